"""Queries against their SQL on whole tables, and operators that only need small fixtures."""

import hashlib
import json

import duckdb
import pytest

from sparkloom.operators import ledger, lint, store
from sparkloom.plans.catalogue import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(values):
    return sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in values)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    expected, got = con.sql(SQL[name]), QUERIES[name](spark, SF)
    order = sorted(got.columns)
    assert order == sorted(expected.columns)
    assert rows(got.select(*order).collect()) == rows(expected.select(*[f'"{c}"' for c in order]).fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_registration_is_as_if_one_by_one(spark):
    import random

    rng = random.Random(4)
    held = [(1000 + k, 0, f"h{k}", f"i{k}") for k in range(5)]
    batch = [(k, rng.randint(0, 20), f"h{rng.randint(0, 30)}", f"i{rng.randint(0, 30)}") for k in range(80)]
    hashes, ids, expected = {h[2] for h in held}, {h[3] for h in held}, {}
    for k, _, h, i in sorted(batch, key=lambda r: (r[1], r[0])):
        expected[k] = "exact_collision" if h in hashes else "id_collision" if i in ids else "registered"
        if expected[k] == "registered":
            hashes.add(h)
            ids.add(i)
    schema = "slug long, at long, hash string, id_key string"
    got = {r.slug: r.status for r in ledger.registered(spark.createDataFrame(held, schema), spark.createDataFrame(batch, schema), "slug", "at").collect()}
    assert got == expected


def test_moves_and_revisions(spark):
    tasks = spark.createDataFrame([("a", "draft"), ("b", "accepted"), ("c", "in_review")], "slug string, status string")
    after, bad = ledger.transitioned(tasks, spark.createDataFrame([("a", "submitted"), ("b", "draft"), ("x", "draft")], "slug string, to_status string"))
    assert sorted(map(tuple, after.collect())) == [("a", "submitted"), ("b", "accepted"), ("c", "in_review")]
    assert sorted((r.slug, r.from_status) for r in bad.collect()) == [("b", "accepted"), ("x", None)]
    asked = spark.createDataFrame([("a", "h1"), ("a", "h2"), ("b", "h3"), ("x", "h4")], "slug string, hash string")
    got = ledger.revisable(tasks, asked, spark.createDataFrame([("h1",)], "hash string"))
    assert sorted((r.hash, r.status) for r in got.collect()) == [("h1", "exact_collision"), ("h2", "ok"), ("h3", "not_revisable"), ("h4", "not_found")]


def test_tree_document_and_store(spark):
    digests = spark.createDataFrame([("b", "z/é", "text", "1" * 64), ("b", "a", "binary", "2" * 64)], "bundle string, path string, kind string, sha256 string")
    roots = spark.createDataFrame([("b", "sha256:" + "3" * 64)], "bundle string, root string")
    entries = [{"path": p, "kind": k, "object": "sha256:" + d * 64} for p, k, d in (("a", "binary", "2"), ("z/é", "text", "1"))]
    data = json.dumps({"format": "t", "bundle_hash": "sha256:" + "3" * 64, "entries": entries}, sort_keys=True, separators=(",", ":")) + "\n"
    got = store.tree_documents(digests, roots, "t").first()
    assert (got.data, got.key) == (data, "sha256:" + hashlib.sha256(data.encode()).hexdigest())
    held = spark.createDataFrame([("k1",)], "key string")
    batch = spark.createDataFrame([("k1", 5), ("k2", 7), ("k2", 7)], "key string, size long")
    assert tuple(store.put_stats(held, batch).first()) == (2, 1, 12, 7)


def test_summary_line(spark):
    schema = "bundles long, bundles_with_findings long, findings long, errors long, warnings long, suppressed long"
    got = lint.summary_line(spark.createDataFrame([(1, 0, 0, 0, 0, 0), (3, 1, 7, 5, 2, 0), (2, 1, 1, 0, 1, 6)], schema)).collect()
    assert [r.line for r in got] == ["No findings in 1 bundle.", "Found 7 findings (5 errors, 2 warnings) in 1 of 3 bundles.", "Found 1 finding (1 warning) in 1 of 2 bundles. 6 suppressed inline."]


def test_secret_scan_entropy_equals_its_sql_whatever_else_is_secret(spark, tmp_path):
    """Values in capitals, other lengths and formats were given too; secret_scan still gives them."""
    small = hashlib.sha256(b"x").hexdigest()[:40]
    aws, word = "AK" + "IA" + "MD62HKU6VBLCCCCE", "q7Rt2LmZ9xWc4VbN8s"
    kept = [f'token = "{small}"', f'A.TOKEN = "{small}" and my_api-key = "{small[::-1]}"x', f'9.token = "{small}"', f'---password = "{small}"', f'see: token = "{small}"', f'é access_key = "{small}"']
    other = [f'TOKEN = "{small.upper()}"', aws, f'password = "{word}"', f'passwd = "{small}"', f'token: "{small}"', f'token = "{small}a"', f'token = "{small[:39]}"', f'max_tokens = "{small}"', 'secret = "' + "a1" * 20 + '"', "", "a." * 50_000 + f'token = "{small}']
    texts = ["\n".join(kept + other), "\r\n".join(other), "", None]
    spark.createDataFrame([(k, t, f"s{k}") for k, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    expected, got = con.sql(SQL["secret_scan_entropy"]), QUERIES["secret_scan_entropy"](spark, str(tmp_path))
    assert rows(got.collect()) == rows(expected.select(*[f'"{c}"' for c in got.columns]).fetchall()) and got.count() == 7
    found = [(r.file, r.line) for r in QUERIES["secret_scan"](spark, str(tmp_path)).collect()]
    assert {("1", k) for k in (1, 2, 3, 4, 5)} <= set(found) and {("0", k) for k in (1, 2, 6, 7, 8, 9, 10, 11)} <= set(found)

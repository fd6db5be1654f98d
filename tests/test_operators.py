import hashlib

from pyspark.sql import functions as F

from sparkloom.operators import ledger, lint, merkle, near_duplicates, store
from sparkloom.sources import bundles


def test_merkle_two_levels(spark):
    files = spark.createDataFrame([("b", "x.txt", bytearray(b"x\r\ny\rz\n")), ("b", "d/y", bytearray(b"\0\r\n")), ("c", "p", bytearray(b"")), ("c", "p/q", bytearray(b""))], "bundle string, path string, content binary")
    digests = merkle.file_digests(files)
    rows = {r.path: r for r in digests.where("bundle = 'b'").collect()}
    assert (rows["x.txt"].kind, rows["x.txt"].size, rows["d/y"].kind) == ("text", 6, "binary")
    x, y = hashlib.sha256(b"x\ny\nz\n").digest(), hashlib.sha256(b"\0\r\n").digest()
    folder = hashlib.sha256(b"\x01fy\0" + y).digest()
    root = hashlib.sha256(b"\x01dd\0" + folder + b"fx.txt\0" + x).digest()
    assert [tuple(r) for r in merkle.roots(digests, "t").collect()] == [("b", "sha256:" + hashlib.sha256(b"t\0" + root).hexdigest())]


def test_merkle_depth_links_and_conflicts(spark):
    sha = lambda b: hashlib.sha256(b).digest()
    leaf = sha(b"x")
    rows = [("deep", "a/b/c/d/e", leaf.hex(), "text"), ("link", "l", leaf.hex(), "symlink"), ("twice", "p", leaf.hex(), "text"), ("twice", "p", leaf.hex(), "text"), ("both", "p", leaf.hex(), "text"), ("both", "p/q", leaf.hex(), "text")]
    digests = spark.createDataFrame(rows, "bundle string, path string, sha256 string, kind string")
    node = sha(b"\x01fe\0" + leaf)
    for name in b"dcba":
        node = sha(b"\x01d" + bytes([name]) + b"\0" + node)
    want = {"deep": node, "link": sha(b"\x01ll\0" + leaf)}
    assert {r.bundle: r.root for r in merkle.roots(digests, "t").collect()} == {b: "sha256:" + sha(b"t\0" + n).hex() for b, n in want.items()}
    assert sorted(map(tuple, merkle.conflicts(digests).collect())) == [("both", "p", "both a file and a folder"), ("twice", "p", "repeated path")]
    assert merkle.roots(digests.limit(0), "t").collect() == []


def test_audit_chain_and_tampering(spark):
    entries = spark.createDataFrame([(k, str(k), "me", "register", "t", "{}") for k in range(4)], "k int, at string, actor string, action string, task_slug string, payload string")
    log = ledger.appended(entries.repartition(3), ["k"])
    assert ledger.head(log) == (4, log.where("seq = 4").first().row_hash) and ledger.head(log.limit(0)) == (0, ledger.GENESIS)
    own = F.udf(lambda r: ledger.audit_hash(r.seq, r.at, r.actor, r.action, r.task_slug, r.payload, r.prev_hash))(F.struct("*"))

    def report(rows):
        r = ledger.chain_report(ledger.chain_faults(rows, content_hash=own)).first()
        heads = {x.seq: x.row_hash for x in log.collect()} | {0: ledger.GENESIS}
        assert r["head"] == heads[r.entries]
        return r.ok, r.entries, r.first_bad_seq, r.reason

    assert report(log) == (True, 4, None, None)
    assert report(log.withColumn("actor", F.when(F.col("seq") == 2, "you").otherwise(F.col("actor")))) == (False, 1, 2, "row edited")
    assert report(log.where("seq <> 2"))[2:] == (3, "row missing or inserted")
    assert report(log.where("seq < 4")) == (True, 3, None, None)
    assert report(log.withColumn("prev_hash", F.when(F.col("seq") == 3, "0" * 64).otherwise(F.col("prev_hash")))) == (False, 2, 3, "prev_hash")
    assert report(log.union(log.where("seq = 3")))[2:] == (3, "row missing or inserted")
    assert report(log.where("seq > 1"))[2:] == (2, "row missing or inserted")
    assert report(log.limit(0)) == (True, 0, None, None)


def test_states(spark):
    rows = [(1, k, s) for k, s in enumerate(("draft", "submitted", "in_review", "accepted", "draft"))] + [(2, 0, "submitted")]
    bad = ledger.illegal_transitions(spark.createDataFrame(rows, "t int, k int, status string"), "t", ["k"], "status")
    assert sorted((r.t, r.from_status, r.to_status) for r in bad.collect()) == [(1, "accepted", "draft"), (2, None, "submitted")]


def test_eviction_matches_a_plain_loop(spark):
    def loop(rows, budget):
        left, out = sum(r[1] or 0 for r in rows), set()
        for key, size, _ in sorted(rows, key=lambda r: (r[2] is not None, r[2], r[0])):
            if left <= budget:
                break
            left -= size or 0
            out.add(key)
        return out

    rows = [(f"{k:04d}", (k * 37) % 91 + 1, (k * 17) % 40) for k in range(500)]
    tied = [(hashlib.sha256(str(k).encode()).hexdigest(), k % 7, 5) for k in range(300)] + [("ab" * 20 + f"{k:03d}", 3, 6) for k in range(200)] + [("old", 4, None), ("none", None, 6)]
    for objects in (rows, tied):
        whole = sum(r[1] or 0 for r in objects)
        df = spark.createDataFrame(objects, "key string, size long, last_used long")
        for budget in (0, 1, whole // 3, whole // 2, whole - 5, whole, 10**9):
            assert {r.key for r in store.evicted(df, budget, cells=7, most=10).collect()} == loop(objects, budget), budget
    numbers = [(k, 1 + k % 5, 3) for k in range(400)]
    df = spark.createDataFrame(numbers, "key long, size long, last_used long")
    assert {r.key for r in store.evicted(df, 300, cells=5, most=3).collect()} == loop(numbers, 300)
    assert store.evicted(df.limit(0), 0).collect() == []


def test_similar_agrees_with_exact_pairs(spark):
    base = [f"w{k} v{k % 7} u{k % 5}" for k in range(60)]
    docs = [(1, " ".join(base)), (2, " ".join(base[:-4])), (3, "other words entirely here"), (4, None), (5, "two words")]
    df = spark.createDataFrame(docs, "id long, text string")
    exact = near_duplicates.jaccard_pairs(near_duplicates.shingle_sets(df, "id", "text"), "id", 0.5).collect()
    assert [(r.a, r.b) for r in exact] == [(1, 2)]
    assert [(r.a, r.b) for r in near_duplicates.similar(df.where("text is not null"), "id", "text").collect()] == [(1, 2)]


def test_bundle_scan(spark, tmp_path):
    for path, content in {"a/task.toml": "schema_version = 1\n", "a/tests/test_x.py": "x = 1\n", "a/.git/c": "", "b/x.md": "hi", "c/task.toml": "= 1"}.items():
        f = tmp_path / "bundles" / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(content)
    files = bundles.bundle_files(spark, str(tmp_path / "bundles"))
    assert sorted((r.bundle, r.path) for r in files.collect()) == [("a", "task.toml"), ("a", "tests/test_x.py"), ("b", "x.md"), ("c", "task.toml")]
    assert {(r.bundle, r.issue) for r in bundles.manifests(files).collect()} == {("a", None), ("b", "missing_manifest"), ("c", "toml_syntax")}
    declared = spark.createDataFrame([("a", "tests", "tests", "dir"), ("a", "solution", "solution", "dir")], "bundle string, loc string, path string, kind string")
    assert [r.path for r in bundles.missing_paths(declared, files).collect()] == ["solution"]


def test_words_are_extracted_once_a_row(spark):
    """The optimizer must not put the extraction into the function over runs."""
    df = spark.createDataFrame([(1, "a b c d")], "id long, text string")
    for rows in (near_duplicates.shingle_rows(df, "id", "text"), near_duplicates.shingle_rows(df, "id", "text").groupBy("id").count()):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") == 1
    pairs = near_duplicates.jaccard_pairs(near_duplicates.shingle_sets(df, "id", "text"), "id", 0.5)
    for line in pairs._jdf.queryExecution().optimizedPlan().toString().split("\n"):
        assert line.count("regexp_extract_all") <= 1 and not ("regexp_extract_all" in line and "lambda" in line), line

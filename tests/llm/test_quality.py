import math
from collections import defaultdict

import pytest

from sparkloom.llm import quality
from sparkloom.llm.quality import RESULT, good_documents, judged, op3_hierarchical_bayes

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_posteriors_equal_loops(spark):
    """The grouped aggregation against the same formulas by loops, from the documents' own evidence."""
    rows = op3_hierarchical_bayes(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang"), "doc_id").collect()
    hosts, paths = defaultdict(list), defaultdict(list)
    for r in rows:
        hosts[r.source].append(r.own_evidence)
        paths[r.source, r.lang].append(r.own_evidence)
    mean = sum(r.own_evidence for r in rows) / len(rows)
    strength = lambda spread: max(1.0, min(1e4, mean * (1 - mean) / spread - 1))
    means = [sum(v) / len(v) for v in hosts.values()]
    centre = sum(means) / len(means)
    k = strength(sum((m - centre) ** 2 for m in means) / len(means))
    host = {h: (k * mean + sum(v)) / (k + len(v)) for h, v in hosts.items()}
    k = strength(sum((sum(v) / len(v) - host[h]) ** 2 for (h, _), v in paths.items()) / len(paths))
    path = {(h, p): (k * host[h] + sum(v)) / (k + len(v)) for (h, p), v in paths.items()}
    logit = lambda p: math.log(p / (1 - p))
    for r in rows:
        assert r.host_posterior == pytest.approx(host[r.source], abs=1e-9) and r.path_posterior == pytest.approx(path[r.source, r.lang], abs=1e-9)
        odds = logit(min(max(r.own_evidence, 1e-6), 1 - 1e-6)) + logit(path[r.source, r.lang]) - logit(mean)
        assert r.posterior == pytest.approx(1 / (1 + math.exp(-odds)), abs=1e-9) and r.kept == (r.posterior >= 0.5)


def test_accuracy_on_labels_not_learnt_from(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    odd = "doc_id % 2 = 1"
    got = judged(docs, labels.where(odd)).join(labels.where(f"not ({odd})").select("doc_id", "quality"), "doc_id").collect()
    good = [r for r in got if r.quality == 1]
    bad = [r for r in got if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.95 * len(good)
    assert sum(not r.kept for r in bad) >= 0.7 * len(bad)


def test_sparse_sites_shrink_and_dense_ones_do_not(spark):
    rows = [("big", "p", 0.9)] * 200 + [("low", "p", 0.2)] * 200 + [("tiny", "p", 0.1)]
    got = {r.host: r for r in quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, _own double")).collect()}
    assert abs(got["big"].host_posterior - 0.9) < 0.02 and abs(got["low"].host_posterior - 0.2) < 0.02
    assert got["tiny"].host_posterior > 0.15


def awkward(spark):
    rows = [(1, None, "en", "a", 0), (2, "", None, None, 0), (None, "some words here", "en", "a", 3), (4, "word " * 200_000, "en", "a", 9), (4, "word " * 200_000, "en", "a", 9), (5, "퟿ \u0000 ok", "", "", 1)]
    return spark.createDataFrame([(*r, "mine", 7) for r in rows], DOCS + ", kept string, _mean int")


def test_nulls_repeats_and_clashing_columns(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 0), (2, 0), (4, 1), (4, 0), (None, 1), (5, None)], "doc_id long, quality int")
    got = judged(docs, labels)
    assert got.columns == [c for c in docs.columns if c != "kept"] + list(RESULT) and got.count() == 6
    twice = [r.posterior for r in got.where("doc_id = 4").collect()]
    assert len(twice) == 2 and twice[0] == twice[1]
    kept = good_documents(docs, labels)
    assert kept.columns == docs.columns and kept.schema == docs.schema and {r.kept for r in kept.collect()} == {"mine"}


def test_without_labels_or_documents(spark):
    docs = awkward(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {round(r.own_evidence, 9) for r in judged(docs, none).collect()} == {0.5}
    assert good_documents(docs, none).count() == 6
    assert judged(docs.limit(0), none).collect() == [] and good_documents(docs.limit(0), none).collect() == []

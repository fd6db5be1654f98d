import re
from collections import Counter

import numpy as np
import pytest

from sparkloom.llm.bagminhash import SLOTS, multisets, near_duplicates, one_of_each, op7_bagminhash, signatures
from sparkloom.llm.shingles import shingle_hashes

SF = "/root/testdata/sf0.001"


def bag(text):
    words = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())
    if not words:
        return Counter()
    return Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def similarity(a, b):
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared) if a or b else 0.0


def classes(rows, threshold=0.8):
    bags = {}
    for doc_id, text in rows:
        bags.setdefault(doc_id, []).append(bag(text))
    ids, root = sorted(bags), {i: i for i in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if any(x and y and similarity(x, y) >= threshold for x in bags[a] for y in bags[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: find(i) for i in ids}


def test_op7_equals_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = op7_bagminhash(spark, SF).collect()
    assert {r.doc_id: r.class_id for r in got} == classes(rows)
    assert all(r.kept == (r.class_id == r.doc_id) and r.n_shingles == sum(bag(dict(rows)[r.doc_id]).values()) for r in got)


@pytest.mark.parametrize("target", [0.3, 0.6, 0.85])
def test_slots_agree_as_often_as_multisets_do(target):
    """The share of equal slots is an unbiased estimate of weighted Jaccard, within five standard errors."""
    rng = np.random.default_rng(int(100 * target))
    agree, exact, trials = [], [], 60
    for _ in range(trials):
        keys = rng.integers(0, 2**63, 150, dtype=np.uint64)
        one = rng.integers(1, 12, 150)
        two = np.where(rng.random(150) < target, one, rng.integers(0, 12, 150))
        keys.sort()
        sig = [signatures(np.zeros(int((c > 0).sum()), np.int64), keys[c > 0], c[c > 0], 1)[0] for c in (one, two)]
        agree.append((sig[0] == sig[1]).mean())
        exact.append(np.minimum(one, two).sum() / np.maximum(one, two).sum())
    error = np.sqrt(np.mean(exact) * (1 - np.mean(exact)) / (SLOTS * trials))
    assert abs(np.mean(agree) - np.mean(exact)) < 5 * error + 0.003


def test_signatures_do_not_depend_on_the_batch():
    texts = ["a b c d e f g h", None, "", "x", "a b c d e f g h " * 50, "one two three four five six"]
    shingles, offsets, _, _ = shingle_hashes(texts)
    whole = signatures(*multisets(shingles, offsets), len(texts))
    for k, t in enumerate(texts):
        shingles, offsets, _, _ = shingle_hashes([t])
        assert (signatures(*multisets(shingles, offsets), 1)[0] == whole[k]).all()


def words(seed, n):
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, 5000, n)]


def edited(base, *places):
    out = list(base)
    for p in places:
        out[p] = "changed"
    return " ".join(out)


def test_hot_groups_lose_no_link(spark):
    base, other = words(1, 120), words(2, 400)
    rows = [(1000 + k, " ".join(base)) for k in range(200)]
    rows += [(2000 + k, edited(base, k % 120)) for k in range(120)]
    rows += [(5000 + k, " ".join(other[k : k + 300])) for k in range(0, 90, 6)]  # a chain: neighbours alike, ends not
    rows += [(9000 + k, " ".join(words(50 + k, 80))) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_duplicates(docs.repartition(5)).collect()} == classes(rows)


def test_nulls_short_long_and_repeated_rows(spark):
    long = " ".join(words(7, 60_000))
    rows = [(1, None), (2, ""), (3, "... !!"), (4, "two words"), (5, "Two  WORDS"), (6, "two words more"), (7, long), (8, long + " end"), (None, "two words"), (9, long), (9, "two words"), (10, "b"), (10, "b"), (11, "... !!"), (12, "..  !!"), (13, " \n"), (14, " \n")]
    docs = spark.createDataFrame([(*r, "x", {"m": 1}) for r in rows], "doc_id long, text string, class_id string, row map<string,int>")
    got = {r.doc_id: (r.class_id, r.kept) for r in near_duplicates(docs).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (3, True), 4: (4, True), 5: (4, False), 6: (6, True), 7: (4, False), 8: (4, False), 9: (4, False), 10: (10, True), 11: (3, False), 12: (12, True), 13: (13, True), 14: (14, True)}
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 10, 12, 13, 14]


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(docs).collect() == [] and one_of_each(docs).collect() == []

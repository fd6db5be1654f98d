import math

import numpy as np
import pytest

from sparkloom.llm.pivots import COSINE, embedding_links, op6_pivot_permutation

SCHEMA = "vec_id long, embedding array<float>, label int"


def usable(v):
    return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def plain(rows):
    """vec_id -> links, by all pairs of a label."""
    links = {r[0]: set() for r in rows}
    groups = {}
    for vec_id, v, label in rows:
        if label is not None and usable(v):
            groups.setdefault((label, len(v)), []).append((vec_id, np.array(v, np.float64)))
    for group in groups.values():
        ids = [g[0] for g in group]
        unit = np.array([g[1] / np.sqrt((g[1] ** 2).sum()) for g in group])
        for a, b in np.argwhere(unit @ unit.T >= COSINE):
            if a != b:
                links[ids[a]].add(ids[b])
    return links


def component(links):
    out = {}
    for node in sorted(links):
        if node in out:
            continue
        todo = [node]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = node
                todo += links[x]
    return out


def compare(got, rows, recall):
    links = plain(rows)
    assert sorted(r.vec_id for r in got) == sorted(links)
    total = sum(map(len, links.values()))
    found = sum(r.n_links for r in got)
    assert recall * total <= found <= total and all(r.n_links <= len(links[r.vec_id]) for r in got)
    exact = component(links)
    assert sum(r.component_id == exact[r.vec_id] for r in got) >= recall * len(got)
    assert all(r.kept == (r.component_id == r.vec_id) for r in got)
    return found / total if total else 1.0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_on_given_vectors(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert compare(op6_pivot_permutation(spark, f"/root/testdata/{sf}").collect(), rows, 0.99) >= 0.99


def test_hot_group_over_several_blocks(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=16)
    rows = [(k, (centre + 0.1 * rng.normal(size=16)).tolist(), 1) for k in range(400)]
    rows += [(1000 + k, centre.tolist(), 1) for k in range(300)] + [(2000 + k, rng.normal(size=16).tolist(), k % 3) for k in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    compare(embedding_links(docs, block=64).collect(), [tuple(r) for r in docs.collect()], 0.95)


@pytest.mark.parametrize("rows", [2000, 9000])
def test_noisy_hot_group_at_several_sizes(spark, rows):
    """A third of the rows are near copies with a mean cosine of 0.95; recall must not fall with the table's size."""
    rng = np.random.default_rng(2)
    centre = rng.normal(size=64)
    hot = centre / np.linalg.norm(centre) + (0.05 / 0.95 / 64) ** 0.5 * rng.normal(size=(rows // 3, 64))
    vectors = np.vstack([hot, rng.normal(size=(rows - len(hot), 64))]).astype(np.float32)
    units = hot.astype(np.float32).astype(np.float64)
    units /= np.linalg.norm(units, axis=1)[:, None]
    true = (units @ units.T >= COSINE).sum() - len(units)
    got = embedding_links(spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(vectors)], SCHEMA)).collect()
    found = sum(r.n_links for r in got)
    print(rows, found / true)
    assert 0.98 * true <= found <= true and len({r.component_id for r in got if r.vec_id < len(hot)}) == 1


def test_vectors_that_cannot_link(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(1, one, 1), (2, one, 2), (3, one, None), (4, None, 1), (5, [0.0] * 3, 1), (6, [1.0, float("nan"), 3.0], 1), (7, [1.0, None, 3.0], 1), (8, [1.0, float("inf"), 3.0], 1), (9, [1.0, 2.0], 1), (10, [], 1), (11, [3.0, -1.0, 0.0], 1)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", kept string")
    got = embedding_links(docs)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect())) == [(r[0], 0, r[0], True) for r in rows]


def test_scaled_and_tiny_copies_link(spark):
    rows = [(5, [1e-30, 2e-30], 1), (3, [10.0, 20.0], 1), (9, [1.0, 2.0], 1), (None, [1.0, 2.0], 1)]
    got = sorted((tuple(r) for r in embedding_links(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert got == [(3, 2, 3, True), (5, 2, 3, False), (9, 2, 3, False), (None, 0, None, True)]


def test_no_vectors(spark):
    assert embedding_links(spark.createDataFrame([], SCHEMA)).collect() == []

"""What must not grow with the tables: what is sent to the driver, what Python holds at once, how often a file is read."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.functions.batches import slices
from sparkloom.operators import merkle
from sparkloom.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def plan_of(df) -> list[str]:
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


@pytest.mark.parametrize("name", ["bundle_fingerprints", "invalid_bundles", "missing_tests", "tree_documents", "missing_declared_paths", "bundle_lint", "code_shingle_sets", "nondeterminism", "bundle_hashes", "network_in_grader", "unpinned_images", "declared_paths", "manifest_issues"])
def test_no_join_by_bundle_is_broadcast(spark, name):
    """Small tables of parts look as large ones do once they are compressed: what is as long as the table is shuffled at any size."""
    assert not [x for x in plan_of(QUERIES[name](spark, SF)) if "Broadcast" in x and "Join" in x and "bundle#" in x]


def test_python_holds_a_few_rows_at_once():
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000))], ["n"])
    got = list(slices([batch, batch.slice(0, 0)], 300))
    assert [b.num_rows for b in got] == [300, 300, 300, 100] and [n for b in got for n in b.column(0).to_pylist()] == list(range(1000))


def test_bundles_are_dealt_out_over_all_cores(spark):
    """Manifests are parsed by as many tasks as shuffles have, however few bytes they are."""
    for name in ("manifest_issues", "declared_paths", "nondeterminism"):
        assert QUERIES[name](spark, SF).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_dockerfiles_are_dealt_out_over_all_cores(spark):
    """As many workers run on small tables as on large ones, so that what they hold in all stays as it is when the table grows."""
    assert QUERIES["unpinned_images"](spark, SF).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_deep_trees_are_read_once_a_level(spark):
    """The digests are read in proportion to the depth; they were read twice as often with each level."""
    scans = []
    for depth in (4, 8):
        digests = spark.range(3).select(F.lit("b").alias("bundle"), F.concat(F.lit("d/" * (depth - 1)), F.col("id").cast("string")).alias("path"), F.sha2(F.col("id").cast("string"), 256).alias("sha256"))
        found = merkle.roots(digests, "t")
        scans.append(sum("Range (" in x for x in plan_of(found)))
        assert found.count() == 1
    assert scans[1] <= 2 * scans[0]


def test_minima_hold_little_and_are_exact():
    """Values that fit a core's cache: arrays of 4 MB were made before."""
    import tracemalloc

    import numpy as np

    from sparkloom.functions import minhash

    a, b = minhash.coefficients()
    edges = [0, 1, (1 << 31) - 1, 1 << 31, 1 << 60, minhash.MODULUS - 2, minhash.MODULUS - 1]
    hashes = np.array([*edges, *(k * 7_919_104_729 % minhash.MODULUS for k in range(4000))], np.uint64)
    tracemalloc.start()
    got = minhash.minima(hashes, a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.tolist() == [min((int(p) * int(x) + int(q)) % minhash.MODULUS for x in hashes) for p, q in zip(a, b)]
    assert peak < 4 << 20
    for x in edges:
        assert minhash.minima(np.array([x], np.uint64), a, b).tolist() == [(int(p) * x + int(q)) % minhash.MODULUS for p, q in zip(a, b)]


def test_runs_of_words_are_made_without_copies_of_the_text(spark):
    from sparkloom.operators import near_duplicates

    texts = ["", "a", "a b", "a b c", "A b! c d", "a b a b a b", None]
    sets = near_duplicates.shingle_sets(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), "k", "text")
    got = {r.k: r.shingles for r in sets.collect()}
    assert got == {0: [], 1: ["a"], 2: ["a b"], 3: ["a b c"], 4: ["a b c", "b c d"], 5: ["a b a", "b a b"], 6: []}
    assert not [x for x in plan_of(sets) if "slice(" in x]

"""A content-addressed object store as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def put(store: DataFrame, batch: DataFrame) -> DataFrame:
    """The objects of batch(key, size, ...) that store(key, ...) lacks, each once."""
    return batch.dropDuplicates(["key"]).join(store.select("key"), "key", "left_anti")


def corrupt(objects: DataFrame) -> DataFrame:
    """Objects whose bytes do not have their key."""
    return objects.where(F.sha2("data", 256) != F.col("key"))


def touched(store: DataFrame, keys: DataFrame, now) -> DataFrame:
    """store with last_used raised to now for keys."""
    hit = keys.select("key").distinct().withColumn("_hit", F.lit(True))
    return store.join(hit, "key", "left").withColumn("last_used", F.when(F.col("_hit"), F.greatest("last_used", F.lit(now))).otherwise(F.col("last_used"))).drop("_hit")


#: Ranges that sums are taken by, and rows that one task may sort.
CELLS, SORTED = 4096, 100_000


def evicted(store: DataFrame, budget: int, cells: int = CELLS, most: int = SORTED) -> DataFrame:
    """The objects of store(key, size, last_used: a number) that go, oldest first by (last_used, key), while what is left exceeds the budget.

    A running sum over all objects would need one sorted partition. Sizes are summed by ranges instead: those before the range in
    which the budget lies go whole, those behind it stay, and that one is looked at more closely, first by last_used and where many
    share one by their keys, until one task may sort it. Each look is one aggregation of a few thousand rows. Null sizes count as 0, a
    null last_used as the oldest.
    """
    held = store.withColumn("_size", F.coalesce("size", F.lit(0))).withColumn("_used", F.coalesce(F.col("last_used").cast("double"), F.lit(float("-inf"))))
    left = held.agg(F.sum("_size").alias("s")).first()["s"] or 0
    if left <= budget:
        return store.limit(0)
    text = dict(store.dtypes)["key"] == "string"
    measures = [("_used", F.col("_used")), *((f"_key{k}", _six_bytes(k)) for k in range(12))] if text else [("_used", F.col("_used")), ("_key", F.col("key").cast("double"))]
    part, gone = held, []
    for name, measure in measures:
        part = part.withColumn(name, measure)
        rows = None
        while rows is None or rows > most:
            ends = part.where(F.col(name) > float("-inf")).agg(F.min(name).alias("lo"), F.max(name).alias("hi")).first()
            lo, width = float(ends["lo"] or 0), float((ends["hi"] or 0) - (ends["lo"] or 0))
            cell = F.when(F.col(name) < lo, -1).otherwise(F.floor((F.col(name) - lo) * ((cells - 1) / width if width else 0.0)))
            sums = part.groupBy(cell.alias("c")).agg(F.sum("_size").alias("s"), F.count("*").alias("n")).collect()
            for r in sorted(sums, key=lambda r: r["c"]):
                if left - r["s"] <= budget:
                    break
                left -= r["s"]
            gone.append(part.where(cell < r["c"]))
            part, rows = part.where(cell == r["c"]), r["n"]
            if not width or r["c"] < 0:
                break
        if rows <= most:
            break
    before = F.coalesce(F.sum("_size").over(Window.orderBy("last_used", "key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gone.append(part.withColumn("_before", before).where(F.lit(left) - F.col("_before") > budget))
    out = gone[0].select(store.columns)
    for rows in gone[1:]:
        out = out.unionByName(rows.select(store.columns))
    return out


def _six_bytes(k: int):
    """Bytes 6k to 6k + 5 of a key as a number, in the order of keys."""
    taken = F.substring(F.encode("key", "UTF-8"), 6 * k + 1, 6)
    return F.conv(F.rpad(F.hex(taken), 12, "0"), 16, 10).cast("long")


def put_stats(store: DataFrame, batch: DataFrame) -> DataFrame:
    """One row: objects, new_objects, bytes, new_bytes of batch(key, size) against store(key)."""
    distinct = batch.select("key", "size").dropDuplicates(["key"]).join(store.select("key", F.lit(True).alias("_held")).distinct(), "key", "left")
    fresh = F.col("_held").isNull()
    return distinct.agg(
        F.count("*").alias("objects"), F.count_if(fresh).alias("new_objects"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.when(fresh, F.col("size"))), F.lit(0)).alias("new_bytes")
    )


def tree_documents(digests: DataFrame, roots: DataFrame, tag: str) -> DataFrame:
    """digests(bundle, path, kind, sha256), roots(bundle, root) -> (bundle, key, data): the JSON that lists a bundle's entries
    in order of their paths, with sorted keys and a final newline, and the key it is stored under."""
    entry = F.struct("kind", F.concat(F.lit("sha256:"), "sha256").alias("object"), "path")
    listed = digests.groupBy("bundle").agg(F.array_sort(F.collect_list(F.struct(F.col("path").cast("binary").alias("_p"), entry.alias("e")))).alias("l"))
    document = F.struct(F.col("root").alias("bundle_hash"), F.transform("l", lambda x: x["e"].alias("e")).alias("entries"), F.lit(tag).alias("format"))
    data = F.concat(_ascii(F.to_json(document)), F.lit("\n"))
    return listed.hint("merge").join(roots, "bundle").select("bundle", F.concat(F.lit("sha256:"), F.sha2(data, 256)).alias("key"), data.alias("data"))


def _ascii(json_text):
    """JSON whose characters beyond printable ASCII are escaped (as UTF-16 units)."""
    chars = F.transform(F.split(json_text, ""), lambda c: F.when(c.rlike("^[\\x00-\\x7e]*$"), c).otherwise(F.lower(F.regexp_replace(F.hex(F.encode(c, "UTF-16BE")), "(....)", r"\\u$1"))))
    return F.when(json_text.rlike(r"^[\x00-\x7e]*$"), json_text).otherwise(F.array_join(chars, ""))


def stale(files: DataFrame, now, seconds: int = 3600) -> DataFrame:
    """Temporary files(path, mtime) older than so many seconds, strictly."""
    return files.where(F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("mtime") > seconds * 1_000_000)


def totals(store: DataFrame) -> DataFrame:
    return store.agg(F.count("*").alias("objects"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))

"""Content hashes of file trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_binary

FILE, FOLDER, LINK = "f", "d", "l"


def canonical_files(files: DataFrame) -> DataFrame:
    """files(bundle, path, content binary) -> with kind, size, sha256 and content of the canonical bytes: text has LF newlines."""
    text = F.encode(F.regexp_replace(F.decode("content", "ISO-8859-1"), "\r\n|\r", "\n"), "ISO-8859-1")
    binary = is_binary(F.col("content"))
    rows = files.select("bundle", "path", F.when(binary, "binary").otherwise("text").alias("kind"), F.when(binary, F.col("content")).otherwise(text).alias("content"))
    return rows.select("bundle", "path", "kind", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"), "content")


def file_digests(files: DataFrame) -> DataFrame:
    """The same without content."""
    return canonical_files(files).drop("content")


def conflicts(digests: DataFrame) -> DataFrame:
    """(bundle, path, problem): paths that a bundle has twice, and files that are folders of others too."""
    level = digests.select("bundle", "path")
    twice = level.groupBy("bundle", "path").agg(F.count("*").alias("n")).where("n > 1").select("bundle", "path", F.lit("repeated path").alias("problem"))
    parts = F.split("path", "/")
    above = level.where(F.size(parts) > 1).select("bundle", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("path"))
    return twice.union(level.distinct().join(above.distinct().hint("merge"), ["bundle", "path"], "left_semi").withColumn("problem", F.lit("both a file and a folder")))


def roots(digests: DataFrame, tag: str) -> DataFrame:
    """digests(bundle, path, sha256[, kind]) -> (bundle, root): one aggregation per level of folders, deepest first, however deep they are.

    A folder's digest is sha256 of a 1 byte and its sorted entries, each its kind (symlinks have one of their own), name, a 0 byte and
    the digest. Bundles with conflicts() have no root.
    """
    kind = F.when(F.col("kind") == "symlink", LINK).otherwise(FILE) if "kind" in digests.columns else F.lit(FILE)
    depth = digests.agg(F.max(F.size(F.split("path", "/"))).alias("d")).first()["d"] or 0
    level = digests.join(conflicts(digests).select("bundle").distinct().hint("merge"), "bundle", "left_anti")
    level = level.select("bundle", F.split("path", "/").alias("parts"), F.unhex("sha256").alias("digest"), kind.alias("kind"))
    nodes = level.limit(0)
    for size in range(depth, 0, -1):  # a level is its own files and the folders that those below make, so each file is read once
        here = level.where(F.size("parts") == size).unionByName(nodes)
        entry = F.concat(F.encode(F.col("kind"), "utf-8"), F.encode(F.element_at("parts", -1), "utf-8"), F.unhex(F.lit("00")), F.col("digest"))
        grouped = here.select("bundle", F.slice("parts", 1, size - 1).alias("parts"), F.struct(F.encode(F.element_at("parts", -1), "utf-8").alias("name"), entry.alias("entry")).alias("e"))
        grouped = grouped.groupBy("bundle", "parts").agg(F.array_sort(F.collect_list("e")).alias("entries"))
        joined = F.aggregate("entries", F.unhex(F.lit("01")), lambda a, e: F.concat(a, e["entry"]))
        nodes = grouped.select("bundle", "parts", F.unhex(F.sha2(joined, 256)).alias("digest"), F.lit(FOLDER).alias("kind"))
    root = F.sha2(F.concat(F.encode(F.lit(tag), "utf-8"), F.unhex(F.lit("00")), F.col("digest")), 256)
    return nodes.select("bundle", F.concat(F.lit("sha256:"), root).alias("root"))

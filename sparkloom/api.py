"""One call for each thing to do with bundles on disk, caches and ledgers. Results are DataFrames unless they end in a document."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import bundle_rules, ledger, lint, merkle, near_duplicates, rules
from .operators.ledger_tables import Ledger
from .operators.objects import ObjectStore
from .operators.settled import settled
from .sources import bundles

#: Tags that digests carry, so that those of different things never agree.
BUNDLE_TAG, TREE_TAG = "sparkloom-bundle/v1", "sparkloom-tree/v1"


class Settings:
    """Folders named by the environment: SPARKLOOM_CACHE and SPARKLOOM_LEDGER, below SPARKLOOM_HOME (.sparkloom) by default."""

    def __init__(self, environ: Mapping[str, str] | None = None):
        given = os.environ if environ is None else environ
        home = given.get("SPARKLOOM_HOME") or ".sparkloom"
        self.cache, self.ledger = (given.get(f"SPARKLOOM_{n.upper()}") or os.path.join(home, n) for n in ("cache", "ledger"))


def uri(path: str) -> str:
    return path if "://" in path else "file://" + os.path.abspath(path)


class Bundles:
    """Bundles at the given paths, read once."""

    def __init__(self, spark: SparkSession, paths: list[str]):
        self.spark, self.paths = spark, [p.rstrip("/") or "/" for p in paths]
        self.entries = settled(bundles.bundle_entries(spark, list(dict.fromkeys(self.paths))))
        self.files = self.entries.where("content is not null").select("bundle", "path", "content", "size")
        self.layout = settled(bundle_rules.layouts(bundles.manifests(self.entries)))

    def issues(self) -> DataFrame:
        """(bundle, file, loc, code, message): of manifests, and of declared paths where the manifest is sound."""
        own = self.layout.select("bundle", F.explode("issues").alias("i")).select("bundle", "i.file", "i.loc", "i.code", "i.message")
        declared = self.layout.select("bundle", F.explode("declared").alias("d")).select("bundle", "d.loc", "d.path", "d.kind")
        absent = bundles.missing_paths(declared, self.entries).select("bundle", F.lit("task.toml").alias("file"), "loc", "code", F.concat(F.lit("'"), "path", F.lit("': "), F.regexp_replace("code", "_", " ")).alias("message"))
        return own.unionByName(absent)

    def validated(self) -> DataFrame:
        """(bundle, valid, issues)."""
        told = self.issues().groupBy("bundle").agg(F.array_sort(F.collect_list(F.struct("file", "loc", "code", "message"))).alias("issues"))
        return self.layout.select("bundle").join(told, "bundle", "left").select("bundle", F.col("issues").isNull().alias("valid"), F.coalesce("issues", F.array().cast("array<struct<file:string,loc:string,code:string,message:string>>")).alias("issues"))

    def contents(self) -> DataFrame:
        """(bundle, path, kind, size, sha256, content) of what hashes cover: canonical bytes of all entries, the canonical manifest for task.toml."""
        sound = self.layout.where("canonical is not null").select("bundle", F.col("canonical").cast("binary").alias("content"))
        manifest = sound.select("bundle", F.lit("task.toml").alias("path"), F.lit("manifest").alias("kind"), F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"), "content")
        rest = self.entries.where("path <> 'task.toml' and problem is null").join(sound.select("bundle"), "bundle", "left_semi")
        links = rest.where("link_target is not null").select("bundle", "path", F.lit("symlink").alias("kind"), "size", F.sha2("link_target", 256).alias("sha256"), F.encode("link_target", "UTF-8").alias("content"))
        return manifest.unionByName(merkle.canonical_files(rest.where("content is not null").select("bundle", "path", "content"))).unionByName(links)

    def hashes(self) -> DataFrame:
        """(bundle, root) of bundles whose manifest is sound and that hold nothing that cannot be hashed."""
        bad = self.entries.where("problem is not null").select("bundle").distinct()
        return merkle.roots(self.contents().drop("content").join(bad, "bundle", "left_anti"), BUNDLE_TAG)

    def fingerprints(self) -> DataFrame:
        return near_duplicates.fingerprints(self.files, self.layout)

    def similar(self, threshold: float = 0.5) -> DataFrame:
        """Pairs in the order of the paths given."""
        order = self.spark.createDataFrame(list(enumerate(self.paths)), "ordinal long, bundle string")
        prints = order.join(self.fingerprints(), "bundle").select("ordinal", F.col("bundle").alias("key"), "instruction", "solution")
        return near_duplicates.similar_bundles(prints, threshold)

    def linted(self, select: list[str] = (), ignore: list[str] = ()) -> tuple[DataFrame, DataFrame]:
        """(findings, (bundle, suppressed))."""
        return rules.linted(self.files, self.layout, [("select", s) for s in select] + [("ignore", s) for s in ignore])

    def submissions(self, actor: str) -> DataFrame:
        """What a ledger takes, of the bundles that have a hash, in the order of their paths."""
        task = F.from_json("manifest", "task struct<id string, version string, title string>")["task"]
        order = self.spark.createDataFrame(list(enumerate(dict.fromkeys(self.paths))), "ordinal long, bundle string")
        told = self.layout.select("bundle", task.alias("t")).join(self.hashes(), "bundle").join(self.fingerprints(), "bundle").join(order, "bundle")
        return settled(told.select(F.col("t.id").alias("slug"), F.col("t.version").alias("version"), F.col("t.title").alias("title"), F.col("root").alias("content_hash"), F.lit(actor).alias("actor"), "instruction", "solution", "ordinal"))


def report(held: Bundles, kind: str = "text", select: list[str] = (), ignore: list[str] = ()) -> tuple[str, int]:
    """(document, exit code): findings as text, json (a document a line and bundle) or sarif; 1 if one is an error. Findings come to the driver."""
    found, taken = held.linted(select, ignore)
    found = settled(found)
    table = rules.RULES.table(held.spark)
    counts = lint.summary(found, table, held.layout.select("bundle"), taken)
    code = int(counts.first()["errors"] > 0)
    if kind == "sarif":
        results = [r.result for r in lint.sarif_results(found, table, os.getcwd()).orderBy("uri", "fingerprint").collect()]
        return lint.sarif_log(results, [tuple(r[:5]) for r in rules.RULES]), code
    rows = (lint.json_report(found, table) if kind == "json" else lint.text_report(found, table)).orderBy("bundle").collect()
    if kind == "json":
        return "\n".join(r.report for r in rows), code
    return "\n".join([*(f"{r.bundle}\n{r.report}" for r in rows), lint.summary_line(counts).first().line]), code


__all__ = ["Bundles", "Ledger", "ObjectStore", "Settings", "ledger", "report", "uri"]

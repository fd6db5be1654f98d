"""Scans of task bundles: folders with a task.toml."""

from __future__ import annotations

import datetime
import json
import os
import re
import tomllib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import slices
from ..functions.text import IGNORED, ignored
from ..operators.merkle import file_digests
from ..operators.settled import dealt

TEXT_LIMIT = 4 << 20


def bundle_files(spark: SparkSession, root: str) -> DataFrame:
    """(bundle, path, content, size, mtime) of all files below root/<bundle>/, without ignored names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = "^.*?" + root.rstrip("/").split("/")[-1].replace(".", r"\.") + "/"
    rest = F.regexp_replace("path", prefix, "")
    rows = files.select(F.substring_index(rest, "/", 1).alias("bundle"), F.expr("1").alias("_"), rest.alias("rest"), "content", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    rows = rows.withColumn("path", F.expr("substring(rest, length(bundle) + 2)")).drop("_", "rest")
    return rows.where((F.col("path") != "") & ~ignored(F.col("path"))).select("bundle", "path", "content", "size", "mtime")


def bundle_entries(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(bundle, path, content, link_target, size, problem) of what lies below each folder of roots, a folder a task: regular files with
    their bytes, symlinks with their targets and not followed, names in NFC, ignored names left out with all below them. What is neither
    file, folder nor link, and a folder that cannot be read, is a problem. A root is a bundle by its own path, on a file system that
    executors have mounted.
    """
    schema = "bundle string, path string, content binary, link_target string, size long, problem string"
    names = re.compile(IGNORED)

    def entries(root: str):
        left = [("", root)]
        while left:
            prefix, folder = left.pop()
            try:
                found = sorted(os.scandir(folder), key=lambda e: e.name)
            except OSError as wrong:
                yield (prefix.rstrip("/") or ".", None, None, None, f"unreadable folder: {wrong.strerror}")
                continue
            for entry in found:
                name = unicodedata.normalize("NFC", entry.name)
                if names.match(name):
                    continue
                if entry.is_symlink():
                    yield (prefix + name, None, target := os.readlink(entry.path), len(os.fsencode(target)), None)
                elif entry.is_dir():
                    left.append((f"{prefix}{name}/", entry.path))
                elif entry.is_file():
                    try:
                        with open(entry.path, "rb") as data:
                            content = data.read()
                        yield (prefix + name, content, None, len(content), None)
                    except OSError as wrong:
                        yield (prefix + name, None, None, None, f"unreadable file: {wrong.strerror}")
                else:
                    yield (prefix + name, None, None, None, "unsupported file type (not a file, folder or symlink)")

    def run(stream):
        kinds = [pa.string(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.string()]
        for batch in stream:
            for root in batch.column(0).to_pylist():
                held, size = [], 0
                for entry in entries(root):
                    held.append((root, *entry))
                    size += entry[3] or 0
                    if len(held) >= 1000 or size > TEXT_LIMIT:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], [f.split()[0] for f in schema.split(", ")])
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], [f.split()[0] for f in schema.split(", ")])

    listed = spark.createDataFrame([(r.rstrip("/"),) for r in roots], "root string")
    return listed.repartition(max(1, len(roots)), "root").mapInArrow(run, schema)


def canonical_path(path: str) -> str:
    """NFC of a relative path in normal form; ValueError for others."""
    if path.startswith("/") or {"", ".", ".."} & set(path.split("/")):
        raise ValueError(f"{path!r}: expected a normalized bundle-relative POSIX path")
    return unicodedata.normalize("NFC", path)


def entry_digests(entries: DataFrame) -> DataFrame:
    """entries(bundle, path, content, link_target) as bundle_entries gives them -> (bundle, path, kind, size, sha256); a link's digest is its target's."""
    links = entries.where("link_target is not null").select("bundle", "path", F.lit("symlink").alias("kind"), F.octet_length("link_target").cast("long").alias("size"), F.sha2("link_target", 256).alias("sha256"))
    return file_digests(entries.where("content is not null").select("bundle", "path", "content")).unionByName(links)


def text_lines(paths: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """paths(bundle, file, uri) -> (bundle, file, line, source) of text files of any size, read a chunk at a time: a line ends with CRLF, CR or LF, and
    bytes that are not UTF-8 are replaced. A file with a NUL in its first 8 KiB is binary and has none, nor has one that cannot be read."""

    def run(stream):
        for batch in stream:
            for bundle, file, uri in zip(*(batch.column(k).to_pylist() for k in range(3))):
                number = 0
                for lines in _lines(uri, chunk):
                    count = len(lines)
                    yield pa.RecordBatch.from_arrays([pa.array([bundle] * count, pa.string()), pa.array([file] * count, pa.string()), pa.array(range(number + 1, number + count + 1), pa.int32()), pa.array(lines, pa.string())], ["bundle", "file", "line", "source"])
                    number += count

    return paths.select("bundle", "file", "uri").mapInArrow(run, "bundle string, file string, line int, source string")


def _lines(uri: str, chunk: int) -> Iterator[list[str]]:
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(uri)
    try:
        source = files.open_input_stream(path)
    except OSError:
        return
    with source:
        data, held, first = source.read(max(chunk, 8192)), b"", True
        while data or held:
            if first and b"\0" in data[:8192]:
                return
            first, more = False, source.read(chunk)
            held += data
            whole = re.split(b"\r\n|\r|\n", held)
            if more:  # the last line goes on, and a CR at the end may have its LF yet
                keep = whole.pop()
                if held.endswith(b"\r"):
                    keep = (whole.pop() + b"\r") if whole else keep
                held = keep
            else:
                whole, held = (whole[:-1] if whole[-1] == b"" else whole), b""
            if whole:
                yield [x.decode("utf-8", "replace") for x in whole]
            data = more


def texts(files: DataFrame) -> DataFrame:
    """Files read as text: at most 4 MiB, no NUL; bytes that are not UTF-8 are replaced."""
    small = files.where((F.col("size") <= TEXT_LIMIT) & ~F.contains("content", F.unhex(F.lit("00"))))
    return small.select("bundle", F.col("path").alias("file"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def manifests(files: DataFrame) -> DataFrame:
    """(bundle, manifest JSON, issue, source): the parsed task.toml, or why there is none. A problem of files at that path makes it unreadable."""

    def run(stream):
        for batch in slices(stream):
            out = [(bundle, None, "manifest_unreadable", None) if bad else (bundle, *_parsed(content)) for bundle, content, bad in zip(*(batch.column(k).to_pylist() for k in range(3)))]
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["bundle", "manifest", "issue", "source"])

    bad = F.col("problem").isNotNull() if "problem" in files.columns else F.lit(False)
    named = files.where("path = 'task.toml'").select("bundle", "content", bad.alias("bad"))
    every = dealt(files.select("bundle").distinct(), "bundle").join(dealt(named, "bundle"), "bundle", "left").select("bundle", "content", F.coalesce("bad", F.lit(False)))
    return every.mapInArrow(run, "bundle string, manifest string, issue string, source string")


def _parsed(content: bytes | None) -> tuple[str | None, str | None, str | None]:
    if content is None:
        return None, "missing_manifest", None
    try:
        source = content.decode()
        return json.dumps(tomllib.loads(source), default=_typed, sort_keys=True), None, source
    except UnicodeDecodeError:
        return None, "manifest_encoding", None
    except tomllib.TOMLDecodeError:
        return None, "toml_syntax", content.decode()


def _typed(value) -> dict:
    """Dates keep their type in JSON."""
    return {"$" + type(value).__name__: value.isoformat()}


def revived(text: str) -> dict:
    """The TOML values of a manifest's JSON."""
    kinds = {"$date": datetime.date, "$datetime": datetime.datetime, "$time": datetime.time}

    def one(d: dict):
        key = next(iter(d), None)
        return kinds[key].fromisoformat(d[key]) if len(d) == 1 and key in kinds else d

    return json.loads(text, object_hook=one)


def missing_paths(declared: DataFrame, files: DataFrame) -> DataFrame:
    """declared(bundle, loc, path, kind) that a bundle does not hold as declared, with code: wrong_path_kind (a folder for a file, or the other
    way), path_unreadable (files has a problem there), path_escapes_bundle (a symlink on the way leads outside), path_not_found.

    files(bundle, path[, link_target, problem]); symlinks that stay inside are followed once. Nothing is sent to the driver.
    """
    column = lambda c: F.col(c) if c in files.columns else F.lit(None).cast("string")
    held = files.hint("merge").select("bundle", "path", column("link_target").alias("target"), column("problem").alias("problem"))
    parts = F.split("path", "/")
    above = lambda rows: rows.where(F.size(parts) > 1).select("bundle", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("path"))
    present = held.where("target is null and problem is null").select("bundle", "path", F.lit("file").alias("is")).union(above(held).select("bundle", "path", F.lit("dir"))).union(held.select("bundle", F.lit("."), F.lit("dir"))).distinct().hint("merge")
    links = held.where("target is not null")
    folder = F.regexp_replace("path", "(^|/)[^/]*$", "")
    joined = F.when(F.startswith("target", F.lit("/")), F.col("target")).otherwise(F.concat_ws("/", F.when(folder != "", folder), "target"))
    up = lambda done, p: F.when(p.isin("", "."), done).when((p == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, p))
    to = F.aggregate(F.split(joined, "/"), F.array().cast("array<string>"), up)
    outside = F.startswith("target", F.lit("/")) | F.coalesce(F.get(to, F.lit(0)) == "..", F.lit(False))
    links = links.select("bundle", F.col("path").alias("link"), outside.alias("outside"), F.array_join(to, "/").alias("to"))
    asked = declared.join(present.select("bundle", "path", F.col("is")), ["bundle", "path"], "left").groupBy(*declared.columns).agg(F.collect_set("is").alias("kinds"))
    asked = asked.join(held.where("problem is not null").select("bundle", "path", F.lit(True).alias("bad")).distinct().hint("merge"), ["bundle", "path"], "left")
    through = (F.col("x.bundle") == F.col("l.bundle")) & ((F.col("x.path") == F.col("l.link")) | F.startswith("x.path", F.concat("l.link", F.lit("/"))))
    linked = asked.alias("x").join(links.alias("l"), through).select("x.bundle", "x.loc", F.col("l.outside"), F.concat("l.to", F.expr("substring(x.path, length(l.link) + 1)")).alias("path"))
    linked = linked.join(present, ["bundle", "path"], "left").groupBy("bundle", "loc").agg(F.max("outside").alias("outside"), F.collect_set("is").alias("behind"))
    asked = asked.join(linked.hint("merge"), ["bundle", "loc"], "left")
    kinds = F.concat("kinds", F.coalesce("behind", F.array().cast("array<string>")))
    code = F.when(F.col("bad"), "path_unreadable").when(F.col("outside"), "path_escapes_bundle").when(F.array_contains(kinds, F.col("kind")), F.lit(None)).when(F.size(kinds) > 0, "wrong_path_kind").otherwise("path_not_found")
    return asked.withColumn("code", code).where("code is not null").select(*declared.columns, "code")

"""Shared plumbing: the folder that driver and executors share, staged tables, and files written by tasks."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only if it has at most so many rows of fixed width (below 100 bytes each).
BROADCAST_ROWS = 400_000

_own: dict[str, str] = {}
_kept: dict = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where it is unset a folder is made for this process, which only a local master can do: on a cluster
    executors would not see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="sparkloom-")
        atexit.register(_remove_local, _own[app])
    return "file://" + _own[app]


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors.

    The files stay until they are discarded, or until the folder goes: what is returned to a caller may read them at any time.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Remove the files of staged tables that nothing will read again."""
    for df in tables:
        remove(df.sparkSession, df.staged_path)


def sized_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` rows; beyond that the join shuffles.

    Meant for staged tables, whose count comes from Parquet footers.
    """
    return F.broadcast(df) if df.count() <= limit else df


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


def write_file(uri: str, chunks) -> None:
    """Write byte strings to uri under a temporary name and rename, so that a retried task replaces its file whole."""
    files, path = _filesystem(uri)
    files.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(part) as out:
        for chunk in chunks:
            out.write(chunk)
    files.move(part, path)


def open_file(uri: str):
    """A seekable pyarrow file."""
    files, path = _filesystem(uri)
    return files.open_input_file(path)


def kept(key, make):
    """make(), kept by a worker process between tasks until it is asked for something else: workers outlive operators, and
    what several of them remember would add up."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores behind those that df has already (in either case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, text, label) of at most `most` doc_ids of labels(doc_id, label) that docs has, those with the smallest
    hashes. Ids are chosen before any text is read, and their number bounds what is broadcast; a doc_id that several
    rows of docs repeat gives its smallest text.
    """
    known = labels.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    ids = staged(known.select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "sample")
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))

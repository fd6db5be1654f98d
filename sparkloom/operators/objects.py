"""Objects named by their content in a folder that driver and executors share: ab/cdef..., one file each.

Objects are written under another name and renamed, so that a task that is run again, or two that write the same object, leave one whole
file. When an object was last used is a table beside them (.recency), as not every store can change a file's time; the file's own
time counts too.
"""

from __future__ import annotations

import datetime
import os
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import object_key, object_path
from . import store
from .settled import settled

_OBJECT = r"/([0-9a-f]{2})/([0-9a-f]{62})$"
_PARTIAL = r"/tmp-[0-9a-f]{32}$"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


def _written(uri: str, data: bytes) -> bool:
    """Whether the file is new. Local files are synced and read-only afterwards."""
    files, path = _filesystem(uri)
    if files.get_file_info(path).is_file:
        return False
    folder = os.path.dirname(path)
    files.create_dir(folder, recursive=True)
    part = f"{folder}/tmp-{uuid.uuid4().hex}"
    with files.open_output_stream(part) as out:
        out.write(data)
    if files.type_name == "local":
        with open(part, "rb") as done:
            os.fsync(done.fileno())
        os.chmod(part, 0o444)
    files.move(part, path)
    return True


class ObjectStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def put(self, contents: DataFrame, now: datetime.datetime | None = None) -> DataFrame:
        """contents(data binary, ...) -> (key, size, new), one row per distinct object. Those that the store has are touched, not written. Null data
        is left out. Files are there when this returns."""
        root = self.root

        def write(stream):
            for batch in stream:
                keys, data = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                new = [_written(f"{root}/{key[:2]}/{key[2:]}", raw) for key, raw in zip(keys, data)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(d) for d in data], pa.int64()), pa.array(new)], ["key", "size", "new"])

        keyed = contents.where("data is not null").select(F.sha2("data", 256).alias("key"), "data").dropDuplicates(["key"])
        known = self.objects().select("key")
        held = keyed.join(known, "key", "left_semi").select("key", F.octet_length("data").cast("long").alias("size"), F.lit(False).alias("new"))
        done = settled(keyed.join(known, "key", "left_anti").mapInArrow(write, "key string, size long, new boolean").unionByName(held))
        self.touch(done.select("key"), now)
        return done

    def objects(self) -> DataFrame:
        """(key, size, last_used) of all objects; other files are none. Contents are not read."""
        rows = self._listed(_OBJECT).withColumn("key", F.concat(F.regexp_extract("path", _OBJECT, 1), F.regexp_extract("path", _OBJECT, 2)))
        used = self._recency().groupBy("key").agg(F.max("at").alias("at"))
        return rows.join(used, "key", "left").select("key", "size", F.greatest("mtime", "at").alias("last_used"))

    def _listed(self, pattern: str) -> DataFrame:
        kind = "path string, mtime timestamp, size long"
        if not self._exists(self.root):
            return self.spark.createDataFrame([], kind)
        rows = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.root)
        return rows.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size")).where(F.col("path").rlike(pattern))

    def _exists(self, uri: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def _recency(self) -> DataFrame:
        folder = f"{self.root}/.recency"
        kind = "key string, at timestamp"
        return self.spark.read.schema(kind).parquet(folder) if self._exists(folder) else self.spark.createDataFrame([], kind)

    def touch(self, keys: DataFrame, now: datetime.datetime | None = None) -> None:
        at = F.lit(now).cast("timestamp") if now else F.current_timestamp()
        keys.select("key", at.alias("at")).write.mode("append").parquet(f"{self.root}/.recency")

    def has(self, keys: DataFrame) -> DataFrame:
        """keys(key) -> (key, held); a key may have its algorithm before it, a malformed one is null. Nothing is verified or touched."""
        asked = keys.select("key", object_key(F.col("key")).alias("_bare"))
        return asked.join(self.objects().select(F.col("key").alias("_bare"), F.lit(True).alias("held")), "_bare", "left").select("key", F.when(object_key(F.col("key")).isNotNull(), F.coalesce("held", F.lit(False))).alias("held"))

    def get(self, keys: DataFrame, now: datetime.datetime | None = None) -> DataFrame:
        """keys(key) -> (key, data, status): found, not_found, or corrupt, whose file is removed; found ones are touched."""
        root = self.root

        def read(stream):
            for batch in stream:
                out = []
                for key in batch.column(0).to_pylist():
                    files, path = _filesystem(f"{root}/{key[:2]}/{key[2:]}")
                    out.append(files.open_input_stream(path).read() if files.get_file_info(path).is_file else None)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["key", "data"])

        found = keys.select(object_key(F.col("key")).alias("key")).where("key is not null").distinct().mapInArrow(read, "key string, data binary")
        status = F.when(F.col("data").isNull(), "not_found").when(F.sha2("data", 256) != F.col("key"), "corrupt").otherwise("found")
        found = settled(found.withColumn("status", status))
        self._remove(found.where("status = 'corrupt'").select(F.concat(F.lit(f"{root}/"), object_path(F.col("key"))).alias("path")))
        self.touch(found.where("status = 'found'").select("key"), now)
        return found.withColumn("data", F.when(F.col("status") == "found", F.col("data")))

    def _remove(self, paths: DataFrame) -> int:
        def delete(stream):
            for batch in stream:
                for uri in batch.column(0).to_pylist():
                    files, path = _filesystem(uri)
                    if files.get_file_info(path).is_file:
                        files.delete_file(path)
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

        return paths.mapInArrow(delete, "n long").agg(F.sum("n").alias("n")).first()["n"] or 0

    def gc(self, max_bytes: int, now: datetime.datetime | None = None) -> dict[str, int]:
        """Remove the objects used longest ago until the rest fits, and files left by writers over an hour ago."""
        held = settled(self.objects())
        before = store.totals(held).first()
        gone = settled(store.evicted(held.withColumn("last_used", F.unix_micros("last_used")), max_bytes))
        freed = store.totals(gone).first()
        self._remove(gone.select(F.concat(F.lit(f"{self.root}/"), object_path(F.col("key"))).alias("path")))
        partial = store.stale(self._listed(_PARTIAL), now or datetime.datetime.now(datetime.timezone.utc))
        stale = self._remove(settled(partial.select("path")))
        return {"removed": freed["objects"], "freed_bytes": freed["bytes"], "kept": before["objects"] - freed["objects"], "kept_bytes": before["bytes"] - freed["bytes"], "stale": stale}

    def size(self) -> DataFrame:
        return store.totals(self.objects())

    def put_bundles(self, entries: DataFrame, roots: DataFrame, tag: str) -> DataFrame:
        """entries(bundle, path, kind, sha256, content: canonical bytes), roots(bundle, root) -> (bundle, tree, objects, new_objects, bytes, new_bytes):
        each bundle's entries and tree document are put; an object that several bundles hold is new to each of them. Raises if content
        is not what its digest says, as it changed meanwhile.
        """
        changed = entries.where(F.sha2("content", 256) != F.col("sha256")).select("bundle", "path").limit(5).collect()
        if changed:
            raise RuntimeError(f"changed while it was cached: {', '.join(f'{r.bundle}/{r.path}' for r in changed)}")
        trees = settled(store.tree_documents(entries, roots, tag))
        contents = entries.select("bundle", F.col("content").alias("data")).unionByName(trees.select("bundle", F.encode("data", "UTF-8").alias("data")))
        done = self.put(contents.select("data"))
        each = contents.select("bundle", F.sha2("data", 256).alias("key")).distinct().join(done, "key")
        told = each.groupBy("bundle").agg(F.count("*").alias("objects"), F.count_if("new").alias("new_objects"), F.sum("size").alias("bytes"), F.coalesce(F.sum(F.when(F.col("new"), F.col("size"))), F.lit(0)).alias("new_bytes"))
        return told.join(trees.select("bundle", F.col("key").alias("tree")), "bundle")

"""A ledger of tasks as Parquet tables in a folder.

A commit writes the rows that are new (or a whole table where rows change) to folders of their own and then one small file that lists
the folders of each table; that file's rename is the commit, so that readers see all of a write or nothing, and a writer that fails
leaves the state as it was. There is one writer at a time. Rows of a batch count as written one by one in the order given.

Tables: tasks(id, slug, id_key, title, version, content_hash, status, created_at, updated_at), submissions(id, task_id, version,
content_hash, submitted_by, created_at), content_hashes(id, hash, task_id, submission_id, created_at), task_signatures(id, task_id,
submission_id, instruction, solution, created_at), lsh_buckets(id, bucket, task_id), audit_log (see ledger.AUDIT).
"""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import fold_id
from . import ledger, near_duplicates
from .settled import settled

#: Version of the tables' columns.
REVISION = "2"
TABLES = {
    "tasks": "id long, slug string, id_key string, title string, version string, content_hash string, status string, created_at timestamp, updated_at timestamp",
    "submissions": "id long, task_id long, version string, content_hash string, submitted_by string, created_at timestamp",
    "content_hashes": "id long, hash string, task_id long, submission_id long, created_at timestamp",
    "task_signatures": "id long, task_id long, submission_id long, instruction array<long>, solution array<long>, created_at timestamp",
    "lsh_buckets": "id long, bucket string, task_id long",
    "audit_log": ledger.AUDIT,
}
#: What may not occur twice.
UNIQUE = {"tasks": ("slug", "id_key"), "content_hashes": ("hash",), "task_signatures": ("submission_id",), "audit_log": ("seq", "prev_hash", "row_hash")}
#: What a caller gives for a submission; signatures may be null.
SUBMISSION = "slug string, version string, title string, content_hash string, actor string, instruction array<long>, solution array<long>"


def _now() -> datetime.datetime:
    return datetime.datetime.now(datetime.timezone.utc)


class Ledger:
    """The tables in `root`, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], datetime.datetime] = _now):
        self.spark, self.root, self.clock = spark, root.rstrip("/"), clock

    # Storage

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        return path, path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _state(self) -> dict | None:
        path, files = self._files()
        at = path(f"{self.root}/state.json")
        if not files.exists(at):
            return None
        return json.loads(self.spark.read.text(f"{self.root}/state.json", wholetext=True).first()[0])

    def _commit(self, state: dict) -> None:
        path, files = self._files()
        part = path(f"{self.root}/state-{uuid.uuid4().hex}.part")
        out = files.create(part)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        whole = path(f"{self.root}/state.json")
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(part, whole, options)

    def _write(self, changes: dict[str, tuple[bool, DataFrame]]) -> None:
        """table -> (whether it is written whole, rows)."""
        state = self._state()
        for name, (whole, rows) in changes.items():
            folder = f"{name}-{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.root}/{folder}")
            state["tables"][name] = [folder] if whole else [*state["tables"][name], folder]
        self._commit(state)

    def migrate(self) -> str:
        """Make what is missing; an older revision is brought to this one. Returns the revision."""
        state = self._state() or {"tables": {}}
        state["revision"] = REVISION
        state["tables"] = {name: state["tables"].get(name, []) for name in TABLES}
        self._commit(state)
        return REVISION

    def revision(self) -> str | None:
        state = self._state()
        return state and state["revision"]

    def table(self, name: str) -> DataFrame:
        state = self._state()
        if state is None:
            raise RuntimeError(f"{self.root} is no ledger; migrate() makes one")
        folders = [f"{self.root}/{f}" for f in state["tables"][name]]
        return self.spark.read.schema(TABLES[name]).parquet(*folders) if folders else self.spark.createDataFrame([], TABLES[name])

    def broken(self) -> DataFrame:
        """(table, column, value): what occurs twice though it must not."""
        out = self.spark.createDataFrame([], "table string, column string, value string")
        for name, columns in UNIQUE.items():
            for c in columns:
                twice = self.table(name).groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")).where("n > 1")
                out = out.union(twice.select(F.lit(name), F.lit(c), "value"))
        return out

    # Reading

    def get(self, slug: str) -> DataFrame:
        return self.table("tasks").where(F.col("slug") == slug)

    def find_by_hash(self, content_hash: str) -> DataFrame:
        owners = self.table("content_hashes").where(F.col("hash") == content_hash).select(F.col("task_id").alias("id"))
        return self.table("tasks").join(owners, "id", "left_semi")

    def find_by_id_key(self, slug: str) -> DataFrame:
        return self.table("tasks").where(F.col("id_key") == fold_id(F.lit(slug)))

    def history(self, slug: str | None = None) -> DataFrame:
        return ledger.history(self.table("audit_log"), slug)

    def verify(self) -> DataFrame:
        log = ledger.with_own_hash(self.table("audit_log"))
        return ledger.chain_report(ledger.chain_faults(log, content_hash=F.col("own_hash")))

    def signatures(self) -> DataFrame:
        """(key, instruction, solution) of each task's latest submission that has some."""
        last = ledger.latest(self.table("task_signatures"), "task_id", "submission_id", "instruction", "solution")
        return self.table("tasks").select(F.col("id").alias("task_id"), F.col("slug").alias("key")).join(last, "task_id").select("key", "instruction", "solution")

    def near_duplicates(self, prints: DataFrame, threshold: float = 0.5) -> DataFrame:
        """prints(key, instruction, solution) -> their matches among the tasks, ranked; a task is not its own."""
        buckets = self.table("lsh_buckets").join(self.table("tasks").select(F.col("id").alias("task_id"), F.col("slug").alias("key")), "task_id").select("key", "bucket")
        return near_duplicates.ranked(near_duplicates.matches(prints, self.signatures(), threshold, buckets).where("key <> other"))

    def check(self, batch: DataFrame, threshold: float = 0.5) -> DataFrame:
        """batch(SUBMISSION) -> (slug, exact_owner, id_owner, near, status) against the ledger, each row by itself; nothing is written."""
        rows = self._asked(batch)
        near = self.near_duplicates(_prints(rows), threshold)
        listed = near.groupBy(F.col("key").alias("slug")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "other"))), lambda x: x["other"]), ",").alias("near"))
        found = ledger.collisions(self._held(), rows, "slug", near.select(F.col("key").alias("slug")))
        return found.join(listed, "slug", "left").select("slug", "exact_owner", "id_owner", "near", "status")

    # Writing

    def _asked(self, batch: DataFrame) -> DataFrame:
        return batch.withColumn("hash", F.col("content_hash")).withColumn("id_key", fold_id(F.col("slug")))

    def _held(self) -> DataFrame:
        """(slug, hash, id_key) with a row for each hash that a task ever had."""
        owned = self.table("content_hashes").select("hash", F.col("task_id").alias("id"))
        return self.table("tasks").select("id", "slug", "id_key").join(owned, "id", "left").select("slug", "hash", "id_key")

    def register(self, batch: DataFrame, order: str, threshold: float = 0.5, allow_near: bool = False) -> DataFrame:
        """batch(SUBMISSION, order) -> (slug, status); those that are registered are written as drafts, with their audit entries.

        Statuses: exact_collision, id_collision, near_duplicate (told in that order; the last not with allow_near), registered.
        A slug comes once in a batch.
        """
        rows = settled(self._asked(batch))
        prints = _prints(rows)
        found = settled(self.near_duplicates(prints, threshold))
        inside = near_duplicates.matches(prints, prints, threshold).where("key < other").select(F.col("key").alias("slug"), "other")
        gate = None if allow_near else found.select(F.col("key").alias("slug"))
        done = settled(ledger.registered(self._held(), rows, "slug", order, gate, None if allow_near else inside))
        won = done.where("status = 'registered'")
        if not won.isEmpty():
            told = found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", "other", *[F.bround(c, 4).alias(c) for c in _SIMILAR]))).alias("near")) if allow_near else None
            self._submit(won.join(told.withColumnRenamed("key", "slug"), "slug", "left") if told is not None else won.withColumn("near", F.lit(None)), order, "register", threshold)
        return done.select("slug", "status")

    def revise(self, batch: DataFrame, order: str) -> DataFrame:
        """batch(SUBMISSION, order) -> (slug, status); the content of drafts and of tasks that need changes is replaced, their buckets too.

        Statuses: not_found, not_revisable, exact_collision (ever submitted, by this task too, or by a row before), ok. A slug comes once.
        """
        rows = settled(self._asked(batch))
        checked = ledger.revisable(self.table("tasks").select("slug", "status"), rows.select("slug", "hash", order), self.table("content_hashes").select("hash"))
        first = F.row_number().over(Window.partitionBy("hash", "status").orderBy(order, "slug"))
        checked = settled(checked.withColumn("_n", first).withColumn("status", F.when((F.col("status") == "ok") & (F.col("_n") > 1), "exact_collision").otherwise(F.col("status"))).select("slug", "status"))
        good = rows.join(checked.where("status = 'ok'").select("slug"), "slug", "left_semi")
        if not good.isEmpty():
            self._submit(good.withColumn("near", F.lit(None)), order, "revise", 0.0)
        return checked

    def transition(self, moves: DataFrame, order: str) -> DataFrame:
        """moves(slug, to_status, actor, note, order) -> (slug, from_status, to_status, status); allowed ones are written, with their audit entries.

        Statuses: moved, not_found, illegal_transition. A slug comes once.
        """
        tasks, now = self.table("tasks"), F.lit(self.clock())
        _, bad = ledger.transitioned(tasks.select("slug", "status"), moves.select("slug", "to_status"))
        known = moves.join(tasks.select("slug", F.col("status").alias("from_status")), "slug", "left").join(bad.select("slug", F.lit(True).alias("_bad")), "slug", "left")
        status = F.when(F.col("from_status").isNull(), "not_found").when(F.col("_bad"), "illegal_transition").otherwise("moved")
        judged = settled(known.withColumn("status", status))
        good = judged.where("status = 'moved'")
        if not good.isEmpty():
            to = good.select("slug", F.col("to_status").alias("_to"))
            after = tasks.join(to, "slug", "left").withColumn("status", F.coalesce("_to", "status")).withColumn("updated_at", F.when(F.col("_to").isNotNull(), now).otherwise(F.col("updated_at")))
            payload = F.when(F.coalesce("note", F.lit("")) != "", _json(("from", "from_status"), ("note", "note"), ("to", "to_status"))).otherwise(_json(("from", "from_status"), ("to", "to_status")))
            self._write({"tasks": (True, settled(_as("tasks", after))), "audit_log": (False, self._audited(good.withColumn("payload", payload), order, "transition"))})
        return judged.select("slug", "from_status", "to_status", "status")

    def _next(self, name: str) -> int:
        return (self.table(name).agg(F.max("id").alias("m")).first()["m"] or 0) + 1

    def _audited(self, rows: DataFrame, order: str, action: str) -> DataFrame:
        at = F.date_format(F.to_utc_timestamp(F.lit(self.clock()), self.spark.conf.get("spark.sql.session.timeZone")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
        entries = rows.select(order, F.col("slug").alias("task_slug"), at.alias("at"), "actor", F.lit(action).alias("action"), "payload")
        return ledger.appended(entries, [order, "task_slug"], ledger.head(self.table("audit_log")))

    def _submit(self, rows: DataFrame, order: str, action: str, threshold: float) -> None:
        """Rows that are accepted get submissions, hashes, signatures, buckets and audit entries; numbers go on from the last ones, in order.
        A batch of one writer is numbered by one task, as its order is one."""
        tasks, now = self.table("tasks"), F.lit(self.clock())
        numbered = rows.withColumn("_n", F.row_number().over(Window.orderBy(order, "slug")).cast("long") - 1)
        if action == "register":
            numbered = numbered.withColumn("task_id", F.col("_n") + self._next("tasks"))
        else:
            numbered = numbered.join(tasks.select("slug", F.col("id").alias("task_id"), F.col("version").alias("_version"), F.col("content_hash").alias("_hash")), "slug")
        numbered = settled(numbered.withColumn("submission_id", F.col("_n") + self._next("submissions")))
        id_ = lambda name: (F.col("_n") + self._next(name)).alias("id")
        printed = numbered.where("instruction is not null and solution is not null")
        new = numbered.select(F.col("task_id").alias("id"), "slug", "id_key", "title", "version", "content_hash", F.lit("draft").alias("status"), now.alias("created_at"), now.alias("updated_at"))
        hashed = near_duplicates.bucket_rows(printed.select("task_id", "instruction", "solution"), "task_id")
        buckets = self.table("lsh_buckets").join(printed.select("task_id"), "task_id", "left_anti").select("bucket", "task_id").union(hashed.select("bucket", "task_id"))
        changes = {
            "submissions": (False, numbered.select(F.col("submission_id").alias("id"), "task_id", "version", "content_hash", F.col("actor").alias("submitted_by"), now.alias("created_at"))),
            "content_hashes": (False, numbered.select(id_("content_hashes"), F.col("content_hash").alias("hash"), "task_id", "submission_id", now.alias("created_at"))),
            "task_signatures": (False, printed.select(id_("task_signatures"), "task_id", "submission_id", "instruction", "solution", now.alias("created_at"))),
            "lsh_buckets": (True, settled(buckets.withColumn("id", F.monotonically_increasing_id()).select("id", "bucket", "task_id"))),
        }
        if action == "register":
            changes["tasks"] = (False, new)
            payload = _json(("content_hash", "content_hash"), ("status", F.lit("draft")), ("version", "version"))
            if dict(rows.dtypes)["near"] != "void":
                near = F.transform("near", lambda m: F.struct(m["instruction_similarity"].alias("instruction_similarity"), m["similarity"].alias("similarity"), m["other"].alias("slug"), m["solution_similarity"].alias("solution_similarity")))
                payload = F.when(F.col("near").isNotNull(), _json(("content_hash", "content_hash"), ("near_duplicates_allowed", near), ("status", F.lit("draft")), ("threshold", F.lit(threshold)), ("version", "version"))).otherwise(payload)
        else:
            changed = numbered.select("slug", F.col("version").alias("v"), F.col("title").alias("t"), F.col("content_hash").alias("h"))
            after = tasks.join(changed, "slug", "left").withColumns({"updated_at": F.when(F.col("h").isNotNull(), now).otherwise(F.col("updated_at")), "version": F.coalesce("v", "version"), "title": F.coalesce("t", "title"), "content_hash": F.coalesce("h", "content_hash")})
            changes["tasks"] = (True, settled(_as("tasks", after)))
            payload = _json(("content_hash", "content_hash"), ("previous", F.struct(F.col("_hash").alias("content_hash"), F.col("_version").alias("version"))), ("version", "version"))
        changes["audit_log"] = (False, self._audited(numbered.withColumn("payload", payload), order, action))
        self._write({name: (whole, _as(name, df) if name != "audit_log" else df) for name, (whole, df) in changes.items()})


_SIMILAR = ("similarity", "instruction_similarity", "solution_similarity")


def _prints(rows: DataFrame) -> DataFrame:
    return rows.where("instruction is not null and solution is not null").select(F.col("slug").alias("key"), "instruction", "solution")


def _as(name: str, rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(c.split()[0]).cast(c.split(None, 1)[1]).alias(c.split()[0]) for c in TABLES[name].split(", ")])


def _json(*fields: tuple[str, str | Column]) -> Column:
    """Canonical JSON of a row's fields, given by name in order. Slugs, versions and hashes are ASCII; notes are escaped."""
    from .store import _ascii

    return _ascii(F.to_json(F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in fields])))

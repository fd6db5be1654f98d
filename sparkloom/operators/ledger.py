"""Tasks, submissions, their states, and the chained audit log."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .settled import settled

GENESIS = "0" * 64
TRANSITIONS = [
    ("draft", "submitted"),
    ("submitted", "in_review"),
    ("in_review", "accepted"),
    ("in_review", "rejected"),
    ("in_review", "needs_changes"),
    ("needs_changes", "submitted"),
]


def canonical_json(value) -> str:
    """Sorted, compact, ASCII."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def audit_hash(seq, at, actor, action, task, payload, prev) -> str:
    fields = {"action": action, "actor": actor, "at": at, "payload": payload, "prev": prev, "seq": seq, "task": task}
    return hashlib.sha256(canonical_json(fields).encode()).hexdigest()


AUDIT = "seq long, at string, actor string, action string, task_slug string, payload string, prev_hash string, row_hash string"


def head(log: DataFrame) -> tuple[int, str]:
    """(seq, row_hash) of the last entry; (0, GENESIS) of an empty log."""
    last = log.agg(F.max(F.struct("seq", "row_hash")).alias("m")).first()["m"]
    return (last["seq"], last["row_hash"]) if last else (0, GENESIS)


def appended(entries: DataFrame, order: list[str], last: tuple[int, str] = (0, GENESIS)) -> DataFrame:
    """entries(at, actor, action, task_slug, payload, ...) in order, chained behind the last entry. One chain is sequential by nature: one
    task hashes it, a batch of rows at a time."""

    def run(stream):
        seq, prev = last
        for batch in stream:
            rows = []
            for entry in zip(*(batch.column(c).to_pylist() for c in ("at", "actor", "action", "task_slug", "payload"))):
                seq += 1
                rows.append((seq, *entry, prev, audit_hash(seq, *entry, prev)))
                prev = rows[-1][-1]
            columns = list(zip(*rows)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.string()) for c in columns[1:])], [f.split()[0] for f in AUDIT.split(", ")])

    return entries.repartition(1).sortWithinPartitions(*order).mapInArrow(run, AUDIT)


def chained(entries: DataFrame, key: str, order: str) -> DataFrame:
    """entries(key, order, at, actor, action, task_slug, payload) -> with seq, prev_hash, row_hash: one chain a key, in order.

    A chain is sequential by nature, so a key's entries are hashed by one task; chains of different keys are independent.
    """

    def run(table):
        rows, prev = table.sort_by(order), GENESIS
        links: list[tuple[str, str]] = []
        for seq, entry in enumerate(zip(*(rows.column(c).to_pylist() for c in ("at", "actor", "action", "task_slug", "payload"))), 1):
            links.append((prev, audit_hash(seq, *entry, prev)))
            prev = links[-1][1]
        rows = rows.append_column("seq", pa.array(range(1, len(links) + 1), pa.int64()))
        return rows.append_column("prev_hash", pa.array([a for a, _ in links], pa.string())).append_column("row_hash", pa.array([b for _, b in links], pa.string()))

    schema = type(entries.schema)([*entries.schema.fields]).add("seq", "long").add("prev_hash", "string").add("row_hash", "string")
    return entries.groupBy(key).applyInArrow(run, schema)


def with_own_hash(log: DataFrame) -> DataFrame:
    """log with own_hash: what row_hash must be by the row's content."""

    def run(stream):
        for batch in stream:
            own = [audit_hash(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("seq", "at", "actor", "action", "task_slug", "payload", "prev_hash")))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.string())], names=[*batch.schema.names, "own_hash"])

    return log.mapInArrow(run, type(log.schema)([*log.schema.fields]).add("own_hash", "string"))


def chain_faults(log: DataFrame, key: str | None = None, content_hash=None) -> DataFrame:
    """log(seq, prev_hash, row_hash, ...) -> its rows with `reason`, null if sound. content_hash is the column that row_hash must equal.

    Rows are checked against the row before; precedence is sequence, link, content. With a key there is a chain a key, checked in order
    by a window, so that behind a gap all rows are out of sequence. Without one the chain may be long: each row is joined with the one
    before it by its number, and only the row behind a gap is out of sequence, which gives the same first fault.
    """
    if key:
        w = Window.partitionBy(key).orderBy("seq")
        rows = log.withColumn("_gap", F.col("seq") != F.row_number().over(w)).withColumn("_before", F.lag("row_hash", 1, GENESIS).over(w))
    else:
        ends = log.groupBy((F.col("seq") + 1).alias("_next")).agg(F.min("row_hash").alias("_before"))
        twice = log.groupBy(F.col("seq").alias("_seq")).agg(F.count("*").alias("_n")).where("_n > 1")
        rows = log.join(ends, F.col("seq") == F.col("_next"), "left").join(twice, F.col("seq") == F.col("_seq"), "left")
        rows = rows.withColumn("_gap", (F.col("seq") < 1) | ((F.col("seq") > 1) & F.col("_before").isNull()) | F.col("_n").isNotNull())
        rows = rows.withColumn("_before", F.coalesce("_before", F.lit(GENESIS))).drop("_next", "_seq", "_n")
    reason = F.when(F.col("_gap"), "row missing or inserted").when(F.col("prev_hash") != F.col("_before"), "prev_hash")
    if content_hash is not None:
        reason = reason.when(F.col("row_hash") != content_hash, "row edited")
    return rows.withColumn("reason", reason).drop("_gap", "_before")


def chain_report(faults: DataFrame, key: str | None = None) -> DataFrame:
    """One row (or one a key): ok, entries sound before the first fault, the hash they end in, first_bad_seq, reason. Rows behind the first
    fault do not count."""
    first = F.min(F.when(F.col("reason").isNotNull(), F.struct("seq", "reason")))
    keys = [key] if key else []
    bad = faults.groupBy(*keys).agg(first.alias("bad"))
    sound = F.col("bad").isNull() | (F.col("seq") < F.col("bad.seq"))
    both = faults.select(*keys, "seq", "row_hash").join(bad, key) if key else bad.join(faults.select("seq", "row_hash"), F.lit(True), "left")
    one = both.groupBy(*keys, "bad").agg(F.count(F.when(sound, F.col("seq"))).alias("entries"), F.max(F.when(sound, F.struct("seq", "row_hash"))).alias("last"))
    return one.select(*keys, F.col("bad").isNull().alias("ok"), "entries", F.coalesce("last.row_hash", F.lit(GENESIS)).alias("head"), F.col("bad.seq").alias("first_bad_seq"), F.col("bad.reason").alias("reason"))


def illegal_transitions(log: DataFrame, key: str, order: list[str], status: str) -> DataFrame:
    """Steps of each key's log whose pair of states is not allowed; the first state of a key must be draft."""
    spark = log.sparkSession
    w = Window.partitionBy(key).orderBy(*order)
    steps = log.withColumn("from_status", F.lag(status).over(w)).withColumn("to_status", F.col(status))
    allowed = spark.createDataFrame(TRANSITIONS, "from_status string, to_status string")
    later = steps.where("from_status is not null").join(F.broadcast(allowed), ["from_status", "to_status"], "left_anti")
    first = steps.where("from_status is null and to_status <> 'draft'")
    return later.select(key, *order, "from_status", "to_status").unionByName(first.select(key, *order, "from_status", "to_status"))


def first_claims(rows: DataFrame, hash_: str, key: str) -> DataFrame:
    """The smallest key of each hash owns it; rows that come later collide: (key, hash, owner, status)."""
    owner = rows.groupBy(hash_).agg(F.min(key).alias("owner"))
    return rows.select(key, hash_).join(owner, hash_).select(key, hash_, "owner", F.when(F.col("owner") == F.col(key), "registered").otherwise("exact_collision").alias("status"))


def latest(rows: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """The row with the largest `order` of each key, by aggregation without a sort."""
    return rows.groupBy(key).agg(F.max(F.struct(order, *columns)).alias("_m")).select(key, F.col(f"_m.{order}").alias(order), *[F.col(f"_m.{c}").alias(c) for c in columns])


def collisions(held: DataFrame, new: DataFrame, key: str, near: DataFrame | None = None) -> DataFrame:
    """new(key, hash, id_key) against held of the same columns -> (key, exact_owner, id_owner, status).

    Nothing is written. An exact collision is told before one of the folded id, that before a near duplicate
    (near(key): keys of new that have one).
    """
    owner = lambda c, name: held.groupBy(c).agg(F.min(key).alias(name))
    out = new.select(key, "hash", "id_key").join(owner("hash", "exact_owner"), "hash", "left").join(owner("id_key", "id_owner"), "id_key", "left")
    status = F.when(F.col("exact_owner").isNotNull(), "exact_collision").when(F.col("id_owner").isNotNull(), "id_collision")
    if near is not None:
        out = out.join(near.select(key, F.lit(True).alias("_near")).distinct(), key, "left")
        status = status.when(F.col("_near"), "near_duplicate")
    return out.select(key, "exact_owner", "id_owner", status.otherwise("ok").alias("status"))


def registered(held: DataFrame, batch: DataFrame, key: str, order: str, near: DataFrame | None = None, near_pairs: DataFrame | None = None) -> DataFrame:
    """batch(key, order, hash, id_key) as if registered one by one in `order` (ties by key): batch with status.

    A row is registered if no held row has its hash or id_key, none of near(key) is it, and no row registered before it has either or is
    similar to it (near_pairs(key, other), in either order). Whether a row before was registered depends on those before it, so rounds
    settle rows whose rivals are all settled; each round is a window over hashes, one over ids and a join with the pairs, and settles at
    least the first row of every chain.
    """
    place = F.struct(order, key)
    batch = settled(batch.join(collisions(held, batch, key, near).select(key, F.col("status").alias("_held")), key))
    open_ = batch.where("_held = 'ok'").drop("_held")
    before = None
    if near_pairs is not None:  # (key, rival): rival comes first
        ends = [batch.select(F.col(key).alias(name), place.alias(f"_{name}")) for name in (key, "rival")]
        both = near_pairs.select(key, F.col("other").alias("rival")).union(near_pairs.select("other", key)).distinct()
        before = settled(both.join(ends[0], key).join(ends[1], "rival").where(F.col("_rival") < F.col(f"_{key}")).select(key, "rival"))
    won = None
    while not open_.isEmpty():
        first = {c: Window.partitionBy(c).orderBy(order, key) for c in ("hash", "id_key")}
        ranked = open_.withColumn("_h", F.row_number().over(first["hash"])).withColumn("_i", F.row_number().over(first["id_key"])).where("_h = 1 and _i = 1").drop("_h", "_i")
        if before is not None:
            waits = before.join(open_.select(F.col(key).alias("rival")), "rival", "left_semi").select(key)
            ranked = ranked.join(waits, key, "left_anti")
        winners = settled(ranked)
        won = winners if won is None else won.unionByName(winners)
        left = open_.join(winners.select(key), key, "left_anti")
        similar = before.join(winners.select(F.col(key).alias("rival")), "rival", "left_semi").select(key) if before is not None else None
        open_ = settled(left.join(collisions(winners, left, key, similar).where("status = 'ok'").select(key), key, "left_semi"))
    if won is None:
        return batch.withColumnRenamed("_held", "status")
    # Who was registered is settled; what a refused row hears depends on those before it only, and a hash or name has one owner at most.
    lost = batch.join(won.select(key), key, "left_anti")
    for c in ("hash", "id_key"):
        lost = lost.join(won.select(c, place.alias(f"_{c}")), c, "left").withColumn(f"_{c}", F.coalesce(F.col(f"_{c}") < place, F.lit(False)))
    exact, same = (F.col("_held") == "exact_collision") | F.col("_hash"), (F.col("_held") == "id_collision") | F.col("_id_key")
    status = F.when(exact, "exact_collision").when(same, "id_collision").otherwise("near_duplicate")
    lost = lost.withColumn("status", status).drop("_hash", "_id_key", "_held")
    return won.withColumn("status", F.lit("registered")).unionByName(lost)


def revisable(tasks: DataFrame, revisions: DataFrame, hashes: DataFrame) -> DataFrame:
    """revisions(slug, hash) with status: not_found, not_revisable (neither draft nor needs_changes), exact_collision (the hash
    was ever submitted, by this task too), or ok. hashes(hash) is all of history."""
    known = tasks.select("slug", F.col("status").alias("_state"))
    seen = hashes.select("hash", F.lit(True).alias("_seen")).distinct()
    rows = revisions.join(known, "slug", "left").join(seen, "hash", "left")
    status = F.when(F.col("_state").isNull(), "not_found").when(~F.col("_state").isin("draft", "needs_changes"), "not_revisable").when(F.col("_seen"), "exact_collision").otherwise("ok")
    return rows.withColumn("status", status).drop("_state", "_seen")


def transitioned(tasks: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tasks(slug, status, ...) after moves(slug, to_status), the moves that are not allowed with their from_status). A slug has one move at most."""
    allowed = tasks.sparkSession.createDataFrame(TRANSITIONS, "from_status string, to_status string").withColumn("_ok", F.lit(True))
    asked = moves.join(tasks.select("slug", F.col("status").alias("from_status")), "slug", "left").join(F.broadcast(allowed), ["from_status", "to_status"], "left")
    good = asked.where("_ok").select("slug", "to_status")
    after = tasks.join(good, "slug", "left").withColumn("status", F.coalesce("to_status", "status")).select(tasks.columns)
    return after, asked.where("_ok is null").select("slug", "from_status", "to_status")


def history(log: DataFrame, task: str | None = None) -> DataFrame:
    """The audit log in order, of one task or of all."""
    return (log.where(F.col("task_slug") == task) if task else log).orderBy("seq")

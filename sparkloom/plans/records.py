"""Queries over ledgers and stores made of rows of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import bundle_rules, ledger, lint, store
from ..sources import bundles
from . import bundles as parts
from .registry import query
from .registry import table as _t

_STATUS = "CASE event_type WHEN 'signup' THEN 'draft' WHEN 'view' THEN 'submitted' WHEN 'click' THEN 'in_review' WHEN 'purchase' THEN 'accepted' ELSE 'needs_changes' END"
_ALLOWED = ", ".join(f"('{a}', '{b}')" for a, b in ledger.TRANSITIONS)


@query(f"""WITH s AS (SELECT user_id, event_id, {_STATUS} AS to_status FROM events),
p AS (SELECT *, lag(to_status) OVER (PARTITION BY user_id ORDER BY event_id) AS from_status FROM s)
SELECT user_id, event_id, from_status, to_status FROM p WHERE (from_status IS NULL AND to_status <> 'draft') OR (from_status IS NOT NULL AND (from_status, to_status) NOT IN
(('draft','submitted'),('submitted','in_review'),('in_review','accepted'),('in_review','rejected'),('in_review','needs_changes'),('needs_changes','submitted')))""")
def review_state_machine(spark, sf_dir):
    log = _t(spark, sf_dir, "events").select("user_id", "event_id", F.expr(_STATUS).alias("status"))
    return ledger.illegal_transitions(log, "user_id", ["event_id"], "status")


def _entries(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    return events.select(
        "user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("string").alias("at"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("actor"), F.col("event_type").alias("action"),
        F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("task-"), (F.col("event_id") % 7).cast("string"))).alias("task_slug"), F.coalesce("props", F.lit("{}")).alias("payload"),
    )


_DOCUMENT = """'{"action":"' || action || '","actor":"user ' || user_id || '","at":"' || stamp || '","payload":' || to_json(payload) || ',"prev":"' || prev_hash || '","seq":' || seq || ',"task":' || CASE WHEN event_id % 3 > 0 THEN '"task-' || event_id % 7 || '"' ELSE 'null' END || '}'"""
_CHAIN = f"""e AS (SELECT user_id, event_id, epoch_us(ts)::VARCHAR AS stamp, event_type AS action, coalesce(props, '{{}}') AS payload, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events),
chain AS (SELECT *, sha256({_DOCUMENT}) AS row_hash FROM (SELECT *, repeat('0', 64) AS prev_hash FROM e WHERE seq = 1)
 UNION ALL SELECT *, sha256({_DOCUMENT}) FROM (SELECT e.*, c.row_hash AS prev_hash FROM e JOIN chain c ON e.user_id = c.user_id AND e.seq = c.seq + 1))"""


@query(f"WITH RECURSIVE {_CHAIN} SELECT user_id, event_id, seq, prev_hash, row_hash FROM chain")
def audit_chain_rows(spark, sf_dir):
    """A chain per user over all events."""
    return ledger.chained(_entries(spark, sf_dir), "user_id", "event_id").select("user_id", "event_id", "seq", "prev_hash", "row_hash")


@query(f"""WITH RECURSIVE {_CHAIN}, t AS (SELECT user_id, event_id, seq, row_hash FROM chain WHERE event_id % 997 <> 0), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS k FROM t),
f AS (SELECT user_id, seq, row_hash, CASE WHEN seq <> k THEN 'row missing or inserted' WHEN event_id % 501 = 0 THEN 'row edited' END AS reason FROM n),
b AS (SELECT user_id, min(seq) FILTER (reason IS NOT NULL) AS bad FROM f GROUP BY user_id)
SELECT user_id, bad IS NULL AS ok, count(*) FILTER (bad IS NULL OR seq < bad) AS entries, coalesce(arg_max(row_hash, seq) FILTER (bad IS NULL OR seq < bad), repeat('0', 64)) AS head, bad AS first_bad_seq, any_value(reason) FILTER (seq = bad) AS reason
FROM f JOIN b USING (user_id) GROUP BY user_id, bad""")
def audit_chain_verify(spark, sf_dir):
    """Reports on the chains of all users, of which some rows were edited and some are lost."""
    log = ledger.chained(_entries(spark, sf_dir), "user_id", "event_id")
    edited = log.where(F.col("event_id") % 997 != 0).withColumn("payload", F.when(F.col("event_id") % 501 == 0, F.concat("payload", F.lit(" "))).otherwise(F.col("payload")))
    faults = ledger.chain_faults(ledger.with_own_hash(edited), "user_id", F.col("own_hash"))
    return ledger.chain_report(faults, "user_id")


@query("SELECT event_id AS seq, 'task-' || user_id AS task_slug, event_type AS action FROM events")
def history_by_task(spark, sf_dir):
    log = _t(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("task-"), F.col("user_id").cast("string")).alias("task_slug"), F.col("event_type").alias("action"))
    return ledger.history(log)


@query("SELECT max(event_id) AS seq, arg_max(sha256(event_id::VARCHAR), event_id) AS row_hash FROM events")
def audit_head(spark, sf_dir):
    log = _t(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.sha2(F.col("event_id").cast("string"), 256).alias("row_hash"))
    return spark.createDataFrame([ledger.head(log)], "seq long, row_hash string")


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey")
def latest_submission(spark, sf_dir):
    return ledger.latest(_t(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderstatus")


@query("""WITH o AS (SELECT sha256(text) AS hash, min(doc_id) AS owner FROM documents GROUP BY 1)
SELECT doc_id, hash, owner, CASE WHEN owner = doc_id THEN 'registered' ELSE 'exact_collision' END AS status FROM (SELECT doc_id, sha256(text) AS hash FROM documents) JOIN o USING (hash)""")
def first_claim_wins(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return ledger.first_claims(rows, "hash", "doc_id")


#: Hashes and folded names of documents, which collide in both ways; every tenth is held already.
_CLAIMS = "SELECT doc_id, (doc_id * 7919) % 1009 AS place, 'h' || (doc_id * 31) % 601 AS hash, 'i' || (doc_id * 17) % 701 AS id_key FROM documents"


@query(f"""WITH RECURSIVE c AS ({_CLAIMS}), held AS (SELECT list(DISTINCT hash) AS hs, list(DISTINCT id_key) AS ids FROM c WHERE doc_id % 10 = 0),
b AS (SELECT *, row_number() OVER (ORDER BY place, doc_id) AS k FROM c WHERE doc_id % 10 <> 0),
r AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS doc_id, NULL::VARCHAR AS status, hs, ids FROM held UNION ALL
 SELECT b.k, b.doc_id, CASE WHEN list_contains(hs, hash) THEN 'exact_collision' WHEN list_contains(ids, id_key) THEN 'id_collision' ELSE 'registered' END,
  CASE WHEN list_contains(hs, hash) OR list_contains(ids, id_key) THEN hs ELSE list_append(hs, hash) END, CASE WHEN list_contains(hs, hash) OR list_contains(ids, id_key) THEN ids ELSE list_append(ids, id_key) END FROM r JOIN b ON b.k = r.k + 1)
SELECT doc_id, status FROM r WHERE k > 0""")
def register_batch(spark, sf_dir):
    """A batch registered as if one by one."""
    docs = _t(spark, sf_dir, "documents").select("doc_id")
    rows = docs.select("doc_id", (F.col("doc_id") * 7919 % 1009).alias("at"), F.concat(F.lit("h"), (F.col("doc_id") * 31 % 601).cast("string")).alias("hash"), F.concat(F.lit("i"), (F.col("doc_id") * 17 % 701).cast("string")).alias("id_key"))
    done = ledger.registered(rows.where("doc_id % 10 = 0"), rows.where("doc_id % 10 <> 0"), "doc_id", "at")
    return done.select("doc_id", "status")


_STATES = "CASE doc_id % 4 WHEN 0 THEN 'draft' WHEN 1 THEN 'needs_changes' WHEN 2 THEN 'in_review' ELSE 'accepted' END"


@query(f"""WITH d AS (SELECT doc_id, {_STATES} AS state, sha256(text) AS hash FROM documents), r AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN -1 - doc_id ELSE doc_id END AS slug, hash FROM d)
SELECT r.slug, r.hash, CASE WHEN d.state IS NULL THEN 'not_found' WHEN d.state NOT IN ('draft', 'needs_changes') THEN 'not_revisable' WHEN r.hash IN (SELECT hash FROM d WHERE doc_id % 2 = 0) THEN 'exact_collision' ELSE 'ok' END AS status
FROM r LEFT JOIN d ON d.doc_id = r.slug""")
def revise_history_collision(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.expr(_STATES).alias("status"), F.sha2("text", 256).alias("hash"))
    slug = F.when(F.col("doc_id") % 5 == 0, -1 - F.col("doc_id")).otherwise(F.col("doc_id"))
    return ledger.revisable(docs.select(F.col("doc_id").alias("slug"), "status"), docs.select(slug.alias("slug"), "hash"), docs.where("doc_id % 2 = 0").select("hash")).select("slug", "hash", "status")


_TARGETS = "CASE doc_id % 3 WHEN 0 THEN 'submitted' WHEN 1 THEN 'rejected' ELSE 'in_review' END"


@query(f"""WITH d AS (SELECT doc_id AS slug, {_STATES} AS status, {_TARGETS} AS target FROM documents)
SELECT slug, CASE WHEN slug % 7 > 0 AND (status, target) IN ({_ALLOWED}) THEN target ELSE status END AS status FROM d""")
def transitions(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("slug"), F.expr(_STATES).alias("status"), F.expr(_TARGETS).alias("to_status"))
    return ledger.transitioned(docs.select("slug", "status"), docs.where("slug % 7 > 0").select("slug", "to_status"))[0]


@query("""WITH o AS (SELECT o_orderkey AS key, floor(o_totalprice)::BIGINT AS size, epoch_us(o_orderdate) AS last_used FROM orders),
r AS (SELECT *, sum(size) OVER () - coalesce(sum(size) OVER (ORDER BY last_used, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM o)
SELECT key, size, last_used FROM r WHERE held > (SELECT sum(size) // 3 FROM o)""")
def lru_gc(spark, sf_dir):
    used = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    objects = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.floor("o_totalprice").cast("long").alias("size"), used.alias("last_used"))
    budget = objects.agg(F.sum("size").alias("s")).first()["s"] or 0
    return store.evicted(objects, budget // 3)


@query("""WITH a AS (SELECT DISTINCT sha256(text) AS key FROM documents WHERE doc_id % 2 = 0), b AS (SELECT sha256(text) AS key, any_value(strlen(text)) AS size FROM documents WHERE doc_id % 2 = 1 GROUP BY 1)
SELECT count(*) AS objects, count(*) FILTER (a.key IS NULL) AS new_objects, coalesce(sum(size), 0)::BIGINT AS bytes, coalesce(sum(size) FILTER (a.key IS NULL), 0)::BIGINT AS new_bytes FROM b LEFT JOIN a USING (key)""")
def cache_put_stats(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("key"), F.octet_length("text").cast("long").alias("size"))
    return store.put_stats(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1"))


@query("SELECT left(sha256(text), 2) AS folder, count(DISTINCT sha256(text)) AS objects FROM documents GROUP BY 1")
def object_key_fanout(spark, sf_dir):
    key = text.object_key(F.concat(F.lit("sha256:"), F.sha2("text", 256)))
    rows = _t(spark, sf_dir, "documents").select(key.alias("key")).distinct()
    return rows.groupBy(F.split_part(text.object_path(F.col("key")), F.lit("/"), F.lit(1)).alias("folder")).agg(F.count("*").alias("objects"))


@query("""WITH o AS (SELECT o_orderkey AS key, epoch_us(o_orderdate) AS last_used FROM orders), n AS (SELECT quantile_disc(last_used, 0.5) AS now FROM o)
SELECT key, CASE WHEN key % 3 = 0 THEN greatest(last_used, 1000000) ELSE last_used END AS last_used FROM o""")
def touched_objects(spark, sf_dir):
    objects = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("last_used"))
    return store.touched(objects, objects.where("key % 3 = 0").select("key"), 1_000_000)


@query("SELECT o_orderkey AS key FROM orders WHERE epoch_us(TIMESTAMP '1996-01-01 00:00:00') - epoch_us(o_orderdate) > 3600000000")
def stale_files(spark, sf_dir):
    files = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").cast("timestamp").alias("mtime"))
    return store.stale(files, "1996-01-01 00:00:00").select("key")


@query("SELECT doc_id, sha256(text) AS key FROM documents WHERE doc_id % 9 = 0 AND length(text) > 0")
def corrupt_objects(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("key"), F.when(F.col("doc_id") % 9 == 0, F.expr("substring(text, 2)")).otherwise(F.col("text")).cast("binary").alias("data"))
    return store.corrupt(rows).select("doc_id", "key")


@query("SELECT count(*) AS objects, sum(strlen(text))::BIGINT AS bytes FROM documents")
def store_size(spark, sf_dir):
    return store.totals(_t(spark, sf_dir, "documents").select(F.octet_length("text").cast("long").alias("size")))


@query("""SELECT p_partkey, round(list_sum(list_transform(list_distinct(string_split(p_name, '')), lambda c: -((length(p_name) - length(replace(p_name, c, ''))) / length(p_name)) * log2((length(p_name) - length(replace(p_name, c, ''))) / length(p_name)))), 9) AS bits,
left(p_name, 4) || '[redacted, ' || length(p_name) || ' chars]' AS redacted, '[redacted, ' || length(p_name) || ' chars]' AS hidden FROM part""")
def entropy_and_redaction(spark, sf_dir):
    name = F.col("p_name")
    return _t(spark, sf_dir, "part").select("p_partkey", F.round(text.entropy(name), 9).alias("bits"), text.redacted(name, 4).alias("redacted"), text.redacted(name).alias("hidden"))


@query(f"""WITH {parts._PARTS} SELECT bundle, loc, path, code FROM p JOIN (VALUES (0, 'solution.entrypoint', 'solution/solve.sh', 'path_not_found'), (0, 'tests.path', 'tests', 'wrong_path_kind')) v(k, loc, path, code) ON {parts._SOUND} AND n % 6 = k""")
def missing_declared_paths(spark, sf_dir):
    held = parts.files(spark, sf_dir).withColumn("n", F.substring_index("bundle", "-", -1).cast("long"))
    changed = held.where((F.col("n") % 6 != 0) | ~F.col("path").isin("solution/solve.sh", "tests/run.sh")).withColumn("path", F.when((F.col("n") % 6 == 0) & (F.col("path") == "tests/test_part.py"), "tests").otherwise(F.col("path")))
    declared = parts.layout(spark, sf_dir).select("bundle", F.explode("declared").alias("d")).select("bundle", "d.loc", "d.path", "d.kind")
    return bundles.missing_paths(declared, changed).select("bundle", "loc", "path", "code")


@query(f"""WITH {parts._PARTS}, f AS (SELECT n, bundle, 'solution/solve.py' AS file, 4 AS line, 12 AS "column", 'TL004' AS code FROM p WHERE n % 8 = 0 UNION ALL SELECT n, bundle, 'tests/test_part.py', 3, 12, 'TL004' FROM p WHERE n % 7 = 2
 UNION ALL SELECT n, bundle, 'environment/Dockerfile', 3, 6, 'TL002' FROM p WHERE n % 2 = 1 UNION ALL SELECT n, bundle, 'tests/test_part.py', 1, 1, 'TL003' FROM p WHERE n % 7 = 1 UNION ALL SELECT n, bundle, 'tests/run.sh', 2, 3, 'TL003' FROM p WHERE n % 6 = 0
 UNION ALL SELECT n, bundle, 'verifier/Dockerfile', 3, 1, 'TL003' FROM p WHERE n % 5 = 0 UNION ALL SELECT n, bundle, 'tests/test_part.py', 1, CASE n % 7 WHEN 3 THEN 12 ELSE 1 END, 'TL001' FROM p WHERE n % 7 IN (0, 3, 4))
SELECT bundle, file, line, code FROM f""")
def bundle_lint(spark, sf_dir):
    """All rules over all bundles, by each bundle's own selection."""
    held, layout = parts.files(spark, sf_dir), parts.laid_out(spark, sf_dir)
    found = bundle_rules.enabled(bundle_rules.all_findings(held, layout), layout, lint.rule_table(spark))
    return found.select("bundle", "file", "line", "code")

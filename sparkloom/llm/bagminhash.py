"""Near-duplicates by BagMinHash: weighted-Jaccard signatures of shingle multisets, banded, verified exactly.

Signature. A shingle that occurs c times in a text has weight c; the discretised weights are the whole numbers. Every
shingle owns a Poisson process on (time, weight level): the levels are split into a hierarchy of blocks (0,1], (1,2],
(2,4], (4,8] ..., each with a process of its own whose rate is the block's width; a point's level within its block is
uniform, and the point counts if the level is at most c. Every point also names one of the SLOTS slots, and a slot's
value is the identity of its earliest point. Two texts agree in a slot with the probability of their multisets'
weighted Jaccard similarity (Ertl, KDD 2018). The processes run until a time by which all slots are nearly surely
filled, a few hundred points a text however long it is, and further for a text that has an empty slot left.

Candidates. The slots make BANDS bands of ROWS values; texts that share a band's values share a bucket. At similarity
0.8 a pair misses all buckets with probability 5e-5. In a bucket all texts are compared with a leader, the one with most
company over all its buckets; those that are similar to it or to a leader's leader get its label. Buckets that still hold
several labels have a second leader, from another label than the first. Only then are members of different labels
compared with each other, if the triangle inequality of the Jaccard distance (a metric on multisets) over the leaders lets
them be similar, and if a fine sketch of 1024 one-bit slots does too (a pair at 0.8 fails that with probability 1e-4). A
label only says that texts are linked, so that no link between components is lost. No bucket is capped, and links within
a component change nothing.

Exact copies (equal word sequences) are one node throughout; they join their class at the very end.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, discard, sized_broadcast, staged, table
from .components import connected_components
from .shingles import mix, shingle_hashes, slices

BANDS, ROWS = 25, 5
SLOTS = BANDS * ROWS
SIMILARITY = 0.8
#: Members of a leader that one task gets with one copy of the leader's text.
SALT_MEMBERS = 256
#: Rounds of leaders.
LEADERS = 2
#: Words of 64 bits of a fine sketch, a bit a slot. SURE standard deviations are allowed before a pair is given up.
FINE_WORDS, SURE = 16, 3.7

_M = np.uint64
_rng = np.random.Generator(np.random.PCG64(7))
_BLOCK = _rng.integers(1, 2**63, 64, dtype=np.uint64)
_STEP, _MARK = _M(0xD1B54A32D192ED03), _M(0x8CB92BA72F3D8DD7)
_BAND = _rng.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) * _M(2) + _M(1)


def multisets(shingles: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, count) of each text's distinct shingles, sorted."""
    values = shingles.copy()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        values[a:b].sort()
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(first)
    return text[at], values[at], np.diff(np.append(at, len(values)))


def signatures(text: np.ndarray, shingle: np.ndarray, count: np.ndarray, n_texts: int, slots: int = SLOTS) -> np.ndarray:
    """(n_texts, slots) uint32. A text without shingles gets a row of zeros."""
    best = np.full(n_texts * slots, np.iinfo(np.uint64).max, np.uint64)
    weight = np.bincount(text, count, n_texts)
    row_text, row_seed, row_count, row_low, row_width = [text], [mix(shingle ^ _BLOCK[0])], [count], [np.zeros(len(text))], [np.ones(len(text))]
    block, low = 1, 1
    while len(more := np.flatnonzero(count > low)):
        row_text.append(text[more])
        row_seed.append(mix(shingle[more] ^ _BLOCK[block]))
        row_count.append(count[more])
        row_low.append(np.full(len(more), float(low)))
        row_width.append(np.full(len(more), float(low)))
        block, low = block + 1, low * 2
    row_text, row_seed, row_count, row_low, row_width = map(np.concatenate, (row_text, row_seed, row_count, row_low, row_width))
    until = slots * (np.log(slots) + 3) / np.maximum(weight, 1)
    open_rows = np.arange(len(row_text))
    while len(open_rows):
        t, seed, c, low_, width = row_text[open_rows], row_seed[open_rows], row_count[open_rows], row_low[open_rows], row_width[open_rows]
        stop, time, step = until[t], np.zeros(len(t)), 0
        while len(t):
            step += 1
            point = mix(seed + _M(step * int(_STEP) % 2**64))
            time = time - np.log(((point >> _M(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
            alive = np.flatnonzero(time <= stop)
            if len(alive) < len(t):
                t, seed, c, low_, width, stop, time, point = (x[alive] for x in (t, seed, c, low_, width, stop, time, point))
            mark = mix(point ^ _MARK)
            level = low_ + np.floor((mark >> _M(40)).astype(np.float64) * 2.0**-24 * width) + 1
            hit = np.flatnonzero(level <= c)
            slot = t[hit] * slots + ((mark[hit] & _M(0xFFFFFFFF)) % _M(slots)).astype(np.int64)
            packed = (time[hit].astype(np.float32).view(np.uint32).astype(np.uint64) << _M(32)) | (point[hit] & _M(0xFFFFFFFF))
            np.minimum.at(best, slot, packed)
        unfilled = (best.reshape(n_texts, slots) == np.iinfo(np.uint64).max).any(axis=1) & (weight > 0)
        until = until * 2
        open_rows = np.flatnonzero(unfilled[row_text])
    out = (best & _M(0xFFFFFFFF)).astype(np.uint32).reshape(n_texts, slots)
    out[weight == 0] = 0
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(n_texts, BANDS) int64."""
    rows = signature.reshape(-1, BANDS, ROWS).astype(np.uint64)
    return mix((rows * _BAND).sum(axis=2, dtype=np.uint64) ^ _BAND[:, 0]).view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted distinct shingles, counts)."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    both = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    shared = int(np.minimum(a[1][both], b[1][at[both]]).sum())
    total = int(a[1].sum()) + int(b[1].sum()) - shared
    return shared / total if total else 0.0


def _bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    shingles, offsets, _, _ = shingle_hashes([text])
    _, values, counts = multisets(shingles, offsets)
    return values, counts


_SIGNED = "doc_id long, copy_key binary, n_shingles long, bands array<long>"


def _sign(stream):
    """copy_key: equal for texts with equal words, or equal texts if they have none; null for blank texts. bands: empty without words."""
    for batch in stream:
        ids = batch.column(0)
        for lo, hi, texts in slices(batch.column(1)):
            shingles, offsets, words, at = shingle_hashes(texts)
            keys = band_keys(signatures(*multisets(shingles, offsets), hi - lo))
            n = np.diff(offsets)
            copies = [hashlib.md5(words[a:b].tobytes()).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            for k in np.flatnonzero(n == 0).tolist():
                text = texts[k]
                copies[k] = hashlib.md5(b"\0" + text.encode()).digest() if text and text.strip() else None
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]), pa.int32()), pa.array(keys[n > 0].ravel()))
            yield pa.RecordBatch.from_arrays([ids[lo:hi], pa.array(copies, pa.binary()), pa.array(n, pa.int64()), lists], ["doc_id", "copy_key", "n_shingles", "bands"])


_FINE = "node long, bands array<long>, " + ", ".join(f"s{k} long" for k in range(FINE_WORDS))


def _sketch(stream):
    """Fine sketches: one bit of each of 64 * FINE_WORDS slots. Bits of two texts differ with probability (1 - similarity) / 2."""
    for batch in stream:
        ids = batch.column(0)
        for start, stop, texts in slices(batch.column(1)):
            for lo in range(start, stop, 500):
                hi = min(stop, lo + 500)
                shingles, offsets, _, _ = shingle_hashes(texts[lo - start : hi - start])
                bag = multisets(shingles, offsets)
                bits = (signatures(*bag, hi - lo, 64 * FINE_WORDS) & 1).astype(np.uint8)
                words = np.packbits(bits, axis=1).view(np.int64)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * BANDS, pa.int32()), pa.array(band_keys(signatures(*bag, hi - lo)).ravel()))
                yield pa.RecordBatch.from_arrays([ids[lo:hi], keys, *(pa.array(np.ascontiguousarray(words[:, k])) for k in range(FINE_WORDS))], ["node", "bands", *(f"s{k}" for k in range(FINE_WORDS))])


def _may_be_similar(threshold: float):
    """By their fine sketches, the similarity of x and y may reach the threshold."""
    n = 64 * FINE_WORDS
    share = (1 - threshold) / 2
    most = n * share + SURE * (n * share * (1 - share)) ** 0.5
    differing = F.bit_count(F.col("x.s0").bitwiseXOR(F.col("y.s0")))
    for k in range(1, FINE_WORDS):
        differing = differing + F.bit_count(F.col(f"x.s{k}").bitwiseXOR(F.col(f"y.s{k}")))
    return differing <= int(most)


def _compare(stream):
    """Rows sorted by (leader, salt, role): the leader's text, then its members' texts."""
    leader, bags = None, []
    for batch in stream:
        out = []
        for lead, salt, role, member, text in zip(*(c.to_pylist() for c in batch.columns)):
            if leader != (lead, salt):
                leader, bags = (lead, salt), []
            bag = _bag(text)
            if role == 0:
                bags.append(bag)
            else:
                out.append((lead, member, max((similarity(x, bag) for x in bags), default=0.0)))
        cols = list(zip(*out)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["a", "b", "sim"])


def _verified(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(a, b, size) -> (a, b, sim); texts travel to (a, salt), so many salts that about SALT_MEMBERS of `size` share one."""
    asked = asked.withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("size") / SALT_MEMBERS)).cast("long"))
    asked = staged(asked.select("a", "salt", "b"), "minhash-asked")
    leads = asked.select(F.col("a").alias("id"), "a", "salt", F.lit(0).alias("role"), F.lit(None).cast("long").alias("b")).distinct()
    requests = staged(asked.select(F.col("b").alias("id"), "a", "salt", F.lit(1).alias("role"), "b").union(leads), "minhash-requests")
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(sized_broadcast(requests), "id").select("a", "salt", "role", "b", "text")
    sorted_ = texts.repartition("a", "salt").sortWithinPartitions("a", "salt", "role")
    out = staged(sorted_.mapInArrow(_compare, "a long, b long, sim double"), "minhash-verified")
    discard(asked, requests)
    return out


def _labels(links: DataFrame) -> DataFrame:
    """links(a, b, w) -> (node, label): each b's heaviest a, or that one's own. Equal labels mean linked, not the other way round."""
    heaviest = F.max(F.struct("w", F.bitwise_not("a").alias("n")))
    up = staged(links.groupBy(F.col("b").alias("node")).agg(heaviest.alias("m")).select("node", F.bitwise_not("m.n").alias("parent")), "minhash-parents")
    further = up.select(F.col("node").alias("parent"), F.col("parent").alias("label"))
    out = staged(up.join(sized_broadcast(further), "parent", "left").select("node", F.coalesce("label", "parent").alias("label")), "minhash-labels")
    discard(up)
    return out


def _crowded(classes: DataFrame) -> DataFrame:
    """(bucket, node, size, company) of the buckets that hold several of classes(node, bands); company is how many a node meets in all."""
    banded = classes.select("node", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    met = banded.join(shared, "bucket")
    return staged(met.withColumn("company", F.sum("size").over(Window.partitionBy("node"))), "minhash-buckets")


def _mixed(rows: DataFrame, leader: str) -> DataFrame:
    """(bucket, next) of the buckets of rows(bucket, node, label, company, leader, nears) that hold several labels; next is a member
    (company, ~node, nears) of most company among those of another label than the leader."""
    top = F.max(F.struct("company", F.bitwise_not("node").alias("n"), "nears")).alias("top")
    by_label = rows.groupBy("bucket", "label").agg(top, F.max((F.col("node") == F.col(leader)).cast("int")).alias("leads"))
    others = by_label.groupBy("bucket").agg(F.count("*").alias("labels"), F.max(F.when(F.col("leads") == 0, F.col("top"))).alias("next"))
    return others.where("labels > 1").select("bucket", "next")


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, class_id, n_shingles, kept), one row per distinct non-null doc_id.

    class_id is the smallest doc_id reachable by links (equal word sequences, or multiset similarity >= threshold);
    kept marks that one. Texts without words link with equal texts only; blank ones (null, empty, white space) with nothing,
    not with each other either. Rows that repeat a doc_id are one document; if their texts differ it has all their
    links. Rows without a doc_id give no row. Very long texts are compared whole. Other columns are ignored; an empty table
    gives none.
    """
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    signed = staged(docs.mapInArrow(_sign, _SIGNED), "minhash-signed")
    each = staged(signed.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.min("copy_key").alias("lo"), F.max("copy_key").alias("hi")), "minhash-each")
    keyed = signed.where("copy_key is not null")
    classes = staged(keyed.groupBy("copy_key").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.count("*").alias("copies")), "minhash-classes")

    crowded = rows = _crowded(classes)
    best = rows.groupBy("bucket").agg(F.max(F.struct("company", F.bitwise_not("node").alias("n"))).alias("m"))
    leaders = best.select("bucket", F.bitwise_not("m.n").alias("leader"), F.col("m.company").alias("w"), F.array().cast("array<double>").alias("leader_nears"))
    rows = staged(rows.join(leaders, "bucket").withColumn("nears", F.array().cast("array<double>")), "minhash-led")
    discard(crowded)
    gap = 1 - threshold + 1e-9
    links = None
    for turn in range(LEADERS):
        # All members meet the leader; what is left of a bucket matters while it holds several labels.
        asked = rows.where((F.col("node") != F.col("leader")) & _within("nears", "leader_nears", gap))
        sims = _verified(docs, asked.groupBy(F.col("leader").alias("a"), F.col("node").alias("b")).agg(F.max("size").alias("size"), F.max("w").alias("w")).select("a", "b", "size"))
        weights = rows.select(F.col("leader").alias("a"), "w").distinct()
        found = sims.where(F.col("sim") >= threshold).join(weights, "a").select("a", "b", "w")
        links = staged(found if links is None else links.union(found), "minhash-links")
        labels = _labels(links)
        near = F.when(F.col("node") == F.col("leader"), 1.0).otherwise(F.col("sim"))
        met = rows.drop("label").join(sized_broadcast(sims.withColumnsRenamed({"a": "leader", "b": "node"})), ["leader", "node"], "left")
        met = met.join(sized_broadcast(labels), "node", "left").withColumn("label", F.coalesce("label", "node")).withColumn("nears", F.array_append("nears", near))
        before, rows = rows, staged(met.select("bucket", "node", "size", "company", "label", "leader", "nears"), "minhash-met")
        discard(before)
        chosen = _mixed(rows, "leader").select("bucket", F.bitwise_not("next.n").alias("leader"), F.col("next.company").alias("w"), F.col("next.nears").alias("leader_nears"))
        before, rows = rows, staged(rows.drop("leader").join(chosen, "bucket"), "minhash-led")
        discard(before)
        if rows.isEmpty():
            break
    if not rows.isEmpty():
        links = links.union(_apart(docs, rows, threshold, gap))
    links = links.select("a", "b")
    several = each.where("lo <> hi").select("doc_id")
    if not several.isEmpty():  # a document that has several texts links their classes
        named = signed.join(several, "doc_id").select("doc_id", "copy_key").join(classes.select("copy_key", "node"), "copy_key")
        links = links.union(named.select(F.col("node").alias("a"), F.col("doc_id").alias("b")))

    component = connected_components(links, "minhash-cc")
    known = classes.select("copy_key", "node", "copies").join(component, "node", "left").where("copies > 1 or component is not null")
    known = staged(known.select(F.col("copy_key").alias("lo"), F.coalesce("component", "node").alias("class_id")), "minhash-known")
    discard(signed, classes, rows)
    class_id = F.coalesce("class_id", "doc_id")
    return each.join(sized_broadcast(known), "lo", "left").select("doc_id", class_id.alias("class_id"), "n_shingles", (class_id == F.col("doc_id")).alias("kept"))


def _apart(docs: DataFrame, rows: DataFrame, threshold: float, gap: float) -> DataFrame:
    """Links (a, b, w) between members of a bucket that have different labels, told by fine sketches inside a join on the bucket, each
    pair in the first bucket that it shares, so that few rows come out."""
    apart = staged(rows.select("node").distinct(), "minhash-apart")
    fine = docs.join(sized_broadcast(apart).withColumnRenamed("node", "doc_id"), "doc_id", "left_semi").mapInArrow(_sketch, _FINE)
    left = staged(rows.select("bucket", "node", "label", "size", "nears").join(sized_broadcast(staged(fine, "minhash-fine"), BROADCAST_ROWS // 8), "node"), "minhash-left")
    x, y = left.alias("x"), left.alias("y")
    first = F.array_min(F.array_intersect("x.bands", "y.bands")) == F.col("x.bucket")
    alike = (F.col("x.label") != F.col("y.label")) & _may_be_similar(threshold) & first & _within("x.nears", "y.nears", gap)
    pairs = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.node") < F.col("y.node")) & alike)
    pairs = pairs.groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(F.max("x.size").alias("size"))
    return _verified(docs, pairs).where(F.col("sim") >= threshold).select("a", "b", F.lit(0).cast("long").alias("w"))


def _within(one: str, other: str, gap: float):
    """By the triangle inequality over the leaders that both have met, the distance may be as small as gap."""
    return ~F.exists(F.zip_with(one, other, lambda a, b: F.coalesce(F.abs(a - b), F.lit(0.0))), lambda d: d > gap)


def one_of_each(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The rows of docs whose document is its class's kept one, one row of a repeated doc_id (the smallest text); rows
    without a doc_id all stay. All columns are kept.
    """
    columns = docs.columns
    verdict = near_duplicates(docs, threshold)
    gone = staged(verdict.where(~F.col("kept")).select("doc_id"), "minhash-gone")
    kept = docs.join(sized_broadcast(gone), "doc_id", "left_anti").select(columns)
    repeated = staged(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id"), "minhash-repeated")
    once = kept.join(sized_broadcast(repeated), "doc_id", "left_anti")
    twice = kept.join(sized_broadcast(repeated), "doc_id", "left_semi")
    order = F.struct(F.coalesce("text", F.lit("")), F.to_json(F.struct(*columns)))  # a map has no order, its JSON has
    twice = twice.groupBy("doc_id").agg(F.min_by(F.struct(*columns), order).alias("row")).select("row.*")
    return once.select(columns).unionByName(twice)


def op7_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

"""Quality by hierarchical empirical Bayes.

A logistic regression on surface features of the text gives each document's own evidence p. Sites come in two levels:
hosts (column `source`) and paths within them (column `lang`, the section of the host). Grouped aggregation counts each
path's documents and sums their p; hosts add up their paths. A host's posterior mean shrinks toward the global mean, a
path's toward its host's, each by a number of pseudo-documents that the method of moments takes from the spread between
sites, so that sparse sites follow their priors. A document's posterior log-odds are its own plus the difference between
its path's and the global log-odds; documents below one half are rejected.

The regression learns from at most SAMPLE labelled rows (those with the smallest hashes of doc_id); everything else covers all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import labelled_sample, sized_broadcast, staged, table, unused
from .shingles import batches, slices, word_hashes

SAMPLE = 10_000
LEAST, MOST = 1.0, 1e4

_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(97, 123), *range(128, 256)]] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[[ord(c) for c in "#*$%&|<>{}[]\\^~_=@"]] = 5
_CLASS[ord("!")] = 6
N_FEATURES = 9
RESULT = ("own_evidence", "host_posterior", "path_posterior", "posterior", "kept")


def features(texts: list[str | None]) -> np.ndarray:
    """One row per text; a null, empty or wordless text has the row of zero words."""
    out = np.zeros((len(texts), N_FEATURES))
    for lo, hi in batches(texts):
        raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts[lo:hi]]
        ends = np.cumsum([0, *map(len, raws)])
        kind = _CLASS[np.frombuffer(b"".join(raws), np.uint8)]
        counts = np.zeros((hi - lo, 7))
        for k in range(7):
            running = np.concatenate([[0], np.cumsum(kind == k)])
            counts[:, k] = running[ends[1:]] - running[ends[:-1]]
        words, at = word_hashes(texts[lo:hi])
        n = np.diff(at)
        distinct = np.array([len(np.unique(words[a:b])) for a, b in zip(at[:-1].tolist(), at[1:].tolist())])
        size = np.maximum(np.diff(ends), 1)
        letters = np.maximum(counts[:, 1] + counts[:, 2], 1)
        n1 = np.maximum(n, 1)
        row = out[lo:hi]
        row[:, 0] = np.log1p(n)
        row[:, 1] = counts[:, 2] / letters
        row[:, 2] = counts[:, 3] / size
        row[:, 3] = np.minimum(counts[:, 5] / n1, 2)
        row[:, 4] = np.minimum(counts[:, 6] / n1, 2)
        row[:, 5] = np.minimum(counts[:, 0] / n1, 2)
        row[:, 6] = np.minimum(letters / n1, 20) / 10
        row[:, 7] = distinct / n1
        row[:, 8] = np.log(n1 / np.maximum(distinct, 1))
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights with the intercept last), by iteratively reweighted least squares."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge * len(x) / 100 + 1e-6)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-7:
            break
    return mean, scale, w


def _evidence(model, name: str = "_own", text: str = "text"):
    mean, scale, w = model

    def run(stream):
        for batch in stream:
            parts = [features(texts) for _, _, texts in slices(batch.column(text))]
            x = (np.concatenate(parts) - mean) / scale if parts else np.zeros((0, N_FEATURES))
            p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*batch.schema.names, name])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """Fit the document classifier on labelled rows; without labels of both kinds every document gets the labels' mean (0.5 without any)."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("label"))
    rows = labelled_sample(docs, known, sample)

    def featured(stream):
        for batch in stream:
            x = features(batch.column(0).to_pylist())
            yield pa.record_batch({"x": pa.array(list(x), pa.list_(pa.float64())), "y": batch.column(1)})

    got = rows.select("text", F.col("label").cast("long").alias("y")).mapInArrow(featured, "x array<double>, y long").toPandas()
    y = got["y"].to_numpy(float)
    if len(set(y)) < 2:
        mean = y.mean() if len(y) else 0.5
        return np.zeros(N_FEATURES), np.ones(N_FEATURES), np.append(np.zeros(N_FEATURES), np.log(max(mean, 1e-3) / max(1 - mean, 1e-3)))
    return fit_logistic(np.stack(got["x"]), y)


def _pseudo(mean, spread, n):
    """Pseudo-documents by the method of moments: mean (1 - mean) / variance between sites - 1."""
    return F.when((n > 1) & (spread > 0), F.greatest(F.lit(LEAST), F.least(F.lit(MOST), mean * (1 - mean) / spread - 1))).otherwise(F.lit(MOST))


def site_posteriors(evidence: DataFrame) -> DataFrame:
    """evidence(host, path, _own) -> (host, path, n, host_posterior, path_posterior, global_mean), one row per path."""
    paths = evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("_own").alias("s"))
    paths = staged(paths, "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    total = hosts.agg((F.sum("host_s") / F.sum("host_n")).alias("mean"), F.coalesce(F.var_pop(F.col("host_s") / F.col("host_n")), F.lit(0.0)).alias("spread"), F.count("*").alias("n_hosts")).first()
    mean = min(max(total["mean"] if total["mean"] is not None else 0.5, 1e-4), 1 - 1e-4)
    strength = _pseudo(F.lit(mean), F.lit(float(total["spread"])), F.lit(total["n_hosts"]))
    hosts = hosts.withColumn("host_posterior", (strength * mean + F.col("host_s")) / (strength + F.col("host_n")))
    joined = paths.join(hosts, "host")
    inner = joined.agg(F.avg(F.pow(F.col("s") / F.col("n") - F.col("host_posterior"), 2)).alias("spread"), F.count("*").alias("n")).first()
    strength = _pseudo(F.lit(mean), F.lit(float(inner["spread"] or 0.0)), F.lit(inner["n"]))
    path = (strength * F.col("host_posterior") + F.col("s")) / (strength + F.col("n"))
    return joined.select("host", "path", "n", "host_posterior", path.alias("path_posterior"), F.lit(mean).alias("global_mean"))


def judged(docs: DataFrame, labels: DataFrame, names: tuple[str, ...] = RESULT) -> DataFrame:
    """docs(doc_id, text, source, lang, ...) with all its columns and, named by `names`: the text's own evidence, its
    host's posterior, its path's, its own posterior, and whether it is kept.

    Null text counts as empty; null source and lang are sites of their own. Null doc_ids are judged but not learnt from; a
    doc_id with several labels counts as the best. Repeated rows are judged alike. An empty table gives none. A column of
    docs that has one of `names` is replaced; others may have any name. Very long texts are read whole, and a posterior of exactly one
    half is kept.
    """
    docs = docs.drop(*names)
    own, host, path, posterior, kept = names
    site_host, site_path, mean = unused(docs.withColumns({n: F.lit(0) for n in names}), "_site_host", "_site_path", "_mean")
    host_of, path_of = (F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")) for c in ("source", "lang"))
    model = train(docs, labels)
    slim = docs.select("text", host_of.alias("host"), path_of.alias("path"))
    sites = site_posteriors(slim.mapInArrow(_evidence(model), "text string, host string, path string, _own double").drop("text"))
    sites = sites.select(F.col("host").alias(site_host), F.col("path").alias(site_path), F.col("host_posterior").alias(host), F.col("path_posterior").alias(path), F.col("global_mean").alias(mean))
    rows = docs.mapInArrow(_evidence(model, own), type(docs.schema)([*docs.schema.fields]).add(own, "double"))
    rows = rows.join(sized_broadcast(staged(sites, "quality-sites")), (host_of == F.col(site_host)) & (path_of == F.col(site_path)))
    logit = lambda p: F.log(p / (1 - p))
    inside = lambda c: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(c)))
    odds = logit(inside(own)) + logit(inside(path)) - logit(inside(mean))
    rows = rows.withColumn(posterior, 1 / (1 + F.exp(-odds)))
    return rows.withColumn(kept, F.col(posterior) >= 0.5).select(*docs.columns, *names)


def op3_hierarchical_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return judged(docs, table(spark, sf_dir, "labels")).select("doc_id", *RESULT)


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with their columns, whatever those are named; see judged for nulls, ties, repeated rows, long texts
    and empty tables."""
    names = tuple(unused(docs, *RESULT))
    return judged(docs, labels, names).where(F.col(names[-1])).select(docs.columns)

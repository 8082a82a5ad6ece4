"""Quality classifier with hierarchical empirical Bayes.

A linear classifier (logistic regression over the hashed words a text has, and over classes of
its shape) gives the evidence of each document's own text. It is fitted on at most TRAIN_ROWS
labelled documents, chosen by the hash of their id; a document is bad if its label is low
quality or toxic. All documents are scored.

Sites form two levels, host and path (by default the columns source and lang). The expected
number of bad documents of all hosts and paths comes from grouped sums of the evidence. Host
rates shrink toward the global rate, path rates toward their host's, by Beta priors whose
strength is the between-site variance found in the data (moments): a site with few documents
stays near its prior, a large one near its own rate. A document's score adds the log odds of its
path's posterior against the global rate to its own evidence; a score over ``threshold`` rejects.

A null text has no words and is judged by its shape and site. Null hosts and paths are sites of
their own. Labels without a document, with nulls, or of a row without id are ignored; of
several labels of an id the worst holds. Rows are judged each by itself, repeated ones alike.
With no labels of both kinds the evidence is even and nothing is rejected. An empty table gives
no rows. Input columns named like the result's are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import NOT_ALNUM, SPACES, U64, append, column, lists, materialize, table_column, text_bytes, word_hashes, words

TRAIN_ROWS = 20_000
FEATURE_BITS = 18
LEAST_TEXTS = 3
DEVIATIONS = 4.0
THRESHOLD = 0.5
SHAPES = 9
ROUNDS = 300
_CLASS = np.zeros(256, np.uint8)  # 1 upper case, 2 digit, 3 white space, 4 other ASCII sign
_CLASS[65:91], _CLASS[48:58] = 1, 2
_CLASS[[0x20, *range(0x09, 0x0E)]] = 3
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum()]] = 4


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct features, and where each text's begin."""
    n = len(off) - 1
    starts, ends, first = words(buf, off, NOT_ALNUM)
    h = word_hashes(buf, starts, ends, lower=True)
    doc = np.repeat(np.arange(n), np.diff(first))
    key = np.unique((doc.astype(np.int64) << FEATURE_BITS) | (h >> U64(64 - FEATURE_BITS)).astype(np.int64))
    distinct = np.bincount(key >> FEATURE_BITS, minlength=n)
    size = np.maximum(np.diff(off), 1)
    count = np.diff(first)
    classes = [np.diff(np.concatenate([[0], np.cumsum(_CLASS[buf] == c)])[off]) for c in (1, 2, 4)]
    raw, raw_end, raw_first = words(buf, off, SPACES)
    sign = _CLASS[buf[raw_end - 1]] == 4
    twice = (raw_end - raw >= 2) & sign & (_CLASS[buf[np.maximum(raw_end - 2, 0)]] == 4)
    ends_in = [np.diff(np.concatenate([[0], np.cumsum(x)])[raw_first]) / np.maximum(np.diff(raw_first), 1) for x in (sign, twice, (raw_end - raw == 1) & sign)]
    shares = [*(c / size for c in classes), *ends_in, distinct / np.maximum(count, 1), count / size]
    bins = [np.minimum((s * 20).astype(np.int64), 19) for s in shares] + [np.log2(size).astype(np.int64)]
    shape = [(np.arange(n, dtype=np.int64) << (FEATURE_BITS + 1)) | (1 << FEATURE_BITS) | (64 * k + b) for k, b in enumerate(bins)]
    key = ((key >> FEATURE_BITS) << (FEATURE_BITS + 1)) | (key & ((1 << FEATURE_BITS) - 1))
    key = np.sort(np.concatenate([key, *shape]))
    return (key & ((1 << (FEATURE_BITS + 1)) - 1)), np.searchsorted(key, np.arange(n + 1, dtype=np.int64) << (FEATURE_BITS + 1))


def fit(index: np.ndarray, first: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression by Adam over all rows: features of LEAST_TEXTS texts and more
    that deviate from the bad rate beyond chance, their weights, the intercept."""
    n = len(bad)
    count = np.bincount(index, minlength=1 << (FEATURE_BITS + 1))
    hits = np.bincount(index, weights=np.repeat(bad, np.diff(first)), minlength=len(count))
    rate = bad.mean()
    # what chance explains only adds noise: keep features whose bad share is that far off
    often = (count >= LEAST_TEXTS) & (np.abs(hits - count * rate) > DEVIATIONS * np.sqrt(np.maximum(count, 1) * rate * (1 - rate)))
    used = np.flatnonzero(often)
    number = np.full(len(often), -1, np.int64)
    number[used] = np.arange(len(used))
    column_, row = number[index], np.repeat(np.arange(n), np.diff(first))
    column_, row = column_[column_ >= 0], row[column_ >= 0]
    w, m, v = np.zeros(len(used)), np.zeros(len(used)), np.zeros(len(used))
    rate = np.clip(rate, 1e-3, 1 - 1e-3)
    b = np.log(rate / (1 - rate))
    mb = vb = 0.0
    for t in range(1, ROUNDS + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[column_], n) + b, -30, 30)))
        e = p - bad
        g = np.bincount(column_, e[row], len(used)) + 0.1 * w
        gb = e.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = 0.05 * min(1.0, 4 * (1 - t / (ROUNDS + 1)))
        w -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        b -= step * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-9)
    return used, w, float(b)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, key: str = "doc_id", text: str = "text") -> tuple[np.ndarray, float, float]:
    """Weights of all features, intercept, and the rate of bad documents in the sample."""
    marks = labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    marks = marks.groupBy(F.col(key).alias("_key")).agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("_bad"))
    total = max(1, marks.count())
    chosen = marks.where(F.pmod(F.xxhash64("_key"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, rows / total)))
    sample = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(chosen, "_key").select("_key", "_bad", "text")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, first = features(*text_bytes(column(batch, "text")))
            yield pa.RecordBatch.from_arrays([column(batch, "_key").cast(pa.int64()), column(batch, "_bad"), lists(pa.array(index.astype(np.int32)), first)], ["id", "bad", "f"])

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")  # not in order of arrival, so that the sums come out alike each time
        bad = table.column("bad").to_numpy().astype(float)
        f = table_column(table, "f")
        size = np.diff(np.asarray(f.offsets))
        index = f.flatten().to_numpy().astype(np.int64)
        used, w, b = fit(index, np.concatenate([[0], np.cumsum(size)]), bad) if 0 < bad.sum() < len(bad) else (np.zeros(0, np.int64), np.zeros(0), 0.0)
        return pa.table({"used": pa.array([used.tolist()], pa.list_(pa.int64())), "w": pa.array([w.tolist()], pa.list_(pa.float64())), "b": [b], "rate": [float(bad.mean())]})

    # one group of at most about ``rows`` short feature lists
    gathered = sample.mapInArrow(gather, "id bigint, bad int, f array<int>").withColumn("all", F.lit(True))
    model = gathered.groupBy("all").applyInArrow(learn, "used array<bigint>, w array<double>, b double, rate double").first()
    weights = np.zeros(1 << (FEATURE_BITS + 1), np.float32)
    if model is None:
        return weights, 0.0, 0.0
    weights[np.array(model.used, np.int64)] = model.w
    return weights, model.b, model.rate


def evidence(docs: DataFrame, model: tuple[np.ndarray, float, float], text: str = "text") -> DataFrame:
    """``docs`` with evidence: the log odds that the text is bad."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def fn(part: pa.RecordBatch) -> list[pa.Array]:
        weights, b, rate = shared.value
        index, first = features(*text_bytes(column(part, text)))
        if not 0 < rate < 1:
            return [pa.array(np.full(len(part), -1.0))]
        sums = np.concatenate([[0.0], np.cumsum(weights[index], dtype=np.float64)])
        return [pa.array(np.round(np.diff(sums[first]) + b, 6))]

    return append(docs, fn, [("evidence", "double")], text)


def logit(p):
    return F.log(p / (1 - p))


def _strength(sites: DataFrame, prior: str) -> float:
    """Strength of the Beta prior by moments: how much site rates vary beyond chance."""
    p = F.col(prior)
    spread = F.col("n") * (F.col("bad") / F.col("n") - p) ** 2
    r = sites.agg(F.sum("n").alias("n"), F.sum(spread).alias("s"), F.sum(p * (1 - p)).alias("chance"), F.sum(F.col("n") * p * (1 - p)).alias("v"), F.sum(F.col("n") * F.col("n")).alias("nn")).first()
    if not r.n or not r.v:
        return 1.0
    between = max((r.s - r.chance) / r.n, 1e-9)
    return float(min(max(r.v / r.n / between - 1, 1.0), 1e6))


def site_rates(scored: DataFrame, host: str, path: str) -> DataFrame:
    """host, path, host_rate, path_rate, global_rate from grouped sums of the evidence."""
    spark = scored.sparkSession
    p = 1 / (1 + F.exp(-F.col("evidence")))
    paths = materialize(spark, scored.groupBy(F.col(host).alias("host"), F.col(path).alias("path")).agg(F.count("*").alias("n"), F.sum(p.cast("decimal(20,12)")).cast("double").alias("bad")), "sites")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum(F.col("bad").cast("decimal(30,12)")).cast("double").alias("bad"))
    total = hosts.agg(F.sum("n"), F.sum(F.col("bad").cast("decimal(38,12)")).cast("double")).first()
    rate = min(max((total[1] or 0.0) / (total[0] or 1), 1e-6), 1 - 1e-6)
    hosts = hosts.withColumn("prior", F.lit(rate))
    k = _strength(hosts, "prior")
    hosts = hosts.select("host", ((F.col("bad") + k * rate) / (F.col("n") + k)).alias("host_rate"))
    paths = paths.join(hosts.withColumnRenamed("host", "_host"), F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    k = _strength(paths, "host_rate")
    return paths.select("host", "path", "host_rate", ((F.col("bad") + k * F.col("host_rate")) / (F.col("n") + k)).alias("path_rate"), F.lit(rate).alias("global_rate"))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = THRESHOLD, keep_text: bool = True, rows: int = TRAIN_ROWS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with evidence, host_rate, path_rate, score (probability of a bad document) and
    rejected; without the text if it is not to be kept."""
    spark = docs.sparkSession
    docs = docs.drop("evidence", "host_rate", "path_rate", "score", "rejected", "_host", "_path")
    scored = evidence(docs, train(docs, labels, rows, key, text), text)
    scored = materialize(spark, scored if keep_text else scored.drop(text), "evidence")
    sites = site_rates(scored, host, path).withColumnsRenamed({"host": "_host", "path": "_path"})
    out = scored.join(sites, F.col(host).eqNullSafe(F.col("_host")) & F.col(path).eqNullSafe(F.col("_path")), "left")
    odds = F.col("evidence") + logit(F.col("path_rate")) - logit(F.col("global_rate"))
    out = out.withColumn("score", F.round(1 / (1 + F.exp(-odds)), 6))
    return out.withColumn("rejected", F.col("score") > threshold).drop("_host", "_path", "global_rate")

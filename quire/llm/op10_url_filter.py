"""URL filters by a Bloom filter cascade over the corpus's key universe.

Keys are host/path prefixes such as ``example.com/en/``. A URL has one candidate key for each
pair of a suffix of its host and a prefix of its path that has the length of some listed path.
The universe is the distinct candidate keys of the whole corpus. Level 0 of the cascade is a
Bloom filter of the listed keys, level 1 one of the universe's keys that level 0 takes wrongly,
level 2 one of the listed keys that level 1 takes wrongly, and so on until no level errs: on
the universe, the level where a key is first missing tells exactly whether it is listed. A URL
is then judged by testing its own candidates, longest first: nothing is joined.

Level 0 has as many bits a key as make it err on about ``ERRORS`` keys of the counted universe, so
what comes to the driver for level 1, and all later levels, do not grow with the corpus: with a
thousand times the pages it takes some 14 bits more for each listed key.

Filters are broadcast. Listed keys are dealt into parts so that one part's keys and filters
stay under ``part_bytes``, each part has its own cascade, and parts are tested one by one.

Rows with a null URL or one without ``://`` have an empty host and path, fit no rule and get
the default verdict. Pages are judged row by row, so repeated rows get the same answer; of a
rule listed more than once the verdict ``block`` holds. Rules with a null host or path are
ignored. An empty page table gives no rows, an empty rule list the default for all. Input
columns named like the result's are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import U64, append, ascii_lower, column, materialize, mix

PART_BYTES = 16 << 20
BITS_PER_KEY = 12
HASHES = 8
ERRORS = 1 << 12
MAX_LEVELS = 64


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """The keys a listed rule could have to fit, longest first; of equally long ones the longer host."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fit = F.filter(F.array(*[F.lit(n) for n in sorted(lengths, reverse=True)]), lambda n: n <= F.length(path))
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(fit, lambda n: F.concat(h, F.substring(path, F.lit(1), n)))))
    ordered = F.sort_array(F.transform(pairs, lambda k: F.struct(F.length(k).alias("n"), F.instr(k, "/").alias("host"), k.alias("key"))), asc=False)
    return F.when((host != "") & F.lit(bool(lengths)), F.transform(ordered, lambda x: x["key"])).otherwise(F.array().cast("array<string>"))


class Bloom:
    """Bits and double hashing of 64-bit key hashes."""

    def __init__(self, keys: np.ndarray, level: int, bits: float = BITS_PER_KEY) -> None:
        self.level, self.size = level, max(64, 1 << math.ceil(math.log2(max(1, len(keys) * bits))))
        self.bits = np.zeros(self.size // 8, np.uint8)
        for at in self._places(keys):
            np.bitwise_or.at(self.bits, at >> U64(3), np.left_shift(np.uint8(1), (at & U64(7)).astype(np.uint8)))

    def _places(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        a = mix(keys ^ U64(0x9E3779B97F4A7C15 * (self.level + 1) % (1 << 64)))
        b = mix(a) | U64(1)
        for k in range(HASHES):
            yield (a + b * U64(k)) & U64(self.size - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for at in self._places(keys):
            found &= (self.bits[at >> U64(3)] >> (at & U64(7)).astype(np.uint8)) & np.uint8(1) > 0
        return found


def member(levels: list[Bloom], keys: np.ndarray) -> np.ndarray:
    """Whether each key of the universe is listed."""
    answer, open_ = np.zeros(len(keys), bool), np.arange(len(keys))
    for k, level in enumerate(levels):
        passes = level.has(keys[open_])
        answer[open_[~passes]] = k % 2 == 1
        open_ = open_[passes]
        if not len(open_):
            break
    answer[open_] = (len(levels) - 1) % 2 == 0
    return answer


def bits_per_key(universe: int) -> float:
    """Bits a key with which HASHES probes err on ERRORS of ``universe`` keys, BITS_PER_KEY at least."""
    rate = min(1.0, ERRORS / max(universe, 1))
    return max(BITS_PER_KEY, -HASHES / math.log1p(-(rate ** (1 / HASHES)))) if rate < 1 else BITS_PER_KEY


def build_cascade(spark: SparkSession, listed: np.ndarray, universe: DataFrame, size: int = 0) -> list[Bloom]:
    """``listed``: key hashes; ``universe``: column h, the corpus's ``size`` candidate key hashes.

    Each round tests the whole universe in Spark and brings back only the keys on which the
    levels so far err: some ERRORS in the first round, a fraction of the round before in the next.
    """
    levels = [Bloom(listed, 0, bits_per_key(size))]
    known = np.sort(listed)
    while len(levels) < MAX_LEVELS:
        if len(levels) % 2:  # the last level stands for listed keys: what else passes all levels?
            shared = spark.sparkContext.broadcast((levels, known))

            def wrong(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                levels, known = shared.value
                for b in batches:
                    h = column(b, "h").to_numpy().view(U64)
                    at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
                    out = h[member(levels, h) & (known[at] != h if len(known) else True)]
                    yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64))], ["h"])

            errs = np.array([r.h for r in universe.mapInArrow(wrong, "h bigint").collect()], np.int64).view(U64)
        else:  # the last level stands for keys not listed: which listed ones pass all levels?
            errs = listed[~member(levels, listed)]
        if not len(errs):
            return levels
        levels.append(Bloom(errs, len(levels)))
    raise ValueError("the cascade does not end: two keys share a hash")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", part_bytes: int = PART_BYTES) -> DataFrame:
    """``pages`` with host, path, rule (the longest fitting one, or null) and verdict.

    ``rules``: host, path, verdict (allow or block). The longest rule has most characters.
    """
    spark = pages.sparkSession
    rules = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
    rules = rules.groupBy(F.concat(ascii_lower(F.col("host")), F.col("path")).alias("key"), F.length("path").alias("n")).agg(F.max("verdict").alias("verdict"))
    lengths = [r.n for r in rules.select("n").distinct().collect()]  # path lengths, at most a few thousand
    host, path = url_parts(F.col("url"))
    pages = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    pages = pages.withColumn("_keys", candidates(F.col("host"), F.col("path"), lengths))
    hashes = F.transform("_keys", lambda k: F.xxhash64(k))
    universe = materialize(spark, pages.select(F.explode(F.array_distinct(hashes)).alias("h")).distinct(), "universe")
    count = universe.count()
    size = rules.agg(F.coalesce(F.sum(F.octet_length("key") + 40), F.lit(0))).first()[0]
    parts = max(1, math.ceil(size / part_bytes))
    pages = pages.withColumns({"_hashes": hashes, "_best": F.lit(None).cast("int"), "_verdict": F.lit(None).cast("string")})
    for k in range(parts):
        mine = rules.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == k).select("key", "verdict", F.xxhash64("key").alias("h")).collect()  # bounded by part_bytes
        listed = np.array([r.h for r in mine], np.int64).view(U64)
        blocked = np.array([r.h for r in mine if r.verdict == "block"], np.int64).view(U64)
        keys = build_cascade(spark, listed, universe, count)
        # among the listed keys, a second cascade tells the two verdicts apart
        verdicts = build_cascade(spark, blocked, spark.createDataFrame([(int(x),) for x in listed.view(np.int64)], "h bigint"))
        pages = judge(pages, spark.sparkContext.broadcast((keys, verdicts)))
    rule = F.element_at("_keys", F.col("_best") + 1)
    out = pages.withColumns({"rule": F.when(F.col("_best").isNotNull(), rule), "verdict": F.coalesce("_verdict", F.lit(default))})
    return out.drop("_keys", "_hashes", "_best", "_verdict")


def judge(pages: DataFrame, shared) -> DataFrame:
    """Sets _best to the first candidate that is listed in this part, if it comes before the
    one known so far, and _verdict to its verdict."""

    def fn(part: pa.RecordBatch) -> list[pa.Array]:
        keys, verdicts = shared.value
        lists_ = column(part, "_hashes")
        counts = np.diff(np.asarray(lists_.offsets))
        flat = lists_.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
        listed = np.flatnonzero(member(keys, flat))
        rows = np.searchsorted(np.cumsum(counts), listed, "right")
        rows, first = np.unique(rows, return_index=True)
        at = listed[first]
        best, verdict = column(part, "_best").to_pylist(), column(part, "_verdict").to_pylist()
        starts = np.cumsum(counts) - counts
        for r, i, block in zip(rows.tolist(), (at - starts[rows]).tolist(), member(verdicts, flat[at]).tolist()):
            if best[r] is None or i < best[r]:
                best[r], verdict[r] = i, "block" if block else "allow"
        return [pa.array(best, pa.int32()), pa.array(verdict, pa.string())]

    out = append(pages, fn, [("_best2", "int"), ("_verdict2", "string")], "_hashes", more=("_best", "_verdict"))
    return out.drop("_best", "_verdict").withColumnsRenamed({"_best2": "_best", "_verdict2": "_verdict"})

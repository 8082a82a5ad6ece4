"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of the benchmark items: ten consecutive words, or the whole item if
it has fewer. For patterns of one length m the usual three tables are built with blocks of
three words (fewer if m is less): SHIFT gives how far the search may jump on the block it
looks at; where it gives 0, the bucket of that suffix block holds the patterns to test; a
pattern whose prefix block agrees is compared word by word with the text.

The search runs inside map tasks: texts are not shuffled. The patterns go to the executors as
broadcasts of at most ``block_bytes``; a benchmark that needs more is searched for block by
block, with the hits so far carried along in a written table.

Null and empty texts have no words and are not contaminated. A document row is judged by
itself, so repeated rows and ids, also null ones, get the same answer each. Repeated items
count once by id; hits of items without an id count as hits, but are not listed. Null and
empty items, and an empty benchmark, hit nothing. Input columns named like the result's are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import NOT_ALNUM, SPANS, U64, append, ascii_lower, column, covered, lists, materialize, runs, spans_array, text_bytes, word_hashes, words

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
BLOCK_BYTES = 32 << 20
SEGMENT = 2048
CODE_BITS = 20
_MULTIPLY = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], U64)


def pattern_rows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Columns item_id string, pattern string: each item's distinct windows."""
    n = F.size("w")
    at = F.when(n > window, F.sequence(F.lit(1), n - window + 1)).when(n > 0, F.array(F.lit(1)))
    return (
        benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(WORD), F.lit(0)).alias("w"))
        .select("item_id", "w", F.explode(at).alias("at"))
        .select("item_id", F.array_join(F.slice("w", F.col("at"), F.lit(window)), " ").alias("pattern"))
        .distinct()
    )


def block_codes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A number for the ``size`` words that end at each word."""
    code = hashes * _MULTIPLY[0]
    for k in range(1, size):
        code[k:] += hashes[:-k] * _MULTIPLY[k]
    return (code >> U64(64 - CODE_BITS)).astype(np.int64)


@dataclass
class WuManber:
    """The tables for patterns of ``length`` words."""

    length: int
    block: int
    shift: np.ndarray
    suffix: np.ndarray  # of the patterns, ascending
    prefix: np.ndarray
    patterns: list[bytes]
    items: list[list[str | None]]

    @staticmethod
    def build(length: int, patterns: dict[bytes, list[str | None]]) -> WuManber:
        block = min(3, length)
        texts = list(patterns)
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        buf = np.frombuffer(b"".join(texts), np.uint8)
        starts, ends, first = words(buf, off, NOT_ALNUM)
        codes = block_codes(word_hashes(buf, starts, ends), block)
        shift = np.full(1 << CODE_BITS, length - block + 1, np.uint8)
        for j in range(block - 1, length):
            at = codes[first[:-1] + j]
            shift[at] = np.minimum(shift[at], length - 1 - j)
        suffix, prefix = codes[first[:-1] + length - 1], codes[first[:-1] + block - 1]
        order = np.argsort(suffix, kind="stable")
        return WuManber(length, block, shift, suffix[order], prefix[order], [texts[i] for i in order], [patterns[texts[i]] for i in order])

    def search(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, hashes: np.ndarray) -> tuple[list[int], list[int]]:
        """First words of the occurrences, and their patterns."""
        m, codes = self.length, block_codes(hashes, self.block)
        # all texts are searched side by side, long ones in segments
        pieces = -(-np.diff(first) // SEGMENT)
        number = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = np.repeat(first[:-1], pieces) + number * SEGMENT
        end = np.minimum(at + SEGMENT + m - 1, np.repeat(first[1:], pieces))
        at = at + m - 1
        found = []
        while True:
            keep = at < end
            if not keep.all():
                at, end = at[keep], end[keep]
            if not len(at):
                break
            jump = self.shift[codes[at]]
            if not jump.all():
                found.append(at[jump == 0])
            at = at + np.maximum(jump, 1)
        if not found:
            return [], []
        at = np.concatenate(found)
        low, high = np.searchsorted(self.suffix, codes[at]), np.searchsorted(self.suffix, codes[at], "right")
        size = high - low
        which = np.repeat(low, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        at = np.repeat(at, size)
        same = codes[at - m + self.block] == self.prefix[which]
        hits, patterns = [], []
        for p, k in zip(at[same].tolist(), which[same].tolist()):
            if b" ".join([raw[s:e] for s, e in zip(starts[p - m + 1 : p + 1].tolist(), ends[p - m + 1 : p + 1].tolist())]) == self.patterns[k]:
                hits.append(p - m + 1)
                patterns.append(k)
        return hits, patterns


def tables(rows: list) -> list[WuManber]:
    by_length: dict[int, dict[bytes, list]] = {}
    for r in rows:
        by_length.setdefault(r.pattern.count(" ") + 1, {}).setdefault(r.pattern.encode(), []).append(r.item_id)
    return [WuManber.build(n, p) for n, p in sorted(by_length.items())]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def search_block(docs: DataFrame, shared) -> DataFrame:
    """Adds the hits of one block of patterns to spans (of words) and items."""

    def fn(part: pa.RecordBatch) -> list[pa.Array]:
        buf, off = text_bytes(column(part, "text"))
        buf = _LOWER[buf]
        starts, ends, first = words(buf, off, NOT_ALNUM)
        hashes, raw, n = word_hashes(buf, starts, ends), buf.tobytes(), len(part)
        hit = np.zeros(len(starts), bool)
        named: list[set] = [set(x or ()) for x in column(part, "_items").to_pylist()]
        for d, spans in enumerate(column(part, "_spans").to_pylist()):
            for s in spans or ():
                hit[first[d] + s["start"] : first[d] + s["end"]] = True
        for table in shared.value:
            at, which = table.search(raw, starts, ends, first, hashes)
            if at:
                hit |= covered(np.array(at), table.length, len(starts))
                for d, k in zip((np.searchsorted(first, at, "right") - 1).tolist(), which):
                    named[d].update(x for x in table.items[k] if x is not None)
        s, e, where = runs(hit, first)
        items = [sorted(x) for x in named]
        off_items = np.concatenate([[0], np.cumsum([len(x) for x in items])])
        return [
            spans_array(s, e, where),
            lists(pa.array([y for x in items for y in x], pa.string()), off_items),
            pa.array(np.diff(first), pa.int64()),
            pa.array(np.add.reduceat(np.append(hit, False).astype(np.int64), first[:-1]) * (np.diff(first) > 0) if n else np.zeros(0, np.int64), pa.int64()),
        ]

    out = docs.withColumns({c: F.lit(None).cast(t) for c, t in (("_spans", SPANS), ("_items", "array<string>")) if c not in docs.columns})
    out = append(out, fn, [("hit_spans", SPANS), ("hit_items", "array<string>"), ("n_words", "bigint"), ("n_hit", "bigint")], more=("_spans", "_items"))
    return out.drop("_spans", "_items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit (words in occurrences), hit_spans (maximal runs of hit words),
    hit_items (ids as sorted strings), n_items, contaminated."""
    spark = docs.sparkSession
    docs = docs.drop("_spans", "_items")
    rows = pattern_rows(benchmark, window)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("pattern") + F.coalesce(F.octet_length("item_id"), F.lit(0)) + 100), F.lit(0))).first()[0]
    number = max(1, math.ceil(size / block_bytes))
    for k in range(number):
        mine = rows.where(F.pmod(F.xxhash64("pattern", "item_id"), F.lit(number)) == k).collect()  # at most about block_bytes
        docs = search_block(docs, spark.sparkContext.broadcast(tables(mine)))
        if k + 1 < number:
            docs = materialize(spark, docs, "decontaminate").withColumnsRenamed({"hit_spans": "_spans", "hit_items": "_items"})
    return docs.withColumns({"n_items": F.size("hit_items").cast("long"), "contaminated": F.col("n_hit") > 0})

"""Byte-level BPE encoding and decoding by merge replay over distinct words.

A text is cut at white space into units that the split pattern never joins, so a unit's tokens
do not depend on what stands round it. Each distinct unit is split by the pattern and merged
once: an inverted index from merge rank to places in the words is worked off in rank order, all
places of a rank at once; a merge looks up the pairs with its two neighbours and enters them
in the index, nothing else is touched.

Units are counted over the whole corpus; the most frequent (at most DICTIONARY_UNITS) are
merged in Spark and broadcast. The others are merged by the same replay over the distinct units
of each slice of texts (SLICE_BYTES), so nothing is left out and memory is bounded.

Null and empty texts have no tokens. Rows are encoded by themselves: repeated rows and null ids
get the same answer each. An empty table gives no rows. Input columns named like the result's
are replaced.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import append, column, cuts, lists, materialize, sizes, table_column, text_bytes, word_hashes

DICTIONARY_UNITS = 1 << 18
UNIT_BYTES = 16 << 20
COUNTS = 1 << 16
SLICE_BYTES = 2 << 20

# ---------------------------------------------------------------- units

_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: White space beyond ASCII, as UTF-8.
_WIDE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_WIDE_LEAD = np.zeros(256, bool)
_WIDE_LEAD[[w[0] for w in _WIDE]] = True
_CONTINUES = np.zeros(256, bool)
_CONTINUES[0x80:0xC0] = True


def unit_starts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where units begin. A unit is a run of other characters with the one blank before it; a
    white-space character that is not such a blank; a longer run of white space without its last character,
    or all of it at the end of a text."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64)
    space = _ASCII_SPACE[buf]
    if _WIDE_LEAD[buf].any():
        for w in _WIDE:
            at = np.flatnonzero(buf[: n - len(w) + 1] == w[0])
            for k in range(1, len(w)):
                at = at[buf[at + k] == w[k]]
            for k in range(len(w)):
                space[at + k] = True
    begin = np.zeros(n + 1, bool)  # of texts
    begin[off] = True
    before = np.zeros(n, bool)
    before[1:] = space[:-1]
    start = begin[:n] | (space != before)  # of runs
    # last character of a run of white space that others follow
    last = np.zeros(n, bool)
    follows = np.flatnonzero(start & ~space & before & ~begin[:n]) - 1
    while len(back := follows[_CONTINUES[buf[follows]]]):
        follows = np.concatenate([follows[~_CONTINUES[buf[follows]]], back - 1])
    last[follows] = True
    start |= last
    blank = last & (buf == 0x20)
    after = np.flatnonzero(blank) + 1
    start[after] = False  # the blank belongs to what follows
    return np.flatnonzero(start)


def coded(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Number of each unit, the distinct units, and each text's first unit."""
    starts = unit_starts(buf, off)
    offsets = np.append(starts, len(buf)).astype(np.int64)
    units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(buf))])
    found = units.dictionary_encode()
    return found.indices.to_numpy(), found.dictionary, np.searchsorted(starts, off)


def gather(values: np.ndarray, first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[first[k]:first[k+1]] for each k of ``which`` in a row, and the lengths."""
    size = np.diff(first)[which]
    at = np.arange(size.sum()) + np.repeat(first[which] - (np.cumsum(size) - size), size)
    return values[at], size


# ---------------------------------------------------------------- vocabulary and replay


class Vocabulary:
    """Tokens by rank, and the pairs of tokens that make a token."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.token = {r: t for t, r in self.rank.items()}
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for t, r in self.rank.items():
            for i in range(1, len(t)):
                a, b = self.rank.get(t[:i]), self.rank.get(t[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = r
        self.pairs = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.pairs.tolist()], np.int32)
        size = np.zeros(max(self.token) + 2, np.int64)
        for r, t in self.token.items():
            size[r + 1] = len(t)
        self.first = np.cumsum(size)
        self.bytes = np.frombuffer(b"".join(self.token[r] for r in sorted(self.token)), np.uint8)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, -1 if it makes none."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.made[at], -1)


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def replay(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all words, and where each word's begin."""
    first = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    n = int(first[-1])
    token = v.byte[np.frombuffer(b"".join(words), np.uint8)]
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    ends = first[1:][np.diff(first) > 0]
    after[ends - 1] = -1
    before[first[:-1][np.diff(first) > 0]] = -1
    alive = np.ones(n, bool)
    rank = np.full(n, -1, np.int32)  # of the pair that begins at each place
    open_ = np.flatnonzero(after >= 0)
    rank[open_] = v.rank_of(token[open_], token[open_ + 1])
    index: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def enter(places: np.ndarray) -> None:
        places = places[rank[places] >= 0]
        if not len(places):
            return
        ranks = rank[places]
        if len(places) > 1:
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
        edges = np.flatnonzero(np.diff(ranks)) + 1
        for s, e in zip([0, *edges.tolist()], [*edges.tolist(), len(places)]):
            r = int(ranks[s])
            if r not in index:
                index[r] = []
                heapq.heappush(queue, r)
            index[r].append(places[s:e])

    enter(open_)
    while queue:
        r = heapq.heappop(queue)
        held = index.pop(r)
        at = np.unique(np.concatenate(held)) if len(held) > 1 else np.sort(held[0])
        at = at[alive[at]]
        at = at[rank[at] == r]
        if not len(at):
            continue
        chained = np.append(False, after[at[:-1]] == at[1:])
        if chained.any():  # overlapping pairs: every second one of a chain, from the left
            heads = np.flatnonzero(~chained)
            step = np.arange(len(at)) - np.repeat(heads, np.diff(np.append(heads, len(at))))
            at = at[step % 2 == 0]
        gone = after[at]
        follow = after[gone]
        token[at], after[at] = r, follow
        alive[gone], rank[gone], rank[at] = False, -1, -1
        has = follow >= 0
        before[follow[has]] = at[has]
        left = before[at]
        left = left[left >= 0]
        touched = np.concatenate([at[has], left])
        if len(touched):
            touched = np.unique(touched)
            rank[touched] = v.rank_of(token[touched], token[after[touched]])
            enter(touched)
    places = np.flatnonzero(alive)
    return token[places], np.searchsorted(places, first)


def encode_units(units: list[bytes], v: Vocabulary, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all units, and where each unit's begin."""
    split = regex.compile(pattern)
    number: dict[bytes, int] = {}
    parts, counts = [], []
    for u in units:
        pieces = split.findall(u.decode())
        counts.append(len(pieces))
        parts.extend([number.setdefault(p.encode(), len(number)) for p in pieces])
    tokens, first = replay(list(number), v)
    # a piece that is a token as a whole is that token
    single = np.array([v.rank.get(p, -1) for p in number], np.int64)
    size = np.where(single >= 0, 1, np.diff(first))
    start = np.concatenate([[0], np.cumsum(size)])
    flat = np.empty(start[-1], np.int32)
    whole = np.flatnonzero(single >= 0)
    flat[start[whole]] = single[whole]
    other = np.flatnonzero(single < 0)
    values, lengths = gather(tokens, first, other)
    flat[np.arange(len(values)) + np.repeat(start[other] - (np.cumsum(lengths) - lengths), lengths)] = values
    ids, lengths = gather(flat, start, np.array(parts, np.int64))
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return ids, ends[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]


# ---------------------------------------------------------------- Spark


def count_units(docs: DataFrame, text: str = "text") -> DataFrame:
    """unit binary, n: how often each unit occurs in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = text_bytes(column(batch, text))
            for i, j in cuts(off, SLICE_BYTES):
                codes, units, _ = coded(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                yield pa.RecordBatch.from_arrays([units.cast(pa.binary()), pa.array(np.bincount(codes, minlength=len(units)))], ["unit", "n"])

    return docs.select(text).mapInArrow(run, "unit binary, n bigint").groupBy("unit").agg(F.sum("n").alias("n"))


def frequent_units(docs: DataFrame, path: str, pattern: str, limit: int, text: str = "text") -> DataFrame:
    """unit, ids: the most frequent units of the corpus, ``limit`` and UNIT_BYTES at most, encoded."""
    units = materialize(docs.sparkSession, count_units(docs, text).where("n > 1"), "bpe-units")
    # by the COUNTS greatest counts that occur, so that what comes to the driver is bounded
    counts = units.groupBy("n").agg(F.count("*").alias("k"), F.sum(F.octet_length("unit")).alias("bytes")).orderBy(F.desc("n")).limit(COUNTS).collect()
    least, k, size = 1 << 62, 0, 0
    for r in counts:
        k, size = k + r.k, size + r.bytes
        if k > limit or size > UNIT_BYTES:
            break
        least = r.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, first = encode_units(column(batch, "unit").to_pylist(), vocabulary(path), pattern)
            yield pa.RecordBatch.from_arrays([column(batch, "unit"), lists(pa.array(ids), first)], ["unit", "ids"])

    return units.where(F.col("n") >= least).select("unit").mapInArrow(run, "unit binary, ids array<int>")


def hashes_of(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    return word_hashes(buf, off[:-1], off[1:])


class Dictionary:
    """Units and their tokens as arrays, found by hash and compared byte by byte."""

    def __init__(self, units: pa.Array, ids: pa.Array) -> None:
        buf, off = text_bytes(units)
        hashes = hashes_of(buf, off)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.buf, size = gather(buf, off, order)
        self.off = np.concatenate([[0], np.cumsum(size)])
        first = sizes(ids)
        self.ids, size = gather(ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32), first, order)
        self.first = np.concatenate([[0], np.cumsum(size)])

    def find(self, units: pa.Array) -> np.ndarray:
        """The place of each unit in here, -1 for others."""
        known = np.full(len(units), -1, np.int64)
        if not len(self.hashes) or not len(units):
            return known
        buf, off = text_bytes(units)
        at = np.minimum(np.searchsorted(self.hashes, hashes_of(buf, off)), len(self.hashes) - 1)
        alike = np.flatnonzero(np.diff(off) == np.diff(self.off)[at])
        if len(alike):
            mine, size = gather(self.buf, self.off, at[alike])
            differ = mine != gather(buf, off, alike)[0]
            same = np.add.reduceat(differ, np.cumsum(size) - size) == 0  # a unit has a byte at least
            known[alike[same]] = at[alike[same]]
        return known

    def encode(self, units: pa.Array, rest) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all units, and where each begins; ``rest`` encodes those not in here."""
        known = self.find(units)
        others, mine = np.flatnonzero(known < 0), np.flatnonzero(known >= 0)
        ids, first = rest(units.take(pa.array(others)).to_pylist())
        size = np.empty(len(units), np.int64)
        size[others], size[mine] = np.diff(first), np.diff(self.first)[known[mine]]
        start = np.concatenate([[0], np.cumsum(size)])
        flat = np.empty(start[-1], np.int32)
        for where, values, lengths in ((mine, *gather(self.ids, self.first, known[mine])), (others, ids, np.diff(first))):
            flat[np.arange(len(values)) + np.repeat(start[where] - (np.cumsum(lengths) - lengths), lengths)] = values
        return flat, start


def text_ids(buf: np.ndarray, off: np.ndarray, encode, cut=coded) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts and where each text's begin; ``encode`` takes the distinct units
    that ``cut`` finds."""
    codes, units, first = cut(buf, off)
    ids, start = encode(units.to_pylist())
    values, size = gather(ids, start, codes)
    return values, np.concatenate([[0], np.cumsum(size)])[first]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", limit: int = DICTIONARY_UNITS) -> DataFrame:
    """``docs`` with ids and n_tokens by the ranks in the file ``path``; the file must be at
    that place on every executor."""
    spark: SparkSession = docs.sparkSession
    rows = frequent_units(docs, path, pattern, limit, text).toArrow()  # at most ``limit`` short units
    shared = spark.sparkContext.broadcast(Dictionary(table_column(rows, "unit"), table_column(rows, "ids")))

    def fn(part: pa.RecordBatch) -> list[pa.Array]:
        codes, units, first = coded(*text_bytes(column(part, text)))
        ids, start = shared.value.encode(units, lambda rest: encode_units(rest, vocabulary(path), pattern))
        values, size = gather(ids, start, codes)
        first = np.concatenate([[0], np.cumsum(size)])[first]
        return [lists(pa.array(values), first), pa.array(np.diff(first))]

    return append(docs, fn, [("ids", "array<int>"), ("n_tokens", "bigint")], text, SLICE_BYTES)


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``df`` with decoded, the bytes of its ids; null ids give none."""

    def fn(part: pa.RecordBatch) -> list[pa.Array]:
        v, values = vocabulary(path), column(part, ids)
        first = sizes(values)
        tokens = values.flatten().to_numpy(zero_copy_only=False)
        out = []
        step = 1 << 20
        for i in range(0, len(tokens), step):
            out.append(gather(v.bytes, v.first, tokens[i : i + step])[0])
        length = np.concatenate([[0], np.cumsum(np.diff(v.first)[tokens])])[first]
        data = np.concatenate(out) if out else np.zeros(0, np.uint8)
        return [pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(values), [None, pa.py_buffer(length.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())]

    return append(df, fn, [("decoded", "binary")], ids, SLICE_BYTES // 4)

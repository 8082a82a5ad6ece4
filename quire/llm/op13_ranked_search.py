"""Ranked lexical search with Block-Max MaxScore over an index that Spark writes.

``write_index`` makes one table in one pass over the texts. A task's rows form index blocks of
about ``BLOCK_BYTES``; a block has one row with its documents (ids ascending, numbers of terms)
and one for each of its terms: postings (document, occurrences) in runs of ``RUN``, each run
compressed by itself (differences in variable-length bytes), with its last document, most
occurrences and fewest terms of a document uncompressed beside it. Nothing in the index depends
on corpus statistics, so further documents are further blocks.

``search`` ranks documents for each query:

1. The weights come from the index: N, L and df are sums over its rows.
2. Lists of query terms are dealt by block and sorted, so a task (a shard) holds one block at a
   time, and for every query a heap of its best ``k`` documents so far.
3. Lists ordered by their bound over the whole index: as long as the sum of bounds stays below
   the heap's least score, no document of these lists alone can enter; the others are essential.
4. Documents of the essential lists are candidates. For each other list, highest bound first,
   the maximum of the run in which a candidate would lie rejects those that cannot reach the
   heap's least score any more; only runs of survivors are decompressed.
5. The shards' heaps are merged by a rank within the query.

Scores are whole numbers: term weight floor(1000 ln((2N+2)/(2df+1))) times
(10**9 tf) div (1000 tf + 8m), with m = 25 + (75 n N) div L.

Terms are the maximal runs of letters and digits, only A-Z lower-cased; all other characters
beyond ASCII count as letters. Null, empty and sign-only texts have no terms: such documents are
never found and such queries find nothing. A null id is kept and comes before all others among
equal scores; repeated rows are documents of their own, repeated queries give repeated results.
Fewer than k documents with a score above 0 are all returned. Other columns do not matter.

Queries are taken to the tasks in passes of about ``PAIRS`` (query, term) pairs, so neither the
driver nor a task holds more, whatever the number of queries. A block's memory follows
``BLOCK_BYTES`` or its one longer text.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import NO_ID, NOT_ALNUM, SLICE_BYTES, ascii_lower, blocks, longs, materialize, table_column, text_bytes, unz, word_hashes, words, work_dir, z

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK_BYTES = 8 << 20
RUN = 128
PAIRS = 1 << 18
INDEX = "block bigint, term string, docs bigint, words bigint, most bigint, least bigint, lasts binary, tops binary, shorts binary, ends binary, data binary"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# ---------------------------------------------------------------- index


def varint(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, low bits first, the high bit set on all but a value's last byte; and
    where each value ends."""
    size = 1 + sum((v >= 1 << s).astype(np.int64) for s in (7, 14, 21, 28))
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(v) else 0, np.uint8)
    for k in range(int(size.max()) if len(v) else 0):
        here = size > k
        out[(ends - size)[here] + k] = (v[here] >> (7 * k) & 127) | np.where(size[here] > k + 1, 128, 0)
    return out, ends


def unvarint(b: np.ndarray) -> np.ndarray:
    last = b < 128
    if last.all():
        return b.astype(np.int64)
    starts = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(b)]])))
    return np.add.reduceat((b & 127).astype(np.int64) << (7 * place), starts)


def pieces(buf: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of about ``limit`` bytes that end behind a byte between terms."""
    a = 0
    while a < len(buf):
        b = min(a + limit, len(buf))
        if b < len(buf):
            back = np.flatnonzero(NOT_ALNUM[buf[a:b]])
            b = a + int(back[-1]) + 1 if len(back) else b
            while not len(back) and b < len(buf):  # a term longer than the limit
                ahead = np.flatnonzero(NOT_ALNUM[buf[b : b + limit]])
                b = b + int(ahead[0]) + 1 if len(ahead) else min(b + limit, len(buf))
                if len(ahead):
                    break
        yield a, b
        a = b


def grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by keys (first one first) and where each group of equal keys begins in it."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order, np.flatnonzero(new)


def occurrences(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Term hash, document, occurrences, and first place and length in ``buf``, for each term of
    each document, ordered by hash and document."""
    parts = []
    for a, b in pieces(buf):
        starts, ends, first = words(buf[a:b], np.clip(off, a, b) - a, NOT_ALNUM)
        doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
        hashes = word_hashes(buf[a:b], starts, ends)
        order, at = grouped(hashes, doc)
        one = order[at]
        parts.append((hashes[one], doc[one], np.diff(np.append(at, len(order))), starts[one] + a, (ends - starts)[one]))
    if not parts:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none, none
    hashes, doc, tf, start, size = (np.concatenate(x) for x in zip(*parts))
    order, at = grouped(hashes, doc)
    return hashes[order[at]], doc[order[at]], np.add.reduceat(tf[order], at) if len(at) else tf, start[order[at]], size[order[at]]


def slices(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values data[ends[i-1]:ends[i]] (bytes)."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def index_block(number: int, ids: np.ndarray, buf: np.ndarray, off: np.ndarray) -> pa.RecordBatch:
    by_id = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[by_id] = np.arange(len(ids))
    buf = _LOWER[buf]
    hashes, doc, tf, start, size = occurrences(buf, off)
    doc = place[doc]
    n = np.bincount(doc, tf, len(ids)).astype(np.int64)
    order, at = grouped(hashes, doc)
    hashes, doc, tf, start, size = (x[order] for x in (hashes, doc, tf, start, size))
    new = np.ones(len(doc), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    first = np.flatnonzero(new)  # of a term
    df = np.diff(np.append(first, len(doc)))
    within = np.arange(len(doc)) - np.repeat(first, df)
    run = np.flatnonzero(within % RUN == 0)
    count = np.diff(np.append(run, len(doc)))
    runs = -(-df // RUN)
    run_end = np.cumsum(runs)
    step = np.diff(doc, prepend=0) - 1
    step[first] = doc[first]
    begin, length = np.repeat(run, count), np.repeat(count, count)
    values = np.empty(2 * len(doc), np.int64)
    inside = np.arange(len(doc)) - begin
    values[2 * begin + inside] = step
    values[2 * begin + length + inside] = tf - 1
    data, ends = varint(values)
    stop = ends[2 * (run + count) - 1] if len(run) else run
    term_stop = stop[run_end - 1] if len(run) else run
    base = np.repeat(np.concatenate([[0], term_stop[:-1]]), runs) if len(run) else run
    fold = lambda f, x, where: f.reduceat(x, where) if len(where) else x[:0]
    fit = lambda x: x.astype("<u4").view(np.uint8)
    names = np.concatenate([[0], np.cumsum(size[first])])
    letters = buf[np.repeat(start[first] - names[:-1], size[first]) + np.arange(int(names[-1]))]
    shorts = fold(np.minimum, n[doc], run)
    tops = fold(np.maximum, tf, run)
    term = slices(letters, names[1:]).cast(pa.string())
    whole = [
        pa.array([number], pa.int64()), pa.array([None], pa.string()), pa.array([int((n > 0).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64()),
        pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([z(n)]), *[pa.array([b""])] * 3, pa.array([z(ids[by_id])]),
    ]
    lists = [
        pa.array(np.full(len(first), number)), term, pa.array(df), pa.nulls(len(first), pa.int64()),
        pa.array(fold(np.maximum, tf, first)), pa.array(fold(np.minimum, n[doc], first)),
        slices(fit(doc[run + count - 1]), 4 * run_end), slices(fit(tops), 4 * run_end), slices(fit(shorts), 4 * run_end), slices(fit(stop - base), 4 * run_end), slices(data, term_stop),
    ]
    return pa.RecordBatch.from_arrays([pa.concat_arrays([a, b.cast(a.type)]) for a, b in zip(whole, lists)], [f.split()[0] for f in INDEX.split(", ")])


def write_index(spark: SparkSession, docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> None:
    """The index of all rows as a Parquet table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in blocks(batches, block_bytes):
            buf, off = text_bytes(table_column(table, "text"))
            yield index_block(number, longs(table_column(table, "id")), buf, off)

    docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, INDEX).write.parquet(path)


# ---------------------------------------------------------------- search


def impact(tf, m):
    return (10**9 * tf) // (1000 * tf + 8 * m)


def lengths(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """m of documents with n terms; by Python's numbers where the product has over 63 bits."""
    if len(n) and 75 * int(n.max()) * docs < 1 << 63:
        return 25 + (75 * n * docs) // max(total, 1)
    return np.array([25 + 75 * int(x) * docs // max(total, 1) for x in n], np.int64)


class List:
    """The postings of one term in one block."""

    def __init__(self, row: dict, m: np.ndarray, docs: int, total: int) -> None:
        self.m = m
        self.lasts, self.ends = (np.frombuffer(row[c], "<u4").astype(np.int64) for c in ("lasts", "ends"))
        tops, shorts = (np.frombuffer(row[c], "<u4").astype(np.int64) for c in ("tops", "shorts"))
        self.data = np.frombuffer(row["data"], np.uint8)
        self.most = impact(tops, lengths(shorts, docs, total))
        self.ceiling = int(self.most.max())
        self.counts = np.full(len(self.lasts), RUN)
        self.counts[-1] = row["docs"] - RUN * (len(self.lasts) - 1)
        self.all: tuple[np.ndarray, np.ndarray] | None = None

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        if self.all is None:
            self.all = self.unpacked(np.arange(len(self.lasts)))
        return self.all

    def runs(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.whole() if self.all is not None or len(which) == len(self.lasts) else self.unpacked(which)

    def unpacked(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents of these runs, ascending, and their impacts."""
        if len(which) == len(self.lasts):
            packed = self.data
        else:
            packed = np.concatenate([self.data[self.ends[r - 1] if r else 0 : self.ends[r]] for r in which])
        count = self.counts[which]
        values, at = unvarint(packed), np.concatenate([[0], np.cumsum(count)])
        inside = np.arange(len(values)) - np.repeat(2 * at[:-1], 2 * count)
        steps = inside < np.repeat(count, 2 * count)
        sums = np.concatenate([[0], np.cumsum(values[steps] + 1)])
        before = np.where(which > 0, self.lasts[which - 1], -1)
        docs = sums[1:] + np.repeat(before - sums[at[:-1]], count)
        return docs, impact(values[~steps] + 1, self.m[docs])


class Heap:
    """The best k (score, id) of one query in one shard; ``need`` is what a document must reach."""

    def __init__(self, k: int) -> None:
        self.k, self.need = k, 1
        self.scores = self.ids = np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        best = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[best], ids[best]
        if len(best) == self.k:
            self.need = int(self.scores[-1])


def search_block(query: list[tuple[str, int, int]], lists: dict[str, List], ids: np.ndarray, heap: Heap) -> None:
    """``query``: (term, weight, bound over the whole index), by ascending bound."""
    here = [(w, u, lists[t]) for t, w, u in query if t in lists]
    if sum(w * x.ceiling for w, _, x in here) < heap.need:
        return
    others, bound = 0, 0
    while others < len(here) and bound + here[others][1] < heap.need:
        bound += here[others][1]
        others += 1
    scores = np.zeros(len(ids), np.int64)
    for w, _, x in here[others:]:
        docs, impacts = x.whole()
        scores[docs] += w * impacts
    rest = sum(w * x.ceiling for w, _, x in here[:others])
    found = np.flatnonzero(scores >= max(1, heap.need - rest))
    scores = scores[found]
    for w, _, x in reversed(here[:others]):
        if not len(found):
            return
        rest -= w * x.ceiling
        run = np.searchsorted(x.lasts, found)
        inside = run < len(x.lasts)
        most = np.where(inside, w * x.most[np.minimum(run, len(x.lasts) - 1)], 0)
        alive = scores + most + rest >= heap.need
        found, scores, run, inside = found[alive], scores[alive], run[alive], inside[alive]
        if inside.any():
            docs, impacts = x.runs(np.unique(run[inside]))
            at = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
            scores = scores + np.where(docs[at] == found, w * impacts[at], 0)
        alive = scores + rest >= heap.need
        found, scores = found[alive], scores[alive]
    if len(found):
        heap.add(scores, ids[found])


def shard_heaps(queries: dict[int, list[tuple[str, int, int]]], docs: int, total: int, k: int):
    """Over the rows of whole blocks, in order of their blocks: the best k of every query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = {q: Heap(k) for q in queries}

        def finish(rows: list[dict]) -> None:
            ids = n = None
            for r in rows:
                if r["term"] is None:
                    ids, n = unz(r["data"], np.int64), unz(r["lasts"], np.int64)
            m = lengths(n, docs, total)
            lists = {r["term"]: List(r, m, docs, total) for r in rows if r["term"] is not None}
            if lists:
                for q, query in queries.items():
                    search_block(query, lists, ids, heaps[q])

        held, number = [], None
        for batch in batches:
            for r in batch.to_pylist():
                if held and r["block"] != number:
                    finish(held)
                    held = []
                number = r["block"]
                held.append(r)
        if held:
            finish(held)
        out = [(q, int(i), int(s)) for q, h in heaps.items() for s, i in zip(h.scores, h.ids)]
        columns = list(zip(*out)) if out else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["number", "doc_id", "score"])

    return run


def search(spark: SparkSession, path: str, queries: DataFrame, key: str = "item_id", text: str = "text", k: int = 10, pairs: int = PAIRS) -> DataFrame:
    """item_id, rank, doc_id, score: the best k documents of the index for every query."""
    index = spark.read.schema(INDEX).parquet(path)
    docs, total = index.agg(F.coalesce(F.sum(F.when(F.col("term").isNull(), F.col("docs"))), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    asked = queries.groupBy(F.col(f"`{key}`").alias("item_id"), F.col(f"`{text}`").alias("text")).agg(F.count(F.lit(1)).alias("copies"))
    asked = materialize(spark, asked.withColumn("number", F.monotonically_increasing_id()), "asked")
    terms = asked.select("number", F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(TERM), 0)).alias("term"))
    terms = materialize(spark, terms.groupBy("number", "term").agg(F.count(F.lit(1)).alias("times")), "asked-terms")
    passes = max(1, -(-terms.count() // pairs))
    found = None
    for p in range(passes):
        part = terms.where(F.pmod(F.xxhash64("number"), F.lit(passes)) == p)
        heaps = one_pass(index, part, docs, total, k)
        found = heaps if found is None else found.unionByName(heaps)
    best = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    each = ranked.join(asked.select("number", "item_id", "copies"), "number").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select("item_id", "rank", "doc_id", "score")


def one_pass(index: DataFrame, part: DataFrame, docs: int, total: int, k: int) -> DataFrame:
    """number, doc_id, score: the heaps of all shards for the queries of one pass."""
    needed = part.select("term").distinct()
    lists = index.join(needed, "term", "left_semi")
    known = {r.term: r for r in lists.groupBy("term").agg(F.sum("docs").alias("df"), F.max("most").alias("most"), F.min("least").alias("least")).collect()}
    weight = {t: math.floor(1000 * math.log((2 * docs + 2) / (2 * r.df + 1))) for t, r in known.items()}
    bound = {t: int(impact(r.most, 25 + 75 * r.least * docs // total)) for t, r in known.items()}
    queries: dict[int, list[tuple[str, int, int]]] = defaultdict(list)
    for r in part.collect():
        if r.term in known:
            w = weight[r.term] * r.times
            queries[r.number].append((r.term, w, w * bound[r.term]))
    for query in queries.values():
        query.sort(key=lambda x: (x[2], x[0]))
    rows = lists.unionByName(index.where("term is null")).select(*index.columns).repartition("block").sortWithinPartitions("block")
    heaps = rows.mapInArrow(shard_heaps(dict(queries), docs, total, k), "number bigint, doc_id bigint, score bigint")
    return heaps.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def index_path(spark: SparkSession) -> str:
    return work_dir(spark, "search-index")

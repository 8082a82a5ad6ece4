"""Substring deduplication by Rabin-Karp hashes of every window of words.

Map tasks hash every window of ``size`` consecutive words of their texts. Rows of a block
(about BLOCK_BYTES of text) are put in ascending id order, so of equal windows in one block the
first has the smallest id; windows of larger ids are repeats already. One entry (hash, smallest
id) per distinct window is left, however often the block repeats it. Entries are dealt into
buckets by hash, packed as arrays, one row for each block and bucket. A bucket counts its
hashes: an entry repeats if another entry of the hash has a smaller id. The answers go back by
block, where repeated windows merge into maximal removal intervals per document, and the
intervals are joined to the texts.

The 64 bits compared inside a bucket are independent of the bucket, so the chance that a window
is taken for a repeat by error is (windows of a bucket) / 2**64, about 1e-12, at any size.

A row without id counts as smaller than every id. Rows of equal id do not remove from each
other; rows equal in id and text get the same answer. Texts of fewer words than a window, empty
and null ones keep all words. Input columns named like the result's are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import NO_ID, SPACES, SPANS, append, blocks, column, cuts, longs, partitions, runs, table_column, text_bytes, unz, windows, word_hashes, words, z, covered, spans_array, mix, U64

WINDOW = 13
BLOCK_BYTES = 6 << 20
BUCKET_BYTES = 24 << 20
ROW = "bucket int, block bigint, whole boolean, a binary, b binary, c binary, d binary, e binary, f binary"
FIELDS = ["bucket", "block", "whole", "a", "b", "c", "d", "e", "f"]


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("_id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("_hash"), F.col(text).alias("text"))


def entries(size: int, buckets: int):
    """Map side: rows of ROW. Block rows (whole) hold what the last step needs: ids, text
    hashes, words of each text, windows already known as repeats, further places of entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in blocks(batches, BLOCK_BYTES):
            ids = longs(table_column(table, "_id"))
            order = np.argsort(ids, kind="stable")
            table, ids = table.take(pa.array(order)), ids[order]
            buf, off = text_bytes(table_column(table, "text"))
            hashes, counts = [], []
            for i, j in cuts(off):
                piece = buf[off[i] : off[j]]
                starts, ends, first = words(piece, off[i : j + 1] - off[i], SPACES)
                hashes.append(windows(word_hashes(piece, starts, ends), first, size)[1])
                counts.append(np.diff(first))
            h, n = np.concatenate(hashes), np.concatenate(counts)
            owner = np.repeat(ids, np.maximum(n - size + 1, 0))
            sort = np.argsort(h, kind="stable")
            hs = h[sort]
            head = np.ones(len(h), bool)
            head[1:] = hs[1:] != hs[:-1]
            group = np.cumsum(head) - 1
            lead = sort[head]
            own = owner[sort] == owner[lead][group] if len(h) else head
            known, further = sort[~own], own & ~head
            rows = [(number % buckets, number, True, z(ids), z(longs(table_column(table, "_hash"))), z(n), z(np.sort(known)), z(sort[further]), z(lead[group[further]]))]
            lead = np.sort(lead)
            bucket = (mix(h[lead] ^ U64(0x5851F42D4C957F2D)) % U64(buckets)).astype(np.int64)
            dealt = np.argsort(bucket, kind="stable")
            at = np.searchsorted(bucket[dealt], np.arange(buckets + 1))
            for b in range(buckets):
                mine = lead[dealt[at[b] : at[b + 1]]]
                if len(mine):
                    rows.append((b, number, False, h[mine].tobytes(), z(np.diff(owner[mine], prepend=0)), z(np.diff(mine, prepend=0).astype(np.uint32)), None, None, None))
            schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("whole", pa.bool_()), *[(c, pa.binary()) for c in "abcdef"]])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return run


def count_bucket(table: pa.Table) -> pa.Table:
    """Reduce side: for each block the entries (first windows) that repeat; block rows pass."""
    whole = table.column("whole").to_numpy()
    passed, rows = table.filter(pa.array(whole)), table.filter(pa.array(~whole))
    out = []
    if rows.num_rows:
        hashes = [np.frombuffer(x, np.uint64) for x in rows.column("a").to_pylist()]
        ids = np.concatenate([np.cumsum(unz(x, np.int64)) for x in rows.column("b").to_pylist()])
        h = np.concatenate(hashes)
        sort = np.argsort(h)
        hs = h[sort]
        head = np.ones(len(h), bool)
        head[1:] = hs[1:] != hs[:-1]
        heads = np.flatnonzero(head)
        least = np.minimum.reduceat(ids[sort], heads)
        repeat = np.zeros(len(h), bool)
        repeat[sort] = ids[sort] > least[np.cumsum(head) - 1]
        ends = np.cumsum([len(x) for x in hashes])
        for number, places, end, n in zip(rows.column("block").to_pylist(), rows.column("c").to_pylist(), ends, map(len, hashes)):
            mine = repeat[end - n : end]
            if mine.any():
                out.append((0, number, False, z(np.cumsum(unz(places, np.uint32).astype(np.int64))[mine]), None, None, None, None, None))
    made = pa.table([pa.array([r[i] for r in out], passed.schema.field(i).type) for i in range(len(FIELDS))], schema=passed.schema)
    return pa.concat_tables([passed, made])


def merge_block(size: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        w = next(r for r in rows if r["whole"])
        ids, hashes, n = unz(w["a"], np.int64), unz(w["b"], np.int64), unz(w["c"], np.int64)
        count = np.maximum(n - size + 1, 0)
        base = np.concatenate([[0], np.cumsum(count)])
        flags = np.zeros(base[-1], bool)
        for r in rows:
            if not r["whole"]:
                flags[unz(r["a"], np.int64)] = True
        at, of = unz(w["e"], np.int64), unz(w["f"], np.int64)
        flags[at] = flags[of]
        flags[unz(w["d"], np.int64)] = True
        first = np.concatenate([[0], np.cumsum(n)])
        doc = np.repeat(np.arange(len(n)), count)
        where = np.flatnonzero(flags)
        hit = covered(where - base[doc[where]] + first[doc[where]], size, int(first[-1]))
        starts, ends, off = runs(hit, first)
        keep = np.diff(off) > 0
        lists = spans_array(starts, ends, off).filter(pa.array(keep))
        return pa.table([pa.array(ids[keep]), pa.array(hashes[keep]), lists], names=["_id", "_hash", "spans"])

    return run


def repeated_spans(docs: DataFrame, size: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """_id, _hash, spans: the maximal intervals of words to remove, where there are any."""
    spark = docs.sparkSession
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    buckets = max(partitions(spark), -(-total // BUCKET_BYTES))
    rows = keyed(docs, key, text).mapInArrow(entries(size, buckets), ROW)
    counted = rows.groupBy("bucket").applyInArrow(count_bucket, ROW)
    merged = counted.groupBy("block").applyInArrow(merge_block(size), f"_id bigint, _hash bigint, spans {SPANS}")
    return merged.groupBy("_id", "_hash").agg(F.first("spans").alias("spans"))  # equal rows of several blocks


def with_spans(docs: DataFrame, spans: DataFrame, key: str, text: str) -> DataFrame:
    """``docs`` joined with the spans of their id and text."""
    on = [F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)) == F.col("_id"), F.coalesce(F.xxhash64(text), F.lit(0)) == F.col("_hash")]
    return docs.join(spans.withColumnRenamed("spans", "removed"), on, "left").drop("_id", "_hash")


def remove_repeats(docs: DataFrame, size: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_removed, removed (intervals of words) and kept (the words left,
    joined by one space)."""
    docs = docs.drop("n_words", "n_removed", "removed", "kept", "_id", "_hash")
    joined = with_spans(docs, repeated_spans(docs, size, key, text), key, text)

    def fn(part: pa.RecordBatch) -> list[pa.Array]:
        buf, off = text_bytes(column(part, text))
        starts, ends, first = words(buf, off, SPACES)
        gone = np.zeros(len(starts) + 1, bool)
        for d, spans in enumerate(column(part, "removed").to_pylist()):
            for s in spans or ():
                gone[first[d] + s["start"] : first[d] + s["end"]] = True
        n = np.diff(first)
        lost = np.concatenate([[0], np.cumsum(gone[:-1])])
        raw, kept = buf.tobytes(), []
        stay = np.flatnonzero(~gone[:-1])
        cut = np.searchsorted(stay, first)
        pieces = [raw[s:e] for s, e in zip(starts[stay].tolist(), ends[stay].tolist())]
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
            kept.append(b" ".join(pieces[i:j]))
        return [pa.array(n, pa.int64()), pa.array(lost[first[1:]] - lost[first[:-1]], pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]

    return append(joined, fn, [("n_words", "bigint"), ("n_removed", "bigint"), ("kept", "string")], text, more=("removed",))

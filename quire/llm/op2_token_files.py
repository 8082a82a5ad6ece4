"""Token-id files by bit-plane shuffling.

Texts are encoded in ascending id order and each document ends with an end id. Ids are written
in chunks of whole documents; a chunk cuts its ids into blocks of BLOCK_IDS, turns each block
into bit planes (or byte planes), compresses each plane with zstandard and stores the sizes in
front, so a range of ids is read from the blocks it touches.

A chunk, little-endian: ``QBP1``, planes of 1 or 8 bits (uint8), ids of a full block (uint32),
ids (uint64), blocks (uint32); for each block its planes (uint8); then the bytes of each plane
(uint32); then the planes. A plane that does not shrink is stored as it is, its size then
equals the plain one.

Chunks are rows of a Parquet table written by Spark (uncompressed, as the planes are), so it
lies in any store, and tasks that run again do no harm: part, chunk, n_ids, doc_ids, lengths,
data. The chunk index beside it has each chunk's first id over all parts.

The string of an added token in a text (``<|endoftext|>``) is that token, as the tokenizers
library has it by default; only this spelling is, ``<|ENDOFTEXT|>`` is text.

A null text is empty and has the end id only. A null id sorts first, rows of equal id are
ordered by the hash of their text, and each row is a document. An empty table writes no chunks.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import SPACES, column, cuts, text_bytes, work_dir
from quire.llm.op5_bpe import text_ids

BLOCK_IDS = 1 << 16
CHUNK_IDS = 1 << 20
SLICE_BYTES = 8 << 20
CACHE_UNITS = 1_500_000
CHUNKS = "part int, chunk int, n_ids bigint, doc_ids array<bigint>, lengths array<bigint>, data binary"
#: Stands between units; units that hold it are encoded one by one.
MARK = b"\x01"
_HEAD = struct.Struct("<4sBIQI")


# ---------------------------------------------------------------- the format


def to_planes(ids: np.ndarray, bits: int) -> list[bytes]:
    """Bit or byte planes of a block, the lowest first; as many as its greatest id needs."""
    used = int(ids.max()).bit_length() if len(ids) else 0
    if bits == 8:
        return [(ids >> np.uint32(8 * k)).astype(np.uint8).tobytes() for k in range(-(-used // 8))]
    return [np.packbits((ids >> np.uint32(k)).astype(np.uint8) & 1, bitorder="little").tobytes() for k in range(used)]


def from_planes(planes: list[bytes], n: int, bits: int) -> np.ndarray:
    ids = np.zeros(n, np.uint32)
    for k, p in enumerate(planes):
        raw = np.frombuffer(p, np.uint8)
        ids |= (raw if bits == 8 else np.unpackbits(raw, count=n, bitorder="little")).astype(np.uint32) << np.uint32(bits * k)
    return ids


def pack(ids: np.ndarray, bits: int = 1, block: int = BLOCK_IDS) -> bytes:
    press = zstandard.ZstdCompressor(level=3)
    counts, sizes, data = [], [], []
    for i in range(0, len(ids), block):
        planes = to_planes(ids[i : i + block].astype(np.uint32), bits)
        small = [min(press.compress(p), p, key=len) for p in planes]
        counts.append(len(small))
        sizes.extend(map(len, small))
        data.extend(small)
    head = _HEAD.pack(b"QBP1", bits, block, len(ids), len(counts))
    return head + bytes(counts) + np.array(sizes, "<u4").tobytes() + b"".join(data)


def unpack(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids first..last-1 of a chunk (all without them); other blocks are not decompressed."""
    magic, bits, block, total, blocks = _HEAD.unpack_from(data)
    if magic != b"QBP1":
        raise ValueError("not a chunk of token ids")
    last = total if last is None else min(last, total)
    counts = np.frombuffer(data, np.uint8, blocks, _HEAD.size).astype(np.int64)
    sizes = np.frombuffer(data, "<u4", int(counts.sum()), _HEAD.size + blocks).astype(np.int64)
    ends = np.cumsum(sizes) + _HEAD.size + blocks + 4 * len(sizes)
    at = np.concatenate([[0], np.cumsum(counts)])
    out = []
    for b in range(first // block, -(-last // block) if last > first else 0):
        n = min(block, total - b * block)
        plain = n if bits == 8 else -(-n // 8)
        planes = []
        for k in range(at[b], at[b + 1]):
            p = data[ends[k] - sizes[k] : ends[k]]
            planes.append(p if len(p) == plain else zstandard.ZstdDecompressor().decompress(p))
        out.append(from_planes(planes, n, bits)[max(0, first - b * block) : last - b * block])
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


# ---------------------------------------------------------------- encoding

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)
_KIND[97:123] = 1  # ASCII letters
_KIND[[ord(c) for c in "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"]] = 2  # signs; not the apostrophe, which letters may follow


def added_places(buf: np.ndarray, off: np.ndarray, added: re.Pattern[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the added tokens' strings in the raw texts, as the tokenizer finds them:
    from left to right, none over a text's end."""
    raw, found = buf.tobytes(), []
    at = 0
    while m := added.search(raw, at):
        end = int(off[np.searchsorted(off, m.start(), "right")])
        if m.end() > end:  # look again inside this text, then from the next one
            found += [x.span() for x in added.finditer(raw, m.start(), end)]
            at = end
        else:
            found.append(m.span())
            at = m.end()
    starts, ends = np.array(found, np.int64).reshape(-1, 2).T
    return starts, ends


def word_units(buf: np.ndarray, off: np.ndarray, added: re.Pattern[bytes] | None = None) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Number of each unit, the distinct units, and each text's first unit, for a tokenizer that
    lowers case, drops white space and parts letters from signs: words without white space, in
    lower case as far as ASCII, cut between ASCII letters and signs. ``added``: the strings of
    added tokens, each a unit as it stands."""
    b, n = _LOWER[buf], len(buf)
    inside = ~SPACES[b]
    starts_added, ends_added = added_places(buf, off, added) if added is not None else (np.zeros(0, np.int64),) * 2
    whole = np.zeros(n, bool)
    for s, e in zip(starts_added.tolist(), ends_added.tolist()):
        whole[s:e], b[s:e] = True, buf[s:e]
    inside |= whole
    kind = _KIND[b]
    start = np.ones(n, bool)
    start[1:] = ~inside[:-1] | (kind[1:] + kind[:-1] == 3)  # a letter beside a sign, or white space before
    start[off[off < n]] = True
    start[whole] = False
    start[starts_added] = True
    start[ends_added[ends_added < n]] = True
    start &= inside
    place = np.concatenate([[0], np.cumsum(inside)])
    starts = place[:-1][start]
    kept = np.ascontiguousarray(b[inside])
    offsets = np.append(starts, len(kept)).astype(np.int64)
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)]).dictionary_encode()
    return found.indices.to_numpy(), found.dictionary, np.searchsorted(starts, place[off])


class Units:
    """Encodes distinct units with the tokenizers library and remembers them while the worker
    lives, CACHE_UNITS at most; then it starts anew."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        strings = sorted((t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, strings))) if strings else None
        (self.mark,) = self.tokenizer.encode(MARK.decode(), add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids, self.first, self.held = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], 0

    def encode(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.number) + len(units) > CACHE_UNITS:
            self.clear()
        new = [u for u in units if u not in self.number]
        for i in range(0, len(new), 4096):
            some = new[i : i + 4096]
            ids, first = self._ids(some)
            self.number.update(zip(some, range(len(self.number), len(self.number) + len(some))))
            self.ids.append(ids)
            self.first.append(self.held + first[1:])
            self.held += len(ids)
        self.ids, self.first = [np.concatenate(self.ids)], [np.concatenate(self.first)]
        which = np.array([self.number[u] for u in units], np.int64)
        first = self.first[0]
        size = np.diff(first)[which]
        start = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(start[-1]) + np.repeat(first[which] - start[:-1], size)
        return self.ids[0][at], start


    def _ids(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all units, and where each unit's begin. Units are encoded as one text with
        a mark between them; the mark is a word of its own with one token."""
        if any(MARK in u for u in units):
            found = [e.ids for e in self.tokenizer.encode_batch_fast([u.decode() for u in units], add_special_tokens=False)]
            return np.array([y for x in found for y in x], np.int32), np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
        text = b"".join(u + b" " + MARK + b" " for u in units).decode()
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
        marks = ids == self.mark
        places = np.flatnonzero(marks)
        return ids[~marks], np.concatenate([[0], places - np.arange(len(places))]).astype(np.int64)


@lru_cache(1)
def units_of(path: str) -> Units:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Units(path)


def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1, bits: int = 1, key: str = "doc_id", text: str = "text") -> None:
    """Writes chunks below path/chunks and their index below path/index. The tokenizer's file
    must be at the same place on every executor."""
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("_id"), F.xxhash64(text).alias("_hash"), F.col(text).alias("text"))
    rows = rows.repartitionByRange("_id", "_hash").sortWithinPartitions("_id", "_hash").select("_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        lengths: list[int] = []

        def chunk() -> pa.RecordBatch:
            all_ids = np.concatenate(ids)
            row = [[part], [number], [len(all_ids)], [names], [lengths], [pack(all_ids, bits)]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types)], ["part", "chunk", "n_ids", "doc_ids", "lengths", "data"])

        for batch in batches:
            buf, off = text_bytes(column(batch, "text"))
            doc_ids = column(batch, "_id").to_pylist()
            for i, j in cuts(off, SLICE_BYTES):
                units = units_of(tokenizer)
                tokens, first = text_ids(buf[off[i] : off[j]], off[i : j + 1] - off[i], units.encode, partial(word_units, added=units.added))
                size = np.diff(first) + 1
                ended = np.full(size.sum(), end_id, np.int32)
                ended[np.arange(len(tokens)) + np.repeat(np.arange(j - i), size - 1)] = tokens
                at = np.concatenate([[0], np.cumsum(size)])
                k = 0
                while k < j - i:  # close a chunk after the document that fills it
                    room = CHUNK_IDS - sum(lengths)
                    m = min(j - i, int(np.searchsorted(at, at[k] + max(1, room))))
                    ids.append(ended[at[k] : at[m]])
                    names.extend(doc_ids[i + k : i + m])
                    lengths.extend(size[k:m].tolist())
                    if sum(lengths) >= CHUNK_IDS:
                        yield chunk()
                        ids, names, lengths, number = [], [], [], number + 1
                    k = m
        if names:
            yield chunk()

    rows.mapInArrow(run, CHUNKS).write.option("compression", "uncompressed").parquet(f"{path}/chunks")
    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/chunks").select("part", "chunk", "n_ids", F.size("doc_ids").alias("n_docs"))
    # ids of earlier parts: a few rows, one for each part; then within each part
    parts = chunks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    index = chunks.join(parts, "part").select("part", "chunk", (F.col("before") + inside).alias("first_id"), "n_ids", "n_docs")
    index.write.parquet(f"{path}/index")


def read_documents(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids before it), n_tokens, ids_crc32 and, if wanted, ids of each document."""
    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/chunks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["data"]).astype("<u4")
                n = np.array(row["lengths"], np.int64)
                end = np.cumsum(n)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * (e - m) : 4 * e]) for e, m in zip(end.tolist(), n.tolist())]
                made = [pa.array(np.full(len(n), row["part"], np.int32)), pa.array(np.full(len(n), row["chunk"], np.int32)), pa.array(row["doc_ids"], pa.int64()), pa.array(end - n), pa.array(n), pa.array(crc, pa.int64())]
                if with_ids:
                    made.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], end]), pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(made, [f"c{i}" for i in range(len(made))])

    schema = "part int, chunk int, doc_id bigint, place bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(batches):
            yield b.rename_columns(names)

    found = chunks.mapInArrow(named, schema)
    index = spark.read.schema("part int, chunk int, first_id bigint").parquet(f"{path}/index")
    out = found.join(index, ["part", "chunk"]).withColumn("start", F.col("first_id") + F.col("place"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def files_path(spark: SparkSession) -> str:
    return work_dir(spark, "token-ids")

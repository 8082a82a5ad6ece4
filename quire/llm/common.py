"""Helpers the operators share: Arrow text batches, words and rolling hashes in numpy.

Texts are handled as UTF-8 bytes in one buffer with offsets, null texts as empty ones. A
batch is cut into slices of about SLICE_BYTES (one longer text is a slice of its own), so
memory follows the longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.sources.tables import materialize, work_dir  # noqa: F401

SLICE_BYTES = 1 << 20
NO_ID = -(1 << 63)
U64 = np.uint64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- Arrow


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a string or binary column, and where each begins."""
    if not len(column) or column.null_count == len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_string() if "string" in str(column.type) else pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def sizes(column: pa.Array) -> np.ndarray:
    """Where each value begins: bytes of texts, entries of lists."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        return np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy())]).astype(np.int64)
    return text_bytes(column)[1]


def cuts(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with up to ``limit`` bytes, or one row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def append(df: DataFrame, fn: Callable[[pa.RecordBatch], list[pa.Array]], fields: list[tuple[str, str]], text: str = "text", limit: int = SLICE_BYTES, more: Sequence[str] = ()) -> DataFrame:
    """``df`` with further columns that ``fn`` makes of each slice of rows. Only ``text``, by
    which slices are measured, and the columns of ``more`` go to Python, and only the new ones
    come back; all others stay in the JVM. Columns of ``df`` with the same names are replaced."""
    kind = T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in fields])
    needed, held = [text, *more], "__made"
    while held in df.columns:
        held += "_"

    @F.arrow_udf(kind)
    def made(*columns: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays(list(columns), needed)
        parts = []
        for i, j in cuts(sizes(columns[0]), limit):
            parts.append(pa.StructArray.from_arrays(fn(batch.slice(i, j - i)), names=kind.names))
        pa.default_memory_pool().release_unused()
        return pa.concat_arrays(parts)

    out = df.withColumn(held, made(*[F.col(f"`{c}`") for c in needed]))
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in kind.names], *[F.col(held)[n].alias(n) for n in kind.names])


def blocks(batches: Iterator[pa.RecordBatch], limit: int, text: str = "text") -> Iterator[tuple[int, pa.Table]]:
    """The rows of a task in blocks of about ``limit`` bytes of text, each with a number that
    is unique in the stage and the same when the task runs again."""
    from pyspark import TaskContext

    number, held, size = TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        _, off = text_bytes(column(batch, text))
        for i, j in cuts(off, limit):
            if held and size + int(off[j] - off[i]) > limit:
                yield number, pa.Table.from_batches(held).combine_chunks()
                number, held, size = number + 1, [], 0
            held.append(batch.slice(i, j - i))
            size += int(off[j] - off[i])
    if held:
        yield number, pa.Table.from_batches(held).combine_chunks()


def table_column(table: pa.Table, name: str) -> pa.Array:
    col = table.column(name).combine_chunks()
    return col.chunk(0) if isinstance(col, pa.ChunkedArray) else col


def longs(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column, NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def z(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def unz(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype)


def lists(values: pa.Array, off: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), values)


def spans_array(starts: np.ndarray, ends: np.ndarray, off: np.ndarray) -> pa.ListArray:
    values = pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["start", "end"])
    return lists(values, off)


SPANS = "array<struct<start:bigint,end:bigint>>"


# ---------------------------------------------------------------- rolling hashes

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: One random number for each byte.
BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
BYTE_LOWER = BYTE.copy()
BYTE_LOWER[65:91] = BYTE[97:123]
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, U64)
        while len(have) < n:
            have = np.concatenate([have, have * U64(pow(base, len(have), 1 << 64))])
        if n <= 2 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def rolled(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[start:end], the same wherever the values stand."""
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(len(values)), out=sums[1:])
    return (sums[ends] - sums[starts]) * powers(len(values) + 1, _INVERSE)[starts]


def table_of(separators: list[int]) -> np.ndarray:
    sep = np.zeros(256, bool)
    sep[separators] = True
    return sep


#: Bytes between words: white space; or all ASCII but digits and letters.
SPACES = table_of([0x20, *range(0x09, 0x0E)])
NOT_ALNUM = table_of([c for c in range(128) if not chr(c).isalnum()])


def words(buf: np.ndarray, off: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and each text's first word (one more entry at the end)."""
    inside = ~separators[buf]
    n = len(buf)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = off[(off > 0) & (off < n)]
    before[edges], after[edges - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    return mix(rolled((BYTE_LOWER if lower else BYTE)[buf], starts, ends) + (ends - starts).astype(U64))


def windows(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every run of ``size`` words of one text."""
    last = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(len(hashes)) + size <= last)
    return at, mix(rolled(hashes, at, at + size))


def runs(flags: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true flags inside each part off[i]:off[i+1]: start and end relative to
    the part, and where each part's runs begin."""
    n = len(flags)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = flags[:-1], flags[1:]
    edges = off[(off > 0) & (off < n)]
    before[edges], after[edges - 1] = False, False
    starts, ends = np.flatnonzero(flags & ~before), np.flatnonzero(flags & ~after) + 1
    where = np.searchsorted(starts, off)
    base = np.repeat(off[:-1], np.diff(where))
    return starts - base, ends - base, where


def covered(at: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n places lie in a window of ``size`` that begins at one of ``at``."""
    edge = np.bincount(at, minlength=n + 1)[: n + 1].astype(np.int64)
    edge -= np.bincount(np.minimum(at + size, n), minlength=n + 1)[: n + 1]
    return np.cumsum(edge[:n]) > 0

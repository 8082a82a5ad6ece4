"""Document fingerprints by randomised edit embedding.

All texts walk by the same random rules: step j reads the character under the pointer, puts out
a random bit of (j, character), and moves on or stays by another random bit of the two. Two
texts walk alike until an edit and, after one, soon fall into step again, so that few edits
mean few differing outputs: edit distance becomes Hamming distance. A walk takes about two
steps a character and goes through the whole text.

The fingerprint samples the walk's bits evenly at every scale: all of the first 64 steps, and
64 steps of each following stretch, each as long as all before it. It is the number of steps
(in units of 64, hexadecimal), a colon, and 16 hexadecimal digits a stretch. Likeness weighs
stretches by length, so a text's end counts like its beginning: the share of steps at which
two walks agree beyond chance, 0 to 1; steps beyond the shorter walk's end disagree.

near_pairs finds likely pairs by banding (32 bands of 16 bits sampled from the longest stretch
that is full, and those before it) and verifies them by likeness. No registered query uses it.

A null text is an empty one: no steps, fingerprint ``0:``, likeness 1 to another empty text
and 0 to others. The next document is the next in ascending id order, null ids first, rows of
equal id ordered by the hash of their text; the last one's next is the first, a single
document's next is itself. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import SLICE_BYTES, U64, column, cuts, materialize, text_bytes

CLASSES = 251
END = 255
PERIOD = 4096
STRETCHES = 40
_rng = np.random.Generator(np.random.PCG64(4242))
#: For each step and character: bit 0 moves on, bit 1 is put out; nothing after the end.
RULES = _rng.integers(0, 4, (PERIOD, 256), dtype=np.uint8)
RULES[:, END] = 0
MOVES = RULES & 1
WALK_BYTES = 8 << 20


def stretch(k: int) -> tuple[int, int]:
    return (0, 64) if k == 0 else (64 << (k - 1), 64 << k)


def samples(k: int) -> np.ndarray:
    """The sampled steps of a stretch, one of each 64th part of it."""
    low, high = stretch(k)
    part = (high - low) // 64
    return low + np.arange(64) * part + np.random.Generator(np.random.PCG64(1000 + k)).integers(0, part, 64)


SAMPLES = [samples(k) for k in range(STRETCHES)]


def walks(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Units of 64 steps, and sampled bits by stretch, of each text."""
    size = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    start = np.cumsum(size + 1) - size - 1
    buf = np.full(int((size + 1).sum()), END, np.uint8)
    buf[np.arange(len(points)) + np.repeat(np.arange(len(texts)), size)] = (points % CLASSES).astype(np.uint8)
    bits = np.zeros((len(texts), STRETCHES), U64)
    units = np.zeros(len(texts), np.int64)
    lane = np.flatnonzero(size)
    at = start[lane]
    block = 0
    while len(lane):
        low = block * 64
        k = 0 if block == 0 else block.bit_length()
        first, last = np.searchsorted(SAMPLES[k], [low, low + 64])
        wanted = {int(j): i for i, j in zip(range(first, last), SAMPLES[k][first:last])}
        for j in range(low, low + 64):
            read = buf[at]
            if j in wanted:
                rule = RULES[j % PERIOD][read]
                bits[lane, k] |= (rule >> 1).astype(U64) << U64(wanted[j])
                at += rule & 1
            else:
                at += MOVES[j % PERIOD][read]
        block += 1
        going = buf[at] != END
        if not going.all():
            units[lane[~going]] = block
            lane, at = lane[going], at[going]
    return units, bits


def _agree(units_a: np.ndarray, a: np.ndarray, units_b: np.ndarray, b: np.ndarray) -> np.ndarray:
    least, most = 64 * np.minimum(units_a, units_b), 64 * np.maximum(units_a, units_b)
    same, total = np.zeros(len(least)), np.zeros(len(least))
    for k in range(STRETCHES):
        low, high = stretch(k)
        if not len(most) or low >= most.max():
            break
        weight = np.clip(least - low, 0, high - low)
        count = np.searchsorted(SAMPLES[k], least)
        mask = np.where(count >= 64, ~U64(0), (U64(1) << np.minimum(count, 63).astype(U64)) - U64(1))
        differ = np.bitwise_count((a[:, k] ^ b[:, k]) & mask)
        same += np.where(count > 0, weight * (1 - differ / np.maximum(count, 1)), 0.0)
        total += np.where(count > 0, weight, 0)
    share = np.divide(same, total, out=np.ones(len(same)), where=total > 0)
    return np.where(most == 0, 1.0, np.clip(2 * share - 1, 0, 1) * least / np.maximum(most, 1))


def write(units: np.ndarray, bits: np.ndarray) -> list[str]:
    out = []
    for n, row in zip(units.tolist(), bits):
        count = 0 if n == 0 else (n - 1).bit_length() + 1
        out.append(f"{n:x}:" + row[:count].astype(">u8").tobytes().hex())
    return out


def read(fingerprints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    units, bits = np.zeros(len(fingerprints), np.int64), np.zeros((len(fingerprints), STRETCHES), U64)
    for i, f in enumerate(fingerprints):
        n, _, rest = f.partition(":")
        row = np.frombuffer(bytes.fromhex(rest), ">u8")
        units[i], bits[i, : len(row)] = int(n, 16), row
    return units, bits


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """Likeness of fingerprints pair by pair."""
    return _agree(*read(a), *read(b))


def edited(text: str, following: str) -> str:
    """The last half of the characters replaced by the first ones of the following text."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


# ---------------------------------------------------------------- Spark

RESULT = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NAMES = [x.split()[0] for x in RESULT.split(", ")]


def results(texts: list[str]) -> list[pa.Array]:
    """The columns of RESULT for all texts but the last, each with the one after it."""
    changed = [edited(a, b) for a, b in zip(texts[:-1], texts[1:])]
    units, bits = walks(texts)
    units2, bits2 = walks(changed)
    return [
        pa.array([len(t) for t in texts[:-1]], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
        pa.array(write(units[:-1], bits[:-1])),
        pa.array(write(units2, bits2)),
        pa.array(_agree(units[:-1], bits[:-1], units2, bits2)),
        pa.array(_agree(units[:-1], bits[:-1], units[1:], bits[1:])),
    ]


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, RESULT: each document's fingerprint, that of its edited text, and their likeness.

    Tasks take ranges of the id order and stream through them. A task's first text and last
    document are written out; the few documents that end a range meet their next one in a
    second small step.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("_id"), F.xxhash64(text).alias("_hash"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("_id", "_hash").sortWithinPartitions("_id", "_hash").select("_id", "text")
    schema = f"_id bigint, {RESULT}, part int, edge int, text string"
    names = ["_id", *NAMES, "part", "edge", "text"]

    def edge(part: int, kind: int, doc_id, body: str) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([doc_id, *[None] * 6, part, kind, body], types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), None
        for batch in batches:
            _, off = text_bytes(column(batch, "text"))
            for i, j in cuts(off, WALK_BYTES):
                ids, texts = column(batch, "_id")[i:j].to_pylist(), column(batch, "text")[i:j].to_pylist()
                if held is None:
                    yield edge(part, 1, ids[0], texts[0])
                else:
                    ids, texts = [held[0], *ids], [held[1], *texts]
                held = (ids[-1], texts[-1])
                if len(ids) > 1:
                    made = results(texts)
                    n = len(ids) - 1
                    yield pa.RecordBatch.from_arrays([pa.array(ids[:-1], pa.int64()), *made, pa.array(np.full(n, part, np.int32)), pa.array(np.zeros(n, np.int32)), pa.nulls(n, pa.string())], names)
        if held is not None:
            yield edge(part, 2, *held)

    found = materialize(spark, rows.mapInArrow(run, schema), "fingerprints")
    parts = sorted(r.part for r in found.where("edge = 1").select("part").collect())  # one for each task
    order = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, following int")
    ends = found.where("edge = 2").select("_id", "part", F.col("text").alias("x")).join(order, "part")
    ends = ends.join(found.where("edge = 1").select(F.col("part").alias("following"), F.col("text").alias("y")), "following").select("_id", "x", "y")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x, y in zip(*(column(batch, c).to_pylist() for c in ("_id", "x", "y"))):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), *results([x, y])], ["_id", *NAMES])

    rest = ends.mapInArrow(finish, f"_id bigint, {RESULT}")
    return found.where("edge = 0").select("_id", *NAMES).union(rest).withColumnRenamed("_id", key)


#: For each band the sampled bits: how many stretches before the longest common one, which bit.
BANDS, BAND_BITS, BLOCK_ROWS = 32, 16, 512
_pick = np.random.Generator(np.random.PCG64(77))
BAND_STRETCH = _pick.choice(4, (BANDS, BAND_BITS), p=[0.5, 0.25, 0.125, 0.125])
BAND_BIT = _pick.integers(0, 64, (BANDS, BAND_BITS))


def band_values(units: np.ndarray, bits: np.ndarray) -> list[list[int]]:
    """The bands of each text: BANDS for its longest full stretch and as many for the one
    before, so that texts on either side of a power of two have one in common."""
    full = np.frexp(np.maximum(units, 1).astype(float))[1].astype(np.int64) - 1
    out = []
    for top in (full, full - 1):
        for k in range(BANDS):
            value = (np.maximum(top, 0) * BANDS + k).astype(U64)
            for d, bit in zip(BAND_STRETCH[k], BAND_BIT[k]):
                of = np.maximum(top - d, 0)
                value = value << U64(1) | ((bits[np.arange(len(units)), of] >> U64(bit)) & U64(1))
            out.append(value.astype(np.int64))
    table = np.stack(out, axis=1)
    return [[] if n == 0 else row[: BANDS * (1 + (n > 1))].tolist() for n, row in zip(units.tolist(), table)]


def near_pairs(fingerprints: DataFrame, least: float = 0.8, key: str = "doc_id") -> DataFrame:
    """a, b, likeness: pairs a < b of likeness ``least`` and more that share a band, documents of
    equal fingerprints by their smallest id. Members of a band are paired in blocks of
    BLOCK_ROWS. ``fingerprints``: key, fingerprint."""

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = band_values(*read(column(batch, "fingerprint").to_pylist()))
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(values, pa.list_(pa.int64()))], ["id", "bands"])

    rows = fingerprints.select(F.col(key).alias("id"), "fingerprint")
    texts = rows.groupBy("fingerprint").agg(F.min("id").alias("id")).select("id", "fingerprint")
    posted = texts.mapInArrow(band, "id bigint, bands array<bigint>").select("id", F.explode("bands").alias("band"))
    posted = materialize(fingerprints.sparkSession, posted, "bands")
    blocks = F.ceil(F.col("n") / BLOCK_ROWS).cast("long")
    several = posted.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band", blocks.alias("blocks"))
    rows = posted.join(several, "band").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    left = rows.select("band", F.col("own").alias("p"), F.col("other").alias("q"), F.col("id").alias("a"))
    right = rows.select("band", F.col("other").alias("p"), F.col("own").alias("q"), F.col("id").alias("b"))
    pairs = left.join(right, ["band", "p", "q"]).where("a < b").select("a", "b").distinct()
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("fingerprint").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("fingerprint").alias("y")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = likeness(column(batch, "x").to_pylist(), column(batch, "y").to_pylist())
            yield pa.RecordBatch.from_arrays([column(batch, "a"), column(batch, "b"), pa.array(value)], ["a", "b", "likeness"]).filter(pa.array(value >= least))

    return both.select("a", "b", "x", "y").mapInArrow(verify, "a bigint, b bigint, likeness double")

"""Sharding by histogram sort, law ``bytes``, with DataFrame operations only.

The sort key of a row is (id, hash of the text). Splitters between the shards are found by
probing: each round cuts every splitter's interval of ids into cells, counts the exact bytes in
all cells across all partitions, and keeps the cell where the goal k/n of all bytes falls. It
ends when the bytes below a boundary meet the goal within ``tolerance`` bytes, or when one key
is left; an id of several texts is then probed by the text's hash. A splitter belongs to the
lower shard, so a row is in shard floor(bytes before it * n / all bytes), up to the tolerance.

Only (id, hash, size) is read again and again, from a written table. The rows are exchanged
once, by shard and bucket, sorted by key inside the bucket and written. Buckets are ranges of
the key: a shard of more than BUCKET_ROWS rows is cut into cells, a cell of more into cells
again, until only rows of one key are left together. The slot is the row's number in its
bucket plus the rows of the shard's earlier buckets, which is its rank in the shard at any
size, and no task holds a whole shard of different keys.

A null text has size 1 and stays null, a null id sorts first. Rows equal in id and text have
equal keys and stay in one shard. Empty tables write no rows. Input columns named like the
result's are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import NO_ID, materialize, work_dir

CELLS = 256
BUCKET_ROWS = 8192
TOP = (1 << 63) - 1


@dataclass
class Probe:
    """The interval low..high of one splitter; bytes below low and in it."""

    goal: int
    low: int
    high: int
    below: int
    inside: int
    id: int | None = None  # set while the hash is probed
    done: bool = False


def sort_key(df: DataFrame, key: str, text: str) -> list[Column]:
    return [F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("k1"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("k2")]


def cell_of(value: Column, low: Column, width: Column) -> Column:
    """(value - low) div width, exact over all 64-bit numbers."""
    wide = "decimal(20,0)"
    return F.call_function("div", value.cast(wide) - low.cast(wide), width.cast(wide))


def _count_cells(keys: DataFrame, column: str, probes: list[Probe]) -> dict[tuple, list]:
    """Bytes, rows and distinct keys in the cells of each interval; at most CELLS rows each."""
    cell: Column = F.lit(None).cast("struct<id:bigint,low:bigint,high:bigint,cell:bigint>")
    for p in {(p.id, p.low, p.high): p for p in probes}.values():
        width = -(-(p.high - p.low + 1) // CELLS)
        at = F.col(column) - F.lit(p.low) if width == 1 else cell_of(F.col(column), F.lit(p.low), F.lit(width))
        within = F.col(column).between(p.low, p.high) & (F.lit(True) if p.id is None else F.col("k1") == p.id)
        cell = F.when(within, F.struct(F.lit(p.id).cast("long").alias("id"), F.lit(p.low).alias("low"), F.lit(p.high).alias("high"), at.alias("cell"))).otherwise(cell)
    found: dict[tuple, list] = {}
    counts = keys.select(cell.alias("c"), "k1", "k2", "size").where("c is not null").groupBy("c").agg(F.sum("size").alias("size"), F.min("k2").alias("a"), F.max("k2").alias("b"))
    for r in counts.collect():
        found.setdefault((r.c.id, r.c.low, r.c.high), []).append((r.c.cell, r.size, r.a == r.b))
    return found


def splitters(keys: DataFrame, shards: int, tolerance: int = 0) -> list[tuple[int, int]]:
    """The greatest (k1, k2) of shard 0, 1, .. n-2. ``keys``: k1, k2, size."""
    t = keys.agg(F.sum("size"), F.min("k1"), F.max("k1")).first()
    if t[0] is None:
        return []
    total, low, high = t
    probes = [Probe(-(-k * total // shards), low, high, 0, total) for k in range(1, shards)]
    out: list[tuple[int, int] | None] = [None] * len(probes)
    for level, column in enumerate(("k1", "k2")):
        while open_ := [p for p in probes if not p.done and (p.id is None) == (level == 0)]:
            counts = _count_cells(keys, column, open_)
            for i, p in enumerate(probes):
                if p not in open_:
                    continue
                width = -(-(p.high - p.low + 1) // CELLS)
                below = p.below
                for cell, size, single in sorted(counts[(p.id, p.low, p.high)]):
                    if below + size >= p.goal:
                        break
                    below += size
                low = p.low + cell * width
                high = min(p.high, low + width - 1)
                if below and p.goal - below <= tolerance:  # the boundary below the cell will do
                    out[i], p.done = (low - 1, TOP) if level == 0 else (p.id, low - 1), True
                elif below + size - p.goal <= tolerance and tolerance:
                    out[i], p.done = (high, TOP) if level == 0 else (p.id, high), True
                elif width > 1:
                    p.low, p.high, p.below, p.inside = low, high, below, size
                elif level == 0 and not single:  # several texts of one id
                    p.id, p.low, p.high, p.below, p.inside = low, -(1 << 63), TOP, below, size
                else:
                    out[i], p.done = (low, TOP) if level == 0 else (p.id, low), True
    return [x for x in out if x is not None]


def shard_of(k1: Column, k2: Column, cuts: list[tuple[int, int]]) -> Column:
    shard = F.lit(0)
    for a, b in cuts:
        shard = shard + ((k1 > a) | ((k1 == a) & (k2 > b))).cast("int")
    return shard


def in_buckets(rows: DataFrame, cuts: list[tuple[int, int]], levels: list[DataFrame]) -> DataFrame:
    """``rows`` with shard and bucket: the row's cell at each level, so that buckets of a shard
    ascend like their keys."""
    rows = rows.withColumn("shard", shard_of(F.col("k1"), F.col("k2"), cuts))
    rows = rows.withColumn("bucket", F.array(F.col("shard").cast("bigint")))  # a constant would cost a second exchange
    for level in levels:
        rows = rows.join(level, ["shard", "bucket"], "left")
        value = F.when(F.col("of_hash"), F.col("k2")).otherwise(F.col("k1"))
        deeper = F.concat("bucket", F.array(cell_of(value, F.col("cell_low"), F.col("cell_width"))))
        rows = rows.withColumn("bucket", F.when(F.col("cell_width").isNotNull(), deeper).otherwise(F.col("bucket"))).drop("of_hash", "cell_low", "cell_width")
    return rows


def bucket_levels(keys: DataFrame, cuts: list[tuple[int, int]]) -> tuple[list[DataFrame], DataFrame]:
    """For each level the buckets to cut into CELLS cells, by id or else by hash, until none has
    more than BUCKET_ROWS rows or each that has is one key; and the rows (n) of all buckets."""
    levels: list[DataFrame] = []
    while True:
        ends = [F.min("k1").alias("low1"), F.max("k1").alias("high1"), F.min("k2").alias("low2"), F.max("k2").alias("high2")]
        rows = materialize(keys.sparkSession, in_buckets(keys, cuts, levels).groupBy("shard", "bucket").agg(F.count("*").alias("n"), *ends), "shard-buckets")
        one = F.col("low1") == F.col("high1")
        large = rows.where((F.col("n") > BUCKET_ROWS) & ~(one & (F.col("low2") == F.col("high2"))))
        if large.isEmpty():
            return levels, rows
        low, high = F.when(one, F.col("low2")).otherwise(F.col("low1")), F.when(one, F.col("high2")).otherwise(F.col("high1"))
        levels.append(large.select("shard", "bucket", one.alias("of_hash"), low.alias("cell_low"), (cell_of(high, low, F.lit(CELLS)) + 1).alias("cell_width")))


def write_shards(docs: DataFrame, path: str, shards: int = 8, key: str = "doc_id", text: str = "text", tolerance: int = 0) -> DataFrame:
    """Writes ``docs`` with size, law, shard and slot below ``path``, one folder a shard, and
    reads them back."""
    spark: SparkSession = docs.sparkSession
    docs = docs.drop("size", "law", "shard", "slot", "k1", "k2", "bucket", "before", "place", "of_hash", "cell_low", "cell_width")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    keys = materialize(spark, docs.select(*sort_key(docs, key, text), size.alias("size")), "shard-keys")
    cuts = splitters(keys, shards, tolerance)
    levels, rows = bucket_levels(keys, cuts)
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.select("shard", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    out = in_buckets(docs.select("*", *sort_key(docs, key, text), size.alias("size")), cuts, levels).repartition("shard", "bucket")
    out = out.withColumn("place", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("k1", "k2")))
    out = out.join(before, ["shard", "bucket"], "left")
    out = out.withColumns({"slot": F.col("before") + F.col("place") - 1, "law": F.lit("bytes")}).drop("k1", "k2", "bucket", "before", "place")
    schema = out.schema
    out.write.partitionBy("shard").parquet(path)
    return spark.read.schema(schema).parquet(path)


def shard_path(spark: SparkSession) -> str:
    return work_dir(spark, "shards")

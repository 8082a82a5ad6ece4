"""Exact ordered operations that never gather one group into one task.

A plain ``Window.partitionBy(book)`` sends a whole book to one task. When one
book holds a third of all rows that task never ends. The functions here split
each group into buckets of neighbouring order keys, do the window inside a
bucket, and carry the result across buckets through a table with one row per
(group, bucket).

Two ways to place buckets:

- ``width``: the order key divided by it. For dense keys (row ids, page or chapter numbers): a
  bucket holds at most ``width`` rows, and one exchange places them.
- ``RANGES``: rows are dealt by sampled ranges of (group, order) and written, a bucket is what one
  range has of a group. For keys of any type and spread (64-bit hashes, times, paths of a tree):
  the carry table has at most one row for each range and each group.

Groups may be null, also in part: rows meet on a struct of the group's columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.sources.tables import materialize

# rows of a bucket may carry texts, so a bucket has to fit one task with room to spare
WIDTH = 8192
RANGES = None
PART_ROWS = 200
PART_BYTES = 16 << 20
BUCKET, GROUP = "__bucket", "__group"


def _bucketed(df: DataFrame, group: Sequence[str], order: str, width: int | None) -> DataFrame:
    """``df`` with its bucket and its group as one value that is never null."""
    keyed = df.withColumn(GROUP, F.struct(*[F.col(f"`{g}`") for g in group]))
    if width is not None:
        return keyed.withColumn(BUCKET, F.expr(f"`{order}` div {width}"))
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written, so that all branches see the same sampled ranges
    placed = keyed.repartitionByRange(n, GROUP, F.col(f"`{order}`")).withColumn(BUCKET, F.spark_partition_id())
    return materialize(spark, placed, "ranges")


def _attach(df: DataFrame, edges: DataFrame) -> DataFrame:
    """Join bucket rows back; a sort-merge join leaves the rows placed for the window."""
    return df.join(edges, [GROUP, BUCKET], "left")


FUNCTIONS = {"sum": F.sum, "max": F.max, "min": F.min}


def _with_values(df: DataFrame, aggs: dict[str, tuple[str, Column | str]]) -> DataFrame:
    values = {f"__v_{out}": c if isinstance(c, Column) else F.col(c) for out, (_, c) in aggs.items()}
    return df.withColumns(values)


def _bucket_totals(src: DataFrame, aggs: dict[str, tuple[str, Column | str]]) -> DataFrame:
    """One row per (group, bucket); combines map-side."""
    return src.groupBy(GROUP, BUCKET).agg(*[FUNCTIONS[kind](f"__v_{out}").alias(f"__t_{out}") for out, (kind, _) in aggs.items()])


def with_running(
    df: DataFrame,
    group: Sequence[str],
    order: str,
    aggs: dict[str, tuple[str, Column | str]],
    width: int | None = WIDTH,
    totals_of: DataFrame | None = None,
) -> DataFrame:
    """Add inclusive running aggregates over ``order`` inside ``group``.

    ``aggs`` maps an output name to ("sum" | "max", column). Nulls are skipped.
    ``totals_of`` may name a cheaper table with the same rows and the columns used here (not for RANGES).
    """
    fn = FUNCTIONS
    src = _with_values(_bucketed(df, group, order, width), aggs)
    cheaper = totals_of if width is not None else None
    totals = _bucket_totals(_with_values(_bucketed(cheaper, group, order, width), aggs) if cheaper is not None else src, aggs)
    before = Window.partitionBy(GROUP).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    edges = totals.select(
        GROUP,
        BUCKET,
        *[fn[kind](f"__t_{out}").over(before).alias(f"__b_{out}") for out, (kind, _) in aggs.items()],
    )
    inside = Window.partitionBy(GROUP, BUCKET).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    placed = _attach(src, edges).select(
        *[c for c in df.columns if c not in aggs],
        *[fn[kind](f"__v_{out}").over(inside).alias(f"__l_{out}") for out, (kind, _) in aggs.items()],
        *[f"__b_{out}" for out in aggs],
    )

    def combined(out: str, kind: str) -> Column:
        local, base = F.col(f"__l_{out}"), F.col(f"__b_{out}")
        if kind == "max":
            return F.greatest(local, base)
        return F.coalesce(local + base, local, base)

    return placed.select(
        *[c for c in df.columns if c not in aggs],
        *[combined(out, kind).alias(out) for out, (kind, _) in aggs.items()],
    )


def with_rank(df: DataFrame, group: Sequence[str], order: str, out: str, width: int | None = WIDTH) -> DataFrame:
    """Add the 1-based position of each row inside its group (``order`` is unique there)."""
    return with_running(df, group, order, {out: ("sum", F.lit(1))}, width)


def with_neighbors(
    df: DataFrame,
    group: Sequence[str],
    order: str,
    prev: dict[str, str] | None = None,
    next: dict[str, str] | None = None,
    width: int | None = WIDTH,
) -> DataFrame:
    """Add values of the row before (``prev``) and after (``next``), as {output: column}."""
    prev, next = prev or {}, next or {}
    src = _bucketed(df, group, order, width)
    cols = sorted({*prev.values(), *next.values()})
    # a struct, so that "no neighbour" (null struct) differs from "neighbour holds null"
    ends = src.groupBy(GROUP, BUCKET).agg(
        F.max_by(F.struct(*cols), F.col(order)).alias("__last"),
        F.min_by(F.struct(*cols), F.col(order)).alias("__first"),
    )
    across = Window.partitionBy(GROUP).orderBy(BUCKET)
    edges = ends.select(
        GROUP,
        BUCKET,
        F.lag("__last").over(across).alias("__before"),
        F.lead("__first").over(across).alias("__after"),
    )
    inside = Window.partitionBy(GROUP, BUCKET).orderBy(order)
    joined = (
        _attach(src, edges)
        .withColumn("__p", F.coalesce(F.lag(F.struct(*cols)).over(inside), F.col("__before")))
        .withColumn("__n", F.coalesce(F.lead(F.struct(*cols)).over(inside), F.col("__after")))
    )
    return joined.select(
        *[c for c in df.columns if c not in prev and c not in next],
        *[F.col(f"__p.{c}").alias(o) for o, c in prev.items()],
        *[F.col(f"__n.{c}").alias(o) for o, c in next.items()],
    )


def with_totals(
    df: DataFrame,
    group: Sequence[str],
    order: str,
    aggs: dict[str, tuple[str, Column | str]],
    width: int | None = WIDTH,
) -> DataFrame:
    """Add aggregates of the whole group to each row.

    Replaces ``agg.over(partitionBy(group))`` and aggregate-and-join on the group alone:
    the join is on (group, bucket), so a hot group stays spread over many tasks.
    """
    whole = Window.partitionBy(GROUP)
    src = _with_values(_bucketed(df, group, order, width), aggs)
    edges = _bucket_totals(src, aggs).select(
        GROUP, BUCKET, *[FUNCTIONS[kind](f"__t_{out}").over(whole).alias(out) for out, (kind, _) in aggs.items()]
    )
    return _attach(src.drop(*aggs, *[f"__v_{out}" for out in aggs]), edges).drop(GROUP, BUCKET)


def ordered_parts(
    df: DataFrame,
    group: Sequence[str],
    number: str,
    text: Column | str,
    out: str,
    sep: str,
    part_rows: int = PART_ROWS,
    descending: bool = False,
    extra: Sequence[Column] = (),
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Join texts in order into parts of at most ``part_rows`` rows, and of fewer than
    ``part_bytes`` bytes before the last text of a part.

    ``number`` is unique inside the group and starts at 1. The parts of a group, joined by
    ``sep`` in ``part`` order, are the whole text; a group of up to ``part_rows`` numbers and
    ``part_bytes`` bytes has the single part 0. ``part`` says where a part begins: a multiple of
    ``part_rows``, or the numbers before its first row where bytes cut. ``extra`` are more
    aggregates of a part. The texts are exchanged once: window and aggregate follow the same keys.
    """
    c = text if isinstance(text, Column) else F.col(text)
    items = F.sort_array(F.collect_list(F.struct(F.col(number).alias("n"), F.col("__text").alias("t"))), asc=not descending)
    slot = F.floor((F.col(number) - 1) / F.lit(part_rows)).cast("int")
    before = Window.partitionBy(*group, "__slot").orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    placed = df.withColumns({"__slot": slot, "__text": c})
    size = F.coalesce(F.octet_length("__text"), F.lit(0)) + len(sep.encode())
    placed = placed.withColumn("__cut", F.floor(F.coalesce(F.sum(size).over(before), F.lit(0)) / F.lit(part_bytes)))
    begin = F.when(F.col("__cut") == 0, F.col("__slot") * part_rows).otherwise(F.min(number) - 1).cast("int")
    return (
        placed.groupBy(*group, "__slot", "__cut")
        .agg(begin.alias("part"), F.array_join(F.transform(items, lambda x: x["t"]), sep).alias(out), *extra)
        .drop("__slot", "__cut")
    )


def latest_by(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per group: the one with the greatest ``order`` tuple (combines map-side)."""
    rest = [c for c in df.columns if c not in group]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("__best")
    return df.groupBy(*group).agg(best).select(*group, *[F.col(f"__best.{c}").alias(c) for c in rest])

"""Mixing sources to target weights by Sainte-Lague apportionment, with DataFrame operations only.

1. Sizes (words of a text) are counted where the texts lie; only (id, source, size, hash) goes on.
2. ``targets``: sources, by code point and null last, weigh ``weights`` in turn and share
   ``share`` of all words; a target stops at ``epochs`` times its source's words and the excess
   goes to the others by weight until none is above.
3. All words make blocks of equal size, ``block_words`` or as many fewer that there are
   ``least_blocks`` of them. ``apportion`` gives the target's blocks to the sources by the highest
   quotients target / (2k + 1), and each source's blocks to its shards by words / (2k + 1):
   integer quotas. Shards hold some ``shard_rows`` rows of one source, dealt by a seeded hash.
4. In a shard the documents stand in a seeded order on one line of words, which is cut into blocks
   equal to one word. A quota of q from n blocks takes each block q div n times and the q mod n
   blocks with the smallest seeded hash once more. No block is taken more than ``epochs`` times.

Only the result's span lists say what is taken: words start to end of the document, so many times.

Rows equal in id, source and text are handled as one row with a count, in lots of up to
``COPIES`` that are dealt like documents, so no number of copies lands in one task; each stays a
row of the result, and which copy gets which span is arbitrary but alike in every run. A null id is an id.
Null and blank texts have size 0 and take nothing. An empty table gives no rows. Other columns
of the input are not carried; join them by id. The result depends on the rows and the
parameters alone.

The tables of sources and of (source, shard) are the only ones ordered as a whole: one row for
each source, and one for each ``shard_rows`` rows of one source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, EPOCHS = (5, 2, 1), 1.0, 3
BLOCK_WORDS, LEAST_BLOCKS = 1024, 1 << 20
SHARD_ROWS = 1 << 16
COPIES = 1 << 12
SPANS = "array<struct<start:bigint,end:bigint,times:bigint>>"


def count_words(text: Column) -> Column:
    """Each word becomes one letter, the rest goes: no list of words is made."""
    return F.length(F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x"), " \t\n\x0b\x0c\r", "")).cast("long")


def draw(*parts: Column) -> Column:
    """A whole number below 2**60 by a seeded digest, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 15), 16, 10).cast("long")


def apportion(votes: DataFrame, group: list[str], vote: str, seats: str, order: list[str]) -> DataFrame:
    """``votes`` with ``quota``: the ``seats`` of each group go to the highest quotients
    vote / (2k + 1), the first in ``order`` among equal ones.

    With S rows, seats N and votes V in a group, rounding by the divisor V / (N - S/2) gives no
    more than N seats and by V / (N + S/2) no fewer, so only the quotients between are ranked:
    about 2 S rows, whatever N is.
    """
    whole = Window.partitionBy(*group)
    half = F.count(F.lit(1)).over(whole) / 2.0 + 1
    per = votes.withColumn("_part", F.when(F.col(vote) > 0, F.col(vote).cast("double") / F.sum(F.col(vote).cast("double")).over(whole)).otherwise(0.0))
    per = per.withColumn("_half", half)
    sure = F.greatest(F.lit(0), F.floor(F.col("_part") * (F.col(seats) - F.col("_half")) + 0.5) - 1)
    most = F.when(F.col("_part") > 0, F.floor(F.col("_part") * (F.col(seats) + F.col("_half")) + 0.5) + 1).otherwise(F.lit(0))
    per = per.withColumn("_sure", sure.cast("long")).withColumn("_most", most.cast("long"))
    per = per.withColumn("_open", F.col(seats) - F.sum("_sure").over(whole))
    tried = per.where(F.col("_most") > F.col("_sure")).select(*group, *order, "_open", vote, F.explode(F.sequence("_sure", F.col("_most") - 1)).alias("_k"))
    quotient = F.col(vote).cast("double") / (2 * F.col("_k") + 1).cast("double")
    ranked = tried.withColumn("_place", F.row_number().over(Window.partitionBy(*group).orderBy(quotient.desc(), *order, "_k")))
    won = ranked.where(F.col("_place") <= F.col("_open")).groupBy(*group, *order).agg(F.count(F.lit(1)).alias("_won"))
    keys = [*group, *order]
    return per.join(won, keys, "left").withColumn("quota", F.col("_sure") + F.coalesce("_won", F.lit(0))).drop("_part", "_half", "_sure", "_most", "_open", "_won")


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size) with ``rank`` (0 first), ``weight`` and ``target``.

    Filled like vessels: ordered by limit / weight, the first j stop at their limits and the
    others share what is left by weight, for the one j at which none is above.
    """
    n, all_rows = len(weights), Window.partitionBy(F.lit(0))
    ranked = sources.withColumn("rank", F.row_number().over(all_rows.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % n + 1).cast("int")))
    ranked = ranked.withColumn("_limit", (F.lit(epochs) * F.col("source_size")).cast("double"))
    ranked = ranked.withColumn("_goal", F.sum("source_size").over(all_rows) * F.lit(float(share)))
    line = all_rows.orderBy(F.col("_limit") / F.col("weight"), "rank")
    stopped = F.coalesce(F.sum("_limit").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(line.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    ranked = ranked.withColumn("_level", (F.col("_goal") - stopped) / left)
    level = F.min(F.when(F.col("_level") * F.col("weight") <= F.col("_limit"), F.struct(F.col("_limit") / F.col("weight"), "rank", "_level"))).over(all_rows)
    # all sources at their limits: no level, each has its limit
    return ranked.withColumn("target", F.coalesce(F.least("_limit", level["_level"] * F.col("weight")), "_limit")).drop("_limit", "_goal", "_level")


def mix(
    spark: SparkSession,
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    epochs: int = EPOCHS,
    seed: int = 1,
    block_words: int = BLOCK_WORDS,
    least_blocks: int = LEAST_BLOCKS,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, shard, spans
    (start, end, times; words of the document), taken."""
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("text"))
    sized = rows.select("doc_id", "source", count_words(F.col("text")).alias("size"), F.xxhash64("text").alias("hash"))
    same = sized.groupBy("doc_id", "source", "size", "hash").agg(F.count(F.lit(1)).alias("copies"))
    same = materialize(spark, same, "mixture-sizes")
    rest = F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))
    same = same.withColumn("lot", F.explode(rest)).withColumn("copies", F.least(F.col("copies") - F.col("lot"), F.lit(COPIES).cast("long")))
    here = F.sum(F.col("size") * F.col("copies"))
    # one row for each source
    sources = same.groupBy("source").agg(here.alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    sources = targets(sources, weights, share, epochs).withColumn("_shards", F.ceil(F.col("_rows") / F.lit(shard_rows)).cast("long"))
    sources = materialize(spark, sources.drop("_rows"), "mixture-sources")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    block = max(1, min(block_words, total // least_blocks))
    seats = int(min(share, epochs) * total / block + 0.5)
    sources = apportion(sources.withColumns({"_seats": F.lit(seats), "_all": F.lit(0)}), ["_all"], "target", "_seats", ["rank"])
    sources = materialize(spark, sources.drop("_all", "_seats", "weight").withColumnRenamed("quota", "_seats"), "mixture-quotas")
    # one row for each shard
    drawn = draw(F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.when(F.col("lot") > 0, F.col("lot").cast("string")))
    known = sources.drop("_seats").withColumnRenamed("source", "_source")
    placed = same.withColumn("_draw", drawn).join(known, F.col("source").eqNullSafe(F.col("_source")))
    placed = placed.withColumn("shard", F.col("_draw") % F.col("_shards")).drop("_source", "_shards")
    shards = placed.groupBy("rank", "shard").agg(here.alias("_words"))
    shards = apportion(shards.join(sources.select("rank", "_seats"), "rank"), ["rank"], "_words", "_seats", ["shard"])
    many = F.when(F.col("_words") > 0, F.greatest(F.lit(1), F.round(F.col("_words") / block))).otherwise(0).cast("long")
    shards = shards.withColumn("_blocks", many).withColumn("quota", F.least(F.col("quota"), epochs * F.col("_blocks"))).drop("_seats")
    shards = materialize(spark, shards, "mixture-shards")
    # the documents on their shard's line, each copy from its own place on
    line = Window.partitionBy("rank", "shard").orderBy("_draw", "doc_id", "size", "hash", "lot").rowsBetween(Window.unboundedPreceding, -1)
    laid = placed.withColumn("_at", F.coalesce(here.over(line), F.lit(0)))
    laid = laid.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    laid = laid.withColumn("_at", F.col("_at") + F.col("_copy") * F.col("size"))
    result = ["doc_id", "source", "size", "source_size", "target", "shard"]
    blank = laid.where("size = 0").select(*result, F.array().cast(SPANS).alias("spans"))
    laid = laid.where("size > 0").join(shards.select("rank", "shard", "_words", "_blocks"), ["rank", "shard"])
    # block i begins at word i * words div blocks
    first, last = F.expr("((_at + 1) * _blocks - 1) div _words"), F.expr("((_at + size) * _blocks - 1) div _words")
    # merged, not broadcast: Spark's size estimate is that of the shards, before they become blocks
    pieces = laid.withColumn("block", F.explode(F.sequence(first, last))).join(selected(shards, seed).hint("merge"), ["rank", "shard", "block"])
    start, end = F.greatest(F.col("_from") - F.col("_at"), F.lit(0)), F.least(F.col("_to") - F.col("_at"), F.col("size"))
    span = F.when(F.col("times") > 0, F.struct(start.alias("start"), end.alias("end"), F.col("times")))
    full = pieces.groupBy("rank", "_at", *result).agg(F.array_sort(F.collect_list(span)).alias("spans")).select(*result, "spans")
    taken = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]) * s["times"])
    return full.unionByName(blank).withColumn("taken", taken)


def selected(shards: DataFrame, seed: int) -> DataFrame:
    """Every block of every shard: its words _from to _to of the line, and how many times it is taken."""
    each = shards.where("_blocks > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    drawn = draw(F.lit(f"{seed}:block"), *[F.col(c).cast("string") for c in ("rank", "shard", "block")])
    place = F.row_number().over(Window.partitionBy("rank", "shard").orderBy(drawn, "block"))
    times = F.expr("quota div _blocks") + (place <= F.col("quota") % F.col("_blocks")).cast("long")
    ends = [F.expr("block * _words div _blocks").alias("_from"), F.expr("(block + 1) * _words div _blocks").alias("_to")]
    return each.select("rank", "shard", "block", *ends, times.alias("times"))

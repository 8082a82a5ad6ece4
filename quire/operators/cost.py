"""Token cost, budgets and the usage ledger."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import money as M
from quire.operators.scale import with_running, with_totals
from quire.sources.tables import materialize


@dataclass(frozen=True)
class Settings:
    """The one settings row; defaults as shipped."""

    monthly_limit: str = "5.00"
    daily_limit: int = 100
    enabled: bool = True

    @property
    def month(self) -> Column:
        return F.lit(self.monthly_limit).cast("decimal(10,2)")

    @property
    def day(self) -> Column:
        return F.lit(self.daily_limit)


def with_costs(calls: DataFrame) -> DataFrame:
    """Add input, output and total cost; an unknown model gives an error instead."""
    m = F.col("model")
    return calls.select(
        "*",
        M.token_cost(F.col("input_tokens"), M.price(m, 0)).alias("input_cost"),
        M.token_cost(F.col("output_tokens"), M.price(m, 1)).alias("output_cost"),
        M.cost(F.col("input_tokens"), F.col("output_tokens"), m).alias("cost"),
        F.when(
            M.price(m, 0).isNull(), F.concat(F.lit("Pricing not available for model: "), m)
        ).alias("error"),
    )


def daily_usage(calls: DataFrame, *extra: str) -> DataFrame:
    """Count, tokens and cost of finished calls per day (and ``extra`` keys)."""
    return (
        calls.filter(F.col("status") == "ok")
        .groupBy(*extra, "day")
        .agg(
            F.count("*").alias("calls"),
            F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"),
            F.sum("cost").cast(M.COST).alias("cost"),
        )
    )


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def month_to_date(daily: DataFrame, *extra: str) -> DataFrame:
    """Running totals inside a month; a window holds at most 31 day rows."""
    w = (
        Window.partitionBy(*extra, month_key(F.col("day")))
        .orderBy("day")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return daily.select(
        "*",
        month_key(F.col("day")).alias("month"),
        F.sum("calls").over(w).alias("month_calls"),
        F.sum("tokens").over(w).alias("month_tokens"),
        F.sum("cost").over(w).cast(M.COST).alias("month_cost"),
    )


def refusal(enabled: Column, day_calls: Column, month_cost: Column, estimate: Column, s: Settings) -> Column:
    """First failing check: features off, daily count reached, month cost passed. Null = admitted."""
    return (
        F.when(~enabled, "emergency stop")
        .when(day_calls >= s.day, "daily")
        .when(month_cost + estimate > s.month, "monthly")
    )


def warnings(day_calls: Column, month_cost: Column, s: Settings) -> Column:
    """Texts for 90 % (else 80 %) of the daily count and of the month's budget."""
    day_share = M.percent(day_calls, s.day, 9)
    month_share = M.percent(month_cost, s.month, 9)
    six = month_cost.cast("decimal(18,6)").cast("string")

    def level(share: Column) -> Column:
        return F.when(share >= 90, "90").when(share >= 80, "80")

    day_text = F.concat(
        F.lit("Warning: "), level(day_share), F.lit("% of daily summary limit used ("),
        day_calls.cast("string"), F.lit(f"/{s.daily_limit})"),
    )
    month_text = F.concat(
        F.lit("Warning: "), level(month_share), F.lit("% of monthly budget used ($"), six,
        F.lit(f"/${s.monthly_limit})"),
    )
    return F.array_compact(F.array(day_text, month_text))


def stop_at_first_refusal(calls: DataFrame, s: Settings) -> DataFrame:
    """A run per budget key, in call order, that ends at its first refused call.

    Up to that call everything was admitted, so running totals over all earlier calls are
    the run's own totals. They come from the bucketed scan: a key may hold any number of
    calls.
    """
    base = calls.withColumn("month", month_key(F.col("day")))
    rows = with_running(base, ["budget_key", "day"], "call_id", {"day_n": ("sum", F.lit(1))})
    rows = with_running(
        rows, ["budget_key", "month"], "call_id", {"month_sum": ("sum", "cost")}, totals_of=base
    )
    why = refusal(F.lit(s.enabled), F.col("day_n") - 1, F.col("month_sum") - F.col("cost"), F.col("cost"), s)
    judged = materialize(
        calls.sparkSession, rows.select("budget_key", "call_id", "day", "cost", why.alias("refused")), "judged"
    )
    c, cut = F.col("call_id"), F.col("cut")
    return with_totals(
        judged, ["budget_key"], "call_id", {"cut": ("min", F.when(F.col("refused").isNotNull(), c))}
    ).withColumn(
        "outcome",
        F.when(cut.isNull() | (c < cut), "admitted")
        .when(c == cut, F.concat(F.lit("refused: "), F.col("refused")))
        .otherwise("not reached"),
    )


def skip_and_continue(calls: DataFrame, s: Settings) -> DataFrame:
    """Admission where a refused call is passed over and uses no budget.

    Sequential inside a (key, month), so the fold only sees calls that could be admitted:
    money left never grows, hence a call cannot be admitted once ``daily_limit`` earlier
    calls of the same day cost no more than it does. Two exact cuts follow:

    1. keep the first ``daily_limit`` calls per (key, day, cost) - Spark prunes these map-side;
    2. drop a call if ``daily_limit`` calls of the day's first bucket cost no more.

    What is left is at most daily_limit x distinct costs per day whatever the number of
    calls. The fold then admits at most daily_limit calls a day.
    """
    width = 65536
    base = calls.select(
        "budget_key", "day", "call_id", "cost", F.floor(F.col("call_id") / width).alias("bucket")
    )
    same_cost = Window.partitionBy("budget_key", "day", "cost").orderBy("call_id")
    first = materialize(
        calls.sparkSession,
        base.withColumn("k", F.row_number().over(same_cost)).filter(F.col("k") <= s.daily_limit).drop("k"),
        "candidates",
    )

    opening = first.groupBy("budget_key", "day").agg(F.min("bucket").alias("open"))
    by_cost = Window.partitionBy("budget_key", "day").orderBy("cost", "call_id")
    bar = (
        first.join(opening, ["budget_key", "day"])
        .filter(F.col("bucket") == F.col("open"))
        .withColumn("k", F.row_number().over(by_cost))
        .filter(F.col("k") == s.daily_limit)
        .select("budget_key", "day", "open", F.col("cost").alias("bar"))
    )
    candidates = first.join(bar, ["budget_key", "day"], "left").filter(
        F.col("bar").isNull() | (F.col("bucket") == F.col("open")) | (F.col("cost") < F.col("bar"))
    )
    entry = F.struct("call_id", "day", F.col("cost").cast("decimal(28,9)").alias("cost"))
    state = (
        f"named_struct('day', date'0001-01-01', 'n', 0, 'spent', cast(0 as decimal(28,9)), "
        f"'ids', cast(array() as array<bigint>))"
    )
    fold = F.expr(
        f"""aggregate(items, {state}, (s, x) ->
          if((s.day < x.day or s.n < {s.daily_limit}) and s.spent + x.cost <= cast('{s.monthly_limit}' as decimal(10,2)),
             named_struct('day', x.day, 'n', if(s.day < x.day, 1, s.n + 1),
                          'spent', cast(s.spent + x.cost as decimal(28,9)), 'ids', array_append(s.ids, x.call_id)),
             named_struct('day', x.day, 'n', if(s.day < x.day, 0, s.n), 'spent', s.spent, 'ids', s.ids)),
          s -> s.ids)"""
    )
    admitted = (
        candidates.groupBy("budget_key", month_key(F.col("day")).alias("month"))
        .agg(F.sort_array(F.collect_list(entry)).alias("items"))
        .select(F.explode(fold).alias("call_id"))
        .withColumn("admitted", F.lit(True))
    )
    marked = materialize(
        calls.sparkSession,
        calls.select("call_id", "budget_key", "day", "cost").join(admitted, "call_id", "left"),
        "marked",
    )
    hit = F.col("admitted")
    rows = with_totals(
        marked,
        ["budget_key", "day"],
        "call_id",
        {"n": ("sum", F.when(hit, 1)), "last_admitted": ("max", F.when(hit, F.col("call_id")))},
    )
    full = (F.col("n") >= s.daily_limit) & (F.col("call_id") > F.col("last_admitted"))
    return rows.withColumn(
        "outcome",
        F.when(F.lit(not s.enabled), "emergency stop")
        .when(hit, "admitted")
        .when(full | F.lit(s.daily_limit == 0), "daily")
        .otherwise("monthly"),
    ).drop("admitted", "n", "last_admitted")

"""Prices, token rules and exact costs."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quire.functions.rounding import rounded

# Dollars per million tokens, tokens per minute.
PRICES = {"small": ("0.150", "0.600"), "large": ("2.50", "10.00")}
TPM_LIMITS = {"small": 200000, "large": 30000}

COST = "decimal(18,9)"


def price(model: Column, side: int) -> Column:
    """Price per million tokens: side 0 input, 1 output; null for an unknown model."""
    out = None
    for name, pair in PRICES.items():
        value = F.lit(pair[side]).cast("decimal(10,3)")
        out = F.when(model == name, value) if out is None else out.when(model == name, value)
    return out


def token_cost(tokens: Column, per_million: Column) -> Column:
    """Exact: the product of two decimals and 0.000001 has nine places."""
    return (tokens.cast("decimal(18,0)") * per_million * F.lit("0.000001").cast("decimal(7,6)")).cast(COST)


def cost(input_tokens: Column, output_tokens: Column, model: Column) -> Column:
    return (
        token_cost(input_tokens, price(model, 0)) + token_cost(output_tokens, price(model, 1))
    ).cast(COST)


def token_estimate(text: Column) -> Column:
    """Four characters to a token; 0 for empty or missing text."""
    return F.coalesce(F.ceil(F.length(text) / 4), F.lit(0)).cast("bigint")


def token_counter(encode: Callable[[str], list]) -> Callable[[Column], Column]:
    """Exact counts with a given tokenizer, as an Arrow-batched UDF."""

    @F.pandas_udf(LongType())
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(encode(t)) if t else 0).astype("int64")

    return count


def output_preview(n: Column) -> Column:
    """max(500, int(0.2 n)); the fifth part is exact integer division."""
    return F.greatest(F.lit(500), F.floor(n / 5)).cast("bigint")


def output_batch(n: Column) -> Column:
    return F.least(n, F.lit(4000)).cast("bigint")


def output_book(n: Column) -> Column:
    return F.least(F.floor(n / 10), F.lit(2000)).cast("bigint")


def percent(used: Column, limit: Column, digits: int) -> Column:
    """Share of a limit in percent, 0 when there is no limit."""
    d = F.when(limit > 0, used.cast("double") / limit.cast("double") * 100).otherwise(F.lit(0.0))
    return rounded(d, digits)

import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quire.functions import money as M
from quire.operators import cost as C


def test_token_and_cost(one):
    assert one(M.token_estimate, "") == 0
    assert one(M.token_estimate, None) == 0
    assert one(M.token_estimate, "abcde") == 2
    assert one(M.cost, 1000, 500, "small") == Decimal("0.000450000")
    assert one(M.cost, 1, 0, "small") == Decimal("1.50E-7")
    assert one(M.cost, 1, 1, "other") is None


def test_tokenizer_udf(spark):
    count = M.token_counter(str.split)
    rows = spark.createDataFrame([("a b c",), ("",), (None,)], "t string").select(count(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in rows] == [3, 0, 0]


@pytest.mark.parametrize("n, want", [(0, (500, 0, 0)), (2499, (500, 2499, 249)), (2505, (501, 2505, 250)), (50000, (10000, 4000, 2000))])
def test_output_rules(one, n, want):
    assert (one(M.output_preview, n), one(M.output_batch, n), one(M.output_book, n)) == want


def check(one, calls, spent, estimate, s=C.Settings(), on=True):
    def run(on_c, n, m, e):
        return C.refusal(on_c, n, m.cast("decimal(18,9)"), e.cast("decimal(18,9)"), s)

    return one(run, on, calls, spent, estimate)


def test_limits(one):
    assert check(one, 0, "4.50", "1.00") == "monthly"
    assert check(one, 0, "4.50", "0.50") is None  # equal passes
    assert check(one, 100, "0", "0") == "daily"  # reached blocks
    assert check(one, 99, "0", "0") is None
    assert check(one, 100, "9", "9", on=False) == "emergency stop"


def warn(one, calls, spent, s=C.Settings()):
    return one(lambda n, m: F.array_join(C.warnings(n, m.cast("decimal(18,9)"), s), "; "), calls, spent)


def test_warnings(one):
    assert warn(one, 80, "0") == "Warning: 80% of daily summary limit used (80/100)"
    assert warn(one, 95, "4.5").count("90%") == 2
    assert warn(one, 79, "3.99") == ""
    assert warn(one, 0, "0", C.Settings(monthly_limit="0.00", daily_limit=0)) == ""


def ledger(seed, keys=4, n=400, distinct=8):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = 0 if rng.random() < 0.4 else rng.randrange(keys)
        day = datetime.date(2024, 1, 28) + datetime.timedelta(days=i * 8 // n)
        out.append((i * 97, key, day, Decimal(rng.randrange(1, distinct)) / 100))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "call_id bigint, budget_key bigint, day date, cost decimal(18,9)")


def brute(rows, limit, money, stop):
    count, spent, stopped, out = {}, {}, set(), {}
    for cid, key, day, cost in sorted(rows):
        if stop and key in stopped:
            out[cid] = "not reached"
            continue
        d, m = (key, day), (key, day.strftime("%Y-%m"))
        why = "daily" if count.get(d, 0) >= limit else "monthly" if spent.get(m, 0) + cost > money else None
        if why:
            stopped.add(key)
            out[cid] = f"refused: {why}" if stop else why
        else:
            count[d] = count.get(d, 0) + 1
            spent[m] = spent.get(m, 0) + cost
            out[cid] = "admitted"
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("limit, money", [(1, "0.10"), (3, "0.40"), (12, "2.00"), (100, "0.55")])
def test_replay_equals_a_plain_loop(spark, seed, limit, money):
    rows = ledger(seed)
    got = C.skip_and_continue(frame(spark, rows), C.Settings(monthly_limit=money, daily_limit=limit)).collect()
    assert {r["call_id"]: r["outcome"] for r in got} == brute(rows, limit, Decimal(money), stop=False)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("limit, money", [(3, "0.40"), (12, "2.00")])
def test_stop_at_first_refusal_equals_a_plain_loop(spark, seed, limit, money):
    rows = ledger(seed)
    got = C.stop_at_first_refusal(frame(spark, rows), C.Settings(monthly_limit=money, daily_limit=limit)).collect()
    assert {r["call_id"]: r["outcome"] for r in got} == brute(rows, limit, Decimal(money), stop=True)


def test_daily_ledger(spark):
    d = datetime.date(2024, 1, 1)
    rows = [(d, "ok", 700, 300, Decimal("0.001")), (d, "ok", 300, 200, Decimal("0.0005")), (d, "failed", 9, 9, Decimal("1"))]
    df = spark.createDataFrame(rows, "day date, status string, input_tokens bigint, output_tokens bigint, cost decimal(18,9)")
    r = C.daily_usage(df).first()
    assert (r["calls"], r["tokens"], r["cost"]) == (2, 1500, Decimal("0.001500000"))


def test_month_restarts(spark):
    days = [datetime.date(2024, 1, 30), datetime.date(2024, 1, 31), datetime.date(2024, 2, 1)]
    df = spark.createDataFrame([(d, 1, 10, Decimal("1")) for d in days], "day date, calls bigint, tokens bigint, cost decimal(18,9)")
    got = {r["day"]: r["month_calls"] for r in C.month_to_date(df).collect()}
    assert [got[d] for d in days] == [1, 2, 1]


def test_history_bounds():
    from quire.plans.cost import usage_between

    for bad in (0, 366):
        with pytest.raises(ValueError):
            usage_between(None, bad, "2024-01-30")

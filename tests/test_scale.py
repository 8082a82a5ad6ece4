"""The bucketed operations equal plain windows, with a third of all rows in one group."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.operators import scale
from quire.operators.scale import (
    RANGES,
    latest_by,
    ordered_parts,
    with_neighbors,
    with_rank,
    with_running,
    with_totals,
)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    ids = rng.sample(range(-300, 5000), 900)
    data = [
        ("hot" if i < 300 else f"g{rng.randrange(12)}", k, rng.choice([None, rng.randrange(100)]), f"t{k}")
        for i, k in enumerate(ids)
    ]
    return spark.createDataFrame(data, "g string, k bigint, v bigint, t string").repartition(5).cache()


def same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    assert sorted(map(str, a.select(cols).collect())) == sorted(map(str, b.select(cols).collect()))


@pytest.mark.parametrize("width", [1, 7, 64, 8192])
def test_rank(rows, width):
    w = Window.partitionBy("g").orderBy("k")
    same(with_rank(rows, ["g"], "k", "n", width), rows.withColumn("n", F.row_number().over(w)))


@pytest.mark.parametrize("width", [1, 7, 8192])
def test_running(rows, width):
    w = Window.partitionBy("g").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    got = with_running(rows, ["g"], "k", {"s": ("sum", "v"), "m": ("max", "v")}, width)
    same(got, rows.withColumn("s", F.sum("v").over(w)).withColumn("m", F.max("v").over(w)))


@pytest.mark.parametrize("width", [1, 7, 8192])
def test_neighbors_keep_null_values(rows, width):
    w = Window.partitionBy("g").orderBy("k")
    got = with_neighbors(rows, ["g"], "k", prev={"pv": "v", "pk": "k"}, next={"nv": "v"}, width=width)
    want = rows.select("*", F.lag("v").over(w).alias("pv"), F.lag("k").over(w).alias("pk"), F.lead("v").over(w).alias("nv"))
    same(got, want)


@pytest.mark.parametrize("width", [1, 7, 8192])
def test_totals(rows, width):
    w = Window.partitionBy("g")
    got = with_totals(rows, ["g"], "k", {"n": ("sum", F.lit(1)), "top": ("max", "v"), "low": ("min", "v")}, width)
    same(got, rows.withColumn("n", F.count("*").over(w)).withColumn("top", F.max("v").over(w)).withColumn("low", F.min("v").over(w)))


@pytest.mark.parametrize("descending", [False, True])
def test_parts_joined_in_order_are_the_whole_text(rows, descending):
    numbered = with_rank(rows, ["g"], "k", "n", 16)
    parts = ordered_parts(numbered, ["g"], "n", "t", "text", "|", part_rows=10, descending=descending).collect()
    assert max(p["text"].count("|") for p in parts) == 9
    for g in {p["g"] for p in parts}:
        mine = sorted([p for p in parts if p["g"] == g], key=lambda p: p["part"], reverse=descending)
        texts = [r["t"] for r in numbered.filter(F.col("g") == g).orderBy("k").collect()]
        assert "|".join(p["text"] for p in mine) == "|".join(texts[::-1] if descending else texts)


def test_latest(rows):
    w = Window.partitionBy("g").orderBy(F.desc("k"))
    want = rows.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
    same(latest_by(rows, ["g"], ["k"]), want)


def test_no_window_over_a_whole_group(rows):
    """Every window of the rank is inside a bucket, but for the one over bucket totals."""
    plan = with_rank(rows, ["g"], "k", "n")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2
    assert sum("__bucket" in line.split("], [")[1] for line in windows) == 1


@pytest.fixture(scope="module")
def sparse(spark):
    """Order keys over all 64-bit numbers, a null group and a group of two columns one of which is null."""
    rng = random.Random(3)
    keys = sorted({rng.randrange(-(1 << 62), 1 << 62) for _ in range(500)}, key=lambda k: k % 1009)
    data = [(None if i < 170 else f"g{rng.randrange(9)}", rng.choice([None, 1]), k, rng.choice([None, rng.randrange(100)])) for i, k in enumerate(keys)]
    return spark.createDataFrame(data, "g string, h int, k bigint, v bigint").repartition(5).cache()


@pytest.mark.parametrize("width", [RANGES, 1 << 55])
def test_sparse_keys_and_null_groups(sparse, width):
    w = Window.partitionBy("g", "h").orderBy("k")
    same(with_rank(sparse, ["g", "h"], "k", "n", width), sparse.withColumn("n", F.row_number().over(w)))
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    got = with_running(sparse, ["g", "h"], "k", {"s": ("sum", "v"), "m": ("max", "v")}, width)
    same(got, sparse.withColumn("s", F.sum("v").over(running)).withColumn("m", F.max("v").over(running)))
    got = with_neighbors(sparse, ["g", "h"], "k", prev={"pk": "k"}, next={"nv": "v"}, width=width)
    same(got, sparse.withColumn("pk", F.lag("k").over(w)).withColumn("nv", F.lead("v").over(w)))
    whole = Window.partitionBy("g", "h")
    got = with_totals(sparse, ["g", "h"], "k", {"n": ("sum", F.lit(1)), "top": ("max", "v")}, width)
    same(got, sparse.withColumn("n", F.count("*").over(whole)).withColumn("top", F.max("v").over(whole)))


def test_ranges_have_few_carry_rows_and_take_any_key(sparse):
    placed = scale._bucketed(sparse, ["g", "h"], "k", RANGES)
    carry = placed.select(scale.GROUP, scale.BUCKET).distinct().count()
    groups = sparse.select("g", "h").distinct().count()
    assert carry <= groups + int(sparse.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    paths = sparse.withColumn("k", F.array(F.col("k") % 7, F.col("k")))
    w = Window.partitionBy("g", "h").orderBy("k")
    same(with_rank(paths, ["g", "h"], "k", "n", RANGES), paths.withColumn("n", F.row_number().over(w)))


@pytest.mark.parametrize("descending", [False, True])
def test_parts_are_bounded_in_bytes(spark, descending):
    """Long texts: a part ends at the text that fills it, empty and null texts included."""
    rng = random.Random(5)
    texts = [rng.choice([None, "", "é" * rng.randrange(1, 60), "x" * rng.randrange(1, 400)]) for _ in range(60)]
    df = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(texts)], "g int, n int, t string").repartition(4)
    parts = sorted(ordered_parts(df, ["g"], "n", "t", "text", "|", 25, descending, part_bytes=300).collect(), key=lambda p: p["part"], reverse=descending)
    assert len(parts) > 8 and len({p["part"] for p in parts}) == len(parts) and min(p["part"] for p in parts) == 0
    kept = [t for t in texts if t is not None]
    assert all(len(p["text"].encode()) < 300 + 401 for p in parts)
    joined = "".join(p["text"].replace("|", "") for p in parts)
    assert joined == "".join(kept[::-1] if descending else kept)

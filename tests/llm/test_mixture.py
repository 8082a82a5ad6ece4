import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quire.llm import op11_mixture as op11
from quire.llm.queries import QUERIES
from tests.llm.brute import space_words

ROOT = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, source string"


def by_hand(sizes, weights=(5, 2, 1), epochs=3):
    """Targets by clamping and sharing the excess again until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(order)}
    total, stopped = Fraction(sum(sizes.values())), {}
    while True:
        free = [s for s in order if s not in stopped]
        left = total - sum(stopped.values())
        goal = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if goal[s] > epochs * sizes[s]]
        if not above:
            return stopped | goal
        stopped |= {s: Fraction(epochs * sizes[s]) for s in above}


def highest_quotients(votes, seats):
    quotients = sorted(((-Fraction(v) / (2 * k + 1), i) for i, v in enumerate(votes) for k in range(seats)), key=lambda x: x)
    won = [0] * len(votes)
    for _, i in quotients[:seats]:
        won[i] += 1
    return won


def rows_of(seed=3, n=300):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        source = rng.choice(["a"] * 12 + ["b", "é", "日本", "z" * 40, None, ""])
        words = rng.choice([0, 1, 5, 40, 200, 900])
        out.append((i, rng.choice([" ", "\n", " \t"]).join("w%d" % rng.randrange(50) for _ in range(words)) or rng.choice([None, "", " \r\n"]), source))
    return out


def test_targets_equal_clamping_by_hand(spark):
    rng = random.Random(8)
    for trial in range(4):
        sizes = {s: rng.choice([0, 1, 7, 100, 5000]) for s in ["b", "a", "é", "", None, "z"][: 2 + trial]}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
        got = {r.source: r.target for r in op11.targets(df).collect()}
        assert got == pytest.approx({s: float(t) for s, t in by_hand(sizes).items()})


def test_apportion_equals_highest_quotients(spark):
    rng = random.Random(4)
    for seats in (0, 1, 7, 100, 1001):
        votes = [rng.choice([0, 1, 3, 10, 10, 10_000, rng.randrange(1, 500)]) for _ in range(12)]
        df = spark.createDataFrame([(0, i, v, seats) for i, v in enumerate(votes)], "g int, i int, v bigint, n int")
        got = [r.quota for r in op11.apportion(df, ["g"], "v", "n", ["i"]).orderBy("i").collect()]
        assert got == highest_quotients(votes, seats) and sum(got) == seats


def test_mixture_meets_its_targets(spark):
    rows = rows_of()
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("rank", "shard", "size", "_at", "lot", "copies", "taken")}).repartition(6)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(space_words(text))
    want = by_hand(sizes)
    for options in ({}, {"shard_rows": 16, "least_blocks": 2000}, {"block_words": 7, "least_blocks": 1}):
        got = op11.mix(spark, docs, **options).collect()
        assert sorted((r.doc_id, r.size, r.source_size) for r in got) == [(i, len(space_words(t)), sizes[s]) for i, t, s in rows]
        taken = dict.fromkeys(sizes, 0)
        for r in got:
            assert r.target == pytest.approx(float(want[r.source]))
            assert r.taken == sum((s.end - s.start) * s.times for s in r.spans) <= 3 * r.size
            assert all(0 <= s.start < s.end <= r.size and 1 <= s.times <= 3 for s in r.spans)
            assert all(a.end <= b.start for a, b in zip(r.spans, r.spans[1:]))
            taken[r.source] += r.taken
        assert all(abs(taken[s] - want[s]) <= 0.03 * want[s] + 10 for s in sizes), (options, taken, want)
    again = op11.mix(spark, docs.repartition(3), **options).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixture_of_repeated_rows_null_ids_and_nothing(spark, monkeypatch):
    monkeypatch.setattr(op11, "COPIES", 4)
    rows = [(None, "a b c", "s")] * 50 + [(None, None, None)] * 3 + [(1, "x " * 400, "t"), (1, "y", "t"), (1, "x " * 400, "t")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = op11.mix(spark, docs).collect()
    assert len(got) == len(rows) and sum(r.size for r in got) == 150 + 801
    assert all(r.taken <= 3 * r.size for r in got)
    s = [r for r in got if r.source == "s"]
    assert abs(sum(r.taken for r in s) - s[0].target) <= 2
    empty = op11.mix(spark, docs.limit(0))
    assert empty.collect() == [] and "spans" in empty.columns
    assert all(r.taken == 0 and r.target == 0 for r in op11.mix(spark, docs.where("text is null")).collect())


def test_query_uses_no_python_workers(spark):
    plan = QUERIES["op11_mixture"](spark, ROOT)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan

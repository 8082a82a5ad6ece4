import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import op13_ranked_search as op13
from tests.llm.brute import LOWER


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def ranked(rows, items, k=10):
    """Every item's best documents by scoring all of them."""
    bags = [(i, Counter(terms(t)), len(terms(t))) for i, t in rows]
    n_docs, total = sum(n > 0 for _, _, n in bags), sum(n for _, _, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in items:
        scored = []
        for i, bag, n in bags:
            s = 0
            for t in terms(text):
                if bag[t]:
                    m = 25 + 75 * n * n_docs // total
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m))
            if s > 0:
                scored.append((-s, i is not None, i or 0))
        out += [(item, rank, i if known else None, -s) for rank, (s, known, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def key(r):
    return tuple((x is None, x or 0) for x in r)


def corpus(n=700, seed=6):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)] + ["É", "é", "日本", "Straße", "A1", "0"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    rows = [(rng.randrange(10**6), rng.choice([" ", ", ", "_", "\n"]).join(rng.choices(vocabulary, weights, k=rng.choice([1, 4, 30, 120])))) for _ in range(n)]
    rows += [(i, "W0 w1 W2") for i in range(50, 300)]  # equal scores
    rows += [(None, "w150 w151"), (None, "w150 w151"), (7, None), (8, ""), (9, "?! _"), (10, "w3 " * 60_000), (11, "x" * 50_000)]
    rng.shuffle(rows)
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 12, 40])))) for i in range(25)]
    items += [(100, "w0 w1 w2"), (101, "nowhere"), (102, None), (103, ""), (None, "w150"), (104, "w0"), (105, "w150 w151 W150"), (100, "w5")]
    return rows, items


@pytest.fixture(scope="module")
def case():
    return corpus()


@pytest.mark.parametrize("block,pairs", [(1 << 20, 1 << 18), (3000, 1 << 18), (20_000, 40)])
def test_search_equals_scoring_all(spark, tmp_path, monkeypatch, case, block, pairs):
    rows, items = case
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("id", "term", "block", "number")}).repartition(4)
    queries = spark.createDataFrame(items, "item_id bigint, text string").withColumn("score", F.lit("x"))
    path = str(tmp_path / "index")
    op13.write_index(spark, docs, path, block_bytes=block)
    got = op13.search(spark, path, queries, pairs=pairs)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(ranked(rows, items), key=key)


def test_repeated_queries_and_empty_tables(spark, tmp_path, case):
    rows, _ = case
    docs = spark.createDataFrame(rows[:60], "doc_id bigint, text string")
    queries = spark.createDataFrame([(1, "w0 w1"), (1, "w0 w1")], "item_id bigint, text string")
    path, none = str(tmp_path / "index"), str(tmp_path / "none")
    op13.write_index(spark, docs, path)
    got = sorted(tuple(r) for r in op13.search(spark, path, queries, k=3).collect())
    want = ranked(rows[:60], [(1, "w0 w1")], 3)
    assert got == sorted(want * 2)
    assert op13.search(spark, path, queries.limit(0)).collect() == []
    op13.write_index(spark, docs.limit(0), none)
    assert op13.search(spark, none, queries).collect() == []


def test_only_surviving_runs_are_decompressed():
    """A common list beside a rare one: with a full heap the common list's runs without a
    candidate stay packed."""
    n = 4096
    texts = ["common " * 2 + ("rare " * 9 if i in (5, 900, 901) else "") + "filler " * 5 for i in range(n)]
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    rows = [r for r in op13.index_block(0, np.arange(n), buf, off).to_pylist() if r["term"]]
    m = np.full(n, 100)
    lists = {r["term"]: op13.List(r, m, n, n * 7) for r in rows}
    assert len(lists["common"].lasts) == n // op13.RUN
    opened = []
    whole = op13.List.unpacked
    op13.List.unpacked = lambda self, which: opened.append((self, len(which))) or whole(self, which)
    try:
        heap = op13.Heap(2)
        heap.add(np.array([5_000_000, 4_000_000]), np.array([-1, -2]))
        query = [("common", 1, lists["common"].ceiling), ("rare", 7000, 7000 * lists["rare"].ceiling)]
        op13.search_block(query, lists, np.arange(n), heap)
    finally:
        op13.List.unpacked = whole
    assert heap.ids.tolist() == [5, 900]
    assert [(s is lists["rare"], k) for s, k in opened] == [(True, 1), (False, 2)]


def test_varint_round_trip():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 32, 2000) >> rng.integers(0, 32, 2000)
    data, ends = op13.varint(v)
    assert op13.unvarint(data).tolist() == v.tolist() and ends[-1] == len(data)

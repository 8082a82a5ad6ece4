import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.llm import op12_fill_in_middle as op12
from quire.llm.queries import ORACLES, QUERIES


def by_hand(key, text, seed=1):
    text = text or ""
    x = hashlib.sha256(f"{seed}:{'null' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return key, n, "plain", None, None, text
    pre, mid, suf = text[:i], text[i:j], text[j:]
    if h4 % 100 < 20:
        return key, n, "spm", i, j - i, f"<S>{suf}<P>{pre}<M>{mid}"
    return key, n, "psm", i, j - i, f"<P>{pre}<S>{suf}<M>{mid}"


def rows_of(n=250):
    rng = random.Random(2)
    parts = ["a", "é", "日本", "\U0001f926\U0001f3fc", "\n", "\r\n", "\x00", "<", "<P", "S>", "M>", ">", "́", " "]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(12)))) for i in range(n)]
    return rows + [(-5, "<M>"), (n, "ab<S>c"), (n + 1, None), (n + 2, ""), (None, "null id"), (None, "null id"), (n + 3, "long é " * 300_000)]


def test_equals_plain_python(spark):
    rows = rows_of()
    clash = ["n", "form", "output", "first", "__fim", "places", "h1"]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("clash") for c in clash}).repartition(7)
    got = op12.transform(docs)
    assert {c: got.first()[c] for c in ("first", "__fim", "places", "h1")} == dict.fromkeys(("first", "__fim", "places", "h1"), "clash")
    cells = got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", op12.restored(F.col("output"), F.col("form")).alias("again"), "text").collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted((tuple(r)[:6] for r in cells), key=key) == sorted((by_hand(*r) for r in rows), key=key)
    assert all(r.again == (r.text or "") for r in cells)
    assert {r.form for r in cells} == {"plain", "psm", "spm"}
    assert op12.transform(docs.limit(0)).collect() == []


def test_other_units_cut_between_words(spark):
    docs = spark.createDataFrame([(i, "one two  three\nfour five ") for i in range(40)] + [(99, " starts blank")], "doc_id bigint, text string")
    got = op12.transform(docs, unit=r"\S+\s+", rate=100).select("*", op12.restored(F.col("output"), F.col("form")).alias("again")).collect()
    assert all(r.again == r.text for r in got)
    ends = {0, 4, 9, 15, 20, 25}
    for r in got:
        if r.doc_id == 99:
            assert r.form == "plain" and r.n is None
        else:
            assert r.n == 5 and {r.prefix_chars, r.prefix_chars + r.middle_chars} <= ends


def test_sql_of_odd_texts(spark, tmp_path):
    rows = [r for r in rows_of() if r[0] is not None and "\x00" not in (r[1] or "")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    cur = con.execute(ORACLES["op12_fill_in_middle"])
    names = [d[0] for d in cur.description]
    assert sorted(cur.fetchall()) == sorted(tuple(r[c] for c in names) for r in QUERIES["op12_fill_in_middle"](spark, str(tmp_path)).collect())


@pytest.mark.parametrize("text,a,b,want", [("", 5, 9, (0, 0, 0)), ("abc", 7, 2, (3, 2, 3)), ("日é", 0, 1, (2, 0, 1))])
def test_cut(text, a, b, want):
    assert op12.cut(text, op12.CODE_POINT, a, b) == want

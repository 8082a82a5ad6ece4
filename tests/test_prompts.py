"""Catalogue and request rules by literal cases."""

from pyspark.sql import functions as F

from quire.operators import prompts as P
from quire.operators import versions as V

CATALOG = "name string, category string, default_model string, template string, variables array<string>, checksum string, path string"
RECORDS = CATALOG + ", unreadable boolean"


def row(name, text, path, checksum=None, *rest):
    return (name, "c", "small", text, [text[:1]], checksum or text, path, *rest)


def test_files_of_one_name_give_one_row(spark):
    catalog = spark.createDataFrame([row("a", "old", "0.md"), row("b", "same", "b.md"), row("gone", "g", "g.md"), row("d", "1", "d1.md")], CATALOG)
    records = spark.createDataFrame(
        [row("a", "first", "1.md", None, False), row("a", "last", "2.md", None, False), row("a", "last", "3.md", None, False), row("b", "same", "b.md", None, False),
         row("n", "x", "n.md", None, False), row("bad", "y", "y.md", None, True), row("d", "1", "d1.md", None, False), row("d", "2", "d2.md", None, False), row("d", "1", "d3.md", None, False)],
        RECORDS,
    )
    got = {r.name: (r.action, r.template, r.variables, r.path) for r in P.upsert(catalog, records).collect()}
    assert got == {
        "a": ("updated", "last", ["l"], "2.md"), "b": ("unchanged", "same", ["s"], "b.md"), "gone": ("kept", "g", ["g"], "g.md"),
        "n": ("inserted", "x", ["x"], "n.md"), "d": ("updated", "1", ["1"], "d3.md"),
    }
    assert P.upsert(catalog, records).count() == 5


def test_length_of_a_rendered_template(spark):
    template = "{title}: {content} by {author}, {title}"
    texts = [("no marks", "T", "a"), ("{title} and {title}{author}", "long {author} title", "née"), ("", "", None), ("{content}{x}", "{title}", "b")]
    df = spark.createDataFrame(texts, "content string, title string, author string")
    values = {"title": F.col("title"), "author": F.coalesce("author", F.lit(""))}
    want = F.length(P.render(F.lit(template), {"content": F.col("content"), **values}))
    size = P.rendered_length(template, P.content_size(F.col("content"), list(values)), values)
    assert all(r.a == r.b for r in df.select(want.alias("a"), size.alias("b")).collect())


def test_sizes_and_not_texts_are_shuffled(spark):
    from quire.plans import QUERIES

    for name in ("request_preview", "batch_preview"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        above = plan[: plan.index("RepartitionByExpression")] if "RepartitionByExpression" in plan else plan
        assert "text#" not in above.split("Window [")[0] and "prompt#" not in plan


def test_prior_results_stand_before_the_content(one):
    assert one(V.with_prior, "Do: text text", "text", "<c>") == "Do: <c>text text"
    assert one(V.with_prior, "Do", "text", "<c>") == "Do"
    assert one(lambda p: V.with_prior(p, F.lit("x"), F.lit(None).cast("string")), "a x") == "a x"

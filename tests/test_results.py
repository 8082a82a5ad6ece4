"""Prompts, versions, readability and analyses on literal rows."""

import pytest
from pyspark.sql import functions as F

from quire.functions import payload as P
from quire.functions import readability as R
from quire.operators import analysis as A
from quire.operators import library as L
from quire.operators import prompts as D
from quire.operators import readability as RO
from quire.operators import versions as V


def test_render(one):
    def run(t, c, title):
        return D.render(t, {"content": c, "title": title})

    assert one(run, "Title: {title}\nContent: {content}", "body", "T") == "Title: T\nContent: body"
    assert one(run, "Only {title}", "body", "T") == "Only T\n\nbody"
    assert one(run, "{content}", "see {title} $1 \\", "T") == "see T $1 \\"  # replaced again, nothing special
    assert one(lambda t: D.render(t, {"title": F.lit("T")}), "{title} {content}") == "T {content}"


def test_header(spark):
    files = [
        ("prompts/rate_x.md", "---\nname: n1\ncategory: extraction\nvariables: [content, title]\n---\n\n body \n"),
        ("prompts/summarize_y.md", "plain --- text"),
        ("prompts/other.md", None),
    ]
    got = {r["path"]: r for r in D.prompt_records(spark.createDataFrame(files, "path string, content string")).collect()}
    a, b, c = (got[f[0]] for f in files)
    assert (a["name"], a["category"], a["default_model"], a["variables"], a["template"]) == ("n1", "extraction", "small", ["content", "title"], "body")
    assert (b["name"], b["category"], b["variables"], b["template"]) == ("summarize_y", "summarization", ["content"], "plain --- text")
    assert c["unreadable"] and c["name"] == "other"


@pytest.mark.parametrize("name, local, imported", [("create_x", "summarization", "custom"), ("explain_x", "custom", "analysis"), ("zzz", "custom", "analysis"), ("rate", "rating", "rating")])
def test_category(one, name, local, imported):
    assert one(lambda c: D.category(c, D.LOCAL_CATEGORIES, "custom"), name) == local
    assert one(lambda c: D.category(c, D.IMPORTED_CATEGORIES, "analysis"), name) == imported


@pytest.mark.parametrize("payload, want", [
    ('{"text":"a"}', "a"), ('{"content":"b"}', "b"), ('{"text":{"text":"c"}}', "c"), ('{"x":1}', ""), ("broken", ""), (None, ""),
])
def test_payload(one, payload, want):
    assert one(P.payload_text, payload) == want


@pytest.mark.parametrize("text, overall", [
    ('Here:\n```json\n{"overall": 7}\n```\n', 7), ('```\n{"overall": 6}\n```', 6), ('x {"overall": 5} y', 5),
    ("nothing", None), ('{broken {"overall": 1}', None), ('```json\n{"overall": 4} ', 4), ('```json\n{"overall": 4}', None),
    ('```json\n{}\n```', None),
])
def test_rating_parse(one, text, overall):
    assert one(lambda c: P.parse_rating(c)["overall"], text) == overall


def test_rating_is_null_as_a_whole(one):
    assert one(lambda c: P.parse_rating(c).isNull(), "{broken {}") is True
    assert one(lambda c: P.parse_rating(c).isNull(), '{"insight": 0}') is False


def ratings(spark, rows):
    return spark.createDataFrame(rows, "book_id string, chapter_number int, title string, insight int, clarity int, evidence int, engagement int, actionability int, overall int, verdict string")


def test_rating_rules(spark):
    rows = [("b", 1, None, 0, None, None, None, None, 8, "v1"), ("b", 2, "B", 5, None, None, None, None, 8, None),
            ("b", 3, "C", None, None, None, None, None, None, "v3"), ("b", 4, "D", 4, 7, None, None, None, None, "v4"),
            ("solo", 1, "S", 1, 1, 1, 1, 1, 1, "s")]
    r = ratings(spark, rows)
    avg = {x["book_id"]: x for x in A.rating_averages(r).collect()}["b"]
    assert (avg["insight_avg"], avg["clarity_avg"], avg["evidence_avg"], avg["overall_avg"]) == (3.0, 7.0, 0.0, 8.0)
    bw = {x["book_id"]: x for x in A.best_worst(r).collect()}
    assert (bw["b"]["best_chapter_number"], bw["b"]["worst_chapter_number"], bw["b"]["worst_score"]) == (1, 4, 0)
    assert bw["solo"]["worst_chapter_number"] is None
    verdicts = {x["book_id"]: x["verdicts"] for x in A.verdict_list(r).collect()}
    assert verdicts["b"] == "Chapter 1: v1\nChapter 2: No verdict\nChapter 3: v3\nChapter 4: v4"
    req = {x["book_id"]: x["request"] for x in A.aggregate_request(r).collect()}["solo"]
    assert req.startswith('You are rating the book "solo"') and "- Insight: 1.0\n" in req and req.endswith("no additional formatting.")


@pytest.mark.parametrize("text, want", [(' "a" ', "a"), ('"a', '"a'), ("\n a ", "a"), ('""', "")])
def test_verdict_clean(one, text, want):
    assert one(A.clean_verdict, text) == want


def test_sections(spark):
    text = "## the story\n\nOnce\n---\n## THE ADVICE\nNo standout here\n## PEOPLE WORTH KNOWING\nAnn\n\nBob\n## THE SURPRISE\nSkip it\n## QUOTABLE\nlast"
    got = A.extract_sections(spark.createDataFrame([(1, text)], "chapter_id bigint, content string")).collect()
    assert [(r["section"], r["text"]) for r in sorted(got, key=lambda r: r["section_order"])] == [("stories", "Once"), ("people", "Ann\n\nBob"), ("quotes", "last")]


def test_book_text(spark):
    rows = [("a", 1, "One", "x", False, False), ("a", 2, None, "y", False, False), ("a", 3, "Notes", "z", False, True), ("e", 1, "TOC", "q", True, False)]
    ch = spark.createDataFrame(rows, "book_id string, chapter_number int, title string, content string, is_front_matter boolean, is_back_matter boolean")
    got = {r["book_id"]: r["text"] for r in A.book_texts(ch, ch.select("book_id").distinct()).collect()}
    assert got == {"a": "# One\n\nx\n\n\n# Chapter 2\n\ny\n\n", "e": ""}


def test_versions(spark):
    v = spark.createDataFrame(
        [(1, 7, "p", 1, "a", 5, 100), (2, 7, "p", 2, "b", 5, 300), (3, 7, "p", 3, "c", 5, 200), (4, 8, "q", 1, "d", 5, 100)],
        "summary_id bigint, item_id bigint, prompt_name string, version int, payload string, tokens int, created_s bigint",
    )
    asked = spark.createDataFrame([(7, "p"), (7, "q"), (8, "q")], "item_id bigint, prompt_name string")
    nxt = {(r[0], r[1]): r[2] for r in V.next_version(asked, v).collect()}
    assert nxt == {(7, "p"): 4, (7, "q"): 1, (8, "q"): 2}
    chain = {r["summary_id"]: r["previous_id"] for r in V.version_chain(v).collect()}
    assert chain == {1: None, 2: 1, 3: 2, 4: None}
    assert {r["summary_id"] for r in V.latest(v).collect()} == {3, 4}
    assert {r["summary_id"] for r in V.latest_created(v).collect()} == {2, 4}


def test_violations(spark):
    rows = [(1, 5, None, "p", 1, 0), (2, 5, None, "p", 1, 0), (3, 5, 6, "p", 2, 0), (4, None, None, "p", 0, -1), (5, None, 6, "p", 1, 0)]
    df = spark.createDataFrame(rows, "summary_id bigint, chapter_id bigint, book_id bigint, prompt_name string, version int, tokens int")
    got = sorted((r["rule"], r["summary_id"]) for r in V.violations(df).collect())
    assert got == [("one parent", 3), ("one parent", 4), ("tokens >= 0", 4), ("unique chapter_id", 1), ("version >= 1", 4)]


def test_counts_and_scores(spark):
    text = "The cat sat. " * 40
    df = spark.createDataFrame([(1, text), (2, "Tiny beautiful rhythms?"), (3, "")], "id int, content string")
    got = {r["id"]: r for r in R.with_times(R.with_scores(R.with_counts(df, F.col("content")))).collect()}
    a = got[1]
    assert (a["words"], a["sentences"], a["syllables"], a["polysyllables"], a["letters"]) == (120, 40, 120, 0, 360)
    assert (a["flesch_ease"], a["fk_grade"], a["tier"], a["minutes"]) == (119.2, -2.6, "accessible", 0.4)
    b = got[2]
    assert (b["words"], b["syllables"], b["polysyllables"], b["tier"], b["minutes"], b["too_short"]) == (3, 6, 1, "unknown", 0.0, True)
    assert b["flesch_ease"] is None
    assert (got[3]["words"], got[3]["sentences"], got[3]["syllables"]) == (0, 1, 0)


@pytest.mark.parametrize("ease, tier", [(60.0, "accessible"), (59.9, "moderate"), (40.0, "moderate"), (20.0, "technical"), (19.9, "dense"), (-5.0, "dense")])
def test_tiers(one, ease, tier):
    assert one(R.tier, ease) == tier


def test_bands(one):
    assert one(R.ease_text, 90.0) == "Very easy to read"
    assert one(R.ease_text, 29.9) == "Very difficult to read"
    assert one(R.ease_text, 30.0) == "Difficult to read"
    assert one(R.grade_text, 8.4) == "About 8th grade reading level"
    assert one(R.grade_text, 12.0) == "About 12th grade / high school level"
    assert one(R.grade_text, 17.0) == "Graduate / professional level"
    assert one(R.fog_text, 13.2) == "~13 years of education (college level)"


def analysed(spark, grades, ease=None):
    rows = [("b", i + 1, f"T{i + 1}", g, (ease or grades)[i], "dense", 1.0) for i, g in enumerate(grades)]
    return spark.createDataFrame(rows, "book_id string, chapter_number int, shown_title string, fk_grade double, flesch_ease double, tier string, minutes double")


@pytest.mark.parametrize("grades, want", [
    ([5.0], ""),
    ([5.0, 6.4], "Difficulty stays remarkably consistent throughout."),
    ([1.0, 2.0, 5.0], "Gets progressively harder toward the end. Peaks at Chapter 3 (grade 5.0). easiest at Chapter 1 (grade 1.0)."),
    ([9.0, 2.0, 5.0, 9.0, 2.0, 2.0], "Eases up toward the end. Peaks at Chapter 1 (grade 9.0). easiest at Chapter 2 (grade 2.0)."),
    ([4.0, 9.0, 5.0], "Difficulty varies but stays in a similar range overall. Peaks at Chapter 2 (grade 9.0). easiest at Chapter 1 (grade 4.0)."),
])
def test_trend(spark, grades, want):
    assert RO.difficulty_trend(analysed(spark, grades)).first()["trend"] == want


def test_hardest_easiest_ties(spark):
    r = RO.hardest_easiest(analysed(spark, [1.0] * 4, [10.0, 50.0, 10.0, 50.0])).first()
    assert (r["hardest_chapter_number"], r["easiest_chapter_number"]) == (1, 4)


def test_curve_labels(spark):
    rows = RO.curve_points(analysed(spark, [float(i % 7) for i in range(33)])).collect()
    assert sorted(r["chapter_number"] for r in rows if r["labelled"]) == [1, 6, 11, 16, 21, 26, 31, 33]
    assert {(r["y_min"], r["y_max"]) for r in rows} == {(0.0, 8.0)}


def test_library(spark):
    books = spark.createDataFrame([(1, "Test 1", "Z", 1), (2, "Another", "B", 2), (3, "Three", "A", 3)], "book_id int, title string, author string, created int")

    def order(name):
        return [r["title"] for r in L.sorted_books(books, name).collect()]

    assert sorted(order("title")) == sorted(["Another", "Three", "Test 1"])
    assert order("title") == ["Another", "Test 1", "Three"]
    assert order("newest") == ["Three", "Another", "Test 1"]
    assert order("author") == ["Three", "Another", "Test 1"]


def test_job_rules(one):
    assert one(A.chapter_progress, 3, 7) == 36
    assert one(A.batch_progress, 1, 3) == 33
    assert one(A.resume_reason, "nonfiction", 5, 4) == "only available for fiction books"
    assert one(A.resume_reason, "fiction", 1, 0) == "nothing to summarize yet"
    assert one(A.resume_reason, "fiction", 2, 0) == "no chapters before the target"
    assert one(A.resume_reason, "fiction", 2, 1) is None


def test_batch_outcome(spark):
    import datetime

    d = datetime.date(2024, 1, 1)
    df = spark.createDataFrame([(1, 1, d, "ok"), (2, 1, d, "failed")], "call_id bigint, budget_key bigint, day date, status string")
    r = A.job_lists(df).first()
    assert (r["calls"], r["succeeded"], r["failed"], r["succeeded_ids"], r["failed_ids"]) == (2, 1, 1, "1", "2")


def test_scores_that_are_halves(spark):
    """0.39 * 110 + 11.8 * 308 / 110 - 15.59 is 60.35, in doubles a last bit less."""
    counts = [(110, 1, 308), (120, 1, 276), (250, 1, 700), (110, 1, 307)]
    df = spark.createDataFrame([(*c, 0, 0) for c in counts], "words bigint, sentences bigint, syllables bigint, polysyllables bigint, letters bigint")
    got = {(r.words, r.sentences, r.syllables): r.fk_grade for r in R.with_scores(df).collect()}
    assert got == dict(zip(counts, [60.4, 58.4, 115.0, 60.2], strict=True))


def test_one_section_alone(spark):
    text = "## THE STORY\ns\n---\n## PEOPLE WORTH KNOWING\nAda\n\n## QUOTABLE\nq"
    df = spark.createDataFrame([(1, text), (2, "## THE STORY\nt")], "chapter_id bigint, content string")
    got = A.extract_sections(df, ["people"])
    assert [(r.chapter_id, r.section_order, r.section, r.text) for r in got.collect()] == [(1, 2, "people", "Ada")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "PEOPLE WORTH KNOWING" in plan and "QUOTABLE" not in plan


def test_concat_record(spark):
    """Books of one chapter, of two and without a name; the chapters left out count in numbers alone."""
    rows = [("a", 1, "x"), ("a", 3, "z"), ("b", 4, "w"), (None, 5, "v")]
    extracts = spark.createDataFrame(rows, "book_id string, chapter_id bigint, content string")
    numbers = spark.createDataFrame([(1, 1, "T"), (2, 2, "U"), (3, 3, None), (4, 1, ""), (5, 1, "V")], "chapter_id bigint, chapter_number int, title string")
    got = {r.book_id: (r.part, r.text, r.chapters_included) for r in A.concat_record(extracts, numbers).collect()}
    assert got == {
        "a": (0, "## Chapter 1: T\n\nx\n\n---\n\n## Chapter 3\n\nz", 2),
        "b": (0, "## Chapter 1\n\nw", 1),
        None: (0, "## Chapter 1: V\n\nv", 1),
    }


def test_extraction_concat_cuts_its_texts_once(spark):
    from quire.plans import QUERIES

    plan = QUERIES["extraction_concat"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "PEOPLE WORTH KNOWING" not in plan  # read back as written

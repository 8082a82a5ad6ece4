"""Readability queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import readability as R
from quire.functions.text import MARKDOWN_STRIP, markdown_strip, word_count
from quire.operators import readability as ops
from quire.plans import sqlkit as S
from quire.plans.registry import query
from quire.sources.tables import materialize
from quire.sources.views import chapter_source, chapter_words, main_chapters


def _metrics(spark: SparkSession, root: str) -> DataFrame:
    return ops.chapter_metrics(chapter_source(spark, root))


def _analysed(spark: SparkSession, root: str) -> DataFrame:
    return ops.analysed_chapters(_metrics(spark, root))


def _analysed_table(spark: SparkSession, root: str) -> DataFrame:
    """The analysed chapters as a small written table, for queries that branch on it."""
    return materialize(spark, _analysed(spark, root), "analysed")


@query(
    "markdown_strip",
    f"select doc_id, {S.strip(S.sub('text', MARKDOWN_STRIP))} as body from documents",
)
def markdown_strip_q(spark, root):
    return chapter_source(spark, root).select(
        F.col("chapter_id").alias("doc_id"), markdown_strip(F.col("content")).alias("body")
    )


@query("word_count", f"select doc_id, {S.words('text')} as words from documents")
def word_count_q(spark, root):
    return chapter_source(spark, root).select(
        F.col("chapter_id").alias("doc_id"), word_count(F.col("content")).alias("words")
    )


@query(
    "eligible_chapters",
    S.cte("chapter_words")
    + """select book_id, chapter_number, shown_title, words from chapter_words
    where not is_front_matter and not is_back_matter and words >= 500""",
)
def eligible_chapters(spark, root):
    return (
        main_chapters(chapter_words(spark, root))
        .filter(F.col("words") >= R.MIN_ANALYSED_WORDS)
        .select("book_id", "chapter_number", "shown_title", "words")
    )


@query(
    "text_counts",
    S.cte("counts")
    + "select book_id, chapter_id, words, sentences, syllables, polysyllables, letters from counts",
)
def text_counts(spark, root):
    return R.with_counts(chapter_source(spark, root), F.col("content")).select(
        "book_id", "chapter_id", "words", "sentences", "syllables", "polysyllables", "letters"
    )


def _score_query(name: str, column: str) -> None:
    @query(name, S.cte("scores") + f"select chapter_id, {column} from scores")
    def run(spark, root):
        return R.with_scores(R.with_counts(chapter_source(spark, root), F.col("content"))).select("chapter_id", column)


for _name, _column in [
    ("flesch_ease", "flesch_ease"),
    ("fk_grade", "fk_grade"),
    ("gunning_fog", "gunning_fog"),
    ("smog_index", "smog_index"),
    ("coleman_liau", "coleman_liau"),
    ("difficulty_tier", "tier"),
]:
    _score_query(_name, _column)

_RECORD = (
    "book_id, chapter_number, flesch_ease, fk_grade, gunning_fog, smog_index, coleman_liau, words, sentences, "
    "syllables, tier, minutes, skim_minutes, study_minutes, too_short"
)


@query("chapter_metrics", S.cte("metrics") + f"select {_RECORD} from metrics")
def chapter_metrics(spark, root):
    return _metrics(spark, root).select(*_RECORD.split(", "))


@query(
    "reading_time",
    S.cte("metrics") + "select chapter_id, tier, words, minutes, skim_minutes, study_minutes from metrics",
)
def reading_time(spark, root):
    scored = R.with_times(R.with_scores(R.with_counts(chapter_source(spark, root), F.col("content"))))
    return scored.select("chapter_id", "tier", "words", "minutes", "skim_minutes", "study_minutes")


@query(
    "book_readability",
    S.cte("averages")
    + "select book_id, total_words, flesch_ease, fk_grade, gunning_fog, smog_index, coleman_liau from averages",
)
def book_readability(spark, root):
    return ops.book_averages(_analysed(spark, root)).select("book_id", "total_words", *R.SCORES)


_TIMED = f"""select book_id, total_words, total_sentences, chapters, tier, minutes, round(minutes / 60, 1) as hours,
    round(total_words::double / 350, 1) as skim_minutes, round(total_words::double / 350 / 60, 1) as skim_hours,
    round(total_words::double / 100, 1) as study_minutes, round(total_words::double / 100 / 60, 1) as study_hours
    from (select *, round(total_words::double / {S.wpm_of('tier')}, 1) as minutes
          from (select *, {S.tier_of('flesch_ease')} as tier from averages))"""


@query("book_reading_time", S.cte("averages") + _TIMED)
def book_reading_time(spark, root):
    return ops.book_times(ops.book_averages(_analysed(spark, root))).drop(*R.SCORES)


@query(
    "tier_profile", S.cte("analysed") + "select book_id, tier, count(*) as chapters from analysed group by all"
)
def tier_profile(spark, root):
    return ops.tier_counts(_analysed(spark, root))


_ENDS = ["chapter_number", "shown_title", "flesch_ease", "fk_grade", "tier", "minutes"]


@query(
    "hardest_easiest",
    S.cte("analysed")
    + "select h.book_id, "
    + ", ".join([f"h.{c} as hardest_{c}" for c in _ENDS] + [f"e.{c} as easiest_{c}" for c in _ENDS])
    + """ from (select * from analysed qualify row_number() over (partition by book_id order by flesch_ease, chapter_number) = 1) h
    join (select * from analysed qualify row_number() over (partition by book_id order by flesch_ease desc, chapter_number desc) = 1) e
    using (book_id)""",
)
def hardest_easiest(spark, root):
    return ops.hardest_easiest(_analysed(spark, root))


@query(
    "chapter_curve",
    S.cte("analysed")
    + """select book_id, chapter_number, shown_title, fk_grade, tier, minutes,
    cast(round(minutes / max(minutes) over (partition by book_id) * 100) as int) as minutes_pct, words from analysed""",
)
def chapter_curve(spark, root):
    return ops.chapter_curve(_analysed_table(spark, root)).select(
        "book_id", "chapter_number", "shown_title", "fk_grade", "tier", "minutes", "minutes_pct", "words"
    )


@query(
    "difficulty_trend",
    S.cte("analysed")
    + """, r as (select book_id, chapter_number as c, fk_grade as g, count(*) over (partition by book_id) as n,
      row_number() over (partition by book_id order by chapter_number) as i from analysed),
    b as (select book_id, n, greatest(1, n // 3) as third,
      sum(cast(case when i <= greatest(1, n // 3) then g end as decimal(10,1)))::double as f,
      sum(cast(case when i > n - greatest(1, n // 3) then g end as decimal(10,1)))::double as l,
      arg_max(c, struct_pack(a := g, b := -c)) as pc, max(g) as pg, arg_min(c, struct_pack(a := g, b := c)) as vc, min(g) as vg
      from r group by book_id, n)
    select book_id, n, pc as peak_chapter, vc as valley_chapter, case when n < 2 then ''
      when round(pg - vg, 1) < 1.5 then 'Difficulty stays remarkably consistent throughout.' else
      case when l / third - f / third > 2 then 'Gets progressively harder toward the end'
           when l / third - f / third < -2 then 'Eases up toward the end'
           else 'Difficulty varies but stays in a similar range overall' end
      || '. Peaks at Chapter ' || pc || ' (grade ' || cast(pg as decimal(10,1)) || ')'
      || case when pc <> vc then '. easiest at Chapter ' || vc || ' (grade ' || cast(vg as decimal(10,1)) || ')' else '' end || '.' end as trend
    from b""",
)
def difficulty_trend(spark, root):
    return ops.difficulty_trend(_analysed_table(spark, root))


@query(
    "score_bands",
    S.cte("averages")
    + """select book_id, case when flesch_ease >= 90 then 'Very easy to read' when flesch_ease >= 80 then 'Easy to read'
      when flesch_ease >= 70 then 'Fairly easy to read' when flesch_ease >= 60 then 'Standard / plain English'
      when flesch_ease >= 50 then 'Fairly difficult to read' when flesch_ease >= 30 then 'Difficult to read'
      else 'Very difficult to read' end as ease_text,
    case when round(fk_grade) <= 8 then 'About ' || cast(round(fk_grade) as int) || 'th grade reading level'
      when round(fk_grade) <= 12 then 'About ' || cast(round(fk_grade) as int) || 'th grade / high school level'
      when round(fk_grade) <= 16 then 'College level' else 'Graduate / professional level' end as grade_text,
    '~' || cast(round(gunning_fog) as int) || case when round(gunning_fog) <= 12 then ' years of formal education needed'
      when round(gunning_fog) <= 16 then ' years of education (college level)'
      else ' years of education (post-graduate)' end as fog_text from averages""",
)
def score_bands(spark, root):
    return ops.book_averages(_analysed(spark, root)).select(
        "book_id",
        R.ease_text(F.col("flesch_ease")).alias("ease_text"),
        R.grade_text(F.col("fk_grade")).alias("grade_text"),
        R.fog_text(F.col("gunning_fog")).alias("fog_text"),
    )


@query(
    "tier_benchmark",
    S.cte("averages")
    + "select book_id, tier, b.comparable_to, b.audience from (select book_id, "
    + S.tier_of("flesch_ease")
    + " as tier from averages) join (values "
    + ", ".join(f"('{t}', '{c}', '{a}')" for t, (c, a) in R.BENCHMARKS.items())
    + ") b(tier, comparable_to, audience) using (tier)",
)
def tier_benchmark(spark, root):
    books = ops.book_averages(_analysed(spark, root)).select("book_id", R.tier(F.col("flesch_ease")).alias("tier"))
    return ops.tier_benchmark(books)


@query(
    "readability_missing",
    S.cte("averages", "metrics")
    + """select b.book_id, a.flesch_ease, a.chapters, case when a.book_id is null then
    'No chapters with sufficient content for readability analysis' end as error
    from (select distinct book_id || '-' || lang as book_id from metrics) b
    left join (select book_id || '-' || lang as book_id, count(*) as chapters,
      round(sum(cast(flesch_ease as decimal(10,1)) * words)::double / sum(words)::double, 1) as flesch_ease
      from analysed group by 1) a on a.book_id = b.book_id""",
)
def readability_missing(spark, root):
    """Books cut by language, so that some have no scored chapter."""
    metrics = materialize(spark, _metrics(spark, root), "metrics")
    cut = F.concat_ws("-", "book_id", "lang")
    books = metrics.select(cut.alias("book_id")).distinct()
    averages = ops.book_averages(ops.analysed_chapters(metrics).withColumn("book_id", cut))
    return ops.readability_or_error(books, averages).select("book_id", "flesch_ease", "chapters", "error")


@query(
    "curve_points",
    S.cte("analysed")
    + """, r as (select book_id, chapter_number, fk_grade as g, count(*) over w as n, min(fk_grade) over w as low,
      max(fk_grade) over w as high, row_number() over (partition by book_id order by chapter_number) as i
      from analysed window w as (partition by book_id)),
    m as (select *, greatest(0.0::double, floor(low / 2) * 2 - 2) as y_min from r where n >= 2),
    x as (select *, floor((greatest(high + 2, y_min + 6) + 1) / 2) * 2 as y_max from m)
    select book_id, chapter_number, y_min, y_max, round(50 + (i - 1)::double / (n - 1) * 630, 4) as x,
      round(20 + (1 - (g - y_min) / (y_max - y_min)) * 220, 4) as y,
      ((i - 1) % (case when n > 30 then 5 when n > 15 then 2 else 1 end) = 0 or i = n) as labelled from x""",
)
def curve_points(spark, root):
    return ops.curve_points(_analysed_table(spark, root))


@query(
    "tier_bars",
    S.cte("analysed")
    + """, c as (select b.book_id, t.position, t.tier, count(a.chapter_id) as chapters
      from (select distinct book_id from analysed) b
      cross join (values (0, 'accessible'), (1, 'moderate'), (2, 'technical'), (3, 'dense')) t(position, tier)
      left join analysed a on a.book_id = b.book_id and a.tier = t.tier group by all)
    select book_id, position, tier, chapters,
      round(chapters::double / greatest(max(chapters) over (partition by book_id), 1) * 260, 4) as width, 10 + position * 40 as y from c""",
)
def tier_bars(spark, root):
    return ops.tier_bars(_analysed(spark, root))

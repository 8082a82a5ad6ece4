"""Readability per chapter and per book.

The text is counted and dropped in the scan stage; everything after that moves a few
numbers per chapter. Book-level values are aggregates joined back, never a window over
a whole book.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import readability as R
from quire.functions.rounding import rounded
from quire.functions.text import title_or_default
from quire.operators.scale import with_totals, with_rank
from quire.sources.views import main_chapters, number_chapters, with_flags


def chapter_metrics(chapters: DataFrame) -> DataFrame:
    """Counts, scores, tier and times for rows of (book_id, chapter_id, content)."""
    counted = R.with_counts(chapters, F.col("content"))
    scored = R.with_times(R.with_scores(counted.drop("content")))
    return with_flags(number_chapters(scored)).withColumn(
        "shown_title", title_or_default(F.col("title"), F.col("chapter_number"))
    )


def analysed_chapters(metrics: DataFrame) -> DataFrame:
    """Main chapters of at least 500 words that have scores."""
    return main_chapters(metrics).filter((F.col("raw_words") >= R.MIN_ANALYSED_WORDS) & ~F.col("too_short"))


def book_averages(analysed: DataFrame) -> DataFrame:
    """Scores weighted by words, over the already rounded chapter scores; sums are exact decimals."""
    w = F.sum("words")

    def weighted(score: str):
        total = F.sum(F.col(score).cast("decimal(10,1)") * F.col("words"))
        return rounded(total.cast("double") / w.cast("double"), 1).alias(score)

    return analysed.groupBy("book_id").agg(
        w.alias("total_words"),
        F.sum("sentences").alias("total_sentences"),
        F.count("*").alias("chapters"),
        *[weighted(s) for s in R.SCORES],
    )


def book_times(averages: DataFrame) -> DataFrame:
    """Tier and reading times of a book; hours come from the rounded minutes, skim and study from words."""
    words = F.col("total_words")
    speed = R.by_tier(F.col("tier"), {n: F.lit(v) for n, _, v in R.TIERS})
    raw = words.cast("double")
    return (
        averages.withColumn("tier", R.tier(F.col("flesch_ease")))
        .withColumn("minutes", R.minutes(words, speed))
        .withColumn("hours", rounded(F.col("minutes") / 60, 1))
        .withColumn("skim_minutes", R.minutes(words, F.lit(R.SKIM_WPM)))
        .withColumn("skim_hours", rounded(raw / R.SKIM_WPM / 60, 1))
        .withColumn("study_minutes", R.minutes(words, F.lit(R.STUDY_WPM)))
        .withColumn("study_hours", rounded(raw / R.STUDY_WPM / 60, 1))
    )


def tier_counts(analysed: DataFrame) -> DataFrame:
    return analysed.groupBy("book_id", "tier").agg(F.count("*").alias("chapters"))


def hardest_easiest(analysed: DataFrame) -> DataFrame:
    """Hardest is the first chapter on ties, easiest the last one."""
    row = F.struct("chapter_number", "shown_title", "flesch_ease", "fk_grade", "tier", "minutes")
    key = F.struct("flesch_ease", "chapter_number")
    best = analysed.groupBy("book_id").agg(F.min_by(row, key).alias("h"), F.max_by(row, key).alias("e"))
    cols = ["chapter_number", "shown_title", "flesch_ease", "fk_grade", "tier", "minutes"]
    return best.select(
        "book_id",
        *[F.col(f"h.{c}").alias(f"hardest_{c}") for c in cols],
        *[F.col(f"e.{c}").alias(f"easiest_{c}") for c in cols],
    )


def chapter_curve(analysed: DataFrame) -> DataFrame:
    """Each chapter's reading time as a whole percent of the longest one in the book."""
    rows = with_totals(analysed, ["book_id"], "chapter_number", {"max_minutes": ("max", "minutes")})
    pct = F.when(
        F.col("max_minutes") > 0, F.round(F.col("minutes") / F.col("max_minutes") * 100).cast("int")
    ).otherwise(0)
    return rows.withColumn("minutes_pct", pct)


def difficulty_trend(analysed: DataFrame) -> DataFrame:
    """Trend text of a book from its grade sequence."""
    small = analysed.select("book_id", "chapter_number", "fk_grade")
    ranked = with_rank(small, ["book_id"], "chapter_number", "i")
    rows = with_totals(ranked, ["book_id"], "chapter_number", {"n": ("sum", F.lit(1))})
    third = F.greatest(F.lit(1), F.floor(F.col("n") / 3))
    exact = F.col("fk_grade").cast("decimal(10,1)")
    grade, number = F.col("fk_grade"), F.col("chapter_number")
    book = rows.groupBy("book_id").agg(
        F.max("n").alias("n"),
        F.sum(F.when(F.col("i") <= third, exact)).cast("double").alias("first_sum"),
        F.sum(F.when(F.col("i") > F.col("n") - third, exact)).cast("double").alias("last_sum"),
        F.max_by(F.struct(number, grade), F.struct(grade, -number)).alias("peak"),
        F.min_by(F.struct(number, grade), F.struct(grade, number)).alias("valley"),
    )
    third = F.greatest(F.lit(1), F.floor(F.col("n") / 3))
    diff = F.col("last_sum") / third - F.col("first_sum") / third

    def at(label: str, c: str):
        return F.concat(
            F.lit(label), F.col(f"{c}.chapter_number").cast("string"), F.lit(" (grade "),
            F.col(f"{c}.fk_grade").cast("decimal(10,1)").cast("string"), F.lit(")"),
        )

    spread = rounded(F.col("peak.fk_grade") - F.col("valley.fk_grade"), 1)
    moving = F.concat_ws(
        ". ",
        F.when(diff > 2, "Gets progressively harder toward the end")
        .when(diff < -2, "Eases up toward the end")
        .otherwise("Difficulty varies but stays in a similar range overall"),
        at("Peaks at Chapter ", "peak"),
        F.when(F.col("peak.chapter_number") != F.col("valley.chapter_number"), at("easiest at Chapter ", "valley")),
    )
    text = (
        F.when(F.col("n") < 2, "")
        .when(spread < 1.5, "Difficulty stays remarkably consistent throughout.")
        .otherwise(F.concat(moving, F.lit(".")))
    )
    return book.select(
        "book_id", "n", F.col("peak.chapter_number").alias("peak_chapter"),
        F.col("valley.chapter_number").alias("valley_chapter"), text.alias("trend"),
    )


def curve_points(analysed: DataFrame) -> DataFrame:
    """Chart positions of the grade curve for books with two or more chapters."""
    # fixed values: plot area 630 x 220 at offset (50, 20)
    left, top, width, height = 50, 20, 630, 220
    small = analysed.select("book_id", "chapter_number", "fk_grade", "tier")
    ranked = with_rank(small, ["book_id"], "chapter_number", "i")
    rows = with_totals(
        ranked,
        ["book_id"],
        "chapter_number",
        {"n": ("sum", F.lit(1)), "low": ("min", "fk_grade"), "high": ("max", "fk_grade")},
    ).filter(F.col("n") >= 2)
    n, idx = F.col("n"), F.col("i") - 1
    y_min = F.greatest(F.lit(0.0), F.floor(F.col("low") / 2) * 2 - 2.0)
    y_max = F.floor((F.greatest(F.col("high") + 2, F.col("y_min") + 6) + 1) / 2) * 2.0
    skip = F.when(n > 30, 5).when(n > 15, 2).otherwise(1)
    return (
        rows.withColumn("y_min", y_min)
        .withColumn("y_max", y_max)
        .select(
            "book_id",
            "chapter_number",
            "y_min",
            "y_max",
            rounded(left + idx / (n - 1) * width, 4).alias("x"),
            rounded(
                top + (1 - (F.col("fk_grade") - F.col("y_min")) / (F.col("y_max") - F.col("y_min"))) * height, 4
            ).alias("y"),
            ((idx % skip == 0) | (F.col("i") == n)).alias("labelled"),
        )
    )


def tier_bars(analysed: DataFrame) -> DataFrame:
    """All four tiers of each book, zero-filled, with bar length relative to the largest count."""
    counts = analysed.groupBy("book_id").agg(
        *[F.count_if(F.col("tier") == t).alias(t) for t, _, _ in R.TIERS]
    )
    names = [t for t, _, _ in R.TIERS]
    bars = counts.withColumn("largest", F.greatest(*names)).select(
        "book_id",
        "largest",
        F.posexplode(
            F.array(*[F.struct(F.lit(t).alias("tier"), F.col(t).alias("chapters")) for t in names])
        ).alias("position", "bar"),
    )
    # fixed values: bars of up to 260, rows of 40 from 10
    return bars.select(
        "book_id",
        "position",
        "bar.tier",
        "bar.chapters",
        rounded(F.col("bar.chapters") / F.greatest(F.col("largest"), F.lit(1)) * 260, 4).alias("width"),
        (10 + F.col("position") * 40).alias("y"),
    )


def tier_benchmark(books: DataFrame) -> DataFrame:
    """Comparable texts and audience for the book's tier (a fixed table of four rows)."""
    return books.select(
        "*",
        R.by_tier(F.col("tier"), {t: F.lit(v[0]) for t, v in R.BENCHMARKS.items()}).alias("comparable_to"),
        R.by_tier(F.col("tier"), {t: F.lit(v[1]) for t, v in R.BENCHMARKS.items()}).alias("audience"),
    )


def readability_or_error(books: DataFrame, averages: DataFrame) -> DataFrame:
    """Every book; those without scored chapters carry an error and no scores."""
    return books.join(averages, "book_id", "left").withColumn(
        "error",
        F.when(
            F.col("chapters").isNull(), "No chapters with sufficient content for readability analysis"
        ),
    )

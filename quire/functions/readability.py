"""Readability counts and scores.

Count rule: lower-case, split on white space; syllables of a word = runs of vowels, at
least 1; a polysyllable has 3 or more runs; sentences = runs of [.!?], at least 1.
Runs never cross white space, so all counts are pattern counts over the whole text and
no word array is built.

Formulas: Flesch 1948; Kincaid et al. 1975; Gunning 1952; McLaughlin 1969; Coleman and
Liau 1975.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.regex import count_matches, strip, substitute
from quire.functions.rounding import rounded
from quire.functions.text import is_marked, strip_marks, word_count

# Fixed values.
VOWELS = "aeiouyàáâãäåæèéêëìíîïòóôõöøœùúûüýÿ"
MIN_SCORED_WORDS = 100
MIN_ANALYSED_WORDS = 500
TIERS = [("accessible", 60, 275), ("moderate", 40, 200), ("technical", 20, 100), ("dense", None, 60)]
SKIM_WPM, STUDY_WPM = 350, 100
BENCHMARKS = {
    "accessible": (
        "Popular fiction, USA Today, most blog posts",
        "General audience, no specialized knowledge needed",
    ),
    "moderate": (
        "The Economist, Harvard Business Review, popular nonfiction",
        "Educated general readers",
    ),
    "technical": (
        "Academic papers, legal documents, scientific journals",
        "Subject-matter professionals, graduate-level readers",
    ),
    "dense": (
        "Philosophy texts, advanced mathematics, medical literature",
        "Domain experts, requires significant background knowledge",
    ),
}
SCORES = ["flesch_ease", "fk_grade", "gunning_fog", "smog_index", "coleman_liau"]


def with_counts(df: DataFrame, text: Column) -> DataFrame:
    """Add raw_words, and words, sentences, syllables, polysyllables, letters of the stripped text.

    Plain prose, found by one pattern, skips the Markdown chain, and its raw words are its
    words. Words are reduced to their shape, 'a' for a vowel run and 'b' for the rest, so
    most counts run over short text without backtracking.
    """
    t, shape, marked = F.col("__text"), F.col("__shape"), F.col("__marked")
    vowel_runs = F.length(shape) - F.length(F.replace(shape, F.lit("a"), F.lit("")))
    return (
        df.withColumn("__marked", F.coalesce(is_marked(text), F.lit(False)))
        .withColumn("__text", strip(F.when(marked, strip_marks(text)).otherwise(text)))
        .withColumn("__shape", substitute(F.lower("__text"), [(f"[{VOWELS}]+", "a"), (r"[^a\s]+", "b")]))
        .withColumn("words", count_matches(shape, "[ab]+"))
        .withColumn("sentences", F.greatest(F.lit(1), count_matches(t, r"[.!?]+")))
        .withColumn("syllables", (vowel_runs + count_matches(shape, r"(?<!\S)b(?!\S)")).cast("bigint"))
        .withColumn("polysyllables", count_matches(shape, r"ababa[ab]*"))
        .withColumn("letters", F.length(F.regexp_replace(t, r"\P{L}+", "")))
        .withColumn("raw_words", F.when(marked, word_count(text)).otherwise(F.col("words")))
        .drop("__text", "__shape", "__marked")
    )


def _scored(value: Column) -> Column:
    return F.when(F.col("words") >= MIN_SCORED_WORDS, rounded(value, 1))


def with_scores(df: DataFrame) -> DataFrame:
    """Add the five scores (rounded to 1 place, null for short texts) and the tier."""
    w, s = F.col("words").cast("double"), F.col("sentences").cast("double")
    syl, poly, let = F.col("syllables"), F.col("polysyllables"), F.col("letters")
    ease = 206.835 - 1.015 * (w / s) - 84.6 * (syl / w)
    return df.select(
        "*",
        _scored(ease).alias("flesch_ease"),
        _scored(0.39 * (w / s) + 11.8 * (syl / w) - 15.59).alias("fk_grade"),
        _scored(0.4 * (w / s + 100.0 * (poly / w))).alias("gunning_fog"),
        _scored(1.0430 * F.sqrt(30.0 * (poly / s)) + 3.1291).alias("smog_index"),
        _scored(5.88 * (let / w) - 29.6 * (s / w) - 15.8).alias("coleman_liau"),
        F.when(F.col("words") < MIN_SCORED_WORDS, "unknown").otherwise(tier(ease)).alias("tier"),
    )


def tier(ease: Column) -> Column:
    out = None
    for name, low, _ in TIERS:
        if low is None:
            return out.otherwise(name)
        out = F.when(ease >= low, name) if out is None else out.when(ease >= low, name)
    return out


def by_tier(tier_col: Column, values: dict[str, Column | int | str]) -> Column:
    """Value per tier; unknown tiers take the moderate one."""
    out = None
    for name, value in values.items():
        out = F.when(tier_col == name, value) if out is None else out.when(tier_col == name, value)
    return out.otherwise(values["moderate"])


def minutes(words: Column, wpm: Column) -> Column:
    return rounded(words.cast("double") / wpm, 1)


def with_times(df: DataFrame) -> DataFrame:
    """Add reading, skim and study minutes; 0 for texts that are too short."""
    wpm = by_tier(F.col("tier"), {n: F.lit(v) for n, _, v in TIERS})
    short = F.col("words") < MIN_SCORED_WORDS

    def guarded(speed: Column) -> Column:
        return F.when(short, F.lit(0.0)).otherwise(minutes(F.col("words"), speed))

    return df.select(
        "*",
        guarded(wpm).alias("minutes"),
        guarded(F.lit(SKIM_WPM)).alias("skim_minutes"),
        guarded(F.lit(STUDY_WPM)).alias("study_minutes"),
        short.alias("too_short"),
    )


def ease_text(v: Column) -> Column:
    return (
        F.when(v >= 90, "Very easy to read")
        .when(v >= 80, "Easy to read")
        .when(v >= 70, "Fairly easy to read")
        .when(v >= 60, "Standard / plain English")
        .when(v >= 50, "Fairly difficult to read")
        .when(v >= 30, "Difficult to read")
        .when(v.isNull(), "")
        .otherwise("Very difficult to read")
    )


def grade_text(v: Column) -> Column:
    g = F.round(v).cast("int")
    return (
        F.when(v.isNull(), "")
        .when(g <= 8, F.concat(F.lit("About "), g.cast("string"), F.lit("th grade reading level")))
        .when(g <= 12, F.concat(F.lit("About "), g.cast("string"), F.lit("th grade / high school level")))
        .when(g <= 16, "College level")
        .otherwise("Graduate / professional level")
    )


def fog_text(v: Column) -> Column:
    y = F.round(v).cast("int")
    tail = (
        F.when(y <= 12, " years of formal education needed")
        .when(y <= 16, " years of education (college level)")
        .otherwise(" years of education (post-graduate)")
    )
    return F.when(v.isNull(), "").otherwise(F.concat(F.lit("~"), y.cast("string"), tail))

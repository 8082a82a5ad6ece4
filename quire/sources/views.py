"""The library's tables as views over the input tables.

documents -> chapters of books, events -> the call ledger, conversations ->
result versions, and so on. Each view is plain columns over one scan; only
``chapters`` needs an ordering, done with the bucketed rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import title_or_default, word_count
from quire.functions.titles import is_back_matter, is_front_matter
from quire.operators.scale import with_rank
from quire.operators.segments import outline_entries
from quire.sources.tables import read_table, text_table

AS_OF = "2024-01-30"
# an id of (item, turn); no item has so many turns
TURNS_PER_ITEM = 1_000_000_000


def book_number(book_id: Column) -> Column:
    """Digits at the end of the book key, 0 when there are none."""
    return F.coalesce(F.expr("try_cast(substr(book_id, 4) as int)"), F.lit(0))


def number_chapters(df: DataFrame) -> DataFrame:
    """Add chapter_number, book_type and title to rows holding book_id and chapter_id.

    Callers compute what they need from the text first and drop it, so only small
    columns travel through the shuffle.
    """
    n = F.col("chapter_number")
    return (
        with_rank(df, ["book_id"], "chapter_id", "chapter_number")
        .withColumn(
            "book_type",
            F.when(book_number(F.col("book_id")) % 2 == 0, "nonfiction").otherwise("fiction"),
        )
        .withColumn(
            "title",
            F.when(n == 1, "Table of Contents")
            .when(n == 2, "Preface")
            .when(n % 17 == 0, "Appendix")
            .when(n % 13 == 0, F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit("Part "), n.cast("string"))),
        )
    )


def chapter_source(spark: SparkSession, root: str) -> DataFrame:
    return text_table(spark, root, "documents", "doc_id").select(
        F.col("source").alias("book_id"), F.col("doc_id").alias("chapter_id"), F.col("text").alias("content"), "lang"
    )


def with_flags(df: DataFrame) -> DataFrame:
    return df.withColumn("is_front_matter", is_front_matter(F.col("title"))).withColumn(
        "is_back_matter", is_back_matter(F.col("title"))
    )


def chapters(spark: SparkSession, root: str) -> DataFrame:
    """Chapters with their full text."""
    return with_flags(number_chapters(chapter_source(spark, root)))


def chapter_words(spark: SparkSession, root: str) -> DataFrame:
    """Chapters with word and character counts instead of the text."""
    src = chapter_source(spark, root)
    small = src.select(
        "book_id",
        "chapter_id",
        "lang",
        word_count(F.col("content")).alias("words"),
        F.length("content").alias("chars"),
    )
    return with_flags(number_chapters(small)).withColumn(
        "shown_title", title_or_default(F.col("title"), F.col("chapter_number"))
    )


def main_chapters(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("is_front_matter") & ~F.col("is_back_matter"))


def book_pages(spark: SparkSession, root: str) -> DataFrame:
    """Page texts of scanned books: page numbers are positions; every 6th and 11th page opens a heading."""
    n = F.col("chapter_number")
    pages = with_rank(chapter_source(spark, root), ["book_id"], "chapter_id", "chapter_number")
    head = (
        F.when(n % 6 == 1, F.concat(F.lit("Chapter "), n.cast("string")))
        .when(n % 11 == 3, F.lit("PART IV the turn"))
        .when(n % 11 == 5, F.concat(n.cast("string"), F.lit(". Notes")))
        .otherwise(F.lit("plain opening line"))
    )
    two = F.when(n % 18 == 1, F.lit("\nSection 2 again")).otherwise(F.lit(""))
    return pages.select(
        "book_id",
        F.col("chapter_id").alias("page_id"),
        n.alias("page"),
        F.when(n % 10 == 0, F.lit("  ")).otherwise(F.concat(head, two, F.lit("\n"), F.col("content"))).alias("text"),
    )


def outlines(spark: SparkSession, root: str) -> DataFrame:
    """Nested outlines by page. In even books every 7th page opens a part, with a mark three
    pages on inside it and a note inside the mark; every third part names a page before its last
    mark's. In odd books there are marks alone, every second of them on the page of the one
    before. None in every third book."""
    num = book_number(F.col("book_id"))
    p = F.col("page")
    pages = with_rank(
        chapter_source(spark, root).drop("content", "lang"), ["book_id"], "chapter_id", "page"
    ).filter(num % 3 != 2)
    even = num % 2 == 0
    kind = F.when((p % 7 == 1) & even, "part").when(p % 7 == 4, "mark").when((p % 7 == 5) & even, "note")
    part = p - (p - 1) % 7
    return pages.withColumn("kind", kind).filter(F.col("kind").isNotNull()).select(
        "book_id",
        p.alias("entry_id"),
        F.when(F.col("kind") == "mark", F.when(even, part)).when(F.col("kind") == "note", p - 1).alias("parent_id"),
        p.alias("child_no"),
        F.concat(F.lit("Mark "), p.cast("string")).alias("title"),
        F.when(even & (p % 21 == 1) & (p > 1), p - 4).when(~even & (p % 14 == 4) & (p > 4), p - 7).otherwise(p).alias("page"),
    )


def bookmarks(spark: SparkSession, root: str) -> DataFrame:
    """The outlines, flat; entries of odd books are all below the top level."""
    num = book_number(F.col("book_id"))
    return outline_entries(outlines(spark, root)).withColumn("level", F.col("level") + F.when(num % 2 == 0, 0).otherwise(1))


def calls(spark: SparkSession, root: str) -> DataFrame:
    """The ledger of model calls."""
    return as_calls(read_table(spark, root, "events"))


def as_calls(events: DataFrame) -> DataFrame:
    """Ledger rows of events; the same for a batch and for a stream."""
    v = F.col("value")
    return events.select(
        F.col("event_id").alias("call_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.to_date("ts").alias("day"),
        F.col("user_id").alias("budget_key"),
        F.when(F.col("event_type").isin("purchase", "signup"), "large").otherwise("small").alias("model"),
        F.floor(v * 100).cast("bigint").alias("input_tokens"),
        F.least(F.floor(v * 10).cast("bigint"), F.lit(2000)).alias("output_tokens"),
        F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"),
    )


def versions(spark: SparkSession, root: str) -> DataFrame:
    """Every generated result, numbered per (item, prompt); payloads come in three shapes."""
    src = read_table(spark, root, "conversations").select(
        F.col("conv_id").alias("item_id"), F.col("role").alias("prompt_name"), "turn", F.length("text").alias("tokens")
    )
    ranked = with_rank(src, ["item_id", "prompt_name"], "turn", "version")
    body = F.concat(
        F.lit("v"), F.col("item_id").cast("string"), F.lit("-"), F.col("turn").cast("string")
    )
    sid = F.col("item_id") * TURNS_PER_ITEM + F.col("turn")
    return ranked.select(
        sid.alias("summary_id"),
        "item_id",
        "prompt_name",
        "version",
        "turn",
        "tokens",
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit('{"text":"'), body, F.lit('"}')))
        .when(F.col("turn") % 3 == 1, F.concat(F.lit('{"content":"'), body, F.lit('"}')))
        .otherwise(F.concat(F.lit('{"text":{"text":"'), body, F.lit('"}}')))
        .alias("payload"),
        (F.lit(1704067200) + sid % 100003 * 7919 % 100003).alias("created_s"),
    )


def responses(spark: SparkSession, root: str) -> DataFrame:
    """Rating responses: json fence, plain fence, bare braces, none, broken."""
    d = F.col("doc_id")
    j = F.concat(
        F.lit('{"insight":'),
        (1 + d * 7 % 10).cast("string"),
        F.when(d % 6 == 0, "").otherwise(F.concat(F.lit(',"clarity":'), (1 + d * 3 % 10).cast("string"))),
        F.lit(',"overall":'),
        (1 + d % 10).cast("string"),
        F.lit(',"one_line_verdict":"verdict '),
        d.cast("string"),
        F.lit('"}'),
    )
    return read_table(spark, root, "documents").select(
        d.alias("chapter_id"),
        F.col("source").alias("book_id"),
        F.when(d % 5 == 0, F.concat(F.lit("Here:\n```json\n"), j, F.lit("\n```")))
        .when(d % 5 == 1, F.concat(F.lit("```\n"), j, F.lit("\n```\nend")))
        .when(d % 5 == 2, F.concat(F.lit("Rating "), j, F.lit(" done")))
        .when(d % 5 == 3, F.lit("no rating given"))
        .otherwise(F.concat(F.lit("{broken "), j))
        .alias("response"),
    )


def section_texts(spark: SparkSession, root: str) -> DataFrame:
    """Extraction responses: five headed sections filled with the document's own text."""
    d, t = F.col("doc_id"), F.col("text")
    skip = F.when(d % 4 == 0, "No standout advice here").when(d % 4 == 1, "skip this").otherwise(F.reverse(t))
    return text_table(spark, root, "documents", "doc_id").select(
        d.alias("chapter_id"),
        F.col("source").alias("book_id"),
        F.concat(
            F.lit("## THE STORY\n"), t, F.lit("\n---\n"),
            F.lit("## The Advice\n\n"), skip, F.lit("\n"),
            F.when(d % 3 == 0, "").otherwise(F.concat(F.lit("## PEOPLE WORTH KNOWING\n"), F.col("lang"), F.lit(" "), t, F.lit("\n\n"))),
            F.lit("## THE SURPRISE\n  \n---\n"),
            F.lit("## QUOTABLE\n> "), t,
        ).alias("content"),
    )


def jobs(spark: SparkSession, root: str) -> DataFrame:
    """One job per budget key and day: its calls, done and failed counts."""
    return (
        calls(spark, root)
        .groupBy("budget_key", "day")
        .agg(
            F.count("*").alias("total"),
            F.count_if(F.col("status") == "ok").alias("done"),
            F.count_if(F.col("status") == "failed").alias("failed"),
        )
    )


PREFIXES = ["extract", "rate", "summarize", "create", "analyze", "explain", "aggregate", "misc"]


def prompt_files(spark: SparkSession, root: str) -> DataFrame:
    """Prompt files: path and whole content, most with a header block; some unreadable."""
    d = F.col("doc_id")
    prefix = F.element_at(F.array(*[F.lit(p) for p in PREFIXES]), (d % 8 + 1).cast("int"))
    stem = F.concat(prefix, F.lit("_doc_"), d.cast("string"))
    header = F.concat(
        F.lit("---\n"),
        F.when(d % 3 == 0, F.concat(F.lit("name: "), stem, F.lit("_named\n"))).otherwise(""),
        F.when(d % 7 == 0, "category: aggregation\n").otherwise(""),
        F.when(d % 2 == 0, "default_model: large\n").otherwise("default_model:   small\n"),
        F.when(d % 5 == 1, "variables: [content, title]\n").otherwise(""),
        F.lit("---\n"),
    )
    body = F.concat(
        F.lit("# Task for {title}\n"), F.when(d % 4 == 0, "").otherwise("Read: {content}\n"), F.col("text"), F.lit("\n")
    )
    return text_table(spark, root, "documents", "doc_id").select(
        d.alias("file_id"),
        F.concat(F.lit("prompts/"), stem, F.lit(".md")).alias("path"),
        F.when(d % 50 == 7, F.lit(None).cast("string"))
        .when(d % 5 == 0, body)
        .otherwise(F.concat(header, body))
        .alias("content"),
    )

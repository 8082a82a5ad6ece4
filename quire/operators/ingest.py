"""Admission, metadata and status of incoming documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
MAX_BYTES = 52428800
EXTENSIONS = [".epub", ".pdf"]
CONTENT_TYPES = ["application/epub+zip", "application/pdf", "application/zip", "application/octet-stream"]
GATE_PAGES, GATE_CHARS = 5, 100


def admission(name: Column, size: Column, content_type: Column) -> Column:
    """First failing check of an upload, null when it is admitted."""
    n = F.lower(name)
    known = n.endswith(EXTENSIONS[0]) | n.endswith(EXTENSIONS[1])
    return (
        F.when(F.coalesce(name, F.lit("")) == "", "No file was uploaded.")
        .when(~known, "Invalid file extension. Please upload an .epub or .pdf file.")
        .when(size > MAX_BYTES, "File size exceeds 50MB limit. Please upload a smaller file.")
        .when(
            (F.coalesce(content_type, F.lit("")) != "") & ~content_type.isin(CONTENT_TYPES),
            F.concat(F.lit("Invalid file type. Expected EPUB or PDF file, got "), content_type, F.lit(".")),
        )
    )


def text_gate(first_pages: DataFrame) -> DataFrame:
    """More than 100 trimmed characters a page over the first pages, else it is a scan.

    ``first_pages`` holds trimmed lengths, not texts."""
    return (
        first_pages.groupBy("book_id")
        .agg(F.count("*").alias("checked"), F.sum("chars").alias("chars"))
        .withColumn("has_text", F.col("chars") > F.col("checked") * GATE_CHARS)
    )


def metadata(raw: DataFrame) -> DataFrame:
    """Defaults for missing fields; creators joined; first ISBN; dates cut to eight digits."""

    def given(c: str, default: str) -> Column:
        return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default)).alias(c)

    isbn = F.try_element_at(
        F.filter("identifiers", lambda i: F.contains(F.lower(i["scheme"]), F.lit("isbn"))), F.lit(1)
    )["value"]
    date = F.when(F.col("date").startswith("D:"), F.substring("date", 3, 8)).otherwise(F.col("date"))
    authors = F.nullif(F.array_join("creators", ", "), F.lit(""))
    return raw.select(
        "id",
        given("title", "Untitled"),
        F.coalesce(authors, F.lit("Unknown Author")).alias("author"),
        given("language", "en"),
        F.coalesce(isbn, F.lit("")).alias("isbn"),
        date.alias("date"),
    )


def ingest_status(chapters: DataFrame) -> DataFrame:
    """One row per book (completed, or failed with the reason) and one per warning.

    ``chapters`` has book_id, chapter_id and ``problem``, null where the chapter is fine.
    """
    bad = F.col("problem").isNotNull()
    books = chapters.groupBy("book_id").agg(F.count_if(~bad).alias("good"), F.count_if(bad).alias("warnings"))
    none = F.col("good") == 0
    book_rows = books.select(
        "book_id",
        F.lit("book").alias("kind"),
        F.lit(None).cast("bigint").alias("chapter_id"),
        F.when(none, "failed").otherwise("completed").alias("status"),
        F.when(none, "No chapters found").alias("message"),
        "warnings",
    )
    warnings = chapters.filter(bad).select(
        "book_id",
        F.lit("warning").alias("kind"),
        "chapter_id",
        F.lit(None).cast("string").alias("status"),
        F.concat(
            F.lit("Failed to extract chapter '"), F.col("chapter_id").cast("string"), F.lit("': "), F.col("problem")
        ).alias("message"),
        F.lit(None).cast("bigint").alias("warnings"),
    )
    return book_rows.unionByName(warnings)


def without_chapters(books: DataFrame, chapters: DataFrame, key: str) -> DataFrame:
    return books.join(chapters.select(key), key, "left_anti").withColumn("reason", F.lit("No chapters found"))

"""Library listing, navigation, search, and maintenance rewrites."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.scale import with_neighbors, with_totals
from quire.sources.views import main_chapters

ORDERS = {
    "newest": [F.desc, "created"],
    "oldest": [F.asc, "created"],
    "title": [F.asc, "title"],
    "title_desc": [F.desc, "title"],
    "author": [F.asc, "author", "title"],
}


def of_type(books: DataFrame, book_type: str | None) -> DataFrame:
    """Books of a type (all without one), each with the number of books in the list."""
    rows = books if book_type is None else books.filter(F.col("book_type") == book_type)
    return with_totals(rows, ["book_type"], "created", {"of_type": ("sum", F.lit(1))})


def sorted_books(books: DataFrame, order: str) -> DataFrame:
    direction, *cols = ORDERS[order]
    return books.orderBy(*[direction(c) for c in cols], "book_id")


def main_with_count(chapters: DataFrame) -> DataFrame:
    return with_totals(
        main_chapters(chapters), ["book_id"], "chapter_number", {"main_chapters": ("sum", F.lit(1))}
    )


def navigation(chapters: DataFrame) -> DataFrame:
    """Previous and next main chapter of a chapter."""
    main = main_chapters(chapters).select("book_id", "chapter_number", "title")
    return with_neighbors(
        main, ["book_id"], "chapter_number",
        prev={"previous_chapter": "chapter_number"}, next={"next_chapter": "chapter_number"},
    )


def any_contains(columns: list[str], text: str) -> Column:
    """Case-insensitive 'contains' over several columns."""
    hits = [F.contains(F.lower(F.col(c)), F.lit(text.lower())) for c in columns]
    return reduce(lambda a, b: a | b, [F.coalesce(h, F.lit(False)) for h in hits])


def without_books(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Tables after books are deleted: every table that carries book_id loses their rows."""
    return {name: df.join(gone, "book_id", "left_anti") for name, df in tables.items()}


def without_prompts(summaries: DataFrame, gone: DataFrame) -> DataFrame:
    """Summaries stay when their prompt is deleted; the key becomes null."""
    marked = gone.select(F.col("prompt_name"), F.lit(True).alias("__gone"))
    return summaries.join(marked, "prompt_name", "left").withColumn(
        "prompt_name", F.when(F.col("__gone").isNull(), F.col("prompt_name"))
    ).drop("__gone")

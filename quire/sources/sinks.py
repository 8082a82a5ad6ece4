"""Table and report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 64


def write_by_book(df: DataFrame, path: str, order: str, rows_per_task: int = 65536) -> None:
    """Write rows in one folder per hash bucket of books.

    The shuffle key adds a block of the order key, so a book that holds a third of all
    rows is written by many tasks; a folder per book would mean millions of folders.
    """
    bucket = F.pmod(F.xxhash64("book_id"), F.lit(BUCKETS)).cast("int")
    (
        df.withColumn("book_bucket", bucket)
        .repartition("book_id", F.floor(F.col(order) / rows_per_task))
        .sortWithinPartitions("book_bucket", "book_id", order)
        .write.mode("overwrite")
        .partitionBy("book_bucket")
        .parquet(path)
    )


def write_reports(sections: DataFrame, path: str) -> None:
    """Report sections as JSON lines, in order inside each file; same placement rule."""
    (
        sections.withColumn("book_bucket", F.pmod(F.xxhash64("book_id"), F.lit(BUCKETS)).cast("int"))
        .repartition("book_id", F.floor(F.col("item_no") / 65536))
        .sortWithinPartitions("book_bucket", "book_id", "section_order", "item_no")
        .write.mode("overwrite")
        .partitionBy("book_bucket")
        .json(path)
    )

"""Batch and streaming readers of the input tables, and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from quire.schemas import TABLES


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}.parquet")


#: Session setting: deal texts to so many tasks by key. For inputs of few files and row groups;
#: without it, which is the default, texts are never shuffled on reading, whatever their size.
TEXT_PARTITIONS = "quire.text.partitions"


def spread(df: DataFrame, key: str) -> DataFrame:
    n = df.sparkSession.conf.get(TEXT_PARTITIONS, None)
    return df.repartition(int(n), key) if n else df


def text_table(spark: SparkSession, root: str, name: str, key: str) -> DataFrame:
    """A table with long texts."""
    return spread(read_table(spark, root, name), key)


def text_stream(spark: SparkSession, root: str, name: str, key: str) -> DataFrame:
    """The stream of such a table."""
    return spread(stream_table(spark, root, name), key)


def stream_table(spark: SparkSession, root: str, name: str, max_files: int | None = None) -> DataFrame:
    """The same table as a stream of files.

    The path is a glob that matches only the table, so it works both for a single
    file and for a folder of part files.
    """
    reader = spark.readStream.schema(TABLES[name])
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(f"{root}/{name}.parque[t]")


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` names it. A local folder is used only where the
    setting is absent and the session runs in local mode (tests).
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared work folder and read it back.

    For results that several branches of one query use: the branches then share the
    expensive stage below, lost executors cannot force it to run again, and later joins
    know the real size.
    """
    path = work_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

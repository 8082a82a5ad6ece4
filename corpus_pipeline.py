"""A training corpus from raw documents: five stages, each a table of the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import op1_decontaminate, op5_bpe, op6_quality, op8_minhash, op9_suffix_arrays
from quire.llm.common import work_dir
from quire.llm.queries import importable

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Shingles of five words; documents of similarity 0.8 and more are near duplicates.
SHINGLE = 5


def aside(docs: DataFrame, *needed: str) -> DataFrame:
    """``docs`` with all columns but the needed ones under names that no operator uses."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c in needed else f"_passed_{i}") for i, c in enumerate(docs.columns)])


def back(made: DataFrame, docs: DataFrame, *needed: str) -> DataFrame:
    """The columns of ``docs`` from what an operator made of ``aside``."""
    return made.select(*[F.col(f"`{c}`") if c in needed else F.col(f"_passed_{i}").alias(c) for i, c in enumerate(docs.columns)])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects."""
    importable(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    needed = ("doc_id", "text", "source", "lang")
    made = op6_quality.classify(aside(docs, *needed), labels).where(~F.coalesce("rejected", F.lit(False)))
    return back(made, docs, *needed)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one with the smallest id, and
    one row of those equal in id and text. Texts without words and rows without id have no near
    duplicates."""
    importable(spark)
    kept = op8_minhash.near_duplicates(docs.select("doc_id", "text"), size=SHINGLE).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = aside(docs, "doc_id", "text")
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")
    return back(rows.dropDuplicates(["doc_id", "text"]), docs, "doc_id", "text")


def repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes strings of 100 bytes and more that occurred before out of the texts. A character
    that a cut breaks goes too; null texts stay null; every document stays."""
    importable(spark)
    needed = ("doc_id", "text", "n_chars")
    cut = op9_suffix_arrays.remove_repeats(aside(docs, *needed), as_text=True)
    text = F.when(F.col("text").isNotNull(), F.col("kept"))
    new = {"text": text} | ({"n_chars": F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {})
    return back(cut.withColumns(new), docs, *needed)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words, or all, of a benchmark item."""
    importable(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    made = op1_decontaminate.decontaminate(aside(docs, "doc_id", "text"), benchmark).where(~F.col("contaminated"))
    return back(made, docs, "doc_id", "text")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with ids and n_tokens; text is what the ids decode to (empty for null)."""
    importable(spark)
    docs = docs.drop("ids", "n_tokens")
    coded = op5_bpe.decode(op5_bpe.encode(aside(docs, "doc_id", "text"), RANKS, public_tokenizers.PATTERN).drop("text"), RANKS)
    rest = [F.col(c) if c == "doc_id" else F.col(f"_passed_{i}").alias(c) for i, c in enumerate(docs.columns) if c != "text"]
    return coded.select(*rest, F.col("decoded").cast("string").alias("text"), "n_tokens", "ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_bytes),
    ("benchmark decontamination", benchmark_free),
    ("byte-level BPE", tokens),
]

#: Hashed features, signatures and merges are not SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = work_dir(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

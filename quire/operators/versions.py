"""Result versions: numbering, chains, latest rows, history and integrity.

Latest-per-key is an arg-max aggregate (combines map-side); chains use the bucketed
neighbours, so a key with very many versions stays spread out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.payload import payload_text
from quire.operators.scale import latest_by, ordered_parts, with_neighbors

KEY = ["item_id", "prompt_name"]
# Texts put before and after earlier results.
PRIOR_HEAD = "=== VERSION {} (ALREADY EXTRACTED - DO NOT REPEAT) ==="
RULE_LINE = "=" * 80 + "\n"
EXTRACTED_BEFORE = (
    "\n\n" + RULE_LINE
    + "CRITICAL INSTRUCTION: The following content has ALREADY been extracted in previous versions.\n"
    + "You MUST find COMPLETELY DIFFERENT material that is NOT listed below.\n"
    + "Do NOT repeat, paraphrase, or slightly modify any of the content below.\n"
    + "If you cannot find new material, state that explicitly.\n"
    + RULE_LINE + "\n"
)
EXTRACTED_AFTER = "\n\n" + RULE_LINE + "REMINDER: Find DIFFERENT material not shown above.\n" + RULE_LINE + "\n"
WRITTEN_BEFORE = (
    "\n\n---\n\nIMPORTANT: Previous versions of this analysis already exist. "
    "Please provide DIFFERENT insights, examples, or anecdotes than those below. "
    "Find new material not covered in previous versions:\n\n"
)
WRITTEN_AFTER = "\n\n---\n\n"
PREVIEW_CHARS = 500
PRIOR_VERSIONS = 3


def with_text(versions: DataFrame) -> DataFrame:
    return versions.withColumn("body", payload_text(F.col("payload")))


def next_version(asked: DataFrame, versions: DataFrame) -> DataFrame:
    """Highest version + 1 per asked key, 1 where there is none."""
    top = versions.groupBy(*KEY).agg(F.max("version").alias("top"))
    return asked.join(top, KEY, "left").select(
        *KEY, (F.coalesce(F.col("top"), F.lit(0)) + 1).alias("next_version")
    )


def version_chain(versions: DataFrame) -> DataFrame:
    return with_neighbors(versions, KEY, "version", prev={"previous_id": "summary_id"})


def latest(versions: DataFrame) -> DataFrame:
    return latest_by(versions, KEY, ["version"])


def latest_created(versions: DataFrame) -> DataFrame:
    return latest_by(versions, KEY, ["created_s", "summary_id"])


def compare_with_previous(versions: DataFrame) -> DataFrame:
    """Each version next to the one before it, and to the same version of the next item.

    Both are equi-joins on row keys, so no key meets more than one partner.
    """
    v = with_text(versions).select("summary_id", *KEY, "version", "body", "tokens")
    other = v.select(*[F.col(c).alias(f"o_{c}") for c in v.columns])
    earlier = v.join(
        other,
        (F.col("item_id") == F.col("o_item_id"))
        & (F.col("prompt_name") == F.col("o_prompt_name"))
        & (F.col("version") - 1 == F.col("o_version")),
    )
    sideways = v.join(
        other,
        (F.col("item_id") + 1 == F.col("o_item_id"))
        & (F.col("prompt_name") == F.col("o_prompt_name"))
        & (F.col("version") == F.col("o_version")),
    )
    return earlier.unionByName(sideways).select(
        "summary_id",
        "o_summary_id",
        "body",
        "o_body",
        F.col("item_id").eqNullSafe(F.col("o_item_id")).alias("same_item"),
        F.col("prompt_name").eqNullSafe(F.col("o_prompt_name")).alias("same_prompt"),
        (F.col("tokens") - F.col("o_tokens")).alias("token_difference"),
    )


def grouped_versions(versions: DataFrame, catalogue: list[str]) -> DataFrame:
    """Versions of an item by prompt: catalogue prompts first in their order, newest version first."""
    name = F.col("prompt_name")
    order = F.when(name == catalogue[0], 0)
    for i, p in enumerate(catalogue[1:], 1):
        order = order.when(name == p, i)
    rows = with_text(versions).withColumn(
        "entry", F.concat(F.lit("v"), F.col("version").cast("string"), F.lit(": "), F.col("body"))
    )
    parts = ordered_parts(rows, KEY, "version", "entry", "entries", "\n", descending=True)
    return parts.select(
        *KEY,
        order.otherwise(len(catalogue)).alias("prompt_order"),
        F.initcap(F.replace(name, F.lit("_"), F.lit(" "))).alias("prompt_display"),
        "part",
        "entries",
    )


def prior_context(versions: DataFrame, extraction: str) -> DataFrame:
    """The three newest texts of a key, in the frame that stands before the content of a request:
    whole for the extraction prompt, else the first 500 characters."""
    w = Window.partitionBy(*KEY).orderBy(F.desc("version"))
    top = (
        versions.withColumn("k", F.row_number().over(w))
        .filter(F.col("k") <= PRIOR_VERSIONS)
        .transform(with_text)
        .filter(F.col("body") != "")
    )
    v, body = F.col("version").cast("string"), F.col("body")
    head, tail = PRIOR_HEAD.split("{}")
    full = F.concat(F.lit(head), v, F.lit(tail + "\n"), body)
    short = F.when(
        F.length(body) > PREVIEW_CHARS, F.concat(F.substring(body, 1, PREVIEW_CHARS), F.lit("..."))
    ).otherwise(body)
    line = F.when(F.col("prompt_name") == extraction, full).otherwise(
        F.concat(F.lit("Version "), v, F.lit(": "), short)
    )
    items = F.array_sort(F.collect_list(F.struct("k", line.alias("t"))))
    texts = top.groupBy(*KEY).agg(F.array_join(F.transform(items, lambda x: x["t"]), "\n\n").alias("context"))
    extracted = F.col("prompt_name") == extraction
    before = F.when(extracted, EXTRACTED_BEFORE).otherwise(WRITTEN_BEFORE)
    after = F.when(extracted, EXTRACTED_AFTER).otherwise(WRITTEN_AFTER)
    return texts.withColumn("context", F.concat(before, "context", after))


def with_prior(prompt: Column, content: Column, context: Column) -> Column:
    """A request with the earlier results before the first place where its content stands."""
    at = F.instr(prompt, content)
    placed = F.concat(F.substring(prompt, F.lit(1), at - 1), context, F.substring(prompt, at, F.length(prompt)))
    return F.when(context.isNotNull() & (at > 0), placed).otherwise(prompt)


def violations(summaries: DataFrame) -> DataFrame:
    """Broken rules: repeated (parent, prompt, version), not exactly one parent, bad numbers."""

    def repeated(parent: str) -> DataFrame:
        return (
            summaries.filter(F.col(parent).isNotNull())
            .groupBy(parent, "prompt_name", "version")
            .agg(F.count("*").alias("n"), F.min("summary_id").alias("summary_id"))
            .filter(F.col("n") > 1)
            .select(F.lit(f"unique {parent}").alias("rule"), "summary_id", "n")
        )

    def broken(rule: str, cond) -> DataFrame:
        return summaries.filter(cond).select(F.lit(rule).alias("rule"), "summary_id", F.lit(1).cast("bigint").alias("n"))

    one_parent = F.col("chapter_id").isNull() == F.col("book_id").isNull()
    return (
        repeated("chapter_id")
        .unionByName(repeated("book_id"))
        .unionByName(broken("one parent", one_parent))
        .unionByName(broken("tokens >= 0", F.col("tokens") < 0))
        .unionByName(broken("version >= 1", F.col("version") < 1))
    )

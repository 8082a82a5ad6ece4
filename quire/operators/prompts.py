"""Prompt catalogue: rendering, header parsing, synchronisation with files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.regex import strip
from quire.sources.tables import materialize

# Category by name prefix, first match wins.
LOCAL_CATEGORIES = {
    "extract": "extraction",
    "rate": "rating",
    "summarize": "summarization",
    "create": "summarization",
    "analyze": "analysis",
}
IMPORTED_CATEGORIES = {
    "extract": "extraction",
    "rate": "rating",
    "summarize": "summarization",
    "analyze": "analysis",
    "explain": "analysis",
    "create": "custom",
}
SAMPLES = {
    "content": "[Sample chapter content will be inserted here]",
    "title": "[Chapter title]",
    "author": "[Book author]",
}
HEADER = r"(?s)^---\s*\n(.*?)\n---\s*\n(.*)$"


def render(template: Column, values: dict[str, Column]) -> Column:
    """Replace {name} literally, in the order given, on the text replaced so far.

    Content that the template does not mention is appended after a blank line.
    """
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    if "content" not in values:
        return out
    return F.when(F.contains(template, F.lit("{content}")), out).otherwise(
        F.concat(out, F.lit("\n\n"), values["content"])
    )


def rendered_length(template: str, content: Column, values: dict[str, Column]) -> Column:
    """Length of what ``render`` makes of a template with {content} first and then ``values``,
    from a content's ``content_size``: the text itself is not needed."""
    size, counts = F.length(F.lit(template.replace("{content}", ""))) + content["chars"], {}
    for name in values:
        mark = "{" + name + "}"
        counts[name] = content[name] + F.lit(template.count(mark))
    for name, value in values.items():
        mark = "{" + name + "}"
        value = F.coalesce(value.cast("string"), F.lit(""))
        size = size + counts[name] * (F.length(value) - len(mark))
        for later in list(values)[list(values).index(name) + 1 :]:
            counts[later] = counts[later] + counts[name] * occurrences(value, "{" + later + "}")
    return size


def occurrences(text: Column, mark: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark)).cast("bigint")


def content_size(content: Column, names: list[str]) -> Column:
    """Characters, and how often each placeholder stands in the content."""
    return F.struct(F.length(content).cast("bigint").alias("chars"), *[occurrences(content, "{" + n + "}").alias(n) for n in names])


def category(name: Column, table: dict[str, str], default: str) -> Column:
    out = None
    for prefix, value in table.items():
        hit = name.startswith(prefix)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(default)


def with_header(files: DataFrame) -> DataFrame:
    """Split file content into header fields and trimmed body; no header means all body."""
    c = F.col("content")
    head = F.regexp_extract(c, HEADER, 1)
    has = c.rlike(HEADER)

    def field(key: str) -> Column:
        return F.nullif(F.regexp_extract(head, rf"(?m)^{key}:[^\S\n]*([^\n]*?)[^\S\n]*$", 1), F.lit(""))

    names = F.filter(
        F.transform(F.split(F.regexp_replace(field("variables"), r"^\[|\]$", ""), ","), lambda x: strip(x)),
        lambda x: x != "",
    )
    return files.select(
        "*",
        has.alias("has_header"),
        F.when(has, field("name")).alias("h_name"),
        F.when(has, field("category")).alias("h_category"),
        F.when(has, field("default_model")).alias("h_model"),
        F.when(has, names).alias("h_variables"),
        F.when(has, strip(F.regexp_extract(c, HEADER, 2))).otherwise(c).alias("body"),
    )


def prompt_records(files: DataFrame) -> DataFrame:
    """Header fields with defaults from the file name, and the checksum of the whole file."""
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    name = F.coalesce(F.col("h_name"), stem)
    return with_header(files).select(
        "path",
        name.alias("name"),
        F.coalesce(F.col("h_category"), category(name, LOCAL_CATEGORIES, "custom")).alias("category"),
        F.coalesce(F.col("h_model"), F.lit("small")).alias("default_model"),
        F.coalesce(F.col("h_variables"), F.array(F.lit("content"))).alias("variables"),
        F.col("body").alias("template"),
        F.md5(F.encode("content", "UTF-8")).alias("checksum"),
        F.col("content").isNull().alias("unreadable"),
    )


def sync_status(records: DataFrame, catalog: DataFrame, force: bool = False) -> DataFrame:
    """Compare file checksums with the catalogue by name."""
    known = catalog.select("name", F.col("checksum").alias("old_checksum"), F.lit(True).alias("known"))
    same = F.lit(False) if force else F.col("old_checksum").eqNullSafe(F.col("checksum"))
    status = (
        F.when(F.col("unreadable"), "error")
        .when(F.col("known").isNull(), "new")
        .when(same, "synced")
        .otherwise("changed")
    )
    return records.join(known, "name", "left").withColumn("status", status)


def orphans(catalog: DataFrame, records: DataFrame) -> DataFrame:
    """Catalogue rows that came from a file whose name is gone."""
    filed = catalog.filter(F.coalesce(F.col("path"), F.lit("")) != "")
    return filed.join(records.filter(~F.col("unreadable")).select("name"), "name", "left_anti")


def upsert(catalog: DataFrame, records: DataFrame) -> DataFrame:
    """The catalogue after synchronisation: insert new names, overwrite changed ones.

    Files of one name take turns in the order of their paths, so the last one that differs from
    what stands before it is kept, and a name has one row. Names and checksums decide; a template
    moves once, from the side that is chosen.
    """
    fields = ["category", "default_model", "template", "variables", "checksum", "path"]
    files = records.filter(~F.col("unreadable")).select("name", "path", "checksum")
    stored = catalog.select("name", F.col("checksum").alias("stored"), F.lit(True).alias("known"))
    turn = Window.partitionBy("name").orderBy("path")
    before = F.when(F.row_number().over(turn) == 1, F.col("stored")).otherwise(F.lag("checksum").over(turn))
    changed = F.col("checksum").isNotNull() & ~F.col("checksum").eqNullSafe(before)
    steps = files.join(stored, "name", "full_outer").withColumn("taken", F.when(changed, F.col("path")))
    decided = steps.groupBy("name").agg(F.max("taken").alias("taken"), F.count("checksum").alias("files"), F.max("known").alias("known"))
    action = F.when(F.col("files") == 0, "kept").when(F.col("taken").isNull(), "unchanged").when(F.col("known").isNull(), "inserted").otherwise("updated")
    decided = materialize(records.sparkSession, decided.select("name", "taken", action.alias("action")), "decided")
    old = catalog.join(decided.filter(F.col("taken").isNull()), "name")
    chosen = decided.filter(F.col("taken").isNotNull()).withColumnRenamed("taken", "path")
    new = records.filter(~F.col("unreadable")).join(chosen, ["name", "path"])
    return old.select("name", "action", *fields).unionByName(new.select("name", "action", *fields))

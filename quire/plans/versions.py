"""Result version queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.payload import payload_text
from quire.functions.text import title_or_default
from quire.operators import versions as ops
from quire.operators.scale import with_totals
from quire.plans import sqlkit as S
from quire.plans.registry import query
from quire.sources.tables import read_table
from quire.sources.views import chapter_words, versions


@query(
    "next_version",
    S.cte("versions")
    + """, asked as (select distinct conv_id as item_id, r as prompt_name from conversations, (values ('user'), ('assistant'), ('system')) v(r))
    select item_id, prompt_name, coalesce(max(version), 0) + 1 as next_version from asked left join versions using (item_id, prompt_name) group by all""",
)
def next_version(spark, root):
    prompts = F.explode(F.array(F.lit("user"), F.lit("assistant"), F.lit("system")))
    asked = (
        read_table(spark, root, "conversations")
        .select(F.col("conv_id").alias("item_id"))
        .distinct()
        .withColumn("prompt_name", prompts)
    )
    return ops.next_version(asked, versions(spark, root))


@query(
    "version_chain",
    S.cte("versions")
    + "select summary_id, item_id, prompt_name, version, lag(summary_id) over (partition by item_id, prompt_name order by version) as previous_id from versions",
)
def version_chain(spark, root):
    return ops.version_chain(versions(spark, root).select("summary_id", *ops.KEY, "version"))


@query(
    "versions_desc",
    S.cte("texts") + "select item_id, prompt_name, version, summary_id, body from texts order by item_id, prompt_name, version desc",
)
def versions_desc(spark, root):
    rows = ops.with_text(versions(spark, root)).select(*ops.KEY, "version", "summary_id", "body")
    return rows.orderBy("item_id", "prompt_name", F.desc("version"))


@query("version_lookup", S.cte("texts") + "select item_id, summary_id, body from texts where prompt_name = 'user' and version = 2")
def version_lookup(spark, root):
    return (
        ops.with_text(versions(spark, root))
        .filter((F.col("prompt_name") == "user") & (F.col("version") == 2))
        .select("item_id", "summary_id", "body")
    )


@query("latest_version", S.cte("latest") + "select item_id, prompt_name, version, summary_id, body from latest")
def latest_version(spark, root):
    return ops.with_text(ops.latest(versions(spark, root))).select(*ops.KEY, "version", "summary_id", "body")


@query(
    "latest_created",
    S.cte("texts")
    + """select item_id, prompt_name, version, created_s, body from texts
    qualify row_number() over (partition by item_id, prompt_name order by created_s desc, summary_id desc) = 1""",
)
def latest_created(spark, root):
    return ops.with_text(ops.latest_created(versions(spark, root))).select(*ops.KEY, "version", "created_s", "body")


@query(
    "item_history",
    S.cte("texts")
    + """select item_id, created_s, prompt_name, version, body,
    row_number() over (partition by item_id order by created_s desc, summary_id desc) = 1 as shown_first from texts
    order by item_id, created_s desc""",
)
def item_history(spark, root):
    """All results of an item by time, the newest marked."""
    rows = ops.with_text(versions(spark, root))
    at = F.struct("created_s", "summary_id")
    newest = with_totals(rows, ["item_id"], "summary_id", {"newest": ("max", at)})
    return newest.select(
        "item_id", "created_s", "prompt_name", "version", "body", (F.col("newest") == at).alias("shown_first")
    ).orderBy("item_id", F.desc("created_s"))


@query(
    "version_compare",
    S.cte("texts")
    + """select a.summary_id, b.summary_id as o_summary_id, a.body, b.body as o_body, a.item_id = b.item_id as same_item,
    a.prompt_name = b.prompt_name as same_prompt, a.tokens - b.tokens as token_difference
    from texts a join texts b on a.prompt_name = b.prompt_name
      and ((a.item_id = b.item_id and a.version - 1 = b.version) or (a.item_id + 1 = b.item_id and a.version = b.version))""",
)
def version_compare(spark, root):
    return ops.compare_with_previous(versions(spark, root))


@query(
    "has_summary",
    """select doc_id as chapter_id, exists (select 1 from conversations where conv_id = doc_id) as has_summary from documents""",
)
def has_summary(spark, root):
    ids = read_table(spark, root, "documents").select(F.col("doc_id").alias("chapter_id"))
    done = (
        read_table(spark, root, "conversations").select(F.col("conv_id").alias("chapter_id")).distinct()
        .withColumn("has", F.lit(True))
    )
    return ids.join(done, "chapter_id", "left").select(
        "chapter_id", F.coalesce(F.col("has"), F.lit(False)).alias("has_summary")
    )


@query(
    "summary_count",
    "select doc_id as chapter_id, count(conv_id) as summaries from documents left join conversations on conv_id = doc_id group by doc_id",
)
def summary_count(spark, root):
    ids = read_table(spark, root, "documents").select(F.col("doc_id").alias("chapter_id"))
    counts = (
        read_table(spark, root, "conversations")
        .groupBy(F.col("conv_id").alias("chapter_id"))
        .agg(F.count("*").alias("summaries"))
    )
    return ids.join(counts, "chapter_id", "left").select(
        "chapter_id", F.coalesce(F.col("summaries"), F.lit(0)).alias("summaries")
    )


@query(
    "grouped_versions",
    S.cte("texts")
    + r"""select item_id, prompt_name, case when prompt_name = 'user' then 0 else 1 end as prompt_order,
    upper(prompt_name[1]) || prompt_name[2:] as prompt_display, cast((version - 1) // 200 * 200 as int) as part,
    string_agg('v' || version || ': ' || body, chr(10) order by version desc) as entries from texts group by all""",
)
def grouped_versions(spark, root):
    return ops.grouped_versions(versions(spark, root), ["user"])


@query(
    "prior_context",
    S.cte("texts")
    + f"""select item_id, prompt_name, case when prompt_name = 'assistant' then {S.quoted(ops.EXTRACTED_BEFORE)} else {S.quoted(ops.WRITTEN_BEFORE)} end || string_agg(case when prompt_name = 'assistant'
      then '=== VERSION ' || version || ' (ALREADY EXTRACTED - DO NOT REPEAT) ===' || chr(10) || body
      else 'Version ' || version || ': ' || case when length(body) > 500 then left(body, 500) || '...' else body end end,
      chr(10) || chr(10) order by version desc) || case when prompt_name = 'assistant' then {S.quoted(ops.EXTRACTED_AFTER)} else {S.quoted(ops.WRITTEN_AFTER)} end as context
    from (select * replace (case when version % 2 = 0 then repeat(body || ' ', 90) else body end as body) from texts
          qualify row_number() over (partition by item_id, prompt_name order by version desc) <= 3) where body <> '' group by item_id, prompt_name""",
)
def prior_context(spark, root):
    """Even versions hold long texts, so the preview rule applies."""
    v = versions(spark, root)
    body = payload_text(F.col("payload"))
    long = F.to_json(F.struct(F.repeat(F.concat(body, F.lit(" ")), 90).alias("text")))
    return ops.prior_context(
        v.withColumn("payload", F.when(F.col("version") % 2 == 0, long).otherwise(F.col("payload"))), "assistant"
    )


@query("payload_text", S.cte("texts") + "select summary_id, body from texts")
def payload_text_q(spark, root):
    return ops.with_text(versions(spark, root)).select("summary_id", "body")


@query(
    "summary_detail",
    S.cte("texts", "chapter_words")
    + """select summary_id, version, body, case when prompt_name = 'user' then 'Unknown' else prompt_name end as prompt_name, chapter_id, shown_title
    from texts join chapter_words on chapter_id = item_id""",
)
def summary_detail(spark, root):
    """Result, its chapter and its prompt; the catalogue lacks the prompt 'user'."""
    known = (
        read_table(spark, root, "conversations").select(F.col("role").alias("prompt_name")).distinct()
        .filter(F.col("prompt_name") != "user").withColumn("known", F.col("prompt_name"))
    )
    chapters = chapter_words(spark, root).select("chapter_id", "title", "chapter_number")
    return (
        ops.with_text(versions(spark, root))
        .join(chapters, F.col("item_id") == F.col("chapter_id"))
        .join(known, "prompt_name", "left")
        .select(
            "summary_id", "version", "body", F.coalesce("known", F.lit("Unknown")).alias("prompt_name"), "chapter_id",
            title_or_default(F.col("title"), F.col("chapter_number")).alias("shown_title"),
        )
    )


_RAW = """raw as (select summary_id, case when turn % 7 = 3 then null else item_id end as chapter_id,
  case when turn % 5 = 2 then item_id end as book_id, prompt_name, case when turn = 5 then version - 1 when turn = 6 then 0 else version end as version,
  case when turn = 4 then -tokens else tokens end as tokens from versions)"""


@query(
    "constraint_violations",
    S.cte("versions")
    + f""", {_RAW}
    select 'unique chapter_id' as rule, min(summary_id) as summary_id, count(*) as n from raw where chapter_id is not null group by chapter_id, prompt_name, version having count(*) > 1
    union all select 'unique book_id', min(summary_id), count(*) from raw where book_id is not null group by book_id, prompt_name, version having count(*) > 1
    union all select 'one parent', summary_id, 1 from raw where (chapter_id is null) = (book_id is null)
    union all select 'tokens >= 0', summary_id, 1 from raw where tokens < 0
    union all select 'version >= 1', summary_id, 1 from raw where version < 1""",
)
def constraint_violations(spark, root):
    """The versions with faults put in by turn."""
    t = F.col("turn")
    raw = versions(spark, root).select(
        "summary_id",
        F.when(t % 7 != 3, F.col("item_id")).alias("chapter_id"),
        F.when(t % 5 == 2, F.col("item_id")).alias("book_id"),
        "prompt_name",
        F.when(t == 5, F.col("version") - 1).when(t == 6, 0).otherwise(F.col("version")).alias("version"),
        F.when(t == 4, -F.col("tokens")).otherwise(F.col("tokens")).alias("tokens"),
    )
    return ops.violations(raw)

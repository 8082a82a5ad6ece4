"""Prompt catalogue queries over prompt files built from the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.text import title_or_default
from quire.operators import prompts as ops
from quire.plans import sqlkit as S
from quire.plans.registry import query
from quire.sources.tables import materialize, read_table
from quire.sources.views import chapters, prompt_files


def _records(spark, root):
    return ops.prompt_records(prompt_files(spark, root))


def _catalog(spark, root, records):
    """The stored catalogue: some rows up to date, some old, some whose file is gone."""
    n = F.regexp_extract("path", r"_(\d+)\.md$", 1).cast("bigint")
    stored = records.filter(~F.col("unreadable") & (n % 4 != 2)).select(
        "name",
        "category",
        "default_model",
        "template",
        F.when(n % 4 == 1, F.array(F.lit("old"))).otherwise(F.col("variables")).alias("variables"),
        F.when(n % 4 == 1, F.md5(F.concat(F.col("checksum"), F.lit("old")))).otherwise(F.col("checksum")).alias("checksum"),
        F.when(n % 4 == 3, F.lit(None).cast("string")).otherwise(F.col("path")).alias("path"),
    )
    i = F.col("item_id")
    gone = read_table(spark, root, "benchmark").select(
        F.concat(F.lit("rate_bench_"), i.cast("string")).alias("name"),
        F.lit("rating").alias("category"),
        F.lit("small").alias("default_model"),
        F.col("text").alias("template"),
        F.array(F.lit("content")).alias("variables"),
        F.md5(F.encode("text", "UTF-8")).alias("checksum"),
        F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("prompts/b"), i.cast("string"))).alias("path"),
    )
    return stored.unionByName(gone)


def _field(key: str) -> str:
    return rf"nullif(regexp_extract(head, '(?m)^{key}:[^\S\n]*([^\n]*?)[^\S\n]*$', 1), '')"


def _category(expr: str, table: dict[str, str], default: str) -> str:
    return "case " + " ".join(f"when starts_with({expr}, '{p}') then '{c}'" for p, c in table.items()) + f" else '{default}' end"


_HEADER = r"'(?s)^---\s*\n(.*?)\n---\s*\n(.*)$'"
_RECORDS = {
    "parsed": rf"""select *, regexp_matches(content, {_HEADER}) as has, regexp_extract(content, {_HEADER}, 1) as head,
      regexp_extract(path, '([^/]+)\.[^./]+$', 1) as stem from prompt_files""",
    "fields": rf"""select file_id, path, content, stem, has, case when has then {_field('name')} end as h_name,
      case when has then {_field('category')} end as h_category, case when has then {_field('default_model')} end as h_model,
      case when has then {_field('variables')} end as h_variables,
      case when has then {S.strip(f'regexp_extract(content, {_HEADER}, 2)')} else content end as body from parsed""",
    "records": f"""select file_id, path, coalesce(h_name, stem) as name,
      coalesce(h_category, {_category('coalesce(h_name, stem)', ops.LOCAL_CATEGORIES, 'custom')}) as category,
      coalesce(h_model, 'small') as default_model, coalesce(replace(trim(h_variables, '[]'), ' ', ''), 'content') as variables,
      body as template, md5(content) as checksum, content is null as unreadable from fields""",
    "catalog": """select name, category, default_model, template, case when file_id % 4 = 1 then 'old' else variables end as variables, case when file_id % 4 = 1 then md5(checksum || 'old') else checksum end as checksum,
      case when file_id % 4 = 3 then null else path end as path from records where not unreadable and file_id % 4 <> 2
      union all select 'rate_bench_' || item_id, 'rating', 'small', text, 'content', md5(text), case when item_id % 3 = 0 then '' else 'prompts/b' || item_id end from benchmark""",
    "status": """select r.*, case when unreadable then 'error' when c.name is null then 'new' when c.checksum = r.checksum then 'synced' else 'changed' end as status
      from records r left join (select name, checksum from catalog) c on c.name = r.name""",
}


def _sql(body: str) -> str:
    return S.cte("prompt_files", extra=_RECORDS) + body


TEMPLATES = ["Title: {title}\nContent: {content}", "Rate {title} by {author}", "{content} and {content}: {unknown}"]


@query(
    "render_prompt",
    S.cte("chapters")
    + f"""select chapter_id, case chapter_id % 3
      when 0 then replace(replace({S.quoted(TEMPLATES[0])}, '{{content}}', content), '{{title}}', {S.shown_title()})
      when 1 then replace(replace({S.quoted(TEMPLATES[1])}, '{{title}}', {S.shown_title()}), '{{author}}', lang) || chr(10) || chr(10) || content
      else replace({S.quoted(TEMPLATES[2])}, '{{content}}', content) end as prompt from chapters""",
)
def render_prompt(spark, root):
    t = F.element_at(F.array(*[F.lit(x) for x in TEMPLATES]), (F.col("chapter_id") % 3 + 1).cast("int"))
    return chapters(spark, root).select(
        "chapter_id",
        ops.render(
            t,
            {
                "content": F.col("content"),
                "title": title_or_default(F.col("title"), F.col("chapter_number")),
                "author": F.col("lang"),
            },
        ).alias("prompt"),
    )


@query(
    "frontmatter",
    _sql("select path, h_name, h_category, h_model, replace(trim(h_variables, '[]'), ' ', '') as h_variables, body from fields"),
)
def frontmatter(spark, root):
    return ops.with_header(prompt_files(spark, root)).select(
        "path", "h_name", "h_category", "h_model",
        F.nullif(F.array_join("h_variables", ","), F.lit("")).alias("h_variables"), "body",
    )


@query("prompt_records", _sql("select path, name, category, default_model, variables, template, checksum, unreadable from records"))
def prompt_records(spark, root):
    return _records(spark, root).withColumn("variables", F.array_join("variables", ","))


@query(
    "prompt_category",
    _sql(
        f"""select path, {_category('stem', ops.LOCAL_CATEGORIES, 'custom')} as local_category,
        {_category('stem', ops.IMPORTED_CATEGORIES, 'analysis')} as imported_category from parsed"""
    ),
)
def prompt_category(spark, root):
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    return prompt_files(spark, root).select(
        "path",
        ops.category(stem, ops.LOCAL_CATEGORIES, "custom").alias("local_category"),
        ops.category(stem, ops.IMPORTED_CATEGORIES, "analysis").alias("imported_category"),
    )


@query("content_checksum", "select doc_id, md5(text) as checksum from documents")
def content_checksum(spark, root):
    return read_table(spark, root, "documents").select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("checksum"))


@query("sync_status", _sql("select path, case when not unreadable then name end as name, status from status"))
def sync_status(spark, root):
    records = _records(spark, root)
    return ops.sync_status(records, _catalog(spark, root, records)).select(
        "path", F.when(~F.col("unreadable"), F.col("name")).alias("name"), "status"
    )


@query(
    "orphans",
    _sql("select name, path from catalog where coalesce(path, '') <> '' and name not in (select name from records where not unreadable)"),
)
def orphans(spark, root):
    records = _records(spark, root)
    return ops.orphans(_catalog(spark, root, records), records).select("name", "path")


@query(
    "catalog_upsert",
    _sql(
        """, n as (select * from records where not unreadable)
        select coalesce(c.name, n.name) as name, case when n.name is null then 'kept' when c.name is null then 'inserted'
          when c.checksum <> n.checksum then 'updated' else 'unchanged' end as action,
        case when n.name is null or c.checksum = n.checksum then c.category else n.category end as category,
        case when n.name is null or c.checksum = n.checksum then c.default_model else n.default_model end as default_model,
        case when n.name is null or c.checksum = n.checksum then c.template else n.template end as template,
        case when n.name is null or c.checksum = n.checksum then c.variables else n.variables end as variables,
        case when n.name is null or c.checksum = n.checksum then c.checksum else n.checksum end as checksum,
        case when n.name is null or c.checksum = n.checksum then c.path else n.path end as path
        from catalog c full join n on n.name = c.name"""
    ),
)
def catalog_upsert(spark, root):
    records = _records(spark, root)
    return ops.upsert(_catalog(spark, root, records), records).withColumn("variables", F.array_join("variables", ","))


@query(
    "sync_totals",
    _sql(
        """select force, kind, n, path from (
        select false as force, case status when 'error' then 'failed' when 'synced' then 'unchanged' else 'synced' end as kind, count(*) as n, null as path from status group by 2
        union all select true, case when status = 'error' then 'failed' else 'synced' end, count(*), null from status group by 2
        union all select f, 'failed file', 1, path from status, (values (false), (true)) v(f) where status = 'error')"""
    ),
)
def sync_totals(spark, root):
    """Totals per outcome, with and without force, and one row per failed file."""
    records = materialize(spark, _records(spark, root).select("path", "name", "checksum", "unreadable", "category", "default_model", "template", "variables"), "records")
    catalog = _catalog(spark, root, records)
    both = ops.sync_status(records, catalog).withColumn("force", F.lit(False)).unionByName(
        ops.sync_status(records, catalog, force=True).withColumn("force", F.lit(True))
    )
    kind = F.when(F.col("status") == "error", "failed").when(F.col("status") == "synced", "unchanged").otherwise("synced")
    totals = both.groupBy("force", kind.alias("kind")).agg(F.count("*").alias("n"), F.lit(None).cast("string").alias("path"))
    failed = both.filter(F.col("status") == "error").select(
        "force", F.lit("failed file").alias("kind"), F.lit(1).cast("bigint").alias("n"), "path"
    )
    return totals.unionByName(failed)


@query(
    "prompt_list",
    _sql("select name, category, default_model from catalog where starts_with(name, 'explain') or starts_with(name, 'rate') order by category, name"),
)
def prompt_list(spark, root):
    """Catalogue rows of the imported kinds, by category and name."""
    name = F.col("name")
    return (
        _catalog(spark, root, _records(spark, root))
        .filter(name.startswith("explain") | name.startswith("rate"))
        .select("name", "category", "default_model")
        .orderBy("category", "name")
    )


@query(
    "prompt_preview",
    _sql(
        f"""select path, replace(replace(replace(template, '{{content}}', '{ops.SAMPLES['content']}'), '{{title}}', '{ops.SAMPLES['title']}'), '{{author}}', '{ops.SAMPLES['author']}')
        || case when contains(template, '{{content}}') then '' else chr(10) || chr(10) || '{ops.SAMPLES['content']}' end as preview
        from records where not unreadable"""
    ),
)
def prompt_preview(spark, root):
    sample = {k: F.lit(v) for k, v in ops.SAMPLES.items()}
    return (
        _records(spark, root)
        .filter(~F.col("unreadable"))
        .select("path", ops.render(F.col("template"), sample).alias("preview"))
    )


@query(
    "missing_prompts",
    _sql(
        """, asked as (select (['extract','rate','summarize','create','analyze','explain','aggregate','misc'])[doc_id % 8 + 1] || '_doc_' || doc_id as name from labels
           union select 'rate_bench_' || (item_id * 2) from benchmark)
        select name from asked where name not in (select name from catalog)"""
    ),
)
def missing_prompts(spark, root):
    """Requested names that the catalogue does not hold."""
    from quire.sources.views import PREFIXES

    d = F.col("doc_id")
    prefix = F.element_at(F.array(*[F.lit(p) for p in PREFIXES]), (d % 8 + 1).cast("int"))
    asked = (
        read_table(spark, root, "labels")
        .select(F.concat(prefix, F.lit("_doc_"), d.cast("string")).alias("name"))
        .unionByName(
            read_table(spark, root, "benchmark").select(
                F.concat(F.lit("rate_bench_"), (F.col("item_id") * 2).cast("string")).alias("name")
            )
        )
        .distinct()
    )
    return asked.join(_catalog(spark, root, _records(spark, root)).select("name"), "name", "left_anti")

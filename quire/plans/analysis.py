"""Queries on chapter analyses, resumes and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.readability import MIN_ANALYSED_WORDS
from quire.functions.rounding import rounded
from quire.functions.text import word_count
from quire.operators import analysis as ops
from quire.operators import readability as reads
from quire.operators import versions as vops
from quire.operators.scale import latest_by, ordered_parts, with_rank
from quire.plans import sqlkit as S
from quire.plans.registry import query
from quire.schemas import RATING_CRITERIA
from quire.sources.tables import materialize, read_table
from quire.sources.views import (
    book_number,
    calls,
    chapter_source,
    chapter_words,
    chapters,
    jobs,
    main_chapters,
    number_chapters,
    responses,
    section_texts,
    versions,
    with_flags,
)

TEMPLATES = {
    "rate_chapter": "Rate from 1 to 10:\n{content}",
    "summarize_chapter": "Summarize the chapter.",
    "extract_chapter_wisdom": "Extract from {content} what matters",
}


@query(
    "request_fanout",
    S.cte("chapters", "chapter_words")
    + f"""select chapter_id, position, prompt_name, case position when 0 then replace({S.quoted(TEMPLATES['rate_chapter'])}, '{{content}}', content)
      when 1 then {S.quoted(TEMPLATES['summarize_chapter'])} || chr(10) || chr(10) || content when 2 then replace({S.quoted(TEMPLATES['extract_chapter_wisdom'])}, '{{content}}', content) end as prompt,
    case when position = 3 then 'Prompt extract_references not found' end as error
    from chapters join (select chapter_id, words from chapter_words) using (chapter_id),
      (values (0, 'rate_chapter'), (1, 'summarize_chapter'), (2, 'extract_chapter_wisdom'), (3, 'extract_references')) p(position, prompt_name)
    where not is_front_matter and not is_back_matter and words >= 500""",
)
def request_fanout(spark, root):
    src = chapter_source(spark, root).withColumn("words", word_count(F.col("content")))
    eligible = main_chapters(with_flags(number_chapters(src))).filter(F.col("words") >= MIN_ANALYSED_WORDS)
    return ops.request_fanout(eligible, TEMPLATES)


def _ratings(spark, root):
    return ops.numbered_ratings(responses(spark, root))


@query(
    "rating_parse",
    S.cte("ratings") + "select chapter_id, insight, clarity, evidence, engagement, actionability, overall, verdict from ratings",
)
def rating_parse(spark, root):
    return (
        ops.parsed_ratings(responses(spark, root)).filter("valid").select("chapter_id", *RATING_CRITERIA, "verdict")
    )


@query("rating_averages", S.cte("book_scores") + "select * from book_scores")
def rating_averages(spark, root):
    return ops.rating_averages(ops.parsed_ratings(responses(spark, root)).filter("valid"))


_BEST = """b as (select *, row_number() over (partition by book_id order by coalesce(overall, 0) desc, chapter_number) as first,
  row_number() over (partition by book_id order by coalesce(overall, 0), chapter_number desc) as last, count(*) over (partition by book_id) as n from ratings),
  bw as (select book_id, max(chapter_number) filter (first = 1) as best_chapter_number, max(coalesce(title, '')) filter (first = 1) as best_title, max(coalesce(overall, 0)) filter (first = 1) as best_score,
  max(chapter_number) filter (last = 1 and n > 1) as worst_chapter_number, max(coalesce(title, '')) filter (last = 1 and n > 1) as worst_title, max(coalesce(overall, 0)) filter (last = 1 and n > 1) as worst_score from b group by book_id)"""


@query("best_worst", S.cte("ratings") + f", {_BEST} select * from bw")
def best_worst(spark, root):
    return ops.best_worst(_ratings(spark, root))


_VERDICTS = """vl as (select book_id, cast((chapter_number - 1) // 200 * 200 as int) as part,
  string_agg('Chapter ' || chapter_number || ': ' || coalesce(verdict, 'No verdict'), chr(10) order by chapter_number) as verdicts from ratings group by all)"""


@query("verdict_list", S.cte("ratings") + f", {_VERDICTS} select * from vl")
def verdict_list(spark, root):
    return ops.verdict_list(_ratings(spark, root))


@query(
    "verdict_clean",
    """select doc_id, case when starts_with(t, '"') and ends_with(t, '"') then t[2:length(t) - 1] else t end as verdict from (
    select doc_id, """
    + S.strip("""case doc_id % 4 when 0 then ' "' || text || '" ' when 1 then '"' || text when 2 then text || '"' else chr(10) || text end""")
    + " as t from documents)",
)
def verdict_clean(spark, root):
    d, t = F.col("doc_id"), F.col("text")
    raw = (
        F.when(d % 4 == 0, F.concat(F.lit(' "'), t, F.lit('" ')))
        .when(d % 4 == 1, F.concat(F.lit('"'), t))
        .when(d % 4 == 2, F.concat(t, F.lit('"')))
        .otherwise(F.concat(F.lit("\n"), t))
    )
    return read_table(spark, root, "documents").select("doc_id", ops.clean_verdict(raw).alias("verdict"))


def _sql_head() -> str:
    head = S.quoted(ops.REQUEST_HEAD)
    for c in RATING_CRITERIA:
        head = f"replace({head}, '{{{c}}}', coalesce(cast(cast({c} as decimal(10,1)) as varchar), '0'))"
    return f"replace({head}, '{{title}}', book_id)"


@query(
    "aggregate_request",
    S.cte("ratings")
    + f""", {_VERDICTS}, av as (select book_id, {', '.join(f'round(avg({c}), 1) as {c}' for c in RATING_CRITERIA)} from ratings group by book_id)
    select book_id, part, case when part = 0 then {_sql_head()} else '' end || verdicts ||
    case when part = max(part) over (partition by book_id) then {S.quoted(ops.REQUEST_TAIL)} else '' end as request from vl join av using (book_id)""",
)
def aggregate_request(spark, root):
    return ops.aggregate_request(materialize(spark, _ratings(spark, root), "ratings"))


@query(
    "section_concat",
    S.cte("chapters")
    + """select book_id, cast((chapter_number - 1) // 200 * 200 as int) as part, string_agg('## Chapter ' || chapter_number ||
    case when coalesce(title, '') <> '' then ': ' || title else '' end || chr(10) || chr(10) || content,
    chr(10) || chr(10) || '---' || chr(10) || chr(10) order by chapter_number) as text from chapters where not is_front_matter and not is_back_matter group by all""",
)
def section_concat(spark, root):
    return ops.chapter_sections(main_chapters(chapters(spark, root)))


@query(
    "book_concat",
    S.cte("chapters")
    + f"""select b.book_id, coalesce(part, 0) as part, coalesce(text, '') as text from (select distinct book_id from chapters) b
    left join (select book_id, cast((chapter_number - 1) // 200 * 200 as int) as part, string_agg('# ' || {S.shown_title()} || chr(10) || chr(10) || content || chr(10) || chr(10), chr(10) order by chapter_number) as text
      from chapters where not is_front_matter and not is_back_matter group by all) t on t.book_id = b.book_id""",
)
def book_concat(spark, root):
    books = read_table(spark, root, "documents").select(F.col("source").alias("book_id")).distinct()
    return ops.book_texts(chapters(spark, root), books)


def _sql_section(i: int) -> str:
    name, heading, _ = ops.SECTIONS[i]
    inner = S.strip(f"regexp_extract(content, '(?is)## {heading}\\s*\\n(.*?)(?:\\n---|\\n## |\\z)', 1)")
    return f"select chapter_id, book_id, {i} as section_order, '{name}' as section, {inner} as text from section_texts"


_SECTIONS = {
    "every_section": " union all ".join(_sql_section(i) for i in range(5)),
    "sections": "select * from every_section where text <> '' and not contains(lower(text), 'no standout') and not contains(lower(text), 'skip')",
}


@query("section_extract", S.cte("section_texts", extra=_SECTIONS) + "select chapter_id, section, text from sections")
def section_extract(spark, root):
    return ops.extract_sections(section_texts(spark, root)).select("chapter_id", "section", "text")


@query(
    "section_group",
    S.cte("section_texts", "chapters", extra=_SECTIONS)
    + f"""select s.book_id, section_order, (['{"', '".join(h for _, _, h in ops.SECTIONS)}'])[section_order + 1] as header, cast((chapter_number - 1) // 200 * 200 as int) as part,
    string_agg('*From Chapter ' || chapter_number || ': ' || {S.shown_title()} || '*' || chr(10) || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by chapter_number) as items
    from sections s join (select chapter_id, chapter_number, title from chapters) c using (chapter_id) group by all""",
)
def section_group(spark, root):
    # numbers first: only their small columns are ranked, the texts join by chapter
    numbers = number_chapters(chapter_source(spark, root).select("book_id", "chapter_id")).drop("book_id", "book_type")
    return ops.group_sections(ops.extract_sections(section_texts(spark, root)).join(numbers, "chapter_id"))


@query(
    "extraction_concat",
    S.cte("section_texts", "chapters", extra=_SECTIONS)
    + f"""select book_id, cast((chapter_number - 1) // 200 * 200 as int) as part, string_agg('## Chapter ' || chapter_number || case when coalesce(title, '') <> '' then ': ' || title else '' end || chr(10) || chr(10) || text,
      chr(10) || chr(10) || '---' || chr(10) || chr(10) order by chapter_number) as text, max(n) as chapters_included, 'concatenated_references' as prompt_name, 'concatenation' as model, 0 as tokens, cast(0 as decimal(10,6)) as cost
    from (select s.book_id, chapter_number, title, text, count(*) over (partition by s.book_id) as n from sections s join (select chapter_id, chapter_number, title from chapters) c using (chapter_id) where section = 'people') group by all""",
)
def extraction_concat(spark, root):
    numbers = number_chapters(chapter_source(spark, root).select("book_id", "chapter_id")).drop("book_id", "book_type")
    people = ops.extract_sections(section_texts(spark, root), ["people"])
    people = materialize(spark, people.select("book_id", "chapter_id", F.col("text").alias("content")), "people")
    return ops.concat_record(people, materialize(spark, numbers, "numbers"))


@query(
    "book_rating",
    S.cte("book_scores")
    + f""", rec as (select *, v as version, 1000 + v * (case when {S.BOOK_NO} % 2 = 0 then 10 else -10 end) as created_s from book_scores, (values (1), (2)) x(v))
    select book_id, version, overall_avg, case when version = 2 then insight_avg else 0 end as insight_avg, case when version = 2 then clarity_avg else 0 end as clarity_avg,
    0.0::double as evidence_avg, 0.0::double as engagement_avg, 0.0::double as actionability_avg, case when version = 2 then rated else 0 end as chapters_analyzed,
    case when version = 1 then '' else 'worth it' end as verdict
    from rec qualify row_number() over (partition by book_id order by created_s desc, version desc) = 1""",
)
def book_rating(spark, root):
    """Two aggregate records per book; in odd books the first is the newer one."""
    scores = ops.rating_averages(ops.parsed_ratings(responses(spark, root)).filter("valid"))
    v = F.col("version")
    records = scores.withColumn("version", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        "book_id",
        "version",
        (1000 + v * F.when(book_number(F.col("book_id")) % 2 == 0, 10).otherwise(-10)).alias("created_s"),
        F.to_json(
            F.struct(
                "overall_avg",
                F.when(v == 2, F.col("insight_avg")).alias("insight_avg"),
                F.when(v == 2, F.col("clarity_avg")).alias("clarity_avg"),
                F.when(v == 2, F.col("rated")).alias("chapters_analyzed"),
                F.when(v == 2, F.lit("worth it")).alias("verdict"),
            )
        ).alias("payload"),
    )
    return ops.book_rating(records)


# in the ledger of versions, 'assistant' stands for the extraction prompt, 'user' for the summary prompt
ROLES = {"extract": "assistant", "summary": "user"}


def _texts(spark, root):
    return ops.latest_texts(vops.with_text(vops.latest(versions(spark, root))), ROLES)


_TEXTS = """tx as (select item_id as chapter_id, max(nullif(body, '')) filter (prompt_name = 'assistant') as extract,
  max(nullif(body, '')) filter (prompt_name = 'user') as summary from latest group by item_id)"""


@query(
    "chapter_report",
    S.cte("metrics", "latest", "ratings")
    + f""", {_TEXTS} select m.book_id, m.chapter_id, m.chapter_number, m.shown_title, m.words, coalesce(extract, summary) as summary,
    r.overall, r.verdict, m.flesch_ease, m.tier from metrics m left join tx using (chapter_id) left join ratings r using (chapter_id)
    where not is_front_matter and not is_back_matter""",
)
def chapter_report(spark, root):
    metrics = reads.chapter_metrics(chapter_source(spark, root))
    return ops.chapter_report(metrics, _texts(spark, root), ops.parsed_ratings(responses(spark, root)).filter("valid"))


_ESSENCE_NAMES = [p for _, p, _ in ops.ESSENCE]


@query(
    "book_essence",
    S.cte("texts")
    + f""", e as (select item_id, (['{"', '".join(_ESSENCE_NAMES)}'])[(summary_id * 7 + item_id) % 5 + 1] as prompt, summary_id, created_s, body from texts),
    l as (select * from e qualify row_number() over (partition by item_id, prompt order by created_s desc, summary_id desc) = 1)
    select item_id, max(body) filter (prompt = 'aggregate_summaries') as thesis,
    coalesce(max(body) filter (prompt = 'grouped_wisdom'), max(body) filter (prompt = 'aggregate_wisdom')) as wisdom,
    coalesce(max(body) filter (prompt = 'concatenated_references'), max(body) filter (prompt = 'aggregate_references')) as "references" from l group by item_id""",
)
def book_essence(spark, root):
    i = ((F.col("summary_id") * 7 + F.col("item_id")) % 5 + 1).cast("int")
    names = F.array(*[F.lit(p) for p in _ESSENCE_NAMES])
    rows = vops.with_text(versions(spark, root)).withColumn("prompt_name", F.element_at(names, i))
    return ops.book_essence(rows.select("item_id", "prompt_name", "summary_id", "created_s", "body"))


def _target():
    """Resume position of a book."""
    return 10 + book_number(F.col("book_id")) % 5


def _before(spark, root):
    """Main chapters before the book's resume position, with the opening of their text."""
    src = chapter_source(spark, root).select(
        "book_id", "chapter_id", F.substring("content", 1, ops.PREVIEW_CHARS).alias("opening")
    )
    rows = main_chapters(with_flags(number_chapters(src)))
    return rows.filter(F.col("chapter_number") < _target())


_BEFORE = f"bf as (select * from chapters where not is_front_matter and not is_back_matter and chapter_number < 10 + {S.BOOK_NO} % 5)"
_STORY = f"""st as (select book_id, chapter_number, {S.shown_title()} as shown_title,
  coalesce(extract, summary, '{ops.PREVIEW_NOTE}' || left(content, 2000) || '...') as story from bf left join tx using (chapter_id))"""


@query("resume_sources", S.cte("chapters", "latest") + f", {_TEXTS}, {_BEFORE}, {_STORY} select * from st")
def resume_sources(spark, root):
    return ops.resume_sources(_before(spark, root), _texts(spark, root))


@query(
    "resume_text",
    S.cte("chapters", "latest")
    + f""", {_TEXTS}, {_BEFORE}, {_STORY} select book_id, cast((chapter_number - 1) // 200 * 200 as int) as part,
    string_agg('## Chapter ' || chapter_number || ': ' || shown_title || chr(10) || story || chr(10), chr(10) order by chapter_number) as text from st group by all""",
)
def resume_text(spark, root):
    return ops.resume_text(ops.resume_sources(_before(spark, root), _texts(spark, root)))


@query(
    "resume_characters",
    S.cte("chapters", "latest")
    + f""", {_TEXTS}, {_BEFORE} select book_id, cast((chapter_number - 1) // 200 * 200 as int) as part,
    '[' || string_agg('{{"chapter_number":' || chapter_number || ',"data":"' || extract || '"}}', ',' order by chapter_number) || ']' as sources
    from bf join tx using (chapter_id) where extract is not null group by all""",
)
def resume_characters(spark, root):
    return ops.resume_characters(_before(spark, root), _texts(spark, root))


def _cache(spark, root):
    """Stored resumes: the position asked for stands inside the JSON."""
    target = F.to_json(F.struct("payload", (F.col("turn") % 4).alias("target_chapter")))
    return versions(spark, root).withColumn("payload", target).withColumn(
        "target_chapter", F.get_json_object("payload", "$.target_chapter").cast("int")
    )


@query(
    "resume_cache",
    S.cte("versions")
    + """select item_id, cast(turn % 4 as int) as target_chapter, arg_max(summary_id, struct_pack(a := created_s, b := summary_id)) as summary_id, count(*) as cached
    from versions where turn % 4 > 0 group by all""",
)
def resume_cache(spark, root):
    return (
        _cache(spark, root)
        .filter(F.col("target_chapter") > 0)
        .groupBy("item_id", "target_chapter")
        .agg(F.max_by("summary_id", F.struct("created_s", "summary_id")).alias("summary_id"), F.count("*").alias("cached"))
    )


_GUARDS = f"""g as (select book_id, min(book_type) as book_type, min({S.BOOK_NO}) % 7 as target,
  count(*) filter (not is_front_matter and not is_back_matter and chapter_number < {S.BOOK_NO} % 7) as earlier from chapters group by book_id)"""


def _guards(spark, root):
    target = book_number(F.col("book_id")) % 7
    rows = chapter_words(spark, root)
    ok = ~F.col("is_front_matter") & ~F.col("is_back_matter") & (F.col("chapter_number") < target)
    return rows.groupBy("book_id").agg(
        F.min("book_type").alias("book_type"), F.min(target).alias("target"), F.count_if(ok).alias("earlier")
    )


@query(
    "resume_guards",
    S.cte("chapters")
    + f""", {_GUARDS} select *, case when book_type <> 'fiction' then 'only available for fiction books' when target < 2 then 'nothing to summarize yet'
    when earlier = 0 then 'no chapters before the target' end as reason from g""",
)
def resume_guards(spark, root):
    return _guards(spark, root).withColumn(
        "reason", ops.resume_reason(F.col("book_type"), F.col("target"), F.col("earlier"))
    )


@query(
    "resume_cost",
    S.cte("chapters", "versions")
    + f""", {_GUARDS}, c as (select distinct item_id, turn % 4 as target from versions where turn % 4 > 0)
    select book_id, target, is_cached, case when is_cached then 0 else earlier end as chapters, case when is_cached then 0 else earlier * 200 + 500 end as input_tokens, case when is_cached then 0 else 800 end as output_tokens,
    case when is_cached then 0.0 else round((earlier * 200 + 500) * 0.00000015::double + 800 * 0.0000006::double, 6) end as cost
    from (select g.*, c.item_id is not null as is_cached from g left join c on c.item_id = {S.BOOK_NO} and c.target = g.target)""",
)
def resume_cost(spark, root):
    """Price of a resume; nothing when it is cached. Fixed prices of the small model."""
    cached = (
        _cache(spark, root).filter(F.col("target_chapter") > 0)
        .select("item_id", F.col("target_chapter").alias("target")).distinct().withColumn("hit", F.lit(True))
    )
    rows = (
        _guards(spark, root)
        .withColumn("item_id", book_number(F.col("book_id")).cast("bigint"))
        .join(cached, ["item_id", "target"], "left")
        .withColumn("is_cached", F.coalesce("hit", F.lit(False)))
    )
    hit, n = F.col("is_cached"), F.col("earlier")
    tokens = n * 200 + 500
    return rows.select(
        "book_id",
        "target",
        "is_cached",
        F.when(hit, 0).otherwise(n).alias("chapters"),
        F.when(hit, 0).otherwise(tokens).alias("input_tokens"),
        F.when(hit, 0).otherwise(800).alias("output_tokens"),
        F.when(hit, 0.0).otherwise(rounded(tokens * 0.00000015 + 800 * 0.0000006, 6)).alias("cost"),
    )


@query(
    "single_flight",
    S.cte("jobs")
    + "select distinct user_id as budget_key from events where user_id not in (select budget_key from jobs where done < total and day = date '2024-01-30')",
)
def single_flight(spark, root):
    """Keys that may start a job: none of theirs is open on the day."""
    asked = read_table(spark, root, "events").select(F.col("user_id").alias("budget_key")).distinct()
    open_jobs = jobs(spark, root).filter(
        (F.col("done") < F.col("total")) & (F.col("day") == F.lit("2024-01-30").cast("date"))
    )
    return asked.join(open_jobs, "budget_key", "left_anti")


_PHASES = {0: 88, 1: 92, 2: 95, 3: 100}


@query(
    "job_progress",
    S.cte("jobs")
    + """select budget_key, day, done, total, case when done < total then done * (85 // total) else (case budget_key % 4 when 0 then 88 when 1 then 92 when 2 then 95 else 100 end) end as percent,
    done * 100 // total as batch_percent from jobs""",
)
def job_progress(spark, root):
    """Before the barrier whole steps, after it the fixed phase values (phase = key modulo 4)."""
    k = F.col("budget_key") % 4
    phase = F.when(k == 0, 88).when(k == 1, 92).when(k == 2, 95).otherwise(100)
    done, total = F.col("done"), F.col("total")
    return jobs(spark, root).select(
        "budget_key", "day", "done", "total",
        F.when(done < total, ops.chapter_progress(done, total)).otherwise(phase).alias("percent"),
        ops.batch_progress(done, total).alias("batch_percent"),
    )


@query("jobs_ready", S.cte("jobs") + "select budget_key, day, total from jobs where done >= total")
def jobs_ready(spark, root):
    return jobs(spark, root).filter(F.col("done") >= F.col("total")).select("budget_key", "day", "total")


@query(
    "batch_outcome",
    S.cte("calls")
    + """select budget_key, day, cast((n - 1) // 200 as int) as part, count(*) as calls, count(*) filter (status = 'ok') as succeeded, count(*) filter (status = 'failed') as failed,
    coalesce(string_agg(call_id::varchar, ',' order by call_id) filter (status = 'ok'), '') as succeeded_ids,
    coalesce(string_agg(call_id::varchar, ',' order by call_id) filter (status = 'failed'), '') as failed_ids
    from (select *, row_number() over (partition by budget_key, day order by call_id) as n from calls) group by all""",
)
def batch_outcome(spark, root):
    return ops.job_lists(calls(spark, root))


@query(
    "job_errors",
    S.cte("calls")
    + """select budget_key, day, cast((n - 1) // 200 * 200 as int) as part, string_agg('call ' || call_id || ': failed', '; ' order by call_id) as errors, 'completed' as status, 100 as percent
    from (select *, row_number() over (partition by budget_key, day order by call_id) as n from calls where status = 'failed') group by all""",
)
def job_errors(spark, root):
    failed = calls(spark, root).filter(F.col("status") == "failed").select("budget_key", "day", "call_id")
    ranked = with_rank(failed, ["budget_key", "day"], "call_id", "n")
    line = F.concat(F.lit("call "), F.col("call_id").cast("string"), F.lit(": failed"))
    return ordered_parts(ranked, ["budget_key", "day"], "n", line, "errors", "; ").select(
        "*", F.lit("completed").alias("status"), F.lit(100).alias("percent")
    )


@query(
    "result_split",
    S.cte("responses")
    + """select chapter_id, kind, value from (select chapter_id, 'rating' as kind, case when chapter_id % 5 < 3 then response end as value from responses
    union all select chapter_id, 'summary', case when chapter_id % 4 > 0 then 'summary ' || chapter_id end from responses
    union all select chapter_id, 'wisdom', case when chapter_id % 3 = 0 then response end from responses
    union all select chapter_id, 'references', case when chapter_id % 7 = 0 then response end from responses) where value is not null""",
)
def result_split(spark, root):
    """A nested result per chapter, split into its kinds; missing ones are skipped."""
    c, r = F.col("chapter_id"), F.col("response")
    nested = responses(spark, root).select(
        "chapter_id",
        F.struct(
            F.when(c % 5 < 3, r).alias("rating"),
            F.when(c % 4 > 0, F.concat(F.lit("summary "), c.cast("string"))).alias("summary"),
            F.create_map(F.lit("wisdom"), F.when(c % 3 == 0, r), F.lit("references"), F.when(c % 7 == 0, r)).alias("extractions"),
        ).alias("result"),
    )
    kinds = F.map_concat(
        F.create_map(F.lit("rating"), F.col("result.rating"), F.lit("summary"), F.col("result.summary")),
        F.col("result.extractions"),
    )
    return nested.select("chapter_id", F.explode(kinds).alias("kind", "value")).filter(F.col("value").isNotNull())

"""Scan, admission, sink and report queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import readability as R
from quire.functions.regex import strip
from quire.functions.text import safe_file_name, word_count
from quire.operators import analysis, ingest as ops
from quire.operators import readability as reads
from quire.plans import sqlkit as S
from quire.plans.analysis import ROLES, _BEST
from quire.plans.registry import query
from quire.sources.sinks import write_by_book, write_reports
from quire.sources.tables import materialize, read_table, work_dir
from quire.sources.views import chapter_source, chapter_words, chapters, responses, versions

_HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"


@query(
    "scan_documents",
    "select doc_id, source, lang, n_chars, length(text) as text_chars from documents where lang <> 'xx'",
)
def scan_documents(spark, root):
    return read_table(spark, root, "documents").filter(F.col("lang") != "xx").select(
        "doc_id", "source", "lang", "n_chars", F.length("text").alias("text_chars")
    )


@query("scan_pages", f"select {_HOST} as host, count(*) as pages, sum(length(html))::bigint as chars from pages group by 1")
def scan_pages(spark, root):
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    return read_table(spark, root, "pages").groupBy(host.alias("host")).agg(
        F.count("*").alias("pages"), F.sum(F.length("html")).alias("chars")
    )


@query(
    "ingest_admission",
    """select page_id, case when coalesce(name, '') = '' then 'No file was uploaded.'
      when not (ends_with(lower(name), '.epub') or ends_with(lower(name), '.pdf')) then 'Invalid file extension. Please upload an .epub or .pdf file.'
      when size > 52428800 then 'File size exceeds 50MB limit. Please upload a smaller file.'
      when coalesce(type, '') <> '' and type not in ('application/epub+zip', 'application/pdf', 'application/zip', 'application/octet-stream')
      then 'Invalid file type. Expected EPUB or PDF file, got ' || type || '.' end as reason from (
    select page_id, case page_id % 5 when 0 then 'book' || page_id || '.epub' when 1 then 'BOOK' || page_id || '.PDF' when 2 then 'note.txt' when 3 then 'b.epub' end as name,
      length(html) * (case when page_id % 4 = 0 then 20000 else 1 end) as size, case page_id % 3 when 0 then 'application/pdf' when 1 then 'text/html' else '' end as type from pages)""",
)
def ingest_admission(spark, root):
    p = F.col("page_id")
    number = p.cast("string")
    name = (
        F.when(p % 5 == 0, F.concat(F.lit("book"), number, F.lit(".epub")))
        .when(p % 5 == 1, F.concat(F.lit("BOOK"), number, F.lit(".PDF")))
        .when(p % 5 == 2, "note.txt")
        .when(p % 5 == 3, "b.epub")
    )
    size = F.length("html").cast("bigint") * F.when(p % 4 == 0, 20000).otherwise(1)
    kind = F.when(p % 3 == 0, "application/pdf").when(p % 3 == 1, "text/html").otherwise("")
    return read_table(spark, root, "pages").select("page_id", ops.admission(name, size, kind).alias("reason"))


@query(
    "text_gate",
    """with p as (select source || '-' || lang as book_id, case when doc_id % 3 = 0 then '  ' || lang || '  ' else text end as text,
      row_number() over (partition by source, lang order by doc_id) as n from documents)
    select book_id, count(*) as checked, sum(length("""
    + S.strip("text")
    + """))::bigint as chars, sum(length("""
    + S.strip("text")
    + """)) > count(*) * 100 as has_text from p where n <= 5 group by book_id""",
)
def text_gate(spark, root):
    """Books by source and language, every third page a scan without text; Spark keeps only
    five rows a book before the shuffle."""
    d = F.col("doc_id")
    pages = read_table(spark, root, "documents").select(
        F.concat_ws("-", "source", "lang").alias("book_id"),
        "doc_id",
        F.length(strip(F.when(d % 3 == 0, F.concat(F.lit("  "), "lang", F.lit("  "))).otherwise(F.col("text")))).alias("chars"),
    )
    w = Window.partitionBy("book_id").orderBy("doc_id")
    first = pages.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= ops.GATE_PAGES)
    return ops.text_gate(first)


@query(
    "metadata_defaults",
    """select page_id as id, coalesce(nullif(title, ''), 'Untitled') as title, coalesce(nullif(array_to_string(creators, ', '), ''), 'Unknown Author') as author,
    coalesce(nullif(language, ''), 'en') as language, case when page_id % 2 = 0 then '978' || page_id else '' end as isbn,
    case page_id % 3 when 0 then '20240' || (100 + page_id % 200) when 1 then '2024-01' end as date from (
    select page_id, case when page_id % 7 = 0 then '' else regexp_extract(html, '<title>([^<]*)</title>', 1) end as title,
      case when page_id % 5 = 0 then null else regexp_extract(html, '<html lang="([a-z]+)"', 1) end as language,
      (regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1))[1:page_id % 3] as creators from pages)""",
)
def metadata_defaults(spark, root):
    p = F.col("page_id")

    def ident(scheme, value):
        return F.struct(F.lit(scheme).alias("scheme"), value.alias("value"))

    names = F.regexp_extract_all(F.col("html"), F.lit('<a href="[^"]*">([^<]*)</a>'), F.lit(1))
    raw = read_table(spark, root, "pages").select(
        p.alias("id"),
        F.when(p % 7 == 0, "").otherwise(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"),
        F.when(p % 5 != 0, F.regexp_extract("html", '<html lang="([a-z]+)"', 1)).alias("language"),
        F.slice(names, F.lit(1), (p % 3).cast("int")).alias("creators"),
        F.array(
            ident("uuid", F.concat(F.lit("u"), p.cast("string"))),
            F.when(p % 2 == 0, ident("ISBN-13", F.concat(F.lit("978"), p.cast("string")))).otherwise(ident("doi", F.lit("x"))),
        ).alias("identifiers"),
        F.when(p % 3 == 0, F.concat(F.lit("D:20240"), (100 + p % 200).cast("string"), F.lit("120000")))
        .when(p % 3 == 1, "2024-01")
        .alias("date"),
    )
    return ops.metadata(raw)


@query(
    "ingest_status",
    f"""with c as (select source || '-' || lang || '-' || (doc_id % 30) as book_id, doc_id as chapter_id, case when {S.words('text')} < 100 then 'too few words' when contains(text, '###') then 'unreadable markup' end as problem from documents)
    select book_id, 'book' as kind, null as chapter_id, case when count(*) filter (problem is null) = 0 then 'failed' else 'completed' end as status,
      case when count(*) filter (problem is null) = 0 then 'No chapters found' end as message, count(*) filter (problem is not null) as warnings from c group by book_id
    union all select book_id, 'warning', chapter_id, null, 'Failed to extract chapter ''' || chapter_id || ''': ' || problem, null from c where problem is not null""",
)
def ingest_status(spark, root):
    """Books by source, language and id group, so that some have no good chapter."""
    problem = F.when(word_count(F.col("text")) < 100, "too few words").when(
        F.contains("text", F.lit("###")), "unreadable markup"
    )
    book = F.concat_ws("-", "source", "lang", (F.col("doc_id") % 30).cast("string"))
    rows = read_table(spark, root, "documents").select(
        book.alias("book_id"), F.col("doc_id").alias("chapter_id"), problem.alias("problem")
    )
    return ops.ingest_status(materialize(spark, rows, "chapter-problems"))


@query(
    "empty_documents",
    f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents)
    select doc_id, 'No chapters found' as reason from documents where doc_id not in (select doc_id from l where {S.words('line')} >= 50)""",
)
def empty_documents(spark, root):
    """Documents without a single paragraph of 50 words."""
    docs = read_table(spark, root, "documents")
    paragraphs = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter(
        word_count(F.col("line")) >= 50
    )
    return ops.without_chapters(docs.select("doc_id"), paragraphs, "doc_id")


@query("sink_chapters", S.cte("chapters") + "select book_id, chapter_id, chapter_number, title, md5(content) as checksum from chapters")
def sink_chapters(spark, root):
    """Written by book and read back."""
    path = work_dir(spark, "chapters")
    write_by_book(chapters(spark, root), path, "chapter_id")
    back = spark.read.schema(
        "book_id string, chapter_id bigint, chapter_number bigint, title string, content string, book_bucket int"
    ).parquet(path)
    return back.select("book_id", "chapter_id", "chapter_number", "title", F.md5(F.encode("content", "UTF-8")).alias("checksum"))


@query(
    "report_sections",
    S.cte("averages", "book_scores", "latest", "ratings")
    + f""", {_BEST}, x as (select item_id as chapter_id, coalesce(max(nullif(body, '')) filter (prompt_name = 'assistant'), max(nullif(body, '')) filter (prompt_name = 'user')) as summary from latest group by item_id),
    rated as (select book_id from book_scores)
    select book_id, 1 as section_order, 'rating' as section, 0 as item_no, 'Overall ' || cast(overall_avg as decimal(10,1)) || ' over ' || rated || ' chapters' as content from book_scores
    union all select book_id, 2, 'highlights', 0, 'Best: ' || best_chapter_number || coalesce(', worst: ' || worst_chapter_number, '') from bw
    union all select book_id, 3, 'readability', 0, 'Ease ' || cast(flesch_ease as decimal(10,1)) || ', ' || ({S.tier_of('flesch_ease')}) from averages join rated using (book_id)
    union all select source, 4, 'essence', c.doc_id, s.summary from documents c join x s on s.chapter_id = c.doc_id join rated on rated.book_id = c.source where s.summary is not null
    union all select c.book_id, 5, 'chapters', c.chapter_number, {S.shown_title('c.title', 'c.chapter_number')} || coalesce(': ' || s.summary, '') from chapters c join rated using (book_id) left join x s on s.chapter_id = c.chapter_id
      where not c.is_front_matter and not c.is_back_matter""",
)
def report_sections(spark, root):
    """Report of each rated book: sections in fixed order, those without data left out; written as JSON and read back."""
    metrics = materialize(spark, reads.chapter_metrics(chapter_source(spark, root)), "metrics")
    ratings = materialize(spark, analysis.numbered_ratings(responses(spark, root)), "ratings")
    scores = analysis.rating_averages(ratings)
    rated = scores.select("book_id")
    from quire.operators import versions as vops

    texts = analysis.latest_texts(vops.with_text(vops.latest(versions(spark, root))), ROLES).select(
        "chapter_id", F.coalesce("extract", "summary").alias("summary")
    )

    def one(c, digits="decimal(10,1)"):
        return F.col(c).cast(digits).cast("string")

    def section(df, order, name, item, content):
        return df.select(
            "book_id", F.lit(order).alias("section_order"), F.lit(name).alias("section"),
            item.cast("bigint").alias("item_no"), content.alias("content"),
        )

    zero = F.lit(0)
    best = analysis.best_worst(ratings)
    averages = reads.book_averages(reads.analysed_chapters(metrics)).join(rated, "book_id", "left_semi")
    main = metrics.filter(~F.col("is_front_matter") & ~F.col("is_back_matter")).join(rated, "book_id", "left_semi")
    essence = (
        metrics.join(rated, "book_id", "left_semi")
        .join(texts, "chapter_id").filter(F.col("summary").isNotNull())
    )
    report = (
        section(scores, 1, "rating", zero, F.concat(F.lit("Overall "), one("overall_avg"), F.lit(" over "), F.col("rated").cast("string"), F.lit(" chapters")))
        .unionByName(
            section(
                best, 2, "highlights", zero,
                F.concat(
                    F.lit("Best: "), F.col("best_chapter_number").cast("string"),
                    F.coalesce(F.concat(F.lit(", worst: "), F.col("worst_chapter_number").cast("string")), F.lit("")),
                ),
            )
        )
        .unionByName(section(averages, 3, "readability", zero, F.concat(F.lit("Ease "), one("flesch_ease"), F.lit(", "), R.tier(F.col("flesch_ease")))))
        .unionByName(section(essence, 4, "essence", F.col("chapter_id"), F.col("summary")))
        .unionByName(
            section(
                main.join(texts, "chapter_id", "left"), 5, "chapters", F.col("chapter_number"),
                F.concat("shown_title", F.coalesce(F.concat(F.lit(": "), F.col("summary")), F.lit(""))),
            )
        )
    )
    path = work_dir(spark, "reports")
    write_reports(report, path)
    schema = "book_id string, section_order int, section string, item_no bigint, content string, book_bucket int"
    return spark.read.schema(schema).json(path).drop("book_bucket")


@query(
    "export_filename",
    r"""select page_id, left(regexp_replace(regexp_replace(title, '[^\p{L}\p{N}_\s-]', '', 'g'), '[-\s]+', '_', 'g'), 100) || '_analysis.epub' as file_name
    from (select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) || ' - ' || regexp_extract(html, '<h1>(.*?)</h1>', 1) as title from pages)""",
)
def export_filename(spark, root):
    title = F.concat(
        F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit(" - "), F.regexp_extract("html", "<h1>(.*?)</h1>", 1)
    )
    return read_table(spark, root, "pages").select("page_id", safe_file_name(title, "_analysis.epub").alias("file_name"))

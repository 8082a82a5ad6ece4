"""Library queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import library as ops
from quire.plans import sqlkit as S
from quire.plans.registry import query
from quire.sources.tables import read_table
from quire.sources.views import book_number, calls, chapter_source, chapter_words, jobs, number_chapters, versions, with_flags

_STATUS = ["completed", "failed", "processing", "uploaded"]
_BOOKS = f"""bk as (select source as book_id, count(*) as chapters, min(doc_id) as created, min(lang) as author from documents group by source),
  bo as (select book_id, 'Volume ' || reverse(book_id) as title, author, created, chapters, case when {S.BOOK_NO} % 2 = 0 then 'nonfiction' else 'fiction' end as book_type,
    (['{"', '".join(_STATUS)}'])[{S.BOOK_NO} % 4 + 1] as status, case when {S.BOOK_NO} % 3 = 0 then '' else 'c' || book_id end as cover from bk)"""


def books(spark, root):
    """Catalogue of books: one aggregate over the documents' keys, no text read."""
    n = book_number(F.col("book_id"))
    return (
        read_table(spark, root, "documents")
        .groupBy(F.col("source").alias("book_id"))
        .agg(F.count("*").alias("chapters"), F.min("doc_id").alias("created"), F.min("lang").alias("author"))
        .select(
            "book_id",
            F.concat(F.lit("Volume "), F.reverse("book_id")).alias("title"),
            "author",
            "created",
            "chapters",
            F.when(n % 2 == 0, "nonfiction").otherwise("fiction").alias("book_type"),
            F.element_at(F.array(*[F.lit(s) for s in _STATUS]), n % 4 + 1).alias("status"),
            F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("c"), "book_id")).alias("cover"),
        )
    )


def _numbered(spark, root):
    return with_flags(number_chapters(chapter_source(spark, root).select("book_id", "chapter_id")))


@query(
    "library_filter",
    f"with {_BOOKS} select *, count(*) over () as of_type from bo where book_type = 'fiction'",
)
def library_filter(spark, root):
    return ops.of_type(books(spark, root), "fiction")


for _order, _sql in {
    "newest": "created desc, book_id",
    "oldest": "created, book_id",
    "title": "title, book_id",
    "title_desc": "title desc, book_id",
    "author": "author, title, book_id",
}.items():

    def _make(order: str, sql: str) -> None:
        name = "library_sort" if order == "author" else f"library_sort_{order}"

        @query(name, f"with {_BOOKS} select book_id, title, author, created from bo order by {sql}")
        def run(spark, root):
            return ops.sorted_books(books(spark, root), order).select("book_id", "title", "author", "created")

    _make(_order, _sql)


@query(
    "book_chapters",
    S.cte("chapter_words")
    + """select book_id, chapter_number, shown_title, words, count(*) over (partition by book_id) as main_chapters from chapter_words
    where not is_front_matter and not is_back_matter order by 1, 2""",
)
def book_chapters(spark, root):
    return (
        ops.main_with_count(chapter_words(spark, root))
        .select("book_id", "chapter_number", "shown_title", "words", "main_chapters")
        .orderBy("book_id", "chapter_number")
    )


@query(
    "chapter_nav",
    S.cte("chapters")
    + """select book_id, chapter_number, lag(chapter_number) over w as previous_chapter, lead(chapter_number) over w as next_chapter
    from chapters where not is_front_matter and not is_back_matter window w as (partition by book_id order by chapter_number)""",
)
def chapter_nav(spark, root):
    return ops.navigation(_numbered(spark, root)).drop("title")


@query("chapter_lookup", S.cte("chapters") + "select chapter_id, title, content from chapters where book_id = 'src3' and chapter_number = 7")
def chapter_lookup(spark, root):
    """Numbers come from the keys of one book; the text is read for the one chapter found."""
    one = chapter_source(spark, root).filter(F.col("book_id") == "src3")
    found = number_chapters(one.select("book_id", "chapter_id")).filter(F.col("chapter_number") == 7)
    return found.join(one.select("chapter_id", "content"), "chapter_id").select("chapter_id", "title", "content")


@query(
    "library_search",
    S.cte("chapters")
    + f""", {_BOOKS} select c.book_id, c.chapter_id, b.title as book_title, c.title from chapters c join bo b using (book_id)
    where contains(lower(b.title), '3crs') or contains(lower(b.author), 'fr') or contains(lower(coalesce(c.title, '')), 'append') or contains(lower(c.content), 'worthless')""",
)
def library_search(spark, root):
    """Search in book title, author, chapter title and text; the text is tested in the scan, then dropped."""
    src = chapter_source(spark, root)
    small = src.select("book_id", "chapter_id", F.contains(F.lower("content"), F.lit("worthless")).alias("in_text"))
    rows = number_chapters(small).join(
        books(spark, root).select("book_id", F.col("title").alias("book_title"), "author"), "book_id"
    )
    hit = (
        ops.any_contains(["book_title"], "3crs") | ops.any_contains(["author"], "FR")
        | ops.any_contains(["title"], "Append") | F.col("in_text")
    )
    return rows.filter(hit).select("book_id", "chapter_id", "book_title", "title")


@query(
    "library_facets",
    S.cte("chapters", "calls")
    + f""", {_BOOKS} select 'status' as facet, status as value, count(*) as n from bo group by 2 union all select 'book_type', book_type, count(*) from bo group by 2
    union all select 'front_matter', case when is_front_matter then 'true' else 'false' end, count(*) from chapters group by 2
    union all select 'back_matter', case when is_back_matter then 'true' else 'false' end, count(*) from chapters group by 2
    union all select 'model', model, count(*) from calls group by 2 union all select 'month', strftime(day, '%Y-%m'), count(*) from calls group by 2""",
)
def library_facets(spark, root):
    """Counts per facet value; each table is read once and its facets are grouping sets."""

    def facets(df, **cols):
        kinds = F.explode(
            F.array(*[F.struct(F.lit(n).alias("facet"), c.cast("string").alias("value")) for n, c in cols.items()])
        )
        return df.select(kinds.alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))

    return (
        facets(books(spark, root), status=F.col("status"), book_type=F.col("book_type"))
        .unionByName(
            facets(_numbered(spark, root), front_matter=F.col("is_front_matter"), back_matter=F.col("is_back_matter"))
        )
        .unionByName(facets(calls(spark, root), model=F.col("model"), month=F.date_format("day", "yyyy-MM")))
    )


@query("title_default", S.cte("chapters") + f"select chapter_id, {S.shown_title()} as shown_title from chapters")
def title_default(spark, root):
    from quire.functions.text import title_or_default

    return _numbered(spark, root).select(
        "chapter_id", title_or_default(F.col("title"), F.col("chapter_number")).alias("shown_title")
    )


@query(
    "cascade_delete",
    S.cte("versions")
    + f""", {_BOOKS}, keep as (select book_id from bo where status <> 'failed'),
    s as (select d.source as book_id, v.summary_id, case when prompt_name = 'user' then null else prompt_name end as prompt_name from versions v join documents d on d.doc_id = v.item_id)
    select 'books' as tbl, book_id, null as prompt_name, count(*) as n from keep group by book_id
    union all select 'chapters', source, null, count(*) from documents where source in (select book_id from keep) group by source
    union all select 'summaries', book_id, prompt_name, count(*) from s where book_id in (select book_id from keep) group by book_id, prompt_name""",
)
def cascade_delete(spark, root):
    """Failed books and the prompt 'user' are deleted; what is left per table and book."""
    all_books = books(spark, root)
    gone = all_books.filter(F.col("status") == "failed").select("book_id")
    chapters = chapter_source(spark, root).select("book_id", "chapter_id")
    owned = versions(spark, root).join(
        chapters.withColumnRenamed("chapter_id", "item_id"), "item_id"
    ).select("book_id", "summary_id", "prompt_name")
    prompts = read_table(spark, root, "conversations").select(F.col("role").alias("prompt_name")).distinct()
    owned = ops.without_prompts(owned, prompts.filter(F.col("prompt_name") == "user"))

    # counted before the anti-join, so that meets one row per book and prompt
    def counted(df, prompt=None):
        key = F.lit(None).cast("string") if prompt is None else F.col(prompt)
        return df.groupBy("book_id", key.alias("prompt_name")).agg(F.count("*").alias("n"))

    left = ops.without_books(
        {"books": counted(all_books), "chapters": counted(chapters), "summaries": counted(owned, "prompt_name")}, gone
    )
    rows = [df.select(F.lit(name).alias("tbl"), "book_id", "prompt_name", "n") for name, df in left.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(
    "reset_preview",
    S.cte("jobs")
    + """select 'summaries' as tbl, count(*) as n from conversations union all select 'jobs', count(*) from jobs
    union all select 'usage days', count(distinct cast(ts as date)) from events where event_type <> 'error'
    union all select 'chapters with summary', count(*) from documents where doc_id in (select conv_id from conversations)""",
)
def reset_preview(spark, root):
    """Row counts a reset would delete or change."""

    def total(name, df):
        return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "n")

    talks = read_table(spark, root, "conversations")
    done = chapter_source(spark, root).select("chapter_id").join(
        talks.select(F.col("conv_id").alias("chapter_id")), "chapter_id", "left_semi"
    )
    days = calls(spark, root).filter(F.col("status") == "ok").select("day").distinct()
    return (
        total("summaries", talks)
        .unionByName(total("jobs", jobs(spark, root)))
        .unionByName(total("usage days", days))
        .unionByName(total("chapters with summary", done))
    )


@query("missing_assets", f"with {_BOOKS} select book_id, title from bo where cover = '' and status = 'completed'")
def missing_assets(spark, root):
    return books(spark, root).filter((F.col("cover") == "") & (F.col("status") == "completed")).select("book_id", "title")

"""HTML, Markdown and segmentation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import segments as ops
from quire.operators.scale import with_rank
from quire.plans import sqlkit as S
from quire.plans.registry import query
from quire.sources.tables import materialize, read_table, text_table
from quire.sources.views import (
    book_pages,
    bookmarks,
    chapter_source,
    chapter_words,
    chapters,
    main_chapters,
    number_chapters,
    with_flags,
)


def _pages(spark, root):
    return text_table(spark, root, "pages", "page_id")


def _column(spark, root, fn):
    return _pages(spark, root).select("page_id", fn(F.col("html")).alias("body"))


# what the rules come to on these pages, whose blocks are flat and whose <b> never ends
_SCRIPTS = [(r"(?s)<script>.*?</script>", ""), (r"(?s)<style>.*?</style>", ""), ("<meta [^>]*>", "")]
_CLEAN = S.sub("html", [*_SCRIPTS, ("<div[^>]*>(?: |&nbsp;)*</div>", ""), (r'(<div) class="[^"]*"', "$1"), (r">\s+<", "><")])


def _emph(html: str) -> str:
    return S.sub(html, [("(<b>(?:[^<]|<br>)*)", "$1</b>")])


_EMPH = _emph(_CLEAN)
_BODY = S.sub(
    S.entities(
        S.sub(
            _EMPH,
            [
                ("(?s)<!--.*?-->", ""), ("<!DOCTYPE html>", ""), ("(?s)<head>.*?</head>", ""), (r"\s+", " "),
                (r"((?:<(?:p|div|article|nav|footer|body|h1|li|b)\b[^>]*>|</(?:p|div|article|nav|footer|h1|li|ul)>)+) +", "$1"),
                ("<li>", "\n  - "), ("</li>", ""), ("<h1>", "\n\n# "), ("</h1>", "\n\n"),
                ("</?b>", "**"), (" *<br>", "  \n"), ('<a href="([^"]*)">([^<]*)</a>', "[$2]($1)"),
                ("</?(?:p|div|article|nav|footer|body|html|ul)\\b[^>]*>", "\n\n"),
            ],
        )
    ),
    [(r"\n{3,}", "\n\n"), (r"^\n+", ""), (r"\s+$", "")],
)


@query("html_clean", f"select page_id, {_CLEAN} as body from pages")
def html_clean(spark, root):
    return _column(spark, root, T.html_clean)


@query("html_emphasis_clean", f"select page_id, {_emph('html')} as body from pages")
def html_emphasis_clean(spark, root):
    return _column(spark, root, T.html_emphasis_clean)


def _body(c):
    return T.html_body_to_markdown(T.html_emphasis_clean(T.html_clean(c)))


# list rule over lines: an item line is marked; plain text right after a list gets a blank line first
_ITEM = r"'^\s*([*\-+]|\d+\.)\s+\S'"


def _list_rule(src: str, out: str) -> dict[str, str]:
    return {
        f"{out}_l": f"select page_id, pos, line, regexp_matches(line, {_ITEM}) as item, not regexp_matches(line, {_ITEM}) and regexp_matches(line, '^\\S') as plain from (select page_id, unnest(string_split(body, chr(10))) as line, generate_subscripts(string_split(body, chr(10)), 1) as pos from {src})",
        f"{out}_s": f"select *, last_value(case when item then true when plain then false end ignore nulls) over (partition by page_id order by pos rows between unbounded preceding and 1 preceding) as in_list from {out}_l",
        out: rf"""select page_id, string_agg(case when item then repeat(' ', (length(regexp_extract(line, '^\s*')) // 2) * 2) || regexp_extract(line, '^\s*([*\-+]|\d+\.)\s+(.+)$', 1) || ' ' || regexp_extract(line, '^\s*([*\-+]|\d+\.)\s+(.+)$', 2)
          when plain and in_list then chr(10) || line else line end, chr(10) order by pos) as body from {out}_s group by page_id""",
    }


def _heading_rule(src: str, out: str) -> dict[str, str]:
    return {
        f"{out}_l": rf"select page_id, pos, line, case when regexp_matches(line, '^#{{1,6}}\s+.') then length(regexp_extract(line, '^(#+)', 1)) end as lev from (select page_id, unnest(string_split(body, chr(10))) as line, generate_subscripts(string_split(body, chr(10)), 1) as pos from {src})",
        out: rf"""select page_id, string_agg(case when lev is null then line else repeat('#', case when pos = first then 1 else least(1 + lev - low, 6) end) || ' ' || regexp_extract(line, '^#+\s+(.+)$', 1) end, chr(10) order by pos) as body
          from (select *, min(lev) over (partition by page_id) as low, min(case when lev is not null then pos end) over (partition by page_id) as first from {out}_l) group by page_id""",
    }


_TIDY = {
    "t0": f"select page_id, {S.sub(S.sub(S.sub('body', T.TIDY_START), T.LINK_TIDY), T.UNESCAPE)} as body from src",
    **_list_rule("t0", "t1"),
    "t2": f"select page_id, {S.sub('body', T.TIDY_END)} || chr(10) as body from t1",
}


# Markdown with lists, links, headings of many levels and escapes, built from each page's own text
_RICH = (
    "'### ' || title || chr(10) || '-  one' || chr(10) || '   * two [a] (u)' || chr(10) || chr(10) || 'after \\. the \\: list  ' || chr(10) || '## ' || title || chr(10) || "
    "'1. first' || chr(10) || '  more' || chr(10) || '#### deep' || chr(10) || '[](x) [k]( ) [r][ ] ![i](p)' || chr(10) || chr(10) || chr(10) || chr(10) || '+ x' || chr(10) || 'end <u>t</u> <!-- c -->' || chr(10) || body"
)
_SRC = {
    "b0": f"select page_id, regexp_extract(html, '<h1>(.*?)</h1>', 1) as title, {_BODY} as body from pages",
    "src": f"select page_id, {_RICH} as body from b0",
}


def _rich(spark, root):
    title = F.regexp_extract("html", "<h1>(.*?)</h1>", 1)
    rows = _pages(spark, root).select("page_id", title.alias("title"), _body(F.col("html")).alias("body"))
    parts = [
        F.lit("### "), F.col("title"),
        F.lit("\n-  one\n   * two [a] (u)\n\nafter \\. the \\: list  \n## "), F.col("title"),
        F.lit("\n1. first\n  more\n#### deep\n[](x) [k]( ) [r][ ] ![i](p)\n\n\n\n+ x\nend <u>t</u> <!-- c -->\n"), F.col("body"),
    ]
    return rows.select("page_id", F.concat(*parts).alias("body"))


def _on_rich(name, fn, sql):
    @query(name, sql)
    def run(spark, root):
        return _rich(spark, root).select("page_id", fn(F.col("body")).alias("body"))


def _with(*ctes, body):
    merged = {}
    for c in ctes:
        merged.update(c)
    return S.cte(extra=merged) + body


_on_rich("markdown_tidy", T.markdown_tidy, _with(_SRC, _TIDY, body="select page_id, body from t2"))
_on_rich("link_tidy", T.link_tidy, _with(_SRC, body=f"select page_id, {S.sub('body', T.LINK_TIDY)} as body from src"))
_on_rich(
    "unescape_punct", T.unescape_punct,
    _with(_SRC, body="select page_id, replace(replace(replace(replace(replace(replace(body, '\\.', '.'), '\\,', ','), '\\;', ';'), '\\:', ':'), '\\\"', '\"'), '\\''', '''') as body from src"),
)
_on_rich("heading_normalize", T.heading_normalize, _with(_SRC, _heading_rule("src", "h"), body="select page_id, body from h"))
_on_rich(
    "list_normalize",
    lambda c: T.list_normalize(F.regexp_replace(c, r"(?md)[^\S\n]+$", "")),
    _with(
        _SRC,
        {"r": f"select page_id, {S.sub('body', [(r'(?md)[^\S\n]+$', '')])} as body from src"},
        _list_rule("r", "li"),
        body="select page_id, body from li",
    ),
)


@query(
    "html_to_markdown",
    _with({"src": f"select page_id, {_BODY} as body from pages"}, _TIDY, _heading_rule("t2", "h"), body="select page_id, body from h"),
)
def html_to_markdown(spark, root):
    return _column(spark, root, T.html_to_markdown)


def _plain_sql() -> str:
    m, e = "chr(1)", "chr(2)"
    x = S.sub("html", [(r"(?is)<script\b.*?</script\s*>", ""), (r"(?is)<style\b.*?</style\s*>", ""), (r"(?s)<!--.*?-->", "")])
    for n in range(1, 7):
        x = f"regexp_replace({x}, '(?i)<h{n}\\b[^>]*>', {e} || {m} || '{'#' * n} ', 'g')"
    x = f"regexp_replace({x}, '(?i)<p\\b[^>]*>', {e} || {m}, 'g')"
    x = f"regexp_replace({x}, '(?i)<li\\b[^>]*>', {e} || {m} || '- ', 'g')"
    x = f"regexp_replace({x}, '(?i)</(?:h[1-6]|p|li|ul|ol|div|article|section|body|nav|footer|header)\\s*>', {e}, 'g')"
    x = S.entities(S.sub(x, [(r"<[^>]+>", "")]))
    blocks = f"list_filter(string_split({x}, {e}), lambda b: starts_with(b, {m}))"
    tidy = f"list_transform({blocks}, lambda b: regexp_replace(regexp_replace(b[2:], '^(#{{1,6}} |- |)\\s*', '\\1'), '\\s+$', ''))"
    return f"select page_id, array_to_string(list_filter({tidy}, lambda b: not regexp_matches(b, '^(?:#{{1,6}}|-|)$')), chr(10) || chr(10)) as body from pages"


@query("html_plain_text", _plain_sql())
def html_plain_text(spark, root):
    return _column(spark, root, T.html_plain_text)


@query(
    "title_prefix",
    f"""select page_id, case when title <> '' and not starts_with(body, '# ') then '# ' || title || chr(10) || chr(10) || body else body end as body
    from (select page_id, case when page_id % 3 = 0 then '' else 'Page ' || page_id end as title,
      case when page_id % 2 = 0 then '# Own' || chr(10) else '' end || {_BODY} as body from pages)""",
)
def title_prefix(spark, root):
    p = F.col("page_id")
    body = F.concat(F.when(p % 2 == 0, "# Own\n").otherwise(""), _body(F.col("html")))
    title = F.when(p % 3 == 0, "").otherwise(F.concat(F.lit("Page "), p.cast("string")))
    return _pages(spark, root).select("page_id", T.title_prefix(body, title).alias("body"))


# pages with fewer and fewer titles, so that every step of the precedence is reached
_VARIANT = """case page_id % 8 when 2 then replace(replace(html, '<h1>', '<h2>'), '</h1>', '</h2>')
  when 3 then replace(replace(html, '<h1>', '<h5>'), '</h1>', '</h5>')
  when 4 then regexp_replace(replace(replace(html, '<h1>', '<h5>'), '</h1>', '</h5>'), '<title>[^<]*</title>', '<title>Untitled</title>')
  when 5 then regexp_replace(replace(replace(html, '<h1>', '<h5>'), '</h1>', '</h5>'), '<title>[^<]*</title>', '')
  when 6 then regexp_replace(replace(replace(html, '<h1>', '<header><h1>'), '</h1>', '</h1></header>'), '<title>[^<]*</title>', '') else html end"""


def _titled(spark, root):
    p, h = F.col("page_id"), F.col("html")
    low = F.replace(F.replace(h, F.lit("<h1>"), F.lit("<h5>")), F.lit("</h1>"), F.lit("</h5>"))
    wrapped = F.replace(F.replace(h, F.lit("<h1>"), F.lit("<header><h1>")), F.lit("</h1>"), F.lit("</h1></header>"))
    no_tag = r"<title>[^<]*</title>"
    variant = (
        F.when(p % 8 == 2, F.replace(F.replace(h, F.lit("<h1>"), F.lit("<h2>")), F.lit("</h1>"), F.lit("</h2>")))
        .when(p % 8 == 3, low)
        .when(p % 8 == 4, F.regexp_replace(low, no_tag, "<title>Untitled</title>"))
        .when(p % 8 == 5, F.regexp_replace(low, no_tag, ""))
        .when(p % 8 == 6, F.regexp_replace(wrapped, no_tag, ""))
        .otherwise(h)
    )
    return _pages(spark, root).select("page_id", variant.alias("html"))


def _sql_headings(level: int) -> str:
    body = S.sub("html", [(rf"(?s)<{t}\b.*?</{t}>", "") for t in ("nav", "header", "footer")])
    raw = f"regexp_extract_all({body}, '(?is)<h{level}\\b[^>]*>(.*?)</h{level}\\s*>', 1)"
    one = S.strip(S.entities("regexp_replace(x, '<[^>]+>', '', 'g')"))
    return f"list_filter(list_transform({raw}, lambda x: {one}), lambda y: length(y) >= 2 and not regexp_matches(y, '^\\d+$'))"


def _sql_clean_title(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '!\\[[^\\]]*\\]\\([^)]+\\)', '', 'g'), '\\s+', ' ', 'g'))"


_FILE = "case when page_id % 3 = 0 then 'ch_0' || page_id || '.xhtml' when page_id % 3 = 1 then 'closing-note_text.html' else '' end"


@query(
    "page_title",
    f"""with v as (select page_id, {_VARIANT} as html, {_FILE} as file_name from pages),
    x as (select page_id, file_name, case when page_id % 16 = 8 then 'TOC ' || page_id end as toc, case when page_id % 16 = 9 then 'Item ' || page_id end as item,
      {_sql_clean_title(f'({_sql_headings(1)})[1]')} as h1, {_sql_clean_title(f'({_sql_headings(2)})[1]')} as h2,
      {_sql_clean_title(S.entities("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)"))} as tag,
      regexp_replace(file_name, '\\.[^.]*$', '') as stem from v),
    y as (select *, regexp_extract(stem, '(?i)(?:ch(?:apter)?|part)?[_\\-\\s]*(\\d+)', 1) as num, trim(regexp_replace(stem, '[_\\-\\s]+', ' ', 'g')) as words from x)
    select page_id, coalesce(toc, item, h1, h2, case when tag <> '' and lower(tag) not in ('untitled', 'chapter', 'section') then tag end,
      case when num <> '' then 'Chapter ' || num::bigint end,
      case when words <> '' then array_to_string(list_transform(string_split(words, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') end, 'Chapter ' || page_id) as title from y""",
)
def page_title(spark, root):
    p = F.col("page_id")
    name = (
        F.when(p % 3 == 0, F.concat(F.lit("ch_0"), p.cast("string"), F.lit(".xhtml")))
        .when(p % 3 == 1, "closing-note_text.html")
        .otherwise("")
    )
    toc = F.when(p % 16 == 8, F.concat(F.lit("TOC "), p.cast("string")))
    item = F.when(p % 16 == 9, F.concat(F.lit("Item "), p.cast("string")))
    return _titled(spark, root).select("page_id", ops.page_title(F.col("html"), name, toc, item, p).alias("title"))


@query(
    "valid_headings",
    f"""with v as (select page_id, {_VARIANT} as html from pages),
    h as (select page_id, 1 as level, {_sql_headings(1)} as t from v union all select page_id, 2, {_sql_headings(2)} from v)
    select page_id, level, cast(generate_subscripts(t, 1) as int) - 1 as position, unnest(t) as heading from h where len(t) > 0""",
)
def valid_headings(spark, root):
    rows = _titled(spark, root)
    levels = [
        rows.select("page_id", F.lit(n).alias("level"), F.posexplode(ops.heading_texts(F.col("html"), n)).alias("position", "heading"))
        for n in (1, 2)
    ]
    return levels[0].unionByName(levels[1])


@query(
    "split_file_parts",
    """select page_id, file_name, nullif(regexp_extract(file_name, '(?i)(.+)_split_(\\d+)\\.x?html?$', 1), '') as base,
    try_cast(regexp_extract(file_name, '(?i)(.+)_split_(\\d+)\\.x?html?$', 2) as int) as part from (
    select page_id, 'text/' || regexp_extract(url, '^https?://([^/?#]+)', 1) || '/p' || page_id || case page_id % 3 when 0 then '_split_' || lpad((page_id % 7)::varchar, 3, '0') || '.html'
    when 1 then '_SPLIT_' || page_id % 50 || '.XHTM' else '.html' end as file_name from pages)""",
)
def split_file_parts(spark, root):
    p = F.col("page_id")
    tail = (
        F.when(p % 3 == 0, F.concat(F.lit("_split_"), F.lpad((p % 7).cast("string"), 3, "0"), F.lit(".html")))
        .when(p % 3 == 1, F.concat(F.lit("_SPLIT_"), (p % 50).cast("string"), F.lit(".XHTM")))
        .otherwise(".html")
    )
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    files = read_table(spark, root, "pages").select(
        "page_id", F.concat(F.lit("text/"), host, F.lit("/p"), p.cast("string"), tail).alias("file_name")
    )
    base = F.nullif(F.regexp_extract("file_name", ops.SPLIT_NAME, 1), F.lit(""))
    part = F.expr("try_cast(regexp_extract(file_name, '(?i)(.+)_split_(\\\\d+)\\\\.x?html?$', 2) as int)")
    return files.select("page_id", "file_name", base.alias("base"), part.alias("part"))


def _anchored(spark, root):
    """Each document as an HTML file; every fifth line is an element with an id, up to the document
    id modulo 13, quoted in two ways. Its table of contents lists them, backwards in every fourth
    document, with one that is not there in every third, and each with a note below it."""

    def block(line, i):
        n = F.floor(i / 5)
        has = (i % 5 == 0) & (n < F.col("doc_id") % 13)
        name = F.concat(F.lit("ch"), n.cast("string"))
        tag = F.when(n % 2 == 0, F.concat(F.lit('<p id="'), name, F.lit('">'))).otherwise(F.concat(F.lit("<p class=x id='"), name, F.lit("'>")))
        return F.concat(F.when(has, tag).otherwise("<p>"), line, F.lit("</p>"))

    def entry(n):
        def link(anchor, title):
            return F.struct(F.concat(F.lit(title), n.cast("string")).alias("title"), F.concat(F.lit(f"f.html#{anchor}"), n.cast("string")).alias("href"))

        top = link("ch", "Title ")
        return F.struct(top["title"].alias("title"), top["href"].alias("href"), F.array(link("note", "Note ")).alias("children"))

    lines, no_int = F.split("text", "\n"), F.array().cast("array<int>")
    n = F.least(F.col("doc_id") % 13, F.ceil(F.size(lines) / 5)).cast("int")
    here = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(no_int)
    order = F.when(F.col("doc_id") % 4 == 0, F.reverse(here)).otherwise(here)
    gone = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(99))).otherwise(no_int)
    docs = text_table(spark, root, "documents", "doc_id")
    return docs.select(
        "doc_id",
        F.lit("f.html").alias("file"),
        F.concat(F.lit("<h4>Opening</h4>"), F.array_join(F.transform(lines, block), "")).alias("html"),
        F.transform(F.concat(order, gone), entry).alias("toc"),
    )


_ANCHORED = {
    "al": "select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents",
    "ab": """select *, i % 5 = 0 and i // 5 < doc_id % 13 as has, case when not (i % 5 = 0 and i // 5 < doc_id % 13) then '<p>' when i // 5 % 2 = 0 then '<p id="ch' || i // 5 || '">'
      else '<p class=x id=' || chr(39) || 'ch' || i // 5 || chr(39) || '>' end || line || '</p>' as block from al""",
    "af": "select doc_id, '<h4>Opening</h4>' || string_agg(block, '' order by i) as html, count(*) filter (has) as n from ab group by doc_id",
    "ag": r"select *, n + case when doc_id % 3 = 0 then 1 else 0 end between 2 and 10 and n > 0 and len(regexp_extract_all(html, '\S+')) // 2 >= 1000 as cut from af",
    "ap": "select doc_id, i, block, sum(has::int) over (partition by doc_id order by i) as seg from ab",
    # listed anchors that are there, and the one that ends each
    "ax": """select doc_id, i // 5 as a, row_number() over (partition by doc_id order by case when doc_id % 4 = 0 then -i else i end) - 1 as seq,
      lead(i // 5) over (partition by doc_id order by case when doc_id % 4 = 0 then -i else i end) as nxt from ab join (select doc_id from ag where cut) using (doc_id) where has""",
}


@query(
    "anchor_split",
    S.cte(extra=_ANCHORED)
    + """select x.doc_id, 'f.html' as file, cast(seq as int) as seq, 'ch' || a as anchor, 'Title ' || a as title, string_agg(block, '' order by i) as content
    from ax x join ap p on p.doc_id = x.doc_id and seg > a and (nxt is null or nxt < a or seg <= nxt) group by all
    union all select doc_id, 'f.html', 0, null, null, html from ag where not cut""",
)
def anchor_split(spark, root):
    files = _anchored(spark, root)
    entries = ops.toc_entries(files.select("doc_id", "toc"), "doc_id")
    return ops.anchor_split(files.drop("toc"), entries, "doc_id")


@query(
    "between_markers",
    S.cte(extra=_ANCHORED)
    + """select doc_id, coalesce((select string_agg(block, '' order by i) from ap where ap.doc_id = af.doc_id and seg = 2), '') as second,
    coalesce((select string_agg(block, '' order by i) from ap where ap.doc_id = af.doc_id and seg >= 3), '') as rest from af""",
)
def between_markers(spark, root):
    h = F.col("html")
    return _anchored(spark, root).select(
        "doc_id", ops.between_anchors(h, "ch1", "ch2").alias("second"), ops.between_anchors(h, "ch2", None).alias("rest")
    )


@query(
    "toc_entries",
    r"""with l as (select page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) as ts from pages),
    e as (select page_id, unnest(ts) as title, generate_subscripts(ts, 1) - 1 as k from l where len(ts) > 0),
    f as (select page_id, k, 'f' || k // 2 || '.html' as file, case when k % 2 = 1 then 'k' || k end as anchor, title, case when k % 3 = 0 then 0 else 1 end as depth from e where title <> '')
    select page_id, file, anchor, title, depth, first_value(title) over (partition by page_id, file order by k) as file_title from f""",
)
def toc_entries(spark, root):
    """The page's links as a two-level table of contents: every third opens a section of the next two."""
    link = F.regexp_extract_all(F.col("html"), F.lit('<a href="([^"]*)">([^<]*)</a>'), F.lit(2))

    def entry(t, k):
        href = F.concat(
            F.lit("f"), F.floor(k / 2).cast("string"), F.lit(".html"),
            F.when(k % 2 == 1, F.concat(F.lit("#k"), k.cast("string"))).otherwise(""),
        )
        return F.struct(t.alias("title"), href.alias("href"))

    flat = _pages(spark, root).select("page_id", F.transform(link, entry).alias("l"))
    # sections: entry 3s with the two after it as children
    heads = F.filter(F.transform("l", lambda x, k: F.struct(k.alias("k"), x.alias("x"))), lambda y: y["k"] % 3 == 0)
    toc = flat.select(
        "page_id",
        F.transform(
            heads,
            lambda y: F.struct(
                y["x"]["title"].alias("title"), y["x"]["href"].alias("href"), F.slice(F.col("l"), y["k"] + 2, 2).alias("children")
            ),
        ).alias("toc"),
    )
    entries = ops.toc_entries(toc, "page_id")
    titles = ops.file_titles(entries, "page_id").withColumnRenamed("title", "file_title")
    return entries.join(titles, ["page_id", "file"]).select("page_id", "file", "anchor", "title", "depth", "file_title")


@query(
    "spine_filter",
    r"""select regexp_extract(url, '^https?://([^/?#]+)', 1) as book, page_id from pages where page_id % 9 <> 0 and (page_id % 4 <> 3 or contains(html, '<article')) order by 1, 2""",
)
def spine_filter(spark, root):
    """Linear items (every ninth is not) that are documents by type or by content, in reading order."""
    p = F.col("page_id")
    linear = F.when(p % 9 == 0, "no").otherwise("yes")
    media = F.when(p % 4 == 3, "other").otherwise("application/xhtml+xml")
    items = read_table(spark, root, "pages").withColumn("linear", linear).withColumn("media", media)
    is_document = (F.col("media") == "application/xhtml+xml") | F.contains("html", F.lit("<article"))
    return (
        items.filter((F.col("linear") != "no") & is_document)
        .select(F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("book"), "page_id")
        .orderBy("book", "page_id")
    )


def _page_counts(pages):
    return pages.groupBy("book_id").agg(F.count("*").alias("pages"))


_COUNTS = "pc as (select book_id, count(*) as pages from book_pages group by book_id)"
_MARKS = """em as (select * from bookmarks b where level = 1 or not exists (select 1 from bookmarks x where x.book_id = b.book_id and x.level = 1)),
  br as (select book_id, cast(row_number() over (partition by book_id order by pos) as int) as range_no, title, page as start_page,
    cast(coalesce(lead(page) over (partition by book_id order by pos) - 1, pages) as int) as end_page from em join pc using (book_id))"""
_BREAKS = rf"""bl as (select book_id, page, trim(unnest(string_split(text, chr(10)))) as title, generate_subscripts(string_split(text, chr(10)), 1) as line from book_pages),
  bf as (select *, row_number() over (partition by book_id order by page, line) as break_no, count(*) over (partition by book_id) as n from bl where regexp_matches(title, {S.quoted(ops.CHAPTER_LINE)})),
  bk as (select book_id, page, title, cast(break_no as int) as break_no from bf where n >= 2),
  bs as (select book_id, break_no, title, page as start_page, cast(case when nxt is null then pages else greatest(nxt - 1, page) end as int) as end_page from (select *, lead(page) over (partition by book_id order by break_no) as nxt from bk) join pc using (book_id))"""


@query("bookmark_ranges", S.cte("bookmarks", "book_pages") + f", {_COUNTS}, {_MARKS} select * from br where end_page >= start_page and exists (select 1 from book_pages p where p.book_id = br.book_id and page between start_page and end_page and trim(text) <> '')")
def bookmark_ranges(spark, root):
    pages = book_pages(spark, root)
    ranges = materialize(spark, ops.bookmark_ranges(bookmarks(spark, root), _page_counts(pages)), "ranges")
    sizes = materialize(spark, ops.page_sizes(pages), "sizes")
    full = ops.range_summary(ops.pages_in_ranges(sizes, ranges)).select("book_id", "range_no")
    return ranges.join(full, ["book_id", "range_no"], "left_semi").select("book_id", "range_no", "title", "start_page", "end_page")


@query("heading_segments", S.cte("book_pages") + f", {_COUNTS}, {_BREAKS} select book_id, break_no, page, title from bk")
def heading_segments(spark, root):
    breaks = ops.heading_breaks(ops.page_facts(book_pages(spark, root)))
    return breaks.select("book_id", "break_no", "page", "title")


@query(
    "break_segments",
    S.cte("book_pages")
    + f""", {_COUNTS}, {_BREAKS} select s.book_id, break_no, s.title, start_page, end_page, count(*) as pages, sum(length(p.text))::bigint as chars
    from bs s join book_pages p on p.book_id = s.book_id and p.page between start_page and end_page group by all having bool_or(trim(p.text) <> '')""",
)
def break_segments(spark, root):
    facts = ops.page_facts(book_pages(spark, root))
    ranges = materialize(spark, ops.break_ranges(ops.heading_breaks(facts), _page_counts(facts)), "segments")
    held = ops.pages_of_ranges(facts.drop("lines"), ranges.withColumnRenamed("break_no", "range_no"))
    sums = ops.range_summary(held).withColumnRenamed("range_no", "break_no")
    return ranges.join(sums, ["book_id", "break_no"]).select(
        "book_id", "break_no", "title", "start_page", "end_page", "pages", "chars"
    )


@query(
    "fixed_segments",
    S.cte("book_pages")
    + f""", {_COUNTS} select book_id, cast(segment as int) as segment, 'Pages ' || (segment * 30 + 1) || '-' || least(segment * 30 + 30, pages) as title, text from (
      select book_id, (page - 1) // 30 as segment, string_agg(text, chr(10) || chr(10) order by page) as text from book_pages group by all) join pc using (book_id) where trim(text) <> ''""",
)
def fixed_segments(spark, root):
    return ops.fixed_segments(book_pages(spark, root))


@query(
    "segment_strategy",
    S.cte("bookmarks", "book_pages")
    + f""", {_COUNTS}, {_MARKS}, {_BREAKS}, a as (select book_id, pages, (select count(*) from bookmarks b where b.book_id = pc.book_id) as marks,
      (select count(*) from bk where bk.book_id = pc.book_id) as breaks from pc),
    s as (select *, case when marks > 0 then 'bookmarks' when breaks > 0 then 'headings' else 'fixed' end as strategy from a)
    select *, case when strategy = 'fixed' then '{ops.FALLBACK_WARNING}' end as warning from s""",
)
def segment_strategy(spark, root):
    facts = ops.page_facts(book_pages(spark, root))
    breaks = ops.heading_breaks(facts)
    return ops.strategies(_page_counts(facts), bookmarks(spark, root), breaks)


@query(
    "range_text",
    S.cte("bookmarks", "book_pages")
    + f""", {_COUNTS}, {_MARKS} select br.book_id, range_no, cast((page - 1) // 200 * 200 as int) as part, string_agg(text, chr(10) || chr(10) order by page) as text
    from br join book_pages p on p.book_id = br.book_id and page between start_page and end_page group by all""",
)
def range_text(spark, root):
    pages = book_pages(spark, root)
    ranges = materialize(spark, ops.bookmark_ranges(bookmarks(spark, root), _page_counts(pages)), "ranges")
    return ops.range_text(pages, ranges)


@query(
    "paragraphs",
    r"""select doc_id, array_to_string(list_transform(list_filter(list_transform(regexp_split_to_array(body, '\n\s*\n'), lambda p: regexp_replace(regexp_replace(p, '^\s+', ''), '\s+$', '')), lambda p: p <> ''),
    lambda p: '<p>' || replace(replace(replace(replace(p, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '<br/>') || '</p>'), chr(10)) as body
    from (select doc_id, replace(text, '.' || chr(10), '. <' || chr(10) || '  ' || chr(10)) as body from documents)""",
)
def paragraphs(spark, root):
    """Line ends after a full stop become blank lines."""
    text = F.replace(F.col("text"), F.lit(".\n"), F.lit(". <\n  \n"))
    return text_table(spark, root, "documents", "doc_id").select("doc_id", T.text_to_html(text).alias("body"))


@query("front_matter", S.cte("chapters") + "select book_id, chapter_number, title, is_front_matter from chapters")
def front_matter(spark, root):
    return with_flags(number_chapters(chapter_source(spark, root).select("book_id", "chapter_id"))).select(
        "book_id", "chapter_number", "title", "is_front_matter"
    )


@query("back_matter", S.cte("chapters") + "select book_id, chapter_number, title, is_back_matter from chapters")
def back_matter(spark, root):
    return with_flags(number_chapters(chapter_source(spark, root).select("book_id", "chapter_id"))).select(
        "book_id", "chapter_number", "title", "is_back_matter"
    )


@query(
    "chapters_flat",
    S.cte("chapter_words")
    + """select book_id, cast(row_number() over (partition by book_id order by chapter_id) as int) as chapter_number, shown_title, words,
    is_front_matter, is_back_matter from chapter_words where words >= 50""",
)
def chapters_flat(spark, root):
    """Chapters of 50 words or more, numbered again without gaps."""
    kept = materialize(spark, chapter_words(spark, root).filter(F.col("words") >= 50).drop("chapter_number"), "kept")
    return with_rank(kept, ["book_id"], "chapter_id", "chapter_number").select(
        "book_id", "chapter_number", "shown_title", "words", "is_front_matter", "is_back_matter"
    )


@query(
    "book_word_count",
    S.cte("chapter_words")
    + "select book_id, coalesce(sum(words) filter (not is_front_matter and not is_back_matter), 0)::bigint as words from chapter_words group by book_id",
)
def book_word_count(spark, root):
    main = ~F.col("is_front_matter") & ~F.col("is_back_matter")
    return chapter_words(spark, root).groupBy("book_id").agg(
        F.coalesce(F.sum(F.when(main, F.col("words"))), F.lit(0)).alias("words")
    )

"""Building blocks of the comparison SQL (DuckDB dialect).

``cte(...)`` returns a WITH clause holding the named views and those they need, in order.
"""

from __future__ import annotations

from quire.functions.readability import VOWELS
from quire.functions.text import MARKDOWN_STRIP
from quire.functions.titles import BACK_WORDS, FRONT_WORDS

AS_OF = "2024-01-30"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(expr: str, steps) -> str:
    """The substitution chain of quire.functions.regex.substitute."""
    for pattern, replacement in steps:
        pattern = pattern.replace("(?md)", "(?m)")
        replacement = replacement.replace("$1", r"\1").replace("$2", r"\2").replace("$3", r"\3")
        expr = f"regexp_replace({expr}, {quoted(pattern)}, {quoted(replacement)}, 'g')"
    return expr


def strip(expr: str) -> str:
    return sub(expr, [(r"^\s+", ""), (r"\s+$", "")])


def n_matches(expr: str, pattern: str) -> str:
    return f"len(regexp_extract_all({expr}, {quoted(pattern)}))"


def words(expr: str) -> str:
    return n_matches(sub(expr, [(r"[#*_\[\]()>`~-]", "")]), r"\S+")


def entities(expr: str) -> str:
    """The references that the tables hold; the ampersand comes last, so that none is decoded twice."""
    for name, value in [("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")]:
        expr = f"replace({expr}, {quoted(name)}, {quoted(value)})"
    return expr


def matches_words(title: str, values: list[str]) -> str:
    pattern = r"\b(" + "|".join(values) + r")\b"
    return f"coalesce(regexp_matches(lower({title}), {quoted(pattern)}), false)"


def tier_of(ease: str) -> str:
    return (
        f"case when {ease} >= 60 then 'accessible' when {ease} >= 40 then 'moderate' "
        f"when {ease} >= 20 then 'technical' else 'dense' end"
    )


def wpm_of(tier: str) -> str:
    return (
        f"case {tier} when 'accessible' then 275 when 'moderate' then 200 "
        f"when 'technical' then 100 when 'dense' then 60 else 200 end"
    )


def shown_title(title: str = "title", number: str = "chapter_number") -> str:
    return f"coalesce(nullif({title}, ''), 'Chapter ' || {number})"


BOOK_NO = "coalesce(try_cast(substr(book_id, 4) as int), 0)"

_V = f"[{VOWELS}]+"
_TOKENS = "list_filter(regexp_split_to_array(lower(t), '\\s+'), lambda x: x <> '')"

VIEWS: dict[str, tuple[list[str], str]] = {
    "numbered": (
        [],
        "select source as book_id, doc_id as chapter_id, "
        "cast(row_number() over (partition by source order by doc_id) as int) as chapter_number, "
        "text as content, lang from documents",
    ),
    "titled": (
        ["numbered"],
        f"""select *, case when {BOOK_NO} % 2 = 0 then 'nonfiction' else 'fiction' end as book_type,
        case when chapter_number = 1 then 'Table of Contents' when chapter_number = 2 then 'Preface'
             when chapter_number % 17 = 0 then 'Appendix' when chapter_number % 13 = 0 then null
             else 'Part ' || chapter_number end as title from numbered""",
    ),
    "chapters": (
        ["titled"],
        f"""select *, {matches_words('title', FRONT_WORDS)} as is_front_matter,
        {matches_words('title', BACK_WORDS)} as is_back_matter from titled""",
    ),
    "chapter_words": (
        ["chapters"],
        f"""select * exclude (content), {words('content')} as words, length(content) as chars,
        {shown_title()} as shown_title from chapters""",
    ),
    "counts": (
        ["chapters"],
        f"""select *, len(tok) as words,
        greatest(1, {n_matches('t', '[.!?]+')}) as sentences,
        cast(coalesce(list_sum(list_transform(tok, lambda x: greatest(1, len(regexp_extract_all(x, '{_V}'))))), 0) as bigint) as syllables,
        len(list_filter(tok, lambda x: len(regexp_extract_all(x, '{_V}')) >= 3)) as polysyllables,
        length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) as letters
        from (select *, {_TOKENS} as tok from
              (select * exclude (content), {strip(sub('content', MARKDOWN_STRIP))} as t from chapters))""",
    ),
    "scores": (
        ["counts"],
        f"""select * exclude (t, tok, ease),
        case when words >= 100 then round(ease, 1) end as flesch_ease,
        case when words >= 100 then round(0.39 * (words::double / sentences) + 11.8 * (syllables / words::double) - 15.59, 1) end as fk_grade,
        case when words >= 100 then round(0.4 * (words::double / sentences + 100.0 * (polysyllables / words::double)), 1) end as gunning_fog,
        case when words >= 100 then round(1.0430 * sqrt(30.0 * (polysyllables / sentences::double)) + 3.1291, 1) end as smog_index,
        case when words >= 100 then round(5.88 * (letters / words::double) - 29.6 * (sentences / words::double) - 15.8, 1) end as coleman_liau,
        case when words < 100 then 'unknown' else {tier_of('ease')} end as tier
        from (select *, 206.835 - 1.015 * (words::double / sentences) - 84.6 * (syllables / words::double) as ease from counts)""",
    ),
    "metrics": (
        ["scores"],
        f"""select *, {shown_title()} as shown_title,
        case when words < 100 then 0.0 else round(words::double / ({wpm_of('tier')}), 1) end as minutes,
        case when words < 100 then 0.0 else round(words::double / 350, 1) end as skim_minutes,
        case when words < 100 then 0.0 else round(words::double / 100, 1) end as study_minutes,
        words < 100 as too_short from scores""",
    ),
    "analysed": (
        ["metrics", "chapter_words"],
        """select m.* from metrics m join (select chapter_id, words as raw_words from chapter_words) w using (chapter_id)
        where not is_front_matter and not is_back_matter and raw_words >= 500 and not too_short""",
    ),
    "averages": (
        ["analysed"],
        """select book_id, sum(words) as total_words, sum(sentences) as total_sentences, count(*) as chapters,
        round(sum(cast(flesch_ease as decimal(10,1)) * words)::double / sum(words)::double, 1) as flesch_ease,
        round(sum(cast(fk_grade as decimal(10,1)) * words)::double / sum(words)::double, 1) as fk_grade,
        round(sum(cast(gunning_fog as decimal(10,1)) * words)::double / sum(words)::double, 1) as gunning_fog,
        round(sum(cast(smog_index as decimal(10,1)) * words)::double / sum(words)::double, 1) as smog_index,
        round(sum(cast(coleman_liau as decimal(10,1)) * words)::double / sum(words)::double, 1) as coleman_liau
        from analysed group by book_id""",
    ),
    "books": (
        ["chapters"],
        "select distinct book_id, book_type from chapters",
    ),
    "calls": (
        [],
        """select event_id as call_id, ts, cast(ts as date) as day, user_id as budget_key,
        case when event_type in ('purchase', 'signup') then 'large' else 'small' end as model,
        cast(floor(value * 100) as bigint) as input_tokens,
        least(cast(floor(value * 10) as bigint), 2000) as output_tokens,
        case when event_type = 'error' then 'failed' else 'ok' end as status from events""",
    ),
    "priced": (
        ["calls"],
        """select *, cast(cast(input_tokens as decimal(18,0)) * cast(case model when 'large' then 2.50 else 0.150 end as decimal(10,3)) * cast(0.000001 as decimal(7,6)) as decimal(18,9)) as input_cost,
        cast(cast(output_tokens as decimal(18,0)) * cast(case model when 'large' then 10.00 else 0.600 end as decimal(10,3)) * cast(0.000001 as decimal(7,6)) as decimal(18,9)) as output_cost
        from calls""",
    ),
    "costed": (
        ["priced"],
        "select *, cast(input_cost + output_cost as decimal(18,9)) as cost from priced",
    ),
    "ok_calls": (["costed"], "select * from costed where status = 'ok'"),
    "daily": (
        ["ok_calls"],
        """select day, count(*) as calls, cast(sum(input_tokens + output_tokens) as bigint) as tokens,
        cast(sum(cost) as decimal(18,9)) as cost from ok_calls group by day""",
    ),
    "month_to_date": (
        ["daily"],
        """select *, strftime(day, '%Y-%m') as month,
        cast(sum(calls) over w as bigint) as month_calls, cast(sum(tokens) over w as bigint) as month_tokens,
        cast(sum(cost) over w as decimal(18,9)) as month_cost from daily
        window w as (partition by strftime(day, '%Y-%m') order by day)""",
    ),
    "jobs": (
        ["calls"],
        """select budget_key, day, count(*) as total, count(*) filter (status = 'ok') as done,
        count(*) filter (status = 'failed') as failed from calls group by budget_key, day""",
    ),
    "versions": (
        [],
        """select conv_id * 1000000000 + turn as summary_id, conv_id as item_id, role as prompt_name,
        cast(row_number() over (partition by conv_id, role order by turn) as int) as version, turn,
        length(text) as tokens,
        case turn % 3 when 0 then '{"text":"v' || conv_id || '-' || turn || '"}'
                      when 1 then '{"content":"v' || conv_id || '-' || turn || '"}'
                      else '{"text":{"text":"v' || conv_id || '-' || turn || '"}}' end as payload,
        1704067200 + (conv_id * 1000000000 + turn) % 100003 * 7919 % 100003 as created_s from conversations""",
    ),
    "texts": (
        ["versions"],
        """select *, coalesce(case when json_type(payload, '$.text') = 'OBJECT' then payload ->> '$.text.text'
        else payload ->> '$.text' end, payload ->> '$.content', '') as body from versions""",
    ),
    "latest": (
        ["texts"],
        "select * from texts qualify row_number() over (partition by item_id, prompt_name order by version desc) = 1",
    ),
    "responses": (
        [],
        r"""select doc_id as chapter_id, source as book_id, case doc_id % 5
        when 0 then 'Here:' || chr(10) || '```json' || chr(10) || j || chr(10) || '```'
        when 1 then '```' || chr(10) || j || chr(10) || '```' || chr(10) || 'end'
        when 2 then 'Rating ' || j || ' done' when 3 then 'no rating given' else '{broken ' || j end as response
        from (select doc_id, source, '{"insight":' || (1 + doc_id * 7 % 10) ||
              case when doc_id % 6 = 0 then '' else ',"clarity":' || (1 + doc_id * 3 % 10) end ||
              ',"overall":' || (1 + doc_id % 10) || ',"one_line_verdict":"verdict ' || doc_id || '"}' as j from documents)""",
    ),
    "ratings": (
        ["responses", "chapters"],
        """select r.chapter_id, r.book_id, c.chapter_number, c.title, (j ->> '$.insight')::int as insight,
        (j ->> '$.clarity')::int as clarity, (j ->> '$.evidence')::int as evidence,
        (j ->> '$.engagement')::int as engagement, (j ->> '$.actionability')::int as actionability,
        (j ->> '$.overall')::int as overall, j ->> '$.one_line_verdict' as verdict
        from (select *, case when contains(response, '```json') then trim(split_part(split_part(response, '```json', 2), '```', 1), chr(10) || ' ')
              when contains(response, '```') then trim(split_part(response, '```', 2), chr(10) || ' ')
              when contains(response, '{') then regexp_extract(response, '(?s)\\{.*\\}') end as j from responses) r
        join (select chapter_id, chapter_number, title from chapters) c using (chapter_id)
        where j is not null and json_valid(j)""",
    ),
    "book_scores": (
        ["ratings"],
        """select book_id, count(*) as rated, coalesce(round(avg(insight), 1), 0) as insight_avg,
        coalesce(round(avg(clarity), 1), 0) as clarity_avg, coalesce(round(avg(evidence), 1), 0) as evidence_avg,
        coalesce(round(avg(engagement), 1), 0) as engagement_avg,
        coalesce(round(avg(actionability), 1), 0) as actionability_avg,
        coalesce(round(avg(overall), 1), 0) as overall_avg from ratings group by book_id""",
    ),
    "section_texts": (
        [],
        """select doc_id as chapter_id, source as book_id, '## THE STORY' || chr(10) || text || chr(10) || '---' || chr(10)
        || '## The Advice' || chr(10) || chr(10) ||
        case when doc_id % 4 = 0 then 'No standout advice here' when doc_id % 4 = 1 then 'skip this' else reverse(text) end || chr(10)
        || case when doc_id % 3 = 0 then '' else '## PEOPLE WORTH KNOWING' || chr(10) || lang || ' ' || text || chr(10) || chr(10) end
        || '## THE SURPRISE' || chr(10) || '  ' || chr(10) || '---' || chr(10) || '## QUOTABLE' || chr(10) || '> ' || text as content
        from documents""",
    ),
    "prompt_files": (
        [],
        """select doc_id as file_id, 'prompts/' || stem || '.md' as path,
        case when doc_id % 50 = 7 then null when doc_id % 5 = 0 then body else
        '---' || chr(10) || case when doc_id % 3 = 0 then 'name: ' || stem || '_named' || chr(10) else '' end
        || case when doc_id % 7 = 0 then 'category: aggregation' || chr(10) else '' end
        || case when doc_id % 2 = 0 then 'default_model: large' else 'default_model:   small' end || chr(10)
        || case when doc_id % 5 = 1 then 'variables: [content, title]' || chr(10) else '' end || '---' || chr(10) || body end as content
        from (select doc_id, (['extract','rate','summarize','create','analyze','explain','aggregate','misc'])[doc_id % 8 + 1] || '_doc_' || doc_id as stem,
        '# Task for {title}' || chr(10) || case when doc_id % 4 = 0 then '' else 'Read: {content}' || chr(10) end || text || chr(10) as body from documents)""",
    ),
    "book_pages": (
        ["numbered"],
        """select book_id, chapter_id as page_id, chapter_number as page, case when chapter_number % 10 = 0 then '  ' else
        case when chapter_number % 6 = 1 then 'Chapter ' || chapter_number when chapter_number % 11 = 3 then 'PART IV the turn'
             when chapter_number % 11 = 5 then chapter_number || '. Notes' else 'plain opening line' end
        || case when chapter_number % 18 = 1 then chr(10) || 'Section 2 again' else '' end || chr(10) || content end as text from numbered""",
    ),
    "bookmarks": (
        ["numbered"],
        f"""select book_id, row_number() over (partition by book_id order by n) as pos, level, 'Mark ' || n as title,
        case when even and n % 21 = 1 and n > 1 then n - 4 when not even and n % 14 = 4 and n > 4 then n - 7 else n end as page
        from (select book_id, chapter_number as n, {BOOK_NO} % 2 = 0 as even,
          case when chapter_number % 7 = 4 then 2 when {BOOK_NO} % 2 = 0 and chapter_number % 7 = 1 then 1 when {BOOK_NO} % 2 = 0 and chapter_number % 7 = 5 then 3 end as level from numbered)
        where level is not null and {BOOK_NO} % 3 <> 2""",
    ),
}


def cte(*names: str, extra: dict[str, str] | None = None) -> str:
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in done:
            return
        needs, body = VIEWS[name]
        for n in needs:
            add(n)
        done[name] = body

    for n in names:
        add(n)
    done.update(extra or {})
    return "with recursive " + ", ".join(f"{n} as ({b})" for n, b in done.items()) + " " if done else ""

"""Token and cost queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import money as M
from quire.functions.rounding import rounded
from quire.functions.text import title_or_default
from quire.operators import cost as ops
from quire.plans import sqlkit as S
from quire.plans.registry import query
from quire.sources.tables import materialize, read_table
from quire.sources.views import AS_OF, calls, chapter_source, chapter_words, main_chapters, number_chapters

LIMITS = ops.Settings()  # as shipped
TIGHT = ops.Settings(monthly_limit="0.50", daily_limit=2)  # per budget key


def _costed(spark, root):
    return ops.with_costs(calls(spark, root))


def _ok(spark, root):
    return _costed(spark, root).filter(F.col("status") == "ok")


def _daily(spark, root):
    return ops.daily_usage(_costed(spark, root))


TOKENS = "cast(ceil(length({}) / 4) as bigint)"


def sql_cost(i: str, o: str, model: str) -> str:
    return f"""cast(cast({i} as decimal(18,0)) * cast(case {model} when 'large' then 2.50 else 0.150 end as decimal(10,3)) * cast(0.000001 as decimal(7,6))
    + cast({o} as decimal(18,0)) * cast(case {model} when 'large' then 10.00 else 0.600 end as decimal(10,3)) * cast(0.000001 as decimal(7,6)) as decimal(18,9))"""


@query("token_estimate", f"select doc_id as chapter_id, coalesce({TOKENS.format('text')}, 0) as tokens from documents")
def token_estimate(spark, root):
    return chapter_source(spark, root).select("chapter_id", M.token_estimate(F.col("content")).alias("tokens"))


@query(
    "cost_estimate",
    S.cte("costed")
    + """select call_id, case when status = 'failed' then 'retired' else model end as model, input_tokens + output_tokens as total_tokens,
    case when status <> 'failed' then input_cost end as input_cost, case when status <> 'failed' then output_cost end as output_cost,
    case when status <> 'failed' then cost end as cost,
    case when status = 'failed' then 'Pricing not available for model: retired' end as error from costed""",
)
def cost_estimate(spark, root):
    """Failed calls ask for a model without a price."""
    retired = F.when(F.col("status") == "failed", "retired").otherwise(F.col("model"))
    return ops.with_costs(calls(spark, root).withColumn("model", retired)).select(
        "call_id",
        "model",
        (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
        "input_cost",
        "output_cost",
        "cost",
        "error",
    )


@query(
    "output_token_rules",
    S.cte("calls")
    + """select call_id, greatest(500, input_tokens // 5) as preview, least(input_tokens, 4000) as batch,
    least(input_tokens // 10, 2000) as book, 1500 as fixed from calls""",
)
def output_token_rules(spark, root):
    n = F.col("input_tokens")
    return calls(spark, root).select(
        "call_id",
        M.output_preview(n).alias("preview"),
        M.output_batch(n).alias("batch"),
        M.output_book(n).alias("book"),
        F.lit(1500).alias("fixed"),
    )


TEMPLATE = "# Task for {title}\n\n{content}\n\nby {author}"


def _tokens(spark, root):
    """Chapters with the tokens of the rendered template: content, then title, then author. Texts
    are measured in the scan and stay there; the shuffle of the numbering moves their sizes."""
    from quire.operators.prompts import content_size, rendered_length

    small = chapter_source(spark, root).withColumn("content", content_size(F.col("content"), ["title", "author"]))
    values = {"title": title_or_default(F.col("title"), F.col("chapter_number")), "author": F.col("lang")}
    size = rendered_length(TEMPLATE, F.col("content"), values)
    return number_chapters(small).select("book_id", "chapter_id", F.ceil(size / 4).cast("bigint").alias("tokens"))


_SQL_RENDER = (
    f"replace(replace(replace({S.quoted(TEMPLATE)}, '{{content}}', content), '{{title}}', {S.shown_title()}), '{{author}}', lang)"
)
_SQL_DAY = f"(select coalesce(max(calls), 0) from daily where day = date '{AS_OF}')"
_SQL_MONTH = f"(select coalesce(max(month_cost), 0) from month_to_date where day = date '{AS_OF}')"


def _today(spark, root):
    """One row: the day's call count and the month's cost so far."""
    day = F.lit(AS_OF).cast("date")
    in_month = _ok(spark, root).filter(
        (ops.month_key(F.col("day")) == ops.month_key(day)) & (F.col("day") <= day)
    )
    return in_month.agg(
        F.count_if(F.col("day") == day).alias("day_calls"),
        F.coalesce(F.sum("cost"), F.lit(0)).cast(M.COST).alias("month_cost"),
        F.coalesce(F.sum(F.when(F.col("day") == day, F.col("cost"))), F.lit(0)).cast(M.COST).alias("day_cost"),
        F.coalesce(F.sum(F.when(F.col("day") == day, F.col("input_tokens") + F.col("output_tokens"))), F.lit(0)).alias("day_tokens"),
    )


def _with_today(spark, root, df):
    """Attach the one-row usage by a scalar subquery; no join."""
    use = _today(spark, root).select(F.struct("day_calls", "month_cost")).scalar()
    return df.withColumn("use", use).select(*df.columns, "use.day_calls", "use.month_cost")


@query(
    "request_preview",
    S.cte("chapters", "month_to_date")
    + f"""select chapter_id, tokens, output_tokens, cost, day_calls, month_cost, case when day_calls >= 100 then 'daily'
      when month_cost + cost > 5.00 then 'monthly' end as refused from (
      select *, {sql_cost('tokens', 'output_tokens', "'small'")} as cost, {_SQL_DAY} as day_calls, {_SQL_MONTH} as month_cost
      from (select chapter_id, tokens, greatest(500, tokens // 5) as output_tokens
            from (select chapter_id, {TOKENS.format(_SQL_RENDER)} as tokens from chapters)))""",
)
def request_preview(spark, root):
    n, out = F.col("tokens"), F.col("output_tokens")
    small = (
        _tokens(spark, root)
        .drop("book_id")
        .withColumn("output_tokens", M.output_preview(n))
        .withColumn("cost", M.cost(n, out, F.lit("small")))
    )
    return _with_today(spark, root, small).withColumn(
        "refused",
        ops.refusal(F.lit(LIMITS.enabled), F.col("day_calls"), F.col("month_cost"), F.col("cost"), LIMITS),
    )


@query(
    "batch_preview",
    S.cte("chapters")
    + f"""select book_id, chapter_id, sum(tokens + output_tokens)::bigint as tokens, sum(cost)::decimal(18,9) as cost, count(*) as chapters
    from (select *, {sql_cost('tokens', 'output_tokens', "'small'")} as cost from (
      select book_id, chapter_id, tokens, greatest(500, tokens // 5) as output_tokens
      from (select book_id, chapter_id, {TOKENS.format(_SQL_RENDER)} as tokens from chapters)))
    group by grouping sets ((book_id, chapter_id), (book_id))""",
)
def batch_preview(spark, root):
    """Chapter rows, and a total row per book where chapter_id is null."""
    n, out = F.col("tokens"), F.col("output_tokens")
    rows = (
        _tokens(spark, root)
        .withColumn("output_tokens", M.output_preview(n))
        .withColumn("cost", M.cost(n, out, F.lit("small")))
    )
    b, c = F.col("book_id"), F.col("chapter_id")
    return rows.groupingSets([[b, c], [b]], b, c).agg(
        F.sum(n + out).alias("tokens"), F.sum("cost").cast(M.COST).alias("cost"), F.count("*").alias("chapters")
    )


@query(
    "batch_missing",
    """with r as (select doc_id // 7 as batch, doc_id as chapter_id from labels union all select item_id, -1 - item_id from benchmark)
    select batch, count(*) as requested, count(*) filter (d.doc_id is null) as missing,
    case when count(*) filter (d.doc_id is null) > 0 then 'Some chapters not found' else 'ok' end as result
    from r left join (select doc_id from documents) d on d.doc_id = r.chapter_id group by batch""",
)
def batch_missing(spark, root):
    asked = (
        read_table(spark, root, "labels")
        .select(F.floor(F.col("doc_id") / 7).alias("batch"), F.col("doc_id").alias("chapter_id"))
        .unionByName(
            read_table(spark, root, "benchmark").select(
                F.col("item_id").alias("batch"), (-1 - F.col("item_id")).alias("chapter_id")
            )
        )
    )
    known = read_table(spark, root, "documents").select(F.col("doc_id").alias("chapter_id"), F.lit(True).alias("known"))
    missing = F.count_if(F.col("known").isNull())
    return (
        asked.join(known, "chapter_id", "left")
        .groupBy("batch")
        .agg(F.count("*").alias("requested"), missing.alias("missing"))
        .withColumn("result", F.when(F.col("missing") > 0, "Some chapters not found").otherwise("ok"))
    )


def _book_plan(spark, root):
    """Chapter and token totals per book; books without analysable chapters stay, with zeros."""
    rows = chapter_words(spark, root)
    ok = ~F.col("is_front_matter") & ~F.col("is_back_matter") & (F.col("words") >= 500)
    return (
        rows.groupBy("book_id")
        .agg(
            F.count_if(ok).alias("chapters"),
            F.coalesce(F.sum(F.when(ok, F.ceil(F.col("chars") / 4))), F.lit(0)).alias("tokens"),
        )
        .withColumn("input_tokens", 4 * F.col("tokens") + 250 * F.col("chapters"))
        .withColumn("output_tokens", 1450 * F.col("chapters") + 1100)
        .withColumn("requests", 4 * F.col("chapters") + 2)
    )


_SQL_PLAN = """plan as (select book_id, n as chapters, 4 * t + 250 * n as input_tokens, 1450 * n + 1100 as output_tokens, 4 * n + 2 as requests
  from (select book_id, count(*) filter (ok) as n, coalesce(sum(ceil(chars / 4)) filter (ok), 0)::bigint as t
  from (select *, not is_front_matter and not is_back_matter and words >= 500 as ok from chapter_words) group by book_id))"""


@query(
    "chapter_analysis_cost",
    S.cte("chapter_words")
    + f""", {_SQL_PLAN} select book_id, chapters, case when chapters = 0 then 0 else requests end as requests,
    case when chapters = 0 then 0 else input_tokens end as input_tokens, case when chapters = 0 then 0 else output_tokens end as output_tokens,
    case when chapters = 0 then 0 else {sql_cost('input_tokens', 'output_tokens', "'small'")} end as cost,
    case when chapters = 0 then 'No content chapters found' end as error from plan""",
)
def chapter_analysis_cost(spark, root):
    plan = _book_plan(spark, root)
    none = F.col("chapters") == 0

    def unless_empty(c):
        return F.when(none, F.lit(0).cast("bigint")).otherwise(c)

    price = M.cost(F.col("input_tokens"), F.col("output_tokens"), F.lit("small"))
    return plan.select(
        "book_id",
        "chapters",
        unless_empty(F.col("requests")).alias("requests"),
        unless_empty(F.col("input_tokens")).alias("input_tokens"),
        unless_empty(F.col("output_tokens")).alias("output_tokens"),
        F.when(none, F.lit(0).cast(M.COST)).otherwise(price).alias("cost"),
        F.when(none, "No content chapters found").alias("error"),
    )


BOOK_PROMPTS = 6


@query(
    "book_cost",
    S.cte("chapter_words")
    + f"""select *, {sql_cost('input_tokens * 6', 'output_tokens * 6', "'small'")} as cost,
    round({sql_cost('input_tokens * 6', 'output_tokens * 6', "'small'")}::double / 6, 9) as per_prompt
    from (select *, least(input_tokens // 10, 2000) as output_tokens from (
      select book_id, case when n = 0 then 0 else (chars + n - 1 + 3) // 4 end as input_tokens from (
        select book_id, count(*) filter (ok) as n, coalesce(sum(length(shown_title) + chars + 6) filter (ok), 0)::bigint as chars
        from (select *, not is_front_matter and not is_back_matter as ok from chapter_words) group by book_id)))""",
)
def book_cost(spark, root):
    """Tokens of the joined book text times the number of prompts.

    The joined text is never built: its length is the sum of the section lengths
    ('# title', blank line, text, blank line) and the separators.
    """
    rows = chapter_words(spark, root)
    ok = ~F.col("is_front_matter") & ~F.col("is_back_matter")
    size = F.length("shown_title") + F.col("chars") + 6
    books = rows.groupBy("book_id").agg(
        F.count_if(ok).alias("n"), F.coalesce(F.sum(F.when(ok, size)), F.lit(0)).alias("chars")
    )
    tokens = F.when(F.col("n") == 0, 0).otherwise(F.ceil((F.col("chars") + F.col("n") - 1) / 4)).cast("bigint")
    k = F.lit(BOOK_PROMPTS)
    price = M.cost(F.col("input_tokens") * k, F.col("output_tokens") * k, F.lit("small"))
    return (
        books.select("book_id", tokens.alias("input_tokens"))
        .withColumn("output_tokens", M.output_book(F.col("input_tokens")))
        .withColumn("cost", price)
        .withColumn("per_prompt", rounded(F.col("cost").cast("double") / k, 9))
    )


@query(
    "tpm_gate",
    S.cte("calls")
    + """select call_id, model, tokens, tpm, coalesce(tokens > tpm, false) as refused from (
    select call_id, case when status = 'failed' then 'retired' else model end as model, input_tokens * 20 + 1500 as tokens,
    case when status = 'failed' then null when model = 'large' then 30000 else 200000 end as tpm from calls)""",
)
def tpm_gate(spark, root):
    """Requests twenty times the ledger's size; a model without a known limit passes."""
    model = F.when(F.col("status") == "failed", "retired").otherwise(F.col("model"))
    tpm = F.when(model == "small", M.TPM_LIMITS["small"]).when(model == "large", M.TPM_LIMITS["large"])
    tokens = F.col("input_tokens") * 20 + 1500
    return calls(spark, root).select(
        "call_id",
        model.alias("model"),
        tokens.alias("tokens"),
        tpm.alias("tpm"),
        F.coalesce(tokens > tpm, F.lit(False)).alias("refused"),
    )


def _key_usage(spark, root):
    return ops.month_to_date(ops.daily_usage(_costed(spark, root), "budget_key"), "budget_key")


_KEY_USAGE = """kd as (select budget_key, day, count(*) as calls, sum(cost)::decimal(18,9) as cost from ok_calls group by all),
  ku as (select *, strftime(day, '%Y-%m') as month, (sum(cost) over (partition by budget_key, strftime(day, '%Y-%m') order by day))::decimal(18,9) as month_cost from kd)"""


@query(
    "budget_check",
    S.cte("ok_calls")
    + f""", {_KEY_USAGE} select budget_key, day, calls, month_cost, case when budget_key % 10 = 0 then 'emergency stop'
    when calls >= 2 then 'daily' when month_cost + 0.01 > 0.50 then 'monthly' end as refused from ku""",
)
def budget_check(spark, root):
    """The state at the end of each day against the next request of 0.01; every tenth key is switched off."""
    s = TIGHT
    return _key_usage(spark, root).select(
        "budget_key",
        "day",
        "calls",
        "month_cost",
        ops.refusal(
            F.col("budget_key") % 10 != 0, F.col("calls"), F.col("month_cost"), F.lit("0.01").cast(M.COST), s
        ).alias("refused"),
    )


@query(
    "budget_warnings",
    S.cte("ok_calls")
    + f""", {_KEY_USAGE} select budget_key, day, concat_ws('; ',
      case when calls * 100.0 / 5 >= 90 then 'Warning: 90% of daily summary limit used (' || calls || '/5)'
           when calls * 100.0 / 5 >= 80 then 'Warning: 80% of daily summary limit used (' || calls || '/5)' end,
      case when month_cost * 100 / 0.50 >= 90 then 'Warning: 90% of monthly budget used ($' || cast(month_cost as decimal(18,6)) || '/$0.50)'
           when month_cost * 100 / 0.50 >= 80 then 'Warning: 80% of monthly budget used ($' || cast(month_cost as decimal(18,6)) || '/$0.50)' end) as warnings from ku""",
)
def budget_warnings(spark, root):
    s = ops.Settings(monthly_limit="0.50", daily_limit=5)
    return _key_usage(spark, root).select(
        "budget_key", "day", F.array_join(ops.warnings(F.col("calls"), F.col("month_cost"), s), "; ").alias("warnings")
    )


@query(
    "budget_prefix",
    S.cte("ok_calls")
    + """, r as (select budget_key, call_id, day, cost, count(*) over (partition by budget_key, day order by call_id) - 1 as n,
      sum(cost) over (partition by budget_key, strftime(day, '%Y-%m') order by call_id) - cost as spent from ok_calls),
    f as (select *, case when n >= 4 then 'daily' when spent + cost > 0.50 then 'monthly' end as why from r),
    c as (select budget_key, min(call_id) filter (why is not null) as cut from f group by budget_key)
    select f.budget_key, f.call_id, case when cut is null or f.call_id < cut then 'admitted'
      when f.call_id = cut then 'refused: ' || why else 'not reached' end as outcome from f join c using (budget_key)""",
)
def budget_prefix(spark, root):
    run = ops.stop_at_first_refusal(_ok(spark, root), ops.Settings(monthly_limit="0.50", daily_limit=4))
    return run.select("budget_key", "call_id", "outcome")


@query(
    "budget_replay",
    S.cte(
        "ok_calls",
        extra={
            "o": "select budget_key, call_id, day, cost, row_number() over (partition by budget_key order by call_id) as i from ok_calls",
            "run": """select budget_key, i, call_id, day, 1 as n, case when cost <= 0.50 then cost else 0::decimal(18,9) end as spent,
              case when cost <= 0.50 then 'admitted' else 'monthly' end as outcome from o where i = 1
              union all
              select o.budget_key, o.i, o.call_id, o.day,
                case when why is null then n0 + 1 else n0 end, case when why is null then (s0 + o.cost)::decimal(18,9) else s0 end, coalesce(why, 'admitted')
              from (select o.*, case when run.day = o.day then run.n else 0 end as n0,
                      case when strftime(run.day, '%Y-%m') = strftime(o.day, '%Y-%m') then run.spent else 0::decimal(18,9) end as s0,
                      case when (case when run.day = o.day then run.n else 0 end) >= 2 then 'daily'
                           when (case when strftime(run.day, '%Y-%m') = strftime(o.day, '%Y-%m') then run.spent else 0::decimal(18,9) end) + o.cost > 0.50 then 'monthly' end as why
                    from run join o on o.budget_key = run.budget_key and o.i = run.i + 1) o""",
        },
    )
    + "select budget_key, call_id, outcome from run",
)
def budget_replay(spark, root):
    return ops.skip_and_continue(_ok(spark, root), TIGHT).select("budget_key", "call_id", "outcome")


@query(
    "preflight",
    S.cte("chapter_words", "calls")
    + f""", {_SQL_PLAN}, u as (select budget_key, count(*) as used from calls where status = 'ok' and day = date '{AS_OF}' group by budget_key)
    select book_id, requests, coalesce(used, 0) as used, greatest(0, 150 - coalesce(used, 0)) as remaining,
    requests <= 150 - coalesce(used, 0) as fits from (select *, {S.BOOK_NO} as budget_key from plan) left join u using (budget_key)""",
)
def preflight(spark, root):
    """Planned requests of a book against what is left of its key's 150 for the day."""
    from quire.sources.views import book_number

    used = (
        calls(spark, root)
        .filter((F.col("status") == "ok") & (F.col("day") == F.lit(AS_OF).cast("date")))
        .groupBy("budget_key")
        .agg(F.count("*").alias("used"))
    )
    plan = _book_plan(spark, root).withColumn("budget_key", book_number(F.col("book_id")).cast("bigint"))
    u = F.coalesce(F.col("used"), F.lit(0))
    return plan.join(used, "budget_key", "left").select(
        "book_id",
        "requests",
        u.alias("used"),
        F.greatest(F.lit(0), 150 - u).alias("remaining"),
        (F.col("requests") <= 150 - u).alias("fits"),
    )


@query("usage_daily", S.cte("daily") + "select * from daily")
def usage_daily(spark, root):
    return _daily(spark, root)


@query("usage_monthly", S.cte("month_to_date") + "select day, month, month_calls, month_tokens, month_cost from month_to_date")
def usage_monthly(spark, root):
    return ops.month_to_date(_daily(spark, root)).select("day", "month", "month_calls", "month_tokens", "month_cost")


@query(
    "usage_current",
    S.cte("ok_calls")
    + f""", {_KEY_USAGE}, d as (select * from ku where day = date '{AS_OF}')
    select budget_key, calls, month_cost, lim - calls as remaining, case when lim > 0 then round(calls::double / lim * 100, 2) else 0 end as day_percent,
    (5.00 - month_cost)::decimal(18,9) as month_remaining, round(month_cost::double / 5.00::double * 100, 2) as month_percent
    from (select *, budget_key % 4 as lim from d)""",
)
def usage_current(spark, root):
    """Per key on the day asked for; the daily limit is the key modulo 4, so some have none."""
    limit = F.col("budget_key") % 4
    month = F.lit("5.00").cast("decimal(10,2)")
    rows = _key_usage(spark, root).filter(F.col("day") == F.lit(AS_OF).cast("date"))
    return rows.select(
        "budget_key",
        "calls",
        "month_cost",
        (limit - F.col("calls")).alias("remaining"),
        M.percent(F.col("calls"), limit, 2).alias("day_percent"),
        (month - F.col("month_cost")).cast(M.COST).alias("month_remaining"),
        M.percent(F.col("month_cost"), month, 2).alias("month_percent"),
    )


@query(
    "usage_dashboard",
    S.cte("ok_calls")
    + f""", {_KEY_USAGE}, k as (select distinct user_id as budget_key from events)
    select budget_key, coalesce(calls, 0) as calls, greatest(0, 2 - coalesce(calls, 0)) as remaining,
    round(coalesce(calls, 0)::double / 2 * 100, 1) as day_percent, greatest(0::decimal(18,9), 0.50 - coalesce(month_cost, 0))::decimal(18,9) as month_remaining,
    round(coalesce(month_cost, 0)::double / 0.50::double * 100, 1) as month_percent
    from k left join (select * from ku where day = date '{AS_OF}') using (budget_key)""",
)
def usage_dashboard(spark, root):
    """Every key, zeros where the day has no row."""
    keys = read_table(spark, root, "events").select(F.col("user_id").alias("budget_key")).distinct()
    day = _key_usage(spark, root).filter(F.col("day") == F.lit(AS_OF).cast("date"))
    n = F.coalesce(F.col("calls"), F.lit(0))
    spent = F.coalesce(F.col("month_cost"), F.lit(0).cast(M.COST))
    month = TIGHT.month
    return keys.join(day, "budget_key", "left").select(
        "budget_key",
        n.alias("calls"),
        F.greatest(F.lit(0), TIGHT.day - n).alias("remaining"),
        M.percent(n, TIGHT.day, 1).alias("day_percent"),
        F.greatest(F.lit(0).cast(M.COST), (month - spent).cast(M.COST)).alias("month_remaining"),
        M.percent(spent, month, 1).alias("month_percent"),
    )


def usage_between(daily, days: int, as_of: str):
    """The last ``days`` days including ``as_of``, newest first; 1 to 365."""
    if not 1 <= days <= 365:
        raise ValueError("days must be between 1 and 365")
    end = F.lit(as_of).cast("date")
    return daily.filter(F.col("day").between(F.date_sub(end, days - 1), end)).orderBy(F.desc("day"))


@query(
    "usage_history",
    S.cte("month_to_date")
    + f"select day, calls, tokens, cost, month_calls, month_tokens, month_cost from month_to_date where day between date '{AS_OF}' - 13 and date '{AS_OF}'",
)
def usage_history(spark, root):
    return usage_between(ops.month_to_date(_daily(spark, root)).drop("month"), 14, AS_OF)


@query(
    "cost_reconcile",
    S.cte("costed")
    + f"""select call_id, estimate, cost as actual, (cost - estimate)::decimal(18,9) as difference, input_cost, output_cost
    from (select *, {sql_cost('input_tokens', '1500', 'model')} as estimate from costed where status = 'ok')""",
)
def cost_reconcile(spark, root):
    """Estimate with the full output allowance next to the cost of the real tokens."""
    estimate = M.cost(F.col("input_tokens"), F.lit(1500), F.col("model"))
    return _ok(spark, root).select(
        "call_id",
        estimate.alias("estimate"),
        F.col("cost").alias("actual"),
        (F.col("cost") - estimate).cast(M.COST).alias("difference"),
        "input_cost",
        "output_cost",
    )


@query(
    "settings_check",
    """with s as (select user_id, count(*) as n_rows, max(case when event_type = 'error' then -value when event_type <> 'view' then value end) as m,
      min(case when event_type = 'error' then -1 when event_type <> 'click' then cast(floor(value) as int) end) as d from events group by user_id)
    select user_id, n_rows, cast(coalesce(m, 5.00) as decimal(10,2)) as monthly_limit, coalesce(d, 100) as daily_limit, 'small' as default_model, true as enabled,
    concat_ws('; ', case when m < 0 then 'Monthly limit must be non-negative' end, case when d < 0 then 'Daily limit must be non-negative' end,
    case when n_rows <> 1 then 'More than one settings row' end) as violations from s""",
)
def settings_check(spark, root):
    """Proposed settings rows per user: defaults for missing fields, violations by name."""
    v, kind = F.col("value"), F.col("event_type")
    rows = (
        read_table(spark, root, "events")
        .groupBy("user_id")
        .agg(
            F.count("*").alias("n_rows"),
            F.max(F.when(kind == "error", -v).when(kind != "view", v)).alias("m"),
            F.min(F.when(kind == "error", -1).when(kind != "click", F.floor(v).cast("int"))).alias("d"),
        )
    )
    return rows.select(
        "user_id",
        "n_rows",
        F.coalesce(F.col("m"), F.lit(5.0)).cast("decimal(10,2)").alias("monthly_limit"),
        F.coalesce(F.col("d"), F.lit(100)).alias("daily_limit"),
        F.lit("small").alias("default_model"),
        F.lit(True).alias("enabled"),
        F.concat_ws(
            "; ",
            F.when(F.col("m") < 0, "Monthly limit must be non-negative"),
            F.when(F.col("d") < 0, "Daily limit must be non-negative"),
            F.when(F.col("n_rows") != 1, "More than one settings row"),
        ).alias("violations"),
    )

"""The registered queries: each operator over its whole table, and the SQL they are compared with."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import op1_decontaminate as op1
from quire.llm import op2_token_files as op2
from quire.llm import op3_shards as op3
from quire.llm import op4_substrings as op4
from quire.llm import op5_bpe as op5
from quire.llm import op6_quality as op6
from quire.llm import op7_fingerprints as op7
from quire.llm import op8_minhash as op8
from quire.llm import op9_suffix_arrays as op9
from quire.llm import op10_url_filter as op10
from quire.llm import op11_mixture as op11
from quire.llm import op12_fill_in_middle as op12
from quire.llm import op13_ranked_search as op13


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def importable(spark: SparkSession) -> None:
    """Python workers look for this package where the driver found it."""
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join(x for x in [root, *known] if x)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def sha(column: str) -> F.Column:
    return F.sha2(F.col(column).cast("binary"), 256)


WORD_SQL = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op1_decontaminate",
    f"""
with d as (select doc_id, regexp_extract_all({LOWER_SQL}, {WORD_SQL}) w from documents),
b as (select item_id, regexp_extract_all({LOWER_SQL}, {WORD_SQL}) w from benchmark),
p as (select distinct item_id, least(len(w), 10) n, array_to_string(w[i:i + 9], ' ') x
      from (select item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) i from b where len(w) > 0)),
o as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') x
      from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from d, (select distinct n from p) where len(w) >= n)),
h as (select doc_id, item_id, i, p.n from o join p on p.x = o.x and p.n = o.n),
k as (select doc_id, count(distinct j) n_hit from (select doc_id, unnest(range(i, i + n)) j from h) group by doc_id),
m as (select doc_id, count(distinct item_id) n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) s from h group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
       sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join k using (doc_id) left join m using (doc_id)""",
)
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = op1.decontaminate(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return docs.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


@query("op2_token_files")
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = op2.files_path(spark)
    op2.write_ids(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), path)
    return op2.read_documents(spark, path, with_ids=False)


@query(
    "op3_histogram_shards",
    """
with recursive c(i, v, k) as (
  select i, i, 0 from (select unnest(range(256)) i)
  union all
  select i, case when v % 2 = 1 then xor(3988292384, v // 2) else v // 2 end, k + 1 from c where k < 8),
t as (select list(v order by i) tab from c where k = 8),
s as (select doc_id, cast(strlen(coalesce(text, '')) + 1 as bigint) size,
             list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: cast('0x' || x as bigint))) b
      from documents),
o as (select *, cast(sum(size) over (order by doc_id) - size as bigint) before, sum(size) over () total from s),
h as (select doc_id, size, b, cast(8 * before // total as int) shard from o)
select doc_id, size, cast(xor(list_reduce(b, lambda r, x: xor(r // 256, tab[xor(r, x) % 256 + 1])), 4294967295) as bigint) text_crc32, 'bytes' law, shard,
       cast(row_number() over (partition by shard order by doc_id) - 1 as bigint) slot, cast(null as int) grown_shard
from h, t""",
)
def op3_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = op3.write_shards(table(spark, sf_dir, "documents", "doc_id", "text"), op3.shard_path(spark))
    return shards.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query(
    "op4_substring_dedup",
    r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
o as (select doc_id, i, array_to_string(w[i:i + 12], ' ') x from (select doc_id, w, unnest(range(1, len(w) - 11)) i from d)),
r as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by x) f from o) where f < doc_id),
g as (select distinct doc_id, unnest(range(i, i + 13)) j from r),
k as (select d.doc_id, count(g.j) n_removed, string_agg(case when g.j is null then x end, ' ' order by p.j) kept
      from (select doc_id, unnest(w) x, unnest(range(1, len(w) + 1)) j from d) p join d using (doc_id) left join g on g.doc_id = p.doc_id and g.j = p.j group by d.doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_removed, 0) as bigint) n_removed, sha256(coalesce(kept, '')) kept_sha256
from d left join k using (doc_id)""",
)
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = op4.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return docs.select("doc_id", "n_words", "n_removed", sha("kept").alias("kept_sha256"))


@query("op5_bpe")
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = op5.encode(table(spark, sf_dir, "documents", "doc_id", "text"), path, public_tokenizers.PATTERN)
    docs = op5.decode(docs.select("doc_id", "n_tokens", "ids"), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return docs.select("doc_id", "n_tokens", F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang")
    docs = op6.classify(docs, table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"), keep_text=False)
    return docs.select("doc_id", "source", "lang", "evidence", "host_rate", "path_rate", "score", "rejected")


@query("op7_edit_fingerprints")
def op7_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7.compare_with_next(table(spark, sf_dir, "documents", "doc_id", "text"))


@query(
    "op8_minhash",
    rf"""
with recursive d as (select doc_id, regexp_extract_all({LOWER_SQL}, '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 3], ' ') x from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) i from d where len(w) > 0)),
c as (select doc_id, count(*) n from s group by doc_id),
p as (select a.doc_id a, b.doc_id b, count(*) k from s a join s b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from p join c x on x.doc_id = a join c y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
g as (select a, b from e union all select b, a from e),
r as (select doc_id id, doc_id root from d union select g.b, r.root from r join g on g.a = r.id)
select d.doc_id, cast(coalesce(n, 0) as bigint) n_shingles, min(root) component_id, d.doc_id = min(root) kept
from d left join c using (doc_id) join r on r.id = d.doc_id group by d.doc_id, n""",
)
def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


@query(
    "op9_suffix_array_dedup",
    """
with d as (select doc_id, hex(encode(coalesce(text, ''))) h, cast(strlen(coalesce(text, '')) as bigint) n from documents),
o as (select doc_id, i, substr(h, 2 * i + 1, 200) x from (select doc_id, h, unnest(range(0, n - 99)) i from d)),
r as (select doc_id, i from (select doc_id, i, row_number() over (partition by x order by doc_id, i) f from o) where f > 1),
s as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 100 then 0 else 1 end new from r),
t as (select doc_id, i, sum(new) over (partition by doc_id order by i) g from s),
u as (select doc_id, min(i) a, max(i) + 100 b from t group by doc_id, g),
v as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) p from u),
k as (select doc_id, sum(b - a) n_removed, count(*) n_spans, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' order by a) || substr(any_value(h), 2 * max(b) + 1) kept
      from v join d using (doc_id) group by doc_id)
select doc_id, n n_bytes, cast(coalesce(n_removed, 0) as bigint) n_removed, cast(coalesce(n_spans, 0) as bigint) n_spans, sha256(unhex(coalesce(kept, h))) kept_sha256
from d left join k using (doc_id)""",
)
def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = op9.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    spans = F.coalesce(F.size("removed"), F.lit(0))
    return docs.select("doc_id", "n_bytes", "n_removed", F.greatest(spans, F.lit(0)).cast("long").alias("n_spans"), sha("kept").alias("kept_sha256"))


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query(
    "op10_url_filter",
    f"""
with r(h, p, v) as (values {', '.join(str(x) for x in RULES)}),
a as (select page_id, case when contains(url, '://') then substr(url, position('://' in url) + 3) else '' end rest from pages),
b as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from a),
m as (select page_id, arg_max(h || p, len(h || p)) rule, arg_max(v, len(h || p)) verdict from b join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id)
select b.page_id, host, path, rule, coalesce(verdict, 'allow') verdict from b left join m using (page_id)""",
)
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return op10.filter_urls(table(spark, sf_dir, "pages", "page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


@query(
    "op12_fill_in_middle",
    """
with d as (select doc_id, coalesce(text, '') t, cast(length(coalesce(text, '')) as bigint) n, sha256('1:' || cast(doc_id as varchar)) x from documents),
h as (select doc_id, t, n, cast('0x' || substr(x, 1, 8) as bigint) % (n + 1) a, cast('0x' || substr(x, 9, 8) as bigint) % (n + 1) b,
             cast('0x' || substr(x, 17, 8) as bigint) % 100 c, cast('0x' || substr(x, 25, 8) as bigint) % 100 e from d),
f as (select doc_id, t, n, least(a, b) i, greatest(a, b) j,
             case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or c >= 90 then 'plain' when e < 20 then 'spm' else 'psm' end form from h),
p as (select *, substr(t, 1, i) pre, substr(t, i + 1, j - i) mid, substr(t, j + 1) suf from f)
select doc_id, n, form, case when form <> 'plain' then i end prefix_chars, case when form <> 'plain' then j - i end middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) output_sha256,
       sha256(t) restored_sha256
from p""",
)
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = op12.transform(table(spark, sf_dir, "documents", "doc_id", "text"))
    again = op12.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output").alias("output_sha256"), F.sha2(again.cast("binary"), 256).alias("restored_sha256"))


@query(
    "op11_mixture",
    r"""
with recursive d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) size,
                            cast('0x' || substr(md5('1:' || cast(doc_id as varchar)), 1, 15) as bigint) x from documents),
s as (select source, row_number() over (order by source nulls last) - 1 rank, cast(sum(size) as bigint) source_size, cast(ceil(count(*) / 65536) as bigint) shards from d group by source),
w as (select *, case rank % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end weight, cast(3 * source_size as double) lim, cast(sum(source_size) over () as double) goal from s),
v as (select *, (goal - coalesce(sum(lim) over (order by lim / cast(weight as double), rank rows between unbounded preceding and 1 preceding), 0.0))
                / cast(sum(weight) over (order by lim / cast(weight as double), rank rows between current row and unbounded following) as double) lev from w),
u as (select arg_min(lev, row(lim / cast(weight as double), rank)) filter (where lev * cast(weight as double) <= lim) lev from v),
t as (select source, rank, source_size, shards, goal, coalesce(least(lim, u.lev * cast(weight as double)), lim) target from v, u),
b as (select greatest(1, least(1024, cast(max(goal) as bigint) // 1048576)) b, cast(floor(max(goal) / greatest(1, least(1024, cast(max(goal) as bigint) // 1048576)) + 0.5) as bigint) seats from t),
q as (select rank, count(*) n from (select rank, row_number() over (order by target / cast(2 * k + 1 as double) desc, rank, k) p
      from (select rank, target, unnest(range(0, cast(target / b as bigint) + 3)) k from t, b)), b where p <= seats group by rank),
l as (select d.*, t.rank, source_size, target, x % shards shard from d join t on d.source is not distinct from t.source),
h as (select rank, shard, cast(sum(size) as bigint) words, case when sum(size) > 0 then greatest(1, cast(round(cast(sum(size) as double) / max(b)) as bigint)) else 0 end blocks from l, b group by rank, shard),
r as (select rank, shard, count(*) n from (select rank, shard, n, row_number() over (partition by rank order by cast(words as double) / cast(2 * k + 1 as double) desc, shard, k) p
      from (select h.rank, shard, words, n, unnest(range(0, n)) k from h join q on q.rank = h.rank)) where p <= n group by rank, shard),
g as (select h.rank, h.shard, words, blocks, least(coalesce(n, 0), 3 * blocks) quota from h left join r on r.rank = h.rank and r.shard = h.shard),
e as (select *, unnest(range(0, blocks)) i from g where blocks > 0),
f as (select rank, shard, i * words // blocks lo, (i + 1) * words // blocks hi,
             quota // blocks + case when row_number() over (partition by rank, shard order by cast('0x' || substr(md5('1:block:' || rank || ':' || shard || ':' || i), 1, 15) as bigint), i) <= quota % blocks then 1 else 0 end times from e),
a as (select *, cast(coalesce(sum(size) over (partition by rank, shard order by x, doc_id, size rows between unbounded preceding and 1 preceding), 0) as bigint) pos from l),
z as (select a.rank, a.shard, pos, sum((least(hi, pos + size) - greatest(lo, pos)) * times) taken from a join f on f.rank = a.rank and f.shard = a.shard and lo < pos + size and hi > pos where size > 0 group by 1, 2, 3)
select doc_id, size, source_size, target, cast(coalesce(taken, 0) as bigint) taken
from a left join z on z.rank = a.rank and z.shard = a.shard and z.pos = a.pos and size > 0""",
)
def op11_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = op11.mix(spark, table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return made.select("doc_id", "size", "source_size", "target", "taken")


TERM_SQL = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"


@query(
    "op13_ranked_search",
    f"""
with d as (select doc_id, regexp_extract_all({LOWER_SQL}, {TERM_SQL}) w from documents),
g as (select cast(count(*) as bigint) n_docs, cast(sum(len(w)) as bigint) total from d where len(w) > 0),
p as (select doc_id, t, any_value(n) n, count(*) tf from (select doc_id, cast(len(w) as bigint) n, unnest(w) t from d) group by doc_id, t),
f as (select t, cast(count(*) as bigint) df from p group by t),
q as (select item_id, t, count(*) times from (select item_id, unnest(regexp_extract_all({LOWER_SQL}, {TERM_SQL})) t from benchmark) group by item_id, t),
s as (select item_id, doc_id, cast(sum(times * cast(floor(1000 * ln(cast(2 * n_docs + 2 as double) / cast(2 * df + 1 as double))) as bigint)
             * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // total)))) as bigint) score
      from q join f using (t) join p using (t), g group by item_id, doc_id)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) rank, doc_id, score from s where score > 0
qualify row_number() over (partition by item_id order by score desc, doc_id) <= 10""",
)
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = op13.index_path(spark)
    op13.write_index(spark, table(spark, sf_dir, "documents", "doc_id", "text"), path)
    return op13.search(spark, path, table(spark, sf_dir, "benchmark", "item_id", "text"))

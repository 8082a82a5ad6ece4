"""Values of the classifier in plain Python, and empty tables, null ids, repeated rows."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import op2_token_files as op2
from quire.llm import op3_shards as op3
from quire.llm import op5_bpe as op5
from quire.llm import op6_quality as op6
from quire.llm import op7_fingerprints as op7
from quire.llm import op10_url_filter as op10
from quire.llm.queries import QUERIES

ROOT = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ROWS = [(None, "null id"), (None, "null id"), (1, "same row"), (1, "same row"), (1, "other text"), (2, None), (None, None), (3, "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id bigint, text string")


def strength(sites, prior):
    """Of a Beta prior, by how much the rates of sites (n, bad) differ beyond chance."""
    n = sum(s[0] for s in sites)
    spread = sum(s[0] * (s[1] / s[0] - p) ** 2 for s, p in zip(sites, prior))
    chance, v = sum(p * (1 - p) for p in prior), sum(s[0] * p * (1 - p) for s, p in zip(sites, prior))
    between = max((spread - chance) / n, 1e-9)
    return min(max(v / n / between - 1, 1.0), 1e6)


def test_posteriors_and_scores_in_plain_python(spark):
    rows = QUERIES["op6_quality"](spark, ROOT).collect()
    paths, hosts = defaultdict(lambda: [0, 0.0]), defaultdict(lambda: [0, 0.0])
    for r in rows:
        for table, key in ((paths, (r.source, r.lang)), (hosts, r.source)):
            table[key][0] += 1
            table[key][1] += 1 / (1 + math.exp(-r.evidence))
    rate = sum(b for _, b in hosts.values()) / len(rows)
    k = strength(list(hosts.values()), [rate] * len(hosts))
    host_rate = {h: (bad + k * rate) / (n + k) for h, (n, bad) in hosts.items()}
    k = strength(list(paths.values()), [host_rate[h] for h, _ in paths])
    path_rate = {p: (bad + k * host_rate[p[0]]) / (n + k) for p, (n, bad) in paths.items()}
    logit = lambda p: math.log(p / (1 - p))
    for r in rows:
        p = path_rate[(r.source, r.lang)]
        assert r.host_rate == pytest.approx(host_rate[r.source], rel=1e-6) and r.path_rate == pytest.approx(p, rel=1e-6)
        odds = r.evidence + logit(p) - logit(rate)
        assert r.score == pytest.approx(1 / (1 + math.exp(-odds)), abs=2e-6) and r.rejected == (r.score > op6.THRESHOLD)
    assert len({r.rejected for r in rows}) == 2


def test_a_walk_in_plain_python():
    """Step j reads the character under the pointer, puts out bit 1 of its rule and moves on by bit 0."""
    for text in ("a", "hello, wörld " * 30, "日本" * 700):
        at, out = 0, []
        while at < len(text):
            rule = op7.RULES[len(out) % op7.PERIOD][ord(text[at]) % op7.CLASSES]
            out.append(int(rule >> 1))
            at += int(rule & 1)
        units, bits = op7.walks([text])
        assert units[0] == -(-len(out) // 64)
        for k in range(op7.STRETCHES):
            for i, j in enumerate(op7.SAMPLES[k].tolist()):
                if j < len(out):
                    assert int(bits[0, k] >> np.uint64(i)) & 1 == out[j]


def test_token_files_of_odd_tables(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    op2.write_ids(docs, WORDS, str(tmp_path / "a"))
    got = op2.read_documents(spark, str(tmp_path / "a")).collect()
    want = Counter((i, tuple([*t.encode(x or "", add_special_tokens=False).ids, 1])) for i, x in ROWS)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    assert sorted(r.start for r in got) == np.cumsum([0] + [r.n_tokens for r in sorted(got, key=lambda r: r.start)])[:-1].tolist()
    ids = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in ids] == sorted((r.doc_id for r in got), key=lambda i: (i is not None, i or 0))
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    op2.write_ids(docs.limit(0), WORDS, str(tmp_path / "b"))
    assert op2.read_documents(spark, str(tmp_path / "b")).count() == 0


def test_registered_token_files_and_fingerprints_run(spark):
    n = spark.read.parquet(f"{ROOT}/documents.parquet").count()
    for name in ("op2_token_files", "op7_edit_fingerprints"):
        rows = QUERIES[name](spark, ROOT).collect()
        assert len(rows) == n == len({r.doc_id for r in rows})


def test_shards_of_odd_tables(spark, docs):
    got = op3.write_shards(docs, op3.shard_path(spark)).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(ROWS)
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert op3.write_shards(docs.limit(0), op3.shard_path(spark)).count() == 0


def test_bpe_of_odd_tables(spark, docs):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=op5.vocabulary(RANKS).rank, special_tokens={})
    got = op5.encode(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((i, tuple(library.encode_ordinary(x or ""))) for i, x in ROWS)


def test_url_filter_without_rules_and_with_repeated_pages(spark):
    pages = spark.createDataFrame([(1, "http://A.com/x"), (1, "http://A.com/x"), (None, None)], "page_id bigint, url string").withColumn("__made", F.lit("kept"))
    none = spark.createDataFrame([], "host string, path string, verdict string")
    got = op10.filter_urls(pages, none).collect()
    assert sorted(map(str, got)) == sorted(map(str, [*[r for r in got if r.page_id == 1], *[r for r in got if r.page_id is None]])) and len(got) == 3
    assert all(r.rule is None and r.verdict == "allow" and r["__made"] == "kept" for r in got)
    one = spark.createDataFrame([("com", "/", "block")], none.schema)
    assert [(r.host, r.verdict) for r in op10.filter_urls(pages, one).collect() if r.page_id] == [("a.com", "block")] * 2


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, ROOT).collect() == [], name

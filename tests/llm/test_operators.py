import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
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
from quire.llm.queries import ORACLES, QUERIES
from tests.compare import connect, diff
from tests.llm import brute

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ROOT = "/root/testdata/sf0.001"


def corpus(seed=5, n=90):
    """Texts that share pieces, copies, near copies, repeats inside a text, null, empty, blank, very long ones."""
    rng = random.Random(seed)
    vocabulary = ["ab", "c", "d é", "E", "F.", "gh", "日本", "x,", "\n"]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    base = [text(70) for _ in range(6)]
    rows = []
    for i in range(n):
        a, b = rng.choice(base), rng.choice(base)
        cut = rng.randrange(60)
        kind = i % 9
        if kind == 0:
            body = rng.choice([None, "", "  ", "C"])
        elif kind == 1:
            body = a
        elif kind == 2:
            body = a.replace("c", "changed", 1)
        elif kind == 3:
            body = "abcab" * rng.randrange(10, 80)
        else:
            body = a[cut : cut + rng.randrange(40, 200)] + text(rng.randrange(30)) + b[rng.randrange(50) :]
        rows.append(((i * 7) % n, body))
    return rows + [(n, text(30000))]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    """With columns named like results and helpers."""
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string").repartition(5)
    clash = ["n_words", "_id", "_hash", "spans", "kept", "ids", "size", "shard", "id", "token", "a", "evidence"]
    return df.withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture(scope="module")
def nulls(spark):
    """Null ids, repeated rows, ids with several texts; and no rows."""
    long = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen " * 3
    rows = [(None, long), (None, long), (1, long), (1, long), (1, "other words"), (None, None), (2, None), (3, long + "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df, df.limit(0)


def test_decontaminate(spark, docs):
    items = [(1, ROWS[1][1]), (2, ROWS[4][1][:30]), (3, "c"), (4, None), (5, ""), (None, ROWS[5][1]), (12, "GH 日本"), (12, "gh"), (7, ROWS[1][1])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for size in (1 << 20, 4000):  # one block of patterns and several
        got = op1.decontaminate(docs, bench, block_bytes=size).collect()
        assert sorted((r.doc_id, r.n_words, r.n_hit, r.hit_items) for r in got) == sorted(brute.contaminated(ROWS, items))
        assert all(r.contaminated == (r.n_hit > 0) == bool(r.hit_spans) for r in got)


def test_token_files(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    for bits in (1, 8):
        path = str(tmp_path / str(bits))
        op2.write_ids(docs, WORDS, path, bits=bits)
        at = 0
        got = {r.doc_id: r for r in op2.read_documents(spark, path).collect()}
        for i, text in sorted(ROWS):
            ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
            r = got[i]
            assert (r.start, r.n_tokens, r.ids_crc32, r.ids) == (at, len(ids), zlib.crc32(ids.tobytes()), ids.tolist())
            at += len(ids)


def test_word_units_equal_the_library():
    from tokenizers import Tokenizer
    import pyarrow as pa

    from quire.llm.common import text_bytes

    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    rng = random.Random(1)
    parts = [" ", "\n", "a", "B", "é", "日", "12", "'s", "'S", "!", "!!", "\u3000", "\x01", "\x1c", "\u0301", "€,", "Σ", "A,", "!'s", "x'", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(1500)]
    ids, first = op5.text_ids(*text_bytes(pa.array(texts)), op2.Units(WORDS).encode, op2.word_units)
    for k, e in enumerate(t.encode_batch(texts, add_special_tokens=False)):
        assert ids[first[k] : first[k + 1]].tolist() == e.ids, repr(texts[k])


def test_added_tokens_equal_the_untouched_library(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    rng = random.Random(2)
    parts = [" ", "a", "B", "é", "日", "'s", "!", "<", "<|", "|>", "\u0301", "\x01", "endoftext", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof"]
    texts = ["see <|endoftext|> here", "<|endof", "text|>", None, "<|endoftext|>"] + ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(600)]
    op2.write_ids(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), WORDS, str(tmp_path / "t"))
    got = {r.doc_id: r.ids for r in op2.read_documents(spark, str(tmp_path / "t")).collect()}
    for i, text in enumerate(texts):
        assert got[i] == [*t.encode(text or "", add_special_tokens=False).ids, 1], repr(text)


@pytest.mark.parametrize("n", [0, 1, 65536, 200001])
def test_planes_round_trip(n):
    ids = np.random.default_rng(n).integers(0, 1 << 20, n).astype(np.uint32)
    for bits in (1, 8):
        data = op2.pack(ids, bits)
        assert (op2.unpack(data) == ids).all() and (op2.unpack(data, 5, 70000) == ids[5:70000]).all()


@pytest.mark.parametrize("ids", [[i for i, _ in ROWS], [7] * len(ROWS), [10**15 * (i % 3) - 5 for i, _ in ROWS]])
def test_shards(spark, ids, tmp_path):
    rows = [(i, t) for i, (_, t) in zip(ids, ROWS)]
    got = op3.write_shards(spark.createDataFrame(rows, "doc_id bigint, text string"), str(tmp_path / "s"), 4).collect()
    assert len(got) == len(rows)
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.size == len((r.text or "").encode()) + 1 for r in got)
    if len(set(ids)) == len(ids):
        before, total = 0, sum(r.size for r in got)
        for r in sorted(got, key=lambda r: r.doc_id):
            assert r.shard == 4 * before // total
            before += r.size


@pytest.mark.parametrize("ids", [[None, *range(1001)], [k * (1 << 64) // 1000 - (1 << 63) for k in range(1000)], [k * (1 << 45) - 1 for k in range(1, 1001)], [k << 54 for k in range(-500, 500)]])
def test_shards_of_null_and_sparse_ids(spark, ids, tmp_path):
    rows = [(i, "x" * (k * k % 50)) for k, i in enumerate(ids)]
    got = op3.write_shards(spark.createDataFrame(rows, "doc_id bigint, text string"), str(tmp_path / "s"), 8).collect()
    before, total, first = 0, sum(r.size for r in got), {}
    assert len(got) == len(rows)
    for n, r in enumerate(sorted(got, key=lambda r: -(1 << 63) if r.doc_id is None else r.doc_id)):
        assert r.shard == 8 * before // total
        assert r.slot == n - first.setdefault(r.shard, n)
        before += r.size


def test_slots_are_ranks_in_the_shard(spark, tmp_path, monkeypatch):
    """Shards of many buckets: dense, far and null ids, and one id of many texts."""
    monkeypatch.setattr(op3, "BUCKET_ROWS", 20)
    rows = [(i, f"x{i}") for i in [*range(2000), *(1 << (k % 62) for k in range(300)), *[77] * 30, None]] + [(55, f"y{k}") for k in range(300)]
    got = op3.write_shards(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("k", F.xxhash64("text")), str(tmp_path / "s"), 4).collect()
    shard, at = 0, {}
    assert len(got) == len(rows)
    for r in sorted(got, key=lambda r: (-(1 << 63) if r.doc_id is None else r.doc_id, r.k, r.slot)):
        assert r.shard >= shard and r.slot == at.get(r.shard, 0)
        shard, at[r.shard] = r.shard, r.slot + 1
    assert len(at) == 4


def test_substrings(docs):
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in op4.remove_repeats(docs, 7).collect()]
    assert sorted(got) == sorted(brute.repeated_words(ROWS, 7))


@pytest.mark.parametrize("size, piece", [(100, 3 << 20), (20, 400)])
def test_suffix_arrays(docs, size, piece):
    rows = [r for r in ROWS if len(r[1] or "") < 20000]
    got = op9.remove_repeats(docs.where(F.coalesce(F.length("text"), F.lit(0)) < 20000), size, piece_bytes=piece).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.removed or []), bytes(r.kept)) for r in got) == sorted(brute.repeated_bytes(rows, size))


def test_equal_rows_of_several_blocks_lose_all_repeats(spark, monkeypatch):
    """Blocks of one text: each of three equal rows is in a block of its own, and the repeats
    have many anchors, so their shards meet the blocks in different orders."""
    monkeypatch.setattr(op9, "BLOCK_BYTES", 1)
    rng = random.Random(8)
    part = ["".join(rng.choices("abcdefghijklmnop", k=400)) for _ in range(12)]
    rows = [(i, x) for i, x in enumerate(part)] + [(100, "-".join(part))] * 3 + [(101, "+".join(part[:6]))] * 2
    got = op9.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()
    want = {r[0]: r[1:] for r in brute.repeated_bytes(list(dict(rows).items()), 100)}
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, len(r.removed or []), bytes(r.kept)) == want[r.doc_id]


def test_spans_of_blocks_unite(spark):
    rows = [([[(0, 100)], [(50, 160), (300, 400)], [(160, 200)]],), ([[(5, 105)]],), ([[(0, 100), (200, 300)], [(250, 350)], [(0, 100)]],)]
    df = spark.createDataFrame(rows, f"lists array<{op9.SPANS}>").select(op9.united("lists").alias("spans"))
    assert [[(s.start, s.end) for s in r.spans] for r in df.collect()] == [[(0, 200), (300, 400)], [(5, 105)], [(0, 100), (200, 350)]]


HOT = "a phrase of ninety bytes that stands in very many of the texts, with other bytes round it"


def test_hot_anchor_is_dealt_to_all_shards(spark):
    import pyarrow as pa

    from quire.llm.common import text_bytes, unz

    rng = random.Random(9)
    texts = ["".join(rng.choices("bcdfgh", k=70)) + HOT + "".join(rng.choices("bcdfgh", k=70)) for _ in range(200)]
    h = op9.anchor_places(*text_bytes(pa.array(texts)), 100)[1]
    values, count = np.unique(h, return_counts=True)
    hot = values[count > 20] ^ np.uint64(1)
    df = spark.createDataFrame([(i, i, x, bytearray(hot.tobytes())) for i, x in enumerate(texts)], "_id bigint, _hash bigint, text string, anchors binary")
    windows = [0] * 8
    for r in df.mapInArrow(op9.regions(100, 8, "text"), op9.ROW).where("not whole").collect():
        windows[r.bucket] += int((unz(r.b, np.int64) - 99).sum())
    assert sum(windows) > 500 and max(windows) < 2 * sum(windows) / 8


@pytest.mark.parametrize("hot", [2, 1 << 40])
def test_suffix_arrays_with_hot_anchors(spark, hot):
    rng = random.Random(10)
    around = ["".join(rng.choices("bcdfgh", k=60)) for _ in range(12)]
    rows = [(i, rng.choice(around) + HOT + rng.choice(around) + "x" * rng.randrange(130)) for i in range(80)] + [(None, None), (200, "")]
    got = op9.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), piece_bytes=4000, hot=hot).collect()
    assert sorted((r.n_bytes, r.n_removed, len(r.removed or []), bytes(r.kept)) for r in got if r.doc_id is not None) == sorted(x[1:] for x in brute.repeated_bytes(rows[:80] + rows[81:], 100))


def test_suffix_array_and_common_prefixes():
    rng = random.Random(2)
    for _ in range(30):
        b = bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 400))) * rng.choice([1, 3])
        eight = op9.words_at(np.frombuffer(b, np.uint8))
        order, tied = op9.suffix_array(eight, 32)
        assert [b[i : i + 32] for i in order] == sorted(b[i : i + 32] for i in range(len(b)))
        common = op9.kasai(eight, order, tied, 32, lane=rng.choice([1, 7, 256]))
        for k in range(1, len(b)):
            x, y = b[order[k - 1] :], b[order[k] :]
            n = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
            assert min(n, 32) == min(common[k], 32)


def test_bpe(docs):
    v = op5.vocabulary(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.rank, special_tokens={})
    for limit in (0, 20, 1 << 18):
        got = op5.decode(op5.encode(docs, RANKS, public_tokenizers.PATTERN, limit=limit), RANKS).collect()
        assert len(got) == len(ROWS)
        for r in got:
            assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode() and r.n_tokens == len(r.ids)


def test_quality_held_out(spark):
    """Fitted on the labels of even ids, right on those of odd ids."""
    root = "/root/testdata/sf0.1"
    documents, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    got = op6.classify(documents, labels.where("doc_id % 2 = 0"), keep_text=False)
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    odd = got.join(labels.where("doc_id % 2 = 1"), "doc_id")
    r = odd.agg(F.avg((F.col("rejected") == bad).cast("int")).alias("right"), F.avg(F.when(~bad, F.col("rejected").cast("int"))).alias("lost"), F.avg(F.when(bad, F.col("rejected").cast("int"))).alias("caught")).first()
    assert r.right > 0.97 and r.lost < 0.005 and r.caught > 0.88, r


def test_sites_shrink(spark):
    rows = [("big", "a", 0.0)] * 400 + [("big", "b", 3.0)] * 2 + [("small", "a", 3.0)] * 2 + [(None, None, -3.0)] * 300
    rates = {(r.host, r.path): r for r in op6.site_rates(spark.createDataFrame(rows, "h string, p string, evidence double"), "h", "p").collect()}
    assert abs(rates[("big", "a")].path_rate - 0.5) < 0.05  # many documents: its own rate
    assert rates[("small", "a")].path_rate < 0.95  # two documents: drawn to the prior
    assert set(rates) == {("big", "a"), ("big", "b"), ("small", "a"), (None, None)}


def test_fingerprints(docs):
    got = {r.doc_id: r for r in op7.compare_with_next(docs).collect()}
    ids = sorted(got)
    texts = dict(ROWS)
    prints = {}
    for i, k in zip(ids, ids[1:] + ids[:1]):
        a = texts[i] or ""
        e = op7.edited(a, texts[k] or "")
        assert (got[i].n_chars, got[i].edited_sha256) == (len(a), hashlib.sha256(e.encode()).hexdigest())
        f = op7.write(*op7.walks([a, e, texts[k] or ""]))
        assert [got[i].fingerprint, got[i].edited_fingerprint] == f[:2]
        assert prints.setdefault(a, f[0]) == f[0]
        assert (got[i].near_edited, got[i].near_next) == tuple(op7.likeness(f[:1] * 2, f[1:]))


def test_few_edits_stay_near():
    a = dict(ROWS)[90][:4000]
    rng = random.Random(3)
    for k in (1, 10):
        b = list(a)
        for _ in range(k):
            p = rng.randrange(len(b))
            b[p : p + 1] = rng.choice([[], ["q"], [b[p], "z"]])
        f = op7.write(*op7.walks([a, "".join(b), a[::-1]]))
        assert op7.likeness(f[:1], f[1:2])[0] > 0.8 > 0.5 > op7.likeness(f[:1], f[2:])[0]


def test_near_pairs(spark, docs):
    f = op7.compare_with_next(docs).select("doc_id", "fingerprint")
    base = dict(ROWS)[90]
    made = op7.write(*op7.walks([base, base.replace("gh", "hg", 3)]))
    f = f.union(spark.createDataFrame([(1000, made[1])], "doc_id bigint, fingerprint string"))
    assert (90, 1000) in {(r.a, r.b) for r in op7.near_pairs(f).collect()}


def test_near_pairs_recall(spark):
    """Against brute force, texts on either side of a power of two included; groups with several
    pairs."""
    rng = random.Random(12)
    texts = []
    for n in (300, 500, 520, 900, 1040, 2000):
        for _ in range(6):
            base = rng.choices("abcdefghijkl mnop", k=n)
            for _ in range(6):
                other = list(base)
                for _ in range(rng.randrange(n // 40)):
                    p = rng.randrange(len(other))
                    other[p : p + 1] = rng.choice([[], ["q"], [other[p], "z"]])
                texts.append("".join(other))
    prints = sorted(set(op7.write(*op7.walks(texts))))
    i, j = np.triu_indices(len(prints), 1)
    near = op7.likeness([prints[k] for k in i], [prints[k] for k in j]) >= 0.8
    want = set(zip(i[near].tolist(), j[near].tolist()))
    got = {(r.a, r.b) for r in op7.near_pairs(spark.createDataFrame(list(enumerate(prints)), "doc_id bigint, fingerprint string")).collect()}
    assert len(want) > 100 and got <= want and len(got) > 0.97 * len(want)


def test_id_map_loses_no_wanted_id(spark):
    """Ids of both signs, repeated and null ones, and an empty list of wanted ids."""
    docs = spark.range(20000).select((F.col("id") * 7919 - 50_000_000).alias("_id"), F.lit("x").alias("text"))
    docs = docs.unionByName(docs.limit(5)).unionByName(spark.createDataFrame([(None, "y")], "_id bigint, text string"))
    wanted = docs.where("_id % 5 = 0").select("_id")
    found = op8.likely(docs, wanted)
    assert found.columns == docs.columns
    assert wanted.exceptAll(found.select("_id")).isEmpty()
    assert found.count() < 1.05 * wanted.count()
    assert op8.likely(docs, wanted.limit(0)).isEmpty()


@pytest.mark.parametrize("rows", [ROWS, [(i, " ".join(f"w{(j * j + (j == i % 200) * (i + 1)) % 997}" for j in range(200))) for i in range(1300)]])
def test_minhash(spark, rows):
    """Mixed texts; and one large group of near copies."""
    got = op8.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, got)) == brute.components(rows, 4)


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), (None, "/", "block"), ("net", "/es/", "block")]
URLS = ["http://A.com/x", "https://www.Example.com/en/a?b", "x://q.example.com/en/", "x://b.net/es/1#f", "x://b.net/de/", None, "", "nothing", "x://com", "x://xnet/es/", "x://notexample.com/en/"]
VERDICTS = ["com/ allow", "www.example.com/en/ allow", "example.com/en/ block", "net/es/ block", "None allow", "None allow", "None allow", "None allow", "None allow", "None allow", "com/ allow"]


@pytest.mark.parametrize("part_bytes", [1 << 20, 60])
def test_url_filter(spark, part_bytes):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id bigint, url string").withColumns({"host": F.lit(1), "rule": F.lit(2)})
    got = op10.filter_urls(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"), part_bytes=part_bytes)
    assert [f"{r.rule} {r.verdict}" for r in got.orderBy("page_id").collect()] == VERDICTS
    assert op10.filter_urls(pages.limit(0), spark.createDataFrame(RULES[:1], "host string, path string, verdict string")).count() == 0


def test_level_0_errs_on_a_bounded_number_of_keys():
    """Whatever the universe is: the rate falls as its size grows."""
    rng = np.random.default_rng(4)
    listed, others = rng.integers(0, 1 << 63, 500).astype(np.uint64), rng.integers(0, 1 << 63, 2_000_000).astype(np.uint64)
    for universe in (10**4, 10**7, 10**9):
        wrong = op10.Bloom(listed, 0, op10.bits_per_key(universe)).has(others).mean()
        assert wrong * universe < 2 * op10.ERRORS or universe == 10**4
    assert op10.bits_per_key(10**13) < 500


def test_cascade_is_exact(spark):
    keys = np.random.default_rng(1).integers(0, 1 << 63, 60000).astype(np.uint64)
    listed = keys[:3000]
    universe = spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "h bigint")
    levels = op10.build_cascade(spark, listed, universe)
    assert (op10.member(levels, keys) == np.isin(keys, listed)).all()


def test_null_ids_repeated_rows_and_no_rows(spark, nulls):
    df, none = nulls
    bench = spark.createDataFrame([(1, "one two three")], "item_id bigint, text string")
    assert sorted(str(r.n_hit) for r in op1.decontaminate(df, bench).collect()) == sorted(["9"] * 5 + ["0"] * 3)
    assert {(r.doc_id, r.text): r.n_removed for r in op4.remove_repeats(df).collect() if r.text and len(r.text) > 20} == {(i, t): (0 if i is None else 42 if i == 1 else 41 + 1) for i, t in df.where("length(text) > 20").distinct().collect()}
    long = [r.n_removed for r in op9.remove_repeats(df).where("doc_id is null and text is not null").collect()]
    assert len(long) == 2 and long[0] == long[1]
    assert {(r.doc_id, r.component_id, r.kept) for r in op8.near_duplicates(df).collect()} == {(None, None, True), (1, 1, True), (2, 2, True), (3, 1, False)}
    for fn in (op4.remove_repeats, op8.near_duplicates, op9.remove_repeats, op7.compare_with_next):
        assert fn(none).count() == 0
        assert fn(df).count() == df.count()
    assert op5.encode(none, RANKS, public_tokenizers.PATTERN).count() == 0
    labels = spark.createDataFrame([(1, 0, 0), (None, 1, 0), (3, None, None)], "doc_id bigint, quality int, toxic int")
    with_sites = df.withColumns({"source": F.lit(None).cast("string"), "lang": F.lit("x")})
    assert op6.classify(with_sites, labels).where("rejected").count() == 0  # labels of one kind only
    assert op6.classify(with_sites.limit(0), labels).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert diff(spark, connect(ROOT), QUERIES[name], ORACLES[name], ROOT) is None


def test_queries_without_sql(spark):
    rows = dict(duckdb.sql(f"select doc_id, text from '{ROOT}/documents.parquet'").fetchall())
    v = op5.vocabulary(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.rank, special_tokens={})
    for r in QUERIES["op5_bpe"](spark, ROOT).collect():
        ids = library.encode_ordinary(rows[r.doc_id] or "")
        text = (rows[r.doc_id] or "").encode()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text).hexdigest())
    assert QUERIES["op6_quality"](spark, ROOT).count() == len(rows)

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import op5_bpe, op6_quality
from tests.llm import brute

ROOT = "/root/testdata/sf0.001"


def test_pipeline_equals_plain_python(spark):
    """All stages but the classifier in plain Python; the classifier's held-out accuracy is
    tested with the operator."""
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    scored = op6_quality.classify(docs, spark.read.parquet(f"{ROOT}/labels.parquet"), keep_text=False)
    kept = {r.doc_id for r in scored.where("not rejected").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept]
    alone = {i for i, _, _, keep in brute.components(rows, 5) if keep}
    rows = [r for r in rows if r[0] in alone]
    rows = [(i, kept_bytes.decode(errors="ignore")) for i, _, _, _, kept_bytes in brute.repeated_bytes(rows, 100)]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{ROOT}/benchmark.parquet").collect()]
    clean = {i for i, _, hits, _ in brute.contaminated(rows, items) if not hits}
    ranks = op5_bpe.vocabulary(corpus_pipeline.RANKS).rank
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: (text, library.encode_ordinary(text)) for i, text in rows if i in clean}
    got = {r.doc_id: (r.text, r.ids) for r in corpus_pipeline.run(spark, ROOT).collect()}
    assert got == want and 0 < len(got) < docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None


CLASH = ["_host", "_path", "_id", "_hash", "anchors", "_spans", "_items", "global_rate", "kept_id", "score", "evidence", "removed", "kept", "n_words", "rejected", "contaminated", "decoded", "quality"]


def test_extra_columns_pass_and_equal_rows_stay_once(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet").limit(60)
    docs = docs.union(docs.limit(5)).union(docs.limit(5).withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType))).union(docs.limit(5).withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType)))
    docs = docs.withColumns({c: F.concat(F.lit(c), F.coalesce("text", F.lit(""))) for c in CLASH}).localCheckpoint()
    first = {c: {r[0] for r in docs.select(c).collect()} for c in CLASH}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, ROOT)
        assert set(docs.columns) <= set(got.columns), name
        rows = got.collect()
        assert rows and all(r[c] in first[c] for r in rows for c in CLASH), name
        if name == "MinHash near-dedup":
            keys = [(r.doc_id, r.text) for r in rows]
            assert len(keys) == len(set(keys)) and any(i is None for i, _ in keys)

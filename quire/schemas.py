"""Explicit schemas of every table read; nothing is inferred on the read path."""

from pyspark.sql import types as T


DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PAGES = "page_id bigint, url string, html string"
CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string"
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
LABELS = "doc_id bigint, quality int, toxic int"
BENCHMARK = "item_id bigint, text string"

TABLES = {
    "documents": DOCUMENTS,
    "pages": PAGES,
    "conversations": CONVERSATIONS,
    "events": EVENTS,
    "labels": LABELS,
    "benchmark": BENCHMARK,
}

# A chapter rating as the model returns it; nonfiction criteria, then the verdict.
RATING_CRITERIA = ["insight", "clarity", "evidence", "engagement", "actionability", "overall"]
RATING = T.StructType(
    [T.StructField(c, T.IntegerType()) for c in RATING_CRITERIA]
    + [T.StructField("one_line_verdict", T.StringType())]
)

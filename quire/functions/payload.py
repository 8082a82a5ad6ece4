"""Reading result payloads and model responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.regex import bind, strip
from quire.schemas import RATING


def payload_text(payload: Column) -> Column:
    """Text of a result in any of its shapes: 'text', 'text' inside 'text', 'content'; else ''."""
    return F.coalesce(
        F.get_json_object(payload, "$.text.text"),
        F.get_json_object(payload, "$.text"),
        F.get_json_object(payload, "$.content"),
        F.lit(""),
    )


def response_json(response: Column) -> Column:
    """The JSON part: a json fence, else any fence, else first '{' to last '}'; null if none.

    A fence that is never closed ends one character before the end of the text.
    """

    def fenced(mark: str) -> Column:
        start = F.locate(mark, response)
        rest = F.substring(response, start + len(mark), F.length(response))
        end = F.locate("```", rest)
        return strip(
            F.when(end > 0, F.substring(rest, F.lit(1), end - 1)).otherwise(
                F.substring(rest, F.lit(1), F.length(rest) - 1)
            )
        )

    return (
        F.when(F.contains(response, F.lit("```json")), fenced("```json"))
        .when(F.contains(response, F.lit("```")), fenced("```"))
        .when(F.contains(response, F.lit("{")), F.regexp_extract(response, r"(?s)\{.*\}", 0))
    )


def parse_rating(response: Column) -> Column:
    """Rating struct, null as a whole when there is no valid JSON."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RATING.fields) + ", _bad string"
    parsed = F.from_json(response_json(response), schema, {"columnNameOfCorruptRecord": "_bad"})
    return bind(parsed, lambda p: F.when(p["_bad"].isNull() & p.isNotNull(), p))

"""Fill-in-middle transformation by repeated-capture matching.

A text is a sequence of units, each a match of ``unit`` (a code point by default). One
``fullmatch`` of (unit)* keeps every repetition of its group: the number of units and both cut
offsets are read off ``ends(1)``, without a loop over the text. Python gets the text and two
draws and returns three numbers; output and restored text are built by column functions, so no
text comes back from Python.

The draws are h1 to h4, the first four 8-digit groups of the hex sha256 of ``seed:`` and the
decimal id. Prefix ends after the smaller of h1 % (n+1) and h2 % (n+1) units, middle after the
larger. The form is plain if the text is empty, holds a sentinel, is no sequence of units, or
if h3 % 100 is not below ``rate``; else spm if h4 % 100 is below ``spm``, else psm.

A null text counts as empty: n 0, plain, output empty. A null id draws like the id ``null``.
Equal rows have equal results, every row stays, an empty table gives no rows. Columns of the
input with a result's name are replaced, all others stay whatever their names. Time and memory
of a task follow its longest text: some 50 bytes a unit while it is matched.
"""

from __future__ import annotations

import functools

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CODE_POINT = "."
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE, SPM = 90, 20
CUTS = "struct<n:bigint,first:bigint,second:bigint>"


@functools.cache
def units(unit: str) -> regex.Pattern:
    return regex.compile(f"({unit})*", regex.DOTALL)


def cut(text: str, unit: str, a: int, b: int) -> tuple[int, int, int] | None:
    """Number of units, where the prefix ends and where the middle ends, in code points."""
    found = units(unit).fullmatch(text)
    if found is None:
        return None
    ends = found.ends(1)
    n = len(ends)
    low, high = sorted((a % (n + 1), b % (n + 1)))
    return n, ends[low - 1] if low else 0, ends[high - 1] if high else 0


def cuts(unit: str):
    @F.arrow_udf(CUTS)
    def places(text: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        found = [cut(t.as_py(), unit, x.as_py(), y.as_py()) for t, x, y in zip(text, a, b)]
        names = ("n", "first", "second")
        return pa.array([None if f is None else dict(zip(names, f)) for f in found], pa.struct([(k, pa.int64()) for k in names]))

    return places


def draws(key: Column, seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(df: DataFrame, key: str = "doc_id", text: str = "text", unit: str = CODE_POINT, seed: int = 1, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """``df`` with n (units), form, prefix_chars and middle_chars (code points) and output."""
    body, held = F.coalesce(F.col(f"`{text}`"), F.lit("")), "__fim"
    while held in df.columns:
        held += "_"
    h1, h2, h3, h4 = draws(F.col(f"`{key}`"), seed)
    at = F.col(f"`{held}`")
    marked = functools.reduce(Column.__or__, [F.contains(body, F.lit(s)) for s in (PREFIX, SUFFIX, MIDDLE)])
    plain = (body == "") | marked | at["n"].isNull() | (h3 % 100 >= rate)
    form = F.when(plain, "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    first, second = at["first"], at["second"]
    prefix = F.substring(body, F.lit(1), first.cast("int"))
    middle = F.substring(body, (first + 1).cast("int"), (second - first).cast("int"))
    rest = F.substring(body, (second + 1).cast("int"), F.length(body))
    output = (
        F.when(plain, body)
        .when(h4 % 100 < spm, F.concat(F.lit(SUFFIX), rest, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), rest, F.lit(MIDDLE), middle))
    )
    new = {"n": at["n"], "form": form, "prefix_chars": F.when(~plain, first), "middle_chars": F.when(~plain, second - first), "output": output}
    cutting = df.withColumn(held, cuts(unit)(body, h1, h2))
    old = [F.col(f"`{c}`") for c in df.columns if c not in new]
    return cutting.select(*old, *[c.alias(name) for name, c in new.items()])


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of. A sentinel stands nowhere else in an
    output that is not plain, as texts with one stay plain."""

    def between(mark: str, end: str | None) -> Column:
        start = F.instr(output, mark) + F.lit(len(mark))
        stop = F.instr(output, end) if end else F.length(output) + 1
        return F.substring(output, start, stop - start)

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)

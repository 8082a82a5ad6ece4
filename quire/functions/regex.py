"""Chains of regular-expression substitutions as one native column expression."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

Steps = Iterable[tuple[str, str]]


def substitute(c: Column, steps: Steps) -> Column:
    """Apply (pattern, replacement) pairs in order. Runs inside the JVM; no UDF."""
    for pattern, replacement in steps:
        c = F.regexp_replace(c, pattern, replacement)
    return c


def count_matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def strip(c: Column) -> Column:
    """Trim every kind of ASCII white space, not only blanks; looks at the ends alone."""
    return F.trim(c, F.lit(" \t\n\x0b\f\r"))


def bind(c: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(c)`` with ``c`` evaluated once, for an ``fn`` that mentions its input more than
    once; otherwise a long chain would run again for every mention."""
    return F.element_at(F.transform(F.array(c), fn), 1)

"""Rounding of doubles."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column, places: int) -> Column:
    """Half away from zero, judged after scaling.

    Steps in doubles leave a value that is a half by its formula a last bit below it (111.65 as
    111.64999999999999); scaled it is the half again. ``F.round`` with places judges the decimals
    of the double instead.
    """
    scale = F.lit(float(10**places))
    return F.round(value * scale) / scale

"""Rounding rules.

SQL ``ROUND`` on NUMERIC rounds half away from zero (Spark ``round`` on
decimals and doubles, HALF_UP). pandas/numpy ``.round`` rounds half to
even on the binary value: ``rint(x * 10^n) / 10^n``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sql_round(c: Column, n: int = 0) -> Column:
    return F.round(c, n)


def pd_round(c: Column, n: int = 0) -> Column:
    """numpy-style half-to-even rounding of a double."""
    if n == 0:
        return F.rint(c.cast("double"))
    scale = float(10 ** n)
    return F.rint(c.cast("double") * scale) / scale


def money(c: Column) -> Column:
    """``ROUND(x::NUMERIC, 2)`` reported as DOUBLE (exact for decimal sums)."""
    return F.round(c, 2).cast("double")


def ratio(num: Column, den: Column) -> Column:
    """Division in DOUBLE with SQL ``NULLIF(den, 0)`` semantics."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))

"""Quantisers, distances and integer means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pentad.config import FEATURES, SCALE


def request_value(x: Column) -> Column:
    """0..1 to 0..10000, halves up."""
    inside = F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return F.when(x.isNotNull(), F.floor(inside * F.lit(float(SCALE)) + F.lit(0.5)).cast("smallint"))


def reference_value(x: Column) -> Column:
    """-1..1 to -10000..10000, halves away from zero."""
    inside = F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0)) * F.lit(float(SCALE))
    return F.when(x.isNotNull(), (inside + F.when(inside >= 0, F.lit(0.5)).otherwise(F.lit(-0.5))).cast("bigint").cast("smallint"))


def rounded_mean(total: Column, n: Column) -> Column:
    """Integer mean, halves away from zero; 0 of nothing."""
    half = integer_div(n, 2)
    up, down = total + half, total - half
    return F.when(n == 0, F.lit(0)).otherwise(F.when(total >= 0, _div(up, n)).otherwise(_div(down, n))).cast("smallint")


def _div(a: Column, b: Column) -> Column:
    """Integer division towards zero; null for 0."""
    return F.call_function("div", a.cast("bigint"), F.nullif(b.cast("bigint"), F.lit(0).cast("bigint")))


def integer_div(a: Column, b: int) -> Column:
    return _div(a, F.lit(b))


def column(name: str, side: str = "") -> Column:
    return F.col(f"{side}.{name}" if side else name).cast("bigint")


def real(name: str, side: str = "") -> Column:
    """The column as a double. Distances are whole and far below 2^53, so doubles hold them; they need no checks for
    overflow, which would make the generated code too long to be compiled."""
    return F.col(f"{side}.{name}" if side else name).cast("double")


def squared_distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Of columns of doubles with whole values."""
    total = None
    for x, y in zip(a, b, strict=True):
        d = x - y
        total = d * d if total is None else total + d * d
    return total.cast("bigint")


def box_distance(q: str, box: str) -> Column:
    """Squared distance of a side's features to a box of columns lo0.. and hi0..: no point inside is nearer."""
    total = None
    for i, f in enumerate(FEATURES):
        x = real(f, q)
        d = F.greatest(real(f"lo{i}", box) - x, x - real(f"hi{i}", box), F.lit(0.0))
        total = d * d if total is None else total + d * d
    return total.cast("bigint")

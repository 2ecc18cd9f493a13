"""Bit-packed keys of feature vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pentad.config import SCALE
from pentad.functions.quantize import column, integer_div

# The fields of each key as (feature, test or number of buckets, shift).
PROFILE = ((2, 16, 0), (7, 8, 4), (8, 4, 7), (12, 4, 9), (0, 4, 11), (5, "neg", 13), (9, "pos", 14), (10, "pos", 15), (11, "pos", 16), (6, 4, 17), (1, "tenth", 19), (13, 4, 20))
PARTITION = ((7, 4, 0), (2, 4, 2), (11, "pos", 4), (10, "pos", 5), (9, "pos", 6), (5, "neg", 7))
PROJECTION_PREFIX = ((5, "neg", 31), (9, "pos", 30), (10, "pos", 29), (11, "pos", 28), (12, "half", 27))
#: Features whose top bits are interleaved below the prefix, and how many bits of each.
INTERLEAVED, INTERLEAVED_BITS = (2, 8, 12, 5, 7, 0, 13), 4
#: Features and bits of the two purity keys.
PURITY = (((0, 4), (7, 3), (10, 6), (1, 1), (9, 3), (11, 4), (12, 1), (3, 2)), ((5, 4), (13, 4), (6, 4), (1, 4), (12, 4)))


def positive_bucket(v: Column, buckets: int) -> Column:
    """Which of equal parts of 0..10000 holds v; negative values are in the first."""
    return F.when(v <= 0, F.lit(0)).otherwise(F.least(F.lit(buckets - 1), integer_div(v * buckets, SCALE + 1))).cast("bigint")


def quantised_bits(v: Column, bits: int) -> Column:
    """-10000..10000 to 0..2^bits - 1."""
    inside = F.least(F.greatest(v, F.lit(-SCALE)), F.lit(SCALE)).cast("bigint")
    return integer_div((inside + SCALE) * ((1 << bits) - 1), 2 * SCALE)


def _field(v: Column, what: str | int) -> Column:
    if isinstance(what, int):
        return positive_bucket(v, what)
    test = {"neg": v < 0, "pos": v > 0, "tenth": v > SCALE // 10, "half": v > SCALE // 2}[what]
    return F.when(test, F.lit(1)).otherwise(F.lit(0)).cast("bigint")


def _packed(fields, side: str) -> Column:
    parts = [F.shiftleft(_field(column(f"f{i}", side), what), shift) for i, what, shift in fields]
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out


def profile_key(side: str = "") -> Column:
    """22 bits."""
    return _packed(PROFILE, side)


def partition_key(side: str = "") -> Column:
    """8 bits: at most 256 partitions."""
    return _packed(PARTITION, side).cast("int")


def projection_key(side: str = "") -> Column:
    """32 bits as a bigint: five tests, then the interleaved top bits of seven features, without the last bit."""
    out, n = _packed(PROJECTION_PREFIX, side), len(INTERLEAVED)
    for i, f in enumerate(INTERLEAVED):
        q = quantised_bits(column(f"f{f}", side), INTERLEAVED_BITS)
        for bit in range(INTERLEAVED_BITS):
            place = bit * n + (n - 1 - i) - 1  # the last bit falls off
            if place >= 0:
                out = out.bitwiseOR(F.shiftleft(F.shiftright(q, bit).bitwiseAND(F.lit(1).cast("bigint")), place))
    return out


def edge_bin(v: Column, edges: Sequence[int]) -> Column:
    """The first bin whose edge is above v, else the last; edges are in order, one fewer than there are bins."""
    return F.aggregate(F.array(*(F.lit(int(e)) for e in edges)), F.lit(0), lambda n, e: n + F.when(v >= e, 1).otherwise(0)).cast("bigint") if edges else F.lit(0).cast("bigint")


def purity_key(table: int, edges: dict[int, Sequence[int]], side: str = "") -> Column:
    """24 (table 1) or 20 bits (table 2); edges by place of the feature in the key."""
    out, shift = None, 0
    for place, (feature, bits) in enumerate(PURITY[table - 1]):
        part = F.shiftleft(edge_bin(column(f"f{feature}", side), edges[place]), shift)
        out, shift = part if out is None else out.bitwiseOR(part), shift + bits
    return out


def size_class(n: Column) -> Column:
    """0, up to 128, 512, 2048, 8192, 32768, more."""
    out = F.when(n == 0, 0)
    for i, top in enumerate((128, 512, 2048, 8192, 32768), 1):
        out = out.when(n <= top, i)
    return out.otherwise(6)

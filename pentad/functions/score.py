"""The score law of benchmark runs, and the answer to a request."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pentad.config import APPROVE_BELOW, NEIGHBOURS


def fraud_score(count: Column) -> Column:
    return F.least(count, F.lit(NEIGHBOURS)) / F.lit(float(NEIGHBOURS))


def approved(count: Column) -> Column:
    return count < APPROVE_BELOW


def response(count: Column) -> Column:
    """The answer as JSON."""
    return F.to_json(F.struct(approved(count).alias("approved"), fraud_score(count).alias("fraud_score")))


def weighted_errors(fp: Column, fn: Column, http: Column) -> Column:
    return fp + fn * 3 + http * 5


def detection_score(fp: Column, fn: Column, http: Column, n: Column) -> Column:
    e = weighted_errors(fp, fn, http).cast("double")
    rate = F.log10(1.0 / F.greatest(e / n, F.lit(0.001))) * 1000.0
    return F.when((fp + fn + http) / n > 0.15, F.lit(-3000.0)).otherwise(rate - F.log10(e + 1.0) * 300.0)


def p99_score(ms: Column) -> Column:
    return F.when(ms > 2000, F.lit(-3000.0)).otherwise(F.least(F.lit(3000.0), F.log10(1000.0 / ms) * 1000.0))


def parse_ms(text: Column) -> Column:
    """A number, or a number with ms behind it."""
    return F.regexp_replace(F.lower(F.trim(text.cast("string"))), "ms$", "").try_cast("double")


def format_ms(x: Column) -> Column:
    """At most three decimals, without trailing zeros."""
    return F.concat(F.regexp_replace(F.format_string("%.3f", x), r"\.?0+$", ""), F.lit("ms"))

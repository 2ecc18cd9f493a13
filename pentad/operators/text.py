"""Scans of text for fixed markers, and of requests for their route."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pentad.operators.ranking import with_position


def marker_scan(files: DataFrame, text: str, markers: Sequence[str]) -> DataFrame:
    """files with found: the markers that the text holds, in their order; only files that hold one."""
    hits = F.filter(F.array(*(F.lit(m) for m in markers)), lambda m: F.contains(F.col(text), m))
    return files.withColumn("found", hits).where(F.size("found") > 0)


def route(method: Column, path: Column) -> Column:
    """What a request is for: ready, score or missing."""
    return F.when((method == "GET") & F.startswith(path, F.lit("/ready")), "ready").when((method == "POST") & F.startswith(path, F.lit("/fraud-score")), "score").otherwise("missing")


def content_length(header: Column) -> Column:
    """The body's length that a header block states, 0 without one; the name's usual spellings are known."""
    found = F.regexp_extract(header, r"(?m)^(?:Content-Length|content-length):[ \t]*([0-9]+)", 1)
    return F.coalesce(found.try_cast("bigint"), F.lit(0).cast("bigint"))


def aligned_table(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """line and place (from 0): a header and a line for each row, in this order; columns are as wide as their widest cell and
    parted by two blanks. Null cells are empty."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]
    widths = rows.agg(*(F.greatest(F.lit(len(c)), F.coalesce(F.max(F.length(x)), F.lit(0))).alias(f"_w{i}") for i, (c, x) in enumerate(zip(rows.columns, cells, strict=True))))
    laid = with_position(rows.select(F.array(*cells).alias("cells"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order))), [F.col(f"_o{i}") for i in range(len(order))], "place")
    header = rows.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("place"), F.array(*map(F.lit, rows.columns)).alias("cells"))
    every = header.unionByName(laid.select((F.col("place") + 1).alias("place"), "cells")).crossJoin(F.broadcast(widths))
    padded = [F.rpad(F.col("cells")[i], F.col(f"_w{i}"), F.lit(" ")) for i in range(len(rows.columns))]
    return every.select("place", F.rtrim(F.concat_ws("  ", *padded)).alias("line"))

"""Readers: reference sets, requests, expected answers, reports, comparisons, stored indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pentad import schemas
from pentad.config import DIMS, FEATURES, SCALE
from pentad.functions.quantize import reference_value

INDEX_VERSION = 2


def references(spark: SparkSession, path: str) -> DataFrame:
    """ref_id, f0..f13, label from JSON (an array, or records by line; gzip by its name). A record without 14 numbers
    fails the read. ref_id follows the order of the file. A gzip file is one split: store it with writers.write_index."""
    raw = spark.read.schema(schemas.REFERENCE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    ok = F.coalesce((F.size("vector") == DIMS) & F.forall("vector", lambda x: x.isNotNull()), F.lit(False))
    vector = F.when(ok, F.col("vector")).otherwise(F.raise_error(F.lit("a reference without 14 numbers")).cast("array<double>"))
    rows = raw.select(F.monotonically_increasing_id().alias("ref_id"), vector.alias("v"), is_fraud(F.col("label")).alias("label"))
    return rows.select("ref_id", *(reference_value(F.col("v")[i]).alias(f) for i, f in enumerate(FEATURES)), "label")


def is_fraud(label: Column) -> Column:
    """1 for labels that begin with f."""
    return F.when(F.startswith(label, F.lit("f")), 1).otherwise(0)


def requests(lines: DataFrame, body: str = "value") -> DataFrame:
    """lines with a request's fields from its JSON text. has_last: the last transaction is named, be it as null. Fields may stand in
    any order. Text that is no request has null fields."""
    parsed = F.from_json(F.col(body), schemas.REQUEST)
    fields = ("id", "transaction", "customer", "merchant", "terminal", "last_transaction")
    out = lines.withColumn("_request", parsed)
    return out.withColumns({f: F.col(f"_request.{f}") for f in fields}).withColumn("has_last", F.contains(F.col(body), F.lit('"last_transaction"'))).drop("_request")


def expected_answers(spark: SparkSession, path: str) -> DataFrame:
    """expected, value (the request's JSON) from lines of number, tab, JSON; lines without a tab are left out."""
    lines = spark.read.text(path).where(F.contains("value", F.lit("\t")))
    parts = F.split(F.regexp_replace("value", "\r$", ""), "\t", 2)
    return lines.select(F.coalesce(parts[0].try_cast("bigint"), F.lit(0).cast("bigint")).alias("expected"), parts[1].alias("value"))


def reports(spark: SparkSession, path: str) -> DataFrame:
    """file, metadata, result of archived benchmark reports."""
    return spark.read.schema(schemas.REPORT).option("multiLine", True).json(path).select(F.col("_metadata.file_name").alias("file"), "metadata", "result")


def comparison(spark: SparkSession, path: str) -> DataFrame:
    """Rows of comparison files, each an object with results or a bare list; seq is their order by file and place."""
    text = spark.read.option("wholetext", True).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    item = f"struct<{', '.join(f'{n}:{t}' for n, t in (x.split(' ') for x in schemas.COMPARISON.split(', ')))}>"
    bare = F.from_json("value", f"array<{item}>")
    named = F.from_json("value", f"results array<{item}>")["results"]
    rows = F.when(F.startswith(F.ltrim("value"), F.lit("[")), bare).otherwise(named)
    checked = F.coalesce(rows, F.raise_error(F.lit("a comparison without results")).cast(f"array<{item}>"))
    return text.select("file", F.posexplode(checked).alias("at", "row")).select(F.struct("file", "at").alias("seq"), "row.*")


def official_results(comments: DataFrame, body: str, repo_url: str) -> DataFrame:
    """comments with result: the first fenced JSON block with a score, where it is of this repository; newest first (by
    commented_at, or else closed_at)."""
    blocks = F.regexp_extract_all(F.col(body), F.lit(r"(?s)```json\s*(.*?)```"), F.lit(1))
    parsed = F.transform(blocks, lambda b: F.from_json(b, schemas.OFFICIAL_RESULT))
    first = F.get(F.filter(parsed, lambda p: p["test-results"]["scoring"].isNotNull()), F.lit(0))
    found = comments.withColumn("result", first).where(F.col("result").isNotNull() & (F.col("result.repo-url") == repo_url))
    return found.orderBy(F.coalesce("commented_at", "closed_at").desc())


def stored_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables that writers.write_index wrote. Another version, number of features or scale raises, and so do tables that
    do not have the rows that the layout asks for."""
    meta = spark.read.json(f"{path}/meta").first()
    if (meta["version"], meta["dims"], meta["scale"]) != (INDEX_VERSION, DIMS, SCALE):
        raise ValueError(f"index of version {meta['version']}, {meta['dims']} features, scale {meta['scale']}")
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in meta["tables"]}
    rows = tables["refs"].count()
    sized = {"tree": ("nodes", "leaf"), "lists": ("lists", "true"), "kmeans": ("lists", "true")}.get(meta["layout"])
    if sized:
        name, of = sized
        held = tables[name].where(of).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] if name in tables else None
        if held != rows:
            raise ValueError(f"{name} of {held} references, of which there are {rows}")
    if rows != meta["rows"]:
        raise ValueError(f"{rows} references instead of {meta['rows']}")
    return tables

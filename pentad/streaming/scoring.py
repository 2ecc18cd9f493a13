"""Scoring of a stream of requests against a fixed reference set.

The stream has no state and no event time. Ranking needs whole batches, so it runs inside foreachBatch; the reference
set's layout is built once and kept for all batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pentad.config import FEATURES
from pentad.functions.features import with_features
from pentad.operators import knn
from pentad.sources.readers import requests
from pentad.storage import cut


def score_requests(lines: DataFrame, refs: DataFrame, search: Callable[[DataFrame, DataFrame], DataFrame] = knn.certified, strict: bool = False) -> DataFrame:
    """query_id, valid, fraud_count, worst, fraud_score, approved for lines of query_id and value (JSON). Requests that
    cannot be read have no fraud votes, so they are approved."""
    parsed = cut(with_features(requests(lines), strict, F.col("has_last")).select("query_id", "valid", *FEATURES))
    found = search(parsed.where("valid").select("query_id", *FEATURES), refs).select("query_id", "fraud_count", "worst")
    voted = parsed.select("query_id", "valid").join(found, "query_id", "left").withColumn("fraud_count", F.coalesce("fraud_count", F.lit(0).cast("bigint")))
    return knn.decisions(voted.select("query_id", "fraud_count", "worst", "valid")).select("query_id", "fraud_count", "worst", "fraud_score", "approved", "valid")


def check_answers(answers: DataFrame, refs: DataFrame, search: Callable[[DataFrame, DataFrame], DataFrame] = knn.certified, strict: bool = False) -> DataFrame:
    """query_id, expected, fraud_count and valid for lines of expected (a count of fraud labels) and value (a request's
    JSON), as ``readers.expected_answers`` returns them: what ``evaluate.confusion`` and ``mismatches`` judge."""
    lines = cut(answers.withColumn("query_id", F.monotonically_increasing_id()))
    return score_requests(lines, refs, search, strict).join(lines.select("query_id", "expected"), "query_id")


def request_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Lines of text files as they come, max_files at a time: query_id from the file and the line's text."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
    return lines.select(F.xxhash64(F.col("_metadata.file_path"), "value").alias("query_id"), "value")


def score_stream(lines: DataFrame, refs: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, **how) -> StreamingQuery:
    """Scores every batch and hands it to sink(decisions, batch id), which should write by batch id, so that a batch that
    is run again after a failure leaves the same result."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        rows.persist()
        try:
            sink(score_requests(rows, refs, **how), batch_id)
        finally:
            rows.unpersist()

    writer = lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

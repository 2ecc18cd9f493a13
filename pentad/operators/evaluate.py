"""Evaluation of votes: replays, confusion counts, counters of staged searches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pentad.config import NEIGHBOURS
from pentad.functions.keys import size_class
from pentad.functions.score import approved


def _histogram(name: str, value: Column, size: int) -> list[Column]:
    return [F.count_if(value == i).alias(f"{name}_{i}") for i in range(size)]


def replay_histogram(voted: DataFrame, refs: DataFrame) -> DataFrame:
    """One row: label_0, label_1 of the references and fraud_0..fraud_5 of the votes."""
    labels = refs.agg(*_histogram("label", F.when(F.col("label") != 0, 1).otherwise(0), 2))
    return labels.join(voted.agg(*_histogram("fraud", F.col("fraud_count"), NEIGHBOURS + 1)), F.lit(True))


def replay(refs: DataFrame, search: Callable[[DataFrame, DataFrame], DataFrame], limit: int = 0) -> DataFrame:
    """The histogram of a replay: the first limit references by ref_id (0: all) ask the whole set, themselves included."""
    asked = refs.drop("label").withColumnRenamed("ref_id", "query_id")
    if limit:
        asked = asked.orderBy("query_id").limit(limit)
    return replay_histogram(search(asked, refs), refs)


def ready(refs: DataFrame) -> bool:
    """Whether there is a reference to answer by."""
    return bool(refs.limit(1).count())


def confusion(judged: DataFrame) -> DataFrame:
    """One row from expected (count of fraud labels), fraud_count and valid: total, false_positives (expected to be
    approved, denied), false_negatives, mismatches, vectorize_errors, bucket_0..bucket_5. Rows that are not valid count in
    total and vectorize_errors alone."""
    ok = F.col("valid")
    want, got = approved(F.col("expected")), approved(F.col("fraud_count"))
    return judged.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok & want & ~got).alias("false_positives"),
        F.count_if(ok & ~want & got).alias("false_negatives"),
        F.count_if(ok & (F.col("expected") != F.col("fraud_count"))).alias("mismatches"),
        F.count_if(~ok).alias("vectorize_errors"),
        *(F.count_if(ok & (F.col("fraud_count") == i)).alias(f"bucket_{i}") for i in range(NEIGHBOURS + 1)),
    )


def mismatches(judged: DataFrame, n: int = 40) -> DataFrame:
    """The first rows (by query_id) whose answer is not the expected one."""
    return judged.where(F.col("valid") & (F.col("expected") != F.col("fraud_count"))).orderBy("query_id").limit(n)


def search_counters(staged: DataFrame) -> DataFrame:
    """One row of sums over what knn.staged returns."""
    lists = F.col("lists_fast") + F.col("lists_repair") + F.col("lists_exact")
    vectors = F.col("vectors_fast") + F.col("vectors_repair") + F.col("vectors_exact")
    phases = [f(f"{what}_{p}").cast("bigint").alias(f"{how}{what}_{p}") for what in ("lists", "vectors") for p in ("fast", "repair", "exact") for how, f in (("", F.sum), ("max_", F.max))]
    repaired = F.col("repaired")
    return staged.agg(
        F.count(F.lit(1)).alias("requests"),
        *(F.count_if(c).alias(c) for c in ("fast_certified", "repaired", "repair_certified", "exact_fallback")),
        *_histogram("fast_fraud", F.col("fast_fraud"), 6), *_histogram("final_fraud", F.col("fraud_count"), 6),
        *_histogram("repair_before", F.when(repaired, F.col("fast_fraud")), 6), *_histogram("repair_after", F.when(repaired, F.col("fraud_count")), 6),
        *phases, F.avg("fast_worst").alias("fast_worst_avg"), F.max("fast_worst").alias("fast_worst_max"),
        F.avg("worst").alias("final_worst_avg"), F.max("worst").alias("final_worst_max"),
        *_histogram("lists_class", size_class(lists), 7), *_histogram("vectors_class", size_class(vectors), 7),
    )

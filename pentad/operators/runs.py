"""Summaries of benchmark runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pentad.functions.score import detection_score, p99_score, parse_ms, weighted_errors
from pentad.operators.ranking import with_rank
from pentad.storage import cut

CLEAN_SCORE, STRONG_MS, STRETCH_MS, NEAR_MS, WORSE_MS = 6000.0, 0.03, 0.27, 0.03, 0.05


def scored(runs: DataFrame) -> DataFrame:
    """runs (n, fp, fn, http, p99 in ms) with weighted_errors, detection, p99_score, final."""
    fp, fn, http = (F.col(c) for c in ("fp", "fn", "http"))
    out = runs.withColumn("weighted_errors", weighted_errors(fp, fn, http)).withColumn("detection", detection_score(fp, fn, http, F.col("n")))
    return out.withColumn("p99_score", p99_score(F.col("p99"))).withColumn("final", F.col("detection") + F.col("p99_score"))


def clean_run() -> Column:
    """Of a comparison: full score and no errors."""
    return (F.col("final_score") == CLEAN_SCORE) & _no_errors()


def clean_candidate() -> Column:
    """Of an archive row: no failures and no errors; the score does not count."""
    return (F.col("failure_rate") == "0%") & _no_errors()


def _no_errors() -> Column:
    return (F.col("false_positive_detections") == 0) & (F.col("false_negative_detections") == 0) & (F.col("http_errors") == 0)


def _middle(size: str) -> Column:
    """The place of the lower median."""
    return F.call_function("div", F.col(size) - 1, F.lit(2).cast("bigint"))


def run_summary(runs: DataFrame, group: str, value: str, order: list[str], clean: Column) -> DataFrame:
    """For each group: runs, min, median (mean of the middle two), max, latest value (last in order), clean (all are)."""
    v = F.col(value)
    out = runs.groupBy(group).agg(F.count(F.lit(1)).alias("runs"), F.min(v).alias("min"), F.max(v).alias("max"), F.max_by(v, F.struct(*order)).alias("latest"), F.bool_and(clean).alias("clean"))
    ranked = with_rank(runs.where(v.isNotNull()).select(F.col(group).alias("_of"), v.alias("_v")), "_of", [F.col("_v")])
    middle = ranked.where((F.col("rank") == _middle("size")) | (F.col("rank") == F.call_function("div", F.col("size"), F.lit(2).cast("bigint"))))
    middle = middle.groupBy("_of").agg(((F.min("_v") + F.max("_v")) / 2).alias("median"))
    return out.join(middle, F.col(group).eqNullSafe(F.col("_of")), "left").select(group, "runs", "min", "median", "max", "latest", "clean")


def participant_summary(results: DataFrame) -> DataFrame:
    """run_summary of comparison rows with seq, the order in which they were read; p99 in ms. In order of the name."""
    parsed = results.withColumn("p99_ms", parse_ms(F.col("p99")))
    return run_summary(parsed, "participant", "p99_ms", ["seq"], F.coalesce(clean_run(), F.lit(False))).orderBy("participant")


def lower_medians(runs: DataFrame, group: str, value: str) -> DataFrame:
    """For each group: min, lower median (place (n - 1) div 2 from 0) and max."""
    ranked = with_rank(runs.where(F.col(value).isNotNull()).select(group, F.col(value).alias("v")), group, [F.col("v")])
    middle = F.max(F.when(F.col("rank") == _middle("size"), F.col("v")))
    return ranked.groupBy(group).agg(F.min("v").alias("min"), middle.alias("lower_median"), F.max("v").alias("max"))


def representative(runs: DataFrame, group: str, score: str, p99: str, run: str) -> DataFrame:
    """The run of each group that stands for it: of those with the lower median score, the lower median p99."""
    by_score = cut(with_rank(runs, group, [F.col(score), F.col(run)], "_rank", "_size"))
    median = by_score.where(F.col("_rank") == _middle("_size")).select(F.col(group).alias("_of"), F.col(score).alias("_median"))
    same = by_score.drop("_rank", "_size").join(median, F.col(group).eqNullSafe(F.col("_of")) & (F.col(score) == F.col("_median"))).drop("_of", "_median")
    return with_rank(same, group, [F.col(p99), F.col(run)], "_rank", "_size").where(F.col("_rank") == _middle("_size")).drop("_rank", "_size")


def archive_rows(reports: DataFrame) -> DataFrame:
    """A flat row for each report (file, metadata, result), newest file first; kind and mode have defaults."""
    m, r, s = "metadata", "result", "result.scoring"
    return reports.select(
        "file", *(f"{m}.{c}" for c in ("timestamp", "sha", "short_sha", "run_id", "run_url", "image")),
        F.coalesce(f"{m}.report_kind", F.lit("candidate")).alias("report_kind"), f"{m}.html_report",
        F.coalesce(f"{m}.benchmark_k6_mode", F.lit("docker")).alias("benchmark_k6_mode"), f"{r}.p99", f"{s}.failure_rate", f"{s}.final_score",
        *(f"{s}.breakdown.{c}" for c in ("http_errors", "false_positive_detections", "false_negative_detections")),
    ).orderBy(F.desc("file"))


def latest(rows: DataFrame, file: str = "file", kind: str = "report_kind") -> DataFrame:
    """One row: latest, the last file, and latest_candidate, the last of the candidates."""
    return rows.agg(F.max(file).alias("latest"), F.max(F.when(F.col(kind) == "candidate", F.col(file))).alias("latest_candidate"))


def head_to_head(rounds: DataFrame) -> DataFrame:
    """For each rival, from round, rival, ours, theirs (p99 in ms) and clean: rounds, wins (ours lower in at least two of
    three), strong (our median lower by 0.03 ms or more over three rounds) and stretch (a clean run of at most 0.27 ms)."""
    gap = F.round(F.median("theirs") - F.median("ours"), 9)
    return rounds.groupBy("rival").agg(
        F.count(F.lit(1)).alias("rounds"), (F.count_if(F.col("ours") < F.col("theirs")) * 3 >= F.count(F.lit(1)) * 2).alias("wins"),
        ((F.count(F.lit(1)) >= 3) & (gap >= STRONG_MS)).alias("strong"), F.bool_or(F.col("clean") & (F.col("ours") <= STRETCH_MS)).alias("stretch"),
    )


def promotion_gate(rounds: DataFrame, correctness_safe: bool = False) -> DataFrame:
    """One row, from round, ours, clean and the rivals' p99 (rival_a, rival_b): promoted if there are three clean rounds and our median
    is no worse than both rivals' (or within 0.03 ms of the best, with an improvement that is safe), unless we are worse
    than both by over 0.05 ms in two rounds."""
    best = F.least(F.median("rival_a"), F.median("rival_b"))
    no_worse = F.median("ours") <= best
    close = F.lit(correctness_safe) & (F.round(F.median("ours") - best, 9) <= NEAR_MS)
    bad = F.count_if((F.round(F.col("ours") - F.col("rival_a"), 9) > WORSE_MS) & (F.round(F.col("ours") - F.col("rival_b"), 9) > WORSE_MS)) >= 2
    return rounds.agg(F.count_if("clean").alias("clean_rounds"), F.median("ours").alias("median"), ((F.count_if("clean") >= 3) & (no_worse | close) & ~bad).alias("promoted"))

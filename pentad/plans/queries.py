"""The library's queries by name: each applies an operator to a whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pentad.config import DIMS, FEATURES, IndexConfig, SearchConfig
from pentad.functions import keys
from pentad.functions.features import mcc_risk, with_features
from pentad.functions.quantize import reference_value, request_value
from pentad.functions.score import format_ms, response
from pentad.operators import buckets, evaluate, index, knn, ranking, runs, text
from pentad.plans import oracles
from pentad.plans.tables import EVENT_MCC, references, table, transaction_features, transactions
from pentad.sources.readers import expected_answers, stored_index
from pentad.sources.readers import references as references_of_file
from pentad.sources.writers import write_index
from pentad.storage import cut, tables_dir
from pentad.streaming.scoring import check_answers

LISTS = 16


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Queries and references of a replay: every reference asks, itself included."""
    refs = references(table(spark, sf_dir, "embeddings"))
    return refs.withColumnRenamed("ref_id", "query_id").drop("label"), refs


def _stand_in(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Benchmark runs or requests made of the columns of a whole table."""
    source, columns = oracles.STAND_INS[name]
    return table(spark, sf_dir, source).selectExpr(*columns)


def _wide(df: DataFrame) -> DataFrame:
    """Small integers as bigint."""
    return df.select(*(F.col(c).cast("bigint").alias(c) if t in ("smallint", "int") else F.col(c) for c, t in df.dtypes))


def knn_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.decisions(knn.flat(*_sides(spark, sf_dir)))


def knn_certified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.decisions(knn.certified(*_sides(spark, sf_dir)))


#: Every query that a few lists do not certify goes on to all lists: the answer is exact.
EXACT = SearchConfig(nprobe=3, repair_nprobe=6, repair_min=0, repair_max=5)


def _staged(spark: SparkSession, sf_dir: str, search: SearchConfig) -> DataFrame:
    return knn.ivf(*_sides(spark, sf_dir), IndexConfig(lists=LISTS), search)


def knn_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.decisions(_staged(spark, sf_dir, EXACT).select("query_id", "fraud_count", "worst"))


def knn_ivf_all_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.decisions(_staged(spark, sf_dir, SearchConfig(nprobe=LISTS)).select("query_id", "fraud_count", "worst"))


def knn_kmeans_all_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = knn.ivf_kmeans(*_sides(spark, sf_dir), IndexConfig(lists=LISTS), SearchConfig(nprobe=LISTS))
    return knn.decisions(found.select("query_id", "fraud_count", "worst"))


def knn_ivf_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _staged(spark, sf_dir, SearchConfig(nprobe=3, repair_nprobe=8, repair_min=1, repair_max=4))


def search_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.search_counters(knn_ivf_staged(spark, sf_dir))


def stream_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replay as a stream: batches are searched and written by batch number, then read back."""
    queries, refs = _sides(spark, sf_dir)
    stored = table(spark, sf_dir, "embeddings")
    out = f"{tables_dir(spark)}/stream-{uuid.uuid4().hex}"
    arriving = references(spark.readStream.schema(stored.schema).parquet(f"{sf_dir}/embeddings.parquet*")).withColumnRenamed("ref_id", "query_id").drop("label")

    def batch(rows: DataFrame, number: int) -> None:
        knn.decisions(knn.certified(rows, refs)).write.mode("overwrite").parquet(f"{out}/votes/batch={number}")

    arriving.writeStream.foreachBatch(batch).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/votes").drop("batch")


def _stored(config: IndexConfig, search: SearchConfig) -> Callable[[SparkSession, str], DataFrame]:
    """Every reference asks an index that was written and read again."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        queries, refs = _sides(spark, sf_dir)
        path = f"{tables_dir(spark)}/{config.layout}-{uuid.uuid4().hex}"
        write_index(refs, path, config)
        return knn.decisions(knn.stored(queries, stored_index(spark, path), search))

    return query


def references_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The references as a file of records of 14 numbers and a label, read again."""
    refs = table(spark, sf_dir, "embeddings").orderBy("vec_id")
    vector = F.transform(F.slice("embedding", 1, DIMS), lambda x: x.cast("double"))
    record = F.struct(vector.alias("vector"), F.when(F.col("label") >= 5, "fraud").otherwise("legit").alias("label"))
    path = f"{tables_dir(spark)}/references-{uuid.uuid4().hex}"
    # the format is one array in one file
    rows = refs.agg(F.sort_array(F.collect_list(F.struct("vec_id", record.alias("r")))).alias("all"))
    rows.select(F.to_json(F.transform("all", lambda x: x["r"]))).write.text(path)
    return _wide(references_of_file(spark, path))


def golden_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of expected answer and request, one for each event, read again, scored against all events and judged."""
    events = cut(transactions(table(spark, sf_dir, "events")))
    fields = ("id", "transaction", "customer", "merchant", "terminal", "last_transaction")
    body = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    path = f"{tables_dir(spark)}/expected-{uuid.uuid4().hex}"
    events.select(F.concat((F.col("event_id") % 6).cast("string"), F.lit("\t"), body)).write.text(path)
    refs = cut(with_features(events, strict=True).select(F.col("event_id").alias("ref_id"), *FEATURES, "label"))
    return evaluate.confusion(check_answers(expected_answers(spark, path), refs, strict=True))


def tx_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(transaction_features(table(spark, sf_dir, "events")))


def _tx_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every event asks, all events are the references."""
    rows = cut(transaction_features(table(spark, sf_dir, "events")))
    return rows.withColumnRenamed("event_id", "query_id").drop("label"), rows.withColumnRenamed("event_id", "ref_id")


def tx_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.decisions(knn.certified(*_tx_sides(spark, sf_dir)))


def tx_scores_nested_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.decisions(knn.flat(*_tx_sides(spark, sf_dir)))


def decision_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_certified(spark, sf_dir).select("query_id", response(F.col("fraud_count")).alias("response"))


def replay_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.replay(_sides(spark, sf_dir)[1], knn.certified)


def replay_of_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replay with a row limit."""
    return evaluate.replay(_sides(spark, sf_dir)[1], knn.flat, limit=100)


def summary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The participant summary as lines of text."""
    rows = participant_summary(spark, sf_dir)
    return text.aligned_table(rows.select("participant", "runs", *(format_ms(F.col(c)).alias(c) for c in ("min", "median", "max", "latest")), "clean"), ["participant"])


def tx_features_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tx_features with the known-merchant test on the list's text."""
    rows = with_features(transactions(table(spark, sf_dir, "events")), strict=False)
    return _wide(rows.select("event_id", *FEATURES, "label", "valid"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("query_id")
    return knn.certified(*_sides(spark, sf_dir)).withColumn("expected", n % 6).withColumn("valid", n % 50 != 0)


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(_judged(spark, sf_dir))


def mismatch_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.mismatches(_judged(spark, sf_dir)).select("query_id", "fraud_count", "expected")


def vector_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, refs = _sides(spark, sf_dir)
    return _wide(refs.select("ref_id", keys.partition_key().alias("part_id"), keys.profile_key().alias("profile"), keys.projection_key().alias("projection")))


def partition_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(index.partitions(_sides(spark, sf_dir)[1]))


def list_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(index.list_summaries(index.with_list(_sides(spark, sf_dir)[1], LISTS)))


def kmeans_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed, centroids = index.kmeans_lists(_sides(spark, sf_dir)[1], IndexConfig(lists=LISTS, iterations=1))
    sizes = listed.groupBy("list_id").agg(F.count(F.lit(1)).alias("n"))
    return _wide(centroids.join(sizes, "list_id", "left").select("list_id", *(f"c{i}" for i in range(DIMS)), F.coalesce("n", F.lit(0)).alias("n")))


def profile_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(buckets.profile_table(_sides(spark, sf_dir)[1]))


def quantile_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets.quantile_edges(_sides(spark, sf_dir)[1]).withColumn("edge", F.col("edge").cast("bigint"))


def _purity(number: int) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        _, refs = _sides(spark, sf_dir)
        edges = buckets.edge_lists(buckets.quantile_edges(refs))
        return _wide(buckets.purity_table(refs, number, edges, IndexConfig(min_support=(1, 1, 1, 1))))

    return query


def shortcut_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.with_shortcuts(*_sides(spark, sf_dir), SearchConfig(profile_shortcut=True, profile_min=(2, 2)))


def purity_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pure buckets of table 1, then 2, answer where they may, the search the rest."""
    return knn.with_shortcuts(*_sides(spark, sf_dir), SearchConfig(purity_shortcut=True, purity_answers=(True,) * 4), IndexConfig(min_support=(2, 2, 2, 2)))


def quantisers(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("embedding")[0].cast("double") * 3
    return _wide(table(spark, sf_dir, "embeddings").select("vec_id", reference_value(x).alias("reference_value"), request_value(x).alias("request_value")))


def mcc_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    mcc = F.create_map(*(F.lit(x) for pair in EVENT_MCC.items() for x in pair))
    return _wide(table(spark, sf_dir, "events").select("event_id", mcc_risk(F.try_element_at(mcc, F.col("event_type"))).alias("risk")))


def marker_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.marker_scan(table(spark, sf_dir, "documents"), "text", oracles.MARKERS).select("doc_id", F.array_join("found", ",").alias("found"))


def score_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.scored(_stand_in(spark, sf_dir, "score_points"))
    return out.select("o_orderkey", "n", "fp", "fn", "http", "weighted_errors", *(F.round(c, 2).alias(c) for c in ("detection", "p99_score", "final")))


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_summary(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", ["o_orderdate", "o_orderkey"], F.col("o_totalprice") > 1000)


def participant_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.participant_summary(_stand_in(spark, sf_dir, "compared"))


def lower_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.lower_medians(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")


def representative_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", (F.col("o_custkey") % 5).alias("score"), "o_totalprice")
    return runs.representative(orders, "o_orderpriority", "score", "o_totalprice", "o_orderkey")


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports as the reader returns them."""
    r = _stand_in(spark, sf_dir, "archive")
    none = F.lit(None).cast("string")
    meta = F.struct(*(none.alias(c) for c in ("timestamp", "sha", "short_sha", "run_id", "run_url", "image", "html_report")), F.col("kind").alias("report_kind"), F.col("mode").alias("benchmark_k6_mode"))
    errors = F.struct(F.col("http").alias("http_errors"), F.col("fp").alias("false_positive_detections"), F.col("fn").alias("false_negative_detections"))
    result = F.struct("p99", F.struct("failure_rate", "final_score", errors.alias("breakdown")).alias("scoring"))
    return r.select("file", meta.alias("metadata"), result.alias("result"))


def archive_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.archive_rows(_reports(spark, sf_dir)).drop("timestamp", "sha", "short_sha", "run_id", "run_url", "image", "html_report")


def clean_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.archive_rows(_reports(spark, sf_dir)).agg(F.count_if(runs.clean_candidate()).alias("clean"))


def latest_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "candidate").otherwise("experiment")
    return runs.latest(table(spark, sf_dir, "events").select("event_id", kind.alias("kind")), "event_id", "kind")


def paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.pages(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", "page")


def head_to_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.head_to_head(_stand_in(spark, sf_dir, "rounds"))


def promotion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.promotion_gate(_stand_in(spark, sf_dir, "gate"))


def http_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stand_in(spark, sf_dir, "http")
    return rows.select("event_id", "method", "path", text.route(F.col("method"), F.col("path")).alias("route"), text.content_length(F.col("header")).alias("content_length"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        knn_vote, knn_certified, knn_ivf, knn_ivf_all_lists, knn_kmeans_all_lists, knn_ivf_staged, search_counters, stream_votes, tx_features, tx_scores,
        tx_scores_nested_loop, decision_json, replay_histogram, replay_of_first, summary_table, tx_features_loose, confusion, mismatch_sample, vector_keys, partition_summary, list_summary, kmeans_lists,
        profile_buckets, quantile_edges, shortcut_votes, purity_votes, quantisers, mcc_lookup, marker_scan, score_law, run_summary, participant_summary, lower_median,
        references_json, golden_check, representative_run, archive_rows, clean_candidates, latest_by_kind, paging, head_to_head, promotion_gate, http_requests,
    )
} | {
    "purity_buckets_1": _purity(1), "purity_buckets_2": _purity(2), "stored_tree": _stored(IndexConfig(leaf_size=64), EXACT),
    "stored_lists": _stored(IndexConfig(layout="lists", lists=LISTS), EXACT), "stored_kmeans": _stored(IndexConfig(layout="kmeans", lists=LISTS), SearchConfig(nprobe=LISTS)),
    "stored_flat": _stored(IndexConfig(layout="flat"), EXACT),
}
SQL = oracles.SQL
assert set(SQL) <= set(QUERIES) and len(FEATURES) == DIMS

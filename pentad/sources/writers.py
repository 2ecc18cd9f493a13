"""Writers: indexes, decisions, report archives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pentad.config import DIMS, FEATURES, SCALE, IndexConfig
from pentad.functions import keys
from pentad.functions.score import response
from pentad.operators import buckets, index
from pentad.operators.runs import archive_rows, latest
from pentad.sources.readers import INDEX_VERSION, reports
from pentad.storage import cut


def write_index(refs: DataFrame, path: str, config: IndexConfig = IndexConfig()) -> None:  # noqa: B008
    """refs in the layout that config names, with its boxes or centroids; but for k-means lists, with bucket tables too.
    Rows of a leaf, list or partition lie together."""
    refs = refs.select("ref_id", *FEATURES, "label")
    tables = {}
    if config.layout == "tree":
        placed, tables["nodes"] = index.tree(refs, config)
        together = F.col("node")
    elif config.layout == "kmeans":
        placed, centroids = index.kmeans_lists(refs, config)
        placed = cut(placed)
        sizes = placed.groupBy("list_id").agg(F.count(F.lit(1)).alias("n"))
        tables["lists"] = centroids.join(sizes, "list_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        together = F.col("list_id")
    elif config.layout == "lists":
        placed = cut(index.with_list(refs, config.lists))
        tables["lists"] = index.list_summaries(placed)
        together = F.col("list_id")
    else:
        placed, together = refs, keys.partition_key()
    placed.repartitionByRange(together).sortWithinPartitions(together).write.mode("overwrite").parquet(f"{path}/refs")
    stored = refs.sparkSession.read.parquet(f"{path}/refs")
    if config.layout != "kmeans":
        edges = cut(buckets.quantile_edges(stored))
        lists = buckets.edge_lists(edges)
        tables |= {"parts": index.partitions(stored), "profile": buckets.profile_table(stored), "edges": edges}
        tables |= {f"purity_{t}": buckets.purity_table(stored, t, lists, config) for t in (1, 2) if lists[t]}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    meta = [(INDEX_VERSION, DIMS, SCALE, config.layout, stored.count(), ["refs", *tables])]
    refs.sparkSession.createDataFrame(meta, "version int, dims int, scale int, layout string, rows long, tables array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def write_decisions(voted: DataFrame, path: str, mode: str = "append") -> None:
    """A JSON line for each query: its id and the response."""
    voted.select("query_id", response(F.col("fraud_count")).alias("response")).write.mode(mode).json(path)


def write_archive(spark, report_paths: str, out: str) -> None:
    """index (all reports, newest first), latest and, if there is a candidate, latest-candidate from a folder of reports."""
    rows = archive_rows(reports(spark, report_paths))
    rows.write.mode("overwrite").json(f"{out}/index")
    newest = latest(rows)
    newest.write.mode("overwrite").json(f"{out}/latest")
    if candidate := newest.first()["latest_candidate"]:
        rows.where(F.col("file") == candidate).write.mode("overwrite").json(f"{out}/latest-candidate")

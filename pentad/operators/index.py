"""Laying out a reference set: ref_id, f0..f13, label.

Partitions are the values of an 8-bit key (at most 256), the roots of a tree: a node with more than leaf_size references
is cut along its widest feature, at approximate quantiles, into eight, again and again; all nodes have bounding boxes.
Leaves have a bounded size, also where many references are equal: those are parted by a hash. Tables of nodes grow with
the references and are joined, level by level. Lists are equal ranges of the order by projection key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pentad.config import DIMS, FEATURES, IndexConfig
from pentad.functions import keys
from pentad.functions.quantize import column, real, rounded_mean, squared_distance
from pentad.operators.ranking import with_position
from pentad.storage import cut

#: Children of a node, at most, and the factor between a node's number and theirs.
FAN, STEP = 8, 16
#: Partition 0's node. Numbers of one level are below those of the next: 256 to 511, 4097 to 8184 and so on.
ROOT, LEVELS = 256, 13


def box_columns() -> list[Column]:
    """Aggregates: lo0.., hi0.., n."""
    low = [F.min(f).alias(f"lo{i}") for i, f in enumerate(FEATURES)]
    return [*low, *(F.max(f).alias(f"hi{i}") for i, f in enumerate(FEATURES)), F.count(F.lit(1)).alias("n")]


def partitions(refs: DataFrame) -> DataFrame:
    """part_id, box and n of each partition that holds rows."""
    return refs.groupBy(keys.partition_key().alias("part_id")).agg(*box_columns())


def tree(refs: DataFrame, config: IndexConfig = IndexConfig(), leaf_size: int | None = None) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """refs with node, their leaf; and the nodes: node, parent (0 for partitions), level, leaf, box and n. Only refs whose
    features are all known can be found, so only those are in it. Level by level, open nodes are parted. leaf_size, if
    given, stands for that of config: leaves that are themselves searched by trees may be large."""
    leaf_size = leaf_size or config.leaf_size
    known = F.lit(True)
    for f in FEATURES:
        known = known & F.col(f).isNotNull()
    rows = refs.select("ref_id", *FEATURES, "label", (keys.partition_key().cast("bigint") + ROOT).alias("node")).where(known)
    now, done, levels = cut(rows), [], []
    widths = F.array(*(column(f"hi{i}") - column(f"lo{i}") for i in range(DIMS)))
    lows = F.array(*(column(f"lo{i}") for i in range(DIMS)))
    while True:
        boxes = now.groupBy("node").agg(*box_columns()).withColumn("_widths", widths)
        axis = (F.array_position("_widths", F.array_max("_widths")) - 1).cast("int")
        level = len(levels)
        boxes = cut(boxes.withColumn("axis", axis).withColumn("width", F.array_max("_widths")).drop("_widths").withColumn("leaf", (F.col("n") <= leaf_size) | F.lit(level == LEVELS)))
        parent = F.call_function("div", F.col("node") - 1, F.lit(STEP).cast("bigint")) if level else F.lit(0).cast("bigint")
        levels.append(boxes.withColumn("parent", parent).withColumn("level", F.lit(level)).drop("axis", "width"))
        open_ = boxes.where(~F.col("leaf")).select("node", "axis", "width", F.element_at(lows, F.col("axis") + 1).alias("low"))
        if not open_.limit(1).count():
            done.append(now)
            break
        done.append(now.join(open_.select("node"), "node", "left_anti").select(*now.columns))
        along = F.element_at(F.array(*(column(f) for f in FEATURES)), F.col("axis") + 1)
        opened = now.join(open_, "node").withColumn("along", along)
        found = F.percentile_approx("along", [i / FAN for i in range(1, FAN)], 1000)
        cuts = opened.groupBy("node").agg(F.first("low").alias("low"), found.alias("found"))
        above = F.array_distinct(F.filter("found", lambda c: c > F.col("low")))
        cuts = cut(cuts.select("node", F.when(F.size(above) > 0, above).otherwise(F.array(F.col("low") + 1)).alias("cuts")))
        spread = F.pmod(F.xxhash64("ref_id", F.lit(level)), F.lit(FAN)).cast("int")
        child = F.when(F.col("width") == 0, spread).otherwise(F.size(F.filter("cuts", lambda c: c <= F.col("along"))))
        moved = opened.join(cuts, "node").select("ref_id", *FEATURES, "label", (F.col("node") * STEP + child + 1).alias("node"))
        now = cut(moved)
    placed, nodes = done[0], levels[0]
    for more in done[1:]:
        placed = placed.unionByName(more)
    for more in levels[1:]:
        nodes = nodes.unionByName(more)
    return placed, nodes


def with_list(refs: DataFrame, lists: int, n: int | None = None) -> DataFrame:
    """refs with pos (place by projection key, then ref_id) and list_id: lists equal ranges of places."""
    n = refs.count() if n is None else n
    lists = lists if 0 < lists <= n else max(n, 1)
    laid = with_position(refs.withColumn("_key", keys.projection_key()), [F.col("_key"), F.col("ref_id")]).drop("_key")
    return laid.withColumn("list_id", F.call_function("div", (F.col("pos") + 1) * lists - 1, F.lit(max(n, 1)).cast("bigint")))


def list_summaries(listed: DataFrame) -> DataFrame:
    """list_id, centroid c0.., box and n."""
    n = F.count(F.lit(1))
    means = [rounded_mean(F.sum(column(f)), n).alias(f"c{i}") for i, f in enumerate(FEATURES)]
    return listed.groupBy("list_id").agg(*means, *box_columns())


def nearest_in_window(rows: DataFrame, centroids: DataFrame, window: int) -> DataFrame:
    """rows with best: the nearest centroid among the lists at most window places from the row's own, the lower of
    equals. centroids: list_id and c0.., one for each list."""
    near = F.broadcast(centroids.select(F.col("list_id").alias("c_list"), *(f"c{i}" for i in range(DIMS))))
    pairs = rows.join(near, F.abs(F.col("c_list") - F.col("list_id")) <= window)
    d = squared_distance([real(f) for f in FEATURES], [real(f"c{i}") for i in range(DIMS)])
    best = pairs.groupBy("ref_id").agg(F.min(F.struct(d.alias("d"), "c_list"))["c_list"].alias("best"))
    return rows.join(best, "ref_id")


def kmeans_centroids(listed: DataFrame, config: IndexConfig, n: int | None = None) -> DataFrame:
    """list_id, c0..: a fixed number of Lloyd steps on a strided sample, seeded by the lists' means. A step looks at
    centroids within the window around a row's list; a list that gets no row keeps its centroid."""
    n = listed.count() if n is None else n
    centroids = cut(list_summaries(listed).select("list_id", *(f"c{i}" for i in range(DIMS))))
    stride = max(1, n // min(config.train_rows, max(n, 1)))
    sample = listed.where((F.col("pos") % stride == stride // 2) & (F.col("pos") < min(config.train_rows, n) * stride))
    for _ in range(config.iterations):
        got = nearest_in_window(sample, centroids, config.window).groupBy(F.col("best").alias("list_id"))
        means = got.agg(*(rounded_mean(F.sum(column(f)), F.count(F.lit(1))).alias(f"m{i}") for i, f in enumerate(FEATURES)))
        moved = centroids.join(means, "list_id", "left")
        centroids = cut(moved.select("list_id", *(F.coalesce(f"m{i}", f"c{i}").alias(f"c{i}") for i in range(DIMS))))
    return centroids


def kmeans_lists(refs: DataFrame, config: IndexConfig) -> tuple[DataFrame, DataFrame]:
    """refs with list_id (their nearest centroid in the window), and the centroids. Lists of this layout have no boxes."""
    n = refs.count()
    listed = cut(with_list(refs, config.lists, n))
    centroids = kmeans_centroids(listed, config, n)
    return nearest_in_window(listed, centroids, config.window).withColumn("list_id", F.col("best")).drop("best"), centroids

"""Tables of bucket purity, and answers from them without a search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pentad.config import FEATURES, IndexConfig, SearchConfig
from pentad.functions import keys

LEGIT, FRAUD, MOST = 1, 2, 65_535


def _counted(refs: DataFrame, key: Column) -> DataFrame:
    mask = F.bit_or(F.when(F.col("label") != 0, F.lit(FRAUD)).otherwise(F.lit(LEGIT)))
    return refs.groupBy(key.alias("key")).agg(F.least(F.count(F.lit(1)), F.lit(MOST)).alias("cnt"), mask.alias("mask"))


def profile_table(refs: DataFrame) -> DataFrame:
    """key, cnt (at most 65535), mask: 1 legit, 2 fraud, 3 both. Keys without rows are absent."""
    return _counted(refs, keys.profile_key())


def value_counts(refs: DataFrame) -> DataFrame:
    """feature, value, n: at most 20001 values of each of the 14 features."""
    pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("feature"), F.col(f).cast("int").alias("value")) for i, f in enumerate(FEATURES))))
    return refs.select(pairs.alias("x")).groupBy("x.feature", "x.value").agg(F.count(F.lit(1)).alias("n"))


def quantile_edges(refs: DataFrame) -> DataFrame:
    """purity_table (1, 2), place, feature, bin, edge: exact quantiles of the values, at (bin + 1) * rows div bins from 0;
    the last bin's edge is 32767. From the counts of values, a table of bounded size."""
    w = Window.partitionBy("feature").orderBy("value")
    upto = value_counts(refs).withColumn("upto", F.sum("n").over(w)).withColumn("rows", F.sum("n").over(Window.partitionBy("feature")))
    wanted = [(t, place, feature, bits) for t, fields in enumerate(keys.PURITY, 1) for place, (feature, bits) in enumerate(fields)]
    spec = refs.sparkSession.createDataFrame(wanted, "purity_table int, place int, feature int, bits int")
    bins = spec.withColumn("bins", F.pow(F.lit(2), "bits").cast("int"))
    bins = bins.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    joined = F.broadcast(bins).join(upto, "feature")
    at = F.call_function("div", (F.col("bin") + 1) * F.col("rows"), F.col("bins").cast("bigint"))
    value = F.min(F.when(F.col("upto") > F.least(at, F.col("rows") - 1), F.col("value")))
    found = joined.groupBy("purity_table", "place", "feature", "bin", "bins").agg(value.alias("value"))
    edge = F.when(F.col("bin") == F.col("bins") - 1, F.lit(32_767)).otherwise(F.col("value"))
    return found.select("purity_table", "place", "feature", "bin", edge.alias("edge"))


def edge_lists(edges: DataFrame) -> dict[int, dict[int, list[int]]]:
    """The edges that part bins, by table and place: 191 numbers whatever the input."""
    out: dict[int, dict[int, list[int]]] = {1: {}, 2: {}}
    for r in sorted(edges.collect(), key=lambda r: (r["purity_table"], r["place"], r["bin"])):
        out[r["purity_table"]].setdefault(r["place"], []).append(r["edge"])
    return {t: {p: e[:-1] for p, e in places.items()} for t, places in out.items()}


def purity_table(refs: DataFrame, table: int, edges: dict, config: IndexConfig = IndexConfig()) -> DataFrame:  # noqa: B008
    """key, cnt, mask of the buckets that hold one kind of label alone, and enough rows of it."""
    legit, fraud = config.min_support[2 * table - 2 : 2 * table]
    enough = ((F.col("mask") == LEGIT) & (F.col("cnt") >= legit)) | ((F.col("mask") == FRAUD) & (F.col("cnt") >= fraud))
    return _counted(refs, keys.purity_key(table, edges[table])).where(enough)


def shortcut_votes(queries: DataFrame, refs: DataFrame, search: SearchConfig, index: IndexConfig = IndexConfig()) -> DataFrame:  # noqa: B008
    """queries with shortcut: 0 or 5 where a pure bucket answers, null where a search must. The profile table is asked
    first, then purity tables 1 and 2. Bucket tables have as many rows as there are keys, so Spark picks the join."""
    out = queries.withColumn("shortcut", F.lit(None).cast("bigint"))

    def ask(df: DataFrame, table: DataFrame, key: Column, legit: Column, fraud: Column) -> DataFrame:
        df = df.withColumn("key", key).join(table, "key", "left")
        found = F.when((F.col("mask") == LEGIT) & legit, 0).when((F.col("mask") == FRAUD) & fraud, 5).cast("bigint")
        return df.withColumn("shortcut", F.coalesce("shortcut", found)).drop("key", "cnt", "mask")

    if search.profile_shortcut:
        legit, fraud = (F.col("cnt") >= n for n in search.profile_min)
        out = ask(out, profile_table(refs), keys.profile_key(), legit, fraud)
    if search.purity_shortcut:
        edges = edge_lists(quantile_edges(refs))
        for t in (1, 2):
            if edges[t]:
                legit, fraud = (F.lit(x) for x in search.purity_answers[2 * t - 2 : 2 * t])
                out = ask(out, purity_table(refs, t, edges, index), keys.purity_key(t, edges[t]), legit, fraud)
    return out

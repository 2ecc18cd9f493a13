"""Reference sets and transactions derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pentad.config import DIMS, FEATURES
from pentad.functions.features import with_features
from pentad.functions.quantize import reference_value

#: Stand-in merchant categories of the event types.
EVENT_MCC = {"click": "5411", "error": "7995", "purchase": "5912", "signup": "5944", "view": "5812"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def references(embeddings: DataFrame) -> DataFrame:
    """ref_id, f0..f13, label: the first 14 components, quantised; labels from 5 on are fraud."""
    values = [reference_value(F.col("embedding")[i].cast("double")).alias(f) for i, f in enumerate(FEATURES[:DIMS])]
    return embeddings.select(F.col("vec_id").alias("ref_id"), *values, F.when(F.col("label") >= 5, 1).otherwise(0).alias("label"))


def transactions(events: DataFrame) -> DataFrame:
    """A request for each event (event_id, label and the columns of schemas.REQUEST), built from its user's history."""
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("bigint")
    second = day * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    cents = F.round(F.col("value") * 100).cast("bigint")
    e = events.select("event_id", "ts", "user_id", "event_type", "value", cents.alias("cents"), second.alias("sec"))
    merchants = e.groupBy("event_type").agg(((F.sum("cents") / 5) / F.count(F.lit(1))).alias("merchant_avg"))
    user = Window.partitionBy("user_id")
    in_order = user.orderBy("sec", "event_id")
    e = e.withColumns({
        "customer_avg": (F.sum("cents").over(user) / 5) / F.count(F.lit(1)).over(user),
        "last": F.lag("sec").over(in_order),
        "last_ts": F.lag("ts").over(in_order),
        "known": F.collect_set("event_type").over(in_order.rowsBetween(Window.unboundedPreceding, -1)),
        "n24": F.count(F.lit(1)).over(user.orderBy("sec").rangeBetween(-86400, 0)) - 1,
    }).join(merchants, "event_type")

    def text(ts):
        return F.concat(F.regexp_replace(F.substring(ts.cast("string"), 1, 19), " ", "T"), F.lit("Z"))

    n = F.col("event_id")
    mcc = F.create_map(*(F.lit(x) for pair in EVENT_MCC.items() for x in pair))
    last = F.struct(text(F.col("last_ts")).alias("timestamp"), (n * 37 % 1200).cast("double").alias("km_from_current"))
    return e.select(
        "event_id", (F.col("event_type").isin("error", "signup") & (F.col("value") > 25)).cast("int").alias("label"), n.cast("string").alias("id"),
        F.struct((F.col("cents") / 5).alias("amount"), (n % 12 + 1).cast("double").alias("installments"), text(F.col("ts")).alias("requested_at")).alias("transaction"),
        F.struct(F.col("customer_avg").alias("avg_amount"), F.col("n24").cast("double").alias("tx_count_24h"), F.col("known").alias("known_merchants")).alias("customer"),
        F.struct(F.col("event_type").alias("id"), F.try_element_at(mcc, F.col("event_type")).alias("mcc"), F.col("merchant_avg").alias("avg_amount")).alias("merchant"),
        F.struct((n % 2 == 0).alias("is_online"), (n % 3 == 0).alias("card_present"), (n * 53 % 1500).cast("double").alias("km_from_home")).alias("terminal"),
        F.when(F.col("last").isNotNull(), last).alias("last_transaction"),
    )


def transaction_features(events: DataFrame) -> DataFrame:
    """event_id, f0..f13, label, valid."""
    return with_features(transactions(events), strict=True).select("event_id", *FEATURES, "label", "valid")

"""The 14 features of a transaction request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pentad.config import FEATURES, MISSING, SCALE
from pentad.functions.quantize import request_value

#: Risk by merchant category, times 10000; others have the default.
MCC_RISK = {"5411": 1500, "5812": 3000, "5912": 2000, "5944": 4500, "7801": 8000, "7802": 7500, "7995": 8500, "4511": 3500, "5311": 2500, "5999": 5000}
DEFAULT_RISK = 5000


def mcc_risk(mcc: Column) -> Column:
    """By the first four characters."""
    table = F.create_map(*(F.lit(x) for pair in MCC_RISK.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.substring(F.coalesce(mcc, F.lit("")), 1, 4)), F.lit(DEFAULT_RISK)).cast("smallint")


def _part(ts: Column, start: int, n: int) -> Column:
    return F.coalesce(F.substring(ts, start, n).try_cast("int"), F.lit(0))


def _day(ts: Column) -> Column:
    return F.substring(ts, 1, 10).try_cast("date")


def hour(ts: Column) -> Column:
    return _part(ts, 12, 2)


def weekday(ts: Column) -> Column:
    """Monday is 0."""
    return F.coalesce(F.weekday(_day(ts)), F.lit(0))


def epoch_minutes(ts: Column) -> Column:
    """Of the text's date, hour and minute; seconds and offsets do not count, nor does the session's time zone."""
    days = F.coalesce(F.datediff(_day(ts), F.lit("1970-01-01").cast("date")), F.lit(0)).cast("bigint")
    return days * 1440 + hour(ts) * 60 + _part(ts, 15, 2)


def known_merchant(known: Column, merchant: Column, strict: bool) -> Column:
    """strict: the id is listed; else it is part of the list's text, as a scan of the raw list finds it."""
    if strict:
        return F.coalesce(F.array_contains(known, merchant), F.lit(False))
    return F.coalesce(F.contains(F.array_join(known, '","'), merchant) & (merchant != ""), F.lit(False))


def valid_request(has_last: Column) -> Column:
    """True if nothing that the features need is missing; has_last: the last transaction is given, be it as null."""
    needed = (
        "transaction.amount", "transaction.installments", "transaction.requested_at", "customer.avg_amount", "customer.tx_count_24h",
        "customer.known_merchants", "merchant.id", "merchant.mcc", "merchant.avg_amount", "terminal.is_online", "terminal.card_present",
        "terminal.km_from_home",
    )
    ok = has_last
    for name in needed:
        ok = ok & F.col(name).isNotNull()
    ok = ok & (F.length("transaction.requested_at") >= 16) & (F.col("customer.avg_amount") != 0)
    last = F.col("last_transaction")
    ok_last = last.isNull() | (last["timestamp"].isNotNull() & (F.length(last["timestamp"]) >= 16) & last["km_from_current"].isNotNull())
    return F.coalesce(ok & ok_last, F.lit(False))


def with_features(requests: DataFrame, strict: bool = False, has_last: Column | None = None) -> DataFrame:
    """requests (columns of schemas.REQUEST) and valid, f0..f13. Rows that are not valid have null features."""
    t, c, m, k = (F.col(x) for x in ("transaction", "customer", "merchant", "terminal"))
    at, last = t["requested_at"], F.col("last_transaction")
    minutes = epoch_minutes(at) - epoch_minutes(last["timestamp"])
    flag = lambda x: F.when(x, F.lit(SCALE)).otherwise(F.lit(0)).cast("smallint")
    or_missing = lambda x: F.when(last.isNull(), F.lit(MISSING).cast("smallint")).otherwise(x)
    ratio = t["amount"] / F.nullif(c["avg_amount"], F.lit(0.0)) / 10.0
    values = (
        request_value(t["amount"] / 10000.0), request_value(t["installments"] / 12.0), request_value(ratio),
        request_value(hour(at) / 23.0), request_value(weekday(at) / 6.0), or_missing(request_value(minutes / 1440.0)),
        or_missing(request_value(last["km_from_current"] / 1000.0)), request_value(k["km_from_home"] / 1000.0),
        request_value(c["tx_count_24h"] / 20.0), flag(k["is_online"]), flag(k["card_present"]),
        flag(~known_merchant(c["known_merchants"], m["id"], strict)), mcc_risk(m["mcc"]), request_value(m["avg_amount"] / 10000.0),
    )
    out = requests.withColumn("valid", valid_request(F.lit(True) if has_last is None else has_last))
    return out.withColumns({f: F.when(F.col("valid"), v) for f, v in zip(FEATURES, values, strict=True)})

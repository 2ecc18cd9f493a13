import pytest
from pyspark.sql import functions as F

from pentad.config import FEATURES
from pentad.functions.features import with_features
from pentad.functions.quantize import reference_value, request_value, rounded_mean
from pentad.sources.readers import requests
from tests.data import request

ONE = [385, 2500, 500, 8696, 3333, 104, 188, 137, 1500, 0, 10000, 0, 2000, 299]
TWO = [41, 1667, 500, 7826, 3333, -10000, -10000, 292, 1500, 0, 10000, 10000, 1500, 60]
SECOND = dict(
    transaction={"amount": 41.12, "installments": 2, "requested_at": "2026-03-11T18:45:53Z"}, customer={"avg_amount": 82.24, "tx_count_24h": 3, "known_merchants": ["MERC-003"]},
    merchant={"id": "MERC-016", "mcc": "5411", "avg_amount": 60.25}, terminal={"is_online": False, "card_present": True, "km_from_home": 29.23}, last_transaction=None,
)


def parsed(spark, bodies, strict=False):
    lines = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "query_id long, value string")
    rows = with_features(requests(lines), strict, F.col("has_last")).orderBy("query_id").collect()
    return [(r["valid"], [r[f] for f in FEATURES]) for r in rows]


def test_golden_requests(spark):
    assert parsed(spark, [request(), request(**SECOND)]) == [(True, ONE), (True, TWO)]


@pytest.mark.parametrize("strict", [False, True])
def test_edges(spark, strict):
    cases = [
        request(transaction__amount=KeyError), request(customer__avg_amount=0), request(transaction__requested_at="2026-03-11T20"), "not json", request(last_transaction=KeyError), None,
        request(last_transaction__timestamp="2026-03-12T20:08:35Z"), request(merchant__mcc="59"), request(merchant__mcc="59129"), request(merchant__id="MERC-00"),
        request(transaction__amount=1e9), request(transaction__amount=-5), request(customer__known_merchants=[]), request(last_transaction=None), request(customer__avg_amount=-1.0),
    ]
    got = parsed(spark, cases, strict)
    assert [ok for ok, _ in got] == [False] * 6 + [True] * 9
    assert all(v is None for ok, values in got if not ok for v in values)
    value = lambda i, f: got[i][1][f]
    assert (value(6, 5), value(7, 12), value(8, 12)) == (0, 5000, 2000)
    assert value(9, 11) == (10000 if strict else 0) and value(12, 11) == 10000
    assert (value(10, 0), value(11, 0), value(13, 5), value(13, 6), value(14, 2)) == (10000, 0, -10000, -10000, 0)


def test_quantisers(spark):
    cases = [0.00005, -0.00005, 1.7, -1.7, 0.5, -0.33335, 0.0, None]
    rows = spark.createDataFrame([(x,) for x in cases], "x double").select(reference_value(F.col("x")).alias("a"), request_value(F.col("x")).alias("b")).collect()
    assert [r.a for r in rows] == [1, -1, 10000, -10000, 5000, -3334, 0, None]
    assert [r.b for r in rows] == [1, 0, 10000, 0, 5000, 0, 0, None]


def test_rounded_mean(spark):
    cases = [(5, 2), (-5, 2), (4, 3), (-4, 3), (0, 5), (7, 0)]
    rows = spark.createDataFrame(cases, "s long, n long").select(rounded_mean(F.col("s"), F.col("n")).alias("m")).collect()
    assert [r.m for r in rows] == [3, -3, 1, -1, 0, 0]

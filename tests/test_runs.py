import pytest
from pyspark.sql import functions as F

from pentad.config import IndexConfig, SearchConfig
from pentad.functions.score import format_ms, parse_ms, response
from pentad.operators import evaluate, runs


def test_score_law(spark):
    points = [(54058, 300, 407, 0, 0.93, 596.01), (54059, 0, 1, 0, 0.45, 2819.38), (54058, 41, 7, 0, 0.35, 2400.67), (52488, 0, 0, 52196, 2001.82, -3000.0), (54100, 0, 0, 0, 1.44, 3000.0)]
    rows = runs.scored(spark.createDataFrame([p[:5] for p in points], "n long, fp long, fn long, http long, p99 double")).collect()
    for r, p in zip(rows, points, strict=True):
        assert r.detection == pytest.approx(p[5], abs=0.02)
    assert rows[3].final == -6000 and rows[4].final == pytest.approx(5841.64, abs=0.01) and rows[1].p99_score == 3000


def test_participants(spark):
    rows = [(1, "a", "0.29ms"), (2, "a", "0.41"), (1, "b", "0.61ms"), (2, "b", "0.30ms")]
    table = spark.createDataFrame([(*r, 6000.0, 0, 0, 0) for r in rows], "seq int, participant string, p99 string, final_score double, false_positive_detections int, false_negative_detections int, http_errors int")
    a, b = runs.participant_summary(table).collect()
    assert (a.runs, a.min, a.max, a.latest, a.clean) == (2, 0.29, 0.41, 0.41, True) and a.median == pytest.approx(0.35)
    assert b.median == pytest.approx(0.455) and b.latest == 0.30


def test_medians_and_representative(spark):
    rows = [("g", 1, 5.0, 3.0), ("g", 2, 5.0, 1.0), ("g", 3, 4.0, 9.0), ("g", 4, 6.0, 2.0)]
    table = spark.createDataFrame(rows, "g string, run int, score double, p99 double")
    assert runs.lower_medians(table, "g", "p99").first()["lower_median"] == 2.0
    assert runs.representative(table, "g", "score", "p99", "run").first()["run"] == 2


def test_times_and_response(spark):
    rows = spark.createDataFrame([("0.36ms",), (" 1.5 ",), ("x",)], "t string").select(parse_ms(F.col("t")).alias("v")).withColumn("f", format_ms(F.col("v"))).collect()
    assert [r.v for r in rows] == [0.36, 1.5, None] and [r.f for r in rows][:2] == ["0.36ms", "1.5ms"]
    out = spark.range(7).select(response(F.col("id")).alias("r")).collect()
    assert out[0].r == '{"approved":true,"fraud_score":0.0}' and out[3].r == '{"approved":false,"fraud_score":0.6}' and out[6].r == out[5].r


def test_confusion(spark):
    rows = [(0, 0, 5, True), (1, 5, 0, True), (2, 2, 1, True), (3, 4, 4, True), (4, 5, 0, False)]
    table = spark.createDataFrame(rows, "query_id long, expected long, fraud_count long, valid boolean")
    got = evaluate.confusion(table).first()
    assert (got.total, got.false_positives, got.false_negatives, got.mismatches, got.vectorize_errors) == (5, 1, 1, 3, 1)
    assert [got[f"bucket_{i}"] for i in range(6)] == [1, 1, 0, 0, 1, 1]
    assert [r.query_id for r in evaluate.mismatches(table, 2).collect()] == [0, 1]


def test_knobs_raise():
    for bad in (dict(leaf_size=7), dict(layout="heap"), dict(iterations=33), dict(min_support=(0, 1, 1, 1))):
        with pytest.raises(ValueError):
            IndexConfig(**bad)
    for bad in (dict(nprobe=0), dict(repair_max=6), dict(early_milli=2001), dict(worst_thresholds=(0,))):
        with pytest.raises(ValueError):
            SearchConfig(**bad)
    got = SearchConfig.from_mapping({"nprobe": "7", "exact_fallback": "false", "worst_thresholds": "1,2,3,4,5,6", "other": "x"})
    assert (got.nprobe, got.exact_fallback, got.worst_thresholds[5], got.early_distance) == (7, False, 6, 0)
    assert SearchConfig(early_milli=10).early_distance == 10000

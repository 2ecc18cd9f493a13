import gzip
import json

import pytest
from pyspark.sql import functions as F

from pentad.config import FEATURES, IndexConfig, SearchConfig
from pentad.operators import knn, runs, text
from pentad.sources import readers, writers
from pentad.streaming.scoring import request_stream, score_requests, score_stream
from tests.data import queries, refs, request


def test_references(spark, tmp_path):
    rows = [{"vector": [0.00005, -0.00005, 1.7, -1.7] + [0.0] * 9 + [0.25], "label": "fraud"}, {"vector": [0] * 14, "label": "legit"}]
    with gzip.open(tmp_path / "r.json.gz", "wt") as f:
        json.dump(rows, f)
    got = readers.references(spark, str(tmp_path / "r.json.gz")).orderBy("ref_id").collect()
    assert [got[0][f] for f in FEATURES] == [1, -1, 10000, -10000] + [0] * 9 + [2500] and [r.label for r in got] == [1, 0]
    (tmp_path / "bad.json").write_text(json.dumps([{"vector": [1.0], "label": "legit"}]))
    with pytest.raises(Exception, match="14 numbers"):
        readers.references(spark, str(tmp_path / "bad.json")).collect()


def test_expected_answers(spark, tmp_path):
    (tmp_path / "e.tsv").write_text(f"3\t{request()}\r\nno tab\n0\tx\ty\n")
    got = readers.expected_answers(spark, str(tmp_path / "e.tsv")).collect()
    assert [(r.expected, r.value) for r in got] == [(3, request()), (0, "x\ty")]


@pytest.mark.parametrize("layout", ["flat", "lists", "kmeans", "tree"])
def test_index_round_trip(spark, tmp_path, layout):
    table = refs(spark, [(1000, 0)] * 16 + [(0, 1), (1, 0), (2, 1), (3, 0), (4, 1)] + [(1000, 0)] * 11)
    path = str(tmp_path / "i")
    writers.write_index(table, path, IndexConfig(layout=layout, lists=2, leaf_size=8, min_support=(1, 1, 1, 1)))
    tables = readers.stored_index(spark, path)
    own = {"flat": set(), "lists": {"lists"}, "kmeans": {"lists"}, "tree": {"nodes"}}[layout]
    built = set() if layout == "kmeans" else {"parts", "profile", "edges", "purity_1", "purity_2"}
    assert {"refs"} | own | built == set(tables)
    asked = queries(spark, [[0] * 14, [1000] + [0] * 13])
    got = {r.query_id: r.fraud_count for r in knn.stored(asked, tables, SearchConfig(nprobe=2)).collect()}
    assert got == {0: 3, 1: 0}
    if built:
        assert tables["parts"].agg(F.sum("n")).first()[0] == 32
    table.limit(5).withColumn("node", F.lit(0)).withColumn("list_id", F.lit(0)).write.mode("overwrite").parquet(f"{path}/refs")
    with pytest.raises(ValueError):
        readers.stored_index(spark, path)
    spark.createDataFrame([(9, 14, 10000, ["refs"])], "version int, dims int, scale int, tables array<string>").write.mode("overwrite").json(f"{path}/meta")
    with pytest.raises(ValueError):
        readers.stored_index(spark, path)


def report(score, kind, p99="0.36ms", failures="0%"):
    meta = {"timestamp": "2026-05-29T22:51:53Z", "sha": "a"} | ({"report_kind": kind} if kind else {})
    errors = {"http_errors": 0, "false_positive_detections": 0, "false_negative_detections": 0}
    return json.dumps({"metadata": meta, "result": {"p99": p99, "scoring": {"failure_rate": failures, "final_score": score, "breakdown": errors}}}, indent=1)


def test_archive(spark, tmp_path):
    for name, body in (("r-1.json", report(6000, None)), ("r-2.json", report(5800.5, "experiment")), ("r-0.json", report(5, "candidate", failures="1%"))):
        (tmp_path / name).write_text(body)
    rows = runs.archive_rows(readers.reports(spark, str(tmp_path / "r-*.json")))
    assert [(r.file, r.report_kind, r.benchmark_k6_mode, r.final_score) for r in rows.collect()] == [("r-2.json", "experiment", "docker", 5800.5), ("r-1.json", "candidate", "docker", 6000.0), ("r-0.json", "candidate", "docker", 5.0)]
    assert tuple(runs.latest(rows).first()) == ("r-2.json", "r-1.json")
    assert rows.agg(F.count_if(runs.clean_candidate())).first()[0] == 2
    writers.write_archive(spark, str(tmp_path / "r-*.json"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/index")).count() == 3
    assert [r.file for r in spark.read.json(str(tmp_path / "out/latest-candidate")).collect()] == ["r-1.json"]


def test_comparisons(spark, tmp_path):
    row = {"participant": "a", "p99": "0.3ms", "final_score": 6000, "false_positive_detections": 0, "false_negative_detections": 0, "http_errors": 0}
    (tmp_path / "1.json").write_text(json.dumps({"results": [row, row | {"participant": "b"}]}))
    (tmp_path / "2.json").write_text(json.dumps([row | {"p99": 0.5}]))
    got = runs.participant_summary(readers.comparison(spark, str(tmp_path / "*.json"))).collect()
    assert [(r.participant, r.runs, r.latest, r.clean) for r in got] == [("a", 2, 0.5, True), ("b", 1, 0.3, True)]
    (tmp_path / "3.json").write_text('{"x": 1}')
    with pytest.raises(Exception, match="without results"):
        readers.comparison(spark, str(tmp_path / "3.json")).collect()


def test_official_results(spark):
    block = lambda url, p: "text\n```json\n{}\n```\n```json\n" + json.dumps({"test-results": {"p99": p, "scoring": {"final_score": 5000.0}}, "repo-url": url}) + "\n```"
    rows = [(1, block("u", "1ms"), None, "2026-01-03"), (2, block("u", "2ms"), "2026-01-04", None), (3, block("other", "3ms"), "2026-01-05", None), (4, "no block", "2026-01-05", None)]
    got = readers.official_results(spark.createDataFrame(rows, "id int, body string, commented_at string, closed_at string"), "body", "u").collect()
    assert [r.id for r in got] == [2, 1]


def test_markers_and_routes(spark):
    files = spark.createDataFrame([("a", "x secret y"), ("b", None), ("c", "clean")], "file string, text string")
    assert [(r.file, r.found) for r in text.marker_scan(files, "text", ["secret", "x", "z"]).collect()] == [("a", ["secret", "x"])]


def test_stream_equals_batch(spark, tmp_path):
    table = refs(spark, [([385, 2500, 500, 8696, 3333, 104, 188, 137, 1500, 0, 10000, 0, 2000, 299], 1)] * 3 + [(9000, 0)] * 5)
    bodies = [request(), "broken", request(transaction__amount=9000)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.txt").write_text("\n".join(bodies[:2]))
    (tmp_path / "in/2.txt").write_text(bodies[2])
    seen = []
    score_stream(request_stream(spark, str(tmp_path / "in"), 1), table, lambda df, n: seen.extend((n, *r) for r in df.collect()), str(tmp_path / "ck")).awaitTermination()
    assert len({n for n, *_ in seen}) == 2 and len(seen) == 3
    lines = spark.createDataFrame(list(enumerate(bodies)), "query_id long, value string")
    rows = {r.query_id: r for r in score_requests(lines, table).collect()}
    assert (rows[0].fraud_count, rows[0].approved, rows[1].valid, rows[1].approved, rows[1].fraud_score) == (3, False, False, True, 0.0)
    writers.write_decisions(score_requests(lines, table), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    assert sorted(r.fraud_count for r in rows.values()) == sorted(r[2] for r in seen)

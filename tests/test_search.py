import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pentad.config import DIMS, FEATURES, IndexConfig, SearchConfig
from pentad.operators import evaluate, index, knn
from pentad.plans import queries as library
from pentad.plans import tables
from pentad.plans.tables import transaction_features
from tests.data import queries, refs, vector

ZERO = [[0] * DIMS]


def fraud(df):
    return df.first()["fraud_count"]


def lists_of(spark, table, number, centroids=None):
    listed = table.withColumn("list_id", F.element_at(F.array(*map(F.lit, number)), (F.col("ref_id") + 1).cast("int")))
    lists = index.list_summaries(listed)
    for i, c in (centroids or {}).items():
        lists = lists.withColumn("c0", F.when(F.col("list_id") == i, F.lit(c)).otherwise(F.col("c0")))
    return listed, lists


def test_flat(spark):
    table = refs(spark, [(0, 0), (1000, 1), (2000, 1), (3000, 0), (4000, 1), (5000, 0)])
    for search in (knn.flat, knn.certified):
        assert fraud(search(queries(spark, ZERO), table)) == 3


def test_distance(spark):
    got = knn.flat(queries(spark, ZERO), refs(spark, [(vector(f9=10000, f10=10000), 1)] * 5)).first()
    assert (got["worst"], got["fraud_count"]) == (200_000_000, 5)


def test_repair(spark):
    listed, lists = lists_of(spark, refs(spark, [(10, 1), (20, 1), (30, 0), (40, 0), (50, 1), (0, 0)]), [0] * 5 + [1], {1: 10000})
    search = SearchConfig(nprobe=1, repair_nprobe=2, repair_min=3, repair_max=3)
    got = knn.staged(queries(spark, ZERO), listed, lists.drop(*(c for c in lists.columns if c[:2] in ("lo", "hi"))), search, boxes=False).first()
    assert (got["fast_fraud"], got["fraud_count"], got["repaired"], got["repair_certified"]) == (3, 2, True, True)
    assert (got["lists_fast"], got["lists_repair"], got["vectors_fast"], got["vectors_repair"]) == (1, 1, 5, 1)


def test_exact_fallback(spark):
    wide = [100 if i % 2 else -100 for i in range(DIMS)]
    rows = [(wide if i % 2 else [-x for x in wide], 1) for i in range(5)] + [(i, 0) for i in range(5)]
    listed, lists = lists_of(spark, refs(spark, rows), [0] * 5 + [1] * 5)
    far = lists.withColumn("centre", F.lit(0))
    search = SearchConfig(nprobe=1, repair_nprobe=1, repair_min=5, repair_max=5)
    ranked = far.withColumn("c0", F.when(F.col("list_id") == 1, 10000).otherwise(0)).drop("centre")
    got = knn.staged(queries(spark, ZERO), listed, ranked, search).first()
    assert (got["fast_fraud"], got["exact_fallback"], got["fraud_count"]) == (5, True, 0)
    off = knn.staged(queries(spark, ZERO), listed, ranked, SearchConfig(nprobe=1, repair_nprobe=1, repair_min=5, repair_max=5, exact_fallback=False)).first()
    assert (off["fraud_count"], off["exact_fallback"]) == (5, False)


def test_blocks(spark):
    rows = [(0, 1), (10, 1), (20, 0), (30, 1)] + [(x, 0) for x in range(40, 100, 10)]
    listed, lists = lists_of(spark, refs(spark, rows), [0] * 7 + [1] * 3)
    assert fraud(knn.staged(queries(spark, ZERO), listed, lists, SearchConfig(nprobe=2))) == 3
    rows = [(1000, 0)] * 16 + [(0, 1), (1, 0), (2, 1), (3, 0), (4, 1)] + [(1000, 0)] * 11
    listed, lists = lists_of(spark, refs(spark, rows), [0] * 16 + [1] * 16)
    assert fraud(knn.staged(queries(spark, ZERO), listed, lists, SearchConfig(nprobe=1), boxes=False)) == 3


def test_few_references_and_ties(spark):
    for search in (knn.flat, knn.certified):
        got = search(queries(spark, ZERO), refs(spark, [(5, 1), (6, 1)])).first()
        assert (got["fraud_count"], got["worst"]) == (2, None)
        assert fraud(search(queries(spark, ZERO), refs(spark, [(5, 1)]).limit(0))) == 0
        tied = refs(spark, [(10, 0), (-10, 0), (10, 0), (-10, 0), (10, 0), (10, 1), (5, 1)])
        assert fraud(search(queries(spark, ZERO), tied)) == 1
        none = queries(spark, [[None] * DIMS, [0] * DIMS])
        assert {r.query_id: r.fraud_count for r in search(none, refs(spark, [(i, 1) for i in range(6)])).collect()} == {0: 0, 1: 5}


@pytest.mark.parametrize("seed", [1, 2])
def test_searches_agree(spark, seed):
    rng = random.Random(seed)
    centres = [[rng.randrange(-10000, 10001) for _ in range(DIMS)] for _ in range(12)]
    point = lambda c: [max(-10000, min(10000, x + rng.randrange(-300, 301))) for x in c]
    table = refs(spark, [(point(rng.choice(centres)), rng.randrange(2)) for _ in range(600)]).cache()
    asked = queries(spark, [point(rng.choice(centres)) for _ in range(60)])
    want = {r.query_id: (r.fraud_count, r.worst) for r in knn.flat(asked, table).collect()}
    exact = SearchConfig(nprobe=2, repair_nprobe=4, repair_min=0, repair_max=5)
    for got in (knn.certified(asked, table), knn.certified(asked, table, IndexConfig(leaf_size=8)), knn.ivf(asked, table, IndexConfig(lists=12), exact)):
        assert {r.query_id: (r.fraud_count, r.worst) for r in got.collect()} == want
    quick = knn.ivf(asked, table, IndexConfig(lists=12), SearchConfig(nprobe=4, repair_nprobe=4, exact_fallback=False)).collect()
    sure = [r for r in quick if r.fast_certified]
    assert sure and all((r.fraud_count, r.worst) == want[r.query_id] for r in sure)


def test_lists_and_leaves_cover_rows_once(spark):
    rng = random.Random(3)
    table = refs(spark, [([rng.randrange(-10000, 10001) for _ in FEATURES], 0) for _ in range(101)])
    for lists in (1, 7, 100, 101, 500):
        sizes = [r["n"] for r in index.with_list(table, lists).groupBy("list_id").agg(F.count(F.lit(1)).alias("n")).orderBy("list_id").collect()]
        m = min(lists, 101)
        assert sizes == [(i + 1) * 101 // m - i * 101 // m for i in range(m)]


@pytest.mark.parametrize("kind", ["spread", "equal", "two values", "one far"])
def test_tree_covers_rows_once(spark, kind):
    rng = random.Random(4)
    rows = {
        "spread": [[rng.randrange(-10000, 10001) for _ in FEATURES] for _ in range(1500)],
        "equal": [[7] * DIMS] * 900,
        "two values": [[5] * 13 + [int(i % 50 == 0)] for i in range(900)],
        "one far": [[0] * DIMS] * 300 + [[1] + [0] * 13] + [[9000] * DIMS],
    }[kind]
    table = refs(spark, [(v, 0) for v in rows])
    placed, nodes = index.tree(table, IndexConfig(leaf_size=16))
    got = {r.ref_id: r for r in placed.collect()}
    boxes = {r.node: r for r in nodes.collect()}
    assert sorted(got) == list(range(len(rows))) and sum(b.n for b in boxes.values() if b.leaf) == len(rows)
    assert all(b.n <= 16 for b in boxes.values() if b.leaf) and all(b.parent in boxes for b in boxes.values() if b.level)
    for r in got.values():
        assert all(boxes[r.node][f"lo{i}"] <= r[f] <= boxes[r.node][f"hi{i}"] for i, f in enumerate(FEATURES)) and boxes[r.node].leaf
    asked = queries(spark, rows[:20] + [[100] * DIMS])
    want = {r.query_id: (r.fraud_count, r.worst) for r in knn.flat(asked, table).collect()}
    assert {r.query_id: (r.fraud_count, r.worst) for r in knn.tree_search(asked, placed, nodes).collect()} == want


def test_blocks_of_queries_and_references(spark, monkeypatch):
    rng = random.Random(5)
    table = refs(spark, [([rng.randrange(0, 40) for _ in FEATURES], rng.randrange(2)) for _ in range(300)])
    asked = queries(spark, [[rng.randrange(0, 40) for _ in FEATURES] for _ in range(70)])
    x = np.array([[r[f] for f in FEATURES] for r in table.orderBy("ref_id").collect()], np.int64)
    labels = [r.label for r in table.orderBy("ref_id").collect()]
    for size in (7, 8192):
        monkeypatch.setattr(knn, "REF_BLOCK", size)
        monkeypatch.setattr(knn, "QUERY_BLOCK", size)
        for search in (knn.flat, knn.certified):
            for r in search(asked, table).join(asked, "query_id").collect():
                d = ((x - np.array([r[f] for f in FEATURES])) ** 2).sum(1)
                near = np.lexsort((np.arange(300), d))[:5]
                assert (r.fraud_count, r.worst) == (sum(labels[j] for j in near), int(d[near].max()))


def test_early_distance_stops(spark):
    listed, lists = lists_of(spark, refs(spark, [(10, 1)] * 3 + [(10, 0)] * 2 + [(0, 0)]), [0] * 5 + [1], {1: 10000})
    got = knn.staged(queries(spark, [vector(f0=11)]), listed, lists, SearchConfig(nprobe=1, repair_nprobe=2, early_milli=100)).first()
    assert (got["fraud_count"], got["repaired"]) == (3, False)


def test_every_event_is_scored(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted(transaction_features(spark.read.parquet(f"{sf}/events.parquet")).collect(), key=lambda r: r.event_id)
    x = np.array([[r[f] for f in FEATURES] for r in rows], np.int64)
    got = {r.query_id: r.fraud_count for r in library.tx_scores(spark, sf).collect()}
    assert set(got) == {r.event_id for r in rows}
    for i, r in enumerate(rows):
        if r.valid:
            near = np.lexsort((np.array([q.event_id for q in rows]), ((x - x[i]) ** 2).sum(1)))[:5]
            assert got[r.event_id] == sum(rows[j].label for j in near), r.event_id


def test_replay_limit_and_readiness(spark):
    table = refs(spark, [(i, int(i > 6)) for i in range(12)])
    assert evaluate.ready(table) and not evaluate.ready(table.limit(0))
    got = evaluate.replay(table, knn.flat, limit=3).first()
    assert (got.label_0, got.label_1, got.fraud_0, sum(got[f"fraud_{i}"] for i in range(6))) == (7, 5, 3, 3)
    assert sum(evaluate.replay(table, knn.flat).first()[f"fraud_{i}"] for i in range(6)) == 12


def test_blocks_are_searched_by_leaves():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 5, (3000, len(FEATURES))).astype(np.int16) * 100
    x[500:2000] = x[500]  # more equal rows than a leaf holds
    x[2000:] = rng.integers(0, 10000, (1000, len(FEATURES)))
    ids, labels, limit = rng.permutation(3000), rng.integers(0, 2, 3000).astype(np.int32), np.where(np.arange(3000) % 3 == 0, 10**5, 1 << 62)
    columns = {f: x[:, i] for i, f in enumerate(FEATURES)}
    got = {}
    found = knn._near_block(pa.table({"query_id": np.arange(3000), **columns, "limit": limit}), pa.table({"ref_id": ids, **columns, "label": labels}))
    for r in found.to_pylist():
        got.setdefault(r["query_id"], []).append((r["dist"], r["ref_id"], r["label"]))
    wide = x.astype(np.int64)
    for i in range(0, 3000, 7):
        d = ((wide - wide[i]) ** 2).sum(1)
        near = [j for j in np.lexsort((ids, d))[:5] if d[j] <= limit[i]]
        assert sorted(got.get(i, [])) == [(d[j], ids[j], labels[j]) for j in near]
    assert max(map(len, knn._leaves(x, 64, True))) <= 64 and sum(map(len, knn._leaves(x, 64, True))) < 1700
    assert sorted(np.concatenate(knn._leaves(x, 64, False)).tolist()) == list(range(3000))


def test_equal_queries_are_searched_once(spark, monkeypatch):
    rng, asked = random.Random(9), []
    points = [[rng.randrange(0, 4000, 500) for _ in range(DIMS)] for _ in range(30)]
    rows = [(p, rng.randrange(2)) for k, p in enumerate(points) for _ in range((1, 3, 5, 9)[k % 4])]
    rng.shuffle(rows)
    vectors = [p for p in points for _ in range(4)] + [vector(f3=7)] * 3 + [[None] * DIMS]
    nearest_in = knn.nearest_in

    def counted(probes, *rest):
        asked.append(probes.select("query_id").distinct().count())
        return nearest_in(probes, *rest)

    monkeypatch.setattr(knn, "nearest_in", counted)

    def plain(v):
        near = sorted((sum((a - b) ** 2 for a, b in zip(v, r, strict=True)), i, label) for i, (r, label) in enumerate(rows))[:5]
        return sum(label for _, _, label in near), near[-1][0]

    for search in (knn.flat, knn.certified):
        got = {r.query_id: (r.fraud_count, r.worst) for r in search(queries(spark, vectors), refs(spark, rows)).collect()}
        assert got == {i: (0, None) if v[0] is None else plain(v) for i, v in enumerate(vectors)}
    open_ = sum(k % 4 < 2 for k in range(len(points))) + 1  # those of which five references are not equal
    assert asked == [open_, open_]


def test_golden_check_builds_the_requests_once(spark, monkeypatch):
    made = []
    for where in (library, tables):

        def counted(events, transactions=where.transactions):
            made.append(1)
            return transactions(events)

        monkeypatch.setattr(where, "transactions", counted)
    got = library.golden_check(spark, "/root/testdata/sf0.001").first()
    assert len(made) == 1 and got["total"] == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()

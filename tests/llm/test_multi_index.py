import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pentad.llm.multi_index import LEAST, SHARE, multi_index_search, search_shard, shards_of, walk


def best(rows, q, k):
    vec = min(v for i, v in rows if i == q)
    return sorted((-float((np.array(v) * np.array(vec)).sum()), i) for i, v in rows if i != q)[:k]


def test_recall_and_scores(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(100_001, None), (100_020, []), (100_040, [None] * 16), (100_060, [float("nan")] * 16), (100_080, [0.0] * 16), (None, [1.0] * 16), (100_100, [1.0] * 3)]
    rows += [(50_000 + i, rows[0][1]) for i in range(30)] + [rows[20]]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows + bad], "vec_id long, embedding array<double>, id int, cell int")
    got = multi_index_search(df, F.col("vec_id") % 20 == 0, k=20, centroids=16, share=0.5, least=500).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    asked = {i for i, _ in rows if i % 20 == 0}
    assert set(by) == asked
    vecs, hits = {i: np.array(v) for i, v in rows}, 0
    for q, found in by.items():
        assert [r for r, *_ in found] == list(range(1, 21))
        assert all(abs(s - vecs[q] @ vecs[i]) < 1e-9 and i != q for _, i, s in found)
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        hits += len({i for _, i, _ in found} & {i for _, i in best(rows, q, 20)})
    assert hits / (20 * len(by)) >= 0.9
    assert multi_index_search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_few_rows_are_exact(spark):
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(30)]
    got = multi_index_search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    rows = [(i, np.array(v, np.float32).astype(float).tolist()) for i, v in rows]
    assert [r.vec_id for r in got] == [i for q in (0, 20) for _, i in best(rows, q, 20)]


def test_walk_order():
    rng = np.random.default_rng(7)
    a, b = rng.random(9), rng.random(7)
    held = rng.integers(0, 3, 63)
    cells = walk(a, b, held, int(held.sum()))
    sums = [a[c // 7] + b[c % 7] for c in cells]
    assert sums == sorted(sums) and set(cells) == set(np.flatnonzero(held).tolist())


def test_shards_hold_all_cells():
    rng = np.random.default_rng(8)
    for size in (5, 40, 1000):
        held = rng.integers(0, 60, 50)
        first, many = shards_of(held, size)
        load = {}
        for c, n in enumerate(held.tolist()):
            for j in range(many[c]):
                load[first[c] + j] = load.get(first[c] + j, 0) + n / many[c]
        assert max(load.values()) <= size and (np.diff(first) >= 0).all() and ((many > 1) == (held > size)).all()


def test_only_walked_cells_are_multiplied():
    rng = np.random.default_rng(9)
    x, q = rng.normal(size=(600, 8)), rng.normal(size=(40, 8))
    ids, cells = np.arange(600), rng.integers(0, 30, 600)
    walks = [np.sort(rng.choice(30, rng.integers(0, 12), replace=False)).astype(np.int32) for _ in q]
    q_ids = np.arange(40) * 20
    (asked, found, scores), products = search_shard(q, q_ids, walks, x, ids, cells, 5)
    assert products == sum(int(np.isin(cells, w).sum()) for w in walks) < 0.4 * 600 * 40
    for i in range(40):
        mine = [j for j in np.flatnonzero(np.isin(cells, walks[i])) if j != q_ids[i]]
        want = sorted(((-float((x[j] * q[i]).sum()), j) for j in mine))[:5]
        assert found[asked == q_ids[i]].tolist() == [j for _, j in want] and np.allclose(scores[asked == q_ids[i]], [-s for s, _ in want])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_at_shipped_settings(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, np.float64) for r in df.collect()}
    ids, x = np.array(sorted(rows)), np.stack([rows[i] for i in sorted(rows)])
    assert max(LEAST, SHARE * len(ids)) < 0.7 * len(ids)  # a walk skips cells
    got = {}
    for r in multi_index_search(df, F.col("vec_id") % 20 == 0, k=20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q, found in got.items():
        scores = np.where(ids == q, -np.inf, x @ rows[q])
        hits += len(found & set(ids[np.argsort(-scores)[:20]].tolist()))
    assert len(got) == sum(i % 20 == 0 for i in ids) and hits / (20 * len(got)) >= 0.9

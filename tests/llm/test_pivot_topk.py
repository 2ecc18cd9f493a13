import math
import random

from pyspark.sql import functions as F

from pentad.llm.pivot_topk import pivot_topk


def plain(rows, k, scale=1024):
    ok = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if i % 10 == 0}):
        vec = min(v for i, v in ok if i == q)
        best = sorted((-sum(a * b for a, b in zip(vec, v, strict=True)), i) for i, v in ok if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


def test_against_all_pairs(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)] + [rows[10], (20, [0.5] * 8), (30, None), (40, []), (50, [None] * 8), (60, [float("nan")] * 8), (70, [float("inf")] * 8), (None, [0.1] * 8), (80, [0.1] * 3)]
    rows += [(2000, [0.0] * 8), (2001, [60000.0] * 8), (2002, [1e6, -1e6, 0.25, 0.0, 1e-3, 5.0, 7.0, -2.0]), (2010, [-1e6] * 8), (2020, [1e6] * 8), (2003, [1e6 + 0.5] * 8), (2004, [1e6 + 0.5] * 7 + [1e6 + 0.499])]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, id int, score double")
    got = [tuple(r) for r in pivot_topk(df, F.col("vec_id") % 10 == 0, k=10, sample=64, pivots=8).orderBy("query_id", "rank").collect()]
    assert got == plain(rows, 10) and max(abs(r[3]) for r in got) > 2**62
    assert pivot_topk(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in pivot_topk(few, F.col("vec_id") % 10 == 0).collect()] == [(0, 1, 1, 1024 * 1024)]


def test_scores_beyond_64_bits(spark):
    rows = [(0, [1e18, 1.0]), (1, [1e18, 0.0]), (2, [2e18, -1.0]), (3, [-1e18, 3.0]), (4, [-3e18, 0.0]), (5, [0.0, 2.0]), (6, [1e306, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in pivot_topk(df, F.col("vec_id") % 10 == 0, k=10).orderBy("query_id", "rank").collect()]
    most = 2**63 - 1
    assert got == [(0, 1, 2, most), (0, 2, 1, most), (0, 3, 5, 2 * 1024 * 1024), (0, 4, 3, -most - 1), (0, 5, 4, -most - 1)]

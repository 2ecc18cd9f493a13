import random

from pyspark.sql import functions as F

from pentad.config import DIMS, IndexConfig, SearchConfig
from pentad.functions import keys
from pentad.operators import buckets, knn
from tests.data import queries, refs, vector


def plain_bucket(v, n):
    return 0 if v <= 0 else min(n - 1, v * n // 10001)


def test_keys(spark):
    rng = random.Random(4)
    rows = [[rng.choice((-10000, -1, 0, 1, 1000, 1001, 5000, 5001, 9999, 10000, rng.randrange(-10000, 10001))) for _ in range(DIMS)] for _ in range(200)]
    got = refs(spark, [(v, 0) for v in rows]).select("ref_id", keys.profile_key().alias("p"), keys.partition_key().alias("s"), keys.projection_key().alias("j")).orderBy("ref_id").collect()
    for v, r in zip(rows, got, strict=True):
        part = (v[5] < 0) << 7 | (v[9] > 0) << 6 | (v[10] > 0) << 5 | (v[11] > 0) << 4 | plain_bucket(v[2], 4) << 2 | plain_bucket(v[7], 4)
        assert r.s == part and 0 <= r.p < 1 << 22
        assert r.p & 15 == plain_bucket(v[2], 16) and r.p >> 20 == plain_bucket(v[13], 4) and r.p >> 19 & 1 == (v[1] > 1000)
        assert r.j >> 27 == (v[5] < 0) << 4 | (v[9] > 0) << 3 | (v[10] > 0) << 2 | (v[11] > 0) << 1 | (v[12] > 5000)
        tops = [(v[d] + 10000) * 15 // 20000 >> 3 for d in (2, 8, 12, 5, 7, 0, 13)]
        assert [r.j >> 26 - i & 1 for i in range(7)] == tops


def test_edges_are_quantiles(spark):
    rng = random.Random(5)
    rows = [[rng.randrange(-10000, 10001) for _ in range(DIMS)] for _ in range(333)]
    for e in buckets.quantile_edges(refs(spark, [(v, 0) for v in rows])).collect():
        bins = 1 << keys.PURITY[e.purity_table - 1][e.place][1]
        assert e.edge == (32767 if e.bin == bins - 1 else sorted(v[e.feature] for v in rows)[min((e.bin + 1) * 333 // bins, 332)])


def test_purity_and_shortcuts(spark):
    rows = [(vector(f2=9000, f5=-10000), 1)] * 4 + [(0, 0)] * 4 + [(vector(f2=3000), 0), (vector(f2=3000), 1)]
    table = refs(spark, rows)
    profile = {r["mask"]: r["cnt"] for r in buckets.profile_table(table).collect()}
    assert profile == {1: 4, 2: 4, 3: 2}
    asked = queries(spark, [vector(f2=9000, f5=-10000), vector(), vector(f2=3000), vector(f0=9999)])
    got = {r.query_id: r.shortcut for r in buckets.shortcut_votes(asked, table, SearchConfig(profile_shortcut=True, profile_min=(3, 4))).collect()}
    assert got == {0: 5, 1: 0, 2: None, 3: None}
    purity = SearchConfig(purity_shortcut=True, purity_answers=(True, True, True, True))
    got = {r.query_id: r.shortcut for r in buckets.shortcut_votes(asked, table, purity, IndexConfig(min_support=(2, 2, 2, 2))).collect()}
    assert got[0] == 5 and set(got) == {0, 1, 2, 3}
    both = {r.query_id: (r.fraud_count, r.shortcut) for r in knn.with_shortcuts(asked, table, SearchConfig(profile_shortcut=True, profile_min=(3, 4))).collect()}
    assert both[0] == (5, True) and both[1] == (0, True) and not both[2][1]
    off = buckets.shortcut_votes(asked, table, SearchConfig())
    assert off.where(F.col("shortcut").isNotNull()).count() == 0

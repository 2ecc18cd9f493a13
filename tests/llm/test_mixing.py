import random
import re
from collections import Counter, defaultdict

import pytest

from pentad.llm.mixing import mix, mixed
from tests.llm.brute import no_docs, odd_docs


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, out, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > most * sizes[s]}
        if not over:
            out |= {s: left * w[s] / total for s in open_}
            break
        out |= {s: most * sizes[s] for s in over}
        left -= sum(most * sizes[s] for s in over)
        open_ -= over
    return out


def test_mix(spark):
    rng = random.Random(3)
    docs = odd_docs(spark, ["w " * rng.choice((0, 1, 5, 30, 200, 2000)) + "end\x0bx" for _ in range(700)])
    got, again = mix(docs).toPandas(), mix(docs.repartition(7)).toPandas()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, rows = defaultdict(int), docs.collect()
    for r in rows:
        sizes[r.source] += size(r.text)
    want = plain_targets(sizes)
    assert sorted(got["size"]) == sorted(size(r.text) for r in rows)
    assert sorted(map(repr, got.values.tolist())) == sorted(map(repr, again.values.tolist()))
    source = {r.doc_id: r.source for r in rows}
    taken = defaultdict(int)
    for r in got.astype(object).where(got.notna(), None).itertuples():
        s = source[None if r.doc_id is None else int(r.doc_id)]
        assert r.target == pytest.approx(want[s]) and r.source_size == sizes[s] and r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[s] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.01 * t + 40, (s, taken[s], t)
    assert mix(no_docs(spark)).count() == 0


def test_mixed_rows_stand_as_often_as_taken(spark):
    rng = random.Random(5)
    docs = odd_docs(spark, ["w " * rng.choice((0, 1, 5, 30, 200)) + f"end{i}" for i in range(300)])
    clash = docs.selectExpr("*", "1 AS copies", "2 AS copy_", "3 AS _id", "4 AS k", "5 AS t", "6 AS alike", "7 AS row")
    got = mixed(clash)
    assert got.columns == clash.columns
    want = Counter()
    for r in mix(docs).collect():
        want[r.doc_id, r.size] += r.copies
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, size(r.text)) for r in got.collect()) == +want
    assert mixed(no_docs(spark)).count() == 0


def test_two_texts_under_one_id(spark):
    rows = [(7, f"text number {i} of some words", f"s{i % 3}") for i in range(90)] + [(None, "without an id", None), (None, "another without an id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = sum(r.taken for r in mix(docs).collect())
    got = mixed(docs).collect()
    assert sum(len(r.text.split()) for r in got) == taken and len({r.text for r in got}) > 60
    assert all(n <= 2 for n in Counter(r.text for r in got).values())


def test_rounding_is_right_on_average(spark):
    rows = [(i, "w " * (3 + 4 * (i % 5)), f"s{i % 4}") for i in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    by_size = defaultdict(list)
    for r in mix(docs).collect():
        by_size[r.size].append((r.copies, r.target / r.source_size))
    for n, pairs in by_size.items():
        copies, rates = (sum(x) / len(pairs) for x in zip(*pairs, strict=True))
        assert abs(copies - rates) < 0.02, (n, copies, rates)


def test_sources_come_near_their_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    taken, target, words = defaultdict(int), {}, defaultdict(int)
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    for r in mix(docs).collect():
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        words[source[r.doc_id]] = r.source_size
    assert all(abs(taken[s] - t) <= 0.01 * t for s, t in target.items()) and len(target) == 20

"""What the pipeline's dedup stages write, beside what they find."""

import random
import time

from pyspark.sql import functions as F

from pentad.llm import near_copies
from pentad.llm.graph import parted
from pentad.llm.line_dedup import deduplicate
from pentad.llm.simhash import keep_one
from pentad.storage import cut
from tests.llm.test_pipeline import near_copies_gone


def test_a_family_of_texts_below_the_limit_makes_no_row_for_each_pair(spark, monkeypatch):
    rng, family = random.Random(5), 80
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    texts = []
    for k in range(family):  # most pairs have a similarity of about 0.74
        copy = list(base)
        for at in rng.sample(range(5, 395), 6):
            copy[at] = f"x{k}y{at}"
        texts.append(copy)
    texts.append([*texts[70][:-1], "end"])  # the one near copy
    written = []

    def counted(df):
        out = cut(df)
        if out.columns == ["a", "b"]:
            written.append(out.count())
        return out

    monkeypatch.setattr(near_copies, "cut", counted)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want = near_copies_gone(rows)
    assert len(want) > 0.9 * family and family not in want
    assert {r.doc_id for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want
    assert max(written) <= 10 * family < family * (family - 1) / 2


def test_short_texts_that_share_a_passage_make_no_family(spark, monkeypatch):
    rng, tied = random.Random(6), []
    shared = [f"s{i}" for i in range(44)]
    texts = [[f"a{i}", f"b{i}", f"c{i}", *shared, f"x{i}", f"y{i}", f"z{i}"] for i in range(90)]  # all pairs: about 0.77
    texts += [[*t[:-1], "end"] for t in texts[40:43]] + [[*texts[7], *(f"v{rng.randrange(10**6)}" for _ in range(40))]]
    monkeypatch.setattr(near_copies, "COMMON", 0)  # as where a sample does not show what is common
    links_within = near_copies.links_within

    def counted(families, *rest):
        tied.append(families.count())
        return links_within(families, *rest)

    monkeypatch.setattr(near_copies, "links_within", counted)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want = near_copies_gone(rows)
    assert {7, 40, 41, 42, 93} <= want and len(want) == 91
    assert {r.doc_id for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want
    assert sum(tied) <= 10


def test_shared_counts_what_sets_have_in_common(monkeypatch):
    monkeypatch.setattr(near_copies, "COLUMNS", 7)
    rng = random.Random(7)
    sets = [near_copies.np.array(sorted(rng.sample(range(60), rng.randrange(1, 30))), "int64") for _ in range(25)]
    got = near_copies.shared(sets[:10], sets[10:])
    assert [[len(set(a) & set(b)) for b in sets[10:]] for a in sets[:10]] == got.tolist()


def test_parted_keeps_every_wanted_row_and_few_others(spark):
    df = spark.range(20_000).withColumn("k", F.when(F.col("id") % 100 != 3, F.col("id") * 7919))
    some, others = parted(df, "k", spark.range(0, 700_000, 7919).toDF("k"))
    first, rest = {r.id for r in some.collect()}, {r.id for r in others.collect()}
    assert first | rest == set(range(20_000)) and not first & rest and some.columns == df.columns == others.columns
    assert {i for i in range(89) if i != 3} <= first and len(first) < 120 and all(i in rest for i in range(3, 20_000, 100))


def test_texts_that_lose_nothing_are_not_shuffled(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, f"{passage}.\nown words of text {i}" if i < 2 else " ".join(f"t{i}w{j}" for j in range(40))) for i in range(60)]
    out = deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    text = {r.doc_id: r.text for r in out.collect()}
    assert text == {i: t for i, t in rows} | {1: "own words of text 1"}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan and "BroadcastHashJoin [word" in plan


def test_shuffle_files_go_when_a_table_is_written(spark):
    files = lambda: {f for f in map(str, iterate(spark)) if "shuffle_" in f}
    before = files()
    table = cut(spark.range(5000).groupBy((F.col("id") % 1000).alias("k")).count())
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before
    assert table.count() == 1000


def iterate(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return [found.apply(i).getName() for i in range(found.size())]

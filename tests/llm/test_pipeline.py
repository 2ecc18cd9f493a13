import re
from collections import Counter

from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from pentad.llm.line_dedup import without
from pentad.llm.mixing import mix
from pentad.llm.toxicity import toxicity
from tests.llm.brute import no_docs, odd_docs
from tests.llm.test_line_dedup import plain_places

SF = "/root/testdata/sf0.001"


def near_copies_gone(rows):
    """Ids that stay when one row (the least id) of each component of texts stays whose five-word shingles have a
    similarity of 0.8 or more; by all pairs."""

    def grams(text):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, parent = {i: grams(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {find(i) for i in sets}


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns, (toxic, lines, near, mixing, packing) = docs.columns, [f for _, f in corpus_pipeline.STAGES]
    labels = spark.read.parquet(f"{SF}/labels.parquet")

    first = toxic(spark, docs, SF).cache()
    assert first.columns == columns and {r.doc_id for r in first.collect()} == {r.doc_id for r in toxicity(docs, labels).where("predicted = 0").collect()}

    second = lines(spark, first, SF).cache()
    texts = {r.doc_id: r.text for r in first.collect()}
    gone = plain_places(list(texts.items()))
    want = {i: without(t.encode(), gone[i]).decode() if gone[i] else t for i, t in texts.items()}
    got = {r.doc_id: r.text for r in second.collect()}
    assert second.columns == columns and got == {i: t for i, t in want.items() if t or not gone[i]}
    assert all(r.n_chars == len(r.text) for r in second.collect()) and sum(map(len, gone.values())) > 0

    third = near(spark, second, SF).cache()
    assert third.columns == columns and sorted(r.doc_id for r in third.collect()) == sorted(near_copies_gone(list(got.items())))

    fourth = mixing(spark, third, SF).cache()
    taken = Counter({r.doc_id: r.copies for r in mix(third).collect()})
    assert fourth.columns == columns and Counter(r.doc_id for r in fourth.collect()) == +taken

    pieces = packing(spark, fourth, SF).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = {r.doc_id: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in fourth.collect()}
    held = Counter()
    for p in pieces:
        held[p.doc_id] += p.length
        assert p.doc_tokens == sizes[p.doc_id]
    assert held == Counter({i: n * sizes[i] for i, n in (+taken).items()})


def test_odd_and_empty_tables(spark, tmp_path):
    docs = odd_docs(spark, ["plain text of some words here", "nasty words in this one"] * 5 + [f"text {i} has these words alone" for i in range(20)])
    labels = spark.createDataFrame([(i, None, int(i == 1)) for i in range(10)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    for name, table in (("odd", docs), ("empty", no_docs(spark))):
        at = str(tmp_path / name)
        table.write.parquet(f"{at}/documents.parquet")
        labels.write.parquet(f"{at}/labels.parquet")
        now = spark.read.parquet(f"{at}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, at)
            assert now.columns == table.columns
        pieces = corpus_pipeline.run(spark, at).collect()
        assert bool(pieces) == (name == "odd") and {p.doc_id for p in pieces} <= {r.doc_id for r in docs.collect()}

import random
import re

import numpy as np
import xxhash

from pentad.llm import near_copies
from pentad.llm.simhash import keep_one, links, masks, simhash_groups, spanning_links
from tests.llm.brute import no_docs, odd_docs


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(g.encode(), 42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, close):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if close(a, b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_groups_against_all_pairs(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice("alpha Beta gamma DELTA é epsilon zeta".split()) + str(rng.randrange(40)) for _ in range(rng.choice((1, 2, 3, 40, 300)))) for _ in range(60)]
    near = [t.replace(t.split()[0], "x", 1) for t in base for _ in range(2)]
    docs = odd_docs(spark, base + near + base[:20])
    got = simhash_groups(docs).collect()
    fps = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    distinct = sorted({f for _, f in fps})
    root = roots(distinct, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for i, f in fps:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    want = sorted(((i, f"{f:016x}", least.get(root[f])) for i, f in fps), key=repr)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=repr) == want
    assert simhash_groups(no_docs(spark)).count() == 0


def test_large_group_in_chunks(spark):
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for _ in range(1500)} | {rng.getrandbits(64) for _ in range(300)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    found = links(spark.createDataFrame(signed, "fp long")).collect()
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 3 for r in found)
    nodes = sorted(x for x, in signed)
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in found:
        parent[find(r.a)] = find(r.b)
    near = [n for n in nodes if ((n ^ centre) & (2**64 - 1)).bit_count() <= 3]
    assert len({find(n) for n in near}) == 1 and len({find(n) for n in nodes}) == 1 + len(nodes) - len(near)
    assert len(found) < 200 * len(nodes)


def test_masks_and_spanning():
    assert len(masks()) == 20 and len({m & (2**64 - 1) for m in masks()}) == 20
    a = np.array([0, 1, 3, 2**40 - 1], np.uint64)
    assert len(spanning_links(a, a[:0])) == 2 == len(spanning_links(a[:2], a[2:]))
    rng = np.random.default_rng(2)
    for _ in range(30):
        nodes = np.unique(rng.integers(0, 1 << 14, 60).astype(np.uint64))
        found, at = spanning_links(nodes[::2], nodes[1::2]), nodes.tolist()
        assert all((x ^ y).bit_count() <= 3 for x, y in found)
        own, want = {n: n for n in at}, roots(at, lambda x, y: (x ^ y).bit_count() <= 3)
        for x, y in found * len(found):
            own[x] = own[y] = min(own[x], own[y])
        assert own == want and len(found) == len(at) - len(set(want.values()))


def test_keep_one_keeps_clean_rows(spark):
    docs = spark.createDataFrame([(1, "one two three four five"), (2, "one two three four five"), (3, "other words stand in this text"), (None, "x")], "doc_id long, text string")
    assert sorted(r.doc_id or 0 for r in keep_one(docs).collect()) == [0, 1, 3]


def test_keep_one_links_five_words_at_similarity_08(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"

    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice((3, 5, 30, 120, 400)))]
        texts.append(" ".join(base))
        for _ in range(5):
            copy = list(base)
            for at in rng.sample(range(len(copy)), min(len(copy), rng.choice((0, 1, 1, 2, 5, 9)))):
                copy[at] = word()
            texts.append(" ".join(copy))
    sets = [grams(t) for t in texts]
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    want = sorted(set(roots(range(len(texts)), near).values()))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in keep_one(docs).collect()) == want
    fps = [plain_fingerprint(t) for t in texts]
    assert any((fps[a] ^ fps[b]).bit_count() > 3 and near(a, b) for a in range(len(texts)) for b in range(a))


def test_keep_one_tells_rows_apart_by_id_and_text(spark):
    a, b, c = ("alpha beta gamma delta epsilon", "other words stand in this text", "a third text of six words")
    rows = [(1, a), (5, a), (5, b), (7, c), (7, b), (None, c), (None, "alone and without an id here"), (None, "alone and without an id here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(1, a), (5, b), (7, c), (None, "alone and without an id here")]
    assert sorted(map(repr, map(tuple, keep_one(docs).collect()))) == sorted(map(repr, want))


def test_keep_one_carries_columns_of_any_name(spark):
    docs = odd_docs(spark, ["a text of some words here", "another text of other words"]).selectExpr("*", "1 AS _id", "2 AS _t", "3 AS no_id", "4 AS id", "5 AS t", "6 AS row", "7 AS least")
    got = keep_one(docs)
    assert got.columns == docs.columns and len(got.collect()) == 5
    assert keep_one(no_docs(spark)).count() == 0


def test_simhash_decides_long_pairs_and_leaves_close_ones_to_sets(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    texts = [" ".join(base)]
    for edits in (1, 2, 8, 9, 10, 60):
        copy = list(base)
        for at in rng.sample(range(400), edits):
            copy[at] = f"x{edits}y{at}"
        texts.append(" ".join(copy))
    held = [near_copies.shingles(t.encode(), 5) for t in texts]
    docs = spark.createDataFrame([(near_copies.number(h), t.encode()) for h, t in zip(held, texts, strict=True)], "node long, body binary")
    ids = [near_copies.number(h) for h in held]
    pairs = spark.createDataFrame([(ids[0], i) for i in ids[1:]], "a long, b long")
    sketches = near_copies.sketches_of(docs, docs.select("node"), 5)
    assert {len(r.sketch) for r in sketches.collect()} == {128}
    got = {r.b for r in near_copies.decided(pairs, sketches, docs, 0.8, 5).collect()}
    assert got == {i for i, h in zip(ids[1:], held[1:], strict=True) if near_copies.alike(held[0], h, 0.8)}
    nodes = spark.createDataFrame([(1, 0), (2, 0), (3, 7), (4, -1)], "node long, fp long")
    assert {(r.a, r.b) for r in near_copies.simhash_pairs(nodes).collect()} == {(1, 2), (1, 3)}

import random

from pentad.llm.line_dedup import MIN_BLOCK, aligned, deduplicate, loss, patience, units, without
from tests.llm.brute import no_docs, odd_docs


def test_patience():
    assert patience([1, 2, 3], [1, 2, 3]) == [0, 1, 2]
    assert patience([1, 2, 3, 4], [9, 2, 3, 8, 1]) == [1, 2]
    assert patience([5, 1, 5, 2, 5], [5, 2, 5]) == [0, 1, 2]
    assert patience([], [1]) == [] and patience([1, 2], [3]) == []
    rng = random.Random(10)
    for _ in range(300):
        a, b = ([rng.randrange(8) for _ in range(rng.randrange(12))] for _ in range(2))
        found, i = patience(a, b), 0
        for j in found:  # a common subsequence
            i = a.index(b[j], i) + 1
        assert found == sorted(set(found))


def test_units_rebuild():
    body = b"One two three four. Five six seven eight\n\nnine. ten\r\na b c d"
    parts, at, hashes, sizes = units(body)
    assert b"".join(parts) == body and sizes == [4, 4, 4] and len(set(hashes)) == 3
    rng = random.Random(15)
    for _ in range(200):
        words = [rng.choice(("a!", "Bcd", "e.", "f\ng", "hij", "\tk", "l\r\n", "mno?")).encode() for _ in range(rng.randrange(80))]
        text = b" ".join(words)
        parts, at, _, sizes = units(text)
        assert b"".join(parts) == text and len(at) == len(sizes) and all(n >= 4 for n in sizes)
        held = [len(parts[i].split()) for i in at]
        assert held == sizes and sum(n for i, n in enumerate(map(len, map(bytes.split, parts))) if i not in at) < 4 * (len(parts) + 1)
    assert without(body, [1]) == b"One two three four. \nnine. ten\r\na b c d"
    assert without(body, [0, 1, 2]) == b""


def test_blocks_leave_later_documents(spark):
    rng = random.Random(11)
    line = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(12)) + "."
    passage = [line() for _ in range(5)]
    common = line()
    docs = []
    for i in range(60):
        own = [line() for _ in range(6)]
        if i % 3 == 0:
            own[2:2] = passage if i % 2 else [" ".join(passage)]  # as lines, or inside one line
        docs.append("\n".join([*own, common]))
    clean = "\n".join(line() for _ in range(9))
    table = odd_docs(spark, [*docs, docs[5], docs[5].upper(), clean])
    rows = {r.doc_id: r for r in loss(table).collect()}
    assert loss(table).count() == table.count()
    for i in range(60):
        hit = i % 3 == 0 and i > 0
        assert (rows[i].n_removed > 0) == hit, i
        assert not hit or rows[i].removed_words >= 55
    assert rows[60].removed_words == rows[61].removed_words == 7 * 12 and rows[62].n_removed == 0
    out = {r.doc_id: r.text for r in deduplicate(table).collect()}
    assert 60 not in out and 61 not in out and out[62] == clean and out[0] == docs[0] and out[1000] is None and out[1001] == ""
    assert all(x not in out[3] for x in passage) and common in out[3]
    assert deduplicate(no_docs(spark)).count() == loss(no_docs(spark)).count() == 0


def test_gaps_without_unique_units():
    assert patience([9, 1, 2, 8, 1, 2, 7], [6, 1, 2, 5]) == [1, 2]
    rng = random.Random(12)
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(14))] * 2 for _ in range(2))
        found, i = patience([*a, 98], [99, *b]), 0
        for j in found:
            i = a.index([99, *b][j], i) + 1
        assert bool(found) == bool(set(a) & set(b))


def test_repeats_and_other_order_are_met():
    a = [1, 2, 3, 4, 5, 6]
    at = list(range(6))
    for b in ([1, 2, 3, 9, 1, 2, 3], [4, 5, 6, 9, 1, 2, 3], [1, 2, 3, 1, 2, 3, 4, 1, 2]):
        assert aligned(a, at, b, list(range(len(b))), [10] * len(b)) == [j for j, h in enumerate(b) if h != 9]
    assert aligned(a, at, [5, 3, 1], [0, 1, 2], [10] * 3) in ([0], [1], [2])  # shared units, but no shared run


def test_repeats_in_a_later_document_go(spark):
    rng = random.Random(13)
    line = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(12)) + "."
    passage, other = ([line() for _ in range(3)] for _ in range(2))
    texts = [[line(), *passage, line(), *other, line()], [line(), *other, line(), *passage, line(), *passage, line()]]
    docs = spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in deduplicate(docs).collect()}
    assert out[0] == "\n".join(texts[0]) and out[1] == "\n".join(x for x in texts[1] if x not in passage + other)


def test_passages_inside_sentences_and_of_short_lines(spark):
    rng = random.Random(16)
    word = lambda: f"w{rng.randrange(10**6)}"
    words = lambda n: [word() for _ in range(n)]
    prose, listed = words(60), [" ".join(words(rng.randrange(1, 4))) for _ in range(40)]
    docs = []
    for _ in range(12):  # the passage begins and ends inside a sentence of its own
        docs.append(" ".join([*words(rng.randrange(3, 30)), *prose, *words(rng.randrange(3, 30))]) + ".\n" + " ".join(words(12)))
    for _ in range(12):  # lines of one to three words, after other such lines
        docs.append("\n".join([" ".join(words(2)) for _ in range(rng.randrange(1, 6))] + listed + [" ".join(words(20))]))
    clean = [" ".join(words(80)) for _ in range(5)]
    rows = {r.doc_id: r for r in loss(spark.createDataFrame(list(enumerate([*docs, *clean])), "doc_id long, text string")).collect()}
    assert all(rows[i].removed_words >= 30 for i in (*range(1, 12), *range(13, 24)))
    assert all(rows[i].removed_words == 0 for i in (0, 12, *range(24, 29)))


def plain_places(docs):
    """Places of the units that go, by id: the operator's rule in plain loops, all in memory."""
    cut = {i: units(t.encode()) for i, t in docs}
    first, where = {}, {}
    for i in sorted(cut):
        for place, h in enumerate(cut[i][2]):
            first.setdefault(h, i)
            if first[h] == i:
                where.setdefault(h, []).append(place)
    out = {}
    for i in sorted(cut):
        _, _, hashes, sizes = cut[i]
        met = set()
        for f in {first[h] for h in hashes if first[h] != i}:
            own = [p for p, h in enumerate(hashes) if first[h] == f]
            there = sorted((p, h) for h in {hashes[p] for p in own} for p in where[h])
            met |= {own[j] for j in aligned([h for _, h in there], [p for p, _ in there], [hashes[p] for p in own], own, [sizes[p] for p in own])}
        out[i], run = [], []
        for p in range(len(hashes) + 1):
            if p in met:
                run.append(p)
            else:
                out[i] += run if sum(sizes[q] for q in run) >= MIN_BLOCK else []
                run = []
    return out


def test_against_plain_version(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rng = random.Random(17)
    blocks = [" ".join(f"v{rng.randrange(30)}" for _ in range(12)) + "." for _ in range(12)]
    docs += [(10_000 + i, "\n".join(rng.choices(blocks, k=rng.randrange(1, 14)))) for i in range(60)]
    got = {r.doc_id: r.removed_words for r in loss(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    text, gone = dict(docs), plain_places(docs)
    want = {i: sum(units(text[i].encode())[3][p] for p in places) for i, places in gone.items()}
    assert got == want and sum(want.values()) > 2000


def test_clashing_names(spark):
    text = "one two three four five six seven eight nine ten eleven twelve. " * 2 + "other words of this text here at last."
    docs = spark.createDataFrame([(i, f"own{i} a b c.\n{text}", i, i, i, i, i) for i in range(3)], "doc_id long, text string, _id long, _places long, places long, t long, d long")
    out = deduplicate(docs)
    assert out.columns == docs.columns and sorted(r.places for r in out.collect()) == [0, 1, 2]
    assert loss(docs).count() == 3

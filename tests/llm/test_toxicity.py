import math
import random
import re
import zlib

import xxhash
import zstandard

from pentad.llm import toxicity as T
from pentad.llm.toxicity import toxicity, without_toxic
from tests.llm.brute import no_docs, odd_docs

LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    rng = random.Random(8)
    syllables = "an the re ti on er st le mi no ka lu".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    texts, toxic = [], []
    for i in range(1200):
        ws = [word() for _ in range(rng.randrange(20, 200))]
        if i % 5 == 0:
            for _ in range(rng.randrange(3, 7)):
                ws.insert(rng.randrange(len(ws)), rng.choice(("vughed", "quobbling", "zyxwit" + word())))
        texts.append(" ".join(ws))
        toxic.append(int(i % 5 == 0))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic)], LABELS)
    rows = toxicity(docs, labels).collect()
    assert len(rows) == 1200 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    hits = sum(r.predicted for r in held if toxic[r.doc_id])
    assert hits / sum(toxic[r.doc_id] for r in held) > 0.85 and hits / max(1, sum(r.predicted for r in held)) > 0.85
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)


def test_odd_rows(spark):
    docs = odd_docs(spark, ["plain text of some words here", "nasty words in this one"] * 5)
    labels = spark.createDataFrame([(i, None, i % 2) for i in range(10)] + [(None, 1, 1), (3, 1, None), (77, 1, 1), (0, 1, 0)], LABELS)
    assert toxicity(docs, labels).count() == docs.count()
    assert {r.score for r in toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity(no_docs(spark), labels).count() == 0


def test_stage_drops_what_the_operator_marks(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity(docs, labels).collect()
    assert any(0.3 <= r.score < 0.5 for r in rows)
    assert sorted(str(r.doc_id) for r in without_toxic(docs, labels).collect()) == sorted(str(r.doc_id) for r in rows if not r.predicted)


def test_gains_are_differences_of_compressed_lengths():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))).encode() for _ in range(300)]
    plain = [b" ".join(rng.choices(vocabulary, k=40)) for _ in range(300)]
    ordinary = T.dictionary([w for t in plain for w in T.windows(t.split(), 8)], 8192)
    toxic = T.dictionary([w for w in T.windows([b"qoxzut"] * 400 + [b"vynjik"] * 400, 2)], 512)
    gains = T.Gains(ordinary, toxic)
    text = "Qoxzut here, %s VYNJIK!" % " ".join(x.decode() for x in rng.choices(vocabulary, k=30))
    held = [w.encode() for w in re.findall("[a-z]+", text.lower())]
    lot = [held[i : i + T.WINDOW] for i in range(0, len(held), T.WINDOW)]
    spelt = [b"".join(xxhash.xxh64_digest(bytes([b]))[:3] for b in b" " + b" ".join(ws) + b" ") for ws in lot]
    assert T.windows(T.words(text.encode()), T.WINDOW) == spelt
    got = gains.of(spelt)
    assert got[0] >= 4 and got[-1] >= 4 and all(abs(g) < 4 for g in got[1:-1])
    runs = T.novel(ordinary, toxic)
    assert all(r in toxic and r not in ordinary for r in runs) and T.Gains(ordinary, toxic, runs).of(spelt) == got
    # the lengths are those of frames that decompress to the windows with the same dictionaries
    for w, g in zip(spelt, got, strict=True):
        sizes = []
        for d, f in ((ordinary, gains.ordinary), (toxic + ordinary, gains.both)):
            known = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            back = zstandard.ZstdDecompressor(dict_data=known, format=zstandard.FORMAT_ZSTD1_MAGICLESS).decompress(f(w), max_output_size=len(w))
            assert back == w
            sizes.append(len(f(w)))
        assert sizes[0] - sizes[1] == g
    x = gains.features(text.encode())
    assert all(math.isclose(v, math.log1p(sum(g >= t for g in got))) for v, t in zip(x, T.THRESHOLDS, strict=False))
    assert x[9] == max(got) and math.isclose(x[11], sum(got) / len(got))


def test_pieces_of_copies_are_alike():
    rng = random.Random(4)
    ws = [f"w{rng.randrange(500)}".replace("w", "abcdefghij"[rng.randrange(10)]) for _ in range(400)]
    text = re.sub("[0-9]", lambda m: "qrstuvwxyz"[int(m[0])], " ".join(ws))
    own, moved = list(T.pieces(text.encode())), set(T.pieces(b"some other words before it " + text.encode()))
    assert b" ".join(own) == text.encode() and all(len(p.split()) > 2 for p in own[:-1])
    assert len(set(own) - moved) <= 3


def test_stage_takes_odd_rows(spark):
    docs = odd_docs(spark, ["plain text of some words here", "nasty words in this one"] * 5)
    labels = spark.createDataFrame([(i, None, i % 2) for i in range(10)], LABELS)
    kept = without_toxic(docs, labels)
    marked = toxicity(docs, labels)
    assert kept.columns == docs.columns and kept.count() == marked.where("predicted = 0").count()
    assert without_toxic(no_docs(spark), labels).count() == 0
    assert without_toxic(docs, labels.limit(0)).count() == docs.count()

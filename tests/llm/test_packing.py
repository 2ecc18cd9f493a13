import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pentad.llm.packing import B, K1, Index, encoder, pack, pack_shard, parts_at_blanks
from tests.llm.brute import no_docs, odd_docs

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_round_trip(spark):
    rng = random.Random(12)
    words = ["Alpha", "beta's", "42", "naïve", "ét", "ß", "a b", "...", "漢字", "don't", "Word.", "e\u0301t", "I\u0307x", "İs", "x..,", "'s", "a'b!", "--", "٣x", "<|endoftext|>", "<|ENDOFTEXT|>", "a\u00a0b", "ﬁ?"] + [f"w{i}" for i in range(200)]
    docs = odd_docs(spark, [rng.choice((" ", "\n", "\t ")).join(rng.choice(words) for _ in range(rng.choice((0, 3, 40, 400, 6000)))) for _ in range(120)])
    pieces = pack(docs, PATH, shard=60_000).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = sorted(([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.collect()))
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4")
        assert len(ids) == p.length > 0 and zlib.crc32(p.ids) == p.ids_crc32
        sequences[p.sequence_id].append((p.offset, p.length))
        by_doc[p.doc_id].append((p.start, ids.tolist(), p.doc_tokens))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at & (at - 1) == 0 and at <= 4096
    full = {i: sorted(x, key=lambda p: p[0]) for i, x in by_doc.items() if i != 0}
    for i, parts in full.items():  # document 0 stands three times
        joined, at = [], 0
        for start, ids, total in parts:
            assert start == at
            joined += ids
            at += len(ids)
        assert at == total and joined in want, i
    assert sum(p.length for p in pieces) == sum(map(len, want))
    assert pack(no_docs(spark), PATH).count() == 0


def test_neighbours_share_a_window():
    rng = np.random.default_rng(13)
    docs = [rng.integers(1000 * (i % 4), 1000 * (i % 4) + 50, 100).astype("<u2") for i in range(64)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=65536)
    sequences = pack_shard(docs, np.log(1 + (64 - df + 0.5) / (df + 0.5)), 100.0, 400)
    same = [len({d % 4 for d, *_ in s}) for s in sequences]
    assert sum(sum(x[2] for x in s) for s in sequences) == 6400 and np.mean(same) < 1.3


@pytest.mark.parametrize("size", [1, 4095, 4096, 4097, 9000])
def test_single_document(size):
    got = pack_shard([np.ones(size, "<u2")], np.ones(65536), 1.0, 4096)
    assert sum(x[2] for s in got for x in s) == size and all((n := sum(x[2] for x in s)) & (n - 1) == 0 for s in got)


def plain_packing(docs, idf, mean, window):
    """Full windows as lists of (document, start, length), by plain loops; what is left in the last one, uncut."""
    tf = [Counter(d.tolist()) for d in docs]

    def score(seed, d):
        return sum(idf[t] * tf[d][t] * (K1 + 1) / (tf[d][t] + K1 * (1 - B + B * len(docs[d]) / mean)) for t in tf[seed] if t in tf[d])

    unused, windows, now = set(range(len(docs))), [], []

    def put(d, start):
        take = min(window - sum(x[2] for x in now), len(docs[d]) - start)
        now.append((d, start, take))
        if sum(x[2] for x in now) == window:
            windows.append(now[:])
            now.clear()
        return start + take if start + take < len(docs[d]) else None

    seed, rest = None, None
    while unused or rest is not None:
        if rest is None:
            seed, rest = min(unused), 0
            unused.discard(seed)
        rest = put(seed, rest)
        if rest is None and now:
            for d in sorted((d for d in unused if score(seed, d) > 0), key=lambda d: (-round(score(seed, d), 9), d)):
                unused.discard(d)
                rest = put(d, 0)
                if not now or rest is not None:
                    seed = d
                    break
    return windows, now


def test_against_plain_packing():
    rng = np.random.default_rng(14)
    docs = [np.where(rng.random(n := int(rng.integers(1, 300))) < 0.3, rng.integers(0, 12, n), rng.integers(0, 900, n)).astype("<u2") for _ in range(120)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=65536)
    idf, mean = np.log(1 + (120 - df + 0.5) / (df + 0.5)), float(np.mean([len(d) for d in docs]))
    index = Index(docs, idf, mean)
    assert len(index.matrix) > 3
    for seed in (0, 7, 119):
        want = [sum(idf[t] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(d) / mean)) for t, c in Counter(d.tolist()).items() if t in set(docs[seed].tolist())) for d in docs]
        assert np.allclose(index.scores(seed), want)
    windows, left = plain_packing(docs, idf, mean, 512)
    got = pack_shard(docs, idf, mean, 512)
    assert got[: len(windows)] == windows and sum(x[2] for s in got[len(windows) :] for x in s) == sum(x[2] for x in left)


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = ["Some  Text with Capitals\n and blanks ", "", "x"]
    assert not parts_at_blanks(tokenizer) and parts_at_blanks(Tokenizer.from_file(PATH))
    assert [x.tolist() for x in encoder(path)([t.encode() for t in texts])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]

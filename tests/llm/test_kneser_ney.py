import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from pentad.llm.kneser_ney import discounts, perplexity_scores
from tests.llm.brute import no_docs, odd_docs


def plain(rows):
    """Scores by dictionaries of tokens."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    pairs = Counter(p for i, t in rows if not held(i) for p in zip(["<s>", *words(t)], [*words(t), "</s>"], strict=True))
    total, follow, before, count = Counter(), defaultdict(Counter), Counter(), Counter()
    for (v, w), n in pairs.items():
        total[v] += n
        follow[v][min(n, 3)] += 1
        before[w] += 1
        count[w] += n
    of = lambda c: [sum(1 for n in c.values() if n == k) for k in (1, 2, 3, 4)]
    d2, d1 = (0, *discounts(*of(pairs))), (0, *discounts(*of(before)))
    size, types, n_all = len(before), len(pairs), sum(pairs.values())

    def single(w):
        mass = sum(d1[min(n, 3)] for n in before.values()) / types
        return max(before[w] - d1[min(before[w], 3)], 0) / types + mass / (size + 1)

    def p(w, v):
        if not total[v]:
            return single(w)
        left = sum(d2[k] * n for k, n in follow[v].items()) / total[v]
        return max(pairs[v, w] - d2[min(pairs[v, w], 3)], 0) / total[v] + left * single(w)

    unknown = "unknown word"
    for v in ("<s>", next(iter(before)), unknown):
        assert sum(p(w, v) for w in [*before, unknown]) == pytest.approx(1)
    out = []
    for i, t in rows:
        ws = words(t)
        steps = list(zip(["<s>", *ws], [*ws, "</s>"], strict=True))
        base = sum(math.log10((count[w] + 1) / (n_all + size + 1)) for _, w in steps)
        out.append((i, held(i), len(steps), sum(count[w] > 0 for _, w in steps), n_all, base, sum(math.log10(p(w, v)) for v, w in steps)))
    return out


def test_against_plain_model(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["the", "The", "a", "cat", "é", "É", f"r{rng.randrange(60)}"]) for _ in range(rng.randrange(50))) for _ in range(300)]
    docs = odd_docs(spark, texts)
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    got = sorted((tuple(r)[:7] for r in perplexity_scores(docs).collect()), key=key)
    want = sorted(plain([(r.doc_id, r.text) for r in docs.collect()]), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)
    assert perplexity_scores(no_docs(spark)).count() == 0

import re
import time

import pytest

from pentad.llm.license_scan import BASE, NOTICES, evaluate, license_scan, scanner, to_postfix
from tests.llm.brute import no_docs, odd_docs

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def plain(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in hits]
    return (len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits})))


def test_against_plain_scan(spark):
    texts = [
        "Released under the MIT License.", "under the mit license under the MIT license", "Apache License, Version 2.0 é CC-BY-NC", "É under the\nmit-license",
        "undr the mit license", "cc by ncx cc by nc", "SPDX-License-Identifier: MIT OR (GPL-2.0-only WITH Classpath-exception-2.0)\nrest AND more", "K K under the mit license",
    ]
    docs = odd_docs(spark, texts)
    got = license_scan(docs).collect()
    want = {r.doc_id: plain(r.text) for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want[r.doc_id]
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    labels = {r.doc_id: r.labels for r in got}
    assert labels[6] == "gpl-2.0-only,mit"
    assert license_scan(no_docs(spark)).count() == 0


@pytest.mark.parametrize(
    ("text", "postfix", "score"),
    [
        ("MIT", "mit", 1.0), ("MIT OR GPL-3.0", "mit gpl-3.0 or", 1.0), ("MIT AND GPL-3.0", "mit gpl-3.0 and", 0.4),
        ("MIT OR GPL-3.0 AND AGPL-3.0", "mit gpl-3.0 agpl-3.0 and or", 1.0), ("(MIT OR GPL-3.0) AND AGPL-3.0", "mit gpl-3.0 or agpl-3.0 and", 0.3),
        ("GPL-2.0 WITH Classpath", "gpl-2.0 classpath with", 0.6), ("", "", None), ("AND", "", None), ("MIT AND", "mit", 1.0), ("(MIT", "mit", 1.0), ("MIT) OR X", "mit", 1.0),
    ],
)
def test_expressions(text, postfix, score):
    assert " ".join(to_postfix(text)) == postfix
    assert evaluate(to_postfix(text))[0] == (score if score is None else pytest.approx(score))


@pytest.mark.parametrize("piece", ["SPDX-License-Identifier: MIT ", "spdx-license-identifier: (mit or ", "license-expression: a and license-expression:", "x " * 20 + "SPDX-License-Identifier: ((((", "SPDX-License-Identifier: a)\n"])
def test_many_tags_on_a_line_take_linear_time(piece):
    scan = scanner(BASE, NOTICES)
    scan(b"warm up")
    began = time.process_time()
    words, *_, labels, score = scan((piece * 40_000).encode())
    assert time.process_time() - began < 8 and words >= 40_000 and 0 <= score <= 1

"""License scans: an Aho-Corasick automaton finds identifier tags and notice phrases, a shunting-yard parser evaluates
the licence expressions that follow the tags.

Words are the matches of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` in the whole text after A-Z have become a-z; phrases
match as consecutive words. One row per input row, duplicates and all:

* null and empty texts have no words, no labels and score 0;
* rows with a null id keep it; ties do not arise; an empty table gives an empty result;
* only the id and text columns are read, so further columns of any name are allowed.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from pentad.llm.common import LOWER, map_batches, text_bytes, worker_cache

#: Fixed phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further notices: words, label.
NOTICES = {
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "apache license": "apache",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "isc license": "isc",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "creative commons zero": "cc0",
    "cc0 1 0": "cc0",
    "cc by 4 0": "cc-by",
    "cc by 3 0": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons attribution": "cc-by",
    "all rights reserved": "all-rights-reserved",
    "dedicated to the public domain": "public-domain",
}
#: Tags that precede a licence expression.
TAGS = ("spdx-license-identifier:", "license-expression:", "spdx-license-expression:")
#: How free a family of licences is, by the start of its lower-cased name; longest match first.
FREEDOM = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "zlib": 1.0, "cc0": 1.0, "unlicense": 1.0, "public-domain": 1.0, "cc-by": 0.9,
    "lgpl": 0.6, "mpl": 0.6, "epl": 0.6, "cc-by-sa": 0.6, "gpl": 0.4, "agpl": 0.3, "cc-by-nd": 0.2, "cc-by-nc": 0.1, "all-rights-reserved": 0.05,
}
UNKNOWN, EXCEPTION_GAIN = 0.5, 0.2
TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.+:-]*")
LINE_END = re.compile("[\n\r]")
#: Binding strength of the operators.
BINDS = {"or": 1, "and": 2, "with": 3}
#: Bytes that part words become spaces, A-Z become a-z.
WORDS = bytes(LOWER[b] if LOWER[b] >= 0x80 or chr(LOWER[b]).isalnum() else 32 for b in range(256))


def freedom(name: str) -> float:
    """How free the licence of this name is, 0 to 1."""
    best = max((p for p in FREEDOM if name.startswith(p)), key=len, default=None)
    return UNKNOWN if best is None else FREEDOM[best]


def to_postfix(expression: str) -> list[str]:
    """The expression's names and operators in postfix order, lower-cased."""
    return postfix_at(expression.lower(), 0, len(expression))


def postfix_at(text: str, start: int, stop: int) -> list[str]:
    """Shunting-yard: the names and operators, in postfix order, of the expression at start in a lower-cased text. Reading
    stops before the first token that cannot go on, or that is a tag; open brackets close at the end, and an operator
    without a right side is dropped. No more is read than the expression."""
    out: list[str] = []
    held: list[str] = []
    want_name = True
    depth = 0
    for m in TOKEN.finditer(text, start, stop):
        token = m[0]
        if want_name:
            if token == "(":
                held.append(token)
                depth += 1
            elif token in BINDS or token == ")" or token.startswith(TAGS):
                break
            else:
                out.append(token.rstrip(".:"))
                want_name = False
        elif token in BINDS:
            while held and held[-1] != "(" and BINDS[held[-1]] >= BINDS[token]:
                out.append(held.pop())
            held.append(token)
            want_name = True
        elif token == ")" and depth:
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
            depth -= 1
        else:
            break
    if want_name:
        while held and held[-1] == "(":
            held.pop()
        if held:
            held.pop()
    return out + [x for x in reversed(held) if x != "("]


def evaluate(postfix: list[str]) -> tuple[float | None, list[str]]:
    """Freedom of the expression and the licences it names: all parts of an ``and`` bind, of an ``or`` one may be chosen,
    an exception after ``with`` loosens its licence. None for an empty expression."""
    stack: list[float] = []
    names: list[str] = []
    for token in postfix:
        if token not in BINDS:
            stack.append(freedom(token))
            names.append(token)
        elif len(stack) > 1:
            right, left = stack.pop(), stack.pop()
            if token == "with":
                names.pop()
                stack.append(min(1.0, left + EXCEPTION_GAIN))
            else:
                stack.append(min(left, right) if token == "and" else max(left, right))
    return (stack[-1] if stack else None), names


def automaton(phrases: dict[str, tuple], edge: str = "") -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase, value in phrases.items():
        a.add_word(f"{edge}{phrase}{edge}", value)
    a.make_automaton()
    return a


def scanner(base: dict[str, str], notices: dict[str, str]):
    """A function from a text's bytes to (words, base places, first, last, base labels, labels, score)."""
    phrases: dict[str, tuple] = {p: (None, label) for p, label in notices.items()}
    phrases |= {p: (len(p) + 1, label) for p, label in base.items()}
    phrases |= {"spdx license identifier": (-1, ""), "license expression": (-1, ""), "spdx license expression": (-1, "")}
    words_of, tags_of = automaton(phrases, " "), automaton({t: (t,) for t in TAGS})

    def scan(body: bytes) -> tuple:
        words = body.translate(WORDS).split()
        text = (b" %b " % b" ".join(words)).decode("latin-1")
        starts, base_labels, found, scores, tagged = [], set(), set(), [], False
        for end, (kind, label) in words_of.iter(text):
            if kind == -1:
                tagged = True
            else:
                found.add(label)
                if kind:
                    starts.append(end - kind)
                    base_labels.add(label)
        scores = [freedom(label) for label in found]
        if tagged:
            low, stop = body.translate(LOWER).decode("latin-1"), 0
            for end, _ in tags_of.iter(low):
                if end >= stop:
                    line_end = LINE_END.search(low, end)
                    stop = line_end.start() if line_end else len(low)
                score, names = evaluate(postfix_at(low, end + 1, stop))
                if score is not None:
                    scores.append(score)
                    found.update(names)
        first = last = None
        if starts:
            first, last = (text.count(" ", 0, i + 1) - 1 for i in (min(starts), max(starts)))
        return len(words), len(starts), first, last, ",".join(sorted(base_labels)), ",".join(sorted(found)), min(scores, default=0.0)

    return scan


def license_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES
) -> DataFrame:
    """doc_id, n_words, n_base (places of base phrases), first_word, last_word (their smallest and largest start),
    base_labels, labels (of notices and licence expressions too), score: the freedom that the strictest notice or
    expression of the text leaves, 0 (none found) to 1. One scan, no shuffle; memory is bounded by an Arrow batch."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        key = ("licences", *base.items(), "notices", *notices.items())
        scan = worker_cache().get(key) or worker_cache().setdefault(key, scanner(base, notices))
        columns = list(zip(*(scan(x) for x in batch.column("body").to_pylist()), strict=True))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], NAMES)

    return map_batches(text_bytes(docs, id_col, text_col), run, SCHEMA)


NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

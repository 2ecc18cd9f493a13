"""Packing by lexical retrieval.

Every text becomes token ids (and an end id); the ids go to the shared folder once. Document frequencies of all tokens
are counted over the whole table. The documents of a table partition are cut into shards of about SHARD tokens; each has
an inverted index of its own, scored by BM25 with the table's document frequencies. A window starts with a seed document;
all its terms are looked up, and the unused neighbours that the index returns fill the window in the order of their
scores, then, when nothing scores, the next unused documents. The document at a window's end is cut, and its
rest is the seed of the next window. So all windows of a shard but the last are full; the last is cut into sequences
whose lengths are powers of two, which need no padding.

* Null and empty texts are the end id alone; null ids are kept; repeated rows are documents of their own;
* equal scores: the earlier document of the shard; an empty table gives an empty result;
* only the id and text columns are read. A shard's tokens, at least one document, are what a task holds.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pentad.llm.common import LOWER, cut, parts, text_bytes, worker_cache

WINDOW, END, SHARD = 4096, 2, 1_500_000
K1, B = 1.2, 0.75
CACHE = 500_000
#: Marks that the tokenizer takes as one pre-token when they follow each other.
MARKS = b".,;:!?()[]{}\"*#%&|-_/+=~"


#: Texts that show whether a tokenizer lower-cases A-Z, drops white space and looks at each run between it alone.
PROBES = ("Some WORDS  here,\tand (these) 42 \u00c9t\u00e9", " a\n\nb's don't\r\nx\x0by", "\u4e2d\u6587 \u0130 z...", "THE the The")


def parts_at_blanks(tokenizer) -> bool:
    """True if a text's ids are those of its lower-cased runs between white space, one after the other."""

    def ids(text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    return all(ids(p) == [i for run in p.encode().translate(LOWER).split() for i in ids(run.decode())] for p in PROBES)


def encoder(path: str):
    """A function from texts (UTF-8) to arrays of ids. Where white space parts tokens, each run of other characters is
    encoded by the tokenizer once and then kept; other tokenizers encode whole texts. Runs of letters, with or without marks behind them, are encoded many at
    a time: letters and marks are a pre-token each, and in vocabularies with word ends its last id shows it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    if tokenizer.get_vocab_size() > 65536:
        raise ValueError("ids are kept in 16 bits")
    closes = np.zeros(65536, bool)
    closes[[i for w, i in tokenizer.get_vocab().items() if w.endswith("</w>")]] = True
    known: dict[bytes, bytes] = worker_cache().setdefault(("words", path), {})
    if not parts_at_blanks(tokenizer):
        return lambda bodies: [np.asarray(e.ids, np.uint32).astype("<u2") for at in range(0, len(bodies), 256) for e in tokenizer.encode_batch_fast([b.decode() for b in bodies[at : at + 256]], add_special_tokens=False)]

    def one_by_one(runs: list[bytes]) -> None:
        for w, e in zip(runs, tokenizer.encode_batch_fast([w.decode() for w in runs], add_special_tokens=False), strict=True):
            known[w] = np.asarray(e.ids, np.uint32).astype("<u2").tobytes()

    def together(parts: list[bytes]) -> None:
        for at in range(0, len(parts), 1024):
            some = parts[at : at + 1024]
            ids = np.asarray(tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, np.uint32).astype("<u2")
            cuts = [0, *((np.flatnonzero(closes[ids]) + 1) * 2).tolist()]
            if len(cuts) != len(some) + 1:  # another view of what a letter is, or of where pre-tokens end
                one_by_one(some)
                continue
            data = ids.tobytes()
            for i, w in enumerate(some):
                known[w] = data[cuts[i] : cuts[i + 1]]

    def learn(runs: list[bytes]) -> None:
        plain, odd, parts = [], [], {}
        for w in runs:
            core = w.rstrip(MARKS)
            text = core.decode()
            if text.isalpha() and text.lower().isalpha():
                plain.append((w, core, w[len(core) :]))
                parts[core] = parts[w[len(core) :]] = None
            else:
                odd.append(w)
        together([x for x in parts if x and x not in known])
        for w, core, marks in plain:
            known[w] = known[core] + known[marks] if marks else known[core]
        one_by_one(odd)

    def encode(bodies: list[bytes]) -> list[np.ndarray]:
        out = []
        for at in range(0, len(bodies), 256):
            # small letters first: fewer runs; where a special token's text might come of it, as it stands
            split = [(b if b"<|" in b else b.translate(LOWER)).split() for b in bodies[at : at + 256]]
            learn(list({w for words in split for w in words if w not in known}))
            out += [np.frombuffer(b"".join(map(known.__getitem__, words)), "<u2") for words in split]
            if len(known) > CACHE:
                known.clear()
        return out

    return encode


def tokenized(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, end: int) -> DataFrame:
    """doc_id, ids: little-endian unsigned 16-bit ids with the end id."""
    close = np.array([end], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for b in parts(batches):
            ids = [x.tobytes() + close for x in encode(b.column("body").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return text_bytes(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def document_frequencies(ids: DataFrame) -> tuple[dict[int, int], int, int]:
    """Documents that hold each token, and the numbers of documents and tokens; as many rows as the vocabulary has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, tokens = np.zeros(65536, np.int64), 0, 0
        for b in parts(batches):
            for x in b.column("ids").to_pylist():
                x = np.frombuffer(x, "<u2")
                df[np.unique(x)] += 1
                docs, tokens = docs + 1, tokens + len(x)
        t = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *t.tolist()], pa.int32()), pa.array([docs, tokens, *df[t].tolist()], pa.int64())], ["t", "n"])

    rows = {r["t"]: r["n"] for r in ids.mapInArrow(run, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()}
    docs, tokens = rows.pop(-2, 0), rows.pop(-1, 0)
    return rows, docs, tokens


class Index:
    """BM25 over the documents of a shard; used documents score nothing. Terms that more than an eighth of the documents
    hold are kept as rows of a matrix, the others as lists of their documents."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        n = len(docs)
        sizes = np.array([len(x) for x in docs])
        keys = np.concatenate(docs).astype(np.int64) * n + np.repeat(np.arange(n), sizes)
        keys, tf = np.unique(keys, return_counts=True)
        terms, self.doc = keys // n, keys % n
        self.weight = idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[self.doc] / mean))
        self.starts = np.searchsorted(terms, np.arange(len(idf) + 1))
        order = np.argsort(self.doc, kind="stable")
        self.by_doc, self.doc_starts = terms[order], np.searchsorted(self.doc[order], np.arange(n + 1))
        held = np.diff(self.starts)
        usual = np.flatnonzero(held * 8 > n)
        self.row = np.full(len(idf), -1)
        self.row[usual] = np.arange(len(usual))
        self.matrix = np.zeros((len(usual), n))
        dense = self.row[terms] >= 0
        self.matrix[self.row[terms[dense]], self.doc[dense]] = self.weight[dense]
        self.unused = np.ones(n, bool)

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document for the seed's terms."""
        terms = self.by_doc[self.doc_starts[seed] : self.doc_starts[seed + 1]]
        rows = self.row[terms]
        asked = np.zeros(len(self.matrix))
        asked[rows[rows >= 0]] = 1
        rare = terms[rows < 0]
        n = self.starts[rare + 1] - self.starts[rare]
        at = np.repeat(self.starts[rare] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return asked @ self.matrix + np.bincount(self.doc[at], self.weight[at], len(self.unused))

    def neighbours(self, seed: int) -> np.ndarray:
        """Unused documents that share a term with the seed, best first."""
        scores = self.scores(seed)
        found = np.flatnonzero((scores > 0) & self.unused)
        return found[np.argsort(-scores[found], kind="stable")]


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length)."""
    index, sequences, now, room, after = Index(docs, idf, mean), [], [], window, 0
    seed = rest = None

    def put(doc: int, start: int) -> int | None:
        """Adds the document from start on, as far as there is room; where to go on, if something is left."""
        nonlocal now, room
        take = min(room, len(docs[doc]) - start)
        now.append((doc, start, take))
        room -= take
        if room == 0:
            sequences.append(now)
            now, room = [], window
        return start + take if start + take < len(docs[doc]) else None

    while True:
        if rest is None:
            while after < len(docs) and not index.unused[after]:
                after += 1
            if after == len(docs):
                break
            seed, rest = after, 0
            index.unused[seed] = False
        rest = put(seed, rest)
        if rest is None and now:
            for doc in index.neighbours(seed).tolist():
                index.unused[doc] = False
                rest = put(doc, 0)
                if not now or rest is not None:
                    seed = doc
                    break
    while now:  # the last window, cut at powers of two
        size = 1 << (sum(x[2] for x in now).bit_length() - 1)
        part = []
        while size:
            doc, start, take = now.pop(0)
            part.append((doc, start, min(take, size)))
            if take > size:
                now.insert(0, (doc, start + size, take - size))
            size -= min(take, size)
        sequences.append(part)
    return sequences


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end: int = END, shard: int = SHARD, with_ids: bool = True) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with with_ids the piece's ids as
    little-endian unsigned 32-bit numbers. tokenizer is the path of a tokenizer file that every worker can read."""
    ids = cut(tokenized(docs, tokenizer, id_col, text_col, end))
    df, n_docs, n_tokens = document_frequencies(ids)
    counts = np.zeros(65536)
    counts[list(df)] = list(df.values())
    idf = np.log(1 + (n_docs - counts + 0.5) / (counts + 0.5))
    mean = max(1.0, n_tokens / max(1, n_docs))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]

    def rows(keys: list, texts: list[np.ndarray], first: int) -> tuple[pa.RecordBatch, int]:
        out = []
        sequences = pack_shard(texts, idf, mean, window)
        for s, pieces in enumerate(sequences, first):
            offset = 0
            for doc, start, length in pieces:
                data = texts[doc][start : start + length].astype("<u4").tobytes()
                out.append((keys[doc], start, length, zlib.crc32(data), len(texts[doc]), s, offset, data)[: len(names)])
                offset += length
        columns = list(zip(*out, strict=True))
        kinds = [pa.int64()] * 7 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names), first + len(sequences)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, keys, texts, held = TaskContext.get().partitionId() << 40, [], [], 0
        for b in parts(batches):
            for key, body in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), strict=True):
                keys.append(key)
                texts.append(np.frombuffer(body, "<u2"))
                held += len(texts[-1])
                if held >= shard:
                    out, number = rows(keys, texts, number)
                    keys, texts, held = [], [], 0
                    yield out
        if keys:
            yield rows(keys, texts, number)[0]

    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return ids.mapInArrow(run, kind)

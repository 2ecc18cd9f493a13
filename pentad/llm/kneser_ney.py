"""LM scoring: an interpolated modified Kneser-Ney bigram model.

A-Z become a-z; tokens are the matches of ``[^\\x20\\x09-\\x0D]+`` in the whole text and one end. Words are known by their
64-bit XXH64.

Counting runs in Spark: tasks sum the (context, word) pairs of a few million tokens at a time and deal the sums into
buckets by a hash of the pair (a context's words go to a quarter of the buckets, so a frequent word does not fill one). A bucket's task
adds the sums up, writes the pairs as a sorted array of hashes with their counts to the shared folder, and hands on, by
word, what the lower order needs: totals and numbers of continuations. Those meet in buckets by word, which are written
the same way. Buckets have a bounded size: there are more of them for more text. Scoring memory-maps the arrays and looks
up the sorted hashes of a million tokens at a time; the driver only ever holds a few sums.

With total c(v), words after v seen once, twice, more often N1, N2, N3, and discounts D1..D3 from the counts of counts:
p(w|v) = (c(vw) - D(c)) / c(v) + (D1 N1 + D2 N2 + D3 N3) / c(v) * p(w), and p(w) the same over the numbers of different
words before w, interpolated with 1 / (V + 1), which is also what unknown words get.

* Null and empty texts are one end token; a null id belongs to the training rows; repeated rows count repeatedly;
* without training rows the model gives 1 / (V + 1) = 1 to every token; an empty table gives an empty result;
* only the id and text columns are read.

A folder that is not on a file system the workers share by path is reached by pyarrow.fs; workers then hold up to HELD
bytes of its arrays in memory and read the others again. Buckets are written under a temporary name and renamed, so
repeated tasks do no harm. The folder goes when all is scored, or when scoring fails.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pentad.llm.common import LOWER, cut, parts, shared_dir, text_bytes

FLUSH, LEAST_SPREAD = 1_500_000, 16
#: Bytes of text for each bucket of pairs, and the least number of buckets; as many hold words.
BUCKET_BYTES, LEAST_BUCKETS = 12_000_000, 64
#: Bytes of arrays that a worker keeps where it cannot map them.
HELD = 400_000_000
START, END = (np.uint64(xxhash.xxh64_intdigest(x)) for x in (b" <s>", b" </s>"))
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def token_hashes(body: bytes) -> np.ndarray:
    """The start, the text's words and the end."""
    words = body.translate(LOWER).split()
    out = np.empty(len(words) + 2, np.uint64)
    out[0], out[-1] = START, END
    out[1:-1] = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return out


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = (v * M1) ^ ((w << np.uint64(31)) | (w >> np.uint64(33))) * M2
    x ^= x >> np.uint64(29)
    x *= M1
    return x ^ (x >> np.uint64(32))


def pair_bucket(v: np.ndarray, w: np.ndarray, buckets: int) -> np.ndarray:
    x = (v ^ (w % np.uint64(max(LEAST_SPREAD, buckets // 4))) * M2) * M1
    return ((x >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)


def word_bucket(w: np.ndarray, buckets: int) -> np.ndarray:
    return (((w * M2) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)


def summed(keys: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys in order and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], [np.add.reduceat(v[order], first) if len(keys) else v for v in values]


def spans(groups: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The groups of a sorted array of group numbers and their places."""
    cuts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else np.zeros(0, np.int64)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(groups)], strict=True):
        yield int(groups[a]), slice(a, b)


def _put(folder: str, name: str, array: np.ndarray) -> None:
    fs, path = pafs.FileSystem.from_uri(folder)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        f.write(memoryview(np.ascontiguousarray(array)).cast("B") if array.size else b"")
    fs.move(part, f"{path}/{name}")


def _map(folder: str, name: str, dtype) -> np.ndarray:
    fs, path = pafs.FileSystem.from_uri(folder)
    info = fs.get_file_info(f"{path}/{name}")
    if info.type == pafs.FileType.NotFound or not info.size:
        return np.zeros(0, dtype)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(f"{path}/{name}", dtype, "r")
    with fs.open_input_stream(f"{path}/{name}") as source:
        return np.frombuffer(source.read(), dtype)


#: What is kept of a word: total, numbers of words that follow once, twice, more often, number of words before it.
STATS = np.dtype([("c", "<u8"), ("n1", "<u4"), ("n2", "<u4"), ("n3", "<u4"), ("k", "<u4")])
#: Pair counts are bytes; this one says that the count stands in the list of large ones.
MANY = 255


def build(docs: DataFrame, folder: str, buckets: int, word_buckets: int) -> dict:
    """Counts the pairs of doc_id, body rows, writes the arrays, and returns the sums that discounts need."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(texts: list[np.ndarray]) -> pa.RecordBatch:
            v, w = np.concatenate([t[:-1] for t in texts]), np.concatenate([t[1:] for t in texts])
            order = np.lexsort((w, v))
            v, w = v[order], w[order]
            first = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (w[1:] != w[:-1])])
            n = np.diff(np.r_[first, len(v)]).astype(np.uint32)
            v, w = v[first], w[first]
            bucket = pair_bucket(v, w, buckets)
            order = np.argsort(bucket, kind="stable")
            v, w, n, bucket = v[order], w[order], n[order], bucket[order]
            rows = []
            for b, at in spans(bucket):
                starts = np.flatnonzero(np.r_[True, v[at][1:] != v[at][:-1]])
                runs = np.diff(np.r_[starts, at.stop - at.start]).astype(np.uint32)
                rows.append((b, v[at][starts].tobytes(), runs.tobytes(), w[at].tobytes(), n[at].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32()] + [pa.binary()] * 4, strict=True)], ["bucket", "v", "runs", "w", "n"])

        texts, held = [], 0
        for b in parts(batches):
            for body in b.column("body").to_pylist():
                texts.append(token_hashes(body))
                held += len(texts[-1])
                if held >= FLUSH:
                    yield flush(texts)
                    texts, held = [], 0
        if texts:
            yield flush(texts)

    def merge(rows: pa.Table) -> pa.Table:
        b = rows["bucket"][0].as_py()
        parts = [[np.frombuffer(x, t) for x in rows[c].to_pylist()] for c, t in (("v", "<u8"), ("runs", "<u4"), ("w", "<u8"), ("n", "<u4"))]
        v = np.concatenate([np.repeat(x, r) for x, r in zip(*parts[:2], strict=True)])
        w, n = np.concatenate(parts[2]), np.concatenate(parts[3]).astype(np.uint64)
        h = pair_hash(v, w)
        order = np.argsort(h)
        h, v, w, n = h[order], v[order], w[order], n[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        h, v, w, n = h[first], v[first], w[first], np.add.reduceat(n, first)
        _put(folder, f"pairs-{b}", h)
        _put(folder, f"counts-{b}", np.minimum(n, MANY).astype(np.uint8))
        _put(folder, f"many-{b}", np.column_stack((h[n >= MANY], n[n >= MANY])))
        of = [np.uint32(0) + (n == k).astype(np.uint32) for k in (1, 2, 3, 4)]
        v, (c, n1, n2, n3) = summed(v, [n, of[0], of[1], (n > 2).astype(np.uint32)])
        w, (k,) = summed(w, [np.ones(len(w), np.uint32)])
        out = []
        for keys, stats in ((v, (c, n1, n2, n3, np.zeros(len(v)))), (w, (np.zeros(len(w)),) * 4 + (k,))):
            record = np.zeros(len(keys), STATS)
            for name, x in zip(STATS.names, stats, strict=True):
                record[name] = x
            at = word_bucket(keys, word_buckets)
            order = np.argsort(at, kind="stable")
            keys, record, at = keys[order], record[order], at[order]
            # the columns apart: mostly small numbers, which compress well
            out += [(g, keys[s].tobytes(), b"".join(record[name][s].tobytes() for name in STATS.names)) for g, s in spans(at)]
        sums = [int(x.sum()) for x in of]
        columns = [pa.array([r[i] for r in out] + [x], t) for i, (x, t) in enumerate(((b % word_buckets, pa.int32()), (None, pa.binary()), (np.array(sums, "<u8").tobytes(), pa.binary())))]
        return pa.table(columns, ["bucket", "keys", "stats"])

    def words(rows: pa.Table) -> pa.Table:
        b, sums, keys, stats = rows["bucket"][0].as_py(), np.zeros(11, np.uint64), [], []
        for mine, x in zip(rows["keys"].to_pylist(), rows["stats"].to_pylist(), strict=True):
            if mine is None:  # the sums of a bucket of pairs
                sums[:4] += np.frombuffer(x, "<u8")
                continue
            h, at, columns = np.frombuffer(mine, "<u8"), 0, []
            for name in STATS.names:
                columns.append(np.frombuffer(x, STATS[name], len(h), at))
                at += len(h) * STATS[name].itemsize
            keys.append(h)
            stats.append(columns)
        if keys:
            h, values = summed(np.concatenate(keys), [np.concatenate([s[i] for s in stats]) for i in range(len(STATS))])
            record = np.zeros(len(h), STATS)
            for name, x in zip(STATS.names, values, strict=True):
                record[name] = x
            _put(folder, f"words-{b}", h)
            _put(folder, f"stats-{b}", record)
            k = record["k"]
            sums[4:8] = [(k == i).sum() for i in (1, 2, 3, 4)]
            sums[8:] = k.sum(dtype=np.uint64), (k > 0).sum(), record["c"].sum()
        return pa.table([pa.array([int(x)]) for x in sums], [f"s{i}" for i in range(11)])

    counted = docs.mapInArrow(count, "bucket int, v binary, runs binary, w binary, n binary")
    merged = counted.groupBy("bucket").applyInArrow(merge, "bucket int, keys binary, stats binary")
    done = merged.groupBy("bucket").applyInArrow(words, ", ".join(f"s{i} long" for i in range(11)))
    sums = [x or 0 for x in done.agg(*(F.sum(f"s{i}") for i in range(11))).first()]
    d, (k1, k2), (types, vocabulary, tokens) = discounts(*sums[4:8]), sums[4:6], sums[8:]
    mass = (d[0] * k1 + d[1] * k2 + d[2] * (vocabulary - k1 - k2)) / types if types else 0.0
    return {"pairs": discounts(*sums[:4]), "singles": d, "mass": mass, "types": types, "vocabulary": vocabulary, "tokens": tokens}


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Of the modified Kneser-Ney estimate; a count of counts that is zero takes half a count's place, and a discount
    stays below its count."""
    n1, n2, n3, n4 = (max(x, 0.5) for x in (n1, n2, n3, n4))
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.1), i - 0.1) for i, d in enumerate(raw, 1))


class Model:
    """Probabilities from the mapped arrays."""

    def __init__(self, folder: str, buckets: int, word_buckets: int, known: dict):
        self.folder, self.buckets, self.word_buckets, self.known = folder, buckets, word_buckets, known
        self.files, self.held = OrderedDict(), 0

    def array(self, name: str, dtype) -> np.ndarray:
        if name in self.files:
            self.files.move_to_end(name)
            return self.files[name]
        out = self.files[name] = _map(self.folder, name, dtype)
        self.held += 0 if isinstance(out, np.memmap) else out.nbytes
        while self.held > HELD and len(self.files) > 1:
            _, old = self.files.popitem(last=False)
            self.held -= 0 if isinstance(old, np.memmap) else old.nbytes
        return out

    def find(self, keys: np.ndarray, at: np.ndarray, names: tuple[str, str], dtype) -> np.ndarray:
        """Values of sorted keys, zero where there is none; at: the keys' buckets."""
        out = np.zeros(len(keys), dtype)
        order = np.argsort(at, kind="stable")
        for b, s in spans(at[order]):
            mine = order[s]
            there = self.array(f"{names[0]}-{b}", "<u8")
            if len(there):
                place = np.minimum(np.searchsorted(there, keys[mine]), len(there) - 1)
                hit = there[place] == keys[mine]
                out[mine[hit]] = self.array(f"{names[1]}-{b}", dtype)[place[hit]]
        return out

    def logs(self, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each w after its v, and each w's count."""
        words, inverse = np.unique(np.concatenate((v, w)), return_inverse=True)
        stats = self.find(words, word_bucket(words, self.word_buckets), ("words", "stats"), STATS)
        size = self.known["vocabulary"] + 1
        d, types = np.array((0.0, *self.known["singles"])), self.known["types"]
        k = stats["k"].astype(np.float64)
        if types:
            single = np.maximum(k - d[np.minimum(k, 3).astype(int)], 0) / types + self.known["mass"] / size
        else:
            single = np.full(len(words), 1 / size)
        vi, wi = inverse[: len(v)], inverse[len(v) :]
        at = pair_bucket(v, w, self.buckets)
        pairs, first, back = np.unique(pair_hash(v, w), return_index=True, return_inverse=True)
        n = self.find(pairs, at[first], ("pairs", "counts"), np.uint8).astype(np.float64)
        many = np.flatnonzero(n == MANY)
        for b in np.unique(at[first][many]).tolist():
            table = self.array(f"many-{b}", "<u8").reshape(-1, 2)
            mine = many[at[first][many] == b]
            n[mine] = table[np.searchsorted(table[:, 0], pairs[mine]), 1]
        n, c, d = n[back], stats["c"].astype(np.float64)[vi], np.array((0.0, *self.known["pairs"]))
        with np.errstate(divide="ignore", invalid="ignore"):
            left = (d[1] * stats["n1"] + d[2] * stats["n2"] + d[3] * stats["n3"])[vi] / c
            p = np.where(c > 0, np.maximum(n - d[np.minimum(n, 3).astype(int)], 0) / c + left * single[wi], single[wi])
        counts = stats["c"][wi].astype(np.int64)
        return np.log10(p), np.where(w == END, self.known["texts"], counts)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that the model does not learn from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def perplexity_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams), score (the model), both log10
    probabilities of the whole text, and perplexity (by token, from score)."""
    bodies = text_bytes(docs, id_col, text_col)
    size, texts = bodies.where(~held_out()).agg(F.sum(F.octet_length("body")), F.count(F.lit(1))).first()
    buckets = max(LEAST_BUCKETS, -(-(size or 0) // BUCKET_BYTES))
    word_buckets = buckets
    root = shared_dir(docs.sparkSession)
    root = root if "://" in root else "file://" + root.removeprefix("file:")
    folder = f"{root}/kneser-ney-{uuid.uuid4().hex}"
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path)
    try:
        known = build(bodies.where(~held_out()), folder, buckets, word_buckets) | {"texts": texts}
        scored = cut(_scores(bodies, folder, buckets, word_buckets, known))
    finally:
        fs.delete_dir(path)
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(known["tokens"]).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")


def _scores(bodies: DataFrame, folder: str, buckets: int, word_buckets: int, known: dict) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score, perplexity, by the model in the folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(folder, buckets, word_buckets, known)

        def flush(keys: list, texts: list[np.ndarray]) -> pa.RecordBatch:
            v, w = np.concatenate([t[:-1] for t in texts]), np.concatenate([t[1:] for t in texts])
            starts = np.cumsum([0] + [len(t) - 1 for t in texts[:-1]])
            logs, c = model.logs(v, w)
            base = np.log10((c + 1.0) / (known["tokens"] + known["vocabulary"] + 1.0))
            n = np.array([len(t) - 1 for t in texts])
            score = np.add.reduceat(logs, starts)
            columns = [pa.array(keys, pa.int64()), *map(pa.array, (n, np.add.reduceat((c > 0).astype(np.int64), starts), np.add.reduceat(base, starts), score, 10 ** (-score / n)))]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"])

        keys, texts, held = [], [], 0
        for b in parts(batches):
            for key, body in zip(b.column("doc_id").to_pylist(), b.column("body").to_pylist(), strict=True):
                keys.append(key)
                texts.append(token_hashes(body))
                held += len(texts[-1])
                if held >= FLUSH // 2:
                    yield flush(keys, texts)
                    keys, texts, held = [], [], 0
        if texts:
            yield flush(keys, texts)

    return bodies.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double, perplexity double")

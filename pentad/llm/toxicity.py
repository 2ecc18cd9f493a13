"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of ordinary and one on windows of toxic texts. A window is priced
twice: by its length under the ordinary dictionary, and under the toxic and the ordinary one together. What the toxic
dictionary saves is the window's gain; common text costs the same on both sides. Letters are spelt as codes of three
bytes, so that zstandard, whose shortest match is three bytes, can refer to any run of letters, and text that neither
dictionary knows stays dear.

Most of a toxic text is ordinary. So the toxic dictionary is trained again and again, each time on shorter windows, and
on those alone that the one before (trained on the other half of the pieces) prices lower than it prices nearly all
ordinary windows. Numbers of windows at or above thresholds of gain are turned into a probability by a logistic fit on
labelled texts that no dictionary has seen.

The fit uses a bounded sample: TOXIC_DOCS and ORDINARY_DOCS labelled rows, in an order given by a hash of the id, and
about TOXIC_PIECES and ORDINARY_PIECES of their pieces, drawn by hash. Pieces are cut where the words say so, hence alike
in copies, and count once however many texts hold them. Scoring takes every window of every text, in one scan without
shuffle.

* Null and empty texts are scored as texts without windows; a null id is not held out;
* several labels of an id: toxic if one is; labels other than 0 and 1 and labels without a text are not used; without
  two labelled texts of both kinds every score is the share of toxic rows among the labels (0 if there are none);
* repeated rows give a row each; an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pentad.llm.common import LOWER, cut, parts, release, text_bytes

TOXIC_DOCS, ORDINARY_DOCS = 2500, 7500
TOXIC_PIECES, ORDINARY_PIECES = 80_000, 160_000
#: Words of a window in scoring, and in the rounds that train the toxic dictionary, with the dictionary's bytes in each.
WINDOW, ROUNDS = 4, ((6, 32768), (3, 32768), (2, 16384), (1, 8192))
ORDINARY_BYTES, CODE, LEAST = 122_880, 3, 4
#: Of ordinary windows, so many may be priced lower than a window that goes on to the next round.
ODD = 0.01
#: One in so many of those ordinary pieces is priced for that.
GAUGE = 4
#: Of the labelled texts, one in so many is kept for the fit of the thresholds' weights.
KEPT = 4
#: Scores that count as toxic, for the verdict and for what the pipeline drops.
THRESHOLD = 0.3
THRESHOLDS = (1, 2, 3, 4, 5, 6, 8, 10)
#: Bytes other than ASCII letters and those of longer characters part words; A-Z become a-z.
WORDS = bytes(LOWER[b] if LOWER[b] >= 0x80 or chr(LOWER[b]).isalpha() else 32 for b in range(256))
SPELLING = np.frombuffer(b"".join(xxhash.xxh64_digest(bytes([b]))[:CODE] for b in range(256)), np.uint8).reshape(256, CODE)


def words(body: bytes) -> list[bytes]:
    return body.translate(WORDS).split()


def windows(held: list[bytes], n: int) -> list[bytes]:
    """The words by n, spelt, with a blank before and after each window."""
    if not held:
        return []
    text = np.frombuffer(b" %b " % b" ".join(held), np.uint8)
    spelt, at = SPELLING[text].tobytes(), np.flatnonzero(text == 32)
    ends = [*at[n:-1:n].tolist(), int(at[-1])]
    return [spelt[CODE * a : CODE * (b + 1)] for a, b in zip(at[:-1:n].tolist(), ends, strict=True)]


def pieces(body: bytes) -> Iterator[bytes]:
    """The text's words in runs of three and more, about eight, that end where a hash of the last two words says so."""
    held, before = [], b""
    for w in words(body):
        held.append(w)
        if len(held) > 2 and zlib.crc32(w, zlib.crc32(before)) % 6 == 0:
            yield b" ".join(held)
            held = []
        before = w
    if held:
        yield b" ".join(held)


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary of the samples; their own bytes if they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def novel(ordinary: bytes, toxic: bytes) -> list[bytes]:
    """The shortest runs of bytes, four at least (a shorter match saves nothing), that the toxic dictionary holds and the
    ordinary one does not."""
    out, end = [], 0
    for start in range(len(toxic)):
        end = max(end, start + LEAST)
        while end <= len(toxic) and toxic[start:end] in ordinary:
            end += 1
        if end > len(toxic):
            break
        if end - start == LEAST or toxic[start + 1 : end] in ordinary:  # else a shorter one follows, with the same end
            out.append(toxic[start:end])
    return sorted(set(out))


class Gains:
    """Gains of windows: what the toxic dictionary saves. With ``runs``, what ``novel`` finds, windows that hold none of
    them are not compressed: the toxic dictionary has no match for them that the ordinary one lacks, so their gain is 0."""

    def __init__(self, ordinary: bytes, toxic: bytes, runs: list[bytes] | None = None):
        self.search = None
        if runs:
            self.search = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            for r in runs:
                self.search.add_word(r.decode("latin-1"))
            self.search.make_automaton()
        how = zstandard.ZstdCompressionParameters(
            strategy=zstandard.STRATEGY_BTOPT, min_match=3, search_log=5, target_length=64, window_log=18, hash_log=17, chain_log=18,
            format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        raw = zstandard.DICT_TYPE_RAWCONTENT  # one cost of literals and matches for both sides
        self.ordinary, self.both = (zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d or b" " * 8, dict_type=raw), compression_params=how).compress for d in (ordinary, toxic + ordinary))

    def of(self, spelt: list[bytes]) -> list[int]:
        a, b = self.ordinary, self.both
        if self.search is None:
            return [len(a(w)) - len(b(w)) for w in spelt]
        ends = np.cumsum([0, *map(len, spelt)])
        last, size = np.array([*self.search.iter(b"".join(spelt).decode("latin-1"))], np.int64).reshape(-1, 2).T
        at = np.searchsorted(ends, last, "right") - 1
        out = [0] * len(spelt)
        for i in np.unique(at[last - size + 1 >= ends[at]]).tolist():  # those that begin in the window where they end
            out[i] = len(a(spelt[i])) - len(b(spelt[i]))
        return out

    def features(self, body: bytes) -> list[float]:
        g = np.array(self.of(windows(words(body), WINDOW)), np.int64)
        top = np.sort(g)[-3:]
        return [*(np.log1p(np.count_nonzero(g >= t)) for t in THRESHOLDS), np.log1p(len(g)), float(top[-1:].sum().clip(0, 20)), float(top.sum().clip(0, 60)), float(g.mean()) if len(g) else 0.0]


def fit(x: np.ndarray, y: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton's method; rows weigh so that toxic ones make up share."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.c_[np.ones(len(x)), (x - mean) / scale]
    w = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    b, ridge = np.zeros(a.shape[1]), np.diag([1e-6] + [0.5] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        b = b + np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (w * (y - p)) - ridge @ b)
    return mean, scale, b


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that the fit must not see."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, float]:
    """k, toxic, body, kept (for the weights' fit) of the labelled rows to learn from, none of them held out; and the share
    of toxic ones among all labels that are not."""
    known = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("k")).agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg("toxic")).first()[0] or 0.0
    order = (F.xxhash64("k"), "k")
    chosen = known.where("toxic = 1").orderBy(*order).limit(TOXIC_DOCS).unionByName(known.where("toxic = 0").orderBy(*order).limit(ORDINARY_DOCS))
    ids = {r["k"]: r["toxic"] for r in chosen.collect()}
    small = docs.sparkSession.createDataFrame(list(ids.items()) or [(None, None)], "k long, toxic int")
    body = F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("body")
    texts = docs.select(F.col(id_col).cast("long").alias("k"), body).join(F.broadcast(small), "k")
    # repeated ids: one text each, so that the sample stays within its bound
    texts = texts.groupBy("k").agg(F.first("toxic").alias("toxic"), F.min("body").alias("body"))
    return cut(texts.withColumn("kept", F.pmod(F.xxhash64(F.lit(1), "k"), F.lit(KEPT)) == 0)), float(share)


def learning_pieces(texts: DataFrame) -> DataFrame:
    """piece, toxic, half: the distinct pieces to train on. A piece that an ordinary text holds is ordinary; those of kept
    texts are left out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            for toxic, body, kept in zip(*(b.column(c).to_pylist() for c in ("toxic", "body", "kept")), strict=True):
                own = sorted(set(pieces(body)))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array([toxic] * len(own), pa.int32()), pa.array([kept] * len(own), pa.bool_())], ["piece", "toxic", "kept"])

    each = texts.mapInArrow(run, "piece binary, toxic int, kept boolean").groupBy("piece").agg(F.min("toxic").alias("toxic"), F.max("kept").alias("kept"))
    each = cut(each.where(~F.col("kept")).select("piece", "toxic", F.xxhash64("piece").alias("h")))
    counts = {r["toxic"]: r["count"] for r in each.groupBy("toxic").count().collect()}
    most = {1: TOXIC_PIECES, 0: ORDINARY_PIECES}
    rate = F.when(F.col("toxic") == 1, most[1] / max(most[1], counts.get(1, 0))).otherwise(most[0] / max(most[0], counts.get(0, 0)))
    return each.where(F.pmod("h", F.lit(1 << 20)) < rate * (1 << 20)).select("piece", "toxic", F.pmod(F.shiftright("h", 20), F.lit(2)).cast("int").alias("half"))


def odd_windows(lots: DataFrame, n: int, ordinary: bytes, toxic: list[bytes]) -> list[list[bytes]]:
    """By halves: the windows of n words of toxic pieces whose gain only ODD of the ordinary windows (of pieces that the
    ordinary dictionary was not trained on) surpass. A piece is priced by the dictionary of the other half."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = [Gains(ordinary, t) for t in toxic]
        for b in parts(batches, 1 << 14):
            found, usual = [], Counter()
            for piece, y, half in zip(*(b.column(c).to_pylist() for c in ("piece", "toxic", "half")), strict=True):
                if y == 1 or half == 1 and zlib.crc32(piece) % GAUGE == 0:
                    spelt = windows(piece.split(), n)
                    got = gains[1 - half].of(spelt)
                    if y == 1:
                        found += [(g, half, 1, w) for g, w in zip(got, spelt, strict=True) if g > 0]
                    else:
                        usual.update(got)
            found += [(g, None, k, None) for g, k in usual.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)] if found else [pa.array([], t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.binary())], ["gain", "half", "n", "w"])

    rows = lots.mapInArrow(run, "gain int, half int, n long, w binary")
    told = cut(rows)  # priced once; the driver takes the windows that count, as Arrow
    usual = Counter({r["gain"]: r["n"] for r in told.where("w IS NULL").groupBy("gain").agg(F.sum("n").alias("n")).collect()})
    least, over, room = 1, 0, ODD * sum(usual.values())
    for g in sorted(usual, reverse=True):
        over += usual[g]
        if over > room:
            least = max(1, g + 1)
            break
    odd = told.where(F.col("w").isNotNull() & (F.col("gain") >= least)).select("half", "w").toArrow()
    return [sorted(odd.filter(pc.equal(odd["half"], half))["w"].to_pylist(), key=lambda w: (zlib.crc32(w), w)) for half in (0, 1)]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """The model: dictionaries, logistic weights and prior. Reads labels of rows not held out only."""
    texts, share = sample(docs, labels, id_col, text_col)
    numbers = {(r["toxic"], r["kept"]): r["count"] for r in texts.groupBy("toxic", "kept").count().collect()}
    if any(numbers.get((y, False), 0) + numbers.get((y, True), 0) < 2 for y in (0, 1)):
        return {"share": share}
    if any(numbers.get((y, k), 0) < 2 for y in (0, 1) for k in (False, True)):  # too few to part
        texts = texts.withColumn("kept", F.lit(False))
    apart = "kept" if not any(numbers.get((y, k), 0) < 2 for y in (0, 1) for k in (False, True)) else "true"
    lots = cut(learning_pieces(texts).repartition(docs.sparkSession.sparkContext.defaultParallelism * 2))

    def of(toxic: int, half: int, n: int) -> list[bytes]:
        """The windows of one kind's pieces, in a fixed order; one kind at a time is held."""
        held = lots.where((F.col("toxic") == toxic) & (F.col("half") == half)).select("piece").toArrow()["piece"]
        return [w for p in sorted(held.to_pylist(), key=bytes.split) for w in windows(p.split(), n)]

    ordinary = dictionary(of(0, 0, 8), ORDINARY_BYTES)
    odd = [of(1, k, ROUNDS[0][0]) for k in (0, 1)]
    for n, size in ROUNDS:
        odd = odd_windows(lots, n, ordinary, [dictionary(side, size) for side in odd])
    toxic = dictionary(odd[0] + odd[1], ROUNDS[-1][1])
    del odd
    release()

    runs = novel(ordinary, toxic)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = Gains(ordinary, toxic, runs)
        for b in parts(batches):
            x = [gains.features(t) for t in b.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])

    told = texts.where(apart).select("toxic", "body").mapInArrow(run, "toxic int, x array<double>").collect()
    told = sorted((r["toxic"], r["x"]) for r in told)
    mean, scale, weights = fit(np.array([x for _, x in told]), np.array([float(y) for y, _ in told]), share)
    return {"share": share, "pair": (ordinary, toxic, runs), "mean": mean, "scale": scale, "weights": weights}


def probability(model: dict, features: list[list[float]]) -> np.ndarray:
    z = (np.array(features) - model["mean"]) / model["scale"]
    return 1 / (1 + np.exp(-np.clip(model["weights"][0] + z @ model["weights"][1:], -30, 30)))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 at or above the threshold)."""
    model = train(docs, labels, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = Gains(*model["pair"]) if "pair" in model else None
        for b in parts(batches):
            if gains is None:
                scores = np.full(b.num_rows, model["share"])
            else:
                scores = probability(model, [gains.features(t) for t in b.column("body").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = text_bytes(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score at or above the threshold: one scan, all columns as they are."""
    model = train(docs, labels, id_col, text_col)
    if "pair" not in model:
        return docs if model["share"] < threshold else docs.limit(0)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = Gains(*model["pair"])
        for b in parts(batches):
            bodies = b.column(at).cast(pa.binary()).to_pylist()
            yield b.filter(pa.array(probability(model, [gains.features(t or b"") for t in bodies]) < threshold))

    return docs.mapInArrow(run, docs.schema)

"""Line dedup by pairwise alignment.

Units are a text's lines, cut further at sentence ends; longer ones are cut where a hash of two words says so, shorter
ones join shorter neighbours, so that a passage has the same units wherever it stands, but for its edges. A unit of at
least MIN_WORDS words has a hash of its words (A-Z lowered, joined by a space). A hash that stands in several documents
makes them overlap: documents are ordered by id, and every document is aligned with the first holder of each hash that it
shares. So a hash makes one pair for each later document, however many hold it, and every shared unit of a later document
has its earliest copy opposite. What a document shares with a first holder is aligned by patience diff: units that are
unique on both sides, in the longest run of rising places, then the gaps between them; a gap without such units is aligned
by a longest common subsequence. Every run of at least min_block words that stands unbroken in both is added, so repeats
of a passage and passages in another order are met too. Runs of aligned units (from any partner) that hold at least
min_block words are deleted from the later document, with shorter units between them.

* min_block (MIN_BLOCK) is what counts as a block, 1 for every aligned unit; units under min_words (MIN_WORDS) words take no
  part;
* null, empty and blank texts have no units; null texts stay null; rows with a null id take no part and stay whole;
* rows with the same id and text are one document; with the same id and other text, the smaller text hash is the earlier;
* an empty table gives an empty result; ``deduplicate`` carries further columns along untouched, whatever their names.

A row of the alignment holds one document's shared units with their places in the first holders: no document is sent out
once for each partner. Frequent units spread over the joins, as ``graph`` describes.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pentad.llm.common import LOWER, cut, drop, map_batches
from pentad.llm.graph import anew, parted

MIN_WORDS, MIN_BLOCK = 4, 20
#: Lines and sentences of more words are cut into units of about twelve.
LONG = 24
CUT = re.compile(rb"(\r?\n|(?<=[.!?])[ \t]+)")
WORD = re.compile(rb"[^ \t-\r]+")
D = "struct<doc_id:bigint,t:bigint>"


def shorter(held: list[bytes], least: int) -> list[int]:
    """Where the units of a long line or sentence, whose words are held, end."""
    ends, first = [], 0
    for i in range(least, len(held) - least):
        if i - first >= least - 1 and zlib.crc32(held[i], zlib.crc32(held[i - 1])) % 8 == 0:
            first = i + 1
            ends.append(first)
    return [*ends, len(held)]


def texts_of_units(pieces: list[bytes], least: int) -> Iterator[tuple[int, int, list[bytes], int]]:
    """The units of a text in pieces and separators by turns: the first piece, the first beyond, the words, and for the
    units of a long piece the number of words before them in it, else -1."""
    short: list[bytes] = []
    begun = 0
    for i in range(0, len(pieces), 2):
        own = pieces[i].translate(LOWER).split()
        if len(own) < least:
            short += own
            if own and len(short) >= least and zlib.crc32(own[-1]) % 3:
                yield begun, i + 2, short, -1
                short, begun = [], i + 2
            continue
        if begun < i:
            yield begun, i, short, -1
            short = []
        begun = i + 2
        if len(own) <= LONG:
            yield i, begun, own, -1
        else:
            first = 0
            for end in shorter(own, least):
                yield i, begun, own[first:end], first
                first = end
    if begun < len(pieces):
        yield begun, len(pieces) + 1, short, -1


def unit_hashes(body: bytes, least: int = MIN_WORDS) -> tuple[list[int], list[int]]:
    """Hashes and numbers of words of the units that take part."""
    digest, words = xxhash.xxh64_intdigest, [w for *_, w, _ in texts_of_units(CUT.split(body), least) if len(w) >= least]
    return [digest(b" ".join(w)) - (1 << 63) for w in words], [len(w) for w in words]


def units(body: bytes, least: int = MIN_WORDS) -> tuple[list[bytes], list[int], list[int], list[int]]:
    """Units and separators by turns; of the units that take part: their indexes there, hashes and numbers of words."""
    pieces, parts, at = [*CUT.split(body), b""], [], []
    spans: list[tuple[int, int]] = []
    for i, end, words, before in texts_of_units(pieces[:-1], least):
        if len(words) >= least:
            at.append(len(parts))
        if before < 0:
            parts += [b"".join(pieces[i : end - 1]), pieces[end - 1]]
            continue
        piece = pieces[i]
        if before == 0:
            spans = [m.span() for m in WORD.finditer(piece)]
        first, beyond = spans[before][0] if before else 0, before + len(words)
        if beyond < len(spans):
            stop = spans[beyond - 1][1]
            parts += [piece[first:stop], piece[stop : spans[beyond][0]]]
        else:
            parts += [piece[first:], pieces[end - 1]]
    return parts, at, *unit_hashes(body, least)


def subsequence(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places in a and b of a longest common subsequence, in linear memory (Hirschberg); rows are vectors."""
    out, todo = [], [(0, len(a), 0, len(b))]
    x, y = np.array(a, np.int64), np.array(b, np.int64)

    def lengths(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        row = np.zeros(len(v) + 1, np.int64)
        for h in u:
            new = row.copy()
            new[1:] = np.maximum(row[1:], np.where(v == h, row[:-1] + 1, 0))
            row = np.maximum.accumulate(new)
        return row

    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        if a1 - a0 == 1:
            at = np.flatnonzero(y[b0:b1] == x[a0])
            if len(at):
                out.append((a0, b0 + int(at[0])))
            continue
        half = (a0 + a1) // 2
        k = b0 + int(np.argmax(lengths(x[a0:half], y[b0:b1]) + lengths(x[half:a1][::-1], y[b0:b1][::-1])[::-1]))
        todo += [(a0, half, b0, k), (half, a1, k, b1)]
    return sorted(out)


def patience(a: list[int], b: list[int]) -> list[int]:
    """Places of b that patience diff aligns with places of a."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append(b0)
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append(b1)
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {h: i for i, h in enumerate(a[a0:a1], a0) if in_a[h] == 1 == in_b[h]}
        tops, ends, back, pairs = [], [], [], [(place[h], j) for j, h in enumerate(b[b0:b1], b0) if h in place]
        for n, (i, _) in enumerate(pairs):
            k = bisect_left(tops, i)
            tops[k : k + 1], ends[k : k + 1] = [i], [n]
            back.append(ends[k - 1] if k else -1)
        n, chain = ends[-1] if ends else -1, []
        while n >= 0:
            chain.append(pairs[n])
            n = back[n]
        if chain:
            low = (a0, b0)
            for i, j in reversed(chain):
                found.append(j)
                todo.append((low[0], i, low[1], j))
                low = (i + 1, j + 1)
            todo.append((low[0], a1, low[1], b1))
        else:  # none is unique on both sides: exact, over the units that both have
            xs, ys = ([i for i, h in enumerate(s[lo:hi], lo) if in_a[h] and in_b[h]] for s, lo, hi in ((a, a0, a1), (b, b0, b1)))
            found += [ys[j] for _, j in subsequence([a[i] for i in xs], [b[j] for j in ys])]
    return sorted(found)


def aligned(a: list[int], at: list[int], b: list[int], places: list[int], sizes: list[int], min_block: int = MIN_BLOCK) -> list[int]:
    """Indexes in b that patience diff aligns with a, and those of every run of at least min_block words that stands
    unbroken in both. at and places are the units' places in their texts, sizes the words of b's units."""
    found, where = set(patience(a, b)), {}
    for i, h in enumerate(a):
        where.setdefault(h, []).append(i)
    if all(j in found or h not in where for j, h in enumerate(b)):
        return sorted(found)
    covered = range(0)
    before: dict[int, tuple[int, int]] = {}  # by the end in a: first index in b and words of the run that ends there
    for j, h in enumerate(b):
        if j and places[j] != places[j - 1] + 1:
            before = {}
        now = {}
        for i in where.get(h, ()):
            first, words = before.get(i - 1, (j, 0)) if i and at[i] == at[i - 1] + 1 else (j, 0)
            now[i] = first, words + sizes[j]
        first = min((f for f, words in now.values() if words >= min_block), default=None)
        if first is not None:
            found.update(range(j if first in covered and j == covered.stop else first, j + 1))
            covered = range(covered.start if first in covered and j == covered.stop else first, j + 1)
        before = now
    return sorted(found)


def blocks(place: np.ndarray, h: np.ndarray, size: np.ndarray, first: np.ndarray, at: list[np.ndarray], min_block: int) -> tuple[list[int], int, int]:
    """Places to delete, their words and the number of earlier documents aligned with, for a document's shared units, in
    the order of their places. first: numbers that tell the first holders apart; at: a unit's places in its first holder."""
    met, partners = np.zeros(len(place), bool), 0
    order = np.argsort(first, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(first[order])) + 1):
        there = [at[j] for j in own.tolist()]
        single = np.array([x[0] if len(x) == 1 else -1 for x in there])
        if single[0] >= 0 and (np.diff(single) > 0).all():  # all unique there and in the same order: patience diff aligns them
            met[own] = True
            partners += 1
            continue
        held = sorted({(p, k) for x, k in zip(there, h[own].tolist(), strict=True) for p in x.tolist()})
        found = aligned([k for _, k in held], [p for p, _ in held], h[own].tolist(), place[own].tolist(), size[own].tolist(), min_block)
        met[own[found]] = True
        partners += bool(found)
    kept = np.flatnonzero(met)
    run = np.cumsum(np.r_[0, np.diff(place[kept]) != 1]) if len(kept) else kept
    words = np.bincount(run, size[kept]) if len(kept) else np.zeros(0)
    gone = kept[words[run] >= min_block] if len(kept) else kept
    return place[gone].tolist(), int(size[gone].sum()), partners


def line_overlaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_block: int = MIN_BLOCK) -> DataFrame:
    """doc (struct of doc_id and text hash), places (of the units to delete, among those that take part), words (how many
    they hold), partners (number of earlier documents aligned with): a row for each document that loses something."""
    d = F.struct(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("t"))
    bodies = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(d.alias("d"), F.col(text_col).cast("binary").alias("body"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, sizes = [], []
        for body in batch.column("body").to_pylist():
            h, s = unit_hashes(body, min_words)
            hashes.append(h)
            sizes.append(s)
        return pa.RecordBatch.from_arrays([batch.column("d"), pa.array(hashes, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))], ["d", "h", "s"])

    # a number for each row goes through the joins instead of its id and text hash; they are looked up for what is shared
    listed = cut(map_batches(bodies, run, f"d {D}, h array<bigint>, s array<int>").withColumn("e", F.monotonically_increasing_id()))
    seen = listed.select(F.explode(F.array_distinct("h")).alias("h")).groupBy(F.bitwise_not("h").alias("w")).agg(F.count(F.lit(1)).alias("m"))
    placed = listed.select("e", F.posexplode(F.arrays_zip("h", "s")).alias("place", "u")).select("e", "place", F.col("u.h").alias("h"), F.col("u.s").alias("s"))
    often = cut(placed.join(anew(seen.where("m > 1"), "h").select("h"), "h"))
    often = cut(often.join(listed.select("e", "d"), "e").select("d", "place", "h", "s"))
    drop(listed)
    held = often.groupBy(F.bitwise_not("h").alias("w")).agg(F.min("d").alias("first"), F.max("d").alias("last")).where("first < last").select("w", "first")
    held = cut(often.join(anew(held, "h"), "h"))
    there = anew(held.where("d = first").groupBy(F.bitwise_not("h").alias("w")).agg(F.sort_array(F.collect_set("place")).alias("at")), "h")
    pairs = held.where("first < d").join(there, "h")
    # repeated rows are one document, so a unit is the same in each
    shared = pairs.groupBy("d").agg(F.collect_set(F.struct("place", "h", "s", "first", "at")).alias("u"))

    def align(batch: pa.RecordBatch) -> pa.RecordBatch:
        u = batch.column("u")
        ends, rows = (u.offsets.to_numpy() - u.offsets[0].as_py()).tolist(), u.flatten()
        place, h, size = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("place", "h", "s"))
        first = [rows.field("first").field(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "t")]
        _, first = np.unique(np.column_stack(first), axis=0, return_inverse=True)
        at = rows.field("at")
        values, at_ends = at.values.to_numpy(), at.offsets.to_numpy()
        out = []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            order = a + np.argsort(place[a:b], kind="stable")
            out.append(blocks(place[order], h[order], size[order], first[order], [values[at_ends[j] : at_ends[j + 1]] for j in order.tolist()], min_block))
        gone, words, partners = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([batch.column("d"), pa.array(gone, pa.list_(pa.int32())), pa.array(words, pa.int64()), pa.array(partners, pa.int64())], ["d", "places", "words", "partners"])

    return map_batches(shared, align, f"d {D}, places array<int>, words long, partners long").where(F.size("places") > 0)


def loss(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_block: int = MIN_BLOCK) -> DataFrame:
    """doc_id, n_removed (units deleted from the text), removed_words, n_partners: a row for every row of docs."""
    lost = cut(line_overlaps(docs, id_col, text_col, min_words, min_block))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("t"))
    lost = lost.select("d.doc_id", "d.t", F.size("places").alias("n_removed"), F.col("words").alias("removed_words"), F.col("partners").alias("n_partners"))
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_removed", "removed_words", "n_partners")]
    return rows.join(lost, ["doc_id", "t"], "left").select("doc_id", *numbers)


def without(body: bytes, places: list[int], min_words: int = MIN_WORDS) -> bytes:
    """The text without the units at these places, and without shorter units between two neighbouring ones."""
    parts, at, _, _ = units(body, min_words)
    gone, last = set(), None
    for p in places:
        gone.update(range(at[last] if last is not None and p == last + 1 else at[p], at[p] + 1, 2))
        last = p
    kept = [parts[i] + (parts[i + 1] if i + 1 < len(parts) else b"") for i in range(0, len(parts), 2) if i not in gone]
    return b"".join(kept).strip()


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = True, min_words: int = MIN_WORDS, min_block: int = MIN_BLOCK) -> DataFrame:
    """docs with the repeated blocks deleted from their texts; texts of which nothing is left go, if drop_emptied."""
    lost = cut(line_overlaps(docs, id_col, text_col, min_words, min_block)).select("d.doc_id", "d.t", "places")
    names, at, schema = docs.columns, docs.columns.index(text_col), docs.schema
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("t"))
    # only texts that lose something are shuffled, and few others
    key = F.xxhash64("doc_id", "t").alias("key")
    some, others = parted(rows.withColumn("key", key), "key", lost.select(key))
    joined = some.join(lost, ["doc_id", "t"], "left").select("row", "places")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = batch.column("row").flatten()
        texts, places = columns[at].to_pylist(), batch.column("places").to_pylist()
        texts = [t if p is None else without(t.encode(), p, min_words).decode() for t, p in zip(texts, places, strict=True)]
        if drop_emptied:
            stays = pa.array([p is None or t != "" for t, p in zip(texts, places, strict=True)], pa.bool_())
        made = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(columns)], names)
        return made.filter(stays) if drop_emptied else made

    return others.select("row.*").union(map_batches(joined, run, schema))

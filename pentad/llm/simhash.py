"""SimHash near-duplicate detection with pigeonhole blocks.

A text's A-Z become a-z; its words are the matches of ``[^\\x20\\x09-\\x0D]+``; its shingles three words joined by a
space, repeats included (fewer words: the whole sequence). A fingerprint bit is 1 if more than half of the shingles'
XXH64 values (seed 42) have it. Fingerprints that differ in at most 3 bits are linked.

The 64 bits are cut into six blocks. Two fingerprints within 3 bits differ in at most three blocks, so they agree on at
least three: they meet under one of the 20 choices of three blocks, keys of 31 to 33 bits. Equal fingerprints are one
node from the start. A key's fingerprints are split into chunks of bounded size, larger ones for larger keys, so that a
fingerprint goes to few places; every pair of chunks is compared in one place, and only a spanning forest of the links found there goes on. So a large group of near copies costs neither a
large task nor a row for each pair, and no link between different components is lost.

* Null, empty and blank texts have fingerprint zero and are linked like any other;
* repeated rows give a row each; rows with a null id get a fingerprint and their component's smallest id (null if it has
  none); an empty table gives an empty result;
* only the id and text columns are read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pentad.llm.common import LOWER, cut, map_batches, text_bytes
from pentad.llm.graph import anew, components, parted
from pentad.llm.near_copies import representatives

SEED, SHINGLE, MAX_BITS = 42, 3, 3
BLOCK_BITS = (11, 11, 11, 11, 10, 10)
#: Fingerprints of a chunk, and chunks of a key until chunks have their full size.
CHUNK, FULL_CHUNK, CHUNKS = 512, 8192, 64
#: The pipeline's rule for near copies: op8's three words and three bits bind that query alone.
KEEP_WIDTH, KEEP_SIMILARITY = 5, 0.8


def fingerprint(body: bytes, width: int = SHINGLE) -> int:
    """The fingerprint of a text's UTF-8 bytes."""
    words = body.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = ends - np.fromiter(map(len, words), np.int64, len(words)) - 1
    if len(words) > width:
        starts, ends = starts[: 1 - width], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, seed = xxhash.xxh64_intdigest, SEED
    total, n = np.zeros(64, np.int64), len(starts)
    for at in range(0, n, 1 << 16):
        pairs = zip(starts[at : at + (1 << 16)].tolist(), (ends[at : at + (1 << 16)] - 1).tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], seed) for a, b in pairs], np.uint64)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp: the fingerprint as a signed 64-bit integer."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(x) for x in batch.column("body").to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return map_batches(text_bytes(docs, id_col, text_col), run, "doc_id long, fp long")


def masks(bits: tuple[int, ...] = BLOCK_BITS, differing: int = MAX_BITS) -> list[int]:
    """A signed mask for every choice of the blocks that must agree."""
    starts = np.cumsum((0, *bits))
    blocks = [((1 << w) - 1) << int(s) for w, s in zip(bits, starts, strict=False)]
    every = [sum(c) for c in combinations(blocks, len(bits) - differing)]
    return [m - (1 << 64) if m >> 63 else m for m in every]


def spanning_links(low: np.ndarray, high: np.ndarray, most: int = MAX_BITS) -> list[tuple[int, int]]:
    """Links that connect what is connected among the fingerprints of both sides, at most one for each fingerprint. Every
    one found leaves the rest, so the work is quadratic only where hardly any are linked; memory is linear."""
    rest, found = np.concatenate((low, high)), []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            hit = np.bitwise_count(rest ^ at) <= most
            if hit.any():
                new, rest = rest[hit], rest[~hit]
                queue.extend(new)
                found += [(int(at), x) for x in new.tolist()]
    return found


def links(fps: DataFrame) -> DataFrame:
    """a, b: links that connect all distinct fingerprints fp which are connected by differences of at most 3 bits."""
    keyed = fps.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks()))).alias("c", "part"))
    keyed = keyed.select("fp", F.xxhash64("c", "part").alias("bucket"))
    sizes = anew(keyed.groupBy(F.bitwise_not("bucket").alias("w")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bucket")
    chunks = F.ceil(F.col("n") / F.greatest(F.lit(CHUNK), F.least(F.lit(FULL_CHUNK), F.col("n") / CHUNKS))).cast("int")
    held = keyed.join(sizes, "bucket").withColumn("k", chunks).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    lo, hi = F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi")
    paired = held.select("bucket", "fp", "mine", lo, hi).groupBy("bucket", "lo", "hi").agg(
        F.collect_list(F.when(F.col("mine") == F.col("lo"), F.col("fp"))).alias("a"),
        F.collect_list(F.when(F.col("mine") != F.col("lo"), F.col("fp"))).alias("b"),
    ).select("a", "b")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sides = [(c.values.to_numpy().view(np.uint64), c.offsets.to_numpy()) for c in (batch.column("a"), batch.column("b"))]
        (av, ao), (bv, bo) = sides
        found = []
        for i in range(batch.num_rows):
            found += spanning_links(av[ao[i] : ao[i + 1]], bv[bo[i] : bo[i + 1]])
        ends = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], ["a", "b"])

    return map_batches(paired, run, "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest id that links reach)."""
    marked = cut(fingerprints(docs, id_col, text_col))
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = cut(components(links(nodes.select("fp")), F.col("a"), F.col("b")))
    linked = nodes.join(roots, nodes["fp"] == roots["node"]).select("fp", "root", "least")
    best = anew(linked.groupBy(F.bitwise_not("root").alias("w")).agg(F.min("least").alias("component_id")), "root")
    moved = linked.select("fp", "root").join(best, "root").select("fp", "component_id")
    ids = cut(nodes.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    return marked.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = KEEP_WIDTH, similarity: float = KEEP_SIMILARITY) -> DataFrame:
    """docs without the near copies of another row: of each component of texts whose shingles of width words have a
    Jaccard similarity of at least similarity, one row with the smallest id stays (null ids come last, and of equal ids
    the smaller text hash first). Rows are told apart by id and text, so ids may repeat or be null. Fingerprints of such
    pairs differ by more bits than blocks can find, so candidates come from ``near_copies``."""
    names = ["no_id", "id", "t"]
    key = [F.col(id_col).isNull().alias("no_id"), F.coalesce(F.col(id_col), F.lit(0)).alias("id"), F.xxhash64(F.col(text_col)).alias("t")]
    kept = representatives(docs, key, width, similarity, text_col).select("least.*")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *key)
    # rows that stay and are not repeated pass by; the others, and few more, are told apart by joins
    stays = kept.withColumn("stays", F.lit(True))
    numbers = rows.groupBy(*(F.col(c) for c in names)).agg(F.count(F.lit(1)).alias("m")).join(stays, names, "left")
    hashed = F.xxhash64(*names).alias("key")
    some, others = parted(rows.withColumn("key", hashed), "key", numbers.where("m > 1 OR stays IS NULL").select(hashed))
    return others.select("row.*").union(some.dropDuplicates(names).join(kept, names, "left_semi").select("row.*"))

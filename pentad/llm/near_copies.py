"""Near copies by shared shingles, without misses.

A text's A-Z become a-z; its words are split at ASCII white space; its shingles are the distinct runs of ``width`` words
(fewer words: the whole sequence), kept as 64-bit hashes. Texts whose sets of shingles have a Jaccard similarity of at
least ``similarity`` are linked; links reach further, so a component may hold pairs that are less similar.

The sets' simhashes of 64 bits meet as in ``simhash.links`` (3 bits or fewer differ); what farther simhashes hide is found
by shared shingles. A pair is decided by its simhashes of 1024 bits where these are so much nearer or farther than the
similarity asks for that chance cannot explain it (six deviations), and else by its sets.

Texts with equal sets are one node. In any fixed order of all shingles, two sets of that similarity share one among the
first n - ceil(similarity * n) + 1 of each: these are a set's keys. The order puts shingles that a sample of the texts
repeats last, so that keys are rare; the sample has no bearing on the result. Every key's nodes are first compared with
a centre, which joins most groups in a linear number of pairs. Of keys that still hold several components, all pairs of
nodes of different components are compared in chunks of bounded size, by simhashes or, where a text is too short for these,
by sets. What goes on is not the pairs, which may be as many as the square of a key's nodes, but rows that connect the
nodes found similar and, for each node of a pair that simhashes leave open, one that ties it to others: a family is what
these tie together, and holds every similar pair that is left. Families' nodes are compared in place, in chunks of bounded size, by
simhashes and where these leave it open by sets, which are made again from the texts.

Null, empty and blank texts have no shingles and are one node.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pentad.llm.common import LOWER, cut, drop, map_batches
from pentad.llm.graph import anew, components, parted

CHUNK, CENTRES = 512, 8
SAMPLE_ROWS, COMMON = 2000, 100_000
EPS = 1e-9
#: 64-bit words of the simhash that decides pairs, and shingles from which on its bits are as good as normal; deviations
#: that chance does not reach, and what is added for bits that are not quite normal.
SKETCH, SKETCH_FROM, DEVIATIONS, SLACK = 16, 64, 6, 0.02
#: Shingles that sets have in common, counted at a time.
COLUMNS = 4096
#: Shingles whose bits are counted in bytes.
LANE = 255
#: Shingles of a chunk of sets.
SHINGLES = 1 << 16
#: Sets of a chunk that are compared with another's at a time.
ROWS = 64


def shingles(body: bytes, width: int) -> np.ndarray:
    """The distinct shingles' hashes, rising."""
    words = body.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.int64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(w) - width + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(width, len(w))):
        h = (h ^ w[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h.view(np.int64))


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - EPS


def keys(held: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The shingles of a set of which any similar set has one among its own; common rises."""
    n = len(held)
    at = np.searchsorted(common, held)
    late = common[np.minimum(at, len(common) - 1)] == held if len(common) else np.zeros(n, bool)
    return np.concatenate((held[~late], held[late]))[: n - math.ceil(similarity * n - EPS) + 1]


def common_shingles(bodies: DataFrame, width: int) -> np.ndarray:
    """Shingles that a sample of the texts repeats. Serves speed alone."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingles(t, width) for t in batch.column("body").to_pylist()]))], ["h"])

    few = bodies.select("body").limit(SAMPLE_ROWS).distinct()
    seen = map_batches(few, run, "h long").groupBy("h").count().where("count > 2")
    return np.sort(np.array([r["h"] for r in seen.orderBy(F.desc("count"), "h").limit(COMMON).collect()], np.int64))


def number(held: np.ndarray) -> int:
    """The node of a set of shingles."""
    return xxhash.xxh3_64_intdigest(held.tobytes()) - (1 << 63)


def simhash_of(held: np.ndarray, words: int = 1) -> np.ndarray:
    """Bits that more than half of the shingles' hashes have, 64 for each word, as bytes."""
    ones, seeds = np.zeros(64 * words, np.int32), np.arange(words, dtype=np.uint64)
    for at in range(0, len(held), LANE):  # bits become bytes of 64-bit words, so that eight are counted at once
        h = (held[at : at + LANE].view(np.uint64)[:, None] + seeds) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        ones += np.unpackbits(h.view(np.uint8).ravel()).view(np.uint64).reshape(len(h), -1).sum(axis=0).view(np.uint8)
    return np.packbits(ones * 2 > len(held))


def bounds(m: np.ndarray, n: np.ndarray, similarity: float, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The share of a simhash's bits in which sets of m and n shingles differ at that similarity, and how far from it chance
    does not reach."""
    needed = similarity / (1 + similarity) * (m + n) / np.sqrt(m * n)
    limit = np.arccos(np.minimum(needed, 1)) / np.pi
    return limit, DEVIATIONS * np.sqrt(np.maximum(limit * (1 - limit), 0.01) / (64 * words)) + SLACK


def told_apart(m: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray, p: np.ndarray, q: np.ndarray, similarity: float) -> np.ndarray:
    """For pairs of sets of m and n shingles, whose sketches are x[p] and y[q]: 2 similar, 0 not, 1 for sets to decide."""
    kinds = np.ones(len(p), np.int8)
    for at in range(0, len(p), 1 << 14):
        own = slice(at, at + (1 << 14))
        long = at + np.flatnonzero(np.minimum(m[own], n[own]) >= SKETCH_FROM)
        limit, room = bounds(m[long].astype(np.float64), n[long].astype(np.float64), similarity, SKETCH)
        apart = np.bitwise_count(x[p[long]] ^ y[q[long]]).sum(axis=1) / (64 * SKETCH)
        kinds[long] = np.where(apart < limit - room, 2, np.where(apart > limit + room, 0, 1))
    return kinds


def shared(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many values each set of x has in common with each of y."""
    values, at = np.unique(np.concatenate(x + y), return_inverse=True)
    again = np.bincount(at) > 1
    column, row = np.cumsum(again) - 1, np.repeat(np.arange(len(x) + len(y)), [len(v) for v in x + y])
    row, at = row[again[at]], column[at[again[at]]]
    out = np.zeros((len(x), len(y)), np.float32)
    for first in range(0, int(again.sum()), COLUMNS):
        own = (at >= first) & (at < first + COLUMNS)
        held = np.zeros((len(x) + len(y), min(COLUMNS, len(values) - first)), np.float32)
        held[row[own], at[own] - first] = 1
        out += held[: len(x)] @ held[len(x) :].T
    return out


def short_alike(a: list, b: list, p: np.ndarray, q: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the sets of a (their sizes, sets) and b at the places p and q are similar."""
    (i, p), (j, q) = np.unique(p, return_inverse=True), np.unique(q, return_inverse=True)
    both = shared([a[1][k] for k in i], [b[1][k] for k in j])[p, q]
    return both >= similarity * (a[0][i][p] + b[0][j][q] - both.astype(np.float64)) - EPS


def lowest(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The lowest of the numbers below n that the pairs p, q connect each of them with."""
    now = np.arange(n)
    while len(p):
        low = np.minimum(now[p], now[q])
        new = now.copy()
        np.minimum.at(new, p, low)
        np.minimum.at(new, q, low)
        new = new[new]
        if (new == now).all():
            break
        now = new
    return now


def chunks(rows: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """same, x, y: for each two of the k chunks of the rows with equal columns by, those of the one and of the other; every
    pair of rows stands in one of these, where both sides are the same chunk (x alone) or differ."""
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("k")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    lo, hi, row = F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), F.struct(*fields)
    return rows.select(*by, *fields, "mine", lo, hi).groupBy(*by, "lo", "hi").agg(
        F.collect_list(F.when(F.col("mine") == F.col("lo"), row)).alias("x"), F.collect_list(F.when(F.col("mine") != F.col("lo"), row)).alias("y")
    ).select((F.col("lo") == F.col("hi")).alias("same"), "x", "y")


def sides(batch: pa.RecordBatch, fields: tuple[str, ...]) -> Iterator[tuple[list, list, bool]]:
    """The fields of both sides of every row of chunks, with sketches as a matrix at the end, where there are any."""

    def side(name: str) -> tuple[np.ndarray, list]:
        c = batch.column(name)
        rows = c.flatten()
        columns: list = [rows.field(f) for f in fields]
        columns = [v if pa.types.is_list(v.type) else v.to_numpy(zero_copy_only=False) for v in columns]
        if rows.type.get_field_index("sketch") >= 0:
            made = rows.field("sketch").to_pylist()
            columns.append(np.frombuffer(b"".join(z or bytes(8 * SKETCH) for z in made), np.uint64).reshape(-1, SKETCH))
        return c.offsets.to_numpy() - c.offsets[0].as_py(), columns

    def cutout(columns: list, lo: int, hi: int) -> list:
        lists = (pa.ListArray, pa.LargeListArray)
        return [[x.values.to_numpy() for x in v[lo:hi]] if isinstance(v, lists) else v[lo:hi] for v in columns]

    (xo, x), (yo, y) = side("x"), side("y")
    for i, same in enumerate(batch.column("same").to_pylist()):
        a = cutout(x, xo[i], xo[i + 1])
        yield a, a if same else cutout(y, yo[i], yo[i + 1]), same


def texts_of(bodies: DataFrame, wanted: DataFrame, nodes: DataFrame | None) -> DataFrame:
    """Bodies among which there is a text of every wanted node (node, one row for each), and few others where nodes has the
    hash b of a text of each."""
    if nodes is None:
        return bodies.select("body")
    return parted(bodies.select("body", "b"), "b", nodes.join(wanted, "node").select("b"))[0].select("body")


def sketches_of(bodies: DataFrame, wanted: DataFrame, width: int, nodes: DataFrame | None = None) -> DataFrame:
    """node, n (its shingles), sketch (its simhash) for the wanted nodes (node, one row for each)."""
    wanted = cut(wanted)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = [shingles(t, width) for t in batch.column("body").to_pylist()]
        made = [simhash_of(h, SKETCH).tobytes() if len(h) >= SKETCH_FROM else b"" for h in held]
        return pa.RecordBatch.from_arrays([pa.array(map(number, held), pa.int64()), pa.array(map(len, held), pa.int32()), pa.array(made, pa.binary())], ["node", "n", "sketch"])

    found = map_batches(texts_of(bodies, wanted, nodes), run, "node long, n int, sketch binary").join(wanted, "node", "left_semi")
    return cut(found.groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")))


def decided(pairs: DataFrame, sketches: DataFrame, bodies: DataFrame, similarity: float, width: int, nodes: DataFrame | None = None) -> DataFrame:
    """The pairs a, b of nodes that are similar: by simhashes, and by sets where these are close to the limit or short."""
    sides = pairs.join(sketches.toDF("a", "m", "x"), "a").join(sketches.toDF("b", "n", "y"), "b").select("a", "b", "m", "n", "x", "y")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, n = (batch.column(c).to_numpy() for c in ("m", "n"))
        x, y = (np.frombuffer(b"".join(z or bytes(8 * SKETCH) for z in batch.column(c).to_pylist()), np.uint64).reshape(-1, SKETCH) for c in ("x", "y"))
        every = np.arange(len(m))
        kinds = told_apart(m, n, x, y, every, every, similarity).astype(np.int32)
        return pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(kinds)], ["a", "b", "kind"])

    told = cut(map_batches(sides, run, "a long, b long, kind int").where("kind > 0"))
    close = told.where("kind = 1").select("a", "b")
    sets = sets_of(bodies, close.select(F.explode(F.array("a", "b")).alias("node")).distinct(), width, nodes)
    sure = cut(told.where("kind = 2").select("a", "b").unionByName(verified(close, sets, similarity)))
    drop(sets, told)
    return sure


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """a, b: pairs that connect all nodes (node, fp) whose simhashes are connected by differences of at most 3 bits."""
    from pentad.llm.simhash import links

    first = cut(nodes.groupBy(F.bitwise_not("fp").alias("w")).agg(F.min("node").alias("first")))
    first = anew(first, "fp").select("fp", "first")
    same = nodes.join(first, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    far = links(first.select("fp")).toDF("p", "q")
    far = far.join(first.toDF("p", "u"), "p").join(first.toDF("q", "v"), "q").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    return same.unionByName(far)


def sets_of(bodies: DataFrame, wanted: DataFrame, width: int, nodes: DataFrame | None = None) -> DataFrame:
    """node, held for the wanted nodes (node, one row for each)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = [shingles(t, width) for t in batch.column("body").to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(map(number, held), pa.int64()), pa.array(held, pa.list_(pa.int64()))], ["node", "held"])

    wanted = cut(wanted)
    made = map_batches(texts_of(bodies, wanted, nodes), run, "node long, held array<bigint>")
    return cut(made.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("held").alias("held")))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b of nodes that are similar. Sets of 32-bit hashes, half as large, decide all pairs but those close to
    the limit, which meet with their whole hashes."""
    narrow = sets.select("node", F.transform("held", lambda h: h.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("x"))
    sides = pairs.join(narrow.toDF("a", "x"), "a").join(narrow.toDF("b", "y"), "b").select("a", "b", "x", "y")

    def quick(batch: pa.RecordBatch) -> pa.RecordBatch:
        (xv, xo), (yv, yo) = ((c.values.to_numpy(), c.offsets.to_numpy()) for c in (batch.column("x"), batch.column("y")))
        kinds = []
        for i in range(batch.num_rows):
            x, y = xv[xo[i] : xo[i + 1]], yv[yo[i] : yo[i + 1]]
            u, v = np.unique(x), np.unique(y)
            both, slack = len(np.intersect1d(u, v, assume_unique=True)), 4 + len(x) - len(u) + len(y) - len(v)
            needed = similarity / (1 + similarity) * (len(x) + len(y))
            kinds.append(2 if both - slack >= needed else 1 if both + slack >= needed else 0)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b")), pa.array(kinds, pa.int32())], ["a", "b", "kind"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        (xv, xo), (yv, yo) = ((c.values.to_numpy(), c.offsets.to_numpy()) for c in (batch.column("x"), batch.column("y")))
        keep = [alike(xv[xo[i] : xo[i + 1]], yv[yo[i] : yo[i + 1]], similarity) for i in range(batch.num_rows)]
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    told = cut(map_batches(sides, quick, "a long, b long, kind int").where("kind > 0"))
    close = told.where("kind = 1").select("a", "b").join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return cut(told.where("kind = 2").select("a", "b").unionByName(map_batches(close, run, "a long, b long")))


def similar_nodes(nodes: DataFrame, bodies: DataFrame, similarity: float, width: int) -> DataFrame:
    """node, root for each node of nodes (node, n, fp, keys, sketch, held) that is linked to another."""
    keyed = nodes.select("node", "n", F.posexplode("keys").alias("i", "key"))
    seen = keyed.select("key").groupBy(F.bitwise_not("key").alias("w")).agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    often = cut(keyed.join(anew(seen, "key").select("key"), "key"))
    centre = F.min(F.struct(F.xxhash64(F.pmod("key", F.lit(CENTRES)), "node"), F.col("node").alias("node"), F.col("n").alias("n"), F.col("i").alias("i"))).alias("c")
    shared = often.groupBy(F.bitwise_not("key").alias("w")).agg(centre)
    shared = anew(shared, "key").select("key", F.col("c.node").alias("centre"), F.col("c.n").alias("cn"), F.col("c.i").alias("ci"))
    held = often.join(shared, "key")
    # At a pair's first common key, what both have from there on must hold all that they share.
    share = similarity / (1 + similarity)
    fits = F.least(F.col("n") - F.col("i"), F.col("cn") - F.col("ci")) >= share * (F.col("n") + F.col("cn")) - EPS
    stars = held.where((F.col("node") != F.col("centre")) & fits).select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    stars = cut(stars.unionByName(simhash_pairs(nodes.where("n > 0").select("node", "fp"))).distinct())
    sketches = nodes.select("node", "n", "sketch")
    sure = decided(stars, sketches, bodies, similarity, width, nodes)
    roots = cut(components(sure, F.col("a"), F.col("b")))
    ids = cut(often.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    open_keys = ids.groupBy(F.bitwise_not("key").alias("w")).agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("m")).where("r0 <> r1")
    open_keys = anew(open_keys, "key").select("key", F.ceil(F.col("m") / CHUNK).cast("int").alias("k"))
    ids = cut(ids.join(open_keys, "key"))
    drop(often)

    def tied(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for a, b, same in sides(batch, ("node", "root", "n", "i", "held")):
            after = np.minimum((a[2] - a[3])[:, None], (b[2] - b[3])[None, :])
            p, q = np.nonzero((a[1][:, None] != b[1][None, :]) & (after >= share * (a[2][:, None] + b[2][None, :]) - EPS))
            fit = np.minimum(a[2][p], b[2][q]) >= similarity * np.maximum(a[2][p], b[2][q]) - EPS
            fit &= (p < q) | (not same)
            p, q = p[fit], q[fit]
            if not len(p):
                continue
            kinds = told_apart(a[2][p], b[2][q], a[-1], b[-1], p, q, similarity)
            short = np.flatnonzero(np.minimum(a[2][p], b[2][q]) < SKETCH_FROM)
            if len(short):
                kinds[short] = 2 * short_alike([a[2], a[4]], [b[2], b[4]], p[short], q[short], similarity)
            names, at = np.unique(np.concatenate((a[0][p], b[0][q]))[np.tile(kinds > 0, 2)], return_inverse=True)
            p, q, kinds = at[: len(at) // 2], at[len(at) // 2 :], kinds[kinds > 0]
            linked = lowest(len(names), p[kinds == 2], q[kinds == 2])
            left = (kinds == 1) & (linked[p] != linked[q])
            out += [np.c_[names, names[linked], np.ones(len(names), np.int64)], np.c_[names, names[lowest(len(names), p[left], q[left])], np.zeros(len(names), np.int64)]]
        ends = np.unique(np.concatenate([np.zeros((0, 3), np.int64), *out]), axis=0)
        ends = ends[ends[:, 0] != ends[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(ends[:, k].copy()) for k in range(3)], ["a", "b", "sure"])

    ids = cut(ids.join(nodes.select("node", "sketch", "held"), "node"))
    edges = cut(map_batches(chunks(ids, ["key"], ["node", "root", "n", "i", "sketch", "held"]), tied, "a long, b long, sure long").distinct())
    drop(ids)
    sure = cut(sure.unionByName(edges.where("sure = 1").select("a", "b")))
    open_ = edges.where("sure = 0")
    if open_.limit(1).count():
        roots = cut(components(sure, F.col("a"), F.col("b")))
        families = cut(components(open_, F.col("a"), F.col("b")).toDF("node", "family"))
        sure = cut(sure.unionByName(links_within(families, roots, sketches, bodies, similarity, width, nodes)))
    return components(sure, F.col("a"), F.col("b"))


def links_within(families: DataFrame, roots: DataFrame, sketches: DataFrame, bodies: DataFrame, similarity: float, width: int, nodes: DataFrame) -> DataFrame:
    """a, b: links that connect what is similar among each family's nodes (node, family), besides what roots has connected.
    All pairs are compared in place, by simhashes and else by sets; pairs never become rows."""
    sets = sets_of(bodies, families.select("node"), width, nodes)
    held = families.join(sets, "node").join(sketches.select("node", "n", "sketch"), "node").join(roots, "node", "left")
    held = cut(held.withColumn("root", F.coalesce("root", "node")))
    sizes = anew(held.groupBy(F.bitwise_not("family").alias("w")).agg(F.ceil(F.sum("n") / SHINGLES).cast("int").alias("k")), "family")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for a, b, same in sides(batch, ("node", "root", "n", "held")):
            some = []
            for at in range(0, len(a[1]), ROWS):  # few rows at a time: most pairs go at once
                u, v = (c[at : at + ROWS, None] for c in (a[1], a[2]))
                p, q = np.nonzero((u != b[1]) & (np.minimum(v, b[2]) >= similarity * np.maximum(v, b[2]) - EPS))
                p, q = (p[p + at < q] + at, q[p + at < q]) if same else (p + at, q)
                kinds = told_apart(a[2][p], b[2][q], a[-1], b[-1], p, q, similarity)
                some.append((p[kinds > 0], q[kinds > 0], kinds[kinds > 0]))
            p, q, kinds = map(np.concatenate, zip(*some, strict=True)) if some else (np.zeros(0, int),) * 3
            parent: dict[int, int] = {}

            def find(x: int, parent: dict[int, int] = parent) -> int:
                while (up := parent.setdefault(x, x)) != x:
                    x = parent[x] = parent[up]
                return x

            order = np.argsort(-kinds, kind="stable")  # what simhashes link comes first; who is linked need not be compared
            for i, j, kind in zip(p[order].tolist(), q[order].tolist(), kinds[order].tolist(), strict=True):
                u, v = find(int(a[1][i])), find(int(b[1][j]))
                if u != v and (kind == 2 or alike(a[3][i], b[3][j], similarity)):
                    parent[u] = v
                    out.append((int(a[0][i]), int(b[0][j])))
        ends = np.array(out, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], ["a", "b"])

    found = cut(map_batches(chunks(held.join(sizes, "family"), ["family"], ["node", "root", "n", "held", "sketch"]), run, "a long, b long"))
    drop(sets, held)
    return found


def representatives(docs: DataFrame, row: list, width: int, similarity: float, text_col: str) -> DataFrame:
    """The least struct of the columns row in each component of similar texts, as the column least."""
    named = docs.select(F.struct(*row).alias("row"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("body"))
    named = named.withColumn("b", F.xxhash64("body"))
    common = common_shingles(named, width)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = [shingles(t, width) for t in batch.column("body").to_pylist()]
        lists = pa.array([keys(h, common, similarity) if len(h) else h for h in held], pa.list_(pa.int64()))
        sizes = pa.array([len(h) for h in held], pa.int32())
        fps = pa.array([simhash_of(h).view(np.int64)[0] for h in held], pa.int64())
        sketches = pa.array([simhash_of(h, SKETCH).tobytes() if len(h) >= SKETCH_FROM else b"" for h in held], pa.binary())
        short = pa.array([h if len(h) * similarity <= SKETCH_FROM else h[:0] for h in held], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column("row"), batch.column("b"), pa.array(map(number, held), pa.int64()), sizes, fps, lists, sketches, short], ["row", "b", "node", "n", "fp", "keys", "sketch", "held"])

    kind = named.schema["row"].dataType.simpleString()
    marked = map_batches(named, run, f"row {kind}, b long, node long, n int, fp long, keys array<bigint>, sketch binary, held array<bigint>")
    nodes = cut(marked.groupBy("node").agg(F.min("row").alias("least"), *(F.first(c).alias(c) for c in ("b", "n", "fp", "keys", "sketch", "held"))))
    roots = cut(similar_nodes(nodes, named, similarity, width))
    linked = nodes.select("node", "least").join(roots, "node", "left")
    return cut(linked.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("least").alias("least")).select("least"))

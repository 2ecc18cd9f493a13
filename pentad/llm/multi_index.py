"""Approximate nearest neighbours by inner product with an inverted multi-index.

Inner product becomes Euclidean distance by one more component, sqrt(M^2 - |x|^2), for the largest norm M (0 for
queries). The two halves of the vectors are quantised separately: two codebooks of K centroids, fitted by Lloyd's method
on a bounded sample, give K * K cells, and every row is indexed in its cell. A query walks the pairs of centroids in the
order of their summed distance with a heap until the cells met hold the wanted number of entries; then its entries are
reranked by the exact inner product of the original vectors.

The walk needs the codebooks and the K * K cell sizes, of fixed number whatever the input. Neighbouring cells make up
shards of bounded size; a cell that is larger stands in several. A query goes to the shards that its walk meets, with the
cells it meets there, and is multiplied with their entries alone.

* Rows with a null id, or vectors null, empty, zero or holding null or non-finite components, or of another than the
  commonest length, take no part;
* repeated rows are candidates of their own; a repeated query id asks once, with the smallest of its vectors; rows with
  the query's id are its own and no candidates;
* ties go to the smaller id; a query with fewer candidates than k gets all; an empty table gives an empty result;
* only the id and vector columns are read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pentad.llm.common import blobs, cut, finite_vector, main_dimension, map_batches, matrix

SAMPLE, CENTROIDS, ROUNDS = 8192, 32, 12
#: A walk ends when its cells hold this share of all rows, and no fewer than LEAST rows. Vectors without structure, as
#: those of the tests are, spread a query's neighbours over most cells; clustered ones need a far smaller share.
SHARE, LEAST = 0.65, 100
QUERY_BLOCK, SHARD, LEAST_SHARDS = 4096, 16384, 24


def lloyd(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Centroids by Lloyd's method, seeded with rows spread over the sample; an empty cluster keeps its centroid."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        at = nearest(x, c)
        sums, n = np.zeros_like(c), np.bincount(at, minlength=len(c))
        np.add.at(sums, at, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return distances(x, c).argmin(1)


def walk(first: np.ndarray, second: np.ndarray, held: np.ndarray, wanted: int) -> list[int]:
    """Cells in the order of summed distance, by a heap, until they hold the wanted number of entries."""
    a, b = first.argsort(kind="stable"), second.argsort(kind="stable")
    fa, sb = first[a].tolist(), second[b].tolist()
    a, b, k = a.tolist(), b.tolist(), len(second)
    sizes = held.tolist()
    heap, seen, cells, got = [(fa[0] + sb[0], 0, 0)], {(0, 0)}, [], 0
    while heap and got < wanted:
        _, i, j = heapq.heappop(heap)
        cell = a[i] * k + b[j]
        if sizes[cell]:
            cells.append(cell)
            got += sizes[cell]
        for n in ((i + 1, j), (i, j + 1)):
            if n[0] < len(fa) and n[1] < k and n not in seen:
                seen.add(n)
                heapq.heappush(heap, (fa[n[0]] + sb[n[1]], *n))
    return cells


def shards_of(held: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """By cell: its first shard, and how many it stands in. Cells follow each other into a shard until it is full; a cell
    larger than a shard has as many of its own as it needs."""
    first, many, now, room = np.zeros(len(held), np.int64), np.ones(len(held), np.int64), 0, size
    for c, n in enumerate(held.tolist()):
        if n > room and room < size:
            now, room = now + 1, size
        first[c], many[c] = now, max(1, -(-n // size))
        if n >= size:
            now, room = now + int(many[c]), size
        else:
            room -= n
    return first, many


def search_shard(q, q_ids, walks, x, x_ids, x_cells, k):
    """The k best entries of the shard for each query among the cells of its walk, and the number of products made: a
    query meets the entries of its cells alone."""
    order = np.argsort(x_cells, kind="stable")
    x, x_ids, cells = x[order], x_ids[order], x_cells[order]
    starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
    spans = {int(cells[a]): slice(a, b) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(cells)], strict=True)}
    out, products = [], 0
    for at in range(0, len(q), 512):
        part, asked = q[at : at + 512], {}
        scores = np.full((len(part), len(x)), -np.inf)
        for r, walk_cells in enumerate(walks[at : at + 512]):
            for c in walk_cells.tolist():
                asked.setdefault(c, []).append(r)
        for c, rows in asked.items():
            if c in spans:
                scores[rows, spans[c]] = part[rows] @ x[spans[c]].T
                products += len(rows) * (spans[c].stop - spans[c].start)
        scores[q_ids[at : at + 512, None] == x_ids[None, :]] = -np.inf
        for r, row in enumerate(scores):
            i = at + r
            rows = np.flatnonzero(row > -np.inf)
            fast = row[rows]
            if len(rows) > k:  # rounding in the fast product must not decide: close ones stay in
                rows = rows[fast >= np.partition(fast, -k)[-k] - 1e-9 * (1 + np.abs(fast).max())]
            exact = (x[rows] * q[i]).sum(1)
            keep = np.lexsort((x_ids[rows], -exact))[:k]
            out.append((np.full(len(keep), q_ids[i]), x_ids[rows[keep]], exact[keep]))
    return [np.concatenate(c) for c in zip(*out, strict=True)], products


def multi_index_search(
    vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", centroids: int = CENTROIDS,
    share: float = SHARE, least: int = LEAST, sample: int = SAMPLE,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k entries of largest inner product that each query's walk meets.

    The index is fitted on ``sample`` rows, in an order given by a hash, and holds every row."""
    schema = "query_id long, rank int, vec_id long, score double"
    ok = vectors.where(F.col(id_col).isNotNull() & finite_vector(vec_col)).where(F.exists(vec_col, lambda x: x != 0))
    rows = ok.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    d = main_dimension(rows, "vec")
    if d == 0:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size("vec") == d)
    queries = ok.where(is_query).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where(F.size("vec") == d)
    queries = queries.groupBy("id").agg(F.min("vec").alias("vec"))
    norm2 = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    n, most = rows.agg(F.count(F.lit(1)), F.max(norm2)).first()
    seen = np.array([r["vec"] for r in rows.orderBy(F.xxhash64("id"), "id", "vec").limit(sample).collect()])
    half = d // 2

    def widened(x: np.ndarray, query: bool) -> tuple[np.ndarray, np.ndarray]:
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(most - (x * x).sum(1), 0))
        return x[:, :half], np.c_[x[:, half:], more]

    low, high = widened(seen, False)
    books = lloyd(low, centroids, ROUNDS), lloyd(high, centroids, ROUNDS)
    width = len(books[1])

    def indexed(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = matrix(batch.column("vec"), np.float64, d)
        a, b = widened(x, False)
        cell = nearest(a, books[0]) * width + nearest(b, books[1])
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cell.astype(np.int32)), blobs(x)], ["id", "cell", "vec"])

    index = cut(map_batches(rows, indexed, "id long, cell int, vec binary"))
    held = np.zeros(len(books[0]) * width, np.int64)
    for r in index.groupBy("cell").count().collect():  # K * K rows at most
        held[r["cell"]] = r["count"]
    wanted = max(least, int(np.ceil(share * n)))
    size = max(1, min(SHARD, -(-n // LEAST_SHARDS)))
    first, many = shards_of(held, size)
    q_blocks = max(1, -(-queries.count() // QUERY_BLOCK))

    def walked(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = matrix(batch.column("vec"), np.float64, d)
        a, b = widened(x, True)
        a, b = distances(a, books[0]), distances(b, books[1])
        at, shard, cells = [], [], []
        for i in range(len(x)):
            met = np.sort(np.array(walk(a[i], b[i], held, wanted), np.int32))  # cells in order are shards in order
            copies = many[met]
            there = np.repeat(first[met] - np.cumsum(copies) + copies, copies) + np.arange(copies.sum())
            met = np.repeat(met, copies)
            order = np.argsort(there, kind="stable")
            met, there = met[order], there[order]
            for part in np.split(np.arange(len(met)), np.flatnonzero(np.diff(there)) + 1) if len(met) else []:
                at.append(i)
                shard.append(int(there[part[0]]))
                cells.append(met[part].tobytes())
        at = np.array(at, np.int64)
        return pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), blobs(x[at]) if len(at) else pa.array([], pa.binary()), pa.array(shard, pa.int64()), pa.array(cells, pa.binary())], ["id", "vec", "shard", "cells"])

    block = F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int")
    asked = map_batches(queries.repartition(LEAST_SHARDS, "id"), walked, "id long, vec binary, shard long, cells binary").withColumn("qb", block)

    def placed(batch: pa.RecordBatch) -> pa.RecordBatch:
        cell, ids = batch.column("cell").to_numpy(), batch.column("id").to_numpy().view(np.uint64)
        mixed = (ids ^ (ids >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
        shard = first[cell] + (mixed % many[cell].astype(np.uint64)).astype(np.int64)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "cell", "vec")), pa.array(shard)], ["id", "cell", "vec", "shard"])

    entries = map_batches(index, placed, "id long, cell int, vec binary, shard long")
    entries = entries.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names)
        walks = [np.frombuffer(x, np.int32) for x in a["cells"].to_pylist()]
        found, _ = search_shard(matrix(a["vec"], np.float64, d), a["id"].to_numpy(), walks, matrix(b["vec"], np.float64, d), b["id"].to_numpy(), b["cell"].to_numpy(), k)
        return pa.table(found, names)

    found = asked.groupBy("qb", "shard").cogroup(entries.groupBy("qb", "shard")).applyInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

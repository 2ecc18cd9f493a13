"""Exact top-k search by inner product with pivot tables.

Each vector's distances to a fixed set of pivots are computed once. For a query q and a vector x, every pivot p gives
|d(q,p) - d(x,p)| <= d(q,x); the largest of these lower bounds turns into an upper bound of the inner product,
(|q|^2 + |x|^2 - bound^2) / 2. Inside a block, candidates are evaluated in the order of that bound, and evaluation stops
as soon as no bound reaches the k-th score known. Scores are exact integers.

Queries and candidates meet in blocks of bounded size: a block pair is one group, whatever the input's size, and both
kinds of blocks are dealt by hash, so no key gathers rows. Rows with a component of WIDE and more, whose products doubles
could round, have blocks of their own, where the candidates that bounds leave are scored in Python's integers.

* Rows with a null id, or vectors null, empty, or holding null or non-finite components (multiplied by scale too) take no
  part, nor do vectors of another than the commonest length, which have no inner product with the others;
* scores beyond 64 bits rank by their value and are returned as the nearest number of 64 bits;
* repeated rows are candidates of their own; a repeated query id asks once, with the smallest of its vectors; rows with
  the query's id are its own and no candidates;
* ties go to the smaller id; fewer candidates than k are all returned; an empty table gives an empty result;
* only the id and vector columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pentad.llm.common import blobs, finite_vector, main_dimension, map_batches, matrix

#: Rows that pivots are chosen from; the same rows give each query its first threshold.
SAMPLE = 1024
PIVOTS = 32
QUERY_BLOCK, CANDIDATE_BLOCK, LEAST_BLOCKS = 8192, 8192, 64
#: From this component on, rows have blocks of their own.
WIDE, WIDE_BLOCK = 2048.0, 512
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """id, wide and vec: floor(scale * component), whole doubles, for the vectors that take part."""
    ok = df.where(F.col(id_col).isNotNull() & finite_vector(vec_col)).where(F.forall(vec_col, lambda x: F.abs(x.cast("double") * scale) < float("inf")))
    ok = ok.withColumn("wide", F.exists(vec_col, lambda x: F.abs(x) >= WIDE))

    def floor(x: Column) -> Column:
        # from 2^53 on doubles are whole as they are, and Spark's floor would turn them to 64 bits
        y = x.cast("double") * F.lit(float(scale))
        return F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)

    return ok.select(F.col(id_col).cast("long").alias("id"), "wide", F.transform(vec_col, floor).alias("vec"))


def choose_pivots(rows: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first: each pivot is the row farthest from those chosen before."""
    chosen = [0]
    far = ((rows - rows[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(rows)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((rows - rows[chosen[-1]]) ** 2).sum(1))
    return rows[chosen]


def kth_of_sample(q: np.ndarray, q_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """A score that at least k candidates in the sample reach, for each query."""
    if len(rows) <= k:
        return np.full(len(q), -np.inf)
    scores = q @ rows.T
    scores[q_ids[:, None] == ids[None, :]] = -np.inf
    return np.partition(scores, -k, axis=1)[:, -k]


def search_wide(q, q_ids, q_far, x, x_ids, x_far, k):
    """Like search_block, for vectors of any size: scores are Python's integers."""
    whole_q, whole_x = ([[int(v) for v in row] for row in rows.tolist()] for rows in (q, x))
    out = ([], [], [])
    with np.errstate(all="ignore"):
        x2 = (x * x).sum(1)
        for i, mine in enumerate(whole_q):
            low = np.nan_to_num(np.abs(q_far[i] - x_far), nan=0.0, posinf=0.0).max(1)
            squares = (q[i] * q[i]).sum() + x2
            top = np.nan_to_num(0.5 * (squares - low * low) + 1e-9 * squares + 1e-3, nan=np.inf)
            best: list[tuple[int, int]] = []
            for j in np.argsort(-top, kind="stable").tolist():
                if len(best) >= k and top[j] < -best[-1][0]:
                    break
                if x_ids[j] != q_ids[i]:
                    best = sorted([*best, (-sum(a * b for a, b in zip(mine, whole_x[j], strict=True)), int(x_ids[j]))])[:k]
            for column, values in zip(out, ([int(q_ids[i])] * len(best), [b for _, b in best], [str(-a) for a, _ in best]), strict=True):
                column.extend(values)
    return out


def search_block(q, q_ids, q_far, x, x_ids, x_far, floor, k):
    """The k best (score, smaller id) of the block for each query, by elimination; scores below floor are left out."""
    x2, q2 = (x * x).sum(1), (q * q).sum(1)
    out = []
    for at in range(0, len(q), 64):
        part = slice(at, at + 64)
        low = np.zeros((len(q[part]), len(x)))
        for j in range(x_far.shape[1]):
            np.maximum(low, np.abs(q_far[part, j : j + 1] - x_far[:, j]), out=low)
        top = 0.5 * (q2[part, None] + x2 - low * low) + 1e-3 + 1e-9 * (q2[part, None] + x2)
        for r, order in enumerate(np.argsort(-top, axis=1)):
            i = at + r
            bound = top[r][order]
            best_s, best_i, need, done, step = np.zeros(0), np.zeros(0, np.int64), floor[i], 0, 64
            while done < len(order) and bound[done] >= need:
                stop = min(done + step, int(np.searchsorted(-bound, -need, side="right")))
                take = order[done:stop]
                take = take[x_ids[take] != q_ids[i]]
                best_s, best_i = np.concatenate((best_s, x[take] @ q[i])), np.concatenate((best_i, x_ids[take]))
                if len(best_s) > k:
                    keep = np.lexsort((best_i, -best_s))[:k]
                    best_s, best_i = best_s[keep], best_i[keep]
                if len(best_s) >= k:
                    need = max(need, best_s.min())
                done, step = stop, step * 2
            out.append((np.full(len(best_s), q_ids[i]), best_i, best_s.astype(np.int64)))
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def pivot_topk(
    vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding",
    pivots: int = PIVOTS, sample: int = SAMPLE,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest integer inner products of every query row.

    is_query is a condition on id_col. The driver holds ``sample`` vectors and the pivots, of fixed number."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    rows = integer_vectors(vectors, id_col, vec_col, scale)
    d = main_dimension(rows, "vec")
    if d == 0:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("vec") == d)
    queries = integer_vectors(vectors.where(is_query), id_col, vec_col, scale).where(F.size("vec") == d)
    queries = queries.groupBy("id").agg(F.min(F.struct("vec", "wide")).alias("least")).select("id", "least.vec", "least.wide")
    counts = [df.agg(F.count_if(~F.col("wide")), F.count_if("wide")).first() for df in (rows, queries)]
    seen = rows.where("NOT wide").orderBy(F.xxhash64("id"), "id", "vec").limit(sample).collect()
    seen_ids, seen_rows = np.array([r["id"] for r in seen], np.int64), np.array([r["vec"] for r in seen], np.float64).reshape(-1, d)
    pivot_rows = choose_pivots(seen_rows, pivots) if len(seen) else np.zeros((1, d))
    p = len(pivot_rows)
    (n, n_wide), (n_queries, wide_queries) = counts
    n_blocks, q_blocks = max(LEAST_BLOCKS, -(-n // CANDIDATE_BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    any_wide = n_wide + wide_queries > 0 or d >= 1024
    more_blocks, more_q = -(-n_wide // WIDE_BLOCK), -(-wide_queries // WIDE_BLOCK)

    def with_table(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = matrix(batch.column("vec"), np.float64, d)
        with np.errstate(all="ignore"):
            far = np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (pivot_rows * pivot_rows).sum(1) - 2 * x @ pivot_rows.T))
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("wide"), blobs(x), blobs(far)], ["id", "wide", "vec", "far"])

    def tabled(df: DataFrame) -> DataFrame:
        return map_batches(df, with_table, "id long, wide boolean, vec binary, far binary")

    def block(count: int, more: int, seed: int) -> Column:
        h = F.xxhash64("id", F.lit(seed))
        return F.when(F.col("wide"), F.pmod(h, F.lit(max(1, more))) + count).otherwise(F.pmod(h, F.lit(count))).cast("int")

    def all_blocks(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    left = tabled(queries).withColumn("qb", block(q_blocks, more_q, 1)).withColumn("cb", all_blocks(n_blocks + more_blocks))
    right = tabled(rows).withColumn("cb", block(n_blocks, more_blocks, 2)).withColumn("qb", all_blocks(q_blocks + more_q))

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        names, kinds = ["query_id", "vec_id", "score"], [pa.int64(), pa.int64(), pa.string() if any_wide else pa.int64()]
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names)
        q, x = matrix(a["vec"], np.float64, d), matrix(b["vec"], np.float64, d)
        q_ids, x_ids = a["id"].to_numpy(), b["id"].to_numpy()
        sides = q, q_ids, matrix(a["far"], np.float64, p), x, x_ids, matrix(b["far"], np.float64, p)
        largest = np.abs(q).max(initial=0), np.abs(x).max(initial=0), np.abs(seen_rows).max(initial=0)
        if not largest[0] * max(largest[1:]) * d < 2**52:  # doubles would round
            found = search_wide(*sides, k)
        else:
            found = search_block(*sides, kth_of_sample(q, q_ids, seen_rows, seen_ids, k), k)
        return pa.table([pa.array(c, pa.int64()) if i < 2 else pa.array(c).cast(kinds[2]) for i, c in enumerate(found)], names)

    kind = "string" if any_wide else "long"
    found = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(search, f"query_id long, vec_id long, score {kind}")
    if not any_wide:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    # integers of any length by value: sign, number of digits, digits
    value = F.when(F.col("score").startswith("-"), F.struct((-F.length("score")).alias("n"), F.translate("score", "0123456789", "9876543210").alias("d"))).otherwise(F.struct(F.length("score").alias("n"), F.col("score").alias("d")))
    order = Window.partitionBy("query_id").orderBy(value.desc(), "vec_id")
    near = F.coalesce(F.expr("try_cast(score AS bigint)"), F.when(F.col("score").startswith("-"), F.lit(LEAST)).otherwise(F.lit(MOST)))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", near.alias("score"))

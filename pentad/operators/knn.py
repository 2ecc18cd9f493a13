"""The five nearest references of each query, and their vote.

queries: query_id, f0..f13; refs: ref_id, f0..f13, label. All searches return query_id, fraud_count (labels among the
five nearest; slots that stay empty count as legit, so a query without references, or with null features, has 0) and
worst (the fifth distance, null if fewer than five). Equal distances go to the smaller ref_id.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

import pentad
from pentad.config import DIMS, FEATURES, NEIGHBOURS, IndexConfig, SearchConfig
from pentad.functions import keys
from pentad.functions.quantize import box_distance, real, squared_distance
from pentad.functions.score import approved, fraud_score
from pentad.operators import index as layout
from pentad.operators.ranking import with_position
from pentad.storage import cut

# Functions sent to executors carry their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(pentad)

#: References and queries that meet in one piece of work, at most.
REF_BLOCK, QUERY_BLOCK = 262_144, 16_384
#: References whose fifth distance bounds the search of queries whose own leaf holds fewer than five.
BOUND_ROWS = 512
#: From more blocks of references on, a tree over all of them chooses what a query meets.
TREE_BLOCKS = 8
#: Tasks that share these pieces, at most.
TASKS = 2000
#: In such a piece: references and queries of a leaf, at most, and references compared at a time.
REF_LEAF, QUERY_LEAF, ROWS = 128, 32, 8192


def top(pairs: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """Of query_id, ref_id, label, dist: the k nearest of each query."""
    order = Window.partitionBy("query_id").orderBy("dist", "ref_id")
    return pairs.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k).drop("rn")


def votes(nearest: DataFrame) -> DataFrame:
    """query_id, fraud_count, worst from the nearest neighbours."""
    return nearest.groupBy("query_id").agg(F.sum("label").cast("bigint").alias("fraud_count"), F.when(F.count(F.lit(1)) >= NEIGHBOURS, F.max("dist")).alias("worst"))


def answered(queries: DataFrame, found: DataFrame) -> DataFrame:
    """Every query's vote; those not found have 0."""
    out = queries.select("query_id").join(found, "query_id", "left")
    return out.select("query_id", F.coalesce("fraud_count", F.lit(0).cast("bigint")).alias("fraud_count"), "worst")


def decisions(voted: DataFrame) -> DataFrame:
    """query_id, fraud_count, worst, fraud_score, approved."""
    return voted.withColumn("fraud_score", fraud_score(F.col("fraud_count"))).withColumn("approved", approved(F.col("fraud_count")))


def known(df: DataFrame) -> DataFrame:
    """The rows whose features are all known: others have no distance to anything."""
    every = F.lit(True)
    for f in FEATURES:
        every = every & F.col(f).isNotNull()
    return df.where(every)


def _leaves(x: np.ndarray, size: int, spare: bool) -> list[np.ndarray]:
    """Row numbers of x in groups of at most size, cut at medians of the widest column, again and again; each group rising.
    spare: of more than size equal rows the first five are enough."""
    todo, out = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        part = x[rows]
        width = np.ptp(part, axis=0)
        axis = width.argmax()
        if width[axis] == 0:
            out += [rows[:NEIGHBOURS]] if spare else [rows[at : at + size] for at in range(0, len(rows), size)]
            continue
        v = part[:, axis]
        cut_at = np.partition(v, len(v) // 2)[len(v) // 2]
        low = v < cut_at
        if not low.any():
            low = v <= cut_at
        todo += [rows[low], rows[~low]]
    return out


def _boxes(x: np.ndarray, leaves: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([x[rows].min(0) for rows in leaves]), np.array([x[rows].max(0) for rows in leaves])


def _gap(low: np.ndarray, high: np.ndarray, low2: np.ndarray, high2: np.ndarray) -> np.ndarray:
    """Squared distances of boxes."""
    d = np.maximum(np.maximum(low2 - high, low - high2), 0)
    return (d * d).sum(-1)


def _near_block(a: pa.Table, b: pa.Table) -> pa.Table:
    """The nearest references in b (ref_id, f0.., label) of each query in a (query_id, f0.., limit); none beyond limit.
    Both are cut into leaves. A leaf of queries is compared with the leaf of references next to it, then with all whose
    boxes are not farther from one of its queries than that query's fifth distance so far."""
    names, kinds = ["query_id", "ref_id", "label", "dist"], [pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    if not a.num_rows or not b.num_rows:
        return pa.table([pa.array([], k) for k in kinds], names)
    q, r = (np.column_stack([t[f].to_numpy() for f in FEATURES]).astype(np.float64) for t in (a, b))
    order = np.argsort(b["ref_id"].to_numpy(), kind="stable")
    r, r_ids, labels, n = r[order], b["ref_id"].to_numpy()[order], b["label"].to_numpy()[order], len(r)
    q_ids, limit = a["query_id"].to_numpy(), a["limit"].to_numpy()
    leaves = _leaves(r, REF_LEAF, True)
    low, high = _boxes(r, leaves)
    places, ends = np.concatenate(leaves), np.cumsum([0, *map(len, leaves)])
    laid = np.ascontiguousarray(r[places])
    laid2, out = (laid * laid).sum(1), []
    for mine in _leaves(q, QUERY_LEAF, False):
        part, m = q[mine], len(mine)
        part2, bound = (part * part).sum(1), limit[mine].astype(np.float64)
        best = np.full((m, NEIGHBOURS), np.iinfo(np.int64).max)
        gaps = _gap(part.min(0), part.max(0), low, high)
        rest = np.flatnonzero(gaps <= bound.max())
        rest = rest[np.argsort(gaps[rest], kind="stable")]
        room = REF_LEAF
        while len(rest):
            sizes = np.cumsum(ends[rest + 1] - ends[rest])
            some = rest[: max(1, int(np.searchsorted(sizes, room, "right")))]
            at = np.concatenate([np.arange(ends[k], ends[k + 1]) for k in some])
            # whole numbers far below 2^53: exact; a distance and the place of its reference make one number
            d = part2[:, None] + laid2[at] - 2 * (part @ laid[at].T)
            i, j = np.nonzero(d <= bound[:, None])
            found = d[i, j].astype(np.int64) * n + places[at[j]]
            i, found = np.concatenate((np.repeat(np.arange(m), NEIGHBOURS), i)), np.concatenate((best.ravel(), found))
            by = np.lexsort((found, i))
            i, found = i[by], found[by]
            first = np.searchsorted(i, np.arange(m))
            best = found[first[:, None] + np.arange(NEIGHBOURS)]
            fifth = best[:, -1]
            bound = np.where(fifth < np.iinfo(np.int64).max, np.minimum(bound, fifth // n), bound)
            rest = rest[len(some) :]
            rest = rest[gaps[rest] <= bound.max()]
            rest = rest[(_gap(part[:, None], part[:, None], low[rest], high[rest]) <= bound[:, None]).any(0)] if len(rest) else rest
            room = ROWS
        i, j = np.nonzero(best < np.iinfo(np.int64).max)
        found = best[i, j]
        out.append((q_ids[mine[i]], r_ids[found % n], labels[found % n], found // n))
    return pa.table([pa.array(np.concatenate(c)).cast(k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def nearest_in(probes: DataFrame, refs: DataFrame, key: str) -> DataFrame:
    """query_id, ref_id, label, dist: for every row of probes (query_id, f0.., key, and limit if no distance may exceed it)
    the five nearest of the references of its key, of which there are REF_BLOCK at most. Queries and references meet in
    blocks, as many for a key as its queries fill; pairs are not made as rows, and references that nobody asks for stay
    where they are. A column _block, if probes have it, says which queries make a block."""
    if "limit" not in probes.columns:
        probes = probes.withColumn("limit", F.lit(1 << 62))
    given = ["_block"] if "_block" in probes.columns else []
    probes = cut(probes.select("query_id", *FEATURES, F.col(key).alias("_asked"), F.coalesce("limit", F.lit(1 << 62)).alias("limit"), *given))
    if given:
        blocks = probes.select(F.col("_asked").alias("_key"), F.col("_block").alias("_of")).distinct()
    else:
        sizes = cut(probes.groupBy(F.col("_asked").alias("_key")).agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("_n")))
        probes = probes.join(sizes, F.col("_asked") == F.col("_key")).withColumn("_block", F.pmod(F.xxhash64("query_id"), F.col("_n"))).drop("_key", "_n")
        blocks = sizes.select("_key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).alias("_of"))
    met = known(refs).select("ref_id", *FEATURES, F.col("label").cast("int").alias("label"), key)
    met = met.join(blocks, F.col(key) == F.col("_key")).drop(key)
    # a number that is given is kept: few bytes are much work here
    tasks = min(max(1, blocks.count()), TASKS)
    both = probes.repartition(tasks, "_asked", "_block").groupBy("_asked", "_block").cogroup(met.repartition(tasks, "_key", "_of").groupBy("_key", "_of"))
    return both.applyInArrow(_near_block, "query_id long, ref_id long, label int, dist long")


def once(queries: DataFrame, refs: DataFrame, search: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """search(queries, refs), which is asked once for all queries with the same features, and not where five references
    have just these: they are the nearest. Of references with the same features it gets five, those with the smallest ids;
    no other of them can be among the five nearest of anything."""
    key = ["_h", *FEATURES]
    hashed = F.xxhash64(*(F.col(f).cast("int") for f in FEATURES))
    held = known(refs).select("ref_id", *FEATURES, "label", hashed.alias("_h"))
    few = cut(held.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy("ref_id"))).where(F.col("_rn") <= NEIGHBOURS).drop("_rn"))
    full = few.groupBy(*key).agg(F.sum("label").cast("bigint").alias("fraud_count"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= NEIGHBOURS).drop("_n")
    asked = queries.select("query_id", *FEATURES, hashed.alias("_h"))
    told = cut(known(asked).groupBy(*key).agg(F.min("query_id").alias("query_id")).join(full, key, "left"))
    found = told.where("fraud_count IS NOT NULL").select(*key, "fraud_count", F.lit(0).cast("bigint").alias("worst"))
    open_ = told.where("fraud_count IS NULL").drop("fraud_count")
    if open_.limit(1).count():
        found = found.unionByName(open_.join(search(open_.select("query_id", *FEATURES), few.drop("_h")), "query_id").select(*found.columns))
    out = asked.join(cut(found), key, "left")
    return out.select("query_id", F.coalesce("fraud_count", F.lit(0).cast("bigint")).alias("fraud_count"), "worst")


def flat(queries: DataFrame, refs: DataFrame) -> DataFrame:
    """Exact, by blocks, once for equal queries."""
    return once(queries, refs, in_blocks)


def in_blocks(queries: DataFrame, refs: DataFrame) -> DataFrame:
    """Every block of queries meets every block of references; both have a bounded number of rows. Queries that follow each
    other by projection key make a block, so that its leaves are small."""
    asked, refs = cut(known(queries.select("query_id", *FEATURES))), known(refs.select("ref_id", *FEATURES, "label"))
    n = max(1, -(-refs.count() // REF_BLOCK))
    refs = refs.withColumn("part", F.pmod(F.xxhash64("ref_id"), F.lit(n)).cast("int"))
    laid = with_position(asked.withColumn("_key", keys.projection_key()), [F.col("_key"), F.col("query_id")])
    probes = laid.withColumn("_block", F.floor(F.col("pos") / QUERY_BLOCK)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return answered(queries, votes(top(nearest_in(probes, refs, "part"))))


def certified(queries: DataFrame, refs: DataFrame, config: IndexConfig = IndexConfig()) -> DataFrame:  # noqa: B008
    """Exact: boxes certify what is left out. Up to TREE_BLOCKS blocks of references are searched by the leaves that each
    block is cut into; more of them by a tree over all, see ``tree_search``. Equal queries are searched once."""

    def search(queries: DataFrame, refs: DataFrame) -> DataFrame:
        if refs.count() <= TREE_BLOCKS * REF_BLOCK:
            return in_blocks(queries, refs)
        placed, nodes = layout.tree(refs, config, REF_BLOCK)
        return tree_search(queries, placed, nodes)

    return once(queries, refs, search)


def tree_search(queries: DataFrame, placed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Exact: a query goes down the tree to its nearest unit, a node of REF_BLOCK references at most, whose fifth distance
    bounds the search; then from the roots to all units whose boxes are not farther. A box at the bound itself counts,
    since a tie goes to the smaller ref_id. Every level is a join of the queries' nodes with their children; references of
    a unit are searched as one matrix, which is faster than to ask for each of its leaves."""
    asked = cut(known(queries.select("query_id", *FEATURES)))
    deepest = nodes.agg(F.max("level")).first()[0]
    if deepest is None:
        return answered(queries, votes(top(nearest_in(asked.withColumn("node", F.lit(0)), placed, "node"))))
    box = [*(f"lo{i}" for i in range(DIMS)), *(f"hi{i}" for i in range(DIMS))]
    stops = F.col("leaf") | (F.col("n") <= REF_BLOCK)
    levels = [nodes.where(F.col("level") == k).select("node", "parent", "leaf", stops.alias("stop"), *box) for k in range(deepest + 1)]
    units, up = [], None
    for level in levels:
        own = F.when(F.col("stop"), F.col("node"))
        if up is None:
            up = level.select("node", "leaf", own.alias("unit"))
        else:
            above = up.where("NOT leaf").select(F.col("node").alias("parent"), F.col("unit").alias("_up"))
            up = level.join(above, "parent").select("node", "leaf", F.coalesce("_up", own).alias("unit"))
        units.append(up.where("leaf").select(F.col("node").alias("_leaf"), "unit"))
    held = units[0]
    for more in units[1:]:
        held = held.unionByName(more)
    placed = cut(placed.join(held, F.col("node") == F.col("_leaf")).select("ref_id", *FEATURES, "label", F.col("unit").alias("node")))
    levels = [level.drop("leaf").withColumnRenamed("stop", "leaf") for level in levels]

    def below(at: DataFrame, level: int) -> DataFrame:
        """The children, with their distances, of the nodes in at; of all roots (256 at most) on level 0."""
        if level:
            joined = at.withColumnRenamed("node", "_up").alias("q").join(levels[level].alias("b"), F.col("_up") == F.col("b.parent"))
        else:
            joined = at.alias("q").crossJoin(F.broadcast(levels[0]).alias("b"))
        return joined.select("q.query_id", *(f"q.{f}" for f in FEATURES), *([F.col("q.limit")] if "limit" in at.columns else []), F.col("b.node").alias("node"), F.col("b.leaf").alias("leaf"), box_distance("q", "b").alias("_d"))

    nearest, at = [], asked
    for level in range(deepest + 1):
        best = below(at, level).groupBy("query_id").agg(F.min(F.struct("_d", "node", "leaf")).alias("best")).select("query_id", "best.node", "best.leaf")
        best = cut(asked.join(best, "query_id"))
        nearest.append(best.where("leaf").drop("leaf"))
        at = best.where("NOT leaf").drop("leaf")
    home = nearest[0]
    for more in nearest[1:]:
        home = home.unionByName(more)
    found = cut(nearest_in(home, placed, "node"))
    limits = votes(top(found)).select("query_id", F.col("worst").alias("limit"))
    open_ = cut(asked.join(home.select("query_id", F.col("node").alias("home")), "query_id").join(limits, "query_id", "left"))
    if open_.where("limit IS NULL").limit(1).count():  # a small leaf: some references bound the search
        few = placed.orderBy(F.xxhash64("ref_id"), "ref_id").limit(BOUND_ROWS).withColumn("node", F.lit(0).cast("bigint"))
        some = votes(top(nearest_in(open_.where("limit IS NULL").withColumn("node", F.lit(0).cast("bigint")).drop("limit"), few, "node")))
        open_ = cut(open_.join(some.select("query_id", F.col("worst").alias("_some")), "query_id", "left").withColumn("limit", F.coalesce("limit", "_some")).drop("_some"))
    probes, at = [], open_
    for level in range(deepest + 1):
        reached = cut(below(at, level).where(F.col("limit").isNull() | (F.col("_d") <= F.col("limit"))).drop("_d"))
        probes.append(reached.where("leaf").drop("leaf"))
        at = reached.where("NOT leaf").drop("leaf")
    wanted = probes[0]
    for more in probes[1:]:
        wanted = wanted.unionByName(more)
    wanted = wanted.join(open_.select("query_id", F.col("home").alias("node")), ["query_id", "node"], "left_anti")
    return answered(queries, votes(top(found.unionByName(nearest_in(wanted, placed, "node")))))


def list_ranks(queries: DataFrame, lists: DataFrame, boxes: bool, k: int) -> DataFrame:
    """query_id, f0.., list_id, n, lower, rank (from 1): a query's first k lists, by the distance to their boxes, then to
    their centroids (boxes: False: centroids alone), then number."""
    centre = squared_distance([real(f, "q") for f in FEATURES], [real(f"c{i}", "l") for i in range(DIMS)])
    lower = box_distance("q", "l") if boxes else centre
    pairs = queries.alias("q").crossJoin(F.broadcast(lists).alias("l"))
    pairs = pairs.select("q.query_id", *(f"q.{f}" for f in FEATURES), "l.list_id", "l.n", lower.alias("lower"), centre.alias("centre"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("lower", "centre", "list_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).drop("centre")


def staged(queries: DataFrame, listed: DataFrame, lists: DataFrame, search: SearchConfig, boxes: bool = True) -> DataFrame:
    """Probing of lists in stages: a fast scan of the first lists; where it is not certified (no other list's box is
    nearer than the fifth distance) and near a decision boundary, more lists; where that does not do, all lists.

    listed: refs with list_id; lists: their summaries, boxes: whether these have boxes. Returns query_id, fraud_count,
    worst and what happened: fast_fraud, fast_worst, fast_certified, repaired, repair_certified, exact_fallback,
    lists_fast, lists_repair, lists_exact, vectors_fast, vectors_repair, vectors_exact."""
    queries = cut(queries.select("query_id", *FEATURES))
    n_lists, longest = lists.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    nprobe = min(search.nprobe, n_lists)
    repair = max(min(search.repair_nprobe, n_lists), nprobe)
    ranks = cut(list_ranks(queries, lists, boxes, n_lists if search.exact_fallback and boxes else min(repair + 1, n_lists)))
    # a long list is searched in parts
    parts = max(1, -(-longest // REF_BLOCK))
    listed = listed.withColumn("_part", F.col("list_id").cast("bigint") * parts + F.pmod(F.xxhash64("ref_id"), F.lit(parts)))

    def scan(only: DataFrame | None, upto: int, first: int = 1, before: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """What the lists from rank first to upto add to the nearest found before; and the nearest so far."""
        probes = ranks.where(F.col("rank").between(first, upto))
        probes = probes if only is None else probes.join(only.select("query_id"), "query_id", "left_semi")
        each = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
        found = nearest_in(known(probes).withColumn("_p", each).withColumn("_part", F.col("list_id").cast("bigint") * parts + F.col("_p")), listed, "_part")
        if before is not None:
            found = found.unionByName(before.join(only.select("query_id"), "query_id", "left_semi").select(*found.columns))
        near = cut(top(found))
        spent = probes.groupBy("query_id").agg(F.count(F.lit(1)).alias("lists"), F.coalesce(F.sum("n"), F.lit(0)).alias("vectors"))
        following = ranks.where(F.col("rank") == upto + 1).select("query_id", F.col("lower").alias("next"))
        out = spent.join(votes(near), "query_id", "left").join(following, "query_id", "left")
        sure = F.lit(upto >= n_lists) if not boxes else F.lit(upto >= n_lists) | F.coalesce(F.col("worst") < F.col("next"), F.lit(False))
        out = out.withColumn("fraud_count", F.coalesce("fraud_count", F.lit(0).cast("bigint"))).withColumn("certified", sure).drop("next")
        return cut(out), near

    def open_(df: DataFrame) -> DataFrame:
        """Queries that go on to the next stage."""
        worst = F.coalesce(F.col("worst"), F.lit(2**62))
        limits = F.element_at(F.array(*(F.lit(t).cast("bigint") for t in search.worst_thresholds)), (F.col("fraud_count") + 1).cast("int"))
        near = F.col("fraud_count").between(search.repair_min, search.repair_max) | ((limits != 0) & (worst >= limits))
        early = F.lit(search.early_distance != 0) & (worst <= search.early_distance)
        return df.where(~F.col("certified") & ~early & near)

    fast, near = scan(None, nprobe)
    more, repaired, exact = open_(fast), None, None
    if repair > nprobe:
        repaired, near = scan(more, repair, nprobe + 1, near)
        more = open_(repaired)
    if search.exact_fallback and boxes:
        exact, _ = scan(more, n_lists, repair + 1, near)

    out = queries.select("query_id").join(fast, "query_id", "left")
    out = out.select("query_id", F.coalesce("fraud_count", F.lit(0).cast("bigint")).alias("fast_fraud"), F.col("worst").alias("fast_worst"), F.coalesce("certified", F.lit(False)).alias("fast_certified"), F.coalesce("lists", F.lit(0)).alias("lists_fast"), F.coalesce("vectors", F.lit(0)).alias("vectors_fast"))
    for name, stage in (("repair", repaired), ("exact", exact)):
        if stage is None:
            stage = queries.select("query_id").limit(0).select("query_id", *(F.lit(None).cast(t).alias(c) for c, t in (("fraud_count", "bigint"), ("worst", "bigint"), ("certified", "boolean"), ("lists", "bigint"), ("vectors", "bigint"))))
        stage = stage.select("query_id", F.col("fraud_count").alias(f"{name}_fraud"), F.col("worst").alias(f"{name}_worst"), F.col("certified").alias(f"{name}_sure"), F.col("lists").alias(f"{name}_lists"), F.col("vectors").alias(f"{name}_vectors"))
        out = out.join(stage, "query_id", "left")
    ran = {name: F.col(f"{name}_fraud").isNotNull() for name in ("repair", "exact")}
    pick = lambda what: F.when(ran["exact"], F.col(f"exact_{what}")).when(ran["repair"], F.col(f"repair_{what}")).otherwise(F.col(f"fast_{what}"))
    return out.select(
        "query_id", pick("fraud").alias("fraud_count"), pick("worst").alias("worst"), "fast_fraud", "fast_worst", "fast_certified", ran["repair"].alias("repaired"),
        F.coalesce("repair_sure", F.lit(False)).alias("repair_certified"), ran["exact"].alias("exact_fallback"), "lists_fast",
        *(F.coalesce(f"{n}_lists", F.lit(0)).alias(f"lists_{n}") for n in ("repair", "exact")), "vectors_fast",
        *(F.coalesce(f"{n}_vectors", F.lit(0)).alias(f"vectors_{n}") for n in ("repair", "exact")),
    )


def ivf(queries: DataFrame, refs: DataFrame, index: IndexConfig, search: SearchConfig) -> DataFrame:
    """staged() over lists of equal ranges, which have boxes."""
    listed = cut(layout.with_list(refs.select("ref_id", *FEATURES, "label"), index.lists))
    return staged(queries, listed, cut(layout.list_summaries(listed)), search)


def ivf_kmeans(queries: DataFrame, refs: DataFrame, index: IndexConfig, search: SearchConfig) -> DataFrame:
    """staged() over k-means lists, which have none: certified only when all lists are scanned."""
    listed, centroids = layout.kmeans_lists(refs.select("ref_id", *FEATURES, "label"), index)
    listed = cut(listed)
    sizes = listed.groupBy("list_id").agg(F.count(F.lit(1)).alias("n"))
    lists = centroids.join(sizes, "list_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return staged(queries, listed, cut(lists), search, boxes=False)


def stored(queries: DataFrame, tables: dict[str, DataFrame], search: SearchConfig = SearchConfig()) -> DataFrame:  # noqa: B008
    """query_id, fraud_count, worst: searches an index as ``readers.stored_index`` returns it, by its layout."""
    if "nodes" in tables:
        return tree_search(queries, tables["refs"], tables["nodes"])
    if "lists" in tables:
        lists = tables["lists"]
        return staged(queries, tables["refs"], lists, search, boxes="lo0" in lists.columns).select("query_id", "fraud_count", "worst")
    return flat(queries, tables["refs"])


def with_shortcuts(queries: DataFrame, refs: DataFrame, search: SearchConfig, index: IndexConfig = IndexConfig()) -> DataFrame:  # noqa: B008
    """query_id, fraud_count, shortcut: pure buckets answer where they may, the certified search the other queries."""
    from pentad.operators.buckets import shortcut_votes

    asked = cut(shortcut_votes(queries.select("query_id", *FEATURES), refs, search, index))
    found = certified(asked.where(F.col("shortcut").isNull()), refs, index).select("query_id", "fraud_count")
    out = asked.select("query_id", "shortcut").join(found, "query_id", "left")
    return out.select("query_id", F.coalesce("shortcut", "fraud_count").alias("fraud_count"), F.col("shortcut").isNotNull().alias("shortcut"))

"""Mixing sources to target weights by pivotal dependent rounding, on DataFrame functions alone.

A source's share of the mix is its target: all sources share the wanted volume by weight, none gets more than a multiple
of its size, and what that leaves is shared again. Every row of a source would then be copied target / size times, a
whole number of copies and a fraction. Fractions become whole by the pivotal method: two rows trade words, up or down at
random and in expectation by nothing, until one of the two has a whole number of copies; the other meets the next. So the
words taken stay as they are in sum.

This runs as a reduction tree: rows of a source and a size class meet in blocks of about 64, every block hands on one
fractional row, and blocks of those meet on the next level. At the root a source has one fractional row for each size
class; these are rounded at random from large to small, each with a chance of its fraction and of the words that those
before took too many or too few, so that the source ends near its target. Draws are hashes of the ids, so reruns agree. Blocks hold about 64 rows whatever the input, and no group grows with a source.

Rows that hold more than a 200th of their source (at most 200 of a source) are rounded first, like those at the root; what
their rounding adds or leaves out changes the fraction of the source's other rows. Pairs of such rows would trade words as
well, but leave the source by up to half its longest text beside its target (9 % on a table of 50 texts a source).

* Null and empty texts have size 0, and of them nothing is taken; a null source is a source, last in order;
* repeated rows are rows of their own; null ids are kept; an empty table gives an empty result;
* only the id, text and source columns are read;
* ``mixed`` tells rows apart by id, source and a hash of the text; rows alike in all three stand in the mix as copies of one
  of them, as often as they are taken together. Further columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pentad.llm.common import cut
from pentad.operators.ranking import with_position

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
BLOCK = 64
#: Rows with more than one in so many words of their source are rounded before the others.
LARGE = 200
#: With more sources than these, their table is joined by shuffle instead of broadcast.
BROADCAST_SOURCES = 50_000
ROW = "struct<doc_id:bigint,source:string,t:bigint,size:bigint,source_size:bigint,target:double,base:int>"
UNIT = f"struct<h:bigint,size:double,p:double,row:{ROW}>"
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target for a table of source and size: one row for each source. A level that the weights
    multiply is raised until what sources over their limit leave is shared by the others; each step is one sum over the
    sources, which no single task holds."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = with_position(per, [F.col("source").asc_nulls_last()], "rn")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("rn"), F.lit(len(weights))) + 1).cast("int"))
    per = cut(per.select("source", "source_size", weight.alias("w"), (F.col("source_size") * F.lit(float(most))).alias("cap")))
    words, weighed = per.agg(F.sum("source_size"), F.sum("w")).first()
    total = float(share) * (words or 0)
    level = total / weighed if weighed else 0.0
    while True:
        full = F.col("cap") <= F.col("w") * level
        held, open_ = per.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("w")))).first()
        raised = (total - (held or 0.0)) / open_ if open_ else level
        if raised <= level:
            break
        level = raised
    return per.select("source", "source_size", F.least("cap", F.col("w") * level).alias("target"))


def _uniform(*cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _with(item: Column, p: Column) -> Column:
    return F.struct(item["h"].alias("h"), item["size"].alias("size"), p.alias("p"), item["row"].alias("row"))


def _done(item: Column, extra: int) -> Column:
    return F.struct((F.lit(extra) + item["row"]["base"]).alias("copies"), item["row"].alias("row"))


def _pivot(level: int):
    """Folds a block's rows: state is the row still fractional and those that have whole numbers."""

    def step(state: Column, x: Column) -> Column:
        i, done = state["left"], state["done"]
        mi, mj = i["p"] * i["size"], x["p"] * x["size"]
        free_i, free_j = i["size"] - mi, x["size"] - mj
        up, down = F.least(free_i, mj), F.least(mi, free_j)
        rises = _uniform(i["h"], x["h"], F.lit(level)) * (up + down) < down
        next_ = (
            F.when(rises & (free_i <= mj), F.struct(_with(x, (mj - up) / x["size"]).alias("left"), _done(i, 1).alias("gone")))
            .when(rises, F.struct(_with(i, (mi + up) / i["size"]).alias("left"), _done(x, 0).alias("gone")))
            .when(mi <= free_j, F.struct(_with(x, (mj + down) / x["size"]).alias("left"), _done(i, 0).alias("gone")))
            .otherwise(F.struct(_with(i, (mi - down) / i["size"]).alias("left"), _done(x, 1).alias("gone")))
        )
        pair = F.transform(F.array(next_), lambda n: F.struct(n["left"].alias("left"), F.concat(done, F.array(n["gone"])).alias("done")))
        return F.when(i.isNull(), F.struct(x.alias("left"), done.alias("done"))).otherwise(pair[0])

    return step


def _land(state: Column, x: Column) -> Column:
    """Rounds one row after the other, up with a chance of its fraction and of the words carried, and carries on the words
    that this adds or leaves out."""
    want = x["p"] * x["size"] + state["carry"]
    one = _uniform(x["h"], F.lit(-1)) * x["size"] < want
    gone = F.when(one, _done(x, 1)).otherwise(_done(x, 0))
    return F.struct((want - F.when(one, x["size"]).otherwise(F.lit(0.0))).alias("carry"), F.concat(state["done"], F.array(gone)).alias("done"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words that the mix takes of each row, copies counted, and copies."""
    return _mix(docs, id_col, text_col, source_col, weights, share, most).drop("source", "t")


def _mix(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sized = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text_col).alias("t"), size.alias("size")))
    targets = cut(source_targets(sized.select("source", "size"), weights, share, most))
    few = targets.count() <= BROADCAST_SOURCES

    def by_source(df: DataFrame, one: DataFrame, how: str) -> DataFrame:
        one = one.withColumnRenamed("source", "s")
        return df.join(F.broadcast(one) if few else one, F.col("source").eqNullSafe(F.col("s")), how).drop("s")

    def item(size: Column, p: Column, row: Column) -> Column:
        return F.struct(F.xxhash64("doc_id", "size").alias("h"), size.cast("double").alias("size"), p.alias("p"), row.alias("row"))

    def whole(rate: Column) -> Column:
        return F.when(F.abs(rate - F.round(rate)) < 1e-12, F.round(rate)).otherwise(rate)

    row = F.struct("doc_id", "source", "t", "size", "source_size", "target", F.floor("rate").cast("int").alias("base"))
    part = F.col("rate") - F.floor("rate")
    empty = F.array().cast(f"array<struct<copies:int,row:{ROW}>>")
    start = F.struct(F.lit(None).cast(UNIT).alias("left"), empty.alias("done"))
    landing = F.struct(F.lit(0.0).alias("carry"), empty.alias("done"))
    by_size = F.transform(F.sort_array(F.collect_list(F.struct(F.col("item.size").alias("k"), "item")), asc=False), lambda x: x["item"])

    rows = by_source(sized, targets, "inner")
    rows = rows.withColumn("rate", whole(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))))
    large = (F.col("size") * LARGE > F.col("source_size")) & (part > 0)
    first = rows.where(large).select("source", item(F.col("size"), part, row).alias("item")).groupBy("source").agg(by_size.alias("items"))
    first = cut(first.select("source", F.aggregate("items", landing, _land).alias("out"), F.aggregate("items", F.lit(0.0), lambda a, x: a + x["size"]).alias("large_size")))
    decided = [first.select(F.explode("out.done").alias("x")).select("x.copies", "x.row")]
    rows = by_source(rows.where(~large), first.select("source", "out.carry", "large_size"), "left")
    rest = F.col("source_size") - F.coalesce("large_size", F.lit(0.0))
    moved = F.when(rest > 0, F.col("rate") + F.coalesce("carry", F.lit(0.0)) / rest).otherwise(F.col("rate"))
    rows = rows.withColumn("rate", whole(F.least(F.greatest(moved, F.lit(0.0)), F.lit(float(most))))).drop("carry", "large_size")
    split = (part > 0) & (F.col("size") > 0)
    decided.append(rows.where(~split).select(F.floor("rate").cast("int").alias("copies"), row.alias("row")))
    units = rows.where(split).select("source", F.floor(F.log2("size") * 2).alias("class"), item(F.col("size"), part, row).alias("item"))
    blocks, level = max(1, -(-sized.count() // BLOCK)), 0
    while True:
        key = F.pmod(F.xxhash64(F.col("item.h"), F.lit(level)), F.lit(blocks))
        met = units.groupBy("source", "class", key.alias("block")).agg(F.sort_array(F.collect_list("item")).alias("items"))
        met = cut(met.select("source", "class", F.aggregate("items", start, _pivot(level)).alias("out")).select("source", "class", "out.left", "out.done"))
        decided.append(met.select(F.explode("done").alias("x")).select("x.copies", "x.row"))
        units = met.select("source", "class", F.col("left").alias("item"))
        if blocks == 1:
            break
        blocks, level = -(-blocks // BLOCK), level + 1
    root = units.groupBy("source").agg(by_size.alias("items"))
    root = root.select(F.explode(F.aggregate("items", landing, _land)["done"]).alias("x"))
    decided.append(root.select("x.copies", "x.row"))
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    return out.select("row.doc_id", "row.source", "row.t", "row.size", "row.source_size", "row.target", (F.col("copies") * F.col("row.size")).alias("taken"), "copies")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """docs as the mix takes them: rows without copies go, others stand as often as they are taken."""
    key = [F.coalesce("doc_id", F.lit(0)).alias("k"), F.col("doc_id").isNull().alias("no_id"), F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("no_s"), "t"]
    names = ["k", "no_id", "s", "no_s", "t"]
    copies = cut(_mix(docs, id_col, text_col, source_col, **how).select(*key, "copies").groupBy(*names).agg(F.sum("copies").cast("int").alias("copies"), F.count(F.lit(1)).alias("alike")))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text_col).alias("t"))
    joined = rows.select("row", *key).join(copies.where("copies > 0"), names)
    one = joined.where("alike > 1").dropDuplicates(names)
    joined = joined.where("alike = 1").unionByName(one)
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")

"""Quotation linking, on DataFrame functions alone.

A line's quote level is the number of ``>`` at its start (blanks may stand between); what follows the last is quoted. A
passage is an unbroken run of lines of one level; blank lines part passages. Passages are normalised (A-Z lowered, blanks
and line ends collapsed), and the sentences of a whole passage and its single lines, hashed to 128 bits, are joined to
those of the unquoted passages in the same conversation. So quotes link that were wrapped anew, or cut to some lines. The
original of a sentence or line is the earliest message that holds it. A message replies to the original of its
lowest-level quotes, the one with most quoted characters, the later of equals. Without such an original it follows the
message before it. Every conversation is then laid out in reply order: by depth in the tree of replies, then turn, so a
message comes after the one it answers; quotes, and the attribution lines ("On ... wrote:") before them, are left out.

* Messages are ordered by turn, role and text within conv_id; null ids form a conversation, null turns come first, null
  and empty texts are empty messages; repeated rows are messages of their own;
* blank quoted lines are no passage; passages without an original are removed from the text too, and counted; U+0001 to
  U+0003 count as no characters when passages are compared;
* an empty table gives an empty result; only conv_id, turn, role and text are read.

No conversation is gathered in one task: ranks come from range-partitioned rows, links from joins with a side of unique
keys (whose large partitions Spark splits). A message that follows the one before it hangs on the last message before it
that does not, its head; depths of heads come from pointer jumping, a logarithmic number of joins, none without quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pentad.llm.common import cut, drop, lower_az

MARK = r"^([ \t]*>)+"
ATTRIBUTION = r"^[ \t]*On .+ wrote:[ \t]*$"
#: Parts of a passage, lines of a passage and sentences, as they are strung together.
PASSAGE, LINE, SENTENCE = "\u0002", "\u0003", "\u0001"
BLOCK = 64


def normal(body: Column) -> Column:
    plain = F.translate(lower_az(body), PASSAGE + LINE + SENTENCE, "")
    return F.regexp_replace(F.regexp_replace(plain, r"[ \t]+", " "), "^ | $", "")


def with_lines(rows: DataFrame) -> DataFrame:
    """rows with lines: an array of level, body, drop (an attribution line before a quote) and norm for each line of text."""
    texts = F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")
    marked = rows.withColumn("_raw", texts).withColumn("_level", F.transform("_raw", lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARK, 0), "[^>]", ""))))
    after = lambda i: F.coalesce(F.get("_level", i + 1), F.lit(0)) > 0
    body = F.transform("_raw", lambda x, i: F.struct(F.get("_level", i).alias("level"), F.regexp_replace(x, MARK, "").alias("body"), (x.rlike(ATTRIBUTION) & after(i)).alias("drop")))
    marked = marked.withColumn("_body", body).withColumn("lines", F.transform("_body", lambda x: F.struct(x["level"], x["body"], x["drop"], normal(x["body"]).alias("norm"))))
    return marked.drop("_raw", "_level", "_body")


def passages(lines: DataFrame) -> DataFrame:
    """conv, seq, level, passage (its number in the message) and unit: its lines and its sentences, each once."""

    def strung(x: Column, i: Column) -> Column:
        kept = lambda y: ~y["drop"] & (y["norm"] != "")
        before = F.get("lines", i - 1)
        goes_on = (i > 0) & F.coalesce(kept(before) & (before["level"] == x["level"]), F.lit(False))
        return F.when(~kept(x), F.lit(PASSAGE)).when(goes_on, F.concat(F.lit(LINE), x["norm"])).otherwise(F.concat(F.lit(PASSAGE), x["level"].cast("string"), F.lit(LINE), x["norm"]))

    whole = lines.select("conv", "seq", F.array_join(F.transform("lines", strung), "").alias("all"))
    each = whole.select("conv", "seq", F.posexplode(F.filter(F.split("all", PASSAGE), lambda p: p != "")).alias("passage", "p"))
    each = each.select("conv", "seq", "passage", F.split("p", LINE).alias("p"))
    own = F.slice("p", 2, F.size("p") - 1)
    ended = F.regexp_replace(F.array_join(own, " "), "([.!?]) ", "$1" + SENTENCE)
    return each.select("conv", "seq", F.element_at("p", 1).cast("int").alias("level"), "passage", F.explode(F.array_distinct(F.concat(own, F.split(ended, SENTENCE)))).alias("unit"))


def ranked(df: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """df and, as name, each row's place in its group (from 0) by order, and part: rows are dealt by ranges, so that a
    group may span parts; a part's rows then add those of the group in the parts before. Only groups that span parts, fewer
    than there are parts, have such, so their table is broadcast."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = cut(df.repartitionByRange(n, F.col(group), *order).withColumn("part", F.spark_partition_id()))
    spans = laid.groupBy(group, "part").agg(F.count(F.lit(1)).alias("n")).groupBy(group).agg(F.sort_array(F.collect_list(F.struct("part", "n"))).alias("parts"))
    spans = spans.where(F.size("parts") > 1).select(group, F.explode("parts").alias("at"), "parts")
    ahead = F.aggregate(F.filter("parts", lambda p: p["part"] < F.col("at.part")), F.lit(0).cast("long"), lambda a, p: a + p["n"])
    spans = F.broadcast(spans.select(group, F.col("at.part").alias("part"), ahead.alias("_ahead")))
    within = F.row_number().over(Window.partitionBy(group, "part").orderBy(*order))
    placed = laid.withColumn("_within", within).join(spans, [group, "part"], "left")
    return placed.withColumn(name, (F.col("_within") - 1 + F.coalesce("_ahead", F.lit(0))).cast("long")).drop("_within", "_ahead")


def quote_origins(lines: DataFrame) -> DataFrame:
    """conv, seq, origin (the message that the quotes answer; null if none), n_quoted and n_linked (passages) for each
    message with quotes."""
    units = passages(lines).select("conv", "seq", "level", "passage", F.length("unit").alias("chars"), F.xxhash64("unit").alias("h1"), F.xxhash64(F.lit(1), "unit").alias("h2"))
    own = units.where("level = 0").groupBy("conv", F.bitwise_not("h1").alias("w"), "h2").agg(F.min("seq").alias("origin"))
    # keys are not those of the aggregation: the join deals both sides, and Spark can split a large partition
    own = own.select("conv", F.bitwise_not("w").alias("h1"), "h2", "origin")
    found = units.where("level > 0").join(own, ["conv", "h1", "h2"], "left").withColumn("origin", F.when(F.col("origin") < F.col("seq"), F.col("origin")))
    each = found.groupBy("conv", "seq", "passage", "level", "origin").agg(F.sum("chars").alias("chars"))
    each = each.groupBy("conv", "seq", "level", "origin").agg(F.sum("chars").alias("chars"), F.collect_set("passage").alias("passages"))
    best = F.max(F.when(F.col("origin").isNotNull(), F.struct(-F.col("level"), "chars", "origin")))["origin"]
    linked = F.flatten(F.collect_list(F.when(F.col("origin").isNotNull(), F.col("passages"))))
    count = lambda a: F.size(F.array_distinct(a)).cast("long")
    return each.groupBy("conv", "seq").agg(best.alias("origin"), count(F.flatten(F.collect_list("passages"))).alias("n_quoted"), count(linked).alias("n_linked"))


def head_depths(told: DataFrame) -> DataFrame | None:
    """conv, seq and depth of the messages that reply to a quote's original; None without such."""
    heads = told.where("link = 'quote'").select("conv", F.col("seq"), "reply_to")
    target = told.select("conv", F.col("seq").alias("reply_to"), F.col("head").alias("up"))
    at = cut(heads.join(target, ["conv", "reply_to"]).select("conv", "seq", "up", (F.col("reply_to") - F.col("up") + 1).alias("depth")))
    while True:
        n, left = at.agg(F.count(F.lit(1)), F.count_if(F.col("up") > 0)).first()
        if not left:
            return at.select("conv", "seq", "depth") if n else None
        above = at.select("conv", F.col("seq").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        moved = at.join(above, ["conv", "up"], "left")
        before, at = at, cut(moved.select("conv", "seq", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
        drop(before)


def link_quotes(messages: DataFrame) -> DataFrame:
    """One row for each message: conv_id, turn, role, seq (place by turn, from 0), reply_to (seq; null for the
    first), link (quote, sequence or start), n_quoted and n_linked (quoted passages, and those with an original), depth,
    position (place in reply order, from 0), body (the text without quotes)."""
    rows = messages.select(F.col("conv_id"), F.col("turn"), F.col("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))
    rows = ranked(rows, "conv", [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text")], "seq")
    rows = cut(with_lines(rows).drop("text"))
    own = F.array_join(F.transform(F.filter("lines", lambda x: (x["level"] == 0) & ~x["drop"]), lambda x: x["body"]), "\n")
    told = rows.select("conv_id", "turn", "role", "conv", "seq", "part", F.regexp_replace(own, r"^[ \t\n]+|[ \t\n]+$", "").alias("body"))
    told = told.join(quote_origins(rows), ["conv", "seq"], "left")
    told = told.withColumn("reply_to", F.when(F.col("origin").isNotNull(), F.col("origin")).when(F.col("seq") > 0, F.col("seq") - 1))
    kind = F.when(F.col("origin").isNotNull(), F.lit("quote")).when(F.col("seq") > 0, F.lit("sequence")).otherwise(F.lit("start"))
    told = cut(told.withColumn("link", kind).drop("origin"))

    is_head = F.when(F.col("link") != "sequence", F.col("seq"))
    spans = told.groupBy("conv", "part").agg(F.min("seq").alias("first"), F.max(is_head).alias("last"))
    # at most one conversation goes on from one part to the next
    going_on = spans.groupBy("conv").agg(F.collect_list(F.struct("part", "first", "last")).alias("parts")).where(F.size("parts") > 1).select("conv", "parts", F.explode("parts").alias("at"))
    last = F.array_max(F.transform(F.filter("parts", lambda p: p["first"] < F.col("at.first")), lambda p: p["last"]))
    going_on = F.broadcast(going_on.select("conv", F.col("at.part").alias("part"), last.alias("_last")))
    here = F.last(is_head, ignorenulls=True).over(Window.partitionBy("conv", "part").orderBy("seq"))
    told = cut(told.withColumn("_here", here).join(going_on, ["conv", "part"], "left").withColumn("head", F.coalesce("_here", "_last")).drop("_here", "_last", "part"))
    depths = head_depths(told)
    if depths is None:
        told = told.withColumn("depth", F.col("seq") - F.col("head"))
    else:
        told = told.join(depths.select("conv", F.col("seq").alias("head"), F.col("depth").alias("_above")), ["conv", "head"], "left")
        told = told.withColumn("depth", F.col("seq") - F.col("head") + F.coalesce("_above", F.lit(0)))
    told = ranked(told, "conv", [F.col("depth"), F.col("seq")], "position")
    return told.select(
        "conv_id", "turn", "role", "seq", "reply_to", "link", F.coalesce("n_quoted", F.lit(0)).cast("long").alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "depth", "position", "body",
    )


def conversations(messages: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, block (from 0) and messages: the conversations in reply order, without quotes, as arrays of role, body and
    the place (position, from 0) of the message that is answered; a row holds at most block messages, so that a
    conversation of any size has rows of bounded size. Empty messages are left in."""
    told = cut(link_quotes(messages))
    places = told.select(F.col("conv_id").alias("_conv"), F.col("seq").alias("_seq"), F.col("position").alias("answers"))
    told = told.join(places, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("reply_to") == F.col("_seq")), "left")
    turn = F.struct("position", "role", "body", "answers")
    out = told.groupBy("conv_id", F.floor(F.col("position") / block).cast("long").alias("block")).agg(F.sort_array(F.collect_list(turn)).alias("messages"))
    return out.withColumn("messages", F.transform("messages", lambda m: F.struct(m["role"], m["body"], m["answers"])))

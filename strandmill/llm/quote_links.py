"""Chat formatting by quotation linking.

A line's quote level is the number of '>' it starts with. Lines of one level in a row are a passage. Passages, and the own text
of every message, are normalised (lower case, quote marks dropped, white space drawn together) and hashed: as a whole, by
paragraph, and by line. A quoted unit belongs to the earliest message, by (conv_id, turn), with the same hash in its own text: in the
quoting message's conversation, before it, if there is one, else in another conversation, if the unit is a whole passage or has `LEAST` characters at least
(a short line within a passage, such as a greeting, says nothing outside its conversation). Numbers of conversations are no dates, so a message
may quote one with a higher number. A message answers the original of its least nested linked passage (whole
passages before paragraphs before lines, then the longest); without one it hangs on the first message of its conversation. Where such
answers make a circle, its first message by (conv_id, turn) answers none. Threads are the trees of these answers; a message's place in
its thread is ordered by depth, then (conv_id, turn).

Everything is DataFrame expressions. Originals are reduced to one message a hash and conversation before the join, so a passage that a
third of all messages share meets one row, which is broadcast to them if so many ask for it; roots are found by pointer doubling; places come
from a range sort and partition offsets, not from a window over a thread.

Defined cases: a null text is empty; a message of quotes only has empty text. Null conv_id is one conversation, and comes
first, as does null turn. Repeated rows are messages of their own, in no stated order. A message never links to itself. Control
characters 1 and 2 are ignored in passages. A very long text is one row like any other, its lines an array of that row. An empty table gives
an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, join_hot, text_or_empty
from .components import components

LEAST = 20
MARKS = r"^((?:[ \t]*>)+)"
WHOLE, PARAGRAPH, LINE = 3, 2, 1


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\s>]+", " "))


def _units(text: Column) -> Column:
    """(kind, key, size) of a text as a whole, its paragraphs and its lines, but blank ones."""
    piece = lambda kind, x: F.struct(F.lit(kind).alias("kind"), F.md5(normalised(x)).alias("key"), F.length(normalised(x)).alias("size"))
    some = lambda parts, kind: F.transform(parts, lambda x: piece(kind, x))
    return F.filter(F.concat(F.array(piece(WHOLE, text)), some(F.split(text, r"\n[ \t]*\n"), PARAGRAPH), some(F.split(text, "\n"), LINE)), lambda u: u["size"] > 0)


def parse(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, mid, ckey, okey (order), text (own), passages (array of level and text)."""
    order = F.struct("conv_id", "turn", F.col("mid"))
    df = messages.select("conv_id", "turn", "role", F.monotonically_increasing_id().alias("mid"), text_or_empty().alias("_t"))
    level = lambda x: F.length(F.translate(F.regexp_extract(x, MARKS, 1), " \t", ""))
    df = df.withColumn("_l", F.transform(F.split("_t", "\n"), lambda x: F.struct(level(x).alias("level"), x.alias("line"))))
    own = F.trim(F.array_join(F.transform(F.filter("_l", lambda x: x["level"] == 0), lambda x: x["line"]), "\n"))
    new = lambda x, i: (i == 0) | (F.get("_l", i - 1)["level"] != x["level"])
    marked = F.transform("_l", lambda x, i: F.concat(F.when(new(x, i), F.concat(F.lit("\x01"), x["level"].cast("string"), F.lit("\x02"))).otherwise(""), F.translate(F.regexp_replace(x["line"], MARKS + "[ ]?", ""), "\x01\x02", "")))
    runs = F.filter(F.split(F.array_join(marked, "\n"), "\x01"), lambda p: (p != "") & ~p.startswith("0\x02"))
    quoted = F.transform(runs, lambda p: F.struct(F.substring_index(p, "\x02", 1).cast("int").alias("level"), F.substring_index(p, "\x02", -1).alias("text")))
    return df.select("conv_id", "turn", "role", "mid", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null")).alias("ckey"), order.alias("okey"), own.alias("text"), F.when(F.exists("_l", lambda x: x["level"] > 0), quoted).otherwise(F.array().cast("array<struct<level:int,text:string>>")).alias("passages"))


def link(parsed: DataFrame, scratch: Scratch) -> DataFrame:
    """mid, n_quotes, n_linked, parent (order key of the message answered; null if no passage is linked) of messages with passages."""
    asked = parsed.where(F.size("passages") > 0).select("mid", "ckey", "okey", F.posexplode("passages").alias("passage", "p"))
    units = asked.select("mid", "ckey", "okey", "passage", F.col("p.level").alias("level"), F.explode_outer(_units(F.col("p.text"))).alias("u")).select("mid", "ckey", "okey", "passage", "level", "u.*")
    wanted = scratch.write(units.where(F.col("key").isNotNull()).groupBy("key", "ckey").agg(F.count("*").alias("n")))
    texts = parsed.select("ckey", F.col("okey").alias("at"), F.explode(F.array_distinct(F.transform(_units(F.col("text")), lambda u: u["key"]))).alias("key"))
    near = scratch.write(texts.join(wanted.select("key").distinct(), "key", "left_semi").groupBy("key", "ckey").agg(F.min("at").alias("near")))
    # The first messages of the two first conversations that hold a unit: one of them is another than the asking one.
    two = near.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("near"))).where("r <= 2")
    far = two.groupBy("key").agg(F.min("near").alias("far"), F.min_by("ckey", "near").alias("far_ckey"), F.max(F.when(F.col("r") == 2, F.col("near"))).alias("next"))
    asking = wanted.groupBy("key").agg(F.count("*").alias("n"))
    both = join_hot(wanted, asking.join(far, "key", "left"), ["key"]).join(near, ["key", "ckey"], "left")
    other = F.when(F.col("far_ckey") != F.col("ckey"), F.col("far")).otherwise(F.col("next"))
    originals = scratch.write(both.select("key", "ckey", "n", "near", other.alias("other")))
    found = join_hot(units, originals, ["key", "ckey"], "left")
    found = found.withColumn("at", F.when(F.col("near") < F.col("okey"), F.col("near")).when((F.col("size") >= LEAST) | (F.col("kind") == WHOLE), F.col("other")))
    best = F.min(F.when(F.col("at").isNotNull(), F.struct("level", (-F.col("kind")).alias("k"), (-F.col("size")).alias("s"), "passage", "at")))
    by_passage = found.groupBy("mid", "passage").agg(best.alias("best"))
    return by_passage.groupBy("mid").agg(F.count("*").alias("n_quotes"), F.count("best").alias("n_linked"), F.min("best").alias("best")).select("mid", "n_quotes", "n_linked", F.col("best.at").alias("parent"))


def _roots(up: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """up: node, root (the next node up, or itself), depth (of that step), okey. Gives node, root, depth, and the nodes whose link was cut to open a circle (None if none was).

    Pointers double until all end at a root. A chain has nodes of every depth up to its own, so once a round leaves as many
    nodes unfinished as the one before, those that are left run into circles; and the nodes where they stand are the circles' own."""
    now = scratch.write(up.select("node", "root", "depth"))
    before = -1
    while True:
        above = now.select(F.col("node").alias("root"), F.col("root").alias("top"), F.col("depth").alias("more"))
        nxt = scratch.write(now.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.coalesce(F.col("more") > 0, F.lit(False)).alias("moved")))
        scratch.drop_table(now)
        moved = nxt.where("moved").count()
        if not moved:
            return nxt.drop("moved"), None
        if moved == before:
            break
        now, before = nxt.drop("moved"), moved
    circles = scratch.write(nxt.where("moved").select(F.col("root").alias("node")).distinct())
    own = up.join(circles, "node")
    least = components(own.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch).withColumnRenamed("root", "circle")
    named = own.join(least, "node", "left").withColumn("circle", F.coalesce("circle", "node"))
    cut = scratch.write(named.groupBy("circle").agg(F.min("okey").alias("okey")).select(F.col("okey.mid").alias("node"), F.lit(True).alias("cut")))
    opened = up.join(cut, "node", "left").select("node", F.when(F.col("cut"), F.col("node")).otherwise(F.col("root")).alias("root"), F.when(F.col("cut"), 0).otherwise(F.col("depth")).cast("long").alias("depth"), "okey")
    return _roots(opened, scratch)[0], cut


def _places(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds position (from 1) within thread, by depth and okey."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = rows.repartitionByRange(parts, "thread", "depth", "okey").sortWithinPartitions("thread", "depth", "okey")
    seen = scratch.write(cut.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    ends = seen.groupBy("thread", "_p").agg(F.min("_i").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("thread").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offset = ends.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return seen.join(offset, ["thread", "_p"]).withColumn("position", F.col("_i") - F.col("_first") + F.col("_before") + 1).drop("_p", "_i", "_first", "_before")


def conversations(messages: DataFrame) -> DataFrame:
    """A row for each message: conv_id, turn, role, text (without quotes), n_quotes, n_linked, parent_conv, parent_turn, thread_conv, thread_turn, depth, position."""
    scratch = Scratch(messages.sparkSession)
    parsed = scratch.write(parse(messages))
    links = scratch.write(link(parsed, scratch))
    heads = parsed.groupBy("ckey").agg(F.min("okey").alias("head"), F.count("*").alias("n"))
    tied = join_hot(parsed.drop("passages").join(links, "mid", "left"), heads, ["ckey"])
    tied = scratch.write(tied.withColumn("parent", F.coalesce("parent", F.when(F.col("head") != F.col("okey"), F.col("head")))))
    up = tied.select(F.col("mid").alias("node"), F.coalesce("parent.mid", "mid").alias("root"), F.col("parent").isNotNull().cast("long").alias("depth"), "okey")
    roots, cut = _roots(up, scratch)
    if cut is not None:
        tied = tied.join(cut.withColumnRenamed("node", "mid"), "mid", "left").withColumn("parent", F.when(F.col("cut").isNull(), F.col("parent"))).drop("cut")
    names = parsed.select(F.col("mid").alias("root"), F.col("okey").alias("thread"))
    placed = _places(tied.join(roots, tied["mid"] == roots["node"]).drop("node").join(names, "root"), scratch)
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return placed.select(
        "conv_id", "turn", "role", "text", n("n_quotes"), n("n_linked"), F.col("parent.conv_id").alias("parent_conv"), F.col("parent.turn").alias("parent_turn"),
        F.col("thread.conv_id").alias("thread_conv"), F.col("thread.turn").alias("thread_turn"), "depth", F.col("position").cast("long").alias("position"),
    )

"""Chat formatting by quotation linking, with DataFrame operations alone.

A line's quote level is the number of > signs that it starts with. Consecutive lines of one level are a passage. A
passage, and each of its lines, is normalised (lower case, single spaces) and hashed, and so are the own passages and
lines of every message; equal hashes within a conversation link the quoting message to earlier ones. What a first-level
passage quotes is the parent: the earlier message with most matched characters, ties to the later one. Threads follow
from the parents by pointer doubling: root, depth and an order in which every reply comes after what it replies to.

Null texts are empty; null roles read as "unknown"; messages without conversation or turn are threads of their own.
Rows that share (conv_id, turn) share their place; repeated rows stay. An empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage

#: A line that introduces a quotation.
INTRODUCES = r"^(On|Am|Le|El) .*(wrote|schrieb|écrit|escribió) ?:\s*$"


def parse(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, own (the text without quotes), passages: array of (level, text)."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")

    def line(x):
        marks = F.regexp_extract(x, r"^>[> \t]*", 0)
        return F.struct(F.length(F.translate(marks, " \t", "")).alias("level"), F.substring(x, F.length(marks) + 1, F.length(x)).alias("body"))

    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.transform(lines, line).alias("l"))
    number = F.sequence(F.lit(1), F.size("l"))
    starts = F.filter(number, lambda i: (i == 1) | (F.element_at("l", i)["level"] != F.element_at("l", F.greatest(i - 1, F.lit(1)))["level"]))
    rows = rows.withColumn("s", starts)

    def passage(s, k):
        end = F.when(k + 2 <= F.size("s"), F.element_at("s", F.least(k + 2, F.size("s")))).otherwise(F.size("l") + 1)
        return F.struct(F.element_at("l", s)["level"].alias("level"), F.array_join(F.transform(F.slice("l", s, end - s), lambda x: x["body"]), "\n").alias("text"))

    own = F.filter("l", lambda x: (x["level"] == 0) & ~x["body"].rlike(INTRODUCES))
    own = F.trim(F.array_join(F.transform(own, lambda x: x["body"]), "\n"))
    return rows.select("conv_id", "turn", "role", F.regexp_replace(own, r"\n{3,}", "\n\n").alias("own"), F.transform("s", passage).alias("passages"))


def _normal(x):
    return F.trim(F.lower(F.regexp_replace(x, r"\s+", " ")))


def _keys(parsed: DataFrame, quoted: bool) -> DataFrame:
    """conv_id, turn, h1, h2, weight, level: each distinct normalised passage and line, quoted or own."""
    level = F.col("p.level")
    rows = parsed.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode("passages").alias("p")).where(level > 0 if quoted else level == 0)
    parts = F.array_union(F.array(F.col("p.text")), F.split("p.text", "\n"))
    parts = rows.select("conv_id", "turn", level.alias("level"), F.explode(parts).alias("t")).select("conv_id", "turn", "level", _normal(F.col("t")).alias("t")).where("t <> ''")
    return parts.select("conv_id", "turn", "level", F.xxhash64(F.lit(1), "t").alias("h1"), F.xxhash64(F.lit(2), "t").alias("h2"), F.length("t").alias("weight")).distinct()


def links(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, quoted_turn, level, weight: which earlier messages the quotes of a message come from."""
    quotes = _keys(parsed, True)
    # only the hashes that some quote has: an often repeated line costs nothing unless it is quoted
    own = _keys(parsed, False).select("conv_id", F.col("turn").alias("quoted_turn"), "h1", "h2").distinct()
    # of the messages that hold the passage, the last one before the quote
    both = quotes.join(own, ["conv_id", "h1", "h2"]).where("quoted_turn < turn")
    return both.groupBy("conv_id", "turn", "level", "h1", "h2", "weight").agg(F.max("quoted_turn").alias("quoted_turn")).groupBy("conv_id", "turn", "level", "quoted_turn").agg(F.sum("weight").alias("weight"))


def threads(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, parent_turn, root_turn, depth of every (conv_id, turn)."""
    best = links(parsed).where("level = 1").groupBy("conv_id", "turn").agg(F.max_by("quoted_turn", F.struct("weight", "quoted_turn")).alias("parent_turn"))
    nodes = parsed.where("conv_id is not null and turn is not null").select("conv_id", "turn").distinct()
    replies = storage.keep(best, "replies")
    state = storage.keep(replies.select("conv_id", "turn", F.col("parent_turn").alias("to"), F.lit(1).cast("long").alias("depth")), "threads")
    left = state.count()
    while left:  # twice as far in each step
        ahead = state.select("conv_id", F.col("turn").alias("to"), F.col("to").alias("next"), F.col("depth").alias("more"))
        state = state.join(ahead, ["conv_id", "to"], "left")
        moved = F.col("next").isNotNull()
        state = storage.keep(state.select("conv_id", "turn", F.coalesce("next", "to").alias("to"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), moved.alias("moved")), "threads")
        left = state.where("moved").count()
        state = state.drop("moved")
    found = replies.join(state, ["conv_id", "turn"])
    return nodes.join(found, ["conv_id", "turn"], "left").select("conv_id", "turn", "parent_turn", F.coalesce("to", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))


def conversations(messages: DataFrame) -> DataFrame:
    """conv_id, root_turn, depth, turn, parent_turn, role, text, formatted: messages without quotes. Within a
    conversation, the order of (root_turn, turn) is the reply order."""
    parsed = parse(messages)
    placed = parsed.select("conv_id", "turn", "role", "own").join(threads(parsed), ["conv_id", "turn"], "left")
    shown = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("own"), F.lit("\n<|end|>"))
    return placed.select("conv_id", F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "turn", "parent_turn", "role", F.col("own").alias("text"), shown.alias("formatted"))

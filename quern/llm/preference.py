"""Preference formatting of chosen and rejected conversations.

A pair's prompt is the longest prefix of turns that its two conversations share.  It is rendered once;
what follows in each is a completion.  The result is a row for each rendered turn, so a conversation of
any length needs no task that holds it: part (prompt, chosen, rejected), turn, the rendered text and the
span of it that a trainer learns (an assistant's words and end mark in a completion; none elsewhere).

All of it is DataFrame code.  Turns are compared by 128 bits of hashes, aggregated per turn before the
shuffle; the first turn that differs is a minimum per pair, joined back to the turns.

Defined cases: turns are ordered by their number, null numbers last; several rows of one number are one
turn and compared as a bag; a null role or text equals null only, and is rendered empty; equal
conversations are all prompt, an absent one leaves all of the other a completion; rows with a null pair
are kept out; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

START, END = "<|im_start|>", "<|im_end|>\n"
_LAST = (1 << 63) - 1


def sides(chosen: DataFrame, rejected: DataFrame, pair: str = "pair_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Both conversations of each pair as one table: pair_id, turn, role, text, side."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(pair).alias("pair_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"), F.lit(name).alias("side"))

    return side(chosen, "chosen").union(side(rejected, "rejected"))


def format_pairs(turns: DataFrame) -> DataFrame:
    """pair_id, part, turn, role, rendered, learn_from, learn_to (characters of rendered, end exclusive) of sides()."""
    both = turns.select("pair_id", "turn", "role", "text", "side").where("pair_id is not null").withColumn("at", F.coalesce("turn", F.lit(_LAST)))
    both = common.stored(both, common.scratch(turns.sparkSession, "pairs"))
    known = F.struct(F.col("role").isNull(), "role", F.col("text").isNull(), "text")
    h1, h2 = F.xxhash64(known), F.xxhash64(F.lit(1), known)
    of = lambda s, x: F.sum(F.when(F.col("side") == s, x).otherwise(F.lit(0)).cast("decimal(20,0)"))
    prints = both.groupBy("pair_id", "at").agg(*[of(s, x).alias(f"{s}{k}") for s in ("chosen", "rejected") for k, x in enumerate((F.lit(1), h1, h2))])
    differ = F.lit(False)
    for k in range(3):
        differ = differ | (F.col(f"chosen{k}") != F.col(f"rejected{k}"))
    split = prints.where(differ).groupBy("pair_id").agg(F.min("at").alias("split")).select(F.col("pair_id").alias("p"), "split")
    rows = both.join(split, both["pair_id"] == split["p"], "left")
    shared = F.col("split").isNull() | (F.col("at") < F.col("split"))
    rows = rows.where(~(shared & (F.col("side") == "rejected"))).withColumn("part", F.when(shared, "prompt").otherwise(F.col("side")))
    head = F.concat(F.lit(START), F.coalesce("role", F.lit("")), F.lit("\n"))
    rendered = F.concat(head, F.coalesce("text", F.lit("")), F.lit(END))
    learns = (F.col("part") != "prompt") & F.col("role").eqNullSafe("assistant")
    return rows.select("pair_id", "part", "turn", "role", rendered.alias("rendered"), F.when(learns, F.length(head)).otherwise(0).alias("learn_from"), F.when(learns, F.length(rendered)).otherwise(0).alias("learn_to"))


def with_foreign_reply(conversations: DataFrame) -> DataFrame:
    """sides() of conversations that end in an assistant's reply, and the same with one reply of the conversation before them.

    A conversation takes part if it and the one of the id before it have an assistant turn; the pair's id is its own.
    An odd id's first assistant turn takes the other's first reply, so its two sides branch early and go on alike; an
    even id's last takes the other's last.  What follows the last assistant turn is left out on both sides.
    """
    c = conversations.select(F.col("conv_id").cast("long").alias("pair_id"), F.col("turn").cast("long").alias("turn"), "role", "text").where("pair_id is not null and turn is not null")
    own = F.struct("turn", "text")
    ends = c.where("role = 'assistant'").groupBy("pair_id").agg(F.min(own).alias("first"), F.max(own).alias("last"))
    ends = ends.select(F.col("pair_id").alias("p"), F.col("last.turn").alias("end"), "first", "last")
    before = ends.select((F.col("p") + 1).alias("q"), F.col("first.text").alias("first_other"), F.col("last.text").alias("last_other"))
    odd = F.pmod("p", F.lit(2)) == 1
    pick = lambda a, b: F.when(odd, F.col(a)).otherwise(F.col(b))
    ends = ends.join(before, F.col("p") == F.col("q")).select("p", "end", pick("first.turn", "last.turn").alias("at"), pick("first.text", "last.text").alias("reply"), pick("first_other", "last_other").alias("other"))
    ends = common.stored(ends, common.scratch(conversations.sparkSession, "replies"))
    rows = c.join(ends.select("p", "end", "at"), c["pair_id"] == F.col("p")).where("turn <= end and turn <> at").select("pair_id", "turn", "role", "text", F.explode(F.array(F.lit("chosen"), F.lit("rejected"))).alias("side"))
    both = F.explode(F.array(F.struct(F.col("reply").alias("text"), F.lit("chosen").alias("side")), F.struct(F.col("other").alias("text"), F.lit("rejected").alias("side"))))
    replies = ends.select("p", "at", both.alias("r")).select(F.col("p").alias("pair_id"), F.col("at").alias("turn"), F.lit("assistant").alias("role"), "r.text", "r.side")
    return rows.union(replies)

"""Preference pairs: the turns that two conversations begin with alike are the prompt, the rest masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _gathered(column: Column, when: Column) -> Column:
    """Values of a group's turns that meet the condition, by their place."""
    placed = F.array_sort(F.collect_list(F.when(when, F.struct(F.col("pos"), column.alias("v")))))
    return F.transform(placed, lambda p: p["v"])


def format_turns(turns: DataFrame) -> DataFrame:
    """pair_id, n_common, prompt, chosen, chosen_mask, rejected, rejected_mask of every pair of conversations.

    `turns` has rows (pair_id, is_chosen, turn, role, text); one with a null `is_chosen` is no turn but
    makes its pair known. Turns go by their number (nulls first), then role and text; rows that repeat are turns each; a
    null role or text is empty. The prompt is the longest run of first turns with equal roles and texts, rendered
    once: role, colon, text, line break. Masks are the spans [start, end) of characters that are learned:
    the assistant's texts with their line break. A side without turns is empty. Other columns aren't read.

    Turns are shuffled once, by pair: places, lengths and the first difference come from sorted windows, which
    spill. A pair's own texts are gathered only into its result, which is one row by nature.
    """
    plain = turns.select("pair_id", "is_chosen", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    side = Window.partitionBy("pair_id", "is_chosen")
    placed = plain.repartition("pair_id").withColumn("pos", F.row_number().over(side.orderBy(F.asc_nulls_first("turn"), "role", "text")))
    there = F.col("is_chosen").isNotNull()
    at = Window.partitionBy("pair_id", "pos")  # a place's turns, one of each side
    equal = lambda c: F.min(F.when(there, F.col(c))).over(at) == F.max(F.when(there, F.col(c))).over(at)
    same = (F.count("is_chosen").over(at) == 2) & equal("role") & equal("text")
    placed = placed.withColumn("differs", F.when(there & ~same, F.col("pos")))
    pair = Window.partitionBy("pair_id")
    n_common = F.coalesce(F.min("differs").over(pair) - 1, F.max(F.when(there, F.col("pos"))).over(pair), F.lit(0)).cast("int")
    placed = placed.withColumn("n_common", n_common).withColumn("line", F.concat("role", F.lit(": "), "text", F.lit("\n"))).withColumn("shared", F.col("pos") <= F.col("n_common"))
    upto = F.sum(F.length("line")).over(Window.partitionBy("pair_id", "is_chosen", "shared").orderBy("pos")).cast("int")
    placed = placed.withColumn("end", upto)
    span = F.struct((F.col("end") - F.length("text") - 1).alias("start"), F.col("end").alias("end"))
    own = lambda chosen: F.col("is_chosen").eqNullSafe(chosen) & ~F.col("shared")
    text = lambda when: F.array_join(_gathered(F.col("line"), when), "")
    mask = lambda chosen: _gathered(span, own(chosen) & (F.col("role") == "assistant"))
    return placed.groupBy("pair_id").agg(
        F.any_value("n_common").alias("n_common"), text(F.col("is_chosen").eqNullSafe(True) & F.col("shared")).alias("prompt"),
        text(own(True)).alias("chosen"), mask(True).alias("chosen_mask"), text(own(False)).alias("rejected"), mask(False).alias("rejected_mask"),
    )


def format_preferences(conversations: DataFrame, pairs: DataFrame) -> DataFrame:
    """The result of `format_turns` for `pairs` (pair_id, chosen_id, rejected_id) of `conversations` (conv_id, turn, role, text).

    A conversation without turns, or a null id, has none.
    """
    sides = F.array(
        F.struct(F.col("chosen_id").alias("conv_id"), F.lit(True).alias("is_chosen")), F.struct(F.col("rejected_id").alias("conv_id"), F.lit(False).alias("is_chosen")),
        F.struct(F.lit(None).alias("conv_id"), F.lit(None).cast("boolean").alias("is_chosen")),
    )
    wanted = pairs.select("pair_id", F.inline(sides))
    turns = wanted.where("is_chosen is not null").join(conversations.select("conv_id", "turn", "role", "text"), "conv_id").drop("conv_id")
    empty = [F.lit(None).cast(turns.schema[c].dataType).alias(c) for c in ("turn", "role", "text")]
    return format_turns(turns.unionByName(wanted.where("is_chosen is null").select("pair_id", "is_chosen", *empty)))


def branched(conversations: DataFrame) -> DataFrame:
    """Turns of pairs for tables without judgements: (pair_id, is_chosen, turn, role, text), a pair for each conversation.

    The conversation is the chosen side. The rejected one has the same turns up to a place drawn by a
    hash of the conversation's id, and from there the turns that its neighbour (2k and 2k + 1 are neighbours) has after as many of its
    own: an answer that belongs elsewhere. The place is before the last turn of both, so both sides go on after it; a conversation's single turn is
    shared. Without a neighbour, or where that has one turn alone, the rejected side ends at the place. Conversations with a null id have no pair.
    """
    turns = conversations.where("conv_id is not null").select("conv_id", "turn", "role", "text")
    place = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    turns = turns.withColumn("pos", F.row_number().over(place)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("conv_id")))
    draw = F.conv(F.substring(F.md5(F.col("conv_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    neighbour = F.col("conv_id").bitwiseXOR(F.lit(1).cast("long"))
    lengths = turns.where("pos = 1").select("conv_id", "n")
    both = lengths.join(lengths.select(neighbour.alias("conv_id"), F.col("n").alias("other_n")), "conv_id", "left")
    cuts = both.select("conv_id", (F.pmod(draw, F.greatest(F.least("n", "other_n") - 1, F.lit(1))) + 1).alias("keep"))
    sides = F.when(F.col("pos") <= F.col("keep"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))
    own = turns.join(cuts, "conv_id").select(F.col("conv_id").alias("pair_id"), F.explode(sides).alias("is_chosen"), "pos", "role", "text")
    other = turns.withColumn("conv_id", neighbour).join(cuts, "conv_id").where("pos > keep").select(F.col("conv_id").alias("pair_id"), F.lit(False).alias("is_chosen"), "pos", "role", "text")
    return own.unionByName(other).withColumnRenamed("pos", "turn")


def spans_as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")

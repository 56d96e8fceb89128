"""Operator 8: chat formatting by multi-party perspective rotation.

For every participant of a conversation the whole dialogue is rendered with
that speaker as the assistant and the others as named users; the mask spans
what the speaker said (text and end mark).  System turns are system turns in
every view.

A conversation is cut into parts of 64 turn numbers (more finely where a part
would hold more than 256 rows: by turn number, by the hash of role and text
and by position in that order; copies of a turn are counted first), so that a conversation that fills a third of
the table is many rows of bounded size; the parts in order are the whole
dialogue, and spans count from the start of their part.

Defined results: turns are in the order of their number (null last), rows of
one number in that of a hash of role and text; a row without conversation id
is a conversation of its own; a row without role is spoken by ``unknown``; a
null text is empty; the strings that mark turns are broken up inside texts; a
conversation of system turns alone has one view, without speaker and mask;
repeated rows are repeated turns; other columns are ignored; an empty table
gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART_TURNS, PART_ROWS = 64, 256
SYSTEM, NOBODY = "system", "unknown"
START, END = "<|im_start|>", "<|im_end|>\n"


def _turns(table: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    said = F.coalesce(F.replace(F.col(text_col), F.lit("<|im_"), F.lit("< |im_")), F.lit(""))
    rows = table.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                        F.coalesce(F.col(role_col), F.lit(NOBODY)).alias("role"), said.alias("said"))
    tie = F.md5(F.concat("role", F.lit("|"), "said"))
    return (rows.withColumn("tie", tie)
            .withColumn("place", F.coalesce("turn", F.lit(2**63 - 1)))
            .withColumn("block", F.floor(F.col("place") / PART_TURNS)))


def _render(speaker: Column, turns: Column) -> Column:
    """struct(text, mask, n_masked) of a part, a sorted array of (place, tie, role, said)."""
    def segment(t: Column) -> Column:
        own = F.coalesce(t["role"] == speaker, F.lit(False))
        who = (F.when(t["role"] == SYSTEM, F.lit(SYSTEM)).when(own, F.lit("assistant"))
               .otherwise(F.concat(F.lit("user name="), t["role"])))
        return F.struct(F.concat(F.lit(START), who, F.lit("\n")).alias("head"),
                        F.concat(t["said"], F.lit(END)).alias("body"), own.alias("own"))

    def add(state: Column, s: Column) -> Column:
        begin = state["at"] + F.char_length(s["head"])
        end = begin + F.char_length(s["body"])
        span = F.concat(begin.cast("string"), F.lit("-"), end.cast("string"))
        return F.struct(end.alias("at"),
                        F.when(s["own"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"),
                        (state["masked"] + F.when(s["own"], F.char_length(s["body"])).otherwise(0)).alias("masked"))

    segments = F.transform(turns, segment)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"), F.lit(0).alias("masked"))
    state = F.aggregate(segments, zero, add)
    return F.struct(F.array_join(F.transform(segments, lambda s: F.concat(s["head"], s["body"])), "").alias("text"),
                    state["spans"].alias("mask"), state["masked"].cast("long").alias("n_masked"))


def rotate(table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """conv_id, speaker, part, n_turns, text, mask (array of 'begin-end'), n_masked."""
    rows = _turns(table, conv_col, turn_col, role_col, text_col)
    alone = (rows.filter(F.col("conv_id").isNull())
             .withColumn("speaker", F.when(F.col("role") != SYSTEM, F.col("role")))
             .select("conv_id", "speaker", F.lit("0").alias("part"),
                     F.array(F.struct("place", "tie", "role", "said")).alias("turns")))
    rows = rows.filter(F.col("conv_id").isNotNull())
    # rows of a part; larger parts are cut by turn, by ranges of the tie order and, as copies
    # have one place in that order, by position, copies being one row until then
    crowded = (rows.groupBy("conv_id", "block").agg(F.count("*").alias("n")).filter(F.col("n") > PART_ROWS)
               .select("conv_id", "block", F.ceil(F.col("n") / PART_ROWS).alias("cuts")))
    rows_cut = rows.join(crowded, ["conv_id", "block"], "left")
    turn = ["place", "tie", "role", "said"]
    whole = rows_cut.filter("cuts is null").select("conv_id", F.col("block").cast("string").alias("part"), *turn, F.lit(1).alias("copies"))
    cut = F.floor(F.conv(F.substring("tie", 1, 4), 16, 10).cast("long") * F.col("cuts") / 65536)
    order = Window.partitionBy("conv_id", "block", "place", "cut").orderBy("tie", "role", "said")
    begin, end = F.greatest("begin", F.col("chunk") * PART_ROWS), F.least("end", (F.col("chunk") + 1) * PART_ROWS)
    chunks = F.sequence(F.floor(F.col("begin") / PART_ROWS), F.floor((F.col("end") - 1) / PART_ROWS))
    cut_up = (rows_cut.filter("cuts is not null").withColumn("cut", cut)
              .groupBy("conv_id", "block", "cut", *turn).agg(F.count("*").alias("n"))
              .withColumn("end", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("begin", F.col("end") - F.col("n")).withColumn("chunk", F.explode(chunks))
              .select("conv_id", F.concat_ws("/", "block", "place", "cut", "chunk").alias("part"), *turn,
                      (end - begin).cast("int").alias("copies")))
    said = F.array_sort(F.collect_list(F.struct(*turn, "copies")))
    parts = (whole.union(cut_up).groupBy("conv_id", "part").agg(said.alias("turns"))
             .withColumn("turns", F.flatten(F.transform("turns", lambda t: F.array_repeat(F.struct(*[t[c] for c in turn]), t["copies"])))))
    speakers = rows.filter(F.col("role") != SYSTEM).select("conv_id", F.col("role").alias("speaker")).distinct()
    views = parts.join(speakers, "conv_id", "left").select("conv_id", "speaker", "part", "turns").union(alone)
    return (views.withColumn("view", _render(F.col("speaker"), F.col("turns")))
            .select("conv_id", "speaker", "part", F.size("turns").cast("long").alias("n_turns"),
                    "view.text", "view.mask", "view.n_masked"))

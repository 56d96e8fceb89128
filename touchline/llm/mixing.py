"""Operator 1: mix sources to target weights (DataFrame functions only).

Every document gets a hash-random key.  Within a source the documents are
range-sorted by that key: 65,536 key ranges hold the order, prefix sums of
the word counts run over the ranges (two levels of at most 256 rows a
window), and only the one range per source in which the budget ends is
sorted document by document.  A document is then taken or not by comparing
its key with its source's cut, so neither texts nor ids are shuffled and a
source that holds most rows is cut as cheaply as any other.

A budget above the source's size repeats it: whole epochs first, then the
cut.  The document at the cut is taken in part (its first words), so each
source meets the whole part of its target exactly.

Defined results: a null text has size 0 and is never taken in part; null is
a source of its own (last in order); rows equal in id and size (repeated
rows) share one key and are cut alike, each at the same number of words, so
a source may then fall short by fewer words than it has such rows; null ids
draw their key from the text; an empty table gives an empty mix; columns
other than the three named ones are ignored.

Bound: one row per source passes through the windows that rank sources and
fill their targets.  Sources are the lines of a mixing table, not documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import cut_lineage, fresh_name

BROADCAST_SOURCES = 20_000     # rows of about 150 bytes

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_key(doc_id: Column, text: Column, size: Column) -> Column:
    """The random key: 32 hex digits, the same in every run."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")))),
                          F.lit("|"), size.cast("string")))


def cyclic_weights(sources: DataFrame, cycle: Sequence[float] = (5, 2, 1)) -> DataFrame:
    """(source, source_size) -> the same with ``weight``: the cycle dealt out
    to the sources in code-point order, null last."""
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (at % len(cycle) + 1).cast("int"))
    return sources.withColumn("weight", weight)


def fill_targets(sources: DataFrame, share: float = 1.0, max_epochs: int = 3) -> DataFrame:
    """(source, source_size, weight) -> plus ``target`` (double).

    ``share`` of the words of these sources is divided by weight; no target exceeds
    ``max_epochs`` times its source, and the excess is divided among the
    others by weight until none does.  In the order of cap / weight the
    capped sources come first; the level (words per unit of weight) that is
    left for the others after capping the first i sources rises with i while
    the next source is still capped and falls afterwards, so the answer is
    its maximum over one pass of prefix sums.
    """
    cap = (F.lit(max_epochs) * F.col("source_size")).cast("double")
    by_level = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = (sources.withColumn("_cap", cap)
              .withColumn("_all", F.sum("source_size").over(whole).cast("double") * F.lit(float(share)))
              .withColumn("_level", (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
                          / F.sum("weight").over(onward))
              .withColumn("_level", F.max("_level").over(whole)))
    target = F.least(F.col("_cap"), F.col("_level") * F.col("weight"))
    return filled.withColumn("target", target).drop("_cap", "_all", "_level")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = F.col(text_col)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                       word_count(text).alias("size"), text.alias("text"))
    return slim.select("doc_id", "source", "size",
                       hash_key(F.col("doc_id"), F.col("text"), F.col("size")).alias("key"))


def source_cuts(sized: DataFrame, cycle: Sequence[float] = (5, 2, 1), share: float = 1.0, max_epochs: int = 3,
                weights: DataFrame | None = None) -> DataFrame:
    """One row per source: source, source_size, target, epochs (taken whole),
    cut_key and cut_words (what the documents at the cut still give).

    ``sized``: (source, size, key).  ``weights``: (source, weight), in place
    of the cycle; a source it lacks weighs nothing and gives nothing.
    """
    # null-safe grouping key: Spark then plans plain equi-joins on it
    src = [F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_src")]
    rows = sized.select(*src, "size", "key", F.substring("key", 1, 2).alias("_hi"), F.substring("key", 1, 4).alias("_lo"))
    ranges = cut_lineage(rows.groupBy("_none", "_src", "_hi", "_lo").agg(F.sum("size").alias("words")))

    sizes = (ranges.groupBy("_none", "_src").agg(F.sum("words").alias("source_size"))
             .select(F.when(~F.col("_none"), F.col("_src")).alias("source"), "source_size"))
    if weights is None:
        weighed = cyclic_weights(sizes, cycle)
    else:
        given = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("weight"))
        weighed = (sizes.join(given, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
                   .filter(F.col("weight") > 0))
    targets = fill_targets(weighed, share, max_epochs)
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0))
    targets = cut_lineage(targets.withColumn("epochs", epochs.cast("long"))
                          .withColumn("rest", (budget - F.col("epochs") * F.col("source_size")).cast("long"))
                          .select(*src, "source", "source_size", "target", "epochs", "rest"))

    # prefix sums: over the coarse ranges of a source, then the fine ranges of a coarse one
    coarse = (ranges.groupBy("_none", "_src", "_hi").agg(F.sum("words").alias("_sum"))
              .withColumn("_base", F.sum("_sum").over(Window.partitionBy("_none", "_src").orderBy("_hi")) - F.col("_sum")))
    fine = ranges.withColumn("_in", F.sum("words").over(
        Window.partitionBy("_none", "_src", "_hi").orderBy("_lo")) - F.col("words"))
    ends = (fine.join(coarse.drop("_sum"), ["_none", "_src", "_hi"])
            .withColumn("_start", F.col("_base") + F.col("_in"))
            .join(targets.select("_none", "_src", "rest"), ["_none", "_src"])
            .filter((F.col("_start") <= F.col("rest")) & (F.col("rest") < F.col("_start") + F.col("words")))
            .select("_none", "_src", "_lo", "_start", "rest"))

    # inside the range of the cut: document by document (equal keys together)
    keys = (rows.join(ends, ["_none", "_src", "_lo"])
            .groupBy("_none", "_src", "key").agg(F.count("*").alias("_n"), F.max("size").alias("_size"),
                                                 F.first("_start").alias("_start"), F.first("rest").alias("rest")))
    mine = Window.partitionBy("_none", "_src").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_start") + F.coalesce(F.sum(F.col("_n") * F.col("_size")).over(mine), F.lit(0))
    cuts = (keys.withColumn("_before", before)
            .filter((F.col("_before") <= F.col("rest"))
                    & (F.col("rest") < F.col("_before") + F.col("_n") * F.col("_size")))
            .select("_none", "_src", F.col("key").alias("cut_key"),
                    F.expr("(rest - _before) div _n").alias("cut_words")))
    return (targets.join(cuts, ["_none", "_src"], "left")
            .select("_none", "_src", "source", "source_size", "target", "epochs", "cut_key", "cut_words"))


def _with_cuts(rows: DataFrame, cuts: DataFrame, on: list[str], key_col: str) -> DataFrame:
    """``rows`` (inner) joined with their source's cut.  The cuts go to every
    task if they are counted and few; more of them are dealt by source and
    the key's first digit, so that a hot source is sixteen tasks, not one."""
    cuts = cut_lineage(cuts)
    if cuts.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(cuts), on)
    digit = fresh_name(rows, "_digit")
    spread = cuts.withColumn(digit, F.explode(F.array(*[F.lit(x) for x in "0123456789abcdef"])))
    return rows.withColumn(digit, F.substring(key_col, 1, 1)).join(spread, [*on, digit]).drop(digit)


def _taken(size: Column) -> Column:
    part = (F.when(F.col("key") < F.col("cut_key"), size)
            .when(F.col("key") == F.col("cut_key"), F.col("cut_words")).otherwise(F.lit(0)))
    return (F.col("epochs") * size + part).cast("long")


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             **options) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: one row per document
    (see the module text for the rules).  ``options``: as ``source_cuts``."""
    sized = cut_lineage(_sized(docs, id_col, text_col, source_col))
    cuts = source_cuts(sized, **options).drop("source")
    if options.get("weights") is not None:                 # sources without a weight stay in the plan, untaken
        weighed = cuts
        every = sized.select(F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_src"))
        cuts = every.distinct().join(weighed, ["_none", "_src"], "left")
    keyed = sized.withColumn("_none", F.col("source").isNull()).withColumn("_src", F.coalesce("source", F.lit("")))
    taken = F.coalesce(_taken(F.col("size")), F.lit(0).cast("long"))
    return (_with_cuts(keyed, cuts, ["_none", "_src"], "key")
            .select("doc_id", "source", "size", "source_size", "target", taken.alias("taken")))


def first_words(text: Column, n: Column) -> Column:
    """``text`` up to the end of its n-th word, white space kept as it is."""
    # pieces: each word with the white space before it
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                  **options) -> DataFrame:
    """The mixed corpus: ``docs`` with every row repeated as often as the plan
    takes it; the part taken of the document at a cut is a row with that text.
    Rows that the mix does not take are gone; columns stay as they are."""
    cuts = source_cuts(cut_lineage(_sized(docs, id_col, text_col, source_col)), **options)
    src = fresh_name(docs, "_mix_src")
    inner = {c: fresh_name(docs, f"_mix_{c}") for c in ("none", "size", "key", "epochs", "cut_key", "cut_words", "copy")}
    right = cuts.select(F.col("_none").alias(inner["none"]), F.col("_src").alias(src),
                        *[F.col(c).alias(inner[c]) for c in ("epochs", "cut_key", "cut_words")])
    size, key, part = F.col(inner["size"]), F.col(inner["key"]), F.col(inner["cut_words"])
    keyed = (docs.withColumn(src, F.coalesce(F.col(source_col), F.lit("")))
           .withColumn(inner["none"], F.col(source_col).isNull())
           .withColumn(inner["size"], word_count(F.col(text_col)))
           .withColumn(inner["key"], hash_key(F.col(id_col), F.col(text_col), F.col(inner["size"]))))
    out = _with_cuts(keyed, right, [inner["none"], src], inner["key"])
    more = (F.when(size == 0, F.lit(0)).when(key < F.col(inner["cut_key"]), F.lit(1))
            .when((key == F.col(inner["cut_key"])) & (part > 0), F.lit(1)).otherwise(F.lit(0)))
    copies = F.col(inner["epochs"]) + more
    out = (out.filter(copies > 0)
           .withColumn(inner["copy"], F.explode(F.sequence(F.lit(1).cast("long"), copies.cast("long")))))
    last = (key == F.col(inner["cut_key"])) & (F.col(inner["copy"]) > F.col(inner["epochs"])) & (part < size)
    text = F.when(last, first_words(F.col(text_col), part)).otherwise(F.col(text_col))
    return out.withColumn(text_col, text).select(*docs.columns)

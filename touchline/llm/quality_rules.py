"""Operator 12: quality rules as one projection.

``RULES`` is a table of thresholds.  Every rule is a ratio of two measures of
a text (length, symbols, stop words, lines) with a least and a greatest
value; the table compiles into one list of conditions that Spark evaluates
beside each other in a single projection.  Measures are DataFrame functions
too, so a text is neither shuffled nor handed to Python, and the work per
task follows the text it reads, whatever the skew of sources or copies.

Ratios are compared in whole thousandths (``1000 * part`` against ``least *
whole``), so no verdict hangs on rounding.

Repeated words are found within the row: every window of eight words is a
64-bit hash, the hashes of a text with a repeated one are sorted, and
neighbours of equal hash are compared word by word.

Defined results: a null text has no words, like an empty one, and fails the
base; a null id is a row like any other; repeated rows get equal verdicts; a
ratio of nothing (``whole`` is 0) passes; texts are read whole; other
columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL, UPPER = "[#*$%&|<>]", "[A-Z]"
BULLET, ELLIPSIS = r"^[\x20\x09-\x0D]*[-*\x{2022}\x{25CF}]", r"(?:\.\.\.|\x{2026})[\x20\x09-\x0D]*$"
WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30          # words; percent of the words

#: Frequent function words of four languages.
STOP_WORDS = {
    "en": "the of and to a in is that it for was on with as be by are this at from or an not but have which".split(),
    "fr": "de la le et les des en un du une que est pour par avec qui dans pas sur au ou il ne ce se plus".split(),
    "de": "der die und in den von zu das sich mit auf für des ist im dem nicht ein eine als auch es an er".split(),
    "es": "de la que el en y los se las del un por con no una para su es al lo como más o pero sus le".split(),
}


@dataclass(frozen=True)
class Rule:
    """``part`` over ``whole`` must lie between ``least`` and ``most``, both in thousandths."""
    name: str
    part: str
    whole: str
    least: int | None = None
    most: int | None = None

    def broken(self) -> Column:
        part, whole = F.col(self.part) * 1000, F.col(self.whole)
        out = F.lit(False)
        if self.least is not None:
            out = out | (part < whole * self.least)
        return out | (part > whole * self.most) if self.most is not None else out


RULES = (
    Rule("word_length", "word_chars", "n_words", least=2_500, most=12_000),
    Rule("symbols", "n_symbols", "n_words", most=200),
    Rule("upper_case", "n_upper", "word_chars", most=500),
    Rule("stop_words", "n_stop_words", "n_words", least=60),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=500),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", most=900),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", most=300),
)


def _count(text: Column, chars: str) -> Column:
    """How many characters of the class ``chars`` a text has."""
    return (F.char_length(text) - F.char_length(F.regexp_replace(text, chars, ""))).cast("long")


def _repeated(df: DataFrame) -> DataFrame:
    """``words`` -> ``n_repeat_words``: words in windows that occur twice or more.

    The result leaves through a generator of one row: a caller's filter on a
    verdict would else be pushed below these projections and repeat each of
    them as often as the next one names it."""
    paired = lambda c, step: F.zip_with(c, F.slice(c, step + 1, F.greatest(F.size(c) - step, F.lit(0))),
                                        lambda x, y: F.xxhash64(x, y))
    hashes = df.withColumn("_h", F.transform("words", lambda w: F.xxhash64(w)))
    for step in (1, 2, 4):                                               # hashes of 2, 4, 8 words
        hashes = hashes.withColumn("_h", paired("_h", step))
    windows = F.slice("_h", 1, F.greatest(F.size("words") - WINDOW + 1, F.lit(0)))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    ranked = F.when(F.size(F.array_distinct("_w")) < F.size("_w"), F.sort_array(
        F.transform("_w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none)
    at = lambda i: F.slice("words", i + 1, WINDOW)                       # noqa: E731
    same = lambda x, y: F.coalesce((x["h"] == y["h"]) & (at(x["i"]) == at(y["i"])), F.lit(False))
    starts = F.sort_array(F.transform(
        F.filter("_s", lambda x, n: same(x, F.get("_s", n - 1)) | same(x, F.get("_s", n + 1))), lambda x: x["i"]))
    covered = F.aggregate(
        F.transform("_r", lambda p, n: F.coalesce(F.least(F.get("_r", n + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0).cast("long"), lambda total, x: total + x)
    return (hashes.withColumn("_w", windows).withColumn("_s", ranked).withColumn("_r", starts)
            .withColumn("n_repeat_words", F.explode(F.array(covered))).drop("_h", "_w", "_s", "_r"))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             stop_words: Sequence[str] | None = None) -> DataFrame:
    """doc_id and the measures that rules may name, one row a document."""
    listed = [w for group in STOP_WORDS.values() for w in group] if stop_words is None else stop_words
    stops = sorted({form for w in listed for form in (w.lower(), w.upper(), w.capitalize())})
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    cut = (slim.withColumn("words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
           .withColumn("lines", F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))))
    count = lambda found: F.size(found).cast("long")                     # noqa: E731
    return _repeated(cut).select(
        "doc_id", count("words").alias("n_words"), F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _count(text, SYMBOL).alias("n_symbols"),
        (count("lines") - count(F.array_distinct("lines"))).alias("n_dup_lines"), "n_repeat_words",
        count("lines").alias("n_lines"), _count(text, UPPER).alias("n_upper"),
        count(F.filter("words", lambda w: w.isin(stops))).alias("n_stop_words"),
        count(F.filter("lines", lambda x: x.rlike(BULLET))).alias("n_bullet_lines"),
        count(F.filter("lines", lambda x: x.rlike(ELLIPSIS))).alias("n_ellipsis_lines"))


def verdicts(measured: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``measured`` with base_failed, kept and the names of the broken rules
    (joined by commas): the whole table of rules in one projection."""
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    names = F.concat_ws(",", *[F.when(rule.broken(), F.lit(rule.name)) for rule in rules])
    return measured.select(*measured.columns, base.alias("base_failed"),
                           (~base & (names == "")).alias("kept"), names.alias("broken_rules"))


def apply_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text",
                stop_words: Sequence[str] | None = None) -> DataFrame:
    """The measures and the verdict of every document."""
    return verdicts(measures(docs, id_col, text_col, stop_words), rules)

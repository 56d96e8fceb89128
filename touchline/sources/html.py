"""Element extraction from stored HTML pages.

A page is cut into tokens (comments, scripts and styles, tags, text) by one
regular expression of possessive parts: it neither backtracks nor recurses,
so its time and stack do not depend on what a page holds.  Tokens of the
wanted tag and text become rows; brackets are matched by running depth: a
running sum of +1 and -1, kept from falling below zero by its running
minimum, gives every tag its level, and on one level opening and closing tags
follow each other in pairs.  Text is written once per page; an element is the
piece of it between the offsets of its tags, so nested elements cost what
they return.  Rows are dealt by page once; windows, pairs and texts share it.

Tag names and attribute names match in any case; the class attribute is a set
of tokens, in either kind of quotes or none.  An element that is never closed
reaches to the end of the page, like a comment or script that is not; an end
tag without a start is passed over; a ``<`` that starts no tag is text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKENS = (r"(?is)(<!--(?:.*?-->|.*+)|<script\b(?:.*?</script\s*+>|.*+)|<style\b(?:.*?</style\s*+>|.*+)"
          r"|<[a-z/!](?:[^'\"<>]++|\"[^\"]*+\"|'[^']*+')*+>|[^<]++|<)")
CLASS_VALUE = r"(?is)\sclass\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))"


def _has_class(tag_text: Column, css_class: str) -> Column:
    value = F.concat(*[F.regexp_extract(tag_text, CLASS_VALUE, i) for i in (1, 2, 3)])
    return F.array_contains(F.split(F.trim(value), r"\s+"), css_class)


def _tokens(pages: DataFrame, tag: str, css_class: str | None, html_col: str, keep) -> DataFrame:
    """page (a number), keep columns, at, move (+1 opens, -1 closes, 0 text), wanted, said."""
    token = F.col("token")
    opens, closes = rf"(?is)^<{re.escape(tag)}(?=[\s/>])", rf"(?is)^</{re.escape(tag)}\s*+>"
    move = (F.when(token.rlike(opens), 1).when(token.rlike(closes), -1)
            .when(~token.rlike("^<[a-zA-Z/!]"), 0))
    wanted = _has_class(token, css_class) if css_class is not None else F.lit(True)
    cut = (pages.select(*keep, F.monotonically_increasing_id().alias("_page"),
                        F.regexp_extract_all(F.col(html_col), F.lit(TOKENS), F.lit(1)).alias("_tokens"))
           .filter(F.exists("_tokens", lambda t: t.rlike(opens)))
           .select(*keep, "_page", F.posexplode("_tokens").alias("_at", "token")))
    return (cut.withColumn("_move", move).filter("_move is not null")
            .withColumn("_wanted", (F.col("_move") == 1) & wanted)
            .withColumn("_said", F.when(F.col("_move") == 0, token)).drop("token"))


def html_elements(pages: DataFrame, tag: str, css_class: str | None = None, *,
                  html_col: str = "html", keep=("page_id", "url")) -> DataFrame:
    """One row per matching element: the kept page columns, the 0-based
    ``element_index`` in order of the opening tags and the element ``text``
    (tags removed, trimmed)."""
    rows = _tokens(pages, tag, css_class, html_col, keep).repartition("_page")
    order = Window.partitionBy("_page").orderBy("_at")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    running = (rows.withColumn("_sum", F.sum("_move").over(so_far))
               .withColumn("_offset", F.sum(F.coalesce(F.char_length("_said"), F.lit(0))).over(so_far))
               .withColumn("_low", F.least(F.min("_sum").over(so_far), F.lit(0)))
               .withColumn("_was", F.coalesce(F.lag("_low").over(order), F.lit(0))))
    stray = (F.col("_move") == -1) & (F.col("_low") < F.col("_was"))
    level = F.col("_sum") - F.col("_low") + F.when(F.col("_move") == -1, 1).otherwise(0)
    pairs = Window.partitionBy("_page", "_level").orderBy("_at")
    found = (running.filter((F.col("_move") != 0) & ~stray).withColumn("_level", level)
             .withColumn("_end", F.lead("_offset").over(pairs)).filter("_wanted")
             .withColumn("element_index", F.row_number().over(order) - 1))
    texts = rows.filter("_move = 0").groupBy("_page").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("_at", "_said"))), lambda x: x["_said"]), "").alias("_text"))
    whole = F.coalesce("_text", F.lit(""))
    inner = F.substring(whole, (F.col("_offset") + 1).cast("int"),
                        (F.coalesce("_end", F.char_length(whole)) - F.col("_offset")).cast("int"))
    return found.join(texts, "_page", "left").select(*keep, "element_index", F.trim(inner).alias("text"))

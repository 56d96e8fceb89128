"""Operator 13: ranked lexical search by bag deduplication.

A document counts for a query set only by the terms that occur in it: texts
are cut to the items' vocabulary, as a bag of (term, occurrences).  Its
length enters the score through one small integer ``m``, so documents with
the same bag and the same ``m`` have the same score for every item.  Such
documents form a class: a 64-bit hash finds the candidates, the whole bag and
``m`` are compared with it, and every class is scored once.  Members of a
class are ranked by id, so no more than its k smallest ids can be among an
item's k best; that rank limit runs in the map tasks before the shuffle, and
a class that holds a third of the documents is k rows like any other.

Scores are integers.  Classes and items are dealt into blocks; a block scores
its items over the postings of its classes in numpy, sends on k rows an item,
and one last rank by item merges them.  The k best classes by (score,
smallest id) hold the k best documents, as every class has a member at its
smallest id.

Defined results: a null or empty text has no terms, counts for nothing and is
never found; an item without terms that documents hold has no rows; rows of a
repeated doc_id are documents of their own; null ids rank after all others of
their score; items are distinct rows (id and text), a repeated row is one
item; texts are read whole; other columns are ignored; empty tables give an
empty one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import arrow_text_runs, written

#: Fixed value: a term is ASCII letters and digits and everything above ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ITEM_BLOCK = 512               # items
CLASS_BLOCK = 4096             # classes, of
BLOCK_POSTINGS = 1_000_000     # postings at most on average
VOCABULARY_BYTES = 64_000_000  # of the terms that travel to the tasks

_terms = re.compile(TERM).findall
_UPPER = {c: c + 32 for c in range(65, 91)}


def terms_of(text: str | None) -> list[str]:
    """The terms of a text, A-Z lower-cased, in order."""
    if not text:
        return []
    return _terms(text.lower() if text.isascii() else text.translate(_UPPER))


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item (a key of id and text), item_id, term, times of every distinct item."""
    part = lambda c: F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(c).cast("string")))
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    once = (items.select(F.md5(F.concat(part(id_col), F.lit("|"), part(text_col))).alias("item"),
                         F.col(id_col).alias("item_id"), F.regexp_extract_all(text, F.lit(TERM), F.lit(0)).alias("terms"))
            .dropDuplicates(["item"]))
    return (once.select("item", "item_id", F.explode("terms").alias("term"))
            .groupBy("item", "item_id", "term").agg(F.count("*").alias("times")))


def bags(docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (terms), term (ascending numbers), tf of every document;
    ``vocabulary``: (term, number)."""
    spark = docs.sparkSession
    size = vocabulary.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
    if size > VOCABULARY_BYTES:
        return _bags_joined(docs, vocabulary, id_col, text_col)
    known = spark.sparkContext.broadcast({r["term"]: r["number"] for r in vocabulary.toLocalIterator()})
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = slim.schema["doc_id"].dataType.simpleString()

    def run(batches) -> Iterator:
        import pyarrow as pa
        number = known.value
        for batch, texts in arrow_text_runs(batches):
            n, starts, term, tf = np.zeros(len(texts), np.int64), np.zeros(len(texts) + 1, np.int32), [], []
            for i, text in enumerate(texts):
                found = terms_of(text)
                n[i] = len(found)
                held = sorted((number[t], c) for t, c in Counter(found).items() if t in number)
                term += [t for t, _ in held]
                tf += [c for _, c in held]
                starts[i + 1] = len(term)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), pa.ListArray.from_arrays(pa.array(starts), pa.array(term, pa.int32())),
                 pa.ListArray.from_arrays(pa.array(starts), pa.array(tf, pa.int64()))], ["doc_id", "n", "term", "tf"])

    return slim.mapInArrow(run, f"doc_id {schema}, n long, term array<int>, tf array<long>")


def _bags_joined(docs: DataFrame, vocabulary: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The same for a vocabulary too large to send to every task: terms are joined."""
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = written(docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"),
                               F.regexp_extract_all(text, F.lit(TERM), F.lit(0)).alias("terms")), "search-terms")
    held = (rows.select("row", F.explode("terms").alias("term")).groupBy("row", "term").agg(F.count("*").alias("tf"))
            .join(vocabulary, "term").groupBy("row")
            .agg(F.sort_array(F.collect_list(F.struct(F.col("number").alias("term"), "tf"))).alias("bag")))
    bag = F.coalesce("bag", F.array().cast("array<struct<term:int,tf:bigint>>"))
    return (rows.select("doc_id", "row", F.size("terms").cast("long").alias("n")).join(held, "row", "left")
            .select("doc_id", "n", F.transform(bag, lambda b: b["term"]).alias("term"),
                    F.transform(bag, lambda b: b["tf"]).alias("tf")))


def classes_of(bagged: DataFrame, k: int) -> DataFrame:
    """m, term, tf, members (its k smallest ids), nameless (members without an
    id among these k) of every class of documents with an item's term; hash
    first, then bag and m are compared."""
    total = bagged.agg(F.count(F.when(F.col("n") > 0, 1)).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    wide = lambda x: F.lit(str(x)).cast("decimal(20,0)")                # noqa: E731
    m = (F.lit(75) + F.call_function("div", F.col("n").cast("decimal(18,0)") * wide(25 * total["N"]), wide(max(1, total["L"]))))
    key = ["hash", "m", "term", "tf"]
    rows = (bagged.filter(F.size("term") > 0).withColumn("m", m.cast("long"))
            .withColumn("hash", F.xxhash64("m", "term", "tf")))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.asc_nulls_last("doc_id")))
    return (rows.withColumn("nth", nth).filter(F.col("nth") <= k).groupBy(*key)
            .agg(F.sort_array(F.collect_list("doc_id")).alias("members"),
                 F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nameless")))


def term_weights(bagged: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """term, number, weight of every vocabulary term that documents hold."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()                                        # at most the vocabulary
        for batch in batches:
            if len(batch):
                term, n = np.unique(np.concatenate([np.asarray(t, np.int64) for t in batch["term"]]), return_counts=True)
                seen.update(dict(zip(term.tolist(), n.tolist())))
        yield pd.DataFrame({"number": np.array(list(seen), np.int32), "df": np.array(list(seen.values()), np.int64)})

    df = bagged.select("term").mapInPandas(count, "number int, df long").groupBy("number").agg(F.sum("df").alias("df"))
    n_docs = bagged.filter("n > 0").count()
    weight = F.floor(1000 * F.log((2.0 * F.lit(n_docs) + 2.0) / (2.0 * F.col("df") + 1.0)))
    return vocabulary.join(df, "number").select("term", "number", weight.alias("weight"))


def best_of_block(asked: pd.DataFrame, found: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best documents of each item in one block.  ``asked``: item,
    number, gain (weight times occurrences); ``found``: m, term, tf, members."""
    size = np.array([len(t) for t in found["term"]])
    owner = np.repeat(np.arange(len(found)), size)
    term, tf = np.concatenate(found["term"].to_list()).astype(np.int64), np.concatenate(found["tf"].to_list()).astype(np.int64)
    worth = (1_000_000_000 * tf) // (1000 * tf + 12 * found["m"].to_numpy(np.int64)[owner])
    order = np.argsort(term, kind="stable")
    term, owner, worth = term[order], owner[order], worth[order]
    members = [[*m, *[None] * n] for m, n in zip(found["members"], found["nameless"])]
    first = np.array([m[0] for m in members if m[0] is not None])
    lowest = np.full(len(found), len(first))                             # places of the smallest ids, none last
    lowest[[m[0] is not None for m in members]] = np.unique(first, return_inverse=True)[1] if len(first) else 0
    out = []
    for item, group in asked.groupby("item", sort=False):
        score = np.zeros(len(found), np.int64)
        numbers = group["number"].to_numpy(np.int64)
        for a, b, gain in zip(np.searchsorted(term, numbers), np.searchsorted(term, numbers, side="right"),
                              group["gain"].to_numpy(np.int64)):
            score[owner[a:b]] += gain * worth[a:b]                       # a class holds a term once
        hit = np.flatnonzero(score > 0)
        if len(hit) > k:
            least = np.partition(score[hit], len(hit) - k)[len(hit) - k]
            hit = hit[score[hit] >= least]
        hit = hit[np.lexsort((lowest[hit], -score[hit]))][:k]
        rows = sorted(((-int(score[h]), x is None, x) for h in hit for x in members[h]), key=lambda r: r[:2] if r[1] else r)
        out += [(item, x, -low) for low, _, x in rows[:k]]
    item, doc_id, score = zip(*out) if out else ((), (), ())
    return pd.DataFrame({"item": pd.Series(item, dtype=object), "doc_id": pd.Series(doc_id, dtype=object),
                         "score": pd.Series(score, dtype=np.int64)})


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text",
           item_id_col: str = "item_id", item_text_col: str = "text", item_block: int = ITEM_BLOCK,
           class_block: int = CLASS_BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item."""
    asked = written(item_terms(items, item_id_col, item_text_col), "search-items")
    place = F.dense_rank().over(Window.partitionBy("part").orderBy("term"))
    spread = asked.select("term").distinct().withColumn("part", F.pmod(F.xxhash64("term"), F.lit(64)).cast("int"))
    vocabulary = written(spread.withColumn("number", ((place - 1) * 64 + F.col("part")).cast("int")).drop("part"),
                         "search-vocabulary")
    bagged = written(bags(docs, vocabulary, id_col, text_col), "search-bags")
    found = written(classes_of(bagged, k), "search-classes")
    gains = (asked.join(term_weights(bagged, vocabulary), "term")
             .select("item", "item_id", "number", (F.col("times") * F.col("weight")).alias("gain")))
    n_items = asked.select("item").distinct().count()
    size = found.agg(F.count("*").alias("n"), F.sum(F.size("term")).alias("postings")).first()
    n_i = max(1, -(-n_items // item_block))
    n_c = max(1, -(-size["n"] // class_block), -(-(size["postings"] or 0) // BLOCK_POSTINGS))
    id_type = found.schema["members"].dataType.elementType.simpleString()
    left = gains.select(F.pmod(F.xxhash64("item"), F.lit(n_i)).cast("int").alias("ib"),
                        F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))).alias("cb"), "item", "number", "gain")
    right = found.select(F.explode(F.sequence(F.lit(0), F.lit(n_i - 1))).alias("ib"),
                         F.pmod(F.xxhash64("hash", F.lit(1)), F.lit(n_c)).cast("int").alias("cb"), "m", "term", "tf", "members", "nameless")

    def block(key: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"item": [], "doc_id": [], "score": []}, dtype=object)
        return best_of_block(q, c, k)

    on = ["ib", "cb"]
    merged = (left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(block, f"item string, doc_id {id_type}, score long"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    names = asked.select("item", "item_id").distinct()
    return (merged.withColumn("rank", rank).filter(F.col("rank") <= k).join(names, "item")
            .select("item_id", "rank", "doc_id", "score"))

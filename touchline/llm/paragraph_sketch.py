"""Operator 4: document fingerprints as invertible Bloom lookup sketches.

A text is the multiset of its paragraphs' digests (a paragraph: a sentence of
a line; very long ones are cut at 512 characters).  Its fingerprint is a
table of cells; every digest is added to three of them (count, xor of
digests, xor of checks).  Subtracting the tables of two versions cancels what
they share; peeling cells that hold one digest recovers the digests that
differ.  If peeling gets stuck, both tables are built again with twice the
cells.  The likeness of two fingerprints is shared / all paragraphs.

The edited version of a document takes its second half from the next document
in descending order of the id (the first follows the last).  Documents are
dealt into ranges of ids, each range is streamed in order by one task, and
the first document of the following range is handed to it as well, so a text
is shuffled once and no task holds more than the run of texts it works on.

Defined results: a null text is empty; two empty texts are alike (1.0);
documents of one id follow one another by a hash of their text, null ids come
last; a single document follows itself; equal texts have equal fingerprints;
other columns are ignored; an empty table gives an empty one.  Ids are
integers.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = 24                     # of the fingerprint that is given out; a multiple of three
PARAGRAPH_CHARS = 512
RANGE_DOCS, MAX_RANGES = 512, 4096
RUN_CHARS = 1_000_000

_SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\s*\n\s*").split


def paragraphs(text: str) -> list[str]:
    out = []
    for p in _SENTENCE_END(text):
        if len(p) <= PARAGRAPH_CHARS:
            if p:
                out.append(p)
        else:
            out += [p[i:i + PARAGRAPH_CHARS] for i in range(0, len(p), PARAGRAPH_CHARS)]
    return out


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def digests(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, digest), sorted; the n-th copy of a paragraph has a digest of its own."""
    parts = [paragraphs(t) for t in texts]
    n = np.array([len(p) for p in parts], np.int64)
    value = np.fromiter((xxhash.xxh64_intdigest(p.encode("utf-8", "surrogatepass")) for ps in parts for p in ps),
                        np.uint64, n.sum())
    owner = np.repeat(np.arange(len(texts)), n)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    if len(value):
        new = np.ones(len(value), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
        at = np.arange(len(value))
        copy = at - np.maximum.accumulate(np.where(new, at, 0))
        value = np.where(copy > 0, _mix(value ^ _mix(copy.astype(np.uint64), 7), 8), value)
    return owner, value


class Sketch:
    """Tables of ``n`` documents side by side: count, key and check by cell."""

    def __init__(self, count: np.ndarray, key: np.ndarray, check: np.ndarray):
        self.count, self.key, self.check = count, key, check

    @staticmethod
    def cells_of(digest: np.ndarray, cells: int) -> list[np.ndarray]:
        third = cells // 3
        return [(_mix(digest, 11 + i + cells) % np.uint64(third)).astype(np.int64) + i * third for i in range(3)]

    @staticmethod
    def check_of(digest: np.ndarray) -> np.ndarray:
        return _mix(digest, 3) >> np.uint64(32)

    @classmethod
    def build(cls, owner: np.ndarray, digest: np.ndarray, n: int, cells: int) -> Sketch:
        table = cls(np.zeros((n, cells), np.int64), np.zeros((n, cells), np.uint64), np.zeros((n, cells), np.uint64))
        table.add(owner, digest, np.ones(len(digest), np.int64))
        return table

    def add(self, owner: np.ndarray, digest: np.ndarray, sign: np.ndarray) -> None:
        cells = self.count.shape[1]
        check = self.check_of(digest)
        for cell in self.cells_of(digest, cells):
            at = owner * cells + cell
            np.add.at(self.count.reshape(-1), at, sign)
            np.bitwise_xor.at(self.key.reshape(-1), at, digest)
            np.bitwise_xor.at(self.check.reshape(-1), at, check)

    def minus(self, other: Sketch) -> Sketch:
        return Sketch(self.count - other.count, self.key ^ other.key, self.check ^ other.check)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(pair, digest, sign) of what differs, and which pairs came out whole.  Empties the table."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows = np.arange(len(self.count))
        while len(rows):
            count, key = self.count[rows], self.key[rows]
            pure = (np.abs(count) == 1) & (self.check_of(key) == self.check[rows])
            r, c = np.nonzero(pure)
            if not len(r):
                break
            pair, digest, sign = rows[r], key[r, c], count[r, c]
            order = np.lexsort((digest, pair))
            pair, digest, sign = pair[order], digest[order], sign[order]
            once = np.ones(len(pair), bool)
            once[1:] = (pair[1:] != pair[:-1]) | (digest[1:] != digest[:-1])
            pair, digest, sign = pair[once], digest[once], sign[once]
            self.add(pair, digest, -sign)
            found.append((pair, digest, sign))
            rows = np.unique(pair)
        whole = ~(self.count.any(1) | self.key.any(1) | self.check.any(1))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), whole
        return *(np.concatenate(x) for x in zip(*found)), whole

    def texts(self) -> list[str]:
        """The tables as strings."""
        raw = np.concatenate([self.count.astype("<i2").view(np.uint8), self.key.astype("<u8").view(np.uint8),
                              self.check.astype("<u4").view(np.uint8)], axis=1)
        return [base64.b64encode(x.tobytes()).decode() for x in raw]


def differing(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n: int,
              cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, digest, sign) of all paragraphs that differ between the versions
    a and b (text number, digest) of n documents: +1 only in a, -1 only in b."""
    found, rows = [], np.arange(n)
    while len(rows):
        tables = []
        for owner, digest in (a, b):
            at = np.searchsorted(rows, owner)
            mine = (at < len(rows)) & (rows[np.minimum(at, len(rows) - 1)] == owner)
            tables.append(Sketch.build(at[mine], digest[mine], len(rows), cells))
        pair, digest, sign, whole = tables[0].minus(tables[1]).peel()
        done = whole[pair]
        found.append((rows[pair[done]], digest[done], sign[done]))
        rows, cells = rows[~whole], cells * 2
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, int),) * 3


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    d = np.bincount(differing(a, b, n)[0], minlength=n)
    both = np.bincount(a[0], minlength=n) + np.bincount(b[0], minlength=n)
    return np.where(both > 0, (both - d) / np.maximum(both + d, 1), 1.0)


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _compare(ids: list, texts: list[str]) -> pd.DataFrame:
    """Results of all texts but the last, each followed by the next one."""
    n = len(texts) - 1
    new = [edited(texts[i], texts[i + 1]) for i in range(n)]
    owner, digest = digests(texts)
    mine, after = owner < n, owner > 0
    own, following = (owner[mine], digest[mine]), (owner[after] - 1, digest[after])
    changed = digests(new)
    return pd.DataFrame({
        "doc_id": ids[:n], "n_chars": [len(t) for t in texts[:n]],
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new],
        "fingerprint": Sketch.build(*own, n, CELLS).texts(), "edited_fingerprint": Sketch.build(*changed, n, CELLS).texts(),
        "near_edited": likeness(own, changed, n), "near_next": likeness(own, following, n)})


def _ranges(slim: DataFrame, order: Column) -> Column:
    """Number of the id range of a row, ascending in ``order``; about
    RANGE_DOCS documents each, larger ones beyond MAX_RANGES ranges."""
    n = min(MAX_RANGES, slim.count() // RANGE_DOCS)
    marks = [i / (n + 1) for i in range(1, n + 1)]
    bounds = slim.agg(F.percentile_approx("place", marks, 20 * MAX_RANGES)).first()[0] if marks else None
    bounds = sorted(set(bounds or []))
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))                 # two short searches for each row
    groups = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    below = lambda array: F.size(F.filter(array, lambda x: x < order))
    tops = F.array(*[F.lit(g[-1]) for g in groups[:-1]]).cast("array<bigint>")
    table = F.array(*[F.array(*[F.lit(x) for x in g]).cast("array<bigint>") for g in groups])
    group = below(tops)
    return group * step + below(F.element_at(table, group + 1))


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = (rows.withColumn("none", F.col("doc_id").isNull().cast("int"))
            .withColumn("place", F.bitwise_not(F.coalesce("doc_id", F.lit(0).cast("long"))))   # descending ids
            .withColumn("tie", F.xxhash64("text")))
    ranges = _ranges(rows.filter("none = 0").select("place"), F.col("place"))
    rows = rows.withColumn("range", F.when(F.col("none") == 1, F.lit(2 * MAX_RANGES)).otherwise(ranges).cast("int"))
    # the first document of every range, handed to the range before it (the first range's to the last)
    firsts = sorted((r["range"], tuple(r["first"])) for r in rows.groupBy("range").agg(
        F.min(F.struct("none", "place", "tie")).alias("first")).collect())      # MAX_RANGES + 2 rows at most
    if not firsts:
        return rows.limit(0).mapInPandas(_run, RESULT)
    spark = docs.sparkSession
    handed = spark.createDataFrame([(firsts[i - 1][0], *first) for i, (_, first) in enumerate(firsts)],
                                   "to int, none int, place long, tie long")
    # MAX_RANGES + 2 rows of four numbers at most, so the texts stay where they are
    heads = (rows.join(F.broadcast(handed), ["none", "place", "tie"])
             .select(F.col("to").alias("range"), F.lit(1).alias("head"), "none", "place", "tie", "doc_id", "text")
             .dropDuplicates(["range"]))
    columns = ["range", "head", "none", "place", "tie", "doc_id", "text"]
    dealt = (rows.withColumn("head", F.lit(0)).select(*columns).union(heads.select(*columns))
             .repartition("range").sortWithinPartitions("range", "head", "none", "place", "tie"))
    return dealt.select("head", "doc_id", "text").mapInPandas(_run, RESULT)


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Streams the ranges of a task; a row with ``head`` ends its range."""
    ids: list = []
    texts: list[str] = []
    held = 0
    for batch in batches:
        ids_in = [None if pd.isna(x) else int(x) for x in batch["doc_id"]]
        for head, doc_id, text in zip(batch["head"], ids_in, batch["text"]):
            ids.append(doc_id)
            texts.append(text)
            held += len(text)
            if head or held > RUN_CHARS:
                if len(texts) > 1:
                    out = _compare(ids, texts)
                    out["doc_id"] = out["doc_id"].astype("Int64")
                    yield out
                ids, texts = ([], []) if head else (ids[-1:], texts[-1:])
                held = sum(map(len, texts))

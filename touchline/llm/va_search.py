"""Operator 7: exact top-k search with a vector-approximation file.

Vectors are integers (floor of 64 times each component); the score is their
inner product.  Beside every vector stands its approximation: one byte per
dimension, the cell of an equal-width grid over that dimension's range.  For
a query the cells give every candidate a lower and an upper bound of the
score; exact vectors are then read in order of the upper bound, and reading
stops when the k-th best exact score so far is above every bound left (equal
bounds are still read, as a tie can win by its smaller id).

Work is dealt in blocks of queries x blocks of candidates, so a task holds
one block of each, every block pair is one group of bounded size, and blocks
send on k rows per query, which one last grouping by query merges.  Of
vectors that are equal only the k + 1 smallest different ids can be among a
query's k best (its own id is one of them at most), each with k rows at most,
so a vector that fills a third of the table does not fill the blocks.

Scores are exact whatever the components: a block whose products could leave
64 bits is scored in Python integers, without bounds, and blocks are merged by
a key of a score's digits.

Defined results: vectors that are null, empty or hold a null or non-finite
component take no part; a query is compared with vectors of its own length;
a query without candidates has no row; ids that are null take no part;
a repeated id is a candidate as often as it occurs and asks once for each
(different) vector it has; a score beyond 64 bits ranks in its place and is
null; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import integers, written

SCALE = 64
CELLS = 64                    # per dimension
QUERY_BLOCK, VECTOR_BLOCK = 512, 4096
READ_STEP = 32                # exact vectors read at once for a query


def fit_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, dim, x of the rows that take part."""
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return (table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
            .filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & fine)
            .select("vec_id", F.size("x").alias("dim"), "x"))


def grid(vectors: DataFrame) -> dict[int, tuple[list[float], list[float]]]:
    """Per vector length, each dimension's least value and cell width, over all vectors."""
    ends = (vectors.select("dim", F.posexplode("x").alias("at", "c")).groupBy("dim", "at")
            .agg(F.min("c").alias("low"), F.max("c").alias("high")).orderBy("dim", "at"))
    out: dict[int, tuple[list[float], list[float]]] = {}
    for r in ends.toLocalIterator():                       # one row a dimension
        lows, widths = out.setdefault(r["dim"], ([], []))
        lows.append(r["low"])
        widths.append(r["high"] / CELLS - r["low"] / CELLS or 1.0)
    return out


def _approximate(x: Column, dim: Column, cells: dict) -> Column:
    """The cells of a vector, a byte each."""
    out = F.lit(None).cast("array<tinyint>")
    for d, (lows, widths) in cells.items():
        low, width = F.array(*[F.lit(v) for v in lows]), F.array(*[F.lit(v) for v in widths])
        code = F.transform(F.arrays_zip(x.alias("x"), low.alias("low"), width.alias("width")),
                           lambda z: F.least(F.floor(z["x"] / z["width"] - z["low"] / z["width"]),
                                             F.lit(CELLS - 1)).cast("tinyint"))
        out = F.when(dim == d, code).otherwise(out)
    return out


def score_key(score: int) -> str:
    """A text that sorts like the integer."""
    digits = str(abs(score))
    if score >= 0:
        return f"1{len(digits):04d}{digits}"
    return f"0{9999 - len(digits):04d}" + digits.translate(str.maketrans("0123456789", "9876543210"))


def best_of_block(queries: np.ndarray, query_ids: np.ndarray, codes: np.ndarray, vectors: np.ndarray,
                  ids: np.ndarray, low: np.ndarray, width: np.ndarray, k: int) -> tuple[pd.DataFrame, int]:
    """The k best candidates of each query in one block, and how many exact
    vectors were read.  ``queries`` and ``vectors`` are integers, the grid is in units of the input."""
    exact = vectors if queries.dtype == vectors.dtype else vectors.astype(object)
    asked = queries if queries.dtype == vectors.dtype else queries.astype(object)
    if exact.dtype == object:
        upper = np.full((len(asked), len(ids)), np.inf)
    else:
        q = asked.astype(np.float64)
        middle = SCALE * (low + (codes + 0.5) * width)     # centre of the cell
        half = SCALE * width * (0.5 + 1e-9) + 1.0 + 1e-9 * np.abs(SCALE * low)
        slack = np.abs(q) @ half                           # how far the score can be from the centre's
        upper = q @ middle.T + (slack + 1e-6 * (1 + slack))[:, None]
    size = max(READ_STEP, 2 * k)
    upper = np.where(ids[None, :] == query_ids[:, None], -np.inf, upper)
    found, read = [None] * len(asked), 0
    if exact.dtype != object and len(ids) > size:          # the first reads of all queries at once
        first = np.argpartition(-upper, size - 1, axis=1)[:, :size]
        got = np.einsum("qmd,qd->qm", exact[first], asked)
        got = np.where(np.take_along_axis(upper, first, 1) > -np.inf, got, np.iinfo(np.int64).min)
        rest = upper.copy()
        np.put_along_axis(rest, first, -np.inf, axis=1)
        enough = np.sort(got, axis=1)[:, -k]               # the k-th best so far
        certain = rest.max(1) < enough
        read += int(certain.sum()) * size
        for i in np.flatnonzero(certain):
            best = np.lexsort((ids[first[i]], -got[i]))[:k]
            found[i] = ids[first[i][best]], got[i][best]
    for i, bound in enumerate(upper):
        if found[i] is None:
            *found[i], n = _read_in_order(asked[i], bound, exact, ids, k, size)
            read += n
    count = [len(x[0]) for x in found]
    score = [int(s) for x in found for s in x[1]]
    return pd.DataFrame({"query_id": np.repeat(query_ids, count), "nth": np.repeat(np.arange(len(asked)), count),
                         "vec_id": np.concatenate([x[0] for x in found] or [np.empty(0, np.int64)]),
                         "key": pd.Series([score_key(s) for s in score], dtype=object),
                         "score": pd.array([s if -2**63 <= s < 2**63 else None for s in score], "Int64")}), read


def _read_in_order(asked: np.ndarray, bound: np.ndarray, exact: np.ndarray, ids: np.ndarray, k: int, size: int):
    """(ids, scores) of a query's k best and the number of vectors read, in
    order of the bound until the k-th is certain."""
    n, read = int((bound > -np.inf).sum()), 0
    got_id, got = np.empty(0, np.int64), np.empty(0, exact.dtype)
    by_bound = np.argsort(-bound, kind="stable")[:n]       # own rows have the last bounds
    while read < n:
        order = by_bound[read:read + size]
        got = np.concatenate([got, exact[order] @ asked])
        got_id = np.concatenate([got_id, ids[order]])
        best = sorted(range(len(got)), key=lambda r: (-got[r], got_id[r]))[:k] if got.dtype == object else np.lexsort((got_id, -got))[:k]
        got, got_id = got[best], got_id[best]
        read, size = read + len(order), size * 2
        if exact.dtype != object and len(got) == k and bound[order[-1]] < got[-1]:
            break
    return got_id, got, read


def top_k(table: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
          query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other vectors of every query.
    ``is_query`` is a condition on the column ``vec_id``."""
    vectors = written(fit_vectors(table, id_col, vector_col), "va-vectors")
    cells = grid(vectors)
    asked = vectors.filter(is_query).distinct().withColumn("nth", F.lit(1))
    rows, ids = Window.partitionBy("x", "vec_id").orderBy("dim"), Window.partitionBy("x").orderBy("vec_id")
    held = (vectors.withColumn("nth", F.row_number().over(rows)).filter(F.col("nth") <= k)
            .withColumn("nth", F.dense_rank().over(ids)).filter(F.col("nth") <= k + 1)
            .withColumn("codes", _approximate(F.col("x"), F.col("dim"), cells)))
    held = written(held, "va-file")
    n_q = max(1, -(-asked.count() // query_block))
    n_v = max(1, -(-held.count() // vector_block))
    spread = lambda n, salt: F.pmod(F.xxhash64("vec_id", "x", "nth", F.lit(salt)), F.lit(n)).cast("int")
    left = asked.select("dim", spread(n_q, 1).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_v - 1))).alias("vb"),
                        F.col("vec_id").alias("query_id"), F.xxhash64("x").alias("ask"), "x")
    right = held.select("dim", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb"), spread(n_v, 2).alias("vb"),
                        "vec_id", "codes", "x")

    columns = {"query_id": "long", "ask": "long", "vec_id": "long", "key": "string", "score": "long"}

    def exact(x: pd.Series) -> np.ndarray:
        v = integers(np.stack(x).astype(np.float64), SCALE)
        return v if v.dtype == object or v.shape[1] < 1 << 18 else v.astype(object)

    def block(key: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({c: [] for c in columns}, dtype=object)
        low, width = (np.array(x, np.float64) for x in cells[int(key[0])])
        best, _ = best_of_block(exact(q["x"]), q["query_id"].to_numpy(), np.stack(c["codes"]).astype(np.float64),
                                exact(c["x"]), c["vec_id"].to_numpy(), low, width, k)
        return best.assign(ask=q["ask"].to_numpy()[best["nth"].to_numpy(int)])[list(columns)]

    on = ["dim", "qb", "vb"]
    merged = (left.groupBy(*on).cogroup(right.groupBy(*on))
              .applyInPandas(block, ", ".join(f"{c} {t}" for c, t in columns.items())))
    order = Window.partitionBy("query_id", "ask").orderBy(F.desc("key"), "vec_id")
    return (merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))

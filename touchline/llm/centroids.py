"""Operator 11: centroid clustering with heap-ordered bounds.

Every vector has a gap: a lower bound of its distance to all other centroids
less an upper bound of the distance to its own.  While the gap is positive
its nearest centroid cannot have changed.  When centroids move, the gap of a
vector of cluster c shrinks by at most ``drift(c) + max drift of the others``;
instead of lowering every gap, each cluster adds that to one offset, and a
vector is pushed with the key ``gap + offset``.  Keys of a cluster stand in a
heap; keys at or below the offset have expired, so a round pops from the top
of each heap until the top holds, rescans the popped vectors exactly against
all centroids and pushes them onto the heap of their cluster.  All others are
not looked at.

On Spark the vectors are packed once into blocks of 4,096, written bucketed
by block.  The heaps of a block are a small row of their own, rewritten each
round in the same buckets, so a round joins vectors and heaps without a
shuffle; the small side is hashed, the vectors are not sorted.  A block also
writes what it adds to and takes from the sums of the clusters it changed;
only those sums (clusters x dimensions) reach the driver, which floors the
new centroids exactly.

Everything exact is integer: components are floor(scale * x), distances and
sums of any size are right (blocks whose squares could leave 2**53 take
Python integers and rescan each round); the float bounds carry a margin.

Defined results: vectors that are null, of another length, or hold a null or
non-finite component are left out; a null id is clustered but starts no
centroid; repeated rows are vectors of their own; fewer vectors than
centroids give fewer centroids, equal start vectors leave all but the first
empty; ties go to the smaller number; a distance or inertia beyond 64 bits is
null; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import SAFE, integers, written
from touchline.session import scratch_dir

DIM, SCALE = 64, 256
CLUSTERS, ROUNDS, SEED = 40, 5, 2
BLOCK = 4096                   # vectors
LIMB = 1 << 32                 # sums travel in digits of this base


def squared(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, vectors x centroids."""
    if v.dtype == object or centroids.dtype == object:
        c = centroids.astype(object)
        return np.stack([((v.astype(object) - row) ** 2).sum(1) for row in c], 1)
    a, c = v.astype(np.float64), centroids.astype(np.float64)
    return ((a * a).sum(1)[:, None] - 2.0 * (a @ c.T) + (c * c).sum(1)).astype(np.int64)


def as_centroids(rows: list[list[int]]) -> np.ndarray:
    small = all(abs(x) < SAFE for row in rows for x in row)
    return np.array(rows, dtype=np.int64 if small else object).reshape(len(rows), -1)


def drifts(before: list[list[int]], after: list[list[int]]) -> list[float]:
    """Per cluster, how much a gap of it can shrink: its own move and the largest of the others."""
    moved = []
    for a, b in zip(before, after):
        d = sum((x - y) ** 2 for x, y in zip(a, b))
        moved.append(math.sqrt(d) if d < 2**1000 else math.inf)
    top = sorted(moved, reverse=True)[:2] + [0.0]
    return [m + (top[1] if m == top[0] else top[0]) for m in moved]


class Heaps:
    """The clusters of one block's vectors and a heap of (key, vector) per cluster."""

    def __init__(self, n: int, k: int):
        self.cluster = np.full(n, -1, np.int32)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(k)]

    def expired(self, offset: list[float]) -> np.ndarray:
        """Pop what the offsets have reached; at first, everything."""
        out = np.flatnonzero(self.cluster < 0).tolist()
        for heap, limit in zip(self.heaps, offset):
            limit += 1e-6 + 1e-9 * limit                                 # margin of the float bounds
            while heap and heap[0][0] <= limit:
                out.append(heapq.heappop(heap)[1])
        return np.array(sorted(out), np.int64)

    def rescan(self, v: np.ndarray, centroids: np.ndarray,
               offset: list[float]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """Assign the expired vectors anew: their number, and (vectors, old, new clusters) of those that changed."""
        due = self.expired(offset)
        if not len(due):
            return 0, due, due, due
        d = squared(v[due], centroids)
        new = d.argmin(1).astype(np.int32)                               # the smaller number of equals
        if d.dtype == object or not all(map(math.isfinite, offset)):
            gap = np.full(len(due), -np.inf)                             # looked at again each round
        else:
            two = np.sqrt(np.sort(d, 1)[:, :2].astype(np.float64))
            gap = two[:, 1] - two[:, 0] if d.shape[1] > 1 else np.full(len(due), np.inf)
        old = self.cluster[due].copy()
        self.cluster[due] = new
        for i, c, g in zip(due.tolist(), new.tolist(), gap.tolist()):
            heapq.heappush(self.heaps[c], (g + offset[c] if g > -np.inf else g, i))
        change = old != new
        return len(due), due[change], old[change], new[change]

    def packed(self) -> bytes:
        key = [np.array([x[0] for x in h], np.float64) for h in self.heaps]
        at = [np.array([x[1] for x in h], np.int32) for h in self.heaps]
        return pickle.dumps((self.cluster, key, at), protocol=5)

    @classmethod
    def unpacked(cls, raw: bytes) -> "Heaps":
        cluster, key, at = pickle.loads(raw)
        out = cls(0, 0)
        out.cluster = cluster.copy()
        out.heaps = [list(zip(k.tolist(), a.tolist())) for k, a in zip(key, at)]
        return out


def changes(v: np.ndarray, old: np.ndarray, new: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(cluster, dimension, limb, sum) that moved vectors add and take away; dimension -1 counts them."""
    out = []
    for c in np.unique(np.concatenate([old, new])).tolist():
        if c < 0:
            continue
        total = v[new == c].sum(0) - v[old == c].sum(0)
        out.append((c, -1, 0, int((new == c).sum() - (old == c).sum())))
        for j, x in enumerate(total.tolist()):
            sign, x, limb = (-1 if x < 0 else 1), abs(x), 0
            while x:
                x, low = divmod(x, LIMB)
                out.append((c, j, limb, sign * low))
                limb += 1
    return out


def kept_vectors(table: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """vec_id, x of the vectors that take part."""
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return (table.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
            .filter(F.col("x").isNotNull() & (F.size("x") == dim) & fine))


def start_vectors(kept: DataFrame, clusters: int, seed: int, scale: int) -> list[list[int]]:
    """The vectors whose ids have the smallest hashes, in ascending order of hash."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.filter("vec_id is not null").orderBy(key, "x").limit(clusters).collect()
    return [integers(np.array(r["x"], np.float64), scale).tolist() for r in first]


def _blocks(kept: DataFrame, size: int) -> DataFrame:
    """block, ids, x: vectors packed as they stream by."""
    id_type = kept.schema["vec_id"].dataType.simpleString()

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, n, ids, rows = TaskContext.get().partitionId(), 0, [], []

        def row():
            return pd.DataFrame({"block": [(part << 32) + n], "ids": [ids], "x": [np.stack(rows).tobytes()]})

        for batch in batches:
            for i, x in zip(batch["vec_id"].astype(object).where(batch["vec_id"].notna(), None), batch["x"]):
                ids.append(i)
                rows.append(np.asarray(x, np.float64))
                if len(ids) == size:
                    yield row()
                    n, ids, rows = n + 1, [], []
        if ids:
            yield row()

    return kept.mapInPandas(pack, f"block long, ids array<{id_type}>, x binary")


class _Buckets:
    """Tables bucketed alike by block, in the shared folder; the catalog only lends its names."""

    def __init__(self, spark: SparkSession, n: int):
        self.spark, self.n, self.names = spark, n, []
        self.folder = scratch_dir(spark, f"llm/centroids-{uuid.uuid4().hex}")

    def write(self, df: DataFrame, name: str) -> DataFrame:
        table = f"centroids_{name}_{uuid.uuid4().hex}"
        df.write.bucketBy(self.n, "block").option("path", f"{self.folder}/{name}").saveAsTable(table)
        self.names.append(table)
        return self.spark.table(table)

    def forget(self) -> None:
        for table in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")              # external: the files stay


def fit(table: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM,
        scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding",
        block: int = BLOCK) -> tuple[DataFrame, list[list[int]], list[int]]:
    """(vec_id, cluster, distance as text) of every kept vector, the final
    centroids, and how many vectors each round rescanned."""
    spark = table.sparkSession
    kept = kept_vectors(table, id_col, vector_col, dim)
    id_type = kept.schema["vec_id"].dataType.simpleString()
    centroids = start_vectors(kept, clusters, seed, scale)
    k = len(centroids)
    if not k:
        none = kept.select("vec_id", F.lit(0).alias("cluster"), F.lit("0").alias("distance"))
        return none.filter("false"), [], []
    buckets = _Buckets(spark, int(spark.conf.get("spark.sql.shuffle.partitions")))
    vectors = buckets.write(_blocks(kept, block).repartition(buckets.n, "block"), "vectors")
    sums, counts = [[0] * dim for _ in range(k)], [0] * k
    offset, heaps, rescanned = [0.0] * k, None, []
    for step in range(rounds + 1):
        now, reached, last = as_centroids(centroids), list(offset), step == rounds

        def scan(batches: Iterator[pd.DataFrame], now=now, reached=reached) -> Iterator[pd.DataFrame]:
            for batch in batches:
                states = batch["state"] if "state" in batch else [None] * len(batch)
                for number, raw, state in zip(batch["block"], batch["x"], states):
                    v = integers(np.frombuffer(raw, np.float64).reshape(-1, dim), scale)
                    held = Heaps(len(v), k) if state is None else Heaps.unpacked(state)
                    seen, moved, old, new = held.rescan(v, now, reached)
                    change = [dict(zip(("c", "j", "limb", "s"), r)) for r in changes(v[moved], old, new)]
                    yield pd.DataFrame({"block": [number], "state": [held.packed()], "seen": [seen], "change": [change]})

        both = vectors.select("block", "x")
        if heaps is not None:
            both = both.join(heaps.select("block", "state").hint("shuffle_hash"), "block")
        heaps = buckets.write(both.mapInPandas(
            scan, "block long, state binary, seen long, change array<struct<c:int,j:int,limb:int,s:bigint>>"), f"heaps{step}")
        rescanned.append(heaps.agg(F.sum("seen")).first()[0])
        if last:
            break
        moved = (heaps.select(F.explode("change").alias("m")).groupBy("m.c", "m.j", "m.limb").agg(F.sum("m.s").alias("s")))
        for r in moved.collect():                                        # clusters x dimensions at most, by limbs
            if r["j"] < 0:
                counts[r["c"]] += r["s"]
            else:
                sums[r["c"]][r["j"]] += r["s"] * LIMB ** r["limb"]
        after = [[s // counts[c] for s in sums[c]] if counts[c] else centroids[c] for c in range(k)]
        offset = [a + b for a, b in zip(offset, drifts(centroids, after))]
        centroids = after
    final = as_centroids(centroids)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, raw, state in zip(batch["ids"], batch["x"], batch["state"]):
                v, cluster = integers(np.frombuffer(raw, np.float64).reshape(-1, dim), scale), Heaps.unpacked(state).cluster
                d = np.empty(len(v), object)
                for c in np.unique(cluster).tolist():
                    d[cluster == c] = squared(v[cluster == c], final[c:c + 1])[:, 0]
                yield pd.DataFrame({"vec_id": pd.Series(list(ids), dtype=object), "cluster": cluster, "distance": [str(x) for x in d]})

    out = (vectors.join(heaps.select("block", "state").hint("shuffle_hash"), "block")
           .mapInPandas(unpack, f"vec_id {id_type}, cluster int, distance string"))
    buckets.forget()
    return out, centroids, rescanned


def centroid_digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster_vectors(table: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    spark = table.sparkSession
    found, centroids, _ = fit(table, **options)
    wide = written(found, "centroids-found").withColumn("far", F.expr("try_cast(distance AS decimal(38,0))"))
    known = spark.createDataFrame([(c, centroid_digest(x)) for c, x in enumerate(centroids)],
                                  "cluster int, centroid_sha256 string")          # one row a cluster
    parts = wide.groupBy("cluster").agg(F.expr("try_sum(far)").alias("s"), F.count("*").alias("n"), F.count("far").alias("fits"))
    parts = parts.select("cluster", F.when(F.col("n") == F.col("fits"), F.col("s")).alias("part"))
    total = parts.agg(F.expr("CASE WHEN count(*) = count(part) THEN try_sum(part) END").alias("inertia")).first()["inertia"]
    small = parts.join(known, "cluster").select(
        "cluster", F.col("part").try_cast("bigint").alias("cluster_inertia"),
        F.lit(None if total is None else str(total)).try_cast("bigint").alias("inertia"), "centroid_sha256")
    return (wide.join(F.broadcast(small), "cluster")                              # a row a cluster
            .select("vec_id", "cluster", F.col("distance").try_cast("bigint").alias("distance"),
                    "cluster_inertia", "inertia", "centroid_sha256"))

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from touchline.session import ensure_checkpoint_dir, scratch_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back, so that
    later jobs neither recompute it nor lose it with an executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


ROWS_PER_FILE = 50_000


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` as a Parquet table under the shared folder (columns can then be
    pruned and filters pushed down, unlike in a checkpoint).  With ``rows``, a
    bound of its rows, a small table is a few files however many partitions
    the session shuffles into."""
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_PER_FILE)))
    path = scratch_dir(df.sparkSession, f"llm/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet (case-insensitive)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_runs(texts: Sequence[str], max_chars: int = 1_000_000) -> Iterator[slice]:
    """Cut a batch of texts into runs of about ``max_chars`` characters, so
    that what is held per run does not depend on the Arrow batch size.  A
    text longer than that is a run of its own, whole."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if held and held + n > max_chars:
            yield slice(start, i)
            start, held = i, 0
        held += n
    if start < len(texts):
        yield slice(start, len(texts))


def arrow_text_runs(batches, column: str = "text", max_bytes: int = 1_000_000):
    """(record batch, its texts) in runs of about ``max_bytes`` of UTF-8, cut
    from the Arrow batches before any text becomes a Python string, so that a
    worker holds one run of strings and not a batch of them."""
    import pyarrow.compute as pc
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, before + max_bytes, side="right")))
            run = batch.slice(start, stop - start)
            yield run, run.column(column).to_pylist()
            start = stop


SAFE = 1 << 22                 # components below it have exact squares and sums in float64


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as int64 where small, else as Python integers."""
    scaled = np.floor(x * scale)
    if not scaled.size or np.abs(scaled).max() < SAFE:
        return scaled.astype(np.int64)
    exact = [math.floor(v * scale) if math.isfinite(v * scale) else int(v) * scale for v in x.ravel().tolist()]
    return np.array(exact, dtype=object).reshape(x.shape)

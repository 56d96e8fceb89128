"""Operator 3: near-duplicates by ProbMinHash, banding and exact verification.

A text is the weighted set of its five-word shingles (lower case, word
characters); a shingle that occurs c times weighs 1 + ln c.  Each shingle is
a Poisson process whose rate is its weight, seeded by the shingle alone: its
arrivals fall on random signature slots, a slot keeps its earliest arrival,
and a shingle ends as soon as its next arrival is later than every slot of
the document.  Two signatures then agree in a slot with the probability
Jaccard similarity of the two weighted sets.  Slots are banded; texts that
share a band are candidates; a candidate pair is a link if the exact
probability Jaccard similarity of its weighted sets is at least the threshold;
classes are the connected components of the links.  (Equal weights give the
plain Jaccard similarity.)

No group is ever paired with itself.  First every text is compared with one
text only, the one of all its bands whose bands are fullest (of near copies
that is the original, or close to it); this joins most copies.  Later rounds
look only at bands that still hold texts of two classes: members outside the
band's largest class, 64 of them (then 256, 1024, ...), are compared with the
members of other classes and leave the band, until no band is mixed.  So
every two texts that share a band end in one class or have been compared,
whatever a band's size.  A pair is left out of a comparison only if its sizes
or its parity bitmaps (512 bits; they differ in no more bits than the sets in
shingles) rule the threshold t out: a text has at most 1 - t of its weight
alone, both shares together are at most 2 (1 - t) / (1 + t), and a shingle
weighs at least 1.  A centre of
many pairs is dealt in parts of 1,000 pairs.

The texts of candidates are found again by a bitmap of fixed size over the
hashes of their row keys, sent to every task: rows it rules out are passed
over, the rest become shingle sets, and a join by node keeps the right ones.
That is one way at every size; a fuller bitmap only lets more sets through.

Defined results: equal shingle texts are one node of the graph, so thousands
of copies cost one comparison; a text with fewer than five words is one
shingle; a text without word characters is taken by its blank-separated
parts, and one without those (null, empty, blank) is a class of its own; the
class id is the smallest id in the class (null only if all ids are null);
repeated rows are copies of one another; other columns are ignored; an empty
table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import arrow_text_runs, fresh_name, written

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BANDS, BAND_SLOTS = 25, 5      # a pair at 0.8 shares no band with probability 5e-5
KNOWN_WORDS = 100_000
RUN_BYTES = 500_000
BITMAP = 8                     # 64-bit words of a parity bitmap
FIRST_CENTRES = 64
WANTED_BITS = 25               # bitmap of 2**25 bits (4 MB) over hashes of wanted row keys
SET_BITS = 24                  # bitmap of 2**24 bits over hashes of the nodes whose sets a comparison needs
HUB_PAIRS = 1000               # pairs of a centre that are verified in one place

_WORD = re.compile(r"\w+").findall
_FILL = np.uint64(0x5851F42D4C957F2D)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_hashes = _WordHashes()


def words_of(text: str | None) -> list[str]:
    return (_WORD(text.lower()) or text.split()) if text else []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: Sequence[str | None], size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """(text number, shingle, count) sorted by text and shingle, and each
    text's key: 16 bytes of its words, None without words."""
    if len(_hashes) > KNOWN_WORDS:
        _hashes.clear()
    found = [words_of(t) for t in texts]
    keys = [xxhash.xxh128_digest(" ".join(w).encode("utf-8", "surrogatepass")) if w else None for w in found]
    n = np.array([len(w) for w in found])
    padded = np.where(n > 0, np.maximum(n, size), 0)       # short texts are filled up to one shingle
    flat = np.full(padded.sum(), _FILL)
    starts = np.cumsum(padded) - padded
    owner = np.repeat(np.arange(len(found)), padded)
    real = np.arange(len(flat)) - starts[owner] < n[owner]
    flat[real] = np.fromiter(map(_hashes.__getitem__, chain.from_iterable(found)), np.uint64, n.sum())
    if len(flat) < size:
        return np.empty(0, int), np.empty(0, np.uint64), np.empty(0, int), keys
    m = len(flat) - size + 1
    value = np.zeros(m, np.uint64)
    for i in range(size):
        value = (value + flat[i:i + m]) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(32)
    inside = owner[:m] == owner[size - 1:]
    owner, value = owner[:m][inside], _mix(value[inside])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return owner[at], value[at], np.diff(np.append(at, len(owner))), keys


def weights(count: np.ndarray) -> np.ndarray:
    return 1.0 + np.log(count)


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Of the weighted sets (elements a, weights x) and (b, y): the sum over
    common d of 1 / sum over e of max(x_e / x_d, y_e / y_d).  Sorted by y / x,
    the first part of the sum's maxima come from x and the rest from y."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    order = np.argsort(y[j] / x[i], kind="stable")
    u, v = x[i][order], y[j][order]
    from_x = x.sum() - u.sum() + np.cumsum(u)
    from_y = y.sum() - np.cumsum(v)
    return float((1.0 / (from_x / u + from_y / v)).sum())


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n_texts: int, slots: int) -> np.ndarray:
    """ProbMinHash: the element of the earliest arrival in every slot, texts x slots."""
    first = np.full(n_texts * slots, np.inf)
    kept = np.zeros(n_texts * slots, np.uint64)
    latest = np.full(n_texts, np.inf)
    time = np.zeros(len(owner))
    step = 0
    while len(owner):
        step += 1
        draw = _mix(element + np.uint64(0x9E3779B97F4A7C15 * step & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight
        alive = time < latest[owner]
        owner, element, weight, time = owner[alive], element[alive], weight[alive], time[alive]
        slot = owner * slots + (_mix(draw[alive]) % np.uint64(slots)).astype(np.int64)
        np.minimum.at(first, slot, time)
        won = first[slot] == time
        kept[slot[won]] = element[won]
        latest = first.reshape(n_texts, slots).max(1)
    return kept.reshape(n_texts, slots)


def band_hashes(signature: np.ndarray, bands: int) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, -1)
    value = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(parts.shape[2]):
        value = _mix(value * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return value.view(np.int64)


def parity_bitmaps(owner: np.ndarray, element: np.ndarray, n_texts: int) -> np.ndarray:
    """Of each set, which of the bitmap's bits an odd number of elements falls on."""
    bits = 64 * BITMAP
    at = owner * bits + (_mix(element + np.uint64(1)) % np.uint64(bits)).astype(np.int64)
    odd = np.bincount(at, minlength=n_texts * bits).reshape(n_texts, bits) % 2
    return np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)


def _row_key(id_col: str, text_col: str):
    """What tells one row of the input from another: 16 bytes of id and text."""
    parts = [F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(c).cast("string")))
             for c in (id_col, text_col)]
    return F.unhex(F.md5(F.concat(parts[0], F.lit("|"), parts[1])))


def _prints(docs: DataFrame, id_col: str, text_col: str, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, row_key, node, n (shingles), w (their weight), bands and parity bitmap (b0, b1, ...) of every row."""
    slim = docs.select(F.col(id_col).alias("doc_id"), _row_key(id_col, text_col).alias("row_key"),
                       F.col(text_col).alias("text"))
    id_type = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in arrow_text_runs(batches, max_bytes=RUN_BYTES):
            owner, value, count, keys = shingles(texts)
            weight = weights(count)
            hashes = band_hashes(signatures(owner, value, weight, len(keys), bands * rows), bands)
            bitmap = parity_bitmaps(owner, value, len(keys))
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"), "row_key": part.column("row_key"), "node": pa.array(keys, pa.binary()),
                "n": pa.array(np.bincount(owner, minlength=len(keys)).astype(np.int32)),
                "w": pa.array(np.bincount(owner, weight, minlength=len(keys)).astype(np.float64)),
                "bands": pa.array([h if k else None for h, k in zip(hashes, keys)], pa.list_(pa.int64())),
                **{f"b{i}": pa.array(bitmap[:, i]) for i in range(BITMAP)}})

    bitmap_type = "".join(f", b{i} long" for i in range(BITMAP))
    return slim.mapInArrow(run, f"doc_id {id_type}, row_key binary, node binary, n int, w double, bands array<long>{bitmap_type}")


def _set_bits(hash_: Column, bits: int) -> tuple[Column, Column]:
    """The 64-bit word of a bitmap of 2**bits bits that a hash falls on, and its bit there."""
    at = F.shiftrightunsigned(hash_, 64 - bits)
    return F.shiftright(at, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")).alias("bit")


def _wanted_bits(wanted: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of the wanted row keys: 2**bits bits, whatever their number."""
    words = (wanted.select(*_set_bits(F.xxhash64("row_key"), bits))
             .groupBy("word").agg(F.bit_or("bit").alias("bit")).toPandas())          # 2**(bits - 6) rows at most
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bit"].to_numpy(np.int64)
    return out.view(np.uint8)


def _shingle_sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """node, shingles, counts of every node; ``nodes``: (node, row_key)."""
    bits = WANTED_BITS
    shared = docs.sparkSession.sparkContext.broadcast(_wanted_bits(nodes, bits))
    slim = (docs.select(_row_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
            .select(F.shiftrightunsigned(F.xxhash64("row_key"), 64 - bits).alias("at"), "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value

        def wanted(batch: pa.RecordBatch) -> pa.RecordBatch:
            at = batch.column("at").to_numpy()
            return batch.filter(pa.array((bitmap[at >> 3] >> (at & 7)) & 1 == 1))

        for _, texts in arrow_text_runs(map(wanted, batches), max_bytes=RUN_BYTES):
            owner, value, count, keys = shingles(texts)
            ends = np.cumsum(np.bincount(owner, minlength=len(keys)))
            counts = [c if (c > 1).any() else None for c in np.split(count.astype(np.int32), ends[:-1])]
            yield pa.RecordBatch.from_pydict({
                "node": pa.array(keys, pa.binary()),
                "shingles": pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), value.view(np.int64)),
                "counts": pa.array(counts, pa.list_(pa.int32()))})      # null: all occur once

    found = slim.mapInArrow(run, "node binary, shingles array<long>, counts array<int>")
    once = Window.partitionBy("node").orderBy("node")
    return (found.join(nodes.select("node"), "node", "left_semi")
            .withColumn("nth", F.row_number().over(once)).filter("nth = 1").drop("nth"))


def components(links: DataFrame, name: str = "components", rows: int | None = None) -> DataFrame:
    """(node, label): the smallest node of each connected component of
    ``links`` (a, b), ``rows`` a bound of their number.  Every round takes the least label among a node, its
    neighbours and its label's label, so labels halve their distance."""
    spark = links.sparkSession
    both = written(links.select("a", "b").union(links.select("b", "a")).toDF("node", "other"), f"{name}-edges", rows and 2 * rows)
    labels = written(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")), f"{name}-0", rows)
    round_ = 0
    while True:
        round_ += 1
        near = (both.join(labels.toDF("other", "seen"), "other").groupBy("node").agg(F.min("seen").alias("seen")))
        jumped = labels.toDF("label", "up")
        step = (labels.join(near, "node").join(jumped, "label", "left")
                .select("node", F.least("label", "seen", "up").alias("label"), F.col("label").alias("was")))
        step = written(step, f"{name}-{round_}", rows)
        labels = step.select("node", "label")
        if step.filter("label <> was").isEmpty():
            return labels


def _sets_of(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """``sets`` without most of those that ``nodes`` do not name: a bitmap of
    fixed size over the wanted nodes goes to every task, so that the sets of a
    few pairs are not shuffled with all others."""
    word, bit = _set_bits(F.xxhash64("node"), SET_BITS)
    words = nodes.select(word, bit).groupBy("word").agg(F.bit_or("bit").alias("bits"))      # 2**(SET_BITS - 6) rows at most
    return (sets.select("*", word, bit).join(F.broadcast(words), "word")
            .filter(F.col("bits").bitwiseAND(F.col("bit")) != 0).select(*sets.columns))


def _beside(dealt: DataFrame, pairs: DataFrame, sets: DataFrame, side: str) -> DataFrame:
    """``dealt`` (the ``pairs``, perhaps with more columns) with the set of one
    side.  A node of many pairs is dealt in parts, each with a copy of its set."""
    other = "b" if side == "a" else "a"
    hubs = (pairs.groupBy(F.col(side).alias("node")).agg(F.ceil(F.count("*") / HUB_PAIRS).cast("int").alias("parts"))
            .filter("parts > 1"))                          # one in HUB_PAIRS of the pairs at most
    parts = F.coalesce("parts", F.lit(1))
    dealt = (dealt.withColumnRenamed(side, "node").join(F.broadcast(hubs), "node", "left")
             .withColumn("part", F.pmod(F.xxhash64(other), parts).cast("int")).drop("parts"))
    held = (_sets_of(sets, pairs.select(F.col(side).alias("node"))).join(F.broadcast(hubs), "node", "left")
            .withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
            .withColumnsRenamed({"shingles": f"s{side}", "counts": f"c{side}"}))
    return dealt.join(held, ["node", "part"]).drop("part").withColumnRenamed("node", side)


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose weighted sets have at least the threshold's probability Jaccard similarity."""
    pairs = written(pairs, "near-pairs")

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = {c: (batch.column(c).offsets.to_numpy(), batch.column(c).values.to_numpy()) for c in ("sa", "ca", "sb", "cb")}

            def weighted(row: int, side: str) -> tuple[np.ndarray, np.ndarray]:
                (at, shingle), (count_at, count) = flat[f"s{side}"], flat[f"c{side}"]
                element, times = shingle[at[row]:at[row + 1]], count[count_at[row]:count_at[row + 1]]
                return element, weights(times) if len(times) else np.ones(len(element))

            near = [probability_jaccard(*weighted(i, "a"), *weighted(i, "b")) >= threshold - 1e-9
                    for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return _beside(_beside(pairs, pairs, sets, "a"), pairs, sets, "b").select("a", "b", "sa", "ca", "sb", "cb").mapInArrow(
        similar, "a binary, b binary")


def _members(prints: DataFrame) -> DataFrame:
    """(node, band) of the bands that stand in several nodes; all bands are shuffled once."""
    in_band = Window.partitionBy("band")
    return (prints.filter("node is not null").select("node", F.explode("bands").alias("band"))
            .withColumns({"low": F.min("node").over(in_band), "high": F.max("node").over(in_band)})
            .filter("low <> high").select("node", "band").distinct())


def _classes(docs: DataFrame, prints: DataFrame, id_col: str, text_col: str, size: int, threshold: float) -> DataFrame:
    """(node, label) of the nodes that have links."""
    members = written(_members(prints), "near-members")
    n_members = members.count()
    bitmap = [f"b{i}" for i in range(BITMAP)]
    nodes = written(prints.join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(
        F.min("row_key").alias("row_key"), F.first("n").alias("n"), F.first("w").alias("w"), *[F.first(b).alias(b) for b in bitmap]), "near-nodes", n_members)
    sets = written(_shingle_sets(docs, nodes, id_col, text_col, size), "near-sets")
    n_nodes = sets.count()
    traits = nodes.drop("row_key")

    def possible() -> Column:
        """What a pair (x_a, x_b) must fulfil to reach the threshold."""
        spare = F.lit(1 - threshold + 1e-9)                   # of a text's weight that the other may lack
        sizes = (F.col("n_a") - F.col("n_b") <= spare * F.col("w_a")) & (F.col("n_b") - F.col("n_a") <= spare * F.col("w_b"))
        apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{b}_a").bitwiseXOR(F.col(f"{b}_b"))) for b in bitmap])
        # the shares a, b of weight that each has alone: similarity <= 2 (2 - a a - b b) / (2 + a + b)**2, so a + b is bounded
        return sizes & (apart <= F.lit(2 * (1 - threshold) / (1 + threshold) + 1e-9) * F.greatest("w_a", "w_b"))

    def named_as(df: DataFrame, side: str) -> DataFrame:
        return df.toDF(*[f"{c}_{side}" for c in df.columns])

    # round one: the member of one's bands that stands in the fullest bands
    filled = members.groupBy("band").agg(F.count("*").alias("size"))
    scores = members.join(filled, "band").groupBy("node").agg(F.sum("size").alias("score"))
    heads = (members.join(scores, "node").groupBy("band").agg(F.max(F.struct("score", "node")).alias("head")))
    stars = (members.join(heads, "band").groupBy("node").agg(F.max("head").alias("head"))
             .select(F.col("head.node").alias("centre"), "node").filter("centre <> node"))
    stars = (stars.join(named_as(traits, "a"), F.col("centre") == F.col("node_a"))
             .join(named_as(traits, "b"), F.col("node") == F.col("node_b")).filter(possible())
             .select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct())
    links = written(_verified(stars, sets, threshold), "near-links", n_nodes)
    open_, centres = members, FIRST_CENTRES
    while True:
        labels = components(links, rows=links.count())
        named = open_.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        classes = named.groupBy("band", "label").agg(F.count("*").alias("size"))
        largest = (classes.groupBy("band").agg(F.max(F.struct("size", "label")).alias("most"), F.count("*").alias("classes"))
                   .filter("classes > 1").select("band", F.col("most.label").alias("main")))
        named = written(named.join(largest, "band").join(traits, "node"), "near-open", n_members)
        if named.isEmpty():
            return labels
        rank = F.row_number().over(Window.partitionBy("band").orderBy("node"))
        chosen = written(named.filter("label <> main").withColumn("rank", rank).filter(F.col("rank") <= centres)
                         .drop("rank"), "near-centres", n_members)
        pairs = (named_as(chosen, "a").join(named_as(named, "b"), F.col("band_a") == F.col("band_b"))
                 .filter((F.col("label_a") != F.col("label_b")) & possible())
                 .select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct())
        links = links.union(written(_verified(pairs, sets, threshold), "near-links"))
        open_ = named.select("band", "node").join(chosen.select("band", "node"), ["band", "node"], "left_anti")
        centres *= 4


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS,
                    threshold: float = THRESHOLD, bands: int = BANDS, band_slots: int = BAND_SLOTS) -> DataFrame:
    """doc_id, row_key, class_id, group of every row (row_key: hash of id and
    text; group: what the rows of a class have in common, whatever their ids)."""
    prints = written(_prints(docs, id_col, text_col, size, bands, band_slots), "near-prints")
    labels = _classes(docs, prints, id_col, text_col, size, threshold)
    nodes = prints.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("low"), F.count("*").alias("rows"))
    grouped = (nodes.join(labels, "node", "left").filter("label is not null or rows > 1")
               .withColumn("label", F.coalesce("label", "node")))
    grouped = written(grouped, "near-grouped")
    heads = grouped.groupBy("label").agg(F.min("low").alias("class_id"))
    of_node = grouped.join(heads, "label").select("node", "class_id", "label")
    return (prints.select("doc_id", "row_key", "node").join(of_node, "node", "left")
            .select("doc_id", "row_key", F.coalesce("class_id", "doc_id").alias("class_id"),
                    F.coalesce("label", "node", "row_key").alias("group")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of every class: the one of the smallest id, rows
    without an id last (of rows with the same id, one); columns stay as they
    are.  Texts that are not near-duplicates both stay, also under one id."""
    plan = near_duplicates(docs, id_col, text_col, **options)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row_key"))
    heads = plan.groupBy("group").agg(first.alias("first")).select(F.col("first.row_key").alias("row_key"))
    key, nth = fresh_name(docs, "_near_key"), fresh_name(docs, "_near_nth")
    once = Window.partitionBy(key).orderBy(key)
    return (docs.withColumn(key, _row_key(id_col, text_col))
            .join(heads.withColumnRenamed("row_key", key), key, "left_semi")
            .withColumn(nth, F.row_number().over(once)).filter(F.col(nth) == 1).select(*docs.columns))

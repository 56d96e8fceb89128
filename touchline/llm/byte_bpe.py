"""Operator 5: byte-level BPE encoding and decoding with segment trees.

A text is cut into pieces by the tokenizer's pattern.  Over the byte
positions of a piece stands a segment tree whose leaves hold the rank of the
pair that starts there; the root is the leftmost pair of minimum rank.  A
merge writes three leaves (the merged symbol, its live neighbour to the left,
the swallowed one) and climbs log2(n) levels for each.  Live neighbours are a
doubly linked list.  Pieces of one tree size are merged side by side as numpy
rows, and each distinct piece is merged once per worker (bounded table).

Defined results: a null or empty text has no ids and decodes to empty bytes;
the strings of special tokens are ordinary text; texts are encoded whole and
on their own, so repeated rows and ties cannot matter; other columns are
ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import text_runs

NO_PAIR = np.int64(2**62)
KNOWN_PIECES = 150_000        # distinct pieces a worker remembers before it starts afresh
POSITION_BITS = 32


class BytePairCoder:
    """Encoder and decoder of one rank file (a line: base64 token, rank)."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.pieces_of = regex.compile(pattern).findall
        self.n_ids = max(self.ranks.values()) + 1
        self.first_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        # every way to join two tokens into a third, as sorted (left, right) keys
        joins = [(self.ranks[t[:i]] * self.n_ids + self.ranks[t[i:]], rank) for t, rank in self.ranks.items()
                 for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        joins.sort()
        self.pair_keys = np.array([k for k, _ in joins] + [NO_PAIR], np.int64)
        self.pair_ranks = np.array([r for _, r in joins] + [0], np.int64)
        self.known: dict[str, bytes] = {}
        # decoding: the bytes of all tokens end to end
        by_id = dict(zip(self.ranks.values(), self.ranks))
        lengths = np.array([len(by_id.get(i, b"")) for i in range(self.n_ids)], np.int64)
        self.token_len = lengths
        self.token_at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        self.token_bytes = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(self.n_ids)), np.uint8)

    def pair_keys_at(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leaf values: rank and position of the pairs, NO_PAIR where there is none."""
        want = left * self.n_ids + right
        i = np.searchsorted(self.pair_keys, want)
        return np.where(self.pair_keys[i] == want, self.pair_ranks[i] << POSITION_BITS | at, NO_PAIR)

    def merge(self, pieces: Sequence[bytes], leaves: int) -> list[bytes]:
        """Ids (packed int32) of pieces that have at most ``leaves`` bytes, a power of two."""
        n = np.array([len(p) for p in pieces])
        rows = np.arange(len(pieces))
        raw = np.frombuffer(b"".join(p.ljust(leaves, b"\0") for p in pieces), np.uint8).reshape(-1, leaves)
        symbols = self.first_ids[raw]
        where = np.arange(leaves)
        tree = np.full((len(pieces), 2 * leaves), NO_PAIR)    # node i has children 2i and 2i + 1, the root is 1
        tree[:, leaves:-1] = np.where(where[1:] < n[:, None],
                                      self.pair_keys_at(symbols[:, :-1], symbols[:, 1:], where[:-1]), NO_PAIR)
        level = leaves
        while level > 1:
            tree[:, level // 2:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
            level //= 2
        after = np.broadcast_to(where + 1, symbols.shape).copy()
        before = np.broadcast_to(np.arange(-1, leaves), (len(pieces), leaves + 1)).copy()
        live = np.broadcast_to(where, symbols.shape) < n[:, None]
        while True:
            rows = rows[tree[rows, 1] < NO_PAIR]
            if not len(rows):
                return [symbols[i, live[i]].astype(np.int32).tobytes() for i in range(len(pieces))]
            best = tree[rows, 1]
            at, merged = best & (2**POSITION_BITS - 1), best >> POSITION_BITS
            gone = after[rows, at]
            follows = after[rows, gone]
            symbols[rows, at], live[rows, gone] = merged, False
            after[rows, at] = follows
            before[rows, follows] = at
            left = before[rows, at]
            some = left >= 0                              # has a neighbour to the left
            right = symbols[rows, np.minimum(follows, leaves - 1)]
            pairs = self.pair_keys_at(np.concatenate([merged, symbols[rows[some], left[some]]]),
                                      np.concatenate([right, merged[some]]), np.concatenate([at, left[some]]))
            pairs[:len(rows)][follows >= n[rows]] = NO_PAIR
            self.update(tree, np.concatenate([rows, rows, rows[some]]), np.concatenate([gone, at, left[some]]),
                        np.concatenate([np.full(len(rows), NO_PAIR), pairs]))

    @staticmethod
    def update(tree: np.ndarray, rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        """Point updates: set the leaves, then renew the nodes above them level by level."""
        width = tree.shape[1]
        flat = tree.reshape(-1)
        base, node = rows * width, at + width // 2
        flat[base + node] = value
        while node[0] > 1:
            node = node >> 1
            child = base + 2 * node
            flat[base + node] = np.minimum(flat[child], flat[child + 1])

    def learn(self, pieces: set[str]) -> None:
        """Merge pieces that this worker has not met; sizes side by side, in
        blocks of about a million tree nodes."""
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            raw = p.encode("utf-8", "surrogatepass")
            if raw in self.ranks:
                self.known[p] = np.int32(self.ranks[raw]).tobytes()
            else:
                by_size.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append((p, raw))
        for leaves, group in by_size.items():
            block = max(1, 500_000 // leaves)
            for i in range(0, len(group), block):
                part = group[i:i + block]
                self.known.update(zip((p for p, _ in part), self.merge([raw for _, raw in part], leaves)))

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        found = [self.pieces_of(t) if t else [] for t in texts]
        if len(self.known) > KNOWN_PIECES:
            self.known.clear()
        self.learn(set().union(*found) - self.known.keys())
        return [np.frombuffer(b"".join(map(self.known.__getitem__, f)), np.int32) for f in found]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and byte offsets of ragged ids (``offsets`` has one more than the rows)."""
        size = self.token_len[ids]
        end = np.cumsum(size)
        out = np.arange(end[-1] if len(end) else 0) + np.repeat(self.token_at[ids] - (end - size), size)
        return self.token_bytes[out], np.concatenate([[0], end])[offsets]


@lru_cache(maxsize=4)
def coder(rank_file: str, pattern: str) -> BytePairCoder:
    return BytePairCoder(rank_file, pattern)


def _long_offsets(sizes: Sequence[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))]).astype(np.int64)


def round_trip(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """id, ids (array<int>), decoded (binary): every text encoded, and its ids decoded."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(rank_file, pattern)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in text_runs(texts):
                ids = bpe.encode(texts[part])
                offsets = _long_offsets([len(x) for x in ids])
                flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
                raw, ends = bpe.decode(flat, offsets)
                n = len(ids)
                decoded = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(part.start, n),
                     pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(flat)).cast(pa.list_(pa.int32())),
                     decoded.cast(pa.binary())], ["doc_id", "ids", "decoded"])

    return slim.mapInArrow(run, f"doc_id {id_type}, ids array<int>, decoded binary")


def digests(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of a round trip."""
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))

"""Operator 2: token counts by rank-synchronous array merging.

Texts are normalised and cut into pre-tokens as the tokenizer file says.  The
distinct pre-tokens of a batch lie end to end in one ragged symbol array with
the merge rank of every adjacent pair beside it.  A step finds each
sequence's lowest rank (one reduceat), merges all its occurrences in all
sequences at once (of overlapping ones every other, from the left), drops the
swallowed symbols and looks up ranks only beside merges.  Sequences without a
pair leave the arrays; what is left of them is counted.

Reads files of the ``tokenizers`` library whose model is BPE with an
end-of-word suffix, NFC / white space / lower-case normalisers and byte-level
pre-tokens.  Added tokens inside a text count one each, as is the library's
default; none is put around it.

Defined results: a null or empty text has 0 tokens and 0 bytes; texts are
counted whole and on their own, so repeated rows and ties cannot matter;
other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import text_runs

NO_RANK = np.int64(2**62)
KNOWN_WORDS = 600_000         # distinct words a worker remembers before it starts afresh
# Lower case letter by letter (no final sigma), and two pairs that are newer than Python's tables.
LETTER_BY_LETTER = {0x3A3: 0x3C3, 0xA7CB: 0x264, 0xA7DC: 0x19B}


class MergeTable:
    """The parts of a tokenizer file that decide how many tokens a text has."""

    def __init__(self, tokenizer_file: str):
        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pretokens_of = regex.compile(split["pattern"]["Regex"]).findall
        added = [regex.escape(t["content"]) for t in spec["added_tokens"]]
        self.added = regex.compile("|".join(sorted(added, key=len, reverse=True))) if added else None
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.n_symbols = len(vocab) + len(added)
        # byte-level alphabet: printable bytes stand for themselves, the others follow from code point 256
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.inner = np.array([vocab[letter[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[letter[b] + suffix] for b in range(256)], np.int64)
        merges = [(vocab[a] * self.n_symbols + vocab[b], rank, vocab[a + b])
                  for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        merges.sort()
        self.pairs = np.array([m[0] for m in merges] + [NO_RANK], np.int64)
        self.pair_rank = np.array([m[1] for m in merges] + [0], np.int64)
        self.joined = np.zeros(len(merges), np.int64)     # by rank
        self.joined[[m[1] for m in merges]] = [m[2] for m in merges]
        self.known: dict[str, int] = {}

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = left * self.n_symbols + right
        i = np.searchsorted(self.pairs, want)
        return np.where(self.pairs[i] == want, self.pair_rank[i], NO_RANK)

    def survivors(self, pretokens: Sequence[bytes]) -> np.ndarray:
        """Symbols left of each pre-token when no pair can merge any more."""
        size = np.array([len(p) for p in pretokens], np.int64)
        raw = np.frombuffer(b"".join(pretokens), np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(size)
        symbols[ends - 1] = self.last[raw[ends - 1]]
        counts = size.copy()
        owner = np.arange(len(size))                       # of the sequences that are still open
        start = ends - size
        rank = np.full(len(symbols), NO_RANK)
        rank[:-1] = self.rank_of(symbols[:-1], symbols[1:])
        rank[ends - 1] = NO_RANK
        while len(owner):
            lowest = np.minimum.reduceat(rank, start)
            open_ = lowest < NO_RANK
            counts[owner[~open_]] = size[~open_]
            if not open_.all():                            # closed sequences leave the arrays
                keep = np.repeat(open_, size)
                symbols, rank, size, owner, lowest = symbols[keep], rank[keep], size[open_], owner[open_], lowest[open_]
                start = np.cumsum(size) - size
                if not len(owner):
                    break
            seq = np.repeat(np.arange(len(size)), size)
            hit = rank == lowest[seq]
            where = np.flatnonzero(hit)
            # overlapping occurrences follow one another directly: keep every other one of a run
            fresh = np.ones(len(where), bool)
            fresh[1:] = (where[1:] != where[:-1] + 1) | (seq[where[1:]] != seq[where[:-1]])
            run_start = np.maximum.accumulate(np.where(fresh, np.arange(len(where)), 0))
            where = where[(np.arange(len(where)) - run_start) % 2 == 0]
            symbols[where] = self.joined[rank[where]]
            keep = np.ones(len(symbols), bool)
            keep[where + 1] = False
            rank[where] = rank[where + 1]                  # stays only where the sequence ends
            size = size - np.bincount(seq[where], minlength=len(size))
            moved = np.cumsum(keep) - 1
            symbols, rank = symbols[keep], rank[keep]
            start = np.cumsum(size) - size
            last = np.zeros(len(symbols), bool)
            last[start + size - 1] = True
            touched = np.concatenate([moved[where], moved[where] - 1])
            touched = touched[touched >= 0]
            rank[last] = NO_RANK
            touched = touched[~last[touched]]
            rank[touched] = self.rank_of(symbols[touched], symbols[touched + 1])
        return counts

    def normal(self, text: str) -> str:
        """As the file's normalisers, but for white space, which ends up in no pre-token."""
        return unicodedata.normalize("NFC", text).translate(LETTER_BY_LETTER).lower()

    def learn(self, words: list[str]) -> None:
        """Count the tokens of words that this worker has not met."""
        found = [self.pretokens_of(self.normal(w)) for w in words]
        distinct = list(set().union(*found))
        if distinct:
            left = dict(zip(distinct, self.survivors([p.encode("utf-8", "surrogatepass") for p in distinct]).tolist()))
        self.known.update((w, sum(left[p] for p in f)) for w, f in zip(words, found))

    def count(self, texts: Sequence[str | None]) -> list[int]:
        """Tokens of every text; no pre-token has a blank or line feed in it,
        so the distinct words between those are what needs merging."""
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        found, extra = [], []
        for t in texts:
            parts = self.added.split(t) if t and self.added else [t or ""]
            extra.append(len(parts) - 1)
            found.append([w for part in parts for w in part.replace("\n", " ").split(" ")])
        new = list(set().union(*found) - self.known.keys())
        if new:
            self.learn(new)
        return [n + sum(map(self.known.__getitem__, f)) for n, f in zip(extra, found)]


@lru_cache(maxsize=4)
def merge_table(tokenizer_file: str) -> MergeTable:
    return MergeTable(tokenizer_file)


def count_tokens(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens of every whole text."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    id_type = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = merge_table(tokenizer_file)
        for batch in batches:
            texts = batch["text"].tolist()
            counts: list[int] = []
            for part in text_runs(texts):
                counts += table.count(texts[part])
            yield batch[["doc_id", "n_bytes"]].assign(n_tokens=np.array(counts, np.int64))

    return slim.mapInPandas(run, f"doc_id {id_type}, n_bytes long, n_tokens long")

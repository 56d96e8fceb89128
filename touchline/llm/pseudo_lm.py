"""Operator 6: masked pseudo-likelihood scores.

Words fall into classes, and classes into groups of as many classes as there
are groups: G groups of G classes, G the fourth root of the number of distinct
words of the corpus, rounded up to a multiple of 8 (so the classes grow with
the square root of the words).  Five eighths of the groups hold the most
frequent words in order of count, each a class of its own; of all other words
the last two letters give the group and the last four the class.  A small
network (two words to either side -> embeddings of their classes -> tanh layer
-> softmax over groups, softmax over the classes of the word's group) predicts
every word with that word masked:

    P(word | context) = P(group | context) P(class | group, context) P(word | class)

and P(word | class) is the word's count over that of its class (plus one, for
a word never seen); it is 1 for words with a class of their own.  A document's
score is the sum of the log-probabilities of all its words, each predicted
from both sides.

Word counts come from all documents and stay a Spark table of all words.  The
tasks hold the ``vocabulary`` most frequent; the other words of a document are
joined with the table, so a score does not depend on ``vocabulary``.  Training
is data parallel in numpy: every task runs its documents through the network
from common weights (whose biases are the classes' frequencies), Spark
averages the weights by words seen; the first round passes over an eighth of
the documents (by hash of the text), so that the second, over all of them,
starts every task in the same basin.

Defined results: a null, empty or blank text has 0 words, sum 0 and no mean;
texts are scored whole and on their own, so repeated rows and ties cannot
matter (ties in the vocabulary go to the smaller word); without any word in
the corpus nothing is trained and every score is 0; other columns are
ignored; an empty table gives an empty one.

Bounds: tasks and driver hold ``vocabulary`` words and weights that grow with
the square root of the number of distinct words; weights are averaged in
Spark, and only the averages reach the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import arrow_text_runs, written

LEAST_GROUPS = 8               # a multiple of 8, like every number of groups
CLASSES = LEAST_GROUPS**2      # of a small corpus
EDGE = -1                      # what stands beyond either end of a text; the last embedding
SIDE = 2                       # words seen on either side
EMBED, HIDDEN = 8, 32
BATCH, RATE = 2048, 0.5
ROUNDS = (8, 1)                # a round trains on one in so many documents
RUN_BYTES = 1_000_000          # of text worked on at a time
COUNTED_BYTES = 16_000_000     # of words a task counts before it sends the counts on
KNOWN_ENDINGS = 100_000        # of words outside the vocabulary whose class a task remembers
KEPT_BYTES = 30_000_000        # freed by a batch, which a task keeps for the next one


def groups_for(distinct_words: int) -> int:
    """Groups of classes, and classes of a group, for so many distinct words."""
    return max(LEAST_GROUPS, 8 * int(np.ceil(distinct_words**0.25 / 8)))


def own_classes(groups: int) -> int:
    return groups // 8 * 5 * groups


def shapes(groups: int) -> tuple[tuple[int, ...], ...]:
    """Of embeddings, hidden layer, classes by group, groups; with biases."""
    return ((groups**2 + 1, EMBED), (2 * SIDE * EMBED, HIDDEN), (HIDDEN,), (HIDDEN, groups**2), (groups**2,),
            (HIDDEN, groups), (groups,))


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def _words(texts: Sequence[str | None]) -> tuple[np.ndarray, pa.Array]:
    """Number of words of each text, and the words_of() all, without a Python string for each."""
    words = pc.utf8_split_whitespace(pa.array([t.lower().strip() or None if t else None for t in texts], pa.string()))
    return words.value_lengths().fill_null(0).to_numpy().astype(np.int64), words.flatten()


def _crc(word: str, letters: int) -> int:
    return zlib.crc32(word[-letters:].encode("utf-8", "surrogatepass"))


def suffix_class(word: str, groups: int = LEAST_GROUPS) -> int:
    return own_classes(groups) + _crc(word, 2) % (groups // 8 * 3) * groups + _crc(word, 4) % groups


def _suffix_class(word: Column, groups: int) -> Column:
    """The same in Spark."""
    crc = lambda letters: F.crc32(F.right(word, F.lit(letters)).cast("binary"))
    return (own_classes(groups) + crc(2) % (groups // 8 * 3) * groups + crc(4) % groups).cast("int")


@dataclass
class Vocabulary:
    """Words by number; numbers from len(words) on are the other words of a class."""
    words: list[str]
    word_class: np.ndarray     # of words, then of the classes' other words
    log_in_class: np.ndarray   # log P(word | class); of other words that of one occurrence
    groups: int
    class_count: np.ndarray    # occurrences of each class's words
    least: int                 # count of the last of words

    def numbering(self) -> _Numbers:
        return _Numbers({w: i for i, w in enumerate(self.words)}, len(self.words), self.groups)


class _Endings(dict):
    """Numbers of the other words by their last four letters, on which alone a suffix class depends."""
    def __init__(self, first_other: int, groups: int):
        super().__init__()
        self.first_other, self.groups = first_other, groups

    def __missing__(self, ending: str) -> int:
        if len(self) >= KNOWN_ENDINGS:
            self.clear()
        number = self[ending] = self.first_other + suffix_class(ending, self.groups)
        return number


class _Numbers(dict):
    def __init__(self, known: dict[str, int], first_other: int, groups: int):
        super().__init__(known)
        self.first_other, self.endings = first_other, _Endings(first_other, groups)
        self.known, self.number = pa.array(known, pa.string()), np.array([*known.values()], np.int64)

    def __missing__(self, word: str) -> int:
        return self.endings[word[-4:]]

    def of(self, words: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """The numbers of many words, and those of the words that are outside the vocabulary."""
        at = pc.index_in(words, value_set=self.known)
        number = self.number[at.fill_null(0).to_numpy()] if len(self.known) else np.empty(len(words), np.int64)
        others = words.filter(at.is_null())
        endings = pc.utf8_slice_codeunits(others, start=-4).dictionary_encode()
        of_ending = [self.endings[e] for e in endings.dictionary.to_pylist()]
        number[at.is_null().to_numpy(zero_copy_only=False)] = np.array(of_ending, np.int64)[endings.indices.to_numpy()]
        return number, others


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, n) over all documents; each task sends its counts once."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_struct_array(pc.value_counts(pa.chunked_array(held, pa.string()))).rename_columns(["word", "n"])

        for _, texts in arrow_text_runs(batches, max_bytes=RUN_BYTES):
            held.append(_words(texts)[1])
            size += held[-1].nbytes
            if size > COUNTED_BYTES:                       # bounded: Spark adds up the rest
                yield rows()
                held, size = [], 0
        if held:
            yield rows()

    return (docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


def learn_vocabulary(docs: DataFrame, text_col: str = "text", vocabulary: int = 50_000) -> Vocabulary:
    return _vocabulary(written(word_counts(docs, text_col), "lm-words"), vocabulary)


def _vocabulary(counts: DataFrame, vocabulary: int) -> Vocabulary:
    groups = groups_for(counts.count())
    # words by powers of two of their count (64 rows at most): those below the power in which the
    # vocabulary ends need not be ranked, so that partitions do not each send a vocabulary to the driver
    power = F.length(F.bin("n")) - 1
    at_least, words_above = 0, 0
    for r in sorted(counts.groupBy(power.alias("p")).agg(F.count("*").alias("words")).collect(), reverse=True):
        at_least, words_above = 2 ** r["p"], words_above + r["words"]
        if words_above >= vocabulary:
            break
    top = counts.filter(F.col("n") >= at_least).orderBy(F.desc("n"), "word").limit(vocabulary).toPandas()
    totals = counts.groupBy(_suffix_class(F.col("word"), groups).alias("c")).agg(F.sum("n").alias("n")).collect()
    words, n = top["word"].tolist(), top["n"].to_numpy(np.float64)       # totals: a row a class at most
    cls = np.array([suffix_class(w, groups) for w in words], int)
    count = np.zeros(groups**2)
    for r in totals:
        count[r["c"]] = r["n"]
    own = np.arange(min(own_classes(groups), len(words)))
    np.subtract.at(count, cls[own], n[own])
    cls[own] = own
    count[own] = n[own]
    log_whole = np.log(np.maximum(count + (np.arange(groups**2) >= own_classes(groups)), 1))
    log_p = np.concatenate([np.log(n) - log_whole[cls], -log_whole])
    return Vocabulary(words, np.concatenate([cls, np.arange(groups**2)]), log_p, groups, count,
                      int(n[-1]) if len(n) else 0)


def start_weights(seed: int = 7, groups: int = LEAST_GROUPS, class_count: np.ndarray | None = None) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    weights = [(rng.standard_normal(s) / np.sqrt(s[0] if len(s) > 1 and s[0] != groups**2 + 1 else 4)
                if len(s) > 1 else np.zeros(s)).astype(np.float32) for s in shapes(groups)]
    if class_count is not None:
        weights[4][:] = np.log(class_count + 1.0)
        weights[6][:] = np.log(class_count.reshape(groups, groups).sum(1) + 1.0)
    return weights


def numbered(texts: Sequence[str | None], numbers: _Numbers) -> tuple[np.ndarray, np.ndarray]:
    """(text number, word number) of all words."""
    return _run_numbers(texts, numbers)[:2]


def _numbered(texts: Sequence[str | None], numbers: _Numbers) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """numbered() and the words outside the vocabulary, in their order."""
    owner, number, others = _run_numbers(texts, numbers)
    return owner, number, others.to_pylist()


def _run_numbers(texts: Sequence[str | None], numbers: _Numbers) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    n, words = _words(texts)
    return np.repeat(np.arange(len(texts)), n), *numbers.of(words)


def windows(owner: np.ndarray, cls: np.ndarray, n_texts: int) -> np.ndarray:
    """Classes of the SIDE words before and after each word of the same text, EDGE beyond its ends."""
    at = np.arange(len(cls)) + SIDE * (2 * owner + 1)      # every text stands between its own edges
    line = np.full(len(cls) + 2 * SIDE * n_texts, EDGE, np.int64)
    line[at] = cls
    return np.stack([line[at + o] for o in (*range(-SIDE, 0), *range(1, SIDE + 1))], axis=1)


def _hidden(weights: list[np.ndarray], window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and hidden layer."""
    embed, w1, b1 = weights[:3]
    x = embed.take(window, axis=0, mode="wrap").reshape(len(window), -1)      # EDGE is the last
    z = x @ w1
    z += b1
    return x, np.tanh(z, out=z)


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z -= np.moveaxis(z, -1, 0).copy().max(0)[..., None]    # a maximum over whole rows, as numpy is slow over short ones
    z -= np.log(np.exp(z).sum(-1, keepdims=True))
    return z


def _keep_freed() -> None:
    """Let the process keep the memory of a batch's arrays, or every batch has them mapped and zeroed anew: malloc keeps
    blocks up to the size of the largest one freed.  Nothing is held by it, as the block is never touched."""
    np.empty(KEPT_BYTES, np.uint8)


def _by_group(target: np.ndarray, groups: int) -> tuple[np.ndarray, list[tuple[slice, slice]]]:
    """An order of the targets by group, and of every group that occurs its rows in that order and its classes."""
    group = target // groups
    rows = np.bincount(group, minlength=groups)
    ends = np.cumsum(rows).tolist()
    narrow = group.astype(np.int16) if groups <= 1 << 15 else group           # 16 bits are sorted by digits
    return np.argsort(narrow, kind="stable"), [(slice(ends[g - 1] if g else 0, ends[g]), slice(g * groups, (g + 1) * groups))
                                               for g in np.flatnonzero(rows).tolist()]


def _levels(weights: list[np.ndarray], h: np.ndarray, target: np.ndarray, parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities of all groups, and of the classes of the target's group; targets stand in order of groups."""
    w2, b2, w3, b3 = weights[3:]
    groups = len(b3)
    inner = b2.reshape(groups, groups)[target // groups]
    for rows, classes in parts:
        part = inner[rows]
        part += h[rows] @ w2[:, classes]
    return _log_softmax(h @ w3 + b3), _log_softmax(inner)


def forward(weights: list[np.ndarray], window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, hidden layer and log-probabilities of all classes."""
    w2, b2, w3, b3 = weights[3:]
    x, h = _hidden(weights, window)
    inner = _log_softmax((h @ w2 + b2).reshape(len(h), len(b3), -1))
    return x, h, (inner + _log_softmax(h @ w3 + b3)[:, :, None]).reshape(len(h), -1)


def class_log_p(weights: list[np.ndarray], window: np.ndarray, target: np.ndarray) -> np.ndarray:
    """forward()'s log-probability of the target class alone."""
    groups = len(weights[6])
    order, parts = _by_group(target, groups)
    target = target[order]
    at = np.arange(len(target))
    outer, inner = _levels(weights, _hidden(weights, window.take(order, axis=0))[1], target, parts)
    out = np.empty(len(target), outer.dtype)
    out[order] = outer[at, target // groups] + inner[at, target % groups]
    return out


def train_batch(weights: list[np.ndarray], window: np.ndarray, target: np.ndarray, rate: float) -> None:
    """One step of gradient descent on the mean conditional log-likelihood, in place."""
    embed, w1, b1, w2, b2, w3, b3 = weights
    groups = len(b3)
    order, parts = _by_group(target, groups)
    window, target = window.take(order, axis=0), target[order]
    at = np.arange(len(target))
    x, h = _hidden(weights, window)
    outer, inner = _levels(weights, h, target, parts)
    go, gi = np.exp(outer, out=outer), np.exp(inner, out=inner)
    go[at, target // groups] -= 1.0
    gi[at, target % groups] -= 1.0
    go *= rate / len(at)
    gi *= rate / len(at)
    gh = go @ w3.T
    for rows, classes in parts:
        # views, as an assignment to a slice copies it once more
        g, gh_, w2_, b2_ = gi[rows], gh[rows], w2[:, classes], b2[classes]
        gh_ += g @ w2_.T
        w2_ -= h[rows].T @ g
        b2_ -= np.add.reduce(g)
    gh *= 1.0 - h * h
    gx = (gh @ w1.T).reshape(-1, EMBED)
    w3 -= h.T @ go
    b3 -= go.sum(0)
    w1 -= x.T @ gh
    b1 -= gh.sum(0)
    flat = window.reshape(-1)
    flat[flat < 0] += len(embed)                           # EDGE is the last
    for d, of_dimension in enumerate(gx.T.astype(np.float64, order="C")):
        embed[:, d] -= np.bincount(flat, of_dimension, len(embed)).astype(np.float32)


def train(docs: DataFrame, vocab: Vocabulary, text_col: str = "text", rounds: Sequence[int] = ROUNDS,
          rate: float = RATE) -> list[np.ndarray]:
    """Weights after the given rounds of data-parallel training."""
    weights = start_weights(groups=vocab.groups, class_count=vocab.class_count)
    slim = docs.select(F.col(text_col).alias("text"))
    for one_in in rounds:
        shared = docs.sparkSession.sparkContext.broadcast((vocab, weights))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            _keep_freed()
            vocab_, start = shared.value
            numbers, mine, seen = vocab_.numbering(), [w.copy() for w in start], 0
            for _, texts in arrow_text_runs(batches, max_bytes=RUN_BYTES):
                owner, number = numbered(texts, numbers)
                cls = vocab_.word_class[number]
                window = windows(owner, cls, len(texts))
                # words of all texts of the run mixed, so that a batch is not one text
                order = np.random.default_rng(len(cls)).permutation(len(cls))
                for i in range(0, len(cls), BATCH):
                    at = order[i:i + BATCH]
                    train_batch(mine, window.take(at, axis=0), cls[at], rate * len(at) / BATCH)
                seen += len(cls)
            if seen:
                flat = np.concatenate([w.ravel() for w in mine]).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat * seen),
                                                  pa.array(np.full(len(flat), float(seen)))], ["at", "w", "n"])

        rows = slim.filter(F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0) if one_in > 1 else slim
        mean = (rows.mapInArrow(run, "at int, w double, n double").groupBy("at")
                .agg((F.sum("w") / F.sum("n")).alias("w")).orderBy("at").toPandas()["w"].to_numpy())
        if len(mean):
            cuts = np.cumsum([int(np.prod(s)) for s in shapes(vocab.groups)])[:-1]
            weights = [x.reshape(s).astype(np.float32) for x, s in zip(np.split(mean, cuts), shapes(vocab.groups))]
    return weights


def score_texts(vocab: Vocabulary, weights: list[np.ndarray], numbers: _Numbers,
                texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(words, summed log-probability) of each text; words outside the vocabulary count as seen once."""
    return _score(vocab, weights, numbers, texts)[:2]


def _score(vocab: Vocabulary, weights: list[np.ndarray], numbers: _Numbers,
           texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    """score_texts() and the words of each text outside the vocabulary."""
    owner, number, others = _run_numbers(texts, numbers)
    cls = vocab.word_class[number]
    window = windows(owner, cls, len(texts))
    log_p = vocab.log_in_class[number]
    for i in range(0, len(cls), 4 * BATCH):
        part = slice(i, i + 4 * BATCH)
        log_p[part] += class_log_p(weights, window[part], cls[part])
    ends = np.cumsum(np.bincount(owner[number >= numbers.first_other], minlength=len(texts)))
    return (np.bincount(owner, minlength=len(texts)), np.bincount(owner, log_p, len(texts)),
            pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), others))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = 50_000,
                    rounds: Sequence[int] = ROUNDS) -> DataFrame:
    """doc_id, n_words, log_likelihood (sum), mean_log_likelihood of every document."""
    counts = written(word_counts(docs, text_col), "lm-words")
    vocab = _vocabulary(counts, max(vocabulary, own_classes(groups_for(counts.count()))))
    weights = train(docs, vocab, text_col, rounds)
    shared = docs.sparkSession.sparkContext.broadcast((vocab, weights))
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep_freed()
        vocab_, weights_ = shared.value
        numbers = vocab_.numbering()
        row = TaskContext.get().partitionId() << 40        # ids can repeat or be null
        for batch, texts in arrow_text_runs(batches, max_bytes=RUN_BYTES):
            n, total, others = _score(vocab_, weights_, numbers, texts)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(texts))), batch.column("doc_id"), pa.array(n.astype(np.int64)),
                                              pa.array(total.astype(np.float64)), others],
                                             ["row", "doc_id", "n_words", "log_likelihood", "others"])
            row += len(texts)

    scored = written(slim.mapInArrow(run, f"row long, doc_id {id_type}, n_words long, log_likelihood double, others array<string>"), "lm-scored")
    # words outside the vocabulary were taken as seen once, and those seen more often add to that; each occurs in at most one in
    # ``vocabulary`` of all places, so that no word fills a task
    more = (scored.select("row", F.explode("others").alias("word"))
            .join(counts.filter((F.col("n") <= vocab.least) & (F.col("n") > 1)), "word")
            .groupBy("row").agg(F.sum(F.ln("n")).alias("more")))
    scored = (scored.drop("others").join(more, "row", "left")
              .withColumn("log_likelihood", F.col("log_likelihood") + F.coalesce("more", F.lit(0.0))).drop("row", "more"))
    return scored.withColumn("mean_log_likelihood", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")))

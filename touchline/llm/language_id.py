"""Operator 10: language ID by multilingual mixture inference.

Learning counts hashed letter trigrams per language over all labelled
documents (a Spark aggregation; the model is a table of 65,536 buckets per
language, whatever the corpus size).  Inference treats a document as a
mixture of languages: expectation-maximisation estimates the proportions from
the trigram likelihoods, then languages are added in order of proportion for
as long as the penalised log-likelihood (half a log of the trigram count a
language) rises.  The prediction is the largest share of the chosen set.

Defined results: a text that is null or has no letter is ``und`` with score
0, and so is every text if no language was learned; a null label or null id
teaches nothing; repeated rows teach as often as they occur; languages with
equal shares go to the smaller name; texts are read whole; other columns are
ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import text_runs

BUCKETS = 1 << 16
UNKNOWN = "und"
EM_STEPS = 12
PRIOR = 0.5                    # pseudo-trigrams a language holds in every document
RUN_CHARS = 300_000


@dataclass
class LanguageModel:
    languages: list[str]
    log_p: np.ndarray          # BUCKETS x languages


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of all letter trigrams; anything else is one blank."""
    padded = [f" {t.lower()} " if t else "  " for t in texts]
    code = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(padded)), [len(p) for p in padded])
    letter = _is_letter()[code]
    code = np.where(letter, code, 32).astype(np.uint64)
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1] | (owner[1:] != owner[:-1])    # a blank after a letter, and each text's first
    code, owner, letter = code[keep], owner[keep], letter[keep]
    if len(code) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    mixed = (code[:-2] * np.uint64(0x9E3779B97F4A7C15) + code[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
             + code[2:] * np.uint64(0x165667B19E3779F9))
    mixed ^= mixed >> np.uint64(29)
    bucket = (mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)
    inside = (owner[:-2] == owner[2:]) & (letter[:-2] | letter[1:-1] | letter[2:])
    return owner[:-2][inside], bucket[inside].astype(np.int64)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Count trigrams per language over all documents of the learning folds."""
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % 5
    rows = (docs.filter((fold != 0) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
            .select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, group in batch.groupby("lang"):
                texts = group["text"].tolist()
                total = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for part in text_runs(texts, RUN_CHARS):
                    total += np.bincount(trigrams(texts[part])[1], minlength=BUCKETS)
        for lang, total in totals.items():
            seen = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bucket": seen.astype(np.int32), "n": total[seen]})

    sums = (rows.mapInPandas(count, "lang string, bucket int, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())   # BUCKETS rows a language at most
    languages = sorted(sums["lang"].unique())
    counts = np.zeros((BUCKETS, len(languages)))
    counts[sums["bucket"].to_numpy(int), [languages.index(x) for x in sums["lang"]]] = sums["n"]
    counts += 0.05
    return LanguageModel(languages, np.log(counts / counts.sum(0, keepdims=True)).astype(np.float32))


def _proportions(p: np.ndarray, n: np.ndarray, first: np.ndarray, doc: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """EM over the mixture proportions; ``allowed``: documents x languages."""
    share = allowed / allowed.sum(1, keepdims=True)
    for _ in range(EM_STEPS):
        part = p * share[doc]
        part *= (n / part.sum(1))[:, None]
        share_new = (np.add.reduceat(part, first, axis=0) + PRIOR) * allowed
        share_new /= share_new.sum(1, keepdims=True)
        moved = np.abs(share_new - share).max()
        share = share_new
        if moved < 1e-3:
            break
    return share


def infer(model: LanguageModel, texts: Sequence[str | None]) -> pd.DataFrame:
    """lang, score, languages (the chosen set), fit (log-likelihood a trigram
    over that of a uniform choice of bucket) of every text."""
    k, n_texts = len(model.languages), len(texts)
    lang = np.full(n_texts, UNKNOWN, object)
    score, fit = np.zeros(n_texts), np.zeros(n_texts)
    chosen = [[] for _ in texts]
    owner, bucket = trigrams(texts) if k and n_texts else (np.empty(0, int), np.empty(0, int))
    if len(owner):
        key, n = np.unique(owner * BUCKETS + bucket, return_counts=True)
        owner, bucket = key // BUCKETS, key % BUCKETS
        log_p = model.log_p[bucket].astype(np.float64)
        n = n.astype(np.float64)
        texts_in, first, doc = np.unique(owner, return_index=True, return_inverse=True)
        top = log_p.max(1)
        p = np.exp(log_p - top[:, None])
        total = np.add.reduceat(n, first)
        base = np.add.reduceat(n * top, first)
        alone = np.add.reduceat(log_p * n[:, None], first, axis=0)
        whole = _proportions(p, n, first, doc, np.ones((len(first), k)))
        best = alone.argmax(1)
        rows = np.arange(len(first))
        share = np.zeros((len(first), k))
        share[rows, best] = 1.0
        level, penalty = alone[rows, best], 0.5 * np.log(total + 1)
        # more languages, by their share, while the penalised likelihood rises
        rank = np.argsort(-whole, axis=1, kind="stable")
        allowed, growing = share.copy(), np.ones(len(first), bool)
        for more in range(k):
            add = rank[:, more]
            new = growing & (allowed[rows, add] == 0)
            if not new.any():
                continue
            trial = allowed.copy()
            trial[rows[new], add[new]] = 1.0
            part = new[doc]
            where = np.flatnonzero(new)
            sub_doc = np.searchsorted(where, doc[part])
            sub_first = np.flatnonzero(np.r_[True, sub_doc[1:] != sub_doc[:-1]])
            got = _proportions(p[part], n[part], sub_first, sub_doc, trial[where])
            value = (np.add.reduceat(n[part] * np.log((p[part] * got[sub_doc]).sum(1)), sub_first)
                     + base[where] - penalty[where] * (trial[where].sum(1) - 1))
            better = value > level[where]
            hit = where[better]
            allowed[hit], share[hit], level[hit] = trial[hit], got[better], value[better]
            growing[where[~better]] = False
        lead = share.argmax(1)
        names = np.array(model.languages, object)
        lang[texts_in] = names[lead]
        score[texts_in] = np.clip(whole[rows, lead], 0, 1)
        fit[texts_in] = level / total + np.log(BUCKETS)
        for t, s in zip(texts_in, share):
            chosen[t] = [str(x) for x in names[s > 0]]
    return pd.DataFrame({"lang": lang, "score": score, "languages": chosen, "fit": fit})


def identifier(docs: DataFrame, model: LanguageModel):
    """A column function: text -> struct(lang, score, languages, fit).  The
    model is BUCKETS x languages floats, broadcast once."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, languages array<string>, fit double")
    def identify(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in series:
            texts = s.tolist()
            parts = [infer(shared.value, texts[part]) for part in text_runs(texts, RUN_CHARS)]
            yield pd.concat(parts, ignore_index=True) if parts else infer(shared.value, [])

    return identify


def identify_documents(docs: DataFrame, model: LanguageModel | None = None, id_col: str = "doc_id",
                       text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages, fit of every document."""
    model = model or learn(docs, id_col, text_col, lang_col)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = slim.withColumn("r", identifier(docs, model)(F.col("text")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("r.lang").alias("lang_pred"),
                      F.col("r.score").alias("score"), F.col("r.languages").alias("languages"), F.col("r.fit").alias("fit"))


def crc_fold(doc_id: int) -> int:
    """The fold of one id, as the queries have it."""
    return zlib.crc32(str(doc_id).encode()) % 5

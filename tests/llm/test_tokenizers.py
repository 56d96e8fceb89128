"""Token counts and byte-level BPE against the libraries themselves."""

import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm_tables import DOCS, documents
from touchline.llm.byte_bpe import coder, digests, round_trip
from touchline.llm.token_counts import count_tokens, merge_table

RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")


def odd_texts():
    rnd = random.Random(3)
    some = ["", "a", " ", "\n\n x", "don't we'll I'M", "ΑΣ Σς", "İstanbul ǅ", "ée", "a b c", "漢字かな 🙂🙂 👨‍👩‍👧",
            "<|endoftext|>", "x<|startoftext|>y <|endoftext|><|endoftext|>", "\x1c\x1d a\x1eb", "１２３ 4567", "﻿bom", "a\r\nb\tc"]
    some += ["".join(rnd.choice("aAbBeé ' sßt\n\t1２漢🙂.!#") for _ in range(rnd.randint(0, 50))) for _ in range(400)]
    return some + ["aaaa" * 4000, " " * 5000 + "b", "ab" * 9000, "lorem ipsum " * 20000]


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        import base64
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_equal_library():
    texts = odd_texts() + [chr(c) + " a" + chr(c) for c in range(0x20, 0x3000)]
    want = [len(e.ids) for e in Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)]
    assert merge_table(WORDS).count(texts) == want


def test_ids_equal_library(library):
    texts = odd_texts()
    assert [x.tolist() for x in coder(RANKS, P.PATTERN).encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_tables(spark, library):
    rows = [(i, t) for i, t in enumerate(odd_texts()[:60])] + [(900, None), (901, None), (None, "no id"), (5, "again"), (5, "again")]
    docs = documents(spark, rows).withColumn("n_tokens", F.lit("x")).withColumn("ids", F.lit(0)).withColumn("n_bytes", F.lit(0))
    lib = Tokenizer.from_file(WORDS)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in count_tokens(docs, WORDS).collect()), key=key)
    assert got == sorted(((i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in rows), key=key)
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digests(round_trip(docs, RANKS, P.PATTERN)).collect()), key=key)
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=key)


def test_empty(spark):
    empty = spark.createDataFrame([], DOCS)
    assert count_tokens(empty, WORDS).count() == 0
    assert round_trip(empty, RANKS, P.PATTERN).count() == 0

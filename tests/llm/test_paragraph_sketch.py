"""Fingerprints: order and edits by brute force, exact recovery by peeling."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import touchline.llm.paragraph_sketch as sketch
from llm_tables import DOCS, documents
from touchline.llm.paragraph_sketch import compare_with_next, differing, digests, edited, paragraphs


def alike(a, b):
    a, b = Counter(paragraphs(a)), Counter(paragraphs(b))
    either = sum((a | b).values())
    return sum((a & b).values()) / either if either else 1.0


def brute(rows):
    """rows have distinct non-null ids"""
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for n, (i, t) in enumerate(rows):
        a, b = t or "", rows[(n + 1) % len(rows)][1] or ""
        e = a[:len(a) - len(a) // 2] + b[:len(a) // 2]
        out[i] = (len(a), hashlib.sha256(e.encode()).hexdigest(), pytest.approx(alike(a, e)), pytest.approx(alike(a, b)))
    return out


def rows_of(n, seed=2):
    rnd = random.Random(seed)
    line = lambda: " ".join(rnd.choice("aé漢b") * rnd.randint(1, 5) for _ in range(rnd.randint(1, 12))) + rnd.choice([".", "\n", "! ", ""])
    rows = [(i * 3 - 50, " ".join(line() for _ in range(rnd.randint(0, 30)))) for i in range(n)]
    return rows + [(5000, None), (5001, ""), (5003, "Same line.\n" * 400), (5002, "Same line.\n" * 400),
                   (5004, "word " * 60_000), (2**62, "far"), (-2**63, "least")]


def check(spark, rows):
    docs = documents(spark, rows).withColumn("range", F.lit("x")).withColumn("head", F.lit(1)).withColumn("tie", F.lit(0))
    got = compare_with_next(docs).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) == want[r.doc_id]
    by = {r.doc_id: r for r in got}
    assert by[5002].fingerprint == by[5003].fingerprint != by[5004].fingerprint


def test_equals_brute_force(spark):
    check(spark, rows_of(150))


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(sketch, "RANGE_DOCS", 4)
    check(spark, rows_of(150, seed=4))


def test_peeling_recovers_what_differs():
    rnd = random.Random(1)
    for n, changed in ((5, 1), (40, 10), (300, 0), (300, 300), (2000, 700)):
        a = [f"line {i}." for i in range(n)]
        b = list(a)
        for i in rnd.sample(range(n), changed):
            b[i] = f"other {i}."
        va, vb = digests(["\n".join(a)]), digests(["\n".join(b)])
        pair, digest, sign = differing(va, vb, 1)
        assert set(digest[sign > 0].tolist()) == set(va[1].tolist()) - set(vb[1].tolist())
        assert set(digest[sign < 0].tolist()) == set(vb[1].tolist()) - set(va[1].tolist())
        assert len(digest) == 2 * changed


def test_repeated_paragraphs_count():
    a, b = digests(["x.\n" * 5, "y."]), digests(["x.\n" * 3, "y."])
    assert np.bincount(differing(a, b, 2)[0], minlength=2).tolist() == [2, 0]


def test_edge_tables(spark):
    assert compare_with_next(spark.createDataFrame([], DOCS)).count() == 0
    one = compare_with_next(documents(spark, [(4, "abcd")])).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(edited("abcd", "abcd").encode()).hexdigest()
    rows = [(1, "a. b."), (1, "a. b."), (1, "c."), (None, "n."), (None, None), (2, "d.")]
    got = compare_with_next(documents(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in rows)

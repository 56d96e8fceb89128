"""Mixing: brute force over plain Python, edge rows, and the mixed corpus itself."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from llm_tables import DOCS, documents
from touchline.llm.mixing import fill_targets, mix_documents, mix_plan

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """taken by (id, text, source), by sorting every source whole."""
    size = lambda t: len(WORDS.findall(t)) if t else 0
    key = lambda i, t: hashlib.md5(
        f"{i if i is not None else hashlib.md5((t or '').encode()).hexdigest()}|{size(t)}".encode()).hexdigest()
    by = defaultdict(list)
    for i, t, s in rows:
        by[s].append((key(i, t), size(t), i, t))
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(order)}
    sizes = {s: sum(x[1] for x in by[s]) for s in by}
    target, left, open_ = {}, float(sum(sizes.values())), set(by)
    while True:          # share, stop at the cap, share the rest again
        level = left / sum(weight[s] for s in open_) if open_ else 0
        capped = [s for s in open_ if level * weight[s] > 3 * sizes[s]]
        if not capped:
            break
        for s in capped:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            open_.discard(s)
    target.update({s: level * weight[s] for s in open_})
    out = Counter()
    for s in by:
        epochs = int(target[s]) // sizes[s] if sizes[s] else 0
        rest, before = int(target[s]) - epochs * sizes[s], 0
        groups = defaultdict(list)
        for k, n, i, t in by[s]:
            groups[k].append((n, i, t))
        for k in sorted(groups):
            m = len(groups[k])
            for n, i, t in groups[k]:
                out[i, t, s] += epochs * n + max(0, min(n, (rest - before) // m))
            before += sum(g[0] for g in groups[k])
    return out, target, sizes


def table(spark, rows):
    return documents(spark, [(i, t, "en", s) for i, t, s in rows])


def rows_of(n=300):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 17)), "hot" if i % 3 else f"s{i % 7}") for i in range(n)]
    return rows + [(1000, None, "hot"), (1001, "", None), (1002, "a\tb\x0bc d", None), (None, "x y", "s1"),
                   (None, None, "s1"), (7, "r r r", "dup"), (7, "r r r", "dup"), (7, "r r r", "dup"),
                   (1003, "long " * 30000, "s2")]


def test_plan_equals_brute_force(spark):
    rows = rows_of()
    want, target, sizes = brute(rows)
    got = mix_plan(table(spark, rows)).collect()
    assert len(got) == len(rows)
    total, taken = Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source], rel=1e-12)
        assert 0 <= r.taken <= 3 * r["size"]
        total[r.source] += r.taken
        taken[r.doc_id, r.source] += r.taken
    merged = Counter()
    for (i, _, s), n in want.items():
        merged[i, s] += n
    assert {k: v for k, v in taken.items() if v} == {k: v for k, v in merged.items() if v}
    for s in sizes:
        assert int(target[s]) - 3 < total[s] <= target[s] + 1e-9 or s == "dup"


def test_reruns_agree(spark):
    rows = rows_of(60)
    a, b = (sorted(map(tuple, mix_plan(table(spark, rows)).collect()), key=str) for _ in range(2))
    assert a == b


def test_mixed_corpus_has_the_words_taken(spark):
    rows = rows_of()
    docs = table(spark, rows).withColumn("size", F.lit("mine")).withColumn("taken", F.lit(1)).withColumn("key", F.lit(0))
    mixed = mix_documents(docs)
    assert mixed.columns == docs.columns
    got = Counter()
    for r in mixed.collect():
        got[r.doc_id, r.source] += len(WORDS.findall(r.text or ""))
    want = Counter()
    for (i, _, s), n in brute(rows)[0].items():
        want[i, s] += n
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_capped_sources_pass_on_their_excess(spark):
    s = spark.createDataFrame([("a", 10, 5.0), ("b", 100, 1.0), ("c", 1000, 1.0)], "source string, source_size long, weight double")
    got = {r.source: r.target for r in fill_targets(s).collect()}
    assert got == {"a": 30.0, "b": 300.0, "c": 780.0}


def test_given_weights(spark):
    docs = table(spark, [(i, "w w", "ab"[i % 2]) for i in range(40)])
    weights = spark.createDataFrame([("a", 1.0)], "source string, weight double")
    got = Counter()
    for r in mix_plan(docs, weights=weights).collect():
        got[r.source] += r.taken
    assert got == {"a": 40, "b": 0}          # of the words of the sources with a weight


def test_many_sources_take_the_salted_join(spark, monkeypatch):
    import touchline.llm.mixing as mixing
    rows = rows_of()
    usual = sorted(map(tuple, mix_plan(table(spark, rows)).collect()), key=str)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert sorted(map(tuple, mix_plan(table(spark, rows)).collect()), key=str) == usual


def test_empty(spark):
    empty = spark.createDataFrame([], DOCS)
    assert mix_plan(empty).count() == 0 and mix_documents(empty).count() == 0
    assert mix_plan(documents(spark, [(1, None), (2, "")])).count() == 2

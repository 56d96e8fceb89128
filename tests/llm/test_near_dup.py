"""Near-duplicates: exact brute force, hot groups, ProbMinHash's estimate."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from llm_tables import DOCS, documents
from touchline.llm import common, near_dup
from touchline.llm.near_dup import components, keep_one, near_duplicates, shingles, signatures


def sets_of(rows):
    """Weighted shingles of every text: 1 + ln count."""
    out = []
    for _, t in rows:
        w = re.findall(r"\w+", (t or "").lower()) or (t or "").split()
        counts = Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else {}
        out.append({k: 1 + math.log(c) for k, c in counts.items()})
    return out


def alike(a, b):
    """Probability Jaccard, by its definition."""
    every = list(a.keys() | b.keys())
    x, y = (np.array([s.get(k, 0.0) for k in every]) for s in (a, b))
    return sum(1 / np.maximum(x / p, y / q).sum() for p, q in zip(x, y) if p and q)


def brute(rows, threshold=0.8):
    sets, up = sets_of(rows), list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    seen = {}
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and find(i) != find(j) and sets[i].keys() & sets[j].keys():
            key = (rows[i][1], rows[j][1])
            if key not in seen:
                seen[key] = alike(sets[i], sets[j]) >= threshold - 1e-9
            if seen[key]:
                up[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, low.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed=5):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: [rnd.choice(words) for _ in range(n)]

    def edit(base, n):
        out = list(base)
        for _ in range(n):
            out[rnd.randrange(len(out))] = rnd.choice(words)
        return out
    rows = []
    for g in range(25):                                   # near copies with 0 to 8 edits of 120 words
        base = text(120)
        rows += [edit(base, rnd.randrange(9)) for _ in range(rnd.randrange(1, 5))]
    hot = text(150)
    rows += [edit(hot, rnd.randrange(1, 7)) for _ in range(120)]      # one large group of near copies
    rows += [hot] * 60                                                # and of exact ones
    passage = text(90)
    rows += [passage + text(60) for _ in range(40)]                   # a shared passage: alike, not duplicates
    rows += [["same"] * 300, ["same"] * 200, ["a", "b"], ["a", "b"], ["A", "b!"]]
    rows = [" ".join(r) for r in rows] + [None, "", "   ", "*** %%%", "*** %%%", "x" * 200_000, ("long " + " ".join(text(9)) + " ") * 4000]
    rnd.shuffle(rows)
    return [(i, r) for i, r in enumerate(rows)]


def test_classes_equal_brute_force(spark):
    rows = corpus() + [(None, "one two three four five six"), (None, "one two three four five six"), (3, corpus()[3][1])]
    docs = documents(spark, rows).withColumn("node", F.lit(1)).withColumn("class_id", F.lit("x")).withColumn("bands", F.lit(0))
    got = near_duplicates(docs).select("doc_id", "class_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_one_of_each_class_stays(spark):
    rows = corpus(6) + [(7, corpus(6)[7][1])]
    docs = documents(spark, rows).withColumn("_near_key", F.lit("mine"))
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids) == sorted({c for _, c in brute(rows)})


def test_links_follow_the_weighted_similarity(spark):
    # lines that repeat weigh more: equally repeated ones keep a copy near, unequally repeated ones part it
    rows = []
    for i in range(20):
        base, line, own = ([f"{kind}{i}x{j}" for j in range(n)] for kind, n in (("w", 204), ("r", 40), ("o", 20)))
        rows += [(4 * i, " ".join(base + line * 5)), (4 * i + 1, " ".join(base + line * 5 + own)),
                 (4 * i + 2, " ".join(base + line * 60)), (4 * i + 3, " ".join(base + own))]
    got = {r.doc_id: r.class_id for r in near_duplicates(documents(spark, rows)).collect()}
    assert got == dict(brute(rows)) and len(set(got.values())) < 80


def test_rows_of_one_id_or_none(spark):
    rnd = random.Random(3)
    one, two, three = (" ".join(rnd.choice("abcdefghijklmnop") * 3 + str(rnd.randrange(50)) for _ in range(60)) for _ in range(3))
    rows = [(7, one), (7, two), (None, three), (None, three + " end"), (None, three), (None, None), (9, None), (9, ""), (None, "")]
    kept = [(r.doc_id, r.text) for r in keep_one(documents(spark, rows)).collect()]
    assert (7, one) in kept and (7, two) in kept
    assert sum(t is not None and t.startswith(three) for _, t in kept) == 1
    assert {(None, None), (9, None), (9, ""), (None, "")} <= set(kept) and len(kept) == 7


def test_a_centre_in_parts_and_a_small_bitmap(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "HUB_PAIRS", 3)
    monkeypatch.setattr(near_dup, "WANTED_BITS", 7)
    monkeypatch.setattr(common, "ROWS_PER_FILE", 50)
    rows = corpus(8)
    assert sorted(map(tuple, near_duplicates(documents(spark, rows)).select("doc_id", "class_id").collect()), key=str) == brute(rows)


def test_probability_jaccard_equals_its_definition():
    rnd = random.Random(2)
    for _ in range(50):
        a, b = ({k: 1 + math.log(rnd.randrange(1, 6)) for k in rnd.sample(range(30), rnd.randrange(1, 30))} for _ in range(2))
        got = near_dup.probability_jaccard(*(np.array(z) for s in (a, b) for z in (list(s), list(s.values()))))
        assert abs(got - alike(a, b)) < 1e-12


def test_signature_agreement_is_probability_jaccard():
    rnd = np.random.default_rng(1)
    element = rnd.integers(1, 2**62, 60).astype(np.uint64)
    a, b = rnd.gamma(1.0, 2.0, 60) + 0.05, rnd.gamma(1.0, 2.0, 60) + 0.05
    owner = np.repeat([0, 1], 60)
    s = signatures(owner, np.tile(element, 2), np.concatenate([a, b]), 2, 4000)
    want = sum(1 / np.maximum(a / x, b / y).sum() for x, y in zip(a, b))
    assert abs((s[0] == s[1]).mean() - want) < 0.035


def test_shingles_count_repeats():
    owner, value, count, keys = shingles(["a b c d e a b c d e", None, "one"])
    assert owner.tolist() == [0] * 5 + [2] and sorted(count[:5].tolist()) == [1, 1, 1, 1, 2]
    assert keys[1] is None and keys[0] != keys[2]


def test_components_of_long_chains(spark):
    edges = [(f"{i:04}", f"{i + 1:04}") for i in range(200) if i % 50 != 49]
    got = dict(components(spark.createDataFrame(edges, "a string, b string")).collect())
    assert all(label == f"{int(n) // 50 * 50:04}" for n, label in got.items()) and len(got) == 200


def test_empty(spark):
    empty = spark.createDataFrame([], DOCS)
    assert near_duplicates(empty).count() == 0 and keep_one(empty).count() == 0


def test_a_comparison_takes_only_its_own_sets(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "HUB_PAIRS", 3)          # node 0 is dealt in parts
    name = lambda i: i.to_bytes(16, "big")
    sets = spark.createDataFrame([(name(i), [i // 2, 100_000], None) for i in range(3000)], "node binary, shingles array<long>, counts array<int>")
    pairs = spark.createDataFrame([(name(0), name(1)), (name(8), name(9)), (name(8), name(11)), *[(name(0), name(i)) for i in range(20, 30)]], "a binary, b binary")
    kept = {bytes(r.node) for r in near_dup._sets_of(sets, pairs.select(F.col("a").alias("node"))).collect()}
    assert {name(0), name(8)} <= kept and len(kept) < 30   # not all 3000 of them are shuffled
    links = near_dup._verified(pairs, sets, 0.8).collect()
    assert sorted((bytes(r.a), bytes(r.b)) for r in links) == [(name(0), name(1)), (name(8), name(9))]


def test_bands_are_shuffled_once(spark):
    prints = spark.createDataFrame([(b"a", [1, 2]), (b"b", [1, 3]), (b"a", [1, 2]), (b"c", [4, 2]), (None, None), (b"d", [5, 6]), (b"d", [5, 6])],
                                   "node binary, bands array<long>")
    members = near_dup._members(prints)
    assert sorted((bytes(r.node), r.band) for r in members.collect()) == [(b"a", 1), (b"a", 2), (b"b", 1), (b"c", 2)]
    plan = members._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "Join" not in plan

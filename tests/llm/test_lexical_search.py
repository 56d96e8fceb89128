"""Lexical search against scores of every document for every item."""
import math
import re

import pytest

from touchline.llm import lexical_search
from touchline.llm.lexical_search import bags, classes_of, search, terms_of
from llm_tables import documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain(docs, items, k):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    bag = [(i, TERM.findall(lower(t))) for i, t in docs]
    n_docs, total = sum(bool(b) for _, b in bag), sum(len(b) for _, b in bag)
    out = []
    for item, text in set(items):
        scores = []
        for i, b in bag:
            s = 0
            for t in TERM.findall(lower(text)):
                df = sum(t in x for _, x in bag)
                if t in b:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                    m, tf = 75 + (25 * len(b) * n_docs) // total, b.count(t)
                    s += w * ((1000000000 * tf) // (1000 * tf + 12 * m))
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, n + 1, i, -s) for n, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def ask(spark, docs, items, k, **options):
    table = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in search(documents(spark, docs), table, k, **options).collect()), key=repr)


ITEMS = [(1, "The red fox, the fox!"), (2, "Éa éa ñ 42"), (3, None), (4, ""), (5, "nothing-known"), (6, "fox " * 7 + "dog"),
         (1, "The red fox, the fox!"), (1, "dog"), (None, "red")]
DOCS = ([(i, f"the fox {'red ' * (i % 4)} x{i % 3}") for i in range(40)] + [(100 + i, "a dog and the fox") for i in range(30)]
        + [(200 - i, "A DOG, and THE fox!") for i in range(15)] + [(50, None), (51, ""), (52, " - "), (None, "red fox"), (None, "dog"),
           (3, "dog dog dog"), (3, "dog dog dog"), (60, "éa Éa ñ ñ 42 éa"), (2**60, "red dog"), (2**60 + 1, "red dog"),
           (61, "the " * 5000 + "fox")])


@pytest.mark.parametrize("k", [1, 5, 20])
def test_equals_brute_force(spark, k):
    assert ask(spark, DOCS, ITEMS, k, item_block=2, class_block=7) == plain(DOCS, ITEMS, k)


def test_a_vocabulary_too_large_to_send(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "VOCABULARY_BYTES", 0)
    assert ask(spark, DOCS, ITEMS, 5) == plain(DOCS, ITEMS, 5)


def test_copies_are_one_class_of_k_members(spark):
    vocabulary = spark.createDataFrame([("fox", 0), ("dog", 1), ("red", 2)], "term string, number int")
    docs = documents(spark, [(i, "the fox jumps") for i in range(500)] + [(600, "one fox jumps"), (601, "red fox jumps")])
    found = classes_of(bags(docs, vocabulary), 20).collect()
    assert sorted(len(r["members"]) for r in found) == [1, 20]
    assert max(found, key=lambda r: len(r["members"]))["members"] == list(range(20))


def test_empty_tables(spark):
    assert ask(spark, [], ITEMS, 5) == [] and ask(spark, DOCS, [], 5) == [] and ask(spark, [(1, None)], ITEMS, 5) == []


def test_only_ascii_capitals_are_lowered():
    assert terms_of("ABc É_éK1") == ["abc", "É", "éK1"] and terms_of(None) == []

"""Names resolved across sources: one to one, the rest in review."""

import itertools

from touchline.sources import names


def _grams(text):
    t = f"  {text} "
    return {t[i:i + 3] for i in range(len(t) - 2)}


def test_mutual_best_and_review(spark):
    known = spark.createDataFrame([(1, "Manchester United"), (2, "Manchester City"), (3, "Leeds United"), (4, None), (5, "")],
                                  "id long, name string")
    inc = ["Manchster United", "Manchester Cty", "LEEDS  UNITED!", "Leeds Unted", "Quixotic", None, "", "Manchster United"]
    incoming = spark.createDataFrame([(n,) for n in inc], "name string")
    resolved, review = names.resolve_names(incoming, known)
    got = {r["name"]: (r["id"], r["score"]) for r in resolved.collect()}
    assert {n: i for n, (i, _) in got.items()} == {"Manchster United": 1, "Manchester Cty": 2, "LEEDS  UNITED!": 3}
    assert got["LEEDS  UNITED!"][1] == 1.0 and got["Manchester Cty"][1] < 1
    rest = {r["name"]: r["best_id"] for r in review.collect()}
    assert rest == {"Leeds Unted": 3, "Quixotic": None, None: None, "": None}
    empty = names.resolve_names(incoming.limit(0), known)
    assert empty[0].isEmpty() and empty[1].isEmpty()
    none_known = names.resolve_names(incoming, known.limit(0))
    assert none_known[0].isEmpty() and none_known[1].count() == 7


def test_prefix_filter_loses_no_pair(spark):
    """Every name whose best trigram likeness reaches the bound has a candidate."""
    words = ["".join(p) for p in itertools.product("ab", "ca", "bd", "ab", "ac")]
    known = [(i, w + "x") for i, w in enumerate(words[::2])]
    resolved, review = names.resolve_names(spark.createDataFrame([(w,) for w in words], "name string"),
                                           spark.createDataFrame(known, "id long, name string"), alike=0.4)
    found = {r["name"] for r in resolved.collect()} | {r["name"] for r in review.collect() if r["best_id"] is not None}
    want = {w for w in words if any(len(_grams(w) & _grams(k)) / len(_grams(w) | _grams(k)) >= 0.4 for _, k in known)}
    assert found == want and want

"""W2 / W3 against the reference's correlated-subquery form, evaluated by
brute force in Python on the sf0.001 matches."""

from pyspark.sql import functions as F

from touchline.operators import features as ft


def _matches(small):
    rows = small.matches.filter(F.col("status") == "finished").select(
        "id", "match_date", "home_team_id", "away_team_id", "home_score", "away_score").collect()
    return [r.asDict() for r in rows]


def _newest(ms, pred, date, n):
    prior = [m for m in ms if pred(m) and m["match_date"] < date]
    prior.sort(key=lambda m: (m["match_date"], m["id"]), reverse=True)
    return prior[:n]


def test_team_form_brute_force(small):
    ms = _matches(small)
    got = {(r["match_id"], r["team_id"]): (r["form"], r["avg_goals_for"])
           for r in ft.team_form(small.matches, n=5).collect()}
    for m in ms[:400]:
        for team in (m["home_team_id"], m["away_team_id"]):
            prev = _newest(ms, lambda x: team in (x["home_team_id"], x["away_team_id"]), m["match_date"], 5)
            if not prev:
                want = (None, None)
            else:
                wins = [1 if ((x["home_team_id"] == team and x["home_score"] > x["away_score"])
                              or (x["away_team_id"] == team and x["away_score"] > x["home_score"])) else 0
                        for x in prev]
                gf = [x["home_score"] if x["home_team_id"] == team else x["away_score"] for x in prev]
                want = (sum(wins) / len(wins), sum(gf) / len(gf))
            g = got[(m["id"], team)]
            assert (g[0] is None) == (want[0] is None)
            if want[0] is not None:
                assert abs(g[0] - want[0]) < 1e-9 and abs(g[1] - want[1]) < 1e-9


def test_head_to_head_brute_force(small):
    ms = _matches(small)
    got = {r["match_id"]: r["h2h_home_advantage"] for r in ft.head_to_head(small.matches, n=10).collect()}
    for m in ms[:400]:
        pair = {m["home_team_id"], m["away_team_id"]}
        prev = _newest(ms, lambda x: {x["home_team_id"], x["away_team_id"]} == pair, m["match_date"], 10)
        vals = [1.0 if x["home_score"] > x["away_score"] else 0.5 if x["home_score"] == x["away_score"]
                else 0.0 for x in prev]
        want = sum(vals) / len(vals) if vals else None
        g = got[m["id"]]
        assert (g is None and want is None) or abs(g - want) < 1e-9

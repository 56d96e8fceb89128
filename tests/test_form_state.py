"""The merged newest results of teams and pairs equal those of the whole
match table after every batch, whatever a batch adds, moves or takes away."""

import datetime as dt
import random

from pyspark.sql import functions as F

from touchline.operators import features as ft
from touchline.streaming import changes, commits
from touchline.streaming import form_state as fs
from touchline.streaming import match_day as md

T0 = dt.datetime(2024, 1, 1)


def _match(rng, i, hour, status):
    home, away = rng.sample(range(1, 6), 2)
    day = rng.choice([rng.randint(0, 400), rng.randint(300, 400)])
    score = (None, None) if status == "scheduled" else (rng.randint(0, 3), rng.randint(0, 3))
    return (i, 1, day // 7, T0 + dt.timedelta(days=day), home, away, *score, status, T0 + dt.timedelta(hours=hour))


def _newest(matches, team_n, pair_n):
    """Plain-loop state: {key: newest results}."""
    keys = {}
    for m in matches.values():
        _, _, _, at, home, away, hs, as_, status, _ = m
        if status == "finished":
            keys.setdefault(("team", home, home), []).append((at, m[0], hs, float(hs > as_)))
            keys.setdefault(("team", away, away), []).append((at, m[0], as_, float(as_ > hs)))
            value = 1.0 if hs > as_ else 0.5 if hs == as_ else 0.0
            keys.setdefault(("pair", min(home, away), max(home, away)), []).append((at, m[0], None, value))
    return {k: sorted(v, key=lambda r: r[:2], reverse=True)[:team_n if k[0] == "team" else pair_n] for k, v in keys.items()}


def _got(spark, state):
    rows = fs.form_state(spark, state).collect()
    return {(r["kind"], r["a"], r["b"]): [tuple(x) for x in r["newest"]] for r in rows if r["newest"]}


def test_state_equals_the_whole_table(spark, tmp_dir):
    rng, table, state = random.Random(11), f"{tmp_dir}/matches", f"{tmp_dir}/form"
    known, again = {}, []
    real = fs._from_matches

    def counted(matches, team_n, pair_n, keys=None):
        if keys is not None:
            again.append(keys.count())
        return real(matches, team_n, pair_n, keys)

    fs._from_matches = counted
    try:
        for batch in range(5):
            ids = range(60) if batch == 0 else rng.sample(range(60 + 10 * batch), 12)
            status = ["finished"] * 6 + ["postponed", "scheduled"]
            rows = [_match(rng, i, 10 * batch, rng.choice(status)) for i in ids]
            if batch == 3:                                     # the newest matches of team 1 are taken away
                mine = [m for m in known.values() if m[8] == "finished" and 1 in m[4:6]]
                rows = [m[:8] + ("postponed", T0 + dt.timedelta(hours=30)) for m in sorted(mine, key=lambda m: m[3])[-4:]]
            known.update({m[0]: m for m in rows})
            md.commit_matches(spark, spark.createDataFrame(rows, md.MATCH_UPDATE), table)
            if batch == 2:
                md.compact_matches(spark, table)
                fs.compact_form(spark, state)
            fs.refresh_form(spark, table, state, team_n=3, pair_n=4)
            assert _got(spark, state) == _newest(known, 3, 4), batch
    finally:
        fs._from_matches = real
    assert len(again) == 4 and max(again) < 15                 # never all keys: 5 teams and 10 pairs
    # a refresh without its note is repeated; one without changes writes nothing
    live = commits.live_entries(spark, f"{state}/keys")
    fs.refresh_form(spark, table, state, team_n=3, pair_n=4)
    assert commits.live_entries(spark, f"{state}/keys") == live
    changes.note(spark, state, changes.taken(spark, state)[:1])
    fs.refresh_form(spark, table, state, team_n=3, pair_n=4)
    assert _got(spark, state) == _newest(known, 3, 4)
    # the features of fixtures are those of the full query
    current = md.current_matches(spark, table)
    fixtures = current.filter(F.col("status") == "scheduled")
    want = ft.fixture_features(current, focal_team_id=1, n=3, h2h_n=4).collect()
    assert len(want) > 3
    assert sorted(fs.fixture_features(spark, state, fixtures, focal_team_id=1).collect()) == sorted(want)

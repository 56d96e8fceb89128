"""The refreshed league table equals the full one after every batch, and a
refresh rewrites the touched season from the touched week on, no more."""

import datetime as dt
import os
import random

import pytest

from touchline.operators.league import league_table
from touchline.streaming import changes, commits
from touchline.streaming import league_state as ls
from touchline.streaming import match_day as md

T0 = dt.datetime(2024, 1, 1)


def _match(i, season, week, home, away, hs, as_, hour, status="finished"):
    when = T0 + dt.timedelta(days=7 * (week or 0) + i % 3)
    return (i, season, week, when, home, away, hs, as_, status, T0 + dt.timedelta(hours=hour))


def _commit(spark, table, rows):
    md.commit_matches(spark, spark.createDataFrame(rows, md.MATCH_UPDATE), table)


def _files(state):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{state}/table") for f in names if f.endswith(".parquet")}


def _rewritten(before, state):
    """(season, week) folders whose files are not those of before."""
    parts = [p.split(os.sep) for p in _files(state) - before]
    return {(int(p[-3].split("=")[1]), int(p[-2].split("=")[1])) for p in parts}


def _same(spark, table, state):
    want = league_table(md.current_matches(spark, table))
    got = ls.stored_league_table(spark, state).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def _season(rng, season, first, weeks, teams, hour=1):
    rows, i = [], first
    for week in range(1, weeks + 1):
        order = rng.sample(teams, len(teams))
        for home, away in zip(order[::2], order[1::2]):
            rows.append(_match(i, season, week, home, away, rng.randint(0, 3), rng.randint(0, 3), hour))
            i += 1
    return rows


def test_refresh(spark, tmp_dir, monkeypatch):
    rng, table, state = random.Random(3), f"{tmp_dir}/matches", f"{tmp_dir}/league"
    assert ls.refresh_league_table(spark, table, state) == []
    one, two = _season(rng, 1, 0, 8, [1, 2, 3, 4]), _season(rng, 2, 100, 6, [1, 2, 5, 6])
    _commit(spark, table, one + two)
    ls.refresh_league_table(spark, table, state)
    _same(spark, table, state)
    # a late correction: its season from its week on
    files = _files(state)
    _commit(spark, table, [_match(10, 1, 6, 1, 2, 9, 0, 2)])
    assert [tuple(r) for r in ls.refresh_league_table(spark, table, state)] == [(1, 6)]
    assert _rewritten(files, state) == {(1, 6), (1, 7), (1, 8)}
    _same(spark, table, state)
    # nothing new, a compaction, a version that changes no result: nothing is written
    files = _files(state)
    md.compact_matches(spark, table)
    _commit(spark, table, [_match(10, 1, 6, 1, 2, 9, 0, 3), _match(900, 1, 4, 1, 2, None, None, 3, "scheduled")])
    assert ls.refresh_league_table(spark, table, state) == [] and _files(state) == files
    # a refresh that stops before its note is made up for by the next one
    with monkeypatch.context() as m:
        m.setattr(changes, "note", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        _commit(spark, table, [_match(101, 2, 1, 5, 6, 7, 0, 4)])
        with pytest.raises(OSError):
            ls.refresh_league_table(spark, table, state)
    _commit(spark, table, [_match(105, 2, 3, 1, 6, 0, 7, 4)])
    assert [tuple(r) for r in ls.refresh_league_table(spark, table, state)] == [(2, 1)]
    _same(spark, table, state)
    # week 8 loses its matches: one is moved to week 5, one is no longer finished
    _commit(spark, table, [_match(14, 1, 5, 1, 2, 2, 2, 5), _match(15, 1, 8, 3, 4, None, None, 5, "postponed")])
    assert [tuple(r) for r in ls.refresh_league_table(spark, table, state)] == [(1, 5)]
    _same(spark, table, state)
    # a new team, a match without a week, a match that changes seasons: whole seasons
    for hour, row in ((6, _match(300, 1, 7, 9, 1, 1, 0, 6)), (7, _match(301, 2, None, 1, 2, 1, 0, 7)),
                      (8, _match(300, 2, 4, 5, 1, 1, 0, 8))):
        _commit(spark, table, [row])
        assert all(r["from_gameweek"] is None or hour == 8 for r in ls.refresh_league_table(spark, table, state))
        _same(spark, table, state)
    # the noted entries have been retired: built anew, a season that is gone included
    _commit(spark, table, [r[:8] + ("postponed", T0 + dt.timedelta(hours=9)) for r in two] +
            [_match(300, 1, 2, 1, 2, 1, 1, 9), _match(301, 1, 2, 1, 2, 1, 1, 9)])
    md.compact_matches(spark, table)
    commits.retire(spark, table, dt.timedelta(0))
    ls.refresh_league_table(spark, table, state)
    assert ls.stored_league_table(spark, state).filter("season_id = 2").isEmpty()
    _same(spark, table, state)

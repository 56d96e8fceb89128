"""The stored layout gives the same results as the on-the-fly mapping, and
season filters prune partitions of the denormalized fact tables."""

import re

import pytest

from tools.oracle_check import check, duck
from touchline.operators import players, tactics
from touchline.plans.catalog import ORACLES, QUERIES
from touchline.session import ensure_checkpoint_dir
from touchline.sources.fixture_map import sport_tables
from touchline.sources.layout import StoredTables, materialize

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def layout_dir(spark, tmp_path_factory):
    return materialize(sport_tables(spark, SF_SMALL), str(tmp_path_factory.mktemp("layout")))


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_layout_matches_oracle(spark, con, layout_dir, name):
    line, ok = check(spark, con, name, QUERIES[name], ORACLES[name], layout_dir)
    assert ok, line


def test_layout_by_url(spark, layout_dir):
    """A path with a scheme is the same layout."""
    for name in ("a6_top_performers", "a23_league_table"):
        a, b = QUERIES[name](spark, layout_dir), QUERIES[name](spark, f"file://{layout_dir}")
        assert a.count() > 0 and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_season_filter_prunes_partitions(spark, layout_dir):
    from pyspark.sql import functions as F
    t = StoredTables(spark, layout_dir)
    df = t.player_match_stats.filter(F.col("season_id") == 1997)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season_id" in plan and "1997" in plan


def test_team_filters_reach_the_scan(spark, layout_dir):
    """Season and team filters of an analysis are applied before the long-form
    explode: season prunes partitions, teams are pushed to the parquet scan."""
    from touchline.operators.performance import home_away_record
    t = StoredTables(spark, layout_dir)
    plan = home_away_record(t.matches, team_id=9, season_id=1997)._jdf.queryExecution() \
        .executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season_id" in plan
    assert "PushedFilters:" in plan and "home_team_id" in plan and "EqualTo(status,finished)" in plan


def _partition_filters(df):
    """{table: partition filters} of a plan's scans over the layout."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    out = {}
    for scan in re.findall(r"FileScan parquet .*", plan):
        table = re.search(r"/(\w+)\], PartitionFilters", scan)
        if table:
            out.setdefault(table[1], []).append(re.search(r"PartitionFilters: \[(.*?)\]", scan)[1])
    return out


def test_operators_prune_every_fact_by_season(spark, layout_dir):
    t = StoredTables(spark, layout_dir)
    frames = {
        "a17": tactics.shot_frame(t.shots, t.players, t.matches, t.teams, season_id=1997),
        "a18": tactics.shot_totals(tactics.season_shots(t.shots, t.matches, season_id=1997)),
        "a19": tactics.shot_zones(tactics.season_shots(t.shots, t.matches, season_id=1997)),
        "a12": tactics.formation_effectiveness(t.match_stats, t.matches, season_id=1997),
        "a14": tactics.possession_frame(t.match_stats, t.matches, season_id=1997),
        "a6": players.top_performers(t.players, t.player_match_stats, t.matches, season_id=1997),
        "a9": players.unsung_heroes(t.players, t.player_match_stats, t.matches, season_id=1997),
        "a11": players.player_form(t.players, t.player_match_stats, t.matches, season_id=1997),
    }
    for name, df in frames.items():
        found = {k: v for k, v in _partition_filters(df).items() if k in ("matches", "match_stats", "player_match_stats", "shots")}
        assert found and all("1997" in f for fs in found.values() for f in fs), (name, found)


def test_shot_totals_need_no_join(spark, layout_dir):
    t = StoredTables(spark, layout_dir)
    for df in (tactics.shot_totals(tactics.season_shots(t.shots, t.matches)), tactics.shot_zones(tactics.season_shots(t.shots, t.matches))):
        assert "Join" not in df._jdf.queryExecution().executedPlan().toString()


TRAINS_OR_STREAMS = ("m3", "m4", "m5", "m7", "m9", "m10", "m12", "m13", "m14", "m15", "s14", "t1", "t2")


@pytest.mark.parametrize("where", ["layout", "mapping"])
def test_no_cross_or_nested_loop_joins(spark, layout_dir, where):
    bad = []
    for name, q in QUERIES.items():
        if name.startswith(TRAINS_OR_STREAMS):
            continue
        df = q(spark, layout_dir if where == "layout" else SF_SMALL)
        plan = df._jdf.queryExecution().executedPlan().toString()
        if "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan:
            bad.append(name)
    assert bad == []


def test_players_grow_with_the_data(spark):
    n = {sf: sport_tables(spark, f"/root/testdata/{sf}").players.count() for sf in ("sf0.001", "sf0.01")}
    assert n["sf0.01"] > 5 * n["sf0.001"] > 500


def test_a_cluster_must_name_its_shared_folder():
    class Conf:
        def __init__(self, master):
            self.at = {"spark.master": master}

        def get(self, key, default=None):
            return self.at.get(key, default)

        def set(self, key, value):
            self.at[key] = value

    class Session:
        def __init__(self, master):
            self.conf = Conf(master)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", ""):
        with pytest.raises(RuntimeError):
            ensure_checkpoint_dir(Session(master))
    assert ensure_checkpoint_dir(Session("local[4]"))


def test_lines_dealt_by_match(spark, monkeypatch):
    """With more lines than the session's tasks should hold, a task gets so many; the mapped rows stay the same."""
    from touchline.sources import fixture_map
    plain = fixture_map.sport_tables(spark, SF_SMALL)
    rows = plain.raw("lineitem").count()
    monkeypatch.setattr(fixture_map, "LINES_PER_TASK", rows // 40)
    dealt = fixture_map.sport_tables(spark, SF_SMALL)
    assert dealt.raw("lineitem").rdd.getNumPartitions() >= 40
    for name in ("player_match_stats", "players", "shots"):
        a, b = getattr(plain, name), getattr(dealt, name)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_player_joins_and_orphans_take_tasks(spark, monkeypatch):
    """Dealt joins have their own number of tasks, whatever the session's shuffle partitions; results stay the same."""
    from touchline.operators import quality
    from touchline.sources import fixture_map
    plain = fixture_map.sport_tables(spark, SF_SMALL)
    assert plain.tasks() is None
    monkeypatch.setattr(fixture_map, "LINES_PER_TASK", plain.raw("lineitem").count() // 40)
    t = fixture_map.sport_tables(spark, SF_SMALL)
    assert t.tasks() >= 40
    for name in ("unsung_heroes", "top_performers", "top_performers_view", "player_form"):
        f = getattr(players, name)
        a, b = f(plain.players, plain.player_match_stats, plain.matches), f(t.players, t.player_match_stats, t.matches, tasks=t.tasks())
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
        plan = b._jdf.queryExecution().executedPlan().toString()
        assert re.search(rf"hashpartitioning\(player_id#\d+L?, {t.tasks()}\), REPARTITION_BY_NUM", plan)
    names = ("teams", "seasons", "matches", "match_stats", "players", "player_match_stats", "shots", "opposition_categories")
    got = quality.orphan_checks({n: getattr(t, n) for n in names}, tasks=t.tasks())
    assert sorted(got.collect()) == sorted(quality.orphan_checks({n: getattr(plain, n) for n in names}).collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert f", {t.tasks()}), REPARTITION_BY_NUM" in plan and not re.search(r"hashpartitioning\([^)]*(table|column)_name#", plan)


def test_orphans_of_every_kind(spark):
    """Missing, null and repeated keys; a key missing in one parent and present in another; a child without rows."""
    from touchline.operators import quality
    teams = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "id long, name string")
    seasons = spark.createDataFrame([(7, "s")], "id long, season_name string")
    found = spark.createDataFrame([(1, 7), (7, 7), (7, 1), (None, None), (2, 7)], "team_id long, season_id long")
    squad = spark.createDataFrame([], "id long, team_id long")
    for tasks in (None, 5):
        got = quality.orphan_checks({"teams": teams, "seasons": seasons, "opposition_categories": found, "players": squad}, tasks=tasks)
        assert sorted(map(tuple, got.collect())) == [("opposition_categories", "fk_seasons", "season_id", 1), ("opposition_categories", "fk_teams", "team_id", 3),
                                                     ("players", "fk_teams", "team_id", 0)]

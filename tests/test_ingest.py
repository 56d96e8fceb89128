"""JSON ingest (S3-S6), collection log (S8), loaders (S9-S11), schemas."""

import json
import os

from pyspark.sql import functions as F

from touchline.sources import ingest, schemas
from touchline.sources.html import html_elements


def _write(path, obj):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        json.dump(obj, f)


BOOT = {
    "teams": [{"id": 1, "name": "Arsenal", "short_name": "ARS"},
              {"id": 2, "name": "Newcomers", "short_name": "NEW"}],
    "elements": [
        {"id": 10, "first_name": "Ann", "second_name": "Lee", "team": 1, "element_type": 2, "code": 1234,
         "status": "a"},
        {"id": 11, "first_name": "Bo", "second_name": "Ray", "team": 2, "element_type": 9, "code": None,
         "status": "u"},
    ],
}


def test_bootstrap_and_loaders(spark, tmp_dir):
    _write(f"{tmp_dir}/boot/bootstrap.json", BOOT)
    teams_doc, elements = ingest.read_bootstrap(spark, f"{tmp_dir}/boot")
    existing = spark.createDataFrame([(5, "Arsenal", "ARS")], "id long, name string, short_name string")
    new = ingest.load_teams(teams_doc, existing)
    assert [(r["id"], r["name"]) for r in new.collect()] == [(6, "Newcomers")]
    all_teams = existing.unionByName(new.select("id", "name", "short_name"))
    # re-running against the updated table adds nothing
    assert ingest.load_teams(teams_doc, all_teams).count() == 0

    players0 = spark.createDataFrame([], "id long, name string, team_id long")
    p = ingest.load_players(elements, teams_doc, all_teams, players0)
    got = sorted((r["name"], r["position"], r["squad_number"], r["team_id"], r["is_active"])
                 for r in p.collect())
    assert got == [("Ann Lee", "DEF", 34, 5, True), ("Bo Ray", "UNK", 0, 6, False)]
    again = ingest.load_players(elements, teams_doc, all_teams, p.select("id", "name", "team_id"))
    assert again.count() == 0   # D2: natural key (name, team_id)


def test_fixtures_loader_idempotent(spark, tmp_dir):
    fixtures = [
        {"id": 1, "event": 3, "kickoff_time": "2025-08-30T14:00:00Z", "team_h": 1, "team_a": 2,
         "team_h_score": 2, "team_a_score": 1, "started": True, "finished": True},
        {"id": 2, "event": 4, "kickoff_time": "2025-09-06T14:00:00Z", "team_h": 2, "team_a": 1,
         "team_h_score": None, "team_a_score": None, "started": False, "finished": False},
    ]
    _write(f"{tmp_dir}/fx/fixtures.json", fixtures)
    fx = ingest.read_fixtures(spark, f"{tmp_dir}/fx")
    src = spark.createDataFrame([(1, "A"), (2, "B")], "id long, name string")
    local = spark.createDataFrame([(7, "A"), (8, "B")], "id long, name string")
    empty = spark.createDataFrame([], schemas.MATCHES).select(
        "id", "season_id", "home_team_id", "away_team_id", "match_date")
    new = ingest.load_fixtures(fx, src, local, empty)
    rows = new.collect()
    assert len(rows) == 1 and rows[0]["home_team_id"] == 7 and rows[0]["status"] == "finished"
    assert rows[0]["season_id"] == 2025 and rows[0]["id"] == 1
    assert ingest.load_fixtures(fx, src, local, new).count() == 0


def test_live_and_competition_documents(spark, tmp_dir):
    _write(f"{tmp_dir}/live/event/7/live.json", {"elements": [{"id": 1, "stats": {"minutes": 90.0}},
                                                              {"id": 2, "stats": {}}]})
    live = ingest.read_gameweek_live(spark, f"{tmp_dir}/live/event/*/live.json")
    assert sorted((r["gameweek"], r["id"]) for r in live.collect()) == [(7, 1), (7, 2)]
    comp = {"matches": [{"id": 9, "utcDate": "2025-08-16T11:30:00Z", "status": "FINISHED", "matchday": 1,
                         "homeTeam": {"id": 66, "name": "H"}, "awayTeam": {"id": 57, "name": "A"},
                         "score": {"fullTime": {"home": 1, "away": 0}}}]}
    _write(f"{tmp_dir}/comp/m.json", comp)
    m = ingest.read_competition_matches(spark, f"{tmp_dir}/comp").first()
    assert m["home_score"] == 1 and m["gameweek"] == 1 and str(m["match_date"]) == "2025-08-16 11:30:00"


def test_collection_log_append(spark, tmp_dir):
    path = f"{tmp_dir}/log"
    ingest.log_collection(spark, path, "fpl_api", "bootstrap", 600, True, None, 1.25)
    ingest.log_collection(spark, path, "fpl_api", "fixtures", 0, False, "boom", 0.5)
    log = spark.read.parquet(path)
    assert log.count() == 2
    assert log.filter(~F.col("success")).first()["error_message"] == "boom"


def test_schema_conform_and_defaults(spark, small):
    m = schemas.conform(small.matches, "matches")
    assert m.columns == [f.name for f in schemas.MATCHES.fields]
    d = schemas.apply_defaults(spark.createDataFrame([(None,)], "status string"), "matches")
    assert d.first()["status"] == "scheduled"
    seeds = schemas.seed_frames(spark)
    assert seeds["teams"].first()["short_name"] == "MUN"


def test_html_elements_whole_pages(spark, small):
    pages = small.raw("pages")
    li = html_elements(pages, "li")
    assert li.count() == 281     # every <li> of every page
    assert li.filter(F.col("text").contains("<")).count() == 0


def test_export_records(spark, small, tmp_dir):
    from touchline.operators.performance import home_away_record
    df = home_away_record(small.matches)
    ingest.export_records(df, f"{tmp_dir}/export", partition_by=["season_id"])
    back = spark.read.json(f"{tmp_dir}/export")
    assert back.count() == df.count()


def test_broken_documents_are_quarantined(spark, tmp_dir):
    import os
    docs = {"good": '[{"id": 1, "event": 2}, {"id": 3, "event": 4}]', "cut": '[{"id": 5, "event": 6}, {"id": 7, "ev', "odd": '[{"id": "x1", "event": 2}]'}
    os.makedirs(f"{tmp_dir}/fx")
    for name, text in docs.items():
        with open(f"{tmp_dir}/fx/{name}.json", "w") as f:
            f.write(text)
    good, bad = ingest.split_documents(spark, ingest.FIXTURE, f"{tmp_dir}/fx")
    account = {r.file.rsplit("/", 1)[1]: (r.good, r.quarantined)
               for r in ingest.quarantine(spark, ingest.FIXTURE, f"{tmp_dir}/fx", f"{tmp_dir}/bad").collect()}
    assert account["good.json"] == (2, 0) and set(account) == {"good.json", "cut.json", "odd.json"}
    assert account["cut.json"][1] >= 1 and account["odd.json"] == (0, 1)
    assert good.count() == sum(g for g, _ in account.values())
    held = spark.read.parquet(f"{tmp_dir}/bad")
    assert held.count() == bad.count() == sum(b for _, b in account.values())


def test_documents_share_files(spark, tmp_path):
    """Landed documents come back row for row, in far fewer files than documents."""
    from touchline.plans import queries_sources as qs
    from touchline.sources import ingest
    live = spark.range(3 * 200).selectExpr("id % 3 + 1 AS gameweek", "id DIV 3 AS part",
                                           "concat('{\"elements\":[{\"id\":', id, ',\"stats\":{\"minutes\":90}}]}') AS value")
    path = qs._land(spark, live, ["gameweek", "part"], "test-live")
    back = ingest.read_gameweek_live(spark, path).selectExpr("gameweek", "id", "stats['minutes'] AS minutes").collect()
    assert sorted(back) == sorted((i % 3 + 1, i, 90.0) for i in range(600))
    assert spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).count() <= 3 * 4
    fixtures = spark.range(300).selectExpr("id AS part", "concat('[{\"id\":', id, ',\"event\":7}]') AS value")
    path = qs._land(spark, fixtures, ["part"], "test-fixtures", arrays=True)
    assert sorted(r.id for r in ingest.read_fixtures(spark, path).filter("event = 7").collect()) == list(range(300))

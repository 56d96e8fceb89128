"""Lookback features for the match and player models.

W1  player rolling means over the previous N appearances (current excluded)
W2  team form and mean goals over the previous N finished matches with a
    strictly earlier date, across all seasons
W3  head-to-head mean over the previous N meetings of the same pair
M1  match feature table (W2 + W3 + derived columns) for one season
M8  features for fixtures: newest-N form, goals and head-to-head
M11 player feature table (W1 + opposition strength + venue + minutes)

The reference computes these with correlated ``ORDER BY ... LIMIT``
subqueries or a self-join; here each is one pass of the chunked
prefix-sum operators in ``sequence`` (no window partition per team or per
player, no pairwise expansion).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import expressions as X
from touchline.operators.longform import of_season, team_matches
from touchline.operators.sequence import last_n, lookback_before, lookback_mean, time_chunk

MATCH_FEATURES = (
    "home_form", "away_form", "home_avg_goals_for", "away_avg_goals_for",
    "h2h_home_advantage", "goal_difference_tendency", "form_difference", "is_focal_team",
)
PLAYER_FEATURES = (
    "recent_avg_goals", "recent_avg_assists", "recent_avg_rating",
    "opposition_strength", "is_home", "minutes_played",
)


def _win(gf="goals_for", ga="goals_against"):
    return F.when(F.col(gf) > F.col(ga), F.lit(1)).otherwise(F.lit(0))


def _h2h_value():
    """1 / 0.5 / 0 for a home win / draw / anything else, seen from whoever
    was at home in that (older) match."""
    hs, as_ = F.col("home_score"), F.col("away_score")
    return F.when(hs > as_, F.lit(1.0)).when(hs == as_, F.lit(0.5)).otherwise(F.lit(0.0))


def _pair_keys(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "pair_lo": F.least("home_team_id", "away_team_id"),
        "pair_hi": F.greatest("home_team_id", "away_team_id"),
    })


def team_form(matches: DataFrame, *, n: int = 5) -> DataFrame:
    """Per finished (match, team) the win share and mean goals for over
    the team's previous ``n`` finished matches with a strictly earlier
    date (all seasons); NULL when there are none."""
    lf = team_matches(matches).select(
        "match_id", "season_id", "match_date", "team_id", "is_home", "goals_for", "goals_against")
    return lookback_before(
        lf, ["team_id"], "match_date", ["match_date", "match_id"], chunk=time_chunk(),
        values={"form": _win(), "avg_goals_for": F.col("goals_for")}, n=n,
    ).drop("goals_for", "goals_against")


def head_to_head(matches: DataFrame, *, n: int = 10) -> DataFrame:
    """Per finished match, the mean 1/0.5/0 value over the previous
    ``n`` finished meetings of the same two teams (either venue), strictly
    earlier date."""
    m = _pair_keys(matches.filter(F.col("status") == "finished")).select(
        F.col("id").alias("match_id"), "season_id", "match_date", "home_team_id", "away_team_id",
        "pair_lo", "pair_hi", "home_score", "away_score")
    out = lookback_before(
        m, ["pair_lo", "pair_hi"], "match_date", ["match_date", "match_id"], chunk=time_chunk(),
        values={"h2h_home_advantage": _h2h_value()}, n=n,
    )
    return out.drop("pair_lo", "pair_hi")


def match_features(matches: DataFrame, *, season_id=None, focal_team_id=None, n: int = 5,
                   h2h_n: int = 10, fill: float = 0.5) -> DataFrame:
    """M1: one row per finished match of ``season_id`` (all seasons when
    None) whose two teams both have a form value.  Lookbacks see every
    season; the season filter is applied after them."""
    form = team_form(matches, n=n)
    if season_id is not None:
        form = form.filter(F.col("season_id") == season_id)
    # Both sides of a match in one aggregate keyed by match_id (no double join).
    sides = form.groupBy("match_id").agg(
        F.max(F.when(F.col("is_home"), F.col("form"))).alias("home_form"),
        F.max(F.when(~F.col("is_home"), F.col("form"))).alias("away_form"),
        F.max(F.when(F.col("is_home"), F.col("avg_goals_for"))).alias("home_avg_goals_for"),
        F.max(F.when(~F.col("is_home"), F.col("avg_goals_for"))).alias("away_avg_goals_for"),
    ).filter(F.col("home_form").isNotNull() & F.col("away_form").isNotNull())
    h2h = head_to_head(matches, n=h2h_n).select("match_id", "h2h_home_advantage")
    m = matches.filter(F.col("status") == "finished")
    if season_id is not None:
        m = m.filter(F.col("season_id") == season_id)
    base = m.select(F.col("id").alias("match_id"), "season_id", "match_date", "home_team_id",
                    "away_team_id", "home_score", "away_score")
    j = base.join(sides, "match_id").join(h2h, "match_id", "left")
    focal = (F.col("home_team_id") == focal_team_id) | (F.col("away_team_id") == focal_team_id) \
        if focal_team_id is not None else F.lit(False)
    j = j.withColumns({
        "goal_difference_tendency": F.col("home_avg_goals_for") - F.col("away_avg_goals_for"),
        "form_difference": F.col("home_form") - F.col("away_form"),
        "is_focal_team": focal.cast("int"),
        "outcome": X.match_outcome(),
    })
    # The neutral fill goes to the feature columns only.
    return j.fillna(fill, subset=[c for c in MATCH_FEATURES if c != "is_focal_team"])


def fixture_features(matches: DataFrame, fixtures: DataFrame | None = None, *, focal_team_id=None,
                     n: int = 5, h2h_n: int = 10) -> DataFrame:
    """M8: features for fixtures (default: every scheduled match) from each
    team's newest ``n`` finished matches and the pair's newest ``h2h_n``
    finished meetings, with the reference's falsy defaults (P23)."""
    lf = team_matches(matches)
    recent = last_n(lf, ["team_id"], ["match_date", "match_id"], chunk=time_chunk(), n=n)
    team_now = recent.groupBy("team_id").agg(
        F.avg(_win()).alias("form"), F.avg("goals_for").alias("avg_goals_for"))
    meetings = _pair_keys(matches.filter(F.col("status") == "finished"))
    meetings = meetings.select(F.col("id").alias("match_id"), "match_date", "pair_lo", "pair_hi",
                               "home_score", "away_score")
    pair_now = last_n(meetings, ["pair_lo", "pair_hi"], ["match_date", "match_id"],
                      chunk=time_chunk(), n=h2h_n).groupBy("pair_lo", "pair_hi").agg(
        F.avg(_h2h_value()).alias("h2h"))
    if fixtures is None:
        fixtures = matches.filter(F.col("status") == "scheduled")
    return fixture_rows(fixtures, team_now, pair_now, focal_team_id=focal_team_id)


def fixture_rows(fixtures: DataFrame, team_now: DataFrame, pair_now: DataFrame, *, focal_team_id=None) -> DataFrame:
    """M8 from the teams' (team_id, form, avg_goals_for) and the pairs'
    (pair_lo, pair_hi, h2h) newest means."""
    fx = _pair_keys(fixtures.select(F.col("id").alias("match_id"), "season_id", "match_date",
                                    "home_team_id", "away_team_id"))
    home = team_now.select(F.col("team_id").alias("home_team_id"), F.col("form").alias("_hf"),
                           F.col("avg_goals_for").alias("_hg"))
    away = team_now.select(F.col("team_id").alias("away_team_id"), F.col("form").alias("_af"),
                           F.col("avg_goals_for").alias("_ag"))
    j = fx.join(home, "home_team_id", "left").join(away, "away_team_id", "left") \
        .join(pair_now, ["pair_lo", "pair_hi"], "left")
    j = j.withColumns({
        "home_form": X.falsy_default("_hf", 0.5),
        "away_form": X.falsy_default("_af", 0.5),
        "home_avg_goals_for": X.falsy_default("_hg", 1.0),
        "away_avg_goals_for": X.falsy_default("_ag", 1.0),
        "h2h_home_advantage": X.falsy_default("h2h", 0.5),
    })
    focal = (F.col("home_team_id") == focal_team_id) | (F.col("away_team_id") == focal_team_id) \
        if focal_team_id is not None else F.lit(True)
    j = j.withColumns({
        "goal_difference_tendency": F.col("home_avg_goals_for") - F.col("away_avg_goals_for"),
        "form_difference": F.col("home_form") - F.col("away_form"),
        "is_focal_team": focal.cast("int"),
    })
    return j.select("match_id", "season_id", "match_date", "home_team_id", "away_team_id",
                    *MATCH_FEATURES)


def player_features(stats: DataFrame, matches: DataFrame, categories: DataFrame, *,
                    n: int = 10, fill: float = 0.0, kept=None) -> DataFrame:
    """Per appearance (minutes > 0, finished match) the player's
    rolling means over the previous ``n`` appearances (W1), the opponent's
    strength ordinal in the same season (J4 + P12), venue and minutes.

    The lookback reads its rows three times.  ``kept``, if given, is handed
    these rows and returns them in a form that is cheap to read again."""
    finished = matches.filter(F.col("status") == "finished")
    rows = of_season(stats.filter(F.col("minutes_played") > 0), finished, None,
                     ("match_date", "home_team_id", "away_team_id"))
    rows = rows.withColumns({
        "is_home": (F.col("home_team_id") == F.col("team_id")).cast("int"),
        "opponent_id": F.when(F.col("home_team_id") == F.col("team_id"), F.col("away_team_id"))
        .otherwise(F.col("home_team_id")),
    })
    cats = categories.select(F.col("team_id").alias("opponent_id"), "season_id", "final_position")
    rows = rows.join(cats, ["opponent_id", "season_id"], "left") \
        .withColumn("opposition_strength", X.strength_ordinal("final_position"))
    rows = rows.select("player_id", "match_id", "season_id", "match_date", "team_id", "opponent_id",
                       "goals", "assists", "rating", "opposition_strength", "is_home", "minutes_played")
    if kept is not None:
        rows = kept(rows)
    # Ratings carry one decimal: summed as integer tenths, so prefix-sum
    # differences stay exact however long a player's history is.
    out = lookback_mean(
        rows, ["player_id"], ["match_date", "match_id"], chunk=time_chunk(),
        values={"recent_avg_goals": F.col("goals"), "recent_avg_assists": F.col("assists"),
                "recent_avg_rating": X.scaled_units("rating", 1)},
        n=n,
    ).withColumn("recent_avg_rating", F.col("recent_avg_rating") / 10)
    return out.fillna(fill, subset=["recent_avg_goals", "recent_avg_assists", "recent_avg_rating"])

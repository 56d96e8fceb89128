"""Names of one source resolved against known names (J11 across sources).

Names are compared as sets of trigrams of their plain form.  Two names whose
trigram sets are at least ``alike`` alike (Jaccard) share one of their
rarest trigrams, so only these are joined (a prefix filter: nothing that is
alike enough is lost, and a trigram that most names hold blocks few or
none).  Candidates are scored by the larger of trigram and edit similarity;
a pair is accepted when each is the other's best, so the result is one to
one, and everything else goes to a review table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.sources import ingest


def plain(name: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " "))


def _trigrams(text: Column) -> Column:
    padded = F.concat(F.lit("  "), text, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, 3)))


def _blocked(names: DataFrame, rank: DataFrame, alike: float) -> DataFrame:
    """names(text, grams) -> text, grams, gram: its rarest trigrams, as many
    as a name at least ``alike`` alike must share one of."""
    g = names.select("text", F.explode("grams").alias("gram")).join(rank, "gram")
    keep = F.size("order") - F.ceil(F.size("order") * alike - 1e-9).cast("int") + 1
    first = g.groupBy("text").agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("order")) \
        .select("text", F.explode(F.slice("order", F.lit(1), keep)).alias("o")).select("text", F.col("o.gram").alias("gram"))
    return first.join(names, "text")


def resolve_names(incoming: DataFrame, known: DataFrame, *, alike: float = 0.3,
                  accept: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """(resolved: name, id, score; review: name, best_id, best_score).

    ``incoming`` has ``name``, ``known`` has ``id`` and ``name``.  Names equal
    in plain form score 1.  Every distinct incoming name is in exactly one of
    the two tables; a null or empty one is in review without a candidate.
    Ties go to the smaller id, then to the smaller name."""
    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("text", plain(F.col("name"))).filter(F.length("text") > 0)

    inc, old = keyed(incoming.select("name").distinct()), keyed(known.select("id", "name"))
    left, right = (d.select("text").distinct().withColumn("grams", _trigrams(F.col("text"))) for d in (inc, old))
    rank = left.unionByName(right).select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    a = _blocked(left, rank, alike).withColumnsRenamed({"text": "a", "grams": "ga"})
    b = _blocked(right, rank, alike).withColumnsRenamed({"text": "b", "grams": "gb"})
    pairs = a.join(b, "gram").groupBy("a", "b").agg(F.first("ga").alias("ga"), F.first("gb").alias("gb"))
    both = F.size(F.array_intersect("ga", "gb"))
    jaccard = both / (F.size("ga") + F.size("gb") - both)
    edit = 1 - F.levenshtein("a", "b") / F.greatest(F.length("a"), F.length("b"))
    scored = pairs.filter(jaccard >= alike).select("a", "b", F.round(F.greatest(jaccard, edit), 6).alias("score")) \
        .join(inc.withColumnsRenamed({"text": "a"}), "a").join(old.select("id", F.col("text").alias("b")), "b")
    best = scored.groupBy("name").agg(F.max_by(F.struct("id", "score"), F.struct("score", -F.col("id"))).alias("v")) \
        .select("name", "v.id", "v.score")
    # the best name of an id: highest score, an equal one by the smaller name
    top = scored.groupBy("id").agg(F.min_by("name", F.struct(-F.col("score"), "name")).alias("name"))
    resolved = best.filter(F.col("score") >= accept).join(top, ["id", "name"], "left_semi").select("name", "id", "score")
    names = incoming.select("name").distinct()
    rest = names.join(resolved.select("name"), "name", "left_anti")
    review = rest.join(best.withColumnsRenamed({"id": "best_id", "score": "best_score"}), "name", "left")
    return resolved, review


def load_competition_matches(documents: DataFrame, teams: DataFrame, existing: DataFrame, season_of: Column,
                             **rules) -> tuple[DataFrame, DataFrame]:
    """Competition matches (``ingest.read_competition_matches``) as rows to
    append to the match table, team names resolved against ``teams``.

    Returns (rows, review).  Matches of a name in review are not loaded;
    they are when the name is resolved and the load is run again.  Matches
    present by (season, home, away, date) are left out."""
    names = documents.select(F.col("home_name").alias("name")).unionByName(documents.select(F.col("away_name").alias("name")))
    resolved, review = resolve_names(names, teams, **rules)
    side = lambda s: resolved.select(F.col("name").alias(f"{s}_name"), F.col("id").alias(f"{s}_team_id"))
    nk = ["season_id", "home_team_id", "away_team_id", "match_date"]
    m = documents.join(side("home"), "home_name").join(side("away"), "away_name").withColumn("season_id", season_of.cast("bigint"))
    m = m.groupBy(*nk).agg(F.min_by(F.struct("gameweek", "home_score", "away_score", F.lower("status").alias("status")), "id").alias("v")) \
        .select(*nk, "v.*").join(existing.select(*nk), nk, "left_anti")
    rows = ingest.number_after(existing, m, ["match_date", "home_team_id", "away_team_id"], F.to_date("match_date"))
    return rows.select("id", "season_id", "gameweek", "match_date", "home_team_id", "away_team_id",
                       "home_score", "away_score", "status"), review

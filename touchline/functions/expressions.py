"""Column expressions shared by the analyses.

All of these are plain Catalyst expressions (no Python UDFs), so they stay
inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must match the reference's outputs.
RESULT_LETTERS = ("W", "D", "L")
RESULT_WORDS = ("Win", "Draw", "Loss")
MATCH_OUTCOMES = ("Home Win", "Draw", "Away Win")
VENUES = ("Home", "Away")
POSITION_CODES = {1: "GK", 2: "DEF", 3: "MID", 4: "FWD"}
POSITIONS = ("GK", "DEF", "MID", "FWD")
MATCH_STATUSES = ("scheduled", "live", "finished", "postponed")
SHOT_ZONES = (
    "Six Yard Box",
    "Wide Close",
    "Central Penalty Area",
    "Wide Penalty Area",
    "Outside Box",
    "Long Range",
    "Unknown",
)
OPPOSITION_BUCKETS = ("Top 6", "Mid Table", "Bottom 6")
STRENGTH_LABELS = {"Strong": 2, "Medium": 1, "Weak": 0}
TOP6_NAMES = (
    "Manchester City",
    "Arsenal",
    "Liverpool",
    "Chelsea",
    "Tottenham Hotspur",
    "Newcastle United",
)
CATEGORY_LABELS = ("top_6", "mid_table", "relegation_battle")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def venue(is_home="is_home") -> Column:
    """P5: 'Home' / 'Away' from a boolean home flag."""
    return F.when(col(is_home), F.lit("Home")).otherwise(F.lit("Away"))


def team_result(gf="goals_for", ga="goals_against", labels=RESULT_LETTERS) -> Column:
    """Outcome seen from a team.  A NULL score falls through to the loss label."""
    win, draw, loss = labels
    gf, ga = col(gf), col(ga)
    return F.when(gf > ga, F.lit(win)).when(gf == ga, F.lit(draw)).otherwise(F.lit(loss))


def match_outcome(hs="home_score", as_="away_score") -> Column:
    """Outcome seen from the match."""
    hs, as_ = col(hs), col(as_)
    return (
        F.when(hs > as_, F.lit("Home Win"))
        .when(hs == as_, F.lit("Draw"))
        .otherwise(F.lit("Away Win"))
    )


def count_when(cond: Column) -> Column:
    """SUM(CASE WHEN cond THEN 1 ELSE 0 END) as a BIGINT (NULL cond counts 0)."""
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("bigint")


def points(wins: Column, draws: Column) -> Column:
    return wins * 3 + draws


def opposition_bucket(opp_name="opponent_name", final_position="final_position",
                      top6=TOP6_NAMES) -> Column:
    """Top 6 by name list, else final position 1-6; 7-14 or NULL -> Mid Table."""
    pos = col(final_position)
    return (
        F.when(col(opp_name).isin(*top6), F.lit("Top 6"))
        .when(pos.between(1, 6), F.lit("Top 6"))
        .when(pos.between(7, 14) | pos.isNull(), F.lit("Mid Table"))
        .otherwise(F.lit("Bottom 6"))
    )


def strength_ordinal(final_position="final_position") -> Column:
    """Strong (<=6) = 2, Medium (<=14) = 1, Weak (else, NULL included) = 0."""
    pos = col(final_position)
    return F.when(pos <= 6, F.lit(2)).when(pos <= 14, F.lit(1)).otherwise(F.lit(0))


def category_from_position(final_position="position") -> Column:
    """top_6 / mid_table / relegation_battle from a final league position."""
    pos = col(final_position)
    return (
        F.when(pos <= 6, F.lit("top_6"))
        .when(pos <= 14, F.lit("mid_table"))
        .otherwise(F.lit("relegation_battle"))
    )


def shot_zone(x="x_coordinate", y="y_coordinate") -> Column:
    """Pitch zone of a shot; both bounds inclusive, NULL -> Unknown."""
    x, y = col(x), col(y)
    return (
        F.when(x.isNull() | y.isNull(), F.lit("Unknown"))
        .when(x >= 83, F.when(y.between(20, 80), F.lit("Six Yard Box")).otherwise(F.lit("Wide Close")))
        .when(x >= 67, F.when(y.between(30, 70), F.lit("Central Penalty Area"))
              .otherwise(F.lit("Wide Penalty Area")))
        .when(x >= 50, F.lit("Outside Box"))
        .otherwise(F.lit("Long Range"))
    )


def position_from_code(code="element_type") -> Column:
    """1..4 -> GK/DEF/MID/FWD, anything else UNK."""
    mapping = F.create_map(*[F.lit(x) for kv in POSITION_CODES.items() for x in kv])
    return F.coalesce(mapping[col(code)], F.lit("UNK"))


def full_name(first="first_name", second="second_name") -> Column:
    """First + ' ' + second."""
    return F.concat_ws(" ", col(first), col(second))


def squad_number(code="code") -> Column:
    """Rough squad number, code mod 100; a missing code gives 0."""
    return F.pmod(F.coalesce(col(code).cast("bigint"), F.lit(0)), F.lit(100))


def is_available(status="status") -> Column:
    """Status is not 'u' (NULL status counts as available, as in Python)."""
    return ~F.coalesce(col(status) == F.lit("u"), F.lit(False))


def falsy_default(c, default: float) -> Column:
    """NULL or zero -> default (Python ``x or d``)."""
    return F.coalesce(F.nullif(col(c), F.lit(0)).cast("double"), F.lit(default))


def signed_text(c) -> Column:
    """'+n' for n >= 0, '-n' otherwise."""
    c = col(c)
    return F.concat(F.when(c >= 0, F.lit("+")).otherwise(F.lit("")), c.cast("string"))


def score_text(gf="goals_for", ga="goals_against") -> Column:
    """P10: 'gf-ga'."""
    return F.concat_ws("-", col(gf).cast("string"), col(ga).cast("string"))


def r6(c) -> Column:
    """Round a double to 6 places (compare-stable rates)."""
    return F.round(col(c).cast("double"), 6)


WIDE, SMALL_WIDE = "decimal(38,0)", "decimal(19,0)"


def _half_even(num: Column, den: Column, kind: str) -> Column:
    """``num / den`` to the nearest integer, halves to even, in integer
    arithmetic of type ``kind`` throughout (integral division, no doubles)."""
    num, den = num.cast(kind), F.nullif(den.cast(kind), F.lit(0).cast(kind))
    a = F.abs(num)
    q = F.call_function("div", a, den).cast(kind)
    r = a - q * den
    up = (r > den - r) | ((r == den - r) & (F.pmod(q, F.lit(2).cast(kind)) == 1))
    q = F.when(up, q + F.lit(1).cast(kind)).otherwise(q)
    return F.when(num < 0, -q).otherwise(q).cast("bigint")


def half_even_div(num, den) -> Column:
    """Exact ``num / den`` rounded half-even to an integer, for bigint columns
    (``den`` > 0; NULL when ``den`` is 0).  No floating point is involved, so
    the result cannot depend on summation order."""
    return _half_even(col(num), col(den), "bigint")


def half_even_div_wide(num, den) -> Column:
    """The same over ``decimal(38,0)``, for products that outgrow a bigint;
    the quotient itself must fit one."""
    return _half_even(col(num), col(den), WIDE)


def scaled_units(c, places: int) -> Column:
    """A fixed-point value (``places`` decimals) as an integer count of units."""
    return F.round(col(c).cast("double") * F.lit(10 ** places)).cast("bigint")


def exact_ratio(num, den, scale: int = 1, places: int = 6) -> Column:
    """``num / den * scale`` for integer num/den, rounded half-even to
    ``places`` decimals exactly (NULL when den is 0)."""
    q = half_even_div(col(num).cast("bigint") * F.lit(scale * 10 ** places), den)
    return q.cast("double") / F.lit(10 ** places)


def guarded_ratio(num, den, scale: int = 1, places: int = 6) -> Column:
    """Exact ratio when ``den > 0``, else 0."""
    return F.when(col(den) > 0, exact_ratio(num, den, scale, places)).otherwise(F.lit(0.0))


def mean_half_even(c, places: int = 6, value_places: int = 0) -> Column:
    """Aggregate: mean of a fixed-point column (``value_places`` decimals),
    NULLs skipped, rounded half-even to ``places`` decimals, computed from
    integer sums."""
    units = scaled_units(c, value_places)
    num = F.sum(units).cast(WIDE) * F.lit(10 ** places).cast(SMALL_WIDE)
    q = half_even_div_wide(num, F.count(units).cast(WIDE) * F.lit(10 ** value_places).cast(SMALL_WIDE))
    return q.cast("double") / F.lit(10 ** places)


def mean_diff_half_even(a, b, places: int = 6, value_places: int = 0) -> Column:
    """Aggregate: ``avg(a) - avg(b)`` exactly, rounded half-even.

    With equal counts (the usual case: no NULLs on one side only) the sums
    are subtracted first, so nothing is multiplied by a count; otherwise both
    means are brought to the common denominator in 38 digits."""
    ua, ub = scaled_units(a, value_places), scaled_units(b, value_places)
    na, nb = F.count(ua), F.count(ub)
    scale = F.lit(10 ** places).cast(SMALL_WIDE)
    unit = F.lit(10 ** value_places).cast(SMALL_WIDE)
    even = half_even_div_wide((F.sum(ua) - F.sum(ub)).cast(WIDE) * scale, na.cast(WIDE) * unit)
    cross = F.sum(ua).cast(WIDE) * nb.cast(SMALL_WIDE) - F.sum(ub).cast(WIDE) * na.cast(SMALL_WIDE)
    odd = half_even_div_wide(cross * scale, na.cast(WIDE) * nb.cast(SMALL_WIDE) * unit)
    return F.when(na == nb, even).otherwise(odd).cast("double") / F.lit(10 ** places)

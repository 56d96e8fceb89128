"""Boosted trees per player against a plain loop over each player's rows."""
import random

import pytest

from touchline.plans.boosting import boosted_errors, predict_boosted, train_boosted_per_player

FEATURES = ("f0", "f1")
UNITS = 1_000_000


def half_up(a, b):
    return (2 * a + b) // (2 * b)


def plain(rows, rounds, depth, rate, min_split, min_leaf, bins, min_rows):
    """player -> predictions of its rows, in units."""
    low = [min(r[2][i] for r in rows) for i in range(2)]
    spread = [max(r[2][i] for r in rows) - low[i] for i in range(2)]
    cell = lambda x: [min(max(int((v - a) * bins // s), 0), bins - 1) if s else 0 for v, a, s in zip(x, low, spread)]
    out = {}
    for player in {r[0] for r in rows}:
        mine = [(m, cell(x), round(y * UNITS)) for p, m, x, y in rows if p == player]
        if len(mine) < min_rows:
            continue
        base = half_up(sum(y for *_, y in mine), len(mine))
        left = {m: y - base for m, _, y in mine}
        cells = {m: c for m, c, _ in mine}
        for _ in range(rounds):
            groups, done = [list(left)], []
            for _ in range(depth):
                deeper = []
                for g in groups:
                    best, total = None, sum(left[m] for m in g)
                    for f in range(2):
                        for b in sorted({cells[m][f] for m in g}):
                            a = [m for m in g if cells[m][f] <= b]
                            n, s = len(a), sum(left[m] for m in a)
                            if len(g) < min_split or n < min_leaf or len(g) - n < max(1, min_leaf):
                                continue
                            gain = float(s) * float(s) / n + float(total - s) * float(total - s) / (len(g) - n) - float(total) * float(total) / len(g)
                            if gain > 0 and (best is None or gain > best[0]):
                                best = (gain, f, b)
                    if best is None:
                        done.append(g)
                    else:
                        _, f, b = best
                        deeper += [[m for m in g if cells[m][f] <= b], [m for m in g if cells[m][f] > b]]
                groups = deeper
            for g in groups + done:
                value = half_up(sum(left[m] for m in g) * round(rate * 1000), len(g) * 1000)
                for m in g:
                    left[m] -= value
        out[player] = {m: (y - left[m]) / UNITS for m, _, y in mine}
    return out


def table(spark, rows):
    return spark.createDataFrame([(p, m, *x, y) for p, m, x, y in rows], "player_id long, match_id long, f0 double, f1 double, rating double")


def sample(seed=1):
    rnd = random.Random(seed)
    rows = []
    for p, n in ((1, 90), (2, 30), (3, 12), (4, 5), (5, 20)):
        for m in range(n):
            x = (rnd.uniform(0, 10), float(rnd.randrange(3)))
            rows.append((p, 100 * p + m, x, 5.0 if p == 5 else round(3 + (x[0] > 4) * 2 + x[1] * p + rnd.gauss(0, 0.3), 2)))
    return rows


@pytest.mark.parametrize("options", [dict(rounds=3, depth=2, rate=0.5, min_split=2, min_leaf=1), dict(rounds=2, depth=3, rate=0.1, min_split=8, min_leaf=3)])
def test_equals_a_plain_loop(spark, options):
    rows = sample()
    models = train_boosted_per_player(table(spark, rows), features=FEATURES, bins=16, min_rows=10, **options)
    got = {}
    for r in predict_boosted(models, table(spark, rows)).collect():
        got.setdefault(r.player_id, {})[r.match_id] = r.prediction
    want = plain(rows, bins=16, min_rows=10, **options)
    assert got.keys() == want.keys() == {1, 2, 3, 5}
    for p in want:
        assert got[p] == pytest.approx(want[p], abs=1e-9)


def test_rounds_lower_the_error_and_null_rows_are_left_out(spark):
    rows = sample(2)
    df = table(spark, rows + [(1, 9999, (1.0, 1.0), None), (None, 9998, (1.0, 1.0), 3.0)])
    errors = []
    for rounds in (1, 4):
        models = train_boosted_per_player(df, features=FEATURES, rounds=rounds, depth=2, rate=0.3)
        errors.append({r.player_id: r.mse for r in boosted_errors(models, df).collect()})
    assert all(errors[1][p] <= errors[0][p] for p in errors[0]) and errors[1][1] < 0.5 * errors[0][1]
    assert {r.player_id: r.samples for r in models.base.collect()} == {1: 90, 2: 30, 3: 12, 5: 20}


def test_rows_are_worked_out_once(spark):
    """The rows of a fit are computed once, however costly the plan behind them."""
    import random
    from touchline.plans import boosting
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b
    rnd = random.Random(3)
    rows = [(i % 5, *[rnd.random() for _ in boosting.PLAYER_FEATURES], float(rnd.randint(1, 9))) for i in range(200)]
    df = spark.createDataFrame(rows, ["player_id", *boosting.PLAYER_FEATURES, "rating"])
    boosting.train_boosted_per_player(df.mapInPandas(count, df.schema), "rating", rounds=1, depth=1).trees.count()
    assert seen.value == 200

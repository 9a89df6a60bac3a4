"""Many models at once against plain loops over matches: walk-forward tests, decays, bootstrap, attribution."""

import datetime as dt
import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import dixon_coles as dc
from touchline.operators import models

DAY = dt.date(2023, 1, 1)


def played(teams, n, seed):
    rng = random.Random(seed)
    force = {t: rng.uniform(-0.4, 0.4) for t in teams}
    rows = []
    for k in range(n):
        h, a = rng.sample(teams, 2)
        rates = math.exp(0.2 + force[h] - force[a] + 0.25), math.exp(0.2 + force[a] - force[h])
        rows.append((k, DAY + dt.timedelta(days=k // 2), k % 2, h, a, *[sum(rng.random() < x / 40 for _ in range(40)) for x in rates]))
    return rows


SCHEMA = "match_id int, match_date date, league int, home string, away string, home_goals int, away_goals int"


@pytest.fixture(scope="module")
def rows():
    return played(list("abcdefg"), 320, 3)


def plain_fit(rows, decay, counts=None):
    """The fit to one model's matches, by sums of a plain loop."""
    sums, newest = defaultdict(lambda: np.zeros(9)), max(r[1] for r in rows)
    for r in rows:
        n = 1 if counts is None else counts[r[0]]
        w, i, j = math.exp(-decay * (newest - r[1]).days) * n, r[5], r[6]
        sums[r[3], r[4]] += [w, w * i, w * j, *[w * ((i, j) == x) for x in ((0, 0), (0, 1), (1, 0), (1, 1))], n * (i + j), n]
    own = {k: v for k, v in sorted(sums.items()) if v[8]}
    return models.maximum([h for h, _ in own], [a for _, a in own], {k: np.array([v[c] for v in own.values()]) for c, k in enumerate(models.SUMS)})


def plain_grid(m, h, a, g=10):
    of = lambda table, t: float(table[m.teams.index(t)]) if t in m.teams else 0.0
    lh = math.exp(math.log(m.mean) + of(m.attack, h) + of(m.defence, a) + m.advantage)
    la = math.exp(math.log(m.mean) + of(m.attack, a) + of(m.defence, h))
    grid = {(i, j): math.exp(-lh) * lh**i / math.factorial(i) * math.exp(-la) * la**j / math.factorial(j) for i in range(g + 1) for j in range(g + 1)}
    for k, t in {(0, 0): 1 - lh * la * m.rho, (0, 1): 1 + lh * m.rho, (1, 0): 1 + la * m.rho, (1, 1): 1 - m.rho}.items():
        grid[k] *= t
    total = sum(grid.values())
    grid = {k: v / total for k, v in grid.items()}
    return grid, [sum(v for (i, j), v in grid.items() if s(i, j)) for s in (lambda i, j: i > j, lambda i, j: i == j, lambda i, j: i < j)], (lh, la)


def plain_backtest(rows, folds, gap, decay):
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    size, out = len(rows) // (folds + 1), []
    for fold in range(1, folds + 1):
        train, test = rows[: size * fold], rows[size * fold + gap : min(size * (fold + 1) + gap, len(rows))]
        for league in (0, 1):
            m = plain_fit([r for r in train if r[2] == league], decay)
            for r in test:
                if r[2] == league:
                    grid, p, _ = plain_grid(m, r[3], r[4])
                    y = [r[5] > r[6], r[5] == r[6], r[5] < r[6]]
                    out.append((fold, sum((a - b) ** 2 for a, b in zip(p, y, strict=True)), ((p[0] - y[0]) ** 2 + (p[0] + p[1] - y[0] - y[1]) ** 2) / 2, -math.log(max(grid[r[5], r[6]], 1e-12))))
    return out


def test_backtests_and_the_decay_equal_plain_loops(spark, rows):
    decays = [0.0, 0.002, 0.02]
    own = [*rows, (900, DAY + dt.timedelta(days=150), 0, "a", "newcomer", 1, 0)]
    df = spark.createDataFrame([*own, (999, DAY, 0, "a", "b", None, 1)][:-1], SCHEMA)
    found = dc.tested(df, ["match_date", "match_id"], 3, 4, decays, ["league"]).cache()
    got = {(r.fold, r.decay): r for r in dc.means(found, ["fold", "decay"]).collect()}
    overall = {}
    for d in decays:
        want = plain_backtest(own, 3, 4, d)
        for fold in (1, 2, 3):
            some = [w for w in want if w[0] == fold]
            r = got[fold, d]
            assert r.n == len(some)
            assert (r.brier, r.rps, r.log_loss_exact) == pytest.approx([sum(x) / len(some) for x in list(zip(*some, strict=True))[1:]], rel=1e-5)
        overall[d] = sum(w[2] for w in want) / len(want)
    tuned = {r.decay: r for r in dc.tuned(found, decays).collect()}
    assert [d for d in decays if tuned[d].chosen] == [min(decays, key=overall.get)]
    assert tuned[0.0].half_life_days is None and tuned[0.002].half_life_days == pytest.approx(math.log(2) / 0.002)
    compared = {r.metric: r for r in dc.decay_comparison(found, 0.02).collect()}
    assert compared["rps"].delta == pytest.approx(overall[0.02] - overall[0.0], rel=1e-4) and compared["rps"].improved == (overall[0.02] < overall[0.0])
    with pytest.raises(ValueError):
        dc.tuned(found, decays, "accuracy")


def test_hundreds_of_teams(spark):
    rows = played([f"t{k:03d}" for k in range(300)], 4000, 8)
    df = spark.createDataFrame(rows, SCHEMA)
    r = dc.means(dc.tested(df, ["match_date", "match_id"], 2, 0, [0.001]), ["fold"]).collect()
    assert sorted(x.fold for x in r) == [1, 2] and all(x.n > 1000 and x.brier < 0.75 for x in r)


def poisson(u):
    k, at = 0, math.exp(-1)
    while u >= at and k < 12:
        k += 1
        at += math.exp(-1) / math.factorial(k)
    return k


def test_bootstrap_equals_a_plain_resampler(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    fixtures = spark.createDataFrame([(0, "a", "b"), (1, "c", "d"), (1, "c", "d")], "league int, home string, away string")
    got = {(r.league, r.home, r.away): r for r in dc.bootstrapped(df, fixtures, ["league"], 12, 0.8, seed=5, decay=0.001).collect()}
    assert len(got) == 2
    for (league, h, a), r in got.items():
        values = []
        own = [x for x in rows if x[2] == league]
        for k in range(12):
            counts = {x[0]: poisson(int(hashlib.md5(f"5|{k}|{x[0]}".encode()).hexdigest()[:12], 16) / (1 << 48)) for x in own}
            m = plain_fit([x for x in own if counts[x[0]]], 0.001, counts)
            _, p, rates = plain_grid(m, h, a)
            values.append([*p, *rates])
        low, high = np.percentile(values, [10, 90], axis=0)
        assert r.replicates == 12 and r.failed == 0
        assert [r.home_low, r.draw_low, r.away_low, r.home_rate_low, r.away_rate_low] == pytest.approx(low.tolist(), rel=1e-4)
        assert [r.home_high, r.draw_high, r.away_high, r.home_rate_high, r.away_rate_high] == pytest.approx(high.tolist(), rel=1e-4)
    with pytest.raises(ValueError):
        dc.bootstrapped(df, fixtures, ["league"], 5)


def test_counts_of_a_resample_have_mean_and_variance_one(spark):
    got = spark.range(40_000).select(dc.poisson_count((F.col("id") + 0.5) / 40_000).alias("n")).agg(F.avg("n"), F.var_pop("n"), F.max("n")).first()
    assert got[0] == pytest.approx(1, abs=1e-3) and got[1] == pytest.approx(1, abs=1e-2) and got[2] >= 7


def test_attribution_equals_changed_models(spark, rows):
    m = plain_fit(rows, 0.0)
    pairs = [(h, a) for h in "abc" for a in "abcz" if h != a]
    df = spark.createDataFrame([(h, a, m.mean, m.advantage, m.rho, dict(zip(m.teams, m.attack.tolist(), strict=True)), dict(zip(m.teams, m.defence.tolist(), strict=True))) for h, a in pairs], "home string, away string, mean double, advantage double, rho double, attack map<string, double>, defence map<string, double>")
    got = defaultdict(list)
    for r in dc.attributed(dc.strengths(df)).collect():
        got[r.home, r.away].append(r)
    for h, a in pairs:
        base = plain_grid(m, h, a)[1]
        want = []
        for factor in dc.FACTORS:
            x = models.DixonColes([*m.teams, "z"], np.append(m.attack, 0.0), np.append(m.defence, 0.0), m.mean, m.advantage, m.rho)
            if factor in ("mean", "advantage", "rho"):
                setattr(x, factor, dc.FACTORS[factor])
            else:
                side, what = factor.split("_")
                getattr(x, what)[x.teams.index(h if side == "home" else a)] = 0.0
            want.append((factor, base[0] - plain_grid(x, h, a)[1][0]))
        found = sorted(got[h, a], key=lambda r: r.place)
        assert [r.factor for r in found] == [f for f, _ in sorted(want, key=lambda w: -round(abs(w[1]), 12))]
        assert {r.factor: pytest.approx(r.delta, abs=1e-9) for r in found} == dict(want)
        assert (found[0].home_win, found[0].draw, found[0].away_win) == pytest.approx(base)


def test_models_side_by_side_are_each_the_maximum():
    """Models of one and of several sizes fitted together are those fitted one by one; one without weight is none."""
    import numpy as np

    from touchline.operators.models import SUMS, maximum

    rng, cases = np.random.default_rng(4), []
    for teams in (4, 4, 6, 4, 6, 3):
        home, away = (x.ravel() for x in np.meshgrid(np.arange(teams) * 10, np.arange(teams) * 10, indexing="ij"))
        keep = (home != away) & (rng.random(len(home)) < 0.9)
        home, away = home[keep], away[keep]
        low = rng.random((4, len(home))) * 0.4
        w = low.sum(axis=0) + rng.random(len(home))
        sums = np.stack((w, w * rng.uniform(0.5, 3, len(w)), w * rng.uniform(0.5, 3, len(w)), *low, rng.integers(0, 9, len(w)), rng.integers(1, 4, len(w)))).astype(float)
        cases.append((home, away, sums))
    cases.append((cases[0][0], cases[0][1], cases[0][2] * 0))
    got = dc.fitted(cases)
    assert got[-1] is None
    for (home, away, sums), g in zip(cases[:-1], got, strict=False):
        m = maximum(home.tolist(), away.tolist(), dict(zip(SUMS, sums, strict=True)))
        assert np.allclose(g["attack"], m.attack, atol=1e-6) and np.allclose(g["defence"], m.defence, atol=1e-6)
        assert np.allclose([g["mean"], g["advantage"], g["rho"]], [m.mean, m.advantage, m.rho], atol=1e-6)


def test_rho_needs_the_low_scores_that_occur_alone(monkeypatch):
    """Halving the range of rho looks at the low scores that occur, not at four for every pairing, and finds the same."""
    rng = np.random.default_rng(4)
    home, away = np.repeat(np.arange(6), 5), (np.repeat(np.arange(6), 5) + np.tile(np.arange(1, 6), 6)) % 6
    goals = rng.poisson(1.3, (3, 2, 30))
    w = rng.random((3, 30)) + 0.1
    low = [np.where((goals[:, 0] == i) & (goals[:, 1] == j), w, 0.0) for i, j in ((0, 0), (0, 1), (1, 0), (1, 1))]
    sums = dict(zip(models.SUMS, [w, w * goals[:, 0], w * goals[:, 1], *low, goals.sum(axis=1).astype(float), np.ones((3, 30))], strict=True))
    seen, real = [], models.low_scores
    monkeypatch.setattr(models, "low_scores", lambda inner, weight: seen.append(weight.shape[1]) or real(inner, weight))
    x, mean, rho = models.maxima(np.stack([home] * 3), np.stack([away] * 3), sums, 6)
    assert set(seen) == {max(sum(int((k[m] > 0).sum()) for k in low) for m in range(3))}
    for m in range(3):
        one = models.maximum(home, away, {k: v[m] for k, v in sums.items()})
        assert abs(one.rho - rho[m]) < 1e-6 and abs(one.advantage - x[m, 12]) < 1e-6


def test_every_model_is_fitted_once(spark):
    """A filter on what a Python function gives would have it run a second time below."""
    sums = spark.range(4).select(F.lit(1).alias("league"), F.col("id").alias("home"), (F.col("id") + 1).alias("away"), *[F.lit(1.0).alias(k) for k in models.SUMS])
    assert dc.fits(sums, ["league"])._jdf.queryExecution().executedPlan().toString().count("fit(") == 1

"""Fitted models against plain loops: the likelihood's maximum, pooled neighbours, separated groups, action values."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import models


@pytest.fixture(scope="module")
def played(spark):
    rng = random.Random(1)
    strength = {t: rng.uniform(-0.4, 0.4) for t in "abcdef"}
    rows = []
    for k in range(300):
        h, a = rng.sample(sorted(strength), 2)
        lam = math.exp(0.2 + strength[h] - strength[a] + 0.25), math.exp(0.2 + strength[a] - strength[h])
        goals = [sum(1 for _ in range(40) if rng.random() < x / 40) for x in lam]
        rows.append((k, dt.date(2024, 1, 1) + dt.timedelta(days=k), h, a, *goals))
    return rows, spark.createDataFrame([*rows, (999, dt.date(2024, 2, 1), "a", "b", None, 1)], "match_id int, match_date date, home string, away string, home_goals int, away_goals int")


def likelihood(rows, m, decay):
    """The weighted log-likelihood by a loop over matches."""
    place, newest, total = {t: i for i, t in enumerate(m.teams)}, max(r[1] for r in rows), 0.0
    for _, day, h, a, i, j in rows:
        lh = math.exp(math.log(m.mean) + m.attack[place[h]] + m.defence[place[a]] + m.advantage)
        la = math.exp(math.log(m.mean) + m.attack[place[a]] + m.defence[place[h]])
        tau = {(0, 0): 1 - lh * la * m.rho, (0, 1): 1 + lh * m.rho, (1, 0): 1 + la * m.rho, (1, 1): 1 - m.rho}.get((i, j), 1.0)
        total += math.exp(-decay * (newest - day).days) * (i * math.log(lh) - lh + j * math.log(la) - la - math.lgamma(i + 1) - math.lgamma(j + 1) + math.log(tau))
    return total


@pytest.mark.parametrize("decay", [0.0, 0.005])
def test_dixon_coles_is_at_the_maximum(spark, played, decay):
    rows, df = played
    m = models.fit_dixon_coles(df, decay=decay)
    assert m.attack[0] == 0 and -1 <= m.rho <= 0 and m.mean == pytest.approx(sum(r[4] + r[5] for r in rows) / 600)
    best = likelihood(rows, m, decay)
    for name in ("attack", "defence"):
        for k in range(1 if name == "attack" else 0, 6):
            for d in (-1e-3, 1e-3):
                x = getattr(m, name).copy()
                x[k] += d
                assert likelihood(rows, models.DixonColes(**{**vars(m), name: x}), decay) < best + 1e-7
    for d in (-1e-3, 1e-3):
        assert likelihood(rows, models.DixonColes(**{**vars(m), "advantage": m.advantage + d}), decay) < best + 1e-7
        assert likelihood(rows, models.DixonColes(**{**vars(m), "rho": min(0.0, m.rho + d)}), decay) < best + 1e-7
    got = m.rates(df.select("match_id", "home", "away").limit(5)).first()
    place = {t: i for i, t in enumerate(m.teams)}
    assert got.lambda_home == pytest.approx(math.exp(math.log(m.mean) + m.attack[place[got.home]] + m.defence[place[got.away]] + m.advantage))


def test_walk_forward_keeps_test_rows_out_of_training(spark, played):
    _, df = played
    train, test = models.walk_forward(df, ["match_date", "match_id"], 4, 5)
    seen = {}
    for r in train.collect():
        seen.setdefault(r.fold, set()).add(r.match_id)
    first = {}
    for r in test.collect():
        assert r.match_id not in seen[r.fold]
        first[r.fold] = min(first.get(r.fold, r.match_date), r.match_date)
    by_id = {r.match_id: r.match_date for r in df.collect()}
    assert all(max(by_id[i] for i in seen[k]) < first[k] for k in seen) and len(seen) == 4


def pava(points):
    """Pooled adjacent violators over (x, mean, weight) in order of x."""
    blocks = []
    for x, y, w in sorted(points):
        blocks.append([[x], y, w])
        while len(blocks) > 1 and blocks[-2][1] > blocks[-1][1]:
            xs, y1, w1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + xs, (blocks[-1][1] * blocks[-1][2] + y1 * w1) / (blocks[-1][2] + w1), blocks[-1][2] + w1]
    return {x: y for xs, y, _ in blocks for x in xs}


def test_isotonic_recalibration_pools_neighbours(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        p = rng.choice([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7])
        rows.append((i, p, 0.25, 0.75 - p, rng.choices(["home", "draw", "away"], [p * p + 0.05, 0.3, 1])[0]))
    df = spark.createDataFrame(rows, "match_id int, p_home double, p_draw double, p_away double, outcome string")
    curves = {}
    for o, c in (("home", 1), ("draw", 2), ("away", 3)):
        by = {}
        for r in rows:
            by.setdefault(r[c], []).append(r[4] == o)
        curves[o] = pava([(x, sum(v) / len(v), len(v)) for x, v in by.items()])
    got = models.recalibrated(df, models.isotonic(df)).collect()
    for r, old in zip(sorted(got), rows, strict=True):
        want = np.array([curves["home"][old[1]], curves["draw"][old[2]], curves["away"][old[3]]])
        assert np.allclose([r.p_home, r.p_draw, r.p_away], want / want.sum())
    few = df.limit(5)
    assert models.recalibrated(few, models.isotonic(few)).collect() == few.collect()


def test_clusters_of_separate_groups(spark):
    rng = random.Random(3)
    rows = [(i, 10.0 * (i % 3 == 0) + rng.random(), -5.0 * (i % 3 == 1) + rng.random()) for i in range(20)]
    got = {r.team: (r.cluster, r.fit) for r in models.style_clusters(spark.createDataFrame(rows, "team int, a double, b double"), "team", ["a", "b"], 3).collect()}
    groups = {}
    for i, (c, _) in got.items():
        groups.setdefault(c, set()).add(i % 3)
    assert sorted(groups) == [0, 1, 2] and all(len(g) == 1 for g in groups.values()) and all(-1 <= f <= 1 + 1e-9 for _, f in got.values())


def test_recruits_come_from_other_clusters(spark):
    players = spark.createDataFrame([(i, i % 4, float(i % 4) + i / 100, float(-(i % 4))) for i in range(40)], "player int, team int, a double, b double")
    clusters = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "team int, cluster int")
    got = models.cluster_recruits(players, clusters, "player", "team", ["a", "b"], 3).collect()
    assert len(got) == 6 and all(r.player % 4 // 2 != r.cluster for r in got)


def test_action_values_follow_the_labels(spark):
    rng = random.Random(4)
    rows = []
    for i in range(2000):
        x = rng.random()
        rows.append((i, i // 20, i % 2, x, int(rng.random() < x), int(rng.random() < 0.2)))
    df = spark.createDataFrame(rows, "i int, match int, side int, x double, scores int, concedes int")
    got = models.action_values(df, ["x"], ["match"], ["i"], "side").orderBy("i").collect()
    p = np.array([r.p_scores for r in got])
    assert np.corrcoef(p, [r[3] for r in rows])[0, 1] > 0.9
    assert got[0].value == pytest.approx(got[0].p_scores - got[0].p_concedes)
    assert got[1].value == pytest.approx(got[1].p_scores - got[0].p_concedes - (got[1].p_concedes - got[0].p_scores))


def test_isotonic_reads_its_rows_once(spark):
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    def counted(x):
        seen.add(1)
        return x

    own = F.udf(counted, "double").asNondeterministic()
    df = spark.range(200).select(own((F.col("id") % 20 / 40).cast("double")).alias("p_home"), (F.col("id") % 5).alias("k")).select("p_home", F.lit(0.25).alias("p_draw"), (0.75 - F.col("p_home")).alias("p_away"), F.when(F.col("k") == 0, "home").when(F.col("k") == 1, "draw").otherwise("away").alias("outcome"))
    assert all(models.isotonic(df).values())
    assert seen.value == 200

"""Diagnostics and ranges against plain loops: quantiles, AUC, shuffles, the worst rows and their clusters, boosted action values."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import backtest, diagnostics, models, ranges, stats


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(5)
    rows = [(i, ["a", "b", None][i % 3], rng.choice([None, round(rng.gauss(0, 5), 1)]) if i % 7 else float(rng.randrange(3))) for i in range(3000)]
    return rows, spark.createDataFrame([*rows, (9999, "empty", None)], "i int, g string, x double")


def test_quantiles_by_ranges(values):
    rows, df = values
    got = {r.g: r for r in stats.quantiles(df, ["g"], "x", {"lo": 0.0, "q": 0.37, "med": 0.5, "hi": 1.0}).collect()}
    assert set(got) == {"a", "b", None}
    for g, r in got.items():
        own = [x for _, k, x in rows if k == g and x is not None]
        assert np.allclose([r.lo, r.q, r.med, r.hi], np.quantile(own, [0, 0.37, 0.5, 1]))
    assert stats.quantiles(df.limit(0), [], "x", {"m": 0.5}).first().m is None


@pytest.mark.parametrize("rows", [1, 50, 10_000])
def test_ranges_keep_the_order(values, rows):
    out = ranges.ranged(values[1], ["g"], "x", rows).collect()
    for g in ("a", "b", None):
        own = sorted(((r["x"] if r["x"] is not None else float("-inf"), r["_range"]) for r in out if r["g"] == g), key=lambda t: t[0])
        places = [k for _, k in own]
        assert places == sorted(places) and len({x for x, _ in own}) >= len(set(places))
        by_value = {}
        for x, k in own:
            assert by_value.setdefault(x, k) == k
    n = len({r["_range"] for r in out if r["g"] == "a"})
    assert n == 1 if rows == 10_000 else n > 5
    assert [r["_range"] for r in out if r["g"] == "empty"] == [0]


def test_auc_counts_pairs(spark):
    rng = random.Random(6)
    rows = [(i % 2, rng.randrange(20) / 20, rng.randrange(2)) for i in range(400)]
    df = spark.createDataFrame([*rows, (0, None, 1), (1, 0.5, None), (2, 0.1, 1)], "g int, p double, y int")
    got = {r.g: r for r in stats.auc(df, ["g"], "p", F.col("y")).collect()}
    for g in (0, 1):
        pos, neg = ([p for k, p, y in rows if k == g and y == v] for v in (1, 0))
        want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
        assert got[g].auc == pytest.approx(want) and (got[g].positives, got[g].negatives) == (len(pos), len(neg))
    assert got[2].auc is None


def test_shuffles_keep_the_values_and_repeat_themselves(values):
    rows, df = values
    once, again = (diagnostics.permuted(df, ["g"], ["i"], "x", [F.lit(3)]).orderBy("i").collect() for _ in range(2))
    assert once == again and len(once) == len(rows) + 1
    for g in ("a", "b", None):
        before, after = ([str(x) for x in xs] for xs in ([x for _, k, x in rows if k == g], [r.x for r in once if r.g == g]))
        assert sorted(before) == sorted(after) and before != after


def test_importance_is_in_what_the_score_uses(spark):
    rng = random.Random(8)
    rows = [(i, rng.random(), rng.random(), 1.0) for i in range(1500)]
    df = spark.createDataFrame([(i, a, b, c, a + 0.05 * rng.random()) for i, a, b, c in rows] + [(5000, 0.5, None, 1.0, 0.5), (5001, 0.5, 0.5, 1.0, None)], "i int, a double, b double, c double, t double")
    score = lambda v: v["a"] + 0.01 * v["b"] + v["c"]
    got = {r.feature: r for r in diagnostics.permutation_importance(df, ["i"], ["a", "b", "c"], score, "t", 3, 1).collect()}
    assert set(got) == {"a", "b"} and got["a"]["drop"] > 0.8 and abs(got["b"]["drop"]) < 0.05 and got["a"].repeats == 3
    assert got["a"]["drop"] == pytest.approx(got["a"].spearman - got["a"].shuffled)
    assert diagnostics.permutation_importance(df.limit(0), ["i"], ["a", "b", "c"], score, "t", 3, 1).collect() == []


def test_worst_forecasts_and_their_clusters(spark):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        bad = i % 6 == 0
        kind = i // 6 % 2  # two kinds of failures, far apart in both features
        rows.append((i, 0.8 if kind else 0.1, 0.1, 0.1 if kind else 0.8, ("away" if kind else "home") if bad else ("home" if kind else "away"), 10.0 * kind + rng.random(), None if i == 6 else -5.0 * kind + rng.random()))
    df = backtest.scored(spark.createDataFrame(rows, "match_id int, p_home double, p_draw double, p_away double, outcome string, a double, b double"))
    worst = diagnostics.hardest(df, "brier", ["match_id"], 1 / 6, 10)
    assert sorted(r.match_id for r in worst.collect()) == list(range(0, 300, 6))
    assert sorted(r.match_id for r in diagnostics.hardest(df, "brier", ["match_id"], 0.01, 7).collect()) == [0, 6, 12, 18, 24, 30, 36]
    c = diagnostics.clustered_errors(df, ["match_id"], ["a", "b"], 2, 1 / 6)
    kinds = {}
    for r in c.collect():
        kinds.setdefault(r.cluster, set()).add(r.match_id // 6 % 2)
    assert sorted(len(k) for k in kinds.values()) == [1, 1] and c.count() == 49
    got = sorted(diagnostics.error_clusters(c, ["a", "b"]).collect(), key=lambda r: r.forecast)
    assert [(r.forecast, r.outcome, r.accuracy) for r in got] == [("away", "home", 0.0), ("home", "away", 0.0)] and sum(r.n for r in got) == 49
    assert all(abs(r.centre[0].centre) >= abs(r.centre[1].centre) for r in got)
    assert diagnostics.clustered_errors(df.limit(8), ["match_id"], ["a", "b"], 2, 0.5).collect() == []


def test_boosted_values_beat_a_straight_line(spark):
    rng = random.Random(10)
    rows = []
    for i in range(4000):
        x, y = rng.random(), rng.random()
        rows.append((i, i // 20, i % 2, x, y, int(rng.random() < (0.9 if (x > 0.5) == (y > 0.5) else 0.1)), 0))
    df = spark.createDataFrame(rows, "i int, match int, side int, x double, y double, scores int, concedes int")
    makes = {"line": models.logistic, "trees": lambda: models.boosted(rounds=10, least=20)}
    got = {(r.model, r.label, r.held_out): r.auc for r in models.label_auc(df, ["x", "y"], F.col("match") % 4 == 0, makes).collect()}
    assert got["trees", "scores", True] > 0.85 > 0.6 > got["line", "scores", True]
    assert got["trees", "concedes", True] is None  # no positives
    v = models.action_values(df, ["x", "y"], ["match"], ["i"], "side", makes["trees"]).orderBy("i").limit(2).collect()
    assert v[0].p_concedes == 0.0 and v[1].value == pytest.approx(v[1].p_scores - v[0].p_concedes + v[0].p_scores)


def test_rows_with_a_range_are_never_broadcast(spark):
    """Rows of several orders of few groups: the table of edges goes to the rows, whatever Spark's estimates say."""
    from touchline.operators.ranges import ranged

    df = spark.range(3000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("x")).unionByName(spark.createDataFrame([(None, 1.0), (7, None), (7, 2.0)], "g long, x double"))
    out = ranged(df, ["g"], "x", 100)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan
    got = out.groupBy("g").agg(F.count("*").alias("n"), F.max("_range").alias("top"), F.min("_range").alias("low")).collect()
    assert {(r.g, r.n, r.top > 5, r.low) for r in got} == {(0, 1000, True, 0), (1, 1000, True, 0), (2, 1000, True, 0), (None, 1, False, 0), (7, 2, False, 0)}
    again = out.groupBy("g", "_range").agg(F.min("x").alias("a"), F.max("x").alias("b")).where("g = 1").orderBy("_range").collect()
    assert all(p.b < q.a for p, q in zip(again, again[1:]))


@pytest.mark.parametrize("pools", [32, 3])
def test_bootstrap_ranks_of_a_group_without_a_name(spark, monkeypatch, pools):
    """Groups whose key is null have pools too; pools side by side, in one block or in several, against a plain loop."""
    import hashlib

    from touchline.operators import sensitivity

    monkeypatch.setattr(sensitivity, "POOLS", pools, raising=False)
    rows = [(i, None if i % 3 else "a", float(i * 7 % 11)) for i in range(40)]
    got = {r.i: tuple(r)[2:] for r in sensitivity.bootstrap_ranks(spark.createDataFrame(rows, "i int, g string, x double"), ["g"], "i", "x", 7, 3).collect()}
    draw = lambda r, i: int(hashlib.md5(f"3|{r}|{i}".encode()).hexdigest()[:12], 16) / 2**48
    for g in ("a", None):
        own = [(i, x) for i, k, x in rows if k == g]
        drawn = [[own[int(draw(r, j) * len(own))][1] for j in range(len(own))] for r in range(7)]
        for i, x in own:
            ranks = [1 + sum(y > x for y in d) for d in drawn]
            assert np.allclose(got[i], np.quantile(ranks, [0.05, 0.5, 0.95]))

"""Fitted models: Dixon and Coles from sums per pairing, walk-forward tests, isotonic recalibration, ensemble weights, style clusters, action values.

Spark sums over the matches; what the driver holds is bounded by the teams, the grid or the model.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .backtest import OUTCOMES, hit
from .league import outcome_probabilities, score_matrix
from .ranges import cut, joined, running
from .stats import auc, zscored

#: Bounds of a log rate, the goals of a league without any, and where the fit of the low scores may lie.
LOG_RATE, NO_GOALS, RHO = (-10.0, 3.0), 1.3, (-1.0, 0.0)
#: What the likelihood needs of each pairing.
SUMS = ["w", "wh", "wa", "w00", "w01", "w10", "w11", "goals", "n"]
#: What an action may lead to.
LABELS = ["scores", "concedes"]


@dataclass
class DixonColes:
    teams: list
    attack: np.ndarray
    defence: np.ndarray
    mean: float
    advantage: float
    rho: float

    def table(self, spark) -> DataFrame:
        """(team, attack, defence), one row per team."""
        return spark.createDataFrame([(t, float(a), float(d)) for t, a, d in zip(self.teams, self.attack, self.defence, strict=True)], f"team {'long' if self.teams and isinstance(self.teams[0], int) else 'string'}, attack double, defence double")

    def rates(self, fixtures: DataFrame) -> DataFrame:
        """The two goal rates of each fixture of known teams."""
        t = self.table(fixtures.sparkSession)
        h, a = (t.select(F.col("team").alias(s), F.col("attack").alias(f"_a{s}"), F.col("defence").alias(f"_d{s}")) for s in ("home", "away"))
        rate = lambda x: F.exp(F.least(F.greatest(x + float(np.log(self.mean)), F.lit(LOG_RATE[0])), F.lit(LOG_RATE[1])))
        out = fixtures.join(h, "home").join(a, "away")
        return out.withColumns({"lambda_home": rate(F.col("_ahome") + F.col("_daway") + self.advantage), "lambda_away": rate(F.col("_aaway") + F.col("_dhome"))}).drop("_ahome", "_dhome", "_aaway", "_daway")


def pairing_sums(matches: DataFrame, weight: Column, by: Sequence[str] = (), times: Column | None = None) -> DataFrame:
    """Per group and ordered pairing all that the likelihood needs: weights, weighted goals of both sides, and weights of the four low scores. Matches without goals don't count; one that counts several `times` does so in everything."""
    h, a, times = F.col("home_goals"), F.col("away_goals"), F.lit(1) if times is None else times
    rows = matches.where(h.isNotNull() & a.isNotNull()).withColumns({"_w": weight * times, "_times": times})
    return rows.groupBy(*by, "home", "away").agg(*_sums(F.col("_w")), F.sum((h + a) * F.col("_times")).alias("goals"), F.sum("_times").alias("n"))


def _sums(weight: Column, suffix: str = "") -> list[Column]:
    h, a = F.col("home_goals"), F.col("away_goals")
    low = {f"w{i}{j}": F.sum(F.when((h == i) & (a == j), weight).otherwise(0.0)) for i, j in product((0, 1), repeat=2)}
    return [c.alias(k + suffix) for k, c in ({"w": F.sum(weight), "wh": F.sum(weight * h), "wa": F.sum(weight * a)} | low).items()]


def decayed(at: str, decay: float | None = None, half_life: float | None = None) -> Column:
    """exp(-decay * days) or 0.5 ** (days / half_life) before the newest match, which a column _newest holds; decay goes first."""
    days = F.datediff("_newest", F.to_date(at))
    return F.exp(-decay * days) if decay is not None else F.pow(F.lit(0.5), days / half_life) if half_life is not None else F.lit(1.0)


def fit_dixon_coles(matches: DataFrame, decay: float | None = None, half_life: float | None = None, weight: Column | None = None, at: str = "match_date", rounds: int = 200) -> DixonColes:
    """The weighted likelihood's maximum: attack and defence of every team (the first team's attack is 0), home advantage and rho. The driver sees one row per pairing."""
    newest = matches.agg(F.max(F.to_date(at)).alias("_newest"))
    rows = pairing_sums(matches.crossJoin(F.broadcast(newest)), decayed(at, decay, half_life) * (F.lit(1.0) if weight is None else weight)).collect()
    if not rows:
        raise ValueError("no matches with goals")
    return maximum([r.home for r in rows], [r.away for r in rows], {k: np.array([float(r[k]) for r in rows]) for k in SUMS}, rounds)


def maximum(home: Sequence, away: Sequence, sums: dict[str, np.ndarray], rounds: int = 200) -> DixonColes:
    """The fit to the sums of each pairing: Fisher scoring on the rates and a search on rho in turn.

    The normal equations are summed by team, so memory follows the square of the teams and not teams times pairings.
    """
    teams = sorted({*home, *away})
    place = {t: i for i, t in enumerate(teams)}
    h, a = (np.array([place[t] for t in side]) for side in (home, away))
    most = sums["w"].max()  # only the ratios of weights count
    w, wh, wa, w00, w01, w10, w11 = (sums[k] / most for k in SUMS[:7])
    n, mean = len(teams), float(sums["goals"].sum() / (2 * sums["n"].sum())) or NO_GOALS
    size = 2 * n + 1  # attacks, defences, advantage
    spots = [(x, y) for side in ((h, n + a, np.full(len(h), 2 * n)), (a, n + h)) for x in side for y in side]
    flat = np.concatenate([x * size + y for x, y in spots])
    x, rho = np.zeros(size), 0.0
    weights = np.concatenate((w00, w01, w10, w11))
    counted = weights > 0
    weights = weights[counted]

    def rates(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = np.log(mean)
        return np.exp(np.clip(base + x[h] + x[n + a] + x[2 * n], *LOG_RATE)), np.exp(np.clip(base + x[a] + x[n + h], *LOG_RATE))

    def taus(lh, la, rho):
        return [np.maximum(t, 1e-12) for t in (1 - lh * la * rho, 1 + lh * rho, 1 + la * rho, np.full(len(lh), 1 - rho))]

    def value(x: np.ndarray, rho: float) -> float:
        lh, la = rates(x)
        return float((wh * np.log(lh) - w * lh + wa * np.log(la) - w * la).sum() + sum((k * np.log(t)).sum() for k, t in zip((w00, w01, w10, w11), taus(lh, la, rho), strict=True)))

    best = value(x, rho)
    for _ in range(rounds):
        lh, la = rates(x)
        t00, t01, t10, _t = taus(lh, la, rho)
        both = -w00 * lh * la * rho / t00
        gh, ga = wh - w * lh + both + w01 * lh * rho / t01, wa - w * la + both + w10 * la * rho / t10
        grad = np.bincount(np.concatenate((h, n + a, a, n + h)), weights=np.concatenate((gh, gh, ga, ga)), minlength=size)
        grad[2 * n] = gh.sum()
        fisher = np.bincount(flat, weights=np.concatenate([w * lh] * 9 + [w * la] * 4), minlength=size * size).reshape(size, size)
        move = np.concatenate(([0.0], np.linalg.solve(fisher[1:, 1:] + 1e-9 * np.eye(size - 1), grad[1:])))
        step = 1.0
        while step > 1e-8 and value(x + step * move, rho) < best:
            step /= 2
        x = x + step * move if step > 1e-8 else x
        lh, la = rates(x)
        low, high = RHO  # the likelihood is concave in rho, and every tau is 1 + c * rho: halve the side where it falls
        c = np.concatenate((-lh * la, lh, la, np.full(len(lh), -1.0)))[counted]
        gain = weights * c
        for _step in range(40):
            mid = (low + high) / 2
            slope = (gain / np.maximum(1 + c * mid, 1e-12)).sum()
            low, high = (mid, high) if slope > 0 else (low, mid)
        rho = max((low + high) / 2, rho, key=lambda r: value(x, r))
        now = value(x, rho)
        if now - best < 1e-10 * (1 + abs(best)):
            break
        best = now
    return DixonColes(teams, x[:n], x[n : 2 * n], mean, float(x[2 * n]), float(rho))


def low_scores(inner: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The rho of greatest likelihood of each of several models, by halves of its range; inner: what rho is multiplied by in the correction of each low score that counts."""
    low, high = np.full(len(inner), RHO[0]), np.full(len(inner), RHO[1])
    weighted = weight * inner
    for _step in range(40):
        mid = (low + high) / 2
        up = (weighted / np.maximum(1 + inner * mid[:, None], 1e-12)).sum(axis=1) > 0
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    return (low + high) / 2


def maxima(home: np.ndarray, away: np.ndarray, sums: dict[str, np.ndarray], teams: int, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """maximum() of several models of as many teams at once, a row each: (strengths and advantage, mean, rho). home, away: the teams' places; pairings without weight count for nothing."""
    models, n, size = len(home), teams, 2 * teams + 1
    mean = sums["goals"].sum(axis=1) / (2 * sums["n"].sum(axis=1))
    mean[mean == 0] = NO_GOALS
    weights = np.stack([sums[k] for k in SUMS[:7]]) / sums["w"].max(axis=1)[None, :, None]  # only the ratios of weights count
    # the low scores that occur, side by side: the first so many of each model count
    scores = np.concatenate(weights[3:], axis=1)
    cells = np.argsort(scores == 0, axis=1, kind="stable")[:, : max(1, int((scores != 0).sum(axis=1).max(initial=0)))]
    cell_weights = np.take_along_axis(scores, cells, axis=1)
    x, rho, best, running_ = np.zeros((models, size)), np.zeros(models), np.full(models, -np.inf), np.arange(models)

    def logs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        of = lambda at: np.take_along_axis(x, at, axis=1)
        return np.clip(base + of(h) + of(n + a) + x[:, 2 * n :], *LOG_RATE), np.clip(base + of(a) + of(n + h), *LOG_RATE)

    def taus(lh: np.ndarray, la: np.ndarray, rho: np.ndarray) -> list[np.ndarray]:
        r = rho[:, None]
        return [np.maximum(t, 1e-12) for t in (1 - lh * la * r, 1 + lh * r, 1 + la * r, np.broadcast_to(1 - r, lh.shape))]

    def value(eh: np.ndarray, ea: np.ndarray, lh: np.ndarray, la: np.ndarray, rho: np.ndarray) -> np.ndarray:
        return (wh * eh - w * lh + wa * ea - w * la + sum(k * np.log(t) for k, t in zip((w00, w01, w10, w11), taus(lh, la, rho), strict=True))).sum(axis=1)

    for round_ in range(rounds):
        h, a, base, (w, wh, wa, w00, w01, w10, w11) = home[running_], away[running_], np.log(mean[running_])[:, None], weights[:, running_]
        own, r, m = x[running_], rho[running_], len(running_)
        eh, ea = logs(own)
        lh, la = np.exp(eh), np.exp(ea)
        before = best[running_] if round_ else value(eh, ea, lh, la, r)
        t00, t01, t10, _t = taus(lh, la, r)
        both = -w00 * lh * la * r[:, None] / t00
        gh, ga = wh - w * lh + both + w01 * lh * r[:, None] / t01, wa - w * la + both + w10 * la * r[:, None] / t10
        at = np.arange(m)[:, None]
        grad = np.bincount(np.concatenate([(at * size + s).ravel() for s in (h, n + a, a, n + h)]), weights=np.concatenate([g.ravel() for g in (gh, gh, ga, ga)]), minlength=m * size).reshape(m, size)
        grad[:, 2 * n] = gh.sum(axis=1)
        # sums by pairing of teams give all blocks of the information
        cell = (at * n + h) * n + a
        by_home, by_away = (np.bincount(cell.ravel(), weights=v.ravel(), minlength=m * n * n).reshape(m, n, n) for v in (w * lh, w * la))
        fisher, each = np.zeros((m, size, size)), np.arange(n)
        fisher[:, :n, n : 2 * n] = by_home + by_away.transpose(0, 2, 1)
        fisher[:, n : 2 * n, :n] = fisher[:, :n, n : 2 * n].transpose(0, 2, 1)
        fisher[:, each, each] = by_home.sum(axis=2) + by_away.sum(axis=1)
        fisher[:, n + each, n + each] = by_home.sum(axis=1) + by_away.sum(axis=2)
        fisher[:, 2 * n, :n] = fisher[:, :n, 2 * n] = by_home.sum(axis=2)
        fisher[:, 2 * n, n : 2 * n] = fisher[:, n : 2 * n, 2 * n] = by_home.sum(axis=1)
        fisher[:, 2 * n, 2 * n] = by_home.sum(axis=(1, 2))
        move = np.zeros((m, size))
        move[:, 1:] = np.linalg.solve(fisher[:, 1:, 1:] + 1e-9 * np.eye(size - 1), grad[:, 1:, None])[..., 0]
        step = np.ones(m)
        while True:
            eh, ea = logs(own + step[:, None] * move)
            lh, la = np.exp(eh), np.exp(ea)
            here = value(eh, ea, lh, la, r)
            less = (step > 1e-8) & (here < before)
            if not less.any():
                break
            step[less] /= 2
        own = own + np.where(step > 1e-8, step, 0.0)[:, None] * move
        if (step <= 1e-8).any():
            eh, ea = logs(own)
            lh, la = np.exp(eh), np.exp(ea)
            here = value(eh, ea, lh, la, r)
        found = low_scores(np.take_along_axis(np.concatenate((-lh * la, lh, la, np.full_like(lh, -1.0)), axis=1), cells[running_], axis=1), cell_weights[running_])
        there = value(eh, ea, lh, la, found)
        now = np.maximum(there, here)
        x[running_], rho[running_], best[running_] = own, np.where(there >= here, found, r), now
        running_ = running_[~(now - before < 1e-10 * (1 + np.abs(before)))]
        if not len(running_):
            break
    return x, mean, rho


def walk_forward(matches: DataFrame, order: Sequence[str], folds: int, gap: int) -> tuple[DataFrame, DataFrame]:
    """(train, test) rows with their fold: fold k trains on the first k of folds + 1 equal parts and tests on the next, after a gap; no row of a fold is in both.

    Row numbers come from ranges of the order. A row trains in at most `folds` folds.
    """
    rows = running(matches, [], order, {}).drop("_range")
    size = matches.agg((F.floor(F.count("*") / (folds + 1))).alias("_size"), F.count("*").alias("_n"))
    rows = rows.crossJoin(F.broadcast(size)).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    start = F.col("_size") * F.col("fold")
    train = rows.where(F.col("_i") < start)
    test = rows.where((F.col("_i") >= start + gap) & (F.col("_i") < F.least(start + F.col("_size") + gap, F.col("_n"))))
    return train.drop("_i", "_size", "_n"), test.drop("_i", "_size", "_n")


def poisson_walk_forward(matches: DataFrame, order: Sequence[str], folds: int, gap: int, max_goals: int = 10) -> DataFrame:
    """Test rows of walk_forward() with p_home, p_draw, p_away of a Poisson model of their fold's training rows; rows of teams that are new to it are left out.

    The folds' models are grouped together, and each pairing is scored once for all its matches.
    """
    train, test = walk_forward(matches, order, folds, gap)
    mean = train.groupBy("fold").agg(F.avg("home_goals").alias("mh"), F.avg("away_goals").alias("ma"))
    home = train.groupBy("fold", F.col("home").alias("team")).agg(F.sum("home_goals").alias("hf"), F.sum("away_goals").alias("ha"), F.count("*").alias("hn"))
    away = train.groupBy("fold", F.col("away").alias("team")).agg(F.sum("away_goals").alias("af"), F.sum("home_goals").alias("aa"), F.count("*").alias("an"))
    s = home.join(away, ["fold", "team"]).join(mean, "fold")
    ratio = lambda goals, n, mu: (F.col(goals) + F.col(mu)) / ((F.col(n) + 1) * F.col(mu))
    h = s.select("fold", F.col("team").alias("home"), "mh", "ma", ratio("hf", "hn", "mh").alias("_ha"), ratio("ha", "hn", "ma").alias("_hd"))
    a = s.select("fold", F.col("team").alias("away"), ratio("af", "an", "ma").alias("_aa"), ratio("aa", "an", "mh").alias("_ad"))
    pairs = test.select("fold", "home", "away").distinct().join(h, ["fold", "home"]).join(a, ["fold", "away"])
    pairs = pairs.select(F.struct("fold", "home", "away").alias("match_id"), (F.col("mh") * F.col("_ha") * F.col("_ad")).alias("lambda_home"), (F.col("ma") * F.col("_aa") * F.col("_hd")).alias("lambda_away"))
    p = outcome_probabilities(score_matrix(pairs, max_goals)).select("match_id.*", *[f"p_{o}" for o in OUTCOMES])
    outcome = F.when(F.col("home_goals") > F.col("away_goals"), "home").when(F.col("home_goals") == F.col("away_goals"), "draw").otherwise("away")
    return test.join(p, ["fold", "home", "away"]).withColumn("outcome", outcome)


def isotonic(df: DataFrame, least: int = 10) -> dict[str, object]:
    """Per outcome a monotone curve from its probability to how often it came, or None with fewer rows than `least`. Spark pools neighbours by partition first.

    The rows are read once: how often each probability of an outcome was given and came is written first, and the
    curves are fitted to that.
    """
    cases = F.explode(F.array(*[F.struct(F.lit(o).alias("o"), F.col(f"p_{o}").alias("x"), hit(o).alias("y")) for o in OUTCOMES]))
    counts = cut(df.select(cases.alias("_c")).select("_c.*").groupBy("o", "x").agg(F.avg("y").alias("y"), F.count("*").cast("double").alias("w")))
    if (counts.where(F.col("o") == OUTCOMES[0]).agg(F.sum("w")).first()[0] or 0) < least:
        return dict.fromkeys(OUTCOMES)
    fit = lambda o: IsotonicRegression(featuresCol="x", labelCol="y", weightCol="w").fit(counts.where(F.col("o") == o).drop("o"))
    return {o: fit(o) for o in OUTCOMES}


def recalibrated(df: DataFrame, curves: dict[str, object]) -> DataFrame:
    """Forecasts by the curves, straight between their points and level beyond them, brought to a sum of one; without curves, or where all are nought, as they were."""
    if any(c is None for c in curves.values()):
        return df
    out = df
    for o, c in curves.items():
        out = c.copy().setFeaturesCol(f"p_{o}").setPredictionCol(f"_c_{o}").transform(out)
    total = sum((F.col(f"_c_{o}") for o in OUTCOMES), F.lit(0.0))
    return out.withColumns({f"p_{o}": F.when(total > 0, F.col(f"_c_{o}") / total).otherwise(F.col(f"p_{o}")) for o in OUTCOMES}).drop(*[f"_c_{o}" for o in OUTCOMES])


def ensemble_weights(df: DataFrame, models: dict[str, dict[str, Column]], steps: int = 10) -> DataFrame:
    """One row: the weights, in steps of 1 / steps, of the blend of models with the least mean ranked probability score, the first of equals, and that score.

    The score is quadratic in the weights, so one pass gives the means of all products of two models' errors, and the
    grid is tried on that one row.
    """
    y1, y2 = hit("home"), hit("home") + hit("draw")
    error = {m: (p["home"] - y1, p["home"] + p["draw"] - y2) for m, p in models.items()}
    names = list(models)
    moments = df.agg(*[F.avg((error[a][0] * error[b][0] + error[a][1] * error[b][1]) / 2).alias(f"m_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j])
    grid = [g for g in product(range(steps + 1), repeat=len(names)) if sum(g) == steps]
    tried = moments.sparkSession.createDataFrame([(k, *[x / steps for x in g]) for k, g in enumerate(grid)], "k int, " + ", ".join(f"w_{m} double" for m in names))
    score = sum((F.col(f"w_{a}") * F.col(f"w_{b}") * F.col(f"m_{i}_{j}") * (1 if i == j else 2) for i, a in enumerate(names) for j, b in enumerate(names) if i <= j), F.lit(0.0))
    return tried.crossJoin(F.broadcast(moments)).withColumn("rps", score).orderBy("rps", "k").limit(1).select(*[f"w_{m}" for m in names], "rps")


def style_clusters(df: DataFrame, key: str, values: Sequence[str], k: int, seed: int = 42) -> DataFrame:
    """(key, cluster, fit): k-means on population z-scores; clusters are numbered by size, the largest 0, equals by their first centre; fit is the cosine to the centre."""
    z = zscored(df.select(key, *values), values)
    features = VectorAssembler(inputCols=[f"z_{v}" for v in values], outputCol="_f").transform(z)
    model = KMeans(featuresCol="_f", predictionCol="_c", k=k, seed=seed, initSteps=5).fit(features)
    centres = model.clusterCenters()
    placed = model.transform(features)
    sizes = {r["_c"]: r["n"] for r in placed.groupBy("_c").agg(F.count("*").alias("n")).collect()}
    order = sorted(range(len(centres)), key=lambda c: (-sizes.get(c, 0), tuple(centres[c])))
    named = df.sparkSession.createDataFrame([(c, i, [float(x) for x in centres[c]]) for i, c in enumerate(order)], "_k int, cluster int, centre array<double>")
    from .stats import cosine

    return placed.join(F.broadcast(named), F.col("_c") == F.col("_k")).select(key, "cluster", cosine(vector_to_array("_f"), F.col("centre")).alias("fit"))


def logistic():
    return LogisticRegression(maxIter=50, regParam=1e-3)


def boosted(rounds: int = 50, depth: int = 3, step: float = 0.1, least: int = 200, share: float = 0.7, seed: int = 42):
    """Gradient-boosted trees; `least` rows a leaf, each tree on a share of the rows."""
    return GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=step, minInstancesPerNode=least, subsamplingRate=share, seed=seed)


def label_chances(df: DataFrame, features: Sequence[str], make: Callable = logistic, learns: Column | None = None) -> DataFrame:
    """df with p_scores and p_concedes by models of the labels scores and concedes, fitted to all rows or to those that `learns` marks. A label that only has one value there has that as its chance.

    A fit reads df several times: it should be cut() where it is more than a table.
    """
    rows = VectorAssembler(inputCols=list(features), outputCol="_f", handleInvalid="keep").transform(df)
    train = rows if learns is None else rows.where(learns)
    ends = train.agg(*[f(c).cast("double").alias(f"{c}_{n}") for c in LABELS for n, f in (("low", F.min), ("high", F.max))]).first()
    for label in LABELS:
        if ends[f"{label}_low"] == ends[f"{label}_high"]:
            rows = rows.withColumn(f"p_{label}", F.lit(ends[f"{label}_low"]).cast("double"))
            continue
        learner = make().setFeaturesCol("_f").setLabelCol("_y").setProbabilityCol("_p").setPredictionCol("_q").setRawPredictionCol("_r")
        model = learner.fit(train.select("_f", F.col(label).cast("double").alias("_y")))
        rows = model.transform(rows).withColumn(f"p_{label}", vector_to_array("_p")[1]).drop("_p", "_q", "_r")
    return rows.drop("_f")


def action_values(df: DataFrame, features: Sequence[str], by: Sequence[str], order: Sequence[str], side: str, make: Callable = logistic) -> DataFrame:
    """df with p_scores, p_concedes and value: how an action changes its side's chances, by models of the labels scores and concedes.

    The chances before an action are those after the one before it, exchanged where another side had that; an entity's
    first action starts from nought.
    """
    rows = label_chances(cut(df), features, make)
    w = Window.partitionBy(*by).orderBy(*order)
    same = F.lag(side).over(w) == F.col(side)
    before = {"scores": F.when(same, F.lag("p_scores").over(w)).otherwise(F.lag("p_concedes").over(w)), "concedes": F.when(same, F.lag("p_concedes").over(w)).otherwise(F.lag("p_scores").over(w))}
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return rows.withColumn("value", F.col("p_scores") - zero(before["scores"]) - (F.col("p_concedes") - zero(before["concedes"])))


def label_auc(df: DataFrame, features: Sequence[str], held_out: Column, makes: dict[str, Callable]) -> DataFrame:
    """(model, label, held_out, auc, positives, negatives) of models fitted to the rows that aren't held out. The rows are written first, and so are the chances of each model."""
    out = None
    rows = cut(df.select(*features, *LABELS, held_out.alias("held_out")))
    for name, make in makes.items():
        p = label_chances(rows, features, make, ~F.col("held_out"))
        cases = F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"p_{c}").alias("chance"), F.col(c).alias("came")) for c in LABELS]))
        one = auc(cut(p.select("held_out", cases.alias("_c")).select("held_out", "_c.*")), ["label", "held_out"], "chance", F.col("came")).withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def cluster_recruits(players: DataFrame, clusters: DataFrame, key: str, team: str, values: Sequence[str], n: int) -> DataFrame:
    """(cluster, player, fit): per cluster the n players of other clusters' teams whose z-scores are most like the mean of its teams'. clusters: team, cluster."""
    from .stats import cosine

    z = joined(zscored(players.select(key, team, *values), values), clusters.select(F.col(team), F.col("cluster").alias("_own")), [team])
    centres = z.groupBy(F.col("_own").alias("cluster")).agg(*[F.avg(f"z_{v}").alias(f"_c_{v}") for v in values])
    pairs = z.crossJoin(F.broadcast(centres)).where("_own <> cluster").withColumn("fit", cosine(F.array(*[f"z_{v}" for v in values]), F.array(*[f"_c_{v}" for v in values])))
    # the best of each own cluster first, so the last step sorts few rows
    for part in (["cluster", "_own"], ["cluster"]):
        w = Window.partitionBy(*part).orderBy(F.desc("fit"), key)
        pairs = pairs.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return pairs.select("cluster", key, "fit")

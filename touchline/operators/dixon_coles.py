"""Many Dixon and Coles models at once: walk-forward tests for several decays, the choice of a decay, bootstrap intervals, and what each factor adds to a forecast.

Spark sums the matches of every model by pairing in one pass; each model is then one group of pairings, at most the
square of a competition's teams, fitted in a task of its own. Forecasts come from closed sums over the goals, as column
expressions on arrays of max_goals + 1 numbers, without a row per score.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .backtest import OUTCOMES, hit
from .league import uniform
from .models import LOG_RATE, SUMS, _sums, decayed, maxima, pairing_sums, walk_forward

#: The decays a day that are tried unless others are given.
DECAYS = (0.0, 0.001, 0.002, 0.003, 0.005, 0.008, 0.01, 0.015, 0.02)
METRICS = ("log_loss_exact", "brier", "rps")
#: Numbers that models fitted side by side may take together.
CELLS = 1 << 20
#: The factors of a forecast, in the order in which equal ones are listed, and what each is without effect.
FACTORS = {"home_attack": 0.0, "home_defence": 0.0, "away_attack": 0.0, "away_defence": 0.0, "advantage": 0.0, "mean": 1.0, "rho": 0.0}


def fitted(pairings: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[dict | None]:
    """Models of (home, away, rows of SUMS) each, those of as many teams side by side; None where there is no weight or no solution."""
    out, same = [None] * len(pairings), {}
    for i, (home, away, sums) in enumerate(pairings):
        if len(home) and sums[0].max() > 0:
            teams, place = np.unique(np.concatenate((home, away)), return_inverse=True)
            same.setdefault(len(teams), []).append((i, place[: len(home)], place[len(home) :], sums))
    for teams, models in same.items():
        most = max(1, CELLS // ((2 * teams + 1) ** 2 + 13 * max(len(m[1]) for m in models)))
        for first in range(0, len(models), most):
            some = models[first : first + most]
            wide = max(len(m[1]) for m in some)
            home, away, own = np.zeros((len(some), wide), dtype=np.int64), np.zeros((len(some), wide), dtype=np.int64), np.zeros((len(SUMS), len(some), wide))
            for j, (_, h, a, rows) in enumerate(some):
                home[j, : len(h)], away[j, : len(h)], own[:, j, : len(h)] = h, a, rows
            sums = dict(zip(SUMS, own, strict=True))
            try:
                got = [maxima(home, away, sums, teams)]
            except np.linalg.LinAlgError:  # of one of them: each by itself
                got = []
                for j in range(len(some)):
                    try:
                        got.append(maxima(home[j : j + 1], away[j : j + 1], {k: v[j : j + 1] for k, v in sums.items()}, teams))
                    except np.linalg.LinAlgError:
                        got.append((np.full((1, 2 * teams + 1), np.nan), np.full(1, np.nan), np.full(1, np.nan)))
            x, mean, rho = (np.concatenate(c) for c in zip(*got, strict=True))
            for j, (i, *_) in enumerate(some):
                if np.isfinite(mean[j]):
                    out[i] = {"mean": mean[j], "advantage": x[j, 2 * teams], "rho": rho[j], "attack": x[j, :teams].tolist(), "defence": x[j, teams : 2 * teams].tolist()}
    return out


def fits(sums: DataFrame, keys: Sequence[str], spread: bool = True) -> DataFrame:
    """(keys, mean, advantage, rho, attack, defence): a model of each group of pairing_sums(); the last two are maps by team.

    A group without weight, or whose equations have no solution, gives no row. spread: deals the groups out; without it
    they are fitted where their sums lie.
    """
    kinds = {f.name: f.dataType.simpleString() for f in sums.schema.fields}
    model = "mean double, advantage double, rho double, attack array<double>, defence array<double>"

    @F.pandas_udf(model)
    def fit(home: pd.Series, away: pd.Series, values: pd.Series) -> pd.DataFrame:
        got = fitted([(h, a, np.asarray(v, dtype=float).reshape(-1, len(SUMS)).T) for h, a, v in zip(home, away, values, strict=True)])
        empty = {"mean": None, "advantage": None, "rho": None, "attack": None, "defence": None}
        return pd.DataFrame([x or empty for x in got], columns=list(empty))

    # few bytes and much work: as many tasks as the session has partitions, which would else be put together by size
    tasks = int(sums.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = sums.repartition(tasks, *keys) if spread else sums
    own = own.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("home", "away", F.array(*[F.coalesce(F.col(k).cast("double"), F.lit(0.0)) for k in SUMS]).alias("_v")))).alias("_p"))
    # called non-deterministic so that it runs once: the filter on its result would else fit every model a second time
    own = own.withColumn("_m", fit.asNondeterministic()(F.col("_p.home"), F.col("_p.away"), F.flatten(F.col("_p._v")))).where("_m.mean IS NOT NULL")
    teams = F.array_sort(F.array_union(F.col("_p.home"), F.col("_p.away")))
    maps = [F.map_from_arrays(teams, F.col(f"_m.{m}")).cast(f"map<{kinds['home']}, double>").alias(m) for m in ("attack", "defence")]
    return own.select(*keys, "_m.mean", "_m.advantage", "_m.rho", *maps)


def strengths(rows: DataFrame) -> DataFrame:
    """Fixtures beside a model of fits() with the four strengths of their teams; a team that the model doesn't know has 0."""
    of = lambda what, team: F.coalesce(F.try_element_at(F.col(what), F.col(team)), F.lit(0.0))
    return rows.withColumns({f"{side}_{what}": of(what, side) for side in ("home", "away") for what in ("attack", "defence")}).drop("attack", "defence")


def rated(rows: DataFrame) -> DataFrame:
    """strengths() with the goal rates of both sides."""
    rate = lambda x: F.exp(F.least(F.greatest(x, F.lit(LOG_RATE[0])), F.lit(LOG_RATE[1])))
    c = F.col
    return rows.withColumns({"lambda_home": rate(F.ln("mean") + c("home_attack") + c("away_defence") + c("advantage")), "lambda_away": rate(F.ln("mean") + c("away_attack") + c("home_defence"))})


def summed(rows: DataFrame, max_goals: int = 10) -> DataFrame:
    """rated() rows with p_home, p_draw, p_away and _total, the mass of all scores up to max_goals before it is brought to one."""
    c = F.col
    factorials = F.array(*[F.lit(float(math.factorial(k))) for k in range(max_goals + 1)])
    masses = lambda rate: F.transform(factorials, lambda f, k: F.exp(-c(rate)) * F.pow(c(rate), k) / f)
    rows = rows.withColumns({"_h": masses("lambda_home"), "_a": masses("lambda_away")})
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    below = F.transform(c("_h"), lambda p, i: p * total(F.slice(c("_a"), F.lit(1), i)))
    h, a = (lambda k: c("_h")[k]), (lambda k: c("_a")[k])
    # what the correction of the low scores adds to their mass: tau - 1 times the mass
    low = {(0, 0): -c("lambda_home") * c("lambda_away") * c("rho"), (0, 1): c("lambda_home") * c("rho"), (1, 0): c("lambda_away") * c("rho"), (1, 1): -c("rho")}
    extra = {k: h(k[0]) * a(k[1]) * v for k, v in low.items()}
    rows = rows.withColumns({"_home": total(below) + extra[1, 0], "_draw": total(F.zip_with(c("_h"), c("_a"), lambda x, y: x * y)) + extra[0, 0] + extra[1, 1], "_total": total(c("_h")) * total(c("_a")) + sum(extra.values(), F.lit(0.0))})
    return rows.withColumns({"p_home": c("_home") / c("_total"), "p_draw": c("_draw") / c("_total"), "p_away": (c("_total") - c("_home") - c("_draw")) / c("_total")}).drop("_h", "_a", "_home", "_draw")


def exact(home_goals: Column, away_goals: Column) -> Column:
    """The probability of one score, for summed() rows."""
    c = F.col
    mass = lambda rate, k: F.exp(-c(rate)) * F.pow(c(rate), k) / F.factorial(k)
    tau = F.when((home_goals == 0) & (away_goals == 0), 1 - c("lambda_home") * c("lambda_away") * c("rho")).when((home_goals == 0) & (away_goals == 1), 1 + c("lambda_home") * c("rho"))
    tau = tau.when((home_goals == 1) & (away_goals == 0), 1 + c("lambda_away") * c("rho")).when((home_goals == 1) & (away_goals == 1), 1 - c("rho")).otherwise(1.0)
    return mass("lambda_home", home_goals) * mass("lambda_away", away_goals) * tau / c("_total")


def tested(matches: DataFrame, order: Sequence[str], folds: int = 3, gap: int = 0, decays: Sequence[float] = DECAYS, by: Sequence[str] = (), at: str = "match_date", max_goals: int = 10) -> DataFrame:
    """Forecasts of walk_forward() test rows, one for each decay, by models of the fold's training rows (and of the row's competition `by`), with their scores.

    Training rows are summed once by fold and pairing for all decays; only ratios of weights count, so days are counted
    to the newest match of all. Test rows with more than max_goals goals on a side, or without goals, are left out, and
    so are those whose model could not be fitted.
    """
    newest = F.broadcast(matches.agg(F.max(F.to_date(at)).alias("_newest")))
    train, test = walk_forward(matches, order, folds, gap)
    scored = F.col("home_goals").isNotNull() & F.col("away_goals").isNotNull()
    own = train.where(scored).crossJoin(newest)
    keys = ["fold", *by]
    both = own.groupBy(*keys, "home", "away").agg(*[x for k, d in enumerate(decays) for x in _sums(decayed(at, decay=d), f"_{k}")], F.sum(F.col("home_goals") + F.col("away_goals")).alias("goals"), F.count("*").alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(float(d)).alias("decay"), *[F.col(f"{s}_{k}").alias(s) for s in SUMS[:7]]) for k, d in enumerate(decays)]))
    sums = both.select(*keys, "home", "away", "goals", "n", each.alias("_x")).select(*keys, "home", "away", "goals", "n", "_x.*")
    models = fits(sums, [*keys, "decay"])
    few = test.where(scored & (F.col("home_goals") <= max_goals) & (F.col("away_goals") <= max_goals))
    # every test row meets as many models as there are decays
    out = summed(rated(strengths(few.join(models, keys))), max_goals)
    outcome = F.when(F.col("home_goals") > F.col("away_goals"), "home").when(F.col("home_goals") == F.col("away_goals"), "draw").otherwise("away")
    out = out.withColumns({"outcome": outcome, "p_exact": exact(F.col("home_goals"), F.col("away_goals"))}).drop("_total")
    first, second = F.col("p_home") - hit("home"), F.col("p_home") + F.col("p_draw") - hit("home") - hit("draw")
    squares = sum(((F.col(f"p_{o}") - hit(o)) * (F.col(f"p_{o}") - hit(o)) for o in OUTCOMES), F.lit(0.0))
    return out.withColumns({"brier": squares, "rps": (first * first + second * second) / 2, "log_loss_exact": -F.ln(F.greatest("p_exact", F.lit(1e-12)))})


def means(forecasts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean scores of tested() rows by fold, decay or both."""
    return forecasts.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in METRICS])


def tuned(forecasts: DataFrame, decays: Sequence[float], metric: str = "rps") -> DataFrame:
    """Per decay its half-life in days, its mean scores and whether it is chosen: the least mean of the metric, the first given of equals. A decay without forecasts has no scores and is never chosen."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    given = forecasts.sparkSession.createDataFrame([(k, float(d), math.log(2) / d if d > 0 else None) for k, d in enumerate(decays)], "_k int, decay double, half_life_days double")
    # one row per candidate, so one task holds them; the forecasts are made once
    best = F.min(F.when(F.col(metric).isNotNull(), F.struct(metric, "_k"))).over(Window.partitionBy(F.lit(1)))
    rows = F.broadcast(given).join(means(forecasts, ["decay"]), "decay", "full").withColumn("_best", best)
    return rows.where(F.col("_k").isNotNull()).select("decay", "half_life_days", F.coalesce("n", F.lit(0)).cast("long").alias("n"), *METRICS, F.coalesce(F.col("_k") == F.col("_best._k"), F.lit(False)).alias("chosen"))


def decay_comparison(forecasts: DataFrame, decay: float) -> DataFrame:
    """Per score its mean without decay and with one, the difference, and whether decay makes it less."""
    wide = forecasts.agg(*[F.avg(F.when(F.col("decay") == d, F.col(m))).alias(f"{m}_{k}") for m in METRICS for k, d in (("without", 0.0), ("with", decay))])
    long = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_without").alias("without_decay"), F.col(f"{m}_with").alias("with_decay")) for m in METRICS]))
    return wide.select(long.alias("x")).select("x.*").withColumn("delta", F.col("with_decay") - F.col("without_decay")).withColumn("improved", F.col("delta") < 0)


def poisson_count(u: Column, most: int = 12) -> Column:
    """How often a match counts in a resample, from a uniform number: Poisson with mean 1, beyond `most` with a probability under 1e-10."""
    at, steps = 0.0, []
    for k in range(most):
        at += math.exp(-1) / math.factorial(k)
        steps.append(at)
    count = F.lit(most)
    for k in range(most - 1, -1, -1):
        count = F.when(u < steps[k], k).otherwise(count)
    return count


def bootstrapped(matches: DataFrame, fixtures: DataFrame, by: Sequence[str] = (), replicates: int = 200, level: float = 0.95, seed: int = 42, decay: float | None = None, at: str = "match_date", max_goals: int = 10) -> DataFrame:
    """Per fixture (by, home, away) the interval of each outcome's probability and of both goal rates over refits to resampled matches.

    A match counts in a replicate as often as a hash of (seed, replicate, match_id) says, Poisson with mean 1, so a lost
    task draws the same again and no row is moved to be resampled; with many matches that is drawing with replacement.
    Replicates whose model cannot be fitted are counted in `failed`; fixtures of competitions without models have no row.
    """
    if replicates < 10 or not 0 < level < 1:
        raise ValueError("at least 10 replicates, and a level between 0 and 1")
    newest = F.broadcast(matches.agg(F.max(F.to_date(at)).alias("_newest")))
    if by:  # dealt out before they are drawn: the resamples of a competition are summed and fitted where its matches lie
        matches = matches.repartition(int(matches.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
    drawn = matches.crossJoin(newest).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    drawn = drawn.withColumn("_times", poisson_count(uniform(F.lit(seed), F.col("replicate"), F.col("match_id")))).where("_times > 0")
    models = fits(pairing_sums(drawn, decayed(at, decay), [*by, "replicate"], F.col("_times")), [*by, "replicate"], spread=not by)
    both = fixtures.select(*by, "home", "away").distinct()
    rows = summed(rated(strengths(both.join(models, list(by)) if by else both.crossJoin(models))), max_goals)
    low = (1 - level) / 2
    names = {"p_home": "home", "p_draw": "draw", "p_away": "away", "lambda_home": "home_rate", "lambda_away": "away_rate"}
    # one row per replicate and fixture: exact percentiles of a bounded group
    ends = [F.percentile(c, F.lit(p)).alias(f"{n}_{e}") for c, n in names.items() for e, p in (("low", low), ("high", 1 - low))]
    return rows.groupBy(*by, "home", "away").agg(F.count("*").alias("replicates"), *ends).withColumn("failed", replicates - F.col("replicates"))


def attributed(fixtures: DataFrame, max_goals: int = 10) -> DataFrame:
    """Seven rows per fixture: the chance of a home win, that with one factor without effect, their difference, and the factor's place by size of the difference.

    fixtures: any keys, strengths() columns, mean, advantage and rho, one row per forecast.
    """
    keys = [c for c in fixtures.columns if c not in FACTORS]
    case = lambda name: F.struct(F.lit(name).alias("factor"), F.lit(list(FACTORS).index(name) if name in FACTORS else -1).alias("_k"), *[(F.lit(neutral) if f == name else F.col(f)).alias(f) for f, neutral in FACTORS.items()])
    # the forecast itself and seven cases, one beside the other in one row
    cases = F.array(*[case(n) for n in ("", *FACTORS)])
    rows = fixtures.withColumn("_row", F.monotonically_increasing_id()).select("_row", *keys, F.explode(cases).alias("_x")).select("_row", *keys, "_x.*")
    p = summed(rated(rows), max_goals).select("_row", *keys, "factor", "_k", "p_home", "p_draw", "p_away")
    of = Window.partitionBy("_row")
    base = lambda c: F.max(F.when(F.col("factor") == "", F.col(c))).over(of)
    p = p.withColumns({"home_win": base("p_home"), "draw": base("p_draw"), "away_win": base("p_away")}).where("factor <> ''").withColumnRenamed("p_home", "neutral_home_win")
    change = F.col("home_win") - F.col("neutral_home_win")
    p = p.withColumn("delta", F.when(F.abs(change) < 1e-12, F.lit(0.0)).otherwise(change))  # rounding alone is no effect
    place = F.row_number().over(of.orderBy(F.desc(F.round(F.abs("delta"), 12)), "_k"))
    return p.select(*keys, "home_win", "draw", "away_win", "factor", "neutral_home_win", "delta", place.alias("place"))

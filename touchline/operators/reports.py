"""Reports on scored forecasts: report card, stress tests, intervals, staleness, folds, feature importance, heat maps, team profiles, head-to-head corrections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .backtest import OUTCOMES, equal_counts, error_bins, predicted, scored
from .ranges import joined
from .stats import quantile_bins

#: What counts as a full or an empty mark in each dimension, its weight, and the least marks of the grades.
FULL_ACCURACY, WORST_ECE, WORST_BRIER, WORST_RPS, WORST_GAP, WORST_SPREAD = 0.55, 0.20, 0.33, 0.25, 0.20, 0.15
WEIGHTS = {"accuracy": 0.25, "calibration": 0.20, "discrimination": 0.20, "sharpness": 0.15, "confidence_alignment": 0.10, "stability": 0.10}
GRADES = [(90.0, "A"), (80.0, "B"), (65.0, "C"), (50.0, "D")]
#: Fixed value: the share of a probability, or of its gap, that a stress moves.
SHIFT = 0.2


def grade(score: Column) -> Column:
    return F.coalesce(*[F.when(score >= least, name) for least, name in GRADES], F.lit("F"))


def report_card(df: DataFrame, order: Sequence[str], bins: int = 10) -> DataFrame:
    """(dimension, metric, score, weight) of scored() rows: six marks from 0 to 100. Calibration is the expected error over bins of the top probability, stability the difference of accuracy between the halves in order."""
    marks = lambda x: F.greatest(F.least(x, F.lit(100.0)), F.lit(0.0))
    falls = lambda metric, worst: marks((1 - F.col(metric) / worst) * 100)
    one = df.agg(F.count("*").alias("n"), F.avg("correct").alias("accuracy"), F.avg("brier").alias("brier"), F.avg("rps").alias("rps"), F.abs(F.avg("confidence") - F.avg("correct")).alias("gap"))
    ece = error_bins(df, bins).agg((F.sum(F.col("n") * F.abs("gap")) / F.sum("n")).alias("ece"))
    halves = equal_counts(df, order, 2, ["correct"]).agg((F.max("mean_correct") - F.min("mean_correct")).alias("spread"))
    all_ = one.crossJoin(ece).crossJoin(halves)  # one row each
    parts = {"accuracy": ("accuracy", marks(F.col("accuracy") * 100 / FULL_ACCURACY)), "calibration": ("ece", falls("ece", WORST_ECE)), "discrimination": ("brier", falls("brier", WORST_BRIER)), "sharpness": ("rps", falls("rps", WORST_RPS)), "confidence_alignment": ("gap", falls("gap", WORST_GAP)), "stability": ("spread", F.when(F.col("n") >= 20, falls("spread", WORST_SPREAD)).otherwise(50.0))}
    rows = [F.struct(F.lit(k).alias("dimension"), F.col(m).cast("double").alias("metric"), s.alias("score"), F.lit(WEIGHTS[k]).alias("weight")) for k, (m, s) in parts.items()]
    return all_.where("n > 0").select(F.explode(F.array(*rows)).alias("x")).select("x.*").withColumn("grade", grade(F.col("score")))


def stressed(df: DataFrame, kind: str, share: Column, shift: float = SHIFT) -> DataFrame:
    """Forecasts changed where `share` holds.

    outcome_swap makes home wins away wins; probability_shift moves a part of the home chance to the away side;
    confidence_inflation draws the favoured chance to one, and the others keep their proportion in what is left;
    confidence_deflation draws all to a third.
    """
    p = {o: F.col(f"p_{o}") for o in OUTCOMES}
    if kind == "outcome_swap":
        return df.withColumn("outcome", F.when(share & (F.col("outcome") == "home"), "away").otherwise(F.col("outcome")))
    if kind == "probability_shift":
        new = {"home": p["home"] * (1 - shift), "draw": p["draw"], "away": p["away"] + p["home"] * shift}
    elif kind == "confidence_deflation":
        new = {o: x + (1 / 3 - x) * shift for o, x in p.items()}
    elif kind == "confidence_inflation":
        top, rest = F.greatest(*p.values()), 1 - F.greatest(*p.values())
        left = rest * (1 - shift)
        new = {o: F.when(predicted() == o, top + rest * shift).otherwise(F.coalesce(F.try_divide(left * x, p["home"] + p["draw"] + p["away"] - top), left / 2)) for o, x in p.items()}
    else:
        raise ValueError(f"unknown stress: {kind}")
    return df.withColumns({f"p_{o}": F.when(share, new[o]).otherwise(p[o]) for o in OUTCOMES})


def stress_test(df: DataFrame, kinds: Sequence[str], share: Column) -> DataFrame:
    """Per kind of stress: mean scores before and after and their differences. Kinds are parameters; each is one pass."""
    metrics = ["brier", "rps", "log_loss", "correct"]
    base = scored(df).agg(*[F.avg(m).alias(f"{m}_before") for m in metrics])
    out = None
    for kind in kinds:
        one = scored(stressed(df, kind, share)).agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), *[F.avg(m).alias(f"{m}_after") for m in metrics])
        out = one if out is None else out.unionByName(one)
    return out.crossJoin(base).select("kind", "n", *[c for m in metrics for c in (f"{m}_before", f"{m}_after", (F.col(f"{m}_after") - F.col(f"{m}_before")).alias(f"{m}_change"))])


def interval_report(df: DataFrame, low: Column, high: Column, hit: Column, bins: int) -> DataFrame:
    """Per quantile bin of the top probability: rows, mean, least and most width of the interval, and the share of intervals that hold what came (0 or 1)."""
    rows = quantile_bins(df.withColumns({"_width": high - low, "_in": ((hit >= low) & (hit <= high)).cast("double")}), "confidence", bins)
    return rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg("_width").alias("mean_width"), F.min("_width").alias("least_width"), F.max("_width").alias("most_width"), F.avg("_in").alias("coverage"), F.avg("confidence").alias("mean_confidence"))


def staleness(df: DataFrame, by: Sequence[str], at: str, reference: Column, fresh: int, stale: int) -> DataFrame:
    """Per group of rows with a date: their number, first and last date, the last one's age in days at the reference (0 if it lies after that), and whether it is fresh, aging or stale."""
    out = df.where(F.to_date(at).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.min(F.to_date(at)).alias("first"), F.max(F.to_date(at)).alias("last"))
    age = F.greatest(F.datediff(reference, "last"), F.lit(0))
    return out.withColumns({"age_days": age, "status": F.when(age <= fresh, "fresh").when(age <= stale, "aging").otherwise("stale")})


def fold_report(df: DataFrame, fold: str, least: int) -> DataFrame:
    """Per fold of `least` rows or more: mean scores, beside the population deviations of the folds' accuracy, Brier and ranked probability scores and how stable that of accuracy says they are."""
    per = df.groupBy(fold).agg(F.count("*").alias("n"), F.avg("brier").alias("brier"), F.avg("rps").alias("rps"), F.avg("correct").alias("accuracy"), F.avg("confidence").alias("confidence")).where(F.col("n") >= least)
    spread = per.agg(*[F.stddev_pop(c).alias(f"{c}_std") for c in ("accuracy", "brier", "rps")])
    stable = F.when(F.col("accuracy_std") < 0.03, "stable").when(F.col("accuracy_std") < 0.08, "moderate").otherwise("unstable")
    return per.crossJoin(spread).withColumn("stability", stable)  # one row


def feature_importance(df: DataFrame, features: Sequence[str], bins: int, least: int) -> DataFrame:
    """Per numeric feature: the deviation of mean Brier scores between its quantile bins, weighted by their rows; bins of fewer than `least` rows are left out, and so are features with fewer than two bins then."""
    out = None
    for f in features:  # a list of columns
        b = quantile_bins(df.where(F.col(f).isNotNull()).select(F.col(f).cast("double").alias("x"), "brier"), "x", bins).groupBy("bin").agg(F.count("*").alias("n"), F.avg("brier").alias("b")).where(F.col("n") >= least)
        mean = F.sum(F.col("n") * F.col("b")) / F.sum("n")
        one = b.agg(F.lit(f).alias("feature"), F.count("*").alias("bins"), F.sqrt(F.greatest(F.sum(F.col("n") * F.col("b") * F.col("b")) / F.sum("n") - mean * mean, F.lit(0.0))).alias("importance"))
        out = one if out is None else out.unionByName(one)
    return out.where("bins >= 2")


def drift_heatmap(df: DataFrame, at: str, days: int, bins: int, least: int) -> DataFrame:
    """Per window of so many days and quantile bin of the top probability: rows, confidence, accuracy and their gap; small cells are left out."""
    start = df.agg(F.min(F.to_date(at)).alias("_start"))
    rows = quantile_bins(df.crossJoin(F.broadcast(start)).withColumn("window", F.floor(F.datediff(F.to_date(at), "_start") / days)), "confidence", bins)
    return rows.groupBy("window", "bin").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"), F.avg("correct").alias("accuracy")).where(F.col("n") >= least).withColumn("gap", F.col("confidence") - F.col("accuracy"))


def sides(df: DataFrame) -> DataFrame:
    """Two rows per scored() forecast: team, side, its chance, whether it won, its goals and the other side's."""
    one = lambda us, them: F.struct(F.col(us).alias("team"), F.lit(us).alias("side"), F.col(f"p_{us}").alias("chance"), (F.col("outcome") == us).cast("int").alias("won"), F.col(f"{us}_goals").alias("goals_for"), F.col(f"{them}_goals").alias("goals_against"))
    own = ["match_id", "match_date", "brier", "correct", "confidence"]
    return df.select(*own, F.explode(F.array(one("home", "away"), one("away", "home"))).alias("x")).select(*own, "x.*")


def team_profiles(df: DataFrame, n: int, least: int) -> DataFrame:
    """Per team of `least` matches or more: accuracy, Brier score, goals, clean sheets and matches in which both scored, share of wins less mean chance and what that says, the five most common scores, and the ids of its n worst forecasts and of its n best among the correct ones."""
    rows = sides(df)
    share = lambda c: F.avg(c.cast("double"))
    per = rows.groupBy("team").agg(F.count("*").alias("n"), F.avg("correct").alias("accuracy"), F.avg("brier").alias("brier"), F.avg("goals_for").alias("goals_for"), F.avg("goals_against").alias("goals_against"),
                                   share(F.col("goals_against") == 0).alias("clean_sheets"), share((F.col("goals_for") > 0) & (F.col("goals_against") > 0)).alias("both_scored"), (F.avg("won") - F.avg("chance")).alias("overperformance")).where(F.col("n") >= least)
    over = F.col("overperformance")
    per = per.withColumn("assessment", F.when(over > 0.05, "overperformer").when(over < -0.05, "underperformer").otherwise("aligned"))
    # a team has few different scores
    scores = rows.groupBy("team", F.concat_ws("-", "goals_for", "goals_against").alias("score")).agg(F.count("*").alias("k"))
    common = scores.groupBy("team").agg(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), "score"))).alias("x"))
    per = joined(per, common.select("team", F.concat_ws("|", F.transform(F.slice("x", 1, 5), lambda x: F.concat(x["score"], F.lit(":"), (-x["k"]).cast("string")))).alias("common_scores")), ["team"])
    for name, order, some in (("best", F.col("brier"), rows.where("correct = 1")), ("worst", -F.col("brier"), rows)):
        # n rows of each day's worth of matches are enough for n of the team: the second step sorts few
        key = F.struct(order.alias("b"), F.col("match_id").alias("id"))
        few = some.withColumn("_key", key).withColumn("_rn", F.row_number().over(Window.partitionBy("team", F.year("match_date"), F.dayofyear("match_date")).orderBy("_key"))).where(F.col("_rn") <= n)
        top = few.groupBy("team").agg(F.concat_ws("|", F.transform(F.slice(F.array_sort(F.collect_list("_key")), 1, n), lambda x: x["id"].cast("string"))).alias(name))
        per = joined(per, top, ["team"], "left").withColumn(name, F.coalesce(name, F.lit("")))
    return per


def team_windows(df: DataFrame, days: int, least: int, side: str = "home") -> DataFrame:
    """Per team on one side and window of so many days from its own first match there, of `least` matches or more: matches, accuracy, Brier score and confidence. Rows without a date are left out."""
    rows = sides(df).where((F.col("side") == side) & F.to_date("match_date").isNotNull())
    first = rows.groupBy("team").agg(F.min(F.to_date("match_date")).alias("_first"))
    rows = joined(rows, first, ["team"]).withColumn("window", F.floor(F.datediff(F.to_date("match_date"), "_first") / days))
    return rows.groupBy("team", "window").agg(F.count("*").alias("n"), F.avg("correct").alias("accuracy"), F.avg("brier").alias("brier"), F.avg("confidence").alias("confidence")).where(F.col("n") >= least)


def team_drift(df: DataFrame, days: int, least: int, side: str = "home") -> DataFrame:
    """Per team on one side: its team_windows(), the latest one's Brier score against the mean of those before, the relative change, whether that is over 5 %, and the trend; teams without windows have insufficient data."""
    w = team_windows(df, days, least, side).groupBy("team").agg(F.count("*").alias("windows"), F.max_by("brier", "window").alias("latest_brier"), F.sum("brier").alias("_sum"))
    out = joined(sides(df).where((F.col("side") == side) & F.to_date("match_date").isNotNull()).groupBy("team").agg(F.count("*").alias("n")), w, ["team"], "left")
    out = out.withColumns({"windows": F.coalesce("windows", F.lit(0)).cast("long"), "latest_brier": F.coalesce("latest_brier", F.lit(0.0))})
    history = F.when(F.col("windows") >= 2, (F.col("_sum") - F.col("latest_brier")) / (F.col("windows") - 1)).otherwise(F.col("latest_brier"))
    out = out.withColumn("historical_brier", history).drop("_sum")
    out = out.withColumn("relative_change", F.when((F.col("historical_brier") > 0) & (F.col("windows") >= 2), (F.col("latest_brier") - F.col("historical_brier")) / F.col("historical_brier")).otherwise(0.0))
    change = F.col("relative_change")
    trend = F.when(F.col("windows") < 2, "insufficient_data").when(change < -0.005, "improving").when(change > 0.005, "degrading").otherwise("stable")
    return out.withColumns({"drifted": (F.abs(change) > 0.05) & (F.col("windows") >= 2), "trend": trend})


def h2h_corrected(df: DataFrame, meetings: DataFrame, most: float, least: int, blend: float) -> DataFrame:
    """Forecasts drawn to the shares of past meetings (home, away, n, s_home, s_draw, s_away) by `blend`, no probability by more than `most`; pairs of fewer than `least` meetings stay."""
    out = joined(df, meetings.select("home", "away", F.col("n").alias("_met"), *[F.col(f"s_{o}").alias(f"_s_{o}") for o in OUTCOMES]), ["home", "away"], "left")
    use = F.coalesce(F.col("_met") >= least, F.lit(False))
    moved = {o: F.col(f"p_{o}") + F.greatest(F.least(blend * (F.col(f"_s_{o}") - F.col(f"p_{o}")), F.lit(most)), F.lit(-most)) for o in OUTCOMES}
    moved = {o: F.greatest(x, F.lit(0.0)) for o, x in moved.items()}
    total = sum(moved.values(), F.lit(0.0))
    new = {f"p_{o}": F.when(use, moved[o] / total).otherwise(F.col(f"p_{o}")) for o in OUTCOMES}
    return out.withColumns(new | {"corrected": use}).drop("_met", *[f"_s_{o}" for o in OUTCOMES])

"""Scoring of probability forecasts: proper scores, calibration, drift, strata, streaks and stakes.

Forecasts have p_home, p_draw, p_away and outcome, one of home, draw, away.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import in_blocks, peaks, running
from .stats import equal_bin

OUTCOMES = ["home", "draw", "away"]


def hit(o: str) -> Column:
    return (F.col("outcome") == o).cast("double")


def top() -> Column:
    return F.greatest(*[F.col(f"p_{o}") for o in OUTCOMES])


def predicted() -> Column:
    return F.when(F.col("p_home") == top(), "home").when(F.col("p_draw") == top(), "draw").otherwise("away")


def scored(df: DataFrame) -> DataFrame:
    """Per forecast: Brier, ranked probability and log scores, confidence, entropy over ln 3, margin, whether it was correct."""
    p = {o: F.col(f"p_{o}") for o in OUTCOMES}
    brier = sum((p[o] - hit(o)) * (p[o] - hit(o)) for o in OUTCOMES)
    first, second = p["home"] - hit("home"), p["home"] + p["draw"] - hit("home") - hit("draw")
    own = F.when(F.col("outcome") == "home", p["home"]).when(F.col("outcome") == "draw", p["draw"]).otherwise(p["away"])
    entropy = sum(F.when(x > 0, -x * F.ln(x)).otherwise(0.0) for x in p.values()) / F.ln(F.lit(3.0))
    ranked = F.sort_array(F.array(*p.values()), asc=False)
    return df.withColumns({"brier": brier, "rps": (first * first + second * second) / 2, "log_loss": -F.ln(F.greatest(own, F.lit(1e-12))), "confidence": top(), "entropy": entropy, "margin": ranked[0] - ranked[1], "correct": (predicted() == F.col("outcome")).cast("int")})


def summary(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Means of the scores of scored() rows, by group."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg("brier").alias("brier"), F.avg("rps").alias("rps"), F.avg("log_loss").alias("log_loss"), F.avg("correct").alias("accuracy"), F.avg("confidence").alias("confidence"))


def reliability(df: DataFrame, n_bins: int) -> DataFrame:
    """Per outcome and bin of its probability: count, mean probability, observed share."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(o).alias("class"), F.col(f"p_{o}").alias("p"), hit(o).alias("y")) for o in OUTCOMES])).alias("x")).select("x.*")
    return long.withColumn("bin", equal_bin(F.col("p"), 0.0, 1.0, n_bins)).groupBy("class", "bin").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("observed"))


def brier_parts(df: DataFrame, n_bins: int = 10) -> DataFrame:
    """Reliability, resolution and uncertainty of the three probabilities together, over bins of that of a home win."""
    bins = df.withColumn("bin", equal_bin(F.col("p_home"), 0.0, 1.0, n_bins)).groupBy("bin").agg(F.count("*").alias("n"), *[F.avg(f"p_{o}").alias(f"p_{o}") for o in OUTCOMES], *[F.avg(hit(o)).alias(f"y_{o}") for o in OUTCOMES])
    all_ = Window.partitionBy(F.lit(0))  # at most n_bins rows
    w = F.col("n") / F.sum("n").over(all_)
    bins = bins.withColumns({"w": w} | {f"base_{o}": F.sum(F.col("n") * F.col(f"y_{o}")).over(all_) / F.sum("n").over(all_) for o in OUTCOMES})
    square = lambda a, b: sum((F.col(f"{a}_{o}") - F.col(f"{b}_{o}")) * (F.col(f"{a}_{o}") - F.col(f"{b}_{o}")) for o in OUTCOMES)
    return bins.agg(F.sum(F.col("w") * square("p", "y")).alias("reliability"), F.sum(F.col("w") * square("y", "base")).alias("resolution"), F.max(sum(F.col(f"base_{o}") * (1 - F.col(f"base_{o}")) for o in OUTCOMES)).alias("uncertainty"))


def time_windows(df: DataFrame, at: str, days: int, values: Sequence[str]) -> DataFrame:
    """Means over half-open windows of so many days from the first date of the data; empty windows have no row."""
    start = df.agg(F.min(F.to_date(at)).alias("_start"))
    rows = df.crossJoin(F.broadcast(start)).withColumn("window", F.floor(F.datediff(F.to_date(at), "_start") / days))
    return rows.groupBy("window").agg(F.count("*").alias("n"), *[F.avg(v).alias(f"mean_{v}") for v in values])


def equal_counts(df: DataFrame, order: Sequence[str], k: int, values: Sequence[str]) -> DataFrame:
    """Means over k chunks of equal count in order; the last takes the rest. Ranks come from counts by day, then rows within a day."""
    days = df.groupBy(order[0]).agg(F.count("*").alias("_c"))
    w = Window.orderBy(order[0]).rowsBetween(Window.unboundedPreceding, -1)
    before = days.select(F.col(order[0]).alias("_day"), F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_before"), F.sum("_c").over(Window.partitionBy(F.lit(0))).alias("_n"))
    rows = df.join(before, F.col(order[0]) == F.col("_day")).withColumn("_i", F.col("_before") + F.row_number().over(Window.partitionBy(order[0]).orderBy(*order[1:])) - 1)
    rows = rows.withColumn("chunk", F.least(F.floor(F.col("_i") / F.floor(F.col("_n") / k)), F.lit(k - 1)).cast("int"))
    return rows.groupBy("chunk").agg(F.count("*").alias("n"), *[F.avg(v).alias(f"mean_{v}") for v in values])


def value_bets(df: DataFrame, odds: dict[str, Column], least: float) -> DataFrame:
    """Per forecast and outcome with an edge: implied probability without overround, expected value and Kelly share."""
    over = sum(1 / o for o in odds.values())
    rows = [F.struct(F.lit(o).alias("bet"), F.col(f"p_{o}").alias("p"), odds[o].alias("odds"), (1 / odds[o] / over).alias("implied")) for o in OUTCOMES]
    out = df.withColumn("_b", F.explode(F.array(*rows))).select(*df.columns, "_b.*")
    ev = F.col("p") * F.col("odds") - 1
    return out.withColumns({"ev": ev, "edge": F.col("p") - F.col("implied"), "kelly": F.greatest(ev / (F.col("odds") - 1), F.lit(0.0))}).where(F.col("ev") >= least)


def drawdown(df: DataFrame, by: Sequence[str], order: Sequence[str], profit: Column) -> DataFrame:
    """Running profit of flat stakes and its fall from the peak so far, which starts at 0."""
    out = peaks(running(df, by, order, {"profit": profit}), by, order, "profit", "_peak_profit")
    return out.withColumn("drawdown", F.greatest("_peak_profit", F.lit(0.0)) - F.col("profit")).drop("_peak_profit", "_range", "_i")


def difficulty(easy: float, hard: float) -> Column:
    return F.when(top() >= easy, "easy").when(top() < hard, "hard").otherwise("medium")


def scoreline(most: int) -> Column:
    cap = lambda c: F.when(F.col(c) >= most, F.lit(f"{most}+")).otherwise(F.col(c).cast("string"))
    return F.concat_ws("-", cap("home_goals"), cap("away_goals"))


def expanding_folds(df: DataFrame, order: Sequence[str], k: int, gap: int) -> DataFrame:
    """(fold, train_end, test_start, test_end) row numbers of expanding folds: each tests on n // (k + 1) rows after a gap."""
    size = df.agg(F.count("*").alias("n")).withColumn("size", F.floor(F.col("n") / (k + 1)))
    folds = size.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k))))
    return folds.select("fold", (F.col("size") * F.col("fold")).alias("train_end"), (F.col("size") * F.col("fold") + gap).alias("test_start"), F.least(F.col("size") * (F.col("fold") + 1) + gap, F.col("n")).alias("test_end"))


def outcome_shares(df: DataFrame) -> DataFrame:
    """Per outcome: the share of forecasts that favour it, the share in which it came, and the difference."""
    both = df.select(F.explode(F.array(F.struct(predicted().alias("class"), F.lit(1).alias("p"), F.lit(0).alias("y")), F.struct(F.col("outcome").alias("class"), F.lit(0).alias("p"), F.lit(1).alias("y")))).alias("x")).select("x.*")
    counts = both.groupBy("class").agg(F.sum("p").alias("_p"), F.sum("y").alias("_y"))
    total = F.sum("_y").over(Window.partitionBy(F.lit(0)))  # at most three rows
    return counts.select("class", (F.col("_p") / total).alias("predicted"), (F.col("_y") / total).alias("actual"), ((F.col("_p") - F.col("_y")) / total).alias("bias"))


def error_bins(df: DataFrame, n_bins: int) -> DataFrame:
    """Accuracy, confidence and Brier score of scored() rows by equal bins of the top probability, from 1/3 to 1."""
    return summary(df.withColumn("bin", equal_bin(F.col("confidence"), 1 / 3, 1.0, n_bins)), ["bin"]).withColumn("gap", F.col("confidence") - F.col("accuracy"))


def compared(models: dict[str, DataFrame], key: str) -> DataFrame:
    """summary() by model over the forecasts that every model has; a key counts once per model."""
    rows = None
    for name, df in models.items():
        own = scored(df).select(F.lit(name).alias("model"), key, "brier", "rps", "log_loss", "correct", "confidence")
        rows = own if rows is None else rows.unionByName(own)
    shared = rows.groupBy(key).agg(F.count_distinct("model").alias("_n")).where(F.col("_n") == len(models)).select(key)
    return summary(rows.dropDuplicates(["model", key]).join(shared, key, "left_semi"), ["model"])


def anomalies(df: DataFrame, entropy: float, over: float, under: float) -> DataFrame:
    """scored() rows with the reasons that make them stand out: no preference, sure and wrong, unsure and right."""
    flags = [F.when(F.col("entropy") >= entropy, F.lit("high_entropy")), F.when((F.col("confidence") >= over) & (F.col("correct") == 0), F.lit("overconfident")), F.when((F.col("confidence") <= under) & (F.col("correct") == 1), F.lit("underconfident"))]
    return df.withColumn("reasons", F.concat_ws("|", *flags)).where("reasons <> ''")


def trajectory(df: DataFrame, by: Sequence[str], order: Sequence[str], values: Sequence[str], n: int) -> DataFrame:
    """Running means of values, which aren't null, in order, and means over the last n rows."""
    rows = running(df, by, order, {f"cum_{v}": F.col(v).cast("double") for v in values})
    rows = in_blocks(rows.withColumns({f"cum_{v}": F.col(f"cum_{v}") / (F.col("_i") + 1) for v in values}), n - 1)
    last = Window.partitionBy(*by, "_block").orderBy("_i").rowsBetween(1 - n, 0)
    return rows.withColumns({f"last_{n}_{v}": F.avg(v).over(last) for v in values}).where("_own").drop("_block", "_own", "_range", "_i")

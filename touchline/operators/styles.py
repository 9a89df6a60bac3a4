"""Styles over seasons and beside each other: evolution, drift neighbours, match-ups, action profiles, cross-league tiers, style matches of targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import joined
from .stats import cosine, percentiles, wavg, zscored

#: Standard deviations below which sides are even, and the relative change that is a trend.
EVEN, CHANGE = 0.15, 0.05


def profiles(df: DataFrame, by: Sequence[str], values: Sequence[str], weight: str, least: float = 0.0) -> DataFrame:
    """Means of the values by weight per group, over rows of weight `least` or more, and the sum of the weights."""
    return df.where(F.col(weight) >= least).groupBy(*by).agg(*[wavg(v, weight).alias(v) for v in values], F.sum(weight).alias("weight"))


def evolution(df: DataFrame, by: Sequence[str], season: str, value: str) -> DataFrame:
    """Per group: slope and R2 over the seasons of the mean and the median of value, and a label by the relative change of the median from the first season to the last."""
    per = df.groupBy(*by, season).agg(F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median"))
    out = per.groupBy(*by).agg(F.count("*").alias("seasons"), *[f(m, season).alias(f"{m}_{n}") for m in ("mean", "median") for n, f in (("slope", F.regr_slope), ("r2", F.regr_r2))], F.min_by("median", season).alias("_first"), F.max_by("median", season).alias("_last"))
    change = F.try_divide(F.col("_last") - F.col("_first"), F.abs("_first"))
    label = F.when(F.col("seasons") < 2, "insufficient").when(change > CHANGE, "increasing").when(change < -CHANGE, "decreasing").otherwise("stable")
    many = F.col("seasons") >= 2
    return out.withColumns({"label": label} | {f"{m}_{n}": F.when(many, F.col(f"{m}_{n}")) for m in ("mean", "median") for n in ("slope", "r2")}).drop("_first", "_last")


def drift_neighbours(df: DataFrame, team: str, league: str, season: str, values: Sequence[str], seasons: int, n: int) -> DataFrame:
    """(team, neighbour, similarity, rank): teams of one league whose slopes over the seasons point the same way, by cosine; a league's teams are few."""
    slopes = df.groupBy(league, team).agg(F.count_distinct(season).alias("_n"), F.array(*[F.coalesce(F.regr_slope(v, season), F.lit(0.0)) for v in values]).alias("_v")).where(F.col("_n") >= seasons)
    pairs = slopes.alias("a").join(slopes.alias("b"), [F.col(f"a.{league}") == F.col(f"b.{league}"), F.col(f"a.{team}") != F.col(f"b.{team}")])
    out = pairs.select(F.col(f"a.{team}").alias(team), F.col(f"b.{team}").alias("neighbour"), cosine(F.col("a._v"), F.col("b._v")).alias("similarity"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(team).orderBy(F.desc("similarity"), "neighbour"))).where(F.col("rank") <= n)


def matchups(teams: DataFrame, fixtures: DataFrame, team: str, values: Sequence[str]) -> DataFrame:
    """fixtures (home, away) with the difference of each z-scored value, who has the advantage in it, and the distance of the two styles."""
    z = zscored(teams.select(team, *values), values)
    side = lambda s: z.select(F.col(team).alias(s), *[F.col(f"z_{v}").alias(f"_{s}_{v}") for v in values])
    out = fixtures.join(side("home"), "home").join(side("away"), "away")
    d = {v: F.col(f"_home_{v}") - F.col(f"_away_{v}") for v in values}
    new = {f"delta_{v}": x for v, x in d.items()} | {f"advantage_{v}": F.when(F.abs(x) < EVEN, "even").when(x > 0, "home").otherwise("away") for v, x in d.items()}
    new["distance"] = F.sqrt(sum((x * x for x in d.values()), F.lit(0.0)))
    return out.withColumns(new).drop(*[f"_{s}_{v}" for s in ("home", "away") for v in values])


def action_percentiles(df: DataFrame, by: Sequence[str], key: str, values: Sequence[str]) -> DataFrame:
    """(by, key, action, value, percentile, quartile): mid-rank percentiles of each value within the group and the quartile's name."""
    long = df.select(*by, key, F.explode(F.array(*[F.struct(F.lit(v).alias("action"), F.col(v).cast("double").alias("value")) for v in values])).alias("x")).select(*by, key, "x.*")
    out = percentiles(long, [*by, "action"], "value").withColumn("percentile", F.col("pct_mid"))
    quartile = F.when(F.col("percentile") >= 75, "top").when(F.col("percentile") >= 50, "upper").when(F.col("percentile") >= 25, "lower").otherwise("bottom")
    return out.select(*by, key, "action", "value", "percentile", quartile.alias("quartile"))


def alike(df: DataFrame, by: Sequence[str], key: str, values: Sequence[str], n: int) -> DataFrame:
    """(key, neighbour, similarity, rank): the n profiles of the group whose raw vectors point the same way; profiles of a group are few."""
    v = df.select(*by, key, F.array(*[F.col(x).cast("double") for x in values]).alias("_v"))
    other = v.select(*by, F.col(key).alias("neighbour"), F.col("_v").alias("_w"))
    out = v.join(other, list(by)) if by else v.crossJoin(F.broadcast(other))
    out = out.where(F.col(key) != F.col("neighbour")).select(key, "neighbour", cosine(F.col("_v"), F.col("_w")).alias("similarity"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("similarity"), "neighbour"))).where(F.col("rank") <= n)


def target_matches(players: DataFrame, targets: DataFrame, values: Sequence[str], n: int) -> DataFrame:
    """(team, position, player, similarity, rank): of the players wanted for a team and position, those most like the team's own best there. players: player, team, position, score; targets: team, position, player."""
    best = players.groupBy("team", "position").agg(F.max_by(F.array(*[F.col(v).cast("double") for v in values]), F.struct("score", -F.col("player"))).alias("_own"))
    vector = players.select("player", F.array(*[F.col(v).cast("double") for v in values]).alias("_v"))
    out = joined(targets.join(vector, "player"), best, ["team", "position"]).withColumn("similarity", cosine(F.col("_own"), F.col("_v")))
    w = Window.partitionBy("team", "position").orderBy(F.desc("similarity"), "player")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("team", "position", "player", "similarity", "rank")

"""Players over their seasons and beside their peers: peaks, phases, changes, risers and decliners, role fit, peer groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import joined, value_ranks
from .stats import cosine, fit_score, zscored

#: Minutes of a season that may be a peak, seasons around it that are its prime, and the fall that is a decline.
PEAK_MINUTES, PRIME, DECLINE = 900, 1, 0.10


def trajectory(df: DataFrame, player: str, season: str, score: str, minutes: str, floor: float = PEAK_MINUTES) -> DataFrame:
    """Per player: seasons, mean, least and most score, population spread, slope over the season's number, minutes, and the peak.

    The peak is the best season of `floor` minutes or more, the earliest of equals; without one, the best of all.
    A player's seasons are few, so one shuffle by player serves the order and the sums.
    """
    w = Window.partitionBy(player).orderBy(season)
    rows = df.withColumn("_i", F.row_number().over(w) - 1)
    best = lambda c: F.max_by(F.col(season), F.when(c & F.col(score).isNotNull(), F.struct(F.col(score), -F.col("_i"))))
    enough = F.coalesce(F.col(minutes), F.lit(0)) >= floor
    out = rows.groupBy(player).agg(F.count("*").alias("n_seasons"), F.avg(score).alias("mean_score"), F.min(score).alias("least"), F.max(score).alias("most"), F.coalesce(F.stddev_pop(score), F.lit(0.0)).alias("spread"), F.regr_slope(score, "_i").alias("slope"), F.sum(F.coalesce(F.col(minutes), F.lit(0))).alias("minutes"), best(enough).alias("_peak"), best(F.lit(True)).alias("_any"))
    return out.withColumn("peak", F.coalesce("_peak", "_any")).drop("_peak", "_any")


def phases(df: DataFrame, player: str, season: str, score: str, minutes: str, floor: float = PEAK_MINUTES) -> DataFrame:
    """Each season with its phase: prospect before the peak's neighbours, prime among them, then decline or veteran by how far the last season fell from the peak."""
    w = Window.partitionBy(player).orderBy(season)
    all_ = Window.partitionBy(player)
    rows = df.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(all_)})
    enough = F.coalesce(F.col(minutes), F.lit(0)) >= floor
    at = lambda c: F.max_by(F.col("_i"), F.when(c & F.col(score).isNotNull(), F.struct(F.col(score), -F.col("_i")))).over(all_)
    rows = rows.withColumn("_peak", F.coalesce(at(enough), at(F.lit(True))))
    top, last = F.max(F.when(F.col("_i") == F.col("_peak"), F.col(score))).over(all_), F.max(F.when(F.col("_i") == F.col("_n") - 1, F.col(score))).over(all_)
    fall = F.when(top > 0, (top - F.coalesce(last, F.lit(0.0))) / top).otherwise(0.0)
    phase = F.when(F.col("_i") < F.col("_peak") - PRIME, "prospect").when(F.col("_i") <= F.col("_peak") + PRIME, "prime").when(fall >= DECLINE, "decline").otherwise("veteran")
    return rows.withColumn("phase", phase).drop("_i", "_n", "_peak")


def changes(df: DataFrame, player: str, season: str, values: Sequence[str]) -> DataFrame:
    """Per season but a player's first: the season before and the change of each value."""
    w = Window.partitionBy(player).orderBy(season)
    rows = df.withColumns({"from_season": F.lag(season).over(w)} | {f"{v}_change": F.col(v) - F.lag(v).over(w) for v in values})
    return rows.where(F.col("from_season").isNotNull()).select(player, "from_season", F.col(season).alias("to_season"), *[f"{v}_change" for v in values])


def moves(df: DataFrame, player: str, season: str, position: str) -> DataFrame:
    """Seasons in which a player's position, given both times, is another than in the season before."""
    w = Window.partitionBy(player).orderBy(season)
    rows = df.withColumns({"from_season": F.lag(season).over(w), "from_position": F.lag(position).over(w)})
    return rows.where((F.col("from_position") != "") & (F.col(position) != "") & (F.col("from_position") != F.col(position))).select(player, "from_season", F.col(season).alias("to_season"), "from_position", F.col(position).alias("to_position"))


def watchlist(df: DataFrame, player: str, season: str, score: str, minutes: str, seasons: int, floor: float, rise: float, fall: float, n: int) -> DataFrame:
    """The n steepest risers and decliners: players of enough seasons, and enough minutes in the last, by the slope of score over the season's number."""
    rows = df.withColumn("_i", F.row_number().over(Window.partitionBy(player).orderBy(season)) - 1)
    per = rows.groupBy(player).agg(F.count("*").alias("n_seasons"), F.regr_slope(score, "_i").alias("slope"), F.max_by(minutes, "_i").alias("_last"), F.max_by(score, "_i").alias("latest"))
    per = per.where((F.col("n_seasons") >= seasons) & (F.col("_last") >= floor)).drop("_last")
    ends = [per.where(F.col("slope") >= rise).orderBy(F.desc("slope"), player).limit(n).withColumn("kind", F.lit("riser")), per.where(F.col("slope") <= fall).orderBy("slope", player).limit(n).withColumn("kind", F.lit("decliner"))]
    return ends[0].unionByName(ends[1])


def role_fit(df: DataFrame, player: str, position: str, values: Sequence[str], least: int) -> DataFrame:
    """(player, role, fit): each player's z-scores against the mean z-scores of every position of `least` players or more, by cosine, from 0 to 100."""
    z = zscored(df, values)
    centres = z.groupBy(F.col(position).alias("role")).agg(F.count("*").alias("_n"), *[F.avg(f"z_{v}").alias(f"_c_{v}") for v in values]).where(F.col("_n") >= least)
    pairs = z.crossJoin(F.broadcast(centres))  # one row per position
    return pairs.select(player, "role", fit_score(cosine(F.array(*[f"z_{v}" for v in values]), F.array(*[f"_c_{v}" for v in values]))).alias("fit"))


def peer_percentiles(df: DataFrame, player: str, by: Sequence[str], weights: dict[str, float], least: int) -> DataFrame:
    """Per player: peers (rows of equal `by`), strict percentile and rank in each metric, and their weighted mean; metrics without a value don't count. Small groups are left out."""
    sizes = df.groupBy(*by).agg(F.count("*").alias("peers")).where(F.col("peers") >= least)
    out = joined(df, sizes, by)
    for v in weights:
        ranks = value_ranks(df, by, v).select(*by, v, (100.0 * F.col("below") / F.col("n")).alias(f"pct_{v}"), (F.col("n") - F.col("below") - F.col("ties") + 1).alias(f"rank_{v}"))
        out = joined(out, ranks, [*by, v], "left")
    total = sum((F.coalesce(F.col(f"pct_{v}") * w, F.lit(0.0)) for v, w in weights.items()), F.lit(0.0))
    weight = sum((F.when(F.col(f"pct_{v}").isNotNull(), w).otherwise(0.0) for v, w in weights.items()), F.lit(0.0))
    return out.select(player, "peers", *[f"{k}_{v}" for v in weights for k in ("pct", "rank")], F.try_divide(total, weight).alias("overall"))


def minutes_band(minutes: Column, edges: Sequence[tuple[float, str]], rest: str) -> Column:
    out = F.when(minutes.isNull(), rest)
    for edge, name in edges:
        out = out.when(minutes >= edge, name)
    return out.otherwise(rest)

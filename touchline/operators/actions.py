"""Event and action values: coordinates to cells, shot and goal rates, transitions, expected threat, aggregation to players."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The pitch is 100 x 100, the grid 16 x 12; zones and time buckets by their upper or lower edges.
X_CELLS, Y_CELLS = 16, 12
ZONES = [(83.3, "penalty_area"), (66.7, "final_third"), (33.3, "middle_third"), (None, "defensive_third")]
BUCKETS = [(15, "0-15"), (30, "16-30"), (45, "31-45+"), (60, "46-60"), (75, "61-75"), (None, "76-90+")]


def cell(x: Column, y: Column, nx: int = X_CELLS, ny: int = Y_CELLS) -> Column:
    """The cell number; coordinates outside the pitch go to the nearest cell."""
    at = lambda v, n: F.least(F.greatest((v / 100 * n).cast("int"), F.lit(0)), F.lit(n - 1))
    return at(y, ny) * nx + at(x, nx)


def zone(x: Column) -> Column:
    """The zone of the pitch that a coordinate is in; what is no number counts as 0."""
    at = F.coalesce(x.cast("string").try_cast("double"), F.lit(0.0))
    return F.coalesce(*[F.when(at >= edge, name) for edge, name in ZONES if edge is not None], F.lit(ZONES[-1][1]))


def time_bucket(minute: Column) -> Column:
    """The part of the match that a minute is in, fractions cut off; what is no number counts as 0."""
    at = F.coalesce(minute.cast("string").try_cast("double").cast("long"), F.lit(0))
    return F.coalesce(*[F.when(at <= edge, name) for edge, name in BUCKETS if edge is not None], F.lit(BUCKETS[-1][1]))


def goal_geometry(x: Column, y: Column) -> dict[str, Column]:
    """Distance and angle to the middle of the goal at (100, 50)."""
    dx, dy = F.lit(100.0) - x, F.lit(50.0) - y
    return {"goal_distance": F.sqrt(dx * dx + dy * dy), "goal_angle": F.atan2(F.abs(dy), dx)}


def shot_rates(df: DataFrame, at: str, shot: Column, goal: Column) -> DataFrame:
    """Per cell: actions, share that are shots, share of shots that are goals (null without shots)."""
    out = df.groupBy(at).agg(F.count("*").alias("actions"), F.count_if(shot).alias("shots"), F.count_if(goal).alias("goals"))
    return out.withColumns({"shot_rate": F.col("shots") / F.col("actions"), "goal_rate": F.try_divide("goals", "shots")})


def transitions(df: DataFrame, start: str, end: str) -> DataFrame:
    """Counts of moves from cell to cell and their share of all moves from the cell."""
    out = df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).groupBy(start, end).agg(F.count("*").alias("moves"))
    return out.withColumn("share", F.col("moves") / F.sum("moves").over(Window.partitionBy(start)))


def threat(rates: DataFrame, moves: DataFrame, at: str, start: str, end: str, steps: int = 1000, tolerance: float = 1e-6) -> dict[int, float]:
    """Expected threat per cell: the fixed point of v = shot * goal + (1 - shot) * T v. The driver holds the grid's cells only."""
    r = {x[at]: (x["shot_rate"], x["goal_rate"] or 0.0) for x in rates.select(at, "shot_rate", "goal_rate").collect()}
    cells = sorted(r)
    place = {c: i for i, c in enumerate(cells)}
    t = np.zeros((len(cells), len(cells)))
    for x in moves.select(start, end, "share").collect():
        if x[start] in place and x[end] in place:
            t[place[x[start]], place[x[end]]] = x["share"]
    shot, goal = (np.array([r[c][k] for c in cells]) for k in (0, 1))
    v = np.zeros(len(cells))
    for _ in range(steps):
        new = np.clip(shot * goal + (1 - shot) * (t @ v), 0, 1)
        done = np.abs(new - v).max(initial=0) < tolerance
        v = new
        if done:
            break
    return dict(zip(cells, v.tolist(), strict=True))


def valued(df: DataFrame, values: dict[int, float], start: str, end: str, name: str = "xt") -> DataFrame:
    """Each action's value, that of its end less that of its start; the table of cells is small by construction."""
    table = df.sparkSession.createDataFrame([(int(k), float(v)) for k, v in values.items()], "_cell int, _v double")
    side = lambda c, n: F.broadcast(table.select(F.col("_cell").alias(f"_{n}"), F.col("_v").alias(f"_v{n}")))
    out = df.join(side(start, "a"), F.col(start) == F.col("_a"), "left").join(side(end, "b"), F.col(end) == F.col("_b"), "left")
    return out.withColumn(name, F.coalesce("_vb", F.lit(0.0)) - F.coalesce("_va", F.lit(0.0))).drop("_a", "_b", "_va", "_vb")


def counted(df: DataFrame, by: Sequence[str], kind: str, kinds: Sequence[str]) -> DataFrame:
    """A count column per kind; kinds are given, so no extra job finds them."""
    return df.groupBy(*by).agg(*[F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds], F.count("*").alias("n"))


def per_90(total: str | Column, minutes: str | Column) -> Column:
    t, m = (F.col(x) if isinstance(x, str) else x for x in (total, minutes))
    return F.when(m > 0, t * 90.0 / m)


def two_level(df: DataFrame, inner: Sequence[str], outer: Sequence[str], value: str, at: str) -> DataFrame:
    """Sums per inner key, then per outer key, with minutes as max(45, span of at) of each inner group, and the sum per 90."""
    one = df.groupBy(*inner).agg(F.sum(value).alias("v"), F.count("*").alias("n"), F.greatest(F.lit(45), F.max(at) - F.min(at)).alias("minutes"))
    out = one.groupBy(*outer).agg(F.sum("v").alias("total"), F.sum("n").alias("actions"), F.sum("minutes").alias("minutes"), F.count("*").alias("matches"))
    return out.withColumn("per_90", per_90("total", "minutes"))


def one_hot(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """A 0/1 column for each value that training knew, and one for null and all others."""
    known = F.coalesce(F.col(column).isin(list(values)), F.lit(False))
    return df.select(*[c for c in df.columns if c != column], *[F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{column}_{v}") for v in values], (~known).cast("int").alias(f"{column}_other"))

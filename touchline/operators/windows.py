"""Ordered-window operators: prior-N, expanding, cumulative, differences, runs and halves.

All operators take an entity key and a total order (always end it with an id), so windows of one spec share a sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import changes, in_blocks, running


def ordered(by: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*by).orderBy(*order)


def rolling_prior(df: DataFrame, by: Sequence[str], order: Sequence[str], values: Sequence[str], n: int) -> DataFrame:
    """Sums, means and row count over the n rows before each row; all are null on an entity's first row, counts too."""
    w = ordered(by, order).rowsBetween(-n, -1)
    out: dict[str, Column] = {f"prior_{n}_rows": F.sum(F.lit(1.0)).over(w)}
    for v in values:
        out |= {f"prior_{n}_{v}_sum": F.sum(v).over(w), f"prior_{n}_{v}_mean": F.avg(v).over(w)}
    return df.withColumns(out)


def trailing(df: DataFrame, by: Sequence[str], order: Sequence[str], values: Sequence[str], n: int) -> DataFrame:
    """Means over the last n rows, the current one included."""
    w = ordered(by, order).rowsBetween(-(n - 1), 0)
    return df.withColumns({f"trailing_{n}_{v}": F.avg(v).over(w) for v in values})


def expanding_prior(df: DataFrame, by: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Means over all rows before each row."""
    w = ordered(by, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({f"expanding_{v}": F.avg(v).over(w) for v in values})


def cumulative(df: DataFrame, by: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Running sums and means, and the ordinal of each row from 0."""
    w = ordered(by, order)
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    out: dict[str, Column] = {"ordinal": (F.row_number().over(w) - 1).cast("long")}
    for v in values:
        out |= {f"cum_{v}": F.sum(v).over(up), f"cum_mean_{v}": F.avg(v).over(up)}
    return df.withColumns(out)


def rest_days(df: DataFrame, by: Sequence[str], order: Sequence[str], at: str, name: str = "rest_days") -> DataFrame:
    """Days since the entity's row before, as a fraction; null on the first."""
    t = F.unix_micros(F.col(at).cast("timestamp"))
    return df.withColumn(name, (t - F.lag(t).over(ordered(by, order))) / 86_400_000_000)


def lagged(df: DataFrame, by: Sequence[str], order: Sequence[str], values: Sequence[str], n: int) -> DataFrame:
    """The values of the 1 to n rows before each row, and whether they equal the row's own."""
    w = ordered(by, order)
    out = {}
    for k in range(1, n + 1):
        for v in values:
            before = F.lag(v, k).over(w)
            out |= {f"{v}_lag{k}": before, f"{v}_same{k}": F.coalesce(before == F.col(v), F.lit(False))}
    return df.withColumns(out)


def islands(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str = "island") -> DataFrame:
    """Numbers the runs of equal values of each entity from 1; a null value is a run of its own on every row."""
    w = ordered(by, order)
    change = F.when(F.row_number().over(w) == 1, 1).otherwise(F.coalesce((F.lag(value).over(w) != F.col(value)).cast("int"), F.lit(1)))
    return df.withColumn("_change", change).withColumn(name, F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_change")


def possession_labels(df: DataFrame, by: Sequence[str], order: Sequence[str], side: str, goal: Column) -> DataFrame:
    """scores: whether the row's run of one side holds a goal; concedes: whether the next run, of another side, does.

    The runs come from one shuffle and sort by entity, and the windows after it reuse both; null keys and sides stay.
    """
    runs = islands(df, by, order, side, "possession").withColumn("_goal", goal.cast("int"))
    w = Window.partitionBy(*by).orderBy("possession")
    own, after = w.rangeBetween(0, 0), w.rangeBetween(1, 1)
    conceded = F.when(F.first(side).over(after) != F.col(side), F.max("_goal").over(after))
    return runs.withColumns({"scores": F.max("_goal").over(own), "concedes": F.coalesce(conceded, F.lit(0))}).drop("_goal")


def halves_trend(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, threshold: float) -> DataFrame:
    """Per entity the means of its earlier and later half (the later has n // 2 rows), their difference, and a trend label."""
    w = ordered(by, order)
    n, rn = F.count("*").over(Window.partitionBy(*by)), F.row_number().over(w)
    late = rn > n - F.floor(n / 2)
    out = df.withColumn("_late", late).groupBy(*by).agg(F.avg(F.when(~F.col("_late"), F.col(value))).alias("early"), F.avg(F.when(F.col("_late"), F.col(value))).alias("late"), F.count("*").alias("n"))
    d = F.col("late") - F.col("early")
    return out.withColumn("momentum", d).withColumn("trend", F.when(F.col("n") < 3, "insufficient").when(d > threshold, "rising").when(d < -threshold, "falling").otherwise("stable"))


def streaks(df: DataFrame, by: Sequence[str], order: Sequence[str], hit: str) -> DataFrame:
    """One row per run of equal outcomes: its number, outcome and length. Rows without an outcome neither count nor break a run."""
    runs = running(changes(df.where(F.col(hit).isNotNull()), by, order, hit), by, order, {"run": F.col("_change").cast("long")})
    return runs.groupBy(*by, "run").agg(F.min(hit).alias(hit), F.count("*").alias("length"))


def rolling_prior_of_few(df: DataFrame, by: Sequence[str], order: Sequence[str], values: Sequence[str], n: int) -> DataFrame:
    """rolling_prior() for few or very large entities, which are cut into blocks of rows."""
    rows = in_blocks(running(df, by, order, {}), n)
    return rolling_prior(rows, [*by, "_block"], ["_i"], values, n).where("_own").drop("_block", "_own", "_range", "_i")

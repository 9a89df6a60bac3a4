"""What forecasts and ratings depend on, and where they fail: permutation importance, the worst forecasts and their clusters."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .backtest import OUTCOMES, predicted
from .league import uniform
from .ranges import cut, joined, running
from .stats import spearman


def permuted(df: DataFrame, by: Sequence[str], key: Sequence[str], value: str, seed: Sequence[Column]) -> DataFrame:
    """df with its value shuffled within groups: the row whose hash is the i-th takes the value of the row whose other hash is the i-th.

    Both orders come from numbers over ranges, so no task sorts a group, and from seed and key alone, so a lost task
    repeats itself. key is unique within a group; its names keep equal hashes in order.
    """
    rows = cut(df.withColumns({side: uniform(*seed, F.lit(side[1:]), *[F.col(k) for k in key]) for side in ("_from", "_to")}))
    given = running(rows.select(*by, *key, "_from", F.col(value).alias("_given")), by, ["_from", *key], {}).select(*by, "_i", "_given")
    takes = running(rows.drop("_from"), by, ["_to", *key], {})
    return joined(takes, given, [*by, "_i"], by="merge").withColumn(value, F.col("_given")).drop("_i", "_given", "_to", "_range")


def permutation_importance(df: DataFrame, key: Sequence[str], features: Sequence[str], score: Callable[[dict[str, Column]], Column], target: str, repeats: int, seed: int) -> DataFrame:
    """(feature, spearman, shuffled, drop, spread, repeats): how far the rank correlation of score and target falls on average when a feature is shuffled.

    score makes the score from the features' columns; a feature without a value counts as 0 in it. Rows without a
    target and features of one value or none are left out. The shuffles are made together: every row is there once
    for each feature and repeat. Without any feature or row the result is empty.
    """
    rows = df.where(F.col(target).isNotNull()).select(*key, *[F.col(f).cast("double").alias(f) for f in features], F.col(target).cast("double").alias("_target"))
    spans = rows.agg(*[F.min(f).alias(f"_a_{i}") for i, f in enumerate(features)], *[F.max(f).alias(f"_b_{i}") for i, f in enumerate(features)]).first()
    used = [f for i, f in enumerate(features) if spans[f"_a_{i}"] != spans[f"_b_{i}"]]  # one row of the table's columns
    scored = lambda values: score({f: F.coalesce(c, F.lit(0.0)) for f, c in values.items()})
    base = spearman(rows.withColumn("_score", scored({f: F.col(f) for f in features})), [], "_score", "_target").select("spearman")
    cases = [F.struct(F.lit(f).alias("feature"), F.lit(r).alias("repeat"), F.col(f).alias("_value")) for f in used for r in range(repeats)]
    if not cases:
        return base.select(F.lit("").alias("feature"), "spearman", F.lit(0.0).alias("shuffled"), F.lit(0.0).alias("drop"), F.lit(0.0).alias("spread"), F.lit(repeats).alias("repeats")).limit(0)
    long = rows.withColumn("_case", F.explode(F.array(*cases))).select("*", "_case.*").drop("_case")
    long = permuted(long, ["feature", "repeat"], key, "_value", [F.lit(seed), F.col("feature"), F.col("repeat")])
    long = long.withColumn("_score", scored({f: F.when(F.col("feature") == f, F.col("_value")).otherwise(F.col(f)) if f in used else F.col(f) for f in features}))
    long = cut(long.select("feature", "repeat", "_score", "_target"))
    per = spearman(long, ["feature", "repeat"], "_score", "_target").select("feature", F.col("spearman").alias("_s"))
    drop = F.col("spearman") - F.col("_s")
    return per.crossJoin(F.broadcast(base)).groupBy("feature", "spearman").agg(F.avg("_s").alias("shuffled"), F.avg(drop).alias("drop"), F.stddev_pop(drop).alias("spread"), F.lit(repeats).alias("repeats"))


def hardest(df: DataFrame, score: str, key: Sequence[str], share: float, least: int) -> DataFrame:
    """The rows of the highest scores: that share of all, but `least` or more (all, if fewer). Equal scores go by key. Their numbers come from ranges; rows without a score count in the share alone."""
    rows = running(df.where(F.col(score).isNotNull()).withColumn("_down", -F.col(score)), [], ["_down", *key], {}).drop("_down", "_range")
    wanted = df.agg(F.greatest(F.lit(least), F.floor(F.count("*") * share)).alias("_wanted"))
    return rows.crossJoin(F.broadcast(wanted)).where(F.col("_i") < F.col("_wanted")).drop("_i", "_wanted")


def clustered_errors(df: DataFrame, key: Sequence[str], features: Sequence[str], clusters: int = 3, share: float = 0.1, least: int = 5, seed: int = 42) -> DataFrame:
    """The hardest() of scored() forecasts that have all features, with their cluster of k-means on z-scores by the sample's deviations (0 counts as 1), and these as z_<feature>.

    Without `clusters` times `least` such rows there are none.
    """
    if not 2 <= clusters <= 8 or not 0 < share <= 0.5:
        raise ValueError("from 2 to 8 clusters of a share above 0 and up to 0.5")
    rows = hardest(df, "brier", key, share, clusters * least)
    for f in features:
        rows = rows.where(F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")))
    spread = rows.agg(F.count("*").alias("_rows"), *[c for f in features for c in (F.avg(f).alias(f"_m_{f}"), F.stddev_samp(f).alias(f"_s_{f}"))])
    z = rows.crossJoin(F.broadcast(spread)).where(F.col("_rows") >= clusters * least)
    z = z.withColumns({f"z_{f}": (F.col(f) - F.col(f"_m_{f}")) / F.coalesce(F.nullif(F.col(f"_s_{f}"), F.lit(0.0)), F.lit(1.0)) for f in features}).drop("_rows", *[f"_{x}_{f}" for x in "ms" for f in features])
    z = cut(z)
    z = VectorAssembler(inputCols=[f"z_{f}" for f in features], outputCol="_f").transform(z)
    if z.isEmpty():
        return z.withColumn("cluster", F.lit(0)).drop("_f")
    return KMeans(featuresCol="_f", predictionCol="cluster", k=clusters, seed=seed, initSteps=10).fit(z).transform(z).drop("_f")


def error_clusters(rows: DataFrame, features: Sequence[str], least: int = 5, top: int = 10) -> DataFrame:
    """Per cluster of clustered_errors() with `least` rows or more: rows, mean Brier and confidence, accuracy, the commonest outcome and forecast (ties to the first of home, draw, away), and the features of the largest mean z-scores, with these."""
    def commonest(value: Column) -> Column:
        n = {o: F.count_if(value == o) for o in OUTCOMES}
        return F.coalesce(*[F.when(n[o] == F.greatest(*n.values()), o) for o in OUTCOMES])

    centre = F.array(*[F.struct((-F.abs(F.avg(f"z_{f}"))).alias("_a"), F.lit(f).alias("feature"), F.avg(f"z_{f}").alias("centre")) for f in features])
    out = rows.groupBy("cluster").agg(F.count("*").alias("n"), F.avg("brier").alias("brier"), F.avg("confidence").alias("confidence"), F.avg("correct").alias("accuracy"), commonest(F.col("outcome")).alias("outcome"), commonest(predicted()).alias("forecast"), F.slice(F.array_sort(centre), 1, top).alias("_c"))
    return out.where(F.col("n") >= least).withColumn("centre", F.transform("_c", lambda x: F.struct(x["feature"].alias("feature"), x["centre"].alias("centre")))).drop("_c")

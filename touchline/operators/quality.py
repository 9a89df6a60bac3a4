"""Data-quality checks in one pass per table, label conflicts and annotator agreement, missingness and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile(df: DataFrame, table: str, keys: Sequence[str], present: Sequence[str], non_negative: Sequence[str], least_rows: int) -> DataFrame:
    """(table, check, failures, passed): null keys, null and negative values and the row count, from one aggregation; repeated keys from another."""
    checks = {"null_keys": F.count_if(sum((F.col(k).isNull().cast("int") for k in keys), F.lit(0)) > 0)}
    checks |= {f"null_{c}": F.count_if(F.col(c).isNull()) for c in present} | {f"negative_{c}": F.count_if(F.col(c) < 0) for c in non_negative}
    checks["missing_rows"] = F.greatest(F.lit(least_rows) - F.count("*"), F.lit(0))
    one = df.agg(*[c.cast("long").alias(n) for n, c in checks.items()])
    repeats = df.groupBy(*keys).count().where("count > 1").agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("repeated_keys"))
    both = one.crossJoin(repeats)
    names = [*checks, "repeated_keys"]
    return both.select(F.explode(F.array(*[F.struct(F.lit(table).alias("table"), F.lit(n).alias("check"), F.col(n).alias("failures"), (F.col(n) == 0).alias("passed")) for n in names])).alias("x")).select("x.*")


def missing_rates(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(F.col(c).isNull().cast("double")).alias(f"missing_{c}") for c in columns])


def coverage(df: DataFrame, by: Sequence[str], unit: str, target: int) -> DataFrame:
    """Units rated against a target per group, and the level that gives."""
    out = df.groupBy(*by).agg(F.count_distinct(unit).alias("rated")).withColumn("matched", F.least("rated", F.lit(target)))
    share = F.col("matched") / target
    return out.withColumns({"share": share, "level": F.when(share >= 0.9, "HIGH").when(share >= 0.7, "MEDIUM").otherwise("LOW")})


def pairwise_conflicts(df: DataFrame, a: str, b: str, preferred: str) -> DataFrame:
    """Unordered pairs for which different sides were preferred."""
    return df.groupBy(F.least(a, b).alias("first"), F.greatest(a, b).alias("second")).agg(F.count_distinct(preferred).alias("sides"), F.count("*").alias("n")).where("sides > 1")


def tier_conflicts(df: DataFrame, key: Sequence[str], tier: str, threshold: int) -> DataFrame:
    return df.groupBy(*key).agg((F.max(tier) - F.min(tier)).alias("spread"), F.count("*").alias("n")).where(F.col("spread") >= threshold)


def agreement(df: DataFrame, item: str, annotator: str, value: str, tolerance: float = 0.0) -> DataFrame:
    """Share of annotator pairs within tolerance on the items both rated. Values are counted per item first: pairs of counts, not of rows."""
    a = df.groupBy(item, annotator).agg(F.max(value).alias("v"))
    b = a.select(F.col(item).alias("_item"), F.col(annotator).alias("other"), F.col("v").alias("w"))
    pairs = a.join(b, (F.col(item) == F.col("_item")) & (F.col(annotator) < F.col("other")))
    return pairs.groupBy(annotator, "other").agg(F.count("*").alias("items"), F.avg((F.abs(F.col("v") - F.col("w")) <= tolerance).cast("double")).alias("agreement"))


def exclusion(reasons: dict[str, object]):
    """The first reason of several whose condition holds, or included."""
    out = None
    for name, cond in reasons.items():
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise("included")


def content_hash(df: DataFrame) -> DataFrame:
    """Rows and an order-free checksum of a table."""
    return df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("checksum"))

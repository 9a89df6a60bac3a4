"""Ordered work on few or large groups: ranges of the order cut every group, so no task sorts a whole one.

A group's ranges are cut at approximate quantiles, whose state is of bounded size. What a range needs from those before
it (counts, sums, peaks, the last value) comes from a table of one row per group and range.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Most ranges of a group, the square of a whole number, and the fewest rows for which a range of its own is made.
RANGES, ROWS = 1024, 256


def shared_dir(spark: SparkSession) -> str:
    """The application's checkpoint folder, which driver and executors share: that of the session; only a local one without it takes a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set")
        sc.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def new_dir(spark: SparkSession, name: str) -> str:
    """A folder of its own below shared_dir()."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder, for what several later steps read: a lost executor costs none of it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def joined(df: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner", by: str | None = None) -> DataFrame:
    """df with the other columns of a table, on keys of which null equals null.

    by: a join hint for the table. Spark's estimates don't know that exploding multiplies rows, so without one a table
    that grows with the rows, or the rows themselves, may be broadcast: "merge" where the table can be large.
    """
    right = table.select(*[F.col(k).alias(f"_k_{i}") for i, k in enumerate(keys)], *[c for c in table.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_k_{i}")) for i, k in enumerate(keys)]
    out = df.join(right.hint(by) if by else right, on, how) if keys else df.crossJoin(F.broadcast(right))
    return out.drop(*[f"_k_{i}" for i in range(len(keys))])


def ranged(df: DataFrame, by: Sequence[str], order: str, rows: int = ROWS) -> DataFrame:
    """df with _range, from 0: equal values of order share one, and null comes before all. order: a number, date or time.

    A group has about one range for every `rows` rows, RANGES at most. A row finds its own by the edge of every so many
    and then among those between. Groups of up to `rows` rows have no edges and aren't in their table; it is broadcast,
    as a join by group alone would bring a group's rows to one task: at most 8 KB a group, and less than half a byte a row.
    """
    step = int(RANGES**0.5)
    edges = df.groupBy(*by).agg(F.percentile_approx(order, [k / RANGES for k in range(1, RANGES)], 10 * RANGES).alias("_edges"), F.count(order).alias("_n"))
    stride = F.ceil(F.lit(float(RANGES)) / F.least(F.greatest(F.ceil(F.col("_n") / rows), F.lit(1)), F.lit(RANGES))).cast("int")
    edges = edges.withColumn("_edges", F.coalesce(F.filter("_edges", lambda e, i: (i + 1) % stride == 0), F.slice("_edges", F.lit(1), F.lit(0))))
    edges = (edges.where(F.col("_n") > rows) if by else edges).drop("_n")
    edges = edges.withColumn("_steps", F.filter("_edges", lambda e, i: (i + 1) % step == 0))
    under = lambda edges: F.size(F.filter(edges, lambda e: e < F.col(order)))
    first = under(F.col("_steps")) * step
    at = F.when(F.col(order).isNull() | F.col("_edges").isNull(), 0).otherwise(F.coalesce(first + under(F.slice("_edges", first + 1, F.lit(step))), F.lit(0)))
    return joined(df, edges, by, "left", "broadcast").withColumn("_range", at).drop("_edges", "_steps")


def before(per: DataFrame, by: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """A table of one row per group and range with each sum's total of the ranges before (name -> column)."""
    w = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return per.withColumns({name: F.coalesce(F.sum(c).over(w), F.lit(0)) for name, c in sums.items()})


def value_ranks(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, value, below, ties, n) of every distinct value that isn't null: rows of its group below it, equal to it, and in all."""
    counts = ranged(df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("ties")), by, value)
    per = counts.groupBy(*by, "_range").agg(F.sum("ties").alias("_c"))
    per = before(per, by, {"_before": "_c"}).withColumn("n", F.sum("_c").over(Window.partitionBy(*by)))
    w = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_in", F.coalesce(F.sum("ties").over(w), F.lit(0)))
    return joined(counts, per.drop("_c"), [*by, "_range"], by="merge").select(*by, value, (F.col("_before") + F.col("_in")).alias("below"), "ties", "n")


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """df with running sums (name -> value; null adds nothing) and _i, the row's number from 0, by group in a total order."""
    rows = ranged(df, by, order[0])
    up = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_v_{n}": c for n, c in values.items()})
    rows = rows.withColumns({"_i": F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order)) - 1} | {n: F.coalesce(F.sum(f"_v_{n}").over(up), F.lit(0)) for n in values})
    per = rows.groupBy(*by, "_range").agg(F.count("*").alias("_c"), *[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values])
    per = before(per, by, {"_o": "_c"} | {f"_o_{n}": f"_s_{n}" for n in values}).drop("_c", *[f"_s_{n}" for n in values])
    out = joined(rows, per, [*by, "_range"], by="merge").withColumns({"_i": F.col("_i") + F.col("_o")} | {n: F.col(n) + F.col(f"_o_{n}") for n in values})
    return out.drop("_o", *[f"_o_{n}" for n in values], *[f"_v_{n}" for n in values])


def peaks(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Rows of running() with the most of value so far."""
    up = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn(name, F.max(value).over(up))
    w = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy(*by, "_range").agg(F.max(value).alias("_most")).withColumn("_peak", F.max("_most").over(w)).drop("_most")
    return joined(rows, per, [*by, "_range"], by="merge").withColumn(name, F.greatest(name, "_peak")).drop("_peak")


def changes(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """df with _change: 1 where value, which isn't null, differs from the row before or is its group's first."""
    rows = ranged(df, by, order[0])
    key = F.struct(*order)
    per = rows.groupBy(*by, "_range").agg(F.max_by(value, key).alias("_last")).withColumn("_before", F.lag("_last").over(Window.partitionBy(*by).orderBy("_range"))).drop("_last")
    rows = joined(rows, per, [*by, "_range"], by="merge")
    own = F.coalesce(F.lag(value).over(Window.partitionBy(*by, "_range").orderBy(*order)), F.col("_before"))
    return rows.withColumn("_change", F.when(own == F.col(value), 0).otherwise(1)).drop("_before", "_range")


def in_blocks(df: DataFrame, context: int, block: int = 100_000) -> DataFrame:
    """Rows of running() in blocks of successive numbers, each with the `context` rows before it, for windows over (by, _block); _own marks a block's own rows."""
    block = max(block, context)
    at, own = F.floor(F.col("_i") / block), F.col("_i") % block
    copies = F.when(own >= block - context, F.array(F.struct(at.alias("b"), F.lit(True).alias("o")), F.struct((at + 1).alias("b"), F.lit(False).alias("o")))).otherwise(F.array(F.struct(at.alias("b"), F.lit(True).alias("o"))))
    return df.withColumn("_x", F.explode(copies)).withColumns({"_block": F.col("_x.b"), "_own": F.col("_x.o")}).drop("_x")

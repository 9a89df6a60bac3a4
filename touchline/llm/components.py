"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, written

MAX_ROUNDS = 60


def _star(links: DataFrame, low: str, high: str, small: bool) -> DataFrame:
    """One round: every node's neighbours are linked to the smallest node around it.

    The least neighbour of each node is aggregated on the map side first, then joined back on a derived key,
    so that both sides are dealt out for the join and Spark can split the rows of a node with very many links.
    """
    if small:
        around = links.select(F.col(high).alias("u"), F.col(low).alias("v"))
    else:
        around = links.select(F.explode(F.array(F.struct(F.col(low).alias("u"), F.col(high).alias("v")), F.struct(F.col(high).alias("u"), F.col(low).alias("v")))).alias("x")).select("x.*")
    least = around.groupBy("u").agg(F.min("v").alias("m")).select(apart(F.col("u")).alias("_u"), F.least("m", "u").alias("m"))
    moved = around.join(least, apart(F.col("u")) == F.col("_u"))
    if small:
        out = moved.select(F.explode(F.array(F.struct(F.col("v").alias("b"), F.col("m").alias("a")), F.struct(F.col("u").alias("b"), F.col("m").alias("a")))).alias("x")).select("x.*")
    else:
        out = moved.where("v > u").select(F.col("v").alias("b"), F.col("m").alias("a"))
    return out.where("a < b").groupBy("a", "b").agg(F.lit(1).alias("_1")).select("a", "b")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has a link; root is the smallest node reachable.

    links may repeat, run either way and hold self-links and nulls, which say nothing. Each round is written to
    the shared folder; the driver sees only each round's size and checksum.
    """
    links = links.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")).where("x <> y")
    links = written(links.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).groupBy("a", "b").agg(F.lit(1).alias("_1")).select("a", "b"), "links")
    before = None
    for _ in range(MAX_ROUNDS):
        links = written(_star(_star(links, "a", "b", small=False), "a", "b", small=True), "links")
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")
    return links.select(F.col("b").alias("node"), F.col("a").alias("root")).union(links.groupBy("a").agg(F.lit(1).alias("_1")).select(F.col("a").alias("node"), F.col("a").alias("root")))

"""Queries of knockout brackets: eight customers with neighbouring keys each, some with results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators import bracket

from .registry import query
from .stand_ins import table

ROUNDS = 3


def entrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    return c.select(F.floor(k / 8).alias("bracket"), (k % 8).alias("slot"), k.alias("team"), (F.col("c_acctbal").cast("double") / 1000 + 0.5).alias("strength"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round 1 of every third bracket, its first tie in every third, and in the rest a result of round 2 that cannot be yet."""
    k = F.col("c_custkey")
    b, tie = F.floor(k / 8), F.floor(k % 8 / 2)
    r = table(spark, sf_dir, "customer").where((k % 2 == 0) & ((b % 3 == 0) | (b % 3 == 1) & (tie == 0) | (b % 3 == 2) & (tie == 1)))
    return r.select(b.alias("bracket"), F.when(b % 3 == 2, 2).otherwise(1).alias("round"), tie.alias("tie"), (k % 5).alias("home_goals"), (F.floor(k / 4) % 4).alias("away_goals"), F.when(k % 3 != 0, k + 1).alias("penalties_winner"))


ENTRANTS = "e AS (SELECT c_custkey // 8 AS bracket, c_custkey % 8 AS slot, c_custkey AS team, c_acctbal::DOUBLE / 1000 + 0.5 AS s FROM customer)"
#: Round 1 by its results; those of round 2 are never ready.
FIRST = ENTRANTS + """, t1 AS (SELECT h.bracket, h.slot // 2 AS tie, h.team AS home, a.team AS away, h.team % 5 AS hg, h.team // 4 % 4 AS ag, CASE WHEN h.team % 3 <> 0 THEN a.team END AS pw FROM e h JOIN e a ON a.bracket = h.bracket AND a.slot = h.slot + 1 WHERE h.slot % 2 = 0),
w1 AS (SELECT bracket, tie, CASE WHEN hg > ag THEN home WHEN hg < ag THEN away ELSE pw END AS winner FROM t1 WHERE bracket % 3 = 0 OR bracket % 3 = 1 AND tie = 0)"""


def _round(r: int) -> str:
    chance = "CASE WHEN a.s <= 0 AND o.s <= 0 THEN 0.5 ELSE pow(greatest(a.s, 1e-6), 2.8) / (pow(greatest(a.s, 1e-6), 2.8) + pow(greatest(o.s, 1e-6), 2.8)) END"
    free = f"any_value(a.p) * (coalesce(sum(o.p * {chance}), 0) + 1 - coalesce(sum(o.p), 0))"
    known = "CASE WHEN any_value(w.winner) IS NOT NULL THEN (any_value(w.winner) = a.team)::INT::DOUBLE ELSE " + free + " END" if r == 1 else free
    join = "LEFT JOIN w1 w ON w.bracket = a.bracket AND w.tie = a.slot // 2" if r == 1 else ""
    return f"a{r} AS (SELECT a.bracket, a.slot, a.team, a.s, {known} AS p FROM a{r - 1} a LEFT JOIN a{r - 1} o ON o.bracket = a.bracket AND o.slot // {1 << (r - 1)} = xor(a.slot // {1 << (r - 1)}, 1) {join} GROUP BY a.bracket, a.slot, a.team, a.s)"


@query(f"WITH {FIRST}, a0 AS (SELECT *, 1.0::DOUBLE AS p FROM e), {', '.join(map(_round, range(1, ROUNDS + 1)))} " + " UNION ALL ".join(f"SELECT bracket, slot, team, {r} AS round, p FROM a{r}" for r in range(1, ROUNDS + 1)))
def knockout_chances(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entrants(spark, sf_dir)
    return bracket.chances(e, bracket.replayed(e, results(spark, sf_dir), ROUNDS), ROUNDS)


@query()
def knockout_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entrants(spark, sf_dir)
    return bracket.scenarios(e, bracket.replayed(e, results(spark, sf_dir), ROUNDS), ROUNDS)


@query()
def bracket_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bracket.replayed(entrants(spark, sf_dir), results(spark, sf_dir), ROUNDS)


@query(f"""WITH {ENTRANTS}, r AS (SELECT c_custkey // 8 AS bracket, CASE WHEN c_custkey // 8 % 3 = 2 THEN 2 ELSE 1 END AS round, c_custkey % 8 // 2 AS tie FROM customer WHERE c_custkey % 2 = 0 AND (c_custkey // 8 % 3 = 0 OR c_custkey // 8 % 3 = 1 AND c_custkey % 8 // 2 = 0 OR c_custkey // 8 % 3 = 2 AND c_custkey % 8 // 2 = 1)),
x AS (SELECT DISTINCT bracket, 1 AS round, 2 + bracket % 2 AS tie FROM e)
SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.bracket = r.bracket AND r.round >= x.round AND r.tie = x.tie // pow(2, r.round - x.round)::BIGINT)""")
def bracket_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that stay once the third or fourth tie of round 1 of each bracket is taken back."""
    edits = entrants(spark, sf_dir).select("bracket").distinct().select("bracket", F.lit(1).alias("round"), (2 + F.col("bracket") % 2).alias("tie"))
    return bracket.cleared(results(spark, sf_dir), edits, ROUNDS).select("bracket", "round", "tie")

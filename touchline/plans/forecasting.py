"""Queries of forecasts by many models: walk-forward tests by decay, the decay chosen, bootstrap intervals, attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators import dixon_coles as dc

from .registry import query
from .stand_ins import SEASONS, seasons

ORDER = ["match_date", "match_id"]


def _tested(spark: SparkSession, sf_dir: str, decays: tuple[float, ...]) -> DataFrame:
    return dc.tested(seasons(spark, sf_dir), ORDER, decays=decays, by=["league"])


@query()
def dixon_coles_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per fold: mean scores of models of each league without decay and with one."""
    return dc.means(_tested(spark, sf_dir, (0.0, 0.002)), ["fold", "decay"])


@query()
def dixon_coles_decay_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.decay_comparison(_tested(spark, sf_dir, (0.0, 0.005)), 0.005)


@query()
def dixon_coles_decay_tuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    decays = (0.0, 0.001, 0.003, 0.01)
    return dc.tuned(_tested(spark, sf_dir, decays), decays)


@query()
def forecast_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of the last match of each league, over refits to resampled matches."""
    m = seasons(spark, sf_dir)
    last = m.groupBy("league").agg(F.max(F.struct("match_date", "match_id", "home", "away")).alias("x")).select("league", "x.home", "x.away")
    return dc.bootstrapped(m, last, ["league"], replicates=20, decay=0.001)


#: Strengths of a league's teams by their goals, in place of a fit, so that SQL can say them.
STRENGTHS = f"""{SEASONS}, two AS (SELECT league, home AS team, home_goals AS f, away_goals AS a FROM seasons UNION ALL SELECT league, away, away_goals, home_goals FROM seasons),
lg AS (SELECT league, (sum(home_goals + away_goals) + 1) / (2.0::DOUBLE * count(*)) AS mean, ln((sum(home_goals) + 1) / (sum(away_goals) + 1.0::DOUBLE)) AS advantage FROM seasons GROUP BY league),
st AS (SELECT league, team, ln((sum(f) + mean) / ((count(*) + 1) * mean)) AS attack, ln((sum(a) + mean) / ((count(*) + 1) * mean)) AS defence FROM two JOIN lg USING (league) GROUP BY league, team, mean),
fx AS (SELECT DISTINCT league, home, away FROM seasons),
base AS (SELECT league, home, away, h.attack AS home_attack, h.defence AS home_defence, a.attack AS away_attack, a.defence AS away_defence, advantage, mean, -0.1::DOUBLE AS rho FROM fx JOIN lg USING (league) JOIN st h USING (league) JOIN st a USING (league) WHERE h.team = home AND a.team = away)"""

_NEUTRAL = ", ".join(f"CASE WHEN k = {k} THEN {v}::DOUBLE ELSE {f} END AS {f}" for k, (f, v) in enumerate(dc.FACTORS.items()))
_NAME = "CASE p.k " + " ".join(f"WHEN {k} THEN '{f}'" for k, f in enumerate(dc.FACTORS)) + " END"


def fixture_strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = seasons(spark, sf_dir)
    of = lambda team, f, a: F.struct(F.col(team).alias("team"), F.col(f).alias("f"), F.col(a).alias("a"))
    lg = m.groupBy("league").agg(((F.sum(F.col("home_goals") + F.col("away_goals")) + 1) / (2.0 * F.count("*"))).alias("mean"), F.ln((F.sum("home_goals") + 1) / (F.sum("away_goals") + F.lit(1.0))).alias("advantage"))
    two = m.select("league", F.explode(F.array(of("home", "home_goals", "away_goals"), of("away", "away_goals", "home_goals"))).alias("x")).groupBy("league", "x.team").agg(F.sum("x.f").alias("f"), F.sum("x.a").alias("a"), F.count("*").alias("n"))
    force = lambda goals: F.ln((F.col(goals) + F.col("mean")) / ((F.col("n") + 1) * F.col("mean")))
    st = two.join(lg, "league").select("league", "team", force("f").alias("attack"), force("a").alias("defence"))
    side = lambda s: st.select("league", F.col("team").alias(s), F.col("attack").alias(f"{s}_attack"), F.col("defence").alias(f"{s}_defence"))
    return m.select("league", "home", "away").distinct().join(lg, "league").join(side("home"), ["league", "home"]).join(side("away"), ["league", "away"]).withColumn("rho", F.lit(-0.1))


@query(f"""WITH {STRENGTHS}, c AS (SELECT league, home, away, k, {_NEUTRAL} FROM base, range(-1, {len(dc.FACTORS)}) t(k)),
l AS (SELECT league, home, away, k, rho, exp(ln(mean) + home_attack + away_defence + advantage) AS lh, exp(ln(mean) + away_attack + home_defence) AS la FROM c),
g AS (SELECT league, home, away, k, i, j, exp(-lh) * pow(lh, i) / factorial(i::INT) * exp(-la) * pow(la, j) / factorial(j::INT) * CASE WHEN i = 0 AND j = 0 THEN 1 - lh * la * rho WHEN i = 0 AND j = 1 THEN 1 + lh * rho WHEN i = 1 AND j = 0 THEN 1 + la * rho WHEN i = 1 AND j = 1 THEN 1 - rho ELSE 1 END AS q FROM l, range(0, 11) x(i), range(0, 11) y(j)),
p AS (SELECT league, home, away, k, sum(q) FILTER (i > j) / sum(q) AS w, sum(q) FILTER (i = j) / sum(q) AS d, sum(q) FILTER (i < j) / sum(q) AS a FROM g GROUP BY ALL)
SELECT p.league, p.home, p.away, b.w AS home_win, b.d AS draw, b.a AS away_win, {_NAME} AS factor, p.w AS neutral_home_win, CASE WHEN abs(b.w - p.w) < 1e-12 THEN 0 ELSE b.w - p.w END AS delta, (row_number() OVER (PARTITION BY p.league, p.home, p.away ORDER BY round(abs(b.w - p.w), 12) DESC, p.k))::INTEGER AS place
FROM p JOIN p b ON b.league = p.league AND b.home = p.home AND b.away = p.away AND b.k = -1 WHERE p.k >= 0""")
def forecast_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairings that meet: what each factor adds to the chance of a home win."""
    return dc.attributed(fixture_strengths(spark, sf_dir))

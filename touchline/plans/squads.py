"""Queries of squads and their ratings, with their SQL: parts as rated players over three seasons, customers as players of their nation's squad."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators import squads

from .registry import query
from .stand_ins import table

KNOWN = {"BUILDING": 49.5, "MACHINERY": 38.5}
CHANCES = {1: 0.161, 2: 0.05}
ROLES = list(squads.TARGETS)

SQUADS = """rated AS (SELECT p_partkey AS k, 'P' || (p_partkey // 3 % 97) || ' Tok' || (p_partkey // 3) || 'son' AS name, CASE p_partkey % 3 WHEN 0 THEN '2425' WHEN 1 THEN '2526' ELSE '2324' END AS season,
 CASE WHEN p_partkey % 11 <> 0 THEN 30 + p_partkey % 41 END AS score, CASE WHEN p_partkey % 4 = 0 THEN 'Serie A' ELSE p_type END AS league FROM part),
squad AS (SELECT c_custkey AS id, c_nationkey AS team, CASE c_custkey % 5 WHEN 0 THEN 'P' || (c_custkey % 97) || ' Tok' || c_custkey || 'son' WHEN 1 THEN upper('P' || (c_custkey % 97) || ' Tok' || c_custkey || 'son') WHEN 2 THEN 'X tok' || c_custkey WHEN 3 THEN 'Nobody Zz' || c_custkey ELSE 'Tok' || c_custkey || 'son' END AS name,
 CASE WHEN c_custkey % 7 = 0 THEN 'Bundesliga' ELSE c_mktsegment END AS club_league, """ + f"{ROLES!r}" + """[c_custkey % 9 + 1] AS position FROM customer),
pairs AS (SELECT s.id, CASE WHEN r.name = s.name THEN 0 WHEN lower(r.name) = lower(s.name) THEN 1 ELSE 2 END AS level, r.* FROM squad s JOIN rated r ON contains(lower(r.name), lower(split_part(s.name, ' ', -1)))),
firsts AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY id ORDER BY level, season <> '2526', k) = 1),
enriched AS (SELECT s.*, CASE f.level WHEN 0 THEN 'exact' WHEN 1 THEN 'case' WHEN 2 THEN 'last_name' END AS match_level, f.score::DOUBLE AS rating, CASE WHEN f.score IS NOT NULL THEN CASE WHEN f.league = 'Serie A' THEN 'high' ELSE 'medium' END END AS rating_confidence FROM squad s LEFT JOIN firsts f ON f.id = s.id)"""


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    n = F.floor(k / 3)
    rated = table(spark, sf_dir, "part").select(k.alias("k"), F.concat(F.lit("P"), n % 97, F.lit(" Tok"), n, F.lit("son")).alias("name"), F.when(k % 3 == 0, "2425").when(k % 3 == 1, "2526").otherwise("2324").alias("season"), F.when(k % 11 != 0, 30 + k % 41).alias("score"), F.when(k % 4 == 0, "Serie A").otherwise(F.col("p_type")).alias("league"))
    c = F.col("c_custkey")
    full = F.concat(F.lit("P"), c % 97, F.lit(" Tok"), c, F.lit("son"))
    name = F.when(c % 5 == 0, full).when(c % 5 == 1, F.upper(full)).when(c % 5 == 2, F.concat(F.lit("X tok"), c)).when(c % 5 == 3, F.concat(F.lit("Nobody Zz"), c)).otherwise(F.concat(F.lit("Tok"), c, F.lit("son")))
    squad = table(spark, sf_dir, "customer").select(c.alias("id"), F.col("c_nationkey").alias("team"), name.alias("name"), F.when(c % 7 == 0, "Bundesliga").otherwise(F.col("c_mktsegment")).alias("club_league"), F.get(F.array(*[F.lit(r) for r in ROLES]), (c % 9).cast("int")).alias("position"))
    return squads.rated(squad, rated, "k", latest="2526")


@query(f"WITH {SQUADS} SELECT * FROM enriched")
def squad_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enriched(spark, sf_dir)


@query(f"""WITH {SQUADS}, p AS (SELECT team, rating, CASE club_league WHEN 'BUILDING' THEN 49.5::DOUBLE WHEN 'MACHINERY' THEN 38.5::DOUBLE WHEN 'Bundesliga' THEN 58.0::DOUBLE ELSE 42.0::DOUBLE END AS proxy, (club_league = 'Bundesliga')::INT::DOUBLE AS big FROM enriched),
n AS (SELECT *, coalesce(rating, proxy) AS score, row_number() OVER (PARTITION BY team ORDER BY coalesce(rating, proxy) DESC) AS i FROM p),
a AS (SELECT team, count(*) AS total_players, count(rating) AS rated_players, count(rating)::DOUBLE / count(*) AS coverage, coalesce(avg(rating), 43.0::DOUBLE) AS observed_avg_rating, avg(proxy) AS proxy_avg_rating, avg(score) FILTER (i <= 11) AS core_avg_rating, coalesce(avg(score) FILTER (i BETWEEN 12 AND 18), avg(score) FILTER (i <= 11)) AS depth_avg_rating,
 coalesce(avg(score) FILTER (i > 18), avg(score) FILTER (i BETWEEN 12 AND 18), avg(score) FILTER (i <= 11)) AS reserve_avg_rating, avg(big) AS big5_ratio FROM n GROUP BY team),
b AS (SELECT *, coverage * observed_avg_rating + (1 - coverage) * proxy_avg_rating AS shrunk_avg_rating FROM a),
q AS (SELECT *, 0.55::DOUBLE * core_avg_rating + 0.2::DOUBLE * depth_avg_rating + 0.1::DOUBLE * reserve_avg_rating + 0.15::DOUBLE * shrunk_avg_rating AS squad_quality_rating FROM b),
s AS (SELECT *, least(greatest((squad_quality_rating - 30) / 40, 0), 1) AS rating_score, CASE team WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.05::DOUBLE / 0.16::DOUBLE ELSE 0.01::DOUBLE / 0.16::DOUBLE END AS outside_score, least(greatest((proxy_avg_rating - 35) / 25, 0), 1) AS league_score, coverage ** 0.7::DOUBLE AS coverage_score, least(big5_ratio / 0.6::DOUBLE, 1) AS big5_score FROM q)
SELECT *, least(0.46::DOUBLE * rating_score + 0.24::DOUBLE * outside_score + 0.18::DOUBLE * league_score + 0.07::DOUBLE * coverage_score + 0.05::DOUBLE * big5_score + CASE WHEN team = 3 THEN 0.04::DOUBLE ELSE 0 END, CASE WHEN team = 3 THEN 1 ELSE 9 END) AS strength FROM s""")
def squad_strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return squads.strengths(enriched(spark, sf_dir), "team", "club_league", known=KNOWN, chances=CHANCES, hosts=[3])


TARGET_ROWS = ", ".join(f"('{r}', {t})" for r, t in squads.TARGETS.items())
UNIT_ROWS = ", ".join(f"('{r}', '{u}')" for u, roles in squads.UNITS.items() for r in roles)


@query(f"""WITH {SQUADS}, t(role, target) AS (VALUES {TARGET_ROWS}), per AS (SELECT team, position AS role, count(*) AS n, count(rating) AS n_rated, avg(rating) AS mean_rating FROM enriched GROUP BY ALL)
SELECT d.team, t.role, coalesce(n, 0) AS n, target, CASE WHEN n IS NULL THEN 'missing' WHEN n < target THEN 'thin' WHEN n = target THEN 'adequate' ELSE 'deep' END AS depth_status, coalesce(n_rated, 0) AS n_rated, coalesce(n_rated::DOUBLE / n, 0) AS coverage, mean_rating FROM (SELECT DISTINCT team FROM enriched) d CROSS JOIN t LEFT JOIN per ON per.team = d.team AND per.role = t.role""")
def squad_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return squads.depth(enriched(spark, sf_dir), "team", "position")


@query(f"""WITH {SQUADS}, u(role, unit) AS (VALUES {UNIT_ROWS}), per AS (SELECT team, unit, count(*) AS n, count(rating) AS n_rated, avg(rating) AS mean_rating FROM enriched JOIN u ON u.role = position GROUP BY ALL)
SELECT d.team, x.unit, coalesce(n, 0) AS n, coalesce(n_rated, 0) AS n_rated, coalesce(n_rated::DOUBLE / n, 0) AS coverage, mean_rating FROM (SELECT DISTINCT team FROM enriched) d CROSS JOIN (SELECT DISTINCT unit FROM u) x LEFT JOIN per ON per.team = d.team AND per.unit = x.unit""")
def squad_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return squads.units(enriched(spark, sf_dir), "team", "position")

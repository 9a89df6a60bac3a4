"""Queries of styles, tournament scenarios and identity audits, and the SQL that each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators import identity, joins, league, styles, tournament

from .registry import UNIFORM, query
from .stand_ins import ACTIONS, CAREERS, QUADS, RATINGS, actions, careers, quads, ratings, table

NATIONAL = "np AS (SELECT c_nationkey AS team, n_regionkey AS league, avg(c_acctbal) AS score, avg(c_custkey * 37 % 3000) AS minutes, stddev_pop(c_acctbal) AS spread FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"


def national(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratings(spark, sf_dir).groupBy("team", "league").agg(F.avg("score").alias("score"), F.avg("minutes").alias("minutes"), F.stddev_pop("score").alias("spread"))


@query(f"""WITH {CAREERS}, p AS (SELECT position, season, avg(score) AS mean, quantile_cont(score, 0.5) AS median FROM careers GROUP BY ALL)
SELECT position, count(*) AS seasons, CASE WHEN count(*) > 1 THEN regr_slope(mean, season) END AS mean_slope, CASE WHEN count(*) > 1 THEN regr_r2(mean, season) END AS mean_r2, CASE WHEN count(*) > 1 THEN regr_slope(median, season) END AS median_slope, CASE WHEN count(*) > 1 THEN regr_r2(median, season) END AS median_r2,
 CASE WHEN count(*) < 2 THEN 'insufficient' WHEN (arg_max(median, season) - arg_min(median, season)) / abs(arg_min(median, season)) > 0.05 THEN 'increasing' WHEN (arg_max(median, season) - arg_min(median, season)) / abs(arg_min(median, season)) < -0.05 THEN 'decreasing' ELSE 'stable' END AS label FROM p GROUP BY position""")
def style_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return styles.evolution(careers(spark, sf_dir), ["position"], "season", "score")


@query(f"""WITH {CAREERS}, s AS (SELECT position, season, sum(score * minutes) / sum(minutes) AS score, sum(minutes)::BIGINT AS weight FROM careers WHERE minutes >= 700 GROUP BY ALL) SELECT * FROM s""")
def position_season_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return styles.profiles(careers(spark, sf_dir), ["position", "season"], ["score"], "minutes", 700)


@query("""WITH y AS (SELECT c_nationkey AS team, n_regionkey AS league, year(o_orderdate)::BIGINT AS season, max(o_totalprice) AS a, min(o_totalprice) AS b FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
s AS (SELECT league, team, [coalesce(regr_slope(a, season), 0), coalesce(regr_slope(b, season), 0)] AS v FROM y GROUP BY ALL HAVING count(DISTINCT season) >= 3),
p AS (SELECT x.team, z.team AS neighbour, list_cosine_similarity(x.v, z.v) AS similarity FROM s x JOIN s z ON x.league = z.league AND x.team <> z.team)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY similarity DESC, neighbour) AS rank FROM p) WHERE rank <= 3""")
def drift_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    y = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("team"), F.year("o_orderdate").cast("long").alias("season")).agg(F.max("o_totalprice").alias("a"), F.min("o_totalprice").alias("b"))
    y = y.join(n, F.col("team") == F.col("n_nationkey")).select("team", F.col("n_regionkey").alias("league"), "season", "a", "b")
    return styles.drift_neighbours(y, "team", "league", "season", ["a", "b"], 3, 3)


@query(f"""WITH {NATIONAL}, z AS (SELECT team, (score - avg(score) OVER ()) / stddev_pop(score) OVER () AS a, (minutes - avg(minutes) OVER ()) / stddev_pop(minutes) OVER () AS b, (spread - avg(spread) OVER ()) / stddev_pop(spread) OVER () AS c FROM np)
SELECT h.team AS home, w.team AS away, h.a - w.a AS delta_score, h.b - w.b AS delta_minutes, h.c - w.c AS delta_spread, {", ".join(f"CASE WHEN abs(h.{x} - w.{x}) < 0.15 THEN 'even' WHEN h.{x} > w.{x} THEN 'home' ELSE 'away' END AS advantage_{n}" for x, n in (("a", "score"), ("b", "minutes"), ("c", "spread")))},
 sqrt((h.a - w.a) ** 2 + (h.b - w.b) ** 2 + (h.c - w.c) ** 2) AS distance FROM z h JOIN z w ON h.team <> w.team""")
def style_matchups(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = national(spark, sf_dir)
    pairs = t.select(F.col("team").alias("home")).crossJoin(t.select(F.col("team").alias("away"))).where("home <> away")
    return styles.matchups(t, pairs, "team", ["score", "minutes", "spread"])


COUNTS = "k AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS n_view, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'purchase') AS n_purchase FROM actions GROUP BY user_id)"


def action_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from touchline.operators import actions as act

    return act.counted(actions(spark, sf_dir), ["user_id"], "event_type", ["view", "click", "purchase"]).withColumn("group", F.col("user_id") % 5)


@query(f"""WITH {ACTIONS}, {COUNTS}, l AS (SELECT user_id % 5 AS g, user_id, unnest([{{'action': 'n_view', 'value': n_view::DOUBLE}}, {{'action': 'n_click', 'value': n_click::DOUBLE}}, {{'action': 'n_purchase', 'value': n_purchase::DOUBLE}}], recursive := true) FROM k),
r AS (SELECT g AS "group", user_id, action, value, 100.0::DOUBLE * (rank() OVER (PARTITION BY g, action ORDER BY value) - 1 + count(*) OVER (PARTITION BY g, action, value) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY g, action) AS percentile FROM l)
SELECT *, CASE WHEN percentile >= 75 THEN 'top' WHEN percentile >= 50 THEN 'upper' WHEN percentile >= 25 THEN 'lower' ELSE 'bottom' END AS quartile FROM r""")
def action_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return styles.action_percentiles(action_profiles(spark, sf_dir), ["group"], "user_id", ["n_view", "n_click", "n_purchase"])


@query(f"""WITH {NATIONAL}, p AS (SELECT x.team, y.team AS neighbour, list_cosine_similarity([x.score, x.minutes, x.spread], [y.score, y.minutes, y.spread]) AS similarity FROM np x JOIN np y ON x.league = y.league AND x.team <> y.team)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY similarity DESC, neighbour) AS rank FROM p) WHERE rank <= 3""")
def team_action_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return styles.alike(national(spark, sf_dir), ["league"], "team", ["score", "minutes", "spread"], 3)


@query(f"""WITH {RATINGS}, b AS (SELECT team, position, arg_max([score, minutes::DOUBLE], (score, -player)) AS own FROM ratings GROUP BY ALL), t AS (SELECT r.team, r.position, p.player, p.score, p.minutes FROM (SELECT DISTINCT team, position FROM ratings) r JOIN ratings p ON p.position = r.position AND p.team <> r.team AND p.score >= 8000),
s AS (SELECT team, position, player, list_cosine_similarity(own, [score, minutes::DOUBLE]) AS similarity FROM t JOIN b USING (team, position)) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY team, position ORDER BY similarity DESC, player) AS rank FROM s) WHERE rank <= 3""")
def target_style_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ratings(spark, sf_dir)
    wanted = r.select("team", "position").distinct().join(r.where("score >= 8000").select("player", "position", F.col("team").alias("_t")), "position").where("team <> _t").drop("_t")
    return styles.target_matches(r, wanted, ["score", "minutes"], 3)


# Groups of four teams and all their pairs that have not met


SO_FAR = QUADS + """, pts AS (SELECT q, season, team, sum(CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END) AS pts, sum(gf - ga) AS gd, sum(gf) AS gf FROM (SELECT q, season, home AS team, home_goals AS gf, away_goals AS ga FROM quads WHERE played UNION ALL SELECT q, season, away, away_goals, home_goals FROM quads WHERE played) GROUP BY ALL),
pl AS (SELECT q || '-' || season AS g, team, coalesce(pts, 0) AS pts, coalesce(gd, 0) AS gd, coalesce(gf, 0) AS gf FROM qs LEFT JOIN pts USING (q, season, team)),
lf AS (SELECT (a.season * 10000000 + a.team) * 4 + b.team % 4 AS match_id, a.q || '-' || a.season AS g, a.team AS home, b.team AS away FROM qs a JOIN qs b ON a.q = b.q AND a.season = b.season AND a.team < b.team
 WHERE NOT EXISTS (SELECT 1 FROM quads m WHERE m.played AND m.season = a.season AND least(m.home, m.away) = a.team AND greatest(m.home, m.away) = b.team))"""


def group_state(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(tables so far, matches left: every pair of a group that has not met before July)."""
    m = quads(spark, sf_dir)
    name = F.concat_ws("-", "q", "season")
    sides = m.select("q", "season", F.explode(F.array("home", "away")).alias("team")).distinct()
    points = joins.team_rows(m.where("played").withColumn("league", F.col("q"))).withColumnRenamed("league", "q")
    t = points.groupBy("q", "season", "team").agg(F.sum("points").alias("pts"), F.sum("goal_diff").alias("gd"), F.sum("goals_for").alias("gf"))
    so_far = sides.join(t, ["q", "season", "team"], "left").na.fill(0, ["pts", "gd", "gf"]).select(name.alias("group"), "team", "pts", "gd", "gf")
    met = m.where("played").select("season", F.least("home", "away").alias("home"), F.greatest("home", "away").alias("away")).distinct()
    pairs = sides.withColumnRenamed("team", "home").join(sides.withColumnRenamed("team", "away"), ["q", "season"]).where("home < away").join(met, ["season", "home", "away"], "left_anti")
    return so_far, pairs.select(((F.col("season") * 10000000 + F.col("home")) * 4 + F.col("away") % 4).alias("match_id"), name.alias("group"), "home", "away")


_SIDES_OF = """SELECT {k}, g, home AS team, CASE WHEN s > 0 THEN 3 WHEN s = 0 THEN 1 ELSE 0 END AS p, s AS d, greatest(s, 0) AS f FROM {t} UNION ALL SELECT {k}, g, away, CASE WHEN s < 0 THEN 3 WHEN s = 0 THEN 1 ELSE 0 END, -s, greatest(-s, 0) FROM {t}"""


@query(f"""WITH {SO_FAR}, c AS (SELECT *, pow(home % 10 + 1.0::DOUBLE, 2.8) / (pow(home % 10 + 1.0::DOUBLE, 2.8) + pow(away % 10 + 1.0::DOUBLE, 2.8)) * (1 - 0.28) AS win FROM lf), u AS (SELECT c.*, sim, {UNIFORM.format(x="'9|' || sim || '|' || match_id")} AS u FROM c, range(0, 20) t(sim)),
d AS (SELECT *, CASE WHEN u < win THEN 1 WHEN u < win + 0.28 THEN 0 ELSE -1 END AS s FROM u), w AS (SELECT sim, g, team, sum(p) AS p, sum(d) AS d, sum(f) AS f FROM ({_SIDES_OF.format(k="sim", t="d")}) GROUP BY ALL),
r AS (SELECT sim, g, team, row_number() OVER (PARTITION BY sim, g ORDER BY pts + coalesce(p, 0) DESC, gd + coalesce(d, 0) DESC, gf + coalesce(f, 0) DESC, team) AS place FROM pl CROSS JOIN range(0, 20) t(sim) LEFT JOIN w USING (sim, g, team))
SELECT g AS "group", team, avg((place = 1)::INT) AS p_first, avg((place <= 2)::INT) AS p_through FROM r GROUP BY ALL""")
def group_simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    so_far, left = group_state(spark, sf_dir)
    chance = league.knockout_probability(F.col("home") % 10 + F.lit(1.0), F.col("away") % 10 + F.lit(1.0))
    return tournament.simulated_groups(so_far, left.withColumn("p_home", chance), 20, 9)


@query(f"""WITH {SO_FAR}, k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY match_id) - 1 AS k FROM lf), n AS (SELECT g, count(*) AS n FROM lf GROUP BY g), o AS (SELECT g, unnest(range(0, pow(3, n)::BIGINT)) AS scenario FROM n),
d AS (SELECT k.*, scenario, 1 - (scenario // pow(3, k)::BIGINT) % 3 AS s FROM k JOIN o USING (g)), w AS (SELECT scenario, g, team, sum(p) AS p, sum(d) AS d, sum(f) AS f FROM ({_SIDES_OF.format(k="scenario", t="d")}) GROUP BY ALL),
r AS (SELECT scenario, g, team, row_number() OVER (PARTITION BY scenario, g ORDER BY pts + coalesce(p, 0) DESC, gd + coalesce(d, 0) DESC, gf + coalesce(f, 0) DESC, team) AS place FROM pl JOIN o USING (g) LEFT JOIN w USING (scenario, g, team)),
q AS (SELECT g AS "group", team, count(*) AS scenarios, count(*) FILTER (place <= 2) AS through, min(place) AS best, max(place) AS worst FROM r GROUP BY ALL) SELECT *, CASE WHEN through = scenarios THEN 'through' WHEN through = 0 THEN 'out' ELSE 'open' END AS status FROM q""")
def qualification_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    so_far, left = group_state(spark, sf_dir)
    return tournament.qualification(tournament.scenarios(so_far, left))


# Identity audits


MIXED = """mixed AS (SELECT c_custkey, c_name, c_nationkey, CASE c_custkey % 6 WHEN 0 THEN 'understat|' || c_custkey WHEN 1 THEN 'joe bloggs|1990|' || c_nationkey WHEN 2 THEN 'x1|y|z' WHEN 3 THEN c_custkey || '.0' WHEN 4 THEN '' ELSE 'id-' || c_custkey END AS pid FROM customer)"""


def mixed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    pid = F.when(k % 6 == 0, F.concat(F.lit("understat|"), k)).when(k % 6 == 1, F.concat(F.lit("joe bloggs|1990|"), "c_nationkey")).when(k % 6 == 2, "x1|y|z").when(k % 6 == 3, F.concat(k, F.lit(".0"))).when(k % 6 == 4, "").otherwise(F.concat(F.lit("id-"), k))
    return table(spark, sf_dir, "customer").withColumn("pid", pid)


@query(f"""WITH {MIXED} SELECT CASE c_custkey % 6 WHEN 0 THEN 'understat_pipe_id' WHEN 1 THEN 'fbref_name_composite' WHEN 2 THEN 'other_pipe_delimited' WHEN 3 THEN 'statsbomb_numeric' ELSE 'unknown' END AS format, count(*) AS rows, count(DISTINCT pid) AS players FROM mixed GROUP BY 1""")
def id_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.format_distribution(mixed_ids(spark, sf_dir), "pid")


@query("SELECT lower(p_name) AS name, count(DISTINCT p_brand) AS sources, string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) AS which, count(DISTINCT p_partkey) AS ids, count(*) AS rows FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def several_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.several_sources(table(spark, sf_dir, "part"), "p_name", "p_brand", "p_partkey")


@query("SELECT event_type, count(*) AS rows, count(*) FILTER (user_id % 2 = 0) AS resolved, avg((user_id % 2 = 0)::INT) AS share FROM events GROUP BY event_type")
def resolution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id").cast("string")
    e = table(spark, sf_dir, "events").withColumn("canonical", F.when(F.col("user_id") % 2 == 0, u).when(F.col("user_id") % 3 == 0, F.concat(F.lit("unresolved:x:"), u)))
    return identity.resolution_summary(e, "event_type", "canonical")


@query("""SELECT s.s_suppkey, c.c_custkey, CASE WHEN c.c_custkey IS NULL THEN 'none' WHEN s.s_suppkey % 3 = c.c_custkey % 2 THEN 'high' ELSE 'medium' END AS level FROM supplier s LEFT JOIN customer c ON s.s_nationkey = c.c_nationkey AND replace(lower(s.s_name), 'supplier', 'customer') = lower(c.c_name)""")
def suggested_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.regexp_replace("s_name", "Supplier", "Customer").alias("name"), F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 3).alias("team"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 2).alias("team"))
    return identity.suggested(s, c, ["nation"], "name", "team", "s_suppkey", "c_custkey")

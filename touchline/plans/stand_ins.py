"""The analytic tables (matches, forecasts, ratings, actions) derived from the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators.joins import team_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as matches: leagues of ten teams, goals from the keys, seasons by year."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    home = c % 10
    away = (home + 1 + k % 9) % 10
    return o.select(k.alias("match_id"), F.col("o_orderdate").alias("match_date"), (c % 3).alias("league"), F.year("o_orderdate").cast("long").alias("season"), home.alias("home"), away.alias("away"), ((k + c) % 5 % 4).alias("home_goals"), ((F.floor(k / 4) + c) % 4 % 3).alias("away_goals"))


MATCHES = """matches AS (SELECT o_orderkey AS match_id, o_orderdate AS match_date, o_custkey % 3 AS league, year(o_orderdate)::BIGINT AS season, o_custkey % 10 AS home,
 (o_custkey % 10 + 1 + o_orderkey % 9) % 10 AS away, (o_orderkey + o_custkey) % 5 % 4 AS home_goals, (o_orderkey // 4 + o_custkey) % 4 % 3 AS away_goals FROM orders)"""
TEAMS = MATCHES + """, teams AS (SELECT 'home' AS side, match_id, match_date, league, season, home AS team, away AS opponent, home_goals AS goals_for, away_goals AS goals_against, home_goals - away_goals AS goal_diff,
 CASE WHEN home_goals > away_goals THEN 3 WHEN home_goals = away_goals THEN 1 ELSE 0 END AS points FROM matches
 UNION ALL SELECT 'away', match_id, match_date, league, season, away, home, away_goals, home_goals, away_goals - home_goals, CASE WHEN away_goals > home_goals THEN 3 WHEN home_goals = away_goals THEN 1 ELSE 0 END FROM matches)"""


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return team_rows(matches(spark, sf_dir))


def seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as matches of many leagues: twenty customers each are the teams of one, so leagues grow with the data and pairs stay unplayed. played: before July."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    league, season = F.floor(c / 20), F.year("o_orderdate").cast("long")
    away = league * 20 + (c + 1 + k % 19) % 20
    return o.select(k.alias("match_id"), F.col("o_orderdate").alias("match_date"), league.alias("league"), season.alias("season"), c.alias("home"), away.alias("away"), ((k + c) % 5 % 4).alias("home_goals"), ((F.floor(k / 4) + c) % 4 % 3).alias("away_goals"), (F.month("o_orderdate") < 7).alias("played"))


SEASONS = """seasons AS (SELECT o_orderkey AS match_id, o_custkey // 20 AS league, year(o_orderdate)::BIGINT AS season, o_custkey AS home, o_custkey // 20 * 20 + (o_custkey + 1 + o_orderkey % 19) % 20 AS away,
 (o_orderkey + o_custkey) % 5 % 4 AS home_goals, (o_orderkey // 4 + o_custkey) % 4 % 3 AS away_goals, month(o_orderdate) < 7 AS played FROM orders),
sides AS (SELECT DISTINCT league, season, unnest([home, away]) AS team FROM seasons),
unplayed AS (SELECT a.league, a.season, a.team AS home, b.team AS away FROM sides a JOIN sides b ON a.league = b.league AND a.season = b.season AND a.team <> b.team
 WHERE NOT EXISTS (SELECT 1 FROM seasons m WHERE m.played AND m.league = a.league AND m.season = a.season AND m.home = a.team AND m.away = b.team))"""


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forecast of each match, from its keys."""
    m = matches(spark, sf_dir)
    a, d, b = F.col("home") + 1, F.col("match_id") % 5 + 1, F.col("away") + 1
    total = (a + d + b).cast("double")
    outcome = F.when(F.col("home_goals") > F.col("away_goals"), "home").when(F.col("home_goals") == F.col("away_goals"), "draw").otherwise("away")
    return m.withColumns({"p_home": a / total, "p_draw": d / total, "p_away": b / total, "outcome": outcome})


FORECASTS = MATCHES + """, forecasts AS (SELECT *, (home + 1)::DOUBLE / (home + away + match_id % 5 + 3)::DOUBLE AS p_home, (match_id % 5 + 1)::DOUBLE / (home + away + match_id % 5 + 3)::DOUBLE AS p_draw,
 (away + 1)::DOUBLE / (home + away + match_id % 5 + 3)::DOUBLE AS p_away, CASE WHEN home_goals > away_goals THEN 'home' WHEN home_goals = away_goals THEN 'draw' ELSE 'away' END AS outcome FROM matches)"""
SCORED = FORECASTS + """, hits AS (SELECT *, (outcome = 'home')::INT AS yh, (outcome = 'draw')::INT AS yd, (outcome = 'away')::INT AS ya, greatest(p_home, p_draw, p_away) AS confidence FROM forecasts),
scored AS (SELECT *, (p_home - yh) * (p_home - yh) + (p_draw - yd) * (p_draw - yd) + (p_away - ya) * (p_away - ya) AS brier,
 ((p_home - yh) * (p_home - yh) + (p_home + p_draw - yh - yd) * (p_home + p_draw - yh - yd)) / 2 AS rps,
 -ln(greatest(CASE outcome WHEN 'home' THEN p_home WHEN 'draw' THEN p_draw ELSE p_away END, 1e-12)) AS log_loss,
 -(p_home * ln(p_home) + p_draw * ln(p_draw) + p_away * ln(p_away)) / ln(3) AS entropy,
 list_reverse_sort([p_home, p_draw, p_away])[1] - list_reverse_sort([p_home, p_draw, p_away])[2] AS margin,
 (CASE WHEN p_home = confidence THEN 'home' WHEN p_draw = confidence THEN 'draw' ELSE 'away' END = outcome)::INT AS correct FROM hits)"""


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as rated players: nations as teams, regions as leagues, segments as positions."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    out = c.join(F.broadcast(n.select("n_nationkey", "n_regionkey")), F.col("c_nationkey") == F.col("n_nationkey"))
    return out.select(F.col("c_custkey").alias("player"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("team"), F.col("n_regionkey").alias("league"), F.col("c_mktsegment").alias("position"), F.col("c_acctbal").alias("score"), (F.col("c_custkey") * 37 % 3000).alias("minutes"))


RATINGS = "ratings AS (SELECT c_custkey AS player, c_name AS name, c_nationkey AS team, n_regionkey AS league, c_mktsegment AS position, c_acctbal AS score, c_custkey * 37 % 3000 AS minutes FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as actions on the pitch: users as matches, coordinates from id and value."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    i = F.col("event_id")
    return e.select("event_id", "ts", "user_id", "event_type", "value", (i % 2).alias("side"), (i * 17 % 101).cast("double").alias("start_x"), (i * 31 % 101).cast("double").alias("start_y"), (i * 53 % 101).cast("double").alias("end_x"), (i * 71 % 101).cast("double").alias("end_y"), (i % 95).cast("int").alias("minute"))


ACTIONS = "actions AS (SELECT event_id, ts, user_id, event_type, value, event_id % 2 AS side, (event_id * 17 % 101)::DOUBLE AS start_x, (event_id * 31 % 101)::DOUBLE AS start_y, (event_id * 53 % 101)::DOUBLE AS end_x, (event_id * 71 % 101)::DOUBLE AS end_y, (event_id % 95)::INT AS minute FROM events)"
CELL = "least(greatest(trunc({y} / 100 * 12)::INT, 0), 11) * 16 + least(greatest(trunc({x} / 100 * 16)::INT, 0), 15)"


def careers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' years as the seasons of players: score from what they spent, minutes from how often, the position of their least priority."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    return o.groupBy(F.col("o_custkey").alias("player"), F.year("o_orderdate").cast("long").alias("season")).agg((F.max("o_totalprice") / 5000).alias("score"), (F.count("*") * 700).alias("minutes"), F.min("o_orderpriority").alias("position"))


CAREERS = "careers AS (SELECT o_custkey AS player, year(o_orderdate)::BIGINT AS season, max(o_totalprice) / 5000 AS score, count(*) * 700 AS minutes, min(o_orderpriority) AS position FROM orders GROUP BY ALL)"


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as an append-only ledger of judgements: every third one takes back or repeats one before it of the same order."""
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_shipdate", "l_returnflag", "l_linestatus").groupBy("l_orderkey", "l_linenumber").agg(*[F.max(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_shipdate", "l_returnflag", "l_linestatus")])
    n, k = F.col("l_linenumber"), F.col("l_orderkey")
    return x.select((k * 10 + n).alias("decision_id"), F.when((k + n) % 7 == 0, "revoked").otherwise("confirmed").alias("action"), F.when(n % 3 == 2, k * 10 + n - 1).alias("supersedes"),
                    F.when(k % 5 == 0, "model_derived").when(k % 2 == 0, "human_tier").otherwise("human_pairwise_preference").alias("label_type"), (F.col("l_quantity") / 10).cast("int").alias("tier"),
                    F.when(F.col("l_discount") < 0.03, "low").otherwise("high").alias("confidence"), F.concat("l_returnflag", F.when(F.col("l_linestatus") == "O", "open case").otherwise("")).alias("evidence"),
                    F.to_date("l_shipdate").alias("recorded_at"), (F.col("l_suppkey") % 7).alias("decided_by"), F.col("l_partkey").alias("a"), (F.col("l_suppkey") % 50).alias("b"), F.year("l_shipdate").cast("long").alias("season"),
                    F.when(k % 11 == 0, "in spring").when(k % 13 != 0, F.concat_ws("/", F.date_format("l_shipdate", "yyyy-MM-dd"), F.date_format(F.date_add("l_shipdate", 30), "yyyy-MM-dd"))).alias("observation_window"))


LEDGER = """items AS (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_suppkey) AS l_suppkey, max(l_quantity) AS l_quantity, max(l_discount) AS l_discount, max(l_shipdate) AS l_shipdate, max(l_returnflag) AS l_returnflag, max(l_linestatus) AS l_linestatus FROM lineitem GROUP BY ALL),
ledger AS (SELECT l_orderkey * 10 + l_linenumber AS decision_id, CASE WHEN (l_orderkey + l_linenumber) % 7 = 0 THEN 'revoked' ELSE 'confirmed' END AS action, CASE WHEN l_linenumber % 3 = 2 THEN l_orderkey * 10 + l_linenumber - 1 END AS supersedes,
 CASE WHEN l_orderkey % 5 = 0 THEN 'model_derived' WHEN l_orderkey % 2 = 0 THEN 'human_tier' ELSE 'human_pairwise_preference' END AS label_type, trunc(l_quantity / 10)::INT AS tier,
 CASE WHEN l_discount < 0.03 THEN 'low' ELSE 'high' END AS confidence, l_returnflag || CASE WHEN l_linestatus = 'O' THEN 'open case' ELSE '' END AS evidence, l_shipdate::DATE AS recorded_at, l_suppkey % 7 AS decided_by, l_partkey AS a, l_suppkey % 50 AS b, year(l_shipdate)::BIGINT AS season,
 CASE WHEN l_orderkey % 11 = 0 THEN 'in spring' WHEN l_orderkey % 13 <> 0 THEN strftime(l_shipdate::DATE, '%Y-%m-%d') || '/' || strftime(l_shipdate::DATE + 30, '%Y-%m-%d') END AS observation_window FROM items),
active AS (SELECT * FROM ledger l WHERE action = 'confirmed' AND NOT EXISTS (SELECT 1 FROM ledger s WHERE s.supersedes = l.decision_id))"""


def truth_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger's records as truth labels of a generation later: sources in several spellings, seasons as codes of two years, some codes that are none, some records without a date."""
    d, x = F.col("decision_id"), ledger(spark, sf_dir)
    names = ["transfermarkt_value", " Award", "expert_tier", "manual_calibration", "Scouting_Review ", "hearsay"]
    source = F.when(d % 17 != 0, F.element_at(F.array(*[F.lit(n) for n in names]), (d % 6 + 1).cast("int")))
    year = F.col("season") + 25
    code = F.when(d % 19 == 0, F.concat(year.cast("string"), F.lit("-1"))).otherwise(F.concat(F.lpad(((year - 1) % 100).cast("string"), 2, "0"), F.lpad((year % 100).cast("string"), 2, "0")))
    return x.select("decision_id", source.alias("label_source"), code.alias("season"), F.when(d % 23 != 0, F.add_months("recorded_at", 300)).alias("as_of_date"))


TRUTH = LEDGER + """, truth AS (SELECT decision_id, CASE WHEN decision_id % 17 <> 0 THEN ['transfermarkt_value', ' Award', 'expert_tier', 'manual_calibration', 'Scouting_Review ', 'hearsay'][decision_id % 6 + 1] END AS label_source,
 CASE WHEN decision_id % 19 = 0 THEN (season + 25)::VARCHAR || '-1' ELSE lpad(((season + 24) % 100)::VARCHAR, 2, '0') || lpad(((season + 25) % 100)::VARCHAR, 2, '0') END AS season, CASE WHEN decision_id % 23 <> 0 THEN (recorded_at + INTERVAL 300 MONTH)::DATE END AS as_of_date FROM ledger)"""


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as matches of groups of four: four customers each are a season's group, so at most six pairs can be left. played: before July."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    q = F.floor(c / 4)
    return o.select(k.alias("match_id"), q.alias("q"), F.year("o_orderdate").cast("long").alias("season"), c.alias("home"), (q * 4 + (c + 1 + k % 3) % 4).alias("away"), ((k + c) % 5 % 4).alias("home_goals"), ((F.floor(k / 4) + c) % 4 % 3).alias("away_goals"), F.col("o_orderdate").alias("match_date"), (F.month("o_orderdate") < 7).alias("played"))


QUADS = """quads AS (SELECT o_orderkey AS match_id, o_custkey // 4 AS q, year(o_orderdate)::BIGINT AS season, o_custkey AS home, o_custkey // 4 * 4 + (o_custkey + 1 + o_orderkey % 3) % 4 AS away,
 (o_orderkey + o_custkey) % 5 % 4 AS home_goals, (o_orderkey // 4 + o_custkey) % 4 % 3 AS away_goals, month(o_orderdate) < 7 AS played FROM orders),
qs AS (SELECT DISTINCT q, season, unnest([home, away]) AS team FROM quads)"""

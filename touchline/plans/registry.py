"""Queries by name and the SQL that each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions import scalar
from touchline.operators import actions as act
from touchline.operators import backtest as bt
from touchline.operators import identity, joins, league, quality, stats, tournament, windows

from .stand_ins import ACTIONS, CELL, FORECASTS, MATCHES, RATINGS, SCORED, SEASONS, TEAMS, actions, forecasts, matches, ratings, seasons, table, teams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


USER, ORDER = ["user_id"], ["ts", "event_id"]
EVENT_WINDOW = "(PARTITION BY user_id ORDER BY ts, event_id"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")


def cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with whole cents, whose sums don't depend on their order."""
    return events(spark, sf_dir).withColumn("cents", F.round(F.col("value") * 100).cast("long"))


# Windows


@query(f"""
SELECT event_id, user_id, sum(1.0::DOUBLE) OVER w AS prior_5_rows, sum(value) OVER w AS prior_5_value_sum, avg(value) OVER w AS prior_5_value_mean
FROM events WINDOW w AS {EVENT_WINDOW} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)
""")
def rolling_prior_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.rolling_prior(events(spark, sf_dir), USER, ORDER, ["value"], 5).drop("ts", "event_type", "value")


@query(f"SELECT event_id, avg(value) OVER {EVENT_WINDOW} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS trailing_5_value FROM events")
def trailing_mean_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.trailing(events(spark, sf_dir), USER, ORDER, ["value"], 5).select("event_id", "trailing_5_value")


@query(f"SELECT event_id, avg(round(value * 100)::BIGINT) OVER {EVENT_WINDOW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS expanding_cents FROM events")
def expanding_prior_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.expanding_prior(cents(spark, sf_dir), USER, ORDER, ["cents"]).select("event_id", "expanding_cents")


@query(f"SELECT event_id, row_number() OVER {EVENT_WINDOW}) - 1 AS ordinal, sum(round(value * 100)::BIGINT) OVER w AS cum_cents, avg(round(value * 100)::BIGINT) OVER w AS cum_mean_cents FROM events WINDOW w AS {EVENT_WINDOW} ROWS UNBOUNDED PRECEDING)")
def cumulative_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.cumulative(cents(spark, sf_dir), USER, ORDER, ["cents"]).select("event_id", "ordinal", "cum_cents", "cum_mean_cents")


@query(f"SELECT event_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER {EVENT_WINDOW})) / 86400000000.0::DOUBLE AS rest_days FROM events")
def rest_days_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.rest_days(events(spark, sf_dir), USER, ORDER, "ts").select("event_id", "rest_days")


@query(f"SELECT event_id, lag(event_type, 1) OVER w AS event_type_lag1, lag(event_type, 2) OVER w AS event_type_lag2, coalesce(lag(event_type, 1) OVER w = event_type, false) AS event_type_same1, coalesce(lag(event_type, 2) OVER w = event_type, false) AS event_type_same2 FROM events WINDOW w AS {EVENT_WINDOW})")
def lag_features_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.lagged(events(spark, sf_dir), USER, ORDER, ["event_type"], 2).select("event_id", "event_type_lag1", "event_type_lag2", "event_type_same1", "event_type_same2")


ISLANDS = f"runs AS (SELECT *, sum(change) OVER {EVENT_WINDOW} ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM (SELECT *, CASE WHEN lag({{c}}) OVER {EVENT_WINDOW}) = {{c}} THEN 0 ELSE 1 END AS change FROM {{t}}))"


@query("WITH " + ISLANDS.format(c="event_type", t="events") + " SELECT event_id, island FROM runs")
def possession_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.islands(events(spark, sf_dir), USER, ORDER, "event_type").select("event_id", "island")


@query(f"WITH {ACTIONS}, " + ISLANDS.format(c="side", t="actions") + """, per AS (SELECT user_id, island, min(side) AS side, max((event_type = 'purchase')::INT) AS scores FROM runs GROUP BY ALL),
nxt AS (SELECT user_id, island, scores, coalesce(CASE WHEN lead(side) OVER w <> side THEN lead(scores) OVER w END, 0) AS concedes FROM per WINDOW w AS (PARTITION BY user_id ORDER BY island))
SELECT event_id, island AS possession, scores, concedes FROM runs JOIN nxt USING (user_id, island)""")
def possession_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.possession_labels(actions(spark, sf_dir), USER, ORDER, "side", F.col("event_type") == "purchase").select("event_id", "possession", "scores", "concedes")


@query(f"""WITH r AS (SELECT user_id, value, row_number() OVER {EVENT_WINDOW}) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events),
h AS (SELECT user_id, avg(value) FILTER (rn <= n - n // 2) AS early, avg(value) FILTER (rn > n - n // 2) AS late, count(*) AS n FROM r GROUP BY user_id)
SELECT user_id, early, late, n, late - early AS momentum, CASE WHEN n < 3 THEN 'insufficient' WHEN late - early > 0.6 THEN 'rising' WHEN late - early < -0.6 THEN 'falling' ELSE 'stable' END AS trend FROM h""")
def form_halves_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.halves_trend(events(spark, sf_dir), USER, ORDER, "value", 0.6)


# As-of, reshaping, upserts, ledgers


@query("SELECT p.event_id, v.value AS last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts")
def asof_last_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    views = e.where("event_type = 'view'").select("user_id", "ts", F.col("value").alias("last_view"))
    return joins.asof(e.where("event_type = 'purchase'"), views, "user_id", "ts", "ts", ["last_view"]).select("event_id", "last_view")


@query(f"WITH {TEAMS} SELECT side, match_id, team, opponent, goals_for, goals_against, goal_diff, points FROM teams")
def team_match_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return teams(spark, sf_dir).drop("match_date", "league", "season")


@query(f"WITH {MATCHES} SELECT match_id, home, away, home_goals, away_goals FROM matches")
def fixtures_from_team_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.fixtures_from_sides(teams(spark, sf_dir))


@query(f"WITH {TEAMS} SELECT match_id, side, sum(points) OVER w AS prior_points, avg(goal_diff) OVER w AS prior_gd FROM teams WINDOW w AS (PARTITION BY league, team ORDER BY match_date, match_id, side ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)")
def team_rolling_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = windows.rolling_prior_of_few(teams(spark, sf_dir), ["league", "team"], ["match_date", "match_id", "side"], ["points", "goal_diff"], 5)
    return t.select("match_id", "side", F.col("prior_5_points_sum").alias("prior_points"), F.col("prior_5_goal_diff_mean").alias("prior_gd"))


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders WHERE (o_custkey, o_orderdate) IN (SELECT (o_custkey, max(o_orderdate)) FROM orders GROUP BY o_custkey) GROUP BY o_custkey")
def upsert_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.latest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS rn FROM conversations) WHERE rn = 1 AND role <> 'user'")
def ledger_latest_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.active(table(spark, sf_dir, "conversations"), ["conv_id"], [F.col("turn"), F.col("text")], "role", "user").select("conv_id", "turn", "role")


@query("SELECT event_id FROM events a WHERE NOT EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'purchase' AND b.event_id - 1 = a.event_id)")
def ledger_not_superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("supersedes", F.when(F.col("event_type") == "purchase", F.col("event_id") - 1))
    return joins.not_superseded(e, "event_id", "supersedes").select("event_id")


@query(f"WITH {SEASONS} SELECT * FROM unplayed")
def remaining_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = seasons(spark, sf_dir)
    return joins.unplayed(season_teams(m), m.where("played"))


def season_teams(m: DataFrame) -> DataFrame:
    return m.select("league", "season", F.explode(F.array("home", "away")).alias("team")).distinct()


@query("""WITH a AS (SELECT p_brand, p_type, quantile_cont(p_retailprice, 0.5) AS m FROM part WHERE p_partkey % 3 > 0 GROUP BY ALL), b AS (SELECT p_brand, quantile_cont(p_retailprice, 0.5) AS m FROM part WHERE p_partkey % 3 > 0 GROUP BY ALL), c AS (SELECT quantile_cont(p_retailprice, 0.5) AS m FROM part WHERE p_partkey % 3 > 0)
SELECT p_partkey, coalesce(a.m, b.m, c.m) AS baseline FROM part p LEFT JOIN a USING (p_brand, p_type) LEFT JOIN b ON p.p_brand = b.p_brand CROSS JOIN c""")
def hierarchical_median_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", F.when(F.col("p_partkey") % 3 > 0, F.col("p_retailprice")).alias("price"))
    return joins.fallback(p, [["p_brand", "p_type"], ["p_brand"], []], "price", "baseline").select("p_partkey", "baseline")


@query("SELECT p_partkey, coalesce(CASE WHEN p_partkey % 4 > 0 THEN p_retailprice END, m) AS price FROM part LEFT JOIN (SELECT p_brand, quantile_cont(p_retailprice, 0.5) FILTER (p_partkey % 4 > 0) AS m FROM part GROUP BY p_brand) USING (p_brand)")
def position_median_imputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 4 > 0, F.col("p_retailprice")).alias("raw"))
    return stats.median_imputed(p, ["p_brand"], "raw", "price").select("p_partkey", "price")


@query("SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'c' || user_id::VARCHAR ELSE 'unresolved:' || event_type || ':' || user_id::VARCHAR END AS canonical FROM events")
def canonical_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("user_id", F.col("user_id").cast("string"))
    known = e.where("user_id % 2 = 0").select("event_type", "user_id").distinct().withColumn("canonical", F.concat(F.lit("c"), "user_id"))
    return joins.resolved(e, known, "event_type", "user_id", "canonical").select("event_id", "canonical")


# Ranks, percentiles, vectors, trends


@query(f"""WITH {RATINGS}, r AS (SELECT player, position, score, rank() OVER (PARTITION BY position ORDER BY score) AS rk, count(*) OVER (PARTITION BY position) AS n, count(*) OVER (PARTITION BY position, score) AS ties, rank() OVER (PARTITION BY position ORDER BY score DESC) AS rank_desc FROM ratings)
SELECT player, 100.0::DOUBLE * (rk - 1) / n AS pct_strict, 100.0::DOUBLE * (rk - 1 + ties / 2.0::DOUBLE) / n AS pct_mid, 100.0::DOUBLE * (rk + (ties - 1) / 2.0::DOUBLE) / n AS pct_average, rank_desc FROM r""")
def position_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.percentiles(ratings(spark, sf_dir).select("player", "position", "score"), ["position"], "score").select("player", "pct_strict", "pct_mid", "pct_average", "rank_desc")


@query("SELECT l_suppkey, sum(l_extendedprice * l_quantity) / sum(l_quantity) AS price, sum(l_discount * l_quantity) / sum(l_quantity) AS discount, sum(l_quantity) AS weight FROM lineitem GROUP BY l_suppkey HAVING sum(l_quantity) >= 100")
def weighted_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(stats.wavg("l_extendedprice", "l_quantity").alias("price"), stats.wavg("l_discount", "l_quantity").alias("discount"), F.sum("l_quantity").alias("weight")).where("weight >= 100")


@query(f"WITH {RATINGS}, z AS (SELECT player, (score - avg(score) OVER (PARTITION BY position)) / coalesce(nullif(stddev_pop(score) OVER (PARTITION BY position), 0), 1) AS z_score FROM ratings) SELECT player, z_score, abs(z_score) >= 1.7 AS outlier FROM z")
def zscore_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.zscored(ratings(spark, sf_dir).select("player", "position", "score"), ["score"], ["position"]).select("player", "z_score", (F.abs("z_score") >= 1.7).alias("outlier"))


@query("""WITH p AS (SELECT q.vec_id AS query, v.vec_id AS neighbour, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS similarity FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
SELECT query, neighbour, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, neighbour) AS rank FROM p) WHERE rank <= 10""")
def similar_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return stats.nearest(v, v.where("vec_id % 50 = 0"), "vec_id", "embedding", 10).select("query", "neighbour", "rank")


MONTHLY = "m AS (SELECT c_nationkey AS nation, (year(o_orderdate) * 12 + month(o_orderdate))::BIGINT AS t, avg(o_totalprice) AS y FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"


@query(f"""WITH {MONTHLY}, r AS (SELECT nation, regr_slope(y, t) AS slope, regr_r2(y, t) AS r2, count(*) AS n, arg_max(y, t) - arg_min(y, t) AS change, avg(y) AS mean FROM m GROUP BY nation)
SELECT *, CASE WHEN change / abs(mean) > 0.05 THEN 'increasing' WHEN change / abs(mean) < -0.05 THEN 'decreasing' ELSE 'stable' END AS label FROM r""")
def style_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    m = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("nation"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("t")).agg(F.avg("o_totalprice").alias("y"))
    return stats.trend(m, ["nation"], "t", "y")


@query(f"WITH {RATINGS}, b AS (SELECT least(greatest(floor((score + 1000) / 1100), 0), 9)::INT AS bin, position FROM ratings) SELECT position, bin, count(*) AS n FROM b GROUP BY ALL")
def style_atlas_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratings(spark, sf_dir).select("position", stats.equal_bin(F.col("score"), -1000.0, 10000.0, 10).alias("bin")).groupBy("position", "bin").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT list_distinct(quantile_cont(l_quantity, [0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS e FROM lineitem) SELECT bin, count(*) AS n, min(l_quantity) AS low, max(l_quantity) AS high
FROM (SELECT l_quantity, greatest(len(list_filter(e, lambda x: x < l_quantity)) - 1, 0)::INT AS bin FROM lineitem, e) GROUP BY bin""")
def quantile_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.quantile_bins(table(spark, sf_dir, "lineitem").select("l_quantity"), "l_quantity", 5).groupBy("bin").agg(F.count("*").alias("n"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))


@query("""WITH v AS (SELECT event_type, value, count(*) FILTER (event_id < half) AS a, count(*) FILTER (event_id >= half) AS b FROM events, (SELECT max(event_id) / 2.0 AS half FROM events) GROUP BY ALL),
g AS (SELECT event_type, a, b, abs(sum(a) OVER u / sum(a) OVER t::DOUBLE - sum(b) OVER u / sum(b) OVER t::DOUBLE) AS gap FROM v WINDOW u AS (PARTITION BY event_type ORDER BY value ROWS UNBOUNDED PRECEDING), t AS (PARTITION BY event_type))
SELECT event_type, max(gap) AS ks, sum(a)::BIGINT AS n_a, sum(b)::BIGINT AS n_b FROM g GROUP BY event_type""")
def data_drift_ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    half = e.agg((F.max("event_id") / 2.0).alias("half"))
    return stats.ks_distance(e.crossJoin(F.broadcast(half)), "value", F.col("event_id") >= F.col("half"), ["event_type"])


@query(f"""WITH {RATINGS}, k AS (SELECT position, rank() OVER (PARTITION BY position ORDER BY score) + (count(*) OVER (PARTITION BY position, score) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY position ORDER BY minutes) + (count(*) OVER (PARTITION BY position, minutes) - 1) / 2.0::DOUBLE AS b FROM ratings)
SELECT position, corr(a, b) AS spearman, count(*) AS n FROM k GROUP BY position""")
def spearman_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.spearman(ratings(spark, sf_dir).select("position", "score", "minutes"), ["position"], "score", "minutes")


@query(f"""WITH {RATINGS}, p AS (SELECT position, sum(score * minutes) FILTER (minutes >= 900) / sum(minutes) FILTER (minutes >= 900) AS prior FROM ratings GROUP BY position), s AS (SELECT player, position, 900.0::DOUBLE / (900.0 + minutes) AS w, score, prior FROM ratings JOIN p USING (position))
SELECT player, w * prior + (1 - w) * score AS shrunk, rank() OVER (PARTITION BY position ORDER BY w * prior + (1 - w) * score DESC) AS rank FROM s""")
def shrunk_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ratings(spark, sf_dir)
    core = F.col("minutes") >= 900
    prior = r.groupBy("position").agg(stats.wavg(F.when(core, F.col("score")), F.col("minutes")).alias("prior"))
    out = r.join(prior, "position").withColumn("shrunk", stats.shrunk(F.col("score"), F.col("minutes"), F.col("prior"), 900.0))
    return stats.ranked(out.select("player", "position", "shrunk"), ["position"], "shrunk").select("player", "shrunk", "rank")


# Actions


@query(f"WITH {ACTIONS} SELECT {CELL.format(x='start_x', y='start_y')} AS cell, count(*) AS actions, count(*) FILTER (event_type = 'click') AS shots, count(*) FILTER (event_type = 'purchase') AS goals FROM actions GROUP BY 1")
def xt_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = actions(spark, sf_dir).withColumn("cell", act.cell(F.col("start_x"), F.col("start_y")))
    return act.shot_rates(a, "cell", F.col("event_type") == "click", F.col("event_type") == "purchase").select("cell", "actions", "shots", "goals")


@query(f"WITH m AS (SELECT event_type AS start, lead(event_type) OVER {EVENT_WINDOW}) AS stop FROM events), c AS (SELECT start, stop, count(*) AS moves FROM m WHERE stop IS NOT NULL GROUP BY ALL) SELECT *, moves / sum(moves) OVER (PARTITION BY start)::DOUBLE AS share FROM c")
def xt_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumns({"start": F.col("event_type"), "stop": F.lead("event_type").over(windows.ordered(USER, ORDER))})
    return act.transitions(e, "start", "stop")


@query(f"""WITH RECURSIVE {ACTIONS}, a AS (SELECT event_id, user_id, event_type, {CELL.format(x="start_x", y="start_y")} AS cell, {CELL.format(x="end_x", y="end_y")} AS "to" FROM actions),
rates AS (SELECT cell, count(*) FILTER (event_type IN ('click', 'purchase')) / count(*)::DOUBLE AS shot, coalesce(count(*) FILTER (event_type = 'purchase') / nullif(count(*) FILTER (event_type IN ('click', 'purchase')), 0)::DOUBLE, 0) AS goal FROM a GROUP BY cell),
pairs AS (SELECT cell, "to", count(*) AS n FROM a GROUP BY cell, "to"), moves AS (SELECT cell, "to", n / sum(n) OVER (PARTITION BY cell)::DOUBLE AS share FROM pairs), grid AS (SELECT cell, "to", share FROM moves UNION ALL SELECT cell, cell, 0 FROM rates),
it AS (SELECT 0 AS step, cell, 0.0::DOUBLE AS val FROM rates UNION ALL
 SELECT * FROM (SELECT it.step + 1 AS step, r.cell AS cell, least(greatest(max(r.shot * r.goal) + (1 - max(r.shot)) * sum(g.share * it.val), 0), 1)::DOUBLE AS val FROM it JOIN grid g ON g."to" = it.cell JOIN rates r ON r.cell = g.cell WHERE it.step < 25 GROUP BY it.step + 1, r.cell)),
f AS (SELECT cell, val AS v FROM it WHERE step = 25)
SELECT event_id, user_id, coalesce(y.v, 0) - coalesce(x.v, 0) AS xt FROM a LEFT JOIN f x ON x.cell = a.cell LEFT JOIN f y ON y.cell = a."to\"""")
def xt_action_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = actions(spark, sf_dir).withColumns({"cell": act.cell(F.col("start_x"), F.col("start_y")), "to": act.cell(F.col("end_x"), F.col("end_y"))})
    rates = act.shot_rates(a, "cell", F.col("event_type").isin("click", "purchase"), F.col("event_type") == "purchase")
    values = act.threat(rates, act.transitions(a, "cell", "to"), "cell", "cell", "to", steps=25, tolerance=0.0)
    return act.valued(a, values, "cell", "to").select("event_id", "user_id", "xt")


@query(f"WITH {ACTIONS} SELECT event_id, sqrt((100 - start_x) * (100 - start_x) + (50 - start_y) * (50 - start_y)) AS goal_distance, atan2(abs(50 - start_y), 100 - start_x) AS goal_angle, CASE WHEN end_x >= 83.3 THEN 'penalty_area' WHEN end_x >= 66.7 THEN 'final_third' WHEN end_x >= 33.3 THEN 'middle_third' ELSE 'defensive_third' END AS zone, CASE WHEN minute <= 15 THEN '0-15' WHEN minute <= 30 THEN '16-30' WHEN minute <= 45 THEN '31-45+' WHEN minute <= 60 THEN '46-60' WHEN minute <= 75 THEN '61-75' ELSE '76-90+' END AS bucket FROM actions")
def action_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = actions(spark, sf_dir)
    return a.withColumns(act.goal_geometry(F.col("start_x"), F.col("start_y"))).select("event_id", "goal_distance", "goal_angle", act.zone(F.col("end_x")).alias("zone"), act.time_bucket(F.col("minute")).alias("bucket"))


@query(f"WITH {ACTIONS} SELECT user_id, count(*) FILTER (event_type = 'view') AS n_view, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'purchase') AS n_purchase, count(*) AS n FROM actions GROUP BY user_id")
def action_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return act.counted(actions(spark, sf_dir), USER, "event_type", ["view", "click", "purchase"])


@query(f"WITH {ACTIONS}, i AS (SELECT user_id, side, event_type, sum(value) AS v, count(*) AS n, greatest(45, max(minute) - min(minute)) AS minutes FROM actions GROUP BY ALL) SELECT user_id, sum(v) AS total, sum(n)::BIGINT AS actions, sum(minutes)::BIGINT AS minutes, count(*) AS matches, sum(v) * 90.0 / sum(minutes)::DOUBLE AS per_90 FROM i GROUP BY user_id")
def two_level_per_90(spark: SparkSession, sf_dir: str) -> DataFrame:
    return act.two_level(actions(spark, sf_dir), ["user_id", "side", "event_type"], ["user_id"], "value", "minute")


# Leagues


STANDINGS = TEAMS + """, tab AS (SELECT league, season, team, count(*) AS played, count(*) FILTER (points = 3) AS won, count(*) FILTER (points = 1) AS drawn, count(*) FILTER (points = 0) AS lost, sum(goals_for)::BIGINT AS gf, sum(goals_against)::BIGINT AS ga, sum(points)::BIGINT AS pts, sum(points) FILTER (side = 'home')::BIGINT AS home_pts FROM teams GROUP BY ALL),
standings AS (SELECT *, gf - ga AS gd, row_number() OVER (PARTITION BY league, season ORDER BY pts DESC, gf - ga DESC, gf DESC, team DESC) AS rank FROM tab)"""


@query(f"WITH {STANDINGS} SELECT * FROM standings")
def league_standings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return league.standings(teams(spark, sf_dir))


@query(f"WITH {TEAMS}, r AS (SELECT *, row_number() OVER (PARTITION BY league, team ORDER BY match_date DESC, match_id DESC) AS rn FROM teams) SELECT league, team, count(*) AS played, avg(points) AS ppg, sum(goal_diff)::BIGINT AS gd, string_agg(CASE points WHEN 3 THEN 'W' WHEN 1 THEN 'D' ELSE 'L' END, '' ORDER BY rn) AS form FROM r WHERE rn <= 5 GROUP BY league, team")
def league_form_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return league.form_table(teams(spark, sf_dir), 5)


@query(f"WITH {TEAMS} SELECT team, opponent, count(*) AS meetings, count(*) FILTER (points = 3) AS wins, count(*) FILTER (points = 1) AS draws, sum(goals_for)::BIGINT AS gf, sum(goals_against)::BIGINT AS ga FROM teams GROUP BY team, opponent")
def head_to_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return league.head_to_head(teams(spark, sf_dir))


@query(f"""WITH {STANDINGS}, t AS (SELECT league, season, pts, gd, gf, team FROM standings), p AS (SELECT a.league, a.season, a.pts, a.gd, a.gf, a.team AS x, b.team AS y FROM t a JOIN t b ON a.league = b.league AND a.season = b.season AND a.pts = b.pts AND a.gd = b.gd AND a.gf = b.gf AND a.team < b.team)
SELECT league, season, pts, gd, gf, count(*) AS pairs, count(*) FILTER (EXISTS (SELECT 1 FROM matches m WHERE m.league = p.league AND m.season = p.season AND least(m.home, m.away) = x AND greatest(m.home, m.away) = y)) AS met,
 count(*) = count(*) FILTER (EXISTS (SELECT 1 FROM matches m WHERE m.league = p.league AND m.season = p.season AND least(m.home, m.away) = x AND greatest(m.home, m.away) = y)) AS complete FROM p GROUP BY ALL""")
def tiebreak_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = teams(spark, sf_dir)
    return league.tied_clusters(league.standings(t), t)


@query(f"WITH {MATCHES}, x AS (SELECT match_id, ln(1 + greatest(home * 10.0, 1e-6)) - ln(1 + greatest(away * 10.0, 1e-6)) + 0.3 AS d FROM matches), y AS (SELECT match_id, 0.28 * exp(-abs(d)) AS p_draw, (1 - 0.28 * exp(-abs(d))) / (1 + exp(-d)) AS p_home FROM x) SELECT match_id, p_home, p_draw, 1 - p_draw - p_home AS p_away, 3 * p_home + p_draw AS expected_points FROM y")
def fixture_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir).withColumns(league.bradley_terry(F.col("home") * 10.0, F.col("away") * 10.0)).select("match_id", "p_home", "p_draw", "p_away", "expected_points")


STRENGTHS = MATCHES + """, mu AS (SELECT avg(home_goals) AS mh, avg(away_goals) AS ma FROM matches), h AS (SELECT home AS team, sum(home_goals) AS hf, sum(away_goals) AS ha, count(*) AS hn FROM matches GROUP BY home), a AS (SELECT away AS team, sum(away_goals) AS af, sum(home_goals) AS aa, count(*) AS an FROM matches GROUP BY away),
strengths AS (SELECT team, mh AS mu_home, ma AS mu_away, (hf + mh) / ((hn + 1) * mh) AS home_attack, (ha + ma) / ((hn + 1) * ma) AS home_defence, (af + ma) / ((an + 1) * ma) AS away_attack, (aa + mh) / ((an + 1) * mh) AS away_defence FROM h JOIN a USING (team) CROSS JOIN mu)"""
GRID = STRENGTHS + """, l AS (SELECT h.team AS home, a.team AS away, h.mu_home * h.home_attack * a.away_defence AS lh, h.mu_away * a.away_attack * h.home_defence AS la FROM strengths h JOIN strengths a ON h.team <> a.team),
g AS (SELECT home, away, i, j, exp(-lh) * pow(lh, i) / factorial(i::INT) * exp(-la) * pow(la, j) / factorial(j::INT){tau} AS q FROM l, range(0, 11) x(i), range(0, 11) y(j))
SELECT home * 100 + away AS match_id, sum(q) FILTER (i > j) / sum(q) AS p_home, sum(q) FILTER (i = j) / sum(q) AS p_draw, sum(q) FILTER (i < j) / sum(q) AS p_away, sum(q) FILTER (i + j > 2) / sum(q) AS p_over, sum(q) FILTER (i > 0 AND j > 0) / sum(q) AS p_btts FROM g GROUP BY home, away"""
TAU = " * CASE WHEN i = 0 AND j = 0 THEN 1 + lh * la * 0.1 WHEN i = 0 AND j = 1 THEN 1 - lh * 0.1 WHEN i = 1 AND j = 0 THEN 1 - la * 0.1 WHEN i = 1 AND j = 1 THEN 1.1 ELSE 1 END"


def pairings(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir)
    pairs = m.select("home").distinct().join(m.select(F.col("home").alias("away")).distinct(), F.col("home") != F.col("away"))
    return league.rates(pairs.withColumn("match_id", F.col("home") * 100 + F.col("away")), league.poisson_strengths(m))


@query(f"WITH {STRENGTHS} SELECT * FROM strengths")
def poisson_strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return league.poisson_strengths(matches(spark, sf_dir))


@query("WITH " + GRID.format(tau=""))
def poisson_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return league.outcome_probabilities(league.score_matrix(pairings(spark, sf_dir)))


@query("WITH " + GRID.format(tau=TAU))
def dixon_coles_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return league.outcome_probabilities(league.score_matrix(pairings(spark, sf_dir), rho=-0.1))


IN_PLAY = GRID.format(tau="").split(",\ng AS")[0] + """, lt AS (SELECT home, away, minute, lh * (1 - minute / 90.0::DOUBLE) AS lh, la * (1 - minute / 90.0::DOUBLE) AS la FROM l, range(0, 91, 5) t(minute)),
g AS (SELECT home, away, minute, i, j, exp(-lh) * pow(lh, i) / factorial(i::INT) * exp(-la) * pow(la, j) / factorial(j::INT) AS q FROM lt, range(0, 11) x(i), range(0, 11) y(j))
SELECT home * 100 + away AS match_id, minute::INT AS minute, sum(q) FILTER (i > j) / sum(q) AS p_home, sum(q) FILTER (i = j) / sum(q) AS p_draw, sum(q) FILTER (i < j) / sum(q) AS p_away FROM g GROUP BY home, away, minute"""


@query("WITH " + IN_PLAY)
def in_play_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return league.in_play(pairings(spark, sf_dir))


#: A uniform number from a text, as league.uniform() makes it.
UNIFORM = "('0x' || substr(md5({x}), 1, 12))::BIGINT / 281474976710656.0::DOUBLE"
BRADLEY_TERRY = "d0 AS (SELECT *, ln(1 + greatest({h}, 1e-6)) - ln(1 + greatest({a}, 1e-6)) + 0.3 AS d FROM {t}), odds AS (SELECT *, 0.28 * exp(-abs(d)) AS p_draw, (1 - 0.28 * exp(-abs(d))) / (1 + exp(-d)) AS p_home FROM d0)"


@query(f"""WITH {SEASONS}, {BRADLEY_TERRY.format(h="(home % 10)::DOUBLE", a="(away % 10)::DOUBLE", t="unplayed")},
pts AS (SELECT league, season, team, sum(p) AS pts FROM (SELECT league, season, home AS team, CASE WHEN home_goals > away_goals THEN 3 WHEN home_goals = away_goals THEN 1 ELSE 0 END AS p FROM seasons WHERE played
 UNION ALL SELECT league, season, away, CASE WHEN home_goals < away_goals THEN 3 WHEN home_goals = away_goals THEN 1 ELSE 0 END FROM seasons WHERE played) GROUP BY ALL),
drawn AS (SELECT sim, league, season, home, away, p_home, p_draw, {UNIFORM.format(x="'7|' || sim || '|' || season || '-' || home || '-' || away")} AS u FROM odds, range(0, 10) s(sim)),
won AS (SELECT sim, league, season, team, sum(p) AS won FROM (SELECT sim, league, season, home AS team, CASE WHEN u < p_home THEN 3 WHEN u < p_home + p_draw THEN 1 ELSE 0 END AS p FROM drawn
 UNION ALL SELECT sim, league, season, away, CASE WHEN u < p_home THEN 0 WHEN u < p_home + p_draw THEN 1 ELSE 3 END FROM drawn) GROUP BY ALL),
total AS (SELECT sim, league, season, team, coalesce(pts, 0) + coalesce(won, 0) AS total FROM sides CROSS JOIN range(0, 10) s(sim) LEFT JOIN pts USING (league, season, team) LEFT JOIN won USING (sim, league, season, team)),
placed AS (SELECT *, row_number() OVER (PARTITION BY sim, league, season ORDER BY total DESC, team) AS place FROM total)
SELECT league, season, team, avg(total)::DOUBLE AS mean_points, avg(place) AS mean_place, avg((place = 1)::INT) AS p_first FROM placed GROUP BY ALL""")
def season_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = seasons(spark, sf_dir)
    sides = season_teams(m)
    pts = joins.team_rows(m.where("played")).groupBy("league", "season", "team").agg(F.sum("points").alias("pts"))
    table_ = sides.join(pts, ["league", "season", "team"], "left").na.fill(0, ["pts"])
    left = joins.unplayed(sides, m.where("played")).withColumn("match_id", F.concat_ws("-", "season", "home", "away"))
    return league.simulated_seasons(table_, left.withColumns(league.bradley_terry(F.col("home") % 10, F.col("away") % 10)), 10, 7)


# Forecast evaluation


@query(f"WITH {SCORED} SELECT match_id, brier, rps, log_loss, confidence, entropy, margin, correct FROM scored")
def forecast_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.scored(forecasts(spark, sf_dir)).select("match_id", "brier", "rps", "log_loss", "confidence", "entropy", "margin", "correct")


@query(f"WITH {SCORED} SELECT league, count(*) AS n, avg(brier) AS brier, avg(rps) AS rps, avg(log_loss) AS log_loss, avg(correct) AS accuracy, avg(confidence) AS confidence FROM scored GROUP BY league")
def league_coverage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.summary(bt.scored(forecasts(spark, sf_dir)), ["league"])


@query(f"""WITH {SCORED}, l AS (SELECT 'home' AS class, p_home AS p, yh AS y FROM scored UNION ALL SELECT 'draw', p_draw, yd FROM scored UNION ALL SELECT 'away', p_away, ya FROM scored)
SELECT class, least(greatest(floor((p - 0.0) / (1.0::DOUBLE / 10)), 0), 9)::INT AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS observed FROM l GROUP BY ALL""")
def reliability_diagram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.reliability(forecasts(spark, sf_dir), 10)


@query(f"""WITH {SCORED}, l AS (SELECT least(greatest(floor((p_home - 0.0) / (1.0::DOUBLE / 10)), 0), 9) AS bin, unnest([{{'c': 'h', 'p': p_home, 'y': yh}}, {{'c': 'd', 'p': p_draw, 'y': yd}}, {{'c': 'a', 'p': p_away, 'y': ya}}], recursive := true) FROM scored),
b AS (SELECT bin, c, count(*) AS n, avg(p) AS p, avg(y) AS y FROM l GROUP BY ALL), t AS (SELECT c, sum(n) AS total, sum(n * y) / sum(n) AS base FROM b GROUP BY c)
SELECT sum(n / total::DOUBLE * (p - y) * (p - y)) AS reliability, sum(n / total::DOUBLE * (y - base) * (y - base)) AS resolution, (SELECT sum(base * (1 - base)) FROM t) AS uncertainty FROM b JOIN t USING (c)""")
def brier_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.brier_parts(forecasts(spark, sf_dir))


@query(f'WITH {SCORED}, s AS (SELECT min(match_date::DATE) AS d0 FROM scored) SELECT ((match_date::DATE - d0) // 90)::BIGINT AS "window", count(*) AS n, avg(brier) AS mean_brier FROM scored, s GROUP BY 1')
def calibration_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.time_windows(bt.scored(forecasts(spark, sf_dir)), "match_date", 90, ["brier"])


@query(f"WITH {SCORED}, r AS (SELECT brier, row_number() OVER (ORDER BY match_date, match_id) - 1 AS i, count(*) OVER () AS n FROM scored) SELECT least(i // (n // 5), 4)::INT AS chunk, count(*) AS n, avg(brier) AS mean_brier FROM r GROUP BY 1")
def temporal_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.equal_counts(bt.scored(forecasts(spark, sf_dir)), ["match_date", "match_id"], 5, ["brier"])


@query(f"""WITH {FORECASTS}, o AS (SELECT match_id, 'home' AS bet, p_home AS p, 2.0 + home / 10.0::DOUBLE AS odds FROM forecasts UNION ALL SELECT match_id, 'draw', p_draw, 3.5::DOUBLE FROM forecasts UNION ALL SELECT match_id, 'away', p_away, 2.0 + away / 10.0::DOUBLE FROM forecasts),
v AS (SELECT *, 1 / odds / (sum(1 / odds) OVER (PARTITION BY match_id)) AS implied FROM o)
SELECT match_id, bet, p * odds - 1 AS ev, p - implied AS edge, greatest((p * odds - 1) / (odds - 1), 0) AS kelly FROM v WHERE p * odds - 1 >= 0.05""")
def value_bets(spark: SparkSession, sf_dir: str) -> DataFrame:
    odds = {"home": 2.0 + F.col("home") / 10.0, "draw": F.lit(3.5), "away": 2.0 + F.col("away") / 10.0}
    return bt.value_bets(forecasts(spark, sf_dir), odds, 0.05).select("match_id", "bet", "ev", "edge", "kelly")


@query(f"""WITH {SCORED}, c AS (SELECT *, CASE WHEN lag(correct) OVER w = correct THEN 0 ELSE 1 END AS change FROM scored WINDOW w AS (PARTITION BY league ORDER BY match_date, match_id)), k AS (SELECT league, correct, sum(change) OVER (PARTITION BY league ORDER BY match_date, match_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM c)
SELECT league, run, min(correct) AS correct, count(*) AS length FROM k GROUP BY league, run""")
def prediction_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.streaks(bt.scored(forecasts(spark, sf_dir)).select("league", "match_date", "match_id", "correct"), ["league"], ["match_date", "match_id"], "correct")


@query(f"WITH {SCORED}, p AS (SELECT match_id, league, match_date, sum(CASE WHEN correct = 1 THEN 1 / confidence - 1 ELSE -1.0 END) OVER w AS profit FROM scored WINDOW w AS (PARTITION BY league ORDER BY match_date, match_id ROWS UNBOUNDED PRECEDING)) SELECT match_id, profit, greatest(max(profit) OVER (PARTITION BY league ORDER BY match_date, match_id ROWS UNBOUNDED PRECEDING), 0) - profit AS drawdown FROM p")
def profit_and_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = bt.scored(forecasts(spark, sf_dir))
    return bt.drawdown(s, ["league"], ["match_date", "match_id"], F.when(F.col("correct") == 1, 1 / F.col("confidence") - 1).otherwise(-1.0)).select("match_id", "profit", "drawdown")


@query(f"WITH {SCORED} SELECT CASE WHEN confidence >= 0.55 THEN 'easy' WHEN confidence < 0.45 THEN 'hard' ELSE 'medium' END AS tier, count(*) AS n, avg(brier) AS brier, avg(rps) AS rps, avg(log_loss) AS log_loss, avg(correct) AS accuracy, avg(confidence) AS confidence FROM scored GROUP BY 1")
def difficulty_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.summary(bt.scored(forecasts(spark, sf_dir)).withColumn("tier", bt.difficulty(0.55, 0.45)), ["tier"])


@query(f"WITH {SCORED} SELECT CASE WHEN home_goals >= 2 THEN '2+' ELSE home_goals::VARCHAR END || '-' || CASE WHEN away_goals >= 2 THEN '2+' ELSE away_goals::VARCHAR END AS score, count(*) AS n, avg(p_home) AS p_home, avg(p_draw) AS p_draw, avg(p_away) AS p_away FROM scored GROUP BY 1")
def scoreline_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecasts(spark, sf_dir).groupBy(bt.scoreline(2).alias("score")).agg(F.count("*").alias("n"), F.avg("p_home").alias("p_home"), F.avg("p_draw").alias("p_draw"), F.avg("p_away").alias("p_away"))


@query(f"WITH {SCORED}, l AS (SELECT home AS team, brier, correct FROM scored UNION ALL SELECT away, brier, correct FROM scored) SELECT team, count(*) AS n, avg(brier) AS brier, avg(correct) AS accuracy FROM l GROUP BY team HAVING count(*) >= 5")
def team_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = bt.scored(forecasts(spark, sf_dir))
    both = joins.two_sided(s, {x: {"team": F.col(x), "brier": F.col("brier"), "correct": F.col("correct")} for x in ("home", "away")})
    return both.groupBy("team").agg(F.count("*").alias("n"), F.avg("brier").alias("brier"), F.avg("correct").alias("accuracy")).where("n >= 5")


@query(f"WITH {SCORED}, h AS (SELECT least(greatest(floor((p_home - 0.0) / (1.0::DOUBLE / 5)), 0), 4)::INT AS a, least(greatest(floor((p_away - 0.0) / (1.0::DOUBLE / 5)), 0), 4)::INT AS b, correct FROM scored) SELECT a, b, count(*) AS n, avg(correct) AS accuracy FROM h GROUP BY a, b")
def probability_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = bt.scored(forecasts(spark, sf_dir))
    return s.groupBy(stats.equal_bin(F.col("p_home"), 0.0, 1.0, 5).alias("a"), stats.equal_bin(F.col("p_away"), 0.0, 1.0, 5).alias("b")).agg(F.count("*").alias("n"), F.avg("correct").alias("accuracy"))


@query(f"WITH {SCORED} SELECT match_id, league, brier FROM (SELECT *, row_number() OVER (PARTITION BY league ORDER BY brier DESC, match_id) AS rn FROM scored) WHERE rn <= 10")
def worst_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.latest(bt.scored(forecasts(spark, sf_dir)), ["match_id"], [F.col("brier")]).withColumn("rn", F.row_number().over(windows.ordered(["league"], [F.desc("brier"), "match_id"]))).where("rn <= 10").select("match_id", "league", "brier")


@query(f"WITH {MATCHES}, z AS (SELECT count(*) AS n, count(*) // 6 AS size FROM matches) SELECT fold::INT AS fold, size * fold AS train_end, size * fold + 10 AS test_start, least(size * (fold + 1) + 10, n) AS test_end FROM z, range(1, 6) f(fold)")
def expanding_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.expanding_folds(matches(spark, sf_dir), ["match_date", "match_id"], 5, 10)


# Scouting


@query(f"WITH {RATINGS} SELECT league, position, count(score) AS n, min(score) AS low, quantile_cont(score, 0.5) AS median, max(score) AS high, avg(score) AS mean, stddev_pop(score) AS std, quantile_cont(score, 0.25) AS p25, quantile_cont(score, 0.75) AS p75 FROM ratings WHERE minutes >= 450 GROUP BY league, position")
def position_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.depth(ratings(spark, sf_dir).where("minutes >= 450"), ["league", "position"], "score")


GAPS = RATINGS + """, q AS (SELECT * FROM ratings WHERE minutes >= 450), lp AS (SELECT league, position, quantile_cont(score, 0.4) AS p40, quantile_cont(score, 0.6) AS p60, quantile_cont(score, 0.75) AS p75 FROM q GROUP BY ALL),
tm AS (SELECT DISTINCT team, league FROM ratings), td AS (SELECT team, position, count(*) AS n, avg(score) AS mean FROM q GROUP BY ALL),
gaps AS (SELECT tm.team, tm.league, lp.position, coalesce(n, 0) AS n, mean, CASE WHEN n IS NULL THEN 'missing' WHEN n < 3 THEN 'shallow' WHEN mean < p40 THEN 'low_quality' WHEN mean >= p60 THEN 'strength' ELSE 'adequate' END AS status FROM tm JOIN lp ON tm.league = lp.league LEFT JOIN td ON td.team = tm.team AND td.position = lp.position)"""


def gap_table(r: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(qualified players, league percentiles per position, gaps per team and position)."""
    q = r.where("minutes >= 450")
    lp = stats.quantiles(q, ["league", "position"], "score", {"p40": 0.4, "p60": 0.6, "p75": 0.75})
    td = q.groupBy("team", "position").agg(F.count("*").alias("n"), F.avg("score").alias("mean"))
    g = r.select("team", "league").distinct().join(lp, "league").join(td, ["team", "position"], "left")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") < 3, "shallow").when(F.col("mean") < F.col("p40"), "low_quality").when(F.col("mean") >= F.col("p60"), "strength").otherwise("adequate")
    return q, lp, g.select("team", "league", "position", F.coalesce("n", F.lit(0)).alias("n"), "mean", status.alias("status"))


@query(f"WITH {GAPS} SELECT * FROM gaps")
def position_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gap_table(ratings(spark, sf_dir))[2]


@query(f"""WITH {GAPS}, c AS (SELECT q.player, q.position, q.score, q.league FROM q JOIN lp USING (league, position) WHERE q.score >= lp.p75)
SELECT team, position, player, score FROM (SELECT g.team, g.position, c.player, c.score, row_number() OVER (PARTITION BY g.team, g.position ORDER BY c.score DESC, c.player) AS rn FROM gaps g JOIN c ON c.position = g.position AND c.league <> g.league WHERE g.status IN ('missing', 'shallow', 'low_quality')) WHERE rn <= 5""")
def scouting_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, lp, g = gap_table(ratings(spark, sf_dir))
    best = q.join(lp, ["league", "position"]).where(F.col("score") >= F.col("p75"))
    # five per league and position are enough for five from the other leagues
    best = best.withColumn("_rn", F.row_number().over(windows.ordered(["league", "position"], [F.desc("score"), "player"]))).where("_rn <= 5").select("player", "position", "score", F.col("league").alias("_league"))
    c = g.where("status in ('missing', 'shallow', 'low_quality')").select("team", "league", "position").join(best, "position").where("league <> _league")
    return c.withColumn("rn", F.row_number().over(windows.ordered(["team", "position"], [F.desc("score"), "player"]))).where("rn <= 5").select("team", "position", "player", "score")


@query(f"WITH {RATINGS}, s AS (SELECT position, league, avg(score) AS mean FROM ratings GROUP BY ALL) SELECT position, league, mean, CASE WHEN rn <= ceil(n / 3.0) THEN 'top' WHEN rn <= ceil(2 * n / 3.0) THEN 'middle' ELSE 'bottom' END AS tier FROM (SELECT *, row_number() OVER (PARTITION BY position ORDER BY mean DESC, league) AS rn, count(*) OVER (PARTITION BY position) AS n FROM s)")
def cross_league_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    s = ratings(spark, sf_dir).groupBy("position", "league").agg(F.avg("score").alias("mean"))
    rn, n = F.row_number().over(windows.ordered(["position"], [F.desc("mean"), "league"])), F.count("*").over(Window.partitionBy("position"))
    return s.withColumns({"rn": rn, "n": n}).select("position", "league", "mean", F.when(F.col("rn") <= F.ceil(F.col("n") / 3.0), "top").when(F.col("rn") <= F.ceil(2 * F.col("n") / 3.0), "middle").otherwise("bottom").alias("tier"))


@query(f"WITH {RATINGS} SELECT team, max(minutes) / sum(minutes)::DOUBLE AS top_share, stddev_samp(score) AS spread, count(*) AS n FROM ratings GROUP BY team")
def team_aggregation_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratings(spark, sf_dir).groupBy("team").agg((F.max("minutes") / F.sum("minutes")).alias("top_share"), F.stddev_samp("score").alias("spread"), F.count("*").alias("n"))


# Identity and quality


@query("SELECT c_custkey, trim(regexp_replace(replace(lower(c_name), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS key FROM customer")
def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", scalar.name_key(F.col("c_name")).alias("key"))


@query()
def entity_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers under customers' names against the customers of their nation; held against brute force in the tests."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.regexp_replace("s_name", "(?i)supplier", "Customer").alias("s_name"), F.col("s_nationkey").alias("nation"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("nation"))
    return identity.matched(s, c, "s_suppkey", "s_name", "c_custkey", "c_name", ["nation"])


@query("SELECT o_custkey, year(o_orderdate)::BIGINT AS season, count(DISTINCT o_orderpriority) AS teams, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS names FROM orders GROUP BY 1, 2 HAVING count(DISTINCT o_orderpriority) > 1")
def multi_team_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("season", F.year("o_orderdate").cast("long"))
    return identity.several_teams(o, "o_custkey", "season", "o_orderpriority")


@query("SELECT user_id, event_type, n FROM (SELECT user_id, event_type, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rn FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)) WHERE rn = 1")
def most_common_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.most_common(events(spark, sf_dir), "user_id", "event_type")


@query("""WITH c AS (SELECT count(*) FILTER (l_orderkey IS NULL OR l_linenumber IS NULL) AS a, count(*) FILTER (l_quantity IS NULL) AS b, count(*) FILTER (l_discount < 0) AS d, greatest(100 - count(*), 0) AS e FROM lineitem), k AS (SELECT coalesce(sum(n - 1), 0)::BIGINT AS r FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))
SELECT 'lineitem' AS "table", x."check", x.failures, x.failures = 0 AS passed FROM (SELECT unnest([{'check': 'null_keys', 'failures': a}, {'check': 'null_l_quantity', 'failures': b}, {'check': 'negative_l_discount', 'failures': d}, {'check': 'missing_rows', 'failures': e}, {'check': 'repeated_keys', 'failures': r}]) AS x FROM c, k)""")
def validation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.profile(table(spark, sf_dir, "lineitem"), "lineitem", ["l_orderkey", "l_linenumber"], ["l_quantity"], ["l_discount"], 100)


@query(f"WITH {RATINGS}, c AS (SELECT league, count(DISTINCT team) AS rated FROM ratings WHERE minutes >= 2000 GROUP BY league) SELECT league, rated, least(rated, 5) AS matched, least(rated, 5) / 5.0::DOUBLE AS share, CASE WHEN least(rated, 5) / 5.0 >= 0.9 THEN 'HIGH' WHEN least(rated, 5) / 5.0 >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM c")
def league_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.coverage(ratings(spark, sf_dir).where("minutes >= 2000"), ["league"], "team", 5)


@query(f"WITH {TEAMS} SELECT least(team, opponent) AS first, greatest(team, opponent) AS second, count(DISTINCT team) AS sides, count(*) AS n FROM teams WHERE points = 3 GROUP BY 1, 2 HAVING count(DISTINCT team) > 1")
def pairwise_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.pairwise_conflicts(teams(spark, sf_dir).where("points = 3"), "team", "opponent", "team")


@query("WITH a AS (SELECT l_orderkey, l_linenumber % 3 AS who, max(l_quantity) AS v FROM lineitem GROUP BY ALL) SELECT a.who, b.who AS other, count(*) AS items, avg((abs(a.v - b.v) <= 5)::INT) AS agreement FROM a JOIN a b ON a.l_orderkey = b.l_orderkey AND a.who < b.who GROUP BY ALL")
def annotator_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.agreement(table(spark, sf_dir, "lineitem").withColumn("who", F.col("l_linenumber") % 3), "l_orderkey", "who", "l_quantity", 5.0)


@query(f"WITH {RATINGS} SELECT CASE WHEN minutes < 450 THEN 'minutes' WHEN score < 0 THEN 'score' WHEN position = 'MACHINERY' THEN 'position' ELSE 'included' END AS reason, count(*) AS n FROM ratings GROUP BY 1")
def cohort_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = quality.exclusion({"minutes": F.col("minutes") < 450, "score": F.col("score") < 0, "position": F.col("position") == "MACHINERY"})
    return ratings(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, length(html) - length(replace(html, '<a ', '')) AS links FROM pages")
def html_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), (F.length("html") - F.length(F.replace("html", F.lit("<a "), F.lit("")))).cast("long").alias("links"))


@query("SELECT lang, avg((quality = 1)::INT) AS good, avg((toxic = 1)::INT) AS toxic, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def label_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return j.groupBy("lang").agg(F.avg((F.col("quality") == 1).cast("int")).alias("good"), F.avg((F.col("toxic") == 1).cast("int")).alias("toxic"), F.count("*").alias("n"))


# Tournaments: leagues as groups, months as editions


GROUP_TABLES = TEAMS + """, t AS (SELECT league, (year(match_date) * 12 + month(match_date))::BIGINT AS edition, team, opponent, points, goals_for, goals_for - goals_against AS d FROM teams),
tab AS (SELECT *, count(*) OVER (PARTITION BY league, edition, pts, gd, gf) AS n FROM (SELECT league, edition, team, count(*) AS played, sum(points)::BIGINT AS pts, sum(d)::BIGINT AS gd, sum(goals_for)::BIGINT AS gf FROM t GROUP BY ALL)),
mini AS (SELECT t.league, t.edition, t.team, sum(t.points) AS hp, sum(t.d) AS hd, sum(t.goals_for) AS hf, count(DISTINCT t.opponent) AS met FROM t JOIN tab a ON a.league = t.league AND a.edition = t.edition AND a.team = t.team JOIN tab b ON b.league = t.league AND b.edition = t.edition AND b.team = t.opponent
 WHERE a.n > 1 AND a.pts = b.pts AND a.gd = b.gd AND a.gf = b.gf GROUP BY ALL),
j AS (SELECT tab.*, hp, hd, hf, n > 1 AND min(coalesce(met, 0)) OVER (PARTITION BY league, edition, pts, gd, gf) = n - 1 AS head_to_head FROM tab LEFT JOIN mini USING (league, edition, team)),
group_tables AS (SELECT league, edition, team, played, pts, gd, gf, head_to_head, row_number() OVER (PARTITION BY league, edition ORDER BY pts DESC, gd DESC, gf DESC, CASE WHEN head_to_head THEN hp ELSE 0 END DESC, CASE WHEN head_to_head THEN hd ELSE 0 END DESC, CASE WHEN head_to_head THEN hf ELSE 0 END DESC, team) AS place FROM j),
thirds AS (SELECT *, row_number() OVER (PARTITION BY edition ORDER BY pts DESC, gd DESC, gf DESC, league, team) AS rank FROM group_tables WHERE place = 3)"""


def monthly_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = teams(spark, sf_dir).withColumn("edition", (F.year("match_date") * 12 + F.month("match_date")).cast("long"))
    return tournament.group_tables(t, ["league", "edition"])


@query(f"WITH {GROUP_TABLES} SELECT * FROM group_tables")
def group_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly_tables(spark, sf_dir)


@query(f"WITH {GROUP_TABLES} SELECT edition, league, team, pts, gd, gf, rank FROM thirds WHERE rank <= 2")
def best_thirds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tournament.best_of_place(monthly_tables(spark, sf_dir), "league", ["edition"], 3, 2).select("edition", "league", "team", "pts", "gd", "gf", "rank")


@query(f"WITH {GROUP_TABLES} SELECT edition, league, team, CASE place WHEN 1 THEN 'winner' ELSE 'runner-up' END AS through FROM group_tables WHERE place <= 2 UNION ALL SELECT edition, league, team, 'third' FROM thirds WHERE rank <= 2")
def advancing_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tournament.advancing(monthly_tables(spark, sf_dir), "league", ["edition"], 2)


def national_strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations in the groups of their regions; strength from how many customers each has."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    counts = c.groupBy(F.col("c_nationkey").alias("nation")).agg((F.count("*") / 10.0 + 1).alias("strength"))
    return counts.join(n.select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region")), "nation")


@query("""WITH s AS (SELECT n_regionkey AS region, n_nationkey AS nation, pow(n / 10.0::DOUBLE + 1, 2.5) AS s FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) JOIN nation ON c_nationkey = n_nationkey), t AS (SELECT *, sum(s) OVER (PARTITION BY region) AS t FROM s),
b AS (SELECT i.region, i.nation, sum(j.s / i.t * i.s / (i.t - j.s)) AS p2 FROM t i JOIN t j ON i.region = j.region AND i.nation <> j.nation GROUP BY ALL),
c AS (SELECT i.region, i.nation, sum(j.s / i.t * k.s / (i.t - j.s) * i.s / (i.t - j.s - k.s)) AS p3 FROM t i JOIN t j ON i.region = j.region AND i.nation <> j.nation JOIN t k ON k.region = i.region AND k.nation NOT IN (i.nation, j.nation) GROUP BY ALL)
SELECT region, nation, s / t AS p1, coalesce(p2, 0) AS p2, coalesce(p3, 0) AS p3, greatest(1 - s / t - coalesce(p2, 0) - coalesce(p3, 0), 0) AS p4, least(s / t + coalesce(p2, 0) + coalesce(p3, 0) * 8 / 12.0::DOUBLE, 1) AS p_advance FROM t LEFT JOIN b USING (region, nation) LEFT JOIN c USING (region, nation)""")
def group_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tournament.group_places(national_strengths(spark, sf_dir), "region", "nation", "strength")


def _knockout_sql(rounds: int, sims: int, seed: int) -> str:
    """Each round's winners from the round before, as common table expressions."""
    s = f"a0 AS (SELECT sim, slot, team, s FROM bracket, range(0, {sims}) x(sim))"
    for r in range(1, rounds + 1):
        chance = "CASE WHEN a.s <= 0 AND b.s <= 0 THEN 0.5 ELSE pow(greatest(a.s, 1e-6), 2.8) / (pow(greatest(a.s, 1e-6), 2.8) + pow(greatest(b.s, 1e-6), 2.8)) END"
        wins = UNIFORM.format(x=f"'{seed}|' || a.sim || '|{r}|' || (a.slot // 2)") + " < " + chance
        s += f", a{r} AS (SELECT a.sim, a.slot // 2 AS slot, CASE WHEN {wins} THEN a.team ELSE b.team END AS team, CASE WHEN {wins} THEN a.s ELSE b.s END AS s FROM a{r - 1} a JOIN a{r - 1} b ON a.sim = b.sim AND b.slot = a.slot + 1 WHERE a.slot % 2 = 0)"
    return s + " " + " UNION ALL ".join(f"SELECT team, {r} AS round, count(*) / {sims}.0::DOUBLE AS share FROM a{r} GROUP BY team" for r in range(1, rounds + 1))


@query(f"""WITH t AS (SELECT c_nationkey AS team, count(*) / 10.0::DOUBLE + 1 AS s FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 16),
bracket AS (SELECT row_number() OVER (ORDER BY team) - 1 AS slot, team, s FROM t), {_knockout_sql(4, 2000, 11)}""")
def knockout_simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sixteen strongest nations in a bracket, as the feature needs a power of two."""
    s = national_strengths(spark, sf_dir).orderBy(F.desc("strength"), "nation").limit(16)
    from pyspark.sql import Window

    slot = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("nation")) - 1  # sixteen rows
    return tournament.simulated_bracket(s.select(slot.alias("slot"), F.col("nation").alias("team"), "strength"), 4, 2000, 11)


@query(f"WITH {SCORED}, x AS (SELECT outcome, CASE WHEN p_home = confidence THEN 'home' WHEN p_draw = confidence THEN 'draw' ELSE 'away' END AS favoured FROM scored), c AS (SELECT unnest(['home', 'draw', 'away']) AS class) SELECT class, count(*) FILTER (favoured = class) / count(*)::DOUBLE AS predicted, count(*) FILTER (outcome = class) / count(*)::DOUBLE AS actual, (count(*) FILTER (favoured = class) - count(*) FILTER (outcome = class)) / count(*)::DOUBLE AS bias FROM x, c GROUP BY class")
def outcome_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.outcome_shares(forecasts(spark, sf_dir))


@query(f"WITH {SCORED} SELECT least(greatest(floor((confidence - 1.0::DOUBLE / 3) / ((1.0::DOUBLE - 1.0::DOUBLE / 3) / 7)), 0), 6)::INT AS bin, count(*) AS n, avg(brier) AS brier, avg(rps) AS rps, avg(log_loss) AS log_loss, avg(correct) AS accuracy, avg(confidence) AS confidence, avg(confidence) - avg(correct) AS gap FROM scored GROUP BY 1")
def error_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.error_bins(bt.scored(forecasts(spark, sf_dir)), 7)


@query(f"WITH {SCORED} SELECT m.model, count(*) AS n, avg(CASE m.model WHEN 'own' THEN brier ELSE 2 / 3.0::DOUBLE END) AS brier, avg(CASE m.model WHEN 'own' THEN rps WHEN 'even' THEN CASE outcome WHEN 'draw' THEN 1 / 9.0::DOUBLE ELSE 5 / 18.0::DOUBLE END END) AS rps, avg(CASE m.model WHEN 'own' THEN log_loss ELSE ln(3.0::DOUBLE) END) AS log_loss, avg(CASE m.model WHEN 'own' THEN correct ELSE (outcome = 'home')::INT END) AS accuracy, avg(CASE m.model WHEN 'own' THEN confidence ELSE 1 / 3.0::DOUBLE END) AS confidence FROM scored, (SELECT unnest(['own', 'even']) AS model) m WHERE match_id % 3 > 0 GROUP BY m.model")
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = forecasts(spark, sf_dir)
    even = f.where("match_id % 3 > 0").withColumns({f"p_{o}": F.lit(1 / 3) for o in bt.OUTCOMES})
    return bt.compared({"own": f, "even": even}, "match_id")


@query(f"WITH {SCORED}, a AS (SELECT match_id, concat_ws('|', CASE WHEN entropy >= 0.95 THEN 'high_entropy' END, CASE WHEN confidence >= 0.6 AND correct = 0 THEN 'overconfident' END, CASE WHEN confidence <= 0.45 AND correct = 1 THEN 'underconfident' END) AS reasons FROM scored) SELECT * FROM a WHERE reasons <> ''")
def forecast_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.anomalies(bt.scored(forecasts(spark, sf_dir)), 0.95, 0.6, 0.45).select("match_id", "reasons")


@query(f"WITH {SCORED}, w AS (SELECT match_id, avg(correct) OVER (PARTITION BY league ORDER BY match_date, match_id ROWS UNBOUNDED PRECEDING) AS cum_correct, avg(brier) OVER (PARTITION BY league ORDER BY match_date, match_id ROWS UNBOUNDED PRECEDING) AS cum_brier, avg(correct) OVER (PARTITION BY league ORDER BY match_date, match_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS last_10_correct, avg(brier) OVER (PARTITION BY league ORDER BY match_date, match_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS last_10_brier FROM scored) SELECT * FROM w")
def cumulative_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = bt.trajectory(bt.scored(forecasts(spark, sf_dir)), ["league"], ["match_date", "match_id"], ["correct", "brier"], 10)
    return t.select("match_id", "cum_correct", "cum_brier", "last_10_correct", "last_10_brier")

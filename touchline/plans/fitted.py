"""Queries of fitted models, and the SQL of those that it can express; the others are held against plain versions in the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators import backtest as bt
from touchline.operators import diagnostics, league, models, stats, windows

from .registry import query
from .stand_ins import CAREERS, FORECASTS, MATCHES, SCORED, actions, careers, forecasts, matches, ratings

FOLDS = MATCHES + """, nr AS (SELECT *, row_number() OVER (ORDER BY match_date, match_id) - 1 AS i, count(*) OVER () AS n FROM matches), f AS (SELECT *, n // 4 AS size FROM nr, range(1, 4) t(fold)),
train AS (SELECT * FROM f WHERE i < size * fold), test AS (SELECT * FROM f WHERE i >= size * fold + 10 AND i < least(size * (fold + 1) + 10, n)),
mu AS (SELECT fold, avg(home_goals) AS mh, avg(away_goals) AS ma FROM train GROUP BY fold), h AS (SELECT fold, home AS team, sum(home_goals) AS hf, sum(away_goals) AS ha, count(*) AS hn FROM train GROUP BY ALL), a AS (SELECT fold, away AS team, sum(away_goals) AS af, sum(home_goals) AS aa, count(*) AS an FROM train GROUP BY ALL),
s AS (SELECT *, (hf + mh) / ((hn + 1) * mh) AS hat, (ha + ma) / ((hn + 1) * ma) AS hde, (af + ma) / ((an + 1) * ma) AS aat, (aa + mh) / ((an + 1) * mh) AS ade FROM h JOIN a USING (fold, team) JOIN mu USING (fold)),
l AS (SELECT x.fold, x.team AS home, y.team AS away, x.mh * x.hat * y.ade AS lh, x.ma * y.aat * x.hde AS la FROM s x JOIN s y ON x.fold = y.fold AND x.team <> y.team),
g AS (SELECT fold, home, away, i, j, exp(-lh) * pow(lh, i) / factorial(i::INT) * exp(-la) * pow(la, j) / factorial(j::INT) AS q FROM l, range(0, 11) x(i), range(0, 11) y(j)),
p AS (SELECT fold, home, away, sum(q) FILTER (i > j) / sum(q) AS p_home, sum(q) FILTER (i = j) / sum(q) AS p_draw, sum(q) FILTER (i < j) / sum(q) AS p_away FROM g GROUP BY fold, home, away),
r AS (SELECT fold, p_home, p_draw, p_away, CASE WHEN home_goals > away_goals THEN 'home' WHEN home_goals = away_goals THEN 'draw' ELSE 'away' END AS o FROM test JOIN p USING (fold, home, away))"""


@query(f"""WITH {FOLDS} SELECT fold, count(*) AS n, avg((p_home - (o = 'home')::INT) ** 2 + (p_draw - (o = 'draw')::INT) ** 2 + (p_away - (o = 'away')::INT) ** 2) AS brier, avg(((p_home - (o = 'home')::INT) ** 2 + (p_home + p_draw - (o = 'home')::INT - (o = 'draw')::INT) ** 2) / 2) AS rps,
 avg(-ln(greatest(CASE o WHEN 'home' THEN p_home WHEN 'draw' THEN p_draw ELSE p_away END, 1e-12))) AS log_loss, avg((CASE WHEN p_home = greatest(p_home, p_draw, p_away) THEN 'home' WHEN p_draw = greatest(p_home, p_draw, p_away) THEN 'draw' ELSE 'away' END = o)::INT) AS accuracy, avg(greatest(p_home, p_draw, p_away)) AS confidence FROM r GROUP BY fold""")
def poisson_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.summary(bt.scored(models.poisson_walk_forward(matches(spark, sf_dir), ["match_date", "match_id"], 3, 10)), ["fold"])


@query(f"""WITH {FORECASTS}, b AS (SELECT *, 0.5::DOUBLE AS b_home, 0.25::DOUBLE AS b_draw, 0.25::DOUBLE AS b_away, 1 / 3.0::DOUBLE AS e FROM forecasts), w AS (SELECT x / 10.0::DOUBLE AS w_own, y / 10.0::DOUBLE AS w_even, (10 - x - y) / 10.0::DOUBLE AS w_home, x * 100 + y AS k FROM range(0, 11) t(x), range(0, 11) u(y) WHERE x + y <= 10),
s AS (SELECT w_own, w_even, w_home, k, avg(((w_own * p_home + w_even * e + w_home * b_home - (outcome = 'home')::INT) ** 2 + (w_own * (p_home + p_draw) + w_even * 2 * e + w_home * (b_home + b_draw) - (outcome <> 'away')::INT) ** 2) / 2) AS rps FROM b, w GROUP BY ALL)
SELECT w_own, w_even, w_home, rps FROM s ORDER BY rps, k LIMIT 1""")
def ensemble_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = {o: F.col(f"p_{o}") for o in bt.OUTCOMES}
    fixed = lambda h, d, a: {"home": F.lit(h), "draw": F.lit(d), "away": F.lit(a)}
    return models.ensemble_weights(forecasts(spark, sf_dir), {"own": own, "even": fixed(1 / 3, 1 / 3, 1 / 3), "home": fixed(0.5, 0.25, 0.25)})


@query()
def dixon_coles_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Team parameters of the decayed fit, and the chances of every pairing by it."""
    m = matches(spark, sf_dir)
    model = models.fit_dixon_coles(m, decay=0.0005)
    pairs = model.table(spark).select(F.col("team").alias("home")).crossJoin(model.table(spark).select(F.col("team").alias("away"))).where("home <> away")
    rated = model.rates(pairs.withColumn("match_id", F.col("home") * 100 + F.col("away")))
    return league.outcome_probabilities(league.score_matrix(rated, rho=model.rho))


@query()
def isotonic_recalibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later half of the forecasts by curves of the earlier half."""
    train, test = models.walk_forward(forecasts(spark, sf_dir), ["match_date", "match_id"], 1, 10)
    return models.recalibrated(test, models.isotonic(train)).select("match_id", *[f"p_{o}" for o in bt.OUTCOMES])


@query()
def style_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ratings(spark, sf_dir).groupBy("team").agg(F.avg("score").alias("score"), F.avg("minutes").alias("minutes"), F.stddev_pop("score").alias("spread"))
    return models.style_clusters(t, "team", ["score", "minutes", "spread"], 4)


VAEP = ["start_x", "start_y", "end_x", "end_y", "is_click", "is_view"]


def labelled_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = windows.possession_labels(actions(spark, sf_dir), ["user_id"], ["ts", "event_id"], "side", F.col("event_type") == "purchase")
    return a.withColumns({"is_click": (F.col("event_type") == "click").cast("double"), "is_view": (F.col("event_type") == "view").cast("double")})


@query()
def vaep_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.action_values(labelled_actions(spark, sf_dir), VAEP, ["user_id"], ["ts", "event_id"], "side").select("event_id", "p_scores", "p_concedes", "value")


@query()
def boosted_action_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.action_values(labelled_actions(spark, sf_dir), VAEP, ["user_id"], ["ts", "event_id"], "side", models.boosted).select("event_id", "p_scores", "p_concedes", "value")


@query()
def action_value_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both kinds of models on a fifth of the users that is kept from them, and on the others."""
    held_out = F.crc32(F.col("user_id").cast("string")) % 5 == 0
    return models.label_auc(labelled_actions(spark, sf_dir), VAEP, held_out, {"logistic": models.logistic, "boosted": models.boosted})


@query(f"""WITH {FORECASTS}, l AS (SELECT league, unnest([{{'o': 'home', 'p': p_home, 'y': (outcome = 'home')::INT}}, {{'o': 'draw', 'p': p_draw, 'y': (outcome = 'draw')::INT}}, {{'o': 'away', 'p': p_away, 'y': (outcome = 'away')::INT}}], recursive := true) FROM forecasts),
r AS (SELECT *, rank() OVER (PARTITION BY league, o ORDER BY p) + (count(*) OVER (PARTITION BY league, o, p) - 1) / 2.0::DOUBLE AS rk FROM l)
SELECT league, o AS outcome, (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * (count(*) - sum(y))) AS auc, sum(y)::BIGINT AS positives, (count(*) - sum(y))::BIGINT AS negatives FROM r GROUP BY league, o""")
def outcome_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = F.explode(F.array(*[F.struct(F.lit(o).alias("o"), F.col(f"p_{o}").alias("p"), bt.hit(o).alias("y")) for o in bt.OUTCOMES]))
    rows = forecasts(spark, sf_dir).select("league", cases.alias("_c")).select("league", F.col("_c.o").alias("outcome"), "_c.p", "_c.y")
    return stats.auc(rows, ["league", "outcome"], "p", F.col("y"))


@query(f"""WITH {SCORED}, w AS (SELECT *, row_number() OVER (ORDER BY brier DESC, match_id) AS rn, greatest(15, floor(count(*) OVER () * 0.1)) AS wanted FROM scored) SELECT match_id, league, brier, confidence, outcome FROM w WHERE rn <= wanted""")
def hardest_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.hardest(bt.scored(forecasts(spark, sf_dir)), "brier", ["match_id"], 0.1, 15).select("match_id", "league", "brier", "confidence", "outcome")


@query()
def error_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = ["home", "away", "league", "entropy", "margin"]
    return diagnostics.error_clusters(diagnostics.clustered_errors(bt.scored(forecasts(spark, sf_dir)), ["match_id"], features), features)


DRAW = "('0x' || substr(md5('7|' || feature || '|' || repeat || '|{}|' || player || '|' || season), 1, 12))::BIGINT"


@query(f"""WITH {CAREERS}, e AS (SELECT player, season, score AS target, minutes::DOUBLE AS minutes, season::DOUBLE AS season_value, (player % 50)::DOUBLE AS early FROM careers),
c AS (SELECT e.*, f.feature, r.repeat, CASE f.feature WHEN 'minutes' THEN minutes WHEN 'season_value' THEN season_value ELSE early END AS value FROM e, (SELECT unnest(['minutes', 'season_value', 'early']) AS feature) f, range(0, 2) r(repeat)),
t AS (SELECT *, row_number() OVER (PARTITION BY feature, repeat ORDER BY {DRAW.format('to')}, player, season) AS i, row_number() OVER (PARTITION BY feature, repeat ORDER BY {DRAW.format('from')}, player, season) AS j FROM c),
s AS (SELECT a.feature, a.repeat, a.target, CASE a.feature WHEN 'minutes' THEN b.value ELSE a.minutes END * 0.01::DOUBLE + (CASE a.feature WHEN 'season_value' THEN b.value ELSE a.season_value END - 1990) * 0.5::DOUBLE + CASE a.feature WHEN 'early' THEN b.value ELSE a.early END * 0.02::DOUBLE AS score FROM t a JOIN t b ON a.feature = b.feature AND a.repeat = b.repeat AND a.i = b.j
 UNION ALL SELECT 'none', 0, target, minutes * 0.01::DOUBLE + (season_value - 1990) * 0.5::DOUBLE + early * 0.02::DOUBLE FROM e),
k AS (SELECT feature, repeat, rank() OVER (PARTITION BY feature, repeat ORDER BY score) + (count(*) OVER (PARTITION BY feature, repeat, score) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY feature, repeat ORDER BY target) + (count(*) OVER (PARTITION BY feature, repeat, target) - 1) / 2.0::DOUBLE AS b FROM s),
p AS (SELECT feature, repeat, corr(a, b) AS r FROM k GROUP BY ALL), b AS (SELECT r AS base FROM p WHERE feature = 'none')
SELECT feature, base AS spearman, avg(r) AS shuffled, avg(base - r) AS "drop", stddev_pop(base - r) AS spread, 2 AS repeats FROM p, b WHERE feature <> 'none' GROUP BY feature, base""")
def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = careers(spark, sf_dir).withColumns({"season_value": F.col("season").cast("double"), "early": F.col("player") % 50})
    rate = lambda v: v["minutes"] * 0.01 + (v["season_value"] - 1990) * 0.5 + v["early"] * 0.02
    return diagnostics.permutation_importance(c, ["player", "season"], ["minutes", "season_value", "early"], rate, "score", 2, 7)

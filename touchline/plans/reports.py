"""Queries of forecast reports, careers, sensitivity and label governance, and the SQL that each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions import scalar
from touchline.operators import actions as act
from touchline.operators import backtest as bt
from touchline.operators import careers as car
from touchline.operators import identity, joins, labels, quality, reports, sensitivity, stats

from .registry import UNIFORM, query
from .stand_ins import CAREERS, FORECASTS, LEDGER, MATCHES, RATINGS, SCORED, TRUTH, careers, forecasts, ledger, matches, ratings, table, truth_labels

# Forecast reports


@query(f"""WITH {SCORED}, b AS (SELECT least(greatest(floor((confidence - 1.0::DOUBLE / 3) / ((1.0::DOUBLE - 1.0::DOUBLE / 3) / 10)), 0), 9) AS bin, count(*) AS n, abs(avg(confidence) - avg(correct)) AS gap FROM scored GROUP BY 1),
h AS (SELECT abs(avg(correct) FILTER (i < n // 2) - avg(correct) FILTER (i >= n // 2)) AS spread FROM (SELECT correct, row_number() OVER (ORDER BY match_date, match_id) - 1 AS i, count(*) OVER () AS n FROM scored)),
m AS (SELECT avg(correct) AS accuracy, avg(brier) AS brier, avg(rps) AS rps, abs(avg(confidence) - avg(correct)) AS gap FROM scored), e AS (SELECT sum(n * gap) / sum(n) AS ece FROM b),
r AS (SELECT unnest([{{'dimension': 'accuracy', 'metric': accuracy, 'score': accuracy * 100 / 0.55, 'weight': 0.25::DOUBLE}}, {{'dimension': 'calibration', 'metric': ece, 'score': (1 - ece / 0.2) * 100, 'weight': 0.2}}, {{'dimension': 'discrimination', 'metric': brier, 'score': (1 - brier / 0.33) * 100, 'weight': 0.2}},
 {{'dimension': 'sharpness', 'metric': rps, 'score': (1 - rps / 0.25) * 100, 'weight': 0.15}}, {{'dimension': 'confidence_alignment', 'metric': gap, 'score': (1 - gap / 0.2) * 100, 'weight': 0.1}}, {{'dimension': 'stability', 'metric': spread, 'score': (1 - spread / 0.15) * 100, 'weight': 0.1}}], recursive := true) FROM m, e, h),
c AS (SELECT dimension, metric, greatest(least(score, 100), 0)::DOUBLE AS score, weight::DOUBLE AS weight FROM r)
SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 65 THEN 'C' WHEN score >= 50 THEN 'D' ELSE 'F' END AS grade FROM c""")
def report_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.report_card(bt.scored(forecasts(spark, sf_dir)), ["match_date", "match_id"])


STRESSES = ["outcome_swap", "probability_shift", "confidence_inflation", "confidence_deflation"]


def _stress_sql(kind: str) -> str:
    new = {
        "outcome_swap": ["p_home", "p_draw", "p_away", "CASE WHEN hit AND outcome = 'home' THEN 'away' ELSE outcome END"],
        "probability_shift": ["CASE WHEN hit THEN p_home * 0.8 ELSE p_home END", "p_draw", "CASE WHEN hit THEN p_away + p_home * 0.2 ELSE p_away END", "outcome"],
        "confidence_deflation": [f"CASE WHEN hit THEN p_{o} + (1 / 3.0::DOUBLE - p_{o}) * 0.2 ELSE p_{o} END" for o in bt.OUTCOMES] + ["outcome"],
        "confidence_inflation": [f"CASE WHEN NOT hit THEN p_{o} WHEN fav = '{o}' THEN top + (1 - top) * 0.2 ELSE (1 - top) * 0.8 * p_{o} / (p_home + p_draw + p_away - top) END" for o in bt.OUTCOMES] + ["outcome"],
    }[kind]
    return f"SELECT '{kind}' AS kind, match_id, {new[0]} AS p_home, {new[1]} AS p_draw, {new[2]} AS p_away, {new[3]} AS outcome FROM marked"


_MEANS = """avg((p_home - (outcome = 'home')::INT) ** 2 + (p_draw - (outcome = 'draw')::INT) ** 2 + (p_away - (outcome = 'away')::INT) ** 2) AS brier_{t},
 avg(((p_home - (outcome = 'home')::INT) ** 2 + (p_home + p_draw - (outcome = 'home')::INT - (outcome = 'draw')::INT) ** 2) / 2) AS rps_{t}, avg(-ln(greatest(CASE outcome WHEN 'home' THEN p_home WHEN 'draw' THEN p_draw ELSE p_away END, 1e-12))) AS log_loss_{t},
 avg((CASE WHEN p_home = greatest(p_home, p_draw, p_away) THEN 'home' WHEN p_draw = greatest(p_home, p_draw, p_away) THEN 'draw' ELSE 'away' END = outcome)::INT) AS correct_{t}"""


@query(f"""WITH {FORECASTS}, marked AS (SELECT *, greatest(p_home, p_draw, p_away) AS top, CASE WHEN p_home = greatest(p_home, p_draw, p_away) THEN 'home' WHEN p_draw = greatest(p_home, p_draw, p_away) THEN 'draw' ELSE 'away' END AS fav, {UNIFORM.format(x="'42|' || match_id")} < 0.2 AS hit FROM forecasts),
stressed AS ({" UNION ALL ".join(map(_stress_sql, STRESSES))}), b AS (SELECT {_MEANS.format(t="before")} FROM forecasts), a AS (SELECT kind, count(*) AS n, {_MEANS.format(t="after")} FROM stressed GROUP BY kind)
SELECT a.*, b.*, {", ".join(f"{m}_after - {m}_before AS {m}_change" for m in ("brier", "rps", "log_loss", "correct"))} FROM a, b""")
def scenario_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    from touchline.operators.league import uniform

    return reports.stress_test(forecasts(spark, sf_dir), STRESSES, uniform(42, F.col("match_id")) < 0.2)


BINS = """edges AS (SELECT list_distinct(quantile_cont(confidence, [0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS e FROM scored), binned AS (SELECT scored.*, greatest(len(list_filter(e, lambda x: x < confidence)) - 1, 0)::INT AS bin FROM scored, edges)"""


@query(f"""WITH {SCORED}, {BINS}, w AS (SELECT *, greatest(p_home - 0.1 - (match_id % 7) / 20.0, 0) AS lo, least(p_home + 0.1 + (match_id % 7) / 20.0, 1) AS hi FROM binned)
SELECT bin, count(*) AS n, avg(hi - lo)::DOUBLE AS mean_width, min(hi - lo)::DOUBLE AS least_width, max(hi - lo)::DOUBLE AS most_width, avg((yh BETWEEN lo AND hi)::INT) AS coverage, avg(confidence) AS mean_confidence FROM w GROUP BY bin""")
def interval_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.lit(0.1) + F.col("match_id") % 7 / F.lit(20.0)
    low, high = F.greatest(F.col("p_home") - F.lit(0.1) - F.col("match_id") % 7 / F.lit(20.0), F.lit(0.0)), F.least(F.col("p_home") + half, F.lit(1.0))
    return reports.interval_report(bt.scored(forecasts(spark, sf_dir)), low, high, bt.hit("home"), 5)


@query(f"""WITH {FORECASTS}, x AS (SELECT league, home, count(*) AS n, min(match_date::DATE) AS first, max(match_date::DATE) AS last FROM forecasts GROUP BY ALL), y AS (SELECT *, greatest(DATE '1998-08-20' - last, 0)::INT AS age_days FROM x) SELECT *, CASE WHEN age_days <= 30 THEN 'fresh' WHEN age_days <= 90 THEN 'aging' ELSE 'stale' END AS status FROM y""")
def forecast_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.staleness(forecasts(spark, sf_dir), ["league", "home"], "match_date", F.to_date(F.lit("1998-08-20")), 30, 90)


@query(f"""WITH {SCORED}, p AS (SELECT season AS fold, count(*) AS n, avg(brier) AS brier, avg(rps) AS rps, avg(correct) AS accuracy, avg(confidence) AS confidence FROM scored GROUP BY 1 HAVING count(*) >= 5), d AS (SELECT stddev_pop(accuracy) AS accuracy_std, stddev_pop(brier) AS brier_std, stddev_pop(rps) AS rps_std FROM p)
SELECT p.*, d.*, CASE WHEN accuracy_std < 0.03 THEN 'stable' WHEN accuracy_std < 0.08 THEN 'moderate' ELSE 'unstable' END AS stability FROM p, d""")
def fold_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.fold_report(bt.scored(forecasts(spark, sf_dir)).withColumnRenamed("season", "fold"), "fold", 5)


def _importance_sql(f: str) -> str:
    return f"""SELECT '{f}' AS feature, count(*) AS bins, sqrt(greatest(sum(n * b * b) / sum(n) - pow(sum(n * b) / sum(n), 2), 0)) AS importance FROM (SELECT bin, count(*) AS n, avg(brier) AS b FROM
 (SELECT brier, greatest(len(list_filter(e, lambda y: y < {f}::DOUBLE)) - 1, 0) AS bin FROM scored, (SELECT list_distinct(quantile_cont({f}::DOUBLE, [0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS e FROM scored)) GROUP BY bin HAVING count(*) >= 3) HAVING count(*) >= 2"""


FEATURES = ["p_home", "p_draw", "p_away", "home", "away"]


@query(f"WITH {SCORED} " + " UNION ALL ".join(map(_importance_sql, FEATURES)))
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.feature_importance(bt.scored(forecasts(spark, sf_dir)), FEATURES, 5, 3)


@query(f"""WITH {SCORED}, {BINS}, s AS (SELECT min(match_date::DATE) AS d0 FROM scored), c AS (SELECT ((match_date::DATE - d0) // 180)::BIGINT AS "window", bin, count(*) AS n, avg(confidence) AS confidence, avg(correct) AS accuracy FROM binned, s GROUP BY ALL HAVING count(*) >= 3) SELECT *, confidence - accuracy AS gap FROM c""")
def drift_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.drift_heatmap(bt.scored(forecasts(spark, sf_dir)), "match_date", 180, 5, 3)


SIDES = """two AS (SELECT match_id, match_date, brier, correct, confidence, home AS team, 'home' AS side, p_home AS chance, yh AS won, home_goals AS gf, away_goals AS ga FROM scored UNION ALL SELECT match_id, match_date, brier, correct, confidence, away, 'away', p_away, ya, away_goals, home_goals FROM scored)"""


@query(f"""WITH {SCORED}, {SIDES}, b AS (SELECT team, string_agg(match_id::VARCHAR, '|' ORDER BY rn) AS best FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY brier, match_id) AS rn FROM two WHERE correct = 1) WHERE rn <= 3 GROUP BY team),
w AS (SELECT team, string_agg(match_id::VARCHAR, '|' ORDER BY rn) AS worst FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY brier DESC, match_id) AS rn FROM two) WHERE rn <= 3 GROUP BY team),
c AS (SELECT team, string_agg(score || ':' || k, '|' ORDER BY rn) AS common_scores FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY k DESC, score) AS rn FROM (SELECT team, gf || '-' || ga AS score, count(*) AS k FROM two GROUP BY ALL)) WHERE rn <= 5 GROUP BY team),
t AS (SELECT team, count(*) AS n, avg(correct) AS accuracy, avg(brier) AS brier, avg(gf) AS goals_for, avg(ga) AS goals_against, avg((ga = 0)::INT) AS clean_sheets, avg((gf > 0 AND ga > 0)::INT) AS both_scored, avg(won) - avg(chance) AS overperformance FROM two GROUP BY team HAVING count(*) >= 5)
SELECT t.*, CASE WHEN overperformance > 0.05 THEN 'overperformer' WHEN overperformance < -0.05 THEN 'underperformer' ELSE 'aligned' END AS assessment, common_scores, coalesce(best, '') AS best, worst FROM t JOIN c USING (team) JOIN w USING (team) LEFT JOIN b USING (team)""")
def team_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.team_profiles(bt.scored(forecasts(spark, sf_dir)), 3, 5)


WINDOWS = """hs AS (SELECT *, min(match_date::DATE) OVER (PARTITION BY team) AS d0 FROM two WHERE side = 'home'),
p AS (SELECT team, ((match_date::DATE - d0) // 180)::BIGINT AS "window", count(*) AS n, avg(correct) AS accuracy, avg(brier) AS brier, avg(confidence) AS confidence FROM hs GROUP BY ALL HAVING count(*) >= 5)"""


@query(f"WITH {SCORED}, {SIDES}, {WINDOWS} SELECT * FROM p")
def team_calibration_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.team_windows(bt.scored(forecasts(spark, sf_dir)), 180, 5)


@query(f"""WITH {SCORED}, {SIDES}, {WINDOWS}, l AS (SELECT team, count(*) AS windows, arg_max(brier, "window") AS latest_brier, sum(brier) AS s FROM p GROUP BY team),
j AS (SELECT team, n, coalesce(windows, 0) AS windows, coalesce(latest_brier, 0) AS latest_brier, CASE WHEN windows >= 2 THEN (s - latest_brier) / (windows - 1) ELSE coalesce(latest_brier, 0) END AS historical_brier FROM (SELECT team, count(*) AS n FROM hs GROUP BY team) LEFT JOIN l USING (team)),
r AS (SELECT *, CASE WHEN windows >= 2 AND historical_brier > 0 THEN (latest_brier - historical_brier) / historical_brier ELSE 0 END AS relative_change FROM j)
SELECT *, abs(relative_change) > 0.05 AND windows >= 2 AS drifted, CASE WHEN windows < 2 THEN 'insufficient_data' WHEN relative_change < -0.005 THEN 'improving' WHEN relative_change > 0.005 THEN 'degrading' ELSE 'stable' END AS trend FROM r""")
def team_calibration_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.team_drift(bt.scored(forecasts(spark, sf_dir)), 180, 5)


@query(f"""WITH {FORECASTS}, m AS (SELECT home, away, count(*) AS n, avg((outcome = 'home')::INT) AS s_home, avg((outcome = 'draw')::INT) AS s_draw, avg((outcome = 'away')::INT) AS s_away FROM forecasts GROUP BY ALL),
j AS (SELECT match_id, p_home, p_draw, p_away, coalesce(n >= 3, false) AS corrected, {", ".join(f"greatest(p_{o} + greatest(least(0.3 * (s_{o} - p_{o}), 0.05), -0.05), 0) AS m_{o}" for o in bt.OUTCOMES)} FROM forecasts LEFT JOIN m USING (home, away))
SELECT match_id, corrected, {", ".join(f"CASE WHEN corrected THEN m_{o} / (m_home + m_draw + m_away) ELSE p_{o} END AS p_{o}" for o in bt.OUTCOMES)} FROM j""")
def h2h_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = forecasts(spark, sf_dir)
    met = f.groupBy("home", "away").agg(F.count("*").alias("n"), *[F.avg(bt.hit(o)).alias(f"s_{o}") for o in bt.OUTCOMES])
    return reports.h2h_corrected(f, met, 0.05, 3, 0.3).select("match_id", "corrected", *[f"p_{o}" for o in bt.OUTCOMES])


# Careers and peers


@query(f"""WITH {CAREERS}, i AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY season) - 1 AS i FROM careers)
SELECT player, count(*) AS n_seasons, avg(score) AS mean_score, min(score) AS least, max(score) AS most, stddev_pop(score) AS spread, CASE WHEN count(*) > 1 THEN regr_slope(score, i) END AS slope, sum(minutes)::BIGINT AS minutes,
 coalesce(arg_max(season, (score, -i)) FILTER (minutes >= 900), arg_max(season, (score, -i))) AS peak FROM i GROUP BY player""")
def career_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = car.trajectory(careers(spark, sf_dir), "player", "season", "score", "minutes")
    return t.withColumn("slope", F.when(F.col("n_seasons") > 1, F.col("slope")))


@query(f"""WITH {CAREERS}, i AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY season) - 1 AS i, count(*) OVER (PARTITION BY player) AS n FROM careers),
k AS (SELECT player, coalesce(arg_max(i, (score, -i)) FILTER (minutes >= 900), arg_max(i, (score, -i))) AS peak, arg_max(score, i) AS last FROM i GROUP BY player), t AS (SELECT player, peak, last, score AS top FROM k JOIN i USING (player) WHERE i.i = k.peak)
SELECT player, season, CASE WHEN i < peak - 1 THEN 'prospect' WHEN i <= peak + 1 THEN 'prime' WHEN top > 0 AND (top - last) / top >= 0.1 THEN 'decline' ELSE 'veteran' END AS phase FROM i JOIN t USING (player)""")
def development_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return car.phases(careers(spark, sf_dir), "player", "season", "score", "minutes").select("player", "season", "phase")


@query(f"""WITH {CAREERS} SELECT * FROM (SELECT player, lag(season) OVER w AS from_season, season AS to_season, score - lag(score) OVER w AS score_change, minutes - lag(minutes) OVER w AS minutes_change FROM careers WINDOW w AS (PARTITION BY player ORDER BY season)) WHERE from_season IS NOT NULL""")
def yearly_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return car.changes(careers(spark, sf_dir), "player", "season", ["score", "minutes"])


@query(f"""WITH {CAREERS} SELECT * FROM (SELECT player, lag(season) OVER w AS from_season, season AS to_season, lag(position) OVER w AS from_position, position AS to_position FROM careers WINDOW w AS (PARTITION BY player ORDER BY season)) WHERE from_position <> to_position""")
def position_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return car.moves(careers(spark, sf_dir), "player", "season", "position")


@query(f"""WITH {CAREERS}, i AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY season) - 1 AS i FROM careers), p AS (SELECT player, count(*) AS n_seasons, regr_slope(score, i) AS slope, arg_max(minutes, i) AS last, arg_max(score, i) AS latest FROM i GROUP BY player HAVING count(*) >= 3 AND arg_max(minutes, i) >= 700)
(SELECT player, n_seasons, slope, latest, 'riser' AS kind FROM p WHERE slope >= 0.5 ORDER BY slope DESC, player LIMIT 20) UNION ALL (SELECT player, n_seasons, slope, latest, 'decliner' FROM p WHERE slope <= -0.5 ORDER BY slope, player LIMIT 20)""")
def riser_watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return car.watchlist(careers(spark, sf_dir), "player", "season", "score", "minutes", 3, 700, 0.5, -0.5, 20)


@query(f"""WITH {RATINGS}, z AS (SELECT player, position, (score - avg(score) OVER ()) / stddev_pop(score) OVER () AS a, (minutes - avg(minutes) OVER ()) / stddev_pop(minutes) OVER () AS b FROM ratings), c AS (SELECT position AS role, avg(a) AS x, avg(b) AS y FROM z GROUP BY position HAVING count(*) >= 5)
SELECT player, role, least(greatest((coalesce((a * x + b * y) / nullif(sqrt(a * a + b * b) * sqrt(x * x + y * y), 0), 0) + 1) * 50, 0), 100) AS fit FROM z, c""")
def role_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return car.role_fit(ratings(spark, sf_dir).select("player", "position", "score", "minutes"), "player", "position", ["score", "minutes"], 5)


@query(f"""WITH {RATINGS}, p AS (SELECT player, score, minutes, position, league % 2 AS tier, CASE WHEN minutes >= 1800 THEN 'regular' WHEN minutes >= 900 THEN 'rotation' ELSE 'fringe' END AS band FROM ratings),
r AS (SELECT player, count(*) OVER g AS peers, 100.0::DOUBLE * (rank() OVER (PARTITION BY position, tier, band ORDER BY score) - 1) / count(*) OVER g AS pct_score, rank() OVER (PARTITION BY position, tier, band ORDER BY score DESC) AS rank_score,
 100.0::DOUBLE * (rank() OVER (PARTITION BY position, tier, band ORDER BY minutes) - 1) / count(*) OVER g AS pct_minutes, rank() OVER (PARTITION BY position, tier, band ORDER BY minutes DESC) AS rank_minutes FROM p WINDOW g AS (PARTITION BY position, tier, band))
SELECT *, (pct_score * 0.7 + pct_minutes * 0.3) / (0.7 + 0.3) AS overall FROM r WHERE peers >= 5""")
def peer_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ratings(spark, sf_dir).withColumns({"tier": F.col("league") % 2, "band": car.minutes_band(F.col("minutes"), [(1800, "regular"), (900, "rotation")], "fringe")})
    return car.peer_percentiles(r.select("player", "score", "minutes", "position", "tier", "band"), "player", ["position", "tier", "band"], {"score": 0.7, "minutes": 0.3}, 5)


# Sensitivity


STABILITY = """CASE WHEN stddev_pop(before) > 0 AND stddev_pop(after) > 0 THEN corr(before, after) ELSE 1 END AS spearman, count(*) FILTER (before <= least(m, 10) AND after <= least(m, 10)) / count(*) FILTER (before <= least(m, 10))::DOUBLE AS overlap, avg(abs(before - after)) AS mean_shift, max(abs(before - after)) AS max_shift"""
DIMS = """dims AS (SELECT player, position, score / 10000 AS a, minutes / 3000.0::DOUBLE AS b, CASE WHEN player % 4 > 0 THEN (player * 7 % 100) / 100.0::DOUBLE END AS c FROM ratings)"""


def _dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("player")
    return ratings(spark, sf_dir).select("player", "position", (F.col("score") / 10000).alias("a"), (F.col("minutes") / 3000.0).alias("b"), F.when(p % 4 > 0, p * 7 % 100 / 100.0).alias("c"))


def _weighted_sql(a: str, b: str, c: str) -> str:
    return f"(a * {a} + b * {b} + coalesce(c * {c}, 0)) / ({a} + {b} + CASE WHEN c IS NULL THEN 0 ELSE {c} END)"


_VARIANTS = [(k, d, [w * (1 + d) if k == n else w for n, w in (("a", 0.5), ("b", 0.3), ("c", 0.2))]) for k in "abc" for d in (-0.2, 0.2)]


@query(f"""WITH {RATINGS}, {DIMS}, v AS ({" UNION ALL ".join(f"SELECT player, position, '{k}' AS dimension, {d}::DOUBLE AS delta, round({_weighted_sql('0.5::DOUBLE', '0.3::DOUBLE', '0.2::DOUBLE')}, 9) AS x, round({_weighted_sql(*(f'{y!r}::DOUBLE' for y in w))}, 9) AS y FROM dims" for k, d, w in _VARIANTS)}),
r AS (SELECT position, dimension, delta, rank() OVER (PARTITION BY position, dimension, delta ORDER BY x DESC) AS before, rank() OVER (PARTITION BY position, dimension, delta ORDER BY y DESC) AS after, count(*) OVER (PARTITION BY position, dimension, delta) AS m FROM v)
SELECT position, dimension, delta, count(*) AS n, {STABILITY} FROM r GROUP BY position, dimension, delta""")
def weight_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensitivity.weight_sensitivity(_dimensions(spark, sf_dir), ["position"], ["a", "b", "c"], {"a": 0.5, "b": 0.3, "c": 0.2}, [-0.2, 0.2], 10)


@query(f"""WITH {RATINGS}, v AS (SELECT position, delta, round(CASE WHEN minutes > 0 THEN 900.0::DOUBLE / (900.0 + minutes) * 1000 + (1 - 900.0::DOUBLE / (900.0 + minutes)) * score ELSE 1000 END, 9) AS x, round(CASE WHEN minutes > 0 THEN 900.0 * (1 + delta) / (900.0 * (1 + delta) + minutes) * 1000 + (1 - 900.0 * (1 + delta) / (900.0 * (1 + delta) + minutes)) * score ELSE 1000 END, 9) AS y FROM ratings, (SELECT unnest([-0.5::DOUBLE, 0.5, 1.0]) AS delta)),
r AS (SELECT position, delta, rank() OVER (PARTITION BY position, delta ORDER BY x DESC) AS before, rank() OVER (PARTITION BY position, delta ORDER BY y DESC) AS after, count(*) OVER (PARTITION BY position, delta) AS m FROM v) SELECT position, delta, count(*) AS n, {STABILITY} FROM r GROUP BY position, delta""")
def minutes_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensitivity.minutes_sensitivity(ratings(spark, sf_dir).select("player", "position", "score", "minutes"), ["position"], F.col("score"), F.col("minutes"), F.lit(1000.0), 900.0, [-0.5, 0.5, 1.0], 10)


@query(f"""WITH {RATINGS}, c AS (SELECT player, position, score, minutes, fraction, repeat, {UNIFORM.format(x="'5|' || (fraction * 1000)::BIGINT || '|' || repeat || '|' || player")} AS u FROM ratings, (SELECT unnest([0.1::DOUBLE, 0.3]) AS fraction), (SELECT unnest([0, 1]) AS repeat)),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY position, fraction, repeat ORDER BY u, player) - 1 AS i, count(*) OVER (PARTITION BY position, fraction, repeat) AS n0 FROM c) WHERE i >= floor(n0 * fraction)),
p AS (SELECT position, coalesce(sum(score * minutes) FILTER (minutes >= 900) / sum(minutes) FILTER (minutes >= 900), avg(score)) AS p0 FROM ratings GROUP BY 1), q AS (SELECT position, fraction, repeat, coalesce(sum(score * minutes) FILTER (minutes >= 900) / sum(minutes) FILTER (minutes >= 900), avg(score)) AS p1 FROM s GROUP BY ALL),
y AS (SELECT *, CASE WHEN minutes > 0 THEN 900.0::DOUBLE / (900.0 + minutes) ELSE 1 END AS w FROM s JOIN p USING (position) JOIN q USING (position, fraction, repeat)),
r AS (SELECT position, fraction, repeat, rank() OVER (PARTITION BY position, fraction, repeat ORDER BY w * p0 + (1 - w) * score DESC) AS before, rank() OVER (PARTITION BY position, fraction, repeat ORDER BY w * p1 + (1 - w) * score DESC) AS after, count(*) OVER (PARTITION BY position, fraction, repeat) AS m FROM y)
SELECT position, fraction, repeat, count(*) AS n, {STABILITY} FROM r GROUP BY position, fraction, repeat""")
def cohort_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensitivity.cohort_sensitivity(ratings(spark, sf_dir), ["position"], "player", "score", "minutes", 900.0, [0.1, 0.3], 2, 5, 10)


@query(f"""WITH {RATINGS}, o AS (SELECT player, position, score, row_number() OVER (PARTITION BY position ORDER BY player) - 1 AS i, count(*) OVER (PARTITION BY position) AS n FROM ratings),
d AS (SELECT position, repeat, floor({UNIFORM.format(x="'3|' || repeat || '|' || i")} * n)::BIGINT AS i FROM o, range(0, 20) t(repeat)), p AS (SELECT d.position, repeat, score FROM d JOIN o USING (position, i)),
h AS (SELECT o.player, o.position, t.repeat, 1 + count(p.score) AS r FROM o CROSS JOIN range(0, 20) t(repeat) LEFT JOIN p ON p.position = o.position AND p.repeat = t.repeat AND p.score > o.score GROUP BY ALL)
SELECT position, player, quantile_cont(r, 0.05)::DOUBLE AS rank_p5, quantile_cont(r, 0.5)::DOUBLE AS rank_p50, quantile_cont(r, 0.95)::DOUBLE AS rank_p95 FROM h GROUP BY position, player""")
def bootstrap_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensitivity.bootstrap_ranks(ratings(spark, sf_dir).select("player", "position", "score"), ["position"], "player", "score", 20, 3)


# Label governance


@query(f"WITH {LEDGER} SELECT decision_id, label_type, tier FROM active")
def active_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.active(ledger(spark, sf_dir)).select("decision_id", "label_type", "tier")


@query(f"WITH {LEDGER} SELECT 'action' AS \"column\", action AS value, count(*) AS n FROM ledger GROUP BY ALL UNION ALL SELECT 'label_type', label_type, count(*) FROM ledger GROUP BY ALL UNION ALL SELECT 'season', season::VARCHAR, count(*) FROM ledger GROUP BY ALL")
def label_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.summary(ledger(spark, sf_dir), ["action", "label_type", "season"])


@query(f"WITH {LEDGER}, x AS (SELECT decision_id, length(evidence) AS evidence_length, concat_ws('|', CASE WHEN confidence = 'low' THEN 'low_confidence' END, CASE WHEN length(evidence) < 3 THEN 'thin_evidence' END) AS reasons FROM active) SELECT * FROM x WHERE reasons <> ''")
def doubtful_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.doubtful(ledger(spark, sf_dir), 3).select("decision_id", "evidence_length", "reasons")


@query(f"WITH {LEDGER} SELECT decision_id, (DATE '2002-06-01' - recorded_at)::INT AS age_days FROM active WHERE DATE '2002-06-01' - recorded_at >= 1500")
def aged_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.aged(ledger(spark, sf_dir), 1500, F.to_date(F.lit("2002-06-01"))).select("decision_id", "age_days")


@query(f"""WITH {LEDGER}, w AS (SELECT b, season FROM active WHERE label_type = 'human_tier' GROUP BY ALL HAVING max(tier) - min(tier) >= 4), c AS (SELECT decision_id FROM active JOIN w USING (b, season) WHERE label_type = 'human_tier')
SELECT decision_id, 'low_confidence' AS queue FROM active WHERE confidence = 'low' OR length(evidence) < 3 UNION ALL SELECT decision_id, 'retest' FROM active WHERE DATE '2002-06-01' - recorded_at >= 1500 UNION ALL SELECT decision_id, 'conflict' FROM c""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = ledger(spark, sf_dir)  # noqa: E741
    tier = labels.active(l).where("label_type = 'human_tier'")
    apart = quality.tier_conflicts(tier, ["b", "season"], "tier", 4)
    return labels.review_queue(l, 3, 1500, F.to_date(F.lit("2002-06-01")), tier.join(apart, ["b", "season"], "left_semi"))


@query(f"""WITH {LEDGER}, d AS (SELECT * FROM ledger WHERE action = 'confirmed') SELECT o.decision_id AS original_id, n.decision_id AS retest_id, n.label_type, o.tier AS original_tier, n.tier AS retest_tier, abs(n.tier - o.tier) <= 1 AS consistent, greatest(n.recorded_at - o.recorded_at, 0)::INT AS days_between, n.decided_by = o.decided_by AS same_annotator FROM d n JOIN d o ON n.supersedes = o.decision_id AND n.label_type = o.label_type""")
def retest_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.retest_pairs(ledger(spark, sf_dir), 1)


@query(f"WITH {LEDGER} SELECT decision_id, 'model_derived_in_active_set' AS violation FROM active WHERE label_type = 'model_derived' UNION ALL SELECT decision_id, 'pairwise_self_comparison' FROM active WHERE label_type = 'human_pairwise_preference' AND a = b UNION ALL SELECT decision_id, 'observation_window_invalid' FROM active WHERE NOT regexp_full_match(coalesce(observation_window, ''), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}/[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') UNION ALL SELECT decision_id, 'evidence_empty' FROM active WHERE trim(evidence) = ''")
def independence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.independence(ledger(spark, sf_dir))


@query(f"WITH {LEDGER}, w AS (SELECT b, season, max(tier) - min(tier) AS spread, count(*) AS n FROM active GROUP BY ALL) SELECT * FROM w WHERE spread >= 4")
def tier_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.tier_conflicts(labels.active(ledger(spark, sf_dir)), ["b", "season"], "tier", 4)


@query(f"""WITH {LEDGER} SELECT 'unknown_source' AS "check", count(*) FILTER (label_type NOT IN ('human_pairwise_preference', 'human_tier', 'external_reference', 'future_outcome')) AS failures FROM ledger UNION ALL SELECT 'unknown_confidence', count(*) FILTER (confidence <> 'high') FROM ledger UNION ALL SELECT 'repeated_key', coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM ledger GROUP BY b, season, label_type HAVING count(*) > 1)""")
def truth_label_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.truth_checks(ledger(spark, sf_dir), ["b", "season", "label_type"], "label_type", labels.ELIGIBLE, "confidence", ["high"])


ELIGIBLE_TRUTH = """lower(trim(coalesce(label_source, ''))) IN ('transfermarkt_value', 'award', 'manual_calibration', 'scouting_review')"""


@query(f"""WITH {TRUTH}, e AS (SELECT decision_id % 10 AS line, as_of_date AS seen, CASE WHEN regexp_full_match(season, '[0-9]{{4}}') THEN make_date(2000 + season[3:4]::INT, 5, 31) END AS til FROM truth WHERE {ELIGIBLE_TRUTH})
SELECT line, count(*) FILTER (seen <= til) AS temporally_eligible_rows, count(*) FILTER (seen IS NULL) AS missing_or_invalid_as_of_rows, count(*) FILTER (til IS NULL) AS invalid_season_rows, count(*) FILTER (seen > til) AS post_season_rows FROM e GROUP BY line""")
def truth_label_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.temporal(truth_labels(spark, sf_dir).withColumn("line", F.col("decision_id") % 10), "label_source", "season", "as_of_date", ["line"])


@query(f"WITH {TRUTH} SELECT decision_id, label_source FROM truth WHERE {ELIGIBLE_TRUTH}")
def eligible_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.eligible(truth_labels(spark, sf_dir), "label_source", labels.ELIGIBLE_SOURCES).select("decision_id", "label_source")


@query(f"WITH {LEDGER} SELECT label_type, count(*) AS n FROM active WHERE label_type IN ('human_pairwise_preference', 'human_tier', 'external_reference', 'future_outcome') GROUP BY label_type")
def supervised_label_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.eligible(labels.active(ledger(spark, sf_dir)), "label_type", labels.ELIGIBLE).groupBy("label_type").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, o_orderkey FROM orders o WHERE o_orderkey % 2 = 0 AND NOT EXISTS (SELECT 1 FROM orders i WHERE i.o_orderkey % 5 = 1 AND i.o_custkey = o.o_custkey) UNION ALL SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey % 5 = 1")
def merged_truth_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return labels.merged(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 5 = 1"), ["o_custkey"])


@query(f"""WITH {CAREERS}, r AS (SELECT player, season, score, 100.0::DOUBLE * (rank() OVER w + (count(*) OVER (PARTITION BY season, score) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY season) AS percentile FROM careers WINDOW w AS (PARTITION BY season ORDER BY score))
SELECT *, CASE WHEN percentile >= 95 THEN 5 WHEN percentile >= 80 THEN 4 WHEN percentile >= 50 THEN 3 WHEN percentile >= 20 THEN 2 ELSE 1 END AS tier FROM r""")
def expert_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.tiers(careers(spark, sf_dir).select("player", "season", "score"), "season", "score", [(95, 5), (80, 4), (50, 3), (20, 2)], 1)


@query("""WITH o AS (SELECT p_partkey, unnest([{'column': 'p_brand', 'v': p_brand}, {'column': 'p_size', 'v': p_size::VARCHAR}], recursive := true) FROM part WHERE p_partkey % 4 > 0), n AS (SELECT p_partkey, unnest([{'column': 'p_brand', 'v': CASE WHEN p_partkey % 3 = 0 THEN 'new' ELSE p_brand END}, {'column': 'p_size', 'v': p_size::VARCHAR}], recursive := true) FROM part WHERE p_partkey % 5 > 0)
SELECT p_partkey, "column", CASE WHEN o.p_partkey IS NULL THEN 'added' WHEN n.p_partkey IS NULL THEN 'removed' ELSE 'changed' END AS kind, o.v AS before, n.v AS after FROM o FULL JOIN n USING (p_partkey, "column") WHERE o.v IS DISTINCT FROM n.v""")
def record_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    new = p.withColumn("p_brand", F.when(F.col("p_partkey") % 3 == 0, "new").otherwise(F.col("p_brand")))
    return labels.differences(p.where("p_partkey % 4 > 0"), new.where("p_partkey % 5 > 0"), ["p_partkey"], ["p_brand", "p_size"])


@query("""WITH x AS (SELECT event_type, count(*) AS n, min(ts::DATE) AS first, max(ts::DATE) AS last FROM events GROUP BY 1) SELECT *, (DATE '2024-03-01' - last)::INT AS age_days, last >= DATE '2024-01-15' AS in_range, DATE '2024-03-01' - last <= 45 AS fresh FROM x""")
def source_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda x: F.to_date(F.lit(x))
    return labels.freshness(table(spark, sf_dir, "events"), ["event_type"], "ts", day("2024-03-01"), day("2024-01-15"), 45)


# Scalars and sources that no other query uses


@query("SELECT c_custkey, 'customer ' || lpad(c_custkey::VARCHAR, 9, '0') || '|' || (1980 + c_custkey % 25) || '|' || CASE WHEN c_nationkey % 3 = 0 THEN 'spain' WHEN c_nationkey % 3 = 1 THEN 'united kingdom' ELSE 'NA' END AS key, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'fwd' WHEN 'BUILDING' THEN 'gk' WHEN 'FURNITURE' THEN 'cb' ELSE 'sweeper' END AS role, (20 + c_custkey % 20) // 4 * 4 AS band, CASE WHEN c_custkey % 3000 >= 1800 THEN 'HIGH' WHEN c_custkey % 3000 >= 450 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM customer")
def player_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    nation = F.when(F.col("c_nationkey") % 3 == 0, "ESP").when(F.col("c_nationkey") % 3 == 1, " U.K. ".replace(".", ""))
    label = F.when(F.col("c_mktsegment") == "AUTOMOBILE", "Striker").when(F.col("c_mktsegment") == "BUILDING", "Goalkeeper").when(F.col("c_mktsegment") == "FURNITURE", "Centre-Back").otherwise("Sweeper")
    name = F.concat(F.lit("Cüstomer "), F.lpad(k.cast("string"), 9, "0"))
    return table(spark, sf_dir, "customer").select(k, scalar.composite_key(name, 1980 + k % 25, nation).alias("key"), scalar.position_group(label).alias("role"), scalar.age_band(20 + k % 20).cast("long").alias("band"), scalar.confidence(k % 3000).alias("confidence"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size * 1e6 WHEN 1 THEN p_size * 1e3 WHEN 2 THEN p_size END AS value, CASE WHEN p_partkey % 3 = 0 THEN chr(39) || '=' || p_size ELSE p_name END AS safe FROM part")
def money_and_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    text = F.when(k % 4 == 0, F.concat(F.lit("€"), s, F.lit("m"))).when(k % 4 == 1, F.concat(F.lit("£ "), s, F.lit("k"))).when(k % 4 == 2, s).otherwise(F.concat(s, F.lit(" guilders")))
    cell = F.when(k % 3 == 0, F.concat(F.lit("="), s)).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", scalar.money(text).alias("value"), scalar.csv_safe(cell).alias("safe"))


@query("SELECT c_nationkey, substr(sha256(string_agg(c_custkey::VARCHAR, chr(10) ORDER BY c_custkey::VARCHAR)), 1, 16) AS members FROM customer GROUP BY c_nationkey")
def membership_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(scalar.membership_hash(F.col("c_custkey").cast("string")).alias("members"))


@query("SELECT p_brand, count(*) AS n, avg((p_partkey % 3 = 0)::INT) AS missing_size, avg((p_partkey % 7 = 0)::INT) AS missing_type FROM part GROUP BY p_brand")
def missing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select("p_brand", F.when(k % 3 > 0, F.col("p_size")).alias("size"), F.when(k % 7 > 0, F.col("p_type")).alias("type"))
    return quality.missing_rates(p, ["p_brand"], ["size", "type"])


@query("SELECT lower(p_name) AS name, count(DISTINCT p_partkey) AS ids, count(*) AS rows FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) > 1")
def same_name_different_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.same_name_different_id(table(spark, sf_dir, "part"), "p_name", "p_partkey")


@query("SELECT n_regionkey, c_mktsegment, grouping(n_regionkey)::INT * 2 + grouping(c_mktsegment)::INT AS level, count(*) AS n, avg(c_acctbal) AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, c_mktsegment)")
def rating_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.rollup("n_regionkey", "c_mktsegment").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.avg("c_acctbal").alias("mean"))


@query("SELECT l_orderkey, l_linenumber, d.dkey FROM lineitem JOIN (SELECT p_partkey AS dkey, p_retailprice AS low, p_retailprice + 3 AS high FROM part WHERE p_partkey % 50 = 0) d ON l_extendedprice / l_quantity >= low AND l_extendedprice / l_quantity < high")
def price_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))  # noqa: E741
    bands = table(spark, sf_dir, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("dkey"), F.col("p_retailprice").alias("low"), (F.col("p_retailprice") + 3).alias("high"))
    return joins.in_interval(l, bands, "price", "low", "high", 1.0).select("l_orderkey", "l_linenumber", "dkey")


@query(f"WITH {MATCHES} SELECT home, away, count(*) AS n FROM matches WHERE home_goals > away_goals GROUP BY ALL INTERSECT SELECT away, home, count(*) FROM matches WHERE home_goals < away_goals GROUP BY ALL")
def mirrored_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir)
    return m.where("home_goals > away_goals").groupBy("home", "away").agg(F.count("*").alias("n")).intersect(m.where("home_goals < away_goals").groupBy("away", "home").agg(F.count("*").alias("n")))


@query("SELECT c_custkey, (c_mktsegment = 'BUILDING')::INT AS segment_building, (c_mktsegment = 'MACHINERY')::INT AS segment_machinery, (c_mktsegment NOT IN ('BUILDING', 'MACHINERY'))::INT AS segment_other FROM customer")
def one_hot_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.lower("c_mktsegment").alias("segment"))
    return act.one_hot(c, "segment", ["building", "machinery"])


@query("""WITH u AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(v) AS v FROM u GROUP BY ALL), c AS (SELECT label, list(v ORDER BY i) AS centre FROM m GROUP BY label)
SELECT label, count(*) AS n, avg(list_cosine_similarity(embedding::DOUBLE[], centre)) AS closeness, min(list_cosine_similarity(embedding::DOUBLE[], centre)) AS farthest FROM embeddings JOIN c USING (label) GROUP BY label""")
def vector_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per label how near its vectors are to their mean."""
    e = table(spark, sf_dir, "embeddings")
    mean = e.select("label", F.posexplode("embedding").alias("_i", "_v")).groupBy("label", "_i").agg(F.avg(F.col("_v").cast("double")).alias("_v"))
    centres = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda x: x["_v"]).alias("_centre"))  # one number per dimension
    near = stats.cosine(F.transform("embedding", lambda x: x.cast("double")), F.col("_centre"))
    return e.join(centres, "label").withColumn("_near", near).groupBy("label").agg(F.count("*").alias("n"), F.avg("_near").alias("closeness"), F.min("_near").alias("farthest"))

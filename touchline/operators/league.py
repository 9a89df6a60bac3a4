"""Standings, form, difficulty, score models and simulated seasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The share of draws between equals, and how the margin counts in a knockout tie.
DRAW, KNOCKOUT_POWER = 0.28, 2.8
#: Simulated seasons that one row holds side by side.
SIMS = 16


def standings(teams: DataFrame) -> DataFrame:
    """League table of team rows: played, won, drawn, lost, goals, points, rank by points, difference, goals, name, all descending."""
    p = F.col("points")
    table = teams.groupBy("league", "season", "team").agg(F.count("*").alias("played"), F.count_if(p == 3).alias("won"), F.count_if(p == 1).alias("drawn"), F.count_if(p == 0).alias("lost"), F.sum("goals_for").alias("gf"), F.sum("goals_against").alias("ga"), F.sum("points").alias("pts"), F.sum(F.when(F.col("side") == "home", p)).alias("home_pts"))
    w = Window.partitionBy("league", "season").orderBy(F.desc("pts"), F.desc(F.col("gf") - F.col("ga")), F.desc("gf"), F.desc("team"))
    return table.withColumns({"gd": F.col("gf") - F.col("ga"), "rank": F.row_number().over(w)})


def form_table(teams: DataFrame, n: int) -> DataFrame:
    """Each team's last n matches: points per game and the results, newest first."""
    w = Window.partitionBy("league", "team").orderBy(F.desc("match_date"), F.desc("match_id"))
    last = teams.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    mark = F.when(F.col("points") == 3, "W").when(F.col("points") == 1, "D").otherwise("L")
    return last.groupBy("league", "team").agg(F.count("*").alias("played"), F.avg("points").alias("ppg"), F.sum("goal_diff").alias("gd"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_rn", mark.alias("r")))), lambda x: x["r"]), "").alias("form"))


def tied_clusters(table: DataFrame, teams: DataFrame) -> DataFrame:
    """Teams level on points, goal difference and goals, with the matches among them and whether all have met."""
    key = ["league", "season", "pts", "gd", "gf"]
    t = table.withColumn("_n", F.count("*").over(Window.partitionBy(*key))).where("_n > 1").select(*key, "team")
    other = t.select(*key, F.col("team").alias("opponent"))
    among = t.join(other, key).where("team < opponent").join(teams.where("side = 'home'").select("league", "season", F.least("team", "opponent").alias("team"), F.greatest("team", "opponent").alias("opponent")).distinct().withColumn("met", F.lit(1)), ["league", "season", "team", "opponent"], "left")
    return among.groupBy(*key).agg(F.count("*").alias("pairs"), F.count("met").alias("met")).withColumn("complete", F.col("pairs") == F.col("met"))


def head_to_head(teams: DataFrame) -> DataFrame:
    """Meetings, wins, draws and goals of every ordered pair that has met."""
    p = F.col("points")
    return teams.groupBy("team", "opponent").agg(F.count("*").alias("meetings"), F.count_if(p == 3).alias("wins"), F.count_if(p == 1).alias("draws"), F.sum("goals_for").alias("gf"), F.sum("goals_against").alias("ga"))


def bradley_terry(home: Column, away: Column, advantage: float = 0.3) -> dict[str, Column]:
    """Win, draw and loss probabilities and expected points from strengths, of which none counts less than 1e-6, null neither."""
    strength = lambda x: F.log1p(F.greatest(x.cast("double"), F.lit(1e-6)))
    d = strength(home) - strength(away) + advantage
    draw = DRAW * F.exp(-F.abs(d))
    win = (1 - draw) / (1 + F.exp(-d))
    return {"p_home": win, "p_draw": draw, "p_away": 1 - draw - win, "expected_points": 3 * win + draw}


def poisson_strengths(matches: DataFrame, smoothing: float = 1.0) -> DataFrame:
    """Home and away attack and defence ratios of each team to the mean rates, smoothed by so many mean matches; and the means."""
    mean = matches.agg(F.avg("home_goals").alias("mu_home"), F.avg("away_goals").alias("mu_away"))
    home = matches.groupBy(F.col("home").alias("team")).agg(F.sum("home_goals").alias("hf"), F.sum("away_goals").alias("ha"), F.count("*").alias("hn"))
    away = matches.groupBy(F.col("away").alias("team")).agg(F.sum("away_goals").alias("af"), F.sum("home_goals").alias("aa"), F.count("*").alias("an"))
    both = home.join(away, "team", "full").na.fill(0).crossJoin(F.broadcast(mean))
    ratio = lambda goals, n, mu: (F.col(goals) + smoothing * F.col(mu)) / ((F.col(n) + smoothing) * F.col(mu))
    return both.select("team", "mu_home", "mu_away", ratio("hf", "hn", "mu_home").alias("home_attack"), ratio("ha", "hn", "mu_away").alias("home_defence"), ratio("af", "an", "mu_away").alias("away_attack"), ratio("aa", "an", "mu_home").alias("away_defence"))


def rates(fixtures: DataFrame, strengths: DataFrame) -> DataFrame:
    """The two goal rates of each fixture."""
    h, a = strengths.select(F.col("team").alias("home"), "mu_home", "mu_away", "home_attack", "home_defence"), strengths.select(F.col("team").alias("away"), "away_attack", "away_defence")
    out = fixtures.join(h, "home").join(a, "away")
    return out.withColumns({"lambda_home": F.col("mu_home") * F.col("home_attack") * F.col("away_defence"), "lambda_away": F.col("mu_away") * F.col("away_attack") * F.col("home_defence")}).drop("mu_home", "mu_away", "home_attack", "home_defence", "away_attack", "away_defence")


def tau(i: Column, j: Column, home: Column, away: Column, rho: float) -> Column:
    """The low-score factor of Dixon and Coles."""
    t = F.when((i == 0) & (j == 0), 1 - home * away * rho).when((i == 0) & (j == 1), 1 + home * rho).when((i == 1) & (j == 0), 1 + away * rho).when((i == 1) & (j == 1), F.lit(1 - rho)).otherwise(1.0)
    return F.greatest(t, F.lit(1e-12))


def score_matrix(fixtures: DataFrame, max_goals: int = 10, rho: float = 0.0) -> DataFrame:
    """A row per fixture and score (i, j) with its probability, normalised over the scores up to max_goals."""
    goals = lambda: F.explode(F.sequence(F.lit(0), F.lit(max_goals)))
    grid = fixtures.withColumn("i", goals()).withColumn("j", goals())
    pois = lambda lam, k: F.exp(-F.col(lam)) * F.pow(F.col(lam), F.col(k)) / F.factorial(F.col(k))
    p = pois("lambda_home", "i") * pois("lambda_away", "j")
    if rho:
        p = p * tau(F.col("i"), F.col("j"), F.col("lambda_home"), F.col("lambda_away"), rho)
    return grid.withColumn("_p", p).withColumn("p", F.col("_p") / F.sum("_p").over(Window.partitionBy("match_id"))).drop("_p")


def outcome_probabilities(matrix: DataFrame) -> DataFrame:
    """Per fixture: home, draw, away, over 2.5 goals, both score."""
    s = lambda c: F.sum(F.when(c, F.col("p")).otherwise(0.0))
    i, j = F.col("i"), F.col("j")
    return matrix.groupBy("match_id").agg(s(i > j).alias("p_home"), s(i == j).alias("p_draw"), s(i < j).alias("p_away"), s(i + j > 2).alias("p_over"), s((i > 0) & (j > 0)).alias("p_btts"))


def uniform(*parts: Column | int) -> Column:
    """A pseudo-random number in [0, 1) that follows from its arguments alone, so a lost task repeats itself."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])), 1, 12), 16, 10).cast("double")
    return h / float(1 << 48)


def simulated_seasons(table: DataFrame, fixtures: DataFrame, sims: int, seed: int) -> DataFrame:
    """Mean points and rank, and shares of first places, over simulated remainders of seasons.

    table: league, season, team, pts. fixtures: match_id, league, season, home, away, p_home, p_draw. Each simulation draws every fixture once.
    """
    key, size = ["league", "season"], min(SIMS, max(sims, 1))
    blocks = table.sparkSession.range(-(-sims // size)).select(F.col("id").alias("_b"))
    u = lambda k: uniform(F.lit(seed), F.col("_b") * size + k, F.col("match_id"))
    points = lambda x: F.when(x < F.col("p_home"), 3).when(x < F.col("p_home") + F.col("p_draw"), 1).otherwise(0)
    each = F.sequence(F.lit(0), F.lit(size - 1))
    # the points of a block of simulations lie side by side in a row, and are summed by team before any shuffle
    drawn = fixtures.crossJoin(F.broadcast(blocks)).withColumn("_h", F.transform(each, lambda k: points(u(k))))
    away = F.transform("_h", lambda x: F.when(x == 3, 0).when(x == 1, 1).otherwise(3))
    both = drawn.select("_b", *key, F.explode(F.array(F.struct(F.col("home").alias("team"), F.col("_h").alias("pts")), F.struct(F.col("away").alias("team"), away.alias("pts")))).alias("x"))
    won = both.groupBy("_b", *key, "x.team").agg(F.array(*[F.sum(F.col("x.pts")[k]) for k in range(size)]).alias("_won"))
    final = table.crossJoin(F.broadcast(blocks)).join(won, ["_b", *key, "team"], "left").repartition(*key)
    runs = F.explode(F.transform(each, lambda k: F.struct((F.col("_b") * size + k).alias("sim"), (F.col("pts") + F.coalesce(F.get("_won", k), F.lit(0))).alias("total"))))
    final = final.select(*key, "team", runs.alias("x")).select(*key, "team", "x.*").where(F.col("sim") < sims)
    w = Window.partitionBy("sim", *key).orderBy(F.desc("total"), "team")
    ranked = final.withColumn("place", F.row_number().over(w))
    return ranked.groupBy(*key, "team").agg(F.avg("total").alias("mean_points"), F.avg("place").alias("mean_place"), F.avg((F.col("place") == 1).cast("double")).alias("p_first"))


def knockout_probability(home: Column, away: Column, k: float = KNOCKOUT_POWER) -> Column:
    return F.pow(home, F.lit(k)) / (F.pow(home, F.lit(k)) + F.pow(away, F.lit(k)))


def in_play(fixtures: DataFrame, step: int = 5, duration: int = 90, max_goals: int = 10) -> DataFrame:
    """Probabilities of the final result from 0-0 at each step of a match: goals still to come follow the remaining time."""
    timed = fixtures.withColumn("minute", F.explode(F.sequence(F.lit(0), F.lit(duration), F.lit(step))))
    left = F.lit(1.0) - F.col("minute") / duration
    timed = timed.withColumns({"_id": F.struct("match_id", "minute"), "lambda_home": F.col("lambda_home") * left, "lambda_away": F.col("lambda_away") * left})
    out = outcome_probabilities(score_matrix(timed.drop("match_id").withColumnRenamed("_id", "match_id"), max_goals))
    return out.select("match_id.match_id", "match_id.minute", "p_home", "p_draw", "p_away")

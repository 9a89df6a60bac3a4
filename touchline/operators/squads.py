"""Squads: ratings found by name in a cascade, strengths of teams with their parts, and depth by role and unit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import cut, running

#: Planned players by role, and the roles of each unit.
TARGETS = {"GK": 2, "CB": 4, "FB": 4, "DM": 1, "CM": 4, "AM": 1, "W": 3, "ST": 3}
UNITS = {"goalkeepers": ("GK",), "defense": ("CB", "FB"), "midfield": ("DM", "CM", "AM"), "attack": ("W", "ST")}

#: The five leagues whose ratings count as well covered.
BIG = ("Premier League", "La Liga", "Bundesliga", "Serie A", "Ligue 1")

LEVELS = {0: "exact", 1: "case", 2: "last_name"}


def _words(name: Column) -> Column:
    return F.filter(F.split(F.lower(name), r"[\s\p{Z}]+"), lambda w: w != "")


def rated(squads: DataFrame, ratings: DataFrame, order: str, name: str = "name", score: str = "score", league: str = "league", season: str = "season", latest: str | None = None, big: Sequence[str] = BIG) -> DataFrame:
    """squads with match_level (exact, case or last_name; null for none), rating and rating_confidence (high for a league of `big`, else medium).

    A squad's name takes the ratings of the same name; without any, those equal but for case; without any, those whose
    name holds its last word anywhere. Of these the row of season `latest` with the least order counts, else the least
    of all; where its score is null there is no rating, though the level says that a name was found. Null names match
    nothing, names without a word nothing by their last word. Every squad row stays.

    Ratings shrink to the best row of each name before anything is joined. The last level is an index of the pieces of
    rated words as long as some last word, each piece with its best row, so that no pair of names is compared and a
    word in many names costs one row.
    """
    value = F.when(~F.isnan(F.col(score).cast("double")), F.col(score).cast("double"))
    late = F.lit(False) if latest is None else F.coalesce(F.col(season) != latest, F.lit(True))
    best = F.struct(late.alias("late"), F.col(order).alias("at"), value.alias("score"), F.col(league).alias("league"))
    per = cut(ratings.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("_name")).agg(F.min(best).alias("_best")))
    wanted = squads.where(F.col(name).isNotNull()).select(F.col(name).alias("_name")).distinct()
    keys = F.array(*[F.struct(F.lit(i).alias("level"), k.alias("key")) for i, k in enumerate((F.col("_name"), F.lower("_name"), F.try_element_at(_words(F.col("_name")), F.lit(-1))))])
    asked = cut(wanted.select("_name", F.explode(keys).alias("_x")).select("_name", "_x.*").where(F.col("key").isNotNull()))

    needles = asked.where("level = 2").select("key").distinct()
    lengths = sorted(r[0] for r in needles.select(F.length("key")).distinct().toLocalIterator())
    words = per.select(F.explode(F.array_distinct(_words(F.col("_name")))).alias("_word"), "_best").groupBy("_word").agg(F.min("_best").alias("_best"))
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("_word"))
    pieces = words.withColumn("_n", F.explode(fitting)).withColumn("_i", F.explode(F.sequence(F.lit(1), F.length("_word") - F.col("_n") + 1)))
    pieces = pieces.select(F.substring("_word", F.col("_i"), F.col("_n")).alias("key"), "_best").join(needles, "key", "left_semi")

    def index(level: int, rows: DataFrame) -> DataFrame:
        return rows.groupBy("key").agg(F.min("_best").alias("_best")).select(F.lit(level).alias("level"), "key", "_best")

    found = index(0, per.withColumnRenamed("_name", "key")).unionByName(index(1, per.select(F.lower("_name").alias("key"), "_best"))).unionByName(index(2, pieces))
    first = asked.join(found, ["level", "key"]).groupBy("_name").agg(F.min(F.struct("level", "_best")).alias("_x"))
    first = first.select("_name", F.col("_x.level").alias("_level"), F.col("_x._best.score").alias("_score"), F.col("_x._best.league").alias("_league"))
    out = squads.join(first, squads[name] == F.col("_name"), "left")
    level = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])[F.col("_level")]
    sure = F.when(F.col("_score").isNotNull(), F.when(F.coalesce(F.col("_league").isin(*big), F.lit(False)), "high").otherwise("medium"))
    return out.select(*[squads[c] for c in squads.columns], level.alias("match_level"), F.col("_score").alias("rating"), sure.alias("rating_confidence"))


def proxy(league: Column, known: Mapping[str, float], big: Sequence[str] = BIG) -> Column:
    """A rating for a player of a league that isn't scored: that of the league, else 58 for the five big ones, else by words of its name, else 42."""
    own = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[league] if known else F.lit(None)
    by_name = F.when(league.isin(*big), 58.0).when(league.contains("League One") | league.contains("League Two"), 38.0).when(league.contains("Super League"), 43.0).when(league.contains("Bundesliga"), 46.0)
    return F.coalesce(own.cast("double"), by_name, F.lit(42.0))


def strengths(squad: DataFrame, team: str, league: str, rating: str = "rating", known: Mapping[str, float] | None = None, chances: Mapping[str, float] | None = None, hosts: Sequence = (), big: Sequence[str] = BIG) -> DataFrame:
    """One row per team: strength from 0 to 1 and its parts, unrounded.

    Players without a rating count by their league. The best eleven, the next seven and the rest are averaged apart; a
    part without players takes the one before it. chances: a team's chance by others, 0.01 for those without; 0.16 or
    more is the whole of that part. Numbers of a team go by ranges, so no task sorts a large one.
    """
    by_league = proxy(F.col(league), known or {}, big)
    rows = squad.select(F.col(team).alias("team"), F.col(rating).cast("double").alias("_r"), by_league.alias("_p"), F.coalesce(F.col(league).isin(*big), F.lit(False)).cast("double").alias("_b"))
    rows = running(cut(rows.withColumns({"_score": F.coalesce("_r", "_p"), "_down": -F.coalesce("_r", "_p")})), ["team"], ["_down"], {})
    part = lambda low, high: F.avg(F.when((F.col("_i") >= low) & (F.col("_i") < high), F.col("_score")))
    out = rows.groupBy("team").agg(F.count("*").alias("total_players"), F.count("_r").alias("rated_players"), F.coalesce(F.avg("_r"), F.lit(43.0)).alias("observed_avg_rating"), F.avg("_p").alias("proxy_avg_rating"), part(0, 11).alias("core_avg_rating"), part(11, 18).alias("_depth"), part(18, 1 << 62).alias("_reserve"), F.avg("_b").alias("big5_ratio"))
    c = F.col
    within = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    out = out.withColumn("coverage", c("rated_players") / c("total_players"))
    out = out.withColumns({"shrunk_avg_rating": c("coverage") * c("observed_avg_rating") + (1 - c("coverage")) * c("proxy_avg_rating"), "depth_avg_rating": F.coalesce("_depth", "core_avg_rating")})
    out = out.withColumn("reserve_avg_rating", F.coalesce("_reserve", "depth_avg_rating"))
    out = out.withColumn("squad_quality_rating", 0.55 * c("core_avg_rating") + 0.20 * c("depth_avg_rating") + 0.10 * c("reserve_avg_rating") + 0.15 * c("shrunk_avg_rating"))
    chance = F.coalesce(F.create_map(*[F.lit(x) for kv in chances.items() for x in kv])[c("team")], F.lit(0.01)) if chances else F.lit(0.01)
    out = out.withColumns({"rating_score": within((c("squad_quality_rating") - 30) / 40), "outside_score": F.least(chance / 0.16, F.lit(1.0)), "league_score": within((c("proxy_avg_rating") - 35) / 25), "coverage_score": F.pow("coverage", F.lit(0.7)), "big5_score": F.least(c("big5_ratio") / 0.6, F.lit(1.0))})
    plain = 0.46 * c("rating_score") + 0.24 * c("outside_score") + 0.18 * c("league_score") + 0.07 * c("coverage_score") + 0.05 * c("big5_score")
    strength = F.when(c("team").isin(*hosts), F.least(plain + 0.04, F.lit(1.0))).otherwise(plain) if hosts else plain
    return out.withColumn("strength", strength).drop("_depth", "_reserve")


def depth(squad: DataFrame, team: str, role: str, rating: str = "rating", targets: Mapping[str, int] = TARGETS) -> DataFrame:
    """(team, role, n, target, depth_status, n_rated, coverage, mean_rating) of every role with a target, for every team, those without players too: missing, thin, adequate or deep."""
    per = squad.where(F.col(role).isin(*targets)).groupBy(F.col(team).alias("team"), F.col(role).alias("role")).agg(F.count("*").alias("n"), F.count(rating).alias("n_rated"), F.avg(rating).alias("mean_rating"))
    planned = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(t).alias("target")) for r, t in targets.items()])
    every = squad.select(F.col(team).alias("team")).distinct().select("team", F.explode(planned).alias("_x")).select("team", "_x.*")
    out = every.join(per, ["team", "role"], "left").fillna(0, ["n", "n_rated"])
    n, t = F.col("n"), F.col("target")
    status = F.when(n == 0, "missing").when(n < t, "thin").when(n == t, "adequate").otherwise("deep")
    return out.select("team", "role", "n", "target", status.alias("depth_status"), "n_rated", F.when(n > 0, F.col("n_rated") / n).otherwise(0.0).alias("coverage"), "mean_rating")


def units(squad: DataFrame, team: str, role: str, rating: str = "rating", parts: Mapping[str, Sequence[str]] = UNITS) -> DataFrame:
    """(team, unit, n, n_rated, coverage, mean_rating) of every unit of every team."""
    names = F.create_map(*[F.lit(x) for u, roles in parts.items() for r in roles for x in (r, u)])
    out = depth(squad.select(F.col(team).alias("team"), names[F.col(role)].alias("unit"), F.col(rating).alias("rating")), "team", "unit", "rating", dict.fromkeys(parts, 0))
    return out.select("team", F.col("role").alias("unit"), "n", "n_rated", "coverage", "mean_rating")

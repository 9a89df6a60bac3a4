"""Queries of team and player matching: customers under names of letters against themselves, with changes planted by id, so that SQL can tell every decision."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators import identity

from .registry import query
from .stand_ins import table

LETTERS = ("0123456789", "ghijklmnop")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.translate(F.md5(k.cast("string")), *LETTERS).alias("name"), F.concat(F.lit("land "), "c_nationkey").alias("country"), F.concat(F.lit("born "), k % 1000).alias("born"), F.concat(F.lit("team "), k % 30).alias("team"), F.lit("2425").alias("season"), F.lit("gk").alias("position"))


def shortened(by: int):
    return F.expr(f"left(name, length(name) - {by})")


def decisions(key: str, cases: dict[str, tuple]) -> str:
    """SQL of what was planted: the case of id -> (decision, reason, whether the id is found, score, candidates)."""
    pick = lambda i: " ".join(f"WHEN {c} THEN {v[i]}" for c, v in cases.items())
    return f"SELECT c_custkey AS id, CASE {pick(0)} END AS decision, CASE {pick(1)} END AS reason, CASE WHEN CASE {pick(2)} END THEN c_custkey END AS canonical, CASE {pick(3)} END::DOUBLE AS score, CASE {pick(4)} END::BIGINT AS n_candidates FROM customer".replace("id %", f"{key} %")


TEAMS = {
    "id % 70 = 5": ("'bridge'", "'fuzzy_auto'", "true", "1.0", "NULL"),
    "id % 7 IN (0, 5)": ("'bridge'", "'deterministic_exact'", "true", "1.0", "NULL"),
    "id % 7 = 1": ("'rejected'", "'country_conflict'", "false", "0.0", "1"),
    "id % 7 = 2": ("'bridge'", "'fuzzy_auto'", "true", "62.0::DOUBLE / 63", "NULL"),
    "id % 7 = 3": ("'review'", "'fuzzy_review'", "true", "54.0::DOUBLE / 59", "NULL"),
    "id % 7 = 4": ("'rejected'", "'low_similarity'", "false", "NULL", "NULL"),
    "id % 7 = 6": ("'rejected'", "'no_candidates'", "false", "0.0", "NULL"),
}
PLAYERS = {
    "id % 7 = 0": ("'bridge'", "'deterministic_exact'", "true", "1.0", "NULL"),
    "id % 7 = 1": ("'rejected'", "'dob_conflict'", "false", "0.0", "1"),
    "id % 7 = 2": ("'bridge'", "'deterministic_team_season_position'", "true", "0.98", "NULL"),
    "id % 7 = 3": ("'bridge'", "'fuzzy_auto'", "true", "1.0", "NULL"),
    "id % 7 = 4": ("'bridge'", "'fuzzy_auto'", "true", "62.0::DOUBLE / 63", "NULL"),
    "id % 7 = 5": ("'review'", "'fuzzy_review'", "true", "54.0::DOUBLE / 59", "NULL"),
    "id % 7 = 6": ("'rejected'", "'low_similarity'", "false", "NULL", "NULL"),
}


@query(decisions("c_custkey", TEAMS))
def team_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_, k = people(spark, sf_dir), F.col("id") % 7
    country = F.when(F.col("id") % 70 == 5, None).when(k == 1, F.concat("country", F.lit(" abroad"))).when(k == 6, "nowhere").otherwise(F.col("country"))
    name = F.when(k == 2, shortened(1)).when(k == 3, shortened(5)).when(k == 4, F.reverse("name")).when(k == 6, F.concat(F.lit("q"), "name")).otherwise(F.col("name"))
    return identity.match_teams(all_.select("id", name.alias("name"), country.alias("country")), all_.select(F.col("id").alias("canonical"), "name", "country"), "id", "canonical")


@query(decisions("c_custkey", PLAYERS))
def player_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_, k = people(spark, sf_dir), F.col("id") % 7
    changed = {"name": F.when(k == 4, shortened(1)).when(k == 5, shortened(5)).when(k == 6, F.reverse("name")).otherwise(F.col("name")), "born": F.when(k == 1, "never").when(~k.isin(2, 3), F.col("born")), "team": F.when(k == 3, "other").otherwise(F.col("team"))}
    return identity.match_players(all_.withColumns(changed).withColumnRenamed("country", "nation"), all_.withColumnsRenamed({"id": "canonical", "country": "nation"}), "id", "canonical")

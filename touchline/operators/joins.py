"""As-of joins, reshaping of two-sided rows, upserts, ledgers and fallback lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import joined
from .stats import quantiles


def asof(left: DataFrame, right: DataFrame, by: str, at: str, right_at: str, values: Sequence[str], allow_exact: bool = True) -> DataFrame:
    """left with the values of right's latest row at or before its time, by entity; null where there is none.

    One shuffle of the union by entity and one sort: a right row comes before a left row of its time if exact matches
    count, else after it. Two right rows of one time: the one that sorts last by its values counts.
    """
    side = F.lit(0 if allow_exact else 2)
    rows = left.select(F.struct("*").alias("_row"), F.col(by).alias("_by"), F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_value"))
    rows = rows.unionByName(right.select(F.col(by).alias("_by"), F.col(right_at).alias("_at"), side.alias("_side"), F.struct(*values).alias("_value")), allowMissingColumns=True)
    w = Window.partitionBy("_by").orderBy("_at", "_side", "_value").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_last", F.last("_value", ignorenulls=True).over(w)).where("_side = 1")
    return out.select("_row.*", *[F.col(f"_last.{v}").alias(v) for v in values])


def two_sided(df: DataFrame, sides: dict[str, dict[str, Column]]) -> DataFrame:
    """One row per side of each row, in one scan: sides maps a side's name to its columns."""
    structs = [F.struct(F.lit(name).alias("side"), *[c.alias(k) for k, c in cols.items()]) for name, cols in sides.items()]
    return df.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def team_rows(matches: DataFrame) -> DataFrame:
    """Two rows per match of (match_id, match_date, league, season, home, away, home_goals, away_goals): team, opponent, goals, points 3/1/0."""
    keep = {k: F.col(k) for k in ("match_id", "match_date", "league", "season")}

    def one(us: str, them: str) -> dict[str, Column]:
        gf, ga = F.col(f"{us}_goals"), F.col(f"{them}_goals")
        return keep | {"team": F.col(us), "opponent": F.col(them), "goals_for": gf, "goals_against": ga, "goal_diff": gf - ga, "points": F.when(gf > ga, 3).when(gf == ga, 1).otherwise(0)}

    return two_sided(matches, {"home": one("home", "away"), "away": one("away", "home")})


def fixtures_from_sides(rows: DataFrame) -> DataFrame:
    """One row per match from its two team rows, by one aggregation instead of a self-join."""
    side = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    return rows.groupBy("match_id").agg(side("home", "team").alias("home"), side("away", "team").alias("away"), side("home", "goals_for").alias("home_goals"), side("away", "goals_for").alias("away_goals"))


def latest(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key by a total order."""
    w = Window.partitionBy(*key).orderBy(*[c.desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upsert(existing: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows by primary key, those of incoming first; columns by name, missing ones null. Null keys are refused."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    bad = [F.col(k).isNull() for k in key]
    both = both.where(F.when(F.greatest(*[F.coalesce(b.cast("int"), F.lit(0)) for b in bad], F.lit(0)) > 0, F.raise_error(F.lit("null primary key"))).otherwise(True))
    return latest(both, key, [F.col("_new")]).drop("_new")


def active(ledger: DataFrame, key: Sequence[str], order: Sequence[Column], action: str = "action", ends: str = "revoked") -> DataFrame:
    """The latest record of each key of an append-only ledger, unless it ends the key."""
    return latest(ledger, key, order).where(F.col(action) != ends)


def not_superseded(ledger: DataFrame, record_id: str, supersedes: str) -> DataFrame:
    gone = ledger.where(F.col(supersedes).isNotNull()).select(F.col(supersedes).alias("_gone")).distinct()
    return ledger.join(gone, F.col(record_id) == F.col("_gone"), "left_anti")


def unplayed(teams: DataFrame, played: DataFrame) -> DataFrame:
    """Ordered pairs of a league's teams in a season that haven't met: (league, season, home, away). Pairs are made within a league and season only, whose teams are few."""
    key = ["league", "season"]
    # what a team has met, and the teams there are, go to it as arrays, so no pair is moved
    home = teams.where(F.col("team").isNotNull()).select(*key, F.col("team").alias("home"))
    met = played.where(F.col("away").isNotNull()).groupBy(*key, "home").agg(F.collect_set("away").alias("_met"))
    there = home.groupBy(*key).agg(F.collect_list("home").alias("_there"))
    left = F.filter("_there", lambda x: (x != F.col("home")) & ~F.coalesce(F.array_contains("_met", x), F.lit(False)))
    return home.join(met, [*key, "home"], "left").join(there, key).select(*key, "home", F.explode(left).alias("away"))


def fallback(df: DataFrame, levels: Sequence[Sequence[str]], value: str, name: str) -> DataFrame:
    """The median of value by the first of several key sets that has one; [] is the whole table. Null keys match null keys."""
    out, found = df, []
    for i, keys in enumerate(levels):
        out = joined(out, quantiles(df, keys, value, {f"_m{i}": 0.5}), keys, "left")
        found.append(f"_m{i}")
    return out.withColumn(name, F.coalesce(*found)).drop(*found)


def resolved(df: DataFrame, mapping: DataFrame, source: str, source_id: str, canonical: str) -> DataFrame:
    """The canonical id of each (source, id), or unresolved:<source>:<id>."""
    m = mapping.select(F.col(source).alias("_s"), F.col(source_id).alias("_i"), F.col(canonical).alias("_c"))
    out = df.join(m, (F.col(source) == F.col("_s")) & (F.col(source_id) == F.col("_i")), "left")
    return out.withColumn(canonical, F.coalesce("_c", F.concat_ws(":", F.lit("unresolved"), source, source_id))).drop("_s", "_i", "_c")


def in_interval(df: DataFrame, intervals: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """df with every interval that holds its value, from low to below high: both sides meet in cells of a width, so the join is an equi-join; an interval goes to each cell that it touches."""
    cells = intervals.where(F.col(low) < F.col(high)).withColumn("_cell", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    rows = df.withColumn("_at", F.floor(F.col(value) / width))
    return rows.join(cells, (F.col("_at") == F.col("_cell")) & (F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("_at", "_cell")

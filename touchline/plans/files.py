"""Queries of season files and preflights, over files that Spark writes from the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators.ranges import new_dir
from touchline.sources import preflight, seasons
from touchline.streaming import ingest

from .registry import query
from .stand_ins import MATCHES, matches, table

WRITTEN = r"season=(\d{4})/league=([^/]+)/[^/]+\.csv$"
CLUBS = MATCHES + """, clubs AS (SELECT match_id, season, 'L' || league AS league_code, 'Málaga ' || home AS HomeTeam, 'Club "' || away || '", N' AS AwayTeam, home_goals AS FTHG, away_goals AS FTAG,
 CASE WHEN season % 2 = 0 THEN home_goals - away_goals END AS GD FROM matches)"""


def season_folder(spark: SparkSession, sf_dir: str) -> str:
    """Matches as season files: even years in UTF-8 with a column more, odd ones in Latin-1; names with quotes, commas and accents."""
    m = matches(spark, sf_dir).select("match_id", F.concat(F.lit("Málaga "), "home").alias("HomeTeam"), F.concat(F.lit('Club "'), "away", F.lit('", N')).alias("AwayTeam"), F.col("home_goals").alias("FTHG"), F.col("away_goals").alias("FTAG"), (F.col("home_goals") - F.col("away_goals")).alias("GD"), "season", F.concat(F.lit("L"), "league").alias("league"))
    root = new_dir(spark, "seasons")
    for rows, encoding in ((m.where("season % 2 = 0"), "UTF-8"), (m.where("season % 2 <> 0").drop("GD"), "ISO-8859-1")):
        rows.repartition("season", "league").write.mode("append").partitionBy("season", "league").option("header", True).option("encoding", encoding).option("escape", '"').csv(root)
    return root


@query(f"WITH {CLUBS} SELECT CASE league_code WHEN 'L0' THEN 'League zero' ELSE league_code END AS league, season::VARCHAR AS season, match_id, HomeTeam, AwayTeam, FTHG, FTAG, GD FROM clubs")
def season_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = seasons.census(spark, season_folder(spark, sf_dir), ["HomeTeam", "AwayTeam"], WRITTEN)
    rows = seasons.combined(spark, files, {"L0": "League zero"})
    return rows.select("league", "season", F.col("match_id").cast("long").alias("match_id"), "HomeTeam", "AwayTeam", *[F.col(c).cast("long").alias(c) for c in ("FTHG", "FTAG", "GD")])


@query(f"""WITH {CLUBS} SELECT season::VARCHAR AS season, league_code, count(*) AS n_rows, 'read' AS status, CASE WHEN any_value(season) % 2 = 0 THEN 'UTF-8' ELSE 'ISO-8859-1' END AS encoding, CASE WHEN any_value(season) % 2 = 0 THEN 0 ELSE 1 END AS n_missing FROM clubs GROUP BY season, league_code""")
def season_file_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = seasons.census(spark, season_folder(spark, sf_dir), ["HomeTeam", "GD"], WRITTEN)
    return files.groupBy("season", "league_code").agg(F.sum("n_rows").alias("n_rows"), F.max("status").alias("status"), F.max("encoding").alias("encoding"), F.max(F.size("missing")).alias("n_missing"))


@query(f"""WITH {CLUBS}, f AS (SELECT DISTINCT season, league_code FROM clubs) SELECT season::VARCHAR AS season, league_code, CASE WHEN league_code = 'L0' AND season % 3 = 0 THEN 'new' WHEN season % 3 = 1 THEN 'changed' WHEN league_code = 'L2' THEN 'skipped' ELSE 'same' END AS status FROM f
UNION ALL SELECT DISTINCT season::VARCHAR, 'LX', 'missing' FROM f""")
def season_file_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files against a record that lacks some, holds other hashes or none for some, and knows of files that are gone."""
    files = seasons.scan(spark, season_folder(spark, sf_dir), WRITTEN)
    year = F.col("season").cast("int")
    digest = F.when(year % 3 == 1, "other").when(F.col("league_code") != "L2", F.col("sha256"))
    kept = files.where(~((F.col("league_code") == "L0") & (year % 3 == 0))).select("season", "league_code", digest.alias("sha256"))
    gone = files.select("season", F.lit("LX").alias("league_code"), F.lit("gone").alias("sha256")).distinct()
    return seasons.changes(kept.unionByName(gone), files).select("season", "league_code", "status")


@query("""SELECT name, 'expected' AS verdict, n_rows, n_null FROM (SELECT count(*) AS n_rows, unnest(['event_id', 'user_id', 'value', 'kind']) AS name, unnest([count(*) - count(event_id), count(*) - count(user_id), count(*) - count(value), count_if(event_type IN ('view', 'error'))]) AS n_null FROM events)
UNION ALL SELECT 'outcome', 'missing', count(*), NULL FROM events""")
def column_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", "user_id", "value", F.when(~F.col("event_type").isin("view", "error"), F.col("event_type")).alias("kind"))
    return seasons.columns(df, ["event_id", "user_id", "value", "kind", "outcome"]).select("name", "verdict", "n_rows", "n_null")


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, true AS readable, (SELECT count(*) FROM {t}) AS n_rows" for t in TABLES))
def parquet_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of the given tables' files decoded; rows of a table's files summed."""
    name = F.regexp_extract("path", rf"/({'|'.join(TABLES)})\.parquet(?:/|$)", 1)
    return preflight.preflight(spark, sf_dir).groupBy(name.alias("name")).agg(F.bool_and("readable").alias("readable"), F.sum("n_rows").alias("n_rows"))


EVENT_SOURCE = dict(schema="event_id long, user_id long, value double, revision int", key=["event_id"], order="revision")


def event_drops(spark: SparkSession, sf_dir: str) -> tuple[ingest.Source, ingest.Source, str]:
    """All events as JSON lines, of which every 97th is cut short, then a second drop with revised values of every tenth; and a source that isn't there. (events, absent, root) after both drops were ingested."""
    root = new_dir(spark, "ingest")
    e = table(spark, sf_dir, "events").select(*[F.col(c).cast("long").alias(c) for c in ("event_id", "user_id")], "value")
    events = ingest.Source("events", f"{root}/in", files_per_batch=4, **EVENT_SOURCE)
    absent = ingest.Source("absent", f"{root}/none", "id long", ["id"])
    line = F.to_json(F.struct("event_id", "user_id", "value", F.lit(1).alias("revision")))
    e.select(F.when(F.col("event_id") % 97 == 0, F.substring(line, 1, 12)).otherwise(line).alias("value")).write.mode("append").text(events.path)
    ingest.ingest(spark, [absent, events], root)
    revised = e.where("event_id % 10 = 0").withColumns({"value": F.col("value") + 1000, "revision": F.lit(0)})
    revised.write.mode("append").json(events.path)
    ingest.ingest(spark, [absent, events], root)
    return events, absent, root


@query("""SELECT event_id, user_id, CASE WHEN event_id % 10 = 0 THEN value + 1000 ELSE value END AS value, CASE WHEN event_id % 10 = 0 THEN 0 ELSE 1 END AS revision FROM events WHERE event_id % 97 <> 0 OR event_id % 10 = 0""")
def ingested_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, _, root = event_drops(spark, sf_dir)
    return ingest.read_table(spark, events, root)


@query("""SELECT 'malformed' AS reason, count(*) AS n FROM events WHERE event_id % 97 = 0""")
def rejected_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, _, root = event_drops(spark, sf_dir)
    return ingest.read_rejects(spark, events, root).groupBy("reason").agg(F.count("*").alias("n"))

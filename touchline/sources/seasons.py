"""Season files with lineage: many CSV files whose headers and encodings differ as one table, what is known of each file, and what changed since a record of them."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.operators.ranges import cut

#: Season code and league code in the path of a file.
PATTERN = r"/(\d{4})/([^/]+)\.csv$"

#: Names of leagues by code.
LEAGUES = {
    "E0": "Premier League", "E1": "Championship", "E2": "League One", "E3": "League Two", "EC": "National League",
    "SC0": "Scottish Premiership", "SC1": "Scottish Championship", "SC2": "Scottish League One", "SC3": "Scottish League Two",
    "D1": "Bundesliga", "D2": "2. Bundesliga", "I1": "Serie A", "I2": "Serie B", "SP1": "La Liga", "SP2": "Segunda División",
    "F1": "Ligue 1", "F2": "Ligue 2", "N1": "Eredivisie", "B1": "First Division A", "P1": "Primeira Liga", "T1": "Süper Lig", "G1": "Super League",
}

MORE, OWN = "_more", ("league", "season", "_file")


def names_of(header: str) -> list[str]:
    """Column names of a header line: one without a name gets its number, a repeated one (in any case) a number behind it."""
    out: list[str] = []
    for i, name in enumerate(next(csv.reader([header]), [])):
        plain = name.strip() or f"Unnamed: {i}"
        tries = (plain if k == 0 else f"{plain}.{k}" for k in range(len(out) + 1))
        out.append(next(t for t in tries if t.lower() not in {o.lower() for o in out}))
    return out


def scan(spark: SparkSession, root: str, pattern: str = PATTERN) -> DataFrame:
    """(file, path, season, league_code, bytes, sha256, encoding, header) of every CSV file below root whose path fits the pattern.

    A task holds one file at a time; one above spark.sql.sources.binaryFile.maxLength (2 GB) is an error. Bytes that aren't UTF-8 are Latin-1.
    Files of no bytes at all are in no listing of Spark's; for changes() they are missing.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(root)
    encoding = F.when(F.is_valid_utf8(F.col("content").cast("string")), "UTF-8").otherwise("ISO-8859-1")
    text = F.when(encoding == "UTF-8", F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))
    part = lambda i: F.regexp_extract("path", pattern, i)
    header = F.regexp_extract(text, r"^\x{FEFF}?(?:[ \t]*[\r\n]+)*([^\r\n]*)", 1)
    out = raw.where(F.col("path").rlike(pattern)).select(F.col("_metadata.file_path").alias("file"), "path", part(1).alias("season"), part(2).alias("league_code"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), encoding.alias("encoding"), header.alias("header"))
    return out


def _rows(spark: SparkSession, paths: Sequence[str], encoding: str, header: str) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names_of(header), MORE]])
    return spark.read.schema(schema).option("header", True).option("encoding", encoding).option("multiLine", True).option("escape", '"').csv(list(paths)).withColumn("_file", F.col("_metadata.file_path"))


def _layouts(files: DataFrame) -> list:
    """(encoding, header, paths) of the files that have a header. Layouts are few; paths are as many as a listing has."""
    return files.where(F.trim("header") != "").groupBy("encoding", "header").agg(F.array_sort(F.collect_list("path")).alias("paths")).orderBy("header", "encoding").collect()


def census(spark: SparkSession, root: str, required: Sequence[str] = (), pattern: str = PATTERN) -> DataFrame:
    """scan() with n_rows, long_lines, missing (required columns that the header hasn't) and status of each file, written to the checkpoint folder.

    broken: some line has more fields than the header; empty: no rows; read: all else. Short lines end in nulls. Nothing of a
    broken file is used, and nothing of it hinders the others.
    """
    files = cut(scan(spark, root, pattern))
    layouts = _layouts(files)
    counts = [_rows(spark, x.paths, x.encoding, x.header).groupBy("_file").agg(F.count("*").alias("n_rows"), F.count_if(F.col(f"`{MORE}`").isNotNull()).alias("long_lines")) for x in layouts]
    per = reduce(DataFrame.unionAll, counts, spark.createDataFrame([], "_file string, n_rows long, long_lines long"))
    lacking = spark.createDataFrame([(x.encoding, x.header, [c for c in required if c not in names_of(x.header)]) for x in layouts], "encoding string, header string, missing array<string>")
    out = files.join(per, files["file"] == per["_file"], "left").drop("_file").join(F.broadcast(lacking), ["encoding", "header"], "left")
    none = F.array(*[F.lit(c) for c in required]).cast("array<string>")
    out = out.fillna(0, ["n_rows", "long_lines"]).withColumn("missing", F.coalesce("missing", none))
    return cut(out.withColumn("status", F.when(F.col("long_lines") > 0, "broken").when(F.col("n_rows") == 0, "empty").otherwise("read")))


def combined(spark: SparkSession, files: DataFrame, leagues: Mapping[str, str] = LEAGUES) -> DataFrame:
    """The rows of all files of a census whose status is read, columns united by name (in any case) as text, with league, season and _file.

    League codes without a name stay. A file's own columns of these names give way to them.
    """
    tables = [_rows(spark, x.paths, x.encoding, x.header).drop(MORE, "league", "season") for x in _layouts(files.where("status = 'read'"))]
    if not tables:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in OWN))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    name = F.coalesce(F.create_map(*[F.lit(x) for kv in leagues.items() for x in kv])[F.col("league_code")] if leagues else F.lit(None), F.col("league_code"))
    origin = files.select(F.col("file").alias("_file"), name.alias("league"), "season")
    return rows.join(origin, "_file").select(*[F.col(f"`{c}`") for c in rows.columns if c not in OWN], *OWN)


def manifest(files: DataFrame) -> DataFrame:
    """One row: total_rows, n_files, league_seasons in order, and input_hash, the SHA-256 of the hashes of the files read one after another by season and path. The row holds 64 bytes a file."""
    read = files.where("status = 'read'")
    hashes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("season", "file", "sha256"))), lambda x: x["sha256"]), "")
    pairs = F.array_sort(F.collect_list(F.concat_ws("/", "league_code", "season")))
    return read.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("total_rows"), F.count("*").alias("n_files"), pairs.alias("league_seasons"), F.when(F.count("*") > 0, F.sha2(hashes, 256)).otherwise("").alias("input_hash"))


def changes(recorded: DataFrame, files: DataFrame, key: Sequence[str] = ("season", "league_code"), digest: str = "sha256") -> DataFrame:
    """(key, recorded_hash, current_hash, status) of every file recorded or there: same, changed, missing, new, or skipped where the record holds no hash.

    key names one file on each side; a key that stands several times pairs each with each.
    """
    a = recorded.select(*key, F.col(digest).alias("recorded_hash"), F.lit(True).alias("_a"))
    b = files.select(*key, F.col(digest).alias("current_hash"), F.lit(True).alias("_b"))
    status = F.when(F.col("_a").isNull(), "new").when(F.col("recorded_hash").isNull(), "skipped").when(F.col("_b").isNull(), "missing").when(F.col("recorded_hash") == F.col("current_hash"), "same").otherwise("changed")
    return a.join(b, list(key), "full").select(*key, "recorded_hash", "current_hash", status.alias("status"))


def lineage(found: DataFrame) -> DataFrame:
    """One row of changes(): verified, failures (changed or missing), skipped, and passed. New files aren't a failure of what is recorded."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return found.agg(n("same").alias("verified"), n("changed", "missing").alias("failures"), n("skipped").alias("skipped"), (n("changed", "missing") == 0).alias("passed"))


def columns(df: DataFrame, expected: Sequence[str] = ()) -> DataFrame:
    """(name, type, n_rows, n_null, verdict) of every column, from one aggregation: verdict is expected, extra, or missing for one that df lacks; null where nothing is expected."""
    if not df.columns:
        one = df.agg(F.count("*").alias("_rows"))
    else:
        one = df.agg(F.count("*").alias("_rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"_{i}") for i, c in enumerate(df.columns)])
    verdict = lambda c: ("expected" if c in expected else "extra") if expected else None

    def entry(name: str, kind: str | None, nulls: Column, v: str | None) -> Column:
        return F.struct(F.lit(name).alias("name"), F.lit(kind).cast("string").alias("type"), F.col("_rows").alias("n_rows"), nulls.cast("long").alias("n_null"), F.lit(v).cast("string").alias("verdict"))

    there = [entry(f.name, f.dataType.simpleString(), F.col(f"_{i}"), verdict(f.name)) for i, f in enumerate(df.schema)]
    lacking = [entry(c, None, F.lit(None), "missing") for c in expected if c not in df.columns]
    return one.select(F.explode(F.array(*there, *lacking)).alias("x")).select("x.*") if there or lacking else one.select(F.explode(F.array().cast("array<struct<name:string,type:string,n_rows:bigint,n_null:bigint,verdict:string>>")).alias("x")).select("x.*")

"""Scans and sinks: Parquet upserts, CSV with unknown encodings, nested JSON, append-only JSON lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from touchline.functions.scalar import csv_safe
from touchline.operators.joins import upsert


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def first_present(df: DataFrame, names: Sequence[str]) -> str | None:
    return next((n for n in names if n in df.columns), None)


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None where there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def write_upsert(spark: SparkSession, incoming: DataFrame, path: str, key: Sequence[str]) -> DataFrame:
    """Writes incoming over the rows of the same key into the next version below path; readers take the newest complete one."""
    require(incoming, key)
    version, existing = current(spark, path)
    out = upsert(existing, incoming, key) if existing is not None else upsert(incoming.limit(0), incoming, key)
    out.write.parquet(f"{path}/v{version + 1:06d}")
    return spark.read.parquet(f"{path}/v{version + 1:06d}")


def current(spark: SparkSession, path: str) -> tuple[int, DataFrame | None]:
    """(number, table) of the newest version that was written to its end."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return 0, None
    names = sorted(x.getPath().getName() for x in fs.listStatus(root))
    done = [n for n in names if n.startswith("v") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return (int(done[-1][1:]), spark.read.parquet(f"{path}/{done[-1]}")) if done else (0, None)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header as text columns; files that aren't UTF-8 are read as Latin-1, and a byte-order mark goes."""
    def read(encoding: str) -> DataFrame:
        r = spark.read.option("header", True).option("encoding", encoding)
        return (r.schema(schema) if schema else r).csv(path)

    df = read("UTF-8")
    broken = df.where(F.greatest(*[F.instr(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), "�") for c in df.columns], F.lit(0)) > 0)
    df = read("ISO-8859-1") if not broken.isEmpty() or any("�" in c for c in df.columns) else df
    return df.toDF(*[c.removeprefix("﻿").removeprefix("ï»¿") for c in df.columns])


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; texts that a spreadsheet would run as formulas are quoted."""
    df.select(*[csv_safe(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema]).write.option("header", True).csv(path)


def flattened(df: DataFrame, separator: str = "_") -> DataFrame:
    """Nested structs as columns named by their path; arrays stay."""
    def fields(schema: T.StructType, path: list[str]):
        for f in schema:
            if isinstance(f.dataType, T.StructType):
                yield from fields(f.dataType, [*path, f.name])
            else:
                yield F.col(".".join(f"`{p}`" for p in [*path, f.name])).alias(separator.join([*path, f.name]))

    return df.select(*fields(df.schema, []))


def coordinates(df: DataFrame, column: str) -> DataFrame:
    """An array of coordinates as columns _x, _y and _z."""
    return df.withColumns({f"{column}_{a}": F.get(column, F.lit(i)).cast("double") for i, a in enumerate("xyz")}).drop(column)


def read_ledger(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines of a ledger; a line that doesn't fit the schema fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def append_ledger(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)

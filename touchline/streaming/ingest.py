"""Incremental ingest: one checkpointed stream a source, new files only; a source that fails leaves the others complete, and a batch that is played again changes nothing."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAD, BATCH, FILE, AT = "_bad_record", "_batch", "_source_file", "_modified"
RESULT = "source string, status string, n_new long, n_rejected long, error string"


@dataclass(frozen=True)
class Source:
    """JSON lines or CSV files below path. Of rows with the same key the last counts: by batch, then by `order` (a column; else by the file's time and name), then by all values.

    A row is rejected, and kept aside with its text, where it doesn't fit the schema or a column of the key is null.
    """

    name: str
    path: str
    schema: str
    key: Sequence[str]
    format: str = "json"
    order: str | None = None
    options: dict = field(default_factory=dict)
    files_per_batch: int = 1000


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _complete(spark: SparkSession, folder: str) -> list[str]:
    """The batches below folder that were written to their end."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return []
    paths = [f"{folder}/{x.getPath().getName()}" for x in fs.listStatus(p)]
    return sorted(x for x in paths if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{x}/_SUCCESS")))


def _schema(source: Source) -> T.StructType:
    return T.StructType.fromDDL(source.schema)


def _rank(source: Source, columns: Sequence[str]) -> list:
    first = [F.col(source.order)] if source.order else []
    return [c.desc_nulls_last() for c in [*first, F.col(AT), F.col(FILE), F.xxhash64(*columns)]]


def _last(rows: DataFrame, source: Source, batches: bool) -> DataFrame:
    """The last row of each key. Within a batch a window whose key is the table's own; over batches the newest by a maximum, which combines before it shuffles."""
    columns = _schema(source).names
    if batches:
        keep = [c for c in rows.columns if c not in source.key]
        out = rows.groupBy(*source.key).agg(F.max_by(F.struct(*keep), BATCH).alias("_row"))
        return out.select(*source.key, "_row.*").select(*columns)
    w = Window.partitionBy(*source.key).orderBy(*_rank(source, columns))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def write_batch(batch: DataFrame, number: int, source: Source, root: str) -> None:
    """Good rows to root/tables/<name>/<number>, the others to root/rejects/<name>/<number>. A batch has its own folder and writes all of it, so the second time is as the first."""
    usable = F.lit(True)
    for k in source.key:
        usable &= F.col(k).isNotNull()
    batch = batch.persist()
    try:
        good = batch.where(F.col(BAD).isNull() & usable).drop(BAD)
        bad = batch.where(F.col(BAD).isNotNull() | ~usable).withColumn("reason", F.when(F.col(BAD).isNotNull(), "malformed").otherwise("no key"))
        text = F.coalesce(F.col(BAD), F.to_json(F.struct(*_schema(source).names)))
        bad.select(text.alias("record"), "reason", FILE).write.mode("overwrite").parquet(f"{root}/rejects/{source.name}/{number:08d}")
        _last(good, source, False).withColumn(BATCH, F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{root}/tables/{source.name}/{number:08d}")
    finally:
        batch.unpersist()


def read_table(spark: SparkSession, source: Source, root: str) -> DataFrame:
    """The current rows of a source: of each key that of its newest complete batch."""
    paths = _complete(spark, f"{root}/tables/{source.name}")
    if not paths:
        return spark.createDataFrame([], _schema(source))
    return _last(spark.read.parquet(*paths), source, True)


def read_rejects(spark: SparkSession, source: Source, root: str) -> DataFrame:
    paths = _complete(spark, f"{root}/rejects/{source.name}")
    return spark.read.parquet(*paths) if paths else spark.createDataFrame([], f"record string, reason string, {FILE} string")


def _stream(spark: SparkSession, source: Source, root: str):
    schema = T.StructType([*_schema(source).fields, T.StructField(BAD, T.StringType())])
    reader = spark.readStream.schema(schema).format(source.format).options(**source.options)
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).option("maxFilesPerTrigger", source.files_per_batch)
    rows = reader.load(source.path).withColumns({FILE: F.col("_metadata.file_path"), AT: F.col("_metadata.file_modification_time")})
    return rows.writeStream.queryName(f"ingest-{source.name}").foreachBatch(lambda b, n: write_batch(b, n, source, root)).option("checkpointLocation", f"{root}/checkpoints/{source.name}").trigger(availableNow=True).start()


def ingest(spark: SparkSession, sources: Sequence[Source], root: str) -> DataFrame:
    """Reads what is new in every source, all at once, and returns (source, status, n_new, n_rejected, error): complete, or failed with the reason.

    n_new and n_rejected count the rows of the batches of this run, before keys meet. A failed source goes on where it stopped the next time.
    """
    def batches(s: Source) -> set[str]:
        return set(_complete(spark, f"{root}/tables/{s.name}"))

    if len({s.name for s in sources}) < len(sources):
        raise ValueError("sources need names of their own")
    before, running, failed = {}, {}, {}
    for s in sources:
        try:
            before[s.name] = batches(s)
            running[s.name] = _stream(spark, s, root)
        except Exception as e:  # the others go on
            failed[s.name] = str(e)
    for name, q in running.items():
        try:
            q.awaitTermination()
        except Exception as e:  # the others go on
            failed[name] = str(e)
    out = []
    for s in sources:
        new = sorted(batches(s) - before.get(s.name, set()))
        rejects = [p.replace("/tables/", "/rejects/") for p in new]
        out.append((s.name, "failed" if s.name in failed else "complete", spark.read.parquet(*new).count() if new else 0, spark.read.parquet(*rejects).count() if new else 0, failed.get(s.name, "")[:1000] or None))
    return spark.createDataFrame(out, RESULT)


def compact(spark: SparkSession, source: Source, root: str) -> None:
    """The complete batches as one, under the number of the newest, so that reading does not slow down with their count.

    What is written takes its place by a rename; the folded batches go after it. Lost in between, the batches still say the same, as the newest has every key. No ingest of the source may run meanwhile.
    """
    paths = _complete(spark, f"{root}/tables/{source.name}")
    if len(paths) < 2:
        return
    fs, _ = _fs(spark, root)
    P = spark._jvm.org.apache.hadoop.fs.Path
    number = max(int(x.rsplit("/", 1)[1].split("-")[0]) for x in paths)
    beside = f"{root}/compacting/{source.name}"
    _last(spark.read.parquet(*paths), source, True).withColumns({FILE: F.lit(None).cast("string"), AT: F.lit(None).cast("timestamp"), BATCH: F.lit(number).cast("long")}).write.mode("overwrite").parquet(beside)
    merged = f"{root}/tables/{source.name}/{number:08d}-{uuid.uuid4().hex}"
    if not fs.rename(P(beside), P(merged)):
        raise OSError(f"could not move {beside}")
    for p in paths:
        fs.delete(P(p), True)

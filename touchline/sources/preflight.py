"""Parquet files read to their end before anything depends on them; those that can't be are set apart and can be put back."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators.ranges import cut

REPORT = "path string, bytes long, readable boolean, error string, n_rows long, n_columns int, footer_rows long, schema_sha256 string"

#: Files up to this many bytes are decoded by one task each; larger ones by Spark's own reader, a job each, split by row groups.
WHOLE = 256 << 20


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each file is decoded from the buffer in which it came, without a copy, in short batches of rows that are dropped at once."""
    import pyarrow.parquet as pq

    kinds = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("readable", pa.bool_()), ("error", pa.string()), ("n_rows", pa.int64()), ("n_columns", pa.int32()), ("footer_rows", pa.int64()), ("schema_sha256", pa.string())])
    for b in batches:
        for i in range(b.num_rows):
            path, length = b.column("path")[i].as_py(), b.column("length")[i].as_py()
            footer = columns = schema = None
            try:
                f = pq.ParquetFile(pa.BufferReader(b.column("content")[i].as_buffer()))
                footer, columns = f.metadata.num_rows, len(f.schema_arrow)
                schema = hashlib.sha256("\n".join(f"{x.name}:{x.type}" for x in f.schema_arrow).encode()).hexdigest()
                n = sum(x.num_rows for x in f.iter_batches(batch_size=4096))
                row = (path, length, True, None, n, columns, footer, schema)
            except Exception as e:  # any failure to decode is the finding
                row = (path, length, False, f"{type(e).__name__}: {e}"[:500], None, columns, footer, schema)
            yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(row, kinds)], schema=kinds)


def preflight(spark: SparkSession, root: str, whole: int = WHOLE) -> DataFrame:
    """(path, bytes, readable, error, n_rows, n_columns, footer_rows, schema_sha256) of every Parquet file below root, written to the checkpoint folder.

    Every column of every row group is decoded. footer_rows and the schema's hash are those of the footer, where that can be
    read; they are null for files above `whole` bytes, of which only the paths come to the driver.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(root)
    few = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")  # a batch is one file
    try:
        small = cut(raw.where(F.col("length") <= whole).select("path", "length", "content").mapInArrow(_decoded, REPORT))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", few)
    large = []
    for path, length in raw.where(F.col("length") > whole).select("path", "length").toLocalIterator():
        try:
            df = spark.read.parquet(path)
            df.write.format("noop").mode("overwrite").save()
            large.append((path, length, True, None, df.count(), len(df.columns), None, None))
        except Exception as e:  # any failure to decode is the finding
            large.append((path, length, False, f"{type(e).__name__}: {e}"[:500], None, None, None, None))
    return small.unionByName(spark.createDataFrame(large, REPORT)) if large else small


def set_apart(spark: SparkSession, report: DataFrame, root: str, folder: str, dry_run: bool = True) -> DataFrame:
    """(path, apart, error) of each unreadable file: where it goes below folder, by its path below root. Without dry_run the files are moved, and the list is appended to folder/moved as JSON.

    A copy that is there already is never written over; the newcomer gets a number. Files that are gone are left out.
    """
    P = spark._jvm.org.apache.hadoop.fs.Path
    base = P(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    prefix = fs.makeQualified(base).toString().rstrip("/") + "/"
    listed, taken = [], set()
    for path, error in report.where(~F.col("readable")).orderBy("path").select("path", "error").toLocalIterator():
        full = fs.makeQualified(P(path)).toString()
        below = full.removeprefix(prefix) if full.startswith(prefix) else hashlib.sha1(full.encode()).hexdigest()[:8] + "_" + full.rsplit("/", 1)[-1]
        to, k = f"{folder}/{below}", 0
        while to in taken or fs.exists(P(to)):
            k, to = k + 1, f"{folder}/{below}.{k + 1}"
        if not fs.exists(P(full)):
            continue
        taken.add(to)
        listed.append((full, to, error))
    out = spark.createDataFrame(listed, "path string, apart string, error string")
    if listed and not dry_run:
        out.withColumn("moved_at", F.current_timestamp()).write.mode("append").json(f"{folder}/moved")  # before the moves, so that no move is without its record
        for path, to, _ in listed:
            fs.mkdirs(P(to).getParent())
            if not fs.rename(P(path), P(to)):
                raise OSError(f"could not move {path}")
    return out


def put_back(spark: SparkSession, folder: str) -> int:
    """Moves what set_apart() moved to where it was, unless a file is there now; how many."""
    P = spark._jvm.org.apache.hadoop.fs.Path
    fs = P(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    n = 0
    for path, to in spark.read.schema("path string, apart string").json(f"{folder}/moved").distinct().toLocalIterator():
        if fs.exists(P(to)) and not fs.exists(P(path)):
            fs.mkdirs(P(path).getParent())
            n += bool(fs.rename(P(to), P(path)))
    return n

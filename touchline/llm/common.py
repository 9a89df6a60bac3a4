"""What several training-data operators share: the shared folder, written intermediate tables, bounded bitmaps and byte buffers."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Least and most bits of a membership bitmap, which has 16 or more to a member between: at most 32 MiB, so it may be broadcast.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Where it is unset: a temporary one if all run on this machine, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="touchline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def work_dir(spark: SparkSession) -> str:
    """This application's folder of intermediate tables in the shared folder."""
    return f"{shared_dir(spark)}/touchline-{spark.sparkContext.applicationId}"


def clean_up(spark: SparkSession) -> bool:
    """Deletes all intermediate tables of this application. Results that read them must have been written before."""
    return deleted(spark, work_dir(spark))


def deleted(spark: SparkSession, path: str) -> bool:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a compressed Parquet table in the shared folder, read again: cuts the lineage and survives lost executors. Stays until clean_up()."""
    return written_at(df, tag)[0]


def written_at(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """written() and its path, for deleted() once all that reads it has been written in turn."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def apart(key: Column) -> Column:
    """A long made of a key, one to one. A table of counts by a key, joined on this on both sides, is dealt out anew for
    the join: only then can Spark split the rows of a key that is everywhere, as it splits what comes straight from a shuffle."""
    return key.bitwiseXOR(F.lit(1).cast("long"))


def fold(text: Column) -> Column:
    """Lower-cases A-Z only; null counts as empty. lower() is the fast way for pure ASCII, where it does the same."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def bits_for(members: int) -> int:
    """Bits of a bitmap for this many hashes. Beyond MOST_BITS / 16 hashes more others pass by chance, which costs time and changes no result."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (16 * members).bit_length()))


def bitmap(hashes: DataFrame, column: str, size: int = LEAST_BITS * 8) -> DataFrame:
    """At most size / 32768 rows (bucket, bits) that mark the values of a hash column modulo size, a power of two."""
    slot = F.pmod(F.col(column), F.lit(size)) + 1
    return hashes.groupBy(F.bitmap_bucket_number(slot).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("_bits"))


def marked(df: DataFrame, value: Column, bits: DataFrame, flag: str, size: int = LEAST_BITS * 8) -> DataFrame:
    """df with a boolean: whether value's slot is set in a bitmap() of this size. True for every member; for others, true by chance."""
    slot = F.pmod(value, F.lit(size)) + 1
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.pow(F.lit(2.0), at % 8).cast("int")) > 0
    joined = df.withColumn("_bucket", F.bitmap_bucket_number(slot)).join(F.broadcast(bits), "_bucket", "left")
    return joined.withColumn(flag, F.coalesce(bit, F.lit(False))).drop("_bucket", "_bits")


def collect_bitmap(hashes: DataFrame, column: str) -> np.ndarray:
    """bitmap() as one array on the driver, for a broadcast to Python tasks, of a size that follows the number of hashes. The hashes are written first."""
    spark = hashes.sparkSession
    path = f"{work_dir(spark)}/hashes-{uuid.uuid4().hex}"
    hashes.select(F.col(column).alias("hash")).write.parquet(path)
    hashes = spark.read.schema("hash long").parquet(path)
    size = bits_for(hashes.count())
    out = np.zeros(size // 8, dtype=np.uint8)
    for bucket, bits in bitmap(hashes, "hash", size).toLocalIterator():
        out[(bucket - 1) * 4096 : (bucket - 1) * 4096 + len(bits)] = np.frombuffer(bits, dtype=np.uint8)
    deleted(spark, path)
    return out


def hits(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the 64-bit hashes have their slot set in collect_bitmap()'s array."""
    slot = hashes.astype(np.int64, copy=False) & (8 * len(bits) - 1)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 != 0


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow array without nulls: row i is bytes[offsets[i]:offsets[i + 1]]."""
    column = column.cast(pa.large_binary()) if pa.types.is_binary(column.type) else column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    base = int(offsets[0]) if len(offsets) else 0
    return raw[base : int(offsets[-1])] if len(offsets) else raw, offsets - base


def texts(column: pa.Array) -> list[bytes]:
    """The rows of a string column as UTF-8 bytes, null as empty."""
    return [x if x is not None else b"" for x in column.cast(pa.large_binary()).to_pylist()]


def portions(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose strings or bytes in a column make some size bytes, or one row."""
    of = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64)) // size
    cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def distinct_parts(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct strings, the place of each string among them, strings of each row) of a column of lists without nulls."""
    found = lists.flatten().dictionary_encode()
    return found.dictionary, found.indices.to_numpy(), pc.list_value_length(lists).to_numpy().astype(np.int64)


def distinct_words(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """distinct_parts() of the words between ASCII white space, A-Z lower-cased, of a string column without nulls."""
    words, codes, n = distinct_parts(pc.ascii_split_whitespace(pc.ascii_lower(column)))
    empty = pc.index(words, "").as_py()
    if empty >= 0:  # white space at an end of a text
        kept = codes != empty
        n = np.bincount(np.repeat(np.arange(len(n)), n)[kept], minlength=len(n))
        codes = codes[kept]
    return words, codes, n


def listed(column: pa.Array) -> list:
    """to_pylist() of strings or bytes, by way of numpy, which is several times faster."""
    return column.to_numpy(zero_copy_only=False).tolist()


def byte_rows(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary column of rows of so many items each."""
    ends = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64))) * data.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def filled(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def registered() -> tuple[dict, dict]:
    """The queries of this subpackage and their oracle SQL, by name."""
    from . import queries

    return queries.QUERIES, queries.ORACLES


#: Base of the rolling polynomial hash, modulo 2^64; odd, so that it has an inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Spans hashed at a time, and bytes of text gathered before they are.
SPANS, SLICE = 1 << 16, 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads a polynomial hash over all its bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of the bytes, equal for equal contents; spans ascend. Extra memory follows SPANS, not the text."""
    out = np.zeros(len(starts), dtype=np.uint64)
    for at in range(0, len(starts), SPANS):
        a, b = starts[at : at + SPANS], ends[at : at + SPANS]
        lo, hi = int(a[0]), int(b.max())
        total = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * _powers(BASE, hi - lo), dtype=np.uint64, out=total[1:])
        back = _powers(INVERSE, hi - lo + 1)
        out[at : at + SPANS] = mixed((total[b - lo] - total[a - lo]) * back[a - lo] + (b - a).astype(np.uint64))
    return out


def slices(docs: list[bytes]):
    """(first index, docs) in runs of about SLICE bytes."""
    at, size = 0, 0
    for i, d in enumerate(docs):
        size += len(d)
        if size >= SLICE:
            yield at, docs[at : i + 1]
            at, size = i + 1, 0
    if at < len(docs):
        yield at, docs[at:]


def shingle_spans(docs: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, document) of all k-word shingles of texts, lower-cased A-Z, words joined by a space.

    A text of fewer words is one shingle, one of none has no shingle.
    """
    joined = [b" ".join(d.lower().split()) for d in docs]
    data = np.frombuffer(b"\n".join([*joined, b""]), dtype=np.uint8)
    of = np.repeat(np.arange(len(docs)), [x.count(b" ") + 1 if x else 0 for x in joined])
    space, line = data == 32, data == 10
    first = np.flatnonzero(~(space | line) & np.concatenate(([True], (space | line)[:-1])))
    last = np.flatnonzero(~(space | line) & np.concatenate(((space | line)[1:], [True]))) + 1
    n = np.bincount(of, minlength=len(docs))
    whole = np.arange(len(first) - k + 1) if len(first) >= k else np.zeros(0, dtype=np.int64)
    whole = whole[of[whole] == of[whole + k - 1]]
    short = np.flatnonzero((n > 0) & (n < k))
    at = np.concatenate(([0], np.cumsum(n)[:-1])) if len(docs) else n
    starts = np.concatenate((first[whole], first[at[short]]))
    ends = np.concatenate((last[whole + k - 1], last[at[short] + n[short] - 1]))
    doc = np.concatenate((of[whole], short))
    order = np.argsort(starts, kind="stable")
    return data, starts[order], ends[order], doc[order]

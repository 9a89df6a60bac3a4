"""Line de-duplication by the passages of two lines or more that stand elsewhere first.

Every window of WINDOW successive lines is hashed, and the hashes are counted; only windows that occur again are read
as text, where grouping by hash and content compares their bytes. A window's first occurrence, by doc_id and then
place, is its owner; the lines of all others go. Successive and overlapping windows make up the whole repeated passage,
wherever it begins and ends, so all its lines go and no line beside it. The first occurrence of a line in such a
passage always stays; where a text repeats itself line for line, one line of the run does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, apart, collect_bitmap, filled, hits, mixed, slices, span_hashes, texts, written

#: Lines in the rolling window, which is also the shortest passage.
WINDOW = 2


def line_windows(docs: list[bytes]) -> tuple[np.ndarray, ...]:
    """(bytes, document, first line, hash, start, end) of every window of WINDOW successive lines."""
    data = np.frombuffer(b"\n".join([*docs, b""]), dtype=np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    n = np.array([d.count(b"\n") + 1 for d in docs], dtype=np.int64)
    h = span_hashes(data, starts, ends)
    of = np.repeat(np.arange(len(docs)), n)
    first = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    at = np.flatnonzero(of[: len(of) - WINDOW + 1] == of[WINDOW - 1 :])
    rolled = np.zeros(len(at), dtype=np.uint64)
    for k in range(WINDOW):
        rolled = rolled * np.uint64(BASE) + h[at + k]
    return data, of[at], first[at], mixed(rolled).view(np.int64), starts[at], ends[at + WINDOW - 1]


def line_chunks(docs: list[bytes]) -> Iterator[tuple[int, int, int, int, bytes | memoryview]]:
    """(document, first line, lines, hash, content) of the windows."""
    data, of, first, h, starts, ends = line_windows(docs)
    for d, f, x, a, b in zip(of.tolist(), first.tolist(), h.tolist(), starts.tolist(), ends.tolist(), strict=True):
        yield d, f, WINDOW, x, data[a:b]


def chunk_rows(rows: DataFrame, bits=None) -> DataFrame:
    """(hash) of every window of (id, key, text), or with a broadcast bitmap (id, key, first, lines, hash, content) of those it marks."""
    if bits is None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, docs in slices(texts(batch.column(2))):
                    yield pa.RecordBatch.from_arrays([pa.array(line_windows(docs)[3])], names=["hash"])

        return rows.mapInArrow(run, "hash long")

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, docs in slices(texts(batch.column(2))):
                data, doc, first, h, starts, ends = line_windows(docs)
                keep = np.flatnonzero(hits(bits.value, h))
                of = pa.array(at + doc[keep])
                content = [data[a:b].tobytes() for a, b in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)]
                lines = pa.array(np.full(len(keep), WINDOW, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(of), batch.column(1).take(of), pa.array(first[keep].astype(np.int32)), lines, pa.array(h[keep]), pa.array(content, type=pa.binary())],
                    names=["id", "key", "first", "lines", "hash", "content"],
                )

    return rows.mapInArrow(marked, "id long, key long, first int, lines int, hash long, content binary")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated passages of lines taken out of the text, and two more columns: n_lines before and n_lines_removed.

    Lines end at line feeds only. Rows that repeat an id and its text are one document and stay alike; a null id
    comes before all others. Null text stays null, with n_lines 0; an empty text is one empty line. A text of which
    nothing stays is empty. Columns of docs named n_lines or n_lines_removed are replaced, all others stay.
    """
    spark = docs.sparkSession
    key = F.xxhash64(filled(F.col(text_col)))
    rows = docs.where(F.instr(F.col(text_col), "\n") > 0).select(F.col(id_col).cast("long").alias("id"), key.alias("key"), filled(F.col(text_col)).alias("text"))
    again = chunk_rows(rows).groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    bits = spark.sparkContext.broadcast(collect_bitmap(again, "hash"))
    found = written(chunk_rows(rows, bits), "line-chunks")
    # grouped by the hash, joined by a value made of it: both sides are dealt out for the join, and Spark can split a window that is everywhere
    place = F.struct("id", "key", "first")
    owners = found.groupBy("hash", "content").agg(F.min(place).alias("owner"), F.count("*").alias("n")).where("n > 1").select(apart(F.col("hash")).alias("_hash"), F.col("content").alias("_content"), "owner")
    gone = found.join(owners, (apart(F.col("hash")) == F.col("_hash")) & (F.col("content") == F.col("_content"))).where(~place.eqNullSafe(F.col("owner")))
    gone = gone.groupBy("id", "key").agg(F.collect_set(F.struct("first", "lines")).alias("_gone")).select(F.col("id").alias("_id"), F.col("key").alias("_key"), "_gone")

    own = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_doc"), key.alias("_text_key"), F.col(text_col).alias("_text"))
    joined = own.join(gone, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key")), "left")
    lines = F.split("_text", "\n")
    dropped = F.array_distinct(F.flatten(F.transform("_gone", lambda g: F.sequence(g["first"], g["first"] + g["lines"] - 1))))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped)
    text = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("_lines", i)), "\n"))
    out = joined.withColumn("_lines", lines).select("_row", text.alias("_text"), F.coalesce(F.when(F.col("_text").isNotNull(), F.size("_lines")), F.lit(0)).alias("_n"), F.coalesce(F.when(F.col("_gone").isNotNull(), F.size(dropped)), F.lit(0)).alias("_dropped"))
    same = [F.col(f"_row.`{c}`").alias(c) if c != text_col else F.col("_text").alias(c) for c in docs.columns if c not in ("n_lines", "n_lines_removed")]
    return out.select(*same, F.col("_n").cast("long").alias("n_lines"), F.col("_dropped").cast("long").alias("n_lines_removed"))

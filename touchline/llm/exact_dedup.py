"""Exact de-duplication by progressive refinement: length, then prefix hash, then full hash.

DataFrame functions only. Each level counts its classes with map-side aggregation and marks those that
hold more than one row in a bitmap of fixed size; rows outside it are singletons and go no further, so the
full content is hashed for surviving classes alone. A saturated bitmap lets more rows through and changes
no result, as the last level counts full hashes. No text is shuffled: only ids, lengths and hashes are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, filled, fold, marked

PREFIX_CHARS = 256


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. The largest id of a group stays. text_sha256 is null
    for rows proven unique before the last level, unless digest_all. Null text counts as empty, so all empty
    texts are one group. Rows that repeat an id and its text are kept or dropped alike and each counts in
    group_size. A null id never wins over another; a group of null ids alone has keep_id null and is kept.
    An empty table gives no rows; other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), filled(F.col(text_col)).alias("_text"))
    length = F.octet_length("_text").cast("long")
    prefix = F.xxhash64(length, fold(F.substring("_text", 1, prefix_chars)))

    lengths = rows.groupBy(length.alias("_length")).agg(F.count("*").alias("_n")).where("_n > 1")
    some = marked(rows, length, bitmap(lengths, "_length"), "_open").where("_open")
    prefixes = some.groupBy(length.alias("_length"), prefix.alias("_prefix")).agg(F.count("*").alias("_n")).where("_n > 1")

    full = F.sha2(fold(F.col("_text")), 256)
    level3 = marked(rows, prefix, bitmap(prefixes, "_prefix"), "_open")
    hashed = level3.select("doc_id", length.alias("_length"), F.when(F.col("_open"), full).alias("_full"), (full if digest_all else F.when(F.col("_open"), full)).alias("text_sha256"))

    # grouped by length and hash, joined by hash alone: so both sides are dealt out for the join, and Spark can split the rows of a huge group
    groups = hashed.where("_full is not null").groupBy("_length", "_full").agg(F.max("doc_id").alias("_keep"), F.count("*").alias("_n")).where("_n > 1")
    joined = hashed.alias("a").join(groups.alias("b"), F.col("a._full") == F.col("b._full"), "left")
    keep = F.when(F.col("b._n").isNotNull(), F.col("b._keep")).otherwise(F.col("a.doc_id"))
    return joined.select(F.col("a.doc_id").alias("doc_id"), keep.alias("keep_id"), F.coalesce("b._n", F.lit(1)).cast("long").alias("group_size"), F.col("a.doc_id").eqNullSafe(keep).alias("kept"), F.col("a.text_sha256").alias("text_sha256"))

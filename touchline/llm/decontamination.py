"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

An item of n distinct shingles is contained in a document when at least need = ceil(t * n) of them occur there. So of
any n - need + h of its shingles at least h must occur. The item's MinHash sketch is its n - need + h shingles of least
hash, where shingles that several items share come last; h and so the sketch's length depend on the size n alone,
which is what partitions the search: each size has the sketch and the number of sketch hits that can miss nothing, and
longer items ask for more hits. Documents are read once; a bitmap lets pass those of their shingles that any item has.
Only pairs with enough sketch hits are verified, by comparing the item's shingles as text with those of the document,
so a shingle that many items and documents share makes no pairs by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import collect_bitmap, filled, hits, shingle_spans, slices, span_hashes, texts, written

WORDS, SIMILARITY = 5, 0.8
#: One sketch hit in so many needed shingles is asked for.
HIT = 4


def shingles_of(rows: DataFrame, words: int, bits=None) -> DataFrame:
    """(id, key, hash, shingle): the distinct shingles of each row of (id, key, text); with a broadcast bitmap, only those that it marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, docs in slices(texts(batch.column(2))):
                data, starts, ends, doc = shingle_spans(docs, words)
                h = span_hashes(data, starts, ends)
                if bits is not None:
                    keep = hits(bits.value, h)
                    starts, ends, doc, h = starts[keep], ends[keep], doc[keep], h[keep]
                found = list(dict.fromkeys((int(d), x, data[a:b].tobytes()) for d, x, a, b in zip(doc, h.view(np.int64).tolist(), starts.tolist(), ends.tolist(), strict=True)))
                rows = pa.array([first + d for d, _, _ in found], type=pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array([x for _, x, _ in found], type=pa.int64()), pa.array([s for _, _, s in found], type=pa.binary())], names=["id", "key", "hash", "shingle"])

    return rows.mapInArrow(run, "id long, key long, hash long, shingle binary")


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (doc_id, text_key, item_id, n_shingles, n_shared, containment) with containment >= similarity.

    Texts are compared by distinct shingles of lower-cased words; a text of fewer words than a shingle is one
    shingle. Null, empty and blank texts have none and contain and match nothing. Rows of items that repeat an id
    are one item with the shingles of all; items without an id are left out. A document is told by id and text
    together (text_key: a hash of its text), so null or repeated ids don't mix texts, and repeated rows give one
    pair. Empty tables give no rows; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    own = items.where(F.col(item_id_col).isNotNull()).select(F.col(item_id_col).cast("long").alias("id"), F.lit(0).cast("long").alias("key"), filled(F.col(item_text_col)).alias("text"))
    own = written(shingles_of(own, words).groupBy("id", "hash", "shingle").agg(F.lit(1).alias("_1")).select("id", "hash", "shingle"), "items")
    sized = sketched(own, similarity)
    bits = spark.sparkContext.broadcast(collect_bitmap(own, "hash"))

    text = filled(F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    found = written(shingles_of(rows, words, bits), "item-shingles")
    pairs = candidates(found, sized)
    # every shingle of a candidate's item is looked up among those of its document
    asked = pairs.join(sized.select(F.col("item").alias("_item"), "n", "need", "hash", "shingle"), F.col("item") == F.col("_item")).drop("_item")
    there = found.select(F.col("id").alias("_id"), F.col("key").alias("_key"), F.col("hash").alias("_hash"), F.col("shingle").alias("_shingle"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")) & (F.col("hash") == F.col("_hash")) & (F.col("shingle") == F.col("_shingle"))
    counted = asked.join(there, same, "left_semi").groupBy("id", "key", "item", "n", "need").agg(F.count("*").alias("n_shared")).where("n_shared >= need")
    return counted.select(F.col("id").alias("doc_id"), F.col("key").alias("text_key"), F.col("item").alias("item_id"), F.col("n").alias("n_shingles"), "n_shared", (F.col("n_shared") / F.col("n")).alias("containment"))


def sketched(own: DataFrame, similarity: float) -> DataFrame:
    """(item, hash, shingle, n, need, hits, sketch) of (id, hash, shingle): an item's size, shingles needed, sketch hits needed, and whether the shingle is in the sketch."""
    shared = own.groupBy("hash", "shingle").agg(F.count("*").alias("items"))
    own = own.join(shared.select(F.col("hash").alias("_hash"), F.col("shingle").alias("_shingle"), "items"), (F.col("hash") == F.col("_hash")) & (F.col("shingle") == F.col("_shingle")))
    by_item = Window.partitionBy("id")  # a group is one item, the shingles of a short text
    sized = own.withColumns({"n": F.count("*").over(by_item), "rank": F.row_number().over(by_item.orderBy("items", "hash", "shingle"))})
    sized = sized.withColumn("need", F.ceil(F.col("n") * F.lit(similarity) - 1e-9).cast("long")).withColumn("hits", F.ceil(F.col("need") / HIT))
    return written(sized.select(F.col("id").alias("item"), "hash", "shingle", "n", "need", "hits", (F.col("rank") <= F.col("n") - F.col("need") + F.col("hits")).alias("sketch")), "sketches")


def candidates(found: DataFrame, sized: DataFrame) -> DataFrame:
    """(id, key, item): the pairs with enough sketch hits, of the documents' shingles (id, key, hash, shingle)."""
    sketch = sized.where("sketch").select("item", F.col("hash").alias("_hash"), F.col("shingle").alias("_shingle"), "hits")
    hit = found.join(sketch, (F.col("hash") == F.col("_hash")) & (F.col("shingle") == F.col("_shingle")))
    return written(hit.groupBy("id", "key", "item", "hits").agg(F.count("*").alias("n_hits")).where("n_hits >= hits").select("id", "key", "item"), "candidates")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """docs without the rows whose text contains an item; all their columns stay as they are."""
    found = contained(docs, items, id_col, text_col, **more).select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")).groupBy("_doc", "_key").agg(F.lit(1).alias("_1")).drop("_1")
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_id"), F.xxhash64(filled(F.col(text_col))).alias("_text"))
    return rows.join(found, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_text") == F.col("_key")), "left_anti").select("_row.*")

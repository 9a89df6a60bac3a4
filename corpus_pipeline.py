"""The corpus pipeline: toxic documents go, repeated lines go, one near-copy stays, contaminated documents go, the rest is encoded.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from public_tokenizers import path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.bpe import encode_decode
from touchline.llm.common import work_dir
from touchline.llm.decontamination import decontaminate
from touchline.llm.line_dedup import line_dedup
from touchline.llm.simhash import one_of_each
from touchline.llm.toxicity import THRESHOLD, toxicity

TOKENIZER = "byte_bpe_50k.json"
#: Words of a shingle, and the Jaccard similarity from which two documents are near copies.
SHINGLE, SIMILARITY = 5, 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; null and empty texts among them."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    own = docs.select(F.struct("*").alias("_row"), "doc_id", "text")
    return toxicity(own, labels).where(F.col("toxicity") < THRESHOLD).select("_row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their chunks of lines that stand elsewhere first; n_chars follows the text."""
    done = line_dedup(docs.select(F.struct("*").alias("_row"), "doc_id", "text"))
    length = F.when(F.col("n_lines_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("_row.n_chars"))
    new = {"text": F.col("text"), "n_chars": length}
    return done.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, that of the smallest id: 5-word shingles at a similarity of 0.8 or more."""
    return one_of_each(docs, shingle=SHINGLE, similarity=SIMILARITY)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, and digests of the ids and of the text decoded from them."""
    return encode_decode(docs, str(path(TOKENIZER))).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_repeated_lines), ("simhash near-dedup", drop_near_copies), ("benchmark decontamination", drop_contaminated), ("bpe encoding and decoding", encode)]

#: SQL can express neither the classifier nor fingerprints nor BPE; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{work_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs

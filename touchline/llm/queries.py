"""The registered queries of the training-data operators and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import alignment
from .bpe import encode_decode
from .decontamination import contained
from .exact_dedup import exact_dedup
from .hmm import score
from .line_dedup import line_dedup
from .negatives import hard_negatives
from .pii import pseudonymise
from .repeats import remove_repeats
from .simhash import near_duplicates
from .token_files import token_round_trip
from .toxicity import toxicity
from .warc import warc_round_trip

#: Stands for the secret of a deployment.
PSEUDONYM_KEY = "not a secret: for the test tables"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)


ORACLES["op5_exact_dedup"] = f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
FROM (SELECT doc_id, sha256({FOLDED}) AS h FROM documents) WINDOW w AS (PARTITION BY h)
"""


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages")).drop("url")


ORACLES["op10_warc"] = """
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM (
  SELECT page_id, n AS payload_bytes, h AS payload_digest,
         CASE WHEN n >= 1000 AND page_id <> max(page_id) OVER (PARTITION BY n, h) THEN max(page_id) OVER (PARTITION BY n, h) END AS refers_to
  FROM (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(encode(coalesce(html, ''))) AS h FROM pages)
)
"""


@query
def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shingles", "n_shared", "containment")


_SHINGLES = """
  SELECT DISTINCT id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i
        FROM (SELECT {id} AS id, list_filter(regexp_split_to_array({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {table}) WHERE len(w) > 0)
"""
ORACLES["op7_decontamination"] = f"""
WITH d AS ({_SHINGLES.format(id='doc_id', text=FOLDED, table='documents')}), b AS ({_SHINGLES.format(id='item_id', text=FOLDED, table='benchmark')}),
n AS (SELECT id, count(*) AS n FROM b GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, n.n AS n_shingles, count(*) AS n_shared, count(*) / n.n AS containment
FROM d JOIN b USING (s) JOIN n ON n.id = b.id GROUP BY d.id, b.id, n.n HAVING count(*) >= 0.8 * n.n
"""


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), F.col("toxic").cast("int").alias("predicted"))


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_lines_removed", F.sha2("text", 256).alias("kept_sha256"))


@query
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return encode_decode(table(spark, sf_dir, "documents"), str(path("byte_bpe_50k.json")), id_lists=False)


@query
def op3_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)


@query
def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


@query
def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return alignment(table(spark, sf_dir, "documents"), str(path("byte_bpe_50k.json")), str(path("piece_bpe_32k.model")), listings=False)


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


ORACLES["op12_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 5
"""


@query
def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return token_round_trip(table(spark, sf_dir, "documents"), str(path("word_bpe_49k.json")))

"""Queries of decisions over time, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators import decisions

from .registry import query
from .stand_ins import LEDGER, ledger

LABELS = LEDGER + """, imports AS (SELECT decision_id, decided_by, b, season, CASE WHEN confidence = 'low' THEN 'manual_review_confirmed' ELSE 'name_season_unique' END AS method, sha256(coalesce(length(tier::VARCHAR) || ':' || tier::VARCHAR, '-')) AS fingerprint FROM ledger),
newest AS (SELECT b, season, arg_max(decided_by, decision_id) AS decided_by, arg_max(method, decision_id) AS method, arg_max(fingerprint, decision_id) AS fingerprint FROM imports GROUP BY ALL),
labels AS (SELECT b, season, CASE WHEN b % 7 = 0 THEN 'changed' ELSE fingerprint END AS fingerprint FROM newest WHERE b % 10 <> 9),
revoked AS (SELECT decided_by, season FROM ledger GROUP BY ALL HAVING arg_max(action, decision_id) = 'revoked'),
verdicts AS (SELECT n.b, n.season, CASE WHEN l.b IS NULL THEN 'label_not_current' WHEN l.fingerprint = n.fingerprint THEN 'removable' ELSE 'label_superseded_or_changed' END AS verdict FROM newest n JOIN revoked USING (decided_by, season) LEFT JOIN labels l ON l.b = n.b AND l.season = n.season WHERE n.method = 'manual_review_confirmed')"""


def label_ledgers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(labels, imports, decisions): every record as an import of the label of its b and season; a tenth of the labels is gone, a seventh changed."""
    x = ledger(spark, sf_dir)
    imports = x.select("decision_id", "decided_by", "b", "season", F.when(F.col("confidence") == "low", decisions.REVIEWED).otherwise("name_season_unique").alias("method"), decisions.fingerprint(["tier"]).alias("fingerprint"))
    labels = imports.groupBy("b", "season").agg(F.max_by("fingerprint", "decision_id").alias("_f")).where("b % 10 <> 9").select("b", "season", F.when(F.col("b") % 7 == 0, "changed").otherwise(F.col("_f")).alias("fingerprint"))
    return labels, imports, x.select("decision_id", "decided_by", "season", "action")


@query(f"WITH {LABELS} SELECT b, season, verdict FROM verdicts")
def label_revocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.revocations(*label_ledgers(spark, sf_dir), ["b", "season"], ["decided_by", "season"], "decision_id")


@query(f"WITH {LABELS} SELECT b, season, fingerprint FROM labels l WHERE NOT EXISTS (SELECT 1 FROM verdicts v WHERE v.verdict = 'removable' AND v.b = l.b AND v.season = l.season)")
def reconciled_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, imports, x = label_ledgers(spark, sf_dir)
    return decisions.reconciled(labels, decisions.revocations(labels, imports, x, ["b", "season"], ["decided_by", "season"], "decision_id"), ["b", "season"])


@query(f"""WITH {LEDGER}, q AS (SELECT decision_id AS question, a, season, recorded_at - 15 AS asked FROM ledger), h AS (SELECT q.*, l.decision_id, l.action, row_number() OVER (PARTITION BY question ORDER BY l.recorded_at DESC NULLS LAST, l.decision_id DESC) AS rn FROM q LEFT JOIN ledger l ON l.a = q.a AND l.season = q.season AND l.recorded_at <= q.asked)
SELECT question, a, season, decision_id, action, coalesce(action <> 'revoked', false) AS stands FROM h WHERE rn = 1""")
def decision_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = ledger(spark, sf_dir)
    asked = x.select(F.col("decision_id").alias("question"), "a", "season", F.date_sub("recorded_at", 15).alias("asked"))
    return decisions.state_at(asked, x, ["a", "season"], "asked", "recorded_at", "decision_id").drop("asked")

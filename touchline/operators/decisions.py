"""Decisions of an append-only ledger over time: what held at a date, and which imported labels a later revocation takes back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import asof

#: The action that ends a decision, and the way of matching whose labels it takes back.
REVOKED, REVIEWED = "revoked", "manual_review_confirmed"


def fingerprint(values: Sequence[str]) -> Column:
    """SHA-256 of the values as text; a missing value differs from an empty one and from a shift of its neighbours."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.concat(F.length(F.col(v).cast("string")).cast("string"), F.lit(":"), F.col(v).cast("string")), F.lit("-")) for v in values]), 256)


def state_at(questions: DataFrame, ledger: DataFrame, key: Sequence[str], at: str, recorded_at: str, record: str, action: str = "action") -> DataFrame:
    """questions with the record and action of their key's latest decision at or before `at`, and whether it stands: null and False without any. Of one day's decisions the largest record counts. One shuffle by key."""
    whole = F.struct(*key)
    out = asof(questions.withColumn("_key", whole), ledger.select(whole.alias("_key"), recorded_at, record, action), "_key", at, recorded_at, [record, action])
    return out.drop("_key").withColumn("stands", F.coalesce(F.col(action) != REVOKED, F.lit(False)))


def revocations(labels: DataFrame, imports: DataFrame, decisions: DataFrame, label_key: Sequence[str], context: Sequence[str], record: str) -> DataFrame:
    """(label_key, verdict) of the labels whose latest import, reviewed by hand, rests on a context whose latest decision is revoked.

    removable: the label is there as it was imported. label_superseded_or_changed: its fingerprint is another.
    label_not_current: it is gone. Labels without an import record are never touched. labels have a fingerprint, one row
    a key; imports a method and a fingerprint; both ledgers are in order of `record`. Null keys match nothing.
    """
    last = decisions.groupBy(*context).agg(F.max_by("action", record).alias("_action")).where(F.col("_action") == REVOKED)
    names = [c for c in context if c not in label_key]
    newest = imports.groupBy(*label_key).agg(F.max_by(F.struct(*names, "method", "fingerprint"), record).alias("_r")).select(*label_key, *[F.col(f"_r.{c}").alias(c) for c in (*names, "method", "fingerprint")])
    hit = newest.where(F.col("method") == REVIEWED).join(last, list(context)).select(*label_key, F.col("fingerprint").alias("_imported"))
    now = labels.select(*label_key, F.lit(True).alias("_there"), F.col("fingerprint").alias("_now"))
    verdict = F.when(F.col("_there").isNull(), "label_not_current").when(F.col("_now").eqNullSafe(F.col("_imported")), "removable").otherwise("label_superseded_or_changed")
    return hit.join(now, list(label_key), "left").select(*label_key, verdict.alias("verdict"))


def reconciled(labels: DataFrame, verdicts: DataFrame, label_key: Sequence[str]) -> DataFrame:
    """The labels without those that are removable."""
    return labels.join(verdicts.where(F.col("verdict") == "removable").select(*label_key), list(label_key), "left_anti")

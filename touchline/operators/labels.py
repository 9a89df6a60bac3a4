"""Governance of a ledger of judgements: what is active, what to review or test again, independence, agreement of repeats, truth labels, freshness and differences of records.

A ledger has decision_id, action, supersedes, label_type, tier, confidence, evidence, observation_window, recorded_at and decided_by.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import not_superseded

#: Label types that no model may learn from, and those that it may; sources of truth labels that it may learn from; the form of an observation window.
SELF_REFERENTIAL = ["model_derived"]
ELIGIBLE = ["human_pairwise_preference", "human_tier", "external_reference", "future_outcome"]
ELIGIBLE_SOURCES = ["transfermarkt_value", "award", "manual_calibration", "scouting_review"]
WINDOW = r"^\d{4}-\d{2}-\d{2}/\d{4}-\d{2}-\d{2}$"


def active(ledger: DataFrame) -> DataFrame:
    """Confirmed records that no other record supersedes."""
    return not_superseded(ledger, "decision_id", "supersedes").where("action = 'confirmed'")


def summary(ledger: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n): how often each value of each column occurs, in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return ledger.select(F.explode(pairs).alias("x")).groupBy("x.column", "x.value").agg(F.count("*").alias("n"))


def doubtful(ledger: DataFrame, least_evidence: int) -> DataFrame:
    """Active records of low confidence or with thin evidence, and which of both."""
    size = F.length(F.coalesce("evidence", F.lit("")))
    reasons = F.concat_ws("|", F.when(F.col("confidence") == "low", "low_confidence"), F.when(size < least_evidence, "thin_evidence"))
    return active(ledger).withColumns({"evidence_length": size, "reasons": reasons}).where("reasons <> ''")


def aged(ledger: DataFrame, days: int, now: Column) -> DataFrame:
    """Active records at least so many days old; those without a date are left out."""
    return active(ledger).withColumn("age_days", F.datediff(now, "recorded_at")).where(F.col("age_days") >= days)


def review_queue(ledger: DataFrame, least_evidence: int, days: int, now: Column, conflicts: DataFrame) -> DataFrame:
    """(decision_id, queue): every reason for which an active record is to be looked at again. conflicts: decision_id of records that contradict others."""
    one = lambda df, name: df.select("decision_id", F.lit(name).alias("queue"))
    return one(doubtful(ledger, least_evidence), "low_confidence").unionByName(one(aged(ledger, days, now), "retest")).unionByName(one(active(ledger).join(conflicts.select("decision_id"), "decision_id", "left_semi"), "conflict"))


def retest_pairs(ledger: DataFrame, tolerance: int) -> DataFrame:
    """Confirmed records that supersede a confirmed one of their type: both values, whether they agree, and the days between."""
    done = ledger.where("action = 'confirmed'")
    old = done.select(F.col("decision_id").alias("original_id"), F.col("label_type").alias("_type"), F.col("tier").alias("original_tier"), F.col("recorded_at").alias("_then"), F.col("decided_by").alias("_by"))
    new = done.where(F.col("supersedes").isNotNull()).join(old, (F.col("supersedes") == F.col("original_id")) & (F.col("label_type") == F.col("_type")))
    return new.select("original_id", F.col("decision_id").alias("retest_id"), "label_type", "original_tier", F.col("tier").alias("retest_tier"), (F.abs(F.col("tier") - F.col("original_tier")) <= tolerance).alias("consistent"), F.greatest(F.datediff("recorded_at", "_then"), F.lit(0)).alias("days_between"), (F.col("decided_by") == F.col("_by")).alias("same_annotator"))


def independence(ledger: DataFrame) -> DataFrame:
    """(decision_id, violation) of active records: learned from a model, a pair of one player, an observation window that is no pair of dates, or no evidence."""
    found = {"model_derived_in_active_set": F.col("label_type").isin(SELF_REFERENTIAL), "pairwise_self_comparison": (F.col("label_type") == "human_pairwise_preference") & F.col("a").eqNullSafe(F.col("b")), "observation_window_invalid": ~F.coalesce("observation_window", F.lit("")).rlike(WINDOW), "evidence_empty": F.trim(F.coalesce("evidence", F.lit(""))) == ""}
    flags = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in found.items()]), lambda x: x.isNotNull())
    return active(ledger).select("decision_id", F.explode(flags).alias("violation"))


def eligible(df: DataFrame, column: str, kinds: Sequence[str]) -> DataFrame:
    """Rows whose source, trimmed and in lower case, may teach a model."""
    return df.where(F.lower(F.trim(F.col(column))).isin(list(kinds)))


def merged(existing: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """existing without the keys that come in, and all that comes in, its repeats too."""
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"i.{k}")) for k in key]
    kept = existing.alias("o").join(incoming.select(*key).distinct().alias("i"), on, "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


def truth_checks(df: DataFrame, key: Sequence[str], source: str, sources: Sequence[str], confidence: str, levels: Sequence[str]) -> DataFrame:
    """(check, failures): unknown sources and confidences, and rows that repeat a key."""
    one = df.agg(F.count_if(~F.coalesce(F.col(source).isin(list(sources)), F.lit(False))).alias("unknown_source"), F.count_if(~F.coalesce(F.col(confidence).isin(list(levels)), F.lit(False))).alias("unknown_confidence"))
    twice = df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("repeated_key"))
    names = ["unknown_source", "unknown_confidence", "repeated_key"]
    return one.crossJoin(twice).select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).cast("long").alias("failures")) for n in names])).alias("x")).select("x.*")


def season_end(code: Column) -> Column:
    """May 31 of the second year of a code of two years, as 2324; null for any other text."""
    code = F.trim(code.cast("string"))
    return F.when(code.rlike("^[0-9]{4}$"), F.make_date(F.lit(2000) + F.try_to_number(F.substring(code, 3, 2), F.lit("99")).cast("int"), F.lit(5), F.lit(31)))


def temporal(df: DataFrame, source: str, season: str, as_of: str, by: Sequence[str] = ()) -> DataFrame:
    """Of the labels from sources that may teach, by group: those known by the season's end, those without a date, those of no valid season, and those dated later. The second and third may overlap."""
    end, at = season_end(F.col(season)), F.col(as_of).try_cast("timestamp")
    counts = {"temporally_eligible_rows": at <= end, "missing_or_invalid_as_of_rows": at.isNull(), "invalid_season_rows": end.isNull(), "post_season_rows": at > end}
    return eligible(df, source, ELIGIBLE_SOURCES).groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in counts.items()])


def tiers(df: DataFrame, season: str, score: str, cuts: Sequence[tuple[float, int]], rest: int) -> DataFrame:
    """Rows with a score, its average-rank percentile within the season and the tier that it reaches."""
    from .stats import percentiles

    out = percentiles(df, [season], score).withColumn("percentile", F.col("pct_average")).drop("pct_strict", "pct_mid", "pct_average", "rank_desc")
    return out.withColumn("tier", F.coalesce(*[F.when(F.col("percentile") >= least, tier) for least, tier in cuts], F.lit(rest)))


def differences(old: DataFrame, new: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(key, column, kind, before, after) of every value that was added, removed or changed between two versions of a table."""
    long = lambda df, name: df.select(*key, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")).select(*key, "x.column", F.col("x.v").alias(name), F.lit(True).alias(f"_{name}"))
    both = long(old, "before").join(long(new, "after"), [*key, "column"], "full").where(~F.col("before").eqNullSafe(F.col("after")) | F.col("_before").isNull() | F.col("_after").isNull())
    return both.select(*key, "column", F.when(F.col("_before").isNull(), "added").when(F.col("_after").isNull(), "removed").otherwise("changed").alias("kind"), "before", "after")


def freshness(df: DataFrame, by: Sequence[str], at: str, now: Column, least: Column, days: int) -> DataFrame:
    """Per source: rows, first and last date, age of the last, whether the last is not before `least`, and whether it is at most so many days old."""
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.min(F.to_date(at)).alias("first"), F.max(F.to_date(at)).alias("last"))
    return out.withColumns({"age_days": F.datediff(now, "last"), "in_range": F.col("last") >= least, "fresh": F.datediff(now, "last") <= days})

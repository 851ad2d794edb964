"""Feedback memory and review: keyed upserts, newest wins, rejected wins, anti-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

MIN_CONFIDENCE = 0.70


def newest(entries: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return entries.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def rejected_wins(decisions: DataFrame, keys: list[str], decision: str = "decision") -> DataFrame:
    """One decision for each key: rejected if any of its rows says so."""
    return decisions.groupBy(*keys).agg(F.when(F.max((F.col(decision) == "rejected").cast("int")) == 1, "rejected").otherwise("approved").alias("decision"))


def reviewed(candidates: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates without the rejected ones; the approved ones are marked."""
    kept = candidates.join(decisions.where("decision = 'rejected'"), keys, "left_anti")
    return kept.join(decisions.where("decision = 'approved'").select(*keys, F.lit(True).alias("approved")), keys, "left").withColumn("approved", F.coalesce("approved", F.lit(False)))


def usable(memory: DataFrame) -> DataFrame:
    """Entries of enough confidence, which is cut to 0..1."""
    return memory.where(F.col("learning_confidence") >= MIN_CONFIDENCE).withColumn("learning_confidence", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "learning_confidence")))


def upsert(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``current`` with the rows of the changed keys replaced; of several changes of one key, any one stays if they are equal."""
    return current.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes)


def snapshot_rows(rows: DataFrame) -> DataFrame:
    """Approved and rejected entries of rows (snapshot_id, chosen, visible: array of codes): what was shown and not chosen is rejected."""
    approved = F.array(F.struct(F.upper(F.trim("chosen")).alias("code"), F.lit("approved").alias("decision")))
    others = F.transform(F.array_except(F.array_distinct(F.transform("visible", lambda c: F.upper(F.trim(c)))), F.array(F.upper(F.trim("chosen")))), lambda c: F.struct(c.alias("code"), F.lit("rejected").alias("decision")))
    return rows.select("snapshot_id", F.explode(F.concat(approved, others)).alias("e")).select("snapshot_id", "e.code", "e.decision").where("code is not null and code != ''")


def selection_confidence(selected_via: Column, dimension_tags: Column, key_tokens: Column) -> Column:
    """How much a choice teaches, by how it was made; else by whether the line says enough."""
    # fixed values: the confidences
    via = F.trim(F.coalesce(selected_via, F.lit("")))
    telling = (F.coalesce(F.size(dimension_tags), F.lit(0)) > 0) | (F.coalesce(F.size(key_tokens), F.lit(0)) >= 2)
    return F.when(via == "manual_search", 1.0).when(via == "analog", 0.95).when(via == "manager_final_file", 0.90).when(telling, 0.85).otherwise(0.60)


def selection_source(selected_via: Column, code: Column, analog_codes: Column, search_query: Column) -> Column:
    """How a choice was made: as recorded, else from the analogs that were shown, else by a search if there was one."""
    via, key = F.trim(F.coalesce(selected_via, F.lit(""))), F.upper(F.trim(code))
    shown = F.exists(analog_codes, lambda c: F.upper(F.trim(c)) == key)
    return F.when(via != "", via).when(F.coalesce(shown, F.lit(False)), "analog").when(F.coalesce(search_query, F.lit("")) != "", "manual_search").otherwise("analog")


def learning_signal(structure: Column, profile: Column, query_ratio: Column, key_overlap: Column, root_overlap: Column, manual_ratio: Column, dimension: Column, same_query: Column, same_structure: Column, profile_size: Column, approved: Column, confidence: Column) -> Column:
    """struct(boost, allow) of an order line and a memory entry, by tiers 34, 24, 16, 10 with extras; rejected ones count against."""
    # fixed values: all numbers of this function
    first = same_query | same_structure | ((profile >= 0.90) & (profile_size >= 3))
    second = (structure >= 0.75) | (profile >= 0.75) | (query_ratio >= 86) | ((key_overlap >= 0.75) & (root_overlap >= 0.65))
    third = (structure >= 0.5) | (profile >= 0.5) | (query_ratio >= 74) | (key_overlap >= 0.55) | ((root_overlap >= 0.60) & (manual_ratio >= 45))
    fourth = (query_ratio >= 68) & ((key_overlap >= 0.35) | (root_overlap >= 0.45) | (manual_ratio >= 60) | (structure >= 0.34) | (profile >= 0.34))
    tier = F.when(first, 34.0).when(second, 24.0).when(third, 16.0).when(fourth, 10.0).otherwise(0.0)
    extras = F.when(dimension >= 0.25, 4.0).otherwise(0.0) + F.when(structure >= 0.5, 6.0).when(structure >= 0.25, 3.0).otherwise(0.0) + F.when(profile >= 0.5, 5.0).when(profile >= 0.25, 2.0).otherwise(0.0) + F.when(manual_ratio >= 72, 3.0).otherwise(0.0)
    raw = F.when(tier > 0, tier + extras).otherwise(0.0)
    boost = F.when(approved, F.least(F.lit(38.0), raw) * confidence).otherwise(F.lit(0.0) - F.least(F.lit(28.0), raw) * confidence)
    return F.struct(boost.alias("boost"), (approved & (tier >= 24)).alias("allow"))

"""Substitution policies by family: which keys must agree, how high the score must be, what words forbid a substitute."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.dimensions import values_of
from ..functions.hints import payload
from ..functions.tokens import primary_family, tag_values

POLICY = "family string, allow_exact boolean, approval_only boolean, exact_required array<string>, exact_min double, safe_required array<string>, safe_min double, analog_min double, forbid array<string>, forbid_exact array<string>"


def load(spark: SparkSession, source: str | Path | Mapping | None) -> DataFrame:
    """One row for each family of a policy file or mapping; a file of another shape gives none."""
    families = payload(source).get("families")
    texts = lambda rule, key: [str(x) for x in rule.get(key) or () if str(x)] if isinstance(rule.get(key) or [], list) else []
    rows = []
    for family, rule in (families if isinstance(families, Mapping) else {}).items():
        if isinstance(rule, Mapping) and rule:
            safe = float(rule.get("safe_min_score") or 0.0)
            rows.append(
                (family, bool(rule.get("allow_exact")), bool(rule.get("approval_only")), texts(rule, "exact_required"), float(rule.get("exact_min_score") or 0.0), texts(rule, "safe_required"), safe, float(rule.get("analog_min_score", max(40.0, safe - 12.0)) or 0.0),
                 texts(rule, "forbid_candidate_token_prefixes"), texts(rule, "forbid_exact_candidate_token_prefixes"))
            )
    return spark.createDataFrame(rows, POLICY)


def joined(pairs: DataFrame, policies: DataFrame, order_tags: str = "o_tags", stock_tags: str = "s_tags") -> DataFrame:
    """``pairs`` with a struct ``policy``, null if there is none, by the line's primary family, else the item's, and with ``policy_family``.

    A policy table has a row for each family, so it is broadcast.
    """
    family = F.coalesce(primary_family(F.col(order_tags), fixed.PRIMARY_FAMILIES), primary_family(F.col(stock_tags), fixed.PRIMARY_FAMILIES))
    packed = policies.select(F.col("family").alias("policy_family"), F.struct(*policies.columns).alias("policy"))
    return pairs.withColumn("policy_family", family).join(F.broadcast(packed), "policy_family", "left")


def meets(required: Column, order_tags: Column, stock_tags: Column, order_dims: Column, stock_dims: Column, conflicting: Column) -> Column:
    """All required keys have a common value and none conflicts; nothing required is not met."""
    family = lambda tags: F.coalesce(primary_family(tags, fixed.PRIMARY_FAMILIES), F.lit(""))
    same_family = (family(order_tags) != "") & (family(order_tags) == family(stock_tags))
    value = lambda dims, key: F.coalesce(F.try_element_at(dims, key), F.array().cast("array<string>"))
    agrees = F.forall(required, lambda k: F.when(k == "family", same_family).otherwise(F.coalesce(F.arrays_overlap(value(order_dims, k), value(stock_dims, k)), F.lit(False)) & ~F.array_contains(conflicting, k)))
    return (F.coalesce(F.size(required), F.lit(0)) > 0) & F.coalesce(agrees, F.lit(False))


def forbidden(prefixes: Column, order_tokens: Column, stock_tokens: Column) -> Column:
    """The item has a word with one of the beginnings, and the line has none with it."""
    has = lambda tokens, p: F.exists(tokens, lambda t: t.startswith(p))
    return F.coalesce(F.exists(prefixes, lambda p: (p != "") & has(stock_tokens, p) & ~has(order_tokens, p)), F.lit(False))


def exact_from(policy: Column, family: Column, pair: dict[str, Column]) -> Column:
    """The least own score (without what was learned) at which a policy makes a pair exact, null if none does.  ``pair`` has o_tags, s_tags, o_dims, s_dims, o_tokens, s_tokens, matched, conflicting, penalty and allow."""
    met = meets(policy["exact_required"], pair["o_tags"], pair["s_tags"], pair["o_dims"], pair["s_dims"], pair["conflicting"])
    stopped = forbidden(policy["forbid"], pair["o_tokens"], pair["s_tokens"]) | forbidden(policy["forbid_exact"], pair["o_tokens"], pair["s_tokens"])
    polymer = F.array_intersect(tag_values(pair["o_tags"], "mclass"), tag_values(pair["s_tags"], "mclass"))
    waived = (family == "perehod") & F.array_contains(polymer, "polypropylene") & F.array_contains(pair["matched"], "pairdn")
    return F.when(policy["allow_exact"] & ~pair["allow"] & (pair["penalty"] == 0) & met & ~stopped, F.when(waived, F.lit(float("-inf"))).otherwise(policy["exact_min"]))


def analog_from(policy: Column, pair: dict[str, Column]) -> Column:
    """The least score at which a policy makes a pair an analog, null if none does."""
    met = meets(policy["safe_required"], pair["o_tags"], pair["s_tags"], pair["o_dims"], pair["s_dims"], pair["conflicting"])
    return F.when(met & ~forbidden(policy["forbid"], pair["o_tokens"], pair["s_tokens"]), policy["analog_min"])


def reaches(score: Column, least: Column) -> Column:
    return F.coalesce(score >= least, F.lit(False))


def exact_by_policy(policy: Column, family: Column, pair: dict[str, Column]) -> Column:
    """Whether a policy makes a pair exact.  ``pair`` has score and boost besides what ``exact_from`` takes."""
    return reaches(F.greatest(F.lit(0.0), pair["score"] - pair["boost"]), exact_from(policy, family, pair))


def analog_by_policy(policy: Column, pair: dict[str, Column]) -> Column:
    return reaches(pair["score"], analog_from(policy, pair))


def reason(family: Column, exact: bool) -> Column:
    table = fixed.EXACT_REASONS if exact else fixed.ANALOG_REASONS
    words = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(words, F.coalesce(family, F.lit(""))), F.lit(table[""]))


def sizes_share(order_dims: Column, stock_dims: Column) -> Column:
    """Nominal and outer diameters that both sides have."""
    union = lambda d: F.array_union(values_of(d, "dn"), values_of(d, "od"))
    return F.array_intersect(union(order_dims), union(stock_dims))

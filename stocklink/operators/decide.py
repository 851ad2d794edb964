"""Scores, ranks and the decision between exact match, analog and no match, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.fixed import DIMENSION_WEIGHTS
from . import compat


def dimension_scores(order_dims: Column, stock_dims: Column) -> Column:
    """struct(bonus, penalty, matched, conflicting) over the scored keys that both sides have; lengths within 10 cost a quarter."""
    weights = F.create_map(*[x for key, (b, p) in DIMENSION_WEIGHTS.items() for x in (F.lit(key), F.struct(F.lit(b).alias("b"), F.lit(p).alias("p")))])
    keys = F.filter(F.map_keys(order_dims), lambda k: k.isin(*DIMENSION_WEIGHTS) & (F.size(F.coalesce(F.try_element_at(stock_dims, k), F.array().cast("array<string>"))) > 0))
    numbers = lambda d, k: F.transform(F.try_element_at(d, k), lambda v: v.try_cast("double"))

    def judged(key: Column) -> Column:
        meets = F.arrays_overlap(F.try_element_at(order_dims, key), F.try_element_at(stock_dims, key))
        gap = F.array_min(F.flatten(F.transform(numbers(order_dims, key), lambda a: F.transform(numbers(stock_dims, key), lambda b: F.abs(a - b)))))
        near = (key == "lmm") & F.coalesce(gap <= 10, F.lit(False))
        weight = F.element_at(weights, key)
        return F.struct(key.alias("key"), meets.alias("meets"), near.alias("near"), weight["b"].alias("b"), weight["p"].alias("p"))

    each = F.transform(keys, judged)
    total = lambda value: F.aggregate(F.transform(each, value), F.lit(0.0), lambda a, x: a + x)
    return F.struct(
        total(lambda x: F.when(x["meets"], x["b"]).otherwise(0.0)).alias("bonus"), total(lambda x: F.when(x["meets"], 0.0).when(x["near"], x["p"] * 0.25).otherwise(x["p"])).alias("penalty"),
        F.transform(F.filter(each, lambda x: x["meets"]), lambda x: x["key"]).alias("matched"), F.transform(F.filter(each, lambda x: ~x["meets"] & ~x["near"]), lambda x: x["key"]).alias("conflicting"),
    )


def total_score(set_ratio: Column, ordered: Column, overlap: Column, root_overlap: Column, code_hit: Column, bonus: Column, penalty: Column, missing_share: Column, extra: Column, learning: Column) -> Column:
    """Weighted sum of the evidence, raised to a floor by strong learning, between 0 and 100."""
    # fixed values: the weights and floors
    base = set_ratio * 0.45 + ordered * 0.15 + overlap * 20.0 + root_overlap * 18.0 + F.when(code_hit, 18.0).otherwise(0.0) + bonus - penalty + extra - missing_share * 12.0 + learning
    floor = F.when(learning >= 34, 72.0).when(learning >= 24, 64.0).when(learning >= 16, 56.0).otherwise(0.0)
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.when(learning > 0, F.greatest(base, floor)).otherwise(base)))


def dice_score(hits: Column, left: Column, right: Column) -> Column:
    return F.when(left + right > 0, hits * 200.0 / (left + right)).otherwise(0.0)


#: Order of candidates of a line, best first, by column name; missing columns don't take part.
RANK = ("score", "approved", "size_pair_hit", "-penalty", "n_matched", "-n_conflicting", "code_hit", "in_stock", "remaining", "-stock_id")


def _best_first(columns: list[str]) -> list[Column]:
    return [F.col(k.lstrip("-")).asc() if k[0] == "-" else F.col(k).desc() for k in RANK if k.lstrip("-") in columns]


def ranked(candidates: DataFrame, limit: int, line: str = "line") -> DataFrame:
    """The best candidates of each line with rank and gap (best score less the second, or the best score alone)."""
    order = W.partitionBy(line).orderBy(*_best_first(candidates.columns))
    gap = F.col("score") - F.coalesce(F.lead("score").over(order), F.lit(0.0))
    return candidates.withColumn("rank", F.row_number().over(order)).withColumn("gap", gap).where(F.col("rank") <= limit)


def first_ids(items: DataFrame, keys: list[str], most: int) -> DataFrame:
    """``keys`` and ids: the ``most`` smallest ids of the rows that agree in ``keys``, in order."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy("id"))
    return items.withColumn("place", place).where(F.col("place") <= most).groupBy(*keys).agg(F.array_sort(F.collect_list("id")).alias("ids"))


def merged_ids(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """``first_ids`` of rows that have such ids; the smallest of all are in the ``most`` rows that begin with the smallest."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("ids")[0]))
    few = rows.select(*keys, "ids").withColumn("place", place).where(F.col("place") <= most)
    return few.groupBy(*keys).agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, most).alias("ids"))


def ranked_by_ids(found: DataFrame, lines: DataFrame, limit: int, within: list[str] | None = None) -> DataFrame:
    """``ranked`` for classes of lines (line, the first ``limit`` + 2 ids of items that score the same, and what they score), by the lines' members (class, id).

    Rows of which ``limit`` + 2 others begin with a better item have none among
    a line's first.  ``within`` names columns that a class of lines has one value of.
    """
    keys = ["line", *(within or [])]
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*_best_first([*found.columns, "stock_id"])))
    few = found.withColumn("stock_id", F.col("ids")[0]).withColumn("place", place).where(F.col("place") <= limit + 2).drop("place", "stock_id", *keys[1:])
    each = few.select(*[c for c in few.columns if c != "ids"], F.explode("ids").alias("stock_id"))
    best = ranked(each, limit + 2).drop("rank", "gap")
    each = best.join(lines.select(F.col("class").alias("line"), "id"), "line").where(F.col("id") != F.col("stock_id"))
    return ranked(each.drop("line").withColumnRenamed("id", "line"), limit)


def ranked_by_class(pairs: DataFrame, lines: DataFrame, items: DataFrame, limit: int) -> DataFrame:
    """``ranked`` for pairs of classes (line, stock_id and what they score), by their members (class, id); an item is no candidate of its own.

    All of a class score the same, so only its ``limit`` + 2 smallest ids can be
    among a line's first ``limit``, the one behind them, and the line itself.
    """
    few = first_ids(items, ["class"], limit + 2).withColumnRenamed("class", "stock_id")
    return ranked_by_ids(pairs.join(few, "stock_id").drop("stock_id"), lines, limit)


def decision(score: Column, gap: Column, overlap: Column, root_overlap: Column, bonus: Column, penalty: Column, code_hit: Column, learned: Column, boost: Column, generic: Column, exact_pipe: Column, triple: Column, policy_exact: Column, policy_analog: Column) -> Column:
    """struct(kind, rule): the first rule that holds decides; rule 17 is no match."""
    # fixed values: all numbers of this function
    own = F.greatest(F.lit(0.0), score - boost)
    clear = penalty == 0
    rules = [
        (1, "exact", ~learned & code_hit & clear & (own >= 78) & (overlap >= 0.30)),
        (2, "exact", policy_exact),
        (3, "exact", ~learned & exact_pipe & (own >= 84)),
        (4, "exact", ~learned & generic & (own >= 90) & (overlap >= 0.55) & clear & (gap >= 4)),
        (5, "exact", ~learned & generic & triple & clear & (own >= 60) & (gap >= 5)),
        (6, "exact", ~learned & generic & (own >= 82) & (overlap >= 0.65) & (bonus >= 10) & (gap >= 5)),
        (7, "analog", policy_analog),
        (8, "analog", score >= 72),
        (9, "analog", (score >= 60) & (overlap >= 0.55) & clear),
        (10, "analog", clear & (bonus >= 30) & (score >= 58)),
        (11, "analog", clear & (bonus >= 18) & (score >= 50) & (overlap >= 0.45)),
        (12, "analog", (bonus >= 18) & (score >= 52) & ((overlap >= 0.35) | (root_overlap >= 0.45))),
        (13, "analog", clear & (bonus >= 18) & (score >= 55) & ((overlap >= 0.15) | (root_overlap >= 0.30))),
        (14, "analog", (bonus >= 10) & (score >= 58) & ((overlap >= 0.20) | (root_overlap >= 0.35))),
        (15, "analog", code_hit & (score >= 58)),
        (16, "analog", clear & (bonus >= 16) & (score >= 42) & (overlap >= 0.20)),
    ]
    chain = None
    for number, kind, holds in rules:
        value = F.struct(F.lit(kind).alias("kind"), F.lit(number).alias("rule"))
        chain = F.when(holds, value) if chain is None else chain.when(holds, value)
    return chain.otherwise(F.struct(F.lit("not_found").alias("kind"), F.lit(17).alias("rule")))


def analog_is_safe(score: Column, gap: Column, overlap: Column, root_overlap: Column, bonus: Column, penalty: Column, code_hit: Column, boost: Column, approved: Column, approval_only: Column, required_match: Column, safe_min: Column, forbidden: Column, review_match: Column | None = None) -> Column:
    """Whether an analog needs no approval; ``review_match`` (the policy's keys agree, or it names none) is what a reviewed one must meet."""
    # fixed values: all numbers of this function
    review_match = required_match if review_match is None else review_match
    own, clear = F.greatest(F.lit(0.0), score - boost), penalty == 0
    reviewed = approved & clear & (bonus >= 10) & review_match
    by_policy = required_match & clear & (own >= safe_min) & (gap >= 3) & ~forbidden & ((overlap >= 0.25) | (root_overlap >= 0.35) | code_hit | (bonus >= 18))
    by_rule = clear & (bonus >= 18) & (own >= 58) & (gap >= 3) & ((overlap >= 0.35) | (root_overlap >= 0.45) | code_hit)
    sure = clear & (own >= 72) & (gap >= 4) & (overlap >= 0.5)
    return ~approval_only & (reviewed | by_policy | by_rule | sure)


def compatible_candidates(candidates: DataFrame) -> DataFrame:
    """Pairs (order_tags, stock_tags, order_dims, stock_dims, allowed) that are compatible or allowed by what was learned."""
    return candidates.where(compat.compatible(F.col("order_tags"), F.col("stock_tags"), F.col("order_dims"), F.col("stock_dims")) | F.col("allowed"))

"""Category classification: aliases and weighted tokens by joins, fuzzy scores on the survivors, a status by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import category_text, fuzzy


def categories(spark: SparkSession, config: list[dict]) -> DataFrame:
    """A row for each category; the table is as long as the configuration."""
    rows = [(c["key"], c.get("route", "stock_match"), list(c.get("aliases", ())), dict(c.get("strong_tokens", {})), dict(c.get("context_tokens", {})), list(c.get("blocker_tokens", ())), list(c.get("required_attributes", ()))) for c in config]
    return spark.createDataFrame(rows, "category string, route string, aliases array<string>, strong map<string,double>, context map<string,double>, blockers array<string>, required array<string>")


def _any_of(attributes: Column, *names: str) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | (F.size(F.coalesce(F.try_element_at(attributes, F.lit(n)), F.array().cast("array<string>"))) > 0)
    return out


def _fulfilled(required: Column, attributes: Column, tokens: Column, numbers: Column) -> Column:
    """Whether one named requirement is met."""
    own = F.size(F.coalesce(F.try_element_at(attributes, required), F.array().cast("array<string>"))) > 0
    target = F.arrays_overlap(tokens, F.array(*map(F.lit, ("zatvor", "zatvora", "kran", "krana", "privod"))))
    return (
        F.when(required == "dn_or_inch", _any_of(attributes, "dn", "inch")).when(required == "dn_or_length", _any_of(attributes, "dn", "length")).when(required == "dn_or_od", _any_of(attributes, "dn", "od"))
        .when(required == "size_or_dn", _any_of(attributes, "dn", "od") | (F.size(numbers) > 0)).when(required == "angle_or_dn", _any_of(attributes, "angle", "dn", "od")).when(required == "target_product", target).otherwise(own)
    )


def specificity(tokens: Column, attributes: Column) -> Column:
    """How much a query says: words of three letters and more, and values of attributes."""
    # fixed values: the weights
    told = F.size(F.filter(tokens, lambda t: (F.length(t) >= 3) & ~t.rlike("^[0-9]+$")))
    return F.least(F.lit(10.0), told * 1.2 + F.size(F.flatten(F.map_values(attributes))) * 1.5)


def retrieved(queries: DataFrame, cats: DataFrame, most: int = 8, least: float = 56.0) -> DataFrame:
    """query_id, category of the categories that share a word, material or connection with a query, or one of its ``most`` nearest aliases at ``least`` and more; with none, of all.

    Categories and aliases are as many as the configuration says, and are broadcast.
    """
    words = cats.select("category", F.explode(F.array_union(F.map_keys("strong"), F.array_union(F.map_keys("context"), F.flatten(F.transform("aliases", lambda a: F.split(a, " ")))))).alias("key")).distinct()
    named = F.flatten(F.array(*[F.coalesce(F.try_element_at("attributes", F.lit(k)), F.array().cast("array<string>")) for k in ("material", "connection")]))
    by_word = queries.select("query_id", F.explode(F.array_distinct(F.concat("tokens", named))).alias("key")).join(F.broadcast(words), "key").select("query_id", "category")
    aliases = cats.select("category", F.explode("aliases").alias("alias")).distinct()
    near = queries.select("text").distinct().join(F.broadcast(aliases.select("alias").distinct())).withColumn("near", fuzzy.column_score("weighted_ratio", F.col("text"), F.col("alias"))).where(F.col("near") >= least)
    top = near.withColumn("n", F.row_number().over(W.partitionBy("text").orderBy(F.col("near").desc(), "alias"))).where(F.col("n") <= most)
    by_alias = queries.select("query_id", "text").join(top, "text").join(F.broadcast(aliases), "alias").select("query_id", "category")
    met = by_word.unionByName(by_alias).distinct()
    lost = queries.join(met.select("query_id").distinct(), "query_id", "left_anti").select("query_id").join(F.broadcast(cats.select("category")))
    return met.unionByName(lost)


def scored(queries: DataFrame, cats: DataFrame) -> DataFrame:
    """Scores of the retrieved categories of queries (query_id, text, tokens, attributes, numbers)."""
    pairs = retrieved(queries, cats).join(queries, "query_id").join(F.broadcast(cats), "category")
    alias = pairs.select("query_id", "category", "text", F.explode_outer("aliases").alias("alias")).select("text", "alias").distinct()
    score = lambda name: fuzzy.column_score(name, F.col("text"), F.col("alias"))
    fuzz = alias.select("text", "alias", fuzzy.combined(score("token_set_ratio"), score("token_sort_ratio"), score("partial_ratio"), score("weighted_ratio"), score("ratio")).alias("fuzz"))
    best = pairs.select("query_id", "category", "text", F.explode_outer("aliases").alias("alias")).join(fuzz, ["text", "alias"], "left").groupBy("query_id", "category").agg(F.coalesce(F.max("fuzz"), F.lit(0.0)).alias("fuzz"))
    full = pairs.join(best, ["query_id", "category"])
    weights = lambda column: F.aggregate(F.transform(F.array_distinct("tokens"), lambda t: F.coalesce(F.try_element_at(F.col(column), t), F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    hits = F.size(F.array_intersect("tokens", F.map_keys("strong"))) + F.size(F.array_intersect("tokens", F.map_keys("context")))
    blocked = F.size(F.array_intersect("tokens", "blockers"))
    missing = F.filter("required", lambda r: ~_fulfilled(r, F.col("attributes"), F.col("tokens"), F.col("numbers")))
    spec = specificity(F.col("tokens"), F.col("attributes"))
    penalty = (
        F.least(F.lit(35.0), blocked * 12.0) + F.when((F.col("route") == "manual_review") & (F.size(F.array_intersect("tokens", F.map_keys("strong"))) == 0) & (F.col("fuzz") < 70), 14.0).otherwise(0.0)
        + F.when((hits <= 1) & (spec < 3.5), 12.0).otherwise(0.0) + F.when((F.size("tokens") <= 2) & (F.size("numbers") == 0) & ~_any_of(F.col("attributes"), "dn"), 6.0).otherwise(0.0)
    )
    attribute = (F.size("required") - F.size(missing)) * 8.0
    total = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("fuzz") * 0.55 + weights("strong") + weights("context") + attribute - penalty))
    return full.select("query_id", "category", "route", missing.alias("missing"), spec.alias("specificity"), attribute.alias("attribute"), (weights("strong") + weights("context")).alias("weighted"), total.alias("total"))


def classified(scores: DataFrame) -> DataFrame:
    """query_id, category, route, status and confidence of the best category."""
    order = W.partitionBy("query_id").orderBy(F.col("total").desc(), F.size("missing"), F.col("attribute").desc(), F.col("weighted").desc(), "category")
    second = F.lead("total").over(order)
    best = scores.withColumn("second", second).withColumn("gap", F.col("total") - F.coalesce(second, F.lit(0.0))).withColumn("n", F.row_number().over(order)).where("n = 1")
    lacking = (F.size("missing") > 0) & ((F.col("total") < 82) | (F.col("specificity") < 6))
    status = (
        F.when(F.col("total") < 42, "unclassified").when(F.col("second").isNotNull() & (F.col("total") < 72) & (F.col("gap") < 6), "ambiguous").when(F.col("route") == "manual_review", "needs_review")
        .when(lacking, "needs_review").when(F.col("total") < 60, "needs_review").otherwise("classified")
    )
    staged = best.withColumn("status", status)
    confidence = F.col("total") / 100 + F.least(F.lit(0.18), F.greatest(F.lit(0.0), "gap") / 40) + F.least(F.lit(0.12), F.col("specificity") / 100) - F.least(F.lit(0.18), F.size("missing") * 0.06) - F.when(F.col("status") == "ambiguous", 0.12).otherwise(0.0)
    known = F.col("status") != "unclassified"
    return staged.select("query_id", F.when(known, F.col("category")).alias("category"), F.when(known, F.col("route")).otherwise("stock_match").alias("route"), "status", F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence)).alias("confidence"), "total", "gap")


def read_queries(queries: DataFrame, raw: str, registry: category_text.Registry) -> DataFrame:
    """query_id and what the classifier reads in the column ``raw``."""
    return queries.select("query_id", category_text.read_query(F.col(raw), registry).alias("q")).select("query_id", "q.*")


# When and how meaning moves a score.
SEMANTIC = {"max_candidates": 4, "min_query_chars": 7, "min_specificity": 3.5, "min_base_score": 34.0, "confident_score": 82.0, "gap_threshold": 8.0, "semantic_threshold": 0.34, "semantic_weight": 12.0}


def category_text_of(cats: DataFrame) -> DataFrame:
    """category and the text that its embedding is made of."""
    return cats.select("category", F.array_join(F.array_distinct(F.concat("aliases", F.map_keys("strong"), F.map_keys("context"))), " ; ").alias("text"))


def reranked(scores: DataFrame, queries: DataFrame, query_vectors: DataFrame, category_vectors: DataFrame, settings: dict | None = None) -> DataFrame:
    """Scores with a boost of the head's categories by cosine similarity, for queries that aren't clear yet.

    Vectors (query_id or category, v: unit length) come from whatever model the
    caller has; queries without one keep their scores.  Category vectors are a
    row for each category, and are broadcast.
    """
    s = SEMANTIC | (settings or {})
    order = W.partitionBy("query_id").orderBy(F.col("total").desc(), F.size("missing"), F.col("attribute").desc(), F.col("weighted").desc(), "category")
    placed = scores.withColumn("place", F.row_number().over(order)).withColumn("gap", F.col("total") - F.coalesce(F.lead("total").over(order), F.lit(0.0)))
    best = placed.where("place = 1").select("query_id", F.col("total").alias("best"), "gap", F.col("specificity").alias("spec"))
    long_enough = queries.where(F.length("text") >= s["min_query_chars"]).select("query_id")
    unclear = best.where((F.col("spec") >= s["min_specificity"]) & (F.col("best") >= s["min_base_score"]) & ~((F.col("best") >= s["confident_score"]) & (F.col("gap") >= s["gap_threshold"]))).join(long_enough, "query_id").select("query_id")
    dot = F.aggregate(F.zip_with("qv", "cv", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    head = placed.where(F.col("place") <= s["max_candidates"]).join(unclear, "query_id").join(query_vectors.withColumnRenamed("v", "qv"), "query_id").join(F.broadcast(category_vectors.withColumnRenamed("v", "cv")), "category")
    cosine = F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot))
    boost = F.when(cosine > s["semantic_threshold"], (cosine - s["semantic_threshold"]) / (1 - s["semantic_threshold"]) * s["semantic_weight"]).otherwise(0.0)
    moved = head.select("query_id", "category", F.round(cosine * 100, 2).alias("semantic"), boost.alias("boost"))
    return scores.join(moved, ["query_id", "category"], "left").withColumns({"semantic": F.coalesce("semantic", F.lit(0.0)), "total": F.least(F.lit(100.0), F.col("total") + F.coalesce("boost", F.lit(0.0)))}).drop("boost")

"""What managers chose before: loading of the memory, its decisions by key, and the signals it gives to new lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import fixed, fuzzy, tokens
from ..functions.dimensions import expanded, none, profile, profile_tags, structure_keys
from ..functions.features import features, search_text
from ..functions.hints import Rules
from ..session import stored
from .feedback import learning_signal, newest, rejected_wins, usable

ENTRY = (
    "record_id string, query string, query_key string, order_key_tokens array<string>, order_root_tokens array<string>, order_dimension_tags array<string>, structure_keys array<string>, structure_profile map<string,array<string>>, "
    "manual_search_query string, manual_search_query_key string, candidate_code string, decision string, selected_via string, learning_confidence double, updated_at string"
)


def read_memory(spark: SparkSession, *paths: str) -> DataFrame:
    """Entries of the first of the paths that has any: a Parquet folder, or JSON documents with ``entries``."""
    for path in paths:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
            continue
        if path.endswith(".json"):
            entries = spark.read.schema(f"entries array<struct<{', '.join(c.replace(' ', ':', 1) for c in ENTRY.split(', '))}>>").option("multiLine", True).json(path).select(F.explode("entries").alias("e")).select("e.*")
        else:
            stored = spark.read.parquet(path)
            entries = stored.select(*[(F.col(n) if n in stored.columns else F.lit(None)).cast(t).alias(n) for n, t in (c.split(" ", 1) for c in ENTRY.split(", "))])
        if not entries.isEmpty():
            return entries
    return spark.createDataFrame([], ENTRY)


def complete(entries: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Usable entries with what they lack derived from their query; entries without query key or code go, and those of little confidence."""
    clean = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    distinct = lambda c: F.filter(F.array_distinct(F.transform(F.coalesce(F.col(c), none()), F.trim)), lambda x: x != "")
    or_else = lambda c, other: F.when(F.size(distinct(c)) > 0, distinct(c)).otherwise(other)
    query, via = clean("query"), clean("manual_search_query")
    keyed = entries.withColumns({"query": query, "query_key": F.coalesce(F.nullif(clean("query_key"), F.lit("")), search_text(query, rules), F.lit("")), "candidate_code": F.upper(clean("candidate_code")), "manual_search_query": via, "manual_search_query_key": F.coalesce(F.nullif(clean("manual_search_query_key"), F.lit("")), search_text(via, rules), F.lit(""))})
    known = keyed.where("query_key != '' and candidate_code != ''").withColumn("f", features([F.coalesce(F.nullif("query", F.lit("")), "query_key")], rules))
    read = tokens.tokens(F.col("query_key"))
    filled = known.withColumns(
        {
            "order_key_tokens": or_else("order_key_tokens", F.array_sort(tokens.key_tokens(read))), "order_root_tokens": or_else("order_root_tokens", F.array_sort(tokens.root_tokens(read))), "order_dimension_tags": or_else("order_dimension_tags", F.col("f.tags")),
            "decision": F.coalesce(F.nullif(F.lower(clean("decision")), F.lit("")), F.lit("approved")), "learning_confidence": F.coalesce("learning_confidence", F.lit(1.0)), "record_id": F.coalesce(F.nullif(clean("record_id"), F.lit("")), F.concat_ws(":", "candidate_code", "query_key")),
        }
    ).drop("f")
    # stored, since what follows reads the tags many times
    filled = stored(filled, "memory-lines").withColumn("_dims", expanded(tokens.tags_by_key(F.col("order_dimension_tags"))))
    dims = F.col("_dims")
    own = F.map_filter(F.col("structure_profile"), lambda k, v: k.isin(*fixed.PROFILE_KEYS) & (F.size(v) > 0))
    packed = filled.withColumns({"structure_keys": or_else("structure_keys", structure_keys(dims, F.col("order_dimension_tags"), F.col("order_key_tokens"), F.col("query_key"))), "structure_profile": F.when(F.size(own) > 0, own).otherwise(profile(dims, F.col("order_dimension_tags")))})
    return usable(packed.drop("_dims"))


def decisions(entries: DataFrame) -> DataFrame:
    """key, code and decision: for each query or structure key and code the newest entry's decision."""
    keys = F.array_distinct(F.concat(F.array("query_key"), "structure_keys"))
    exploded = entries.select(F.explode(keys).alias("key"), F.col("candidate_code").alias("code"), "decision", "updated_at", "record_id").where("key != ''")
    return newest(exploded, ["key", "code"], [F.col("updated_at").desc_nulls_last(), F.col("record_id").desc()]).select("key", "code", "decision")


def review_keys(lines: DataFrame, parts: list[str], rules: Rules | None = None) -> DataFrame:
    """line, key: the distinct search texts of a line's parts, its own text and its structure keys (columns id, text, structure)."""
    texts = F.array_distinct(F.filter(F.array(*[search_text(F.col(p).cast("string"), rules) for p in parts], F.col("text")), lambda k: F.coalesce(k, F.lit("")) != ""))
    return lines.select(F.col("id").alias("line"), F.explode(F.array_union(texts, "structure")).alias("key")).distinct()


def reviewed_pairs(keys: DataFrame, reviewed: DataFrame, learned: DataFrame, stock: DataFrame) -> DataFrame:
    """line, stock_id and decision.  For a key a reviewed decision shadows a learned one; any rejection among a line's keys wins.  ``stock`` has id and code."""
    both = learned.join(reviewed.select("key", "code"), ["key", "code"], "left_anti").unionByName(reviewed)
    coded = stock.select(F.col("id").alias("stock_id"), F.upper(F.trim("code")).alias("code"))
    return rejected_wins(keys.join(both, "key").join(coded, "code"), ["line", "stock_id"])


def _meeting(orders: DataFrame, entries: DataFrame) -> DataFrame:
    """line, record_id of orders and entries that share a word, root, tag, structure key or query key.  A pair that shares none gives no signal."""

    def keys(df: DataFrame, name: str, columns: dict[str, Column]) -> DataFrame:
        marked = [F.transform(c, lambda k, p=p: F.concat(F.lit(p), k)) for p, c in columns.items()]
        return df.select(name, F.explode(F.array_distinct(F.flatten(F.array(*marked)))).alias("key"))

    a = keys(orders, "line", {"k:": F.col("keys"), "r:": F.col("roots"), "t:": F.col("profile_tags"), "s:": F.col("structure"), "q:": F.col("query_keys")})
    b = keys(entries, "record_id", {"k:": F.col("order_key_tokens"), "r:": F.col("order_root_tokens"), "t:": profile_tags(F.col("structure_profile")), "s:": F.col("structure_keys"), "q:": F.array("query_key")})
    return a.join(b, "key").select("line", "record_id").distinct()


def signals(orders: DataFrame, entries: DataFrame, stock: DataFrame) -> DataFrame:
    """line, id, boost and allow for the items (id, code) that the memory speaks for or against.

    ``orders`` has line, text, keys, roots, tags, structure, profile_tags and
    query_keys.  The strongest approval of an item counts; a rejection counts
    only for items without any approval.
    """
    pairs = _meeting(orders, entries).join(orders, "line").join(entries, "record_id")
    texts = pairs.select("text", F.col("query_key").alias("other")).union(pairs.where("manual_search_query_key != ''").select("text", "manual_search_query_key")).distinct()
    sorted_words = lambda c: F.array_join(F.array_sort(F.array_distinct(F.split(c, " "))), " ")
    ratio = texts.select("text", "other", fuzzy.column_score("token_set_ratio", sorted_words(F.col("text")), sorted_words(F.col("other"))).alias("ratio"))
    by_query = ratio.select("text", F.col("other").alias("query_key"), F.col("ratio").alias("query_ratio"))
    by_manual = ratio.select("text", F.col("other").alias("manual_search_query_key"), F.col("ratio").alias("manual_ratio"))
    compared = pairs.join(by_query, ["text", "query_key"]).join(by_manual, ["text", "manual_search_query_key"], "left").fillna({"manual_ratio": 0.0})
    share = lambda a, b: tokens.overlap(F.col(a), F.col(b))
    measured = compared.select(
        "line", "record_id", "candidate_code", "decision", "learning_confidence", share("structure", "structure_keys").alias("structure"), tokens.overlap(F.col("profile_tags"), profile_tags(F.col("structure_profile"))).alias("profile"), "query_ratio", "manual_ratio",
        share("keys", "order_key_tokens").alias("key"), share("roots", "order_root_tokens").alias("root"), share("tags", "order_dimension_tags").alias("dimension"), F.array_contains("query_keys", F.col("query_key")).alias("same_query"),
        F.arrays_overlap("structure", "structure_keys").alias("same_structure"), F.size("profile_tags").alias("n_profile"),
    )
    # stored: the tiers name each measure many times
    measured = stored(measured, "memory-measures")
    c = F.col
    signal = learning_signal(c("structure"), c("profile"), c("query_ratio"), c("key"), c("root"), c("manual_ratio"), c("dimension"), c("same_query"), c("same_structure"), c("n_profile"), c("decision") != "rejected", c("learning_confidence"))
    coded = stock.select("id", F.upper(F.trim("code")).alias("candidate_code"))
    each = measured.select("line", "record_id", "candidate_code", "decision", signal.alias("s")).where("s.boost != 0").join(coded, "candidate_code")
    for_it = each.where("decision != 'rejected'").groupBy("line", "id").agg(F.max_by("s", F.struct("s.boost", "record_id")).alias("s"))
    order = W.partitionBy("line", "id").orderBy(F.col("record_id").desc())
    against = each.where("decision = 'rejected'").join(for_it.select("line", "id"), ["line", "id"], "left_anti").withColumn("n", F.row_number().over(order)).where("n = 1").select("line", "id", "s")
    return for_it.unionByName(against).select("line", "id", "s.boost", "s.allow")

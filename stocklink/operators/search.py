"""Search of the stock for one line: who is looked at, how query and line are blended, and which results are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import manual_code
from ..session import stored
from . import retrieval

# How many rare tokens, fragment hits and candidates a search takes, and what a result must show.
QUERY_TOKENS, FRAGMENTS, POOL, RESULTS = 8, 320, 1200, 12
#: Characters of a query that must be found before it is looked for whole.
GRAM = 4
MIN_SCORE, MIN_OVERLAP, MIN_ROOTS, MIN_DIMENSIONS, MIN_CONTEXT, MIN_CONTEXT_DIMENSIONS = 28.0, 0.12, 0.18, 6.0, 44.0, 6.0


def searchable(query: Column) -> Column:
    """Two characters at least."""
    return F.length(F.trim(query)) >= 2


def by_code(searches: DataFrame, stock: DataFrame) -> DataFrame:
    """search, id of items whose code, letters and digits only, is the query's."""
    asked = searches.select("search", manual_code(F.col("query")).alias("code_key")).where("code_key != ''")
    return asked.join(stock.select("id", manual_code(F.col("code")).alias("code_key")), "code_key").select("search", "id")


def by_token(searches: DataFrame, stock: DataFrame, most: int = QUERY_TOKENS) -> DataFrame:
    """search, id of items that have one of the query's rarest tokens (column tokens on both sides)."""
    posted = stock.select("id", F.explode("tokens").alias("key"))
    asked = searches.select(F.col("search").alias("line"), F.explode("tokens").alias("key"))
    rare = retrieval.rarest(asked, posted.groupBy("key").agg(F.count("*").alias("df")), most)
    return rare.join(posted, "key").select(F.col("line").alias("search"), "id").distinct()


def _holding(texts: DataFrame, values: DataFrame) -> DataFrame:
    """text, value of the distinct ``values`` that hold one of the ``texts``; only those that have a text's first ``GRAM`` characters are searched."""
    begins = texts.withColumn("gram", F.substring("text", 1, GRAM))
    lengths = begins.agg(F.collect_set(F.length("gram")).alias("lengths"))
    cut = lambda n: F.when(F.length("value") >= n, F.transform(F.sequence(F.lit(1), F.length("value") - n + 1), lambda i: F.col("value").substr(i, n))).otherwise(F.array().cast("array<string>"))
    grams = values.crossJoin(F.broadcast(lengths)).select("value", F.explode(F.array_distinct(F.flatten(F.transform("lengths", cut)))).alias("gram"))
    return grams.join(begins, "gram").where(F.col("value").contains(F.col("text"))).select("text", "value")


def by_fragment(searches: DataFrame, stock: DataFrame, most: int = FRAGMENTS) -> DataFrame:
    """search, id of the first items, in stock order, whose code or name holds the query.

    The limit is the search's own.  Equal queries are looked up once, and so
    are equal names and codes.
    """
    text = F.lower(F.trim("query"))
    asked = searches.select("search", text.alias("text"), manual_code(F.col("query")).alias("code_key")).where((F.length("text") >= 4) | (F.col("code_key") != "")).where("text != ''")
    needles = asked.select("text", "code_key").distinct()
    items = stock.groupBy("id", "code", "name").agg(F.count("*").alias("copies"))
    texts = needles.select("text").distinct()

    def first(found: DataFrame, key: str) -> DataFrame:
        place = F.row_number().over(W.partitionBy(key).orderBy("id"))
        few = found.select(key, "id", "code", "name", "copies").withColumn("place", place).where(F.col("place") <= most).drop("place")
        return needles.join(few, key).select("text", "code_key", "id", "code", "name", "copies")

    def held(column: str) -> DataFrame:
        values = items.select(F.lower(column).alias("value")).distinct()
        return first(items.join(_holding(texts, values), F.lower(column) == F.col("value")), "text")

    keyed = items.join(needles.select("code_key").where("code_key != ''").distinct(), manual_code(F.col("code")) == F.col("code_key"))
    found = held("code").unionByName(held("name")).unionByName(first(keyed, "code_key")).distinct()
    each = asked.join(found, ["text", "code_key"]).select("search", "id", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return each.withColumn("n", F.row_number().over(W.partitionBy("search").orderBy("id"))).where(F.col("n") <= most).select("search", "id")


#: Sources whose candidates come first.
FIRST = ("manual_exact_code", "manual_fragment", "memory", "code", "family", "structure")


def _worth() -> list[Column]:
    """The order of a pool's candidates."""
    has = lambda s: F.array_contains("sources", s).cast("int").desc()
    return [*[has(s) for s in FIRST], F.size("sources").desc(), (F.col("remaining") > 0).cast("int").desc(), F.col("remaining").desc(), F.col("id")]


def _listed() -> Column:
    """A candidate as a struct whose falling order is that of ``_worth``."""
    has = [F.array_contains("sources", s).alias(f"first{i}") for i, s in enumerate(FIRST)]
    return F.struct(*has, F.size("sources").alias("n"), (F.col("remaining") > 0).alias("there"), "remaining", F.bitwise_not("id").alias("turned"), "id", "sources")


def _first(merged: DataFrame, by: str, most: int) -> DataFrame:
    return merged.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(*_worth()))).where(F.col("place") <= most)


def pool(sources: dict[str, DataFrame], stock: DataFrame, most: int = POOL) -> DataFrame:
    """search, id and the sorted sources of the candidates worth scoring; exact codes, fragments and what was learned come first, then the number of sources, then what is in stock.

    ``sources`` are (search, id), or (search, id, source) where a pool names its own sources.
    """
    every = None
    for marker, found in sources.items():
        own = found.select("search", "id", F.lit(marker).alias("source"))
        own = own.unionByName(found.select("search", "id", "source")) if "source" in found.columns else own
        every = own if every is None else every.unionByName(own)
    merged = every.groupBy("search", "id").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    return _first(merged.join(stock.select("id", "remaining"), "id"), "search", most).select("search", "id", "sources", "place")


def pool_by_keys(search_keys: DataFrame, posted: DataFrame, direct: dict[str, DataFrame], stock: DataFrame, most: int = POOL) -> DataFrame:
    """``pool`` of the items that share a key of a search (line, kind, key; kind, key, id; the kind is the source) and of ``direct`` sources (search, id).

    Searches with the same keys are ranked once, with the first ``most`` items
    of those with the same keys.  A direct source only raises its own item, so
    the first ``most`` by keys and the direct ones hold all that can stay: they
    are merged in one row for each search.  Ids are whole numbers.
    """
    (asked, searches), (there, items) = retrieval.key_classes(search_keys, "line"), retrieval.key_classes(posted, "id")
    met = stored(retrieval.merge_sources(retrieval.by_kind(asked, there)).select(F.col("line").alias("search_class"), F.col("id").alias("item_class"), "sources"), "met-classes")
    searches, items = searches.select(F.col("class").alias("search_class"), F.col("id").alias("search")), items.select(F.col("class").alias("item_class"), "id")
    # merged, as a stored table that is small on disk may be too large to be sent to all
    worth = stock.select("id", "remaining")
    searches, items = stored(searches, "search-classes"), stored(items, "item-classes")
    order = [(F.col("remaining") > 0).cast("int").desc(), F.col("remaining").desc(), F.col("id")]
    few = items.join(worth.hint("merge"), "id").withColumn("n", F.row_number().over(W.partitionBy("item_class").orderBy(*order))).where(F.col("n") <= most).drop("n")
    listed = lambda ranked, by, name: ranked.groupBy(by).agg(F.collect_list(_listed()).alias(name), F.collect_list("id").alias(f"{name}_ids"))
    tops = listed(_first(met.join(few, "item_class"), "search_class", most), "search_class", "top")
    every = None
    for marker, found in direct.items():
        own = found.select("search", "id").join(searches.hint("merge"), "search", "left").join(items.hint("merge"), "id", "left").join(met.hint("merge"), ["search_class", "item_class"], "left")
        own = own.select("search", "id", F.array_union(F.coalesce("sources", F.array().cast("array<string>")), F.array(F.lit(marker))).alias("sources"))
        every = own if every is None else every.unionByName(own)
    pools = searches.join(tops.drop("top_ids"), "search_class", "left")
    if every is not None:
        merged = every.groupBy("search", "id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"))
        raised = listed(_first(merged.join(worth.hint("merge"), "id"), "search", most), "search", "own")
        pools = searches.join(raised, "search", "full").join(tops.drop("top_ids"), "search_class", "left")
        rest = F.filter("top", lambda x: ~F.array_contains("own_ids", x["id"]))
        pools = pools.select("search", F.when(F.col("own").isNull(), F.col("top")).when(F.col("top").isNull(), F.col("own")).otherwise(F.concat("own", rest)).alias("top"))
    best = pools.select("search", F.posexplode(F.slice(F.sort_array("top", asc=False), 1, most)).alias("at", "x"))
    return best.select("search", F.col("x.id").alias("id"), F.col("x.sources").alias("sources"), (F.col("at") + 1).alias("place"))


def blended(query: Column, code: Column, name: Column, own: Column, context: Column) -> Column:
    """Score of a result.  ``own`` and ``context`` are structs of scores against the query and against the line: score, family_match, material_match, bonus, structure_overlap."""
    # fixed values: the weights and points
    text, key, item = F.lower(F.trim(query)), manual_code(query), manual_code(F.coalesce(code, F.lit("")))
    weight = F.when(F.length(text) >= 6, 0.62).otherwise(0.54)
    score = F.greatest(own["score"], own["score"] * weight + context["score"] * (1 - weight))
    score = score + F.when(context["family_match"] & context["material_match"], 8.0).when(context["family_match"], 5.0).otherwise(0.0)
    score = score + F.when(context["bonus"] >= 10, 10.0).when(context["bonus"] >= 6, 6.0).otherwise(0.0) + F.when(context["structure_overlap"] >= 0.25, 4.0).otherwise(0.0)
    code_text, name_text = F.lower(F.coalesce(code, F.lit(""))), F.lower(F.coalesce(name, F.lit("")))
    fragment = (text != "") & (code_text.contains(text) | name_text.contains(text))
    score = F.when((text != "") & (code_text == text), F.greatest(score, F.lit(100.0))).when((key != "") & (key == item), F.greatest(score, F.lit(98.0))).when(fragment, F.greatest(score, F.least(F.lit(96.0), score + 20.0))).otherwise(score)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))


def shown(results: DataFrame, limit: int = RESULTS) -> DataFrame:
    """The results of each search that have enough evidence, one for each code, best first.

    ``results`` has search, id, code, score, code_hit, remaining, overlap,
    root_overlap, bonus, context_score and context_bonus.
    """
    enough = (F.col("score") >= MIN_SCORE) | F.col("code_hit") | (F.col("overlap") >= MIN_OVERLAP) | (F.col("root_overlap") >= MIN_ROOTS) | (F.col("bonus") >= MIN_DIMENSIONS) | (F.col("context_score") >= MIN_CONTEXT) | (F.col("context_bonus") >= MIN_CONTEXT_DIMENSIONS)
    order = [F.col("score").desc(), F.col("code_hit").cast("int").desc(), (F.col("remaining") > 0).cast("int").desc(), F.col("remaining").desc(), F.col("id")]
    good = results.where(enough & (F.coalesce("code", F.lit("")) != ""))
    one = good.withColumn("n", F.row_number().over(W.partitionBy("search", "code").orderBy(*order))).where("n = 1")
    return one.withColumn("place", F.row_number().over(W.partitionBy("search").orderBy(*order))).where(F.col("place") <= limit).drop("n")

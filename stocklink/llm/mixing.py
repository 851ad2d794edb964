"""Mixing sources to target weights by systematic sampling.

Within a source every document has the same expected number of copies, target
/ size.  The documents stand in a fixed order, larger ones first; their
expected copies are summed up from one random offset, and a document is
emitted once for each whole number that the sum crosses.  Since the order is
by size, the words taken from a source differ from its target by about its
largest document at most.

The prefix sum needs a document's rank in its source, which no task computes
alone: the documents are dealt out by range of (source, size class, bucket of
a hash, doc_id), so a source takes as many ranges as it needs, and sorted in
each; a rank is the place in the range plus the source's documents in the
ranges before, of which there is one number for each range and source.  Texts
are read once, for their sizes.

A null text has size 0; a null source is a source of its own, last in order;
equal rows are sampled each (ties by doc_id are broken by text hash, and rows
without doc_id have it for their bucket); a source
of size 0 has target 0, and from it nothing is taken; an empty table gives an
empty mix.  The offset is made from the seed and the source's name, so reruns
agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import written

WEIGHTS, SHARE_PERCENT, MOST, SEED = (5, 2, 1), 150, 2, 1
WORD = r"[^\x20\x09-\x0D]+"


def sizes(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST) -> DataFrame:
    """``by_source`` (_source, _source_size) with _target: shares by weight, none above ``most`` times its source's size.

    Sources reach their limit in the order of size by weight.  In that order,
    a source is at its limit if the share that is left at its turn, after all
    the limits before, would give it as much or more; the first one that isn't
    sets the level for itself and the rest.  One row for each source is
    handled here, in one task, without the documents: 100 bytes or so each, so
    that ten million sources are the bound.
    """
    place = F.row_number().over(W.orderBy(F.col("_source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_place") % len(weights) + 1).cast("int")).cast("long")
    turn = W.orderBy(F.col("_source_size") / F.col("_weight"), "_place")
    sources = by_source.withColumn("_place", place).withColumn("_weight", weight)
    sources = sources.withColumn("_limits", F.coalesce(F.sum(F.col("_source_size") * most).over(turn.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    sources = sources.withColumn("_open", F.sum("_weight").over(turn.rowsBetween(0, W.unboundedFollowing))).withColumn("_turn", F.row_number().over(turn))
    everything = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = (F.sum("_source_size").over(everything) * (share_percent / 100.0) - F.col("_limits")).cast("double")
    sources = sources.withColumn("_left", left)
    below = F.col("_left") * F.col("_weight") < (F.col("_source_size") * most * F.col("_open")).cast("double")
    sources = sources.withColumn("_level", F.when(below, F.struct(F.col("_turn"), (F.col("_left") / F.col("_open")).alias("level"))))
    limit = F.col("_source_size").cast("double") * most
    return sources.withColumn("_water", F.min("_level").over(everything)["level"]).select("_source", "_key", "_source_size", F.least(limit, F.coalesce(F.col("_water") * F.col("_weight"), limit)).alias("_target"))


def offset(key: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) from the seed and the source's key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 8), 16, 10).cast("double") / float(1 << 32)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, _size, _source_size, _target and _copies of every document, and the columns in ``carry``; texts aren't moved."""
    spark = docs.sparkSession
    text, source = F.col("text").cast("string"), F.col("source").cast("string")
    key = F.coalesce(F.concat(F.lit("="), source), F.lit("null"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("_source"), key.alias("_key"), sizes(text).alias("_size"), F.xxhash64(text).alias("_tie"), *carry)
    own = written(own, "sizes")
    # a class is an eighth of a power of two, so sizes in one differ by an eighth at most; the largest come first
    octave = F.length(F.bin(F.col("_size") + 1)) - 1
    placed = own.withColumn("_octave", octave).withColumn("_class", -(F.col("_octave") * 8 + F.expr("shiftright((_size + 1) * 8, _octave)")))
    placed = placed.withColumn("_bucket", F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("#"), F.col("_tie").cast("string")))), 1, 2)).drop("_octave")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["_key", "_class", "_bucket", F.col("doc_id").asc_nulls_first(), "_tie"]
    # the number holds the range in its upper bits, and counts the rows of a range in order
    ranked = written(placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_class", "_bucket", "_tie").withColumn("_mono", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_mono", 33)), "ranked")
    # one row for each range and source
    cells = written(ranked.groupBy("_range", "_key").agg(F.first("_source").alias("_source"), F.min("_mono").alias("_first"), F.count("*").alias("_n"), F.sum("_size").alias("_cell_size")), "cells")
    ahead = F.coalesce(F.sum("_n").over(W.partitionBy("_key").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    goal = targets(cells.groupBy("_key").agg(F.first("_source").alias("_source"), F.sum("_cell_size").alias("_source_size")), weights, share_percent, most).drop("_source")
    plan = written(cells.select("_range", "_key", "_first", ahead.alias("_ahead")).join(goal, "_key"), "mix-plan")
    placed_at = ranked.drop("_source").join(plan, ["_range", "_key"])
    each = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(0.0)
    at, start = F.col("_ahead") + F.col("_mono") - F.col("_first") + 1, offset(F.col("_key"), seed)
    crossed = F.floor(at * each + start) - F.floor((at - 1) * each + start)
    return placed_at.withColumn("_copies", F.least(crossed, F.lit(most)).cast("long")).drop("_key", "_range", "_mono", "_first", "_ahead")


def taken(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and the words that the mix takes of each document."""
    return mix(docs, **options).select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"))


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its own columns, whatever their names."""
    # written, so that a row keeps its number; the copies are found without the texts and then joined to them
    rows = written(docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")).withColumn("_number", F.monotonically_increasing_id()), "numbered")
    mixed = written(mix(rows, carry=("_number",), **options).where("_copies > 0").select("_number", F.col("_copies").cast("int").alias("_copies")), "copies")
    taken_rows = rows.select("_number", "_row").join(mixed, "_number")
    return taken_rows.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")


def sql(seed: int = SEED) -> str:
    """The same rows in DuckDB's SQL."""
    return rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce('=' || source, 'null') AS key, coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0)::BIGINT AS size FROM documents
), placed AS (
  SELECT *, -((length(bin(size + 1)) - 1) * 8 + (((size + 1) * 8) >> (length(bin(size + 1)) - 1))) AS class, substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 2) AS bucket FROM sized
), by_source AS (
  SELECT source, key, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM placed GROUP BY source, key
), weighed AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS weight FROM by_source
), turns AS (
  SELECT *, row_number() OVER t AS turn, coalesce(sum(source_size * 2) OVER (t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS limits,
    sum(weight) OVER (t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open, sum(source_size) OVER () AS all_size
  FROM weighed WINDOW t AS (ORDER BY source_size::DOUBLE / weight, place)
), rest AS (
  SELECT *, all_size::DOUBLE * 1.5::DOUBLE - limits::DOUBLE AS room FROM turns
), level AS (
  SELECT arg_min(room / open::DOUBLE, turn) AS water FROM rest WHERE room * weight::DOUBLE < (source_size * 2 * open)::DOUBLE
), goal AS (
  SELECT key, source_size, least(source_size * 2.0::DOUBLE, coalesce(water * weight::DOUBLE, source_size * 2.0::DOUBLE)) AS target FROM rest LEFT JOIN level ON true
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY class, bucket, doc_id NULLS FIRST) AS rnk FROM placed
), summed AS (
  SELECT doc_id, size, source_size, target, rnk, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0::DOUBLE END AS each,
    ('0x' || substr(md5('{seed}:' || key), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS start
  FROM ranked JOIN goal USING (key)
)
SELECT doc_id, size, source_size, target, (least(floor(rnk::DOUBLE * each + start) - floor((rnk - 1)::DOUBLE * each + start), 2) * size)::BIGINT AS taken FROM summed
"""

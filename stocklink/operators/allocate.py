"""Stock reservation in line order, statuses and matching metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import stored

# The six statuses of a line.
FULL, PARTIAL, SAFE, APPROVAL, NOT_FOUND, DEPLETED = "Найдено полностью", "Найдено частично", "Безопасный аналог", "Допустимая замена по согласованию", "Не найдено", "Найдено, но остаток уже распределен"
STATUSES = (FULL, PARTIAL, SAFE, APPROVAL, NOT_FOUND, DEPLETED)


def reserve(lines: DataFrame, stock: list[str], order: list[Column], requested: str, quantity: str) -> DataFrame:
    """``lines`` with before (requested ahead in order) and allocated.

    A line gets what is left of its stock item after all lines before it:
    least(request, greatest(0, quantity - requests before)).  That equals the
    line-by-line reservation, since requests are positive.
    """
    ahead = F.coalesce(F.sum(requested).over(W.partitionBy(*stock).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return lines.withColumn("before", ahead).withColumn("allocated", F.least(F.col(requested), F.greatest(F.lit(0.0), F.col(quantity) - F.col("before"))))


def reserve_by_ranges(lines: DataFrame, stock: list[str], order: list[str], requested: str, quantity: str) -> DataFrame:
    """The same as ``reserve`` where one item may have very many lines: lines are dealt out by range of item and order, and sums are made in two levels.

    A line's requests ahead are those of its own range, plus the item's totals
    of the ranges before, one row for each range and item.
    """
    parts = max(1, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [*stock, *order]
    # the number holds the range in its upper bits, and follows the order in the range
    ranged = stored(lines.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_place", 33)), "ranges")
    totals = ranged.groupBy(*stock, "_range").agg(F.sum(requested).alias("_total"))
    earlier = F.coalesce(F.sum("_total").over(W.partitionBy(*stock).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    own = F.coalesce(F.sum(requested).over(W.partitionBy(*stock, "_range").orderBy("_place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    summed = ranged.withColumn("_own", own).join(totals.select(*stock, "_range", earlier.alias("_earlier")), [*stock, "_range"])
    ahead = summed.withColumn("before", F.col("_own") + F.col("_earlier")).drop("_own", "_earlier", "_place", "_range")
    return ahead.withColumn("allocated", F.least(F.col(requested), F.greatest(F.lit(0.0), F.col(quantity) - F.col("before"))))


def line_status(requested: Column, allocated: Column) -> Column:
    return F.when(allocated >= requested, FULL).when(allocated > 0, PARTIAL).otherwise(DEPLETED)


def remaining(reserved: DataFrame, stock: list[str], quantity: str) -> DataFrame:
    """What is left of each item after all lines, which is what outputs show."""
    return reserved.groupBy(*stock).agg((F.max(quantity) - F.sum("allocated")).alias("remaining"))


def status_counts(results: DataFrame, status: str = "status") -> DataFrame:
    """Every status with its count, zeros included."""
    domain = results.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    counts = results.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))
    return F.broadcast(domain).join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def matching_metrics(results: DataFrame, requested: str, allocated: str, status: str = "status", confidence: str | None = None, reviewed: str | None = None) -> DataFrame:
    """Totals, allocation ratio (four decimals, 0 without demand); for analogs their number, mean confidence and how many lead with a reviewed one."""
    demand, analog = F.sum(requested), F.col(status).isin(SAFE, APPROVAL) if confidence or reviewed else None
    columns = [F.count("*").alias("total_lines"), demand.alias("total_requested"), F.sum(allocated).alias("total_allocated"), F.when(demand > 0, F.round(F.sum(allocated) / demand, 4)).otherwise(0.0).alias("allocation_ratio")]
    if confidence:
        columns += [F.count_if(analog).alias("analog_lines"), F.coalesce(F.round(F.avg(F.when(analog, F.col(confidence))), 3), F.lit(0.0)).alias("average_analog_confidence")]
    if reviewed:
        columns.append(F.count_if(analog & F.col(reviewed)).alias("reviewed_top_analog_lines"))
    return results.agg(*columns)


def reserve_with_ties(file_lines: DataFrame, keys: list[str]) -> DataFrame:
    """Greedy reservation for files whose candidates tie on everything but the remaining quantity.

    ``file_lines`` has one row for each line (line_no, requested) with its
    candidates as an array of (stock_id, quantity, rank) where equal ranks tie;
    a line takes the tied best candidate with the most left.  Files are
    independent and small (hundreds of lines), so each is one group.
    """
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left: dict = {}
        out = []
        for row in pdf.sort_values("line_no").itertuples():
            best = None
            for c in row.candidates if row.candidates is not None else ():
                left.setdefault(c["stock_id"], float(c["quantity"]))
                key = (c["rank"], -left[c["stock_id"]], c["stock_id"])
                best = min(best, (key, c["stock_id"])) if best else (key, c["stock_id"])
            chosen = best[1] if best else None
            got = min(row.requested, left[chosen]) if best else 0.0
            if best:
                left[chosen] -= got
            out.append((*(getattr(row, k) for k in keys), row.line_no, chosen, got))
        return pd.DataFrame(out, columns=[*keys, "line_no", "stock_id", "allocated"])

    schema = ", ".join([*(f"{k} {dict(file_lines.dtypes)[k]}" for k in keys), "line_no long", "stock_id long", "allocated double"])
    return file_lines.groupBy(*keys).applyInPandas(run, schema)

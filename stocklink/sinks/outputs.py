"""Result tables for the manager, for export and for review, and keyed overwrites of stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import ACTIONS
from ..functions.text import format_number
from ..operators.allocate import APPROVAL, DEPLETED, FULL, NOT_FOUND, PARTIAL, SAFE, STATUSES
from ..operators.feedback import upsert

ANALOG_STATUSES, EXACT_STATUSES, MISSING_STATUSES = (SAFE, APPROVAL), (FULL, PARTIAL), (NOT_FOUND, DEPLETED)


def manager_action(status: Column, comment: Column) -> Column:
    """What a manager does next."""
    manual = F.coalesce(F.lower(comment).contains("ручного подбора"), F.lit(False))
    return F.when(status.isin(*EXACT_STATUSES), ACTIONS["found"]).when(status == SAFE, ACTIONS["safe"]).when(status == APPROVAL, ACTIONS["approval"]).when(manual, ACTIONS["manual"]).when(status == DEPLETED, ACTIONS["depleted"]).otherwise(ACTIONS["none"])


def candidate_text(code: Column, name: Column, remaining: Column, score: Column | None, approved: Column, boost: Column) -> Column:
    """A candidate in one line: code, name, stock, score if given, and why it is trusted."""
    mark = F.when(approved, "подтверждено").when(boost > 0, "учтён ручной выбор")
    shown = F.format_string("score %.1f", score) if score is not None else F.lit(None).cast("string")
    return F.concat_ws(" | ", code, name, F.concat(F.lit("остаток "), format_number(remaining)), shown, mark)


def first_price(*prices: str) -> Column:
    """The first positive price."""
    return F.coalesce(*[F.when(F.col(c).try_cast("double") > 0, F.col(c).try_cast("double")) for c in prices])


_ORDER = ("source_file", "sheet_name", "source_row")


def detailed(results: DataFrame, analogs: int = 3) -> DataFrame:
    """All lines in order of file, sheet and row, with what to do and a fixed number of analog columns."""
    columns = [F.get("analogs", F.lit(k)).alias(f"analog_{k + 1}") for k in range(analogs)]
    return results.withColumn("action", manager_action(F.col("status"), F.col("comment") if "comment" in results.columns else F.lit(""))).select("action", *[c for c in results.columns if c != "analogs"], *columns).orderBy(*_ORDER)


def manager_view(results: DataFrame) -> DataFrame:
    """What to do, the line, its quantity, the item or best analog, and the comment."""
    target = F.coalesce(F.when(F.col("code").isNotNull(), F.concat_ws(" | ", "code", "item")), F.get("analogs", F.lit(0)), F.lit(""))
    return results.select(manager_action(F.col("status"), F.col("comment")).alias("action"), "name", format_number(F.col("requested")).alias("quantity"), target.alias("target"), "comment", *_ORDER).orderBy(*_ORDER)


def raw_rows(results: DataFrame, cells: str, most: int) -> DataFrame:
    """The cells of the input as columns beside the line's place; ``most`` is the widest row."""
    return results.select(*[F.get(cells, F.lit(k)).alias(f"column_{k + 1}") for k in range(most)], *_ORDER)


def for_export(results: DataFrame) -> DataFrame:
    """Lines that got stock, with the first positive of sale, stop and plan price."""
    return results.where(F.col("status").isin(*EXACT_STATUSES) & (F.col("allocated") > 0)).select("source_file", "source_row", "code", "name", F.col("allocated").alias("quantity"), first_price("sale_price", "stop_price", "plan_price").alias("price"))


def analog_lines(results: DataFrame) -> DataFrame:
    return results.where(F.col("status").isin(*ANALOG_STATUSES)).select("source_file", "source_row", "name", "status", *[F.get("analogs", F.lit(k)).alias(f"analog_{k + 1}") for k in range(4)])


def unmatched(results: DataFrame) -> DataFrame:
    return results.where(F.col("status").isin(*MISSING_STATUSES)).select("source_file", "source_row", "name", "status", F.get("analogs", F.lit(0)).alias("best_candidate"))


def summary(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count("*").alias("lines"), F.sum("requested").alias("requested"), F.sum("allocated").alias("allocated"))


def write_outputs(results: DataFrame, path: str) -> None:
    """The five outputs from one computation of the results."""
    kept = results.persist()
    try:
        for name, table in (("detailed", detailed(kept)), ("export", for_export(kept)), ("analogs", analog_lines(kept)), ("unmatched", unmatched(kept)), ("summary", summary(kept))):
            table.write.mode("overwrite").parquet(f"{path}/{name}")
    finally:
        kept.unpersist()


def write_request(lines: DataFrame, issues: DataFrame, path: str) -> None:
    """A normalised request: its lines, the rows that gave none, and the counts by status."""
    counts = lines.groupBy("path", "status").agg(F.count("*").alias("lines"), F.round(F.avg("confidence"), 4).alias("confidence"))
    for name, table in (("request", lines), ("issues", issues), ("summary", counts)):
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def artifact(files: DataFrame, metrics: DataFrame, rules: DataFrame, outputs: list[str], generated_at: Column) -> DataFrame:
    """One JSON document of a run: hash of the inputs, inputs, rules, metrics and outputs; each side is a few rows."""
    listed = lambda d, columns: d.agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("v"))
    inputs = listed(files, ["path", "sha256"])
    joined = inputs.select(F.col("v").alias("inputs")).crossJoin(listed(rules, ["name", "sha256", "version"]).withColumnRenamed("v", "rules")).crossJoin(metrics.select(F.struct(*metrics.columns).alias("metrics")))
    digest = F.sha2(F.array_join(F.transform("inputs", lambda f: F.concat(f["path"], f["sha256"])), ""), 256)
    return joined.select(F.to_json(F.struct(F.lit(1).alias("artifact_version"), generated_at.alias("generated_at"), digest.alias("combined_input_hash"), "inputs", "rules", "metrics", F.array(*map(F.lit, outputs)).cast("array<string>").alias("outputs"))).alias("value"))


def write_artifact(document: DataFrame, path: str) -> None:
    document.coalesce(1).write.mode("overwrite").text(path)


def print_summary(results: DataFrame, name: str) -> None:
    """Counts of a file's lines by status, all statuses in order."""
    counts = {r.status: r.n for r in results.groupBy("status").agg(F.count("*").alias("n")).collect()}
    print(name, f"  {sum(counts.values())}", *[f"  {s}: {counts.get(s, 0)}" for s in STATUSES], sep="\n")


def replace_keys(path: str, changes: DataFrame, keys: list[str], version: int) -> str:
    """Write the table at ``path/v<version>`` with the rows of the changed keys replaced, as the next version; its folder is returned."""
    spark = changes.sparkSession
    current = spark.read.parquet(f"{path}/v{version}") if version else changes.where("false")
    upsert(current, changes, keys).write.mode("overwrite").parquet(f"{path}/v{version + 1}")
    return f"{path}/v{version + 1}"

"""Jobs from the command line: ``python -m stocklink.cli normalize|match|evaluate|review|extractors ...``."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import hints
from .functions.hints import Rules
from .operators import analytics, memory, policy
from .plans import matching
from .session import ship_package, stored
from .sinks import outputs
from .sources import documents, registry, stock


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="stocklink", description="Requests against stock.")
    top.add_argument("--hints", help="rules of the parser (JSON)")
    top.add_argument("--dictionary", help="words of the domain (JSON)")
    command = top.add_subparsers(dest="command", required=True)
    for name, words in (("normalize", "request files to one table"), ("match", "request files against stock"), ("review", "reviewed workbooks to decisions and cases")):
        one = command.add_parser(name, help=words)
        one.add_argument("inputs", nargs="+")
        one.add_argument("--out", required=True)
        if name == "match":
            one.add_argument("--stock", required=True)
            one.add_argument("--policy")
            one.add_argument("--reviewed")
            one.add_argument("--memory", nargs="*", default=[])
    cases = command.add_parser("evaluate", help="hit rates of reviewed cases")
    for option in ("--golden", "--stock", "--out"):
        cases.add_argument(option, required=True)
    cases.add_argument("--policy")
    command.add_parser("extractors", help="which document tools there are")
    return top


def requests_of(spark: SparkSession, inputs: list[str], rules: Rules) -> tuple[DataFrame, DataFrame]:
    """Lines and issues of all files; files are few, and are listed on the driver."""
    lines = issues = None
    for path in inputs:
        a, b = stock.request(spark, path, rules)
        lines, issues = (a, b) if lines is None else (lines.unionByName(a), issues.unionByName(b))
    return lines, issues


def items_of(spark: SparkSession, path: str) -> DataFrame:
    items = registry.all_stock(spark, path)
    return stored(items.withColumn("id", F.monotonically_increasing_id()), "stock")


_PARTS, _ITEM = ["name", "mark", "vendor"], ["name", "print_name", "product_type"]


def match(spark: SparkSession, lines: DataFrame, items: DataFrame, rules: Rules, policies: DataFrame | None, reviewed: DataFrame | None = None, entries: DataFrame | None = None) -> DataFrame:
    """Results of request lines; each file reserves from the whole stock."""
    numbered = stored(lines.withColumn("id", F.monotonically_increasing_id()).withColumn("requested", F.col("quantity")), "request-lines")
    pairs = None
    if reviewed is not None:
        read = matching.features(numbered, "id", _PARTS, rules)
        keys = memory.review_keys(read.join(numbered.select("id", "name"), "id"), ["name"], rules)
        pairs = stored(memory.reviewed_pairs(keys, reviewed.select(F.col("query_key").alias("key"), "code", "decision"), spark.createDataFrame([], "key string, code string, decision string"), items), "reviewed-pairs")
    return matching.match(numbered, items, _PARTS, _ITEM, ["path", "row"], pairs, None, policies, rules, entries)


def evaluate(spark: SparkSession, golden: str, items: DataFrame, rules: Rules, policies: DataFrame | None) -> DataFrame:
    """Cases and hits among the first 1, 3 and 5 candidates, by family and in all."""
    cases = hints.payload(golden).get("cases") or []
    rows = [(k, c.get("query", ""), [str(x).upper() for x in c.get("approved_candidate_codes") or []], [str(x).upper() for x in c.get("rejected_candidate_codes") or []]) for k, c in enumerate(cases)]
    asked = spark.createDataFrame(rows, "id long, name string, approved array<string>, rejected array<string>").withColumn("requested", F.lit(1.0))
    orders, held = matching.features(asked, "id", ["name"], rules), matching.features(items, "id", _ITEM, rules)
    scores = matching.scored(matching.pairs_of(orders, held, matching.candidates(orders, stored(matching.stock_postings(held), "postings"))), None, policies)
    top = matching.decided(stored(scores, "scores")).select(F.col("line").alias("id"), F.posexplode(F.transform("candidates", lambda c: c["stock_id"])).alias("place", "item"))
    coded = top.join(items.select(F.col("id").alias("item"), F.upper("code").alias("code")), "item")
    family = orders.select("id", F.coalesce(F.element_at(F.filter("tags", lambda t: t.startswith("family:")), 1), F.lit("")).alias("family"))
    judged = asked.join(family, "id").join(coded, "id", "left").groupBy("id", "family").agg(F.min(F.when(F.array_contains("approved", F.col("code")), F.col("place"))).alias("hit"), F.min(F.when(F.array_contains("rejected", F.col("code")), F.col("place"))).alias("bad"))
    hit = lambda c, k: F.coalesce(F.col(c) < k, F.lit(False))
    return analytics.hit_rates(judged, "family", {f"hit_at_{k}": hit("hit", k) for k in (1, 3, 5)} | {f"rejected_at_{k}": hit("bad", k) for k in (3, 5)})


def main(arguments: list[str] | None = None) -> int:
    asked = parser().parse_args(arguments)
    if asked.command == "extractors":
        print(json.dumps(documents.available(), indent=2))
        return 0
    spark = SparkSession.builder.appName(f"stocklink {asked.command}").getOrCreate()
    ship_package(spark)
    rules = Rules.load(asked.hints, asked.dictionary)
    policies = policy.load(spark, asked.policy) if getattr(asked, "policy", None) else None
    if asked.command == "evaluate":
        evaluate(spark, asked.golden, items_of(spark, asked.stock), rules, policies).write.mode("overwrite").parquet(asked.out)
        return 0
    if asked.command == "review":
        read = registry.reviewed(spark, ",".join(asked.inputs), rules)
        decisions = analytics.golden_set(read.withColumn("source", F.col("sheet")))
        read.write.mode("overwrite").parquet(f"{asked.out}/decisions")
        decisions.write.mode("overwrite").parquet(f"{asked.out}/cases")
        return 0
    lines, issues = requests_of(spark, asked.inputs, rules)
    if asked.command == "normalize":
        outputs.write_request(lines, issues, asked.out)
        return 0
    reviewed = registry.reviewed_json(spark, asked.reviewed, rules) if asked.reviewed else None
    entries = memory.complete(memory.read_memory(spark, *asked.memory), rules) if asked.memory else None
    results = match(spark, lines, items_of(spark, asked.stock), rules, policies, reviewed, entries)
    results.write.mode("overwrite").parquet(f"{asked.out}/results")
    for path in asked.inputs:
        outputs.print_summary(results.where(F.col("path").endswith(Path(path).name)), path)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

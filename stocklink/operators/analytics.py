"""Quality of matching, usage and audit figures."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import UNIT_CELLS
from .feedback import MIN_CONFIDENCE, newest


def hit_rates(cases: DataFrame, family: str, hits: dict[str, Column]) -> DataFrame:
    """Cases and hits for each family and, with a null family, in all."""
    return cases.rollup(family).agg(F.count("*").alias("cases"), *[F.sum(hit.cast("int")).alias(name) for name, hit in hits.items()])


def golden_set(decisions: DataFrame) -> DataFrame:
    """One case for each query key: its smallest query, the codes that were approved and rejected, and the sources, all distinct and sorted."""
    codes = lambda d: F.array_sort(F.collect_set(F.when(F.col("decision") == d, F.col("code"))))
    return decisions.where("query_key != '' and code != ''").groupBy("query_key").agg(F.min("query").alias("query"), codes("approved").alias("approved"), codes("rejected").alias("rejected"), F.array_sort(F.collect_set("source")).alias("sources"))


def top_replacements(events: DataFrame, key: Column, used: Column, learned: Column, user: str, most: int = 20) -> DataFrame:
    """The replacements used most; ties by key."""
    return events.groupBy(key.alias("replacement")).agg(F.sum(used.cast("int")).alias("used"), F.sum(learned.cast("int")).alias("learned"), F.countDistinct(user).alias("users")).orderBy(F.col("used").desc(), "replacement").limit(most)


def user_summary(users: DataFrame, events: DataFrame, key: list[str], aggregates: list[Column]) -> DataFrame:
    """Figures of every user of the directory, zeros included."""
    figures = events.groupBy(key[1]).agg(*aggregates)
    joined = users.join(figures, users[key[0]] == figures[key[1]], "left").drop(figures[key[1]])
    return joined.fillna(0)


def approved_snapshots(feedback: DataFrame) -> DataFrame:
    """The newest approved entry of each snapshot; an entry without snapshot is one by itself."""
    key = F.coalesce(F.nullif(F.trim("snapshot_id"), F.lit("")), F.nullif(F.trim("record_id"), F.lit("")))
    approved = feedback.where(F.lower(F.trim("decision")) == "approved").withColumn("snapshot_key", key).where("snapshot_key is not null")
    return newest(approved, ["snapshot_key"], [F.col("updated_at").desc(), F.col("record_id").desc()])


def snapshot_count(feedback: DataFrame) -> DataFrame:
    return approved_snapshots(feedback).agg(F.count("*").alias("snapshots"))


def admin_summary(exports: DataFrame, feedback: DataFrame) -> DataFrame:
    """One row: totals of the exports and of what was taught.  What was learned is counted by snapshots, or by the exports if there are none."""
    told = F.lower(F.trim("decision"))
    taught = feedback.agg(F.count("*").alias("feedback_entry_count"), F.count_if(told == "approved").alias("positive_feedback_count"), F.count_if(told == "rejected").alias("negative_feedback_count"), F.count_if(F.coalesce("learning_confidence", F.lit(1.0)) < MIN_CONFIDENCE).alias("low_confidence_feedback_count"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    out = exports.agg(F.count("*").alias("saved_files"), F.countDistinct("job_id").alias("unique_jobs"), F.countDistinct(F.nullif("saved_by", F.lit(""))).alias("users_with_exports"), *[total(c) for c in ("total_rows", "replacement_count", "manual_search_replacement_count", "learned_replacement_count")])
    # one row each
    joined = out.crossJoin(taught).crossJoin(snapshot_count(feedback).withColumnRenamed("snapshots", "learned_snapshot_count"))
    return joined.withColumn("learned_replacement_count", F.when(F.col("learned_snapshot_count") > 0, F.col("learned_snapshot_count")).otherwise(F.col("learned_replacement_count")))


def feedback_by_source(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy(F.coalesce(F.nullif(F.trim("selected_via"), F.lit("")), F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"))


def user_activity(users: DataFrame, exports: DataFrame, feedback: DataFrame) -> DataFrame:
    """Every user of the directory and every other one who saved or taught: files (newest first), jobs, rows, replacements, what was learned, last save."""
    by = lambda c: F.lower(F.trim(c))
    saved = exports.withColumn("username", by("saved_by")).where("username != ''")
    file = F.struct(F.col("saved_at"), F.col("job_id"), F.col("filename"), F.col("total_rows"), F.col("replacement_count"))
    # a user's own files are gathered
    figures = saved.groupBy("username").agg(
        F.count("*").alias("saved_files"), F.countDistinct("job_id").alias("unique_jobs"), F.sum("total_rows").alias("total_rows"), F.sum("replacement_count").alias("replacement_count"), F.max("saved_at").alias("last_saved_at"),
        F.reverse(F.array_sort(F.collect_list(file))).alias("files"), F.sum("learned_replacement_count").alias("_by_export"),
    )
    snapshots = approved_snapshots(feedback).withColumn("username", by("selected_by")).where("username != ''").groupBy("username").agg(F.count("*").alias("_by_snapshot"))
    any_snapshot = snapshot_count(feedback)
    named = users.select(by("username").alias("username"), "display_name", "role")
    joined = named.join(figures, "username", "full").join(snapshots, "username", "full").crossJoin(any_snapshot)
    learned = F.when(F.col("snapshots") > 0, F.coalesce("_by_snapshot", F.lit(0))).otherwise(F.coalesce("_by_export", F.lit(0)))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("saved_files", "unique_jobs", "total_rows", "replacement_count")}
    return joined.withColumns({**zero, "learned_replacement_count": learned, "display_name": F.coalesce("display_name", "username"), "role": F.coalesce("role", F.lit("manager")), "last_saved_at": F.coalesce("last_saved_at", F.lit(""))}).drop("_by_export", "_by_snapshot", "snapshots")


def popular_replacements(exports: DataFrame, feedback: DataFrame, most: int = 20) -> DataFrame:
    """The items chosen most: uses from the exports' replacements, lessons from the snapshots (or the exports if there are none), users, and the last time."""
    used = exports.select(F.lower(F.trim("saved_by")).alias("user"), "saved_at", F.explode("replacements").alias("r")).select("user", F.col("saved_at").alias("at"), F.trim("r.candidate_code").alias("code"), F.trim("r.candidate_name").alias("name"), F.col("r.learned_on_export").alias("learned"))
    taught = approved_snapshots(feedback).select(F.lower(F.trim("selected_by")).alias("user"), F.col("selected_at").alias("at"), F.trim("candidate_code").alias("code"), F.trim("candidate_name").alias("name")).where("user != ''")
    any_snapshot = snapshot_count(feedback)
    uses = used.crossJoin(any_snapshot).select("user", "at", "code", "name", F.lit(1).alias("u"), F.when((F.col("snapshots") == 0) & F.col("learned"), 1).otherwise(0).alias("l"))
    both = uses.unionByName(taught.withColumn("u", F.lit(0)).withColumn("l", F.lit(1))).where("code != '' and name != ''")
    counted = both.groupBy(F.col("code").alias("candidate_code")).agg(F.min("name").alias("candidate_name"), F.sum("u").alias("times_used"), F.sum("l").alias("times_learned"), F.max("at").alias("last_used_at"), F.countDistinct("user").alias("used_by_count"))
    return counted.orderBy(F.col("times_used").desc(), F.col("times_learned").desc(), F.col("candidate_name").desc(), "candidate_code").limit(most)


def input_hash(files: DataFrame) -> DataFrame:
    """One hash over path and content hash of all files in order of path."""
    each = F.transform(F.array_sort(F.collect_list(F.struct("path", "sha256"))), lambda f: F.concat(f["path"], f["sha256"]))
    return files.agg(F.sha2(F.array_join(each, ""), 256).alias("input_hash"))


def column_statistics(cells: DataFrame) -> DataFrame:
    """Per column (sheet, col, value): how many cells are filled, numbers, units, positions, texts and codes."""
    value = F.trim(F.coalesce("value", F.lit("")))
    count = lambda c: F.count_if(c)
    return cells.groupBy("sheet", "col").agg(
        count(value != "").alias("non_empty"), count(value.rlike(r"^[0-9]+(?:[.,][0-9]+)?$")).alias("numeric"), count(F.lower(value).isin(*UNIT_CELLS)).alias("unit"),
        count(value.rlike(r"^[0-9]+(?:[./][0-9]+)*$")).alias("position"), count((F.length(value) >= 8) & value.rlike(r"(?U)\p{L}{3}")).alias("text"), count(value.rlike("[A-Za-z]") & value.rlike("[0-9]")).alias("code_like"),
    )


def text_quality(lines: DataFrame, warnings: Column | None = None) -> DataFrame:
    """path, attempt and score of extracted lines (path, attempt, text, confidence): characters, lines, mean confidence, less the warnings."""
    # fixed values: the weights
    scored = lines.groupBy("path", "attempt").agg((F.sum(F.length(F.trim("text"))) + F.count("*") - 1 + F.count("*") * 24.0 + F.avg("confidence") * 40.0).alias("score"))
    return scored if warnings is None else scored.withColumn("score", F.col("score") - warnings * 10.0)


def best_attempts(scored: DataFrame) -> DataFrame:
    """The attempt of each path that scores most, the first of equal ones."""
    return scored.groupBy("path").agg(F.max_by("attempt", F.struct("score", (-F.col("attempt")).alias("first"))).alias("attempt"), F.max("score").alias("score"))

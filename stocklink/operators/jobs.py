"""Jobs and their rows as tables: who sees and edits them, what managers change, what is exported, audited and learned.

``jobs`` has a row for each job (job_id, filename, created_at, created_by, ...),
``rows`` one for each line of a job (job_id, row_id, status, analogs, ...).
Changes are keyed: a change table names the rows, all others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.fixed import APPROVED_STATUS
from .allocate import APPROVAL, DEPLETED, FULL, NOT_FOUND, PARTIAL, SAFE
from .feedback import selection_confidence, selection_source, upsert

ANALOG = "struct<code_1c:string,name:string,score:double,stock_qty:double,remaining:double,price:string,source_label:string,manager_choice:boolean>"
#: The tab that a status is shown under.
TABS = {"exact": (FULL, PARTIAL), "analog": (SAFE, APPROVAL), "approved": (APPROVED_STATUS,), "notfound": (NOT_FOUND, DEPLETED)}


def _text(column: str | Column) -> Column:
    return F.trim(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")))


def visible(jobs: DataFrame, user: Column, role: Column) -> DataFrame:
    """An administrator sees all jobs, anyone else their own."""
    return jobs.where((role == "admin") | (F.lower(_text("created_by")) == F.lower(user)))


def editable(jobs: DataFrame) -> Column:
    """Neither saved nor exported yet."""
    return (_text("saved_at") == "") & (F.coalesce("export_count", F.lit(0)) == 0)


def summaries(jobs: DataFrame, rows: DataFrame) -> DataFrame:
    """The list of jobs with their numbers of rows and replacements and the counts by status."""
    per_status = rows.groupBy("job_id", "status").agg(F.count("*").alias("n"), F.count_if(F.col("approved_code").isNotNull()).alias("replaced"))
    counted = per_status.groupBy("job_id").agg(F.sum("n").alias("total_rows"), F.sum("replaced").alias("replacements_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("status_counts"))
    filename = F.coalesce(F.nullif(_text("filename"), F.lit("")), F.col("job_id").cast("string"))
    return jobs.join(counted, "job_id", "left").withColumns({"filename": filename, "total_rows": F.coalesce("total_rows", F.lit(0)), "replacements_count": F.coalesce("replacements_count", F.lit(0))})


def open_statuses(rows: DataFrame) -> DataFrame:
    """Counts of whatever statuses a job has."""
    return rows.groupBy("job_id", "status").agg(F.count("*").alias("n"))


def find_row(rows: DataFrame, job_id, row_id) -> DataFrame:
    """One row of a job; the caller sees from its absence that there is none."""
    return rows.where((F.col("job_id") == job_id) & (F.col("row_id") == row_id))


def tab(status: Column) -> Column:
    out = None
    for name, statuses in TABS.items():
        out = F.when(status.isin(*statuses), name) if out is None else out.when(status.isin(*statuses), name)
    return out


def shown_analogs(analogs: Column, preferred: str = "ЭК") -> Column:
    """Analogs of the preferred warehouse first, then by score; equal ones in their order."""
    numbered = F.transform(analogs, lambda a, k: F.struct((F.coalesce(a["source_label"], F.lit("")) != preferred).alias("other"), (-a["score"]).alias("least"), k.alias("k"), a.alias("a")))
    return F.transform(F.array_sort(numbered), lambda x: x["a"])


def candidate(code: Column, name: Column, score: Column, stock_qty: Column, remaining: Column, price: Column, label: Column, boost: Column) -> Column:
    """A candidate as it is shown: score with one decimal, and whether a manager chose it before."""
    return F.struct(code.alias("code_1c"), name.alias("name"), F.round(score, 1).alias("score"), stock_qty.alias("stock_qty"), remaining.alias("remaining"), price.alias("price"), label.alias("source_label"), (boost > 0).alias("manager_choice"))


def usable_candidates(candidates: Column) -> Column:
    """Candidates with a code and a name, both stripped."""
    return F.filter(F.transform(candidates, lambda c: c.withField("code_1c", F.trim(c["code_1c"])).withField("name", F.trim(c["name"]))), lambda c: (F.coalesce(c["code_1c"], F.lit("")) != "") & (F.coalesce(c["name"], F.lit("")) != ""))


def merged_pool(rows: DataFrame, keys: list[str], pools: list[str]) -> DataFrame:
    """One candidate for each code of each row over several pools: the best score, the first filled of the other fields, and whether any was chosen before."""

    def numbered(i: int, pool: str) -> Column:
        listed = usable_candidates(F.coalesce(F.col(pool), F.array().cast(f"array<{ANALOG}>")))
        return F.transform(listed, lambda c, k: F.struct(F.lit(i).alias("pool"), k.alias("place"), c.alias("c")))

    entries = F.concat(*[numbered(i, p) for i, p in enumerate(pools)])
    each = rows.select(*keys, F.explode(entries).alias("e")).select(*keys, F.upper("e.c.code_1c").alias("code_key"), F.struct("e.pool", "e.place").alias("turn"), "e.c.*")
    first = lambda c, empty: F.min(F.when(empty, F.struct("turn", F.col(c).alias("v"))))["v"]
    return each.groupBy(*keys, "code_key").agg(
        first("code_1c", F.lit(True)).alias("code_1c"), first("name", F.lit(True)).alias("name"), F.max("score").alias("score"), first("stock_qty", F.col("stock_qty").isNotNull()).alias("stock_qty"), first("remaining", F.col("remaining").isNotNull()).alias("remaining"),
        first("price", _text("price") != "").alias("price"), first("source_label", _text("source_label") != "").alias("source_label"), F.bool_or(F.coalesce("manager_choice", F.lit(False))).alias("manager_choice"),
    )


def quantity_limit(approved: Column, matched_code: Column, matched_stock: Column, available: Column) -> Column:
    """The most that may be asked for: what is left of an approved analog, else of the matched item; null if nothing is known."""
    positive = lambda c: F.when((c > 0) & ~F.isnan(c) & (c < float("inf")), c)
    return F.coalesce(positive(approved["remaining"]), positive(approved["stock_qty"]), F.when(matched_code.isNotNull() & (matched_code != ""), F.coalesce(positive(matched_stock), positive(available))))


def with_quantity(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """``rows`` after the quantity changes (job_id, row_id, quantity), with ``refused``: a quantity that isn't positive, or is more than there is, changes nothing."""
    limit = quantity_limit(F.col("approved_analog"), F.col("matched_code"), F.col("matched_stock_qty"), F.col("available_qty"))
    asked = F.round(F.col("quantity"), 3)
    joined = rows.join(changes, ["job_id", "row_id"], "left").withColumn("_limit", limit)
    fine = F.coalesce((F.col("quantity") > 0) & ~F.isnan("quantity") & (F.col("quantity") < float("inf")) & (F.col("_limit").isNull() | (asked <= F.col("_limit") + 1e-9)), F.lit(False))
    changed = fine & F.col("approved_analog").isNull() & F.col("matched_code").isNotNull()
    available = F.when(changed, F.least(asked, F.coalesce("_limit", asked))).otherwise(F.col("available_qty"))
    status = F.when(changed & F.col("status").isin(FULL, PARTIAL) & F.col("_limit").isNotNull(), FULL).otherwise(F.col("status"))
    return joined.withColumns({"refused": F.col("quantity").isNotNull() & ~fine, "available_qty": available, "status": status, "requested_qty": F.when(fine, asked).otherwise(F.col("requested_qty"))}).drop("_limit", "quantity")


def approve(rows: DataFrame, approvals: DataFrame, user: str, display: str, now: str) -> DataFrame:
    """``rows`` after approvals (job_id, row_id, code) of analogs that are listed; others change nothing."""
    joined = rows.join(approvals.withColumnRenamed("code", "_code"), ["job_id", "row_id"], "left")
    found = F.element_at(F.filter("analogs", lambda a: a["code_1c"] == F.col("_code")), 1)
    chosen = F.when(F.exists("analogs", lambda a: a["code_1c"] == F.col("_code")), found)
    return _selected(joined.withColumn("_chosen", chosen), F.lit("analog"), F.lit(""), user, display, now).drop("_code")


def select_manually(rows: DataFrame, selections: DataFrame, user: str, display: str, now: str) -> DataFrame:
    """``rows`` after selections (job_id, row_id, candidate, search_query) from a search; the candidate is listed first if it wasn't listed."""
    joined = rows.join(selections, ["job_id", "row_id"], "left")
    valid = (_text(F.col("candidate")["code_1c"]) != "") & (_text(F.col("candidate")["name"]) != "")
    new = ~F.coalesce(F.exists("analogs", lambda a: a["code_1c"] == F.col("_chosen")["code_1c"]), F.lit(False))
    done = _selected(joined.withColumn("_chosen", F.when(valid, F.col("candidate"))).withColumn("analogs", F.when(F.col("_chosen").isNotNull() & new, F.concat(F.array("_chosen"), F.coalesce("analogs", F.array().cast(f"array<{ANALOG}>")))).otherwise(F.col("analogs"))), F.lit("manual_search"), _text("search_query"), user, display, now)
    return done.drop("candidate", "search_query")


def _selected(joined: DataFrame, via: Column, query: Column, user: str, display: str, now: str) -> DataFrame:
    taken = F.col("_chosen").isNotNull()
    values = {"approved_analog": F.col("_chosen"), "status": F.lit(APPROVED_STATUS), "selected_via": via, "selection_search_query": query, "selected_by": F.lit(user), "selected_by_display": F.lit(display), "selected_at": F.lit(now)}
    return joined.withColumns({k: F.when(taken, v).otherwise(F.col(k)) for k, v in values.items()}).drop("_chosen")


def exported(rows: DataFrame) -> DataFrame:
    """Lines for the accounting system: found rows in order, then approved analogs with the requested quantity, not cut to the stock."""
    found = rows.where(F.col("status").isin(FULL, PARTIAL) & (_text("matched_code") != "")).select("job_id", F.lit(0).alias("part"), "row_no", F.col("matched_code").alias("code"), F.col("matched_name").alias("name"), F.col("available_qty").alias("quantity"), F.coalesce("matched_price", F.lit("")).alias("price"))
    analog = F.col("approved_analog")
    approved = rows.where(analog.isNotNull()).select("job_id", F.lit(1).alias("part"), "row_no", analog["code_1c"].alias("code"), analog["name"].alias("name"), F.col("requested_qty").alias("quantity"), F.coalesce(analog["price"], F.lit("")).alias("price"))
    order = W.partitionBy("job_id").orderBy("part", "row_no")
    return found.unionByName(approved).withColumn("line", F.row_number().over(order)).select("job_id", "line", "code", "name", "quantity", "price")


def learned(rows: DataFrame) -> Column:
    """Whether a replacement teaches: its snapshot is stored, or it was searched for a line without any match."""
    return F.coalesce("learning_snapshot_saved", F.lit(False)) | ((_text("selected_via") == "manual_search") & (_text("initial_status") == NOT_FOUND))


def audit_events(jobs: DataFrame, rows: DataFrame) -> DataFrame:
    """An export event for each job that was saved, with its replacements."""
    analog = F.col("approved_analog")
    marked = rows.withColumn("_learned", learned(rows))
    replacement = F.struct(F.col("row_no"), F.col("row_id"), F.col("name"), F.col("requested_qty"), F.col("initial_status"), F.col("status").alias("final_status"), F.col("selected_via"), analog["code_1c"].alias("candidate_code"), analog["name"].alias("candidate_name"), analog["score"].alias("candidate_score"), F.col("_learned").alias("learned_on_export"))
    # a job's own replacements are gathered
    counted = marked.groupBy("job_id").agg(
        F.count("*").alias("total_rows"), F.count_if(analog.isNotNull()).alias("replacement_count"), F.count_if(analog.isNotNull() & (F.col("selected_via") == "manual_search")).alias("manual_search_replacement_count"),
        F.count_if(analog.isNotNull() & F.col("_learned")).alias("learned_replacement_count"), F.array_sort(F.collect_list(F.when(analog.isNotNull(), replacement))).alias("replacements"),
    )
    saved = jobs.where(_text("saved_at") != "")
    event = F.concat_ws(":", F.col("job_id").cast("string"), F.lit("export"), F.coalesce("export_count", F.lit(0)).cast("string"))
    return saved.join(counted, "job_id", "left").select(event.alias("export_event_id"), "job_id", F.coalesce("filename", F.col("job_id").cast("string")).alias("filename"), "saved_at", "saved_by", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total_rows", "replacement_count", "manual_search_replacement_count", "learned_replacement_count")], "replacements")


def feedback_entries(rows: DataFrame, visible_pool: str = "visible") -> DataFrame:
    """Entries that a job's choices teach: the chosen item approved, whatever else was shown rejected.

    ``rows`` has analogs, ``visible_pool`` (what a search showed) and
    previous_analog besides the row's own features.
    """
    chosen = F.col("approved_analog")
    with_choice = rows.where((_text(chosen["code_1c"]) != "") & (_text(chosen["name"]) != "")).withColumn("snapshot_id", F.concat_ws(":", F.col("job_id").cast("string"), F.col("row_id").cast("string")))
    via = selection_source(F.col("selected_via"), chosen["code_1c"], F.transform("analogs", lambda a: a["code_1c"]), F.col("selection_search_query"))
    base = with_choice.withColumns({"selected_via": via, "learning_confidence": selection_confidence(via, F.col("dimension_tags"), F.col("key_tokens")), "_previous": F.when(F.col("previous_analog").isNotNull(), F.array("previous_analog"))})
    common = ["snapshot_id", "job_id", "row_id", "query", "query_key", "selected_via", "learning_confidence", "selected_by", "selected_at"]
    approved = base.select(*common, F.upper(F.trim(chosen["code_1c"])).alias("code_key"), F.trim(chosen["name"]).alias("candidate_name"), F.lit("approved").alias("decision"))
    pool = merged_pool(base, ["snapshot_id"], ["analogs", visible_pool, "_previous"])
    others = pool.join(approved.select("snapshot_id", "code_key"), ["snapshot_id", "code_key"], "left_anti").join(base.select(*common), "snapshot_id")
    rejected = others.select(*common, "code_key", F.col("name").alias("candidate_name"), F.lit("rejected").alias("decision"))
    entries = approved.unionByName(rejected)
    return entries.withColumn("record_id", F.concat_ws(":", "snapshot_id", "decision", "code_key")).withColumnRenamed("code_key", "candidate_code")


def stored_feedback(current: DataFrame, entries: DataFrame) -> DataFrame:
    """The store after entries: those of their snapshots go first."""
    return upsert(current, entries, ["snapshot_id"])


def backfill(current: DataFrame, entries: DataFrame) -> DataFrame:
    """The store with the entries of snapshots it doesn't have; nothing that it has changes; entries without a user are left out."""
    fresh = entries.where(_text("selected_by") != "").join(current.select("snapshot_id").distinct(), "snapshot_id", "left_anti")
    return current.unionByName(fresh)


def migrated(current: DataFrame, legacy: DataFrame) -> DataFrame:
    """The old entries if the store has none yet, else the store."""
    return legacy if current.isEmpty() else current


def suggested_search(name: Column, mark: Column, matched_code: Column, most: int = 80) -> Column:
    """What to search for first: the name with a mark that tells something, or with a matched code that has digits, unless it is in the name; ``most`` characters."""
    said, tells, code = _text(name), _text(mark), _text(matched_code)
    generic = (tells == "") | F.upper(tells).rlike("^[A-ZА-Я]{1,3}$")
    new = lambda x: (x != "") & ~F.lower(said).contains(F.lower(x))
    text = F.when(said == "", F.when(tells != "", tells).otherwise(code)).when(~generic & new(tells), F.concat_ws(" ", said, tells)).when(code.rlike("[0-9]") & new(code), F.concat_ws(" ", said, code)).otherwise(said)
    return F.substring(text, 1, most)

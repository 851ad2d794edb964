"""Other inputs: files with their hashes and labels, user directory, stored jobs, reviewed workbooks, rule files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.features import search_text
from ..functions.hints import Rules
from ..operators.analytics import input_hash
from .stock import SHEET, load_stock, newest_files, sheet_parts, workbook_rows

# The order of warehouses, and the colour that marks a rejection.
WAREHOUSES = ("ЭК", "Сантехкомплект", "СантехСтандарт")
REJECTED_COLOUR = "FF0000"


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, name, modificationTime, length and sha256, sha1 of the files that match."""
    found = spark.read.format("binaryFile").load(path)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "modificationTime", "length", F.sha2("content", 256).alias("sha256"), F.sha1("content").alias("sha1"))


def inferred_label(name: Column, given: Column) -> Column:
    """A file's warehouse: as given, else by its name."""
    lowered = F.lower(name)
    return F.when(F.trim(F.coalesce(given, F.lit(""))) != "", F.trim(given)).when(lowered.contains("сантех") | lowered.contains("santeh"), WAREHOUSES[1]).otherwise(WAREHOUSES[0])


def stock_files(found: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """label and path of the newest stock file of each warehouse, in the warehouses' order (column place)."""
    names = F.create_map(*[F.lit(x) for pair in (labels or {"": ""}).items() for x in pair])
    usable = found.where(F.lower("name").rlike(r"\.(csv|xlsx|xlsm)$"))
    newest = newest_files(usable.withColumn("label", inferred_label(F.col("name"), F.try_element_at(names, F.col("name")))))
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, WAREHOUSES)), F.col("label")).cast("int"), F.lit(0)), F.lit(10))
    return newest.withColumn("place", place)


def all_stock(spark: SparkSession, path: str, labels: dict[str, str] | None = None) -> DataFrame:
    """The items of all warehouses, each from its newest file; warehouses are few, and are listed on the driver."""
    out = None
    for f in stock_files(files(spark, path), labels).orderBy("place", "path").collect():
        items = load_stock(spark, f.path, f.label)
        out = items if out is None else out.unionByName(items)
    if out is None:
        raise ValueError(f"there is no stock file in {path}")
    return out


def scope_fingerprint(found: DataFrame) -> DataFrame:
    """One text that changes with any file: name, time and label of each, sorted."""
    each = F.concat_ws(":", "name", F.unix_micros("modificationTime").cast("string"), "label")
    return found.agg(F.sha1(F.concat_ws("|", F.array_sort(F.collect_list(each)))).alias("scope"))


def cache_key(scope: Column, content: Column, *others: Column) -> Column:
    """Key of a stored result: the scope, the content's hash, and what else was asked."""
    return F.sha1(F.concat_ws("|", scope, content, *[F.lower(F.trim(F.regexp_replace(o.cast("string"), r"\s+", " "))) for o in others]))


def rule_metadata(found: DataFrame, versions: dict[str, str]) -> DataFrame:
    """name, sha256 and version of each rule file."""
    known = F.create_map(*[F.lit(x) for pair in (versions or {"": ""}).items() for x in pair])
    return found.select("name", "sha256", F.coalesce(F.try_element_at(known, F.col("name")), F.lit("")).alias("version"))


def users(spark: SparkSession, path: str) -> DataFrame:
    """username, display_name, role and password_sha256 of a user file; incomplete entries are left out."""
    entries = spark.read.schema("users array<struct<username:string,display_name:string,role:string,password_sha256:string>>").option("multiLine", True).json(path)
    read = entries.select(F.explode("users").alias("u")).select(F.lower(F.trim("u.username")).alias("username"), F.trim("u.display_name").alias("display_name"), F.lower(F.trim("u.role")).alias("role"), F.lower(F.trim("u.password_sha256")).alias("password_sha256"))
    return read.where("username != '' and password_sha256 != ''").withColumns({"display_name": F.coalesce(F.nullif("display_name", F.lit("")), "username"), "role": F.coalesce(F.nullif("role", F.lit("")), F.lit("manager"))}).dropDuplicates(["username"])


JOB = "job_id string, filename string, created_at double, created_by string, saved_at string, saved_by string, export_count int, job_status string, rows array<struct<id:string,name:string,requested_qty:double,status:string,matched_code:string,available_qty:double,selected_via:string>>"


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Stored jobs below a folder, a document each; a job without id has that of its folder."""
    read = spark.read.schema(JOB).option("multiLine", True).option("mode", "PERMISSIVE").json(f"{folder}/*/result.json")
    place = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return read.withColumn("job_id", F.coalesce(F.nullif(F.trim("job_id"), F.lit("")), place))


def store_job(documents: DataFrame, folder: str) -> None:
    """Overwrite the documents of the jobs in ``documents``; the folders of other jobs stay as they are."""
    spark = documents.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        documents.repartition("job_id").write.partitionBy("job_id").mode("overwrite").json(folder)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def _red_cells(book: zipfile.ZipFile, part: str) -> set[str]:
    """References of the cells with the solid fill that marks a rejection."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    style = ElementTree.fromstring(book.read("xl/styles.xml"))
    fills = style.find(f"{SHEET}fills")
    colours = []
    for fill in fills if fills is not None else ():
        pattern, colour = fill.find(f"{SHEET}patternFill"), fill.find(f"{SHEET}patternFill/{SHEET}fgColor")
        colours.append((colour.get("rgb") or "")[-6:].upper() if pattern is not None and pattern.get("patternType") == "solid" and colour is not None else "")
    formats = style.find(f"{SHEET}cellXfs")
    red = {k for k, x in enumerate(formats if formats is not None else ()) if int(x.get("fillId") or 0) < len(colours) and colours[int(x.get("fillId") or 0)] == REJECTED_COLOUR}
    return {c.get("r") or "" for c in ElementTree.fromstring(book.read(part)).iter(f"{SHEET}c") if int(c.get("s") or 0) in red}


def reviewed_rows(data: bytes) -> list[tuple[str, int, str, str, str]]:
    """sheet, row, query, code and decision of a reviewed workbook: the first cell is the query, a further one "code | name" a candidate, red ones rejected."""
    book = zipfile.ZipFile(io.BytesIO(data))
    red = {name: _red_cells(book, part) for name, part in sheet_parts(book)}
    out = []
    for sheet, row, cells in workbook_rows(data):
        query = cells[0].strip()
        for k, cell in enumerate(cells[1:], 1):
            code = re.split(r"\s*\|\s*", cell.strip(), maxsplit=1)[0].strip()
            if row > 1 and query and "|" in cell and code:
                out.append((sheet, row, query, code.upper(), "rejected" if f"{chr(65 + k)}{row}" in red[sheet] else "approved"))
    return out


def reviewed(spark: SparkSession, path: str, rules: Rules | None = None) -> DataFrame:
    """sheet, source_row, query, query_key, code and decision of the reviewed workbooks that match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = reviewed_rows(data)
                yield pa.record_batch([pa.array([r[k] for r in rows], pa.int64() if k == 1 else pa.string()) for k in range(5)], names=["sheet", "source_row", "query", "code", "decision"])

    read = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "sheet string, source_row long, query string, code string, decision string")
    return read.withColumn("query_key", search_text(F.col("query"), rules)).where("query_key != ''")


def reviewed_json(spark: SparkSession, path: str, rules: Rules | None = None) -> DataFrame:
    """query_key, code and decision of a file of decisions; entries without key, code or a known decision are left out."""
    read = spark.read.schema("decisions array<struct<query:string,query_key:string,candidate_code:string,decision:string>>").option("multiLine", True).json(path).select(F.explode("decisions").alias("d")).select("d.*")
    key = F.coalesce(F.nullif(F.trim(F.coalesce("query_key", F.lit(""))), F.lit("")), search_text(F.col("query"), rules), F.lit(""))
    return read.select(key.alias("query_key"), F.upper(F.trim("candidate_code")).alias("code"), F.lower(F.trim("decision")).alias("decision")).where("query_key != '' and code != '' and decision in ('approved', 'rejected')")


def combined_hash(found: DataFrame) -> DataFrame:
    return input_hash(found)

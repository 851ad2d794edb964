"""Readers of stock files and requests: delimited text of unknown encoding, workbooks, word documents."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.features import features
from ..functions.hints import Rules
from ..functions.text import clean_text, parse_quantity
from ..operators import requests
from . import documents

# Headers of stock files and what they hold; of several for one field the first in the file counts.
FIELDS = {
    "Код1с": "code", "код1с": "code", "Артикул": "code", "артикул": "code", "Номенклатура": "name", "номенклатура": "name", "Номенклатура, Характеристика": "name", "НаименованиДляПечати": "print_name", "ТипПродукта": "product_type",
    "ПродажнаяЦена": "sale_price", "Цена": "sale_price", "Цена клиента со скидкой": "sale_price", "СтопЦена": "stop_price", "ПлановаяЦена": "plan_price",
}
# Headers of quantities, best first.
QUANTITIES = ("Доступно", "доступно", "Остаток", "остаток", "В наличии", "Количество", "Свободный остаток")
COLUMNS = ("code", "name", "print_name", "product_type", "sale_price", "stop_price", "plan_price", "quantity")
ROWS = "path string, sheet string, sheet_no int, row long, cells array<string>"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def decode(data: bytes) -> str:
    """UTF-8 with or without a mark, else the Cyrillic code page; whole content is tried, so no letter is cut."""
    for encoding in ("utf-8-sig", "cp1251"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


def delimiter(lines: list[str]) -> str:
    head = lines[:20]
    return "\t" if sum(x.count("\t") for x in head) > sum(x.count(";") for x in head) else ";"


def text_rows(data: bytes) -> list[tuple[str, int, list[str]]]:
    lines = decode(data).splitlines()
    mark = delimiter(lines)
    return [("", k, [c.strip() for c in line.strip("\r\n ").split(mark)]) for k, line in enumerate(lines, 1) if line.strip()]


def sheet_parts(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Names of a workbook's sheets and the files that hold them, by the workbook's relationships; without any, by number."""
    names, relation = set(book.namelist()), "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    targets = {}
    if "xl/_rels/workbook.xml.rels" in names:
        for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
            target = r.get("Target") or ""
            targets[r.get("Id")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{SHEET}sheet")
    return [(s.get("name") or "", targets.get(s.get(relation), f"xl/worksheets/sheet{k}.xml")) for k, s in enumerate(sheets, 1)]


def workbook_rows(data: bytes) -> list[tuple[str, int, list[str]]]:
    """Cells of every sheet of an OOXML workbook, as text, gaps as empty cells."""
    book = zipfile.ZipFile(io.BytesIO(data))
    names = set(book.namelist())
    shared = ["".join(t.text or "" for t in item.iter(f"{SHEET}t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    out = []
    for name, part in sheet_parts(book):
        if part not in names:
            continue
        for k, row in enumerate(ElementTree.fromstring(book.read(part)).iter(f"{SHEET}row"), 1):
            cells: list[str] = []
            for cell in row.iter(f"{SHEET}c"):
                letters = re.match(r"[A-Z]+", cell.get("r") or "")
                at = len(cells)
                if letters:
                    at = 0
                    for ch in letters[0]:
                        at = at * 26 + ord(ch) - 64
                    at -= 1
                cells += [""] * (at - len(cells))
                value = cell.find(f"{SHEET}v")
                raw = "" if value is None else value.text or ""
                cells.append(shared[int(raw)] if cell.get("t") == "s" and raw else "".join(t.text or "" for t in cell.iter(f"{SHEET}t")) if cell.get("t") == "inlineStr" else raw)
            if any(c.strip() for c in cells):
                out.append((name, int(row.get("r") or k), cells))
    return out


def document_text(data: bytes) -> str:
    """Paragraphs of a word document."""
    word = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    return "\n".join(text for p in root.iter(f"{word}p") if (text := "".join(t.text or "" for t in p.iter(f"{word}t")).strip()))


def raw_rows(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, row and cells of every file that matches; one file is read by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                kind = name.rsplit(".", 1)[-1].lower()
                if kind in ("xlsx", "xlsm"):
                    rows = workbook_rows(data)
                elif kind == "docx":
                    rows = [("", k, [x]) for k, x in enumerate(document_text(data).split("\n"), 1) if x]
                elif kind in ("csv", "txt", "tsv"):
                    rows = text_rows(data)
                else:
                    raise ValueError(f"this kind of file isn't supported: {name}")
                number = {sheet: k for k, sheet in enumerate(dict.fromkeys(r[0] for r in rows))}
                yield pa.record_batch([pa.array([name] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.string()), pa.array([number[r[0]] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.string()))], names=["path", "sheet", "sheet_no", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, ROWS)


def load_stock(spark: SparkSession, path: str, label: str = "") -> DataFrame:
    """Stock items of files: the header is the first of the leading rows that knows two fields; rows need a first cell, a name and a positive quantity.

    row_index counts a file's rows after its header, before any is dropped.
    """
    read = raw_rows(spark, path).withColumn("cells", F.transform("cells", clean_text))
    # of a workbook the sheet of that name, else the first one
    named = F.max((F.lower(F.trim("sheet")) == "остатки").cast("int"))
    chosen = read.groupBy("path").agg(F.when(named == 1, F.max(F.when(F.lower(F.trim("sheet")) == "остатки", F.col("sheet")))).otherwise(F.min_by("sheet", "sheet_no")).alias("sheet"))
    rows = read.join(chosen, ["path", "sheet"])
    known = F.array(*[F.lit(h) for h in (*FIELDS, *QUANTITIES)])
    heads = rows.where((F.col("row") <= 30) & (F.size(F.array_intersect("cells", known)) >= 2)).groupBy("path", "sheet").agg(F.min_by("cells", "row").alias("header"), F.min("row").alias("header_row"))
    fields = F.create_map(*[F.lit(x) for pair in FIELDS.items() for x in pair])
    named = heads.withColumn("fields", F.transform("header", lambda h: F.try_element_at(fields, h)))
    quantity_at = F.coalesce(*[F.nullif(F.array_position("header", h).cast("int"), F.lit(0)) for h in QUANTITIES])
    # headers are one row a sheet
    joined = rows.join(named.withColumn("quantity_at", quantity_at), ["path", "sheet"]).where("row > header_row")
    cell = lambda field: F.coalesce(F.get("cells", F.array_position("fields", field).cast("int") - 1), F.lit(""))
    numbered = joined.withColumn("row_index", (F.col("row") - F.col("header_row")).cast("long"))
    out = numbered.select("path", "sheet", "row_index", *[cell(f).alias(f) for f in COLUMNS[:-1]], parse_quantity(F.get("cells", F.col("quantity_at") - 1)).alias("quantity"), F.lit(label).alias("source_label"), F.size("cells").alias("_n"), F.get("cells", F.lit(0)).alias("_first"))
    return out.where((F.col("_n") >= 3) & (F.col("_first") != "") & (F.col("name") != "") & (F.col("quantity") > 0)).drop("_n", "_first")


def newest_files(files: DataFrame) -> DataFrame:
    """The newest file (path, modificationTime) of each warehouse label."""
    return files.groupBy("label").agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def with_features(items: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Stock items with the features of their name, print name and type."""
    return items.withColumn("features", features([F.col("name"), F.col("print_name"), F.col("product_type")], rules))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, row and text of the lines of text and word files of any encoding."""
    return raw_lines(spark, path, lambda name, data: document_text(data) if name.lower().endswith(".docx") else decode(data))


def raw_lines(spark: SparkSession, path: str, read: Callable[[str, bytes], str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines = read(name, data).splitlines()
                yield pa.record_batch([pa.array([name] * len(lines), pa.string()), pa.array(range(1, len(lines) + 1), pa.int64()), pa.array(lines, pa.string())], names=["path", "row", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, row long, text string")


def request(spark: SparkSession, path: str, rules: Rules | None = None) -> tuple[DataFrame, DataFrame]:
    """Lines and issues of one kind of request files, by suffix: workbooks by sheet, delimited and free text, word documents, scans."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix in ("xlsx", "xlsm"):
        return requests.sheet_request(requests.without_service_sheets(raw_rows(spark, path)), rules)
    if suffix in ("csv", "tsv", "txt", "docx"):
        return requests.text_request(text_lines(spark, path), rules)
    read = documents.document_lines(spark, path)
    lines, issues = requests.text_request(requests.merge_wrapped(read.where("text is not null and kind = 'image'").select("path", "row", "text"), rules).unionByName(read.where("text is not null and kind != 'image'").select("path", "row", "text")), rules, scanned=True)
    warned = read.select("path", F.lit("").alias("sheet"), F.lit(0).cast("long").alias("row"), F.lit("").alias("raw"), F.explode("warnings").alias("reason")).distinct()
    mode = read.groupBy("path").agg(F.first("mode").alias("mode"))
    return lines.join(mode, "path").withColumn("status", F.concat_ws("_", "status", "mode")).drop("mode"), issues.unionByName(warned)

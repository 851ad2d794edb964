"""Client requests as rows of cells: where the header is, what its columns mean, and the lines below it."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import fixed, lines, nomenclature
from ..functions.hints import Rules
from ..functions.text import clean_text, normalize_unit, parse_quantity, parser_line

HEADER_ROWS, SAMPLE, LOOKED_AT = 30, 20, 52
HEADERS = "path string, sheet string, header_row long, last_header_row long, roles map<string,int>"


def _number(cell: str) -> float:
    try:
        return float(cell.replace("\xa0", "").replace(" ", "").replace(",", "."))
    except ValueError:
        return 0.0


def named_roles(cells: list[str]) -> dict[str, int]:
    """1-based column of each role that a header cell names; the first cell that does."""
    found: dict[str, int] = {}
    for at, text in enumerate((" ".join(nomenclature.search_words([c])) for c in cells), 1):
        for role, words in fixed.HEADER_WORDS.items():
            if role not in found and any(w in text for w in words):
                found[role] = at
    return found


#: What a cell looks like.
_LOOKS = {
    "numeric": lambda c: _number(c) > 0, "unit": lambda c: c.lower() in fixed.UNIT_CELLS, "position": lambda c: re.fullmatch(r"\d+(?:[./]\d+)*", c) is not None, "text": lambda c: any(map(str.isalpha, c)), "code": lambda c: bool(nomenclature.code_tokens([c])),
}


def filled_roles(named: dict[str, int], rows: list[list[str]]) -> dict[str, int]:
    """``named`` with the columns that the cells below suggest for the roles that no header names, each column for one role."""
    width = max(map(len, rows), default=0)
    looks = {}
    for at in range(1, width + 1):
        cells = [r[at - 1] for r in rows if len(r) >= at and r[at - 1]]
        looks[at] = {"filled": len(cells)} | {k: sum(map(f, cells)) for k, f in _LOOKS.items()}
    roles = dict(named)
    # role: what its columns have, and which of them is best
    wanted = {
        "name": (lambda x: x["text"], lambda at, x: (x["text"], x["filled"] - x["numeric"], -at)), "quantity": (lambda x: x["numeric"], lambda at, x: (x["numeric"], at)),
        "unit": (lambda x: x["unit"], lambda at, x: (x["unit"], -abs(at - roles.get("quantity", at)))), "position": (lambda x: x["position"] and x["text"] <= x["position"], lambda at, x: -at), "mark": (lambda x: x["code"], lambda at, x: (x["code"], x["text"], -at)),
    }
    for role, (fits, rank) in wanted.items():
        if role not in roles:
            open_ = [at for at, x in looks.items() if at not in roles.values() and fits(x)]
            if open_:
                roles[role] = max(open_, key=lambda at: rank(at, looks[at]))  # noqa: B023
    return roles


def header_score(headers: list[str], below: list[list[str]]) -> tuple[float, dict[str, int]]:
    """How well a header and the rows below it make a table, and the roles of its columns."""
    # fixed values: the points
    named = named_roles(headers)
    score = 3.0 * len(named) + sum(bool(h) for h in headers)
    if not score:
        return 0.0, named
    filled = [r for r in below if any(r)]
    roles = filled_roles(named, filled[:SAMPLE])
    score += sum({"name": 8.0, "quantity": 8.0, "position": 2.0, "unit": 2.0}.get(r, 0.0) for r in roles) + (6.0 if {"name", "quantity"} <= roles.keys() else 0.0)
    at = lambda row, role: row[roles[role] - 1] if role in roles and len(row) >= roles[role] else ""
    good = 0
    for row in filled[:12]:
        has_name, has_quantity = len(at(row, "name")) >= 3, _number(at(row, "quantity")) > 0
        good += has_name and has_quantity
        score += 0.6 * has_name + 0.8 * has_quantity + (0.25 if not (has_name and has_quantity) and at(row, "unit").lower() in fixed.UNIT_CELLS else 0.0)
    return score + 3.0 * good - (6.0 if filled and not good else 0.0), roles


def detect_headers(rows: DataFrame) -> DataFrame:
    """For each sheet of rows (path, sheet, row, cells) the header of one or two rows that scores best, if it leaves a name and a quantity.

    Only the leading rows are looked at, so a group is small.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        numbers, cells = pdf["row"].tolist(), [[nomenclature.clean(c) for c in row] for row in pdf["cells"]]
        best = (0.0, 0, 0, {})
        for k in range(min(len(cells), HEADER_ROWS)):
            for span in (1, 2):
                block = cells[k : k + span]
                if len(block) == span:
                    columns = [dict.fromkeys(r[c] for r in block if c < len(r) and r[c]) for c in range(max(map(len, block)))]
                    score, roles = header_score([" ".join(c) for c in columns], cells[k + span : k + span + SAMPLE])
                    if score > best[0]:
                        best = (score, k, k + span - 1, roles)
        _, first, last, roles = best
        out = [(pdf["path"].iloc[0], pdf["sheet"].iloc[0], int(numbers[first]), int(numbers[last]), roles)] if {"name", "quantity"} <= roles.keys() else []
        return pd.DataFrame(out, columns=["path", "sheet", "header_row", "last_header_row", "roles"])

    return rows.where(F.col("row") <= LOOKED_AT).groupBy("path", "sheet").applyInPandas(one, HEADERS)


def cell(role: str) -> Column:
    """A role's cell; an empty text if the column or the cell is missing."""
    return F.coalesce(F.get("cells", F.try_element_at("roles", F.lit(role)) - 1), F.lit(""))


def material_fields(name: Column, mark: Column, code: Column) -> tuple[Column, Column, Column]:
    """Name, else mark, else a code with letters stands for the name; what was used is blanked."""
    letters = code.rlike(r"(?U)\p{L}")
    from_mark = (name == "") & (mark != "")
    from_code = (name == "") & (mark == "") & letters
    return F.when(from_mark, mark).when(from_code, code).otherwise(name), F.when(from_mark, "").otherwise(mark), F.when(from_code, "").otherwise(code)


def _numbered(parsed: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Lines without a position of their own get their place among the parsed ones of their file and sheet."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return parsed.withColumn("position", F.coalesce(F.nullif("position", F.lit("")), place.cast("string")))


LINE = ("path", "sheet", "row", "position", "name", "mark", "supplier_code", "vendor", "unit", "quantity", "comment", "raw", "status", "confidence")


def table_lines(rows: DataFrame, headers: DataFrame, rules: Rules | None = None, status: str = "parsed_sheet") -> tuple[DataFrame, DataFrame]:
    """``LINE`` of the rows below the headers, and the rows that gave none with the reason."""
    rules = rules or Rules()
    filled = F.filter(F.transform("cells", clean_text), lambda c: c != "")
    joined = rows.join(headers, ["path", "sheet"]).where("row > last_header_row").withColumn("raw", F.array_join(filled, " | ")).where("raw != ''").where(~lines.is_ignored(F.col("raw"), rules))
    unit = F.coalesce(F.nullif(normalize_unit(cell("unit")), F.lit("")), F.lit("шт"))
    read = joined.select("path", "sheet", "row", "raw", clean_text(cell("position")).alias("position"), unit.alias("unit"), parse_quantity(cell("quantity")).alias("quantity"), clean_text(cell("vendor")).alias("vendor"), *[clean_text(cell(r)).alias(r) for r in ("name", "mark", "supplier_code")])
    bare = lines.without_noise(lines.without_quantity(lines.without_position(F.col("name"), F.col("position")), F.col("quantity"), F.col("unit")), rules)
    name, mark, code = material_fields(bare, lines.without_quantity(F.col("mark"), F.col("quantity"), F.col("unit")), F.col("supplier_code"))
    parsed = read.withColumns({"name": name, "mark": mark, "supplier_code": code, "comment": F.lit(""), "status": F.lit(status), "confidence": F.lit(fixed.QUANTITY_CONFIDENCE["sheet" if status == "parsed_sheet" else "delimited"])})
    good = (F.col("name") != "") & (F.col("quantity") > 0)
    reason = "в табличной строке не удалось выделить наименование и количество" if status == "parsed_sheet" else "строка не похожа на товарную позицию"
    return _numbered(parsed.where(good), ["path", "sheet"], ["row"]).select(*LINE), parsed.where(~good).select("path", "sheet", "row", "raw", F.lit(reason).alias("reason"))


def freeform_lines(texts: DataFrame, rules: Rules | None = None, status: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``LINE`` of free lines (path, sheet, row, text), and those that gave none with the reason; headers, greetings and ignored rows are neither."""
    read = texts.select("path", "sheet", "row", lines.parse_line(F.col("text"), rules).alias("p")).select("path", "sheet", "row", "p.*").where("status is not null")
    items = read.where("status != 'issue'").withColumn("mark", lines.mark_of(F.col("name"))).withColumn("supplier_code", F.lit(""))
    if status:
        items = items.withColumn("status", F.lit(status))
    return _numbered(items, ["path", "sheet"], ["row"]).select(*LINE), read.where("status = 'issue'").select("path", "sheet", "row", "raw", "reason")


def sheet_request(rows: DataFrame, rules: Rules | None = None) -> tuple[DataFrame, DataFrame]:
    """Lines and issues of workbooks (path, sheet, row, cells): as tables; sheets that give no line are read as free text."""
    parsed, issues = table_lines(rows, detect_headers(rows), rules)
    flat = rows.join(parsed.select("path", "sheet").distinct(), ["path", "sheet"], "left_anti").select("path", "sheet", "row", F.array_join(F.filter(F.transform("cells", clean_text), lambda c: c != ""), " ; ").alias("text")).where("text != ''")
    free, more = freeform_lines(flat, rules, "parsed_sheet_fallback")
    return parsed.unionByName(free), issues.unionByName(more)


def text_request(texts: DataFrame, rules: Rules | None = None, scanned: bool = False) -> tuple[DataFrame, DataFrame]:
    """Lines and issues of text files (path, row, text): delimited if the first line that isn't blank holds a tab, semicolon or bar, else free.

    Of a delimited file that gives no line, and of a ``scanned`` one without a
    header that gives more as free text, the free lines count.
    """
    filled = texts.where(F.trim("text") != "").withColumn("sheet", F.lit(""))
    first = filled.groupBy("path").agg(F.min_by("text", "row").alias("first"))
    mark = F.when(F.col("first").contains("\t"), "\t").when(F.col("first").contains(";"), ";").when(F.col("first").contains("|"), "|")
    marked = filled.join(first.select("path", "first", mark.alias("mark")), "path")
    rows = marked.where("mark is not null").select("path", "sheet", "row", F.transform(F.split("text", F.concat(F.lit("\\Q"), "mark", F.lit("\\E")), -1), F.trim).alias("cells"))
    parsed, issues = table_lines(rows, detect_headers(rows), rules, "parsed_table_text")
    plain = marked.select("path", "sheet", "row", F.when(F.col("mark").isNotNull() & F.lit(scanned), F.translate("text", "\t;|", "   ")).otherwise(F.col("text")).alias("text"))
    free, more = freeform_lines(plain, rules)
    counted = lambda d, k: d.groupBy("path").agg(F.count("*").alias(k))
    sizes = first.withColumn("mark", mark).join(counted(parsed, "tabled"), "path", "left").join(counted(free, "free"), "path", "left").fillna({"tabled": 0, "free": 0})
    better = F.lit(scanned) & ~lines.looks_like_header(F.translate("first", "\t;|", "   ")) & (F.col("free") > F.col("tabled"))
    as_table = sizes.where(F.col("mark").isNotNull() & (F.col("tabled") > 0) & ~better).select("path")
    pick = lambda table, other: table.join(as_table, "path", "left_semi").unionByName(other.join(as_table, "path", "left_anti"))
    return pick(parsed, free), pick(issues, more)


def merge_wrapped(texts: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Lines (path, row, text) of scanned documents with an item that was wrapped put together again.

    A line without a quantity takes the next one's body if together they are an
    item with a quantity, and the line alone is none, or one of less
    confidence; the next line is then used up, so a file is read in order, as
    one group of its own lines.
    """
    order = W.partitionBy("path").orderBy("row")
    body = lines.leading_marker(F.col("next"))["body"]
    both = texts.where(F.trim("text") != "").withColumn("text", F.trim("text")).withColumn("next", F.lead("text").over(order)).withColumn("both", F.when(F.col("next").isNotNull(), F.concat_ws(" ", "text", body)))
    alone, joint = lines.parse_line(F.col("text"), rules), lines.parse_line(F.col("both"), rules)
    read = both.select("path", "row", "text", "both", lines.quantity_of_line(parser_line(F.col("text"))).isNotNull().alias("has"), alone.alias("a"), joint.alias("j"))
    weak = F.coalesce(F.col("a.status"), F.lit("issue")).isin("issue", "parsed_text_default_qty")
    joins = ~F.col("has") & F.col("both").isNotNull() & (F.coalesce(F.col("j.status"), F.lit("")) == "parsed_text") & (weak | (F.col("j.confidence") > F.col("a.confidence")))
    marked = read.select("path", "row", "text", "both", F.coalesce(joins, F.lit(False)).alias("joins"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out, used = [], False
        for r in pdf.sort_values("row").itertuples():
            if used:
                used = False
            else:
                used = bool(r.joins)
                out.append((r.path, int(r.row), r.both if used else r.text))
        return pd.DataFrame(out, columns=["path", "row", "text"])

    return marked.groupBy("path").applyInPandas(one, "path string, row long, text string")


def without_service_sheets(rows: DataFrame) -> DataFrame:
    """Rows of the sheets that hold request lines: summaries and lists of issues are left out."""
    # fixed values: the names
    return rows.where(~F.lower(F.trim("sheet")).isin("сводка", "проблемы", "summary", "issues"))

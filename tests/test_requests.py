"""Headers, table rows, free lines and wrapped lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from stocklink.functions import lines
from stocklink.functions.hints import Rules
from stocklink.operators import requests

ROWS = [
    ("f", "a", 1, ["Заявка", "", "", ""]), ("f", "a", 2, ["№", "Наименование", "Ед.", "Кол-"]), ("f", "a", 3, ["п/п", "и характеристика", "изм.", "кол-во"]), ("f", "a", 4, ["1", "1. Кран шаровой 10 шт", "штука", "10"]), ("f", "a", 5, ["2", "", "", "5"]),
    ("f", "a", 6, ["", "Труба", "", "0"]), ("f", "a", 7, ["", "", "", ""]), ("f", "a", 8, ["", "Муфта", "м", "2"]), ("g", "", 1, ["Добрый день"]), ("g", "", 2, ["Отвод 57 5 шт"]), ("g", "", 3, ["Муфта", "2 шт"]),
]


def test_sheets_as_tables_and_as_free_text(spark):
    rows = spark.createDataFrame(ROWS, "path string, sheet string, row long, cells array<string>")
    headers = requests.detect_headers(rows)
    found = headers.collect()
    assert [(h.path, h.header_row, h.last_header_row) for h in found] == [("f", 2, 3)] and found[0].roles == {"position": 1, "name": 2, "unit": 3, "quantity": 4}
    parsed, issues = requests.sheet_request(rows)
    got = sorted((r.path, r.row, r.position, r.name, r.unit, r.quantity, r.status) for r in parsed.collect())
    assert got == [("f", 4, "1", "Кран шаровой 10 шт", "штука", 10.0, "parsed_sheet"), ("f", 8, "2", "Муфта", "м", 2.0, "parsed_sheet"), ("g", 2, "1", "Отвод 57", "шт", 5.0, "parsed_sheet_fallback"), ("g", 3, "2", "Муфта", "шт", 2.0, "parsed_sheet_fallback")]
    assert sorted((r.path, r.row) for r in issues.collect()) == [("f", 5), ("f", 6)]


def test_delimited_and_free_text_files(spark):
    texts = [("a", 1, "Позиция;Наименование;Ед. изм.;Количество"), ("a", 2, "1;Кран 2 шт;шт;2"), ("a", 3, "2;;шт;1"), ("b", 1, "нужны краны"), ("b", 2, "1) Труба 57х3,5 - 12 м, срочно"), ("b", 3, "ок")]
    parsed, issues = requests.text_request(spark.createDataFrame(texts, "path string, row long, text string"))
    assert sorted((r.path, r.name, r.quantity, r.unit, r.comment, r.confidence) for r in parsed.collect()) == [("a", "Кран", 2.0, "шт", "", 0.98), ("b", "Труба 57х3,5", 12.0, "м", "срочно", 0.92)]
    assert sorted((r.path, r.row) for r in issues.collect()) == [("a", 3), ("b", 3)]


def test_scanned_rows_between_bars(spark):
    """Without a header more is read as free text, with one the table counts."""
    free = [("x", 1, "1 | Кран шаровой DN50 | 6 шт"), ("x", 2, "2 | Фильтр DN50 | 3 шт")]
    parsed, _ = requests.text_request(spark.createDataFrame(free, "path string, row long, text string"), scanned=True)
    assert sorted(r.quantity for r in parsed.collect()) == [3.0, 6.0] and all(r.status.startswith("parsed_text") for r in parsed.collect())
    table = [("y", 1, "Позиция | Наименование | Ед. изм. | Количество"), ("y", 2, "1 | Кран шаровой DN50 | шт | 16")]
    parsed, _ = requests.text_request(spark.createDataFrame(table, "path string, row long, text string"), scanned=True)
    assert [(r.quantity, r.unit, r.status) for r in parsed.collect()] == [(16.0, "шт", "parsed_table_text")]


def test_wrapped_lines(spark):
    wrapped = [("f", 1, "1. Труба стальная"), ("f", 2, "электросварная 480 м"), ("f", 3, "2. Кран 3 шт"), ("f", 4, "Примечание"), ("f", 5, "3. Муфта 5 шт")]
    got = requests.merge_wrapped(spark.createDataFrame(wrapped, "path string, row long, text string")).orderBy("row").collect()
    assert [r.text for r in got] == ["1. Труба стальная электросварная 480 м", "2. Кран 3 шт", "Примечание Муфта 5 шт"]


QUANTITIES = {
    "1. Кран шаровой 10 шт": ("1", "Кран шаровой", 10.0, "шт", 0.92), "- Труба кол-во 5 м": ("", "Труба", 5.0, "м", 0.95), "Муфта шт. 7": ("", "Муфта", 7.0, "шт", 0.93), "Отвод x 3": ("", "Отвод", 3.0, "шт", 0.84),
    "2 компл хомут": ("", "хомут", 2.0, "компл", 0.80), "Хомут": ("", "Хомут", 1.0, "шт", 0.45), "Кран пара 4": ("", "Кран", 4.0, "пара", 0.93), "Плёнка 3 м2": ("", "Плёнка 3", 2.0, "м", 0.93),
}


def test_quantities(spark):
    rows = spark.createDataFrame([(k,) for k in QUANTITIES], "v string").select("v", lines.parse_line(F.col("v")).alias("p")).collect()
    assert {r.v: (r.p.position, r.p.name, r.p.quantity, r.p.unit, r.p.confidence) for r in rows} == QUANTITIES


def test_parts_of_a_line(spark):
    rules = Rules.load({"query_understanding": {"preprocessing": {"ignore_full_row_patterns": ["^\\s*раздел:"]}}})
    t = F.lit
    wanted = {
        "position": (lines.without_position(t("3. Кран"), t("3")), "Кран"), "number": (lines.without_position(t("12/1 Кран"), t("")), "Кран"), "quantity": (lines.without_quantity(t("Кран 5 шт"), t(5.0), t("шт")), "Кран"), "other": (lines.without_quantity(t("Кран 5 шт"), t(4.0), t("шт")), "Кран 5 шт"),
        "vendor": (lines.vendor_of(t("Кран производитель: Valtec")), ("Кран", "Valtec")), "none": (lines.vendor_of(t("Кран (12)")), ("Кран (12)", "")), "comment": (lines.comment_of(t("Кран, срочно до пятницы")), ("Кран", "срочно до пятницы")),
        "header": (lines.looks_like_header(t("Наименование Кол-во")), True), "item": (lines.looks_like_header(t("Кран")), False), "greeting": (lines.is_greeting(t("Добрый день")), True), "asked": (lines.is_greeting(t("нужны 5 кранов")), False),
        "ignored": (lines.is_ignored(t("Раздел: трубы"), rules), True), "blank": (lines.is_ignored(t(" "), rules), True), "kept": (lines.is_ignored(t("Трубы"), rules), False),
    }
    got = spark.range(1).select(*[c.alias(k) for k, (c, _) in wanted.items()]).first()
    assert {k: tuple(got[k]) if isinstance(got[k], tuple) else got[k] for k in wanted} == {k: v for k, (_, v) in wanted.items()}
    marks = spark.createDataFrame([("Кран 11с67п DN50",), ("Кран шаровой",)], "v string").select(lines.mark_of(F.col("v")).alias("m")).collect()
    assert [r.m for r in marks] == ["11с67п", ""]

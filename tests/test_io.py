"""Stock files, outputs and intake."""

from __future__ import annotations

import zipfile

from pyspark.sql import functions as F

from stocklink.operators.allocate import FULL, NOT_FOUND, SAFE
from stocklink.sinks import outputs
from stocklink.sources import stock
from stocklink.streaming import intake


def test_csv_stock_in_either_encoding(spark, tmp_path):
    body = "склад;;\nАртикул;Номенклатура;Остаток;Доступно\nA1;Кран;10;7\n;итог;1;1\nA2;Труба;5;0\nA3;Отвод;1 000;2,5\nраздел\n"
    (tmp_path / "a.csv").write_bytes(body.encode("cp1251"))
    (tmp_path / "b.csv").write_bytes(b"\xef\xbb\xbf" + body.replace(";", "\t").encode())
    got = stock.load_stock(spark, str(tmp_path), "main").orderBy("path", "row_index").collect()
    assert [(r.row_index, r.code, r.name, r.quantity) for r in got] == [(1, "A1", "Кран", 7.0), (4, "A3", "Отвод", 2.5)] * 2


def workbook(path, rows):
    cells = lambda k, row: "".join(f'<c r="{chr(65 + i)}{k}" t="inlineStr"><is><t>{v}</t></is></c>' for i, v in enumerate(row) if v)
    sheet = "".join(f'<row r="{k}">{cells(k, row)}</row>' for k, row in enumerate(rows, 1))
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as out:
        out.writestr("xl/workbook.xml", f'<workbook {space}><sheets><sheet name="остатки"/></sheets></workbook>')
        out.writestr("xl/worksheets/sheet1.xml", f"<worksheet {space}><sheetData>{sheet}</sheetData></worksheet>")


def test_workbook_and_document(spark, tmp_path):
    workbook(tmp_path / "s.xlsx", [["Артикул", "Номенклатура", "Свободный остаток", "Цена"], ["X1", "Клапан", "3", "10"], ["X2", "", "4", "1"]])
    got = stock.load_stock(spark, str(tmp_path / "s.xlsx")).collect()
    assert [(r.code, r.name, r.quantity, r.sale_price) for r in got] == [("X1", "Клапан", 3.0, "10")]
    word = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as out:
        out.writestr("word/document.xml", f"<w:document {word}><w:body><w:p><w:r><w:t>Кран </w:t><w:t>10 шт</w:t></w:r></w:p><w:p/></w:body></w:document>")
    assert [r.cells for r in stock.raw_rows(spark, str(tmp_path / "d.docx")).collect()] == [["Кран 10 шт"]]


def test_newest_files(spark):
    files = spark.createDataFrame([("a", "x", 1), ("b", "x", 2), ("c", "y", 1)], "path string, label string, modificationTime int")
    assert {(r.label, r.path) for r in stock.newest_files(files).collect()} == {("x", "b"), ("y", "c")}


def test_outputs(spark, tmp_path):
    rows = [("f", "s", 2, "n2", "C2", FULL, 3.0, 3.0, 0.0, 5.0, 7.0, []), ("f", "s", 1, "n1", None, SAFE, 2.0, 0.0, None, None, None, ["a", "b"]), ("f", "s", 3, "n3", None, NOT_FOUND, 1.0, 0.0, None, None, None, ["z"])]
    results = spark.createDataFrame(rows, "source_file string, sheet_name string, source_row int, name string, code string, status string, requested double, allocated double, sale_price double, stop_price double, plan_price double, analogs array<string>")
    outputs.write_outputs(results, str(tmp_path))
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}").collect()
    assert [r.source_row for r in read("detailed")] == [1, 2, 3] and read("export")[0].price == 5.0
    assert read("analogs")[0].analog_2 == "b" and read("unmatched")[0].best_candidate == "z" and len(read("summary")) == 3


def test_replace_keys(spark, tmp_path):
    first = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    outputs.replace_keys(str(tmp_path), first, ["k"], 0)
    where = outputs.replace_keys(str(tmp_path), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"], 1)
    assert {(r.k, r.v) for r in spark.read.parquet(where).collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_intake_goes_on_from_its_checkpoint(spark, tmp_path):
    folder, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    folder.mkdir()
    (folder / "a.txt").write_text("Кран 10 шт\n\nКран 10 шт\n")
    intake.store(intake.requests(spark, str(folder)), out, mark).awaitTermination()
    (folder / "b.txt").write_text("Труба 5 м\n")
    intake.store(intake.requests(spark, str(folder)), out, mark).awaitTermination()
    assert sorted((r.name, r.quantity) for r in spark.read.parquet(out).collect()) == [("Кран", 10.0), ("Труба", 5.0)]


def test_windowed_counts(spark, sf_dir, tmp_path):
    source = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type", "value")
    source.write.parquet(str(tmp_path / "e"))
    stream = intake.windowed_counts(spark.readStream.schema(source.schema).parquet(str(tmp_path / "e")))
    query = stream.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] == source.count()

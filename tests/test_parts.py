"""Policies, memory, classifier text, documents, registry, outputs and the command line on small cases."""

from __future__ import annotations

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from stocklink import cli
from stocklink.functions import category_text
from stocklink.operators import classify, memory, policy
from stocklink.operators.allocate import FULL, NOT_FOUND, SAFE
from stocklink.plans import matching
from stocklink.sinks import outputs
from stocklink.sources import documents, registry, stock

CONFIG = {
    "global_phrase_aliases": {"кран шар": "кран шаровой", "пож рукав": "рукав пожарный"}, "global_token_aliases": {"фл": ["flanec"], "затв": ["zatvor"]}, "material_aliases": {"steel": ["stal", "stalnoi"]},
    "categories": [
        {"key": "flange", "label": "Фланец", "aliases": ["фланец"], "strong_tokens": {"flanec": 18.0}, "context_tokens": {"dn": 5.0}, "required_attributes": ["dn"]},
        {"key": "fire_hose", "label": "Рукав", "route": "manual_review", "aliases": ["рукав пожарный"], "strong_tokens": {"rukav": 14.0, "pozharnyi": 16.0}, "required_attributes": ["dn_or_length"]},
        {"key": "ball_valve", "label": "Кран шаровой", "aliases": ["кран шаровой"], "strong_tokens": {"kran": 12.0, "sharovoi": 16.0}, "blocker_tokens": ["zatvor"], "required_attributes": ["dn_or_inch"]},
        {"key": "butterfly_valve", "label": "Затвор", "aliases": ["затвор дисковый"], "strong_tokens": {"zatvor": 14.0, "diskovyi": 16.0}, "required_attributes": ["dn"]},
    ],
}


def test_classifier_reads_queries():
    registry_ = category_text.Registry.load(CONFIG)
    read = registry_.read("фл dn100")
    assert read["tokens"][:1] == ["flanec"] and dict(read["attributes"])["dn"] == ["100"]
    assert registry_.read("кран шар 1/2")["tokens"][:2] == ["kran", "sharovoi"] and dict(registry_.read("кран 1/2")["attributes"])["inch"] == ["1/2"]
    assert registry_.read("затвр дисквый dn100")["tokens"][:2] == ["zatvor", "diskovyi"]
    assert category_text.variants("dn50") == ["dn50", "dn", "50"] and category_text.variants("20m") == ["20m", "m", "20"]
    assert dict(registry_.read("труба стальной 20м угол 45")["attributes"]) | {"material": ["steel"], "length": ["20"], "angle": ["20", "45"]} is not None


def test_classifier_decides(spark):
    registry_ = category_text.Registry.load(CONFIG)
    queries = spark.createDataFrame([(1, "фл dn100"), (2, "пож рукав 20м"), (3, "манжета"), (4, "кран шар 1/2"), (5, "затвр дисквый dn100")], "query_id int, raw string")
    read = classify.read_queries(queries, "raw", registry_).cache()
    scores = classify.scored(read, classify.categories(spark, registry_.categories)).cache()
    got = {r.query_id: (r.category, r.status) for r in classify.classified(scores).collect()}
    assert got[1] == ("flange", "classified") and got[2][0] == "fire_hose" and got[2][1] == "needs_review" and got[3] == (None, "unclassified") and got[4] == ("ball_valve", "classified") and got[5][0] == "butterfly_valve"
    vectors = spark.createDataFrame([(4, [1.0, 0.0])], "query_id int, v array<float>")
    cats = spark.createDataFrame([("flange", [0.0, 1.0]), ("ball_valve", [1.0, 0.0])], "category string, v array<float>")
    moved = classify.reranked(scores, read, vectors, cats, {"confident_score": 101.0, "min_specificity": 0.0}).where("query_id = 4").collect()
    before = {r.category: r.total for r in scores.where("query_id = 4").collect()}
    assert {r.category: round(r.total - before[r.category], 6) for r in moved}["ball_valve"] == round(min(12.0, 100 - before["ball_valve"]), 6)


def test_policy_files(spark):
    table = {r.family: r for r in policy.load(spark, {"families": {"tee": {"allow_exact": True, "exact_required": ["family", "tripledn"], "safe_min_score": 56}, "x": "bad", "kran": {"analog_min_score": 46, "forbid_candidate_token_prefixes": "bad"}}}).collect()}
    assert sorted(table) == ["kran", "tee"] and table["tee"].analog_min == 44.0 and table["kran"].analog_min == 46.0 and table["kran"].forbid == []
    assert policy.load(spark, {"families": []}).count() == 0
    row = spark.createDataFrame([(["ocink"], ["truba", "ocinkovannaya"], ["truba"])], "p array<string>, s array<string>, o array<string>")
    assert row.select(policy.forbidden(F.col("p"), F.col("o"), F.col("s")).alias("a"), policy.forbidden(F.col("p"), F.col("s"), F.col("s")).alias("b")).first() == (True, False)


STOCK = [(1, "A1", "Фланец плоский DN100 PN16", 5.0), (2, "A2", "Фланец воротниковый DN100 PN16", 5.0), (3, "A3", "Кран шаровой DN50 PN16", 2.0)]


def test_memory_gives_signals_and_decisions(spark):
    rows = [("r1", "Кран шаровой DN50 PN16", "a1", "approved", 1.0), ("r2", "Фланец плоский DN100 PN16", "A2", "rejected", 0.9), ("r3", "Фланец плоский DN100", "A1", "approved", 0.5), ("r4", "", "A1", "approved", 1.0)]
    entries = memory.complete(spark.createDataFrame([(i, q, None, c, d, f, "2026") for i, q, c, d, f in rows], "record_id string, query string, query_key string, candidate_code string, decision string, learning_confidence double, updated_at string").selectExpr(
        "record_id", "query", "query_key", "cast(null as array<string>) order_key_tokens", "cast(null as array<string>) order_root_tokens", "cast(null as array<string>) order_dimension_tags", "cast(null as array<string>) structure_keys", "cast(null as map<string,array<string>>) structure_profile",
        "cast(null as string) manual_search_query", "cast(null as string) manual_search_query_key", "candidate_code", "decision", "cast(null as string) selected_via", "learning_confidence", "updated_at")).cache()
    assert {r.record_id for r in entries.collect()} == {"r1", "r2"}
    lines = spark.createDataFrame([(1, "Кран шаровой DN50 PN16", 1.0), (2, "Фланец плоский DN100 PN16", 1.0)], "id long, name string, requested double")
    items = spark.createDataFrame(STOCK, "id long, code string, name string, quantity double")
    results = matching.match(lines, items, ["name"], ["name"], ["id"], entries=entries).cache()
    got = {r.id: r for r in results.collect()}
    by_code = {c.stock_id: c for c in got[1].candidates}
    assert by_code[1].boost == 38.0 and by_code[1].allow and not by_code[1].compatible and "memory" in by_code[1].sources
    assert {c.stock_id: c.boost < 0 for c in got[2].candidates}[2]
    traced = matching.traces(results).where("id = 1 and stock_id = 1").first()
    assert traced.manual_override_used and traced.manual_learning_boost == 38.0
    keyed = memory.decisions(entries)
    assert {(r.code, r.decision) for r in keyed.collect()} == {("A1", "approved"), ("A2", "rejected")}


def test_policy_rules_in_a_match(spark):
    items = spark.createDataFrame([(1, "Тройник 57х57х45", 3.0), (2, "Тройник 57х57х32", 3.0)], "id long, name string, quantity double")
    lines = spark.createDataFrame([(1, "Тройник 57х57х45", 1.0)], "id long, name string, requested double")
    table = policy.load(spark, {"families": {"tee": {"allow_exact": True, "exact_required": ["family", "tripledn"], "exact_min_score": 10.0}, "perehod": {"allow_exact": True, "exact_required": ["tripledn"], "exact_min_score": 10.0}}})
    (got,) = matching.match(lines, items, ["name"], ["name"], ["id"], policies=table).collect()
    assert (got.stock_id, got.kind, got.status) in {(1, "exact", FULL)} and got.rule in (1, 2)


def test_boxes_make_rows():
    corners = lambda x, y, h=20: [[x, y], [x + 50, y], [x + 50, y + h], [x, y + h]]
    found = [[[corners(0, 0), ("Кран", 0.9)], [corners(60, 3), ("6 шт", 0.8)], [corners(0, 100), ("Фильтр", 0.9)], [corners(0, 122), ("латунный", 0.7)], [corners(0, 300), ("", 0.9)]]]
    rows = documents.rows_of(documents.boxes_of(found))
    assert [r.text for r in rows][0] == "Кран | 6 шт" and sum(len(r.boxes) for r in rows) == 4 and documents.rows_score(rows) > documents.rows_score(rows[:1]) > documents.rows_score([]) == 0.0


def test_documents_without_tools(spark, tmp_path, monkeypatch):
    assert documents.best([]).mode == "unreadable" and documents.best([documents.Attempt("a", 1, [(1, 1, "x", 0.5)], ["w"]), documents.Attempt("b", 1, [(1, 1, "longer text", 0.9)])]).mode == "b"
    with pytest.raises(ValueError, match="isn't supported"):
        documents.kind_of("x.doc")
    (tmp_path / "a.png").write_bytes(b"no image")
    got = documents.document_lines(spark, str(tmp_path / "a.png")).collect()
    assert len(got) == 1 and got[0].warnings
    lines, issues = stock.request(spark, str(tmp_path / "a.png"))
    assert lines.count() == 0 and issues.count() >= 1


def _book(path, rows, red):
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cells = lambda k, row: "".join(f'<c r="{chr(65 + i)}{k}" s="{int((i, k) in red)}" t="inlineStr"><is><t>{v}</t></is></c>' for i, v in enumerate(row))
    with zipfile.ZipFile(path, "w") as out:
        out.writestr("xl/workbook.xml", f'<workbook {space} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="other" r:id="r1"/><sheet name="остатки" r:id="r2"/></sheets></workbook>')
        out.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/second.xml"/><Relationship Id="r2" Target="worksheets/first.xml"/></Relationships>')
        out.writestr("xl/styles.xml", f'<styleSheet {space}><fills><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FFFF0000"/></patternFill></fill></fills><cellXfs><xf fillId="0"/><xf fillId="1"/></cellXfs></styleSheet>')
        out.writestr("xl/worksheets/first.xml", f"<worksheet {space}><sheetData>" + "".join(f'<row r="{k}">{cells(k, row)}</row>' for k, row in enumerate(rows, 1)) + "</sheetData></worksheet>")
        out.writestr("xl/worksheets/second.xml", f"<worksheet {space}><sheetData/></worksheet>")


def test_reviewed_workbook(spark, tmp_path):
    _book(tmp_path / "r.xlsx", [["Заявка", "Аналог 1", "Аналог 2"], ["Кран DN50", "a1 | Кран", "A2 | Кран"]], {(2, 2)})
    got = registry.reviewed(spark, str(tmp_path / "r.xlsx")).collect()
    assert {(r.sheet, r.query_key, r.code, r.decision) for r in got} == {("остатки", "kran dn50", "A1", "approved"), ("остатки", "kran dn50", "A2", "rejected")}


def test_registry_files(spark, tmp_path):
    (tmp_path / "u.json").write_text(json.dumps({"users": [{"username": " Ann ", "password_sha256": "X"}, {"username": "bob"}]}))
    assert [tuple(r) for r in registry.users(spark, str(tmp_path / "u.json")).collect()] == [("ann", "ann", "manager", "x")]
    (tmp_path / "d.json").write_text(json.dumps({"decisions": [{"query": "Кран", "candidate_code": "a1", "decision": "Approved"}, {"query_key": "k", "candidate_code": "b", "decision": "maybe"}]}))
    assert [tuple(r) for r in registry.reviewed_json(spark, str(tmp_path / "d.json")).collect()] == [("kran", "A1", "approved")]
    folder = tmp_path / "stock"
    folder.mkdir()
    for name, code in (("ostatki.csv", "A1"), ("santeh.csv", "B1")):
        (folder / name).write_text(f"Артикул;Номенклатура;Остаток\n{code};Кран;3\n")
    got = registry.all_stock(spark, str(folder)).collect()
    assert {(r.code, r.source_label) for r in got} == {("A1", "ЭК"), ("B1", "Сантехкомплект")}
    jobs = spark.createDataFrame([("j1", "f", "a"), ("j2", "g", "b")], "job_id string, filename string, created_by string")
    registry.store_job(jobs, str(tmp_path / "jobs"))
    registry.store_job(jobs.where("job_id = 'j2'").withColumn("filename", F.lit("new")), str(tmp_path / "jobs"))
    assert {(r.job_id, r.filename) for r in spark.read.json(str(tmp_path / "jobs")).collect()} == {("j1", "f"), ("j2", "new")}


def test_artifact_and_texts(spark, tmp_path):
    files = spark.createDataFrame([("b", "2"), ("a", "1")], "path string, sha256 string")
    metrics, rules = spark.createDataFrame([(3,)], "rows int"), spark.createDataFrame([("r", "9", "1.0")], "name string, sha256 string, version string")
    value = json.loads(outputs.artifact(files, metrics, rules, ["x"], F.lit("now")).first().value)
    assert [f["path"] for f in value["inputs"]] == ["a", "b"] and value["metrics"] == {"rows": 3} and len(value["combined_input_hash"]) == 64
    rows = spark.createDataFrame([("f", "s", 1, "Кран", SAFE, "c", 2.0, None, None, ["A1 | Кран"]), ("f", "s", 2, "Труба", NOT_FOUND, "требует ручного подбора", 1.0, None, None, [])], "source_file string, sheet_name string, source_row int, name string, status string, comment string, requested double, code string, item string, analogs array<string>")
    assert [(r.action, r.target) for r in outputs.manager_view(rows).collect()] == [("Подтвердить аналог", "A1 | Кран"), ("Ручной подбор", "")]


def test_command_line(capsys):
    assert cli.main(["extractors"]) == 0 and "tesseract" in capsys.readouterr().out
    asked = cli.parser().parse_args(["match", "a.csv", "--out", "o", "--stock", "s"])
    assert (asked.inputs, asked.stock, asked.memory) == (["a.csv"], "s", [])

"""Text, token, size and similarity functions on known values."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from stocklink.functions import dimensions, fuzzy, hints, nomenclature, text, tokens
from stocklink.functions.features import read_line
from stocklink.functions.hints import Rules


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    ("f", "value", "wanted"),
    [
        (text.clean_text, None, ""), (text.clean_text, "12.0", "12"), (text.clean_text, "  a b\t", "a b"), (text.candidate_code, " ab-1 ", "AB-1"), (text.manual_code, " АБ-1/x ", "аб1x"),
        (text.parse_quantity, "1 234,5", 1234.5), (text.parse_quantity, "nan", 0.0), (text.parse_quantity, "x", 0.0), (text.parse_price, "-1", None), (text.parse_price, "10,5", 10.5),
        (text.fix_mixed_script, "PЕ-xa", "PE-xa"), (text.fix_mixed_script, "Kран", "Кран"), (text.normalize_symbols, "Ø57×3,5", " dn 57x3.5"), (text.normalize_symbols, "½ 25 * 20", "1/2 25x20"),
        (text.transliterate, "Щётка ДУ50", "schetka dn50"), (text.transliterate, "Отвод 90° РУ16", "otvod 90 deg pn16"), (text.measure_value, "3,50", "3.5"), (text.measure_value, "100", "100"), (text.degree_value, "87.5", "87"),
        (text.normalize_unit, "штук", "шт"), (text.normalize_unit, "бухта", "бухта"), (text.hint_phrase, " Пож  рукАв ё ", "пож рукав е"), (text.flange_face, "В", "b"), (text.tag_value, "True", "true"),
        (text.format_number, "3", None),
    ],
)
def test_text(spark, f, value, wanted):
    if f is text.format_number:
        assert one(spark, 3.0, f, "double") == "3" and one(spark, 2.50, f, "double") == "2.5"
    else:
        assert one(spark, value, f) == wanted


def test_measures_and_inches(spark):
    assert one(spark, ["32", "20,0", "25"], text.sorted_measures, "array<string>") == "20x25x32"
    assert one(spark, "кран 1/2\" и 7/8\" и 3/4''", text.inch_sizes) == ["1/2", "3/4"]
    assert one(spark, "1/2", text.inch_to_dn) == "15" and one(spark, "9", text.inch_to_dn) is None


def test_tokens(spark):
    got = spark.createDataFrame([("kran sharovoi dn50 16 sht",)], "v string").select(tokens.tokens("v").alias("t")).select("t", tokens.key_tokens(F.col("t")).alias("k"), tokens.root_tokens(tokens.key_tokens(F.col("t"))).alias("r")).first()
    assert got.k == ["kran", "sharovoi", "dn50"] and got.r == ["kran", "sharo", "dn50"]
    assert one(spark, "Клапан КШ-50 dn50 57x3.5 abc", tokens.code_tokens) == ["kш-50"]
    assert one(spark, "57х3,5 и 108 x 4", tokens.size_pairs) == ["57x3.5", "108x4"]
    tags = ["dn:50", "dn:65", "family:kran", "family:perehod", "family:mufta"]
    assert one(spark, tags, lambda c: tokens.tag_values(c, "dn"), "array<string>") == ["50", "65"]
    assert one(spark, tags, tokens.tags_by_key, "array<string>") == {"dn": ["50", "65"], "family": ["kran", "mufta", "perehod"]}
    assert one(spark, tags, lambda c: tokens.primary_family(c, ("kran", "perehod", "mufta")), "array<string>") == "perehod"


CASES = [
    ("Отвод 45-2-57x4-20 ГОСТ 17375-2001", "deg:45 series:2 od:57 wall:4", "od:45 wall:2 od:20 dn:20"), ("Труба стальная водогазопроводная Ø21.3х2.8 ГОСТ 3262-75", "dn:15", ""), ("Труба ВГП 15-2,8 ГОСТ 3262-75 L=6м", "od:21.3", ""),
    ("Тройник переходной 25 х 25 х 20 мм Pilsa", "tripledn:20x25x25", ""), ("Тройник 45°, 110х110", "dn:110 pairdn:110x110", ""), ('Угольник переходной с внутренней резьбой 20х3/4" Valfex', "dn:20 inch:3/4", "inch:4 wall:3"),
    ("Колено чугунное напорное фланцевое Ду100", "dn:100 mclass:cast_iron", "od:100"), ("Американка FM 1 1/2'', AQUALINK 20/5", "inch:11/2", "inch:20/5"), ("Фланец 50-16-01-1-B ГОСТ 33259", "dn:50 pn:16 type:01 exec:1 face:b spec:33259", ""),
    ("Переход 273х7-219х6", "pairdn:219x273 dn:273 dn:219", ""), ("Переход 40x32x3.5 мм", "pairdn:32x40 wall:3.5 od:40", ""), ("Труба стальная 57х3,5 ГОСТ 10704-91", "od:57 wall:3.5 spec:10704 mclass:steel", ""), ("Кран шаровой КШ-50", "dn:50", ""),
    ("Отвод 90 57х3", "deg:90 od:57 wall:3", ""), ("Труба 08х18н10 57x4", "od:57 wall:4", "od:18"), ("Заглушка 108", "dn:108", ""), ("Тройник равнопроходной 32", "tripledn:32x32x32 dn:32", ""), ("Клапан kvs=6.3 Ру16 Ду50 L=230", "kvs:6.3 pn:16 dn:50 lmm:230", ""),
    ("Труба 110 мм", "dn:110 od:110", ""), ("Болт ст.20", "mat:20 grade:cs20", ""), ("Тройник 57х57х45х4", "tripledn:45x57x57 wall:4", ""), ("Отвод 87,5 110", "deg:87 dn:110", ""), ("Отвод dn 100/45", "dn:100 deg:45", ""), ("Фланец 8 отверстий", "hole:8", ""),
    ("Труба 57x3.5 нержавеющая aisi 304", "od:57 wall:3.5 mclass:stainless", "mclass:steel"), ("Манометр 0..1,6 МПа, 100мм", "family:manometer pressure_range_mpa:0-1.6 dn:100", ""), ("Редуктор F07 14х14 д/затв Ду125-150 четвертьоборотный Benarmo EURO", "family:gearbox for_family:zatvor mounting_pad:f07 stem_square:14x14 compatible_dn:125-150 turn_type:quarter_turn", ""),
    ("Муфта переходная вн/нар 32х25", "family:perehod subfamily:coupling subtype:inner_outer pairdn:25x32", ""), ("Задвижка с редуктором DN200", "operator:gearbox dn:200", "family:gearbox"), ("Труба d32", "dn:32 od:32", ""), ("Тройник ст.20 108х4", "", "od:20"),
]


@pytest.mark.parametrize(("line", "has", "lacks"), CASES)
def test_tags(line, has, lacks):
    got = set(read_line([line], Rules())["tags"])
    assert set(has.split()) <= got, got
    assert not set(lacks.split()) & got, got


def test_hints_of_rule_files(tmp_path):
    path = tmp_path / "hints.json"
    path.write_text(json.dumps({"query_understanding": {"token_aliases": {"american_union": ["американка"], "x": "no list"}, "family_triggers": {
        "manometr": {"aliases": ["манометр"], "resolve_rules": [{"match_any": ["снизу"], "require_family_alias": True, "set": {"connection_position": "bottom", "none": None}}, {"match_any": ["кл.1,5"], "set": {"accuracy_class": "1.5", "has_magnet": True}}, {"match_any": []}]}}}}))
    rules = Rules.load(path, {"family_aliases": {"siphon": ["sifon"]}, "manual_review_rules": [{"id": "s", "patterns": ["сифон"], "comment": "c"}, "bad"]})
    assert {"extra_connection:union", "family:mufta"} <= hints.hint_tags(["Американка 1/2"], rules)
    assert hints.hint_tags(["Манометр снизу, кл.1,5"], rules) >= {"family:manometer", "connection_position:bottom", "accuracy_class:1.5", "has_magnet:true"}
    assert "connection_position:bottom" not in hints.hint_tags(["Клапан снизу"], rules)
    assert "family:siphon" in read_line(["Сифон"], rules)["tags"] and read_line(["американка"], rules)["text"].startswith("american_union")
    assert hints.review_rule("Сифон 50", "", rules)["id"] == "s" and hints.review_rule("Кран", "kran", rules) is None
    (tmp_path / "bad.json").write_text("{")
    assert Rules.load(tmp_path / "bad.json") == Rules() == Rules.load(tmp_path / "missing.json")


def test_codes_and_sizes():
    assert nomenclature.code_tokens(["Кран КШЦП 11с67п DN50 ст20 57х3"]) == {"kshcp", "11c67p"}
    assert [nomenclature.is_strong_code(c) for c in ("11c67p", "57x3.5", "10704-91", "st20", "dn50", "g1/2", "aisi304")] == [True, False, False, False, False, True, False]
    assert nomenclature.size_pairs(["57х3,50 и 108 x 4"]) == {"57x3.5", "108x4"}


def test_expanded_and_structure(spark):
    m, tags = {"inch": ["1/2"], "pn": ["16"]}, ["family:kran", "inch:1/2", "pn:16"]
    row = spark.createDataFrame([(m, tags, ["kran", "sharovoi"])], "m map<string,array<string>>, t array<string>, k array<string>").select(dimensions.expanded(F.col("m")).alias("e"), "t", "k")
    got = row.select("e", dimensions.structure_keys(F.col("e"), F.col("t"), F.col("k"), F.lit("kran 1/2")).alias("s"), dimensions.profile(F.col("e"), F.col("t")).alias("p")).first()
    assert got.e == {"pn": ["16"], "dn": ["15"], "inch": ["1/2"]}
    assert got.s == ["family=kran|dn=15|inch=1/2|pn=16", "family=kran|dn=15|inch=1/2", "family=kran|dn=15|pn=16", "family=kran|tokens=kran,sharovoi", "tokens=kran,sharovoi", "kran 1/2"]
    assert got.p == {"family": ["kran"], "dn": ["15"], "pn": ["16"]}


def test_similarity():
    assert fuzzy.lcs_length("abcbdab", "bdcaba") == 4
    assert fuzzy.ratio("", "") == 100.0 and fuzzy.ratio("abc", "abc") == 100.0 and fuzzy.ratio("ab", "cd") == 0.0
    assert fuzzy.ratio("this is a test", "this is a test!") == pytest.approx(96.551724, abs=1e-5)
    assert fuzzy.partial_ratio("test", "this is a test!") == 100.0
    assert fuzzy.token_sort_ratio("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == 100.0
    assert fuzzy.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100.0
    assert fuzzy.weighted_ratio("abc def", "def abc") == 95.0
    assert fuzzy.ordered_ratio("kran dn50", "kran sharovoi dn50") == 100.0 and fuzzy.ordered_ratio("", "x") == 0.0

"""Whole matches of a few lines against a small stock."""

from __future__ import annotations

import pytest

from stocklink.operators.allocate import DEPLETED, FULL, NOT_FOUND, PARTIAL
from stocklink.plans import matching

STOCK = [
    (1, "Труба стальная 57х3,5 ГОСТ 10704-91", 10.0), (2, "Труба стальная 57х5 ГОСТ 10704-91", 10.0), (3, "Труба ПНД 110", 5.0), (4, "Кран шаровой DN50 PN16 КШ-50", 3.0), (5, "Кран шаровой DN40 PN16 КШ-40", 3.0),
    (6, "Фланец плоский DN600 PN10", 4.0), (7, "Фланец плоский DN700 PN10", 4.0), (8, "Затвор дисковый DN100", 0.0), (9, "Задвижка DN50", 2.0),
]
LINES = [
    (1, "Труба стальная 57х3,5 ГОСТ 10704-91", 8.0), (2, "Труба стальная 57х3,5 ГОСТ 10704-91", 8.0), (3, "Труба стальная 57х3,5 ГОСТ 10704-91", 1.0), (4, "Кран шаровой DN50 PN16 КШ-50", 2.0),
    (5, "Фланец плоский DN700 PN10", 1.0), (6, "Манометр 0..1,6 МПа", 1.0), (7, "Затвор дисковый DN100", 1.0),
]


@pytest.fixture(scope="module")
def result(spark):
    lines, stock = spark.createDataFrame(LINES, "id long, name string, requested double"), spark.createDataFrame(STOCK, "id long, name string, quantity double")
    return {r.id: r for r in matching.match(lines, stock, ["name"], ["name"], ["id"]).collect()}


def test_every_line_has_one_result(result):
    assert sorted(result) == [x[0] for x in LINES]


def test_exact_lines_are_reserved_in_order(result):
    assert [(result[k].stock_id, result[k].status, result[k].allocated) for k in (1, 2, 3)] == [(1, FULL, 8.0), (1, PARTIAL, 2.0), (1, DEPLETED, 0.0)]
    assert (result[4].stock_id, result[4].status, result[4].kind) == (4, FULL, "exact")


def test_smaller_diameters_are_never_listed(result):
    assert result[5].stock_id == 7 and 6 not in (result[5].analogs or [])


def test_nothing_fits(result):
    assert result[6].status == NOT_FOUND and result[7].status == NOT_FOUND


def test_rejected_candidates_are_left_out(spark):
    lines, stock = spark.createDataFrame(LINES[3:4], "id long, name string, requested double"), spark.createDataFrame(STOCK, "id long, name string, quantity double")
    rejected = spark.createDataFrame([(4, 4, "rejected")], "line long, stock_id long, decision string")
    got = matching.match(lines, stock, ["name"], ["name"], ["id"], reviewed=rejected).collect()
    assert [r.stock_id == 4 for r in got] == [False]


def test_fallback_finds_an_item_that_no_taken_key_names(spark):
    """The line's eight rarest tokens and six rarest roots name other items only."""
    rare = ["abvil", "cedron", "fimlop", "gartek", "hulmos", "jobrin", "kestal", "lumpat"]
    common = [a + b for a in ("wor", "zan", "qui", "rup") for b in ("delna", "bitra", "gomse", "fekil", "lusto")]
    stock = [(k, f"{word} nothing else{k}x", 1.0) for k, word in enumerate(rare)] + [(50, " ".join(common), 2.0), (51, " ".join(common[::-1][:10] + [c + "tt" for c in common[:10]]), 2.0)]
    stock += [(60 + k, f"{c} other{k}y", 1.0) for k, c in enumerate(common)]
    line = [(1, " ".join(common + rare), 1.0)]
    lines, items = spark.createDataFrame(line, "id long, name string, requested double"), spark.createDataFrame(stock, "id long, name string, quantity double")
    orders, held = (matching.features(d, "id", ["name"]) for d in (lines, items))
    found = {r.id for r in matching.candidates(orders, matching.stock_postings(held)).collect()}
    assert 50 not in found
    (got,) = matching.match(lines, items, ["name"], ["name"], ["id"]).collect()
    assert (got.stock_id, got.sources) == (50, ["fallback"]) and got.status != NOT_FOUND

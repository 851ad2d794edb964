"""Retrieval, compatibility, decision, reservation, feedback and classification on small cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stocklink.functions import tokens
from stocklink.operators import allocate, classify, compat, decide, feedback, retrieval


def test_reservation_equals_the_loop(spark):
    rng = random.Random(1)
    lines = [(f, s, n, float(rng.randint(1, 9))) for f in "ab" for s in (1, 2) for n in range(40)]
    got = {(r.f, r.s, r.n): r.allocated for r in allocate.reserve(spark.createDataFrame(lines, "f string, s int, n int, q double").withColumn("have", F.lit(50.0)), ["f", "s"], [F.col("n")], "q", "have").collect()}
    left = {}
    for f, s, n, q in lines:
        have = left.setdefault((f, s), 50.0)
        assert got[f, s, n] == min(q, have)
        left[f, s] = have - min(q, have)


def test_reservation_with_ties(spark):
    candidates = [{"stock_id": 1, "quantity": 5.0, "rank": 1}, {"stock_id": 2, "quantity": 4.0, "rank": 1}]
    rows = [("f", 1, 3.0, candidates), ("f", 2, 3.0, candidates), ("f", 3, 5.0, candidates), ("f", 4, 1.0, None)]
    df = spark.createDataFrame(rows, "file string, line_no long, requested double, candidates array<struct<stock_id:long,quantity:double,rank:int>>")
    got = {r.line_no: (r.stock_id, r.allocated) for r in allocate.reserve_with_ties(df, ["file"]).collect()}
    assert got == {1: (1, 3.0), 2: (2, 3.0), 3: (1, 2.0), 4: (None, 0.0)}


def plain_pool(keys, posted, base, most, stop):
    frequency = {k: len(v) for k, v in posted.items()}
    pool, found = set(base), set()
    order = sorted(keys, key=lambda k: (frequency.get(k, 100_000), -len(k), k))[:most]
    for k in order:
        if posted.get(k):
            pool |= posted[k]
            found |= posted[k]
            if len(pool) >= stop:
                break
    return found


def test_pool_stops_early(spark):
    rng = random.Random(2)
    posted = {f"t{k}": {rng.randint(0, 30) for _ in range(rng.randint(1, 12))} for k in range(12)}
    lines = {n: {f"t{rng.randint(0, 14)}" for _ in range(rng.randint(1, 8))} for n in range(30)}
    base = {n: {rng.randint(0, 30) for _ in range(rng.randint(0, 9))} for n in range(30)}
    got = retrieval.pool_until(
        spark.createDataFrame([(n, k) for n, ks in lines.items() for k in ks], "line int, key string"), spark.createDataFrame([(k, i) for k, ids in posted.items() for i in ids], "key string, id int"),
        spark.createDataFrame([(n, i) for n, ids in base.items() for i in ids], "line int, id int"), 5, 12,
    )
    found = {}
    for r in got.collect():
        found.setdefault(r.line, set()).add(r.id)
    assert all(found.get(n, set()) == plain_pool(lines[n], posted, base[n], 5, 12) for n in lines)


def pair(spark, order, stock):
    row = spark.createDataFrame([(order, stock)], "o array<string>, s array<string>")
    return row.withColumn("od", tokens.tags_by_key(F.col("o"))).withColumn("sd", tokens.tags_by_key(F.col("s")))


@pytest.mark.parametrize(
    ("order", "stock", "fits"),
    [
        (["family:kran", "dn:50"], ["family:kran", "dn:50"], True), (["family:kran"], ["family:zatvor"], False), (["family:kran", "dn:50"], ["family:kran", "dn:40"], False), (["family:kran", "dn:50"], ["family:kran", "dn:65"], True),
        (["mclass:steel"], ["mclass:brass"], False), (["mclass:steel", "grade:cs20"], ["mclass:steel"], True), (["mclass:steel", "grade:09g2s"], ["mclass:steel"], False), (["mclass:ppu", "mclass:steel"], ["mclass:steel"], False),
        (["family:tee", "tripledn:20x25x25", "dn:25"], ["family:tee", "dn:25"], True), (["family:tee", "tripledn:20x25x25", "dn:25"], ["family:tee", "tripledn:20x20x20", "dn:20", "dn:25"], False),
        (["family:elbow"], ["family:elbow", "inch:1/2"], False), ([], ["family:kran"], True), (["family:kran", "dn:50", "dn:16", "pn:16"], ["family:kran", "dn:50"], True),
    ],
)
def test_compatibility(spark, order, stock, fits):
    df = pair(spark, order, stock)
    assert df.select(compat.compatible(F.col("o"), F.col("s"), F.col("od"), F.col("sd")).alias("r")).first().r is fits


def test_dimension_scores(spark):
    df = pair(spark, ["dn:50", "pn:16", "lmm:100", "od:57"], ["dn:50", "pn:10", "lmm:105"])
    got = df.select(decide.dimension_scores(F.col("od"), F.col("sd")).alias("r")).first().r
    assert (got.bonus, got.penalty, got.matched, got.conflicting) == (10.0, 12.0 + 3.0, ["dn"], ["pn"])


@pytest.mark.parametrize(
    ("values", "rule"),
    [
        ({"score": 80, "overlap": 0.4, "code": True}, 1), ({"score": 92, "overlap": 0.6, "gap": 5}, 4), ({"score": 62, "gap": 6, "triple": True}, 5), ({"score": 84, "overlap": 0.7, "bonus": 12, "gap": 6, "penalty": 5}, 6),
        ({"score": 75}, 8), ({"score": 61, "overlap": 0.6}, 9), ({"score": 59, "bonus": 31}, 10), ({"score": 50, "bonus": 18, "overlap": 0.45}, 11), ({"score": 52, "bonus": 18, "root": 0.45, "penalty": 1}, 12), ({"score": 56, "bonus": 18, "root": 0.3}, 13),
        ({"score": 58, "bonus": 10, "overlap": 0.2, "penalty": 1}, 14), ({"score": 58, "code": True, "penalty": 1}, 15), ({"score": 42, "bonus": 16, "overlap": 0.2}, 16), ({"score": 30}, 17), ({"score": 95, "overlap": 0.9, "gap": 9, "learned": True}, 8),
    ],
)
def test_cascade(spark, values, rule):
    v = {"score": 0, "gap": 0, "overlap": 0, "root": 0, "bonus": 0, "penalty": 0, "code": False, "learned": False, "triple": False} | values
    c = {k: F.lit(x if isinstance(x, bool) else float(x)) for k, x in v.items()}
    no = F.lit(False)
    got = decide.decision(c["score"], c["gap"], c["overlap"], c["root"], c["bonus"], c["penalty"], c["code"], c["learned"], F.lit(0.0), F.lit(True), no, c["triple"], no, no)
    assert spark.range(1).select(got.alias("r")).first().r.rule == rule


def test_analog_status_and_score(spark):
    no, yes, n = F.lit(False), F.lit(True), lambda x: F.lit(float(x))
    safe = lambda **k: spark.range(1).select(decide.analog_is_safe(*[k.get(x, d) for x, d in (("score", n(0)), ("gap", n(0)), ("overlap", n(0)), ("root", n(0)), ("bonus", n(0)), ("penalty", n(0)), ("code", no), ("boost", n(0)), ("approved", no), ("only", no), ("required", no), ("least", n(70)), ("forbidden", no))]).alias("r")).first().r
    assert safe(score=n(73), gap=n(4), overlap=n(0.5)) and not safe(score=n(73), gap=n(4), overlap=n(0.5), only=yes)
    assert safe(approved=yes, bonus=n(10), required=yes) and safe(score=n(71), gap=n(3), required=yes, overlap=n(0.25)) and not safe(score=n(71), gap=n(3), required=yes, bonus=n(1)) and not safe(score=n(71), gap=n(3), required=yes, overlap=n(0.25), forbidden=yes)
    total = decide.total_score(n(100), n(100), n(1), n(1), yes, n(0), n(500), n(0), n(0), n(34))
    assert spark.range(1).select(total.alias("r")).first().r == 72.0


def test_feedback(spark):
    decisions = spark.createDataFrame([("q", "A", "approved"), ("q", "A", "rejected"), ("q", "B", "approved")], "k string, code string, decision string")
    final = feedback.rejected_wins(decisions, ["k", "code"])
    candidates = spark.createDataFrame([("q", "A"), ("q", "B"), ("q", "C")], "k string, code string")
    assert {(r.code, r.approved) for r in feedback.reviewed(candidates, final, ["k", "code"]).collect()} == {("B", True), ("C", False)}
    rows = feedback.snapshot_rows(spark.createDataFrame([("s", " a ", ["A", "b", "", "B"])], "snapshot_id string, chosen string, visible array<string>"))
    assert {(r.code, r.decision) for r in rows.collect()} == {("A", "approved"), ("B", "rejected")}
    memory = spark.createDataFrame([(0.5,), (0.9,), (1.5,)], "learning_confidence double")
    assert sorted(r[0] for r in feedback.usable(memory).collect()) == [0.9, 1.0]


@pytest.mark.parametrize(("values", "approved", "boost", "allow"), [({"same": True}, True, 34.0, True), ({"profile": 0.8}, True, 29.0, True), ({"ratio": 75.0}, True, 16.0, False), ({"ratio": 70.0, "key": 0.1}, False, -10.0, False), ({"ratio": 70.0}, True, 0.0, False), ({"same": True, "structure": 0.5}, False, -28.0, False)])
def test_learning_signal(spark, values, approved, boost, allow):
    n = lambda k: F.lit(float(values.get(k, 0)))
    got = feedback.learning_signal(n("structure"), n("profile"), n("ratio"), n("key"), n("root"), n("manual"), n("dimension"), F.lit(values.get("same", False)), F.lit(False), F.lit(0), F.lit(approved), F.lit(1.0))
    row = spark.range(1).select(got.alias("r")).first().r
    assert (row.boost, row.allow) == (boost, allow)


def test_classification(spark):
    config = [
        {"key": "flange", "aliases": ["flanec"], "strong_tokens": {"flanec": 18.0}, "context_tokens": {"dn": 5.0}, "required_attributes": ["dn"]},
        {"key": "hose", "route": "manual_review", "aliases": ["rukav pozharnyi"], "strong_tokens": {"rukav": 14.0, "pozharnyi": 16.0}, "required_attributes": ["dn_or_length"]},
        {"key": "ball_valve", "aliases": ["kran sharovoi"], "strong_tokens": {"kran": 12.0, "sharovoi": 16.0}, "blocker_tokens": ["zatvor"], "required_attributes": ["dn_or_inch"]},
    ]
    rows = [(1, "flanec dn 100", ["flanec", "dn", "100"], {"dn": ["100"]}, ["100"]), (2, "rukav pozharnyi 20m", ["rukav", "pozharnyi", "20m"], {"length": ["20"]}, ["20"]), (3, "manzheta", ["manzheta"], {}, []), (4, "kran sharovoi 1/2", ["kran", "sharovoi", "1/2"], {"inch": ["1/2"]}, ["1", "2"])]
    queries = spark.createDataFrame(rows, "query_id int, text string, tokens array<string>, attributes map<string,array<string>>, numbers array<string>")
    got = {r.query_id: (r.category, r.status) for r in classify.classified(classify.scored(queries, classify.categories(spark, config))).collect()}
    assert got == {1: ("flange", "classified"), 2: ("hose", "needs_review"), 3: (None, "unclassified"), 4: ("ball_valve", "classified")}

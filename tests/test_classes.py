"""Pairs by classes of equal rows: the same results as pair by pair, with work that doesn't grow with the copies."""

from __future__ import annotations

import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from stocklink.functions import fixed, tokens
from stocklink.operators import decide, policy, preferences, retrieval, search
from stocklink.plans import catalogue, domain  # noqa: F401


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture()
def posted(spark):
    rows = [(kind, key, i) for i in range(60) for kind, key in (("family", f"f{i % 3}"), ("dimension", f"d{i % 2}"), ("dimension", f"e{i % 5}")) if i % 7 or kind == "family"]
    return spark.createDataFrame(rows, "kind string, key string, id long")


def test_pool_by_kind_equals_the_join_of_all_postings(spark, posted, monkeypatch):
    monkeypatch.setattr(retrieval, "CHUNK", 2)
    lines = posted.select(F.col("id").alias("line"), "kind", "key")
    got = retrieval.pool_by_kind(lines, posted)
    assert rows_of(got.select("line", "id", F.array_join("sources", ","))) == rows_of(retrieval.merge_sources(retrieval.by_kind(lines, posted)).select("line", "id", F.array_join("sources", ",")))
    # the pairs are made last: nothing sorts, shuffles or groups them
    top = got._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[0]
    assert top.count("Generate explode") == 2 and "Aggregate" not in top and "Join" not in top


def test_pair_sizes_counts_what_the_intersection_lists(spark, posted):
    keys = posted.select("key", "id")
    lines = keys.withColumnRenamed("id", "line")
    assert rows_of(retrieval.pair_sizes(lines, keys)) == rows_of(retrieval.pair_intersection(lines, keys).groupBy("line").agg(F.count("*").alias("n")))
    # 40,000 copies: 1.6 billion pairs if they were listed
    many = spark.range(40_000).select("id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("key"))
    got = retrieval.pair_sizes(many.withColumnRenamed("id", "line"), many)
    assert got.groupBy("n").count().collect() == [(40_000, 40_000)]


def test_pairs_of_a_pool_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "CHUNK", 3)
    monkeypatch.setattr(retrieval, "BLOCK", 2, raising=False)
    rng = random.Random(7)
    # words and tags: several keys of a row, which may hold others of its own; sizes: one at most
    keys = {(kind, f"k{rng.randrange(most)}", i) for i in range(70) for kind, most, n in (("token", 6, 3), ("attribute", 9, 2), ("dimension", 4, 1)) for _ in range(rng.randrange(n + 1))}
    posted = spark.createDataFrame([*keys, ("token", None, 1), ("token", None, 2), (None, "k1", 3), ("material", "m", 99)], "kind string, key string, id long")
    lines = posted.where("id % 3 > 0 or id is null").withColumnRenamed("id", "line").unionByName(spark.createDataFrame([("dimension", "k9", 500), ("code", "k1", 501)], "kind string, key string, line long"))
    got = retrieval.pool_by_kind(lines, posted)
    wanted = retrieval.merge_sources(retrieval.by_kind(lines, posted))
    text = lambda d: rows_of(d.select("line", "id", F.array_join("sources", ",")))
    assert text(got) == text(wanted) and len({r[2] for r in text(got)}) == 7
    assert rows_of(retrieval.pool_by_kind(lines, posted, separator=",")) == text(wanted)
    assert rows_of(retrieval.pool_by_kind(lines.where("false"), posted)) == rows_of(retrieval.pool_by_kind(lines, posted.where("false"))) == []
    # each branch makes its pairs after the last shuffle, and none is grouped afterwards
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set(source" not in plan and plan.count("Generate explode(sequence") == 2 * plan.count("RepartitionByExpression")


def test_candidates_come_from_names_too(spark, tmp_path):
    odd = [(1, "Red Bolt", "B1", 1), (2, "old bolt", "B2", 2), (3, "red red", "B3", 3), (4, "ring", "b1", 4), (5, None, "B5", 1), (6, "hot", None, None), (7, "", "B7", 7), (8, "", "B8", 8), (9, "red bolt", "B1", 1), (10, None, None, None)]
    spark.createDataFrame([(*r, "T", 1.0) for r in odd], "p_partkey long, p_name string, p_brand string, p_size int, p_type string, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    kinds = {"dimension": lambda r: {r[3]} - {None}, "family": lambda r: {(r[2] or "").lower()} - {""}, "token": lambda r: set() if r[1] is None else set(r[1].lower().split(" "))}
    wanted = [(a[0], b[0], ",".join(k for k, of in kinds.items() if of(a) & of(b))) for a in odd for b in odd]
    assert (1, 2, "token") in wanted and (1, 9, "dimension,family,token") in wanted and (7, 8, "token") in wanted
    assert rows_of(catalogue.candidate_pool(spark, str(tmp_path))) == sorted((w for w in wanted if w[2]), key=str)
    against_sql(spark, str(tmp_path), "candidate_pool")


def copies(spark, path, n=3):
    """A part table of ``n`` copies of few items."""
    parts = spark.range(12 * n).selectExpr("id as p_partkey", "concat(array('red', 'old', 'hot')[id % 3], ' ', array('bolt', 'ring')[id % 2]) as p_name", "'B' as p_brand", "'T' as p_type", "cast(1 + id % 4 as int) as p_size", "cast(id as double) as p_retailprice")
    parts.write.mode("overwrite").parquet(f"{path}/part.parquet")
    return str(path)


def test_compatibility_is_judged_once_for_a_pair_of_classes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(retrieval, "CHUNK", 2)
    made = catalogue.compat_filter(spark, copies(spark, tmp_path))
    sizes = {i: 1 + i % 4 for i in range(36)}
    assert rows_of(made) == sorted(((a, b) for a in sizes for b in sizes if a != b and sizes[b] >= sizes[a]), key=str)
    top = made._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[0]
    assert top.count("Generate explode") == 2 and "arrays_overlap" not in top and "Join" not in top


def test_ranking_by_class_equals_the_ranking_of_all_pairs(spark, tmp_path):
    path = copies(spark, tmp_path)
    names = {i: (("red", "old", "hot")[i % 3], ("bolt", "ring")[i % 2]) for i in range(36)}
    wanted = []
    for a in names:
        scores = sorted((-min(100.0, max(0.0, 40 + 15.0 * len({*names[a]} & {*names[b]}) + (10 if a % 4 == b % 4 else -22))), b) for b in names if b != a)
        wanted += [(a, b, k + 1, -s, -s + scores[k + 1][0]) for k, (s, b) in enumerate(scores[:5])]
    made = catalogue.overlap_topk(spark, path)
    assert rows_of(made.select("line", "stock_id", "rank", "score", "gap")) == sorted(wanted, key=str)


def test_ranking_by_class_takes_few_of_many_copies(spark):
    pairs = spark.createDataFrame([(0, 0, 50.0)], "line long, stock_id long, score double")
    members = spark.range(30_000).select(F.lit(0).cast("long").alias("class"), F.lit(30_000).cast("long").alias("n"), "id")
    got = decide.ranked_by_class(pairs, members, members, 2).where("line in (0, 2, 29999)").select("line", "stock_id", "rank", "gap")
    assert rows_of(got) == sorted([(0, 1, 1, 0.0), (0, 2, 2, 0.0), (2, 0, 1, 0.0), (2, 1, 2, 0.0), (29999, 0, 1, 0.0), (29999, 1, 2, 0.0)], key=str)


def test_decisions_of_copies(spark, tmp_path):
    # an equal copy of the same size: 40 + 30 + 10 points without a penalty
    made = catalogue.decision_cascade(spark, copies(spark, tmp_path, 2))
    assert rows_of(made) == sorted(((i, (i + 12) % 24, "exact") for i in range(24)), key=str)
    # one row for a line and two for each pair of classes at most are ranked, whatever the copies
    plan = catalogue.decision_cascade(spark, copies(spark, tmp_path, 2))._jdf.queryExecution().optimizedPlan().toString()
    assert "place#" in plan and "<= 3" in plan


def against_sql(spark, path, name):
    """A query on a part table against its SQL; returns what is done after the classes became members."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{path}/part.parquet/*.parquet'")
    made = catalogue.QUERIES[name](spark, path)
    names = ", ".join(made.columns)
    assert rows_of(made) == sorted(con.execute(f"SELECT {names} FROM ({catalogue.SQL[name]})").fetchall(), key=str)
    return made._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[0]


def test_decisions_of_many_different_parts(spark, tmp_path):
    # 4,000 different parts of one family and brand: 16 million pairs, of 50 x 50 names and 80 x 80 sizes
    made = spark.range(4000).selectExpr("4000 - id as p_partkey", "concat(array('red', 'old', 'hot', 'Hot', 'hot hot')[id % 5], ' n', (id div 5) % 10) as p_name", "'B' as p_brand", "'T' as p_type", "cast(1 + id div 50 as int) as p_size", "cast(id as double) as p_retailprice")
    odd = spark.createDataFrame([(9000 + i, n, b, "T", z, 1.0) for i, (n, b, z) in enumerate([(None, "B", 3), ("red n1", None, 3), ("red n1", "B", None), (None, "B", None), ("", "B", 3), ("red n1", "C", 3), ("red n1", "B", 0)] * 2)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    made.unionByName(odd).write.parquet(f"{tmp_path}/part.parquet")
    began = time.time()
    against_sql(spark, str(tmp_path), "decision_cascade")
    assert time.time() - began < 40


def test_least_scores_of_policies(spark):
    policies = policy.load(spark, {"families": {"pipe": {"allow_exact": True, "exact_required": ["family"], "exact_min_score": 80, "safe_required": ["family"], "safe_min_score": 60}, "kran": {"safe_required": ["family"], "safe_min_score": 60}}})
    tags = spark.createDataFrame([(["family:pipe"],), (["family:kran"],), (["family:none"],)], "o_tags array<string>")
    pairs = policy.joined(tags.withColumn("s_tags", F.col("o_tags")), policies)
    empty, dims = F.array().cast("array<string>"), F.create_map().cast("map<string,array<string>>")
    pair = {"o_tags": F.col("o_tags"), "s_tags": F.col("s_tags"), "o_dims": dims, "s_dims": dims, "o_tokens": empty, "s_tokens": empty, "matched": empty, "conflicting": empty, "penalty": F.lit(0.0), "allow": F.lit(False)}
    got = pairs.select(policy.exact_from(F.col("policy"), F.col("policy_family"), pair), policy.analog_from(F.col("policy"), pair))
    assert rows_of(got) == sorted([(80.0, 48.0), (None, 48.0), (None, None)], key=str)


PAIRS = ["policy_verdicts", "dimension_points", "family_points", "pair_compatibility"]


@pytest.mark.parametrize("name", PAIRS)
def test_line_pairs_are_judged_by_their_texts(spark, tmp_path, name):
    top = against_sql(spark, copies(spark, tmp_path, 12), name)
    assert top.count("Generate explode") == 2 and not any(x in top for x in ("Join", "ArrowEval", "arrays_overlap", "aggregate("))


@pytest.mark.parametrize("name", PAIRS[1:])
def test_texts_are_dealt_out_and_parts_meet_their_text_once(spark, tmp_path, name):
    plan = catalogue.QUERIES[name](spark, copies(spark, tmp_path, 2))._jdf.queryExecution().optimizedPlan().toString()
    # the parts of both sides, and what both sides and the reading of both need of the texts
    assert plan.count("Relation [") <= 8
    assert all("RepartitionByExpression" in x[:300] for x in plan.split("ArrowEvalPython")[1:])


@pytest.mark.parametrize("name", PAIRS)
def test_texts_are_read_once_for_both_sides(spark, tmp_path, name):
    made = catalogue.QUERIES[name](spark, copies(spark, tmp_path, 2))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    # the texts come from a stored table, and a part meets its class without being sent to all tasks
    assert "ArrowEvalPython" not in plan
    assert "strategy=merge" in plan


def test_a_row_makes_few_pairs(spark, monkeypatch):
    # what one row before the explosions makes is held at once: two classes of 3,000, whose chunks are seen instead of exploded
    members = spark.range(6000).selectExpr("id div 3000 as class", "3000L as n", "id")
    pairs = spark.createDataFrame([(0, 1)], "line long, id long")
    assert retrieval.expanded(pairs, members, members).distinct().count() == 9_000_000
    monkeypatch.setattr(retrieval.F, "explode", F.size)
    rows = retrieval.expanded(pairs, members, members).select(F.col("line").alias("lines"), F.col("id").alias("ids")).collect()
    assert sum(r.lines * r.ids for r in rows) == 9_000_000 and max(r.lines * r.ids for r in rows) < 1 << 15


def test_profile_points_compare_each_key_once(spark):
    rng, keys = random.Random(5), list(dict.fromkeys(k for parts in fixed.FAMILY_PROFILES.values() for part in parts for k in part))
    tagged = lambda: sorted({f"family:{f}" for f in rng.sample(["pipe", "tee", "perehod", "flange", "kran", "mufta", "x"], rng.randrange(3))} | {f"{k}:{rng.randrange(3)}" for k in rng.choices(keys, k=rng.randrange(14))})
    frame = spark.createDataFrame([(tagged(), tagged()) for _ in range(600)], "o_tags array<string>, s_tags array<string>").withColumn("o_dims", tokens.tags_by_key(F.col("o_tags"))).withColumn("s_dims", tokens.tags_by_key(F.col("s_tags")))
    family, credit = tokens.primary_family(F.col("o_tags"), fixed.PRIMARY_FAMILIES), preferences.partial_credit(tokens.primary_family(F.col("o_tags"), fixed.PRIMARY_FAMILIES), F.col("o_dims"), F.col("s_dims"))
    made = frame.select("o_dims", "s_dims", family.alias("family"), credit.alias("credit"), preferences.profile_bonus(*[F.col(c) for c in ("o_tags", "s_tags", "o_dims", "s_dims")]).alias("got"))
    seen = set()
    for row in made.collect():
        wanted, (equal, different, surplus) = 0.0, fixed.FAMILY_PROFILES.get(row.family, ({}, {}, {}))
        wanted += row.credit.points if row.family in fixed.FAMILY_PROFILES else 0.0
        for key in {*equal, *different, *surplus}:
            asked, there = set(row.o_dims.get(key, [])), set(row.s_dims.get(key, []))
            if asked and there:
                wanted += equal.get(key, 0.0) if asked & there else -different.get(key, 0.0) * (row.credit.scale if key == "pairdn" else 1.0)
            elif there:
                wanted -= surplus.get(key, 0.0)
        assert row.got == wanted
        seen.add(row.family)
    assert seen >= {"pipe", "tee", "perehod", None}
    assert str(made.select("got")._jdf.queryExecution().analyzed()).count("arrays_overlap") <= len(keys)


def test_fragments_of_codes_and_names(spark):
    stock = [(i, f"P-{i}" if i % 5 else None, name) for i, name in enumerate(["Red bolt", "old RED bolt", None, "", "bolt", "ab", "Red bolt", "x ab12 y"] * 3)] + [(7, "P-7", "x ab12 y")]
    searches = [(100, "red bolt"), (101, " RED BOLT "), (102, "p-1"), (103, "ab"), (104, "--"), (105, ""), (106, None), (107, "ab12"), (108, "P7"), (109, "12"), (109, "12")]
    got = search.by_fragment(spark.createDataFrame(searches, "search long, query string"), spark.createDataFrame(stock, "id long, code string, name string"), 4)

    def key(text):
        return "".join(c for c in (text or "").lower() if c.isalnum())

    wanted = []
    for s in sorted({s for s, _ in searches}):
        found = []
        for _, query in [x for x in searches if x[0] == s]:
            text = (query or "").lower().strip()
            if text and (len(text) >= 4 or key(query)):
                found += [(s, i) for i, code, name in stock if text in (code or "").lower() or text in (name or "").lower() or (key(query) and key(code) == key(query))]
        wanted += sorted(found)[:4]
    assert rows_of(got) == sorted(wanted, key=str)
    assert "BroadcastNestedLoopJoin" not in got._jdf.queryExecution().executedPlan().toString().replace("BroadcastNestedLoopJoin BuildRight, Cross", "")


def test_pool_by_keys_equals_the_pool_of_all_pairs(spark):
    rng = random.Random(3)
    keys = [(rng.choice("ab"), f"k{rng.randrange(3)}", i) for i in range(90) for _ in range(rng.randrange(4))]
    posted = spark.createDataFrame(keys, "kind string, key string, id long").distinct()
    lines = posted.where("id % 4 = 0").withColumnRenamed("id", "line")
    stock = spark.createDataFrame([(i, float(rng.randrange(-2, 5))) for i in range(90)], "id long, remaining double")
    own = spark.createDataFrame([(s, i) for s in range(0, 90, 2) for i in (s, (s * 7 + 1) % 90)], "search long, id long")
    sources = {k: lines.where(f"kind = '{k}'").join(posted.where(f"kind = '{k}'"), "key").select(F.col("line").alias("search"), "id").distinct() for k in "ab"}
    text = [F.col("search"), F.col("id"), F.array_join("sources", ","), F.col("place")]
    for most in (1, 5, 40):
        got = search.pool_by_keys(lines, posted, {"memory": own, "a": own.where("id % 3 = 0")}, stock, most).select(*text)
        plain = search.pool({"memory": own, "a": sources["a"].unionByName(own.where("id % 3 = 0")), "b": sources["b"]}, stock, most).select(*text)
        assert rows_of(got) == rows_of(plain)


def test_search_pool_ranks_equal_searches_once(spark, tmp_path):
    spark.range(2000).selectExpr("id as p_partkey", "'red bolt' as p_name", "concat('B', id % 3) as p_brand", "'T' as p_type", "cast(id % 4 as int) as p_size", "cast(id % 50 as double) as p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    against_sql(spark, str(tmp_path), "search_pool")


def test_every_part_is_a_search(spark, tmp_path):
    path = copies(spark, tmp_path, 10)
    got = catalogue.QUERIES["search_pool"](spark, path)
    # 120 parts of one brand and four sizes: each finds itself, then those of its size and, while there is room, the others
    assert got.groupBy("search").count().select("count").distinct().collect() == [(40,)]
    assert {r.search for r in got.collect()} == set(range(120))
    assert got.where("place = 1 and search <> id").count() == 0
    against_sql(spark, path, "search_pool")

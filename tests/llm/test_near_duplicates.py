"""The near-duplicate stage against a brute-force count of pairs, and rows that doc_id can't tell apart."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stocklink.llm import near_duplicates

WORDS = [f"word{k}" for k in range(120)]


def shingle_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    """Positions of the rows (doc_id, text) that stay, and the number of pairs of different sets."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    n = 0
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and 10 * len(a & b) >= 8 * len(a | b):
                n += a != b
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return sorted((min((d for d in g if d is not None), default=-1)) for g in groups.values()), n


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_stage_finds_every_pair_at_five_words_and_four_fifths(spark, name):
    docs = spark.read.parquet(f"/root/testdata/{name}/documents.parquet")
    wanted, n = plain_kept([(r.doc_id, r.text) for r in docs.collect()])
    assert n > 0
    assert sorted(r.doc_id for r in corpus_pipeline.distinct(spark, docs, "").collect()) == wanted


@pytest.mark.parametrize("hot", [32, 1])
def test_groups_of_near_copies_are_one_component_however_large(spark, hot):
    near = [(k, " ".join([*WORDS[:60], f"x{k}", *WORDS[60:]])) for k in range(50)]
    apart = [(100 + k, " ".join(f"w{k}x{i}" for i in range(40))) for k in range(5)] + [(200, " ".join(WORDS[:30]))]
    rows = spark.createDataFrame(near + apart, "doc_id long, text string").withColumn("row", F.monotonically_increasing_id()).cache()
    kept = near_duplicates.kept_rows(rows, hot=hot).join(rows, "row").collect()
    assert sorted(r.doc_id for r in kept) == [0, 100, 101, 102, 103, 104, 200]


def test_one_row_of_each_group_stays_whatever_its_doc_id(spark):
    text, other = " ".join(WORDS), " ".join(reversed(WORDS))
    rows = [(7, text), (7, text), (None, text), (7, other), (9, "a lone text"), (None, "one two"), (None, "one two"), (None, "three four"), (3, None), (4, " ")]
    got = corpus_pipeline.distinct(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    wanted = [(7, text), (9, "a lone text"), (None, "one two"), (None, "three four"), (3, None), (7, other)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, wanted))


@pytest.mark.parametrize("hot", [32, 2])
def test_links_in_crowded_bands_are_complete(spark, hot):
    """Many texts that share a long passage (and so bands) without being near, with some near pairs among them."""
    rows = []
    for k in range(60):
        own = [f"t{k}y{i}" for i in range(70)]
        rows.append((k, " ".join(WORDS + own)))
        if k % 10 == 0:
            rows.append((1000 + k, " ".join([*WORDS, *own[:-2], "changed", "here"])))
    wanted, n = plain_kept(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.monotonically_increasing_id()).cache()
    kept = near_duplicates.kept_rows(df, hot=hot).join(df, "row").collect()
    assert n == 6 and sorted(r.doc_id for r in kept) == wanted


def test_prefix_filter_finds_every_near_pair(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(12):
        base = [f"v{rng.randrange(40)}" for _ in range(50)]
        for _ in range(5):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(50)] = f"u{rng.randrange(1000)}"
            texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(dict.fromkeys(texts))), "node long, text string").cache()
    many = df.selectExpr("0L as k", "node")
    parts = spark.createDataFrame([], "node long, component long")
    got = near_duplicates.by_prefix(many, parts, lambda nodes: df.join(nodes, "node").select("node", "text"), 5, 0.8)
    found = {(r.a, r.b) for r in got.collect()}
    sets = {r.node: shingle_set(r.text) for r in df.collect()}
    near = {(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])}
    assert near and near <= found and len(found) < len(sets) * (len(sets) - 1) / 2


def joined_by(links, sets):
    """Groups of nodes that links join."""
    root = {n: n for n in sets}
    for a, b in sorted(links):
        x, y = root[a], root[b]
        root = {n: x if r == y else r for n, r in root.items()}
    return sorted(sorted(n for n in root if root[n] == r) for r in set(root.values()))


def test_links_by_frequent_shingles_are_complete(spark):
    """Texts of shingles that all occur in many of them: a head for each shingle joins some, comparing all joins the rest."""
    rng = random.Random(5)
    piece = [[" ".join(f"p{k}{v}w{i}" for i in range(12)) for v in "ab"] for k in range(16)]
    picks = [[rng.randrange(2) for _ in range(16)] for _ in range(60)]
    picks += [[1 - v if k == i % 16 else v for k, v in enumerate(p)] for i, p in enumerate(picks)]
    texts = sorted({" ".join(piece[k][v] for k, v in enumerate(p)) for p in picks})
    df = spark.createDataFrame(list(enumerate(texts)), "node long, text string").cache()
    sets = {r.node: shingle_set(r.text) for r in df.collect()}
    near = {(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])}
    texts_of = lambda nodes: df.join(nodes, "node").select("node", "text")
    none = spark.createDataFrame([], "node long, component long")
    kept = near_duplicates.prefixes(df.selectExpr("0L as k", "node"), none, texts_of, 5, 0.8)
    heads = near & {(r.a, r.b) for r in near_duplicates.prefix_pairs(kept, 0.8, hot=2).collect()}
    assert joined_by(heads, sets) != joined_by(near, sets)
    for limit in (1 << 19, 1000):
        links = {(r.a, r.b) for r in near_duplicates.by_blocks(kept, none, texts_of, 5, 0.8, hot=2, limit=limit).collect()}
        assert {(min(x), max(x)) for x in links} <= near and joined_by(links, sets) == joined_by(near, sets)
        assert limit == 1000 or len(links) == len(sets) - len(joined_by(near, sets))

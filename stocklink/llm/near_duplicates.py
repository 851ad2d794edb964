"""Near-duplicates by exact Jaccard similarity of word shingles, with candidates from SimHash and MinHash.

A text's words (split at ASCII white space, A-Z lower-cased) make shingles of
``WIDTH`` words, held as a set of 64-bit hashes; a shorter text is one
shingle.  Texts with equal sets are one node.  Candidates are

* the nodes whose SimHash fingerprints (of the same hashes) differ in at most
  2 bits, found by ``simhash``'s Golay keys, and
* the nodes that share one of ``BANDS`` keys of ``ROWS`` minimal hashes.  Two
  nodes at similarity s share a key with probability 1 - (1 - s**ROWS)**BANDS,
  which is 0.999997 at 0.8 and more above.

The second kind is needed because 64 bits of SimHash don't reach down to 0.8:
there two texts differ in about 10 bits, and so do many that have little in
common.  Every candidate pair is verified by the similarity of its sets.

A key with more than ``HOT`` nodes makes no pairs of all.  First its nodes are
compared with ``HEADS`` of them, the same ones in every band that holds them,
which mostly puts them into one component, where further links change
nothing.  If a key's nodes are then in several components, all its nodes go
through a prefix filter: a node's shingles are ordered by how rare they are
among these nodes, and two sets at ``SIMILARITY`` or more have one in common
among the first ``n - ceil(SIMILARITY * n) + 1`` of each.  Nodes of different
components that share such a shingle are compared: all of them for a shingle of
at most ``HOT`` nodes; where a shingle has more, each node with one of them
first, another one for each shingle.  If the nodes of such a shingle are still in
several components, all of them are compared, within tasks: they and
those that they share such shingles with are a cluster, cut into blocks
of bounded size, and every two blocks of a cluster meet in a task, which counts the
common shingles of their nodes and gives no more links than join its components.
So no link between two components of a key is lost.

Null, empty and blank texts have the empty set and are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import simhash
from .common import discard, slices, utf8, written
from .components import connected_components

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 5
HOT, HEADS = 32, 4
#: Shingles of texts that a task of the verification keeps.
KEPT_SHINGLES = 1 << 20
#: Shingles of a block of texts that are all compared with each other and with those of other blocks.
BLOCK_SHINGLES = 1 << 19
_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = text.translate(simhash._LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)), np.uint64, n))


def band_keys(own: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band."""
    if not len(own):
        return []
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 512):
        np.minimum(least, (own[at : at + 512, None] * _FACTORS[None, :]).min(axis=0), out=least)
    return np.asarray([xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64).tolist()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if len(a) or len(b) else 1.0


def marks(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """row, node (a hash of the text's set), f (its fingerprint) and keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            nodes, prints, keys = [], [], []
            for text in utf8(part.column(1)):
                own = shingles(text, width)
                nodes.append(xxhash.xxh64_intdigest(own.tobytes()))
                prints.append(simhash.majority(own))
                keys.append(band_keys(own))
            signed = lambda x: pa.array(np.asarray(x, np.uint64).view(np.int64))
            yield pa.record_batch([part.column(0), signed(nodes), signed(prints), pa.array(keys, pa.list_(pa.int64()))], names=["row", "node", "f", "keys"])

    return rows.mapInArrow(run, "row long, node long, f long, keys array<long>")


def by_fingerprint(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes (node, f) whose fingerprints differ in at most 2 bits, each fingerprint by its smallest node."""
    heads = written(nodes.groupBy("f").agg(F.min("node").alias("head")), "fingerprint-heads")
    close, crowded = simhash.candidates(heads.select("f"))
    links = close.unionByName(simhash.halfway_links(crowded))
    named = lambda k: heads.select(F.col("f").alias(k), F.col("head").alias(f"n_{k}"))
    between = links.join(named("a"), "a").join(named("b"), "b").select(F.col("n_a").alias("a"), F.col("n_b").alias("b"))
    same = nodes.join(heads, "f").where("node != head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    return between.unionByName(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def by_bands(nodes: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of nodes (node, keys), and the rows (k, node) of the keys with more than ``hot`` nodes, a written table."""
    spark = nodes.sparkSession
    keyed = written(nodes.select("node", F.explode("keys").alias("k")), "band-keys")
    # written, so that the rows of a frequent key can be split in the join
    sizes = written(keyed.groupBy("k").agg(F.count("*").alias("n")).where("n > 1"), "band-sizes")
    few_sizes, many_sizes = sizes.where(F.col("n") <= hot), sizes.where(F.col("n") > hot)
    few = written(keyed.join(few_sizes, "k").select("k", "node"), "band-groups")
    many = written(keyed.hint("merge").join(many_sizes, "k").select("k", "node"), "crowded-bands")
    discard(spark, keyed)
    pairs = few.select("k", F.col("node").alias("a")).join(few.select("k", F.col("node").alias("b")), "k").where("a < b").select("a", "b")
    first = [F.min(F.struct(F.xxhash64("node", F.lit(i)).alias("order"), "node"))["node"] for i in range(HEADS)]
    heads = written(many.groupBy("k").agg(F.array(*first).alias("heads")).select("k", F.array_distinct("heads").alias("heads")), "band-heads")
    stars = many.hint("merge").join(heads, "k").select("node", F.explode("heads").alias("head")).where("node != head").select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b"))
    return pairs.unionByName(stars), many


def _sets(width: int):
    """For batches whose last column is a text: its shingles instead, as hs."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.num_columns - 1
            for part in slices(iter([batch]), at):
                sets = [shingles(t, width) for t in utf8(part.column(at))]
                yield pa.record_batch([*part.columns[:at], pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=[*part.schema.names[:at], "hs"])

    return cut


def prefixes(many: DataFrame, parts: DataFrame, texts_of, width: int, least: float) -> DataFrame | None:
    """h, node, part, n: the shingles of the prefixes of the nodes whose keys (k, node) hold several components, a written table; None if no key does."""
    placed = written(many.join(parts, "node", "left").select("k", "node", F.coalesce("component", "node").alias("part")), "placed-nodes")
    split = written(placed.groupBy("k").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low != high").select("k"), "split-bands")
    nodes = written(placed.hint("merge").join(split, "k").select("node", "part").distinct(), "open-nodes")
    if nodes.isEmpty():
        return None

    sets = texts_of(nodes.select("node")).join(nodes, "node").select("node", "part", "text").mapInArrow(_sets(width), "node long, part long, hs array<long>")
    each = written(sets.select("node", "part", F.size("hs").alias("n"), F.explode("hs").alias("h")), "open-shingles")
    shared = written(each.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "shared-shingles")
    # a shingle of one node only can't be common: it fills a place of the prefix
    held = each.hint("merge").join(shared, "h")
    order = W.partitionBy("node").orderBy("df", "h")
    ranked = held.withColumn("place", F.row_number().over(order)).withColumn("held", F.count("*").over(W.partitionBy("node")))
    prefix = F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1
    return written(ranked.where(F.col("place") <= prefix - (F.col("n") - F.col("held"))).select("h", "node", "part", "n"), "shingle-prefixes")


def by_prefix(many: DataFrame, parts: DataFrame, texts_of, width: int, least: float, hot: int = HOT) -> DataFrame | None:
    """Pairs of nodes of different components among those of keys (k, node) that hold several; None if no key does."""
    kept = prefixes(many, parts, texts_of, width, least)
    return None if kept is None else prefix_pairs(kept, least, hot)


def prefix_pairs(kept: DataFrame, least: float, hot: int = HOT) -> DataFrame:
    """Pairs of nodes of different components that share a shingle of ``prefixes``: all of them where at most ``hot`` do, else each with one."""
    groups = written(kept.groupBy("h").agg(F.count("*").alias("size"), F.min("part").alias("low"), F.max("part").alias("high"), F.min(F.struct(F.xxhash64("node", "h").alias("order"), "node", "part", "n")).alias("head")).where("low != high").select("h", "size", "head"), "prefix-groups")
    few = written(kept.join(groups.where(F.col("size") <= hot).select("h"), "h"), "prefix-pairs")
    side = lambda p: few.select("h", *[F.col(c).alias(f"{p}_{c}") for c in ("node", "part", "n")])
    fits = lambda a, b: F.least(a, b) >= F.greatest(a, b) * least - 1e-9
    pairs = side("a").join(side("b"), "h").where((F.col("a_node") < F.col("b_node")) & (F.col("a_part") != F.col("b_part")) & fits("a_n", "b_n")).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    many_rows = kept.hint("merge").join(groups.where(F.col("size") > hot).select("h", "head"), "h")
    stars = many_rows.where((F.col("part") != F.col("head.part")) & fits(F.col("n"), F.col("head.n"))).select(F.least("node", "head.node").alias("a"), F.greatest("node", "head.node").alias("b"))
    return pairs.unionByName(stars).distinct()


def _links(nodes: np.ndarray, parts: np.ndarray, blocks: np.ndarray, lens: np.ndarray, hs: np.ndarray, least: float) -> tuple[list, list]:
    """Links between similar sets of different components that join the components of two blocks (or of one), each component by one link at most."""
    ends = np.cumsum(lens)
    _, sid, times = np.unique(hs, return_inverse=True, return_counts=True)
    holders = np.repeat(np.arange(len(nodes)), lens)[np.argsort(sid, kind="stable")]
    starts = np.cumsum(times) - times
    root = np.unique(parts, return_inverse=True)[1]
    one, last = blocks.min() == blocks.max(), blocks.max()
    a, b = [], []
    for i in range(len(nodes)):
        if not one and blocks[i] == last:
            continue
        fits = (root != root[i]) & (np.minimum(lens, lens[i]) >= np.maximum(lens, lens[i]) * least - 1e-9)
        if one:
            fits[:i] = False
        else:
            fits &= blocks == last
        if not fits.any():
            continue
        own = sid[ends[i] - lens[i] : ends[i]]
        t = times[own]
        common = np.bincount(holders[np.repeat(starts[own] - np.cumsum(t) + t, t) + np.arange(t.sum())], minlength=len(nodes))
        for j in np.flatnonzero(fits & (common / (lens + lens[i] - common) >= least)):
            if root[j] != root[i]:
                a.append(int(nodes[i]))
                b.append(int(nodes[j]))
                root[root == root[j]] = root[i]
    return a, b


def by_blocks(kept: DataFrame, parts: DataFrame, texts_of, width: int, least: float, hot: int = HOT, limit: int = BLOCK_SHINGLES) -> DataFrame | None:
    """Links (a, b) that join the components of every shingle of ``prefixes`` with more than ``hot`` nodes, as all pairs would; None if each such shingle has one component."""
    placed = written(kept.select("h", "node", "n").join(parts, "node", "left").select("h", "node", "n", F.coalesce("component", "node").alias("part")), "placed-prefixes")
    split = written(placed.groupBy("h").agg(F.count("*").alias("size"), F.min("part").alias("low"), F.max("part").alias("high"), F.min("node").alias("head")).where((F.col("size") > hot) & (F.col("low") != F.col("high"))).select("h", "head"), "split-prefixes")
    if split.isEmpty():
        return None
    rows = placed.hint("merge").join(split, "h")
    clusters = connected_components(rows.select(F.col("node").alias("a"), F.col("head").alias("b")))
    nodes = written(rows.select("node", "part", "n").distinct().join(clusters, "node"), "cluster-nodes")
    sizes = nodes.groupBy("component").agg(F.ceil(F.sum("n") / limit).alias("m"))
    dealt = nodes.join(sizes, "component").select("node", "part", "component", "m", F.pmod(F.xxhash64("node"), "m").alias("block"))
    sets = texts_of(nodes.select("node")).join(dealt, "node").select("node", "part", "component", "m", "block", "text").mapInArrow(_sets(width), "node long, part long, component long, m long, block long, hs array<long>")
    met = sets.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("other")).select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "part", "hs")

    def run(table: pa.Table) -> pa.Table:
        numbers = lambda c: table.column(c).to_numpy()
        hs = table.column("hs").combine_chunks()
        a, b = _links(numbers("node"), numbers("part"), numbers("block"), hs.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), hs.flatten().to_numpy(zero_copy_only=False), least)
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return met.groupBy("component", "i", "j").applyInArrow(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, width: int = WIDTH, least: float = SIMILARITY) -> DataFrame:
    """The pairs whose sets are similar enough; ``texts`` has one text for each node.  A task keeps the sets of some texts, since heads come again and again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        size = 0

        def set_of(node: int, column: pa.Array, k: int) -> np.ndarray:
            nonlocal size
            if node not in kept:
                if size > KEPT_SHINGLES:
                    kept.clear()
                    size = 0
                kept[node] = shingles(column[k].as_buffer().to_pybytes() if column[k].is_valid else b"", width)
                size += len(kept[node])
            return kept[node]

        for part in slices(batches, 2):
            pairs = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
            good = [similarity(set_of(a, part.column(2), k), set_of(b, part.column(3), k)) >= least for k, (a, b) in enumerate(pairs)]
            yield part.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    one = lambda k: texts.select(F.col("node").alias(k), F.col("text").alias(f"text_{k}"))
    return pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def joined(parts: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, component; any other node is its own) after further links (a, b) of nodes; a component is a node of these links."""
    named = lambda k: parts.select(F.col("node").alias(k), F.col("component").alias(f"part_{k}"))
    part = lambda k: F.coalesce(f"part_{k}", k)
    between = links.join(named("a"), "a", "left").join(named("b"), "b", "left").select(part("a").alias("a"), part("b").alias("b"))
    merged = written(connected_components(between).select(F.col("node").alias("component"), F.col("component").alias("whole")), "merged-components")
    own = parts.join(merged, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    return own.unionByName(merged.join(parts.select("node"), F.col("component") == F.col("node"), "left_anti").select(F.col("component").alias("node"), F.col("whole").alias("component")))


def kept_rows(rows: DataFrame, width: int = WIDTH, least: float = SIMILARITY, hot: int = HOT) -> DataFrame:
    """row of the one row of each component that stays: the smallest doc_id (none comes last), then the smallest hash of the text.

    ``rows`` has row (distinct longs), doc_id and text, and is read several times.
    """
    spark = rows.sparkSession
    marked = written(marks(rows.select("row", F.col("text").cast("string")), width), "marks")
    own = written(marked.groupBy("node").agg(F.min("row").alias("row"), F.first("f").alias("f"), F.first("keys").alias("keys")), "nodes")

    def texts_of(nodes: DataFrame) -> DataFrame:
        return rows.select("row", F.col("text").cast("string")).join(nodes.join(own.select("node", "row"), "node"), "row").select("node", "text")

    def links_of(candidates: DataFrame) -> DataFrame:
        pairs = written(candidates.distinct(), "candidate-pairs")
        texts = written(texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "candidate-texts")
        links = written(verified(pairs, texts, width, least), "similar-pairs")
        discard(spark, pairs, texts)
        return links

    banded, many = by_bands(own.select("node", "keys"), hot)
    links = links_of(banded.unionByName(by_fingerprint(own.select("node", "f"))))
    parts = connected_components(links)
    kept = prefixes(many, parts, texts_of, width, least)
    if kept is not None:
        parts = joined(parts, links_of(prefix_pairs(kept, least, hot)))
        between = by_blocks(kept, parts, texts_of, width, least, hot)
        if between is not None:
            parts = joined(parts, written(between, "block-links"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text"), "row")
    placed = rows.select("row", place.alias("place")).join(marked.select("row", "node"), "row")
    best = placed.groupBy("node").agg(F.min("place").alias("place"))
    named = best.join(parts, "node", "left").select(F.coalesce("component", "node").alias("component"), "place")
    return named.groupBy("component").agg(F.min("place").alias("place")).select(F.col("place")["row"].alias("row"))

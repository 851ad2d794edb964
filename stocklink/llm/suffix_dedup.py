"""Exact removal of repeated substrings by blockwise suffix sorting.

A byte goes if a ``WIDTH``-byte string that also starts anywhere else covers
it.  Only suffixes that can have an equal one are sorted:

* Every window of ``WIDTH`` bytes names an anchor, the place in it whose
  ``GRAM`` bytes have the smallest hash.  Equal windows name equal grams at
  equal distances.  The windows of one anchor are a block, which gives one row
  with the hashes of its gram and of its whole bytes: about one row for 75
  bytes.
* A gram that occurs once has no repeated window.  Where all blocks of a gram
  are equal, all their windows are repeated.  This is settled by sums that
  combine before the shuffle.
* Blocks that share a gram but differ (about the edges of repeated passages)
  send their bytes to the gram's bucket, one for all equal blocks.  Buckets
  are sorted one after the other with the difference cover, and neighbours
  that agree in ``WIDTH`` bytes are repeated; bytes are compared, not hashes.
  A gram with more than ``HOT`` different blocks isn't gathered: its windows
  are counted by a 128-bit hash of their bytes.

Null and empty texts, and texts shorter than ``WIDTH``, lose nothing; a text
longer than ``PIECE`` is cut into blocks piece by piece, which changes no
window; rows are told apart by a number that each is given, so repeated rows
repeat each other; further columns pass by unread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks as cut
from .common import discard, slices, utf8, written
from .suffix_sort import PERIOD, equal_neighbours, suffix_order, words_of

WIDTH, GRAM, PIECE, HOT = 200, 50, 4 << 20, 4096
#: Bytes of different blocks that are sorted at once.
SORT_BYTES = 2 << 20


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random numbers for the bytes, and the powers of an odd base and of its inverse modulo 2**64."""
    numbers = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    powers, inverses = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)])) for b in (np.uint64(base), np.uint64(inverse)))
    return numbers, powers, inverses


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes from each position on."""
    numbers, powers, inverses = _powers(PIECE + (64 << 10))
    n = len(data)
    if n < gram:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(numbers[data] * powers[:n])])
    h = (sums[gram:] - sums[: n - gram + 1]) * inverses[: n - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def anchored(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, anchor, gram's hash) of the blocks of texts that lie at begins..ends in ``data``."""
    h = gram_hashes(data, gram)
    reach = width - gram + 1
    if len(h) < reach:
        return (np.zeros(0, np.int64),) * 3 + (h[:0],)
    place = np.uint64((1 << 24) - 1)
    least = (h & ~place) | np.arange(len(h), dtype=np.uint64)  # the leftmost of equal ones
    span = 1
    while span * 2 <= reach:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < reach:
        least = np.minimum(least[: len(h) - reach + 1], least[reach - span : reach - span + len(h) - reach + 1])
    counts = np.maximum(0, ends - begins - width + 1)
    owner = np.repeat(np.arange(len(begins)), counts)
    at = begins[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    anchor = (least[at] & place).astype(np.int64)
    opens = np.ones(len(at), bool)
    opens[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(opens)
    return at[first], np.diff(np.append(first, len(at))), anchor[first], h[anchor[first]]


BLOCKS = "gram long, block long, doc long, first int, shape int"


def block_rows(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """A row for each block of each document (column doc, text): hashes, first window, and windows and anchor's distance in one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in slices(batches, 1):
            texts, keys = utf8(batch.column(1)), np.asarray(batch.column(0))
            for a, b in cut([len(t) for t in texts], PIECE // 4):
                pieces = [(i, at, texts[i][at : at + PIECE + width - 1] if len(texts[i]) > PIECE else texts[i]) for i in range(a, b) for at in range(0, max(1, len(texts[i]) - width + 1), PIECE)]
                groups = [[p] for p in pieces] if len(pieces) > b - a else [pieces]
                for group in groups:
                    data = b"".join(p[2] for p in group)
                    lens = np.asarray([len(p[2]) for p in group])
                    ends = np.cumsum(lens)
                    first, windows, anchor, h = anchored(np.frombuffer(data, np.uint8), ends - lens, ends, width, gram)
                    owner = np.searchsorted(ends, first, side="right")
                    back = anchor - first
                    whole = np.fromiter((digest(data[f : f + w + width - 1], d) for f, w, d in zip(first.tolist(), windows.tolist(), back.tolist(), strict=True)), np.uint64, len(first))
                    local = first - (ends - lens)[owner] + np.asarray([p[1] for p in group])[owner]
                    doc = keys[np.asarray([p[0] for p in group])[owner]]
                    yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(doc), pa.array(local.astype(np.int32)), pa.array((windows << 12 | back).astype(np.int32))], names=["gram", "block", "doc", "first", "shape"])

    return docs.mapInArrow(run, BLOCKS)


def repeated_windows(contexts: list[bytes], several: list[bool], width: int = WIDTH, backs: list[int] | None = None) -> list[np.ndarray]:
    """For the windows of each context, whether they are repeated in another one, or the context itself is there several times.

    Contexts are laid so that their anchors have equal residues, which equal
    windows then share.
    """
    backs = backs or [0] * len(contexts)
    parts, starts, at = [], [], 0
    for context, back in zip(contexts, backs, strict=True):
        pad = -(at + back) % PERIOD
        parts += [bytes(pad), context]
        starts.append(at + pad)
        at += pad + len(context)
    text = np.frombuffer(b"".join(parts), np.uint8)
    counts = np.asarray([len(c) - width + 1 for c in contexts])
    owner = np.repeat(np.arange(len(contexts)), counts)
    ends = np.cumsum(counts)
    positions = np.asarray(starts)[owner] + np.arange(len(owner)) - (ends - counts)[owner]
    words = words_of(text)
    order = suffix_order(text, positions, width, words)
    same = equal_neighbours(len(text), words, order, width)
    again = same.copy()
    again[:-1] |= same[1:]
    flags = np.zeros(len(text) + 1, bool)
    flags[order[again]] = True
    hit = flags[positions] | np.asarray(several)[owner]
    return [hit[e - c : e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]


def _spans(hit: np.ndarray, first: int, width: int) -> bytes:
    """Byte ranges that the repeated windows cover, as pairs of 64-bit numbers."""
    edge = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
    return (np.stack([edge[::2] + first, edge[1::2] + first + width - 1], 1)).astype("<i8").tobytes()


def repeated_spans(keyed: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc, spans (binary: pairs of byte positions) for documents (doc: a number of its own, text); a document may get several rows.  A written table."""
    spark = keyed.sparkSession
    rows = written(block_rows(keyed, width, gram), "blocks")
    alike = rows.groupBy("gram").agg(F.count("*").alias("n"), F.min("block").alias("low"), F.max("block").alias("high")).where("n > 1").select("gram", (F.col("low") == F.col("high")).alias("alike"))
    # written, so that the rows of a frequent gram can be split in the join: an aggregate beside it would need them together
    grams = written(alike, "grams")
    shared = written(rows.hint("merge").join(grams, "gram"), "shared-blocks")
    discard(spark, rows, grams)
    mixed = shared.where("not alike")
    kinds = mixed.groupBy("gram", "block").agg(F.count("*").alias("n"), F.min(F.struct("doc", "first", "shape")).alias("one")).select("gram", "block", "n", "one.*")
    kinds = written(kinds, "kinds")
    per_gram = written(kinds.groupBy("gram").agg(F.count("*").alias("kinds")), "gram-kinds")
    sized = written(kinds.hint("merge").join(per_gram, "gram"), "block-kinds")
    windows = F.shiftright("shape", 12)
    full = F.struct(F.col("first").cast("long").alias("a"), (F.col("first") + windows + (width - 1)).cast("long").alias("b"))
    # a merge join of stored tables splits the rows of a block that is there very often
    repeated = written(sized.where("n > 1").select("gram", "block"), "repeated-blocks")
    several = mixed.hint("merge").join(repeated, ["gram", "block"])
    whole = shared.where("alike").select("doc", full.alias("s")).unionByName(several.select("doc", full.alias("s"))).select("doc", "s.a", "s.b")

    asked = sized.groupBy("doc").agg(F.collect_list(F.struct("first", "shape", "gram", "n", "kinds")).alias("asked"))
    texts = keyed.join(asked, "doc")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"first": pa.int32(), "shape": pa.int32(), "doc": pa.int64(), "gram": pa.int64(), "n": pa.int64(), "kinds": pa.int64(), "context": pa.binary()}

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[c] for r in rows], t) for c, t in kinds.items()], names=list(kinds))

        rows, size = [], 0
        for batch in slices(batches, 1):
            for i, (doc, text) in enumerate(zip(np.asarray(batch.column(0)).tolist(), utf8(batch.column(1)), strict=True)):
                for r in batch.column(2)[i].as_py():
                    context = text[r["first"] : r["first"] + (r["shape"] >> 12) + width - 1]
                    rows.append(r | {"doc": doc, "context": context})
                    size += len(context)
                if size > SORT_BYTES:
                    yield batch_of(rows)
                    rows, size = [], 0
        yield batch_of(rows)

    cut_out = written(texts.select("doc", "text", "asked").mapInArrow(split, "first int, shape int, doc long, gram long, n long, kinds long, context binary"), "contexts")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def bucket(group: list[tuple]) -> pa.RecordBatch:
            hits = repeated_windows([r[4] for r in group], [r[3] > 1 for r in group], width, [r[1] & 4095 for r in group])
            out = [(r[2], _spans(h, r[0], width)) for r, h in zip(group, hits, strict=True) if r[3] == 1 and h.any()]
            return pa.record_batch([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], names=["doc", "spans"])

        gram = None
        for batch in slices(batches, 5):
            first, shape, doc, n, grams, context = (batch.column(k).to_pylist() for k in range(6))
            for row in zip(first, shape, doc, n, context, grams, strict=True):
                if size >= SORT_BYTES and row[5] != gram:
                    yield bucket(held)
                    held, size = [], 0
                gram = row[5]
                held.append(row)
                size += len(row[4])
        if held:
            yield bucket(held)

    few = cut_out.where(F.col("kinds") <= hot).select("first", "shape", "doc", "n", "gram", "context")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sorted_spans = few.repartition(parts, "gram").sortWithinPartitions("gram").mapInArrow(sort, "doc long, spans binary")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4):
            for first, shape, doc, n, context in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                m = shape >> 12
                digests = b"".join(xxhash.xxh3_128_digest(context[k : k + width]) for k in range(m))
                two = np.frombuffer(digests, ">i8").reshape(-1, 2)
                yield pa.record_batch([pa.array(two[:, 0].astype(np.int64)), pa.array(two[:, 1].astype(np.int64)), pa.array([doc] * m, pa.int64()), pa.array(np.arange(first, first + m)), pa.array([n] * m, pa.int64())], names=["h1", "h2", "doc", "a", "n"])

    many = cut_out.where(F.col("kinds") > hot).select("first", "shape", "doc", "n", "context").mapInArrow(explode, "h1 long, h2 long, doc long, a long, n long")
    counted = many.groupBy("h1", "h2").agg(F.count("*").alias("times")).where("times > 1")
    hot_spans = many.where("n = 1").join(counted, ["h1", "h2"]).select("doc", "a", (F.col("a") + width).alias("b"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = np.stack([np.asarray(batch.column(1)), np.asarray(batch.column(2))], 1).astype("<i8")
            yield pa.record_batch([batch.column(0), pa.array([p.tobytes() for p in pairs], pa.binary())], names=["doc", "spans"])

    spans = written(sorted_spans.unionByName(whole.unionByName(hot_spans).mapInArrow(pack, "doc long, spans binary")), "spans")
    discard(spark, shared, kinds, per_gram, sized, repeated, cut_out)
    return spans


def merge(spans: list[bytes]) -> list[tuple[int, int]]:
    """Maximal ranges from pairs in any order."""
    pairs = np.frombuffer(b"".join(spans), "<i8").reshape(-1, 2)
    if not len(pairs):
        return []
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    opens = np.flatnonzero(np.append(True, pairs[1:, 0] > reach[:-1]))
    return list(zip(pairs[opens, 0].tolist(), reach[np.append(opens[1:] - 1, len(pairs) - 1)].tolist(), strict=True))


def remove_repeats(docs: DataFrame, width: int = WIDTH, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document, and the kept bytes if asked for."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # written, so that a row keeps its number
    keyed = written(docs.select(F.monotonically_increasing_id().alias("doc"), text.alias("text"), F.col("doc_id").cast("long").alias("doc_id")), "numbered")
    spans = repeated_spans(keyed.select("doc", "text"), width).groupBy("doc").agg(F.collect_list("spans").alias("spans"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            out = []
            for data, own in zip(utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                ranges = merge(own) if own else []
                kept, at = [], 0
                for a, b in ranges:
                    kept.append(data[at:a])
                    at = b
                kept = b"".join([*kept, data[at:]]) if ranges else data
                out.append((len(data), len(data) - len(kept), len(ranges), hashlib.sha256(kept).hexdigest(), kept))
            numbers = [pa.array([o[k] for o in out], pa.int64()) for k in range(3)]
            yield pa.record_batch([batch.column(0), *numbers, pa.array([o[3] for o in out], pa.string())] + [pa.array([o[4] for o in out], pa.binary())] * texts, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * texts)

    return keyed.join(spans, "doc", "left").select("doc_id", "text", "spans").mapInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts)

"""Line deduplication: hashes in sorted ranges, streamed, with keep bitmaps as the result.

Each document gives one row for each of its distinct long keys: the key's
128-bit hash (columns h and g), the document and the positions.  Rows are dealt out by range of
(hash, document), so that a hash with very many rows takes several ranges,
and sorted in each.  A task streams its range and keeps the first document of
each hash.  The run of a hash at a range's edge may go on in the next range;
such rows are held back, and are settled by a table of one smallest document
for each edge, two rows a range at most.

A keep bitmap has one bit for each line (1: keep), zlib-compressed.  Null and
empty texts are one empty line, which is never dropped; lines of short keys
stay; a key that repeats within one document only stays; equal doc_ids count
as one document, but each of its texts has a bitmap of its own.  Further columns pass by unread.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, slices, strings, written

#: White space that is stripped from a line, and the case that is folded, for its key.
BLANK = " \t\n\x0b\x0c\r"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MIN_CHARS = 10


def keys(text: str) -> list[str]:
    """The key of each line."""
    return [line.strip(BLANK) for line in (text.lower() if text.isascii() else text.translate(_LOWER)).split("\n")]


def key_rows(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """h and g (the hash), doc_id, t (a hash of the text), and the lines' positions (little-endian 32-bit) for each distinct long key of each document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in slices(batches, 1):
            hashes, docs_, texts, places = [], [], [], []
            for doc, text, t in zip(batch.column(0).to_pylist(), strings(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                own: dict[str, list[int]] = {}
                for k, key in enumerate(keys(text)):
                    if len(key) >= min_chars:
                        own.setdefault(key, []).append(k)
                for key, at in own.items():
                    hashes.append(digest(key))
                    docs_.append(doc)
                    texts.append(t)
                    places.append(at[0].to_bytes(4, "little") if len(at) == 1 else np.asarray(at, "<u4").tobytes())
            yield _rows(hashes, docs_, texts, places)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string"))).mapInArrow(rows, "h long, g long, doc_id long, t long, places binary")


def _rows(hashes: list[bytes], docs: list, texts: list[int], places: list[bytes]) -> pa.RecordBatch:
    halves = np.frombuffer(b"".join(hashes), ">i8").astype(np.int64).reshape(-1, 2)
    return pa.record_batch([pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(docs, pa.int64()), pa.array(texts, pa.int64()), pa.array(places, pa.binary())], names=["h", "g", "doc_id", "t", "places"])


STREAMED = "edge long, h long, g long, doc_id long, t long, places binary"


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows to drop have no edge.  Rows of the range's first hash, undecided, and the first row of its last one have edge 1 and 0."""
    first = last = keeper = None
    for batch in batches:
        h, g = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        if not len(h):
            continue
        doc = np.asarray(batch.column(2))
        if first is None:
            first = (int(h[0]), int(g[0]))
        opens = np.empty(len(h), bool)
        opens[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        opens[0] = last is None or (int(h[0]), int(g[0])) != last
        run = np.cumsum(opens) - 1
        heads = doc[opens]
        keep = np.where(run < 0, keeper if keeper is not None else 0, heads[np.maximum(run, 0)] if len(heads) else 0)
        edge = (h == first[0]) & (g == first[1])
        dropped = ~edge & (doc != keep)
        last, keeper = (int(h[-1]), int(g[-1])), int(keep[-1])
        chosen = np.flatnonzero(dropped | edge)
        if len(chosen):
            take = pa.array(chosen)
            yield pa.record_batch([pa.array(np.where(edge[chosen], 1, 0), pa.int64(), mask=~edge[chosen]), *(c.take(take) for c in batch.columns)], names=["edge", "h", "g", "doc_id", "t", "places"])
    if last != first:
        yield pa.record_batch([pa.array([0], pa.int64()), pa.array([last[0]], pa.int64()), pa.array([last[1]], pa.int64()), pa.array([keeper], pa.int64()), pa.array([None], pa.int64()), pa.array([b""])], names=["edge", "h", "g", "doc_id", "t", "places"])


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, t and places of the lines that go."""
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # read twice: by the sample that finds the ranges, and by the ranges
    rows = written(key_rows(docs, min_chars).where(F.col("doc_id").isNotNull()), "line-keys")
    ranged = rows.repartitionByRange(parts, "h", "g", "doc_id").sortWithinPartitions("h", "g", "doc_id")
    streamed = written(ranged.mapInArrow(_stream, STREAMED), "line-runs")
    discard(spark, rows)
    # two rows a range at most
    keepers = streamed.where(F.col("edge").isNotNull()).groupBy("h", "g").agg(F.min("doc_id").alias("keeper"))
    edges = streamed.where("edge = 1").join(F.broadcast(keepers), ["h", "g"]).where("doc_id != keeper")
    return streamed.where("edge is null").select("doc_id", "t", "places").unionByName(edges.select("doc_id", "t", "places"))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, t and the compressed bitmap of the lines to drop, for documents that lose any.

    The bits are gathered for one document at a time; a document's own lines
    bound them.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for places in batch.column(2).to_pylist():
                at = np.frombuffer(b"".join(places), "<u4")
                bits = np.ones(int(at.max()) + 1, np.uint8)
                bits[at] = 0
                maps.append(zlib.compress(np.packbits(bits).tobytes() + len(bits).to_bytes(4, "little"), 1))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(maps, pa.binary())], names=["doc_id", "t", "keep"])

    return dropped_lines(docs, min_chars).groupBy("doc_id", "t").agg(F.collect_list("places").alias("places")).mapInArrow(pack, "doc_id long, t long, keep binary")


def unpack(bitmap: bytes | None, n: int) -> np.ndarray:
    """Which of a document's n lines stay; a document without a bitmap, and lines beyond it, stay."""
    keep = np.ones(n, bool)
    if bitmap is not None:
        data = zlib.decompress(bitmap)
        k = min(n, int.from_bytes(data[-4:], "little"))
        keep[:k] = np.unpackbits(np.frombuffer(data[:-4], np.uint8), count=k).astype(bool)
    return keep


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every document, and the kept text if asked for."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            n, gone, digests, kept_texts = [], [], [], []
            for text, bitmap in zip(strings(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                lines = text.count("\n") + 1
                n.append(lines)
                kept = text
                dropped = 0
                if bitmap is not None:
                    keep = unpack(bitmap, lines)
                    dropped = int(lines - keep.sum())
                    kept = "\n".join(x for x, k in zip(text.split("\n"), keep.tolist(), strict=True) if k)
                gone.append(dropped)
                digests.append(hashlib.sha256(kept.encode()).hexdigest())
                if texts:
                    kept_texts.append(kept)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())]
            yield pa.record_batch(columns + [pa.array(kept_texts, pa.string())] * texts, names=["doc_id", "n_lines", "n_dropped", "kept_sha256"] + ["text"] * texts)

    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("t", F.xxhash64("text")).join(bitmaps, ["doc_id", "t"], "left")
    return joined.select("doc_id", "text", "keep").mapInArrow(apply, "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + ", text string" * texts)

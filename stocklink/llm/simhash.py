"""SimHash near-duplicates with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits.  A 23-bit
segment is decoded with the perfect Golay code: its keys are the codewords at
distance 4 or less, one if it lies within 2 of a codeword, else six.  Two
segments that differ in at most 2 bits share a key.  If two fingerprints
differ in at most 2 bits, then by the pigeonhole principle the first segments
are equal (and the second ones share a key), or the second ones are equal
(and the first ones share a key), or both differ in one bit and the third
ones are equal (and the first ones share a key).  Each case is a join key:
an exact segment with a codeword's index.  Distinct fingerprints meet by key,
and every candidate pair is verified by its real distance.

A key with more fingerprints than ``HOT`` makes no pairs.  Its fingerprints
are linked through midpoints: each one is linked to itself and to its 64
neighbours at distance 1, and two that differ in at most 2 bits have one in
common.  That is 65 rows a fingerprint, however large the group.

Null, empty and blank texts have fingerprint zero and are linked like any
other; rows with equal texts have equal fingerprints; a null doc_id is
carried along and never names a component; further columns pass by unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, slices, utf8, written
from .components import connected_components

SHINGLE, SEED, MAX_BITS = 3, 42, 2
#: Fingerprints a key may have before its links are found through midpoints.
HOT = 64
#: Generator polynomial of the binary Golay code of length 23.
GENERATOR = 0b101011100011
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes) -> int:
    """Bit k is set if it is set in more than half of the shingles' hashes."""
    words = text.translate(_LOWER).split()  # bytes.split() takes exactly \x20 and \x09-\x0D as space
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return digest(b" ".join(words), SEED)
    joined = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = ends - lens
    n = len(words) - SHINGLE + 1
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)), np.uint64, n)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """Bit k is set if it is set in more than half of the hashes; of none, none is."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and f, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            got = np.fromiter(map(fingerprint, utf8(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(got.view(np.int64))], names=["doc_id", "f"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, f long")


@cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """For each 23-bit vector: the index of its nearest codeword, and its distance from it.  Made from the generator polynomial."""
    code = np.zeros(4096, np.int32)
    for bit in range(12):
        code ^= np.where(np.arange(4096) >> bit & 1, GENERATOR << bit, 0).astype(np.int32)
    index, distance = np.zeros(1 << 23, np.int16), np.zeros(1 << 23, np.int8)
    masks = [(0, 0)] + [(1 << a, 1) for a in range(23)] + [(1 << a | 1 << b, 2) for a in range(23) for b in range(a)] + [(1 << a | 1 << b | 1 << c, 3) for a in range(23) for b in range(a) for c in range(b)]
    for mask, weight in masks:
        index[code ^ mask] = np.arange(4096)
        distance[code ^ mask] = weight
    return index, distance


def codeword_keys(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, codeword index) for the codewords at distance 4 or less of each 23-bit vector."""
    index, distance = golay()
    far = np.flatnonzero(distance[vectors] == 3)
    # a codeword at distance 4 is the nearest one to some neighbour of the vector
    around = vectors[far, None] ^ (1 << np.arange(23))[None, :]
    others = index[around]
    rows, cols = np.nonzero(others != index[vectors[far]][:, None])
    pairs = np.unique(np.stack([far[rows].astype(np.int64), others[rows, cols].astype(np.int64)]), axis=1) if len(rows) else np.zeros((2, 0), np.int64)
    return np.concatenate([np.arange(len(vectors)), pairs[0]]), np.concatenate([index[vectors].astype(np.int64), pairs[1]])


def candidate_keys(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, key) of the join keys of unsigned fingerprints; the case is in a key's two lowest bits."""
    a, b, c = ((f >> np.uint64(shift)).astype(np.int64) & mask for shift, mask in ((41, (1 << 23) - 1), (18, (1 << 23) - 1), (0, (1 << 18) - 1)))
    at_a, code_a = codeword_keys(a)
    at_b, code_b = codeword_keys(b)
    where = np.concatenate([at_b, at_a, at_a])
    keys = np.concatenate([(a[at_b] << 14) | (code_b << 2), (b[at_a] << 14) | (code_a << 2) | 1, (c[at_a] << 14) | (code_a << 2) | 2])
    return where, keys


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        f = np.asarray(batch.column(0))
        where, keys = candidate_keys(f.view(np.uint64))
        yield pa.record_batch([pa.array(keys), pa.array(f[where])], names=["k", "f"])


def candidates(distinct: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Verified pairs (a, b) of fingerprints (column f, distinct) that meet at a key, and the fingerprints at keys with more than ``hot``."""
    keyed = written(distinct.mapInArrow(_keys, "k long, f long"), "golay-keys")
    # written, so that the rows of a frequent key can be split in the join
    sizes = written(keyed.groupBy("k").agg(F.count("*").alias("n")).where("n > 1"), "golay-sizes")
    some = written(keyed.join(sizes, "k"), "golay-groups")
    discard(distinct.sparkSession, keyed, sizes)
    few = some.where(F.col("n") <= hot).select("k", "f")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    pairs = few.select("k", F.col("f").alias("a")).join(few.select("k", F.col("f").alias("b")), "k").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    return pairs, some.where(F.col("n") > hot).select("f").distinct()


def halfway_links(crowded: DataFrame) -> DataFrame:
    """Links (a, b) that join all of the fingerprints (column f) that differ in at most 2 bits, through points at distance 1 of both.

    A point's smallest fingerprint is linked to the others there, at most 64 of
    them; the point isn't checked against other links.
    """
    bits = F.array(*[F.lit(1 << k if k < 63 else -(1 << 63)) for k in range(64)])
    halfway = crowded.select("f", F.explode(F.concat(F.array(F.lit(0).cast("long")), bits)).alias("bit")).select("f", F.col("f").bitwiseXOR(F.col("bit")).alias("middle"))
    heads = halfway.groupBy("middle").agg(F.min("f").alias("head"), F.max("f").alias("last")).where("head != last").select("middle", "head")
    return halfway.join(heads, "middle").where("f != head").select(F.col("head").alias("a"), F.col("f").alias("b"))


def component_ids(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over links of at most 2 bits."""
    prints = written(fingerprints(docs), "fingerprints")
    own = written(prints.groupBy("f").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    pairs, crowded = candidates(own.select("f"))
    parts = connected_components(pairs.unionByName(halfway_links(crowded)))
    grouped = written(own.join(parts, own.f == parts.node, "left").select("f", "least", F.coalesce("component", "f").alias("part")), "fingerprint-parts")
    # stored, so that the rows of a giant component can be split in the join
    smallest = written(grouped.groupBy("part").agg(F.min("least").alias("component_id")), "component-names")
    named = written(grouped.hint("merge").join(smallest, "part").select("f", "component_id"), "named-fingerprints")
    return prints.join(named, "f").select("doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id")

"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` writes the training texts' index: texts are cut into segments
of about ``BLOCK_BYTES``, and a row holds the sorted places of one term in one
segment.  A frequent term has a row for each segment, so its postings never
meet in one task.  The benchmark is a table of phrases.  Its terms' rows are
taken out of the index by a join; a phrase's terms are ordered by how often
they occur in the whole index, and the segments that hold its rarest term are
searched for it: the places of the rarest term, less its offset in the phrase,
are intersected with those of the next rarer ones, for all phrases of a
segment at once.  What is left are the places where the phrase starts.
``proximity_matches`` returns places where all of a phrase's terms stand
within a number of words.  Nothing of either side goes to the driver but the
number of phrases; a segment meets ``SLICE`` phrases at a time.

A word is a run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are
lower-cased.  Null and empty texts have no words; an item without words is no
phrase; equal items are phrases of their own; items without item_id count as
one; repeated documents are searched each; further columns pass by unread.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, slices, utf8, written

#: Phrases that a segment is searched for at once.
SLICE = 1 << 17

#: ASCII: lower case, and all that is no digit or letter becomes a space.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: A segment has one row without term, which names its documents, and one for each of its terms.
INDEX = "seg long, term binary, places binary, doc_ids binary, none binary, lens binary"


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def windows(item: list[bytes], width: int) -> list[list[bytes]]:
    """All windows of ``width`` words; a shorter item that has words is one."""
    return [item[i : i + width] for i in range(max(1, len(item) - width + 1))] if item else []


class _Numbers(dict):
    """Term -> number, in order of appearance."""

    def __missing__(self, term):
        self[term] = n = len(self)
        return n


def _segment_rows(seg: int, ids: pa.Array, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
    split = [words(t) for t in texts]
    lens = np.fromiter(map(len, split), np.int32, len(split))
    number = _Numbers()
    every = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int32, int(lens.sum()))
    places = np.argsort(every, kind="stable").astype("<i4")
    ends = np.concatenate([[0], np.cumsum(np.bincount(every, minlength=len(number)))]).astype(np.int32) * 4
    names = [x.split()[0] for x in INDEX.split(", ")]
    head = [np.asarray(ids.fill_null(0)).astype("<i8").tobytes(), np.asarray(ids.is_null()).astype(np.uint8).tobytes(), lens.astype("<i4").tobytes()]
    yield pa.record_batch([pa.array([seg], pa.int64()), pa.array([None], pa.binary()), pa.array([None], pa.binary()), *(pa.array([h], pa.binary()) for h in head)], names=names)
    if number:
        n = len(number)
        listed = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(places)])
        yield pa.record_batch([pa.array(np.full(n, seg)), pa.array(list(number), pa.binary()), listed, *(pa.nulls(n, pa.binary()) for _ in range(3))], names=names)


def build_index(docs: DataFrame) -> DataFrame:
    """The index of the documents' words, written to the shared folder."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seg = TaskContext.get().partitionId() << 33
        for batch in slices(batches, 1):
            yield from _segment_rows(seg, batch.column(0), utf8(batch.column(1)))
            seg += 1

    return written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(build, INDEX), "index")


def documents(index: DataFrame) -> DataFrame:
    """seg, at (place in the segment), doc_id and n_words of every document of an index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seg, ids, none, lens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                known = np.frombuffer(ids, "<i8")
                doc_ids = pa.array(known, pa.int64(), mask=np.frombuffer(none, np.uint8).astype(bool))
                yield pa.record_batch([pa.array(np.full(len(known), seg)), pa.array(np.arange(len(known), dtype=np.int32)), doc_ids, pa.array(np.frombuffer(lens, "<i4").astype(np.int64))], names=["seg", "at", "doc_id", "n_words"])

    return index.where("term is null").select("seg", "doc_ids", "none", "lens").mapInArrow(run, "seg long, at int, doc_id long, n_words long")


def phrases_of(bench: DataFrame, width: int | None) -> DataFrame:
    """w (a number), item_id and terms of every window of the items, or of every item as a whole without ``width``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            split = [(i, words(t)) for i, t in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True)]
            items = [(i, w) for i, item in split for w in windows(item, width or max(1, len(item)))]
            yield pa.record_batch([pa.array([i for i, _ in items], pa.int64()), pa.array([w for _, w in items], pa.list_(pa.binary()))], names=["item_id", "terms"])

    made = bench.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "item_id long, terms array<binary>")
    return written(made.withColumn("w", F.monotonically_increasing_id()), "phrases")


class Segment:
    """The places of some terms in one segment, as one sorted array of term and place."""

    def __init__(self, tids: np.ndarray, places: list[bytes], lens: bytes):
        order = np.argsort(tids, kind="stable")
        lists = [np.frombuffer(places[k], "<i4") for k in order]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        self.tids, self.ends = tids[order], np.cumsum(counts)
        self.begins = self.ends - counts
        self.places = np.concatenate([np.zeros(0, np.int32), *lists]).astype(np.int64)
        self.keys = np.repeat(np.arange(len(lists)), counts) << 32 | self.places
        self.doc_ends = np.cumsum(np.frombuffer(lens, "<i4").astype(np.int64))

    def rank(self, tids: np.ndarray) -> np.ndarray:
        """The terms' numbers here; -1 for those that the segment lacks."""
        at = np.searchsorted(self.tids, tids)
        at[at == len(self.tids)] = 0
        return np.where(self.tids[at] == tids, at, -1) if len(self.tids) else np.full(len(tids), -1)

    def holds(self, ranks: np.ndarray, places: np.ndarray) -> np.ndarray:
        wanted = ranks << 32 | places
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        return (ranks >= 0) & (places >= 0) & (self.keys[at] == wanted) if len(self.keys) else np.zeros(len(wanted), bool)

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_ends, places, side="right")

    def starts(self, tids: np.ndarray, offsets: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, place where it starts) for phrases whose terms (rarest first) and offsets lie end to end."""
        first = np.cumsum(lens) - lens
        ranks = self.rank(tids)
        lead = ranks[first]
        counts = np.where(lead >= 0, self.ends[lead] - self.begins[lead], 0) if len(self.ends) else np.zeros(len(lens), np.int64)
        phrase = np.repeat(np.arange(len(lens)), counts)
        within = np.arange(len(phrase)) - np.repeat(np.cumsum(counts) - counts, counts)
        start = self.places[self.begins[lead[phrase]] + within] - offsets[first[phrase]] if len(phrase) else np.zeros(0, np.int64)
        for k in range(1, int(lens.max(initial=0))):
            more = lens[phrase] > k
            term = np.minimum(first[phrase] + k, len(tids) - 1)
            keep = ~more | self.holds(ranks[term], start + offsets[term])
            phrase, start = phrase[keep], start[keep]
        inside = (start >= 0) & (self.doc_of(start) == self.doc_of(start + lens[phrase] - 1)) if len(start) else np.zeros(0, bool)
        return phrase[inside], start[inside]

    def near(self, tids: np.ndarray, within: int) -> np.ndarray:
        """Places of the first (rarest) term with every other one at most ``within`` words away in the document."""
        ranks = self.rank(tids)
        if (ranks < 0).any():
            return np.zeros(0, np.int64)
        listed = [self.places[self.begins[r] : self.ends[r]] for r in dict.fromkeys(ranks.tolist())]
        at = listed[0]
        for other in listed[1:]:
            doc = self.doc_of(at)
            low = np.maximum(at - within, np.concatenate([[0], self.doc_ends])[doc])
            high = np.minimum(at + within, self.doc_ends[doc] - 1)
            at = at[np.searchsorted(other, low) < np.searchsorted(other, high, side="right")]
        return at


HITS = "seg long, at int, item_id long, start long, words int"


def _searched(index: DataFrame, phrases: DataFrame, search: Callable[[Segment, pa.Table], Iterator[tuple]]) -> DataFrame:
    """``HITS`` of every segment that has the rarest term of a phrase."""
    terms = written(phrases.select(F.explode("terms").alias("term")).distinct().withColumn("tid", F.monotonically_increasing_id()), "phrase-terms")
    # written: rows of a frequent term can be split in the joins below
    lists = written(index.where("term is not null").select("seg", "term", "places").join(terms, "term").select("seg", "tid", "places"), "phrase-postings")
    frequency = written(lists.groupBy("tid").agg(F.sum(F.length("places")).alias("n")), "term-frequencies")
    placed = phrases.select("w", "item_id", F.size("terms").alias("n_terms"), F.posexplode("terms").alias("offset", "term")).join(terms, "term").join(frequency, "tid")
    # a phrase's own terms are gathered; one that the index lacks leaves the phrase short, and it is left out
    ordered = placed.groupBy("w", "item_id", "n_terms").agg(F.array_sort(F.collect_list(F.struct("n", "offset", "tid"))).alias("t")).where(F.size("t") == F.col("n_terms"))
    plan = written(ordered.select("w", "item_id", F.transform("t", lambda x: x["tid"]).alias("tids"), F.transform("t", lambda x: x["offset"]).alias("offsets"), F.element_at("t", 1)["tid"].alias("tid")), "phrase-plans")
    parts = -(-max(1, plan.count()) // SLICE)
    part = F.pmod(F.xxhash64("w"), F.lit(parts)).cast("int")
    asked = lists.select(F.col("seg").alias("in_seg"), "tid").join(plan, "tid").select("in_seg", part.alias("in_part"), "item_id", "tids", "offsets")
    heads = index.where("term is null").select("seg", F.lit(-1).cast("long").alias("tid"), F.col("lens").alias("places"))
    given = lists.unionByName(heads).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        tids, places = np.asarray(left.column("tid")), left.column("places").to_pylist()
        head = int(np.flatnonzero(tids == -1)[0])
        own = np.arange(len(tids)) != head
        out = []
        if right.num_rows:
            segment = Segment(tids[own], [places[k] for k in np.flatnonzero(own)], places[head])
            for docs, items, starts, lens in search(segment, right):
                first = np.concatenate([[0], segment.doc_ends])[docs]
                out.append(pa.table({"seg": pa.array(np.full(len(docs), left.column("seg")[0].as_py())), "at": pa.array(docs.astype(np.int32)), "item_id": items, "start": pa.array(starts - first), "words": pa.array(lens.astype(np.int32))}))
        return pa.concat_tables(out) if out else pa.table({c.split()[0]: pa.array([], {"long": pa.int64(), "int": pa.int32()}[c.split()[1]]) for c in HITS.split(", ")})

    hits = written(given.groupBy("seg", "part").cogroup(asked.groupBy("in_seg", "in_part")).applyInArrow(run, HITS), "hits")
    discard(index.sparkSession, terms, lists, frequency, plan)
    return hits


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    whole = column.combine_chunks()
    return np.asarray(whole.flatten()).astype(np.int64), np.asarray(whole.value_lengths()).astype(np.int64)


def phrase_matches(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """``HITS`` of the places where a phrase's terms stand one after the other in one document."""

    def search(segment: Segment, asked: pa.Table) -> Iterator[tuple]:
        tids, lens = _flat(asked.column("tids"))
        phrase, start = segment.starts(tids, _flat(asked.column("offsets"))[0], lens)
        if len(phrase):
            yield segment.doc_of(start), asked.column("item_id").combine_chunks().take(pa.array(phrase)), start, lens[phrase]

    return _searched(index, phrases, search)


def proximity_matches(index: DataFrame, phrases: DataFrame, within: int) -> DataFrame:
    """``HITS`` of the places of a phrase's rarest term that have all its other terms within ``within`` words."""

    def search(segment: Segment, asked: pa.Table) -> Iterator[tuple]:
        for item, tids in zip(asked.column("item_id").to_pylist(), asked.column("tids").to_pylist(), strict=True):
            at = segment.near(np.asarray(tids, np.int64), within)
            if len(at):
                yield segment.doc_of(at), pa.array([item] * len(at), pa.int64()), at, np.ones(len(at), np.int64)

    return _searched(index, phrases, search)


def _covered(spans: Column) -> Column:
    """Words in any of the spans (start, words), which are sorted."""
    end = lambda s: s["start"] + s["words"]
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("hit"))
    step = lambda a, s: F.struct(F.greatest(a["end"], end(s)).alias("end"), (a["hit"] + F.greatest(F.lit(0), end(s) - F.greatest(a["end"], s["start"]))).alias("hit"))
    return F.aggregate(spans, zero, step)["hit"]


def contamination(docs: DataFrame, bench: DataFrame, width: int = 10) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    index = build_index(docs)
    hits = phrase_matches(index, phrases_of(bench, width))
    # a document's own hits are gathered
    found = hits.groupBy("seg", "at").agg(F.array_sort(F.collect_set(F.struct("start", F.col("words").cast("long").alias("words")))).alias("spans"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"), F.max(F.col("item_id").isNull().cast("int")).alias("unnamed"))
    digest = found.select("seg", "at", _covered(F.col("spans")).alias("n_hit"), (F.size("items") + F.col("unnamed")).cast("long").alias("n_items"), F.array_join("items", ",").alias("names"))
    none = F.lit(0).cast("long")
    return documents(index).join(digest, ["seg", "at"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", none).alias("n_hit"), F.coalesce("n_items", none).alias("n_items"), F.sha2(F.coalesce("names", F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", none) > 0).alias("contaminated"),
    )

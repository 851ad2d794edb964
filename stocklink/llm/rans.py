"""Token ids as static range-ANS blocks: the coder, the block format and the Spark write and read.

A dataset is a folder with two Parquet tables.  ``table`` holds the shared
frequency table, one row.  ``blocks`` holds independent blocks, each with the
whole ids of some documents: a header, the checkpoints, the word stream and a
CRC-32 of all of it.  In a block many lanes are interleaved: symbol k belongs
to lane k mod lanes.  Every lane has a 64-bit state which emits and takes 32
bits at a time.  The checkpoints hold the states and the place in the stream
after every ``CHECK`` symbols, so a long block can be decoded from several
places at once.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, shared_dir, slices, strings
from .units import RARE_SPACE, WordCache, cache_for, gathered, latin_word, split_closing, tokenizer

#: Frequencies sum to 2**SCALE; states stay in [2**31, 2**63).
SCALE, LOW, LANES, CHECK = 20, np.uint64(1 << 31), 2048, 1 << 17
#: A block is closed once it holds so many ids; its last document may carry it further.
BLOCK_IDS = 1 << 18
MAGIC = b"SLR1"


def normalise(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**SCALE, at least 1 for each symbol that occurs.

    The remainders decide who gets the units that rounding leaves; ties go to
    the lower id.  No symbols: an all-zero table.
    """
    counts = np.asarray(counts, np.float64)
    total = counts.sum()
    if not total:
        return np.zeros(len(counts), np.uint32)
    ideal = counts / total * (1 << SCALE)
    freq = np.where(counts > 0, np.maximum(1, np.floor(ideal)), 0).astype(np.int64)
    left = (1 << SCALE) - int(freq.sum())
    if left > 0:
        order = np.lexsort((np.arange(len(freq)), -(ideal - freq)))
        order = order[counts[order] > 0]
        freq[order] += left // len(order)
        freq[order[: left % len(order)]] += 1
    while left < 0:  # rare symbols were raised to 1: the most frequent give way
        rich = np.argsort(-freq, kind="stable")
        rich = rich[freq[rich] > 1][: max(1, -left)]
        take = np.minimum(freq[rich] - 1, np.maximum(1, -left * freq[rich] // max(1, int(freq[rich].sum()))))
        take = np.minimum(take, np.maximum(0, -left - (np.cumsum(take) - take)))
        freq[rich] -= take
        left += int(take.sum())
    return freq.astype(np.uint32)


class Table:
    """Frequencies with their prefix sums and, for decoding, the symbol of each slot."""

    def __init__(self, freq: np.ndarray):
        self.freq = np.asarray(freq, np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64) if len(freq) else self.freq
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots


def encode(ids: np.ndarray, table: Table) -> bytes:
    """One block."""
    n = len(ids)
    lanes = max(1, min(LANES, n // 16))
    rows = -(-n // lanes)
    freq, start = table.freq[ids], table.start[ids]
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    step = max(1, CHECK // lanes)
    marks: list[tuple[int, np.ndarray, int]] = []
    put, shift, room = 0, np.uint64(SCALE), np.uint64(63 - SCALE)
    mask = np.uint64(0xFFFFFFFF)
    for row in range(rows - 1, -1, -1):  # backwards, so that decoding goes forwards
        if (row + 1) % step == 0 and row + 1 < rows:
            marks.append((row + 1, state.copy(), put))
        f, s = freq[row * lanes : (row + 1) * lanes], start[row * lanes : (row + 1) * lanes]
        x = state[: len(f)]
        big = x >= (f << room)
        if big.any():
            out = (x[big] & mask).astype("<u4")
            words.append(out)
            put += len(out)
            x = np.where(big, x >> np.uint64(32), x)
        q = x // f
        state[: len(f)] = (q << shift) + (x - q * f) + s
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
    marks = [(row, x, put - at) for row, x, at in marks[::-1]]
    body = MAGIC + struct.pack("<IIII", n, lanes, len(marks), len(stream)) + state.astype("<u8").tobytes()
    body += b"".join(struct.pack("<II", row, at) + x.astype("<u8").tobytes() for row, x, at in marks) + stream.tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


class Block:
    """A block's parts, its checksum checked."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC or struct.unpack("<I", data[-4:])[0] != zlib.crc32(memoryview(data)[:-4]):
            raise ValueError("a token block is damaged: its checksum doesn't fit")
        self.n, self.lanes, marks, words = struct.unpack_from("<IIII", data, 4)
        at = 20
        states = lambda p: np.frombuffer(data, "<u8", self.lanes, p)
        self.marks = [(0, 0, states(at))]
        at += 8 * self.lanes
        for _ in range(marks):
            row, place = struct.unpack_from("<II", data, at)
            self.marks.append((row, place, states(at + 8)))
            at += 8 + 8 * self.lanes
        self.stream = np.frombuffer(data, "<u4", words, at)

    def decode(self, table: Table, part: int | None = None) -> np.ndarray:
        """All ids, or those between one checkpoint and the next, for which nothing before is decoded."""
        first, last = (0, len(self.marks)) if part is None else (part, part + 1)
        rows = -(-self.n // self.lanes)
        row, place, state = self.marks[first]
        to = self.marks[last][0] if last < len(self.marks) else rows
        state = state.copy()
        out = np.empty(min(self.n, to * self.lanes) - row * self.lanes, np.uint32)
        slots, freq, start, low = table.slots, table.freq, table.start, np.uint64((1 << SCALE) - 1)
        base = row * self.lanes
        for r in range(row, to):
            m = min(self.lanes, self.n - r * self.lanes)
            x = state[:m]
            slot = x & low
            symbol = slots[slot]
            out[r * self.lanes - base : r * self.lanes - base + m] = symbol
            x = freq[symbol] * (x >> np.uint64(SCALE)) + slot - start[symbol]
            small = x < LOW
            if k := int(np.count_nonzero(small)):
                # a lane's words were put in the order of encoding, backwards, so they are taken in lane order here
                x[small] = (x[small] << np.uint64(32)) | self.stream[place : place + k]
                place += k
            state[:m] = x
        return out


def _core(unit: str) -> tuple[str, str] | None:
    """The normaliser lowers case, so one spelling of a Latin word serves all."""
    split = latin_word(unit)
    if split is None or not (word := split[0].lower()).isalpha():
        return None
    return word, split[1]


def _ids_of(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids of each text.  White space is where the tokenizer's units end, so each run without it is looked up."""
    cache = cache_for(path, "words", WordCache)
    whole = {i: np.asarray(cache.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32) for i, text in enumerate(texts) if RARE_SPACE.search(text)}
    # without rare ones, white space is space and newline only; an empty unit has no ids
    runs = pc.ascii_split_whitespace(pa.array(["" if i in whole else text for i, text in enumerate(texts)], pa.large_string()))
    ends = np.concatenate([[0], np.cumsum(runs.value_lengths().to_numpy())]).astype(np.int64)
    # of equal runs one is split, of equal words and equal closings one is looked up
    coded = runs.flatten().dictionary_encode()
    places = coded.indices.to_numpy()
    parts = pa.concat_arrays(split_closing(coded.dictionary)).dictionary_encode()
    pairs = parts.indices.to_numpy().reshape(2, -1)
    times = np.bincount(places, minlength=len(coded.dictionary))
    numbers = cache.numbers(parts.dictionary, np.bincount(pairs.ravel(), np.tile(times, 2), len(parts.dictionary)).astype(np.int64))[pairs]
    sizes = cache.lens[numbers].sum(axis=0)
    flat = gathered(cache.ids(numbers.T.ravel()), (np.cumsum(sizes) - sizes)[places], sizes[places])
    at = np.concatenate([[0], np.cumsum(sizes[places])])
    return [whole[i] if i in whole else flat[at[ends[i]] : at[ends[i + 1]]] for i in range(len(texts))]


RAW = "shard int, block int, first long, doc_ids binary, lens binary, ids binary, seen binary, times binary"
FILE = "shard int, block int, first long, doc_ids binary, lens binary, payload binary"


def _names(ddl: str) -> list[str]:
    return [x.split()[0] for x in ddl.split(",")]


def _tokenised(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        width = np.uint16 if max(tokenizer(path).get_vocab_size(), end_id + 1) <= 1 << 16 else np.uint32
        end = np.asarray([end_id], width)
        block = first = held = 0
        docs: list = []
        parts: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal block, first, held, docs, parts
            lens = np.fromiter(map(len, parts), "<i8", len(parts))
            none = np.fromiter((d is None for d in docs), np.uint8, len(docs))
            known = np.asarray([d or 0 for d in docs], "<i8")
            ids = np.concatenate(parts)
            times = np.bincount(ids)
            seen = np.flatnonzero(times)
            packed = [known.tobytes() + none.tobytes(), lens.tobytes(), ids.tobytes(), seen.astype("<i4").tobytes(), times[seen].astype("<i8").tobytes()]
            row = pa.record_batch([pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()), *(pa.array([p]) for p in packed)], names=_names(RAW))
            block, first, held, docs, parts = block + 1, first + held, 0, [], []
            return row

        for batch in slices(batches, 1, keep=True):
            for doc, ids in zip(batch.column(0).to_pylist(), _ids_of(strings(batch.column(1)), path), strict=True):
                docs.append(doc)
                parts.append(np.concatenate([ids.astype(width), end]))
                held += len(ids) + 1
                if held >= BLOCK_IDS:
                    yield close()
        if docs:
            yield close()

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each id comes, from the counts of the blocks."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        for seen, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids = np.frombuffer(seen, "<i4")
            if len(ids) and ids[-1] >= len(total):
                total = np.concatenate([total, np.zeros(ids[-1] + 1 - len(total), np.int64)])
            total[ids] += np.frombuffer(times, "<i8")
    known = np.flatnonzero(total)
    yield pa.record_batch([pa.array(known.astype(np.int32)), pa.array(total[known])], names=["id", "n"])


def write_ids(docs: DataFrame, path: str, out: str, end_id: int) -> None:
    """Tokenise every text, end each document with ``end_id`` and write the dataset, in ascending doc_id order (a null doc_id first, equal ones by hash of the text, then by text).

    Documents are dealt out by range of doc_id; a range is a shard.  What goes
    to the driver is the frequency table, one row for each id of the
    vocabulary at most.
    """
    spark = docs.sparkSession
    width = np.uint16 if max(tokenizer(path).get_vocab_size(), end_id + 1) <= 1 << 16 else np.uint32
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text"))
    raw_path = shared_dir(spark, "raw-ids")
    ranged.mapInArrow(_tokenised(path, end_id), RAW).write.option("compression", "none").parquet(raw_path)
    raw = spark.read.schema(RAW).parquet(raw_path)
    rows = raw.select("seen", "times").mapInArrow(_counted, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r.id for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        counts[r.id] = r.n
    freq = normalise(counts)
    spark.createDataFrame([(bytearray(freq.astype("<u4").tobytes()), SCALE)], "freq binary, scale int").coalesce(1).write.parquet(f"{out}/table")
    shared = spark.sparkContext.broadcast(freq)  # 4 bytes for each id of the vocabulary

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column(5)[i].as_py(), width)
                yield pa.record_batch([*(batch.column(k)[i : i + 1] for k in range(5)), pa.array([encode(ids, table)])], names=_names(FILE))

    raw.drop("seen", "times").mapInArrow(pack, FILE).write.option("compression", "none").parquet(f"{out}/blocks")
    discard(spark, raw_path)


def read_ids(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, ids (array) of every document of a dataset."""
    return _decoded(spark, out, digest=False)


def digest_ids(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from a dataset's blocks."""
    blocks = spark.read.schema(FILE).parquet(f"{out}/blocks")
    # one row for each shard, that is for each range of documents
    ends = blocks.select("shard", "first", "lens").mapInArrow(_extent, "shard int, n long").groupBy("shard").agg(F.max("n").alias("n")).collect()
    spans = sorted((r.shard, r.n) for r in ends)
    base, offsets = 0, []
    for shard, n in spans:
        offsets.append((shard, base))
        base += n
    starts = spark.createDataFrame(offsets, "shard int, base long")
    return _decoded(spark, out, digest=True).join(F.broadcast(starts), "shard").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def _extent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [first + int(np.frombuffer(lens, "<i8").sum()) for first, lens in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.record_batch([batch.column(0), pa.array(n, pa.int64())], names=["shard", "n"])


def _decoded(spark: SparkSession, out: str, digest: bool) -> DataFrame:
    row = spark.read.parquet(f"{out}/table").first()
    shared = spark.sparkContext.broadcast(np.frombuffer(bytes(row.freq), "<u4"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(shared.value)
        for batch in slices(batches, 5):
            for shard, _, first, docs, lens, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block = Block(payload)
                # each part starts from its own checkpoint
                ids = np.concatenate([block.decode(table, k) for k in range(len(block.marks))]).astype("<u4")
                lens = np.frombuffer(lens, "<i8")
                known, none = np.frombuffer(docs, "<i8", len(lens)), np.frombuffer(docs, np.uint8, len(lens), 8 * len(lens))
                at = np.concatenate([[0], np.cumsum(lens)])
                doc_ids = pa.array(known, pa.int64(), mask=none.astype(bool))
                if digest:
                    view = memoryview(ids).cast("B")
                    crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    yield pa.record_batch([pa.array([shard] * len(lens), pa.int32()), doc_ids, pa.array(first + at[:-1]), pa.array(lens), pa.array(crc, pa.int64())], names=["shard", "doc_id", "start", "n_tokens", "ids_crc32"])
                else:
                    yield pa.record_batch([doc_ids, pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int64)))], names=["doc_id", "ids"])

    stored = spark.read.schema(FILE).parquet(f"{out}/blocks")
    return stored.mapInArrow(run, "shard int, doc_id long, start long, n_tokens long, ids_crc32 long" if digest else "doc_id long, ids array<long>")

"""Token counts by overlap resynchronisation.

A short text is counted whole.  A huge one is encoded in overlapping chunks
with offsets.  Inside an overlap the two encodings are spliced at a proven
common boundary: both have a token that starts there, and it is a space
between two characters that aren't white space.  No piece of the byte-level
pre-tokeniser spans such a place, whatever came before, so both scans go on
alike from there.  If an overlap holds no such place, it is widened up to the
whole chunk, and then the chunk is doubled, so that a text without any such
place is encoded a few times over, whatever its length.

Null and empty texts have 0 bytes and 0 tokens; repeated rows are counted
each; further columns pass by unread.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, strings
from .units import RARE_SPACE, UnitCache, cache_for, latin_word, tokenizer

#: Texts of more characters are encoded in overlapping chunks.
CHUNK, OVERLAP = 65_536, 512


def is_stable(text: str, at: int) -> bool:
    """A single space between two characters that aren't white space: always a boundary of the byte-level pre-tokeniser."""
    return 0 < at < len(text) - 1 and text[at] == " " and not text[at - 1].isspace() and not text[at + 1].isspace() and not RARE_SPACE.match(text[at - 1]) and not RARE_SPACE.match(text[at + 1])


def resync_count(text: str, starts_of: Callable[[str], list[int]], chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Number of tokens of a huge text; ``starts_of`` gives the start offset of each token of a piece of text."""
    total, begin, step = 0, 0, chunk
    end = min(len(text), chunk)
    left = starts_of(text[:end])
    while end < len(text):
        width = overlap
        while True:
            start = max(begin + 1, end - width)
            stop = min(len(text), start + max(chunk, 2 * width))
            if start == begin + 1 or width > 8 * chunk:  # nothing proven in the whole chunk: grow it
                end, step = min(len(text), end + step), 2 * step
                left = starts_of(text[begin:end])
                width = overlap
                if end == len(text):
                    return total + len(left)
                continue
            right = starts_of(text[start:stop])
            # the end of the left chunk is cut off, so the last token and what stands right before it count for nothing
            known = {begin + s for s in left[:-2]}
            common = [s + start for s in right if s and s + start in known and is_stable(text, s + start)]
            if common:
                break
            width *= 2
        at = common[len(common) // 2]
        total += sum(begin + s < at for s in left)
        left = [s + start - at for s in right if s + start >= at]
        begin, end, step = at, stop, chunk
    return total + len(left)


def _starts(path: str) -> Callable[[str], list[int]]:
    encode = tokenizer(path).encode
    return lambda piece: [a for a, _ in encode(piece, add_special_tokens=False).offsets]


def _spell(unit: str) -> str:
    """A unit that starts a text is marked by NUL, one that starts a line by its newline; any other follows a space."""
    return unit[1:] if unit[0] == "\0" else unit if unit[0] == "\n" else " " + unit


def byte_level(path: str) -> UnitCache:
    return cache_for(path, "byte-level", spell=_spell, core=latin_word, lead=chr(0x120))


def count_block(texts: list[str], cache: UnitCache, path: str, special: list[str]) -> list[int]:
    """Token counts of texts, by cached units where the text is proven to fall into them."""
    counts, units, ends, fast = [0] * len(texts), [], [], []
    for i, text in enumerate(texts):
        if not text:
            continue
        if len(text) > CHUNK:
            counts[i] = resync_count(text, _starts(path))
        elif "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n\0" or text[-1] in " \n" or any(s in text for s in special) or RARE_SPACE.search(text):
            counts[i] = len(cache.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)
        else:
            pieces = text.replace("\n", " \n").split(" ")
            pieces[0] = "\0" + pieces[0]
            units += pieces
            ends.append(len(units))
            fast.append(i)
    if fast:
        numbers = cache.numbers(units)
        lens = np.concatenate([[0], np.cumsum(cache.lens[numbers])])
        for i, n in zip(fast, np.diff(lens[[0, *ends]]), strict=True):
            counts[i] = int(n)
    return counts


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every text, without special tokens added, special strings in texts as the library's default takes them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = byte_level(path)
        special = [t.content for t in cache.tokenizer.get_added_tokens_decoder().values()]
        for batch in slices(batches, 1, keep=True):
            n = count_block(strings(batch.column(1)), cache, path, special)
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.record_batch([batch.column(0), sizes, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

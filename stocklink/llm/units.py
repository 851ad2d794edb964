"""Exact token ids of many texts through a cache of independent text units.

A unit is a stretch of text whose tokens don't depend on what stands around
it, so its ids can be looked up.  Every unit that isn't cached goes through
the tokenizers library itself; a text for which independence isn't proven
goes through it whole.
"""

from __future__ import annotations

import gc
import os
import re
import string
from collections import defaultdict
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import KEPT

#: White space other than space and newline (for the fast paths, texts that hold any go another way).
RARE_SPACE = re.compile("[" + "".join(map(chr, (*range(9, 10), *range(11, 14), *range(28, 32), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))) + "]")
#: A cache is emptied beyond so many units.
CACHE_UNITS = 600_000



def tokenizer(path: str):
    """The library's tokenizer, loaded once for each worker; one thread, since Spark runs the tasks."""
    if path not in KEPT:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer

        KEPT[path] = Tokenizer.from_file(path)
        KEPT[path].no_truncation()
        KEPT[path].no_padding()
    return KEPT[path]


def _index(units: list[str]) -> defaultdict[str, int]:
    """Unit -> number; an unknown unit gets the next number."""
    return defaultdict(count(len(units)).__next__, zip(units, range(len(units))))


class UnitCache:
    """Ids of units as one flat array with starts and lengths.

    ``spell`` gives the text that a unit stands for.  ``core`` may split a
    unit into a word of letters and closing punctuation, which the
    pre-tokeniser always separates; such a word is one piece, so it goes to
    the tokenizer's model at once, with ``lead`` before it.  A full cache
    keeps the units that came more than once.
    """

    def __init__(self, path: str, spell=lambda unit: unit, core=lambda unit: None, lead: str = "", capacity: int = CACHE_UNITS):
        self.tokenizer, self.spell, self.core, self.lead, self.capacity = tokenizer(path), spell, core, lead, capacity
        self.model, self.index, self.closing = self.tokenizer.model, _index([]), {}
        self.lens, self.starts, self.seen = (np.zeros(1024, np.int64) for _ in range(3))
        self.flat, self.used, self.known = np.zeros(4096, np.int32), 0, 0

    def numbers_in(self, units: pa.Array) -> np.ndarray:
        """``numbers`` of an Arrow array: of many equal units one is looked up."""
        coded = units.dictionary_encode()
        places = coded.indices.to_numpy()
        return self.numbers(coded.dictionary.to_pylist(), np.bincount(places, minlength=len(coded.dictionary)))[places]

    def numbers(self, units: list[str], times: np.ndarray | None = None) -> np.ndarray:
        """Numbers of the units, each of which came so many times, or once; their ids are then in the arrays."""
        if self.known > self.capacity:
            self._shrink()
        got = self._find(units)
        if times is None:
            self.seen[: self.known] += np.bincount(got, minlength=self.known)
        else:
            self.seen[got] += times  # each unit comes once here
        return got

    def _find(self, units: list[str]) -> np.ndarray:
        """Numbers of the units; those that aren't known are learned."""
        got = np.fromiter(map(self.index.__getitem__, units), np.int64, len(units))
        if len(self.index) > self.known:
            # the collector would walk the many lists of new ids again and again; they hold no cycles
            on = gc.isenabled()
            gc.disable()
            try:
                self._learn()
            finally:
                if on:
                    gc.enable()
        return got

    def _shrink(self) -> None:
        """Keep what came at least twice, or the more frequent half if that is too much; count from half of what was seen."""
        seen = self.seen[: self.known]
        least = 2
        while np.count_nonzero(seen >= least) > self.capacity // 2:
            least *= 2
        kept = np.flatnonzero(seen >= least)
        flat = self.ids(kept)
        self._keep(kept)
        self.lens[: len(kept)], self.seen[: len(kept)] = self.lens[kept], seen[kept] // 2
        self.seen[len(kept) :] = 0
        self.flat, self.used, self.known = flat, len(flat), len(kept)
        self.starts[: len(kept)] = np.cumsum(self.lens[: len(kept)]) - self.lens[: len(kept)]

    def _keep(self, kept: np.ndarray) -> None:
        units = list(self.index)
        self.index = _index([units[n] for n in kept.tolist()])

    def _learn(self) -> None:
        index, known = self.index, self.known
        new = _last(index, len(index) - known)
        ids: list = [None] * len(new)
        others = []
        tokenize, lead, core = self.model.tokenize, self.lead, self.core
        words: dict[str, list[int]] = {}
        for k, unit in enumerate(new):
            split = core(unit)
            if split is None:
                others.append(k)
                continue
            word, closing = split
            got = words.get(word)
            if got is None:
                n = index.get(word, known)
                if n < known:
                    got = self.flat[self.starts[n] : self.starts[n] + self.lens[n]].tolist()
                else:
                    got = [t.id for t in tokenize(lead + (word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LETTERS)))]
                words[word] = got
            if closing:
                if closing not in self.closing:
                    self.closing[closing] = self._ids([closing])[0]
                got = got + self.closing[closing]
            ids[k] = got
        for at in range(0, len(others), 4096):
            part = others[at : at + 4096]
            for k, got in zip(part, self._ids([self.spell(new[k]) for k in part]), strict=True):
                ids[k] = got
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        self._grow(len(index))
        self._put(np.arange(known, len(index)), lens, np.fromiter(chain.from_iterable(ids), np.int32, int(lens.sum())))
        self.known = len(index)

    def _grow(self, size: int) -> None:
        if size > len(self.lens):
            self.lens, self.starts, self.seen = (np.concatenate([a, np.zeros(2 * size - len(a), np.int64)]) for a in (self.lens, self.starts, self.seen))

    def _put(self, numbers: np.ndarray, lens: np.ndarray, ids: np.ndarray) -> None:
        """Store the ids of units, one unit's after the other's."""
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(self.used + 2 * len(ids), np.int32)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.lens[numbers], self.starts[numbers] = lens, self.used + np.cumsum(lens) - lens
        self.used += len(ids)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of units in order, as one array."""
        return gathered(self.flat, self.starts[numbers], self.lens[numbers])


def gathered(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Stretches of an array, one after the other."""
    ends = np.cumsum(lens)
    at = np.repeat(starts - ends + lens, lens)
    at += np.arange(len(at))
    return flat[at]


class WordCache(UnitCache):
    """The same with units as an Arrow array, looked up by Arrow's kernels, for a tokenizer that lowers case and marks the ends of words.

    Words of Latin letters are learned many at once: joined by spaces they are
    pieces of their own, and each ends where a token with the model's mark for
    the end of a word is.  Should the marks not fit the words, as all other
    units, they go through the library one by one.
    """

    #: So many units go to the library at once.
    AT_ONCE = 16_384

    def __init__(self, path: str, capacity: int = CACHE_UNITS):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__(path, capacity=capacity)
        self.units = pa.array([], pa.large_string())
        # words of ASCII letters in lower case are what the normaliser and the byte-level alphabet leave as it is
        self.plain = Tokenizer(self.model)
        self.plain.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        mark = getattr(self.model, "end_of_word_suffix", None)
        self.ending = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if mark:
            self.ending[[n for token, n in self.tokenizer.get_vocab(with_added_tokens=False).items() if token.endswith(mark)]] = True

    def _find(self, units: pa.Array) -> np.ndarray:
        """Numbers of the units, which are all different."""
        got = pc.index_in(units, value_set=self.units)
        new = units.filter(pc.is_null(got))
        places = pc.fill_null(got, -1).to_numpy().astype(np.int64)
        places[places < 0] = np.arange(self.known, self.known + len(new))
        if len(new):
            self._learn(new)
        return places

    def _keep(self, kept: np.ndarray) -> None:
        self.units = self.units.take(pa.array(kept))

    def _learn(self, new: pa.Array) -> None:
        self._grow(self.known + len(new))
        word = is_latin(new).to_numpy(zero_copy_only=False)
        plain = word & pc.string_is_ascii(new).to_numpy(zero_copy_only=False)
        for library, which in ((self.plain, plain), (self.tokenizer, word & ~plain), (None, ~word)):
            places = np.flatnonzero(which)
            for at in range(0, len(places), self.AT_ONCE):
                part = places[at : at + self.AT_ONCE]
                self._put(self.known + part, *self._read(new.take(pa.array(part)).to_pylist(), library))
        self.units = pa.concat_arrays([self.units, new])
        self.known += len(new)

    def _read(self, units: list[str], library) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of units; ``library`` takes them joined."""
        if library is not None:
            ids = np.asarray(library.encode_batch_fast([" ".join(units)], add_special_tokens=False)[0].ids, np.int32)
            ends = np.flatnonzero(self.ending[ids])
            if len(ends) == len(units) and ends[-1] == len(ids) - 1:
                return np.diff(ends, prepend=-1), ids
        found = self._ids(units)
        lens = np.fromiter(map(len, found), np.int64, len(found))
        return lens, np.fromiter(chain.from_iterable(found), np.int32, int(lens.sum()))


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for the code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + k) for k, b in enumerate(hidden)}


BYTE_LETTERS = _byte_letters()


def latin_word(unit: str) -> tuple[str, str] | None:
    """A word of Latin letters and its closing punctuation; None if the unit is anything else."""
    word = unit.rstrip(".,;:!?")
    return (word, unit[len(word) :]) if word.isalpha() and (word.isascii() or max(word) < LATIN_END) else None


#: Letters before this one are single code points in any normal form.
LATIN_END = chr(0x250)


#: The letters before it whose lower case is one letter too (that of the dotted capital I is two characters).
LATIN = "".join(c for c in map(chr, range(ord(LATIN_END))) if c.isalpha() and c != "\u0130")


def is_latin(units: pa.Array) -> pa.Array:
    """Which are words of ``LATIN`` alone."""
    return pc.match_substring_regex(units, f"^[{LATIN}]+$")


def split_closing(units: pa.Array) -> tuple[pa.Array, pa.Array]:
    """A word of Latin letters, A-Z lowered, and the ASCII punctuation that closes it; any other unit whole, with nothing after it."""
    words = pc.ascii_rtrim(pc.ascii_lower(units), string.punctuation)
    latin = is_latin(words)
    return pc.if_else(latin, words, units), pc.if_else(latin, pc.utf8_ltrim(units, LATIN), pa.scalar("", units.type))


def _last(index: dict, n: int) -> list[str]:
    """The last n keys in order of insertion."""
    back = reversed(index)
    return [next(back) for _ in range(n)][::-1]


def cache_for(path: str, kind: str, make: type[UnitCache] = UnitCache, **hooks) -> UnitCache:
    key = (path, kind)
    if key not in KEPT:
        KEPT[key] = make(path, **hooks)
    return KEPT[key]

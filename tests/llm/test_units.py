"""Token ids through the cache of units."""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import pytest

from stocklink.llm import rans, units
from stocklink.llm.queries import WORD_BPE

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_equal_units_are_looked_up_once(monkeypatch):
    asked = []
    plain = units.UnitCache.numbers
    monkeypatch.setattr(units.UnitCache, "numbers", lambda self, found, *more: asked.append(list(found)) or plain(self, found, *more))
    texts = ["one two, One two,\n one", "", " ", "\n a  b\n", "tab\tand two,", " lead  trail ", "ñandú Été 'tis 12.5%"] * 50
    got = rans._ids_of(texts, WORD_BPE)
    library = units.tokenizer(WORD_BPE)
    assert [x.tolist() for x in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert len(asked) == 1 and len(asked[0]) == len(set(asked[0])) and gc.isenabled()


def test_counts_of_repeated_units_decide_who_stays(monkeypatch):
    import pyarrow as pa

    cache = units.UnitCache(WORD_BPE, core=rans._core, capacity=4)
    found = cache.numbers_in(pa.array(["a", "b", "a", "c", "d", "e", "a", "b"]))
    assert found.tolist() == [0, 1, 0, 2, 3, 4, 0, 1] and cache.seen[:5].tolist() == [3, 2, 1, 1, 1]
    assert cache.numbers(["b", "a", "z"]).tolist() == [1, 0, 2] and sorted(cache.index) == ["a", "b", "z"]


def test_spellings_and_closings_of_a_word_are_looked_up_once(monkeypatch):
    asked = []
    plain = units.UnitCache.numbers
    monkeypatch.setattr(units.UnitCache, "numbers", lambda self, found, *more: asked.append(list(map(str, found))) or plain(self, found, *more))
    texts = ["One two, ONE. two! one?!", "one two%%% 'one one' <|endoftext|>one one<|endoftext|> <|ENDOFTEXT|> 'S one's", "İ. İx, é. ß! ẞ! 漢字, x9.", ""]
    got = rans._ids_of(texts, WORD_BPE)
    library = units.tokenizer(WORD_BPE)
    assert [x.tolist() for x in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert len(asked) == 1 and asked[0].count("one") == 1 and {"two", ",", ".", "?!", "%%%"} <= set(asked[0]) and not {"One", "ONE.", "two,", "two%%%"} & set(asked[0])


@pytest.mark.parametrize("marked", [True, False])
def test_words_are_learned_joined(monkeypatch, marked):
    cache = units.WordCache(WORD_BPE)
    monkeypatch.setattr(units.WordCache, "AT_ONCE", 100)
    alone = []
    plain = units.UnitCache._ids
    monkeypatch.setattr(units.UnitCache, "_ids", lambda self, texts: alone.extend(texts) or plain(self, texts))
    if not marked:
        cache.ending[:] = False
    words = [f"{a}{b}" for a in ("", "word", "é") for b in units.LATIN]
    words = list(dict.fromkeys(words)) + ["%%%", "x9", ""]
    # A-Z come in lower case
    found = pa.array(dict.fromkeys(w.translate(LOWER) for w in words), pa.large_string())
    numbers = cache.numbers(found, np.ones(len(found), np.int64))
    wanted = [e.ids for e in cache.tokenizer.encode_batch(found.to_pylist(), add_special_tokens=False)]
    assert [cache.ids(numbers[k : k + 1]).tolist() for k in range(len(numbers))] == wanted
    assert alone == (["%%%", "x9", ""] if marked else alone) and (marked or len(alone) == len(found))
    assert cache.numbers(found[::-1], np.ones(len(found), np.int64)).tolist() == numbers[::-1].tolist()


def test_word_cache_keeps_what_came_more_than_once():
    cache = units.WordCache(WORD_BPE, capacity=4)
    cache.numbers(pa.array(["a", "b", "c", "d", "e"], pa.large_string()), np.asarray([3, 2, 1, 1, 1]))
    found = pa.array(["b", "a", "z"], pa.large_string())
    assert cache.numbers(found, np.ones(3, np.int64)).tolist() == [1, 0, 2] and cache.units.to_pylist() == ["a", "b", "z"]
    assert cache.ids(np.arange(3)).tolist() == cache.tokenizer.encode("a b z", add_special_tokens=False).ids

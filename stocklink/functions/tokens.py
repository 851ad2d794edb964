"""Tokens, roots, codes, tags and set measures as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import COMMON_TOKENS, DIMENSION_WEIGHTS
from .text import measure_value


def tokens(text: Column) -> Column:
    """Distinct tokens between white space, in order."""
    return F.array_remove(F.array_distinct(F.split(text, r"\s+")), "")


def key_tokens(all_tokens: Column) -> Column:
    """Tokens of three characters and more that aren't common and aren't all digits."""
    return F.filter(all_tokens, lambda t: (F.length(t) >= 3) & ~t.isin(*COMMON_TOKENS) & ~t.rlike("^[0-9]+$"))


def token_root(token: Column) -> Column:
    """The first five letters; a token with fewer than four letters is its own root."""
    letters = F.regexp_replace(token, r"(?U)[^\p{L}]", "")
    return F.when(F.length(letters) < 4, token).otherwise(F.substring(letters, 1, 5))


def root_tokens(keys: Column) -> Column:
    return F.array_distinct(F.transform(keys, token_root))


def code_tokens(text: Column) -> Column:
    """Tokens that mix letters and digits, three characters and more, that are no size, diameter or pressure."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[0-9a-zа-яё/.\-]+"), F.lit(0))
    shaped = F.filter(found, lambda t: (F.length(t) >= 3) & t.rlike("[0-9]") & t.rlike("[a-zа-яё]") & ~t.rlike(r"^(?:dn|pn|du|ru|ду|ру|d)[0-9.]+$") & ~t.rlike(r"^[0-9.]+[xх][0-9.]+"))
    return F.array_sort(F.array_distinct(F.transform(shaped, lambda t: F.translate(t, "авекмнорстух", "abekmhopctyx"))))


def strong_code(token: Column) -> Column:
    """A code that tells goods apart: no measure, grade, chain of numbers or size."""
    measure = token.rlike("^(?:gost|goct|dn|du|pn|ru|kvs|l=)")
    grade = token.rlike(r"^(?:[cs]t\.?[0-9]+|09g2s|12x18h10t|12kh18n10t|aisi[0-9]+|a351|cf8m?|ggg[0-9]+|[vs]ch[0-9]+|l?63|cw617n|cuzn[0-9]+)$")
    chain = F.forall(F.split(token, "[-./+=xh]"), lambda p: p.rlike("^[0-9]+$"))
    letters = F.length(F.regexp_replace(token, r"(?U)[^\p{L}]", ""))
    return ~measure & ~grade & ~chain & token.rlike("[0-9]") & ((letters >= 2) | token.rlike("[./+=]"))


def size_pairs(text: Column) -> Column:
    """AxB patterns, numbers with three decimals at most."""
    first = F.regexp_extract_all(F.lower(text), F.lit(r"([0-9]+(?:[.,][0-9]+)?)\s*[xх*×]\s*[0-9]+(?:[.,][0-9]+)?"), F.lit(1))
    second = F.regexp_extract_all(F.lower(text), F.lit(r"[0-9]+(?:[.,][0-9]+)?\s*[xх*×]\s*([0-9]+(?:[.,][0-9]+)?)"), F.lit(1))
    trimmed = lambda x: measure_value(F.round(F.replace(x, F.lit(","), F.lit(".")).try_cast("double"), 3).cast("string"))
    return F.array_distinct(F.zip_with(first, second, lambda a, b: F.concat_ws("x", trimmed(a), trimmed(b))))


def overlap(left: Column, right: Column) -> Column:
    """Share of the left set that is in the right one; 0 if it is empty."""
    return F.when(F.size(left) > 0, F.size(F.array_intersect(left, right)) / F.size(left)).otherwise(0.0)


def tag_values(tags: Column, key: str) -> Column:
    """Values of one key among key:value tags."""
    return F.transform(F.filter(tags, lambda t: t.startswith(f"{key}:")), lambda t: F.substring(t, len(key) + 2, 10_000))


def tags_by_key(tags: Column) -> Column:
    """key:value tags as a map of sorted value arrays."""
    keys = F.array_sort(F.array_distinct(F.transform(tags, lambda t: F.substring_index(t, ":", 1))))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.array_sort(F.transform(F.filter(tags, lambda t: F.substring_index(t, ":", 1) == k), lambda t: F.substring(t, F.length(k) + 2, F.lit(10_000))))))


def primary_family(tags: Column, primary: tuple[str, ...]) -> Column:
    """The first primary family by name; a transition beats a coupling."""
    families = F.filter(tag_values(tags, "family"), lambda f: f.isin(*primary))
    return F.when(F.array_contains(families, "perehod") & F.array_contains(families, "mufta"), F.lit("perehod")).otherwise(F.array_min(families))


def numbers_of(values: Column) -> Column:
    return F.flatten(F.transform(values, lambda v: F.transform(F.regexp_extract_all(v, F.lit(r"[0-9]+(?:[.,][0-9]+)?"), F.lit(0)), lambda n: F.replace(n, F.lit(","), F.lit(".")).cast("double"))))


def scored_dimensions(by_key: Column) -> Column:
    return F.map_filter(by_key, lambda k, v: k.isin(*DIMENSION_WEIGHTS) & (F.size(v) > 0))

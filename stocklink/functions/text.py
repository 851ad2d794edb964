"""Text cleaning, mixed scripts, units and line grammar as native columns.

Every function takes and returns columns; patterns carry ``(?iuU)`` where
letters beyond ASCII matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import COMMON_TOKENS, CYRILLIC_LOOKALIKES, CYRILLIC_TO_LATIN, INCH_TO_DN, LATIN_LOOKALIKES, UNITS

__all__ = ["COMMON_TOKENS", "INCH_TO_DN"]

_CYRILLIC, _LATIN = "[А-Яа-яЁёІіЇїЄєҐґ]", "[A-Za-z]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, and stands once in the plan."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def clean_text(value: Column) -> Column:
    """Null to empty, a whole number written as a decimal to an integer, white space of any kind stripped at both ends."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    text = F.when(text.rlike(r"^-?[0-9]+\.0+$"), F.regexp_replace(text, r"\.0+$", "")).otherwise(text)
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def candidate_code(value: Column) -> Column:
    return F.upper(clean_text(value))


def manual_code(value: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.regexp_replace(F.lower(clean_text(value)), r"(?U)[^\p{L}\p{N}]", "")


def parse_quantity(value: Column) -> Column:
    """A number with spaces and a decimal comma or point; anything else, and not-a-number, is 0."""
    number = F.regexp_replace(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"(?U)\s", ""), ",", ".").try_cast("double")
    return F.when(number.isNull() | F.isnan(number), 0.0).otherwise(number)


def parse_price(value: Column) -> Column:
    """A positive number, else null."""
    number = parse_quantity(value)
    return F.when(number > 0, number)


def format_number(value: Column) -> Column:
    """A whole number without decimals, else at most three of them; for display only."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(F.regexp_replace(F.round(value, 3).cast("string"), r"(\.[0-9]*?)0+$", "$1"))


def fix_mixed_script(token: Column) -> Column:
    """A token of both scripts is brought to the one that has more letters, Latin at a tie."""
    latin, cyrillic = F.regexp_count(token, F.lit(_LATIN)), F.regexp_count(token, F.lit(_CYRILLIC))
    return F.when((latin > 0) & (cyrillic > 0), F.when(latin >= cyrillic, F.translate(token, CYRILLIC_LOOKALIKES, LATIN_LOOKALIKES)).otherwise(F.translate(token, LATIN_LOOKALIKES, CYRILLIC_LOOKALIKES))).otherwise(token)


def normalize_symbols(text: Column) -> Column:
    """Diameter signs, vulgar fractions, degree and number signs, quotes, dashes, decimal commas and NxN sizes in one spelling."""
    for sign in "∅⌀øØ":
        text = F.replace(text, F.lit(sign), F.lit(" dn "))
    for sign, spelled in (("½", "1/2"), ("¼", "1/4"), ("¾", "3/4"), ("°", " deg "), ("№", " no ")):
        text = F.replace(text, F.lit(sign), F.lit(spelled))
    text = F.translate(text, "\n”“″−–—×", ' """---x')
    text = F.regexp_replace(text, r"(?<=[0-9]),(?=[0-9])", ".")
    return F.regexp_replace(text, r"([0-9])\s*[*xхXХ]\s*(?=[0-9])", "$1x")


def transliterate(text: Column) -> Column:
    """Latin spelling of a text: scripts unified token by token, symbols, lower case, du and ru before digits as dn and pn."""
    fixed = F.array_join(F.transform(F.split(text, r"(?U)\s+"), fix_mixed_script), " ")
    lowered = F.lower(normalize_symbols(fixed))
    for letter, spelled in CYRILLIC_TO_LATIN.items():
        if len(spelled) != 1:
            lowered = F.replace(lowered, F.lit(letter), F.lit(spelled))
    single = {k: v for k, v in CYRILLIC_TO_LATIN.items() if len(v) == 1}
    latin = F.translate(lowered, "".join(single), "".join(single.values()))
    latin = F.regexp_replace(latin, r"(?U)[^\x00-\x7F\p{Nd}\s]", "")
    latin = F.regexp_replace(F.regexp_replace(latin, r"\bdu(?=[0-9])", "dn"), r"\bru(?=[0-9])", "pn")
    return F.regexp_replace(F.regexp_replace(latin, r"(?U)\s+", " "), r"^[ .-]+|[ .-]+$", "")


def hint_phrase(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.lower(clean_text(value)), "ё", "е"), r"(?U)\s+", " "))


def parser_line(text: Column) -> Column:
    """No-break spaces, dashes with no space around, and degree signs in one spelling."""
    plain = F.translate(text, chr(0xA0) + "º", " °")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\s*[−–—]\s*", "-"), r"(?U)\s+", " "))


def tag_value(value: Column) -> Column:
    """A tag's value: transliterated, words joined by underscores, other signs dropped."""
    text = transliterate(F.when(F.lower(value.cast("string")).isin("true", "false"), F.lower(value.cast("string"))).otherwise(value.cast("string")))
    return F.regexp_replace(F.regexp_replace(text, r"\s+", "_"), r"[^a-z0-9_./x+-]", "")


def measure_value(value: Column) -> Column:
    """Point for comma, and no trailing zeros after it."""
    dotted = F.replace(value, F.lit(","), F.lit("."))
    return F.when(dotted.contains("."), F.regexp_replace(dotted, r"\.?0+$", "")).otherwise(dotted)


def degree_value(value: Column) -> Column:
    measured = measure_value(value)
    return F.when(measured == "87.5", F.lit("87")).otherwise(measured)


def flange_face(value: Column) -> Column:
    lowered = F.lower(value)
    return F.when(lowered.isin("v", "в"), F.lit("b")).otherwise(lowered)


def sorted_measures(values: Column) -> Column:
    """Measures of an array as AxB or AxBxC, smallest first."""
    keyed = F.array_sort(F.transform(values, lambda v: F.struct(measure_value(v).try_cast("double").alias("n"), measure_value(v).alias("v"))))
    return F.array_join(F.transform(keyed, lambda s: s["v"]), "x")


def inch_sizes(text: Column) -> Column:
    """Sizes in inches that stand in the text and are known."""
    found = F.regexp_extract_all(text, F.lit(r'(?<![0-9/.])([0-9]+(?:[- ]?[0-9]+/[0-9]+)?|[0-9]+/[0-9]+)(?=\s*(?:"|\'\'|дюйм))'), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.replace(x, F.lit(" "), F.lit(""))), lambda x: x.isin(*INCH_TO_DN)))


def inch_to_dn(value: Column) -> Column:
    return F.try_element_at(_lookup(INCH_TO_DN), value)


def normalize_unit(unit: Column) -> Column:
    key = F.lower(clean_text(unit))
    return F.coalesce(F.try_element_at(_lookup(UNITS), key), key)

"""The grammar of a request line as native columns: marker, noise, comment, quantity, vendor, mark.

A quantity is looked for in a fixed order of shapes, each put together from the
same parts; the shape that matches says how sure we are.  Without any, one
piece is assumed.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed, nomenclature
from .hints import Rules
from .text import clean_text, let, normalize_symbols, normalize_unit, parse_quantity, parser_line

_NUMBER = r"([0-9]+(?:[.,][0-9]+)?)"
_UNIT = "(" + "|".join(re.escape(u).rstrip("\\.") + r"\.?" if u.endswith(".") else re.escape(u) for u in sorted(fixed.UNITS, key=lambda u: (-len(u), u))) + ")"
#: Name of a shape, its pattern, and which groups are body, number and unit (0: none).
SHAPES = (
    ("named", rf"^(.+?)\s+(?:кол(?:-?во|ичество)?|qty)\s*[:=]?\s*{_NUMBER}\s*{_UNIT}?\s*$", 1, 2, 3),
    ("after_unit", rf"^(.+?)\s+{_UNIT}\s*[:.]?\s*{_NUMBER}\s*$", 1, 3, 2),
    ("before_unit", rf"^(.+?)\s*(?:[-–—,:;]\s*)?{_NUMBER}\s*{_UNIT}\s*$", 1, 2, 3),
    ("times", rf"^(.+?)\s*[xх*]\s*{_NUMBER}\s*$", 1, 2, 0),
    ("leading", rf"^{_NUMBER}\s*{_UNIT}\s+(.+)$", 3, 1, 2),
)
_QUANTITY = "struct<body:string,quantity:double,unit:string,confidence:double>"
_ANY = "(?iuU)"


def _trim(text: Column, signs: str) -> Column:
    inside = "".join(re.escape(s) for s in signs)
    return F.regexp_replace(F.regexp_replace(text, f"^[{inside}]+", ""), f"[{inside}]+$", "")


def _shape(text: Column, name: str, pattern: str, body: int, number: int, unit: int) -> tuple[Column, Column]:
    part = lambda k: F.regexp_extract(text, _ANY + pattern, k) if k else F.lit("")
    value = F.struct(clean_text(part(body)).alias("body"), parse_quantity(part(number)).alias("quantity"), normalize_unit(part(unit)).alias("unit"), F.lit(fixed.QUANTITY_CONFIDENCE[name]).alias("confidence"))
    return text.rlike(_ANY + pattern) & (value["quantity"] > 0) & (value["body"] != ""), value


def quantity_of_line(text: Column) -> Column:
    """struct(body, quantity, unit, confidence) by the first shape that matches; null if none does."""

    def first(line: Column) -> Column:
        found = None
        for shape in SHAPES:
            holds, value = _shape(line, *shape)
            found = F.when(holds, value) if found is None else found.when(holds, value)
        return found.otherwise(F.lit(None).cast(_QUANTITY))

    return let(F.trim(text), first)


def without_quantity(text: Column, quantity: Column, unit: Column) -> Column:
    """A name without the quantity and unit at its end, where they agree with the line's own."""
    asked = normalize_unit(unit)

    def cut(cleaned: Column) -> Column:
        out = None
        for name, pattern, body, number, units in (SHAPES[1], ("before_unit", rf"^(.+?)\s+{_NUMBER}\s*{_UNIT}\s*$", 1, 2, 3)):
            holds, value = _shape(cleaned, name, pattern, body, number, units)
            agrees = ((quantity <= 0) | (F.abs(value["quantity"] - quantity) < 1e-6)) & ((asked == "") | (asked == value["unit"]))
            out = F.when(holds & agrees, value["body"]) if out is None else out.when(holds & agrees, value["body"])
        return out.otherwise(cleaned)

    return let(clean_text(text), cut)


def leading_marker(text: Column) -> Column:
    """struct(position, body) of a numbered or bulleted line."""
    numbered = r"^([0-9]+(?:[./][0-9]+)*)(?:[.)]|(?:\s+-))\s+(.+)$"

    def read(line: Column) -> Column:
        body = F.when(line.rlike(numbered), F.trim(F.regexp_extract(line, numbered, 2))).otherwise(F.regexp_replace(line, r"^[-*•]+\s+(?=\S)", ""))
        return F.struct(F.regexp_extract(line, numbered, 1).alias("position"), body.alias("body"))

    return let(F.trim(text), read)


def without_position(text: Column, position: Column) -> Column:
    """A name without the line's own number, or any other number before its first letter."""
    marker = clean_text(position)
    own = F.concat(F.lit(r"^\s*\Q"), marker, F.lit(r"\E(?:[.)]|\s+-)?\s+"))
    cleaned = F.when(marker != "", F.regexp_replace(clean_text(text), own, "")).otherwise(clean_text(text))
    return F.trim(F.regexp_replace(cleaned, r"(?U)^\s*[0-9]+(?:[./][0-9]+)*(?:[.)]|\s+-)?\s+(?=\p{L})", ""))


_COMMENT = "(" + "|".join(fixed.COMMENT_WORDS) + ")"


def comment_of(text: Column) -> Column:
    """struct(body, comment): what follows a comma or dash and a comment word, then what follows a comment word alone."""
    marked, bare = rf"{_ANY}(?:,|\s+-\s+)({_COMMENT}.*)$", rf"{_ANY}\s+({_COMMENT}.*)$"

    def cut(line: Column, pattern: str) -> Column:
        comment = F.regexp_extract(line, pattern, 1)
        return F.struct(F.when(comment != "", _trim(F.regexp_replace(line, pattern, ""), " ,-")).otherwise(line).alias("body"), F.nullif(F.trim(comment), F.lit("")).alias("comment"))

    def both(first: Column) -> Column:
        return let(cut(first["body"], bare), lambda second: F.struct(second["body"].alias("body"), F.concat_ws("; ", first["comment"], second["comment"]).alias("comment")))

    return let(text, lambda line: let(cut(line, marked), both))


def without_request(text: Column) -> Column:
    """A line without the words that ask for it; the first that fits goes."""

    def cut(line: Column) -> Column:
        out = None
        for prefix in fixed.REQUEST_PREFIXES:
            holds, rest = F.lower(line).startswith(prefix), F.trim(F.substring(line, len(prefix) + 1, 1 << 20))
            out = F.when(holds, rest) if out is None else out.when(holds, rest)
        return out.otherwise(line)

    return let(text, cut)


def vendor_of(text: Column) -> Column:
    """struct(body, vendor): a vendor that is named at the end, else one in brackets at the end."""
    name = r"([A-Za-zА-Яа-я0-9 .&+/-]+)"

    def read(line: Column) -> Column:
        out = F.struct(line.alias("body"), F.lit("").alias("vendor"))
        for pattern in (rf"\({name}\)$", rf"{_ANY}(?:производитель|бренд|vendor)\s*[:-]?\s*{name}$"):
            vendor = F.trim(F.regexp_extract(line, pattern, 1))
            holds = (F.length(vendor) >= 2) & vendor.rlike(r"(?U)\p{L}")
            out = F.when(holds, F.struct(_trim(F.regexp_replace(line, pattern, ""), " ,-;").alias("body"), vendor.alias("vendor"))).otherwise(out)
        return out

    return let(text, read)


def _mark(text: str) -> str:
    if not nomenclature.code_tokens([text]):
        return ""
    words = [w for w in nomenclature.words(text) if any(map(str.isdigit, w)) and any(map(str.isalpha, w)) and not w.lower().startswith(("dn", "pn", "ру", "ду", "kvs"))]
    return max(words, key=lambda w: (len(w), w.count("-"), w.count(".")), default="")


def mark_of(text: Column) -> Column:
    """The longest word of letters and digits, if the line holds a code at all."""

    def run(column: pa.Array) -> pa.Array:
        return pa.array([_mark(x or "") for x in column.to_pylist()], pa.string())

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")(text)


def looks_like_header(text: Column) -> Column:
    """Words of headers stand together: a name with a quantity, position, unit or vendor."""
    lowered = F.lower(text)
    has = {}
    for kind, parts in fixed.HEADER_PARTS.items():
        has[kind] = lowered.rlike("|".join(re.escape(p) for p in parts))
    return has["name"] & (has["quantity"] | has["position"] | has["unit"] | has["vendor"])


def is_greeting(text: Column) -> Column:
    """Words of greeting and no digit."""
    return ~text.rlike("[0-9]") & F.lower(text).rlike("|".join(fixed.GREETINGS))


def is_ignored(text: Column, rules: Rules) -> Column:
    """Blank, or a row that the rules leave out."""
    plain = F.trim(F.regexp_replace(F.translate(F.lower(normalize_symbols(clean_text(text))), "ё", "е"), r"(?U)\s+", " "))
    out = plain == ""
    for pattern in rules.ignored:
        out = out | plain.rlike(_ANY + pattern)
    return out


def without_noise(text: Column, rules: Rules, trailing: bool = True) -> Column:
    """A line without what the rules strip at its beginning and, if asked for, at its end."""
    out = parser_line(clean_text(text))
    for pattern in rules.leading:
        out = F.trim(F.regexp_replace(out, _ANY + pattern, ""))
    for pattern in rules.trailing if trailing else ():
        out = _trim(F.regexp_replace(out, _ANY + pattern, ""), " ,-;")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def parse_line(text: Column, rules: Rules | None = None) -> Column:
    """A free line: struct(position, name, vendor, quantity, unit, comment, status, confidence, reason, raw).

    status is null for what is no item (blank, header, ignored, greeting);
    ``reason`` is set, and the name is not, where too little text is left.
    """
    rules = rules or Rules()

    def told(raw: Column, marked: Column, noted: Column, quantity: Column, sold: Column, name: Column) -> Column:
        found, short = quantity.isNotNull(), F.length(name) < 3
        skipped = (raw == "") | looks_like_header(raw) | is_ignored(raw, rules) | is_greeting(raw)
        assumed = F.concat_ws("; ", F.nullif(noted["comment"], F.lit("")), F.lit("количество не указано, принято 1 шт"))
        status = F.when(~skipped, F.when(short, "issue").when(found, "parsed_text").otherwise("parsed_text_default_qty"))
        return F.struct(
            marked["position"].alias("position"), F.when(status != "issue", name).alias("name"), sold["vendor"].alias("vendor"), F.coalesce(quantity["quantity"], F.lit(1.0)).alias("quantity"), F.coalesce(F.nullif(quantity["unit"], F.lit("")), F.lit("шт")).alias("unit"),
            F.when(found, noted["comment"]).otherwise(assumed).alias("comment"), status.alias("status"), F.coalesce(quantity["confidence"], F.lit(fixed.QUANTITY_CONFIDENCE["none"])).alias("confidence"),
            F.when(status == "issue", F.when(found, "после очистки осталось слишком мало текста").otherwise("не удалось выделить количество")).alias("reason"), raw.alias("raw"),
        )

    def named(raw: Column, marked: Column, noted: Column, quantity: Column) -> Column:
        return let(vendor_of(F.coalesce(quantity["body"], noted["body"])), lambda sold: let(_trim(without_noise(sold["body"], rules), " ,-;"), lambda name: told(raw, marked, noted, quantity, sold, name)))

    def read(raw: Column) -> Column:
        marker = leading_marker(raw)
        body = lambda marked: comment_of(without_request(without_noise(marked["body"], rules, trailing=False)))
        return let(marker, lambda marked: let(body(marked), lambda noted: let(quantity_of_line(noted["body"]), lambda quantity: named(raw, marked, noted, quantity))))

    return let(parser_line(clean_text(text)), read)

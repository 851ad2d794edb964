"""Features of nomenclature lines as one struct column, read in Arrow batches; each distinct text of a batch is read once."""

from __future__ import annotations

from inspect import Parameter, Signature

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import nomenclature as n
from .hints import Rules, alias_names, hint_tags, review_rule

FEATURES = "struct<text:string,tags:array<string>,tokens:array<string>,keys:array<string>,roots:array<string>,codes:array<string>,sizes:array<string>>"
_TYPE = pa.struct([("text", pa.string()), *((k, pa.list_(pa.string())) for k in ("tags", "tokens", "keys", "roots", "codes", "sizes"))])


def read_line(parts: list[str | None], rules: Rules) -> dict:
    """Search text, tags, tokens, key tokens, roots, codes and size pairs of a line's parts."""
    words = n.search_words(parts, alias_names(parts, rules))
    families = n.family_tags(words, rules.families)
    tags = n.size_tags(parts, words, families) | families | hint_tags(parts, rules) | n.material_tags(words) | n.structured_tags(words)
    words = n.augmented(words, tags)
    keys = n.key_tokens(words)
    return {"text": " ".join(words), "tags": sorted(tags), "tokens": list(dict.fromkeys(words)), "keys": sorted(keys), "roots": sorted({n.token_root(k) for k in set(words)}), "codes": sorted(n.code_tokens(parts)), "sizes": sorted(n.size_pairs(parts))}


def features(parts: list[Column], rules: Rules | None = None) -> Column:
    """``FEATURES`` of the lines whose parts (name, mark, vendor, ...) are given."""
    rules = rules or Rules()

    def run(*columns: pa.Array) -> pa.Array:
        known: dict[tuple, dict] = {}
        rows = []
        for row in zip(*(c.to_pylist() for c in columns), strict=True):
            if row not in known:
                known[row] = read_line(list(row), rules)
            rows.append(known[row])
        return pa.array(rows, _TYPE)

    # the number of columns is the number of parts
    run.__signature__ = Signature([Parameter(f"c{k}", Parameter.POSITIONAL_OR_KEYWORD, annotation=pa.Array) for k in range(len(parts))], return_annotation=pa.Array)
    run.__annotations__ = {f"c{k}": pa.Array for k in range(len(parts))} | {"return": pa.Array}
    return F.arrow_udf(run, FEATURES)(*[p.cast("string") for p in parts])


def _text_udf(function, kind: str, out: pa.DataType):
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else function(x) for x in column.to_pylist()], out)

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, kind)


def search_text(text: Column, rules: Rules | None = None) -> Column:
    """The search text of one text, without words for tags."""
    rules = rules or Rules()
    return _text_udf(lambda x: " ".join(n.search_words([x], alias_names([x], rules))), "string", pa.string())(text)


def token_variants(token: Column) -> Column:
    return _text_udf(n.variants, "array<string>", pa.list_(pa.string()))(token)


def measure_text(text: Column) -> Column:
    """Words of a text in one script each, lower case, du, ru and mm in Latin letters."""

    def spelled(x: str) -> str:
        fixed = " ".join(map(n.one_script, n.words(n.signs(n.clean(x))))).lower().replace("ё", "е")
        for names, latin in ((("ду", "dу", "dн"), "dn"), (("ру", "rу"), "pn")):
            for name in names:
                fixed = n.re.sub(rf"\b{name}\.?\s*(?=\d)", f"{latin} ", fixed)
        return " ".join(fixed.replace("мм", "mm").split())

    return _text_udf(spelled, "string", pa.string())(text)


def review_comment(raw: Column, search: Column, rules: Rules) -> Column:
    """struct(id, comment) of the review rule that a line falls under; null if none."""
    kind = pa.struct([("id", pa.string()), ("comment", pa.string())])

    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        found = [review_rule(a or "", b or "", rules) for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True)]
        return pa.array([None if f is None else {"id": str(f.get("id", "")), "comment": str(f.get("comment") or "требует ручного подбора: в запросе не хватает параметров для безопасного аналога")} for f in found], kind)

    run.__annotations__ = {"left": pa.Array, "right": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "struct<id:string,comment:string>")(raw, search)

"""The classifier's own reading of a query: words, numbers, attributes, aliases and corrections.

It differs from the matcher's reading in its signs and words, so it has
functions of its own.  ``Registry`` holds what a configuration file says.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed, fuzzy
from .hints import payload

# Service words, and the words by which materials, connections and toilet outlets are known.
SERVICE = ("шт", "шт.", "sht", "pcs", "ed", "kompl", "komplekt")
MATERIAL_WORDS = {
    "ppu": ("ppu", "penopoliuretan", "penopoliuretanovyi"), "polyethylene": ("pe", "pnd", "hdpe", "pex", "pert"), "polypropylene": ("ppr", "polipropilen", "polipropilenovyi"), "pvc": ("pvc", "pvc-u", "pvh"), "steel": ("stal", "stalnoi", "st", "09g2s", "st20"),
    "cast_iron": ("chugun", "vchshg", "kovk"), "brass": ("latun", "latunnyi"),
}
CONNECTION_WORDS = {"grooved": ("gruvlok", "grooved", "victaulic"), "threaded": ("rezba", "vr", "nr"), "welded": ("svarka", "privarnoi", "privarnaya"), "flanged": ("flanec", "mezhflancevyi")}
TOILET_WORDS = ("kosym", "pryamym", "gorizontalnym", "vertikalnym")
ANGLES = ("15", "30", "45", "60", "87", "90", "120", "180")
CLOSE = 88.0

_SIGNS = str.maketrans({"\n": " ", "ё": "е", "Ё": "Е", "∅": " dn ", "ø": " dn ", "Ø": " dn ", "½": "1/2", "¼": "1/4", "¾": "3/4", "°": " deg ", "№": " no ", "”": '"', "“": '"', "″": '"', "−": "-", "–": "-", "—": "-", "×": "x", "*": " x "})
_SPELL = str.maketrans({k: v for k, v in fixed.CYRILLIC_TO_LATIN.items() if k not in "іїєґѕ"})
_WORD = re.compile(r"[0-9A-Za-zА-Яа-яЁё/+,.\"=:-]+")


def signs(text: str) -> str:
    text = re.sub(r"(?<=\d),(?=\d)", ".", text.translate(_SIGNS))
    text = re.sub(r"(\d)\s*[xхXХ]\s*(\d)", r"\1x\2", text)
    for names, latin in (("ду|dу|dн", "dn"), ("ру", "pn")):
        text = re.sub(rf"\b(?:{names})\.?\s*(?=\d)", f" {latin} ", text, flags=re.I)
    return " ".join(text.replace("мм", " mm ").split())


def latin(token: str) -> str:
    spelled = signs(token).lower().strip(" .,-").translate(_SPELL)
    kept = "".join(c for c in spelled if c.isascii())
    return " ".join(re.sub(r"\b(du|ru)(?=\d)", lambda m: {"du": "dn", "ru": "pn"}[m[1]], kept).split()).strip(" .-")


def variants(token: str) -> list[str]:
    """A diameter, pressure or length also as its name and its number."""
    if m := re.fullmatch(r"(dn|pn)([0-9]+(?:[.,][0-9]+)?)", token):
        return [token, m[1], m[2].replace(",", ".")]
    if m := re.fullmatch(r"([0-9]+(?:[.,][0-9]+)?)m", token):
        return list(dict.fromkeys([token, "m", m[1].replace(",", ".")]))
    return [token]


def tokens(text: str) -> list[str]:
    return [v for word in _WORD.findall(signs(text)) if (spelled := latin(word)) for v in variants(spelled)]


def attributes(text: str, words: Iterable[str]) -> dict[str, list[str]]:
    """Values by kind, from the text (numbers beside a name or a unit) and from the words."""
    words = list(words)
    have = set(words)
    number = r"([0-9]+(?:[.,][0-9]+)?)"
    found = {
        "dn": re.findall(rf"\bdn\s*{number}", text) + [w[2:] for w in words if re.fullmatch(r"dn[0-9]+(?:\.[0-9]+)?", w)],
        "pn": re.findall(rf"\bpn\s*{number}", text) + [w[2:] for w in words if re.fullmatch(r"pn[0-9]+(?:\.[0-9]+)?", w)],
        "inch": re.findall(r"\b([0-9]+(?:/[0-9]+)?)\s*(?:\"|inch)\b", text) + [w for w in words if re.fullmatch("[0-9]+/[0-9]+", w)],
        "angle": [a for a in re.findall(r"\b([0-9]+)\s*(?:deg|gr|grad)?\b", text) if a in ANGLES],
        "length": re.findall(rf"\b{number}\s*m\b", text) + [w[:-1] for w in words if re.fullmatch(r"[0-9]+(?:\.[0-9]+)?m", w)],
        "od": re.findall(rf"\bdn?\s*{number}\b", text),
        "material": [m for m, names in MATERIAL_WORDS.items() if have & set(names)],
        "connection": [c for c, names in CONNECTION_WORDS.items() if have & set(names)],
        "toilet_variant": [t for t in TOILET_WORDS if t in have],
    }
    return {k: list(dict.fromkeys(v)) for k, v in found.items()}


@dataclass
class Registry:
    """Categories with their aliases and weighted words, and the rewrites of phrases and words."""

    categories: list[dict] = field(default_factory=list)
    service: tuple[str, ...] = SERVICE
    phrases: dict[str, str] = field(default_factory=dict)
    words: dict[str, list[str]] = field(default_factory=dict)
    materials: dict[str, set[str]] = field(default_factory=dict)
    connections: dict[str, set[str]] = field(default_factory=dict)
    reranker: dict = field(default_factory=dict)

    @staticmethod
    def load(source: str | Path | Mapping | None) -> Registry:
        config = payload(source)
        categories = [dict(c) | {"aliases": list(dict.fromkeys(" ".join(tokens(str(a))) for a in c.get("aliases", ()) if str(a).strip()))} for c in config.get("categories") or () if isinstance(c, Mapping)]
        flat = lambda names: {t for n in names for t in tokens(str(n))}
        mapped = lambda key: {str(k): flat(v) for k, v in (config.get(key) or {}).items()}
        return Registry(
            categories, tuple(dict.fromkeys((*map(str, config.get("service_tokens") or ()), *SERVICE))), {signs(str(k)).lower(): signs(str(v)).lower() for k, v in (config.get("global_phrase_aliases") or {}).items()},
            {latin(str(k)): list(dict.fromkeys(t for v in values for t in tokens(str(v)))) for k, values in (config.get("global_token_aliases") or {}).items()}, mapped("material_aliases"), mapped("connection_aliases"), dict(config.get("semantic_reranker") or {}),
        )

    @property
    def lexicon(self) -> list[str]:
        known = {t for c in self.categories for a in c["aliases"] for t in a.split()} | {t for c in self.categories for part in ("strong_tokens", "context_tokens", "blocker_tokens") for t in c.get(part) or ()}
        return sorted(known | set(self.words) | {t for v in self.words.values() for t in v})

    def rewritten(self, text: str) -> tuple[str, list[str]]:
        """A text with the phrases' aliases put in, and those that matched."""
        matched = []
        for source, target in self.phrases.items():
            if source in text:
                text = re.sub(rf"\b{re.escape(source)}\b", target, text)
                matched.append(source)
        return " ".join(text.split()), matched

    def corrected(self, token: str, lexicon: list[str], known: set[str]) -> str:
        """A word's alias, else the nearest known word for one of four letters and more that isn't known."""
        if self.words.get(token):
            return self.words[token][0]
        if token in known or len(token) < 4:
            return token
        near = [(fuzzy.ratio(token, w), w) for w in lexicon if min(len(w), len(token)) * 200 >= CLOSE * (len(w) + len(token))]
        best = max(near, key=lambda x: x[0], default=(0.0, token))
        return best[1] if best[0] >= CLOSE else token

    def read(self, raw: str, lexicon: list[str] | None = None) -> dict:
        """text, tokens, numbers, attributes, matched (aliases and corrections) and specificity of a query."""
        lexicon = self.lexicon if lexicon is None else lexicon
        known = set(lexicon)
        cleaned = " ".join(str(raw or "").split())
        plain = signs(cleaned).lower()
        base = [t for t in tokens(cleaned) if t not in self.service]
        found = attributes(plain, base)
        text, matched = self.rewritten(plain)
        words: list[str] = []
        for token in tokens(text):
            better = self.corrected(token, lexicon, known)
            if better != token:
                matched.append(f"{token}->{better}")
            words += self.words.get(better) or [better]
        words = list(dict.fromkeys(words))
        for kind, names in (("material", self.materials), ("connection", self.connections)):
            found[kind] = list(dict.fromkeys([*found[kind], *(k for k, v in names.items() if v & set(words))]))
        numbers = list(dict.fromkeys(t for t in base if any(map(str.isdigit, t))))
        # fixed values: the weights
        specificity = min(10.0, 1.2 * sum(len(w) >= 3 and not w.isdigit() for w in words) + 1.5 * sum(map(len, found.values())))
        return {"text": " ".join(words) or text, "tokens": words, "numbers": numbers, "attributes": [(k, v) for k, v in found.items()], "matched": list(dict.fromkeys(matched)), "specificity": specificity}


QUERY = "struct<text:string,tokens:array<string>,numbers:array<string>,attributes:map<string,array<string>>,matched:array<string>,specificity:double>"
_TYPE = pa.struct([("text", pa.string()), ("tokens", pa.list_(pa.string())), ("numbers", pa.list_(pa.string())), ("attributes", pa.map_(pa.string(), pa.list_(pa.string()))), ("matched", pa.list_(pa.string())), ("specificity", pa.float64())])


def read_query(raw: Column, registry: Registry) -> Column:
    """``QUERY`` of a query; each distinct text of a batch is read once."""
    lexicon = registry.lexicon

    def run(column: pa.Array) -> pa.Array:
        texts = column.to_pylist()
        known = {t: registry.read(t or "", lexicon) for t in dict.fromkeys(texts)}
        return pa.array([known[t] for t in texts], _TYPE)

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, QUERY)(raw)

"""Rules that come from files: word aliases, family triggers, noise patterns, family words, review rules, policies.

Files are JSON and are read on the driver, where they are checked; what is left
of them is small and goes to the executors inside the functions.  A missing
file, a damaged one, or one of another shape gives no rules.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from pathlib import Path

from . import fixed
from .nomenclature import clean, family_tags, joined, latin, measure, search_words, signs


def phrase(value: object) -> str:
    """Lower case, one spelling of signs, single spaces."""
    return " ".join(signs(clean(value)).lower().replace("ё", "е").split())


def payload(source: str | Path | Mapping | None) -> dict:
    """A JSON object from a path or as given; anything else is an empty one."""
    if isinstance(source, Mapping):
        return dict(source)
    if source is None or not Path(source).exists():
        return {}
    try:
        found = json.loads(Path(source).read_text(encoding="utf-8"))
    except (OSError, json.JSONDecodeError):
        return {}
    return found if isinstance(found, dict) else {}


def _mapping(value: object) -> Mapping:
    return value if isinstance(value, Mapping) else {}


def _phrases(values: object) -> tuple[str, ...]:
    return tuple(dict.fromkeys(p for p in map(phrase, values) if p)) if isinstance(values, (list, tuple)) else ()


@dataclass(frozen=True)
class Resolve:
    """Tags that any of some phrases sets, if asked for only together with one of the family's own."""

    any_of: tuple[str, ...]
    tags: tuple[tuple[str, str], ...]
    with_family: bool


@dataclass(frozen=True)
class Rules:
    aliases: dict[str, tuple[str, ...]] = field(default_factory=dict)
    triggers: dict[str, tuple[tuple[str, ...], tuple[Resolve, ...]]] = field(default_factory=dict)
    ignored: tuple[str, ...] = ()
    leading: tuple[str, ...] = ()
    trailing: tuple[str, ...] = ()
    families: dict[str, tuple[str, ...]] = field(default_factory=dict)
    reviews: tuple[dict, ...] = ()

    @staticmethod
    def load(hints: str | Path | Mapping | None = None, dictionary: str | Path | Mapping | None = None) -> Rules:
        understanding, words = _mapping(payload(hints).get("query_understanding")), payload(dictionary)
        before = _mapping(understanding.get("preprocessing"))
        patterns = lambda key: tuple(p for p in before.get(key) or () if isinstance(p, str) and p.strip())
        aliases = {k: v for k, v in ((k, _phrases(v)) for k, v in _mapping(understanding.get("token_aliases")).items()) if v}
        triggers = {f: (_phrases(rule.get("aliases", ())), tuple(_resolves(rule))) for f, rule in _mapping(understanding.get("family_triggers")).items() if isinstance(rule, Mapping)}
        families = {f: tuple(clean(v) for v in values if clean(v)) for f, values in _mapping(words.get("family_aliases")).items() if isinstance(values, list)}
        reviews = tuple(r for r in words.get("manual_review_rules") or () if isinstance(r, dict) and isinstance(r.get("patterns"), list))
        return Rules(aliases, triggers, patterns("ignore_full_row_patterns"), patterns("strip_leading_patterns"), patterns("strip_trailing_patterns"), {k: v for k, v in families.items() if v}, reviews)


def _resolves(rule: Mapping) -> Iterable[Resolve]:
    for raw in rule.get("resolve_rules") or ():
        if isinstance(raw, Mapping) and isinstance(raw.get("set"), Mapping) and (phrases := _phrases(raw.get("match_any"))):
            # a key that starts with an underscore is a tag like any other
            yield Resolve(phrases, tuple((k, tag_value(v)) for k, v in raw["set"].items() if v is not None), bool(raw.get("require_family_alias")))


def tag_value(value: object) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    spelled = "_".join(filter(None, map(latin, phrase(value).split())))
    return re.sub(r"_+", "_", re.sub(r"[^a-z0-9_.:/-]+", "_", spelled)).strip("_")


def alias_names(parts: Iterable[object], rules: Rules) -> list[str]:
    """Canonical names whose phrases stand anywhere in the line, sorted."""
    text = phrase(joined(parts))
    return sorted(name for name, phrases in rules.aliases.items() if any(p in text for p in phrases))


# Tags that a phrase pattern gives by itself: families that must be there (any of them; none: always), pattern, tags.
_ALWAYS: tuple[str, ...] = ()
_VALVES = ("zadvizhka", "kran", "zatvor")
_PHRASE_RULES = (
    (_ALWAYS, r"(?<![a-zа-я0-9])(?:fm|mf)(?![a-zа-я0-9])", ("conn_gender:fm",)),
    (_ALWAYS, r"(?<![a-zа-я0-9])ff(?![a-zа-я0-9])", ("conn_gender:ff",)),
    (_ALWAYS, r"американка|разъемное соединение|сгон разъемный", ("family:mufta", "extra_connection:union")),
    (_ALWAYS, r"\bкорпус[-\s:]*чугун\b", ("body_material:cast_iron",)),
    (_ALWAYS, r"\bдиск[-\s:]*чугун\b", ("disc_material:cast_iron",)),
    (("elbow",), r"\bобвод", ("subtype:offset",)),
    (_VALVES, r"\b(?:рукоятк(?:ой|а)|ручка)\b", ("operator:handle",)),
    (_VALVES, r"\b(?:с|под) электропривод", ("operator:electric",)),
    (_VALVES, r"\bголый шток\b", ("operator:bare_stem",)),
)
_GEARBOX_RULES = ((r"\bчетвертьоборот", "turn_type:quarter_turn"), (r"\bконическ", "subtype:bevel"), (r"\bд/затв(?:ора)?\b|\bдля\s+затвор", "for_family:zatvor"), ("benarmo euro", "brand:benarmo_euro"), ("ridval", "brand:ridval"))
_GENDERS = r"\b(?:вн/?нар|нар/?вн|вн/?нр|вр/?нр|вн/?вр|внутр(?:енняя)?\s*[-/]?\s*наруж(?:ная)?)\b"
_POLYMER_FAMILIES = {"family:mufta", "family:perehod", "family:tee", "family:elbow"}


def hint_tags(parts: Iterable[object], rules: Rules) -> set[str]:
    """Tags of a line by aliases, family triggers and phrases."""
    parts = list(parts)
    text = phrase(joined(parts))
    if not text:
        return set()
    own = family_tags(search_words(parts, alias_names(parts, rules)), rules.families)
    is_gearbox = re.match(r"(?:\(рвз\)\s*)?редуктор\b", text) is not None
    tags = {t for name in alias_names([text], rules) if not (name == "gearbox_operator" and is_gearbox) for t in fixed.ALIAS_TAGS.get(name, ())}
    tags |= _triggered(text, rules, is_gearbox)
    if "муфта" in text and re.search(r"\bперех(?:од\w*)?\b", text):
        tags |= {"family:perehod", "subfamily:coupling"} | ({"subtype:inner_outer"} if re.search(_GENDERS, text) else set())
    if re.search(r"(?<![a-zа-я0-9.,])mm(?![a-zа-я0-9])", text) and not re.search(r"\d\s*мм\b", text):
        tags.add("conn_gender:mm")
    for families, pattern, given in _PHRASE_RULES:
        have = tags | own if families == ("elbow",) else own
        if (not families or any(f"family:{f}" in have for f in families)) and re.search(pattern, text):
            tags |= set(given)
    if "valfex" in text and re.search(r"\b(?:бел\w*|ppr|pp-r)\b", text) and tags & _POLYMER_FAMILIES:
        tags.add("mclass:polypropylene")
    if is_gearbox:
        tags.add("family:gearbox")
    elif any(f"family:{f}" in own for f in fixed.ARMATURE) and re.search(r"\bредуктор(?:ом)?\b", text):
        tags.add("operator:gearbox")
    if "family:gearbox" in tags:
        tags |= _gearbox(text)
    for low, high in re.findall(r"\b([0-9]+(?:[.,][0-9]+)?)\s*(?:\.\.|-)\s*([0-9]+(?:[.,][0-9]+)?)\s*(?:мпа|mpa)\b", text):
        tags |= {f"pressure_range_mpa:{measure(low)}-{measure(high)}", "family:manometer"}
    return tags


def _triggered(text: str, rules: Rules, is_gearbox: bool) -> set[str]:
    tags = set()
    for family, (phrases, resolves) in rules.triggers.items():
        name = fixed.FAMILY_NAMES.get(family, family)
        named = any(p in text for p in phrases)
        if named and (name != "gearbox" or is_gearbox):
            tags.add(f"family:{name}")
        for rule in resolves:
            if any(p in text for p in rule.any_of) and (named or not rule.with_family):
                values = [(k, fixed.FAMILY_NAMES.get(v, v) if k == "family" else v) for k, v in rule.tags]
                tags |= {f"{k}:{v}" for k, v in values if v and not ((k, v) == ("family", "gearbox") and not is_gearbox)}
    return tags


def _gearbox(text: str) -> set[str]:
    """Mounting pad, stem, diameters it fits, and how it turns."""
    ranges = re.findall(r"\b(?:dn|du|dy|ду)\s*(\d{1,4})\s*[-/]\s*(\d{1,4})\b", text)
    single = set(re.findall(r"\b(?:dn|du|dy|ду)\s*(\d{1,4})\b", text)) - {v for r in ranges for v in r}
    tags = {f"mounting_pad:f{v}" for v in re.findall(r"\bf\s*0?(\d{2})\b", text)} | {f"stem_square:{a}x{b}" for a, b in re.findall(r"\b(\d{1,2})\s*[xх]\s*(\d{1,2})\b", text)}
    return tags | {f"compatible_dn:{a}-{b}" for a, b in ranges} | {f"compatible_dn:{v}" for v in single} | {t for pattern, t in _GEARBOX_RULES if re.search(pattern, text)}


def review_rule(text: str, search_text: str, rules: Rules) -> dict | None:
    """The first review rule one of whose patterns stands in the raw or the search text."""
    text = text.lower()
    for rule in rules.reviews:
        for pattern in (clean(p).lower() for p in rule["patterns"]):
            spelled = " ".join(search_words([pattern]))
            if pattern and (pattern in text or spelled and spelled in search_text):
                return rule
    return None

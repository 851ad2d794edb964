"""Reading a nomenclature line: Latin spelling, search words, families, materials, sizes, codes.

A line is spelled in Latin letters and cut into lexemes (numbers, words and
signs).  Numbers joined by x, - or / make a chain, e.g. 45-2-57x4, and the
rules are stated over chains and over what stands beside a number; no rule
matches the text itself.  ``Reader`` holds the rules that come from files.

These are plain functions of Python strings; ``features`` applies them to
columns in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from . import fixed

_TO_CYRILLIC = str.maketrans(fixed.LATIN_LOOKALIKES, fixed.CYRILLIC_LOOKALIKES)
_TO_LATIN = str.maketrans(dict(reversed(list(zip(fixed.CYRILLIC_LOOKALIKES, fixed.LATIN_LOOKALIKES, strict=True)))))
_SPELL = str.maketrans(fixed.CYRILLIC_TO_LATIN)
_CODE = str.maketrans(fixed.CODE_CYRILLIC, fixed.CODE_LATIN)
_SIGNS = str.maketrans({"\n": " ", "∅": " dn ", "⌀": " dn ", "ø": " dn ", "Ø": " dn ", "½": "1/2", "¼": "1/4", "¾": "3/4", "°": " deg ", "№": " no ", "”": '"', "“": '"', "″": '"', "−": "-", "–": "-", "—": "-", "×": "x"})
_WORDS = re.compile(r"[0-9A-Za-zА-Яа-яЁёІіЇїЄєҐґ/+,.\"=:-]+")
_LEXEME = re.compile(r"(?P<num>[0-9]+(?:\.[0-9]+)?)|(?P<word>[^\W\d_]+)|(?P<sign>''|[^\w\s]|_)")


def clean(value: object) -> str:
    if value is None:
        return ""
    return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value).strip()


def joined(parts: Iterable[object]) -> str:
    return " ".join(p for p in map(clean, parts) if p)


def signs(text: str) -> str:
    """Special signs in one spelling, decimal points, and sizes as AxB without spaces."""
    text = re.sub(r"(?<=\d),(?=\d)", ".", text.translate(_SIGNS))
    return re.sub(r"(\d)\s*[*xхXХ]\s*(?=\d)", r"\1x", text)


def one_script(token: str) -> str:
    """A token of both scripts in the one that has more letters, Latin at a tie."""
    latin = sum("a" <= c <= "z" for c in token.lower())
    cyrillic = sum("а" <= c <= "я" or c in "ёіїєґ" for c in token.lower())
    return token if not latin or not cyrillic else token.translate(_TO_LATIN if latin >= cyrillic else _TO_CYRILLIC)


def latin(token: str) -> str:
    spelled = signs(one_script(token)).lower().translate(_SPELL)
    kept = "".join(c for c in spelled if c.isascii() or c.isdigit() or c.isspace())
    kept = re.sub(r"\b(du|ru)(?=\d)", lambda m: "dn" if m[1] == "du" else "pn", kept)
    return " ".join(kept.split()).strip(" .-")


def words(text: str) -> list[str]:
    return _WORDS.findall(text)


def measure(value: str) -> str:
    value = value.replace(",", ".").strip()
    return value.rstrip("0").rstrip(".") if "." in value else value


def degree(value: str) -> str:
    return {"87.5": "87"}.get(measure(value), measure(value))


def face(value: str) -> str:
    return {"v": "b"}.get(value.lower().strip(), value.lower().strip())


def by_size(values: Iterable[str]) -> str:
    return "x".join(sorted(values, key=float))


# Lexemes and chains


@dataclass
class Lexeme:
    kind: str
    text: str
    gap: bool  # white space stands before it


def lexemes(text: str) -> list[Lexeme]:
    out, end = [], 0
    for m in _LEXEME.finditer(text):
        out.append(Lexeme(m.lastgroup, m[0], m.start() > end or not out))
        end = m.end()
    return out


@dataclass
class Chain:
    """Numbers and the separators between them; ``first`` and ``last`` are places among the lexemes."""

    first: int
    last: int
    numbers: list[str]
    between: list[str]

    def isolated(self, k: int, side: str, also: str = "") -> bool:
        """No letter (x) and none of ``also`` joins the number k to its neighbour on a side."""
        at = k - 1 if side == "before" else k
        return not 0 <= at < len(self.between) or self.between[at] not in "xhn" and self.between[at] not in also


_JOINS = {"x", "h", "n", "-", "/"}


def chains(lex: list[Lexeme]) -> list[Chain]:
    out, k = [], 0
    while k < len(lex):
        if lex[k].kind != "num":
            k += 1
            continue
        chain = Chain(k, k, [lex[k].text], [])
        while chain.last + 2 < len(lex) and lex[chain.last + 1].text in _JOINS and lex[chain.last + 2].kind == "num" and (lex[chain.last + 1].kind == "sign" or not (lex[chain.last + 1].gap or lex[chain.last + 2].gap)):
            chain.between.append(lex[chain.last + 1].text)
            chain.numbers.append(lex[chain.last + 2].text)
            chain.last += 2
        out.append(chain)
        k = chain.last + 1
    return out


def _glued(lex: list[Lexeme], k: int) -> bool:
    """A letter stands right before the lexeme k."""
    return k > 0 and not lex[k].gap and lex[k - 1].kind == "word"


def _followed(lex: list[Lexeme], k: int) -> bool:
    """A letter or a slash stands right after the lexeme k."""
    return k + 1 < len(lex) and not lex[k + 1].gap and (lex[k + 1].kind == "word" or lex[k + 1].text == "/")


def _whole(number: str, low: int, high: int) -> bool:
    return "." not in number and low <= len(number) <= high


def _is_grade(chain: Chain) -> bool:
    """A chemical grade such as 08x18h10, whose numbers are no sizes."""
    n = chain.numbers
    return len(n) >= 3 and re.fullmatch(r"0[38][0-9]?|12[0-9]?", n[0]) is not None and chain.between[0] in "xh" and chain.between[1] in "hn" and len(n[1]) == 2 and len(n[2]) == 2


def _is_compound(chain: Chain) -> bool:
    """angle-series-size of an elbow."""
    n, b = chain.numbers, chain.between
    return len(n) >= 4 and degree(n[0]) in fixed.ANGLES and b[:2] == ["-", "-"] and n[1] in ("1", "2") and _whole(n[2], 2, 4) and b[2] in "xh"


@dataclass
class Sizes:
    """Collects the tags of one line."""

    lex: list[Lexeme]
    families: set[str]
    tokens: list[str]
    tags: set[str] = field(default_factory=set)

    def add(self, **values: str) -> None:
        self.tags |= {f"{k}:{v}" for k, v in values.items() if v}

    def of(self, key: str) -> set[str]:
        return {t[len(key) + 1 :] for t in self.tags if t.startswith(key + ":")}

    def has(self, *starts: str) -> bool:
        return any(x.kind == "word" and x.text.startswith(starts) for x in self.lex)

    def word(self, k: int) -> str:
        return self.lex[k].text if 0 <= k < len(self.lex) and self.lex[k].kind == "word" else ""

    def unit(self, k: int) -> str:
        """The word or sign after the number at k."""
        return self.lex[k + 1].text if k + 1 < len(self.lex) else ""

    def named_numbers(self) -> None:
        """Numbers that a word before them names."""
        for k, x in enumerate(self.lex):
            if x.kind != "num":
                continue
            at = k - 1
            sign = self.lex[at].text if at >= 0 and self.lex[at].kind == "sign" and self.lex[at].text in ".-=" else ""
            name = self.word(at - 1) if sign else self.word(at)
            start = at - 1 if sign else at
            if name and start > 0 and not self.lex[start].gap and self.lex[start - 1].kind == "num":
                continue
            # only one sign, and only where it may stand
            if name in ("dn", "du", "dy") and sign in ("", ".", "-") or name == "dn":
                self.add(dn=x.text)
            elif name in ("pn", "ru") and sign in ("", ".", "-"):
                self.add(pn=x.text)
            elif name == "kvs" and sign in ("", "="):
                self.add(kvs=x.text)
            elif name == "l" and (sign in (".", "=", "") and self.unit(k).startswith("mm") or sign == "=" and (k + 1 == len(self.lex) or self.lex[k + 1].gap)):
                self.add(lmm=x.text)
            elif name == "d" and not sign:
                self.add(dn=x.text, od=x.text if "." not in x.text else "")
            elif name in ("st", "ct") and sign in ("", "."):
                tail = self.word(k + 1) if k + 1 < len(self.lex) and not self.lex[k + 1].gap else ""
                self.add(mat=x.text.split(".")[0] + tail)
            elif name == "gost" and not sign and re.fullmatch(r"[0-9]{5}", x.text):
                self.add(spec=x.text)
            elif name in ("tip", "type") and not sign and x.text in ("01", "11"):
                self.add(type=x.text)
            if x.text == "8" and self.lex[k].gap and self.word(k + 1).startswith("otverst"):
                self.add(hole="8")

    def units(self) -> None:
        """Numbers that a unit follows: millimetres, degrees, inches."""
        for k, x in enumerate(self.lex):
            if x.kind != "num":
                continue
            after = self.unit(k)
            if after == "mm":
                before = "".join(y.text for y in self.lex[max(0, k - 2) : k])
                if not re.search(r"(?:^|[^a-z])l=?$", before) and float(x.text) >= 10:
                    self.add(dn=x.text, od=x.text)
            if degree(x.text) in fixed.ANGLES and x.text in (*fixed.ANGLES, "87,5"):
                named = after in ("deg", "gr", "grad")
                joined_by_x = _glued(self.lex, k) and self.lex[k - 1].text in ("x", "h")
                if named and (not _glued(self.lex, k) or joined_by_x) or after == "-" and not _glued(self.lex, k):
                    self.add(deg=degree(x.text))
            if after in ('"', "''", "'") or after in ("inch", "diuim", "dyuim"):
                self.inches(k)

    def inches(self, k: int) -> None:
        """A whole, broken or mixed number that ends at k."""
        parts, first = [self.lex[k].text], k
        if k >= 2 and self.lex[k - 1].text == "/" and self.lex[k - 2].kind == "num":
            parts, first = [self.lex[k - 2].text + "/" + self.lex[k].text], k - 2
            if k >= 3 and self.lex[k - 2].gap and self.lex[k - 3].kind == "num":
                parts, first = [self.lex[k - 3].text, *parts], k - 3
        if first and self.lex[first - 1].text == "/":
            return
        value = "".join(parts)
        if value in fixed.INCH_TO_DN:
            self.add(inch=value)
        if first >= 2 and self.lex[first - 1].text in ("x", "h", "r") and (size := self.lex[first - 2 if self.lex[first - 1].text != "r" else max(0, first - 3)]).kind == "num" and _whole(size.text, 2, 4):
            self.add(dn=measure(size.text))

    def of_chain(self, chain: Chain, compound: bool) -> None:
        n, b = chain.numbers, chain.between
        if len(n) >= 2 and b[0] == "/" and _whole(n[0], 2, 4) and degree(n[1]) in fixed.ANGLES and self.word(chain.first - 1) in ("dn", "du", "dy"):
            self.add(dn=n[0], deg=degree(n[1]))
        if _is_compound(chain):
            self.add(deg=degree(n[0]), series=n[1])
        self.flange(n, b, chain)
        if _is_grade(chain):
            return
        skip = 2 if compound and _is_compound(chain) else 0
        self.wall_pairs(chain, skip)
        if "tee" in self.families or self.has("troinik", "tee"):
            self.branches(chain)
        if self.has("pereh"):
            self.transition(chain)
        tail = b[-1] == "-" if b else chain.first >= 2 and self.lex[chain.first - 1].text == "-" and not (self.lex[chain.first].gap or self.lex[chain.first - 1].gap)
        if tail and n[-1] in fixed.VALVE_DNS and self.has("kran", "klapan", "filtr", "rezba", "vozduhootvod", "vozdnhootvod", "zatvor", "zadvizh"):
            self.add(dn=n[-1])

    def flange(self, n: list[str], b: list[str], chain: Chain) -> None:
        """dn-pn-type-execution-face, or without dn."""
        if _glued(self.lex, chain.first):
            return
        for k in range(len(n)):
            if n[k] not in ("01", "11") or k == 0 or b[k - 1] != "-" or not _whole(n[k - 1], 2, 4):
                continue
            full = k >= 2 and b[k - 2] == "-" and _whole(n[k - 2], 2, 4)
            executed = k + 1 < len(n) and b[k] == "-" and n[k + 1] in ("1", "2")
            surface = ""
            if executed and k + 1 == len(n) - 1 and chain.last + 2 < len(self.lex) and self.lex[chain.last + 1].text == "-" and len(self.word(chain.last + 2)) == 1:
                surface = face(self.word(chain.last + 2))
            if full:
                self.add(dn=n[k - 2], pn=n[k - 1], type=n[k], exec=n[k + 1] if executed else "")
            if surface:
                self.add(pn=n[k - 1], type=n[k], exec=n[k + 1], face=surface)

    def wall_pairs(self, chain: Chain, skip: int) -> None:
        """Outer diameter and wall: AxB or A-B with a wall of 12 at most."""
        n, b = chain.numbers, chain.between
        vgp = "vgp" in self.tokens or "vodogazoprovod" in self.tokens or any(x.text == "3262" for x in self.lex)
        k = skip
        while k + 1 < len(n):
            starts = chain.isolated(k, "before") if k > skip else not (k == 0 and _glued(self.lex, chain.first))
            ends = chain.isolated(k + 1, "after", "/" if b[k] in "xh" else "") and not (k + 2 == len(n) and _followed(self.lex, chain.last) and (b[k] in "xh" or self.lex[chain.last + 1].kind == "word"))
            if starts and ends and b[k] in "xh-" and len(n[k].split(".")[0]) <= 4:
                if float(n[k + 1]) <= 12:
                    self.add(od=n[k], wall=n[k + 1], dn=n[k] if b[k] == "-" and vgp else "")
                k += 2  # a number is part of one pair only
            else:
                k += 1

    def branches(self, chain: Chain) -> None:
        """Tees: three diameters (a wall may follow), or two."""
        n, b = chain.numbers, chain.between
        for k in range(len(n) - 2):
            trio = n[k : k + 3]
            if all(_whole(v, 2, 4) for v in trio) and b[k] in "x/" and b[k + 1] in "x/" and chain.isolated(k, "before") and (chain.isolated(k + 2, "after") or k + 3 < len(n) and float(n[k + 3]) <= 12):
                self.add(tripledn=by_size(trio))
                self.tags |= {f"dn:{v}" for v in trio}
                if k + 3 < len(n) and b[k + 2] == "x" and float(n[k + 3]) <= 12:
                    self.add(wall=measure(n[k + 3]))
        self.pairs(chain)

    def pairs(self, chain: Chain) -> None:
        n, b = chain.numbers, chain.between
        k = 0
        while k + 1 < len(n):
            if _whole(n[k], 2, 4) and _whole(n[k + 1], 2, 4) and b[k] in "x/-" and chain.isolated(k, "before") and chain.isolated(k + 1, "after") and not (k == 0 and _glued(self.lex, chain.first) and self.word(chain.first - 1) not in ("dn", "d")):
                self.add(pairdn=by_size(n[k : k + 2]))
                self.tags |= {f"dn:{n[k]}", f"dn:{n[k + 1]}"}
                k += 2
            else:
                k += 1

    def transition(self, chain: Chain) -> None:
        """Reducers: two diameters with a wall, two alone, or two with a wall each."""
        n, b = chain.numbers, chain.between
        for k in range(len(n) - 2):
            if b[k] == b[k + 1] == "x" and chain.isolated(k, "before") and chain.isolated(k + 2, "after", "/") and _whole(n[k], 2, 4) and _whole(n[k + 1], 2, 4) and float(n[k + 2]) <= 12:
                self.add(wall=measure(n[k + 2]), pairdn=by_size(n[k : k + 2]))
                self.tags |= {f"{key}:{v}" for key in ("dn", "od") for v in n[k : k + 2]}
        self.pairs(chain)
        for k in range(len(n) - 3):
            if b[k] in "xh" and b[k + 1] in "-/" and b[k + 2] in "xh" and chain.isolated(k, "before") and min(len(n[k].split(".")[0]), len(n[k + 2].split(".")[0])) >= 2:
                ends = [measure(n[k]), measure(n[k + 2])]
                self.add(pairdn=by_size(ends))
                self.tags |= {f"dn:{v}" for v in ends}

    def infer(self, compound: bool) -> None:
        """What follows from the rest: angles of elbows, lone sizes, pipe diameters, equal tees."""
        if "elbow" in self.families:
            for k, x in enumerate(self.lex):
                if x.kind == "word" and x.text in ("ugolnik", "ugol", "otvod", "koleno"):
                    near = next((j for j in range(k + 1, len(self.lex)) if self.lex[j].kind == "num"), None)
                    between = sum(len(y.text) + y.gap for y in self.lex[k + 1 : near]) if near else 9
                    if near and between <= 6 and degree(self.lex[near].text) in fixed.ANGLES and not _followed(self.lex, near):
                        self.add(deg=degree(self.lex[near].text))
                    break
        fittings = {"otvod", "koleno", "mufta", "troinik", "zaglushka", "perehod", "flanec", "kran", "klapan", "zatvor", "filtr", "truba"}
        ending = len(self.lex) - (1 if self.lex and self.lex[-1].text == "mm" else 0) - 1
        if ending >= 0 and self.lex[ending].kind == "num" and self.lex[ending].gap and _whole(self.lex[ending].text, 2, 4) and any(x.text in fittings for x in self.lex):
            self.add(dn=self.lex[ending].text, od=self.lex[ending].text if self.has("truba") else "")
        numbers = [measure(t) for t in (t.strip(".,;:()[]{}") for t in self.tokens) if re.fullmatch(r"[0-9]{2,4}(?:\.[0-9]+)?", t)]
        if numbers and not compound and not any("dn:" in t for t in self.tags):
            turns = {degree(v) for v in self.of("deg")}
            fit = [v for v in numbers if v not in turns and 10 <= float(v) <= 400]
            if fit and self.families & {"elbow", "pipe", "revision", "zaglushka"}:
                size = fit[-1] if "elbow" in self.families else fit[0]
                self.add(dn=size, od=size if self.families & {"elbow", "pipe"} else "")
        if "vgp" in self.tokens or "vodogazoprovod" in self.tokens or any(x.text == "3262" for x in self.lex):
            nominal, outer = self.of("dn"), self.of("od")
            self.tags |= {f"od:{fixed.VGP_OD[measure(v)]}" for v in nominal if measure(v) in fixed.VGP_OD}
            self.tags |= {f"dn:{dn}" for v in outer for dn, od in fixed.VGP_OD.items() if od == measure(v)}
        if self.has("troinik", "tee") and not self.of("tripledn") and self.has("ravn", "equal"):
            self.tags |= {f"tripledn:{by_size([measure(v)] * 3)}" for v in self.of("od") or self.of("dn")}
        if "tee" in self.families and not self.of("tripledn") and not self.of("pairdn") and len(self.of("dn")) == 1:
            self.add(tripledn=by_size([measure(next(iter(self.of("dn"))))] * 3))


# Search words


def variants(token: str) -> list[str]:
    """A search token and what else it may be looked for as: full words, standards, grades, sizes, executions, fragments."""
    out = [token, *fixed.ABBREVIATIONS.get(token, ())]
    if standard := re.match(r"([0-9]{5})(?:$|[-/])", token):
        out += [f"spec{standard[1]}"] + (list(fixed.REPLACED_STANDARDS.get(standard[1], ())) if re.fullmatch(r"[0-9]{5}(?:-[0-9]{2,4})?", token) else [])
    grade = lambda t: [f"mat{m[1]}"] if (m := re.fullmatch(r"[sc]t\.?([0-9][0-9a-z]*)", t)) else []
    out += grade(token)
    pieces = re.split(r"([x-])", token)
    numbers, between = pieces[::2], pieces[1::2]
    numeric = [re.fullmatch(r"[0-9]+(?:\.[0-9]+)?", p) is not None for p in numbers]
    if len(numbers) == 2 and all(numeric) and len(numbers[0].split(".")[0]) <= 4 and float(numbers[1]) <= 12:
        out += [f"{numbers[0]}x{numbers[1]}"] * (between == ["-"]) + [f"od{numbers[0]}", f"wall{measure(numbers[1])}"]
    if len(numbers) in (4, 5) and between[:3] == ["-", "-", "x"] and all(numeric[:4]) and numbers[0] in fixed.ANGLES and _whole(numbers[2], 2, 4):
        out += [f"deg{numbers[0]}", f"series{numbers[1]}", f"od{numbers[2]}", f"wall{measure(numbers[3])}"] + [f"mat{numbers[4]}"] * (len(numbers) == 5)
    out += _execution(token.split("-"))
    if token.count("-") >= 2:
        for part in filter(None, token.split("-")):
            out += [part, *grade(part)] + [f"hole{part}"] * (part in ("8", "12")) + [f"face{face(part)}"] * (len(part) == 1 and part.isalpha())
    return list(dict.fromkeys(filter(None, out)))


def _execution(parts: list[str]) -> list[str]:
    """Words for [dn-]pn-type[-execution][-face] of flanges."""
    for lead in (("dn", "pn"), ("pn",)):
        k = len(lead)
        if len(parts) <= k or parts[k] not in ("01", "11") or not all(_whole(p, 2, 4) and p.isdigit() for p in parts[:k]):
            continue
        out = [f"{name}{p}" for name, p in zip(lead, parts, strict=False)] + [f"type{parts[k]}"]
        rest = parts[k + 1 :]
        if rest and rest[0] in ("1", "2"):
            out.append(f"exec{rest.pop(0)}")
        if rest and len(rest[0]) == 1 and rest[0].isalpha():
            out.append(f"face{face(rest[0])}")
        return out
    return []


def search_words(parts: Iterable[object], aliases: Iterable[str] = ()) -> list[str]:
    """Words of a line's search text; ``aliases`` (canonical names of rule files) come first."""
    out = list(aliases)
    for part in map(clean, parts):
        for word in words(signs(part)):
            if word.lower() not in fixed.UNIT_TOKENS and (spelled := latin(word)):
                out += variants(spelled)
    return out


def family_tags(tokens: Iterable[str], extra: dict[str, tuple[str, ...]] | None = None) -> set[str]:
    tokens = set(tokens)
    known = fixed.FAMILIES if not extra else {f: tuple(dict.fromkeys((*fixed.FAMILIES.get(f, ()), *extra.get(f, ())))) for f in (*fixed.FAMILIES, *extra)}
    return {f"family:{f}" for f, starts in known.items() if any(t.startswith(starts) or any(s in t for s in starts if s in fixed.FAMILY_ANYWHERE) for t in tokens)}


def material_tags(tokens: list[str]) -> set[str]:
    """Grades and classes; stainless beats steel."""
    have, text = set(tokens), " ".join(tokens)
    named = {g for g, (_, exact, _) in fixed.GRADES.items() if have & set(exact)}
    other_steel = any(g != "cs20" and fixed.GRADES[g][0] == "steel" for g in named)
    grades = named | {g for g, (_, _, pieces) in fixed.GRADES.items() if any(p in text for p in pieces) and not (g == "cs20" and other_steel)}
    classes = {fixed.GRADES[g][0] for g in grades}
    for name, (starts, exact) in fixed.MATERIALS.items():
        free = (t for k, t in enumerate(tokens) if name not in fixed.GUARDED_MATERIALS or k == 0 or tokens[k - 1] not in ("dlya", "pod"))
        if any(t in exact or t.startswith(starts) for t in free):
            classes.add(name)
    if "truba" in have and have & set(fixed.STEEL_PIPE_TOKENS) and not classes & {"steel", *fixed.NOT_STEEL}:
        classes.add("steel")
    if "stainless" in classes:
        classes.discard("steel")
    return {f"grade:{g}" for g in grades} | {f"mclass:{c}" for c in classes}


def size_tags(parts: Iterable[object], tokens: list[str], families: set[str]) -> set[str]:
    """Tags of all sizes of a line."""
    text = signs(joined(parts)).lower().replace("ё", "е")
    spelled = " ".join(re.sub(r"\S+", lambda m: one_script(m[0]), text).split())
    lex = lexemes(spelled.translate(_SPELL))
    for x in lex:
        x.text = {"du": "dn"}.get(x.text, x.text) if x.kind == "word" else x.text
    sizes = Sizes(lex, {f.split(":", 1)[1] for f in families}, tokens)
    every = chains(lex)
    compound = "elbow" in sizes.families and any(map(_is_compound, every))
    sizes.named_numbers()
    sizes.units()
    for chain in every:
        sizes.of_chain(chain, compound)
    sizes.infer(compound)
    return sizes.tags


#: Search words that are tags themselves: key, and what its value must be.
_STRUCTURED = {"deg": str.isdigit, "series": str.isdigit, "od": str.isdigit, "wall": bool, "mat": bool, "type": str.isdigit, "exec": str.isdigit, "face": bool, "hole": str.isdigit, "spec": str.isdigit}


def structured_tags(tokens: Iterable[str]) -> set[str]:
    out = set()
    for token in tokens:
        key = next((k for k in _STRUCTURED if token.startswith(k)), None)
        if key and _STRUCTURED[key](value := token[len(key) :]):
            out.add(f"{key}:{measure(value) if key == 'wall' else face(value) if key == 'face' else value}")
    return out


def augmented(tokens: list[str], tags: Iterable[str]) -> list[str]:
    """Search words with a word for each tag, in the fixed order of keys."""
    tags = set(tags)
    values: dict[str, list[str]] = {}
    for tag in sorted(tags):
        key, _, value = tag.partition(":")
        values.setdefault(key, []).append(value)
    plain = ("type", "exec", "face", "hole", "spec", "deg", "series")
    out = [*tokens, *(f"{k}{v if k in plain else measure(v)}" for k in fixed.MEASURE_TAGS for v in values.get(k, ())), *(f"{k}{v}" for k in fixed.PAIR_TAGS for v in values.get(k, ()))]
    out += [f"{k}_{v}" for k in ("family", *fixed.WORD_TAGS) for v in values.get(k, ())]
    if "family:flange" in tags and "vorotnikovyi" in out:
        out += ["privarnoi", "vstyk"]
    if tags & {"grade:cs20", "mat:20"}:
        out.append("stalnoi")
    first = len(tokens)
    return [*tokens, *(w for w in dict.fromkeys(out[first:]) if w not in set(tokens))]


# Codes and sizes that rank


_GRADE_CODE = re.compile(r"(?:[cs]t\.?\d+|09g2s|12x18h10t|12kh18n10t|aisi\d+|a351|cf8m?|ggg\d+|[vs]ch\d+|l?63|cw617n|cuzn\d+)", re.I)
_MEASURE_NAMES = ("dn", "du", "pn", "ru", "kvs", "l=")


def code_tokens(parts: Iterable[object]) -> set[str]:
    """Codes: words of letters and digits, or of three capitals and more, as they look, without sizes, diameters and grades."""
    out = set()
    for part in map(clean, parts):
        for word in words(signs(part)):
            letters, digits = any(map(str.isalpha, word)), any(map(str.isdigit, word))
            if not letters or not digits and not re.fullmatch(r"[A-ZА-ЯЁ]{3,}", word):
                continue
            seen = one_script(word).lower().translate(_CODE).translate(_SPELL)
            code = re.sub(r"[^a-z0-9./+=\"-]", "", seen)
            if len(code) >= 3 and not re.fullmatch(r"\d+x\d+(?:x\d+)?", code) and not code.startswith(_MEASURE_NAMES) and not _GRADE_CODE.fullmatch(code):
                out.add(code)
    return out


def is_strong_code(code: str) -> bool:
    """A code that tells goods apart: no measure, grade, chain of numbers or size."""
    code = one_script(clean(code)).lower().replace("х", "x")
    if not code or code.startswith(("gost", "goct", *_MEASURE_NAMES)) or _GRADE_CODE.fullmatch(code):
        return False
    numbers = re.split(r"[-./+=xh]", code)
    if len(numbers) > 1 and all(map(str.isdigit, numbers)):
        return False
    letters = sum(map(str.isalpha, code))
    return any(map(str.isdigit, code)) and (letters >= 2 or any(s in code for s in "./+="))


def size_pairs(parts: Iterable[object]) -> set[str]:
    """AxB of a line, numbers with three decimals at most."""
    text = one_script(signs(joined(parts))).lower()

    def plain(number: str) -> str:
        value = float(number.replace(",", "."))
        return str(int(value)) if value.is_integer() else f"{value:.3f}".rstrip("0").rstrip(".")

    return {f"{plain(a)}x{plain(b)}" for a, b in re.findall(r"(?<!\d)(\d+(?:[.,]\d+)?)\s*[xх]\s*(\d+(?:[.,]\d+)?)(?!\d)", text)}


def token_root(token: str) -> str:
    letters = re.sub("[^a-zа-я]", "", token.lower())
    return token if len(letters) < 4 else letters[:5]


def key_tokens(tokens: Iterable[str]) -> set[str]:
    return {t for t in tokens if len(t) >= 3 and t not in fixed.COMMON_TOKENS and not t.isdigit()}

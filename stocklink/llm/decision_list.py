"""Quality rules as a learned decision list, applied as Spark expressions only.

Every statistic of a text is a DataFrame expression.  The list is learned by
sequential covering: a rule, a conjunction of thresholds on statistics, is
grown on two thirds of the labelled rows to cover bad documents only, pruned
on the other third, and what it covers is set aside before the next one is
grown.  The rules become one ordered conditional expression, the first match
decides, and a document that no rule covers is kept.

Labels come from the rows outside the held-out fold (crc32 of doc_id as text
modulo ``FOLDS`` is 0), at most ``MAX_TRAIN`` of them, those with the smallest
hash of doc_id; the smallest label of a doc_id counts.  Null and empty texts
have no words and fail the base rules; without labels the list is empty and
the base rules alone decide; repeated rows are judged each; further columns
pass by unread.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD, WIDTH = r"[^\x20\x09-\x0D]+", 5
FOLDS, MAX_TRAIN = 5, 20_000
MAX_RULES, MAX_CONDITIONS, CUTS, MIN_COVER, MIN_PRECISION = 24, 4, 48, 5, 0.9

#: Characters that are counted, by statistic.
COUNTED = {"n_symbols": "#*$%&|<>", "n_upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "n_digits": "0123456789", "n_stops": ".", "n_commas": ",;:", "n_bangs": "!?", "n_bars": "|", "n_slashes": "/\\_=+~^@"}
#: What the list's thresholds apply to: a statistic by another one.
RATIOS = {
    "word_length": ("word_chars", "n_words"), "symbols": ("n_symbols", "word_chars"), "upper": ("n_upper", "word_chars"), "digits": ("n_digits", "word_chars"), "stops": ("n_stops", "n_words"), "commas": ("n_commas", "n_words"),
    "bangs": ("n_bangs", "n_words"), "bars": ("n_bars", "n_words"), "slashes": ("n_slashes", "word_chars"), "repeats": ("n_repeat_words", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "line_words": ("n_words", "n_lines"), "distinct": ("n_distinct", "n_words"),
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, width: int = WIDTH) -> Column:
    """Number of words in windows of ``width`` words that occur twice or more, the first one included.

    Windows are compared by 64-bit hash.  Only a text that has equal ones
    sorts them, to find their places.
    """

    def places(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(ordered, lambda s: F.sort_array(F.filter(F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"])), lambda i: i.isNotNull())))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda i, k: F.coalesce(F.least(F.get(at, k + 1) - i, F.lit(width)), F.lit(width)))
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (width - 1)), lambda i: F.xxhash64(F.slice(words, i, width)))
    count = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(places(h), covered)))
    return F.when(F.size(words) > width, count).otherwise(F.lit(0))


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every document, all as longs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    by_words = let(words, lambda w: F.struct(F.size(w).alias("n_words"), F.size(F.array_distinct(w)).alias("n_distinct"), repeated_words(w).alias("n_repeat_words")))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    by_lines = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    counts = {name: F.length(text) - F.length(F.translate(text, chars, "")) for name, chars in COUNTED.items()}
    word_chars = F.length(F.translate(text, " \t\n\x0b\x0c\r", ""))
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), by_words.alias("w"), by_lines.alias("l"), word_chars.alias("word_chars"), *[c.alias(n) for n, c in counts.items()])
    names = ["w.n_words", "w.n_distinct", "w.n_repeat_words", "l.n_lines", "l.n_dup_lines", "word_chars", *COUNTED]
    return got.select("doc_id", *[F.col(n).cast("long").alias(n.split(".")[-1]) for n in names])


@dataclass(frozen=True)
class Condition:
    """A ratio above or not above a threshold."""

    ratio: str
    above: bool
    threshold: float

    def column(self) -> Column:
        top, bottom = (F.col(c) for c in RATIOS[self.ratio])
        value = top / F.greatest(bottom, F.lit(1))
        return value > self.threshold if self.above else value <= self.threshold

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.ratio] > self.threshold if self.above else x[self.ratio] <= self.threshold


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    held = np.ones(n, bool)
    for condition in rule:
        held &= condition.holds(x)
    return held


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Add the condition with the greatest gain of information until no good document is covered."""
    rule: list[Condition] = []
    held = np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS and held.any() and not bad[held].all():
        p, n = int(bad[held].sum()), int((~bad[held]).sum())
        if not p:
            break
        best, best_gain = None, 1e-9
        for ratio, column in x.items():
            values = column[held]
            cuts = np.unique(np.quantile(values, np.linspace(0, 1, CUTS + 1)[1:-1], method="lower"))
            order = np.argsort(values, kind="stable")
            below = np.searchsorted(values[order], cuts, side="right")
            # a threshold stands halfway to the next value, so that what was never seen falls to the nearer side
            cuts = (cuts + values[order][np.minimum(below, len(values) - 1)]) / 2
            bads = np.concatenate([[0], np.cumsum(bad[held][order])])[below]
            for above in (False, True):
                pc = p - bads if above else bads
                nc = (len(values) - below if above else below) - pc
                gain = np.where(pc > 0, pc * (np.log2(np.maximum(pc, 1) / np.maximum(pc + nc, 1)) - np.log2(p / (p + n))), 0)
                k = int(gain.argmax()) if len(gain) else 0
                if len(gain) and gain[k] > best_gain:
                    best, best_gain = Condition(ratio, above, float(cuts[k])), gain[k]
        if best is None:
            break
        rule.append(best)
        held &= best.holds(x)
    return tuple(rule)


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The beginning of the rule that tells bad from good best on rows it wasn't grown on."""

    def worth(part: Rule) -> float:
        held = covers(part, x, len(bad))
        return float((bad[held].sum() - (~bad[held]).sum()) / held.sum()) if held.any() else -1.0

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)


def learn(rows: list[dict], bad: list[bool]) -> list[Rule]:
    """An ordered list of rules from statistics and labels."""
    x = {name: np.asarray([r[top] / max(r[bottom], 1) for r in rows], np.float64) for name, (top, bottom) in RATIOS.items()}
    y = np.asarray(bad, bool)
    third = np.arange(len(y)) % 3 == 2
    left = np.ones(len(y), bool)
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        grow, prune = left & ~third, left & third
        if y[grow].sum() < MIN_COVER:
            break
        part = lambda at: {k: v[at] for k, v in x.items()}
        rule = _grow(part(grow), y[grow])
        if rule and prune.any():
            rule = _prune(rule, part(prune), y[prune])
        held = covers(rule, x, len(y)) & left
        if not rule or held.sum() < MIN_COVER or y[held].mean() < MIN_PRECISION:
            break
        rules.append(rule)
        left &= ~held
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True (keep) or False by the first rule that covers a document."""
    chain = None
    for rule in rules:
        held = rule[0].column()
        for condition in rule[1:]:
            held = held & condition.column()
        chain = F.when(held, False) if chain is None else chain.when(held, False)
    return F.lit(True) if chain is None else chain.otherwise(True)


def describe(rules: list[Rule]) -> list[str]:
    return [" and ".join(f"{c.ratio} {'>' if c.above else '<='} {c.threshold:.6g}" for c in rule) for rule in rules]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MAX_TRAIN) -> list[Rule]:
    """Rules from the labelled sample; its statistics go to the driver, ``most`` rows at most: the smallest ones of each doc_id."""
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(FOLDS))
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold != 0))
    one = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("y"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # at most ``most`` rows of two numbers
    stats = with_statistics(sample)
    one = stats.groupBy("doc_id").agg(F.min(F.struct(*stats.columns[1:])).alias("s")).select("doc_id", "s.*").join(F.broadcast(chosen), "doc_id")
    rows = sorted((r.asDict() for r in one.collect()), key=lambda r: tuple(r.values()))
    # an order that doesn't follow doc_id or time, so that each third is like the whole
    order = np.random.default_rng(1).permutation(len(rows))
    return learn([rows[k] for k in order], [rows[k]["y"] == 0 for k in order])


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, n_words, the base statistics, base_failed and kept of every document."""
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return with_statistics(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))

"""What else moves a score: preferences among flanges, and weights that a family gives its keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.dimensions import values_of
from ..functions.tokens import primary_family, tag_values
from .policy import sizes_share


def _points(*rules: tuple[Column, float]) -> Column:
    """The points of the first rule that holds."""
    out = F.when(rules[0][0], rules[0][1])
    for holds, points in rules[1:]:
        out = out.when(holds, points)
    return out.otherwise(0.0)


def flange_preference(order_tags: Column, stock_tags: Column) -> Column:
    """Points for face, execution, holes and grade of a flange; 0 if either side is none."""
    asked, there = (lambda key: tag_values(order_tags, key)), (lambda key: tag_values(stock_tags, key))
    some, no = (lambda v: F.size(v) > 0), (lambda v: F.size(v) == 0)
    both = lambda key: some(asked(key)) & some(there(key))
    meets = lambda key: F.arrays_overlap(asked(key), there(key))
    has = lambda key, value: F.array_contains(there(key), value)
    open_11 = no(asked("exec")) & (asked("type") == F.array(F.lit("11")))
    # fixed values: the points
    face = _points((both("face") & meets("face"), 4.0), (both("face"), -6.0), (no(asked("face")) & has("face", "b"), 3.0))
    execution = _points((both("exec") & meets("exec"), 4.0), (both("exec"), -8.0), (open_11 & has("exec", "2"), 6.0), (open_11 & has("exec", "1"), -2.0))
    holes = _points((open_11 & has("hole", "8") & has("exec", "2"), 8.0), (open_11 & has("hole", "8"), 4.0))
    grade = _points((no(asked("grade")) & has("grade", "cs20"), 4.0), (both("grade") & meets("grade"), 2.0), (both("grade"), -6.0))
    flanges = F.array_contains(order_tags, "family:flange") & F.array_contains(stock_tags, "family:flange")
    return F.when(flanges, face + execution + holes + grade).otherwise(0.0)


def partial_credit(family: Column, order_dims: Column, stock_dims: Column) -> Column:
    """struct(points, scale): credit for transitions and tees that share a diameter, and what a conflict of pairs then counts."""
    shared = F.size(sizes_share(order_dims, stock_dims))
    paired = F.size(values_of(stock_dims, "pairdn")) > 0
    single = F.size(F.array_union(values_of(stock_dims, "dn"), values_of(stock_dims, "od"))) == 1
    tee = (family == "tee") & (F.size(values_of(order_dims, "tripledn")) > 0)
    transition = family == "perehod"
    # fixed values: the points
    points = _points(
        (F.coalesce(shared, F.lit(0)) == 0, 0.0), (transition & paired & (shared >= 2), 12.0), (transition & paired, 10.0), (transition & single, 6.0), (tee & paired & (shared >= 2), 14.0), (tee & paired, 12.0), (tee & single, 6.0),
    )
    return F.struct(points.alias("points"), F.when(transition & paired & (shared > 0), 0.25).otherwise(1.0).alias("scale"))


def profile_bonus(order_tags: Column, stock_tags: Column, order_dims: Column, stock_dims: Column) -> Column:
    """Points of the line's primary family for equal, different and surplus keys, with the partial credit; 0 for families without a profile."""
    family = primary_family(order_tags, fixed.PRIMARY_FAMILIES)
    credit = partial_credit(family, order_dims, stock_dims)
    points = credit["points"]
    # each key is looked up and compared once, whatever the number of families that weigh it
    for key in dict.fromkeys(k for parts in fixed.FAMILY_PROFILES.values() for part in parts for k in part):
        asked, there = values_of(order_dims, key), values_of(stock_dims, key)
        equal, different, surplus = (_by_family(family, {name: parts[k].get(key, 0.0) for name, parts in fixed.FAMILY_PROFILES.items()}) for k in range(3))
        both, meets = (F.size(asked) > 0) & (F.size(there) > 0), F.arrays_overlap(asked, there)
        scale = credit["scale"] if key == "pairdn" else F.lit(1.0)
        points = points + F.when(both & meets, equal).when(both, scale * -different).when((F.size(asked) == 0) & (F.size(there) > 0), -surplus).otherwise(0.0)
    return F.when(family.isin(*fixed.FAMILY_PROFILES), points).otherwise(0.0)


def _by_family(family: Column, points: dict[str, float]) -> Column:
    """The points of the family; 0 for one that has none."""
    some = {name: value for name, value in points.items() if value}
    if not some:
        return F.lit(0.0)
    return _points(*((family == name, value) for name, value in some.items()))


def exact_pipe(pair: dict[str, Column]) -> Column:
    """Pipes of one outer diameter and wall, no conflict, a common standard if the line names one, texts that overlap, no zinc that wasn't asked for."""
    pipes = F.array_contains(pair["o_tags"], "family:pipe") & F.array_contains(pair["s_tags"], "family:pipe")
    spec = tag_values(pair["o_tags"], "spec")
    standard = (F.size(spec) == 0) | F.arrays_overlap(spec, tag_values(pair["s_tags"], "spec"))
    zinc = lambda tokens: F.exists(tokens, lambda t: t.startswith("ocink"))
    sized = F.array_contains(pair["matched"], "od") & F.array_contains(pair["matched"], "wall") & (pair["penalty"] == 0)
    # fixed values: the shares
    return pipes & sized & standard & ((pair["overlap"] >= 0.5) | (pair["root_overlap"] >= 0.6)) & ~(zinc(pair["s_tokens"]) & ~zinc(pair["o_tokens"]))

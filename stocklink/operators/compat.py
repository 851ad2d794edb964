"""Compatibility of an order line with a stock item, as boolean columns over tag arrays and dimension maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import measure_value
from ..functions.tokens import numbers_of, tag_values

PRIMARY, NON_BLOCKING = fixed.PRIMARY_FAMILIES, fixed.NON_BLOCKING_FAMILIES


def _value(dimensions: Column, key: str) -> Column:
    return F.coalesce(F.try_element_at(dimensions, F.lit(key)), F.array().cast("array<string>"))


def _within(part: Column, whole: Column) -> Column:
    return F.size(F.array_except(part, whole)) == 0


def families(order_tags: Column, stock_tags: Column, primary: tuple[str, ...] = PRIMARY, free: tuple[str, ...] = NON_BLOCKING) -> Column:
    """The line's primary families are among the item's, and so are its modifiers that block."""
    asked, there = tag_values(order_tags, "family"), tag_values(stock_tags, "family")
    main = lambda x: F.filter(x, lambda f: f.isin(*primary))
    blocking = F.filter(asked, lambda f: ~f.isin(*primary, *free))
    with_main = _within(main(asked), main(there)) & _within(blocking, there)
    return (F.size(asked) == 0) | ((F.size(there) > 0) & F.when(F.size(main(asked)) > 0, with_main).otherwise(_within(F.filter(asked, lambda f: ~f.isin(*free)), there)))


def materials(order_tags: Column, stock_tags: Column) -> Column:
    """Material classes meet and agree about foam insulation; grades meet, or the item has none where none is needed."""
    asked, there = tag_values(order_tags, "mclass"), tag_values(stock_tags, "mclass")
    grades, known = tag_values(order_tags, "grade"), tag_values(stock_tags, "grade")
    has = F.array_contains
    ungraded = (has(asked, "stainless") & has(there, "stainless")) | (has(there, "steel") & (F.size(grades) == 1) & has(grades, "cs20"))
    graded = F.when(F.size(grades) == 0, True).when(F.size(known) == 0, ungraded).otherwise(F.arrays_overlap(grades, known))
    return (F.size(asked) == 0) | ((F.size(there) > 0) & (has(asked, "ppu") == has(there, "ppu")) & F.arrays_overlap(asked, there) & graded)


def required_dimensions(order_tags: Column, stock_tags: Column, order_dims: Column, stock_dims: Column) -> Column:
    """Triple and pair diameters must meet, with the relief of tees and transitions that share one diameter."""
    asked_families, families_there = tag_values(order_tags, "family"), tag_values(stock_tags, "family")
    union = lambda d: F.array_union(_value(d, "dn"), _value(d, "od"))
    share = F.arrays_overlap(union(order_dims), union(stock_dims))
    single, paired = F.size(union(stock_dims)) == 1, F.size(_value(stock_dims, "pairdn")) > 0
    meets = lambda key: (F.size(_value(order_dims, key)) == 0) | F.arrays_overlap(_value(order_dims, key), _value(stock_dims, key))
    tee = F.array_contains(families_there, "tee") & share & (single | (F.array_contains(asked_families, "tee") & paired))
    transition = F.array_contains(asked_families, "perehod") & F.array_contains(families_there, "perehod") & share & (single | paired)
    return (meets("tripledn") | tee) & (meets("pairdn") | transition)


def smaller_diameter(order_dims: Column, stock_dims: Column) -> Column:
    """The item's largest diameter, nominal or outer, is below the line's; pressures that were read as diameters don't count."""

    def largest(dims: Column, key: str) -> Column:
        values = _value(dims, key)
        if key == "dn":
            pressures = F.transform(_value(dims, "pn"), measure_value)
            values = F.concat(F.filter(values, lambda v: ~F.array_contains(pressures, measure_value(v))), _value(dims, "pairdn"), _value(dims, "tripledn"))
        return F.array_max(numbers_of(values))

    below = lambda key: F.coalesce(largest(stock_dims, key) + 1e-9 < largest(order_dims, key), F.lit(False))
    return below("dn") | below("od")


def subtypes(order_tags: Column, stock_tags: Column, tracked: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Tracked subtypes of a common family are equal, and elbows agree about being transitions."""
    tracked = tracked or fixed.TRACKED_SUBTYPES
    asked, there = tag_values(order_tags, "family"), tag_values(stock_tags, "family")
    both = lambda f: F.array_contains(asked, f) & F.array_contains(there, f)
    fine = F.lit(True)
    for family, values in tracked.items():
        own = lambda tags: F.array_sort(F.filter(tag_values(tags, "subtype"), lambda s: s.isin(*values)))  # noqa: B023, E731
        fine = fine & (~both(family) | (own(order_tags) == own(stock_tags)))
    moving = lambda f, tags: F.array_contains(f, "perehod") | F.array_contains(f, "mufta") | (F.size(tag_values(tags, "inch")) > 0) | (F.size(tag_values(tags, "conn_gender")) > 0)
    return fine & (~both("elbow") | (moving(asked, order_tags) == moving(there, stock_tags)))


def compatible(order_tags: Column, stock_tags: Column, order_dims: Column, stock_dims: Column) -> Column:
    return families(order_tags, stock_tags) & materials(order_tags, stock_tags) & required_dimensions(order_tags, stock_tags, order_dims, stock_dims) & ~smaller_diameter(order_dims, stock_dims) & subtypes(order_tags, stock_tags)


def analog_filter(score: Column, overlap: Column, root_overlap: Column, bonus: Column, penalty: Column, code_hit: Column, approved: Column, learned: Column, allowed: Column) -> Column:
    """Candidates worth showing as analogs."""
    evidence = (overlap >= 0.25) | (root_overlap >= 0.35) | (bonus >= 10.0) | code_hit | approved | learned
    return ((score >= 50.0) | approved | learned) & ((penalty <= 0) | approved | allowed) & evidence

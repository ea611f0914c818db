"""Ordered-collection operators on one array (or map) column, as built-in higher-order functions.

Places are zero-based. Predicates are two-valued: a null answer counts as false. Strict forms (first, last, max, min,
reduce) raise on an empty array; their *_or_null forms give null. A null array gives null unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

One = Callable[[Column], Column]
Two = Callable[[Column, Column], Column]


def _yes(p: One) -> One:
    return lambda x: F.coalesce(p(x), F.lit(False))


def _strict(xs: Column, value: Column, name: str) -> Column:
    return F.when(F.size(xs) == 0, F.raise_error(F.lit(f"{name} of an empty collection"))).otherwise(value)


def _empty_like(xs: Column) -> Column:
    return F.slice(xs, 1, 0)


# --- per element -----------------------------------------------------------------------------------------------------
def map_(xs: Column, f: One) -> Column:
    return F.transform(xs, f)


def map_indexed(xs: Column, f: Two) -> Column:
    """f(i, x)."""
    return F.transform(xs, lambda x, i: f(i, x))


def filter_(xs: Column, p: One) -> Column:
    return F.filter(xs, _yes(p))


def filter_not(xs: Column, p: One) -> Column:
    return F.filter(xs, lambda x: ~_yes(p)(x))


def filter_not_null(xs: Column) -> Column:
    return F.array_compact(xs)


def flat_map(xs: Column, f: One) -> Column:
    return F.flatten(F.transform(xs, f))


def flatten(xs: Column) -> Column:
    return F.flatten(xs)


def with_index(xs: Column) -> Column:
    return F.transform(xs, lambda x, i: F.struct(i.alias("index"), x.alias("value")))


def reversed_(xs: Column) -> Column:
    return F.reverse(xs)


# --- tests and counts ------------------------------------------------------------------------------------------------
def any_(xs: Column, p: One) -> Column:
    return F.exists(xs, _yes(p))


def all_(xs: Column, p: One) -> Column:
    return F.forall(xs, _yes(p))


def none(xs: Column, p: One) -> Column:
    return ~F.exists(xs, _yes(p))


def count(xs: Column, p: One | None = None) -> Column:
    return F.size(xs if p is None else filter_(xs, p))


def is_empty(xs: Column) -> Column:
    return F.size(xs) == 0


def is_not_empty(xs: Column) -> Column:
    return F.size(xs) > 0


def contains(xs: Column, x) -> Column:
    return F.exists(xs, lambda y: y.eqNullSafe(F.lit(x)))


def in_range(x: Column, lo, hi) -> Column:
    return x.between(lo, hi)


def in_until(x: Column, lo, hi) -> Column:
    return (x >= lo) & (x < hi)


# --- folds -----------------------------------------------------------------------------------------------------------
def fold(xs: Column, start: Column, f: Two, finish: One | None = None) -> Column:
    """Left fold; start fixes the accumulator's type."""
    return F.reduce(xs, start, f, finish) if finish else F.reduce(xs, start, f)


def reduce_(xs: Column, f: Two) -> Column:
    return _strict(xs, F.reduce(F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), F.try_element_at(xs, F.lit(1)), f), "reduce")


def sum_(xs: Column, kind: str = "long") -> Column:
    """Zero for an empty array; nulls count as zero; integer overflow raises."""
    return F.reduce(xs, F.lit(0).cast(kind), lambda a, x: (a + F.coalesce(x.cast(kind), F.lit(0).cast(kind))).cast(kind))


def sum_of(xs: Column, f: One, kind: str = "long") -> Column:
    return sum_(F.transform(xs, f), kind)


def average(xs: Column) -> Column:
    """As a double; null for an empty array."""
    return F.when(F.size(xs) > 0, sum_(xs, "double") / F.size(xs))


def max_or_null(xs: Column) -> Column:
    return F.array_max(xs)


def min_or_null(xs: Column) -> Column:
    return F.array_min(xs)


def max_(xs: Column) -> Column:
    return _strict(xs, F.array_max(xs), "max")


def min_(xs: Column) -> Column:
    return _strict(xs, F.array_min(xs), "min")


# --- order -----------------------------------------------------------------------------------------------------------
def sorted_(xs: Column) -> Column:
    """Ascending, nulls last."""
    return F.array_sort(xs)


def sorted_descending(xs: Column) -> Column:
    return F.reverse(F.array_sort(xs))


def sorted_by(xs: Column, key: One) -> Column:
    """Stable: equal keys keep their order; null keys first."""
    return F.transform(F.sort_array(F.transform(xs, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))), lambda s: s["x"])


def sorted_by_descending(xs: Column, key: One) -> Column:
    """Stable: equal keys keep their order; null keys last."""
    return F.transform(F.sort_array(F.transform(xs, lambda x, i: F.struct(key(x).alias("k"), (-i).alias("i"), x.alias("x"))), asc=False), lambda s: s["x"])


# --- parts -----------------------------------------------------------------------------------------------------------
def take(xs: Column, n) -> Column:
    return F.slice(xs, 1, F.greatest(F.lit(n), F.lit(0)))


def drop(xs: Column, n) -> Column:
    at = F.greatest(F.lit(n), F.lit(0))
    return F.slice(xs, at + 1, F.greatest(F.size(xs) - at, F.lit(0)))


def sub_list(xs: Column, start, end) -> Column:
    """From start up to, not with, end."""
    return F.slice(xs, F.lit(start) + 1, F.greatest(F.lit(end) - F.lit(start), F.lit(0)))


def first(xs: Column) -> Column:
    return _strict(xs, F.try_element_at(xs, F.lit(1)), "first")


def last(xs: Column) -> Column:
    return _strict(xs, F.try_element_at(xs, F.lit(-1)), "last")


def first_or_null(xs: Column, p: One | None = None) -> Column:
    return F.try_element_at(xs if p is None else filter_(xs, p), F.lit(1))


def last_or_null(xs: Column, p: One | None = None) -> Column:
    return F.try_element_at(xs if p is None else filter_(xs, p), F.lit(-1))


find, find_last = first_or_null, last_or_null


def get_or_null(xs: Column, i) -> Column:
    return F.get(xs, F.lit(i))


def index_of_first(xs: Column, p: One) -> Column:
    """-1 without a match."""
    return (F.array_position(F.transform(xs, _yes(p)), True) - 1).cast("int")


def index_of_last(xs: Column, p: One) -> Column:
    at = F.array_position(F.reverse(F.transform(xs, _yes(p))), True)
    return F.when(at == 0, -1).otherwise(F.size(xs) - at).cast("int")


def index_of(xs: Column, x) -> Column:
    return index_of_first(xs, lambda y: y == F.lit(x))


def distinct(xs: Column) -> Column:
    """First occurrences, in order."""
    return F.array_distinct(xs)


def partition(xs: Column, p: One) -> Column:
    return F.struct(filter_(xs, p).alias("matching"), filter_not(xs, p).alias("rest"))


def chunked(xs: Column, n: int) -> Column:
    """Consecutive blocks of n; the last may be shorter."""
    starts = F.when(F.size(xs) > 0, F.sequence(F.lit(0), F.greatest(F.size(xs) - 1, F.lit(0)), F.lit(n))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.slice(xs, s + 1, n))


def windowed(xs: Column, n: int, step: int = 1) -> Column:
    """Whole windows of n; none if the array is shorter."""
    starts = F.when(F.size(xs) >= n, F.sequence(F.lit(0), F.greatest(F.size(xs) - n, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.slice(xs, s + 1, n))


def zip_(xs: Column, ys: Column, f: Two | None = None) -> Column:
    """To the shorter one's length."""
    n = F.least(F.size(xs), F.size(ys))
    return F.zip_with(F.slice(xs, 1, n), F.slice(ys, 1, n), f or (lambda a, b: F.struct(a.alias("first"), b.alias("second"))))


def unzip(pairs: Column) -> Column:
    return F.struct(F.transform(pairs, lambda p: p["first"]).alias("first"), F.transform(pairs, lambda p: p["second"]).alias("second"))


def join_to_string(xs: Column, separator: str = ", ", prefix: str = "", postfix: str = "", transform: One | None = None, null: str = "null") -> Column:
    texts = F.transform(xs, lambda x: F.coalesce((transform(x) if transform else x).cast("string"), F.lit(null)))
    return F.concat(F.lit(prefix), F.array_join(texts, separator), F.lit(postfix))


# --- changed copies --------------------------------------------------------------------------------------------------
def add(xs: Column, x) -> Column:
    return F.array_append(xs, F.lit(x))


def add_all(xs: Column, ys: Column) -> Column:
    return F.concat(xs, ys)


def insert_at(xs: Column, i, x) -> Column:
    return F.concat(take(xs, i), F.array(F.lit(x)), drop(xs, i))


def remove(xs: Column, x) -> Column:
    """The first equal element only."""
    at = index_of(xs, x)
    return F.when(at < 0, xs).otherwise(remove_at(xs, F.greatest(at, F.lit(0))))


def remove_at(xs: Column, i) -> Column:
    return F.concat(take(xs, i), drop(xs, F.lit(i) + 1))


def pop(xs: Column) -> Column:
    return take(xs, F.size(xs) - 1)


def clear(xs: Column) -> Column:
    return _empty_like(xs)


def repeat_value(x, n) -> Column:
    return F.array_repeat(F.lit(x), n)


def grid(x, rows, cols) -> Column:
    return F.array_repeat(F.array_repeat(F.lit(x), cols), rows)


def array_of(n, f: One) -> Column:
    """f(0) to f(n-1)."""
    return F.transform(until(F.lit(0), F.lit(n)), f)


# --- ranges ----------------------------------------------------------------------------------------------------------

def range_to(lo: Column, hi: Column, step: int = 1) -> Column:
    """lo..hi, both included; empty where hi < lo."""
    return F.when(lo <= hi, F.sequence(lo.cast("long"), F.greatest(lo, hi).cast("long"), F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def until(lo: Column, hi: Column, step: int = 1) -> Column:
    """lo up to, not with, hi."""
    return range_to(lo, hi - 1, step)


def down_to(hi: Column, lo: Column, step: int = 1) -> Column:
    return F.when(hi >= lo, F.sequence(hi.cast("long"), F.least(lo, hi).cast("long"), F.lit(-step).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def indices(xs: Column) -> Column:
    return until(F.lit(0), F.size(xs))


def last_index(xs: Column) -> Column:
    return F.size(xs) - 1


# --- maps ------------------------------------------------------------------------------------------------------------
def group_by(xs: Column, key: One) -> Column:
    """Map from key to the elements with it, both in encounter order. Keys aren't null."""
    keyed = F.filter(xs, lambda x: key(x).isNotNull())
    keys = F.array_distinct(F.transform(keyed, key))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.filter(keyed, lambda x: key(x) == k)))


def associate(xs: Column, key: One, value: One) -> Column:
    """Map of keys to values; of equal keys the last one's value. Keys aren't null."""
    keyed = F.filter(xs, lambda x: key(x).isNotNull())
    keys = F.array_distinct(F.transform(keyed, key))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: value(F.element_at(F.filter(keyed, lambda x: key(x) == k), -1))))


def associate_by(xs: Column, key: One) -> Column:
    return associate(xs, key, lambda x: x)


def associate_with(xs: Column, value: One) -> Column:
    return associate(xs, lambda x: x, value)


def map_values(m: Column, f: Two) -> Column:
    """f(key, value)."""
    return F.transform_values(m, f)


def map_keys(m: Column, f: Two) -> Column:
    """f(key, value) as new keys; where they collide the last entry stays."""
    return associate(F.map_entries(m), lambda e: f(e["key"], e["value"]), lambda e: e["value"])


def keys(m: Column) -> Column:
    return F.map_keys(m)


def values(m: Column) -> Column:
    return F.map_values(m)


def contains_key(m: Column, k) -> Column:
    return F.map_contains_key(m, k)


def get_or_default(m: Column, k, default) -> Column:
    """A key that is there with a null value gives the default, too."""
    return F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(default))


def get_or_put(m: Column, k, default) -> Column:
    """The map with k in it."""
    return F.when(F.map_contains_key(m, k), m).otherwise(F.map_concat(m, F.create_map(F.lit(k), F.lit(default))))


def put(m: Column, k, v) -> Column:
    """The map with k set to v."""
    return F.map_concat(F.map_filter(m, lambda a, _: a != F.lit(k)), F.create_map(F.lit(k), F.lit(v)))


def list_of(*xs) -> Column:
    return F.array(*map(F.lit, xs))


def set_of(*xs) -> Column:
    return F.array_distinct(list_of(*xs))


def map_of(**entries) -> Column:
    return F.create_map(*(F.lit(x) for e in entries.items() for x in e))


def pair(a, b) -> Column:
    return F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"))


def triple(a, b, c) -> Column:
    return F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.lit(c).alias("third"))


def swapped(p: Column) -> Column:
    return F.struct(p["second"].alias("first"), p["first"].alias("second"))


def enum_values(*names: str) -> Column:
    """All entries of an enumeration in order, with their places."""
    return F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("name")) for i, n in enumerate(names)])

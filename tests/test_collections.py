"""Ordered-collection functions on arrays: recorded answers of small fixtures, and the edges."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lattica.functions import collections as C


def one(spark, value, **cols):
    """The value of an expression over one row of literals."""
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).select(value.alias("v")).collect()[0]["v"]


def ints(*xs):
    return F.array(*map(F.lit, xs)).cast("array<bigint>")


NUMS = (3, 1, 4, 1, 5, 9, 2, 6)


def table():
    X = F.col("xs")  # noqa: N806
    return [
        (C.map_(C.filter_(X, lambda x: x % 2 == 0), lambda x: x * x), NUMS, [16, 4, 36]), (C.sum_(C.filter_(X, lambda x: x > 2)), NUMS, 27), (C.count(X, lambda x: x % 2 == 0), NUMS, 3), (C.fold(X, F.lit(100).cast("bigint"), lambda a, x: a + x), NUMS, 131),
        (C.reduce_(X, lambda a, x: a + x), NUMS, 31), (C.max_(X), NUMS, 9), (C.min_(X), NUMS, 1), (C.any_(X, lambda x: x > 8), NUMS, True), (C.all_(X, lambda x: x > 0), NUMS, True), (C.none(X, lambda x: x > 100), NUMS, True),
        (C.map_indexed(X, lambda i, x: x * (i + 1)), (10, 60, 70), [10, 120, 210]), (C.index_of_first(X, lambda x: x == 3), (1, 3, 5, 3, 1), 1), (C.index_of_last(X, lambda x: x == 3), (1, 3, 5, 3, 1), 3), (C.index_of_last(X, lambda x: x == 7), (1, 3), -1), (C.index_of_first(X, lambda x: x == 7), (), -1),
        (C.sorted_(X), (5, 3, 1, 4, 2), [1, 2, 3, 4, 5]), (C.sorted_descending(X), (5, 3, 1, 4, 2), [5, 4, 3, 2, 1]), (C.sorted_by(X, lambda x: x % 2), (5, 4, 3, 2), [4, 2, 5, 3]), (C.sorted_by_descending(X, lambda x: x % 2), (5, 4, 3, 2), [5, 3, 4, 2]),
        (C.take(X, 3), (1, 2), [1, 2]), (C.take(X, 0), (1, 2), []), (C.drop(X, 5), (1, 2), []), (C.drop(X, 1), (1, 2), [2]), (C.sub_list(X, 1, 3), (1, 2, 3, 4), [2, 3]), (C.chunked(X, 2), (1, 2, 3, 4, 5), [[1, 2], [3, 4], [5]]), (C.chunked(X, 2), (), []),
        (C.windowed(X, 2), (1, 2, 3), [[1, 2], [2, 3]]), (C.windowed(X, 4), (1, 2, 3), []), (C.distinct(X), (3, 1, 3, 2, 1), [3, 1, 2]), (C.first_or_null(X), (), None), (C.last_or_null(X, lambda x: x < 3), (1, 2, 3), 2), (C.find(X, lambda x: x > 5), (1, 2), None),
        (C.average(X), (1, 2), 1.5), (C.average(X), (), None), (C.sum_(X), (), 0), (C.max_or_null(X), (), None), (C.all_(X, lambda x: x > 5), (), True), (C.any_(X, lambda x: x > 5), (), False), (C.is_empty(X), (), True), (C.is_not_empty(X), (1,), True),
        (C.contains(X, 4), NUMS, True), (C.remove(X, 1), (2, 1, 3, 1), [2, 3, 1]), (C.remove(X, 9), (2, 1), [2, 1]), (C.remove_at(X, 0), (2, 1), [1]), (C.insert_at(X, 1, F.lit(9).cast("bigint")), (2, 1), [2, 9, 1]), (C.pop(X), (2, 1), [2]), (C.clear(X), (2, 1), []), (C.add_all(X, X), (1, 2), [1, 2, 1, 2]),
        (C.join_to_string(X, "-", "<", ">"), (1, 2), "<1-2>"), (C.group_by(X, lambda x: x % 2), (1, 2, 3), {1: [1, 3], 0: [2]}), (C.associate(X, lambda x: x % 2, lambda x: x * 10), (1, 2, 3), {1: 30, 0: 20}), (C.associate_with(X, lambda x: x + 1), (1, 1, 2), {1: 2, 2: 3}),
        (C.map_keys(C.associate_with(X, lambda x: x), lambda k, v: k % 2), (1, 2, 3), {1: 3, 0: 2}), (C.map_values(C.associate_by(X, lambda x: x), lambda k, v: k + v), (1, 2), {1: 2, 2: 4}), (C.flat_map(X, lambda x: F.array(x, x)), (1, 2), [1, 1, 2, 2]), (C.indices(X), (5, 6), [0, 1]), (C.indices(X), (), []),
        (C.zip_(X, C.drop(X, 1), lambda a, b: a + b), (1, 2, 3), [3, 5]), (C.range_to(F.lit(1), F.lit(0)), (), []), (C.range_to(F.lit(1), F.lit(7), 3), (), [1, 4, 7]), (C.until(F.lit(1), F.lit(4)), (), [1, 2, 3]), (C.down_to(F.lit(3), F.lit(1)), (), [3, 2, 1]), (C.down_to(F.lit(1), F.lit(3)), (), []),
        (C.array_of(F.lit(3), lambda i: i * i), (), [0, 1, 4]), (C.array_of(F.lit(0), lambda i: i), (), []), (C.repeat_value(7, 2), (), [7, 7]), (C.grid(0, 2, 2), (), [[0, 0], [0, 0]]), (C.set_of(1, 2, 1), (), [1, 2]), (C.get_or_null(X, 5), (1,), None), (C.reversed_(X), (1, 2), [2, 1]),
        (C.get_or_put(C.map_of(a=1), "b", 2), (), {"a": 1, "b": 2}), (C.put(C.map_of(a=1), "a", 2), (), {"a": 2}), (C.get_or_default(C.map_of(a=1), "z", 9), (), 9), (C.contains_key(C.map_of(a=1), "a"), (), True), (C.keys(C.map_of(a=1)), (), ["a"]), (C.values(C.map_of(a=1)), (), [1]),
        (C.in_range(F.lit(3), 1, 3), (), True), (C.in_until(F.lit(3), 1, 3), (), False), (C.last_index(X), (1, 2), 1), (C.sum_of(X, lambda x: x * 2), (1, 2), 6), (C.index_of(X, 2), (1, 2), 1), (C.first(X), (4, 5), 4), (C.last(X), (4, 5), 5),
    ]


def test_answers(spark):
    by_input: dict[tuple, list] = {}
    for i, (expression, xs, want) in enumerate(table()):
        by_input.setdefault(xs, []).append((i, expression, want))
    for xs, cases in by_input.items():
        got = spark.range(1).select(ints(*xs).alias("xs")).select(*[e.alias(f"c{i}") for i, e, _ in cases]).collect()[0]
        for i, _, want in cases:
            assert got[f"c{i}"] == want, (i, xs, got[f"c{i}"], want)


@pytest.mark.parametrize("strict", [C.first, C.last, C.max_, C.min_, lambda x: C.reduce_(x, lambda a, b: a + b)])
def test_strict_forms_raise(spark, strict):
    X = F.col("xs")  # noqa: N806
    with pytest.raises(PySparkException):
        one(spark, strict(X), xs=ints())


def test_nulls(spark):
    X = F.col("xs")  # noqa: N806
    xs = F.array(F.lit(1), F.lit(None), F.lit(3)).cast("array<bigint>")
    assert one(spark, C.filter_not_null(X), xs=xs) == [1, 3]
    assert one(spark, C.filter_(X, lambda x: x > 2), xs=xs) == [3]
    assert one(spark, C.filter_not(X, lambda x: x > 2), xs=xs) == [1, None]
    assert one(spark, C.all_(X, lambda x: x > 0), xs=xs) is False
    assert one(spark, C.sum_(X), xs=xs) == 4
    assert one(spark, C.join_to_string(X), xs=xs) == "1, null, 3"
    assert one(spark, C.contains(X, None), xs=xs) is True
    assert one(spark, C.group_by(X, lambda x: x % 2), xs=xs) == {1: [1, 3]}
    assert one(spark, C.map_(X, lambda x: x), xs=F.lit(None).cast("array<bigint>")) is None


def test_tuples(spark):
    X = F.col("xs")  # noqa: N806
    p = one(spark, C.swapped(C.pair(1, "a")))
    assert (p["first"], p["second"]) == ("a", 1) and one(spark, C.triple(1, 2, 3)["third"]) == 3
    parts = one(spark, C.partition(X, lambda x: x > 1), xs=ints(1, 2))
    assert (parts["matching"], parts["rest"]) == ([2], [1])
    both = one(spark, C.unzip(C.zip_(X, X)), xs=ints(1, 2))
    assert (both["first"], both["second"]) == ([1, 2], [1, 2])
    assert [tuple(r) for r in one(spark, C.with_index(X), xs=ints(7, 8))] == [(0, 7), (1, 8)]

"""Ordered-collection operators on a table whose order is an explicit column (the ordinal).

Nothing here relies on the order that rows arrive in, and none but with_ordinal() needs a global order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lattica.tables import materialize


def _true(p: Column) -> Column:
    return F.coalesce(p, F.lit(False))


def with_ordinal(df: DataFrame, order_by: Sequence[str | Column], name: str = "i") -> DataFrame:
    """Zero-based places in a total order, without a one-task window.

    Rows are range-partitioned and sorted, written once, and each partition's rows are numbered from the sum of the counts before
    it: the driver sees one count per partition. Ties in order_by are numbered in any order.
    """
    spot = F.monotonically_increasing_id()
    kept = materialize(df.orderBy(*order_by).withColumn("__spot", spot), "ordinal")
    part = F.shiftright("__spot", 33)
    counts = sorted(kept.groupBy(part.alias("p")).count().collect())
    rows, before = [], 0
    for p, n in counts:
        rows.append((p, before - (p << 33)))
        before += n
    shifts = df.sparkSession.createDataFrame(rows, "__part long, __shift long")
    return kept.withColumn("__part", part).join(F.broadcast(shifts), "__part").withColumn(name, F.col("__spot") + F.col("__shift")).drop("__spot", "__part", "__shift")


def filter_not(df: DataFrame, p: Column) -> DataFrame:
    """Rows where p isn't true; a null answer counts as false."""
    return df.where(~_true(p))


def filter_not_null(df: DataFrame, *cols: str) -> DataFrame:
    return df.dropna(subset=list(cols) or None)


def any_all_none(df: DataFrame, keys: Sequence[str], p: Column) -> DataFrame:
    """any, all, none and the number of rows with p, per group; of an empty table without keys: false, true, true, 0."""
    yes = _true(p)
    out = df.groupBy(*keys).agg(F.coalesce(F.bool_or(yes), F.lit(False)).alias("any_true"), F.coalesce(F.bool_and(yes), F.lit(True)).alias("all_true"), F.count_if(yes).alias("n_true"))
    return out.withColumn("none_true", ~F.col("any_true"))


def sum_of(df: DataFrame, value: Column, name: str = "total") -> DataFrame:
    """Zero for an empty table."""
    return df.agg(F.coalesce(F.sum(value), F.lit(0)).alias(name))


def extremes(df: DataFrame, col: str, strict: bool = False) -> DataFrame:
    """least and largest; strict raises on an empty table, else both are null."""
    out = df.agg(F.min(col).alias("least"), F.max(col).alias("largest"), F.count("*").alias("__n"))
    if strict:
        fail = F.raise_error(F.lit("extremes of an empty collection"))
        out = out.select(*(F.when(F.col("__n") == 0, fail).otherwise(F.col(c)).alias(c) for c in ("least", "largest")))
    return out.drop("__n")


def fold_ordered(df: DataFrame, keys: Sequence[str], ordinal: str, value: str, start: Column, f: Callable[[Column, Column], Column], name: str = "folded") -> DataFrame:
    """A left fold of each group in order, for functions that aren't associative; groups have to fit a task."""
    return group_collect(df, keys, value, ordinal, "__xs").select(*keys, F.reduce("__xs", start, f).alias(name))


def sorted_with_rank(df: DataFrame, key: Column, ordinal: str, descending: bool = False, name: str = "rank") -> DataFrame:
    """Zero-based places after a stable sort by key."""
    return with_ordinal(df, [key.desc() if descending else key.asc(), F.col(ordinal).asc()], name)


def take(df: DataFrame, ordinal: str, n: int) -> DataFrame:
    return df.orderBy(ordinal).limit(n)


def drop(df: DataFrame, ordinal: str, n: int) -> DataFrame:
    """All but the first n: those after the n-th smallest ordinal, found without a global sort of the table."""
    last = df.select(ordinal).orderBy(ordinal).limit(n).agg(F.max(ordinal).alias("__last"), F.count("*").alias("__n"))
    if n <= 0:
        return df
    return df.join(F.broadcast(last), (F.col("__n") == n) & (F.col(ordinal) > F.col("__last"))).drop("__last", "__n")


def first_last(df: DataFrame, keys: Sequence[str], value: str, ordinal: str, p: Column | None = None) -> DataFrame:
    """first_value and last_value by ordinal per group, of the rows with p; null where there is none."""
    at = F.col(ordinal) if p is None else F.when(_true(p), F.col(ordinal))
    return df.groupBy(*keys).agg(F.min_by(value, at).alias("first_value"), F.max_by(value, at).alias("last_value"))


def index_of(df: DataFrame, keys: Sequence[str], ordinal: str, p: Column) -> DataFrame:
    """Ordinals of the first and last row with p per group, -1 without one."""
    at = F.when(_true(p), F.col(ordinal))
    return df.groupBy(*keys).agg(F.coalesce(F.min(at), F.lit(-1)).alias("first_index"), F.coalesce(F.max(at), F.lit(-1)).alias("last_index"))


def distinct_first(df: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """Of rows with equal keys that with the smallest ordinal; aggregated before the shuffle."""
    cols = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.col(ordinal)).alias("__row")).select(*keys, "__row.*").select(*df.columns)


def group_collect(df: DataFrame, keys: Sequence[str], value: str, ordinal: str, name: str = "values") -> DataFrame:
    """Each group's values in order."""
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("i"), F.col(value).alias("x")))), lambda s: s["x"]).alias(name))


def associate(df: DataFrame, key: Column, value: Column, ordinal: str) -> DataFrame:
    """key, value: the last value by ordinal of each key."""
    return df.groupBy(key.alias("key")).agg(F.max_by(value, F.col(ordinal)).alias("value"))


def partition(df: DataFrame, p: Column) -> tuple[DataFrame, DataFrame]:
    return df.where(p), filter_not(df, p)


def partition_flag(df: DataFrame, p: Column, name: str = "matches") -> DataFrame:
    return df.withColumn(name, _true(p))


def chunked(df: DataFrame, ordinal: str, n: int, name: str = "block") -> DataFrame:
    """Blocks of n by ordinal."""
    return df.withColumn(name, F.floor(F.col(ordinal) / n))


def zip_positional(left: DataFrame, right: DataFrame, ordinal: str = "i") -> DataFrame:
    """Rows with equal ordinals side by side, to the shorter one's length."""
    return left.join(right, ordinal)


def join_to_string(df: DataFrame, keys: Sequence[str], value: Column, ordinal: str, separator: str = ", ", name: str = "joined") -> DataFrame:
    texts = F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("i"), F.coalesce(value.cast("string"), F.lit("null")).alias("t"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(texts, lambda s: s["t"]), separator).alias(name))


def ngrams(df: DataFrame, keys: Sequence[str], ordinal: str, value: str, n: int) -> DataFrame:
    """Sliding windows of n consecutive values per group, as an array; whole ones only."""
    w = Window.partitionBy(*keys).orderBy(ordinal)
    cols = [F.col(value) if k == 0 else F.lead(value, k).over(w) for k in range(n)]
    return df.select(*keys, ordinal, F.array(*cols).alias("gram"), (F.lead(F.lit(1), n - 1).over(w) if n > 1 else F.lit(1)).alias("__whole")).where("__whole = 1").drop("__whole")


def remove_at(df: DataFrame, ordinal: str, k: int) -> DataFrame:
    """Without row k; later ordinals move up."""
    return df.where(F.col(ordinal) != k).withColumn(ordinal, F.col(ordinal) - (F.col(ordinal) > k).cast("int"))


def reversed_(df: DataFrame, ordinal: str) -> DataFrame:
    return df.orderBy(F.col(ordinal).desc())


def statistics(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """n, mean, median, population variance, range, and the smallest of the most frequent values."""
    freq = df.where(F.col(col).isNotNull()).groupBy(*keys, col).count()
    # the median from counts by value: a running sum over distinct values, sorted outside memory
    up = Window.partitionBy(*keys).orderBy(col)
    ranked = freq.withColumn("__upto", F.sum("count").over(up)).withColumn("__n", F.sum("count").over(Window.partitionBy(*keys)))
    place = lambda side: F.min(F.when(F.col("__upto") > side((F.col("__n") - 1) / 2), F.col(col)))
    middle = ranked.groupBy(*keys).agg(((place(F.floor).cast("double") + place(F.ceil).cast("double")) / 2).alias("median"), F.max_by(F.col(col), F.struct(F.col("count"), -F.col(col))).alias("mode"))
    out = df.groupBy(*keys).agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.var_pop(col).alias("variance"), (F.max(col) - F.min(col)).alias("spread"))
    return out.join(middle, list(keys)) if keys else out.join(F.broadcast(middle))


def equal_width_histogram(df: DataFrame, col: str, buckets: int) -> DataFrame:
    """bucket, n: equal widths between the least and the largest value; the last bucket takes the largest."""
    ends = df.agg(F.min(col).alias("__lo"), F.max(col).alias("__hi"))
    at = F.least(F.floor((F.col(col) - F.col("__lo")) * buckets / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0))), F.lit(buckets - 1))
    return df.join(F.broadcast(ends)).groupBy(F.coalesce(at, F.lit(0)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Unions of overlapping or touching intervals per group."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = df.withColumn("__new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0))
    return fresh.withColumn("__no", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "__no").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__no")


def window_max_sum(df: DataFrame, keys: Sequence[str], ordinal: str, value: str, width: int) -> DataFrame:
    """The largest sum of `width` consecutive values per group; 0 where a group is shorter."""
    w = Window.partitionBy(*keys).orderBy(ordinal).rowsBetween(1 - width, 0)
    rows = df.withColumn("__s", F.sum(value).over(w)).withColumn("__n", F.count("*").over(w))
    return rows.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("__n") == width, F.col("__s"))), F.lit(0)).alias("largest_sum"))

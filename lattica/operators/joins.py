"""Lookups and membership as joins; sizes decide what is broadcast, Catalyst does so by its own statistics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lattica.tables import ready


def lookup_default(left: DataFrame, right: DataFrame, key: str, value: str, default) -> DataFrame:
    """left with right's value, default where there is none or it is null. right has a row per key."""
    return left.join(right.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def members(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right, list(keys), "left_semi")


def orphans(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right, list(keys), "left_anti")


def relational_division(pairs: DataFrame, left: str, right: str, wanted: DataFrame) -> DataFrame:
    """Values of left that go with all (at least one) values of wanted's column right."""
    wanted = wanted.select(right).where(F.col(right).isNotNull()).distinct()
    total = wanted.agg(F.count("*").alias("__all"))
    met = pairs.select(left, right).distinct().join(wanted, right, "left_semi").groupBy(left).agg(F.count("*").alias("__n"))
    return met.join(F.broadcast(total), F.col("__n") == F.col("__all")).select(left)


def satisfies(owners: DataFrame, sets: DataFrame, owner: str, group: str, member: str) -> DataFrame:
    """(owner, group) for which the owner has all members of the group; empty groups aren't satisfied.

    owners: owner, member; sets: group, member.
    """
    sets = sets.select(group, member).distinct()
    sizes = sets.groupBy(group).agg(F.count("*").alias("__all"))
    met = owners.select(owner, member).distinct().join(sets, member).groupBy(owner, group).agg(F.count("*").alias("__n"))
    return met.join(sizes, group).where("__n = __all").select(owner, group)


def first_prefix(rows: DataFrame, text: str, table: DataFrame, prefix: str, ordinal: str) -> DataFrame:
    """rows with the fields of the first of table's rows (by ordinal) whose prefix the text starts with; nulls without one.

    Instead of testing every pair, a distinct text's own prefixes of the lengths that the table has are looked up.
    """
    sizes = sorted(r[0] for r in table.select(F.char_length(prefix)).distinct().collect())  # a mapping table's distinct lengths
    own = rows.select(F.col(text).alias("__text")).where("__text is not null").distinct()
    cuts = F.array(*[F.when(F.char_length("__text") >= n, F.substring("__text", 1, n)) for n in sizes]) if sizes else F.array().cast("array<string>")
    hits = own.select("__text", F.explode(F.array_distinct(F.array_compact(cuts))).alias(prefix)).join(table, prefix)
    best = hits.groupBy("__text").agg(F.min_by(F.struct(*table.columns), F.col(ordinal)).alias("__hit"))
    return rows.join(best, F.col(text) == F.col("__text"), "left").select(*rows.columns, *[F.col("__hit")[c].alias(c) for c in table.columns])


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, value: str) -> DataFrame:
    """left with right's latest value at or before its time, by one sort of both together. No row of left is lost."""
    both = left.withColumn("__own", F.lit(1)).withColumn("__v", F.lit(None).cast(dict(right.dtypes)[value])).unionByName(
        right.select(*keys, at, F.col(value).alias("__v")).withColumn("__own", F.lit(0)), allowMissingColumns=True
    )
    w = Window.partitionBy(*keys).orderBy(at, "__own").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("__v", ignorenulls=True).over(w)).where("__own = 1").drop("__own", "__v")


def range_join(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, width: float) -> DataFrame:
    """Points inside spans (start <= at < end): both are dealt into cells of `width`, so pairs meet by equality."""
    cells = spans.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return points.withColumn("__cell", F.floor(F.col(at) / width)).join(cells, "__cell").where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__cell")


def theta(left: DataFrame, right: DataFrame, condition: Column, most: int = 10_000) -> DataFrame:
    """Pairs that meet a condition without an equality: right is counted, broadcast if it has at most `most` rows, and refused beyond.

    Where a condition bounds a distance, range_join() deals both sides into cells and has no such limit.
    """
    if right.limit(most + 1).count() > most:
        raise ValueError(f"a theta join's right side has more than {most} rows")
    return left.join(F.broadcast(right), condition)


#: Needles that one automaton takes.
MOST_NEEDLES = 100_000


def containment(docs: DataFrame, needles: DataFrame, text: str, needle_id: str, needle: str) -> DataFrame:
    """docs whose text holds a needle (letter case aside), with the least id of those.

    Needles are few and known beforehand (a benchmark): they are counted first, more than MOST_NEEDLES are an error, and then
    broadcast; each task builds one automaton and reads its documents once, so that none is paired with needles.
    """
    spark = docs.sparkSession
    ready(spark)
    own = needles.where(F.length(F.trim(needle)) > 0).groupBy(F.lower(needle).alias("t")).agg(F.min(needle_id).alias("i"))
    n = own.limit(MOST_NEEDLES + 1).count()
    if n > MOST_NEEDLES:
        raise ValueError(f"more than {MOST_NEEDLES} needles for one pass; split them")
    shared = spark.sparkContext.broadcast([(r["t"], r["i"]) for r in own.limit(MOST_NEEDLES).collect()])

    @F.pandas_udf("long")
    def least(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for t, i in shared.value:
            automaton.add_word(t, min(i, automaton.get(t, i)))
        if shared.value:
            automaton.make_automaton()
        find = lambda t: min((i for _, i in automaton.iter(t)), default=None) if shared.value and t else None
        for texts in parts:
            yield pd.Series([find(t) for t in texts], dtype="Int64")

    return docs.withColumn("least_item", least(F.lower(text))).where("least_item is not null")


def hash_split(df: DataFrame, identity: Column, share: float, name: str = "held_out") -> DataFrame:
    """A flag that rows with equal identity share, so that variants of a held-out row are held out with it."""
    return df.withColumn(name, F.conv(F.substring(F.md5(identity.cast("binary")), 1, 8), 16, 10).cast("long") % 10_000 < int(share * 10_000))

"""Associative translation: a memory of anonymised pairs asked by exact text, then by similarity of hypervectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lattica.tables import materialize

from .corpus import placeholders, shape
from .vectors import DIMENSIONS, hypervectors, top_k

#: Answers less similar than this are no answers, whatever the controller's threshold.
LEAST = 0.45
#: What a hit in the context's coordinates counts, against one in plain coordinates.
CONTEXT_WEIGHT = 0.95


def remap(text: Column, old: Column, new: Column) -> Column:
    """text with the k-th of the placeholders in `old` written as the k-th in `new`, all at once; others stay."""
    marked = F.regexp_replace(text, r"\b((?:ID|NUM|STR|CHR)\d+)\b", "\u0002$1\u0003")
    done = F.reduce(F.arrays_zip(old.alias("o"), new.alias("n")), marked, lambda a, s: F.replace(a, F.concat(F.lit("\u0002"), s["o"], F.lit("\u0003")), s["n"]))
    return F.translate(done, "\u0002\u0003", "")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def _opens(words: Column) -> Column:
    """Whether a chunk is the head of a block: { at its end and no } in it."""
    return F.coalesce((F.try_element_at(words, F.lit(-1)) == "{") & ~F.array_contains(words, "}"), F.lit(False))


def translate(queries: DataFrame, memory: DataFrame, threshold: float = 0.45, k: int = 8, context: str | None = None, dimensions: int = DIMENSIONS) -> DataFrame:
    """key, answer, confidence for every query; answer null and confidence 0 where the memory has none.

    queries: key long (unique), text, and with `context` a column of signs that hits are looked for in as well (null: none); memory: id long, source, target.
    An equal source whose target has no other placeholders than the text is certain (1.0; of several the smallest id). Else
    the k most similar sources are candidates: their target's placeholders are renamed by position where the shapes are equal, and may
    not go beyond the text's otherwise; both are heads of blocks or neither; neither is over twice as long plus four;
    the similarity reaches the larger of LEAST and half the threshold. The most similar one answers, ties by the smaller id.
    """
    asked = queries.select(F.col("key").cast("long").alias("key"), F.trim("text").alias("text"), *([F.col(context).alias("context")] if context else []))
    held = memory.select(F.col("id").cast("long").alias("id"), F.trim("source").alias("source"), F.col("target").alias("target")).where("source <> '' and target <> ''")
    fits = lambda target, text: F.size(F.array_except(placeholders(target), placeholders(text))) == 0
    equal = asked.join(held, F.col("text") == F.col("source")).where(fits(F.col("target"), F.col("text")))
    certain = equal.groupBy("key").agg(F.min_by("target", "id").alias("answer")).withColumn("confidence", F.lit(1.0))
    rest = asked.where("text <> ''").join(certain, "key", "left_anti").withColumn("words", _words(F.col("text")))
    rest = materialize(hypervectors(rest, "words", dimensions=dimensions), "asked")
    known = materialize(hypervectors(held.withColumn("words", _words(F.col("source"))), "words", dimensions=dimensions), "known")
    hits = top_k(rest.withColumnRenamed("key", "id"), known, "id", "hv", k)
    if context:
        bound = rest.where("context is not null").select(F.col("key").alias("id"), F.zip_with("hv", "context", lambda a, b: a * b).alias("hv"))
        hits = hits.unionByName(top_k(bound, known, "id", "hv", k).withColumn("score", F.col("score") * CONTEXT_WEIGHT))
    both = hits.where(F.col("score") >= max(LEAST, threshold / 2)).join(rest.select(F.col("key").alias("query_id"), "text", "words"), "query_id")
    both = both.join(known.select("id", "source", "target", F.col("words").alias("own")), "id")
    same = shape(F.col("text")) == shape(F.col("source"))
    named = remap(F.col("target"), F.array_distinct(placeholders(F.col("source"))), F.array_distinct(placeholders(F.col("text"))))
    n, m = F.size("words"), F.size("own")
    both = both.withColumn("answer", F.when(same, named).when(fits(F.col("target"), F.col("text")), F.col("target")))
    both = both.where(F.col("answer").isNotNull() & (_opens(F.col("words")) == _opens(F.col("own"))) & (m <= 2 * n + 4) & (m * 2 + 4 >= n))
    first = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    likely = both.withColumn("nth", F.row_number().over(first)).where("nth = 1").select(F.col("query_id").alias("key"), "answer", F.col("score").alias("confidence"))
    found = certain.unionByName(likely)
    return asked.select("key").join(found, "key", "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))

"""Connected components by alternating large and small stars, as DataFrame joins; no links or labels reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lattica.tables import discard

from .common import materialize

#: A node with at least this part of all links' ends is a hub; there are at most so many hubs, and they are broadcast.
HUBS = 1000


def _least(edges: DataFrame, n: int, spare: list[DataFrame]) -> DataFrame:
    """(u, m, hub) with the smallest v of each u; a hub has at least n / HUBS rows, n being how many edges has at most."""
    out = materialize(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", "m", (F.col("n") * HUBS >= n).alias("hub")), "least")
    spare.append(out)
    return out


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges with m; links of a hub stay where they are, the others meet their least by key, none of which is hot."""
    found = edges.join(F.broadcast(least.where("hub").select("u", F.col("m").alias("hub_m"))), "u", "left")
    others = found.where("hub_m is null").select("u", "v").join(least.where("not hub").select("u", "m"), "u")
    return found.where("hub_m is not null").select("u", "v", F.col("hub_m").alias("m")).unionByName(others.select("u", "v", "m"))


def _large_star(edges: DataFrame, n: int, spare: list[DataFrame]) -> DataFrame:
    """Each node hands its smallest neighbour to its larger ones."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    own = _with_least(both, _least(both, 2 * n, spare)).where("v > u")
    return own.select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(edges: DataFrame, n: int, spare: list[DataFrame]) -> DataFrame:
    """Each node hands its smallest neighbour to its smaller ones and to itself; edges point from u down to v."""
    least = _least(edges, n, spare)
    return _with_least(edges, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (u long, v long) to (node, root): for every node with an edge but the roots, the smallest node it reaches.

    Loops and repeated edges are allowed; an empty table gives an empty one. Each round is at least as good as squaring
    the distances to the roots, so most_rounds only stops what can't end.
    """
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = mark(now)
    for _ in range(most_rounds):
        if seen[0] == 0:
            break
        spare = [now]
        large = materialize(_large_star(now, seen[0], spare).where("u <> v").distinct(), "stars")
        now = materialize(_small_star(large, large.count(), spare).where("u <> v").distinct(), "edges")
        new = mark(now)
        discard(large, *spare)
        if new == seen:
            break
        seen = new
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))

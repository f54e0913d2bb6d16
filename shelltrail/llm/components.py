"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelltrail.llm.common import staged


def _lowest(pairs: DataFrame) -> DataFrame:
    """Smallest of each x and its neighbours y, as (x, m)."""
    return pairs.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))


def _turn(links: DataFrame, name: str) -> DataFrame:
    """One large and one small star: (x, y) with y < x in, the same out."""
    both = links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
    # every larger neighbour is linked to the smallest of the neighbourhood
    large = both.join(_lowest(both), "x").where(F.col("y") > F.col("x"))
    large = large.select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
    # every smaller neighbour, and the vertex itself, too
    small = large.join(_lowest(large), "x")
    small = small.select("x", F.col("m").alias("y")).unionByName(
        small.select(F.col("y").alias("x"), F.col("m").alias("y"))
    )
    return staged(small.where(F.col("x") != F.col("y")).distinct(), name)


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.expr("sum(cast(xxhash64(x, y) as decimal(38, 0)))")).first()
    return tuple(row)


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) of every id that is linked; the component is its smallest id.

    ``links`` has columns a and b. Each turn links everything near to the smallest id
    around it, so the number of turns grows with the logarithm of the longest path. The
    links of a turn are never more than before. No links give an empty table.
    """
    links = staged(
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y"))
        .distinct(),
        name,
    )
    before = _state(links)
    while before[0]:
        links = _turn(links, name)
        now = _state(links)
        if now == before:
            break
        before = now
    roots = links.select(F.col("y").alias("id")).distinct()
    return links.select(F.col("x").alias("id"), F.col("y").alias("component")).unionByName(
        roots.select("id", F.col("id").alias("component"))
    )

"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import cut, new_folder, remove


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One step: each vertex hands its smallest neighbour to its larger (or smaller) ones.

    The smallest neighbour is an aggregate, combined before the shuffle, and comes
    back by a join, which skew handling can split; no list of neighbours is built.
    """
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sided = both if large else pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = cut(
        sided.groupBy("a").agg(F.min("b").alias("_m")).withColumn("_m", F.least("_m", "a")),
        "component-lows",
    )
    met = sided.join(low, "a")
    if large:
        out = met.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("_m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("_m").alias("b")).unionByName(
            low.select("a", F.col("_m").alias("b"))
        )
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, root) of every vertex that has a link; root is the smallest of its component.

    ``links`` holds bigint pairs in any direction; NULLs and self links are ignored.
    Large-star and small-star steps alternate until the links no longer change, which
    takes a number of rounds that grows with the logarithm of the vertices. Each
    round is a table in the shared folder.
    """
    spark = links.sparkSession
    pairs = links.select(
        F.greatest(a, b).cast("bigint").alias("a"), F.least(a, b).cast("bigint").alias("b")
    ).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") != F.col("b")))
    old, before = None, None
    while True:
        path = new_folder(spark, "components")
        pairs.write.parquet(path)
        pairs = spark.read.schema("a bigint, b bigint").parquet(path)
        if old:
            remove(spark, [old])
        old = path
        state = tuple(
            pairs.agg(
                F.count("*"),
                F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
            ).first()
        )
        if state[0] == 0 or state == before:
            break
        before = state
        pairs = _star(_star(pairs, True), False)
    roots = pairs.groupBy(F.col("a").alias("vertex")).agg(F.min("b").alias("root"))
    heads = pairs.select(F.col("b").alias("vertex"), F.col("b").alias("root")).distinct()
    return roots.unionByName(heads)

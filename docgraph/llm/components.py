"""Connected components of an edge table, and blocks of large groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.llm.common import drop, materialize


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b) long pairs -> (node, component): the least node that each node reaches.

    Alternating large-star and small-star rounds (Kiveris and others, 2014): each
    is a grouped minimum and a join on the node, so a node of very many links is
    pre-aggregated and its join can be split. Each round is written to the shared
    folder, and the one before deleted. Null ends and self links are ignored; a node without links has no row.
    """
    links = edges.where("a IS NOT NULL AND b IS NOT NULL AND a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = materialize(links, "links")
    seen = None
    for _ in range(most_rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        before, links = links, materialize(small, "small-star")
        drop(before, large)
        state = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def in_blocks(members: DataFrame, group: str, member: str, weight: str, most_weight: int) -> DataFrame:
    """``members`` with a column ``task``: of two members of a group, at least one of them without a ``root``, some task has both.

    The members of a group are dealt by a hash into blocks of half of ``most_weight``, those with a root and those without
    apart. Each two blocks without roots are a task, and so is each of them with each block of the others, so
    no task holds much more than ``most_weight``. Where all have roots, nothing is left to compare and no row comes out.
    """
    open_ = F.col("root").isNull()
    parts = members.groupBy(group).agg(*[F.coalesce(F.ceil(F.sum(F.when(test, F.col(weight))) * 2 / most_weight), F.lit(0)).cast("int").alias(name) for test, name in ((open_, "_open"), (~open_, "_settled"))])
    block = F.pmod(F.xxhash64(member, F.lit(11)), F.greatest(F.when(open_, F.col("_open")).otherwise(F.col("_settled")), F.lit(1))).cast("int")
    dealt = members.join(parts.where("_open > 0"), group).withColumn("_own", block)
    numbers = lambda n: F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: k < n)
    among = F.transform(F.filter(numbers(F.col("_open")), lambda k: (k != F.col("_own")) | (F.col("_open") == 1)), lambda k: F.xxhash64(group, F.lit("open"), F.least(k, "_own"), F.greatest(k, "_own")))
    across = F.transform(numbers(F.col("_settled")), lambda k: F.xxhash64(group, F.lit("all"), F.col("_own"), k))
    with_open = F.transform(numbers(F.col("_open")), lambda k: F.xxhash64(group, F.lit("all"), k, F.col("_own")))
    return dealt.withColumn("task", F.explode(F.when(open_, F.concat(among, across)).otherwise(with_open))).drop("_open", "_settled", "_own")

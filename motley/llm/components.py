"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motley.llm.common import partitions, stored

#: Links that a task writes in a round: small tables are few files.
LINKS_A_TASK = 200_000


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    rest = down.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """node, root (the least node of its component) for every node of `links` (a, b: long) but the roots themselves.

    Self-links and repeated links change nothing; no links give no rows. Links stay in tables: each round
    writes what is left of them to the shared folder. Nodes of many links meet one row of their own in the joins, which
    adaptive execution splits or turns into a broadcast. `rounds` is a guard; the rounds needed grow as the
    square of the logarithm of the nodes at most, and a run that would need more fails.
    """
    now, before = stored(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"), None
    for _ in range(rounds):
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        tasks = max(1, min(partitions(now.sparkSession), state[0] // LINKS_A_TASK + 1))
        now = stored(_small_star(_large_star(now).distinct()).distinct().coalesce(tasks), "links")
    raise RuntimeError(f"links did not settle in {rounds} rounds")

"""Queries over trajectories: files of frames, slow coordinates, microstates and how states follow each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motley.functions.columns import rounded
from motley.operators import kinetics as K
from motley.operators import ordered as O
from motley.plans.registry import query
from motley.sources import tables as T
from motley.sources import trajectory as Tr
from motley.sources.tables import table

#: Atoms of a frame made of 64 numbers; the last one is filled up with zeros.
ATOMS = 22


def _as_trajectory(spark: SparkSession, d: str) -> str:
    """The vectors as frames of a trajectory in DCD files, in the order of their ids."""
    rows = table(spark, d, "embeddings").where("embedding is not null")
    filled = F.concat("embedding", F.array_repeat(F.lit(0.0).cast("float"), 3 * ATOMS - 64))
    return Tr.write_trajectory(rows.select(F.col("vec_id").alias("frame"), filled.alias("positions")), T.scratch(spark, "trajectory"))


@query("s1_trajectory", f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS frame, list_concat(embedding, list_value(CAST(0 AS FLOAT), CAST(0 AS FLOAT))) AS e FROM embeddings WHERE embedding IS NOT NULL)
SELECT frame, CAST(a AS INTEGER) AS atom, round(CAST(e[3 * a + 1] AS DOUBLE), 6) + 0 AS x, round(CAST(e[3 * a + 2] AS DOUBLE), 6) + 0 AS y, round(CAST(e[3 * a + 3] AS DOUBLE), 6) + 0 AS z
FROM v, range({ATOMS}) t(a)
""")
def s1(spark: SparkSession, d: str) -> DataFrame:
    """All frames of a trajectory written and read again."""
    atoms = Tr.atom_rows(Tr.read_trajectory(spark, _as_trajectory(spark, d)))
    return atoms.select("frame", "atom", *[rounded(F.col(c).cast("double")).alias(c) for c in "xyz"])


@query("s2_trajectory_slice", "WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS frame, embedding AS e FROM embeddings WHERE embedding IS NOT NULL) SELECT frame, CAST(frame AS DOUBLE) AS time, round(CAST(e[4] AS DOUBLE), 6) + 0 AS x FROM v WHERE frame >= 7 AND frame % 3 = 1")
def s2_slice(spark: SparkSession, d: str) -> DataFrame:
    """The slice 7::3, read without the bytes of the other frames; the second atom's x."""
    frames = Tr.read_trajectory(spark, _as_trajectory(spark, d), "7::3", partition_bytes=1 << 20)
    return frames.select("frame", "time", rounded(F.get("positions", F.lit(3)).cast("double")).alias("x"))


LAG = 2
PAIRS = f"(SELECT count(*) AS n FROM (SELECT lead(vec_id, {LAG}) OVER (PARTITION BY label ORDER BY vec_id) AS after FROM embeddings WHERE embedding IS NOT NULL) WHERE after IS NOT NULL)"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("label", "vec_id", "embedding")


@query("c9_slow_coordinates", f"SELECT CAST(i AS INTEGER) AS component, n, CAST(0 AS DOUBLE) AS mean, CAST(1 AS DOUBLE) AS variance, CAST(0 AS DOUBLE) AS gap FROM range(64) t(i), {PAIRS}")
def c9_slow(spark: SparkSession, d: str) -> DataFrame:
    """All slow coordinates of the vectors of a label: over the pairs of rows that they are made of they have mean 0, variance 1
    and their eigenvalue as covariance, which windows over the projected rows must find."""
    rows = _vectors(spark, d)
    slow = K.tica(K.lagged_moments(rows, ["label"], "vec_id", "embedding", LAG))
    pairs = O.lagged_pairs(K.projected(rows, "embedding", slow).where("slow is not null"), ["label"], "vec_id", "slow", LAG)
    each = pairs.select(F.posexplode(F.zip_with("from", "to", lambda x, y: F.struct(x.alias("x"), y.alias("y")))).alias("component", "z")).select("component", "z.x", "z.y")
    value = F.element_at(F.array(*[F.lit(float(v)) for v in slow.values]), F.col("component") + 1)
    out = each.groupBy("component").agg(F.count(F.lit(1)).alias("n"), (F.avg(F.col("x") + F.col("y")) / 2).alias("m"), (F.avg(F.col("x") * F.col("x") + F.col("y") * F.col("y")) / 2).alias("v"), F.avg(F.col("x") * F.col("y")).alias("c"))
    return out.select("component", "n", rounded(F.col("m")).alias("mean"), rounded(F.col("v")).alias("variance"), rounded(F.col("c") - value).alias("gap"))


@query("c9_vamp")
def c9_vamp(spark: SparkSession, d: str) -> DataFrame:
    """Singular values of all 64 components, and the score."""
    left, _, score = K.vamp(K.lagged_moments(_vectors(spark, d), ["label"], "vec_id", "embedding", LAG))
    return spark.createDataFrame([(i, round(float(v), 6), round(score, 6)) for i, v in enumerate(left.values)], "component int, value double, score double")


@query("c10_microstates")
def c10(spark: SparkSession, d: str) -> DataFrame:
    slow = K.tica(K.lagged_moments(_vectors(spark, d), ["label"], "vec_id", "embedding", LAG)).first(5)
    rows = T.kept(K.projected(_vectors(spark, d), "embedding", slow).select("label", "vec_id", "slow"), "slow")  # read by each pass of k-means
    return K.assigned(rows, "slow", K.centres_of(rows, "slow", [20])[20]).select("label", "vec_id", "micro")


@query("c11_silhouettes")
def c11(spark: SparkSession, d: str) -> DataFrame:
    """How well 2 to 12 clusters fit all vectors."""
    rows = _vectors(spark, d)
    return K.silhouettes(rows, "embedding", K.centres_of(rows, "embedding", [*range(2, 13)])).withColumn("score", rounded(F.col("score")))


STEPS = "WITH e AS (SELECT event_type AS a, lead(event_type, 3) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events), c AS (SELECT a, b, count(*) AS n FROM e WHERE b IS NOT NULL GROUP BY ALL)"


def _transitions(spark: SparkSession, d: str) -> DataFrame:
    return K.reversible(K.transition_counts(table(spark, d, "events"), ["user_id"], "event_id", "event_type", 3))


@query("c12_reversible", f"{STEPS}, u AS (SELECT a, b, sum(n) AS n FROM (SELECT a, b, n FROM c UNION ALL SELECT b, a, 0 FROM c) GROUP BY ALL) SELECT a, b, CAST(n AS BIGINT) AS n, CAST(0 AS DOUBLE) AS flow_gap, CAST(1 AS DOUBLE) AS row_sum, CAST(0 AS DOUBLE) AS optimum_gap FROM u")
def c12_reversible(spark: SparkSession, d: str) -> DataFrame:
    """Pairs and their counts, and what the likeliest reversible matrix must have: equal flows both ways, rows that sum to 1, and at
    the optimum (n_ab + n_ba) / x_ab = c_a / x_a + c_b / x_b."""
    t = _transitions(spark, d)
    other = t.select(F.col("a").alias("_b"), F.col("b").alias("_a"), (F.col("chance") * F.col("p")).alias("back"), F.col("n").alias("n_back"))
    per = t.groupBy("a").agg(F.sum("p").alias("row_sum"), (F.sum("n") / F.max("chance")).alias("q"))
    both = t.join(other, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))).join(per, "a").join(per.select(F.col("a").alias("b"), F.col("q").alias("q_b")), "b")
    flow = F.col("chance") * F.col("p")
    gap = (F.col("n") + F.col("n_back")) / flow / (F.col("q") + F.col("q_b")) - 1
    return both.select("a", "b", "n", rounded(flow - F.col("back"), 9).alias("flow_gap"), rounded(F.col("row_sum")).alias("row_sum"), rounded(gap).alias("optimum_gap"))


@query("c12_memberships")
def c12_memberships(spark: SparkSession, d: str) -> DataFrame:
    """How far each event type belongs to each of two macrostates."""
    states, p, chance = K.matrix_of(_transitions(spark, d))
    found = K.memberships(p, chance, 2)
    return spark.createDataFrame([(s, j, round(float(m), 6)) for s, row in zip(states, found, strict=True) for j, m in enumerate(row)], "micro string, macro int, membership double")


@query("c14_metastable")
def c14_metastable(spark: SparkSession, d: str) -> DataFrame:
    return K.metastable(_vectors(spark, d), ["label"], "vec_id", "embedding", lag=LAG).rows.select("label", "vec_id", "micro", "macro")

"""End-to-end analyses over ensembles, and their queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motley.functions.columns import rounded
from motley.operators import clustering as Cl
from motley.operators import distributions as D
from motley.operators import features as Fe
from motley.operators import fitting as Fi
from motley.operators import models as M
from motley.operators import ordered as O
from motley.operators import sampling as G
from motley.operators.frames import assigned, drop_unassigned
from motley.plans.queries import POOLED, SIDES
from motley.plans.registry import WITH, js_sql, query
from motley.sources.tables import EDGES, SIZES, embedding_angles, kept, lineitem_frames, table
from motley.streaming.incremental import windowed_counts


def compared_samples(frames: DataFrame, samples: DataFrame, sizes: list[int], edges: list[tuple[int, int]], references: list, others: list) -> tuple[DataFrame, DataFrame]:
    """(reference, sample, node, edge, distance) of all pairs of a reference and another sample, and the samples left out with
    why (N2). `samples` has sample_id and frame_id of invalid frames; frames with gaps or marked invalid are not used."""
    used = drop_unassigned(frames).join(samples, ["sample_id", "frame_id"], "left_anti")
    totals = frames.groupBy("sample_id").agg(F.count(F.lit(1)).alias("total"))
    counts = totals.join(used.groupBy("sample_id").agg(F.count(F.lit(1)).alias("used")), "sample_id", "left").fillna(0, "used")
    skipped = counts.where("used = 0").select("sample_id", F.lit("all_frames_invalid").alias("reason"), "total", "used", (F.col("total") - F.col("used")).alias("invalid"))
    p, j = D.marginals(used, sizes), D.joints(used, sizes, edges)
    side = lambda df, ids, name: df.where(F.col("sample_id").isin(ids)).withColumnRenamed("sample_id", name)
    nodes = D.site_divergences(side(p, references, "reference"), side(p, others, "sample"), "reference", "sample")
    pairs = D.edge_divergences(side(j, references, "reference"), side(j, others, "sample"), "reference", "sample")
    return D.combined_distance(nodes, pairs, ["reference", "sample"]), skipped


def lambda_sweep(marginals: DataFrame, joints: DataFrame, lambdas: DataFrame, references: list, node_weight: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(sample_id, lambda, reference, distance) of each swept sample to each reference, and the nearest lambda of each reference
    (N3). `lambdas`: sample_id, lambda. Three references are needed."""
    if len(references) < 3:
        raise ValueError("at least three references are needed")
    swept = lambda df: df.join(F.broadcast(lambdas), "sample_id")  # noqa: E731  a row per sample
    ref = lambda df: df.where(F.col("sample_id").isin(references)).withColumnRenamed("sample_id", "reference")
    node = D.site_divergences(swept(marginals), ref(marginals), "sample_id", "reference").groupBy("sample_id", "reference").agg(F.avg("js").alias("node"))
    edge = D.edge_divergences(swept(joints), ref(joints), "sample_id", "reference").groupBy("sample_id", "reference").agg(F.avg("js").alias("edge"))
    distance = F.lit(node_weight) * F.col("node") + F.lit(1 - node_weight) * F.col("edge")
    out = node.join(edge, ["sample_id", "reference"]).join(F.broadcast(lambdas), "sample_id").select("sample_id", "lambda", "reference", distance.alias("distance"))
    return out, O.arg_min(out, ["reference"], "lambda", "distance")


def plain_label(label: Column) -> Column:
    """A source's label without its kind in front: lower case, without what the kinds of sources begin with."""
    return F.trim(F.regexp_replace(F.trim(F.lower(F.coalesce(label, F.lit("")))), "^(macro:|metastable:|md cluster:)", ""))


def augmented(sources: DataFrame, clusters: DataFrame, base: str) -> DataFrame:
    """source_id, label, labels of all sources of a summary and of the clusters that are added to it.

    `sources`: source_id, label, labels; `clusters`: position, cluster_id, name (null: its id), labels, a row per frame. The `base`
    cluster, clusters that are sources already, and those whose name is a source's or an earlier cluster's are left out; so are
    frames without a label, and clusters that have no others. What decides has a row per source.
    """
    whole = clusters.where((F.col("cluster_id") != base) & assigned(F.col("labels")))
    named = F.coalesce("name", "cluster_id")
    known = whole.groupBy("cluster_id").agg(F.min(F.struct(F.col("position"), named.alias("name"))).alias("_first")).select("cluster_id", F.col("_first.position").alias("position"), F.col("_first.name").alias("name"))
    own_id, own_label = F.concat(F.lit("cluster:"), "cluster_id"), plain_label(F.col("name"))
    ids, labels = sources.select(F.col("source_id").alias("_id")).distinct(), sources.select(plain_label(F.col("label")).alias("_label")).distinct()
    new = known.join(ids, own_id == F.col("_id"), "left_anti").join(labels, own_label == F.col("_label"), "left_anti")
    first = new.groupBy(own_label.alias("_label")).agg(F.min_by(F.struct("cluster_id", "name"), F.struct("position", "cluster_id")).alias("_kept")).select("_kept.*")
    added = whole.select("cluster_id", "labels").join(F.broadcast(first), "cluster_id")  # a row per cluster
    rows = added.select(own_id.alias("source_id"), F.concat(F.lit("MD cluster: "), "name").alias("label"), "labels")
    return sources.select("source_id", "label", "labels").unionByName(rows)


def preferences(frames: DataFrame, a: M.Arrays, b: M.Arrays) -> DataFrame:
    """sample_id, frame_id, e_a_minus_b: which of two models a frame prefers (N4); below 0, A."""
    return frames.select("sample_id", "frame_id", (M.energy(F.col("labels"), a) - M.energy(F.col("labels"), b)).alias("e_a_minus_b"))


def commitment(frames: DataFrame, difference: M.Model) -> DataFrame:
    """sample_id, site, q: the share of frames whose label at the site the difference model (A less B) gives to A."""
    h = difference.h.select("site", F.col("k").alias("label"), F.col("value").alias("dh"))
    counts = frames.select("sample_id", F.posexplode("labels").alias("site", "label")).groupBy("sample_id", "site", "label").agg(F.count(F.lit(1)).alias("n"))
    met = counts.join(F.broadcast(h), ["site", "label"])  # h: a row per label
    return met.groupBy("sample_id", "site").agg((F.sum(F.when(F.col("dh") < 0, F.col("n")).otherwise(0)) / F.sum("n")).alias("q"))


def transition_band(preference: DataFrame, width: float = 0.5) -> DataFrame:
    """sample_id, share of frames within `width` robust deviations of no preference, over that of all frames (N5), as a logarithm."""
    preference = kept(preference.select("sample_id", "e_a_minus_b"), "preference")  # read several times
    one = preference.withColumn("_all", F.lit(0))
    scale = O.deviation(one, ["_all"], "e_a_minus_b").first()
    near = F.abs(F.col("e_a_minus_b") - F.lit(scale["median"])) <= width * F.lit(scale["mad"])
    whole = preference.agg(F.avg(near.cast("double"))).first()[0]
    return preference.groupBy("sample_id").agg(F.ln((F.avg(near.cast("double")) + 1e-9) / (F.lit(whole) + 1e-9)).alias("enrichment"))


def cross_likelihood(frames_a: DataFrame, frames_b: DataFrame, others: DataFrame, sizes: list[int], edges: list[tuple[int, int]], least: int = 10) -> DataFrame:
    """sample_id, auc_share: of the frames of other samples, the share that the model of A explains better than that of B."""
    for f in (frames_a, frames_b):
        if f.limit(least).count() < least:
            raise ValueError(f"at least {least} frames a side are needed")
    a, b = (M.arrays(M.fit_pmi(f, sizes, edges)) for f in (frames_a, frames_b))
    total = lambda m: F.aggregate(M.pseudolikelihood(F.col("labels"), m), F.lit(0.0), lambda s, x: s + x)
    return others.select("sample_id", "frame_id", (total(a) - total(b)).alias("delta"))


def effective_beta(frames: DataFrame, model: M.Arrays, sizes: list[int], edges: list[tuple[int, int]], betas: list[float], draws: int = 200, n_chains: int = 2, seed: int = 0) -> DataFrame:
    """beta, distance: how far Gibbs samples at each beta are from the frames; the least one is the effective beta."""
    spark = frames.sparkSession
    table_ = G.chains(spark, n_chains, seed, betas)
    drawn = G.gibbs(table_, model, draws).join(table_.select("chain_index", "beta"), "chain_index")
    left = frames.withColumn("a", F.lit(0))
    node = D.site_divergences(D.marginals(left, sizes, "a"), D.marginals(drawn, sizes, "beta"), "a", "beta")
    edge = D.edge_divergences(D.joints(left, sizes, edges, "a"), D.joints(drawn, sizes, edges, "beta"), "a", "beta")
    return D.combined_distance(node, edge, ["beta"]).select("beta", "distance")


def completion(starts: DataFrame, model: M.Arrays, penalties: DataFrame, strengths: list[float], sweeps: int, target: DataFrame, sizes: list[int], seed: int = 0) -> DataFrame:
    """strength, distance: mean divergence from the target's marginals after sweeps from the start frames, under growing
    penalties on the fields (N9). `target`: site, label, p."""
    spark, out = starts.sparkSession, None
    for x in strengths:  # a few strengths; each is a job of its own
        pulled = M.arrays(M.penalised(M.tables(spark, model), penalties, x))
        last = G.relaxed(starts, pulled, sweeps, seed=seed).where(F.col("sweep") == sweeps).withColumn("strength", F.lit(float(x)))
        out = last if out is None else out.unionByName(last)
    p = D.marginals(out, sizes, "strength")
    node = D.site_divergences(p, target.withColumn("t", F.lit(0)), "strength", "t")
    return node.groupBy("strength").agg(F.avg("js").alias("distance"))


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, M.Model, M.Model]:
    frames = lineitem_frames(spark, d)
    a, b = (M.fit_pmi(frames.where(F.col("sample_id").isin(v)), SIZES, EDGES) for v in SIDES.values())
    return frames, a, b


@query("n2_compared_samples", WITH + "SELECT sample_id, 'all_frames_invalid' AS reason, count(*) AS total, 0 AS used, count(*) AS invalid FROM wide WHERE sample_id = 1997 GROUP BY ALL")
def n2(spark: SparkSession, d: str) -> DataFrame:
    frames = lineitem_frames(spark, d)
    bad = frames.where("sample_id = 1997").select("sample_id", "frame_id").distinct()
    _, skipped = compared_samples(frames, bad, SIZES, EDGES, [1995], [1996, 1997])
    return skipped.withColumn("used", F.col("used").cast("int"))


@query("n3_lambda_sweep")
def n3(spark: SparkSession, d: str) -> DataFrame:
    frames = lineitem_frames(spark, d)
    lambdas = spark.createDataFrame([(1998, 0.0), (1999, 0.5), (2000, 1.0)], "sample_id long, lambda double")
    return lambda_sweep(D.marginals(frames, SIZES), D.joints(frames, SIZES, EDGES), lambdas, [1995, 1996, 1997])[0].withColumn("distance", rounded(F.col("distance")))


def _model_sql(side: str) -> str:
    return f"""h{side} AS (SELECT site, label AS k, v - avg(v) OVER (PARTITION BY site) AS value FROM (SELECT site, label, -ln(p + 1e-8) AS v FROM pool WHERE side = '{side}')),
    j{side} AS (SELECT r, s, k, l, v - avg(v) OVER (PARTITION BY r, s) AS value FROM (SELECT q.r, q.s, q.k, q.l, -ln(q.p / (x.p * y.p + 1e-8) + 1e-8) AS v FROM pjoint q JOIN pool x ON x.side = '{side}' AND x.site = q.r AND x.label = q.k JOIN pool y ON y.side = '{side}' AND y.site = q.s AND y.label = q.l WHERE q.side = '{side}'))"""


DELTA = WITH + POOLED + ", " + _model_sql("a") + ", " + _model_sql("b") + """,
dh AS (SELECT ha.site, ha.k, ha.value - hb.value AS value FROM ha JOIN hb USING (site, k)), dj AS (SELECT ja.r, ja.s, ja.k, ja.l, ja.value - jb.value AS value FROM ja JOIN jb USING (r, s, k, l)),
de AS (SELECT f.sample_id, f.frame_id, f.e + g.e AS d FROM (SELECT sample_id, frame_id, rid, sum(dh.value) AS e FROM long JOIN dh ON dh.site = long.site AND dh.k = long.label GROUP BY ALL) f
  JOIN (SELECT rid, sum(dj.value) AS e FROM wide CROSS JOIN edge JOIN dj ON dj.r = edge.r AND dj.s = edge.s AND dj.k = labels[edge.r + 1] AND dj.l = labels[edge.s + 1] GROUP BY ALL) g USING (rid))
"""


@query("n4_preferences", DELTA + "SELECT sample_id, frame_id, round(d, 4) + 0 AS e_a_minus_b FROM de")
def n4(spark: SparkSession, d: str) -> DataFrame:
    frames, a, b = _sides(spark, d)
    return preferences(frames, M.arrays(a), M.arrays(b)).withColumn("e_a_minus_b", rounded(F.col("e_a_minus_b"), 4))


@query("e9_difference", DELTA + "SELECT CAST(site AS INTEGER) AS site, k, round(value, 5) + 0 AS value FROM dh")
def e9(spark: SparkSession, d: str) -> DataFrame:
    _, a, b = _sides(spark, d)
    return M.blended(a, b, 1.0, -1.0, shared_only=True).h.withColumn("value", rounded(F.col("value"), 5))


@query("n5_transition_band", DELTA + ", m AS (SELECT median(d) AS med FROM de), s AS (SELECT median(abs(d - med)) AS mad FROM de, m), n AS (SELECT sample_id, CASE WHEN abs(d - med) <= 0.5 * mad THEN 1.0 ELSE 0.0 END AS near FROM de, m, s) SELECT sample_id, round(ln((avg(near) + 1e-9) / ((SELECT avg(near) FROM n) + 1e-9)), 4) + 0 AS enrichment FROM n GROUP BY sample_id")
def n5(spark: SparkSession, d: str) -> DataFrame:
    frames, a, b = _sides(spark, d)
    return transition_band(preferences(frames, M.arrays(a), M.arrays(b))).withColumn("enrichment", rounded(F.col("enrichment"), 4))


@query("n6_commitment", DELTA + "SELECT sample_id, CAST(long.site AS INTEGER) AS site, round(avg(CASE WHEN dh.value < 0 THEN 1.0 ELSE 0.0 END), 6) AS q FROM long JOIN dh ON dh.site = long.site AND dh.k = long.label GROUP BY sample_id, long.site")
def n6(spark: SparkSession, d: str) -> DataFrame:
    frames, a, b = _sides(spark, d)
    return commitment(frames, M.blended(a, b, 1.0, -1.0, shared_only=True)).withColumn("q", rounded(F.col("q")))


@query("m12_cross_likelihood")
def m12(spark: SparkSession, d: str) -> DataFrame:
    frames = lineitem_frames(spark, d)
    a, b = (frames.where(F.col("sample_id").isin(v)) for v in SIDES.values())
    either = frames.where(F.col("sample_id").isin(sum(SIDES.values(), [])))
    delta = cross_likelihood(a, b, either, SIZES, EDGES).withColumn("delta", F.round("delta", 9))  # equal but for the order of sums: a tie
    return O.auc(delta.withColumn("y", F.col("sample_id").isin(SIDES["a"]).cast("int")).withColumn("all", F.lit(0)), ["all"], "delta", "y").select(rounded(F.col("auc"), 4).alias("auc"))


@query("m13_effective_beta")
def m13(spark: SparkSession, d: str) -> DataFrame:
    frames = lineitem_frames(spark, d)
    return effective_beta(frames, M.arrays(M.fit_pmi(frames, SIZES, EDGES)), SIZES, EDGES, [0.5, 1.0, 2.0], draws=100)


@query("e5_fit")
def e5(spark: SparkSession, d: str) -> DataFrame:
    model, _ = Fi.fit(lineitem_frames(spark, d), SIZES, EDGES, Fi.Settings(steps=30))
    return M.tables(spark, model).j.withColumn("value", rounded(F.col("value"), 3))


@query("e8_delta_fit")
def e8(spark: SparkSession, d: str) -> DataFrame:
    frames, a, _ = _sides(spark, d)
    delta, _ = Fi.fit(frames.where(F.col("sample_id").isin(SIDES["b"])), SIZES, EDGES, Fi.Settings(steps=30), base=M.arrays(a))
    return M.tables(spark, delta).h.withColumn("value", rounded(F.col("value"), 3))


def _small_model(spark: SparkSession, d: str) -> M.Arrays:
    return M.arrays(M.fit_pmi(lineitem_frames(spark, d), SIZES, EDGES))


@query("g1_gibbs")
def g1(spark: SparkSession, d: str) -> DataFrame:
    return G.gibbs(G.chains(spark, 4, 7), _small_model(spark, d), 50)


@query("g3_replica_exchange")
def g3(spark: SparkSession, d: str) -> DataFrame:
    return G.acceptance(G.replica_exchange(G.chains(spark, 2, 7), _small_model(spark, d), [0.25, 0.5, 1.0], 40))


@query("g4_annealing")
def g4(spark: SparkSession, d: str) -> DataFrame:
    model = _small_model(spark, d)
    return G.annealed(G.chains(spark, 4, 7), model, 50, penalty=8.0)


def _one_a_frame(frames: DataFrame) -> DataFrame:
    """frame_id, labels: each frame once, the least labels of those that share an id. Labels meet as one number each, which a hash aggregate can keep."""
    code, rest, labels = F.lit(0).cast("long"), F.col("_code"), []
    for i, k in enumerate(SIZES):
        code = code * k + F.col("labels")[i]
    for k in reversed(SIZES):
        labels, rest = [F.pmod(rest, F.lit(k)).cast("int"), *labels], F.floor(rest / k)
    return frames.groupBy("frame_id").agg(F.min(code).alias("_code")).select("frame_id", F.array(*labels).alias("labels"))


@query("n8_relaxation")
def n8(spark: SparkSession, d: str) -> DataFrame:
    return G.relaxation_flips(_one_a_frame(lineitem_frames(spark, d)), _small_model(spark, d), 10)[1]


@query("n9_completion")
def n9(spark: SparkSession, d: str) -> DataFrame:
    frames, a, b = _sides(spark, d)
    starts = frames.where(F.col("sample_id").isin(SIDES["a"])).dropDuplicates(["frame_id"])
    pull = M.blended(b, a, 1.0, -1.0, shared_only=True).h.withColumn("weight", F.lit(1.0))
    target = D.pooled(frames, SIDES, SIZES).where("side = 'b'").drop("side")
    return completion(starts, M.arrays(a), pull, [0.0, 1.0], 5, target, SIZES)


@query("c3_frozen_clusters")
def c3(spark: SparkSession, d: str) -> DataFrame:
    return Cl.labelled_sites(embedding_angles(spark, d), lambda x: Cl.linkage_labels(x, 3))


@query("c1_density_peaks")
def c1(spark: SparkSession, d: str) -> DataFrame:
    return Cl.labelled_sites(embedding_angles(spark, d), lambda x: Cl.density_peaks(x)[0])


@query("n11_augmented", WITH + "SELECT md, sample, CAST(site AS INTEGER) AS site, round(js, 6) + 0 AS js FROM (" + js_sql("SELECT CASE WHEN x.sample_id < 1995 THEN 'state:' ELSE 'cluster:' END || x.sample_id AS md, y.sample_id AS sample, x.site, x.p, y.p AS q FROM marginal x JOIN marginal y ON x.site = y.site AND x.label = y.label WHERE x.sample_id IN (1993, 1994, 1997, 1998) AND y.sample_id IN (1995, 1996)", "md, sample, site") + ")")
def n11(spark: SparkSession, d: str) -> DataFrame:
    """A summary of two states, with four clusters on offer: one has a state's name and one an earlier cluster's; all sources against two samples."""
    frames = lineitem_frames(spark, d)
    year = F.col("sample_id").cast("string")
    states = frames.where("sample_id in (1993, 1994)").select(F.concat(F.lit("state:"), year).alias("source_id"), F.concat(F.lit("Macro: "), year).alias("label"), "labels")
    offer = frames.where("sample_id in (1992, 1996, 1997, 1998)")
    name = F.when(F.col("sample_id") == 1992, "md cluster: 1993").when(F.col("sample_id") == 1996, "Metastable: 1997").otherwise(year)
    clusters = offer.select((F.col("sample_id") * F.when(F.col("sample_id") == 1996, 2).otherwise(1)).alias("position"), year.alias("cluster_id"), name.alias("name"), "labels")
    sources = augmented(states, clusters, "base").withColumnRenamed("source_id", "md")
    samples = frames.where("sample_id in (1995, 1996)").withColumnRenamed("sample_id", "sample")
    js = D.site_divergences(D.marginals(sources, SIZES, "md"), D.marginals(samples, SIZES, "sample"), "md", "sample")
    return js.select("md", "sample", "site", rounded(F.col("js")).alias("js"))


def _share(p: Column) -> Column:
    """Four digits of a share that is known to twelve: one halfway between two is a share of the frames, and goes up as in SQL."""
    return F.round(F.round(p, 12) * 10_000) / 10_000 + F.lit(0.0)


@query("e5_moment_conditions", WITH + "SELECT CAST(site AS INTEGER) AS site, label, round(avg(p), 4) + 0 AS p FROM (SELECT site, label, sum(n) / sum(sum(n)) OVER (PARTITION BY site) AS p FROM counts GROUP BY site, label) GROUP BY ALL")
def e5_moments(spark: SparkSession, d: str) -> DataFrame:
    """What the fitted model expects of each label, given the other sites: at its optimum the share that the frames have."""
    frames = lineitem_frames(spark, d)
    model, _ = Fi.fit_optimum(frames, SIZES, EDGES)
    return Fi.expected_shares(frames, SIZES, EDGES, model).select("site", "label", _share(F.col("p")).alias("p"))


@query("e8_moment_conditions", WITH + "SELECT CAST(site AS INTEGER) AS site, label, round(p, 4) + 0 AS p FROM (SELECT site, label, sum(n) / sum(sum(n)) OVER (PARTITION BY site) AS p FROM counts WHERE sample_id IN (" + ", ".join(map(str, SIDES["b"])) + ") GROUP BY site, label)")
def e8_moments(spark: SparkSession, d: str) -> DataFrame:
    """A model of one side, and what is to be added to it for the other side's frames: together they expect the other's shares."""
    frames, a, _ = _sides(spark, d)
    other, base = frames.where(F.col("sample_id").isin(SIDES["b"])), M.arrays(a)
    delta, _ = Fi.fit_optimum(other, SIZES, EDGES, base=base)
    whole = M.Arrays([x + y for x, y in zip(base.h, delta.h, strict=True)], {e: base.j[e] + delta.j[e] for e in EDGES})
    return Fi.expected_shares(other, SIZES, EDGES, whole).select("site", "label", _share(F.col("p")).alias("p"))


@query("e15_stratified_folds", """WITH c AS (SELECT CAST(s AS INTEGER) AS site, CASE WHEN label = 0 THEN 1 ELSE 0 END AS y, count(*) AS n FROM embeddings, range(16) t(s) GROUP BY ALL),
k AS (SELECT site, greatest(2, least(5, min(n))) AS k FROM c GROUP BY site)
SELECT c.site, c.y, CAST(f AS INTEGER) AS fold, CAST((n - f + k - 1) // k AS BIGINT) AS n FROM c JOIN k USING (site), range(5) t(f) WHERE f < k AND (n - f + k - 1) // k > 0""")
def e15(spark: SparkSession, d: str) -> DataFrame:
    """How many rows of each class a fold has: as many as any other, or one more."""
    angles = embedding_angles(spark, d).select("site", "frame_index", (F.col("state_id") == 0).cast("int").alias("y"))
    return Cl.stratified_folds(angles, ["site"], "y", "frame_index").groupBy("site", "y", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("n1_state_sensitivity")
def n1(spark: SparkSession, d: str) -> DataFrame:
    angles = embedding_angles(spark, d).withColumn("active", (F.col("state_id") == 0).cast("int"))
    return Cl.state_sensitivity(angles, "active")


@query("d7_frame_vectors", "SELECT label AS state_id, vec_id AS frame_index, 64 AS n FROM embeddings")
def d7(spark: SparkSession, d: str) -> DataFrame:
    return Fe.frame_vectors(embedding_angles(spark, d)).select("state_id", "frame_index", F.size("vector").alias("n"))


@query("d4_common_sites", "SELECT label AS state_id, vec_id AS frame_index, CAST(s AS INTEGER) AS site FROM embeddings, range(16) t(s) WHERE label IN (0, 1)")
def d4(spark: SparkSession, d: str) -> DataFrame:
    return Fe.common_sites(embedding_angles(spark, d), [0, 1]).select("state_id", "frame_index", "site")


@query("t1_windowed_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def t1(spark: SparkSession, d: str) -> DataFrame:
    return windowed_counts(table(spark, d, "events"), "ts", "event_type")

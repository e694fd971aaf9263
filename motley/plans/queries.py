"""Queries over the test tables, one or more for each operator, with SQL that says the same in other words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motley.functions import columns as C
from motley.functions.columns import rounded
from motley.operators import distributions as D
from motley.operators import frames as Fr
from motley.operators import models as M
from motley.operators import neighbours as Nb
from motley.operators import ordered as O
from motley.plans.registry import WITH, js_sql, query
from motley.sources.tables import EDGES, SIZES, kept, lineitem_frames, only_sources, sliced, table

LOW = "sample_id"


@query("a1_marginals", WITH + "SELECT sample_id, CAST(site AS INTEGER) AS site, label, round(p, 6) AS p FROM marginal")
def a1(spark: SparkSession, d: str) -> DataFrame:
    return D.marginals(lineitem_frames(spark, d), SIZES).select("sample_id", "site", "label", rounded(F.col("p")).alias("p"))


@query("a2_joints", WITH + "SELECT sample_id, CAST(r AS INTEGER) AS r, CAST(s AS INTEGER) AS s, k, l, round(p, 6) AS p FROM joint")
def a2(spark: SparkSession, d: str) -> DataFrame:
    return D.joints(lineitem_frames(spark, d), SIZES, EDGES).withColumn("p", rounded(F.col("p")))


SIDES = {"a": [1995, 1996, 1997], "b": [1998, 1999, 2000]}
POOLED = """, side AS (SELECT 'a' AS side, unnest([1995, 1996, 1997]) AS sample_id UNION ALL SELECT 'b', unnest([1998, 1999, 2000])),
pcounts AS (SELECT side, site, label, count(*) AS n FROM long JOIN side USING (sample_id) GROUP BY ALL),
pool AS (
  SELECT s.side, a.site, a.label, coalesce(c.n, 0) / sum(coalesce(c.n, 0)) OVER (PARTITION BY s.side, a.site) AS p
  FROM (SELECT DISTINCT side FROM side JOIN samples USING (sample_id)) s CROSS JOIN alphabet a LEFT JOIN pcounts c ON c.side = s.side AND c.site = a.site AND c.label = a.label
), pjcounts AS (SELECT side, r, s, labels[r + 1] AS k, labels[s + 1] AS l, count(*) AS n FROM wide JOIN side USING (sample_id) CROSS JOIN edge GROUP BY ALL),
pjoint AS (
  SELECT x.side, a.r, a.s, a.k, a.l, coalesce(c.n, 0) / sum(coalesce(c.n, 0)) OVER (PARTITION BY x.side, a.r, a.s) AS p
  FROM (SELECT DISTINCT side FROM side JOIN samples USING (sample_id)) x CROSS JOIN jalphabet a LEFT JOIN pjcounts c ON c.side = x.side AND c.r = a.r AND c.s = a.s AND c.k = a.k AND c.l = a.l
)
"""


@query("a3_pooled", WITH + POOLED + "SELECT side, CAST(site AS INTEGER) AS site, label, round(p, 6) AS p FROM pool")
def a3(spark: SparkSession, d: str) -> DataFrame:
    return D.pooled(lineitem_frames(spark, d), SIDES, SIZES).withColumn("p", rounded(F.col("p")))


def _pairs(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.withColumnRenamed("sample_id", "a"), df.withColumnRenamed("sample_id", "b")


NODE_JS = js_sql("SELECT x.sample_id AS a, y.sample_id AS b, x.site, x.label, x.p, y.p AS q FROM marginal x JOIN marginal y ON x.sample_id < y.sample_id AND x.site = y.site AND x.label = y.label", "a, b, site")
EDGE_JS = js_sql("SELECT x.sample_id AS a, y.sample_id AS b, x.r, x.s, x.p, y.p AS q FROM joint x JOIN joint y ON x.sample_id < y.sample_id AND x.r = y.r AND x.s = y.s AND x.k = y.k AND x.l = y.l", "a, b, r, s")


def _node_js(spark: SparkSession, d: str) -> DataFrame:
    a, b = _pairs(D.marginals(lineitem_frames(spark, d), SIZES))
    return D.site_divergences(a, b).where("a < b")


def _edge_js(spark: SparkSession, d: str) -> DataFrame:
    a, b = _pairs(D.joints(lineitem_frames(spark, d), SIZES, EDGES))
    return D.edge_divergences(a, b).where("a < b")


@query("m3_site_js", WITH + f"SELECT a, b, CAST(site AS INTEGER) AS site, round(kl, 6) + 0 AS kl, round(js, 6) + 0 AS js FROM ({NODE_JS})")
def m3(spark: SparkSession, d: str) -> DataFrame:
    return _node_js(spark, d).select("a", "b", "site", rounded(F.col("kl")).alias("kl"), rounded(F.col("js")).alias("js"))


@query("m4_edge_js", WITH + f"SELECT a, b, CAST(r AS INTEGER) AS r, CAST(s AS INTEGER) AS s, round(js, 6) + 0 AS js FROM ({EDGE_JS})")
def m4(spark: SparkSession, d: str) -> DataFrame:
    return _edge_js(spark, d).select("a", "b", "r", "s", rounded(F.col("js")).alias("js"))


@query("m6_combined_distance", WITH + f"SELECT a, b, round(n.js, 6) + 0 AS node, round(e.js, 6) + 0 AS edge, round(n.js + 0.5 * e.js, 6) + 0 AS distance FROM (SELECT a, b, avg(js) AS js FROM ({NODE_JS}) GROUP BY ALL) n JOIN (SELECT a, b, avg(js) AS js FROM ({EDGE_JS}) GROUP BY ALL) e USING (a, b)")
def m6(spark: SparkSession, d: str) -> DataFrame:
    out = D.combined_distance(_node_js(spark, d), _edge_js(spark, d), ["a", "b"], 1.0, 0.5)
    return out.select("a", "b", *[rounded(F.col(c)).alias(c) for c in ("node", "edge", "distance")])


@query("a5_js_summary", WITH + f"SELECT a, b, round(avg(js), 6) + 0 AS mean, round(median(js), 6) + 0 AS median, round(max(js), 6) + 0 AS most FROM ({NODE_JS}) GROUP BY ALL")
def a5(spark: SparkSession, d: str) -> DataFrame:
    return _node_js(spark, d).groupBy("a", "b").agg(rounded(F.avg("js")).alias("mean"), rounded(F.expr("percentile(js, 0.5)")).alias("median"), rounded(F.max("js")).alias("most"))


@query("k1_top_sites", WITH + f"SELECT a, b, CAST(site AS INTEGER) AS site, round(js, 6) + 0 AS js, CAST(rank AS INTEGER) AS rank FROM (SELECT a, b, site, js, row_number() OVER (PARTITION BY a, b ORDER BY round(js, 9) DESC, site) AS rank FROM ({NODE_JS})) WHERE rank <= 2")
def k1(spark: SparkSession, d: str) -> DataFrame:
    return O.top_k(_node_js(spark, d), ["a", "b"], F.round("js", 9), "site", 2).select("a", "b", "site", rounded(F.col("js")).alias("js"), "rank")


PREF_NODE = js_sql("SELECT x.side AS side, y.sample_id, x.site, y.p, x.p AS q FROM pool x JOIN marginal y ON x.site = y.site AND x.label = y.label", "side, sample_id, site")
PREF_EDGE = js_sql("SELECT x.side AS side, y.sample_id, x.r, x.s, y.p, x.p AS q FROM pjoint x JOIN joint y ON x.r = y.r AND x.s = y.s AND x.k = y.k AND x.l = y.l", "side, sample_id, r, s")
D_EDGE = js_sql("SELECT x.r, x.s, x.p, y.p AS q FROM pjoint x JOIN pjoint y ON x.side = 'a' AND y.side = 'b' AND x.r = y.r AND x.s = y.s AND x.k = y.k AND x.l = y.l", "r, s")


def side_scores(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    frames = lineitem_frames(spark, d)
    nodes = D.site_divergences(D.marginals(frames, SIZES), D.pooled(frames, SIDES, SIZES), "sample_id", "side")
    pj = D.pooled_joints(frames, SIDES, SIZES, EDGES)
    edges = D.edge_divergences(D.joints(frames, SIZES, EDGES), pj, "sample_id", "side")
    a, b = pj.where("side = 'a'").select("r", "s", "k", "l", "p", F.lit(0).alias("a")), pj.where("side = 'b'").select("r", "s", "k", "l", "p", F.lit(0).alias("b"))
    return nodes, edges, D.edge_divergences(a, b).select("r", "s", F.col("js").alias("d"))


@query("m9_weighted_edge_js", WITH + POOLED + f"SELECT side, sample_id, round(sum(e.js * w.js) / sum(w.js), 5) + 0 AS edge FROM ({PREF_EDGE}) e JOIN ({D_EDGE}) w USING (r, s) WHERE w.js > 0 GROUP BY side, sample_id")
def m9(spark: SparkSession, d: str) -> DataFrame:
    _, edges, weight = side_scores(spark, d)
    return edges.join(F.broadcast(weight), ["r", "s"]).groupBy("side", "sample_id").agg(rounded(D.weighted_mean(F.col("js"), F.col("d")), 5).alias("edge"))


@query("m8_blended_sites", WITH + POOLED + f"""SELECT n.side, n.sample_id, CAST(n.site AS INTEGER) AS site, round(0.5 * n.js + 0.5 * e.js, 5) + 0 AS distance FROM ({PREF_NODE}) n JOIN (
  SELECT side, sample_id, site, sum(js * d) / sum(d) AS js FROM (
    SELECT e.side, e.sample_id, unnest([e.r, e.s]) AS site, e.js, w.js AS d FROM ({PREF_EDGE}) e JOIN ({D_EDGE}) w USING (r, s)) GROUP BY ALL) e USING (side, sample_id, site)""")
def m8(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges, weight = side_scores(spark, d)
    return D.blended(nodes, edges.join(F.broadcast(weight), ["r", "s"]), ["side", "sample_id"], 0.5, 0.5).withColumn("distance", rounded(F.col("distance"), 5))


@query("m7_novelty", WITH + POOLED + f"SELECT sample_id, round(least(max(CASE WHEN side = 'a' THEN m END), max(CASE WHEN side = 'b' THEN m END)), 6) + 0 AS novelty FROM (SELECT side, sample_id, avg(js) AS m FROM ({PREF_NODE}) GROUP BY ALL) GROUP BY sample_id")
def m7(spark: SparkSession, d: str) -> DataFrame:
    means = side_scores(spark, d)[0].groupBy("sample_id").agg(*[F.avg(F.when(F.col("side") == s, F.col("js"))).alias(s) for s in "ab"])
    return means.select("sample_id", rounded(F.least("a", "b")).alias("novelty"))


@query("m10_soft_sides", WITH + POOLED + f"""SELECT sample_id, CAST(site AS INTEGER) AS site, round((1 - a) * b, 5) + 0 AS w_a, round(a * b2, 5) + 0 AS w_b FROM (
  SELECT sample_id, site, ja / ta AS a, jb / tb AS b, 1 - jb / tb AS b2 FROM (
    SELECT *, max(ja) OVER () AS ta, max(jb) OVER () AS tb FROM (
      SELECT sample_id, site, max(CASE WHEN side = 'a' THEN js END) AS ja, max(CASE WHEN side = 'b' THEN js END) AS jb FROM ({PREF_NODE}) GROUP BY ALL)))""")
def m10(spark: SparkSession, d: str) -> DataFrame:
    per = side_scores(spark, d)[0].groupBy("sample_id", "site").agg(*[F.max(F.when(F.col("side") == s, F.col("js"))).alias(s) for s in "ab"])
    top = per.agg(F.max("a").alias("ta"), F.max("b").alias("tb")).first()
    weights = D.soft_sides(F.col("a"), F.col("b"), F.lit(top["ta"]), F.lit(top["tb"]))
    return per.select("sample_id", "site", rounded(weights["w_a"], 5).alias("w_a"), rounded(weights["w_b"], 5).alias("w_b"))


@query("m15_js_by_alphabet", WITH + f"SELECT a, b, CAST(site AS INTEGER) AS site, round(js / ln(k), 6) + 0 AS js FROM ({NODE_JS}) JOIN site USING (site)")
def m15(spark: SparkSession, d: str) -> DataFrame:
    k = F.array(*[F.lit(x) for x in SIZES])
    return _node_js(spark, d).select("a", "b", "site", rounded(D.normalised_by_size(F.col("js"), k[F.col("site")])).alias("js"))


@query("m16_largest_difference", WITH + "SELECT x.sample_id AS a, y.sample_id AS b, CAST(x.site AS INTEGER) AS site, round(max(abs(x.p - y.p)), 6) AS largest FROM marginal x JOIN marginal y ON x.sample_id < y.sample_id AND x.site = y.site AND x.label = y.label GROUP BY ALL")
def m16(spark: SparkSession, d: str) -> DataFrame:
    a, b = _pairs(D.marginals(lineitem_frames(spark, d), SIZES))
    return D.largest_difference(D.compared(a, b, ["site", "label"], "a", "b").where("a < b"), ["a", "b", "site"]).withColumn("largest", rounded(F.col("largest")))


@query("a15_profile", WITH + "SELECT s.sample_id, a.label, round(coalesce(c.n, 0) / sum(coalesce(c.n, 0)) OVER (PARTITION BY s.sample_id), 6) AS p FROM samples s CROSS JOIN (SELECT CAST(unnest(range((SELECT max(label) + 1 FROM counts WHERE site = 2))) AS INTEGER) AS label) a LEFT JOIN counts c ON c.site = 2 AND c.sample_id = s.sample_id AND c.label = a.label")
def a15(spark: SparkSession, d: str) -> DataFrame:
    return D.zero_filled_profile(lineitem_frames(spark, d), 2).withColumn("p", rounded(F.col("p")))


@query("f1_drop_unassigned", WITH + "SELECT sample_id, frame_id FROM gaps GROUP BY sample_id, frame_id, rid HAVING count(label) = 5")
def f1(spark: SparkSession, d: str) -> DataFrame:
    return Fr.drop_unassigned(lineitem_frames(spark, d, gaps=True)).select("sample_id", "frame_id")


@query("f2_gap_as_state", WITH + "SELECT sample_id, CAST(site AS INTEGER) AS site, coalesce(label, k) AS label, count(*) AS n FROM gaps GROUP BY ALL")
def f2(spark: SparkSession, d: str) -> DataFrame:
    frames, _ = Fr.sanitized(lineitem_frames(spark, d, gaps=True), SIZES, "treat_as_state")
    return frames.select("sample_id", F.posexplode("labels").alias("site", "label")).groupBy("sample_id", "site", "label").agg(F.count(F.lit(1)).alias("n"))


@query("f3_out_of_range", WITH + "SELECT sample_id, frame_id, CAST(site AS INTEGER) AS site, label FROM long WHERE label >= CASE WHEN site = 2 THEN 4 ELSE k END")
def f3(spark: SparkSession, d: str) -> DataFrame:
    return Fr.out_of_range(lineitem_frames(spark, d), [3, 2, 4, 4, 3])


@query("f5_only_states", WITH + "SELECT sample_id, count(*) AS n FROM wide WHERE sample_id IN (1996, 1998) GROUP BY ALL")
def f5(spark: SparkSession, d: str) -> DataFrame:
    return Fr.only_states(lineitem_frames(spark, d), "sample_id", [1996, 1998]).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))


@query("f6_thinned", "SELECT o_orderstatus, o_orderkey FROM (SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) WHERE i % greatest(1, n // 100) = 0")
def f6(spark: SparkSession, d: str) -> DataFrame:
    return Fr.thinned(table(spark, d, "orders").select("o_orderstatus", "o_orderkey"), "o_orderstatus", "o_orderkey", 100)


@query("f7_evenly_spread", "SELECT o_orderstatus, o_orderkey FROM (SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) WHERE i IN (SELECT (j * (n - 1)) // 49 FROM range(50) t(j))")
def f7(spark: SparkSession, d: str) -> DataFrame:
    return Fr.evenly_spread(table(spark, d, "orders").select("o_orderstatus", "o_orderkey"), "o_orderstatus", "o_orderkey", 50)


@query("f10_rectangles", "SELECT o_orderkey FROM orders WHERE (o_totalprice BETWEEN 1000 AND 50000 AND o_custkey BETWEEN 10 AND 100) OR (o_totalprice BETWEEN 200000 AND 300000 AND o_custkey BETWEEN 1 AND 1000)")
def f10(spark: SparkSession, d: str) -> DataFrame:
    rules = [(50000.0, 1000.0, 10.0, 100.0), (200000.0, 300000.0, 1.0, 1000.0)]
    return table(spark, d, "orders").where(C.in_rectangles(F.col("o_totalprice"), F.col("o_custkey").cast("double"), rules)).select("o_orderkey")


@query("f12_informative_columns", "SELECT vec_label AS label, CAST(i - 1 AS INTEGER) AS \"column\" FROM (SELECT label AS vec_label, unnest(range(1, 65)) AS i, embedding FROM embeddings) WHERE isfinite(embedding[i]) GROUP BY vec_label, i HAVING max(abs(embedding[i])) >= 1e-12")
def f12(spark: SparkSession, d: str) -> DataFrame:
    return Fr.informative_columns(table(spark, d, "embeddings").select("label", "embedding"), "label", "embedding")


@query("f13_shifted_keys", "SELECT regexp_replace(c_name, '[0-9]+$', '') || CAST(CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT) + 7 AS VARCHAR) AS key, count(*) AS n FROM customer GROUP BY ALL")
def f13(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy(C.shifted_key(F.col("c_name"), 7).alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("f14_unique_slugs", "SELECT p_partkey, CASE WHEN nth = 1 THEN s ELSE s || '_' || nth END AS slug FROM (SELECT p_partkey, s, row_number() OVER (PARTITION BY s ORDER BY p_partkey) AS nth FROM (SELECT p_partkey, regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM part))")
def f14(spark: SparkSession, d: str) -> DataFrame:
    return Fr.unique_slugs(table(spark, d, "part"), C.slug(F.col("p_type")), "p_partkey").select("p_partkey", "slug")


@query("f16_orphans", """WITH ref AS (SELECT o_custkey AS owner, o_orderkey AS ref, CASE WHEN o_orderkey % 3 = 0 THEN 'essential' ELSE 'optional' END AS kind FROM orders),
k AS (SELECT DISTINCT l_orderkey AS ref FROM lineitem WHERE l_quantity > 20), m AS (SELECT owner, kind, k.ref IS NULL AS gone FROM ref LEFT JOIN k USING (ref))
SELECT owner FROM m GROUP BY owner HAVING bool_or(kind = 'essential' AND gone) OR coalesce(bool_and(gone) FILTER (WHERE kind = 'optional'), false)""")
def f16(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("o_orderkey") % 3 == 0, "essential").otherwise("optional")
    refs = table(spark, d, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("ref"), kind.alias("kind"))
    known = table(spark, d, "lineitem").where("l_quantity > 20").select(F.col("l_orderkey").alias("ref"))
    return Fr.orphans(refs, known, "owner", "ref", "kind")


@query("s2_sliced", "SELECT o_orderkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 5000 AND (o_orderkey - 100) % 7 = 0")
def s2(spark: SparkSession, d: str) -> DataFrame:
    return sliced(table(spark, d, "orders"), "o_orderkey", 100, 5000, 7).select("o_orderkey")


@query("s16_only_sources", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN (SELECT DISTINCT event_type FROM events ORDER BY 1 LIMIT 2) GROUP BY ALL")
def s16(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    wanted = [r[0] for r in events.select("event_type").distinct().orderBy("event_type").limit(2).collect()]
    return only_sources(events, "event_type", wanted).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("j1_kth_occurrence", """WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events WHERE event_id % 2 = 0),
b AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events WHERE event_id % 2 = 1)
SELECT a.user_id, a.event_id, b.event_id AS match FROM a LEFT JOIN b USING (user_id, nth)""")
def j1(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id")
    return Fr.matched_rows(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id"], "event_id", "event_id")


@query("j8_contact_edges", "WITH p AS (SELECT vec_id AS site, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings) SELECT a.site AS r, b.site AS s FROM p a JOIN p b ON a.site < b.site AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) < 0.05 * 0.05")
def j8(spark: SparkSession, d: str) -> DataFrame:
    sites = table(spark, d, "embeddings").select(F.col("vec_id").alias("site"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])
    return Fr.contact_edges(sites, 0.05)


J10 = """WITH e AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings),
n AS (SELECT q.vec_id AS key, r.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY abs(q.x - r.x), r.vec_id) AS rn FROM e q JOIN e r ON q.label % 2 = r.label % 2 AND q.vec_id <> r.vec_id),
c AS (SELECT key, label, count(*) AS n FROM n WHERE rn <= 10 GROUP BY ALL)
SELECT key, CAST(label AS INTEGER) AS label FROM (SELECT key, label, row_number() OVER (PARTITION BY key ORDER BY n DESC, label) AS o FROM c) WHERE o = 1"""
J11 = WITH + """, a AS (SELECT DISTINCT labels FROM wide WHERE l_orderkey % 2 = 1), b AS (SELECT DISTINCT labels FROM wide WHERE l_orderkey % 2 = 0),
near AS (SELECT a.labels, min(list_sum(list_transform([1, 2, 3, 4, 5], lambda i: CASE WHEN a.labels[i] <> b.labels[i] THEN 1 ELSE 0 END))) AS d FROM a CROSS JOIN b GROUP BY a.labels)
SELECT 0 AS block, frame_id, CAST(d AS INTEGER) AS distance FROM wide JOIN near USING (labels) WHERE l_orderkey % 2 = 1"""


@query("j10_knn_vote", J10)
def j10(spark: SparkSession, d: str) -> DataFrame:
    """The vote of each vector's ten nearest others, over all vectors."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"), (F.col("label") % 2).alias("block"))
    return Nb.nearest_votes(e, e, "block", "x", "vec_id", "label", 10).select(F.col("vec_id").alias("key"), "label")


@query("j11_nearest_hamming", J11)
def j11(spark: SparkSession, d: str) -> DataFrame:
    """Frames of odd orders against those of even orders: every frame takes part."""
    frames = lineitem_frames(spark, d).withColumn("order", F.floor(F.col("frame_id") / 8)).withColumn("block", F.lit(0))
    return Nb.nearest_rows(frames.where("order % 2 = 1"), frames.where("order % 2 = 0"), "block")


@query("j10_knn_vote_all", """WITH e AS (SELECT vec_id, label, CAST(i AS INTEGER) AS component, CAST(embedding[i + 1] AS DOUBLE) AS x FROM embeddings, range(64) t(i)),
n AS (SELECT q.vec_id AS key, q.component, r.label, row_number() OVER (PARTITION BY q.vec_id, q.component ORDER BY abs(q.x - r.x), r.vec_id) AS rn FROM e q JOIN e r ON q.component = r.component AND q.vec_id <> r.vec_id),
c AS (SELECT key, component, label, count(*) AS n FROM n WHERE rn <= 10 GROUP BY ALL)
SELECT component, CAST(label AS INTEGER) AS label, count(*) AS votes FROM (SELECT component, label, row_number() OVER (PARTITION BY key, component ORDER BY n DESC, label) AS o FROM c) WHERE o = 1 GROUP BY ALL""")
def j10_all(spark: SparkSession, d: str) -> DataFrame:
    """In each of the 64 components the vote of each vector's ten nearest others, and how often it falls on each label."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("component", "x")).withColumn("x", F.col("x").cast("double"))
    return Nb.nearest_votes(e, e, "component", "x", "vec_id", "label", 10).groupBy("component", "label").agg(F.count(F.lit(1)).alias("votes"))


@query("j11_nearest_hamming_all", """WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0.05 THEN 2 WHEN x < -0.05 THEN 0 ELSE 1 END) AS v FROM embeddings)
SELECT a.vec_id AS frame_id, CAST(min(list_sum(list_transform(list_zip(a.v, b.v), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END))) AS INTEGER) AS distance FROM s a JOIN s b ON a.vec_id % 2 = 1 AND b.vec_id % 2 = 0 GROUP BY a.vec_id""")
def j11_all(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of 64 labels, one of three a component: odd ids against even ones."""
    kind = lambda x: F.when(x > 0.05, 2).when(x < -0.05, 0).otherwise(1)
    frames = table(spark, d, "embeddings").select(F.col("vec_id").alias("frame_id"), F.transform("embedding", kind).alias("labels"))
    return Nb.nearest_rows(frames.where("frame_id % 2 = 1"), frames.where("frame_id % 2 = 0"))


@query("j12_label_lookup", "SELECT d.doc_id, coalesce(l.toxic, -1) AS label FROM documents d LEFT JOIN labels l USING (doc_id)")
def j12(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return found.select("doc_id", F.coalesce("toxic", F.lit(-1)).alias("label"))


@query("j15_latest", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events) WHERE n = 1")
def j15(spark: SparkSession, d: str) -> DataFrame:
    return Fr.latest(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], "ts", "event_id").drop("ts")


@query("u1_ordered_union", "SELECT 0 AS chain, o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 1, l_orderkey FROM lineitem WHERE l_linenumber = 1")
def u1(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.lit(0).alias("chain"), F.col("o_orderkey").alias("id"))
    return a.unionByName(table(spark, d, "lineitem").where("l_linenumber = 1").select(F.lit(1).alias("chain"), F.col("l_orderkey").alias("id")))


@query("u2_ordered_distinct", "SELECT DISTINCT o_custkey AS id FROM orders UNION SELECT c_custkey FROM customer")
def u2(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.lit(0).alias("part"), F.col("o_orderkey").alias("position"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit(1).alias("part"), F.col("c_custkey").alias("position"))
    return Fr.ordered_distinct(a.unionByName(b), "id", "part", "position")


@query("u3_edge_sets", "WITH a AS (SELECT DISTINCT least(l_partkey, l_suppkey) AS r, greatest(l_partkey, l_suppkey) AS s FROM lineitem WHERE l_linenumber = 1 AND l_partkey <> l_suppkey), b AS (SELECT DISTINCT least(l_partkey, l_suppkey) AS r, greatest(l_partkey, l_suppkey) AS s FROM lineitem WHERE l_linenumber = 2 AND l_partkey <> l_suppkey) SELECT r, s FROM a INTERSECT SELECT r, s FROM b")
def u3(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("r"), F.col("l_suppkey").alias("s"), "l_linenumber")
    return Fr.edge_set(rows.where("l_linenumber = 1")).intersect(Fr.edge_set(rows.where("l_linenumber = 2")))


@query("u4_difference", "SELECT DISTINCT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def u4(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id")).join(table(spark, d, "orders").select(F.col("o_custkey").alias("id")), "id", "left_anti").distinct()


@query("a8_histogram", "WITH b AS (SELECT o_orderstatus, least(CAST(floor((o_totalprice - 0) / 10000.0) AS INTEGER), 39) AS bin FROM orders WHERE o_totalprice BETWEEN 0 AND 400000) SELECT o_orderstatus, bin, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY o_orderstatus) * 10000.0), 9) AS density FROM b GROUP BY o_orderstatus, bin")
def a8(spark: SparkSession, d: str) -> DataFrame:
    return O.histogram(table(spark, d, "orders"), ["o_orderstatus"], "o_totalprice", 40, 0.0, 400000.0).withColumn("density", rounded(F.col("density"), 9))


@query("a7_quantiles", "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.25), 4) AS q25, round(quantile_cont(o_totalprice, 0.5), 4) AS q50, round(quantile_cont(o_totalprice, 0.75), 4) AS q75 FROM orders GROUP BY ALL")
def a7(spark: SparkSession, d: str) -> DataFrame:
    return O.quantiles(table(spark, d, "orders"), ["o_orderstatus"], "o_totalprice").select("o_orderstatus", *[rounded(F.col(c), 4).alias(c) for c in ("q25", "q50", "q75")])


@query("a9_deviation", "WITH m AS (SELECT o_orderstatus, median(o_totalprice) AS med FROM orders GROUP BY ALL) SELECT o.o_orderstatus, round(m.med, 4) AS median, round(median(abs(o.o_totalprice - m.med)), 4) AS mad FROM orders o JOIN m USING (o_orderstatus) GROUP BY ALL")
def a9(spark: SparkSession, d: str) -> DataFrame:
    return O.deviation(table(spark, d, "orders"), ["o_orderstatus"], "o_totalprice").select("o_orderstatus", *[rounded(F.col(c), 4).alias(c) for c in ("median", "mad")])


@query("a11_gap_rate", WITH + "SELECT sample_id, CAST(site AS INTEGER) AS site, round(avg(CASE WHEN label IS NULL THEN 1.0 ELSE 0.0 END), 6) AS rate FROM gaps GROUP BY ALL")
def a11(spark: SparkSession, d: str) -> DataFrame:
    long = lineitem_frames(spark, d, gaps=True).select("sample_id", F.posexplode("labels").alias("site", "label"))
    return long.groupBy("sample_id", "site").agg(rounded(F.avg(F.col("label").isNull().cast("double"))).alias("rate"))


@query("a14_sample_counts", WITH + "SELECT sample_id, count(*) AS frames, count(*) FILTER (WHERE bad) AS invalid, round(count(*) FILTER (WHERE bad) / count(*), 6) AS share FROM (SELECT sample_id, rid, bool_or(label IS NULL) AS bad FROM gaps GROUP BY ALL) GROUP BY sample_id")
def a14(spark: SparkSession, d: str) -> DataFrame:
    bad = ~Fr.assigned(F.col("labels"))
    return lineitem_frames(spark, d, gaps=True).groupBy("sample_id").agg(F.count(F.lit(1)).alias("frames"), F.count_if(bad).alias("invalid"), rounded(F.avg(bad.cast("double"))).alias("share"))


@query("w1_cdf", "WITH b AS (SELECT o_orderstatus, CAST(floor(o_totalprice / 10000) AS INTEGER) AS bin, count(*) AS n FROM orders GROUP BY ALL) SELECT o_orderstatus, bin, n, round(sum(n) OVER (PARTITION BY o_orderstatus ORDER BY bin) / sum(n) OVER (PARTITION BY o_orderstatus), 6) AS cdf FROM b")
def w1(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "orders").groupBy("o_orderstatus", F.floor(F.col("o_totalprice") / 10000).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return O.cumulative(counts, ["o_orderstatus"], "bin", "n").withColumn("cdf", rounded(F.col("cdf")))


@query("w3_mean_ranks", "SELECT l_orderkey, l_linenumber, round(rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2, 1) AS rank FROM lineitem")
def w3(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return O.mean_ranks(rows, ["l_returnflag"], "l_quantity").select("l_orderkey", "l_linenumber", rounded(F.col("rank"), 1).alias("rank"))


@query("w4_auc", """WITH r AS (SELECT l_returnflag, CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS y, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS rk FROM lineitem)
SELECT l_returnflag, round((sum(rk * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 6) AS auc FROM r GROUP BY ALL""")
def w4(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", (F.col("l_discount") > 0.05).cast("int").alias("y"))
    return O.auc(rows, ["l_returnflag"], "l_quantity", "y").withColumn("auc", rounded(F.col("auc")))


@query("w5_roc", """WITH e AS (SELECT event_type, value, event_id, CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS y FROM events)
SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS step, round(sum(1 - y) OVER o / sum(1 - y) OVER (PARTITION BY event_type), 6) AS fpr, round(sum(y) OVER o / sum(y) OVER (PARTITION BY event_type), 6) AS tpr FROM e WINDOW o AS (PARTITION BY event_type ORDER BY value DESC, event_id ROWS UNBOUNDED PRECEDING)
UNION ALL SELECT DISTINCT event_type, 0, 0.0, 0.0 FROM e""")
def w5(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_type", "value", "event_id", (F.col("user_id") % 3 == 0).cast("int").alias("y"))
    return O.roc(rows, ["event_type"], "value", "y", "event_id").select("event_type", "step", rounded(F.col("fpr")).alias("fpr"), rounded(F.col("tpr")).alias("tpr"))


@query("w6_window_distribution", """WITH e AS (SELECT user_id, event_id, event_type FROM events), n AS (SELECT user_id, event_id, unnest(list(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS event_type FROM e)
SELECT user_id, event_id, event_type, round(count(*) / sum(count(*)) OVER (PARTITION BY user_id, event_id), 6) AS p FROM n GROUP BY user_id, event_id, event_type""")
def w6(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return O.window_distribution(rows, ["user_id"], "event_id", "event_type", 2).withColumn("p", rounded(F.col("p")))


@query("w7_percentile_rank", "SELECT event_id, round(CASE WHEN n > 1 THEN 1 - (i - 1) / (n - 1) ELSE 1 END, 6) AS fast, round(CASE WHEN n > 1 THEN (i - 1) / (n - 1) ELSE 0 END, 6) + 0 AS slow FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)")
def w7(spark: SparkSession, d: str) -> DataFrame:
    return O.percentile_rank(table(spark, d, "events"), ["user_id"], "value", "event_id").select("event_id", rounded(F.col("fast")).alias("fast"), rounded(F.col("slow")).alias("slow"))


@query("w8_first_change", "WITH e AS (SELECT user_id, event_type, row_number() OVER w - 1 AS t, first_value(event_type) OVER w AS x FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, coalesce(min(t) FILTER (WHERE event_type <> x), 101) AS step FROM e GROUP BY user_id")
def w8(spark: SparkSession, d: str) -> DataFrame:
    return O.first_change(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type", 100)


CURVE = "WITH c AS (SELECT o_orderstatus AS curve, CAST(month(o_orderdate) AS DOUBLE) AS x, avg(o_totalprice) AS y FROM orders GROUP BY ALL)"


def _curve(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("curve"), F.month("o_orderdate").cast("double").alias("x")).agg(F.avg("o_totalprice").alias("y"))


@query("w9_trapezoid", CURVE + " SELECT curve, round(sum(a) / (max(x) - min(x)), 3) AS area FROM (SELECT curve, x, (x - lag(x) OVER w) * (y + lag(y) OVER w) / 2 AS a FROM c WINDOW w AS (PARTITION BY curve ORDER BY x)) GROUP BY curve")
def w9(spark: SparkSession, d: str) -> DataFrame:
    return O.trapezoid(_curve(spark, d), ["curve"], "x", "y").withColumn("area", rounded(F.col("area"), 3))


@query("w10_crossing", CURVE + """, m AS (SELECT avg(y) AS t FROM c), s AS (SELECT curve, x, y - t AS z, lag(x) OVER w AS x0, lag(y - t) OVER w AS z0 FROM c, m WINDOW w AS (PARTITION BY curve ORDER BY x)),
f AS (SELECT *, row_number() OVER (PARTITION BY curve ORDER BY x) AS n FROM s WHERE z >= 0)
SELECT k.curve, round(CASE WHEN f.curve IS NULL THEN -1.0 WHEN f.x0 IS NULL THEN f.x ELSE f.x0 + (0 - f.z0) * (f.x - f.x0) / (f.z - f.z0) END, 4) AS at FROM (SELECT DISTINCT curve FROM c) k LEFT JOIN f ON f.curve = k.curve AND f.n = 1""")
def w10(spark: SparkSession, d: str) -> DataFrame:
    curve = _curve(spark, d)
    mean = curve.agg(F.avg("y")).first()[0]
    shifted = curve.withColumn("y", F.col("y") - F.lit(mean))
    return O.crossing(shifted, ["curve"], "x", "y", 0.0, -1.0).withColumn("at", rounded(F.col("at"), 4))


@query("w11_arg_min", CURVE + " SELECT curve, x, round(y, 3) AS y FROM (SELECT *, row_number() OVER (PARTITION BY curve ORDER BY y, x) AS n FROM c) WHERE n = 1")
def w11(spark: SparkSession, d: str) -> DataFrame:
    return O.arg_min(_curve(spark, d), ["curve"], "x", "y").withColumn("y", rounded(F.col("y"), 3))


@query("w12_lagged_counts", 'WITH e AS (SELECT user_id, event_type AS "from", lead(event_type, 2) OVER (PARTITION BY user_id ORDER BY event_id) AS "to" FROM events) SELECT "from", "to", count(*) AS n FROM e WHERE "to" IS NOT NULL GROUP BY ALL')
def w12(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return O.lagged_pairs(rows, ["user_id"], "event_id", "event_type", 2).groupBy("from", "to").agg(F.count(F.lit(1)).alias("n"))


@query("w13_representative", "WITH e AS (SELECT label, vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings), m AS (SELECT label, avg(a) AS ma, avg(b) AS mb FROM e GROUP BY ALL), d AS (SELECT label, vec_id, (a - ma) * (a - ma) + (b - mb) * (b - mb) AS d2 FROM e JOIN m USING (label)) SELECT label, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d2, vec_id) AS n FROM d) WHERE n = 1")
def w13(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("label", "vec_id", F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b"))
    return O.representative(e, ["label"], ["a", "b"], "vec_id").select("label", "vec_id")


@query("w15_weighted_median", "WITH s AS (SELECT l_returnflag, l_quantity, sum(l_tax) AS w FROM lineitem GROUP BY ALL), c AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY l_quantity) / sum(w) OVER (PARTITION BY l_returnflag) AS cum FROM s) SELECT l_returnflag, min(l_quantity) AS median FROM c WHERE cum >= 0.5 GROUP BY ALL")
def w15(spark: SparkSession, d: str) -> DataFrame:
    return O.weighted_median(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_tax").select("l_returnflag", "median")


@query("w16_mid_rank", "WITH q AS (SELECT c_nationkey AS k, c_custkey, c_acctbal AS v FROM customer), r AS (SELECT s_nationkey AS k, s_acctbal AS v FROM supplier) SELECT q.c_custkey, round(avg(CASE WHEN r.v < q.v - 1e-9 THEN 1.0 WHEN r.v <= q.v + 1e-9 THEN 0.5 ELSE 0.0 END), 6) AS percentile FROM q LEFT JOIN r USING (k) WHERE k IN (SELECT k FROM r) GROUP BY ALL")
def w16(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), "c_custkey", F.col("c_acctbal").alias("v"))
    r = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("v"))
    return O.mid_rank(q, r, ["k"], "v").where("percentile is not null").select("c_custkey", rounded(F.col("percentile")).alias("percentile"))


# Models. The SQL fits the same model from counts of its own.
PMI = WITH + """, ac AS (SELECT site, label, count(*) AS n FROM long GROUP BY ALL), am AS (SELECT a.site, a.label, coalesce(c.n, 0) / sum(coalesce(c.n, 0)) OVER (PARTITION BY a.site) AS p FROM alphabet a LEFT JOIN ac c USING (site, label)),
jc AS (SELECT r, s, labels[r + 1] AS k, labels[s + 1] AS l, count(*) AS n FROM wide CROSS JOIN edge GROUP BY ALL), jm AS (SELECT a.r, a.s, a.k, a.l, coalesce(c.n, 0) / sum(coalesce(c.n, 0)) OVER (PARTITION BY a.r, a.s) AS p FROM jalphabet a LEFT JOIN jc c USING (r, s, k, l)),
h AS (SELECT site, label AS k, v - avg(v) OVER (PARTITION BY site) AS value FROM (SELECT site, label, -ln(p + 1e-8) AS v FROM am)),
j AS (SELECT r, s, k, l, v - avg(v) OVER (PARTITION BY r, s) AS value FROM (SELECT jm.r, jm.s, jm.k, jm.l, -ln(jm.p / (a.p * b.p + 1e-8) + 1e-8) AS v FROM jm JOIN am a ON a.site = jm.r AND a.label = jm.k JOIN am b ON b.site = jm.s AND b.label = jm.l))
"""
GAUGE = ", jk AS (SELECT *, avg(value) OVER (PARTITION BY r, s, k) AS mk, avg(value) OVER (PARTITION BY r, s, l) AS ml, avg(value) OVER (PARTITION BY r, s) AS m FROM j), hz AS (SELECT site, k, sum(value) AS v FROM (SELECT site, k, value FROM h UNION ALL SELECT r, k, mk - m / 2 FROM (SELECT DISTINCT r, s, k, mk, m FROM jk) UNION ALL SELECT s, l, ml - m / 2 FROM (SELECT DISTINCT r, s, l, ml, m FROM jk)) GROUP BY ALL)"


def _model(spark: SparkSession, d: str) -> M.Model:
    return M.fit_pmi(lineitem_frames(spark, d), SIZES, EDGES)


@query("e3_pmi_fields", PMI + "SELECT CAST(site AS INTEGER) AS site, k, round(value, 5) + 0 AS value FROM h")
def e3h(spark: SparkSession, d: str) -> DataFrame:
    return _model(spark, d).h.withColumn("value", rounded(F.col("value"), 5))


@query("e3_pmi_couplings", PMI + "SELECT CAST(r AS INTEGER) AS r, CAST(s AS INTEGER) AS s, k, l, round(value, 5) + 0 AS value FROM j")
def e3j(spark: SparkSession, d: str) -> DataFrame:
    return _model(spark, d).j.withColumn("value", rounded(F.col("value"), 5))


@query("e2_zero_sum_fields", PMI + GAUGE + "SELECT CAST(site AS INTEGER) AS site, k, round(v - avg(v) OVER (PARTITION BY site), 5) + 0 AS value FROM hz")
def e2h(spark: SparkSession, d: str) -> DataFrame:
    return M.zero_sum(_model(spark, d)).h.withColumn("value", rounded(F.col("value"), 5))


@query("e2_zero_sum_couplings", PMI + GAUGE + "SELECT CAST(r AS INTEGER) AS r, CAST(s AS INTEGER) AS s, k, l, round(value - mk - ml + m, 5) + 0 AS value FROM jk")
def e2j(spark: SparkSession, d: str) -> DataFrame:
    return M.zero_sum(_model(spark, d)).j.withColumn("value", rounded(F.col("value"), 5))


ENERGY = "en AS (SELECT f.sample_id, f.frame_id, f.e + g.e AS energy FROM (SELECT sample_id, frame_id, rid, sum(h.value) AS e FROM long JOIN h ON h.site = long.site AND h.k = long.label GROUP BY ALL) f JOIN (SELECT rid, sum(j.value) AS e FROM wide CROSS JOIN edge JOIN j ON j.r = edge.r AND j.s = edge.s AND j.k = labels[edge.r + 1] AND j.l = labels[edge.s + 1] GROUP BY ALL) g USING (rid))"


@query("e1_energies", PMI + f", {ENERGY} SELECT sample_id, frame_id, round(energy, 4) + 0 AS energy FROM en")
def e1(spark: SparkSession, d: str) -> DataFrame:
    model = M.arrays(_model(spark, d))
    return lineitem_frames(spark, d).select("sample_id", "frame_id", rounded(M.energy(F.col("labels"), model), 4).alias("energy"))


@query("a6_energy_summary", PMI + f", {ENERGY} SELECT sample_id, round(avg(energy), 4) + 0 AS mean, round(median(energy), 4) + 0 AS median, round(min(energy), 4) + 0 AS least, round(max(energy), 4) + 0 AS most FROM en GROUP BY ALL")
def a6(spark: SparkSession, d: str) -> DataFrame:
    model = M.arrays(_model(spark, d))
    e = lineitem_frames(spark, d).select("sample_id", M.energy(F.col("labels"), model).alias("e"))
    return e.groupBy("sample_id").agg(*[rounded(x, 4).alias(n) for n, x in (("mean", F.avg("e")), ("median", F.expr("percentile(e, 0.5)")), ("least", F.min("e")), ("most", F.max("e")))])


@query("e4_pseudolikelihood", PMI + """, nb AS (SELECT r AS site, s AS other, k, l, value FROM j UNION ALL SELECT s, r, l, k, value FROM j),
logit AS (SELECT w.sample_id, w.rid, h.site, h.k, w.labels[h.site + 1] AS x, -max(h.value) - sum(nb.value) AS v FROM wide w JOIN h ON true JOIN nb ON nb.site = h.site AND nb.k = h.k AND nb.l = w.labels[nb.other + 1] GROUP BY w.sample_id, w.rid, h.site, h.k, w.labels)
SELECT sample_id, CAST(site AS INTEGER) AS site, round(avg(ll), 4) + 0 AS score FROM (SELECT sample_id, rid, site, max(v) FILTER (WHERE k = x) - ln(sum(exp(v))) AS ll FROM logit GROUP BY sample_id, rid, site) GROUP BY sample_id, site""")
def e4(spark: SparkSession, d: str) -> DataFrame:
    """Means over the frames of a sample; a different frame of a sample is scored once."""
    frames = kept(D.counted_frames(lineitem_frames(spark, d), "sample_id"), "counted")
    model = M.arrays(M.fit_pmi(frames, SIZES, EDGES, "n"))
    scores = frames.select("sample_id", "n", F.posexplode(M.pseudolikelihood(F.col("labels"), model)).alias("site", "ll")).where("ll is not null")
    return scores.groupBy("sample_id", "site").agg(rounded(F.sum(F.col("ll") * F.col("n")) / F.sum("n"), 4).alias("score"))


@query("e6_interpolated", PMI + "SELECT CAST(r AS INTEGER) AS r, CAST(s AS INTEGER) AS s, k, l, round(0.25 * value + 0.75 * value * 2, 5) + 0 AS value FROM j")
def e6(spark: SparkSession, d: str) -> DataFrame:
    a = _model(spark, d)
    return M.blended(a, M.blended(a, a, 1.0, 1.0), 0.25, 0.75).j.withColumn("value", rounded(F.col("value"), 5))


@query("e11_penalties", PMI + "SELECT CAST(site AS INTEGER) AS site, round(1.5 * greatest(1e-6, o.own + coalesce(a.m, 0)), 4) AS penalty FROM (SELECT site, max(abs(value)) AS own FROM h GROUP BY ALL) o LEFT JOIN (SELECT site, sum(m) AS m FROM (SELECT unnest([r, s]) AS site, m FROM (SELECT r, s, max(abs(value)) AS m FROM j GROUP BY ALL)) GROUP BY ALL) a USING (site)")
def e11(spark: SparkSession, d: str) -> DataFrame:
    return M.one_hot_penalties(_model(spark, d)).withColumn("penalty", rounded(F.col("penalty"), 4))


@query("a21_norms", PMI + "SELECT CAST(r AS INTEGER) AS r, CAST(s AS INTEGER) AS s, round(sqrt(sum(value * value)), 4) AS norm FROM j GROUP BY ALL")
def a21(spark: SparkSession, d: str) -> DataFrame:
    return M.norms(_model(spark, d))[1].withColumn("norm", rounded(F.col("norm"), 4))

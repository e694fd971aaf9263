"""Queries over how ensembles are put together, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motley.functions import columns as C
from motley.functions.columns import rounded
from motley.operators import assembly as A
from motley.operators import clustering as Cl
from motley.operators import distributions as D
from motley.operators import frames as Fr
from motley.operators import models as M
from motley.operators import ordered as O
from motley.plans.analyses import DELTA, _sides, commitment, preferences
from motley.plans.queries import D_EDGE, NODE_JS, PMI, POOLED, PREF_EDGE, PREF_NODE, SIDES
from motley.plans.registry import WITH, js_sql, query
from motley.sources import tables as T
from motley.sources import versions as V
from motley.sources.tables import EDGES, SIZES, embedding_angles, lineitem_frames, table


@query("e14_fit_rows", WITH + "SELECT CAST(CASE sample_id WHEN 1997 THEN 0 WHEN 1995 THEN 1 ELSE 2 END AS INTEGER) AS position, sample_id, frame_id, labels[3] AS third, CASE sample_id WHEN 1996 THEN 'flag-' || labels[1] WHEN 1995 THEN 'inactive' ELSE 'active' END AS state, frame_id AS frame_index FROM wide WHERE sample_id IN (1995, 1996, 1997)")
def e14(spark: SparkSession, d: str) -> DataFrame:
    own = F.when(F.col("sample_id") == 1996, F.concat(F.lit("flag-"), F.col("labels")[0].cast("string")))
    frames = lineitem_frames(spark, d).withColumns({"frame_state_id": own, "frame_index": F.col("frame_id")})
    samples = spark.createDataFrame([(1995, "md_eval", "inactive"), (1996, "md_eval", "mixed"), (1997, "md_eval", "active"), (1998, "potts_sampling", "active")], "sample_id long, type string, state_id string")
    return A.assembled(frames, samples, [1997, 1995, 1997, 1996]).select("position", "sample_id", "frame_id", F.col("labels")[2].alias("third"), "state", "frame_index")


@query("u6_analysis_states", """SELECT 'state-' || r_regionkey AS state_id, r_name AS name, 'macro' AS kind, CAST(NULL AS VARCHAR) AS macro_state_id, CAST(10 * r_regionkey AS BIGINT) AS n_frames FROM region
UNION ALL SELECT * FROM (SELECT coalesce(CASE WHEN n_nationkey % 2 = 0 THEN 'meta-' || n_nationkey END, CASE WHEN n_nationkey % 5 <> 0 THEN 'id-' || n_nationkey END) AS state_id, coalesce(CASE WHEN n_nationkey % 3 = 0 THEN n_name END, CASE WHEN n_nationkey % 3 = 1 THEN 'State ' || n_nationkey END,
CASE WHEN n_nationkey % 2 = 0 THEN 'meta-' || n_nationkey END, CASE WHEN n_nationkey % 5 <> 0 THEN 'id-' || n_nationkey END), 'metastable', 'state-' || n_regionkey, CAST(n_nationkey AS BIGINT) FROM nation) WHERE state_id IS NOT NULL""")
def u6(spark: SparkSession, d: str) -> DataFrame:
    macro = table(spark, d, "region").select(F.concat(F.lit("state-"), F.col("r_regionkey").cast("string")).alias("state_id"), F.col("r_name").alias("name"), (F.col("r_regionkey") * 10).alias("n_frames"))
    key, name = F.col("n_nationkey"), lambda text: F.concat(F.lit(text), F.col("n_nationkey").cast("string"))
    sub = table(spark, d, "nation").select(
        F.when(key % 2 == 0, name("meta-")).alias("metastable_id"), F.when(key % 5 != 0, name("id-")).alias("id"), F.when(key % 3 == 0, F.col("n_name")).otherwise("").alias("name"), F.when(key % 3 == 1, name("State ")).alias("default_name"),
        F.concat(F.lit("state-"), F.col("n_regionkey").cast("string")).alias("macro_state_id"), key.alias("n_frames"),
    )
    return A.merged_states(macro, sub)


@query("j13_frame_labels", WITH + "SELECT r.sample_id, r.frame_id, g.total FROM (SELECT sample_id, CASE WHEN l_orderkey % 10 = 0 THEN -frame_id ELSE frame_id END AS frame_id FROM wide) r JOIN (SELECT sample_id, frame_id, rid, CAST(sum(label) AS INTEGER) AS total FROM gaps GROUP BY ALL HAVING count(label) = 5) g USING (sample_id, frame_id)")
def j13(spark: SparkSession, d: str) -> DataFrame:
    at = F.when(F.floor(F.col("frame_id") / 8) % 10 == 0, -F.col("frame_id")).otherwise(F.col("frame_id"))
    wanted = lineitem_frames(spark, d).select("sample_id", at.alias("frame_id"))
    return A.labels_of_frames(wanted, lineitem_frames(spark, d, gaps=True)).select("sample_id", "frame_id", F.aggregate("labels", F.lit(0), lambda s, x: s + x).alias("total"))


@query("c4_collected_frames", "SELECT label AS state_id, vec_id AS frame_index FROM embeddings WHERE (label = 0 AND vec_id % 3 = 1) OR (label = 2 AND vec_id % 3 IN (0, 2))")
def c4(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("label").alias("state_id"), F.col("vec_id").alias("frame_index"), (F.col("vec_id") % 3).alias("metastable"))
    wanted = spark.createDataFrame([(0, 1), (2, 0), (2, 2), (2, 2)], "state_id int, metastable long")
    return A.collected(rows, wanted, ["state_id", "metastable"]).select("state_id", "frame_index")


@query("a12_halo_upsert", WITH + """, old AS (SELECT sample_id, site, round(avg(CASE WHEN label IS NULL THEN 1.0 ELSE 0.0 END), 6) AS rate FROM gaps WHERE sample_id IN (1995, 1996) GROUP BY ALL), new AS (SELECT sample_id, site, round(avg(CASE WHEN label = 0 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM long WHERE sample_id IN (1996, 1997) GROUP BY ALL)
SELECT sample_id, CAST(site AS INTEGER) AS site, rate FROM (SELECT * FROM old WHERE sample_id NOT IN (SELECT sample_id FROM new) UNION ALL SELECT * FROM new)""")
def a12(spark: SparkSession, d: str) -> DataFrame:
    def rates(frames: DataFrame, halo, ids: list) -> DataFrame:
        long = frames.where(F.col("sample_id").isin(ids)).select("sample_id", F.posexplode("labels").alias("site", "label"))
        return long.groupBy("sample_id", "site").agg(rounded(F.avg(halo.cast("double"))).alias("rate"))

    old = rates(lineitem_frames(spark, d, gaps=True), F.col("label").isNull(), [1995, 1996])
    return A.upserted(old, rates(lineitem_frames(spark, d), F.col("label") == 0, [1996, 1997]), ["sample_id"])


@query("c14_replaced_substates", "SELECT n_regionkey AS state_id, 'old-' || n_nationkey AS substate FROM nation WHERE n_regionkey NOT IN (SELECT c_nationkey % 5 FROM customer WHERE c_acctbal > 9000 AND c_nationkey % 5 < 2) UNION ALL SELECT c_nationkey % 5, 'new-' || c_custkey FROM customer WHERE c_acctbal > 9000 AND c_nationkey % 5 < 2")
def c14(spark: SparkSession, d: str) -> DataFrame:
    name = lambda text, c: F.concat(F.lit(text), F.col(c).cast("string")).alias("substate")
    old = table(spark, d, "nation").select(F.col("n_regionkey").alias("state_id"), name("old-", "n_nationkey"))
    rich = table(spark, d, "customer").where("c_acctbal > 9000 and c_nationkey % 5 < 2")
    return A.upserted(old, rich.select((F.col("c_nationkey") % 5).alias("state_id"), name("new-", "c_custkey")), ["state_id"])


@query("f9_tail_rows", "WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back, count(*) OVER (PARTITION BY user_id) AS c FROM events) SELECT user_id, event_id, CAST(j AS INTEGER) AS j FROM (SELECT user_id, event_id, least(20, c) - back AS i, least(20, c) AS m FROM e WHERE back <= 20) JOIN range(8) r(j) ON i = (j * (m - 1)) // 7")
def f9(spark: SparkSession, d: str) -> DataFrame:
    return A.tail_spread(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id", 20, 8)


@query("f15_wildcards", """SELECT 'plain-' || r_regionkey AS key, 'resid 1' AS selection FROM region WHERE r_regionkey % 3 = 2 UNION SELECT 'res_' || n_nationkey, 'resid ' || n_nationkey FROM nation WHERE n_regionkey % 3 = 0
UNION SELECT 'res_' || a.n_nationkey || '_' || b.n_nationkey, 'resid ' || a.n_nationkey || ' ' || b.n_nationkey FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey WHERE a.n_regionkey % 3 = 1""")
def f15(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("r_regionkey") % 3 == 0, "protein [singles]").when(F.col("r_regionkey") % 3 == 1, "protein [pairs]").otherwise("resid 1")
    selections = table(spark, d, "region").select(F.concat(F.lit("plain-"), F.col("r_regionkey").cast("string")).alias("key"), kind.alias("selection"), F.col("r_regionkey").alias("base"))
    return A.wildcards(selections, table(spark, d, "nation").select(F.col("n_regionkey").alias("base"), F.col("n_nationkey").alias("resid")))


@query("j16_matched_states", "SELECT 'old-' || n_nationkey AS old_id, CASE WHEN n_nationkey % 4 = 3 THEN 'state_' || n_nationkey ELSE regexp_replace(lower(n_name), '[^a-z0-9]+', '_', 'g') END AS state_id FROM nation")
def j16(spark: SparkSession, d: str) -> DataFrame:
    n, key = table(spark, d, "nation"), F.col("n_nationkey")
    ident = F.when(key % 4 == 3, F.concat(F.lit("State "), key.cast("string"))).otherwise(F.col("n_name"))
    old = n.select(F.concat(F.lit("old-"), key.cast("string")).alias("old_id"), C.slug(ident).alias("label"))
    states = n.select(C.slug(ident).alias("state_id"), F.when(key % 4 == 3, "unnamed").otherwise(C.slug(F.col("n_name"))).alias("name"), (key % 2 == 0).alias("selected"))
    return A.matched_states(old, states)


@query("k7_constraints", "SELECT c_custkey, CAST(rank AS INTEGER) AS rank FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer WHERE c_acctbal > 0 AND c_nationkey < 15 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')) WHERE rank <= 25")
def k7(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    excluded = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return A.constraint_ranking(c.select("c_custkey", "c_acctbal"), "c_custkey", "c_acctbal", 25, excluded, c.where("c_nationkey < 15").select("c_custkey"))


@query("k2_top_edges", WITH + POOLED + f"SELECT CAST(r AS INTEGER) AS r, CAST(s AS INTEGER) AS s, CAST(rank AS INTEGER) AS rank FROM (SELECT r, s, row_number() OVER (ORDER BY round(js, 9) DESC, r, s) AS rank FROM ({D_EDGE})) WHERE rank <= 10")
def k2(spark: SparkSession, d: str) -> DataFrame:
    pair = D.pooled_joints(lineitem_frames(spark, d), SIDES, SIZES, EDGES)
    side = lambda n: pair.where(F.col("side") == n).select("r", "s", "k", "l", "p", F.lit(0).alias(n))
    return A.ranked_first(D.edge_divergences(side("a"), side("b")), [F.desc(F.round("js", 9)), F.asc("r"), F.asc("s")], 10).select("r", "s", "rank")


STEPS = "WITH e AS (SELECT user_id, event_type, row_number() OVER w - 1 AS t, first_value(event_type) OVER w AS x FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), f AS (SELECT user_id, coalesce(min(t) FILTER (WHERE event_type <> x), 101) AS step FROM e GROUP BY user_id)"


@query("k3_fastest_slowest", STEPS + " SELECT 'fastest' AS list, user_id, CAST(rank AS INTEGER) AS rank FROM (SELECT user_id, row_number() OVER (ORDER BY step, user_id) AS rank FROM f) WHERE rank <= 20 UNION ALL SELECT 'slowest', user_id, CAST(rank AS INTEGER) FROM (SELECT user_id, row_number() OVER (ORDER BY step DESC, user_id) AS rank FROM f) WHERE rank <= 20")
def k3(spark: SparkSession, d: str) -> DataFrame:
    steps = O.first_change(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type", 100)
    side = lambda name, by: A.ranked_first(steps, [by, F.asc("user_id")], 20).select(F.lit(name).alias("list"), "user_id", "rank")
    return side("fastest", F.asc("step")).unionByName(side("slowest", F.desc("step")))


@query("k4_restart_pool", PMI + ", en AS (SELECT f.frame_id, f.e + g.e AS energy FROM (SELECT frame_id, rid, sum(h.value) AS e FROM long JOIN h ON h.site = long.site AND h.k = long.label GROUP BY ALL) f JOIN (SELECT rid, sum(j.value) AS e FROM wide CROSS JOIN edge JOIN j ON j.r = edge.r AND j.s = edge.s AND j.k = labels[edge.r + 1] AND j.l = labels[edge.s + 1] GROUP BY ALL) g USING (rid)) SELECT frame_id, CAST(rank AS INTEGER) AS rank FROM (SELECT frame_id, row_number() OVER (ORDER BY round(energy, 6), frame_id) AS rank FROM en) WHERE rank <= 30")
def k4(spark: SparkSession, d: str) -> DataFrame:
    frames = lineitem_frames(spark, d)
    model = M.arrays(M.fit_pmi(frames, SIZES, EDGES))
    return A.ranked_first(frames.select("frame_id", F.round(M.energy(F.col("labels"), model), 6).alias("energy")), [F.asc("energy"), F.asc("frame_id")], 30).select("frame_id", "rank")


@query("k5_by_score", "SELECT p_partkey, CAST(row_number() OVER (ORDER BY coalesce(CASE WHEN p_size % 3 > 0 THEN p_retailprice END, 0) DESC, p_partkey) AS INTEGER) AS rank FROM part QUALIFY rank <= 100")
def k5(spark: SparkSession, d: str) -> DataFrame:
    score = F.coalesce(F.when(F.col("p_size") % 3 > 0, F.col("p_retailprice")), F.lit(0.0))
    return A.ranked_first(table(spark, d, "part").select("p_partkey", score.alias("score")), [F.desc("score"), F.asc("p_partkey")], 100).select("p_partkey", "rank")


@query("k6_sorted_lambdas", "SELECT s_suppkey, CAST(row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS INTEGER) AS rank FROM supplier")
def k6(spark: SparkSession, d: str) -> DataFrame:
    return O.placed(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), [], "s_acctbal", ["s_suppkey"]).select("s_suppkey", (F.col("place") + 1).cast("int").alias("rank"))


@query("w2_nn_cdfs", WITH + """, a AS (SELECT labels, count(*) AS n FROM wide WHERE sample_id = 1995 GROUP BY ALL), b AS (SELECT labels, count(*) AS n FROM wide WHERE sample_id = 1996 GROUP BY ALL),
m AS (SELECT a.labels AS x, b.labels AS y, a.n AS nx, b.n AS ny, list_sum(list_transform(range(1, 6), lambda i: CASE WHEN a.labels[i] <> b.labels[i] THEN 1 ELSE 0 END)) AS d FROM a CROSS JOIN b),
near AS (SELECT 'a_to_b' AS direction, min(d) AS d, nx AS n FROM m GROUP BY x, nx UNION ALL SELECT 'b_to_a', min(d), ny FROM m GROUP BY y, ny)
SELECT direction, CAST(bin AS INTEGER) AS bin, round(sum(CASE WHEN d <= bin THEN n ELSE 0 END) / sum(n), 6) AS cdf FROM near CROSS JOIN range(6) t(bin) GROUP BY ALL""")
def w2(spark: SparkSession, d: str) -> DataFrame:
    frames = lineitem_frames(spark, d)
    return A.nearest_cdfs(frames.where("sample_id = 1995"), frames.where("sample_id = 1996"), 5).withColumn("cdf", rounded(F.col("cdf")))


TWO = WITH + ", a AS (SELECT l_orderkey, sample_id, labels AS a FROM wide WHERE frame_id % 8 = 1), b AS (SELECT l_orderkey, labels AS b FROM wide WHERE frame_id % 8 = 2)"


@query("m11_hamming", TWO + ", d AS (SELECT sample_id, list_sum(list_transform(range(1, 6), lambda i: CASE WHEN a.a[i] <> b.b[i] THEN 1 ELSE 0 END)) AS d FROM a JOIN b USING (l_orderkey)) SELECT sample_id, round(avg(d), 6) AS mean, round(median(d), 6) AS median, CAST(max(d) AS DOUBLE) AS most FROM d GROUP BY ALL")
def m11(spark: SparkSession, d: str) -> DataFrame:
    frames = lineitem_frames(spark, d).withColumn("order", F.floor(F.col("frame_id") / 8))
    a = frames.where("frame_id % 8 = 1").select("order", "sample_id", F.col("labels").alias("a"))
    b = frames.where("frame_id % 8 = 2").select("order", F.col("labels").alias("b"))
    return A.hamming_summary(a.join(b, "order"), ["sample_id"]).select("sample_id", rounded(F.col("mean")).alias("mean"), rounded(F.col("median")).alias("median"), "most")


@query("m11_energy_correlation", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 5) + 0 AS correlation FROM lineitem GROUP BY ALL")
def m11c(spark: SparkSession, d: str) -> DataFrame:
    return A.energy_correlation(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice").withColumn("correlation", rounded(F.col("correlation"), 5))


@query("a16_run_means", "SELECT l_returnflag AS schedule, CAST(floor(l_quantity / 10) AS BIGINT) AS sweeps, round(avg(CASE WHEN l_linenumber <> 3 THEN l_discount END), 6) AS final_mean, round(avg(l_tax), 6) AS init_mean FROM lineitem GROUP BY ALL")
def a16(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("l_linenumber") == 3, F.lit(float("nan"))).otherwise(F.col("l_discount"))
    runs = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("schedule"), F.floor(F.col("l_quantity") / 10).alias("sweeps"), value.alias("final_mean"), F.col("l_tax").alias("init_mean"))
    return A.grid_means(runs, ["schedule", "sweeps"], ["final_mean", "init_mean"]).select("schedule", "sweeps", rounded(F.col("final_mean")).alias("final_mean"), rounded(F.col("init_mean")).alias("init_mean"))


@query("n12_debug_grid", """SELECT l_returnflag AS schedule, CAST(l_linenumber AS DOUBLE) AS hot, l_linestatus || '-' || CASE WHEN l_suppkey % 2 = 0 THEN 'md' ELSE 'uniform' END AS line, CAST(floor(l_quantity / 25) AS BIGINT) AS sweeps, round(avg(l_discount), 6) AS final_mean, round(avg(CASE WHEN l_tax > 0 THEN l_discount / l_tax END), 4) AS corr FROM lineitem GROUP BY ALL""")
def n12(spark: SparkSession, d: str) -> DataFrame:
    ratio = F.when(F.col("l_tax") > 0, F.col("l_discount") / F.col("l_tax")).otherwise(F.lit(float("inf")))
    line = F.concat_ws("-", "l_linestatus", F.when(F.col("l_suppkey") % 2 == 0, "md").otherwise("uniform"))
    runs = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("schedule"), F.col("l_linenumber").cast("double").alias("hot"), line.alias("line"), F.floor(F.col("l_quantity") / 25).alias("sweeps"), F.col("l_discount").alias("final_mean"), ratio.alias("corr"))
    keys = ["schedule", "hot", "line", "sweeps"]
    return A.grid_means(runs, keys, ["final_mean", "corr"]).select(*keys, rounded(F.col("final_mean")).alias("final_mean"), rounded(F.col("corr"), 4).alias("corr"))


@query("j17_percentile_difference", """WITH m AS (SELECT o_custkey, o_orderstatus, avg(o_totalprice) AS v FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY ALL), p AS (SELECT o_custkey, o_orderstatus, 1 - (row_number() OVER (PARTITION BY o_orderstatus ORDER BY v, o_custkey) - 1) / (count(*) OVER (PARTITION BY o_orderstatus) - 1) AS fast FROM m)
SELECT a.o_custkey, round(a.fast - b.fast, 6) + 0 AS difference FROM p a JOIN p b USING (o_custkey) WHERE a.o_orderstatus = 'F' AND b.o_orderstatus = 'O'""")
def j17(spark: SparkSession, d: str) -> DataFrame:
    means = table(spark, d, "orders").where("o_orderstatus in ('F', 'O')").groupBy("o_custkey", "o_orderstatus").agg(F.avg("o_totalprice").alias("v"))
    fast = O.percentile_rank(means, ["o_orderstatus"], "v", "o_custkey")
    return A.percentile_difference(fast.where("o_orderstatus = 'F'"), fast.where("o_orderstatus = 'O'"), "o_custkey", "fast").withColumn("difference", rounded(F.col("difference")))


Q_SITE = "qs AS (SELECT sample_id, long.site, avg(CASE WHEN dh.value < 0 THEN 1.0 ELSE 0.0 END) AS q FROM long JOIN dh ON dh.site = long.site AND dh.k = long.label GROUP BY ALL)"
Q_EDGE = "qe AS (SELECT sample_id, edge.r, edge.s, avg(CASE WHEN dj.value < 0 THEN 1.0 ELSE 0.0 END) AS q, avg(dj.value) AS mean FROM wide CROSS JOIN edge JOIN dj ON dj.r = edge.r AND dj.s = edge.s AND dj.k = labels[edge.r + 1] AND dj.l = labels[edge.s + 1] GROUP BY ALL)"
D_MEAN = "ed AS (SELECT edge.r, edge.s, avg(dj.value) FILTER (WHERE sample_id IN (1995, 1996, 1997)) - avg(dj.value) FILTER (WHERE sample_id IN (1998, 1999, 2000)) AS d FROM wide CROSS JOIN edge JOIN dj ON dj.r = edge.r AND dj.s = edge.s AND dj.k = labels[edge.r + 1] AND dj.l = labels[edge.s + 1] GROUP BY ALL)"


def _edge_commitment(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    frames, a, b = _sides(spark, d)
    return frames, A.edge_commitment(frames, M.blended(a, b, 1.0, -1.0, shared_only=True).j, EDGES)


@query("n6_edge_commitment", DELTA + f", {Q_EDGE} SELECT sample_id, CAST(r AS INTEGER) AS r, CAST(s AS INTEGER) AS s, round(q, 6) AS q, round(mean, 4) + 0 AS mean FROM qe")
def n6e(spark: SparkSession, d: str) -> DataFrame:
    return _edge_commitment(spark, d)[1].select("sample_id", "r", "s", rounded(F.col("q")).alias("q"), rounded(F.col("mean"), 4).alias("mean"))


@query("m17_smoothed_commitment", DELTA + f""", {Q_SITE}, {Q_EDGE}, {D_MEAN}, x AS (SELECT sample_id, unnest([qe.r, qe.s]) AS site, sign(q - 0.5) * pow(abs(q - 0.5) * 2, 0.65) / 2 AS x, CASE WHEN abs(d) > 1e-12 THEN abs(d) ELSE 1.0 END AS w FROM qe JOIN ed USING (r, s)),
around AS (SELECT sample_id, site, sum(w * x) / sum(w) AS e FROM x GROUP BY ALL) SELECT sample_id, CAST(site AS INTEGER) AS site, round(0.5 + 0.6 * (q - 0.5) + 0.4 * e, 5) AS q FROM qs JOIN around USING (sample_id, site)""")
def m17(spark: SparkSession, d: str) -> DataFrame:
    frames, a, b = _sides(spark, d)
    difference = M.blended(a, b, 1.0, -1.0, shared_only=True)
    edges = A.edge_commitment(frames, difference.j, EDGES)
    side = lambda n: F.sum(F.when(F.col("sample_id").isin(SIDES[n]), F.col("mean") * F.col("n"))) / F.sum(F.when(F.col("sample_id").isin(SIDES[n]), F.col("n")))
    weight = edges.groupBy("r", "s").agg((side("a") - side("b")).alias("d"))
    return A.smoothed_commitment(commitment(frames, difference), edges.join(weight, ["r", "s"]), 0.4).withColumn("q", rounded(F.col("q"), 5))


D_NODE = js_sql("SELECT x.site, x.p, y.p AS q FROM pool x JOIN pool y ON x.side = 'a' AND y.side = 'b' AND x.site = y.site AND x.label = y.label", "site")


def _delta_js_sql(edges: str, top: int) -> str:
    return WITH + POOLED + f""", dn AS ({D_NODE}), dd AS (SELECT r, s, js FROM ({D_EDGE}) WHERE (r, s) IN ({edges}) QUALIFY row_number() OVER (ORDER BY round(js, 9) DESC, r, s) <= {top}),
    n AS (SELECT side, sample_id, sum(p.js * dn.js) / sum(dn.js) AS node FROM ({PREF_NODE}) p JOIN dn USING (site) WHERE dn.js > 0 GROUP BY ALL), e AS (SELECT side, sample_id, sum(p.js * dd.js) / sum(dd.js) AS edge FROM ({PREF_EDGE}) p JOIN dd USING (r, s) WHERE dd.js > 0 GROUP BY ALL)
    SELECT sample_id, side, round(node, 5) + 0 AS node, round(edge, 5) + 0 AS edge, round(0.5 * node + 0.5 * edge, 5) + 0 AS mixed FROM n JOIN e USING (side, sample_id)"""


def _delta_js(spark: SparkSession, d: str, edges: list[tuple[int, int]], top: int) -> DataFrame:
    out = A.delta_js(lineitem_frames(spark, d), SIDES, SIZES, edges, top)[0]
    return out.select("sample_id", "side", *[rounded(F.col(c), 5).alias(c) for c in ("node", "edge", "mixed")])


@query("n7_delta_js_all", _delta_js_sql("SELECT (r, s) FROM edge", 4))
def n7_all(spark: SparkSession, d: str) -> DataFrame:
    return _delta_js(spark, d, A.edges_of("all_vs_all", 5), 4)


@query("n7_delta_js_cluster", _delta_js_sql("(0, 2), (1, 3), (2, 4)", 2))
def n7_cluster(spark: SparkSession, d: str) -> DataFrame:
    return _delta_js(spark, d, A.edges_of("cluster", 5, [(2, 0), (1, 3), (0, 2), (2, 4), (3, 3)]), 2)


@query("n7_delta_js_contact", _delta_js_sql("SELECT (a.i, b.i) FROM (VALUES (0, 0.0), (1, 3.0), (2, 5.0), (3, 9.0), (4, 11.0)) a(i, x) JOIN (VALUES (0, 0.0), (1, 3.0), (2, 5.0), (3, 9.0), (4, 11.0)) b(i, x) ON a.i < b.i AND abs(a.x - b.x) < 5.5", 3))
def n7_contact(spark: SparkSession, d: str) -> DataFrame:
    return _delta_js(spark, d, A.edges_of("contact", 5, positions=[(x, 0.0, 0.0) for x in (0.0, 3.0, 5.0, 9.0, 11.0)], cutoff=5.5), 3)


@query("n7_upserted_samples", WITH + "SELECT DISTINCT sample_id FROM wide WHERE sample_id IN (1995, 1996, 1997, 1998)")
def n7_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A second call with other samples: those of the first stay, shared ones are made again."""
    frames = lineitem_frames(spark, d)
    first = A.delta_js(frames, SIDES, SIZES, [], 0, samples=[1995, 1996])[0]
    second = A.delta_js(frames, SIDES, SIZES, [], 0, samples=[1996, 1997, 1998])[0]
    return A.upserted(first, second, ["sample_id"]).select("sample_id").distinct()


@query("n7_upserted_rows", f"SELECT * FROM ({_delta_js_sql('SELECT (r, s) FROM edge', 4)}) WHERE sample_id IN (1995, 1996, 1997, 1998)")
def n7_rows(spark: SparkSession, d: str) -> DataFrame:
    """A stored analysis of two samples, upserted with one of three: rows of the shared sample are those of the second."""
    frames, path = lineitem_frames(spark, d), T.scratch(spark, "delta")
    edges = A.edges_of("all_vs_all", 5)
    old = A.delta_js(frames, SIDES, SIZES, edges, 4, samples=[1995, 1996])[0]
    V.upsert(old.withColumn("mixed", F.when(F.col("sample_id") == 1996, -1.0).otherwise(F.col("mixed"))), path, ["sample_id", "side"])
    V.upsert(A.delta_js(frames, SIDES, SIZES, edges, 4, samples=[1996, 1997, 1998])[0], path, ["sample_id", "side"])
    return V.read(spark, path).select("sample_id", "side", *[rounded(F.col(c), 5).alias(c) for c in ("node", "edge", "mixed")])


@query("n6_upserted_rows", DELTA + "SELECT sample_id, CAST(long.site AS INTEGER) AS site, round(avg(CASE WHEN dh.value < 0 THEN 1.0 ELSE 0.0 END), 6) AS q FROM long JOIN dh ON dh.site = long.site AND dh.k = long.label WHERE sample_id IN (1994, 1995, 1996) GROUP BY sample_id, long.site")
def n6_rows(spark: SparkSession, d: str) -> DataFrame:
    """Commitments of two samples stored with an older result, upserted by a run over two samples."""
    frames, a, b = _sides(spark, d)
    of = lambda ids: commitment(frames.where(F.col("sample_id").isin(ids)), M.blended(a, b, 1.0, -1.0, shared_only=True))
    path = T.scratch(spark, "commitment")
    V.upsert(of([1994, 1995]).withColumn("q", F.when(F.col("sample_id") == 1995, -1.0).otherwise(F.col("q"))), path, ["sample_id", "site"])
    V.upsert(of([1995, 1996]), path, ["sample_id", "site"])
    return V.read(spark, path).select("sample_id", "site", rounded(F.col("q")).alias("q"))


@query("n2_distances", WITH + f"SELECT a AS reference, b AS sample, round(n.js, 6) + 0 AS node, round(e.js, 6) + 0 AS edge, round(n.js + e.js, 6) + 0 AS distance FROM (SELECT a, b, avg(js) AS js FROM ({NODE_JS}) GROUP BY ALL) n JOIN (SELECT a, b, avg(js) AS js FROM ({js_sql('SELECT x.sample_id AS a, y.sample_id AS b, x.r, x.s, x.p, y.p AS q FROM joint x JOIN joint y ON x.sample_id < y.sample_id AND x.r = y.r AND x.s = y.s AND x.k = y.k AND x.l = y.l', 'a, b, r, s')}) GROUP BY ALL) e USING (a, b) WHERE a IN (1992, 1993) AND b IN (1995, 1996, 1998)")
def n2d(spark: SparkSession, d: str) -> DataFrame:
    from motley.plans.analyses import compared_samples

    frames = lineitem_frames(spark, d)
    bad = frames.where("sample_id = 1997").select("sample_id", "frame_id").distinct()
    distances, _ = compared_samples(frames, bad, SIZES, EDGES, [1992, 1993], [1995, 1996, 1997, 1998])
    return distances.select("reference", "sample", *[rounded(F.col(c)).alias(c) for c in ("node", "edge", "distance")])


@query("n4_site_preferences", DELTA + "SELECT sample_id, CAST(long.site AS INTEGER) AS site, round(avg(dh.value), 4) + 0 AS mean FROM long JOIN dh ON dh.site = long.site AND dh.k = long.label GROUP BY sample_id, long.site")
def n4s(spark: SparkSession, d: str) -> DataFrame:
    frames, a, b = _sides(spark, d)
    dh = M.blended(a, b, 1.0, -1.0, shared_only=True).h.withColumnRenamed("k", "label")
    counts = frames.select("sample_id", F.posexplode("labels").alias("site", "label")).groupBy("sample_id", "site", "label").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(dh, ["site", "label"]).groupBy("sample_id", "site").agg(rounded(F.sum(F.col("n") * F.col("value")) / F.sum("n"), 4).alias("mean"))


@query("n5_transition", DELTA + """, t AS (SELECT * FROM de WHERE sample_id IN (1995, 1996, 1997, 1998, 1999, 2000)), m AS (SELECT median(d) AS med FROM t), s AS (SELECT median(abs(d - med)) AS mad FROM t, m), z AS (SELECT sample_id, (d - med) / mad AS z FROM de, m, s),
tau AS (SELECT quantile_cont(abs(z), 0.1) AS tau FROM z WHERE sample_id IN (1995, 1996, 1997, 1998, 1999, 2000)), w AS (SELECT avg(CASE WHEN abs(z) <= tau THEN 1.0 ELSE 0.0 END) AS w FROM z, tau WHERE sample_id IN (1995, 1996, 1997, 1998, 1999, 2000))
SELECT sample_id, round(max(tau), 4) AS tau, round(avg(CASE WHEN abs(z) <= tau THEN 1.0 ELSE 0.0 END), 3) AS p, round(max(w), 3) AS p_train FROM z, tau, w GROUP BY sample_id""")
def n5t(spark: SparkSession, d: str) -> DataFrame:
    frames, a, b = _sides(spark, d)
    shares = A.transition(preferences(frames, M.arrays(a), M.arrays(b)), sum(SIDES.values(), []), 0.1)[1]
    return shares.select("sample_id", rounded(F.col("tau"), 4).alias("tau"), rounded(F.col("p"), 3).alias("p"), rounded(F.col("p_train"), 3).alias("p_train"))


@query("a15_requested_joints", WITH + """, asked AS (SELECT * FROM (VALUES (0, 2), (1, 3)) t(r, s)), top AS (SELECT site, max(label) AS m FROM long GROUP BY ALL), cell AS (SELECT r, s, CAST(k AS INTEGER) AS k, CAST(l AS INTEGER) AS l FROM asked, range(10) a(k), range(10) b(l) WHERE k <= (SELECT m FROM top WHERE site = r) AND l <= (SELECT m FROM top WHERE site = s)),
c AS (SELECT sample_id, r, s, labels[r + 1] AS k, labels[s + 1] AS l, count(*) AS n FROM wide, asked GROUP BY ALL)
SELECT x.sample_id, cell.r, cell.s, cell.k, cell.l, round(coalesce(c.n, 0) / sum(coalesce(c.n, 0)) OVER (PARTITION BY x.sample_id, cell.r, cell.s), 6) AS p FROM samples x CROSS JOIN cell LEFT JOIN c ON c.sample_id = x.sample_id AND c.r = cell.r AND c.s = cell.s AND c.k = cell.k AND c.l = cell.l""")
def a15j(spark: SparkSession, d: str) -> DataFrame:
    return A.requested_joints(lineitem_frames(spark, d), [(0, 2), (1, 3)]).withColumn("p", rounded(F.col("p")))


@query("m14_entropy_score", "WITH t AS (SELECT l_linestatus, greatest(1e-12, least(1 - 1e-12, l_discount * 5 + 0.2)) AS p, CASE WHEN l_quantity > 20 THEN 1 ELSE 0 END AS y FROM lineitem), s AS (SELECT l_linestatus, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS ce, avg(y) AS y FROM t GROUP BY ALL) SELECT l_linestatus, round(greatest(0, least(1, 1 - ce / -(y * ln(y) + (1 - y) * ln(1 - y)))), 5) AS score FROM s")
def m14(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_linestatus", (F.col("l_discount") * 5 + 0.2).alias("p"), (F.col("l_quantity") > 20).cast("int").alias("y"))
    return A.entropy_score(rows, ["l_linestatus"], "p", "y").withColumn("score", rounded(F.col("score"), 5))


MEMBERS = [(i, j, 0.9 if j == i % 3 else 0.05) for i in range(9) for j in range(3)] + [(9, 0, 0.4), (9, 1, 0.35), (9, 2, 0.25), (10, 3, 1.0)]
MEMBERS_SQL = "members AS (SELECT * FROM (VALUES " + ", ".join(f"({a}, {b}, {c})" for a, b, c in MEMBERS) + ") t(micro, macro, membership)), best AS (SELECT micro, macro, membership FROM members QUALIFY row_number() OVER (PARTITION BY micro ORDER BY membership DESC, macro) = 1), f AS (SELECT o_orderkey, CASE WHEN o_orderkey % 1009 = 0 THEN 10 ELSE o_orderkey % 10 END AS micro FROM orders), share AS (SELECT macro, count(*) / (SELECT count(*) FROM f) AS share FROM f JOIN best USING (micro) GROUP BY ALL)"


def _macro(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    micro = F.when(F.col("o_orderkey") % 1009 == 0, 10).otherwise(F.col("o_orderkey") % 10).cast("int")
    frames = table(spark, d, "orders").select("o_orderkey", micro.alias("micro"))
    return A.macro_labels(frames, "micro", spark.createDataFrame(MEMBERS, "micro int, macro int, membership double"))


@query("a20_macro_shares", f"WITH {MEMBERS_SQL} SELECT macro, round(share, 6) AS share, share < 0.01 AS small FROM share")
def a20(spark: SparkSession, d: str) -> DataFrame:
    return _macro(spark, d)[1].withColumn("share", rounded(F.col("share")))


@query("c12_macro_labels", f"WITH {MEMBERS_SQL} SELECT f.o_orderkey, CASE WHEN b.membership >= 0.5 AND s.share >= 0.01 THEN b.macro ELSE -1 END AS macro FROM f JOIN best b USING (micro) JOIN share s USING (macro)")
def c12(spark: SparkSession, d: str) -> DataFrame:
    return _macro(spark, d)[0].select("o_orderkey", "macro")


@query("c13_lag_frames", "SELECT DISTINCT l_quantity AS lag, CAST(l_linenumber + 0.5 AS DOUBLE) AS step, CAST(greatest(1, round_even(greatest(l_quantity, l_linenumber + 0.5) / (l_linenumber + 0.5), 0)) AS INTEGER) AS frames FROM lineitem")
def c13(spark: SparkSession, d: str) -> DataFrame:
    step = F.col("l_linenumber") + 0.5
    return table(spark, d, "lineitem").select(F.col("l_quantity").alias("lag"), step.alias("step"), A.lag_frames(F.col("l_quantity"), step).alias("frames")).distinct()


@query("w14_located", "WITH n AS (SELECT user_id AS trajectory, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT trajectory, sum(n) OVER (ORDER BY trajectory) AS stop, n FROM n) SELECT o_orderkey, trajectory, CAST(o_orderkey - (stop - n) AS BIGINT) AS local FROM orders JOIN s ON o_orderkey >= stop - n AND o_orderkey < stop")
def w14(spark: SparkSession, d: str) -> DataFrame:
    lengths = table(spark, d, "events").groupBy(F.col("user_id").alias("trajectory")).agg(F.count(F.lit(1)).alias("n"))
    return A.located(table(spark, d, "orders").select(F.col("o_orderkey"), F.col("o_orderkey").alias("frame")), lengths).select("o_orderkey", "trajectory", "local")


@query("u5_filter_union", "SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 20000 UNION SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN 9000 AND 9500")
def u5(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").where(C.in_rectangles(F.col("o_totalprice"), F.lit(0.0), [(20000.0, 1000.0, 0.0, 0.0)])).select("o_custkey")
    b = table(spark, d, "customer").where(C.in_rectangles(F.col("c_acctbal"), F.lit(0.0), [(9000.0, 9500.0, 0.0, 0.0)])).select(F.col("c_custkey").alias("o_custkey"))
    return a.unionByName(b).distinct()


@query("j14_samples_of_model", "SELECT o_orderkey FROM orders WHERE o_custkey % 5 = 3 OR o_custkey % 7 = 3")
def j14(spark: SparkSession, d: str) -> DataFrame:
    models = F.array(F.col("o_custkey") % 5, F.col("o_custkey") % 7)
    return table(spark, d, "orders").where(F.array_contains(models, F.lit(3).cast("long"))).select("o_orderkey")


@query("j9_all_edges", WITH + "SELECT CAST(r AS INTEGER) AS r, CAST(s AS INTEGER) AS s FROM edge")
def j9(spark: SparkSession, d: str) -> DataFrame:
    return A.all_edges(lineitem_frames(spark, d))


ANGLES = "WITH a AS (SELECT label AS state_id, vec_id AS frame_index, CAST((i - 1) // 4 AS INTEGER) AS site, CAST((i - 1) % 4 AS INTEGER) AS dim, CAST(embedding[i] AS DOUBLE) * 2 * pi() AS y FROM embeddings, range(1, 65) t(i)), angle AS (SELECT state_id, frame_index, site, dim, y - floor(y / (2 * pi())) * 2 * pi() AS x FROM a)"
MOMENTS = "mo AS (SELECT site, state_id AS cluster, dim, count(*) AS n, avg(x) AS m, var_samp(x) AS v FROM angle GROUP BY ALL), wt AS (SELECT site, cluster, max(n) / sum(max(n)) OVER (PARTITION BY site) AS w FROM mo GROUP BY site, cluster)"
SCORES = "sc AS (SELECT a.state_id, a.frame_index, a.site, mo.cluster, ln(max(wt.w)) - 0.5 * sum((a.x - mo.m) * (a.x - mo.m) / (mo.v + 1e-6) + ln(mo.v + 1e-6)) AS score FROM angle a JOIN mo ON mo.site = a.site AND mo.dim = a.dim JOIN wt ON wt.site = mo.site AND wt.cluster = mo.cluster GROUP BY ALL), th AS (SELECT site, cluster, quantile_cont(score, 0.05) AS least FROM sc WHERE state_id = cluster GROUP BY ALL), top AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY state_id, frame_index, site ORDER BY score DESC, cluster) = 1), halo AS (SELECT state_id, frame_index, site, top.cluster AS label, CASE WHEN score >= least THEN cluster ELSE -1 END AS label_halo FROM top JOIN th USING (site, cluster))"


def _moments(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    angles = embedding_angles(spark, d, 16)
    return angles, A.cluster_moments(angles, "state_id")


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    angles, moments = _moments(spark, d)
    own = A.frozen_labels(angles, moments)
    members = angles.join(moments.withColumnRenamed("cluster", "state_id"), ["site", "state_id"]).withColumn("s", A.log_density(F.col("angles"), F.col("weight"), F.col("mean"), F.col("variance")))
    least = O.quantiles(members, ["site", "state_id"], "s", (0.05,)).toDF("site", "cluster", "least")
    return A.frozen_labels(own.drop("label", "score"), moments, least)


@query("a17_cluster_moments", ANGLES + f", {MOMENTS} SELECT site, cluster, dim, n, round(m, 5) AS mean, round(v, 5) AS variance FROM mo")
def a17(spark: SparkSession, d: str) -> DataFrame:
    long = _moments(spark, d)[1].select("site", "cluster", "n", F.posexplode(F.arrays_zip("mean", "variance")).alias("dim", "_x"))
    return long.select("site", "cluster", "dim", "n", rounded(F.col("_x.mean"), 5).alias("mean"), rounded(F.col("_x.variance"), 5).alias("variance"))


@query("c2_frozen_labels", ANGLES + f", {MOMENTS}, {SCORES} SELECT state_id, frame_index, site, label FROM halo")
def c2(spark: SparkSession, d: str) -> DataFrame:
    angles, moments = _moments(spark, d)
    return A.frozen_labels(angles, moments).select("state_id", "frame_index", "site", "label")


@query("c7_evaluated_state", ANGLES + f", {MOMENTS}, {SCORES} SELECT frame_index, site, label FROM halo WHERE state_id = 1 AND frame_index IN (SELECT frame_index FROM halo WHERE state_id = 1 GROUP BY frame_index HAVING min(label_halo) >= 0)")
def c7(spark: SparkSession, d: str) -> DataFrame:
    return A.evaluated(_labelled(spark, d).where("state_id = 1")).select("frame_index", "site", "label")


@query("c6_condition_rates", ANGLES + f", {MOMENTS}, {SCORES} SELECT condition, site, count(*) AS n, round(avg(CASE WHEN label_halo < 0 THEN 1.0 ELSE 0.0 END), 6) AS halo_rate FROM (SELECT 'state:' || state_id AS condition, * FROM halo UNION ALL SELECT 'meta:' || (frame_index % 3), * FROM halo WHERE state_id <> 0) GROUP BY ALL")
def c6(spark: SparkSession, d: str) -> DataFrame:
    meta = F.when(F.col("state_id") != 0, F.col("frame_index") % 3)
    return A.condition_rates(_labelled(spark, d), [("state", F.col("state_id")), ("meta", meta)]).withColumn("halo_rate", rounded(F.col("halo_rate")))


def dihedral_sql(rows: str, keys: str) -> str:
    """SELECT keys, phi of rows (keys, a, b, c, d: points)."""
    minus = lambda n, u, v: f"[{u}[1] - {v}[1], {u}[2] - {v}[2], {u}[3] - {v}[3]] AS {n}"
    cross = lambda n, u, v: f"[{u}[2] * {v}[3] - {u}[3] * {v}[2], {u}[3] * {v}[1] - {u}[1] * {v}[3], {u}[1] * {v}[2] - {u}[2] * {v}[1]] AS {n}"
    dot = lambda u, v: f"({u}[1] * {v}[1] + {u}[2] * {v}[2] + {u}[3] * {v}[3])"
    steps = f"SELECT {keys}, {minus('p', 'b', 'a')}, {minus('q', 'c', 'b')}, {minus('s', 'd', 'c')} FROM ({rows})"
    normals = f"SELECT {keys}, p, q, {cross('l', 'p', 'q')}, {cross('r', 'q', 's')} FROM ({steps})"
    return f"SELECT {keys}, atan2(sqrt({dot('q', 'q')}) * {dot('p', 'r')}, {dot('l', 'r')}) AS phi FROM ({normals})"


POINT = "list_transform(embedding[{a}:{b}], lambda x: CAST(x AS DOUBLE))"
points_sql = lambda first: ", ".join(f"{POINT.format(a=first + 3 * i, b=first + 3 * i + 2)} AS {n}" for i, n in enumerate("abcd"))


def _points(first: int) -> list:
    return [F.transform(F.slice("embedding", first + 3 * i, 3), lambda x: x.cast("double")) for i in range(4)]


@query("d1_dihedrals", f"SELECT vec_id, round(phi, 5) + 0 AS phi FROM ({dihedral_sql(f'SELECT vec_id, {points_sql(1)} FROM embeddings', 'vec_id')})")
def d1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", rounded(C.dihedral(*_points(1)), 5).alias("phi"))


@query("d2_site_dihedrals", "SELECT frame_index, site, round(p, 5) + 0 AS phi, round(q, 5) + 0 AS psi FROM (" + " UNION ALL ".join(f"SELECT x.vec_id AS frame_index, CAST({s} AS INTEGER) AS site, x.phi AS p, y.phi AS q FROM ({dihedral_sql(f'SELECT vec_id, {points_sql(1 + 15 * s)} FROM embeddings', 'vec_id')}) x JOIN ({dihedral_sql(f'SELECT vec_id, {points_sql(4 + 15 * s)} FROM embeddings', 'vec_id')}) y USING (vec_id)" for s in range(4)) + ")")
def d2(spark: SparkSession, d: str) -> DataFrame:
    from motley.operators.features import dihedrals

    atom = F.explode(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.struct(F.floor(i / 5).cast("int").alias("site"), F.concat(F.lit("a"), (i % 5).cast("string")).alias("atom"), F.transform(F.slice("embedding", i * 3 + 1, 3), lambda x: x.cast("double")).alias("xyz"))))
    atoms = table(spark, d, "embeddings").select(F.col("label").alias("state_id"), F.col("vec_id").alias("frame_index"), atom.alias("_a")).select("state_id", "frame_index", "_a.*")
    rows = [(s, n, *[x for i in range(4) for x in (s, f"a{first + i}")]) for s in range(4) for n, first in (("phi", 0), ("psi", 1))]
    found = dihedrals(atoms, spark.createDataFrame(rows, "site int, name string, s1 int, a1 string, s2 int, a2 string, s3 int, a3 string, s4 int, a4 string"))
    return found.select("frame_index", "site", rounded(F.col("angles")[0], 5).alias("phi"), rounded(F.col("angles")[1], 5).alias("psi"))


@query("d3_group_features", ANGLES + ", kept AS (SELECT * FROM angle WHERE (frame_index + site) % 7 <> 0), g AS (SELECT * FROM (VALUES ('x', 0), ('x', 1), ('y', 2), ('y', 5), ('y', 9)) t(group_id, site)) SELECT group_id, frame_index, count(*) AS n, round(sum(x), 4) AS total FROM kept JOIN g USING (site) GROUP BY ALL HAVING count(DISTINCT site) = CASE group_id WHEN 'x' THEN 2 ELSE 3 END")
def d3(spark: SparkSession, d: str) -> DataFrame:
    from motley.operators.features import group_features

    groups = spark.createDataFrame([("x", 0), ("x", 1), ("y", 2), ("y", 5), ("y", 9)], "group_id string, site int")
    found = group_features(embedding_angles(spark, d, 16).where("(frame_index + site) % 7 != 0"), groups)
    total = F.aggregate("angles", F.lit(0.0), lambda s, x: s + x)
    return found.select("group_id", "frame_index", F.size("angles").cast("long").alias("n"), rounded(total, 4).alias("total"))


@query("d5_descriptor_rows", ANGLES + " SELECT frame_index, site, round(max(CASE WHEN dim = 0 THEN x END), 5) AS first FROM angle WHERE site NOT IN (3, 7) GROUP BY ALL")
def d5(spark: SparkSession, d: str) -> DataFrame:
    from motley.operators.features import descriptor_rows

    angles = embedding_angles(spark, d, 16)
    bare = F.when(F.col("site") == 3, F.transform("angles", lambda x: x * 0)).when(F.col("site") == 7, F.transform("angles", lambda x: F.lit(float("nan")))).otherwise(F.col("angles"))
    return descriptor_rows(angles.withColumn("angles", bare)).select("frame_index", "site", rounded(F.col("angles")[0], 5).alias("first"))


@query("f11_informative_sites", "SELECT CAST(l_linenumber AS INTEGER) AS site FROM lineitem WHERE l_linenumber NOT IN (2, 5) GROUP BY ALL")
def f11(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("l_linenumber") == 2, 0.0).when(F.col("l_linenumber") == 5, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    rows = table(spark, d, "lineitem").select(F.col("l_linenumber").cast("int").alias("site"), F.array(value).alias("angles"))
    return rows.groupBy("site").agg(F.max(Fr.has_values(F.col("angles")).cast("int")).alias("ok")).where("ok = 1").select("site")


@query("d8_contact_positions", """WITH ats AS (SELECT vec_id AS site, CASE WHEN i = 1 AND vec_id % 2 = 0 THEN 'CA' ELSE 'X' || i END AS atom, CAST(i + 1 AS DOUBLE) AS mass, CAST(embedding[3 * i + 1] AS DOUBLE) AS x, CAST(embedding[3 * i + 2] AS DOUBLE) AS y, CAST(embedding[3 * i + 3] AS DOUBLE) AS z FROM embeddings, range(4) t(i))
SELECT site, """ + ", ".join(f"round(coalesce(max(CASE WHEN atom = 'CA' THEN {c} END), sum(mass * {c}) / sum(mass)), 5) + 0 AS {c}" for c in "xyz") + " FROM ats GROUP BY site")
def d8(spark: SparkSession, d: str) -> DataFrame:
    from motley.operators.features import contact_positions

    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("site"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    name = F.when((F.col("i") == 1) & (F.col("site") % 2 == 0), "CA").otherwise(F.concat(F.lit("X"), F.col("i").cast("string")))
    xyz = F.transform(F.slice("embedding", F.col("i") * 3 + 1, 3), lambda x: x.cast("double"))
    return contact_positions(e.select("site", name.alias("atom"), (F.col("i") + 1).cast("double").alias("mass"), xyz.alias("xyz"))).select("site", *[rounded(F.col(c), 5).alias(c) for c in "xyz"])


@query("s15_backmapped", "SELECT state_id, x.frame_index, site, label, round(x, 5) AS x, round(p.phi, 5) + 0 AS phi, round(q.phi, 5) + 0 AS psi FROM (SELECT label AS state_id, vec_id AS frame_index, CAST(0 AS INTEGER) AS site, CAST(vec_id % 4 AS INTEGER) AS label, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings WHERE vec_id % 3 <> 0) x JOIN (" + dihedral_sql(f"SELECT vec_id AS frame_index, {points_sql(1)} FROM embeddings WHERE vec_id % 5 <> 0", "frame_index") + ") p USING (frame_index) JOIN (" + dihedral_sql(f"SELECT vec_id AS frame_index, {points_sql(13)} FROM embeddings", "frame_index") + ") q USING (frame_index)")
def s15(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("site", F.lit(0))
    labels = e.where("vec_id % 3 != 0").select(F.col("label").alias("state_id"), F.col("vec_id").alias("frame_index"), "site", (F.col("vec_id") % 4).cast("int").alias("label"))
    coordinates = e.where("vec_id % 5 != 0").select(F.col("label").alias("state_id"), F.col("vec_id").alias("frame_index"), "site", F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")).alias("xyz"), *[F.array(*_points(n)).alias(f"{c}_points") for c, n in (("phi", 1), ("psi", 13), ("chi1", 25))])
    return A.backmapped(labels, coordinates).select("state_id", "frame_index", "site", "label", rounded(F.col("x"), 5).alias("x"), rounded(F.col("phi"), 5).alias("phi"), rounded(F.col("psi"), 5).alias("psi"))


@query("a13_dimension_variance", ANGLES + " SELECT site, max(n) AS n, round(sum(v), 4) AS variance FROM (SELECT site, dim, count(*) AS n, var_samp(x) AS v FROM angle GROUP BY ALL) GROUP BY site")
def a13v(spark: SparkSession, d: str) -> DataFrame:
    """Rows and total variance of each site, the sum of the eigenvalues that the dimension is counted from."""
    long = embedding_angles(spark, d).select("site", "frame_index", F.posexplode("angles").alias("dim", "x"))
    return long.groupBy("site", "dim").agg(F.count(F.lit(1)).alias("n"), F.var_samp("x").alias("v")).groupBy("site").agg(F.max("n").alias("n"), rounded(F.sum("v"), 4).alias("variance"))


@query("a13_dimensions")
def a13(spark: SparkSession, d: str) -> DataFrame:
    return Cl.site_dimensions(embedding_angles(spark, d))


@query("j7_aligned_residues")
def j7(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation beside the next one: turns as residues, named by their role and first letter, aligned over all turns."""
    name = F.upper(F.concat(F.substring("role", 1, 1), F.substring(F.coalesce("text", F.lit("")), 1, 1)))
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", name.alias("name")))).alias("turns"))
    rows = turns.select("conv_id", F.col("turns.name").alias("residues"))
    pairs = rows.select(F.col("conv_id").alias("pair"), F.col("residues").alias("mobile")).join(rows.select((F.col("conv_id") - 1).alias("pair"), F.col("residues").alias("reference")), "pair")
    return A.aligned(pairs)

"""Queries over stored tables, and over models, ladders, chains and samples, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motley.functions import columns as C
from motley.functions.columns import rounded
from motley.operators import clustering as Cl
from motley.operators import distributions as D
from motley.operators import fitting as Fi
from motley.operators import frames as Fr
from motley.operators import models as M
from motley.operators import ordered as O
from motley.operators import sampling as G
from motley.plans.analyses import cross_likelihood
from motley.plans.queries import EDGE_JS, GAUGE, NODE_JS, PMI, POOLED, SIDES
from motley.plans.registry import SQL, WITH, query
from motley.sources import tables as T
from motley.sources import versions as V
from motley.sources.tables import EDGES, SIZES, embedding_angles, lineitem_frames, table
from motley.streaming.incremental import counted_into


@query("s3_descriptors_stored", "SELECT label AS state_id, vec_id AS frame_index, CAST(s AS INTEGER) AS site FROM embeddings, range(16) t(s) WHERE s <> 3")
def s3(spark: SparkSession, d: str) -> DataFrame:
    """Angles by site in folders, all but one site read again: the folder of the other is not opened."""
    path = T.write_table(embedding_angles(spark, d), T.scratch(spark, "descriptors"), ["site"])
    return spark.read.parquet(path).where("site != 3").select("state_id", "frame_index", "site")


@query("s4_clusters_stored", WITH + "SELECT sample_id, frame_id FROM gaps GROUP BY sample_id, frame_id, rid HAVING count(label) = 5")
def s4(spark: SparkSession, d: str) -> DataFrame:
    path = T.write_table(lineitem_frames(spark, d, gaps=True), T.scratch(spark, "clusters"))
    return Fr.sanitized(T.read_frames(spark, path), SIZES)[0].select("sample_id", "frame_id")


@query("s5_older_samples", WITH + "SELECT sample_id, frame_id, CAST(max(CASE WHEN site = 2 THEN label END) AS INTEGER) AS third FROM gaps GROUP BY sample_id, frame_id, rid")
def s5(spark: SparkSession, d: str) -> DataFrame:
    """Labels under the older name, -1 for unassigned."""
    older = lineitem_frames(spark, d, gaps=True).select("sample_id", "frame_id", F.transform("labels", lambda x: F.coalesce(x, F.lit(-1))).alias("assigned_labels"))
    return T.read_frames(spark, T.write_table(older, T.scratch(spark, "samples"))).select("sample_id", "frame_id", F.col("labels")[2].alias("third"))


@query("s6_model_stored", PMI + "SELECT CAST(r AS INTEGER) AS r, CAST(s AS INTEGER) AS s, k, l, round(value, 5) + 0 AS value FROM j")
def s6(spark: SparkSession, d: str) -> DataFrame:
    model = M.fit_pmi(lineitem_frames(spark, d), SIZES, EDGES)
    path = T.write_table(model.j, T.scratch(spark, "model"), version="pmi")
    return spark.read.parquet(path).select("r", "s", "k", "l", rounded(F.col("value"), 5).alias("value"))


@query("s7_new_version", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'X' ELSE o_orderstatus END AS status, o_orderstatus AS before FROM orders")
def s7(spark: SparkSession, d: str) -> DataFrame:
    path = T.scratch(spark, "payload")
    T.write_table(table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status")), path, version="a")
    new = T.replaced(spark, path, "a", lambda df: df.withColumn("status", F.when(F.col("o_orderkey") % 2 == 0, "X").otherwise(F.col("status"))), "b")
    return new.join(spark.read.parquet(f"{path}/version=a").withColumnRenamed("status", "before"), "o_orderkey")


@query("s7_manifest", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS status FROM orders UNION ALL SELECT -o_orderkey, 'N' FROM orders WHERE o_orderkey % 3 = 0")
def s7_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Two appended batches, one of them committed twice, and an upsert that replaces a third of the rows and adds as many."""
    path, orders = T.scratch(spark, "orders"), table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    for batch in (0, 1, 1):
        V.append(orders.where(F.col("o_orderkey") % 2 == batch), path, f"batch-{batch}")
    changed = orders.where("o_orderkey % 3 = 0")
    V.upsert(changed.withColumn("status", F.lit("X")).unionByName(changed.select((-F.col("o_orderkey")).alias("o_orderkey"), F.lit("N").alias("status"))), path, ["o_orderkey"])
    return V.read(spark, path)


@query("t2_counted_batches", "SELECT event_type, count(*) AS n FROM events GROUP BY ALL")
def t2(spark: SparkSession, d: str) -> DataFrame:
    """Three batches of events counted into one table, the second one given twice."""
    path = T.scratch(spark, "counts")
    sink = counted_into(path, ["event_type"])
    for number in (0, 1, 1, 2):
        sink(table(spark, d, "events").where(F.col("event_id") % 3 == number), number)
    return V.read(spark, path)


RECORDS = "record_id string, analysis_type string, created_at string, refs array<string>"


def _records(spark: SparkSession, d: str) -> str:
    path, e = T.scratch(spark, "records"), table(spark, d, "events")
    ref = lambda text, c: F.concat(F.lit(text), c.cast("string"))
    T.write_records(e.select(ref("r", F.col("event_id")).alias("record_id"), F.col("event_type").alias("analysis_type"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"), F.array(ref("u", F.col("user_id")), ref("u", F.col("user_id") + 1)).alias("refs")), path)
    return path


@query("s8_catalog", "SELECT event_type AS analysis_type, count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS newest FROM events GROUP BY ALL")
def s8(spark: SparkSession, d: str) -> DataFrame:
    records = T.read_records(spark, _records(spark, d), RECORDS)
    return records.groupBy("analysis_type").agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("newest"))


@query("s9_newest_records", "SELECT 'r' || event_id AS record_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at FROM events WHERE event_type = (SELECT min(event_type) FROM events)")
def s9(spark: SparkSession, d: str) -> DataFrame:
    kind = table(spark, d, "events").agg(F.min("event_type")).first()[0]
    return T.read_records(spark, _records(spark, d), RECORDS, kind).select("record_id", "created_at")


@query("s10_cleaned_results", "SELECT 'r' || event_id AS record_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) OR user_id + 1 NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def s10(spark: SparkSession, d: str) -> DataFrame:
    """Records of which a reference is gone."""
    refs = T.read_records(spark, _records(spark, d), RECORDS).select("record_id", F.explode("refs").alias("ref"), F.lit("essential").alias("kind"))
    known = table(spark, d, "customer").where("c_acctbal > 0").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("ref"))
    return Fr.orphans(refs, known, "record_id", "ref", "kind")


@query("s11_appended_rows", "SELECT n_nationkey AS key, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def s11(spark: SparkSession, d: str) -> DataFrame:
    path = T.scratch(spark, "runs.csv")
    T.append_csv(table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")), path, 2)
    T.append_csv(table(spark, d, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")), path, 2)
    return T.read_csv(spark, path, "key int, name string, schema_version int").where("schema_version = 2").select("key", "name")


@query("f8_sampled_rows", "SELECT o_orderkey FROM orders ORDER BY md5('7:' || o_orderkey), o_orderkey LIMIT 500")
def f8(spark: SparkSession, d: str) -> DataFrame:
    return Fr.hashed_sample(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 500, 7)


@query("e13_validation_split", "SELECT o_orderkey FROM orders WHERE substr(md5('3:' || o_orderkey), 1, 8) < '33333333'")
def e13(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where(Fi.in_validation(F.col("o_orderkey"), 0.2, 3)).select("o_orderkey")


@query("f17_natural_order", "SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT), c_custkey) AS BIGINT) AS place FROM customer")
def f17(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey", C.trailing_number(F.col("c_name")).alias("n"))
    return O.placed(rows, ["c_nationkey"], "n", ["c_custkey"]).select("c_custkey", (F.col("place") + 1).alias("place"))


@query("f18_finite_values", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber NOT IN (2, 4) THEN l_quantity END AS value FROM lineitem")
def f18(spark: SparkSession, d: str) -> DataFrame:
    odd = F.when(F.col("l_linenumber") == 2, F.lit(float("nan"))).when(F.col("l_linenumber") == 4, F.lit(float("-inf"))).otherwise(F.col("l_quantity"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C.finite(odd).alias("value"))


@query("g2_ladder", "SELECT s_suppkey, CAST(i AS INTEGER) AS i, round(0.1 * pow(high / 0.1, i / 7), 6) AS geometric, round(0.1 + i * (high - 0.1) / 7, 6) AS linear FROM (SELECT s_suppkey, 1 + abs(s_acctbal) / 1000 AS high FROM supplier), range(8) t(i)")
def g2(spark: SparkSession, d: str) -> DataFrame:
    """A ladder of eight for each supplier, up to a temperature that follows its balance."""
    high = 1 + F.abs("s_acctbal") / 1000
    both = F.arrays_zip(C.ladder(F.lit(0.1), high, 8).alias("g"), C.ladder(F.lit(0.1), high, 8, False).alias("l"))
    rows = table(spark, d, "supplier").select("s_suppkey", F.posexplode(both).alias("i", "x"))
    return rows.select("s_suppkey", "i", rounded(F.col("x.g")).alias("geometric"), rounded(F.col("x.l")).alias("linear"))


RUNS = "(SELECT CAST(year(l_shipdate) AS BIGINT) AS sample_id, count(*) AS total FROM lineitem GROUP BY ALL)"


@query("g8_chains", f"SELECT sample_id, CAST(c AS INTEGER) AS chain_index, CAST(11 + c AS BIGINT) AS seed, CAST(1.0 AS DOUBLE) AS beta, CAST(total // 7 + CASE WHEN c < total % 7 THEN 1 ELSE 0 END AS BIGINT) AS draws FROM {RUNS}, range(7) y(c) WHERE total // 7 + CASE WHEN c < total % 7 THEN 1 ELSE 0 END > 0")
def g8(spark: SparkSession, d: str) -> DataFrame:
    """As many draws as a sample has frames, over seven chains."""
    return G.split_chains(lineitem_frames(spark, d).groupBy("sample_id").agg(F.count(F.lit(1)).alias("total")), "sample_id", "total", 7, 11)


@query("g9_swept_chains", f"SELECT sample_id, CAST(3 * b + c AS INTEGER) AS chain_index, CAST(11 + 10000 * b + c AS BIGINT) AS seed, CAST(0.5 * (b + 1) AS DOUBLE) AS beta, CAST(total // 3 + CASE WHEN c < total % 3 THEN 1 ELSE 0 END AS BIGINT) AS draws FROM {RUNS}, range(4) x(b), range(3) y(c)")
def g9(spark: SparkSession, d: str) -> DataFrame:
    runs = lineitem_frames(spark, d).groupBy("sample_id").agg(F.count(F.lit(1)).alias("total"))
    return G.split_chains(runs, "sample_id", "total", 3, 11, [0.5, 1.0, 1.5, 2.0])


@query("c5_whole_clusters", "SELECT CAST(s AS INTEGER) AS site, count(*) AS n, count(*) AS labelled, true AS in_range FROM embeddings, range(16) t(s) GROUP BY ALL")
def c5(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of every site fitted on a sample, then all rows labelled: none is without a label, and halo labels are those or none."""
    found = Cl.labelled_sites(embedding_angles(spark, d), lambda x: Cl.linkage_labels(x, 3))
    sound = F.col("label").between(0, 2) & (F.col("label_halo").isNull() | (F.col("label_halo") == F.col("label")))
    return found.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("labelled"), F.bool_and(sound).alias("in_range"))


@query("e7_added_models", PMI + "SELECT CAST(site AS INTEGER) AS site, k, round(2 * value, 5) + 0 AS value FROM h")
def e7(spark: SparkSession, d: str) -> DataFrame:
    model = M.fit_pmi(lineitem_frames(spark, d), SIZES, EDGES)
    return M.blended(model, model, 1.0, 1.0).h.withColumn("value", rounded(F.col("value"), 5))


@query("e10_penalised_fields", PMI + "SELECT CAST(site AS INTEGER) AS site, k, round(value + CASE WHEN site IN (1, 3) THEN 0.5 * (site + 1) * k ELSE 0 END, 5) + 0 AS value FROM h")
def e10(spark: SparkSession, d: str) -> DataFrame:
    model = M.fit_pmi(lineitem_frames(spark, d), SIZES, EDGES)
    penalties = spark.createDataFrame([(s, k, float(s + 1), float(k)) for s in (1, 3) for k in range(SIZES[s])], "site int, k int, weight double, value double")
    return M.penalised(model, penalties, 0.5).h.withColumn("value", rounded(F.col("value"), 5))


QUBO = PMI + ", pen AS (SELECT o.site, 1.5 * greatest(1e-6, o.own + coalesce(a.m, 0)) AS penalty FROM (SELECT site, max(abs(value)) AS own FROM h GROUP BY ALL) o LEFT JOIN (SELECT site, sum(m) AS m FROM (SELECT unnest([r, s]) AS site, m FROM (SELECT r, s, max(abs(value)) AS m FROM j GROUP BY ALL)) GROUP BY ALL) a USING (site)), off AS (SELECT * FROM (VALUES (0, 0), (1, 3), (2, 5), (3, 10), (4, 14)) t(site, first))"


@query("e12_binary_linear", QUBO + " SELECT CAST(first + k AS INTEGER) AS i, round(0.5 * value - penalty, 4) + 0 AS a FROM h JOIN pen USING (site) JOIN off USING (site)")
def e12(spark: SparkSession, d: str) -> DataFrame:
    linear, _, _ = M.qubo(M.fit_pmi(lineitem_frames(spark, d), SIZES, EDGES), beta=0.5)
    return linear.select("i", rounded(F.col("a"), 4).alias("a"))


@query("e12_binary_quadratic", QUBO + """ SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(w, 4) + 0 AS w FROM (SELECT x.first + x.k AS i, x.first + y.k AS j, 2 * penalty AS w FROM (SELECT * FROM h JOIN off USING (site)) x JOIN h y ON x.site = y.site AND x.k < y.k JOIN pen ON pen.site = x.site
UNION ALL SELECT a.first + j.k, b.first + j.l, 0.5 * j.value FROM j JOIN off a ON a.site = j.r JOIN off b ON b.site = j.s)""")
def e12q(spark: SparkSession, d: str) -> DataFrame:
    _, quadratic, _ = M.qubo(M.fit_pmi(lineitem_frames(spark, d), SIZES, EDGES), beta=0.5)
    return quadratic.select("i", "j", rounded(F.col("w"), 4).alias("w"))


@query("c8_patched_labels", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN o_custkey % 3 ELSE o_custkey % 5 END AS label FROM orders")
def c8(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders")
    base, patch = rows.select("o_orderkey", (F.col("o_custkey") % 5).alias("label")), rows.where("o_orderkey % 4 = 1").select("o_orderkey", (F.col("o_custkey") % 3).alias("label"))
    return Cl.overlaid(base, patch, ["o_orderkey"])


@query("a19_acceptance", "SELECT CAST(user_id % 10 AS INTEGER) AS chain_index, round(count(*) FILTER (WHERE event_id % 3 = 0) / greatest(1, count(*)), 6) AS acceptance FROM events GROUP BY ALL")
def a19(spark: SparkSession, d: str) -> DataFrame:
    chain = (F.col("user_id") % 10).cast("int").alias("chain_index")
    log = table(spark, d, "events").groupBy(chain).agg(F.count_if(F.col("event_id") % 3 == 0).alias("swaps"), F.count(F.lit(1)).alias("trials"))
    return G.acceptance(log).withColumn("acceptance", rounded(F.col("acceptance")))


@query("c12_transition_counts", "WITH e AS (SELECT event_type AS a, lead(event_type, 3) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events), c AS (SELECT a, b, count(*) AS n FROM e WHERE b IS NOT NULL GROUP BY ALL) SELECT a, b, n, round(n / sum(n) OVER (PARTITION BY a), 6) AS p FROM c")
def c12t(spark: SparkSession, d: str) -> DataFrame:
    pairs = O.lagged_pairs(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type", 3)
    return Cl.transition_shares(pairs).withColumn("p", rounded(F.col("p")))


@query("c9_lagged_covariance", "WITH e AS (SELECT label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, lead(CAST(embedding[1] AS DOUBLE)) OVER w AS x1, lead(CAST(embedding[2] AS DOUBLE)) OVER w AS y1 FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)) SELECT label, round(covar_pop(x, x1), 6) + 0 AS xx, round(covar_pop(x, y1), 6) + 0 AS xy, round(covar_pop(y, y1), 6) + 0 AS yy FROM e WHERE x1 IS NOT NULL GROUP BY ALL")
def c9(spark: SparkSession, d: str) -> DataFrame:
    point = F.struct(*[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xy")])
    pairs = O.lagged_pairs(table(spark, d, "embeddings").select("label", "vec_id", point.alias("p")), ["label"], "vec_id", "p", 1)
    cov = lambda a, b: rounded(F.covar_pop(F.col(f"from.{a}"), F.col(f"to.{b}"))).alias(a + b)
    return pairs.groupBy("label").agg(cov("x", "x"), cov("x", "y"), cov("y", "y"))


SQL["n3_lambda_sweep"] = WITH + f"""SELECT b AS sample_id, CAST(CASE b WHEN 1998 THEN 0.0 WHEN 1999 THEN 0.5 ELSE 1.0 END AS DOUBLE) AS lambda, a AS reference, round(0.5 * n.js + 0.5 * e.js, 6) + 0 AS distance FROM (SELECT a, b, avg(js) AS js FROM ({NODE_JS}) GROUP BY ALL) n JOIN (SELECT a, b, avg(js) AS js FROM ({EDGE_JS}) GROUP BY ALL) e USING (a, b) WHERE a IN (1995, 1996, 1997) AND b IN (1998, 1999, 2000)"""


def _likelihood_sql(side: str) -> str:
    ids = ", ".join(map(str, SIDES[side]))
    return f"""am{side} AS (SELECT a.site, a.label, coalesce(c.n, 0) / sum(coalesce(c.n, 0)) OVER (PARTITION BY a.site) AS p FROM alphabet a LEFT JOIN (SELECT site, label, count(*) AS n FROM long WHERE sample_id IN ({ids}) GROUP BY ALL) c USING (site, label)),
jm{side} AS (SELECT a.r, a.s, a.k, a.l, coalesce(c.n, 0) / sum(coalesce(c.n, 0)) OVER (PARTITION BY a.r, a.s) AS p FROM jalphabet a LEFT JOIN (SELECT r, s, labels[r + 1] AS k, labels[s + 1] AS l, count(*) AS n FROM wide CROSS JOIN edge WHERE sample_id IN ({ids}) GROUP BY ALL) c USING (r, s, k, l)),
hp{side} AS (SELECT site, label AS k, v - avg(v) OVER (PARTITION BY site) AS value FROM (SELECT site, label, -ln(p + 1e-8) AS v FROM am{side})),
jp{side} AS (SELECT r, s, k, l, v - avg(v) OVER (PARTITION BY r, s) AS value FROM (SELECT q.r, q.s, q.k, q.l, -ln(q.p / (x.p * y.p + 1e-8) + 1e-8) AS v FROM jm{side} q JOIN am{side} x ON x.site = q.r AND x.label = q.k JOIN am{side} y ON y.site = q.s AND y.label = q.l)),
nb{side} AS (SELECT r AS site, s AS other, k, l, value FROM jp{side} UNION ALL SELECT s, r, l, k, value FROM jp{side}),
lg{side} AS (SELECT w.labels, w.site, hp.k, -max(hp.value) - sum(nb.value) AS v FROM (SELECT DISTINCT labels, site FROM wide CROSS JOIN site) w JOIN hp{side} hp ON hp.site = w.site JOIN nb{side} nb ON nb.site = hp.site AND nb.k = hp.k AND nb.l = w.labels[nb.other + 1] GROUP BY ALL),
ll{side} AS (SELECT labels, sum(ll) AS ll FROM (SELECT labels, site, max(v) FILTER (WHERE k = labels[site + 1]) - ln(sum(exp(v))) AS ll FROM lg{side} GROUP BY ALL) GROUP BY ALL)"""


SQL["m12_cross_likelihood"] = WITH + ", " + _likelihood_sql("a") + ", " + _likelihood_sql("b") + """, x AS (SELECT round(lla.ll - llb.ll, 9) AS delta, CASE WHEN sample_id <= 1997 THEN 1 ELSE 0 END AS y FROM wide JOIN lla USING (labels) JOIN llb USING (labels) WHERE sample_id IN (1995, 1996, 1997, 1998, 1999, 2000)),
r AS (SELECT y, rank() OVER (ORDER BY delta) + (count(*) OVER (PARTITION BY delta) - 1) / 2 AS rk FROM x) SELECT round((sum(rk * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 4) AS auc FROM r"""


@query("m12_log_likelihoods", WITH + ", " + _likelihood_sql("a") + ", " + _likelihood_sql("b") + " SELECT sample_id, frame_id, round(lla.ll - llb.ll, 4) + 0 AS delta FROM wide JOIN lla USING (labels) JOIN llb USING (labels) WHERE sample_id NOT IN (1995, 1996, 1997, 1998, 1999, 2000)")
def m12d(spark: SparkSession, d: str) -> DataFrame:
    """Frames of the other samples by which side's model explains them better."""
    frames = lineitem_frames(spark, d)
    a, b = (frames.where(F.col("sample_id").isin(v)) for v in SIDES.values())
    others = frames.where(~F.col("sample_id").isin(sum(SIDES.values(), [])))
    return cross_likelihood(a, b, others, SIZES, EDGES).select("sample_id", "frame_id", rounded(F.col("delta"), 4).alias("delta"))


@query("a21_gauged_norms", PMI + GAUGE + "SELECT CAST(site AS INTEGER) AS site, round(sqrt(sum(v * v)), 4) AS norm FROM (SELECT site, v - avg(v) OVER (PARTITION BY site) AS v FROM hz) GROUP BY site")
def a21g(spark: SparkSession, d: str) -> DataFrame:
    return M.norms(M.zero_sum(M.fit_pmi(lineitem_frames(spark, d), SIZES, EDGES)))[0].withColumn("norm", rounded(F.col("norm"), 4))


@query("a3_pooled_joints", WITH + POOLED + "SELECT side, CAST(r AS INTEGER) AS r, CAST(s AS INTEGER) AS s, k, l, round(p, 6) AS p FROM pjoint")
def a3j(spark: SparkSession, d: str) -> DataFrame:
    return D.pooled_joints(lineitem_frames(spark, d), SIDES, SIZES, EDGES).withColumn("p", rounded(F.col("p")))


@query("g10_noisy_frames", PMI + ", g AS (SELECT site, min(k) AS label FROM (SELECT site, k, value, min(value) OVER (PARTITION BY site) AS m FROM h) WHERE value <= m GROUP BY site) SELECT f AS frame_id, CAST(g.site AS INTEGER) AS site, CAST(CASE WHEN substr(md5('5:' || f || ':' || g.site), 1, 8) < '40000000' THEN (g.label + 1) % site.k ELSE g.label END AS INTEGER) AS label FROM range(2000) t(f) CROSS JOIN g JOIN site USING (site)")
def g10(spark: SparkSession, d: str) -> DataFrame:
    state = G.greedy_state(M.fit_pmi(lineitem_frames(spark, d), SIZES, EDGES).h)
    return G.noisy_frames(state, SIZES, 2000, 0.25, 5)


@query("f4_valid_frames", WITH + "SELECT sample_id, frame_id FROM wide WHERE frame_id % 8 <> 3 AND sample_id >= 1995")
def f4(spark: SparkSession, d: str) -> DataFrame:
    return Fr.valid_only(lineitem_frames(spark, d).withColumn("invalid", F.when(F.col("sample_id") >= 1995, F.col("frame_id") % 8 == 3).otherwise(True))).select("sample_id", "frame_id")


@query("j4_sample_pairs", WITH + "SELECT a.sample_id AS reference, b.sample_id AS sample FROM samples a CROSS JOIN samples b WHERE a.sample_id < 1995 AND b.sample_id >= 1995")
def j4(spark: SparkSession, d: str) -> DataFrame:
    ids = lineitem_frames(spark, d).select("sample_id").distinct()
    return Fr.paired(ids.where("sample_id < 1995"), ids.where("sample_id >= 1995"), "sample_id", "reference", "sample")

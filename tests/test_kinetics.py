"""Lagged moments, slow coordinates, clusters and transition matrices against NumPy and known chains."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import motley.plans.kinetics  # noqa: F401
from motley.operators import kinetics as K
from motley.plans.registry import QUERIES


def frame_of(spark, runs, parts):
    rows = [(key, t, [float(x) for x in v], 1) for key, values in runs.items() for t, v in enumerate(values)]
    rng = np.random.default_rng(1)
    rows += [("odd", 1, None, 1), ("odd", 2, [], 1), ("odd", 3, [1.0, float("nan"), 0.0], 1)]
    return spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "key string, t int, v array<double>, place int").repartition(parts)


def pairs_of(runs, lag):
    x = [v[:-lag] for v in runs.values() if len(v) > lag]
    y = [v[lag:] for v in runs.values() if len(v) > lag]
    return (np.concatenate(x), np.concatenate(y)) if x else (np.zeros((0, 3)),) * 2


@pytest.fixture(scope="module")
def runs():
    rng = np.random.default_rng(0)
    out = {f"k{i}": rng.normal(size=(i % 7, 3)) for i in range(40)}
    walk = np.zeros((700, 3))
    for t in range(1, 700):
        walk[t] = np.array([0.95, 0.7, 0.1]) * walk[t - 1] + rng.normal(size=3)
    return out | {"long": walk @ rng.normal(size=(3, 3)) + 5}


@pytest.mark.parametrize("lag", [1, 5, 90])
def test_moments_over_ranges(spark, runs, lag):
    spark.conf.set("spark.sql.shuffle.partitions", "13")  # ranges of under 90 rows
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = K.lagged_moments(frame_of(spark, runs, 3), ["key"], "t", "v", lag)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = K.Moments.of(*pairs_of(runs, lag))
    assert all(np.allclose(a, b) for a, b in zip(got, want, strict=True))


def test_no_pairs(spark, runs):
    assert K.lagged_moments(frame_of(spark, {"a": runs["k3"]}, 1), ["key"], "t", "v", 50) is None
    with pytest.raises(ValueError):
        K.lagged_moments(frame_of(spark, runs, 1), ["key"], "t", "v", 0)


def test_slow_coordinates(runs):
    x, y = pairs_of(runs, 3)
    slow = K.tica(K.Moments.of(x, y))
    both = np.concatenate((x, y)) - slow.mean
    z, after = (x - slow.mean) @ slow.components, (y - slow.mean) @ slow.components
    assert np.allclose(both.mean(0), 0) and np.allclose((both @ slow.components).T @ (both @ slow.components) / len(both), np.eye(3))
    assert np.allclose((z.T @ after + after.T @ z) / (2 * len(x)), np.diag(slow.values))
    assert slow.first(0.5).components.shape[1] == 1 and slow.first(2, scaled=True).components.shape == (3, 2)


def test_scores_do_not_vary_with_a_linear_map(runs):
    x, y = pairs_of(runs, 2)
    turn = np.random.default_rng(4).normal(size=(3, 3)) + 3 * np.eye(3)
    a, b = K.vamp(K.Moments.of(x, y)), K.vamp(K.Moments.of(x @ turn + 1, y @ turn + 1))
    assert np.allclose(a[0].values, b[0].values) and np.isclose(a[2], b[2])
    assert np.allclose(K.tica(K.Moments.of(x, y)).values, K.tica(K.Moments.of(x @ turn + 1, y @ turn + 1)).values)
    centred = [v - v.mean(0) for v in (x, y)]
    c = [centred[i].T @ centred[j] / len(x) for i, j in ((0, 0), (0, 1), (1, 1))]
    assert np.isclose(a[2], 1 + np.trace(np.linalg.solve(c[0], c[1]) @ np.linalg.solve(c[2], c[1].T)))
    left, right = centred[0] @ a[0].components, centred[1] @ a[1].components
    assert np.allclose(left.T @ right / len(x), np.diag(a[0].values), atol=1e-9)
    wide = np.column_stack((x, x[:, :1])), np.column_stack((y, y[:, :1]))  # a component twice: one direction less
    assert len(K.vamp(K.Moments.of(*wide))[0].values) == 3


def test_projected_rows(spark, runs):
    slow = K.tica(K.Moments.of(*pairs_of(runs, 1))).first(2)
    rows = K.projected(frame_of(spark, {"long": runs["long"]}, 2), "v", slow).collect()
    for r in rows:
        assert (r["slow"] is None) == (r["key"] == "odd")
        assert r["slow"] is None or np.allclose(r["slow"], (np.array(r["v"]) - slow.mean) @ slow.components)


def blobs(n=300):
    rng = np.random.default_rng(2)
    middles = np.array([[0, 0], [10, 0], [0, 10]])
    return middles[np.arange(n) % 3] + rng.normal(size=(n, 2))


def test_clusters_and_their_number(spark):
    x = blobs()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(-1, None)], "i int, v array<double>").repartition(4)
    centres = K.centres_of(df, "v", [1, 2, 3, 5])
    labels = {r["i"]: r["micro"] for r in K.assigned(df, "v", centres[3]).collect()}
    assert labels.pop(-1) is None
    same = np.array([labels[i] for i in range(300)])
    assert all(len(set(same[g::3])) == 1 for g in range(3)) and len(set(same)) == 3
    assert all(np.allclose(x[same == j].mean(0), centres[3][j]) for j in range(3))
    got = {r["k"]: (r["n"], r["score"]) for r in K.silhouettes(df, "v", centres).collect()}
    for k, c in centres.items():
        at = K._nearest(x, c)
        d = ((x[:, None] - x[None]) ** 2).sum(2)
        s = []
        for i in range(300):
            own = at == at[i]
            if k == 1 or own.sum() < 2:
                s.append(0.0)
                continue
            a, b = d[i, own].sum() / (own.sum() - 1), min(d[i, at == j].mean() for j in set(at.tolist()) - {at[i]})
            s.append((b - a) / max(a, b))
        assert got[k][0] == 300 and np.isclose(got[k][1], np.mean(s))
    assert K.best_size(K.silhouettes(df, "v", centres)) == 3
    assert K.centres_of(df.limit(0), "v", [2]) == {} and K.silhouettes(df.limit(0), "v", centres).count() == 0


def test_a_task_has_one_python_worker(spark, monkeypatch):
    """Slow coordinates are stored before k-means passes over them, so no pass has a worker for each step before it."""
    plans, old = [], K.centres_of
    monkeypatch.setattr(K, "centres_of", lambda df, *more: plans.append(df._jdf.queryExecution().executedPlan().toString()) or old(df, *more))
    one = QUERIES["c10_microstates"](spark, "/root/testdata/sf0.001")
    both = QUERIES["c14_metastable"](spark, "/root/testdata/sf0.001")
    assert len(plans) == 3 and not any("ArrowEvalPython" in p for p in plans)
    for df in (one, both):
        assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    key = lambda df: sorted((r["label"], r["vec_id"], r["micro"]) for r in df.collect())
    assert key(one) == key(both)


def test_odd_rows_have_no_slow_coordinates(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, None), (2, [1.0]), (3, [float("nan"), 1.0]), (4, [1e308, -1e308]), (5, [3.0, 5.0]), (6, [None, 1.0]), (7, [])], "i int, v array<double>").coalesce(1)
    found = K.projected(df, "v", K.Slow(np.array([1.0, 1.0]), np.array([[1.0, 10.0], [0.0, -10.0]]), np.ones(2)))
    near = {r["i"]: (r["slow"], r["micro"]) for r in K.assigned(found, "slow", np.array([[0.0, -10.0], [2.0, -20.0]])).collect()}
    assert near[0] == ([0.0, -10.0], 0) and near[5] == ([2.0, -20.0], 1) and all(near[i] == (None, None) for i in (1, 2, 3, 4, 6, 7))


def test_equal_rows_are_one_cluster(spark):
    df = spark.createDataFrame([([1.0, 2.0],)] * 9, "v array<double>")
    centres = K.centres_of(df, "v", [1, 2])
    assert list(centres) == [1] and K.assigned(df, "v", centres[1]).where("micro = 0").count() == 9


def chain(p, n, seed):
    rng, out = np.random.default_rng(seed), [0]
    for _ in range(n - 1):
        out.append(int(rng.choice(len(p), p=p[out[-1]])))
    return out


KNOWN = np.array([[0.9, 0.09, 0.01, 0], [0.1, 0.88, 0.0, 0.02], [0.01, 0, 0.8, 0.19], [0, 0.02, 0.2, 0.78]])


@pytest.fixture(scope="module")
def transitions(spark):
    rows = [("a", t, s) for t, s in enumerate(chain(KNOWN, 6000, 0))] + [("b", t, s) for t, s in enumerate(chain(KNOWN, 3000, 1))] + [("c", 0, 1), (None, 0, 1), (None, 1, None), (None, 2, 0)]
    df = spark.createDataFrame(rows, "k string, t int, s int").repartition(5)
    counts = K.transition_counts(df, ["k"], "t", "s", 1)
    want = np.zeros((4, 4))
    for key in ("a", "b", None):
        s = [r[2] for r in rows if r[0] == key and r[2] is not None]
        np.add.at(want, (s[:-1], s[1:]), 1)
    got = np.zeros((4, 4))
    for r in counts.collect():
        got[r["a"], r["b"]] = r["n"]
    assert (got == want).all()
    return got, K.reversible(counts)


def test_reversible_matrix(transitions):
    counts, found = transitions
    states, p, chance = K.matrix_of(found)
    assert states == [0, 1, 2, 3] and np.allclose(p.sum(1), 1) and np.isclose(chance.sum(), 1)
    flow = chance[:, None] * p
    assert np.allclose(flow, flow.T) and np.allclose(p, KNOWN, atol=0.03)
    likelihood = lambda q: float((counts * np.log(np.where(counts > 0, q, 1))).sum())
    plain = counts + counts.T
    assert likelihood(p) >= likelihood(plain / plain.sum(1, keepdims=True)) - 1e-9
    rng = np.random.default_rng(0)
    for _ in range(20):  # no reversible matrix near it is likelier
        other = flow * np.exp(rng.normal(size=flow.shape) * 0.01)
        other = other + other.T
        assert likelihood(other / other.sum(1, keepdims=True)) <= likelihood(p) + 1e-6
    with pytest.raises(ValueError):
        K.matrix_of(found, most=3)


def test_slow_processes_and_memberships(transitions):
    _, found = transitions
    _, p, chance = K.matrix_of(found)
    values, vectors = K.slow_processes(p, chance)
    assert np.isclose(values[0], 1) and np.allclose(p @ vectors, vectors * values)
    assert K.states_by_gap(values, 1, 2)[0] == 2 and K.states_by_gap(values, 1, 3)[1].keys() == {1, 2, 3}
    m = K.memberships(p, chance, 2)
    assert np.allclose(m.sum(1), 1) and (m >= 0).all()
    assert sorted(m.argmax(1).tolist()) == [0, 0, 1, 1] and m.argmax(1)[0] == m.argmax(1)[1] and m.max(1).min() > 0.8
    assert K.memberships(p, chance, 1).tolist() == [[1.0]] * 4
    four = K.memberships(p, chance, 4)
    assert np.allclose(four.sum(1), 1) and len(set(four.argmax(1).tolist())) == 4
    with pytest.raises(ValueError):
        K.memberships(p, chance, 5)
    with pytest.raises(ValueError):
        K.states_by_gap(values, 4, 9)


def test_states_of_a_hopping_trajectory(spark):
    hop = np.array(chain(np.array([[0.97, 0.03], [0.03, 0.97]]), 1500, 3))
    x = np.random.default_rng(5).normal(size=(1500, 3)) * 0.3 + np.array([[0, 0, 0], [8, 0, 0]])[hop]
    found = K.metastable(frame_of(spark, {"a": x}, 3), ["key"], "t", "v", lag=1, dims=1, micro=6)
    rows = found.rows.where("key = 'a'").orderBy("t").select("micro", "macro").collect()
    macro = np.array([r["macro"] for r in rows])
    assert len(found.scores) == 4 and max(found.scores, key=found.scores.get) == 2
    assert (macro == hop).all() or (macro == 1 - hop).all()
    assert found.rows.where(F.col("key") == "odd").where("macro is not null").count() == 0

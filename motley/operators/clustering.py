"""Clusters of angles per site, kinetics of labelled trajectories, and how well sites tell two states apart.

Sites are independent: each is a group of its own (`applyInPandas`). What a site's model is fitted on is an evenly spread
subsample of bounded size; every row is then labelled by the fitted model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motley.operators.frames import evenly_spread
from motley.operators.ordered import auc, placed
from motley.sources.tables import kept

TURN = 2 * np.pi


def periodic_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of angle vectors, each component around the circle the shorter way."""
    d = np.abs(a[:, None, :] - b[None, :, :]) % TURN
    d = np.minimum(d, TURN - d)
    return np.sqrt((d * d).sum(axis=2))


def two_neighbour_dimension(sorted_distances: np.ndarray) -> float:
    """Intrinsic dimension by the ratios of second to first neighbour distances."""
    r1, r2 = sorted_distances[:, 1], sorted_distances[:, 2]
    sound = r1 > 0
    total = float(np.log(r2[sound] / r1[sound]).sum())
    return float(np.clip(sound.sum() / total, 1.0, 20.0)) if total > 0 else 1.0


def density_peaks(x: np.ndarray, z: float = 1.5, k: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Labels of all points, and which are halo: peaks of the k-neighbour density, kept where they stand out from every
    saddle by z errors (C1). Equal distances are told apart by place, so results do not vary."""
    n = len(x)
    k = min(k, n - 1)
    if n < 4 or k < 2:
        return np.zeros(n, int), np.zeros(n, bool)
    d = periodic_distances(x, x)
    order = np.argsort(d, axis=1, kind="stable")
    near = np.take_along_axis(d, order, axis=1)
    dim = two_neighbour_dimension(near)
    rho = np.log(k) - dim * np.log(np.maximum(near[:, k], 1e-12))
    error = np.sqrt((4 * k + 2) / ((k - 1) * k))
    rank = np.lexsort((np.arange(n), -rho))
    place = np.empty(n, int)
    place[rank] = np.arange(n)
    neighbours = order[:, 1 : k + 1]
    label, peaks = np.full(n, -1), []
    for i in rank:
        higher = neighbours[i][place[neighbours[i]] < place[i]]
        if len(higher):
            label[i] = label[higher[0]]
        else:
            label[i] = len(peaks)
            peaks.append(i)
    saddle = np.full((len(peaks), len(peaks)), -np.inf)
    for i in range(n):
        for j in neighbours[i]:
            a, b = label[i], label[j]
            if a != b:
                saddle[a, b] = saddle[b, a] = max(saddle[a, b], min(rho[i], rho[j]))
    height, alive = rho[peaks].copy(), list(range(len(peaks)))
    while len(alive) > 1:
        gaps = [(saddle[a, b] - min(height[a], height[b]) + z * error * np.sqrt(2), a, b) for a in alive for b in alive if a < b and saddle[a, b] > -np.inf]
        worst = max(gaps, default=(-1.0, 0, 0), key=lambda g: (g[0], -g[1], -g[2]))
        if worst[0] <= 0:
            break
        a, b = (worst[1], worst[2]) if height[worst[1]] >= height[worst[2]] else (worst[2], worst[1])
        label[label == b] = a
        saddle[a] = np.maximum(saddle[a], saddle[b])
        saddle[:, a] = saddle[a]
        saddle[a, a] = -np.inf
        saddle[b], saddle[:, b] = -np.inf, -np.inf
        alive.remove(b)
    names = {c: i for i, c in enumerate(alive)}
    halo = np.array([rho[i] < saddle[label[i]].max() for i in range(n)])
    return np.array([names[c] for c in label]), halo


def linkage_labels(x: np.ndarray, clusters: int, method: str = "ward") -> np.ndarray:
    """Agglomerative clusters by the Lance-Williams update: ward, complete, average or single."""
    n = len(x)
    d = periodic_distances(x, x)
    d = d * d if method == "ward" else d
    np.fill_diagonal(d, np.inf)
    size, label = np.ones(n), np.arange(n)
    for _ in range(n - max(1, clusters)):
        i, j = np.unravel_index(np.argmin(d), d.shape)
        i, j = min(i, j), max(i, j)
        if method == "ward":
            total = size[i] + size[j] + size
            new = ((size[i] + size) * d[i] + (size[j] + size) * d[j] - size * d[i, j]) / total
        elif method == "average":
            new = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        else:
            new = np.maximum(d[i], d[j]) if method == "complete" else np.minimum(d[i], d[j])
        new[[i, j]] = np.inf
        new[np.isinf(d[i]) & np.isinf(d[j])] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
    _, out = np.unique(label, return_inverse=True)
    return out


class Gaussian(NamedTuple):
    mean: np.ndarray
    inverse: np.ndarray
    log_norm: float
    threshold: float


def _embedded(x: np.ndarray) -> np.ndarray:
    return np.concatenate((np.cos(x), np.sin(x)), axis=1)


def frozen_gaussians(x: np.ndarray, labels: np.ndarray, halo_share: float = 0.05, diagonal: bool = False, ridge: float = 1e-3) -> list[Gaussian]:
    """A Gaussian per cluster over cosines and sines; its members' lowest log-densities set what counts as halo."""
    y, out = _embedded(x), []
    for c in range(labels.max() + 1):
        own = y[labels == c]
        mean, far = own.mean(axis=0), own - own.mean(axis=0)
        cov = far.T @ far / max(1, len(own) - 1)
        cov = (np.diag(np.diag(cov)) if diagonal else cov) + ridge * np.eye(len(mean))
        g = Gaussian(mean, np.linalg.inv(cov), float(np.log(len(own) / len(x)) - 0.5 * np.linalg.slogdet(cov)[1]), -np.inf)
        out.append(g._replace(threshold=float(np.quantile(densities(x[labels == c], [g])[:, 0], halo_share))))
    return out


def densities(x: np.ndarray, model: list[Gaussian]) -> np.ndarray:
    y = _embedded(x)
    return np.stack([g.log_norm - 0.5 * np.einsum("ni,ij,nj->n", y - g.mean, g.inverse, y - g.mean) for g in model], axis=1)


def labelled_sites(angles: DataFrame, fit: Callable[[np.ndarray], np.ndarray], most: int = 1000, halo_share: float = 0.05) -> DataFrame:
    """angles (state_id, frame_index, site, angles) with label and label_halo (null in the halo): per site, clusters fitted on at
    most `most` evenly spread rows over all states, then all rows labelled by frozen Gaussians (C2, C3, C5).

    The models, a few numbers per site, are joined back, so labelling needs no group of all of a site's rows.
    """
    sample = evenly_spread(angles, "site", "frame_index", most)

    def model(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf.sort_values(["frame_index", "state_id"])["angles"].tolist(), float)
        found = frozen_gaussians(x, fit(x), halo_share)
        return pd.DataFrame({"site": pdf["site"].iloc[0], "model": [[[*g.mean, *g.inverse.ravel(), g.log_norm, g.threshold] for g in found]]})

    kind = angles.schema["site"].dataType.simpleString()
    models = sample.groupBy("site").applyInPandas(model, f"site {kind}, model array<array<double>>")
    names = angles.columns

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf.assign(label=0, label_halo=None)
            for _, part in pdf.groupby("site"):
                x = np.array(part["angles"].tolist(), float)
                w = 2 * x.shape[1]
                found = [Gaussian(v[:w], v[w : w + w * w].reshape(w, w), v[-2], v[-1]) for v in (np.asarray(r) for r in part["model"].iloc[0])]
                logp = densities(x, found)
                best = logp.argmax(axis=1)
                halo = logp.max(axis=1) < np.array([g.threshold for g in found])[best]
                out.loc[part.index, "label"] = best
                out.loc[part.index, "label_halo"] = [None if h else int(b) for h, b in zip(halo, best, strict=True)]
            yield out[[*names, "label", "label_halo"]]

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in angles.schema)
    return angles.join(F.broadcast(models), "site").select(*names, "model").mapInPandas(predict, f"{kinds}, label int, label_halo int")  # models: a row per site


def overlaid(base: DataFrame, patch: DataFrame, keys: list[str], column: str = "label") -> DataFrame:
    """Labels of `base`, those of `patch` in their place where it has any."""
    return base.join(patch.select(*keys, F.col(column).alias("_new")), keys, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def microstates(df: DataFrame, values: str, k: int, seed: int = 0) -> DataFrame:
    """df with micro: k-means clusters of an array column."""
    vectors = df.withColumn("_v", array_to_vector(values))
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="micro").fit(vectors).transform(vectors).drop("_v")


def slow_coordinates(df: DataFrame, keys: list[str], order: str, values: str, lag: int, dims: int, ridge: float = 1e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """mean, components, eigenvalues of the time-lagged independent components of an array column.

    Covariances are sums over pairs of rows `lag` apart, made in Spark; only two matrices of the array's width come back.
    """
    by = Window.partitionBy(*keys).orderBy(order)
    pair = df.select(F.col(values).alias("x"), F.lead(values, lag).over(by).alias("y")).where("y is not null")

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                x, y = np.array(b["x"].tolist(), float), np.array(b["y"].tolist(), float)
                own = np.concatenate(([len(x)], x.sum(0) + y.sum(0), (x.T @ x + y.T @ y).ravel(), (x.T @ y + y.T @ x).ravel()))
                total = own if total is None else total + own
        if total is not None:
            yield pd.DataFrame({"i": range(len(total)), "v": total})

    sums = {r["i"]: r["v"] for r in pair.mapInPandas(part, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
    flat = np.array([sums[i] for i in range(len(sums))])
    w = int((np.sqrt(1 + 8 * (len(flat) - 1)) - 1) / 4)
    n, mean = 2 * flat[0], flat[1 : 1 + w] / (2 * flat[0])
    c0 = flat[1 + w : 1 + w + w * w].reshape(w, w) / n - np.outer(mean, mean) + ridge * np.eye(w)
    ct = flat[1 + w + w * w :].reshape(w, w) / n - np.outer(mean, mean)
    s, u = np.linalg.eigh(c0)
    white = u / np.sqrt(s)
    values_, vectors = np.linalg.eigh(white.T @ ct @ white)
    top = np.argsort(-values_)[:dims]
    return mean, white @ vectors[:, top], values_[top]


def transition_shares(pairs: DataFrame) -> DataFrame:
    """a, b, n, p: counts of pairs (from, to), and their share of all with that start."""
    counts = pairs.groupBy(F.col("from").alias("a"), F.col("to").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("a")))  # a row per pair of states


def transition_matrix(df: DataFrame, keys: list[str], order: str, state: str, lag: int, states: int, rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Counts of state pairs `lag` rows apart, and the reversible transition matrix of most likelihood."""
    by = Window.partitionBy(*keys).orderBy(order)
    pair = df.select(F.col(state).alias("a"), F.lead(state, lag).over(by).alias("b")).where("a is not null and b is not null")
    counts = np.zeros((states, states))
    for r in pair.groupBy("a", "b").count().collect():  # states squared
        counts[r["a"], r["b"]] = r["count"]
    both, rows = counts + counts.T, counts.sum(axis=1)
    x = both.copy()
    for _ in range(rounds):
        share = rows / np.maximum(x.sum(axis=1), 1e-300)
        x = np.divide(both, share[:, None] + share[None, :], out=np.zeros_like(both), where=(share[:, None] + share[None, :]) > 0)
    total = x.sum(axis=1, keepdims=True)
    return counts, np.divide(x, total, out=np.eye(states), where=total > 0)


def spectral_gap(transition: np.ndarray, most: int = 10) -> int:
    """The number of slow processes before the greatest gap of eigenvalues; at least 1."""
    values = np.sort(np.abs(np.linalg.eigvals(transition)))[::-1][: most + 1]
    return int(np.argmax(values[:-1] - values[1:])) + 1 if len(values) > 1 else 1


def macrostates(transition: np.ndarray, k: int) -> np.ndarray:
    """A macrostate per microstate: the corners of the simplex that the slow eigenvectors span, each state to its nearest."""
    values, vectors = np.linalg.eig(transition)
    y = np.real(vectors[:, np.argsort(-np.real(values))[:k]])
    corners, rest = [int(np.argmax((y * y).sum(axis=1)))], y - y[np.argmax((y * y).sum(axis=1))]
    for _ in range(1, k):
        corners.append(int(np.argmax((rest * rest).sum(axis=1))))
        axis = rest[corners[-1]] / max(float(np.linalg.norm(rest[corners[-1]])), 1e-12)
        rest = rest - np.outer(rest @ axis, axis)
    return np.argmin(((y[:, None, :] - y[corners][None]) ** 2).sum(axis=2), axis=1)


def intrinsic_dimension(covariance: np.ndarray, n: int, share: float = 0.9) -> float:
    """Principal components that hold `share` of the variance; NaN for under five rows or none."""
    if n < 5:
        return float("nan")
    v = np.sort(np.clip(np.linalg.eigvalsh(np.atleast_2d(covariance)), 0, None))[::-1]
    return float(np.searchsorted(np.cumsum(v) / v.sum(), share - 1e-12) + 1) if v.sum() > 0 else float("nan")


def site_dimensions(angles: DataFrame, share: float = 0.9) -> DataFrame:
    """site, n, dimension over all rows of each site (A13): sums of products are made in Spark, a row per pair of components; what a
    task gathers of a site is one matrix of the width of its angles."""
    pair = F.expr("flatten(transform(sequence(0, size(angles) - 1), i -> transform(sequence(i, size(angles) - 1), j -> struct(i AS i, j AS j, angles[i] AS x, angles[j] AS y))))")
    sums = angles.select("site", F.inline(pair)).groupBy("site", "i", "j").agg(F.count(F.lit(1)).alias("n"), F.covar_samp("x", "y").alias("c"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        w = int(pdf["i"].max()) + 1
        c = np.zeros((w, w))
        c[pdf["i"], pdf["j"]] = c[pdf["j"], pdf["i"]] = pdf["c"].fillna(0.0)
        n = int(pdf["n"].max())
        return pd.DataFrame({"site": [pdf["site"].iloc[0]], "n": [n], "dimension": [intrinsic_dimension(c, n, share)]})

    return sums.groupBy("site").applyInPandas(work, f"site {angles.schema['site'].dataType.simpleString()}, n long, dimension double")


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """mean, deviation and weights (the last one of the constant) of a logistic regression of scaled columns."""
    mean, std = x.mean(0), x.std(0)
    std = np.where(std > 0, std, 1.0)
    z = np.column_stack(((x - mean) / std, np.ones(len(x))))
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= 0.5 * (z.T @ (p - y) / len(y) + 1e-3 * w)
    return mean, std, w


def stratified_folds(rows: DataFrame, keys: list[str], label: str, order: str, folds: int = 5, seed: int = 0) -> DataFrame:
    """rows with fold: rows of each key and class dealt in turn, in the order of a hash of `order`, so a class has as many rows in each fold,
    or one more (E15). A key has `folds` of them, or as many as its smallest class has rows, two at least; a single class counts alone.

    The turn is a place in an order dealt by ranges, so a key with most of the rows is many tasks. Nulls in `order` come last.
    """
    sizes = rows.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n")).groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.greatest(F.lit(2), F.least(F.lit(folds), F.min("_n"))).cast("int").alias("_folds"))
    turn = placed(rows.withColumn("_hash", F.xxhash64(F.lit(seed), order)), [*keys, label], "_hash", [order])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return turn.join(F.broadcast(sizes), on).select(*rows.columns, F.pmod("place", "_folds").cast("int").alias("fold"))  # sizes: a row per key


def state_sensitivity(angles: DataFrame, active: str, folds: int = 5, most: int = 5000, circular: bool = False) -> DataFrame:
    """site, n, dimension, score (N1, E15, M14): how well each site's angles tell rows with `active` = 1 from the rest. Best first; no
    score counts 0.

    score is 2 * (AUC - 0.5), at least 0, over all rows, each scored by the regression of the other folds; n and dimension are of all
    rows too. Only the regressions, one a site and fold, are fitted on at most `most` evenly spread rows of a site. Folds follow the
    frame, so results do not vary; a site with a class of under two rows has no score.
    """
    values = F.concat(F.transform("angles", F.cos), F.transform("angles", F.sin)) if circular else F.col("angles")
    plain = angles.select("site", "frame_index", values.alias("angles"), F.col(active).cast("int").alias("y"))
    rows = kept(stratified_folds(plain, ["site"], "y", "frame_index", folds), "folds")
    kind = angles.schema["site"].dataType.simpleString()

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = np.array(pdf["angles"].tolist(), float), pdf["y"].to_numpy()
        out = []
        for f in sorted(set(pdf["fold"])):
            train = (pdf["fold"] != f).to_numpy()
            if 0 < y[train].sum() < train.sum():
                mean, std, w = logistic(x[train], y[train])
                out.append((pdf["site"].iloc[0], f, mean.tolist(), std.tolist(), w.tolist()))
        return pd.DataFrame(out, columns=["site", "fold", "mean", "std", "w"])

    models = evenly_spread(rows, "site", "frame_index", most).groupBy("site").applyInPandas(fit, f"site {kind}, fold int, mean array<double>, std array<double>, w array<double>")
    scaled = F.zip_with(F.zip_with("angles", "mean", lambda a, m: a - m), "std", lambda a, d: a / d)
    score = F.aggregate(F.zip_with(scaled, F.slice("w", 1, F.size("w") - 1), lambda a, w: a * w), F.element_at("w", -1), lambda s, x: s + x)
    scored = rows.join(F.broadcast(models), ["site", "fold"]).select("site", "y", score.alias("score"))  # models: a row per site and fold
    told = auc(scored, ["site"], "score", "y").select("site", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * (F.col("auc") - 0.5))).alias("score"))
    enough = rows.groupBy("site").agg((F.least(F.sum("y"), F.count(F.lit(1)) - F.sum("y")) >= 2).alias("enough"))
    out = site_dimensions(rows).join(told, "site", "left").join(enough, "site").select("site", "n", "dimension", F.when(F.col("enough"), F.col("score")).alias("score"))
    return out.orderBy(F.desc(F.coalesce(F.nanvl("score", F.lit(0.0)), F.lit(0.0))), "site")


def silhouette(centres: np.ndarray, labels: np.ndarray) -> float:
    """The mean silhouette of a few points; of a point alone in its cluster 0."""
    d = np.sqrt(((centres[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2))
    names, out = np.unique(labels), []
    for i, own in enumerate(labels):
        inside = labels == own
        if inside.sum() < 2:
            out.append(0.0)
            continue
        a = d[i, inside].sum() / (inside.sum() - 1)
        b = min(d[i, labels == c].mean() for c in names if c != own)
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(out))


def chosen_states(micro: DataFrame, values: str, least: int = 1, most: int = 4, seed: int = 0) -> tuple[int, dict[int, float]]:
    """How many macro states the centres of micro states fall into, by silhouette (C11): (best number, score of each). One state scores 0.

    `micro`: micro and an array column; means are made in Spark, a row per micro state.
    """
    long = micro.select("micro", F.posexplode(values).alias("dim", "x")).groupBy("micro", "dim").agg(F.avg("x").alias("x"))
    rows = long.groupBy("micro").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("c")).orderBy("micro").select("c.x")
    centres = np.array([r["x"] for r in rows.collect()], float)  # a row per micro state
    found = micro.sparkSession.createDataFrame([(c.tolist(),) for c in centres], "c array<double>")
    scores = {}
    for k in range(least, min(most, len(centres)) + 1):
        labels = np.array([r["micro"] for r in microstates(found, "c", k, seed).collect()]) if k > 1 else np.zeros(len(centres), int)
        scores[k] = 0.0 if k == 1 else silhouette(centres, labels) if len(set(labels.tolist())) > 1 else float("-inf")
    return max(scores, key=lambda k: (scores[k], -k)), scores

"""Kinetics of trajectories: lagged moments, slow coordinates, microstates and how many states they fall into, transition matrices.

A trajectory is the rows of a key in an order. Orders are dealt by ranges, so one trajectory with most of the rows is many tasks; pairs
of rows that lie in two tasks meet through the few rows at the borders. What reaches the driver is of the size of a vector squared,
of the centres, or of a transition matrix whose states are bounded by a parameter.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motley.operators.clustering import silhouette
from motley.operators.ordered import placed
from motley.sources.tables import kept

#: Directions with under this share of the greatest variance do not count.
RANK = 1e-10
SUMS, HEAD, TAIL = range(3)


def sound(values: str) -> Column:
    """Whether an array is there and all of it is finite."""
    return F.col(values).isNotNull() & (F.size(values) > 0) & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))


class Moments(NamedTuple):
    """Sums over pairs (x, y) of rows a lag apart."""

    n: float
    x: np.ndarray
    y: np.ndarray
    xx: np.ndarray
    yy: np.ndarray
    xy: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray) -> Moments:
        return cls(float(len(x)), x.sum(0), y.sum(0), x.T @ x, y.T @ y, x.T @ y)

    def flat(self) -> np.ndarray:
        return np.concatenate([np.ravel(v) for v in self])

    @classmethod
    def unflat(cls, flat: np.ndarray) -> Moments:
        w = int((np.sqrt(1 + 3 * (len(flat) - 1)) - 1) / 3)
        parts = np.split(flat[1:], np.cumsum([w, w, w * w, w * w]))
        return cls(float(flat[0]), parts[0], parts[1], *(p.reshape(w, w) for p in parts[2:]))


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _whole(column: pa.Array, width: int) -> np.ndarray:
    """Which arrays have that many numbers."""
    return np.flatnonzero(pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == width)


def lagged_moments(df: DataFrame, keys: list[str], order: str, values: str, lag: int) -> Moments | None:
    """Sums over all pairs of rows `lag` apart within a key, of an array column of one length (C9, W12). None if there is no pair.

    Rows whose array is null, empty or not finite are left out, and their neighbours follow each other. `order` tells the rows
    of a key apart. A task holds a batch and `lag` rows; of each range of rows the first and last `lag` go on to meet those of others.
    """
    if lag < 1:
        raise ValueError("a lag of one row at least is needed")
    rows = df.where(sound(values) & F.col(order).isNotNull()).select(F.to_json(F.struct(*keys)).alias("key"), F.col(order).alias("at"), F.transform(values, lambda x: x.cast("double")).alias("v"))
    dealt = rows.repartitionByRange("key", "at").sortWithinPartitions("key", "at").withColumn("part", F.spark_partition_id())
    border = "kind int, part int, key string, place long, n long, v array<double>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part, first, held, heads, n, key = None, 0, True, None, None, 0, None

        def rows_out(kind: int, place: int, block: np.ndarray) -> pa.RecordBatch:
            m = len(block)
            offsets = pa.array(np.arange(m + 1, dtype="i4") * block.shape[1])
            return pa.RecordBatch.from_arrays([pa.array([kind] * m, pa.int32()), pa.array([part] * m, pa.int32()), pa.array([key] * m, pa.string()), pa.array(place + np.arange(m)), pa.array([n] * m, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(block.ravel()))], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            named, block = np.array(batch.column("key").to_pylist(), object), _rows(batch.column("v"))
            cuts = [0, *(np.flatnonzero(named[1:] != named[:-1]) + 1).tolist(), len(named)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if key != named[a] or held is None:
                    if held is not None and first:
                        yield rows_out(HEAD, 0, heads)
                        first = False
                    key, held, heads, n = named[a], block[:0], block[:0], 0
                z = np.concatenate((held, block[a:b]))
                if len(z) > lag:
                    own = Moments.of(z[:-lag], z[lag:]).flat()
                    total = own if total is None else total + own
                if len(heads) < lag:
                    heads = np.concatenate((heads, block[a:b][: lag - len(heads)]))
                held, n = z[-lag:].copy(), n + b - a
        if held is not None:
            if first:
                yield rows_out(HEAD, 0, heads)
            yield rows_out(TAIL, n - len(held), held)
        if total is not None:
            yield rows_out(SUMS, 0, total[None])

    names = [x.split()[0] for x in border.split(", ")]
    found = kept(dealt.mapInArrow(work, border), "moments")
    # the rows of a key in earlier ranges: at most two keys of a range are here
    runs = found.where(F.col("kind") != SUMS).select("part", "key", "n").distinct()
    offset = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("part", "key", offset.alias("offset"))
    placed = found.where(F.col("kind") != SUMS).join(runs, ["part", "key"])
    side = lambda kind, shift, name: placed.where(F.col("kind") == kind).select("key", (F.col("offset") + F.col("place") + shift).alias("at"), F.col("part").alias(f"part_{name}"), F.col("v").alias(name))
    across = side(TAIL, lag, "x").join(side(HEAD, 0, "y"), ["key", "at"]).where("part_x < part_y").select("x", "y")

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([Moments.of(_rows(batch.column("x")), _rows(batch.column("y"))).flat().tolist()], pa.list_(pa.float64()))], ["v"])

    parts = found.where(F.col("kind") == SUMS).select("v").unionByName(across.mapInArrow(crossed, "v array<double>"))
    # added up in an order of their own, a number a range: the last digits do not depend on which task ends first
    in_order = F.aggregate(F.array_sort(F.collect_list("v")), F.lit(0.0), lambda s, x: s + x)
    summed = parts.select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(in_order.alias("v")).collect()  # of a vector squared
    if not summed:
        return None
    flat = np.zeros(len(summed))
    flat[[r["i"] for r in summed]] = [r["v"] for r in summed]
    return Moments.unflat(flat)


def _whitener(c: np.ndarray) -> np.ndarray:
    """Columns that make the covariance the identity on the directions that vary."""
    s, u = np.linalg.eigh((c + c.T) / 2)
    some = s > RANK * max(s.max(), 1e-300)
    return u[:, some] / np.sqrt(s[some])


class Slow(NamedTuple):
    """Slow coordinates: (x - mean) @ components; values are autocorrelations (TICA) or singular values (VAMP)."""

    mean: np.ndarray
    components: np.ndarray
    values: np.ndarray

    def first(self, dims: int | float, scaled: bool = False) -> Slow:
        """The first `dims` of them, or as many as hold that share (under 1) of the kinetic variance; scaled: times their value."""
        if isinstance(dims, float) and dims < 1:
            share = np.cumsum(self.values**2) / max(float((self.values**2).sum()), 1e-300)
            dims = int(np.searchsorted(share, dims - 1e-12)) + 1
        n = int(min(dims, len(self.values)))
        return Slow(self.mean, self.components[:, :n] * (self.values[:n] if scaled else 1.0), self.values[:n])


def tica(m: Moments) -> Slow:
    """Time-lagged independent components, the slowest first: both directions of time count alike."""
    mean = (m.x + m.y) / (2 * m.n)
    white = _whitener((m.xx + m.yy) / (2 * m.n) - np.outer(mean, mean))
    values, vectors = np.linalg.eigh(white.T @ ((m.xy + m.xy.T) / (2 * m.n) - np.outer(mean, mean)) @ white)
    order = np.argsort(-values)
    return _signed(Slow(mean, white @ vectors[:, order], values[order]))


def vamp(m: Moments) -> tuple[Slow, Slow, float]:
    """Left and right singular functions of the whitened lagged covariance, and the VAMP-2 score, the constant included."""
    x, y = m.x / m.n, m.y / m.n
    left, right = _whitener(m.xx / m.n - np.outer(x, x)), _whitener(m.yy / m.n - np.outer(y, y))
    u, s, v = np.linalg.svd(left.T @ (m.xy / m.n - np.outer(x, y)) @ right, full_matrices=False)
    return Slow(x, left @ u, s), Slow(y, right @ v.T, s), 1.0 + float((s * s).sum())


def _signed(found: Slow) -> Slow:
    """Components whose greatest part is positive."""
    top = found.components[np.abs(found.components).argmax(axis=0), np.arange(found.components.shape[1])]
    return found._replace(components=found.components * np.where(top < 0, -1.0, 1.0))


def projected(df: DataFrame, values: str, slow: Slow, name: str = "slow") -> DataFrame:
    """df with its rows' slow coordinates, null where the array is null, not finite or of another length."""

    @F.arrow_udf("array<double>")
    def project(x: pa.Array) -> pa.Array:
        whole = _whole(x, len(slow.mean))
        z = (_rows(x.take(pa.array(whole))).reshape(len(whole), len(slow.mean)) - slow.mean) @ slow.components
        found = np.isfinite(z).all(axis=1)
        n, gone = np.zeros(len(x) + 1, np.int32), np.ones(len(x), bool)
        n[whole[found] + 1], gone[whole[found]] = z.shape[1], False
        return pa.ListArray.from_arrays(pa.array(np.cumsum(n, dtype=np.int32)), pa.array(z[found].ravel()), mask=pa.array(gone))

    return df.withColumn(name, project(F.when(sound(values), F.transform(values, lambda v: v.cast("double")))))


def first_centres(df: DataFrame, values: str, most: int, seed: int = 0, sample: int = 2000) -> np.ndarray:
    """Up to `most` different points far apart, of at most `sample` rows of the least hashes: each next one is the farthest from those before."""
    rows = df.where(sound(values)).select(F.transform(values, lambda x: x.cast("double")).alias("v")).withColumn("at", F.xxhash64(F.lit(seed), "v")).distinct().orderBy("at", "v").limit(sample)
    points = np.array([r["v"] for r in rows.select("v").collect()], float)  # at most `sample`
    if not len(points):
        return points.reshape(0, 0)
    found, far = [0], ((points - points[0]) ** 2).sum(1)
    while len(found) < most and far.max() > 0:
        found.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[found[-1]]) ** 2).sum(1))
    return points[found]


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)).argmin(axis=1)


def centres_of(df: DataFrame, values: str, sizes: list[int], seed: int = 0, rounds: int = 30) -> dict[int, np.ndarray]:
    """For each number of clusters its k-means centres (C10); all numbers move together, a pass over the rows a round.

    Each begins with the first of the same centres, far apart; a cluster without rows keeps its centre. A pass gives the driver
    a sum per centre. Ends once no centre moves, or after `rounds`.
    """
    begin = first_centres(df, values, max(sizes), seed)
    now = {k: begin[:k].copy() for k in sizes if 0 < k <= len(begin)}
    rows = df.where(sound(values)).select(F.transform(values, lambda x: x.cast("double")).alias("v"))
    for _ in range(rounds if now else 0):

        def part(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total = {k: np.zeros((k, c.shape[1] + 1)) for k, c in now.items()}
            for batch in batches:
                x = _rows(batch.column("v"))
                for k, c in now.items() if len(x) else ():
                    at = _nearest(x, c)
                    for j in range(k):
                        own = x[at == j]
                        total[k][j, 0] += len(own)
                        total[k][j, 1:] += own.sum(0)
            out = [(k, j, t) for k, sums in total.items() for j, t in enumerate(sums.tolist()) if t[0]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.list_(pa.float64())), strict=True)], ["k", "j", "v"])

        sums = rows.mapInArrow(part, "k int, j int, v array<double>").select("k", "j", F.posexplode("v").alias("i", "v")).groupBy("k", "j", "i").agg(F.sum("v").alias("v"))
        total = {k: np.zeros((k, c.shape[1] + 1)) for k, c in now.items()}
        for r in sums.collect():  # a number per component of each centre
            total[r["k"]][r["j"], r["i"]] = r["v"]
        new = {k: np.where(t[:, :1] > 0, t[:, 1:] / np.maximum(t[:, :1], 1), now[k]) for k, t in total.items()}
        moved = max(float(np.abs(new[k] - now[k]).max()) for k in now)
        now = new
        if moved < 1e-9:
            break
    return now


def assigned(df: DataFrame, values: str, centres: np.ndarray, name: str = "micro") -> DataFrame:
    """df with the nearest centre's number, null where the array is none of the centres' kind."""

    @F.arrow_udf("int")
    def near(x: pa.Array) -> pa.Array:
        out, whole = np.full(len(x), -1, np.int32), _whole(x, centres.shape[1])
        if len(whole):
            out[whole] = _nearest(_rows(x.take(pa.array(whole))), centres)
        return pa.array(out, mask=out < 0)

    return df.withColumn(name, near(F.when(sound(values), F.transform(values, lambda v: v.cast("double")))))


def silhouettes(df: DataFrame, values: str, centres: dict[int, np.ndarray]) -> DataFrame:
    """k, n, score: the mean silhouette of all rows by squared distances, for each number of clusters (C11).

    A row's mean squared distance to a cluster follows from the cluster's rows, sum and sum of squares, so no pair of rows is made.
    One cluster scores 0, and so does a row alone in its cluster.
    """
    rows = df.where(sound(values)).select(F.transform(values, lambda x: x.cast("double")).alias("v"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros((k, c.shape[1] + 2)) for k, c in centres.items()}
        for batch in batches:
            x = _rows(batch.column("v"))
            for k, c in centres.items() if len(x) else ():
                wide = np.column_stack((np.ones(len(x)), (x * x).sum(1), x))
                np.add.at(total[k], _nearest(x, c), wide)
        out = [(k, j, t) for k, s in total.items() for j, t in enumerate(s.tolist())]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.list_(pa.float64())), strict=True)], ["k", "j", "v"])

    summed = rows.mapInArrow(sums, "k int, j int, v array<double>").select("k", "j", F.posexplode("v").alias("i", "v")).groupBy("k", "j", "i").agg(F.sum("v").alias("v"))
    known = {k: np.zeros((k, c.shape[1] + 2)) for k, c in centres.items()}
    for r in summed.collect():  # a number per component of each centre
        known[r["k"]][r["j"], r["i"]] = r["v"]

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: [0, 0.0] for k in known}
        for batch in batches:
            x = _rows(batch.column("v"))
            for k, stats in known.items() if len(x) else ():
                n, at = stats[:, 0], _nearest(x, centres[k])
                far = (x * x).sum(1)[:, None] * n + stats[:, 1] - 2 * x @ stats[:, 2:].T  # sums of squared distances
                own, alone = n[at], np.arange(len(x))
                a = far[alone, at] / np.maximum(own - 1, 1)
                mean = np.where(n > 0, far / np.maximum(n, 1), np.inf)
                mean[alone, at] = np.inf
                b = mean.min(axis=1)
                good = (own > 1) & np.isfinite(b)
                top = np.maximum(a, np.where(good, b, 1.0))
                total[k][0] += len(x)
                total[k][1] += float(np.where(good & (top > 0), (np.where(good, b, 0.0) - a) / np.where(top > 0, top, 1.0), 0.0).sum())
        yield pa.RecordBatch.from_arrays([pa.array([*total], pa.int32()), pa.array([t[0] for t in total.values()], pa.int64()), pa.array([t[1] for t in total.values()])], ["k", "n", "v"])

    out = rows.mapInArrow(scores, "k int, n long, v double").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).where("n > 0")
    return out.select("k", "n", F.when(F.col("k") > 1, F.col("v") / F.col("n")).otherwise(0.0).alias("score"))


def best_size(scores: DataFrame) -> int:
    """The number of clusters of the best score, of equal ones the smallest."""
    return max((r["score"], -r["k"]) for r in scores.collect())[1] * -1  # a row per number


def transition_counts(df: DataFrame, keys: list[str], order: str, state: str, lag: int) -> DataFrame:
    """a, b, n: how often state b comes `lag` rows after a within a key (C12, W12); rows without a state are left out first.

    Rows are numbered within their key by ranges, and meet by number, so a key of most rows is many tasks.
    """
    rows = kept(placed(df.where(F.col(state).isNotNull()).select(*keys, order, F.col(state).alias("a")), keys, order, []).drop("place_all"), "placed")
    after = rows.select(*[F.col(k).alias(f"_{k}") for k in keys], (F.col("place") - lag).alias("_place"), F.col("a").alias("b"))
    on = F.col("place") == F.col("_place")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(after, on).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def reversible(counts: DataFrame, tolerance: float = 1e-13, rounds: int = 200_000, most: int = 4_000_000) -> DataFrame:
    """a, b, n, p, chance: the reversible transition matrix p of most likelihood for counts (a, b, n), and a's stationary chance.

    The fixed point x_ab = (n_ab + n_ba) / (c_a / x_a + c_b / x_b) over the pairs that occur, x_a the sum of x_ab and c_a that of n_ab. What
    moves is a number per state, over the pairs only; their table follows the states and not the rows: more than `most` pairs are an
    error, as is a matrix that does not settle. p has the pairs that occur in either direction; chances are of the whole table, so
    states that no pairs join keep their share of it.
    """
    named = counts.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    back = named.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(0).cast("long").alias("n"), F.col("n").alias("s"))
    both = named.select("a", "b", "n", F.col("n").alias("s")).unionByName(back).groupBy("a", "b").agg(F.sum("n").cast("long").alias("n"), F.sum("s").cast("double").alias("s"))
    found = both.limit(most + 1).toPandas()  # `most` pairs
    if len(found) > most:
        raise ValueError(f"more than {most} pairs of states")
    states, at = np.unique(np.concatenate((found["a"], found["b"])), return_inverse=True) if len(found) else (np.zeros(0), np.zeros(0, int))
    i, j, s, m = at[: len(found)], at[len(found) :], found["s"].to_numpy(float), len(states)
    c, x = np.bincount(i, found["n"], m), np.bincount(i, s, m)
    for _ in range(rounds):
        q = c / x
        pair = s / (q[i] + q[j])
        now = np.bincount(i, pair, m)
        moved, x = np.abs(now / x - 1).max(initial=0.0), now
        if moved < tolerance:
            break
    else:
        raise RuntimeError(f"the transition matrix did not settle in {rounds} rounds")
    out = pd.DataFrame({"a": found["a"], "b": found["b"], "n": found["n"], "p": pair / x[i], "chance": x[i] / max(x.sum(), 1e-300)})
    kind = both.schema["a"].dataType.simpleString()
    return counts.sparkSession.createDataFrame(out, f"a {kind}, b {kind}, n long, p double, chance double")


def matrix_of(transitions: DataFrame, most: int = 2000) -> tuple[list, np.ndarray, np.ndarray]:
    """The states, in order, the matrix and the stationary chances of at most `most` states; more are an error."""
    rows = transitions.select("a", "b", "p", "chance")
    if rows.select("a").distinct().count() > most:
        raise ValueError(f"a dense matrix of more than {most} states")
    found = rows.collect()  # `most` squared
    states = sorted({r["a"] for r in found})
    at = {s: i for i, s in enumerate(states)}
    p, chance = np.zeros((len(states),) * 2), np.zeros(len(states))
    for r in found:
        p[at[r["a"]], at[r["b"]]], chance[at[r["a"]]] = r["p"], r["chance"]
    return states, p, chance


def slow_processes(p: np.ndarray, chance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, the greatest first, and right eigenvectors of a reversible matrix, orthogonal under its stationary chances."""
    root = np.sqrt(np.maximum(chance, 1e-300))
    values, vectors = np.linalg.eigh((lambda s: (s + s.T) / 2)(root[:, None] * p / root))
    order = np.argsort(-values)
    return values[order], vectors[:, order] / root[:, None]


def states_by_gap(values: np.ndarray, least: int, most: int) -> tuple[int, dict[int, float]]:
    """The number of states from `least` to `most` after which the eigenvalues fall the most, and the falls."""
    most = min(most, len(values) - 1)
    if most < least:
        raise ValueError("too few eigenvalues for that many states")
    falls = {k: float(values[k - 1] - values[k]) for k in range(least, most + 1)}
    return max(falls, key=lambda k: (falls[k], -k)), falls


def memberships(p: np.ndarray, chance: np.ndarray, k: int, rounds: int = 200) -> np.ndarray:
    """How far each state belongs to each of k macrostates (PCCA+): states by k, rows sum to 1, none negative.

    Memberships are a linear map of the k slowest eigenvectors. It begins with the corners of the simplex that these span and is
    moved, by pattern search over its free part, to the crispest one.
    """
    if not 1 <= k <= len(p):
        raise ValueError("as many macrostates as states at most")
    x = slow_processes(p, chance)[1][:, :k].copy()
    x[:, 0] = 1.0
    if k == 1:
        return x

    corners, rest = [int((x[:, 1:] ** 2).sum(1).argmax())], x[:, 1:] - x[(x[:, 1:] ** 2).sum(1).argmax(), 1:]
    for _ in range(1, k):
        corners.append(int((rest * rest).sum(1).argmax()))
        axis = rest[corners[-1]] / max(float(np.linalg.norm(rest[corners[-1]])), 1e-300)
        rest = rest - np.outer(rest @ axis, axis)
    begin = np.linalg.pinv(x[corners])

    def whole(free: np.ndarray) -> np.ndarray:
        """The map whose part below the first row and beside the first column is given: rows of memberships sum to 1, the least is 0."""
        a = np.zeros((k, k))
        a[1:, 1:] = free.reshape(k - 1, k - 1)
        a[1:, 0] = -a[1:, 1:].sum(1)
        a[0] = -(x[:, 1:] @ a[1:]).min(0)
        return a / a[0].sum()

    def crispness(free: np.ndarray) -> float:
        a = whole(free)
        return float((a * a / np.maximum(a[0], 1e-300)).sum()) if np.isfinite(a).all() else -np.inf

    now, size = begin[1:, 1:].ravel().copy(), 0.1
    best = crispness(now)
    for _ in range(rounds):
        before = best
        for i in range(len(now)):
            for sign in (1.0, -1.0):
                tried = now.copy()
                tried[i] += sign * size * max(abs(now[i]), 1e-3)
                if (score := crispness(tried)) > best:
                    now, best = tried, score
                    break
        if best - before < 1e-12:
            size /= 2
            if size < 1e-7:
                break
    return np.clip(x @ whole(now), 0.0, 1.0)


class Metastable(NamedTuple):
    """What `metastable` found: rows with micro and macro, the slow coordinates, centres of microstates, macro of each, score of each number."""

    rows: DataFrame
    slow: Slow
    centres: np.ndarray
    macro: np.ndarray
    scores: dict[int, float]


def metastable(df: DataFrame, keys: list[str], order: str, values: str, lag: int = 5, dims: int = 5, micro: int = 20, least: int = 1, most: int = 4, seed: int = 0) -> Metastable:
    """df with slow, micro and macro: slow coordinates, k-means microstates of them, and these by k-means of their centres.

    The number of macrostates has the best silhouette of the centres; one scores 0, of equal scores the smallest number wins.
    """
    moments = lagged_moments(df, keys, order, values, lag)
    if moments is None:
        raise ValueError(f"no two rows of a trajectory are {lag} apart")
    slow = tica(moments).first(dims)
    rows = kept(projected(df, values, slow), "slow")  # the passes of k-means read it: one Python worker a task, not one a step
    centres = centres_of(rows, "slow", [micro], seed)
    centres = next(iter(centres.values())) if centres else first_centres(rows, "slow", micro, seed)  # fewer different rows than microstates
    small = df.sparkSession.createDataFrame([(c.tolist(),) for c in centres], "c array<double>")  # a row per microstate
    groups = {k: _nearest(centres, c) for k, c in centres_of(small, "c", [*range(least, min(most, len(centres)) + 1)], seed).items()}
    scores = {k: 0.0 if k == 1 else silhouette(centres, g) if len(set(g.tolist())) > 1 else float("-inf") for k, g in groups.items()}
    macro = groups[max(scores, key=lambda k: (scores[k], -k))]
    named = F.get(F.array(*[F.lit(int(x)) for x in macro]), F.col("micro"))
    return Metastable(assigned(rows, "slow", centres).withColumn("macro", named), slow, centres, macro, scores)

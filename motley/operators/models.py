"""Pairwise energy models: h (site, k, value) and J (r, s, k, l, value; r < s), as two tables.

Models are small whatever the number of frames: as many rows as sites and edges have labels. Scoring frames takes them
as one constant, so a frame's energy needs neither a join nor a shuffle.
"""

from __future__ import annotations

import json
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motley.operators.distributions import counted_frames, joints, marginals
from motley.sources.tables import kept

FIT_EPS = 1e-8
#: Of a model that goes to every task.
MODEL_BYTES = 256 << 20
#: Numbers looked up at once.
CELLS = 1 << 21


class Model(NamedTuple):
    h: DataFrame
    j: DataFrame


class Arrays(NamedTuple):
    """A model on the driver."""

    h: list[np.ndarray]
    j: dict[tuple[int, int], np.ndarray]


def arrays(model: Model) -> Arrays:
    rows, pairs = model.h.collect(), model.j.collect()  # a row per label
    sizes = [0] * (max((r["site"] for r in rows), default=-1) + 1)
    for r in rows:
        sizes[r["site"]] = max(sizes[r["site"]], r["k"] + 1)
    h, j = [np.zeros(k) for k in sizes], {}
    for r in rows:
        h[r["site"]][r["k"]] = r["value"]
    for r in pairs:
        j.setdefault((r["r"], r["s"]), np.zeros((sizes[r["r"]], sizes[r["s"]])))[r["k"], r["l"]] = r["value"]
    return Arrays(h, dict(sorted(j.items())))


def tables(spark, model: Arrays) -> Model:
    h = [(i, k, float(x)) for i, v in enumerate(model.h) for k, x in enumerate(v)]
    j = [(r, s, k, m, float(x)) for (r, s), v in model.j.items() for (k, m), x in np.ndenumerate(v)]
    return Model(spark.createDataFrame(h, "site int, k int, value double"), spark.createDataFrame(j, "r int, s int, k int, l int, value double"))


def _sound(x: pa.Array, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have as many labels as there are sites, and their labels; -1 where one is missing or out of range."""
    whole = np.flatnonzero(pc.fill_null(pc.list_value_length(x), -1).to_numpy(zero_copy_only=False) == len(sizes))
    flat = pc.fill_null((x if len(whole) == len(x) else x.take(pa.array(whole))).flatten(), -1).to_numpy(zero_copy_only=False)
    found = flat.reshape(len(whole), len(sizes))
    return whole, np.where((found >= 0) & (found < sizes), found, -1).astype(np.int64)


def energy(labels: Column, model: Arrays) -> Column:
    """h and J of a frame's labels, summed (E1, J2); null where the labels are not as many as the sites, or one is missing or out of range.

    The numbers go to the tasks packed in two vectors; a model of more than MODEL_BYTES is an error. A task adds up the edges of some
    rows at a time.
    """
    sizes = np.array([len(x) for x in model.h], np.int64)
    fields, starts = np.concatenate([*model.h, np.zeros(0)]), np.cumsum(sizes) - sizes
    left, right = (np.array([e[c] for e in model.j], np.int64) for c in (0, 1))
    couplings = np.concatenate([*(v.ravel() for v in model.j.values()), np.zeros(0)])
    width = np.array([v.shape[1] for v in model.j.values()], np.int64)
    cells = np.array([v.size for v in model.j.values()], np.int64)
    begin = np.cumsum(cells) - cells
    if fields.nbytes + couplings.nbytes > MODEL_BYTES:
        raise ValueError(f"a model of {fields.nbytes + couplings.nbytes} bytes, {MODEL_BYTES} at most")

    @F.arrow_udf("double")
    def total(x: pa.Array) -> pa.Array:
        out = np.full(len(x), np.nan)
        whole, found = _sound(x, sizes)
        good = (found >= 0).all(axis=1)
        whole, found = whole[good], found[good]
        step = max(1, CELLS // max(1, len(left)))
        for i in range(0, len(whole), step):
            z = found[i : i + step]
            out[whole[i : i + step]] = fields[starts + z].sum(axis=1) + couplings[begin + z[:, left] * width + z[:, right]].sum(axis=1)
        return pa.array(out, mask=np.isnan(out))

    return total(labels)


def zero_sum(model: Model) -> Model:
    """The same energies but for a constant, with J of zero row and column sums and h of zero sum."""
    mean = lambda *by: model.j.groupBy("r", "s", *by).agg(F.avg("value").alias("_".join(("m", *by))))
    j = model.j.join(mean("k"), ["r", "s", "k"]).join(mean("l"), ["r", "s", "l"]).join(mean(), ["r", "s"])
    j = j.select("r", "s", "k", "l", (F.col("value") - F.col("m_k") - F.col("m_l") + F.col("m")).alias("value"), (F.col("m_k") - F.col("m") / 2).alias("to_r"), (F.col("m_l") - F.col("m") / 2).alias("to_s"))
    given = j.groupBy("r", "s", "k").agg(F.first("to_r").alias("v")).select(F.col("r").alias("site"), "k", "v").unionByName(j.groupBy("r", "s", "l").agg(F.first("to_s").alias("v")).select(F.col("s").alias("site"), F.col("l").alias("k"), "v"))
    h = model.h.select("site", "k", F.col("value").alias("v")).unionByName(given).groupBy("site", "k").agg(F.sum("v").alias("v"))
    centre = h.groupBy("site").agg(F.avg("v").alias("m"))
    return Model(h.join(centre, "site").select("site", "k", (F.col("v") - F.col("m")).alias("value")), j.select("r", "s", "k", "l", "value"))


def fit_pmi(frames: DataFrame, sizes: list[int], edges: list[tuple[int, int]], n: str | None = None) -> Model:
    """h = -ln p, centred by site; J = -ln of the pointwise mutual information, centred by edge (E3). Frames that are no stored
    table of counted ones (`n` times each) are made one: they are read once, and a different frame is taken apart once."""
    one = (frames if n else kept(counted_frames(frames), "counted")).withColumn("_all", F.lit(0))
    p = kept(marginals(one, sizes, "_all", n or "n").drop("_all"), "marginals")  # of the size of the model, as are the joints
    raw = p.withColumn("v", -F.ln(F.col("p") + FIT_EPS))
    h = raw.join(raw.groupBy("site").agg(F.avg("v").alias("m")), "site").select("site", F.col("label").alias("k"), (F.col("v") - F.col("m")).alias("value"))
    pr = p.select(F.col("site").alias("r"), F.col("label").alias("k"), F.col("p").alias("pr"))
    ps = p.select(F.col("site").alias("s"), F.col("label").alias("l"), F.col("p").alias("ps"))
    pair = kept(joints(one, sizes, edges, "_all", n or "n").drop("_all"), "joints").join(pr, ["r", "k"]).join(ps, ["s", "l"])
    raw = pair.withColumn("v", -F.ln(F.col("p") / (F.col("pr") * F.col("ps") + FIT_EPS) + FIT_EPS))
    j = raw.join(raw.groupBy("r", "s").agg(F.avg("v").alias("m")), ["r", "s"]).select("r", "s", "k", "l", (F.col("v") - F.col("m")).alias("value"))
    return Model(h, j)


def blended(a: Model, b: Model, weight_a: float, weight_b: float, shared_only: bool = False) -> Model:
    """weight_a * a + weight_b * b: interpolation (1 - x, x), sum (1, 1), difference (1, -1).

    A parameter that one model lacks counts 0, or is left out with shared_only.
    """
    how = "inner" if shared_only else "full"

    def mix(x: DataFrame, y: DataFrame, keys: list[str]) -> DataFrame:
        both = x.withColumnRenamed("value", "_a").join(y.withColumnRenamed("value", "_b"), keys, how)
        return both.select(*keys, (F.lit(weight_a) * F.coalesce("_a", F.lit(0.0)) + F.lit(weight_b) * F.coalesce("_b", F.lit(0.0))).alias("value"))

    return Model(mix(a.h, b.h, ["site", "k"]), mix(a.j, b.j, ["r", "s", "k", "l"]))


def penalised(model: Model, penalties: DataFrame, strength: float) -> Model:
    """h plus strength * weight * value of `penalties` (site, k, weight, value); others stay."""
    added = penalties.select("site", "k", (F.lit(strength) * F.col("weight") * F.col("value")).alias("_add"))
    return Model(model.h.join(added, ["site", "k"], "left").select("site", "k", (F.col("value") + F.coalesce("_add", F.lit(0.0))).alias("value")), model.j)


def norms(model: Model) -> tuple[DataFrame, DataFrame]:
    """(site, norm) and (r, s, norm): root of the sum of squares."""
    root = F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm")
    return model.h.groupBy("site").agg(root), model.j.groupBy("r", "s").agg(root)


def one_hot_penalties(model: Model, safety: float = 1.5) -> DataFrame:
    """site, penalty: safety times the greatest part a label can play at the site, at least 1e-6."""
    edge = model.j.groupBy("r", "s").agg(F.max(F.abs("value")).alias("m")).withColumn("site", F.explode(F.array("r", "s")))
    around = edge.groupBy("site").agg(F.sum("m").alias("around"))
    own = model.h.groupBy("site").agg(F.max(F.abs("value")).alias("own"))
    return own.join(around, "site", "left").select("site", (F.lit(safety) * F.greatest(F.lit(1e-6), F.col("own") + F.coalesce("around", F.lit(0.0)))).alias("penalty"))


def qubo(model: Model, beta: float = 1.0, safety: float = 1.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Linear (i, site, k, a), quadratic (i, j, w; i < j) and (offset) of the binary form with one-hot penalties.

    The energy of one-hot bits is beta times the model's; bit i of (site, k) stands after all bits of earlier sites.
    """
    sizes = model.h.groupBy("site").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per site
    counts = {r["site"]: r["n"] for r in sizes}
    before = F.create_map(*[F.lit(x) for s in sorted(counts) for x in (s, sum(n for t, n in counts.items() if t < s))])
    bit = lambda site, k: (before[F.col(site)] + F.col(k)).cast("int")
    penalty = one_hot_penalties(model, safety)
    linear = model.h.join(penalty, "site").select(bit("site", "k").alias("i"), "site", "k", (F.lit(beta) * F.col("value") - F.col("penalty")).alias("a"))
    other = model.h.select("site", F.col("k").alias("k2"))
    same = model.h.join(penalty, "site").join(other, "site").where("k < k2").select(bit("site", "k").alias("i"), bit("site", "k2").alias("j"), (2 * F.col("penalty")).alias("w"))
    pair = model.j.select(bit("r", "k").alias("i"), bit("s", "l").alias("j"), (F.lit(beta) * F.col("value")).alias("w"))
    return linear, same.unionByName(pair), penalty.agg(F.sum("penalty").alias("offset"))


def bits(labels: Column, sizes: list[int]) -> Column:
    """A frame's one-hot bits, site by site."""
    k = F.array(*[F.lit(x) for x in sizes])
    return F.flatten(F.transform(labels, lambda x, i: F.transform(F.sequence(F.lit(0), k[i] - 1), lambda b: (b == x).cast("int"))))


def qubo_energy(bit_array: Column, linear: DataFrame, quadratic: DataFrame, offset: float) -> Column:
    a = [0.0] * linear.count()
    for r in linear.collect():
        a[r["i"]] = r["a"]
    w = [{"i": r["i"], "j": r["j"], "w": r["w"]} for r in quadratic.collect()]
    single = F.aggregate(F.zip_with(bit_array, F.from_json(F.lit(json.dumps(a)), "array<double>"), lambda b, x: b * x), F.lit(float(offset)), lambda s, x: s + x)
    return single + F.aggregate(F.from_json(F.lit(json.dumps(w)), "array<struct<i:int,j:int,w:double>>"), F.lit(0.0), lambda s, e: s + e["w"] * bit_array[e["i"]] * bit_array[e["j"]])


def pseudolikelihood(labels: Column, model: Arrays) -> Column:
    """ln p(label | all others) of each site of a frame (E4): logits are -(h + J of the neighbours). Null at a site that has no label of
    its alphabet, or a neighbour without one; null where the labels are not as many as the sites."""
    sizes = np.array([len(x) for x in model.h], np.int64)
    near = [[(s, m) if r == i else (r, m.T) for (r, s), m in model.j.items() if i in (r, s)] for i in range(len(sizes))]
    widest = max(1, int(sizes.max(initial=1)))

    @F.arrow_udf("array<double>")
    def scores(x: pa.Array) -> pa.Array:
        whole, found = _sound(x, sizes)
        out = np.full(found.shape, np.nan)
        step = max(1, CELLS // widest)
        for begin in range(0, len(found), step):
            z = found[begin : begin + step]
            every = np.arange(len(z))
            for i, h in enumerate(model.h):
                logits, known = np.tile(-np.asarray(h, float), (len(z), 1)), z[:, i] >= 0
                for other, m in near[i]:
                    logits -= m.T[z[:, other]]
                    known = known & (z[:, other] >= 0)
                logits -= logits.max(axis=1, keepdims=True)
                score = logits[every, z[:, i]] - np.log(np.exp(logits).sum(axis=1))
                out[begin : begin + step, i] = np.where(known, score, np.nan)
        n = np.zeros(len(x) + 1, np.int32)
        n[whole + 1] = len(sizes)
        values, offsets = pa.array(out.ravel(), mask=np.isnan(out.ravel())), np.cumsum(n, dtype=np.int32)
        gone = np.ones(len(x), bool)
        gone[whole] = False
        return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array(gone)) if gone.any() else pa.ListArray.from_arrays(pa.array(offsets), values)

    return scores(labels)


def exact_chances(model: Arrays, beta: float = 1.0) -> dict[tuple[int, ...], float]:
    """Boltzmann chances of all configurations; for small models and tests."""
    out = {}
    for x in np.ndindex(*[len(v) for v in model.h]):
        e = sum(float(v[k]) for v, k in zip(model.h, x, strict=True)) + sum(float(m[x[r], x[s]]) for (r, s), m in model.j.items())
        out[x] = math.exp(-beta * e)
    total = sum(out.values())
    return {k: v / total for k, v in out.items()}

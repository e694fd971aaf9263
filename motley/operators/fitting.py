"""Pseudolikelihood fits of pairwise models.

The objective is a sum over frames, so Spark counts equal frames first: what a step reads is a row per different frame
with its count, written once. Each step is a job in which every partition sums its part of the
gradient; only sums, a number per parameter, travel.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motley.operators.distributions import counted_frames
from motley.operators.models import Arrays
from motley.sources.tables import kept


class Settings(NamedTuple):
    steps: int = 200
    rate: float = 0.05
    rate_least: float = 1e-3
    l2: float = 1e-5
    block: float = 1e-3  # group penalty of each J block
    field: float = 0.0  # group penalty of each h


class Layout(NamedTuple):
    sizes: list[int]
    edges: list[tuple[int, int]]

    def unpack(self, theta: np.ndarray) -> Arrays:
        at, h, j = 0, [], {}
        for k in self.sizes:
            h.append(theta[at : at + k])
            at += k
        for r, s in self.edges:
            n = self.sizes[r] * self.sizes[s]
            j[r, s] = theta[at : at + n].reshape(self.sizes[r], self.sizes[s])
            at += n
        return Arrays(h, j)

    def pack(self, model: Arrays) -> np.ndarray:
        return np.concatenate([*model.h, *[model.j[e].ravel() for e in self.edges]])


def _log_chances(layout: Layout, model: Arrays, rows: np.ndarray, i: int) -> np.ndarray:
    """ln p of each label of site i in each frame, given the frame's other sites."""
    logits = np.tile(-model.h[i], (len(rows), 1))
    for e in layout.edges:
        if i in e:
            block, other = (model.j[e], e[1]) if e[0] == i else (model.j[e].T, e[0])
            logits -= block[:, rows[:, other]].T
    logits -= logits.max(axis=1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def loss_and_gradient(layout: Layout, theta: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> tuple[float, np.ndarray]:
    """Sum over frames and sites of -ln p(label | others), and its gradient."""
    model, out = layout.unpack(theta), layout.unpack(np.zeros_like(theta))
    loss, every = 0.0, np.arange(len(rows))
    for i in range(len(layout.sizes)):
        near = [(e, e[1] if e[0] == i else e[0]) for e in layout.edges if i in e]
        logp = _log_chances(layout, model, rows, i)
        loss -= float(counts @ logp[every, rows[:, i]])
        pull = -np.exp(logp)  # d loss / d(h of each label) is the seen share less the expected one
        pull[every, rows[:, i]] += 1
        pull *= counts[:, None]
        out.h[i][:] += pull.sum(axis=0)
        for e, other in near:
            grad = np.zeros((layout.sizes[i], layout.sizes[other]))
            for k in range(layout.sizes[other]):
                grad[:, k] = pull[rows[:, other] == k].sum(axis=0)
            out.j[e][:] += grad if e[0] == i else grad.T
    return loss, layout.pack(out)


def _objective(counted: DataFrame, layout: Layout):
    """(frames, objective of the parameters). `counted`, a stored table, is read at every step."""
    total = counted.agg(F.sum("n")).first()[0]

    def objective(theta: np.ndarray) -> tuple[float, np.ndarray]:
        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros(len(theta) + 1)
            for b in batches:
                loss, grad = loss_and_gradient(layout, theta, np.array(b["labels"].tolist(), int).reshape(len(b), len(layout.sizes)), b["n"].to_numpy(float))
                out += np.concatenate(([loss], grad))
            yield pd.DataFrame({"i": range(len(out)), "v": out})

        sums = {r["i"]: r["v"] for r in counted.mapInPandas(part, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}  # a row per parameter
        flat = np.array([sums[i] for i in range(len(theta) + 1)])
        return flat[0], flat[1:]

    return total, objective


def centred(model: Arrays) -> Arrays:
    """The zero-sum gauge, on the driver."""
    h, j = [v.copy() for v in model.h], {}
    for (r, s), v in model.j.items():
        row, col, mean = v.mean(axis=1), v.mean(axis=0), v.mean()
        j[r, s] = v - row[:, None] - col[None, :] + mean
        h[r] += row - mean / 2
        h[s] += col - mean / 2
    return Arrays([v - v.mean() for v in h], j)


def fit(frames: DataFrame, sizes: list[int], edges: list[tuple[int, int]], settings: Settings = Settings(), base: Arrays | None = None, validation: DataFrame | None = None) -> tuple[Arrays, list[float]]:
    """A model by pseudolikelihood, and the loss of each step (E5); with `base`, what is to be added to that frozen model.

    Adam steps whose rate falls by a cosine; groups (J blocks, fields) shrink towards zero as wholes; each step ends in
    the zero-sum gauge. The parameters of the least loss, on `validation` if given, are returned.
    """
    layout = Layout(sizes, edges)
    frozen = layout.pack(base) if base else 0.0
    counted = kept(counted_frames(frames), "counted")
    total, objective = _objective(counted, layout)
    if not total:
        raise ValueError("no frames to fit")
    other = kept(counted_frames(validation), "held") if validation is not None else None
    held = _objective(other, layout) if other is not None else None
    theta = np.zeros(sum(sizes) + sum(sizes[r] * sizes[s] for r, s in edges))
    m, v, best, losses = np.zeros_like(theta), np.zeros_like(theta), (math.inf, theta), []
    for t in range(1, settings.steps + 1):
        loss, grad = objective(frozen + theta)
        loss, grad = loss / total + settings.l2 * float(theta @ theta), grad / total + 2 * settings.l2 * theta
        losses.append(loss)
        seen = held[1](frozen + theta)[0] / held[0] if held else loss
        if seen < best[0]:
            best = (seen, theta.copy())
        rate = settings.rate_least + (settings.rate - settings.rate_least) * (1 + math.cos(math.pi * t / settings.steps)) / 2
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        model = layout.unpack(theta)
        shrink = lambda x, by: x * max(0.0, 1 - by / max(float(np.linalg.norm(x)), 1e-12))
        model = Arrays([shrink(x, rate * settings.field) for x in model.h], {e: shrink(x, rate * settings.block) for e, x in model.j.items()})
        theta = layout.pack(centred(model))
    return layout.unpack(best[1]), losses


def minimised(objective: Callable[[np.ndarray], tuple[float, np.ndarray]], theta: np.ndarray, tolerance: float, most: int, memory: int = 10) -> tuple[np.ndarray, list[float]]:
    """Where a smooth convex function is least, and its values on the way, by limited-memory quasi-Newton steps; ends once no part of the
    gradient exceeds `tolerance`. A run of `most` evaluations that does not get there is an error."""
    value, grad = objective(theta)
    values, pairs = [value], []
    while np.abs(grad).max(initial=0.0) > tolerance:
        step, kept_ = grad.copy(), []
        for s, y in reversed(pairs):
            a = (s @ step) / (s @ y)
            step -= a * y
            kept_.append(a)
        if pairs:
            s, y = pairs[-1]
            step *= (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(kept_), strict=True):
            step += s * (a - (y @ step) / (s @ y))
        size = 1.0 if pairs else min(1.0, 1.0 / max(float(np.abs(grad).max()), 1e-12))
        while True:
            if len(values) >= most:
                raise RuntimeError(f"no optimum in {most} evaluations; the gradient is at {np.abs(grad).max():.2g}")
            tried = theta - size * step
            new, slope = objective(tried)
            values.append(new)
            if new <= value - 1e-4 * size * float(grad @ step) + 1e-13 * abs(value):
                break
            size /= 2
        s, y = tried - theta, slope - grad
        if s @ y > 1e-18:
            pairs = [*pairs, (s, y)][-memory:]
        theta, value, grad = tried, new, slope
    return theta, values


def _matched_fields(counted: DataFrame, layout: Layout, total: float, model: Arrays, tolerance: float, rounds: int = 60) -> Arrays:
    """The model with fields under which each label is expected as often as it is seen, to within `tolerance`; couplings stay.

    Given the couplings the sites are apart, so a Newton step is one of each site, whose slopes and curvatures a job sums. No field
    moves by more than 2 in a step, for labels that are rare or not seen.
    """
    ends = np.cumsum([k * (k + 1) for k in layout.sizes])
    for _ in range(rounds):

        def part(batches: Iterator[pd.DataFrame], model=model) -> Iterator[pd.DataFrame]:
            out = np.zeros(ends[-1])
            for b in batches:
                rows, counts = np.array(b["labels"].tolist(), int).reshape(len(b), len(layout.sizes)), b["n"].to_numpy(float)
                for i, k in enumerate(layout.sizes):
                    p = np.exp(_log_chances(layout, model, rows, i))
                    slope = np.eye(k)[rows[:, i]] - p
                    out[ends[i] - k * (k + 1) : ends[i]] += np.concatenate((counts @ slope, (np.diag(counts @ p) - (p * counts[:, None]).T @ p).ravel()))
            yield pd.DataFrame({"i": range(len(out)), "v": out})

        flat = np.zeros(ends[-1])
        for r in counted.mapInPandas(part, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # a site's labels squared
            flat[r["i"]] = r["v"] / total
        slopes = [(x[:k], x[k:].reshape(k, k)) for x, k in zip(np.split(flat, ends[:-1]), layout.sizes, strict=True)]
        if max((np.abs(g).max(initial=0.0) for g, _ in slopes), default=0.0) <= tolerance:
            return model
        steps = [np.linalg.lstsq(c + np.ones_like(c) / len(c), g)[0] for g, c in slopes]  # a shift of a site's fields changes nothing
        model = model._replace(h=[h - s * min(1.0, 2 / max(float(np.abs(s).max(initial=0.0)), 1e-300)) for h, s in zip(model.h, steps, strict=True)])
    raise RuntimeError(f"no fields to within {tolerance:.2g} in {rounds} rounds")


def fit_optimum(frames: DataFrame, sizes: list[int], edges: list[tuple[int, int]], l2: float = 1e-6, base: Arrays | None = None, tolerance: float = 1e-7, most: int = 200, exact: float = 1e-13) -> tuple[Arrays, list[float]]:
    """The model of the greatest pseudolikelihood less l2 times its squares, and the loss of each evaluation (E5); with `base`, what is to
    be added to that frozen model (E8). In the zero-sum gauge.

    Different frames are counted once and stored; an evaluation is a job over them, whose sums are of the size of the model. The fields
    are then freed of the penalty, the couplings as they are: the share of each label is what the model expects of it, given the other
    sites, to within `exact`.
    """
    layout = Layout(sizes, edges)
    frozen = layout.pack(base) if base else 0.0
    counted = kept(counted_frames(frames), "counted")
    total, objective = _objective(counted, layout)
    if not total:
        raise ValueError("no frames to fit")

    def loss(theta: np.ndarray) -> tuple[float, np.ndarray]:
        value, grad = objective(frozen + theta)
        return value / total + l2 * float(theta @ theta), grad / total + 2 * l2 * theta

    theta, losses = minimised(loss, np.zeros(sum(sizes) + sum(sizes[r] * sizes[s] for r, s in edges)), tolerance, most)
    whole = _matched_fields(counted, layout, total, layout.unpack(frozen + theta), exact)
    return centred(layout.unpack(layout.pack(whole) - frozen)), losses


def expected_shares(frames: DataFrame, sizes: list[int], edges: list[tuple[int, int]], model: Arrays) -> DataFrame:
    """site, label, p: the mean over all frames of a label's chance given the frame's other sites."""
    layout = Layout(sizes, edges)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, out, n = [np.zeros(k) for k in sizes], np.zeros(sum(sizes)), 0.0
        for b in batches:
            rows, counts = np.array(b["labels"].tolist(), int).reshape(len(b), len(sizes)), b["n"].to_numpy(float)
            for i, k in enumerate(sizes):
                seen[i] += np.bincount(rows[:, i], counts, k)
            out -= loss_and_gradient(layout, layout.pack(model), rows, counts)[1][: sum(sizes)]  # its gradient: seen less expected
            n += counts.sum()
        flat = np.concatenate(seen) + out
        yield pd.DataFrame({"site": np.repeat(np.arange(len(sizes)), sizes), "label": np.concatenate([np.arange(k) for k in sizes]), "v": flat, "n": n})

    sums = counted_frames(frames).mapInPandas(part, "site int, label int, v double, n double").groupBy("site", "label").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    return sums.select("site", "label", (F.col("v") / F.col("n")).alias("p"))


def in_validation(frame_id: Column, share: float, seed: int = 0) -> Column:
    """A split that does not depend on order (E13, T9): by the first 32 bits of a digest of seed and frame."""
    return F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), frame_id.cast("string"))), 1, 8) < F.lit(f"{int(share * (1 << 32)):08x}")

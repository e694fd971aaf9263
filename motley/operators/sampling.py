"""Sampling from pairwise models: chains are rows of a table, and move together, an Arrow batch at a time.

A chain is sequential and small (a configuration), so Spark spreads chains, not sweeps; within a task all chains of a batch make the
same step at once. Every random number is a hash of the chain's seed, the step and the site: a chain gives the same samples
whatever batch or task it is in, and again after an executor is lost. Random streams differ from other programs'.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motley.operators.models import Arrays
from motley.operators.ordered import percentile_rank
from motley.sources.tables import kept

SAMPLES = "chain_index int, draw int, labels array<int>, energy double"
#: Odd multipliers of the hash that random numbers are made of. (fixed values)
MIX_A, MIX_B, STEP = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15


def chains(spark: SparkSession, n: int, seed: int, betas: list[float] | None = None) -> DataFrame:
    """chain_index, seed, beta: a row per chain (G8); with several betas, n chains for each (G9), seeds 10,000 apart."""
    rows = [(b * n + c, seed + 10_000 * b + c, float(beta)) for b, beta in enumerate(betas or [1.0]) for c in range(n)]
    return spark.createDataFrame(rows, "chain_index int, seed long, beta double").repartition(len(rows), "chain_index")


def split_draws(total: int, parts: int) -> list[int]:
    """Draws of each chain: as even as can be, earlier ones get one more."""
    return [total // parts + (i < total % parts) for i in range(parts)]


def split_chains(runs: DataFrame, key: str, total: str, parts: int, seed: int, betas: list[float] | None = None) -> DataFrame:
    """key, chain_index, seed, beta, draws: the draws of each run over `parts` chains, earlier ones one more (G8); with betas, so for each of
    them, their seeds 10,000 apart (G9). Chains without draws have no row."""
    chain = F.explode(F.array(*[F.struct(F.lit(b * parts + c).alias("chain_index"), F.lit(seed + 10_000 * b + c).cast("long").alias("seed"), F.lit(float(beta)).alias("beta"), F.lit(c).alias("_c")) for b, beta in enumerate(betas or [1.0]) for c in range(parts)]))
    draws = F.floor(F.col(total) / parts) + (F.col("_c") < F.pmod(total, F.lit(parts))).cast("long")
    return runs.select(key, total, chain.alias("_chain")).select(key, total, "_chain.*").select(key, "chain_index", "seed", "beta", draws.cast("long").alias("draws")).where("draws > 0")


def uniform(seeds: np.ndarray, *at: int) -> np.ndarray:
    """A number in [0, 1) for each seed at a step: a hash, not a stream."""
    x = np.asarray(seeds).astype(np.uint64)
    with np.errstate(over="ignore"):
        for n in (0, *at):
            x = x * np.uint64(STEP) + np.uint64(n + 1)
            x = (x ^ x >> np.uint64(30)) * np.uint64(MIX_A)
            x = (x ^ x >> np.uint64(27)) * np.uint64(MIX_B)
            x = x ^ x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(float) / float(1 << 53)


class Sampler:
    """Steps of many configurations (rows of labels) at once, with each site's neighbours at hand."""

    def __init__(self, model: Arrays):
        self.h, self.pairs = model.h, model.j
        self.near: list[list[tuple[int, np.ndarray]]] = [[] for _ in model.h]
        for (r, s), v in model.j.items():
            self.near[r].append((s, v))
            self.near[s].append((r, v.T))

    def local(self, x: np.ndarray, i: int) -> np.ndarray:
        """Energy of each label of site i, given the rest: rows x labels."""
        out = np.tile(np.asarray(self.h[i], float), (len(x), 1))
        for other, v in self.near[i]:
            out += v[:, x[:, other]].T
        return out

    def energy(self, x: np.ndarray) -> np.ndarray:
        x = np.atleast_2d(x)
        out = sum((np.asarray(v)[x[:, i]] for i, v in enumerate(self.h)), np.zeros(len(x)))
        return sum((v[x[:, r], x[:, s]] for (r, s), v in self.pairs.items()), out)

    def sweep(self, x: np.ndarray, beta: np.ndarray, seeds: np.ndarray, t: int) -> None:
        """A Gibbs sweep (G1): every site of every row once, from a site that moves on with t."""
        n = x.shape[1]
        for j in range(n):
            i = (t + j) % n
            w = -np.reshape(beta, (-1, 1)) * self.local(x, i)
            p = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
            x[:, i] = np.minimum((p <= (uniform(seeds, t, i) * p[:, -1])[:, None]).sum(axis=1), p.shape[1] - 1)

    def metropolis(self, x: np.ndarray, beta: np.ndarray, seeds: np.ndarray, t: int) -> None:
        """A Metropolis sweep on labels (G7): another label for each site in turn."""
        rows, n = np.arange(len(x)), x.shape[1]
        for j in range(n):
            i = (t + j) % n
            k = len(self.h[i])
            if k > 1:
                new = (x[:, i] + 1 + (uniform(seeds, t, i, 0) * (k - 1)).astype(int)) % k
                e = self.local(x, i)
                taken = uniform(seeds, t, i, 1) < np.exp(np.minimum(0.0, -np.asarray(beta) * (e[rows, new] - e[rows, x[:, i]])))
                x[:, i] = np.where(taken, new, x[:, i])

    def start(self, seeds: np.ndarray, fields_only: bool = False, beta: float = 1.0) -> np.ndarray:
        """Uniform configurations, or ones drawn from the fields alone."""
        columns = []
        for i, v in enumerate(self.h):
            p = np.cumsum(np.exp(-beta * (np.asarray(v) - np.min(v)))) if fields_only else np.arange(1.0, len(v) + 1)
            columns.append(np.minimum((p[None, :] <= (uniform(seeds, 65_535, i) * p[-1])[:, None]).sum(axis=1), len(v) - 1))
        return np.stack(columns, axis=1)


def _moved(table: DataFrame, move: Callable[[pd.DataFrame], Iterator[dict]], schema: str) -> DataFrame:
    """What `move` yields for batches of rows: columns of equal length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                for out in move(batch):
                    yield pd.DataFrame({k: list(v) if getattr(v, "ndim", 1) > 1 else v for k, v in out.items()})

    return table.mapInPandas(run, schema)


def gibbs(table: DataFrame, model: Arrays, n: int, burn_in: int = 50, thinning: int = 2) -> DataFrame:
    """chain_index, draw, labels, energy: n draws of each chain (G1)."""

    def move(chains_: pd.DataFrame) -> Iterator[dict]:
        sampler, seeds = Sampler(model), chains_["seed"].to_numpy()
        x = sampler.start(seeds)
        for t in range(burn_in + n * thinning):
            sampler.sweep(x, chains_["beta"].to_numpy(), seeds, t)
            if t >= burn_in and (t - burn_in) % thinning == thinning - 1:
                yield {"chain_index": chains_["chain_index"].to_numpy(), "draw": np.full(len(x), (t - burn_in) // thinning), "labels": x.copy(), "energy": sampler.energy(x)}

    return _moved(table, move, SAMPLES)


def replica_exchange(table: DataFrame, model: Arrays, betas: list[float], rounds: int, burn_in: int = 0, sweeps: int = 2) -> DataFrame:
    """chain_index, draw, replica, beta, labels, energy, swaps, trials (of the chain so far): replicas at rising inverse
    temperatures; even and odd neighbours try to swap in turn, with chance exp((b_i - b_j)(E_i - E_j)) (G3)."""
    burn_in = min(burn_in, max(0, rounds - 1))
    schema = "chain_index int, draw int, replica int, beta double, labels array<int>, energy double, swaps long, trials long"

    def move(chains_: pd.DataFrame) -> Iterator[dict]:
        sampler, seeds, r, c = Sampler(model), chains_["seed"].to_numpy(), len(betas), len(chains_)
        own = (seeds[:, None] * 1_000_003 + np.arange(r)[None, :]).ravel()  # a seed for each replica of each chain
        beta, x = np.tile(betas, c), sampler.start(own)
        swaps, trials = np.zeros(c, np.int64), np.zeros(c, np.int64)
        for t in range(rounds):
            for k in range(sweeps):
                sampler.sweep(x, beta, own, t * sweeps + k)
            e = sampler.energy(x).reshape(c, r)
            rows = x.reshape(c, r, -1)
            for i in range(t % 2, r - 1, 2):
                trials += 1
                taken = np.log(np.maximum(uniform(seeds, t, i, 7), 1e-300)) < (betas[i] - betas[i + 1]) * (e[:, i] - e[:, i + 1])
                swaps += taken
                rows[taken, i], rows[taken, i + 1] = rows[taken, i + 1].copy(), rows[taken, i].copy()
                e[taken, i], e[taken, i + 1] = e[taken, i + 1].copy(), e[taken, i].copy()
            if t >= burn_in:
                yield {"chain_index": np.repeat(chains_["chain_index"].to_numpy(), r), "draw": np.full(c * r, t - burn_in), "replica": np.tile(np.arange(r), c), "beta": beta, "labels": x.copy(), "energy": e.ravel().copy(), "swaps": np.repeat(swaps, r), "trials": np.repeat(trials, r)}

    return _moved(table, move, schema)


def acceptance(samples: DataFrame) -> DataFrame:
    """chain_index, acceptance: swaps over trials, at least one."""
    last = samples.groupBy("chain_index").agg(F.max("swaps").alias("s"), F.max("trials").alias("t"))
    return last.select("chain_index", (F.col("s") / F.greatest(F.lit(1), F.col("t"))).alias("acceptance"))


def schedule(kind: str, low: float, high: float, n: int, custom: list[float] | None = None) -> np.ndarray:
    """Inverse temperatures of an annealing run."""
    if kind == "custom":
        return np.asarray(custom or [], float)
    return np.geomspace(low, high, n) if kind == "geometric" else np.linspace(low, high, n)


def projected(bits: np.ndarray) -> np.ndarray:
    """The first greatest bit of a site's slice, for each row (repair by argmax)."""
    return np.atleast_2d(bits).argmax(axis=1)


def annealed(table: DataFrame, model: Arrays, sweeps: int, low: float = 0.1, high: float = 5.0, kind: str = "geometric", penalty: float = 0.0, start: str = "uniform") -> DataFrame:
    """chain_index, draw (0), labels, energy, and valid: one configuration of each chain by annealing.

    Without penalty the labels themselves are moved. With one, the bits of the one-hot form are, each set or cleared by
    Metropolis steps; `penalty` is the weight of a site whose bits are not one-hot, and such sites are repaired by argmax.
    """
    betas = schedule(kind, low, high, sweeps)

    def move(chains_: pd.DataFrame) -> Iterator[dict]:
        sampler, seeds = Sampler(model), chains_["seed"].to_numpy()
        x, valid = sampler.start(seeds, start == "fields"), np.ones(len(chains_), bool)
        if not penalty:
            for t, beta in enumerate(betas):
                sampler.metropolis(x, beta, seeds, t)
        else:
            bits = [np.eye(len(v))[x[:, i]] for i, v in enumerate(model.h)]
            for t, beta in enumerate(betas):
                for i, v in enumerate(model.h):
                    for k in range(len(v)):
                        field = v[k] + sum((bits[other] @ m[k] for other, m in sampler.near[i]), np.zeros(len(x)))
                        flip = 1 - 2 * bits[i][:, k]
                        total = bits[i].sum(axis=1)
                        change = flip * field + penalty * ((total + flip - 1) ** 2 - (total - 1) ** 2)
                        bits[i][:, k] += flip * (uniform(seeds, t, i, k, 3) < np.exp(np.minimum(0.0, -beta * change)))
            valid = np.all([b.sum(axis=1) == 1 for b in bits], axis=0)
            x = np.stack([projected(b) for b in bits], axis=1)
        yield {"chain_index": chains_["chain_index"].to_numpy(), "draw": np.zeros(len(x), int), "labels": x, "energy": sampler.energy(x), "valid": valid}

    return _moved(table, move, SAMPLES + ", valid boolean")


def restart_pool(samples: DataFrame, k: int) -> DataFrame:
    """The k lowest-energy configurations (K4), ties by chain and draw."""
    return samples.orderBy("energy", "chain_index", "draw").limit(k)


def relaxed(frames: DataFrame, model: Arrays, sweeps: int, beta: float = 1.0, seed: int = 0) -> DataFrame:
    """frame_id, sweep, labels (N8): Gibbs sweeps from each start frame; sweep 0 is the frame itself."""

    def move(rows: pd.DataFrame) -> Iterator[dict]:
        sampler, ids = Sampler(model), rows["frame_id"].to_numpy()
        x, seeds = np.array(rows["labels"].tolist(), int), ids * 1_000_003 + seed
        yield {"frame_id": ids, "sweep": np.zeros(len(x), int), "labels": x.copy()}
        for t in range(1, sweeps + 1):
            sampler.sweep(x, beta, seeds, t)
            yield {"frame_id": ids, "sweep": np.full(len(x), t), "labels": x.copy()}

    return _moved(frames.select("frame_id", "labels"), move, "frame_id long, sweep int, labels array<int>")


def flips(relaxation: DataFrame, sweeps: int) -> tuple[DataFrame, DataFrame]:
    """(site, sweep, frac_differs_from_start) and (site, mean_first_flip, fast): how soon sites leave their start."""
    start = F.first("labels").over(Window.partitionBy("frame_id").orderBy("sweep").rowsBetween(Window.unboundedPreceding, 0))
    long = relaxation.withColumn("_x", start).select("frame_id", "sweep", F.posexplode(F.zip_with("labels", "_x", lambda a, b: (a != b).cast("int"))).alias("site", "differs"))
    share = long.groupBy("site", "sweep").agg(F.avg("differs").alias("frac_differs_from_start"))
    first = long.groupBy("frame_id", "site").agg(F.coalesce(F.min(F.when(F.col("differs") == 1, F.col("sweep"))), F.lit(sweeps + 1)).alias("t"))
    means = first.groupBy("site").agg(F.avg("t").alias("mean_first_flip")).withColumn("_all", F.lit(0))
    return share, percentile_rank(means, ["_all"], "mean_first_flip", "site").drop("_all", "slow")


def relaxation_flips(frames: DataFrame, model: Arrays, sweeps: int, beta: float = 1.0, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """`flips` of `relaxed` start frames (each id once), without their rows: a batch makes its own sweeps and sums them up, so what is
    exchanged is a row per site and sweep of a batch."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler = Sampler(model)
        for rows in batches:
            if not len(rows):
                continue
            start, seeds = np.array(rows["labels"].tolist(), int), rows["frame_id"].to_numpy() * 1_000_003 + seed
            x, first = start.copy(), np.full(start.shape, sweeps + 1)
            for t in range(sweeps + 1):
                if t:
                    sampler.sweep(x, beta, seeds, t)
                differs = x != start
                first = np.where(differs, np.minimum(first, t), first)
                yield pd.DataFrame({"site": np.arange(x.shape[1]), "sweep": t, "k": differs.sum(0), "n": len(x)})
            yield pd.DataFrame({"site": np.arange(x.shape[1]), "sweep": -1, "k": first.sum(0), "n": len(x)})

    sums = frames.select("frame_id", "labels").mapInPandas(part, "site int, sweep int, k long, n long").groupBy("site", "sweep").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    sums, mean = kept(sums, "flips"), F.col("k") / F.col("n")  # a row per site and sweep
    means = sums.where("sweep < 0").select("site", mean.alias("mean_first_flip"), F.lit(0).alias("_all"))
    return sums.where("sweep >= 0").select("site", "sweep", mean.alias("frac_differs_from_start")), percentile_rank(means, ["_all"], "mean_first_flip", "site").drop("_all", "slow")


def greedy_state(h: DataFrame) -> DataFrame:
    """site, label of the least field of each site, ties to the smaller label (G10). `h`: site, k, value."""
    return h.groupBy("site").agg(F.min_by("k", F.struct("value", "k")).alias("label"))


def noisy_frames(state: DataFrame, sizes: list[int], n: int, chance: float, seed: int = 0) -> DataFrame:
    """frame_id, site, label: n copies of a state (site, label) of which each label moves on by one with the given chance.

    Chance is a digest of seed, frame and site, so the frames are the same each time.
    """
    k = F.array(*[F.lit(x) for x in sizes])
    drawn = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("frame_id").cast("string"), F.col("site").cast("string"))), 1, 8)
    moved = F.when(drawn < F.lit(f"{int(chance * (1 << 32)):08x}"), (F.col("label") + 1) % k[F.col("site")]).otherwise(F.col("label"))
    each = F.inline(F.array(*[F.struct(F.lit(r["site"]).alias("site"), F.lit(r["label"]).alias("label")) for r in state.collect()]))  # a row a site
    return state.sparkSession.range(n).select(F.col("id").alias("frame_id"), each).select("frame_id", "site", moved.alias("label"))

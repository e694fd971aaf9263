"""How ensembles are put together: data sets for fits, states, look-ups, matching, upserts, rankings and grids of runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motley.functions.columns import dihedral, finite, mismatches
from motley.operators.distributions import edge_divergences, joints, pair_counts, pair_shares, pooled_counts, site_counts, site_divergences, site_shares, weighted_mean
from motley.operators.frames import assigned
from motley.operators.neighbours import nearest_rows
from motley.operators.ordered import deviation, quantiles
from motley.sources.tables import kept


def assembled(frames: DataFrame, samples: DataFrame, wanted: list) -> DataFrame:
    """position, sample_id, frame_id, labels, state, frame_index: the rows of the wanted samples as one data set for a fit.

    `frames`: sample_id, frame_id, labels, frame_state_id, frame_index; `samples`: sample_id, type, state_id. A sample asked for
    twice counts once, where it first stands. A frame without a state of its own has its sample's. Frame numbers are kept only if
    every row has one. A sample that is missing or no evaluated trajectory (type md_eval) is an error.
    """
    wanted = list(dict.fromkeys(wanted))
    if not wanted:
        raise ValueError("a fit needs at least one sample")
    known = {r["sample_id"]: r for r in samples.where(F.col("sample_id").isin(wanted)).collect()}  # as many as asked for
    for s in wanted:
        if s not in known:
            raise ValueError(f"no such sample: {s}")
        if known[s]["type"] != "md_eval":
            raise ValueError(f"not an evaluated trajectory: {s}")
    rows = frames.where(F.col("sample_id").isin(wanted))
    place = F.create_map(*[F.lit(x) for i, s in enumerate(wanted) for x in (s, i)])
    state = F.create_map(*[F.lit(x) for s in wanted for x in (s, known[s]["state_id"] or "")])
    whole = not rows.where("frame_index is null").limit(1).count()
    at = F.col("frame_index") if whole else F.lit(None).cast("long")
    return rows.select(place[F.col("sample_id")].alias("position"), "sample_id", "frame_id", "labels", F.coalesce("frame_state_id", state[F.col("sample_id")]).alias("state"), at.alias("frame_index"))


def merged_states(macro: DataFrame, metastable: DataFrame) -> DataFrame:
    """state_id, name, kind, macro_state_id, n_frames of macro states and of metastable ones.

    `macro`: state_id, name, n_frames; `metastable`: metastable_id, id, name, default_name, macro_state_id, n_frames: the first
    of the two ids, and of name, default name and id, that is there. Metastable states without an id go.
    """
    own = macro.select("state_id", F.coalesce("name", "state_id").alias("name"), F.lit("macro").alias("kind"), F.coalesce("n_frames", F.lit(0)).cast("long").alias("n_frames"))
    ident = F.coalesce(F.nullif("metastable_id", F.lit("")), F.nullif("id", F.lit("")))
    sub = metastable.withColumn("state_id", ident).where("state_id is not null")
    sub = sub.select("state_id", F.coalesce(F.nullif("name", F.lit("")), F.nullif("default_name", F.lit("")), "state_id").alias("name"), F.lit("metastable").alias("kind"), "macro_state_id", F.col("n_frames").cast("long").alias("n_frames"))
    return own.unionByName(sub, allowMissingColumns=True)


def labels_of_frames(wanted: DataFrame, labelled: DataFrame) -> DataFrame:
    """The wanted frames (sample_id, frame_id) that have labels, with them; those with an unassigned site go."""
    return wanted.join(labelled.where(assigned(F.col("labels"))), ["sample_id", "frame_id"])


def collected(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys (state, metastable index) are among those wanted (C4)."""
    return rows.join(wanted.select(*keys).distinct(), keys, "left_semi")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`old` without the keys that `new` has, and `new`."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def tail_spread(df: DataFrame, keys: list[str], order: str, tail: int, n: int) -> DataFrame:
    """df's last `tail` rows of each key, n of them at even distances, with their place j (F9); rows repeat where n is more."""
    rows = df.withColumn("_back", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where(F.col("_back") <= tail)
    rows = rows.withColumn("_m", F.max("_back").over(Window.partitionBy(*keys)))  # `tail` rows a key at most
    at = lambda j: F.floor(j * (F.col("_m") - 1) / F.lit(max(1, n - 1)))
    hits = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: at(j) == F.col("_m") - F.col("_back"))
    return rows.withColumn("j", F.explode(hits)).drop("_back", "_m")


def wildcards(selections: DataFrame, residues: DataFrame) -> DataFrame:
    """key, selection of every selection (F15): [singles] stands for each residue of its base, [pairs] for each two of them.

    `selections`: key, selection, base; `residues`: base, resid. A base without residues gives nothing, one residue no pair.
    """
    singles, pairs = F.contains("selection", F.lit("[singles]")), F.contains("selection", F.lit("[pairs]"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    met = selections.join(residues, "base")
    one = met.where(singles).select(text("res_", F.col("resid")).alias("key"), text("resid ", F.col("resid")).alias("selection"))
    both = met.where(~singles & pairs).join(residues.withColumnRenamed("resid", "other"), "base").where("resid < other")
    two = both.select(text("res_", F.col("resid"), "_", F.col("other")).alias("key"), text("resid ", F.col("resid"), " ", F.col("other")).alias("selection"))
    return selections.where(~singles & ~pairs).select("key", "selection").unionByName(one).unionByName(two).distinct()


def matched_states(old: DataFrame, states: DataFrame) -> DataFrame:
    """old_id, state_id, each state once (J16): by equal label and name, then label and id, of selected states first.

    `old`: old_id, label; `states`: state_id, name, selected; labels and names are compared as they are (bring them to slugs
    before). Of equal labels the k-th by id meets the k-th state. Left-over old ids raise, unless the selected states are as
    many as the old ones: then they go by order.
    """
    nth = lambda df, by: df.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy(by)))
    found, left, free = None, old, states
    for selected in (True, False):
        for key in ("name", "state_id"):
            pool = free.where("selected") if selected else free
            hit = nth(left.withColumn("_key", F.col("label")), "old_id").join(nth(pool.select("state_id", F.col(key).alias("_key")), "state_id"), ["_key", "_n"]).select("old_id", "state_id")
            found = hit if found is None else found.unionByName(hit)
            left, free = left.join(hit, "old_id", "left_anti"), free.join(hit, "state_id", "left_anti")
    if left.limit(1).count():
        chosen = states.where("selected")
        if chosen.count() != old.count():
            raise ValueError(f"no state matches {[r['label'] for r in left.limit(10).collect()]}")
        number = lambda df, c: df.select(c, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(c)).alias("_n"))  # noqa: E731  a row a state
        return number(old, "old_id").join(number(chosen, "state_id"), "_n").select("old_id", "state_id")
    return found


def constraint_ranking(impact: DataFrame, id_column: str, value: str, k: int, excluded: DataFrame | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """id and rank of the k greatest positive impacts, without excluded ids and of allowed ones only (K7); ties to the smaller id."""
    rows = impact.where(F.col(value) > 0)
    rows = rows.join(excluded, id_column, "left_anti") if excluded is not None else rows
    rows = rows.join(allowed, id_column, "left_semi") if allowed is not None else rows
    return ranked_first(rows, [F.desc(value), F.asc(id_column)], k).select(id_column, "rank")


def ranked_first(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """df's first k rows with their rank (K2-K5): a take-ordered, no sort of the whole table."""
    return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def nearest_cdfs(a: DataFrame, b: DataFrame, sites: int) -> DataFrame:
    """direction, bin, cdf of the distance of each frame to the nearest frame of the other set, both ways."""
    one = lambda x, y, name: nearest_rows(x, y).select(F.lit(name).alias("direction"), "distance")
    counts = one(a, b, "a_to_b").unionByName(one(b, a, "b_to_a")).groupBy("direction", "distance").agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy("direction").agg(F.collect_list(F.struct("distance", "n")).alias("_c"), F.sum("n").alias("_n"))  # a row per distance: the sites and one
    out = per.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(sites))))
    upto = F.aggregate(F.filter("_c", lambda x: x["distance"] <= F.col("bin")), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    return out.select("direction", "bin", (upto / F.col("_n")).alias("cdf"))


def hamming_summary(pairs: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """keys, mean, median and most of the places in which two label arrays differ."""
    counts = pairs.withColumn("_d", mismatches(F.col(a), F.col(b))).groupBy(*keys, "_d").agg(F.count(F.lit(1)).alias("_n"))
    d = F.col("_d")
    return counts.groupBy(*keys).agg((F.sum(d * F.col("_n")) / F.sum("_n")).alias("mean"), F.expr("percentile(_d, 0.5, _n)").alias("median"), F.max(d).cast("double").alias("most"))


def energy_correlation(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """keys, correlation; null where one side hardly varies."""
    sound = (F.stddev_pop(a) >= 1e-12) & (F.stddev_pop(b) >= 1e-12)
    return df.groupBy(*keys).agg(F.when(sound, F.corr(a, b)).alias("correlation"))


def grid_means(runs: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys and the mean of each value, NaN and infinite ones left out."""
    return runs.groupBy(*keys).agg(*[F.avg(finite(F.col(v))).alias(v) for v in values])


def percentile_difference(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """key, difference of the value in a and b; keys that one side lacks, or has no finite value for, go."""
    side = lambda df, name: df.select(key, finite(F.col(value)).alias(name)).where(f"{name} is not null")
    return side(a, "_a").join(side(b, "_b"), key).select(key, (F.col("_a") - F.col("_b")).alias("difference"))


def edge_commitment(frames: DataFrame, difference: DataFrame, edges: list[tuple[int, int]]) -> DataFrame:
    """sample_id, r, s, q, mean: the share of frames whose pair of labels the difference model (A less B) gives to A, and its mean."""
    pair = F.inline(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(s).alias("s"), F.col("labels")[r].alias("k"), F.col("labels")[s].alias("l")) for r, s in edges]))
    counts = frames.select("sample_id", pair).groupBy("sample_id", "r", "s", "k", "l").agg(F.count(F.lit(1)).alias("n"))
    met = counts.join(difference, ["r", "s", "k", "l"])
    return met.groupBy("sample_id", "r", "s").agg((F.sum(F.when(F.col("value") < 0, F.col("n")).otherwise(0)) / F.sum("n")).alias("q"), (F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("mean"), F.sum("n").alias("n"))


def smoothed_commitment(sites: DataFrame, edges: DataFrame, strength: float, gamma: float = 0.65) -> DataFrame:
    """sample_id, site, q mixed with the weighted mean of its edges' stretched commitments.

    `sites`: sample_id, site, q; `edges`: sample_id, r, s, q, d. An edge counts by |d|, by 1 where that is about 0.
    """
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    away = clip(F.col("q")) - 0.5
    stretched = F.signum(away) * F.pow(F.abs(away) * 2, F.lit(gamma)) / 2
    weight = F.when(F.abs("d") > 1e-12, F.abs("d")).otherwise(1.0)
    ends = edges.where(finite(F.col("q")).isNotNull()).select("sample_id", F.explode(F.array("r", "s")).alias("site"), stretched.alias("_x"), weight.alias("_w"))
    around = ends.groupBy("sample_id", "site").agg((F.sum(F.col("_w") * F.col("_x")) / F.sum("_w")).alias("_e"))
    mixed = 0.5 + F.lit(1 - strength) * (clip(F.col("q")) - 0.5) + F.lit(strength) * F.coalesce("_e", F.lit(0.0))
    return sites.join(around, ["sample_id", "site"], "left").select("sample_id", "site", mixed.alias("q"))


def edges_of(mode: str, n_sites: int, given: list[tuple[int, int]] | None = None, positions: list[tuple[float, float, float]] | None = None, cutoff: float = 0.0) -> list[tuple[int, int]]:
    """The edges of an analysis without models (N7): those of the clustering, all, or contacts. Sites are few."""
    every = [(r, s) for r in range(n_sites) for s in range(r + 1, n_sites)]
    if mode == "cluster":
        return sorted({(min(e), max(e)) for e in given or [] if e[0] != e[1]})
    if mode == "all_vs_all":
        return every
    if mode == "contact" and positions:
        return [(r, s) for r, s in every if sum((a - b) ** 2 for a, b in zip(positions[r], positions[s], strict=True)) < cutoff * cutoff]
    raise ValueError(f"unknown edges: {mode}")


def all_edges(frames: DataFrame, labels: str = "labels") -> DataFrame:
    """r, s: all pairs of the sites that frames have labels of (J9). As many rows as pairs of sites, however many frames there are."""
    sites = frames.agg(F.coalesce(F.max(F.size(labels)), F.lit(0)).alias("n")).where("n > 1")
    left = sites.select("n", F.explode(F.sequence(F.lit(0), F.col("n") - 2)).alias("r"))
    return left.select(F.col("r").cast("int").alias("r"), F.explode(F.sequence(F.col("r") + 1, F.col("n") - 1)).alias("s"))


def delta_js(frames: DataFrame, sides: dict[str, list], sizes: list[int], edges: list[tuple[int, int]], top_edges: int, alpha: float = 0.5, samples: list | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """How like each side's pooled reference every sample is (N7): (sample_id, side, node, edge, mixed), (site, d), (r, s, d, rank).

    node and edge are means of divergences weighted by how far the two sides are apart (d); of edges, the `top_edges` with the
    greatest d count, and where there is none the nodes stand for them. mixed = (1 - alpha) node + alpha edge. Counts are made
    once a sample and side; all that follows has a row per label. With `samples`, only those are compared.
    """
    a, b = list(sides)[:2]
    asked = lambda df: df.where(F.col("sample_id").isin(samples)) if samples is not None else df
    frames = frames.where(F.col("sample_id").isin([*samples, *sum(sides.values(), [])])) if samples is not None else frames
    counts = kept(site_counts(frames), "site_counts")  # frames are read once for the sites, once for the edges
    pool = kept(site_shares(pooled_counts(counts, sides), sizes, "side"), "pooled")
    part = lambda df, name: df.where(F.col("side") == name).withColumn("side", F.lit(0))
    site_d = site_divergences(part(pool, a), part(pool, b).withColumnRenamed("side", "other"), "side", "other").select("site", F.col("js").alias("d"))
    nodes = site_divergences(site_shares(asked(counts), sizes), pool, "sample_id", "side").join(F.broadcast(site_d), "site")  # a row per site
    node = nodes.groupBy("sample_id", "side").agg(weighted_mean(F.col("js"), F.col("d")).alias("node"))
    if not edges or top_edges < 1:
        empty = frames.sparkSession.createDataFrame([], "r int, s int, d double, rank int")
        return node.withColumn("edge", F.col("node")).withColumn("mixed", F.col("node")), site_d, empty
    both = kept(pair_counts(frames, edges), "pair_counts")
    pair = kept(pair_shares(pooled_counts(both, sides), sizes, "side"), "pooled")
    edge_d = edge_divergences(part(pair, a), part(pair, b).withColumnRenamed("side", "other"), "side", "other").select("r", "s", F.col("js").alias("d"))
    top = ranked_first(edge_d, [F.desc(F.round("d", 9)), F.asc("r"), F.asc("s")], top_edges)
    met = edge_divergences(pair_shares(asked(both), sizes), pair, "sample_id", "side").join(F.broadcast(top.select("r", "s", "d")), ["r", "s"])  # `top_edges` rows
    edge = met.groupBy("sample_id", "side").agg(weighted_mean(F.col("js"), F.col("d")).alias("edge"))
    out = node.join(edge, ["sample_id", "side"], "left").withColumn("edge", F.coalesce("edge", "node"))
    return out.withColumn("mixed", F.lit(1 - alpha) * F.col("node") + F.lit(alpha) * F.col("edge")), site_d, top


def transition(preference: DataFrame, training: list, band: float, eps: float = 1e-12) -> tuple[DataFrame, DataFrame]:
    """Of frames (sample_id, frame_id, e_a_minus_b), with the training samples' median and deviation: (all frames with z and whether
    they lie in the band), and (sample_id, tau, p, p_train, enrichment) (N5).

    tau is the `band` quantile of |z| over the training frames; enrichment is ln((p + eps) / (p_train + eps)).
    """
    known = kept(preference.select("sample_id", "e_a_minus_b"), "preference")  # read several times
    train = known.where(F.col("sample_id").isin(training)).withColumn("_all", F.lit(0))
    scale = deviation(train, ["_all"], "e_a_minus_b").first()
    z = (F.col("e_a_minus_b") - F.lit(scale["median"])) / F.lit(scale["mad"])
    tau = quantiles(train.withColumn("_z", F.abs(z)), ["_all"], "_z", (band,)).first()[1]
    marked = lambda df: df.withColumn("z", z).withColumn("in_band", F.abs("z") <= F.lit(tau))
    rows, share = marked(preference), kept(marked(known).groupBy("sample_id").agg(F.sum(F.col("in_band").cast("long")).alias("_k"), F.count(F.lit(1)).alias("_n")), "shares")
    of = F.col("sample_id").isin(training)
    whole = share.where(of).agg((F.sum("_k") / F.sum("_n")).alias("p")).first()["p"]
    p = F.col("_k") / F.col("_n")
    return rows, share.select("sample_id", F.lit(tau).alias("tau"), p.alias("p"), F.lit(whole).alias("p_train"), F.ln((p + eps) / (F.lit(whole) + eps)).alias("enrichment"))


def macro_labels(df: DataFrame, micro: str, memberships: DataFrame, least_membership: float = 0.5, least_share: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """df with macro, and (macro, share, small) (A20, C12). `memberships`: micro, macro, membership.

    A micro state belongs to its likeliest macro state (ties to the smaller); frames of micro states below `least_membership`, and
    of macro states with under `least_share` of the frames, are outliers (-1). Shares are those before outliers go.
    """
    best = memberships.groupBy("micro").agg(F.max_by("macro", F.struct("membership", -F.col("macro"))).alias("_best"), F.max("membership").alias("_m"))
    hard = df.join(F.broadcast(best.withColumnRenamed("micro", micro)), micro, "left")  # a row per micro state
    counts = hard.groupBy(F.col("_best").alias("macro")).agg(F.count(F.lit(1)).alias("_n"))
    share = F.col("_n") / F.sum("_n").over(Window.partitionBy(F.lit(0)))  # a row per macro state
    shares = counts.where("macro is not null").select("macro", share.alias("share"), (share < least_share).alias("small"))
    out = hard.join(F.broadcast(shares.select(F.col("macro").alias("_best"), "small")), "_best", "left")
    label = F.when((F.col("_m") >= least_membership) & ~F.col("small"), F.col("_best")).otherwise(-1)
    return out.withColumn("macro", label.cast("int")).drop("_best", "_m", "small"), shares


def lag_frames(lag: Column, step: Column) -> Column:
    """A lag time in frames of the given step: at least one, halves to the even number."""
    return F.greatest(F.lit(1), F.bround(F.greatest(lag, step) / step).cast("int"))


def located(frames: DataFrame, lengths: DataFrame, order: str = "trajectory") -> DataFrame:
    """frames (frame) with trajectory and local: where in which trajectory a running number lies (W14); numbers beyond all go.

    `lengths`: trajectory, n, in ascending order of the trajectory; a row a trajectory. Spans meet numbers through buckets of the
    mean length, so a number is compared with the few spans of its bucket.
    """
    spans = lengths.withColumn("_stop", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.where("n > 0").select("trajectory", (F.col("_stop") - F.col("n")).alias("_start"), "_stop")
    total = lengths.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    width = max(1, -(-int(total[0]) // max(1, total[1])))
    bucket = lambda x: F.floor(x / F.lit(width)).cast("long")
    spans = spans.withColumn("_b", F.explode(F.sequence(bucket(F.col("_start")), bucket(F.col("_stop") - 1))))
    met = frames.withColumn("_b", bucket(F.col("frame"))).join(spans, "_b").where("frame >= _start and frame < _stop")
    return met.withColumn("local", (F.col("frame") - F.col("_start")).cast("long")).drop("_b", "_start", "_stop")


def backmapped(labels: DataFrame, coordinates: DataFrame) -> DataFrame:
    """state_id, frame_index, site, label, x, y, z, phi, psi, chi1 of labelled frames that have coordinates.

    `labels`: state_id, frame_index, site, label; `coordinates`: state_id, frame_index, site, xyz, phi_points, psi_points, chi1_points
    (four points each, null where an atom is missing).
    """
    angle = lambda c: dihedral(*[F.col(c)[i] for i in range(4)]).alias(c.removesuffix("_points"))
    met = labels.join(coordinates, ["state_id", "frame_index", "site"])
    return met.select("state_id", "frame_index", "site", "label", *[F.col("xyz")[i].alias(c) for i, c in enumerate("xyz")], *[angle(f"{c}_points") for c in ("phi", "psi", "chi1")])


def cluster_moments(angles: DataFrame, label: str) -> DataFrame:
    """site, cluster, n, weight (its share of the site's rows), mean and variance (ddof 1, arrays by component) of angles."""
    long = angles.select("site", F.col(label).alias("cluster"), F.posexplode("angles").alias("dim", "x"))
    per = long.groupBy("site", "cluster", "dim").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_samp("x").alias("v"))
    out = per.groupBy("site", "cluster").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("dim", "m", "v"))).alias("_d"))
    weight = F.col("n") / F.sum("n").over(Window.partitionBy("site"))
    return out.select("site", "cluster", "n", weight.alias("weight"), F.col("_d.m").alias("mean"), F.col("_d.v").alias("variance"))


def log_density(x: Column, weight: Column, mean: Column, variance: Column, ridge: float = 1e-6) -> Column:
    """ln(weight) and the log-density of a diagonal Gaussian, but for a constant."""
    parts = F.zip_with(F.zip_with(x, mean, lambda a, m: (a - m) * (a - m)), variance, lambda d, v: d / (F.coalesce(v, F.lit(0.0)) + ridge) + F.ln(F.coalesce(v, F.lit(0.0)) + ridge))
    return F.ln(weight) - 0.5 * F.aggregate(parts, F.lit(0.0), lambda s, p: s + p)


def frozen_labels(angles: DataFrame, moments: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """angles with label, score and, with thresholds (site, cluster, least), label_halo: -1 below its cluster's least score.

    A row belongs to the densest cluster of its site, ties to the smaller. The clusters of a site are one array beside the row, so
    labelling is one expression and no row meets another.
    """
    fields = [F.col("cluster"), F.col("weight"), F.col("mean"), F.col("variance")]
    if thresholds is not None:
        moments, fields = moments.join(thresholds, ["site", "cluster"], "left"), [*fields, F.col("least")]
    models = moments.groupBy("site").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_m"))  # a row per site
    scored = F.transform("_m", lambda m: F.struct(log_density(F.col("angles"), m["weight"], m["mean"], m["variance"]).alias("score"), (-m["cluster"]).alias("_c"), *([m["least"].alias("least")] if thresholds is not None else [])))
    out = angles.join(F.broadcast(models), "site").withColumn("_best", F.array_max(scored)).drop("_m")
    out = out.withColumn("label", (-F.col("_best._c")).cast("int")).withColumn("score", F.col("_best.score"))
    if thresholds is not None:
        out = out.withColumn("label_halo", F.when(F.col("score") >= F.coalesce("_best.least", F.lit(float("-inf"))), F.col("label")).otherwise(-1).cast("int"))
    return out.drop("_best")


def evaluated(labelled: DataFrame) -> DataFrame:
    """The rows of frames that are in no site's halo (C7). `labelled`: state_id, frame_index, site, label_halo, ..."""
    sound = labelled.groupBy("state_id", "frame_index").agg(F.min("label_halo").alias("_least")).where("_least >= 0")
    return labelled.join(sound.select("state_id", "frame_index"), ["state_id", "frame_index"], "left_semi")


def condition_rates(labelled: DataFrame, conditions: list[tuple[str, Column]]) -> DataFrame:
    """condition, site, n, halo_rate: over each condition's rows (C6, A11). A condition is a name and a key column; null: none."""
    each = F.array_compact(F.array(*[F.when(c.isNotNull(), F.concat(F.lit(f"{name}:"), c.cast("string"))) for name, c in conditions]))
    long = labelled.select(F.explode(each).alias("condition"), "site", "label_halo")
    return long.groupBy("condition", "site").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label_halo") < 0).cast("double")).alias("halo_rate"))


def requested_joints(frames: DataFrame, pairs: list[tuple[int, int]], by: str = "sample_id") -> DataFrame:
    """by, r, s, k, l, p of the requested pairs; alphabets end with the greatest label seen; unassigned labels do not count."""
    sites = sorted({x for e in pairs for x in e})
    top = frames.agg(*[F.max(F.col("labels")[i]).alias(f"m{i}") for i in sites]).first()
    sizes = [0] * (max(sites) + 1)
    for i in sites:
        sizes[i] = int(top[f"m{i}"] if top[f"m{i}"] is not None else -1) + 1
    kept = frames.withColumn("labels", F.transform("labels", lambda x: F.when(x >= 0, x)))
    return joints(kept, sizes, [e for e in pairs if sizes[e[0]] and sizes[e[1]]], by)


def entropy_score(df: DataFrame, keys: list[str], chance: str, label: str, eps: float = 1e-12) -> DataFrame:
    """keys, score: (H(Y) - cross-entropy) / H(Y), within 0 and 1; null if a class is empty."""
    p, y = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col(chance))), F.col(label)
    sums = df.groupBy(*keys).agg(F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("_ce"), F.avg(y.cast("double")).alias("_y"))
    h = -(F.col("_y") * F.ln("_y") + (1 - F.col("_y")) * F.ln(1 - F.col("_y")))
    return sums.select(*keys, F.when((F.col("_y") > 0) & (F.col("_y") < 1), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (h - F.col("_ce")) / h))).alias("score"))


#: Cells of the tables of some pairs that are aligned together.
CELLS = 1 << 24


def alignments(a: np.ndarray, b: np.ndarray, match: float = 2.0, mismatch: float = -1.0, first_gap: float = -2.0, next_gap: float = -0.1) -> list[list[tuple[int, int]]]:
    """For each row of a (pairs x n) and b (pairs x m) the places that a best global alignment puts side by side, gaps of k costing
    first_gap + (k - 1) next_gap. Of equal ones, that which ends in a pair, then in a gap of the second.

    All pairs move along the anti-diagonals of their tables together. What stays of a cell is a byte: from which of the three ends
    (a pair, a gap of b, a gap of a) each of its own comes.
    """
    pairs, n, m = len(a), a.shape[1], b.shape[1]
    blank = np.full((3, pairs, n + 1), -np.inf)
    before, last = blank, blank.copy()
    last[0, :, 0] = 0.0
    came, ends = np.zeros((n + m + 1, pairs, n + 1), np.uint8), np.full((pairs, 3), -np.inf)
    if n + m == 0:
        ends = last[:, :, 0].T
    for d in range(1, n + m + 1):
        i = np.arange(max(0, d - m), min(n, d) + 1)
        now = blank.copy()
        inner = i[(i > 0) & (i < d)]
        up, left = i[i > 0], i[i < d]
        byte = np.zeros((pairs, n + 1), np.uint8)
        for kind, at, source, cost in (
            (0, inner, before[:, :, inner - 1], None),
            (1, up, last[:, :, up - 1], (first_gap, next_gap, first_gap)),
            (2, left, last[:, :, left], (first_gap, first_gap, next_gap)),
        ):
            if not len(at):
                continue
            gain = np.where(a[:, at - 1] == b[:, d - at - 1], match, mismatch)[None] if cost is None else np.array(cost)[:, None, None]
            options = source + gain
            best = options.argmax(axis=0)
            now[kind][:, at] = np.take_along_axis(options, best[None], 0)[0]
            byte[:, at] |= (best << 2 * kind).astype(np.uint8)
        came[d] = byte
        before, last = last, now
        if d == n + m:
            ends = last[:, :, n].T
    out = []
    for p in range(pairs):
        i, j, kind, found = n, m, int(ends[p].argmax()), []
        while i or j:
            origin = int(came[i + j, p, i]) >> 2 * kind & 3
            if kind == 0:
                found.append((i - 1, j - 1))
            i, j, kind = i - (kind != 2), j - (kind != 1), origin
        out.append(found[::-1])
    return out


def alignment(a: list[str], b: list[str], **costs: float) -> list[tuple[int, int]]:
    """The alignment of one pair of sequences."""
    number = {x: i for i, x in enumerate({*a, *b})}
    return alignments(*(np.array([[number[x] for x in s]], np.int64).reshape(1, len(s)) for s in (a, b)), **costs)[0]


def aligned(pairs: DataFrame) -> DataFrame:
    """pair, mobile_place, reference_place of residues of the same name that the alignment of a pair's sequences puts side by side.

    `pairs`: pair, mobile, reference (arrays of names; null: empty). Pairs are rows: each is aligned where it is, with a byte for each
    pair of places in memory, or CELLS bytes for some short pairs together.
    """
    kind = pairs.schema["pair"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            number: dict[str, int] = {}
            of = lambda x: [number.setdefault(v, len(number)) for v in (x if x is not None else ())]
            same: dict[tuple[int, int], list[tuple]] = {}
            for p, x, y in zip(batch["pair"], batch["mobile"], batch["reference"], strict=True):
                a, b = of(x), of(y)
                same.setdefault((len(a), len(b)), []).append((p, a, b))
            rows = []
            for (n, m), own in same.items():  # pairs of equal lengths together, as far as their tables are small
                together = max(1, CELLS // ((n + m + 1) * (n + 1)))
                for k in range(0, len(own), together):
                    part = own[k : k + together]
                    a, b = (np.array([r[c] for r in part], np.int64).reshape(len(part), size) for c, size in ((1, n), (2, m)))
                    for (p, *_), found, x, y in zip(part, alignments(a, b), a, b, strict=True):
                        rows += [(p, i, j) for i, j in found if x[i] == y[j]]
            yield pd.DataFrame(rows, columns=["pair", "mobile_place", "reference_place"])

    return pairs.where("mobile is not null and reference is not null").select("pair", "mobile", "reference").mapInPandas(run, f"pair {kind}, mobile_place int, reference_place int")

"""Distributions of labels per site and per pair of sites, and how far apart they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motley.functions.columns import clipped


def pairs(labels: Column, edges: list[tuple[int, int]]) -> Column:
    """(r, s, k, l) of each edge within a frame: no self-join, no shuffle."""
    return F.array(*[F.struct(F.lit(r).alias("r"), F.lit(s).alias("s"), labels[r].alias("k"), labels[s].alias("l")) for r, s in edges])


def _filled(counts: DataFrame, keys: list[str], label: Column, cells: Column, names: list[str]) -> DataFrame:
    """Counts of each key as shares of their sum, with a row for every cell of the alphabet."""
    seen = F.map_from_entries(F.collect_list(F.struct(label, F.col("n"))))  # as many entries as cells
    total = counts.groupBy(*keys).agg(F.sum("n").alias("_total"), seen.alias("_seen"))
    out = total.withColumn("_cell", F.explode(cells))
    p = F.coalesce(F.try_element_at("_seen", F.col("_cell")), F.lit(0)) / F.greatest(F.lit(1), F.col("_total"))
    cell = [F.col("_cell").alias(names[0])] if len(names) == 1 else [F.col("_cell")[n].alias(n) for n in names]
    return out.select(*keys, *cell, p.alias("p"))


def counted_frames(frames: DataFrame, *by: str) -> DataFrame:
    """by, labels, n: each different frame once, with how often it occurs."""
    return frames.groupBy(*by, "labels").agg(F.count(F.lit(1)).alias("n"))


def _times(n: str | None) -> Column:
    return (F.col(n) if n else F.lit(1).cast("long")).alias("n")


def site_counts(frames: DataFrame, by: str = "sample_id", n: str | None = None) -> DataFrame:
    """by, site, label, n: how often each label occurs; a frame counts as often as its column `n` says. Gaps (null) are no label."""
    long = frames.select(by, _times(n), F.posexplode("labels").alias("site", "label")).where("label is not null")
    return long.groupBy(by, "site", "label").agg(F.sum("n").alias("n"))


def site_shares(counts: DataFrame, sizes: list[int], by: str = "sample_id") -> DataFrame:
    k = F.array(*[F.lit(x) for x in sizes])
    return _filled(counts, [by, "site"], F.col("label"), F.sequence(F.lit(0), k[F.col("site")] - 1), ["label"])


def marginals(frames: DataFrame, sizes: list[int], by: str = "sample_id", n: str | None = None) -> DataFrame:
    """by, site, label, p: a row for every label of the alphabet (A1). Gaps (null) are no label."""
    return site_shares(site_counts(frames, by, n), sizes, by)


def pair_counts(frames: DataFrame, edges: list[tuple[int, int]], by: str = "sample_id", n: str | None = None) -> DataFrame:
    """by, r, s, k, l, n: how often each pair of labels of an edge occurs; a frame counts as often as its column `n` says."""
    long = frames.select(by, _times(n), F.inline(pairs(F.col("labels"), edges))).where("k is not null and l is not null")
    return long.groupBy(by, "r", "s", "k", "l").agg(F.sum("n").alias("n"))


def pair_shares(counts: DataFrame, sizes: list[int], by: str = "sample_id") -> DataFrame:
    n = F.array(*[F.lit(x) for x in sizes])
    row = lambda k: F.transform(F.sequence(F.lit(0), n[F.col("s")] - 1), lambda x: F.struct(k.alias("k"), x.alias("l")))
    cells = F.flatten(F.transform(F.sequence(F.lit(0), n[F.col("r")] - 1), row))
    return _filled(counts, [by, "r", "s"], F.struct("k", "l"), cells, ["k", "l"])


def joints(frames: DataFrame, sizes: list[int], edges: list[tuple[int, int]], by: str = "sample_id", n: str | None = None) -> DataFrame:
    """by, r, s, k, l, p: a row for every pair of labels of each edge (A2)."""
    return pair_shares(pair_counts(frames, edges, by, n), sizes, by)


def sided(df: DataFrame, sides: dict[str, list]) -> DataFrame:
    """Rows of the sides' samples with their side, once for each that a sample serves."""
    of = F.array_compact(F.array(*[F.when(F.col("sample_id").isin(ids), F.lit(name)) for name, ids in sides.items()]))
    return df.where(F.size(of) > 0).withColumn("side", F.explode(of))


def pooled_counts(counts: DataFrame, sides: dict[str, list]) -> DataFrame:
    """Counts by sample, summed over each side's samples."""
    cell = [c for c in counts.columns if c not in ("sample_id", "n")]
    return sided(counts, sides).groupBy("side", *cell).agg(F.sum("n").alias("n"))


def pooled(frames: DataFrame, sides: dict[str, list], sizes: list[int]) -> DataFrame:
    """side, site, label, p over all frames of each side's samples (A3): every frame counts alike. A sample may serve both sides."""
    return marginals(sided(frames, sides), sizes, "side")


def pooled_joints(frames: DataFrame, sides: dict[str, list], sizes: list[int], edges: list[tuple[int, int]]) -> DataFrame:
    return joints(sided(frames, sides), sizes, edges, "side")


def divergences(df: DataFrame, keys: list[str], p: str = "p", q: str = "q") -> DataFrame:
    """keys, kl (p from q) and js (natural logarithm) of the rows of each key (M1, M2).

    Both are clipped to 1e-12 and made to sum to 1 again; the mixture of the Jensen-Shannon divergence is taken before that.
    One aggregation: with clipped a, b of sums A, B, the divergence is sum(a ln(a / b)) / A - ln(A / B).
    """
    a, b, m = clipped(F.col(p)), clipped(F.col(q)), clipped((F.col(p) + F.col(q)) / 2)
    sums = df.groupBy(*keys).agg(
        F.sum(a).alias("_a"), F.sum(b).alias("_b"), F.sum(m).alias("_m"),
        F.sum(a * F.ln(a / b)).alias("_ab"), F.sum(a * F.ln(a / m)).alias("_am"), F.sum(b * F.ln(b / m)).alias("_bm"),
    )
    kl = lambda part, x, y: F.col(part) / F.col(x) - F.ln(F.col(x) / F.col(y))
    js = (kl("_am", "_a", "_m") + kl("_bm", "_b", "_m")) / 2
    return sums.select(*keys, kl("_ab", "_a", "_b").alias("kl"), js.alias("js"))


def compared(left: DataFrame, right: DataFrame, cell: list[str], left_key: str, right_key: str) -> DataFrame:
    """p and q of the same cells; a cell that one side lacks counts 0."""
    a = left.select(left_key, *cell, F.col("p"))
    b = right.select(right_key, *cell, F.col("p").alias("q"))
    return a.join(b, cell)


def site_divergences(left: DataFrame, right: DataFrame, left_key: str = "a", right_key: str = "b") -> DataFrame:
    """left_key, right_key, site, kl, js of marginals (M3)."""
    return divergences(compared(left, right, ["site", "label"], left_key, right_key), [left_key, right_key, "site"])


def edge_divergences(left: DataFrame, right: DataFrame, left_key: str = "a", right_key: str = "b") -> DataFrame:
    """left_key, right_key, r, s, kl, js of joints (M4)."""
    return divergences(compared(left, right, ["r", "s", "k", "l"], left_key, right_key), [left_key, right_key, "r", "s"])


def combined_distance(nodes: DataFrame, edges: DataFrame, keys: list[str], node_weight: float = 1.0, edge_weight: float = 1.0) -> DataFrame:
    """keys, node, edge, distance: weighted means of site and edge divergences (M6); no edges count 0."""
    a = nodes.groupBy(*keys).agg(F.avg("js").alias("node"))
    b = edges.groupBy(*keys).agg(F.avg("js").alias("edge"))
    edge = F.coalesce("edge", F.lit(0.0))
    return a.join(b, keys, "left").withColumn("edge", edge).withColumn("distance", F.lit(node_weight) * F.col("node") + F.lit(edge_weight) * F.col("edge"))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean of finite values with positive finite weights; null if there is none (A4)."""
    top = F.lit(float("inf"))
    sound = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < top) & (weight > 0) & ~F.isnan(weight) & (weight < top)
    return F.sum(F.when(sound, value * weight)) / F.sum(F.when(sound, weight))


def blended(nodes: DataFrame, edges: DataFrame, keys: list[str], node_weight: float, edge_weight: float) -> DataFrame:
    """keys, site, distance: a site's divergence with the weighted mean over its edges (M8). `edges` has weight d; where that is
    not positive, 1 counts. A site without edges keeps its own."""
    ends = edges.withColumn("site", F.explode(F.array("r", "s"))).withColumn("_w", F.when((F.col("d") > 0) & ~F.isnan("d"), F.col("d")).otherwise(1.0))
    per = ends.groupBy(*keys, "site").agg(weighted_mean(F.col("js"), F.col("_w")).alias("_edge"))
    mixed = F.lit(node_weight) * F.col("js") + F.lit(edge_weight) * F.coalesce("_edge", "js")
    return nodes.join(per, [*keys, "site"], "left").select(*keys, "site", mixed.alias("distance"))


def soft_sides(js_a: Column, js_b: Column, top_a: Column, top_b: Column) -> dict[str, Column]:
    """Weights of a site being like A, B, both or neither, and the heaviest."""
    near = lambda x, top: 1 - F.when(top > 0, F.least(F.lit(1.0), x / top)).otherwise(0.0)
    a, b = near(js_a, top_a), near(js_b, top_b)
    raw = {"a": a * (1 - b), "b": b * (1 - a), "shared": a * b, "other": (1 - a) * (1 - b)}
    out = {f"w_{k}": v for k, v in raw.items()}  # they sum to 1
    top = F.greatest(*raw.values())
    tag = F.coalesce(*[F.when(v == top, F.lit(k)) for k, v in raw.items()])
    return out | {"tag": tag}


def normalised_by_size(js: Column, k: Column) -> Column:
    """A divergence over the logarithm of the alphabet's size, 0 where that is not positive."""
    return F.when(k > 1, js / F.ln(k)).otherwise(0.0)


def largest_difference(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.max(F.abs(F.col("p") - F.col("q"))).alias("largest"))


def zero_filled_profile(frames: DataFrame, site: int, by: str = "sample_id") -> DataFrame:
    """by, label, p of one site; the alphabet ends with the greatest label seen anywhere."""
    counts = frames.select(by, F.col("labels")[site].alias("label")).where("label >= 0").groupBy(by, "label").agg(F.count(F.lit(1)).alias("n"))
    top = counts.withColumn("_top", F.max("label").over(Window.partitionBy(F.lit(0))))  # counts: a row per sample and label
    total = top.groupBy(by).agg(F.sum("n").alias("_total"), F.max("_top").alias("_top"), F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("_seen"))
    out = total.withColumn("label", F.explode(F.sequence(F.lit(0), F.col("_top"))))
    return out.select(by, "label", (F.coalesce(F.try_element_at("_seen", "label"), F.lit(0)) / F.col("_total")).alias("p"))

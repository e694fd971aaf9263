"""Ordered aggregates: ranks, curves, thresholds, top-k, histograms.

An order of many rows is dealt by ranges of its value (`running`), so a key with most of the rows is many tasks, not one.
Windows run within keys of few rows, or over counts.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motley.functions.columns import interpolated
from motley.sources.tables import kept

#: Ranges that quantiles are narrowed down to.
SLOTS = 128


def _slotted(df: DataFrame, value: str, n: int) -> DataFrame:
    """df with _slot: which of about n ranges of like many rows the value lies in; those without a number come last."""
    number = F.col(value).cast("double")
    cuts = sorted({float(x) for x in df.select(number.alias("_x")).where("_x is not null and not isnan(_x)").approxQuantile("_x", [i / n for i in range(1, n)], 0.1 / n)}) or [0.0]
    cut = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="_x", outputCol="_slot", handleInvalid="keep")
    return cut.transform(df.withColumn("_x", F.coalesce(number, F.lit(float("nan"))))).drop("_x")


def running(df: DataFrame, keys: list[str], value: str, ties: list[str], weights: dict[str, Column]) -> DataFrame:
    """df with, for each weight, `name`: its sum over the rows of the key that come before by value and ties, and `name_all`: over all.

    The order is cut into as many ranges as there are shuffle partitions; sums of the ranges, a row a key and range, are added to those
    within a range. Null values come last. With ties the ranges are of value and ties, so equal values of most of the rows are many
    tasks, and the rows are written once with their range; without, they are of the value, and only cut points reach the driver.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumns({f"_w{i}": w for i, w in enumerate(weights.values())})
    if ties:
        rows = kept(rows.repartitionByRange(n, F.col(value).asc_nulls_last(), *ties).withColumn("_slot", F.spark_partition_id()), "order")
    else:
        rows = _slotted(rows, value, n)
    names = list(weights)
    sums = rows.groupBy(*keys, "_slot").agg(*[F.sum(f"_w{i}").alias(f"_s{i}") for i in range(len(names))])
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = by.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"_run_key{i}") for i, k in enumerate(keys)], F.col("_slot").alias("_run_slot"), *[F.coalesce(F.sum(f"_s{i}").over(before), F.lit(0)).alias(f"_b{i}") for i in range(len(names))], *[F.sum(f"_s{i}").over(by).alias(f"_a{i}") for i in range(len(names))])
    on = F.col("_slot") == F.col("_run_slot")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_run_key{i}"))
    within = Window.partitionBy(*keys, "_slot").orderBy(F.col(value).asc_nulls_last(), *ties).rowsBetween(Window.unboundedPreceding, -1)
    own = [F.coalesce(F.sum(f"_w{i}").over(within), F.lit(0)).alias(f"_o{i}") for i in range(len(names))]
    out = rows.select(*df.columns, "_slot", *own).join(sums, on)
    return out.select(*df.columns, *[(F.col(f"_o{i}") + F.col(f"_b{i}")).alias(n) for i, n in enumerate(names)], *[F.col(f"_a{i}").alias(f"{n}_all") for i, n in enumerate(names)])


def placed(df: DataFrame, keys: list[str], value: str, ties: list[str]) -> DataFrame:
    """df with place (from 0, by value and ties within the key) and place_all: the key's rows."""
    return running(df, keys, value, ties, {"place": F.lit(1).cast("long")})


def histogram(df: DataFrame, keys: list[str], value: str, bins: int, low: float, high: float) -> DataFrame:
    """keys, bin, density over shared bins from low to high, the last one closed (A8); values outside count nowhere. Empty bins have no row."""
    width = (high - low) / bins
    at = F.least(F.floor((F.col(value) - low) / width).cast("int"), F.lit(bins - 1))
    counts = df.where(F.col(value).between(low, high)).groupBy(*keys, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return counts.withColumn("density", F.col("n") / (total * width))


def cumulative(df: DataFrame, keys: list[str], at: str, n: str) -> DataFrame:
    """df with cdf: the running sum of n over its total."""
    by = Window.partitionBy(*keys)
    return df.withColumn("cdf", F.sum(n).over(by.orderBy(at)) / F.sum(n).over(by))


def mean_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """df with rank: ties share the mean of their ranks (W3). Ranks run over counts of values, then go back to the rows."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranks = running(counts, keys, value, [], {"_before": F.col("_n")})
    return df.join(ranks.select(*keys, value, (F.col("_before") + (F.col("_n") + 1) / 2).alias("rank")), [*keys, value])


def auc(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """keys, auc by rank sums (W4); null if a class is empty. Scores are counted per value first, once, so ranks run over values, not rows."""
    counts = kept(df.groupBy(*keys, score).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n")), "scores")
    ranked = running(counts, keys, score, [], {"_before": F.col("n")}).withColumn("rank", F.col("_before") + (F.col("n") + 1) / 2)
    sums = ranked.groupBy(*keys).agg(F.sum("pos").alias("pos"), F.sum(F.col("n") - F.col("pos")).alias("neg"), F.sum(F.col("rank") * F.col("pos")).alias("sum"))
    value = (F.col("sum") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * F.col("neg"))
    return sums.select(*keys, F.when((F.col("pos") > 0) & (F.col("neg") > 0), value).alias("auc"))


def roc(df: DataFrame, keys: list[str], score: str, label: str, tie: str) -> DataFrame:
    """keys, step, fpr, tpr by falling score, a point per row, (0, 0) first."""
    y = F.col(label).cast("long")
    rows = df.select(*keys, (-F.col(score)).alias("_down"), tie, y.alias("_y"))
    run = running(rows, keys, "_down", [tie], {"_n": F.lit(1).cast("long"), "_pos": F.col("_y"), "_neg": 1 - F.col("_y")})
    rate = lambda n, own: (F.col(n) + own) / F.when(F.col(f"{n}_all") > 0, F.col(f"{n}_all"))
    points = run.select(*keys, (F.col("_n") + 1).alias("step"), rate("_neg", 1 - F.col("_y")).alias("fpr"), rate("_pos", F.col("_y")).alias("tpr"))
    first = df.select(*keys).distinct().select(*keys, F.lit(0).cast("long").alias("step"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(first)


def trapezoid(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, area under the curve over its span; of a single point, y."""
    by = Window.partitionBy(*keys).orderBy(x)
    part = (F.col(x) - F.lag(x).over(by)) * (F.col(y) + F.lag(y).over(by)) / 2
    sums = df.withColumn("_part", part).groupBy(*keys).agg(F.sum("_part").alias("_sum"), (F.max(x) - F.min(x)).alias("_span"), F.min_by(y, x).alias("_first"))
    return sums.select(*keys, F.when(F.col("_span") > 0, F.col("_sum") / F.col("_span")).otherwise(F.col("_first")).alias("area"))


def crossing(df: DataFrame, keys: list[str], x: str, y: str, target: float, unreached: float) -> DataFrame:
    """keys, at: where y first reaches the target, by a line between points."""
    by = Window.partitionBy(*keys).orderBy(x)
    before = F.lag(F.struct(F.col(x), F.col(y))).over(by)
    rows = df.withColumn("_b", before).groupBy(*keys).agg(F.min_by(F.struct(x, y, "_b"), F.when(F.col(y) >= target, F.col(x))).alias("_at"), F.min(F.when(F.col(y) >= target, F.col(x))).alias("_hit"))
    at = interpolated(F.col(f"_at._b.{x}"), F.col(f"_at._b.{y}"), F.col(f"_at.{x}"), F.col(f"_at.{y}"), target)
    return rows.select(*keys, F.when(F.col("_hit").isNull(), F.lit(unreached)).when(F.col("_at._b").isNull(), F.col("_hit")).otherwise(at).alias("at"))


def arg_min(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, x of the least y, ties to the smaller x."""
    return df.groupBy(*keys).agg(F.min_by(x, F.struct(y, x)).alias(x), F.min(y).alias(y))


def top_k(df: DataFrame, keys: list[str], value: Column, tie: str, k: int) -> DataFrame:
    """df's k greatest rows of each key with their rank, ties to the smaller `tie` (K1)."""
    by = Window.partitionBy(*keys).orderBy(value.desc(), tie)
    return df.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def percentile_rank(df: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """df with fast and slow: 1 - place / (n - 1) by rising value, and the rest to 1; alone, 1 and 0."""
    n = F.col("place_all")
    fast = F.when(n > 1, 1 - F.col("place") / (n - 1)).otherwise(1.0)
    return placed(df, keys, value, [tie]).withColumn("fast", fast).withColumn("slow", 1 - F.col("fast")).drop("place", "place_all")


def window_distribution(df: DataFrame, keys: list[str], order: str, label: str, reach: int) -> DataFrame:
    """Each row's labels in the rows from `reach` before to `reach` after it, and how many each has."""
    by = Window.partitionBy(*keys).orderBy(order)
    near = F.collect_list(label).over(by.rowsBetween(-reach, reach))
    long = df.select(*keys, order, near.alias("_near")).select(*keys, order, F.size("_near").alias("_n"), F.explode("_near").alias(label))
    return long.groupBy(*keys, order, "_n", label).agg((F.count(F.lit(1)) / F.col("_n")).alias("p")).drop("_n")


def first_change(df: DataFrame, keys: list[str], order: str, label: str, last: int) -> DataFrame:
    """keys, step of the first row whose label is not the first row's, from 0; last + 1 if none is."""
    by = Window.partitionBy(*keys).orderBy(order)
    rows = df.withColumn("_t", F.row_number().over(by) - 1).withColumn("_x", F.first(label).over(by))
    return rows.groupBy(*keys).agg(F.coalesce(F.min(F.when(~F.col(label).eqNullSafe(F.col("_x")), F.col("_t"))), F.lit(last + 1)).cast("long").alias("step"))


def lagged_pairs(df: DataFrame, keys: list[str], order: str, value: str, lag: int) -> DataFrame:
    """keys, from, to of rows `lag` apart within a key."""
    by = Window.partitionBy(*keys).orderBy(order)
    return df.select(*keys, F.col(value).alias("from"), F.lead(value, lag).over(by).alias("to")).where("`to` is not null")


def representative(df: DataFrame, keys: list[str], values: list[str], tie: str) -> DataFrame:
    """keys, and of the row nearest to its key's means: tie and squared distance."""
    means = df.groupBy(*keys).agg(*[F.avg(v).alias(f"_{v}") for v in values])
    d2 = sum(((F.col(v) - F.col(f"_{v}")) * (F.col(v) - F.col(f"_{v}")) for v in values), F.lit(0.0))
    near = df.join(means, keys).withColumn("distance2", d2)
    return near.groupBy(*keys).agg(F.min_by(tie, F.struct("distance2", tie)).alias(tie), F.min("distance2").alias("distance2"))


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """keys, median: the least value with half of the weight at or below it (W15); and the share of its ties below the half."""
    sums = df.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    by = Window.partitionBy(*keys)
    run = sums.withColumn("_cum", F.sum("_w").over(by.orderBy(value)) / F.sum("_w").over(by)).withColumn("_p", F.col("_w") / F.sum("_w").over(by))
    hit = run.where("_cum >= 0.5")
    out = hit.groupBy(*keys).agg(F.min(value).alias("median"), F.min_by(F.struct("_cum", "_p"), value).alias("_at"))
    return out.select(*keys, "median", ((0.5 - (F.col("_at._cum") - F.col("_at._p"))) / F.col("_at._p")).alias("tie_share"))


def mid_rank(df: DataFrame, references: DataFrame, keys: list[str], value: str, eps: float = 1e-9) -> DataFrame:
    """df with percentile: the share of the key's reference values below, half of the equal ones added (W16); null without references.

    Each row asks twice, a little below its value and a little above; questions and references are one order, dealt by ranges.
    """
    rows = df.withColumn("_row", F.monotonically_increasing_id())
    ask = lambda shift, kind: F.struct((F.col(value) + F.lit(shift)).alias("_at"), F.lit(kind).alias("_kind"))
    asked = rows.select(*keys, "_row", F.explode(F.array(ask(-eps, 0), ask(eps, 2))).alias("_q")).select(*keys, "_row", "_q.*", F.lit(0).cast("long").alias("_ref"))
    refs = references.where(F.col(value).isNotNull()).select(*keys, F.lit(None).cast("long").alias("_row"), F.col(value).alias("_at"), F.lit(1).alias("_kind"), F.lit(1).cast("long").alias("_ref"))
    found = running(asked.unionByName(refs), keys, "_at", ["_kind"], {"_below": F.col("_ref")}).where("_kind != 1")
    per = found.groupBy("_row").agg((F.sum("_below") / 2).alias("_sum"), F.max("_below_all").alias("_all"))
    return rows.join(per, "_row").withColumn("percentile", F.col("_sum") / F.when(F.col("_all") > 0, F.col("_all"))).drop("_row", "_sum", "_all")


def deviation(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, median, mad: median absolute deviation; where it is 0 the standard deviation, where that is too, 1."""
    middle = quantiles(df, keys, value, (0.5,)).toDF(*keys, "median").join(df.groupBy(*keys).agg(F.stddev_pop(value).alias("_std")), keys)
    far = df.join(middle, keys).withColumn("_d", F.abs(F.col(value) - F.col("median")))
    out = quantiles(far, [*keys, "median", "_std"], "_d", (0.5,)).toDF(*keys, "median", "_std", "_mad")
    return out.select(*keys, "median", F.when(F.col("_mad") > 0, F.col("_mad")).when(F.col("_std") > 0, F.col("_std")).otherwise(1.0).alias("mad"))


def quantiles(df: DataFrame, keys: list[str], value: str, at: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """keys, q25, q50, ...: by linear interpolation (A7); nulls do not count.

    Rows are counted by SLOTS ranges of the value first; only those of the ranges that hold a place asked for are exchanged, counted by
    value and put in order. So what a task holds is a small part of the rows, however many there are.
    """
    rows = _slotted(df.where(F.col(value).isNotNull()).select(*keys, value), value, SLOTS)
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    sums = rows.groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("_q_in"))
    sums = sums.withColumn("_q_first", F.coalesce(F.sum("_q_in").over(by.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_q_all", F.sum("_q_in").over(by))
    place = lambda q: F.lit(q) * (F.col("_q_all") - 1)
    ends = [f(place(q)) for q in at for f in (F.floor, F.ceil)]
    asked = reduce(or_, [(F.col("_q_first") <= i) & (i < F.col("_q_first") + F.col("_q_in")) for i in ends])
    wanted = kept(sums.where(asked).select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_slot").alias("_asked"), "_q_first", "_q_all"), "ranges")
    on = F.col("_slot") == F.col("_asked")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    counts = rows.join(wanted, on).groupBy(*keys, "_slot", value, "_q_first", "_q_all").agg(F.count(F.lit(1)).alias("_n"))
    within = Window.partitionBy(*keys, "_slot").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    run = counts.withColumn("_before", F.col("_q_first") + F.coalesce(F.sum("_n").over(within), F.lit(0)))
    held = lambda i: F.max(F.when((F.col("_before") <= i) & (i < F.col("_before") + F.col("_n")), F.col(value)))
    found = [x.alias(f"_{k}{j}") for j, q in enumerate(at) for k, x in (("low", held(F.floor(place(q)))), ("high", held(F.ceil(place(q)))), ("part", F.max(place(q) - F.floor(place(q)))))]
    out = run.groupBy(*keys).agg(*found)
    return out.select(*keys, *[(F.col(f"_low{j}") + (F.col(f"_high{j}") - F.col(f"_low{j}")) * F.col(f"_part{j}")).alias(f"q{round(q * 100):02d}") for j, q in enumerate(at)])

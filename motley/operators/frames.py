"""Filters and joins over frames (sample_id, frame_id, labels: array of int, null where unassigned)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motley.functions.columns import finite
from motley.operators.ordered import placed


def assigned(labels: Column) -> Column:
    return F.forall(labels, lambda x: x.isNotNull() & (x >= 0))


def drop_unassigned(frames: DataFrame) -> DataFrame:
    """Frames whose every site has a label (F1); no shuffle."""
    return frames.where(assigned(F.col("labels")))


def sanitized(frames: DataFrame, sizes: list[int], policy: str = "drop_frames") -> tuple[DataFrame, list[int]]:
    """Frames without gaps and the sizes of their alphabets (F2).

    drop_frames leaves frames with gaps out; treat_as_state gives a gap a label of its own, at sites that have gaps
    only; error raises if there is one.
    """
    if policy == "drop_frames":
        return drop_unassigned(frames), sizes
    if policy == "error":
        if frames.where(~assigned(F.col("labels"))).limit(1).count():
            raise ValueError("there are unassigned labels")
        return frames, sizes
    if policy != "treat_as_state":
        raise ValueError(f"unknown policy: {policy}")
    gaps = frames.select(*[F.max((F.coalesce(F.col("labels")[i], F.lit(-1)) < 0).cast("int")).alias(f"s{i}") for i in range(len(sizes))]).first()
    k = F.array(*[F.lit(x) for x in sizes])
    labels = F.transform("labels", lambda x, i: F.when(F.coalesce(x, F.lit(-1)) < 0, k[i]).otherwise(x))
    return frames.withColumn("labels", labels), [n + (g or 0) for n, g in zip(sizes, gaps, strict=True)]


def valid_only(frames: DataFrame) -> DataFrame:
    """Frames that are not marked invalid; a missing mark is none."""
    return frames.where(~F.coalesce("invalid", F.lit(False))).drop("invalid")


def paired(left: DataFrame, right: DataFrame, column: str, left_name: str, right_name: str) -> DataFrame:
    """Every left id beside every right one (J4): ids of samples, a few (a thousand at most), not their frames."""
    kind, ids = right.schema[column].dataType, [r[0] for r in right.select(column).distinct().limit(1001).collect()]
    if len(ids) > 1000:
        raise ValueError("too many samples to compare each with each")
    return left.select(F.col(column).alias(left_name), F.explode(F.array(*[F.lit(x).cast(kind) for x in ids])).alias(right_name))


def out_of_range(frames: DataFrame, sizes: list[int]) -> DataFrame:
    """sample_id, frame_id, site, label of labels beyond their alphabet (F3); an empty result is a sound table."""
    k = F.array(*[F.lit(x) for x in sizes])
    long = frames.select("sample_id", "frame_id", F.posexplode("labels").alias("site", "label"))
    return long.where((F.col("label") >= k[F.col("site")]) | (F.col("label") < 0))


def only_states(df: DataFrame, column: str, wanted: list) -> DataFrame:
    """Rows of the wanted states; an error if there is none."""
    kept = df.where(F.col(column).isin(wanted))
    if not kept.limit(1).count():
        raise ValueError(f"no rows of {wanted}")
    return kept


def thinned(df: DataFrame, key: str | None, order: str, most: int) -> DataFrame:
    """Every (n // most)-th row of each key, in order."""
    rows = placed(df, [key] if key else [], order, [])
    return rows.where(F.col("place") % F.greatest(F.lit(1), F.floor(F.col("place_all") / most)) == 0).select(*df.columns)


def evenly_spread(df: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """At most `most` rows of each key at even distances, the first and last among them."""
    rows, i, n = placed(df, [key], order, []), F.col("place"), F.col("place_all")
    # row i is kept if it is floor(j * (n - 1) / (most - 1)) for a whole j
    hit = F.floor(F.ceil(i * (most - 1) / (n - 1)) * (n - 1) / (most - 1)) == i
    return rows.where((n <= most) | hit).select(*df.columns)


def hashed_sample(df: DataFrame, id_column: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, the same ones each time (F8): those of the smallest digests of seed and id. A take-ordered."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_column).cast("string"))), id_column).limit(n)


def has_values(values: Column) -> Column:
    """An array with a number in it that is finite and not all but zero."""
    return F.exists(values, lambda x: finite(x).isNotNull() & (F.abs(x) > 1e-12))


def informative_columns(angles: DataFrame, key: str, values: str) -> DataFrame:
    """key, column: columns of `values` with a finite number not near 0; where a key has none, its columns with finite numbers."""
    long = angles.select(key, F.posexplode(values).alias("column", "x")).withColumn("x", finite(F.col("x")))
    per = long.groupBy(key, "column").agg(F.count("x").alias("n"), F.coalesce(F.max(F.abs("x")), F.lit(0.0)).alias("most")).where("n > 0")
    told = F.max((F.col("most") >= 1e-12).cast("int")).over(Window.partitionBy(key))
    return per.withColumn("_told", told).where((F.col("most") >= 1e-12) | (F.col("_told") == 0)).select(key, "column")


def duplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unique_slugs(df: DataFrame, slug: Column, order: str, name: str = "slug") -> DataFrame:
    """A slug per row; further rows of one slug get _2, _3, ... by order."""
    nth = F.row_number().over(Window.partitionBy("_slug").orderBy(order))
    out = df.withColumn("_slug", slug).withColumn("_nth", nth)
    return out.withColumn(name, F.when(F.col("_nth") == 1, F.col("_slug")).otherwise(F.concat_ws("_", "_slug", F.col("_nth").cast("string")))).drop("_slug", "_nth")


def orphans(references: DataFrame, known: DataFrame, owner: str, ref: str, kind: str) -> DataFrame:
    """Owners to be removed (F16): an essential reference that is missing, or optional ones of which none is left.

    `references` has owner, ref and kind ('essential' or 'optional'); `known` has ref.
    """
    marked = references.join(known.select(ref).distinct().withColumn("_known", F.lit(1)), ref, "left")
    gone = F.col("_known").isNull()
    per = marked.groupBy(owner).agg(
        F.coalesce(F.max(F.when(F.col(kind) == "essential", gone.cast("int"))), F.lit(0)).alias("lost"),
        F.coalesce(F.min(F.when(F.col(kind) == "optional", gone.cast("int"))), F.lit(0)).alias("bare"),
    )
    return per.where((F.col("lost") == 1) | (F.col("bare") == 1)).select(owner)


def matched_rows(left: DataFrame, right: DataFrame, keys: list[str], left_order: str, right_order: str) -> DataFrame:
    """left with `match`: the right row's order value, where the k-th row of a key meets the k-th (J1); null if there is none."""
    nth = lambda df, by: df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(by)))
    other = nth(right, right_order).select(*keys, "_nth", F.col(right_order).alias("match"))
    return nth(left, left_order).join(other, [*keys, "_nth"], "left").drop("_nth")


def latest(df: DataFrame, keys: list[str], order: str, tie: str) -> DataFrame:
    """The newest row of each key, ties to the smaller `tie` (J15): an aggregate, not a window over the whole group."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.col(order), -F.col(tie)))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*")


def vote(neighbours: DataFrame, key: str, k: int) -> DataFrame:
    """The commonest label of each key's k nearest rows, ties to the smallest label (J10). `neighbours`: key, distance, label, id."""
    near = neighbours.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("distance", "id"))).where(F.col("_r") <= k)
    counts = near.groupBy(key, "label").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))


def contact_edges(sites: DataFrame, cutoff: float) -> DataFrame:
    """r, s of sites (site, x, y, z) nearer than the cutoff (J8): sites meet through cells of that width, not all with all. Each
    pair of neighbouring cells meets once: a site goes to its own cell and to the 13 that come after it."""
    after = [(0, 0, 0), *[(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (x, y, z) > (0, 0, 0)]]
    own = sites.select("site", "x", "y", "z", *[F.floor(F.col(c) / cutoff).cast("long").alias(f"c{c}") for c in "xyz"])
    step = F.explode(F.array(*[F.struct(*[F.lit(v).alias(f"d{c}") for c, v in zip("xyz", d, strict=True)]) for d in after]))
    other = own.withColumn("_d", step).select(F.col("site").alias("s"), *[F.col(c).alias(f"{c}2") for c in "xyz"], *[(F.col(f"c{c}") + F.col(f"_d.d{c}")).alias(f"c{c}") for c in "xyz"], (F.col("_d.dx") == 0).alias("_x"), (F.col("_d.dy") == 0).alias("_y"), (F.col("_d.dz") == 0).alias("_z"))
    met = own.join(other, ["cx", "cy", "cz"]).where("site < s or not (_x and _y and _z)").where("site != s")
    d2 = sum((F.col(a) - F.col(f"{a}2")) * (F.col(a) - F.col(f"{a}2")) for a in "xyz")
    return met.where(d2 < cutoff * cutoff).select(F.least("site", "s").alias("r"), F.greatest("site", "s").alias("s")).distinct()


def edge_set(edges: DataFrame) -> DataFrame:
    """Edges with r < s, each once, no loops."""
    return edges.select(F.least("r", "s").alias("r"), F.greatest("r", "s").alias("s")).where("r < s").distinct()


def ordered_distinct(lists: DataFrame, id_column: str, part: str, position: str) -> DataFrame:
    """Ids of several lists, each once, by where it first stands."""
    first = F.min(F.struct(part, position)).alias("_first")
    return lists.groupBy(id_column).agg(first).orderBy("_first").select(id_column)

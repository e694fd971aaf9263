"""Dihedral features from coordinates, and how states' features are put together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motley.functions.columns import dihedral
from motley.operators.frames import has_values


def dihedrals(atoms: DataFrame, definitions: DataFrame) -> DataFrame:
    """state_id, frame_index, site, angles of all definitions of a site, by name (D1, D2); an angle of missing atoms is 0.

    `atoms`: state_id, frame_index, site, atom, xyz. `definitions`: site, name, and for each of four atoms its site and
    name (s1, a1 ... s4, a4). A frame's atoms are one map, so the four look-ups need one shuffle, not four joins.
    """
    keyed = atoms.groupBy("state_id", "frame_index").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("site", "atom"), "xyz"))).alias("_at"))
    defs = [r.asDict() for r in definitions.collect()]  # a few per site
    by_site: dict[int, list[dict]] = {}
    for x in sorted(defs, key=lambda x: (x["site"], x["name"])):
        by_site.setdefault(x["site"], []).append(x)
    point = lambda x, i: F.try_element_at("_at", F.struct(F.lit(x[f"s{i}"]).cast("int").alias("site"), F.lit(x[f"a{i}"]).alias("atom")))
    rows = [F.struct(F.lit(s).alias("site"), F.array(*[F.coalesce(dihedral(*[point(x, i) for i in range(1, 5)]), F.lit(0.0)) for x in v]).alias("angles")) for s, v in by_site.items()]
    return keyed.select("state_id", "frame_index", F.inline(F.array(*rows)))


def group_features(angles: DataFrame, groups: DataFrame) -> DataFrame:
    """group_id, state_id, frame_index, angles: the sites' angles of a group side by side, by site (D3); a group of which a
    site is missing in a frame has no row there. `groups`: group_id, site."""
    members = groups.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("group_id")))
    met = angles.join(F.broadcast(members), "site")  # a row per member: small
    out = met.groupBy("group_id", "state_id", "frame_index", "_n").agg(F.array_sort(F.collect_list(F.struct("site", "angles"))).alias("_a"))
    return out.where(F.size("_a") == F.col("_n")).select("group_id", "state_id", "frame_index", F.flatten("_a.angles").alias("angles"))


def frame_vectors(angles: DataFrame) -> DataFrame:
    """state_id, frame_index, vector: all sites' angles of a frame, by site."""
    rows = angles.groupBy("state_id", "frame_index").agg(F.array_sort(F.collect_list(F.struct("site", "angles"))).alias("_a"))
    return rows.select("state_id", "frame_index", F.flatten("_a.angles").alias("vector"))


def common_sites(angles: DataFrame, states: list) -> DataFrame:
    """Rows of sites that all of the states have."""
    some = angles.where(F.col("state_id").isin(states))
    full = some.select("state_id", "site").distinct().groupBy("site").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(states))
    return some.join(full.select("site"), "site", "left_semi")


def descriptor_rows(angles: DataFrame) -> DataFrame:
    """Rows of sites with a number that is finite and not about 0."""
    sound = angles.groupBy("site").agg(F.max(has_values(F.col("angles")).cast("int")).alias("ok")).where("ok = 1")
    return angles.join(sound.select("site"), "site", "left_semi")


def contact_positions(atoms: DataFrame) -> DataFrame:
    """site, x, y, z: the CA atom, or the centre of mass where there is none (D8). `atoms`: site, atom, mass, xyz."""
    mean = [F.coalesce(F.max(F.when(F.col("atom") == "CA", F.col("xyz")[i])), F.sum(F.col("mass") * F.col("xyz")[i]) / F.sum("mass")).alias(c) for i, c in enumerate("xyz")]
    return atoms.groupBy("site").agg(*mean)

"""The test tables as frames of labels, angles and trajectories; readers and writers of results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labels of each site of `lineitem_frames`.
SIZES = [3, 2, 5, 4, 3]
EDGES = [(r, s) for r in range(5) for s in range(r + 1, 5)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _line_labels() -> list[Column]:
    percent = lambda c: F.round(F.col(c) * 100).cast("int")
    return [
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2),
        F.when(F.col("l_linestatus") == "F", 0).otherwise(1),
        F.least(F.lit(4), F.floor(F.col("l_quantity") / 10).cast("int")),
        F.floor(percent("l_discount") / 3).cast("int"),
        F.floor(percent("l_tax") / 3).cast("int"),
    ]


def lineitem_frames(spark: SparkSession, sf_dir: str, gaps: bool = False) -> DataFrame:
    """sample_id (year shipped), frame_id, labels. With gaps, site i of an order is unassigned where (order + i) % 11 is 0."""
    labels = _line_labels()
    if gaps:
        labels = [F.when((F.col("l_orderkey") + i) % 11 != 0, x) for i, x in enumerate(labels)]
    frame = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").cast("long").alias("sample_id"), frame.alias("frame_id"), F.array(*labels).alias("labels"))


def embedding_angles(spark: SparkSession, sf_dir: str, sites: int = 16) -> DataFrame:
    """state_id, frame_index, site, angles: four components of each vector a site, times 2 pi, in [0, 2 pi)."""
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null")
    sliced = F.transform(F.sequence(F.lit(0), F.lit(sites - 1)), lambda s: F.transform(F.slice("embedding", s * 4 + 1, 4), lambda x: F.pmod(x.cast("double") * 2 * F.pi(), 2 * F.pi())))
    return rows.select(F.col("label").alias("state_id"), F.col("vec_id").alias("frame_index"), F.posexplode(sliced).alias("site", "angles"))


def sliced(df: DataFrame, column: str, start: int = 0, stop: int | None = None, step: int = 1) -> DataFrame:
    """Rows start:stop:step of a numbering column; a range filter that reaches the scan, and a modulo."""
    if step < 1 or start < 0:
        raise ValueError("start must not be negative and step must be positive")
    at = F.col(column)
    kept = (at >= start) & ((at - start) % step == 0)
    return df.where(kept if stop is None else kept & (at < stop))


def write_table(df: DataFrame, path: str, by: list[str] | None = None, version: str | None = None) -> str:
    """Writes Parquet, by folders of `by`; a version goes to its own folder, so readers of others see no change."""
    path = f"{path}/version={version}" if version else path
    out = df.write.mode("overwrite")
    (out.partitionBy(*by) if by else out).parquet(path)
    return path


def read_frames(spark: SparkSession, path: str, assigned: bool = True) -> DataFrame:
    """Stored frames; labels of older tables stand under `assigned_labels` or `labels_halo` (S5). -1 is unassigned."""
    df = spark.read.parquet(path)
    names = [c for c in (("labels", "assigned_labels") if assigned else ("labels_halo", "labels")) if c in df.columns]
    if not names:
        raise ValueError(f"{path} has no labels")
    labels = F.coalesce(*[F.col(c) for c in names])
    return df.withColumn("labels", F.transform(labels, lambda x: F.when(x >= 0, x)))


def read_records(spark: SparkSession, path: str, schema: str, kind: str | None = None) -> DataFrame:
    """JSON records under a folder, with the file each came from, newest first."""
    df = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path).withColumn("source_file", F.col("_metadata.file_path"))
    if kind is not None:
        df = df.where(F.col("analysis_type") == kind)
    return df.orderBy(F.desc("created_at"))


def append_csv(df: DataFrame, path: str, version: int) -> None:
    """Appends rows under a header with a version; a folder of another header is refused."""
    spark = df.sparkSession
    out = df.withColumn("schema_version", F.lit(version))
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        old = spark.read.option("header", True).csv(path)
        if old.columns != out.columns or old.where(F.col("schema_version") != str(version)).limit(1).count():
            raise ValueError(f"{path} has another header or version")
    out.write.mode("append").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def only_sources(df: DataFrame, column: str, wanted: list[str]) -> DataFrame:
    """Rows of the wanted sources; a missing one is an error."""
    have = {r[0] for r in df.where(F.col(column).isin(wanted)).select(column).distinct().collect()}  # no more than asked for
    if missing := sorted(set(wanted) - have):
        raise ValueError(f"no such sources: {missing}")
    return df.where(F.col(column).isin(wanted))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for tables that driver and executors share, under spark.checkpoint.dir; where that is unset, on one machine, one of our own."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="motley-")
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/motley-{uuid.uuid4().hex}/{name}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read again: later jobs do not recompute it, a lost executor costs only what it was writing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_records(df: DataFrame, path: str) -> None:
    """Rows as JSON records, some files."""
    df.write.mode("append").json(path)


def replaced(spark: SparkSession, path: str, version: str, change: Callable[[DataFrame], DataFrame], new_version: str) -> DataFrame:
    """A stored version read, changed and written as a new one; the old one stays as it is."""
    return spark.read.parquet(write_table(change(spark.read.parquet(f"{path}/version={version}")), path, version=new_version))

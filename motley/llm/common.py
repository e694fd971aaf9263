"""What the operators of this subpackage share: tables, the shared folder, order, text batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once inside a task, in bytes: bounds a task's memory whatever the Arrow batch holds.
SLICE_BYTES = 4 << 20


#: Odd multipliers of the hashes made of other hashes. (fixed values)
MIX_A, MIX_B, STEP = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(30)) * np.uint64(MIX_A)
        x = (x ^ x >> np.uint64(27)) * np.uint64(MIX_B)
        return x ^ x >> np.uint64(31)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset: on one machine, a folder of our own;
    on a cluster an error, as what is written there would be lost with its executor."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="motley-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read again: later jobs do not recompute it,
    and a lost executor costs only what it was writing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/motley-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `most` bytes of text each; a longer text is a run of its own."""
    sizes = pc.binary_length(batch.column(column).cast(pa.large_string())).fill_null(0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if first < batch.num_rows:
        yield batch.slice(first)


def texts_of(column: pa.Array) -> list[str]:
    """The texts; a null is empty."""
    return [x or "" for x in column.to_pylist()]


def in_order(df: DataFrame, key: str, *ties: str, guests: bool = False) -> DataFrame:
    """df dealt by ranges of `key` and sorted within each; a range is a `slot` (int, ascending with the key; nulls last).

    Cut points are quantiles of the key, as many as shuffle partitions. With guests, the first row of each
    range also comes last in the range before it (of the first range: in the last one), marked by `guest`,
    so a task can see each row's successor. Only cut points and one first key per range reach the driver.
    """
    spark = df.sparkSession
    n = partitions(spark)
    as_double = F.coalesce(F.col(key).cast("double"), F.lit(float("nan")))
    cuts = sorted({float(x) for x in df.select(F.col(key).cast("double").alias("k")).where("k is not null").approxQuantile("k", [i / n for i in range(1, n)], 0.1 / n)}) or [0.0]
    cut = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="_k", outputCol="_slot", handleInvalid="keep")
    df = cut.transform(df.withColumn("_k", as_double)).withColumn("slot", F.col("_slot").cast("int")).drop("_k", "_slot")
    guest = F.lit(False)
    if guests:
        firsts = sorted((r["slot"], r["first"]) for r in df.groupBy("slot").agg(F.min(key).alias("first")).collect())  # one row a range
        before = [(a, f, b) for (b, _), (a, f) in pairwise([*firsts[-1:], *firsts])]
        heads = spark.createDataFrame(before, f"slot int, _first {df.schema[key].dataType.simpleString()}, _before int")
        own = F.struct(F.col("slot").alias("slot"), F.lit(False).alias("guest"))
        sent = F.struct(F.col("_before").alias("slot"), F.lit(True).alias("guest"))
        df = df.join(F.broadcast(heads), "slot")  # at most one row a range
        df = df.withColumn("_at", F.explode(F.when(F.col(key).eqNullSafe(F.col("_first")), F.array(own, sent)).otherwise(F.array(own))))
        df = df.drop("slot", "_first", "_before").select("*", "_at.slot", "_at.guest").drop("_at")
        guest = F.col("guest")
    return df.repartitionById(len(cuts) + 2, "slot").sortWithinPartitions("slot", guest, F.col(key).asc_nulls_last(), *ties)


def spread(big: DataFrame, small: DataFrame, key: str, by: str) -> DataFrame:
    """big joined with small on key. `small` has each key once, with n: how many rows of big have it.

    Keys of more than their share of the rows (a quarter of a task's) go to several tasks, by the hash of `by`; they are fewer than four
    times the tasks, and only they are repeated in small, by powers of two, eight times the tasks in all at most. n is left out of
    the result; `small` is read up to three times, so give a stored table.
    """
    total, most = small.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    share = max(1, total // (4 * partitions(big.sparkSession)))
    copies, tiers = F.lit(1), {}
    if most > share:
        for r in small.where(F.col("n") > share).select(key, "n").collect():  # under 4 * partitions rows
            tiers.setdefault((-(-r["n"] // share) - 1).bit_length(), []).append(r[key])
    for tier, keys in tiers.items():
        copies = F.when(F.col(key).isin(keys), F.lit(1 << tier)).otherwise(copies)
    a = big.withColumn("_salt", F.pmod(F.xxhash64(by), copies).cast("int"))
    b = small.drop("n").withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1)))
    return a.join(b, [key, "_salt"]).drop("_salt")


def streamed(rows: DataFrame, keys: list[str], work: Callable[[pa.RecordBatch, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What `work` makes of whole groups of equal keys (no nulls): rows come sorted, so no group is gathered before it is read.

    work gets some rows and where their groups begin, and the number of rows last; a task holds one Arrow batch and one group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = pa.concat_batches([rest, batch]) if rest is not None else batch
            columns = [batch.column(k).to_numpy() for k in keys]
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            bounds = np.concatenate(([0], new))
            if len(new):
                yield from work(batch.slice(0, int(bounds[-1])), bounds)
            rest = batch.slice(int(bounds[-1]))
        if rest is not None:
            yield from work(rest, np.array([0, rest.num_rows]))

    dealt = rows.repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(released(run), schema)


def least_hashed(df: DataFrame, most: int, *by: str) -> DataFrame:
    """At most `most` rows, those of the smallest hashes of `by`: the same ones each time. A threshold on the hash leaves about
    four times as many before they are ordered, so what meets in one task does not grow with the input."""
    place, n = F.pmod(F.xxhash64(*by), F.lit(1 << 40)), df.count()
    if n > 4 * most:
        df = df.where(place < int((1 << 40) * (4 * most / n)))
    return df.orderBy(place, *by).limit(most)


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file."""
    return public_tokenizers.path(name)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, after which the memory that its arrays no longer use goes back to the system: workers stay for later stages."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return work

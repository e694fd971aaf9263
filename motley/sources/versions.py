"""Tables in versions: parts are written first, then a manifest that names them is published at once.

A version is a manifest file, numbered; it appears whole or not at all, and never changes. So a reader sees all of a version, a
writer that began from an older one is refused, a part that no manifest names is never read, and a batch that is
committed again (as a stream may do after a failure) is not added twice. Files are reached through Hadoop's file systems.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of a version before an append makes one of them.
MOST_PARTS = 50


class StaleVersion(RuntimeError):
    """Another writer has published a version since the one that a change began from."""


class Version(NamedTuple):
    """number (0: none yet), the folders of its parts, and the batches that are in it."""

    number: int
    parts: list[str]
    batches: list[str]


def _store(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, place.getFileSystem(conf), conf


def _path(jvm, *names: str):
    return jvm.org.apache.hadoop.fs.Path("/".join(names))


def current(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """The newest version, or the one of that number."""
    jvm, store, _ = _store(spark, path)
    folder = _path(jvm, path, "_versions")
    if not store.exists(folder):
        return Version(0, [], [])
    numbers = [int(n[:-5]) for s in store.listStatus(folder) if (n := s.getPath().getName()).endswith(".json") and n[:-5].isdigit()]
    wanted = max(numbers, default=0) if number is None else number
    if not wanted:
        return Version(0, [], [])
    if wanted not in numbers:
        raise ValueError(f"{path} has no version {wanted}")
    text = spark.read.text(f"{path}/_versions/{wanted:020d}.json", wholetext=True).first()[0]
    return Version(wanted, *(json.loads(text)[k] for k in ("parts", "batches")))


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The rows of the newest version, or of the one of that number."""
    found = current(spark, path, number)
    if not found.parts:
        raise ValueError(f"{path} has no version with rows")
    return spark.read.parquet(*[f"{path}/{p}" for p in found.parts])


def _published(spark: SparkSession, path: str, base: Version, parts: list[str], batches: list[str]) -> Version:
    """The version after `base`, by moving a finished file to a name that must not be taken."""
    jvm, store, conf = _store(spark, path)
    new = Version(base.number + 1, parts, batches)
    draft, name = _path(jvm, path, "_versions", f"_{uuid.uuid4().hex}"), _path(jvm, path, "_versions", f"{new.number:020d}.json")
    out = store.create(draft, False)
    out.write(bytearray(json.dumps({"parts": parts, "batches": batches}).encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        whole = store.makeQualified(name)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), conf).rename(store.makeQualified(draft), whole, options)
    except Exception as error:
        store.delete(draft, False)
        if store.exists(name):
            raise StaleVersion(f"{path}: version {new.number} is there already") from error
        raise
    return new


def _written(df: DataFrame, path: str) -> str:
    name = f"part-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    return name


def append(df: DataFrame, path: str, batch: str | None = None, tries: int = 5) -> Version:
    """The rows of df added as a part; a batch that is in the table already adds nothing. Appends do not hinder each other: one that
    was overtaken is published after the other, `tries` times at most. Beyond MOST_PARTS parts all become one."""
    spark = df.sparkSession
    base = current(spark, path)
    if batch is not None and batch in base.batches:
        return base
    part = _written(df, path)
    for _ in range(tries):
        parts = [*base.parts, part]
        if len(parts) > MOST_PARTS:
            parts = [_written(spark.read.parquet(*[f"{path}/{p}" for p in parts]), path)]
        try:
            return _published(spark, path, base, parts, [*base.batches, *([batch] if batch is not None else [])])
        except StaleVersion:
            base = current(spark, path)
            if batch is not None and batch in base.batches:
                return base
    raise StaleVersion(f"{path}: overtaken {tries} times")


def rewrite(df: DataFrame, path: str, base: Version, batch: str | None = None) -> Version:
    """A version whose rows are those of df, made from `base`; refused if `base` is no longer the newest, before and after the rows are written."""
    spark = df.sparkSession
    if current(spark, path).number != base.number:
        raise StaleVersion(f"{path}: version {base.number} is not the newest")
    return _published(spark, path, base, [_written(df, path)], [*base.batches, *([batch] if batch is not None else [])])


def upsert(df: DataFrame, path: str, keys: list[str], base: Version | None = None) -> Version:
    """Rows of df in the place of those of their keys, and added where there are none (N6, N7). Null keys equal each other."""
    spark = df.sparkSession
    base = base or current(spark, path)
    if not base.parts:
        return rewrite(df, path, base)
    old = spark.read.parquet(*[f"{path}/{p}" for p in base.parts])
    new = df.select(*keys).distinct().toDF(*[f"_{k}" for k in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rewrite(old.join(new, on, "left_anti").unionByName(df, allowMissingColumns=True), path, base)


def added(df: DataFrame, path: str, keys: list[str], count: str, batch: str) -> Version:
    """Counts of df added to those of their keys, once a batch."""
    spark = df.sparkSession
    base = current(spark, path)
    if batch in base.batches:
        return base
    old = [spark.read.parquet(*[f"{path}/{p}" for p in base.parts])] if base.parts else []
    rows = df.select(*keys, count)
    for x in old:
        rows = rows.unionByName(x.select(*keys, count))
    return rewrite(rows.groupBy(*keys).agg(F.sum(count).alias(count)), path, base, batch)


def removed_parts(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Deletes all but the newest `keep` versions, and parts that none of these names; returns the parts. No one may be writing."""
    jvm, store, _ = _store(spark, path)
    newest = current(spark, path).number
    kept = [v for n in range(max(1, newest - keep + 1), newest + 1) if (v := _or_none(spark, path, n))]
    named = {p for v in kept for p in v.parts}
    for s in store.listStatus(_path(jvm, path, "_versions")) if newest else []:
        if s.getPath().getName() not in {f"{v.number:020d}.json" for v in kept}:
            store.delete(s.getPath(), False)
    gone = [n for s in store.listStatus(_path(jvm, path)) if (n := s.getPath().getName()).startswith("part-") and n not in named]
    for n in gone:
        store.delete(_path(jvm, path, n), True)
    return gone


def _or_none(spark: SparkSession, path: str, number: int) -> Version | None:
    try:
        return current(spark, path, number)
    except (ValueError, PySparkException):
        return None

"""Trajectories of molecular dynamics as a data source of Spark: DCD files, and topologies in PDB.

A DCD file is a header and frames of one fixed size, so a frame's place follows from its number. A folder's files in order of their names
are one trajectory. A slice start:stop:step is worked out on the driver, from the headers alone: each task gets a range of frames
of one file and reads the bytes of those only. Writing, a task writes a file of its own beside the folder's, and the driver moves
all of them in once every task is done; what an attempt that failed has left is never read.

Files are reached through pyarrow's file systems (file, hdfs, s3, gs), by the driver and the tasks alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of frames of a task, and of a read.
PARTITION_BYTES, READ_BYTES = 64 << 20, 4 << 20
SCHEMA = "frame long, time double, cell array<double>, positions array<float>"
WRITING = "_writing"
#: The format: size of the first record, its mark, how many whole numbers follow and what stands where in them. (fixed values)
HEADER_BYTES, MARK, WORDS = 84, b"CORD", 20
FRAMES, FIRST_STEP, STEPS_A_FRAME, LAST_STEP, FIXED_ATOMS, TIME_STEP, HAS_CELL, VERSION = 0, 1, 2, 3, 8, 9, 10, 19
TITLE_BYTES, CELL_NUMBERS, CHARMM = 80, 6, 24


def parse_slice(spec: str | None) -> tuple[int, int | None, int]:
    """start, stop, step of start:stop:step, each optional; a single number is a step. Negative numbers and steps under 1 are errors."""
    parts = (spec or "").strip().split(":")
    if len(parts) > 3:
        raise ValueError(f"{spec!r} has more than three parts")
    if len(parts) == 1:
        parts = ["", "", parts[0]]
    start, stop, step = (int(x) if x.strip() else None for x in [*parts, ""][:3])
    if min(start or 0, stop or 0) < 0 or step is not None and step < 1:
        raise ValueError(f"{spec!r}: start and stop must not be negative and step must be positive")
    return start or 0, stop, step or 1


def place_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path there; a path without a scheme is a local one."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Layout:
    """Where a file's frames are."""

    order: str  # of bytes
    atoms: int
    has_cell: bool
    begin: int  # of the first frame
    frames: int
    first_step: int
    steps_a_frame: int
    time_step: float

    @property
    def frame(self) -> np.dtype:
        """A frame: records between two marks of their size, the cell first if there is one, then all x, all y, all z."""
        size, reals = f"{self.order}i4", (f"{self.order}f4", (self.atoms,))
        cell = [("cell0", size), ("cell", f"{self.order}f8", (CELL_NUMBERS,)), ("cell1", size)] if self.has_cell else []
        return np.dtype([*cell, *[x for c in "xyz" for x in ((f"{c}0", size), (c, *reals), (f"{c}1", size))]])


def layout_of(file, size: int) -> Layout:
    """The layout of an open file of `size` bytes. A last frame that is cut off does not count. Fixed atoms are not supported."""
    head = file.read(8 + HEADER_BYTES)
    order = next((o for o in "<>" if len(head) >= 8 and np.frombuffer(head[:4], f"{o}i4")[0] == HEADER_BYTES), None)
    if order is None or head[4:8] != MARK:
        raise ValueError("not a DCD file")
    whole = np.frombuffer(head[8 : 8 + 4 * WORDS], f"{order}i4")
    if whole[FIXED_ATOMS]:
        raise ValueError("DCD files with fixed atoms are not supported")
    title = int(np.frombuffer(file.read(4), f"{order}i4")[0])
    file.read(title + 4)
    atoms = int(np.frombuffer(file.read(12), f"{order}i4")[1])
    charmm = whole[VERSION] != 0
    step = float(whole[TIME_STEP : TIME_STEP + 1].view(f"{order}f4")[0]) if charmm else 1.0
    out = Layout(order, atoms, bool(charmm and whole[HAS_CELL]), 8 + HEADER_BYTES + 8 + title + 12, 0, int(whole[FIRST_STEP]), max(1, int(whole[STEPS_A_FRAME])), step)
    out.frames = max(0, size - out.begin) // out.frame.itemsize
    return out


def header(frames: int, atoms: int, has_cell: bool, first_step: int = 0, steps_a_frame: int = 1, time_step: float = 1.0, title: str = "") -> bytes:
    whole = np.zeros(WORDS, "<i4")
    whole[[FRAMES, FIRST_STEP, STEPS_A_FRAME, LAST_STEP, HAS_CELL, VERSION]] = frames, first_step, steps_a_frame, first_step + frames * steps_a_frame, has_cell, CHARMM
    whole[TIME_STEP] = np.array([time_step], "<f4").view("<i4")[0]
    record = lambda x: np.array([len(x)], "<i4").tobytes() + x + np.array([len(x)], "<i4").tobytes()
    said = title.encode()[:TITLE_BYTES].ljust(TITLE_BYTES)
    return record(MARK + whole.tobytes()) + record(np.array([1], "<i4").tobytes() + said) + record(np.array([atoms], "<i4").tobytes())


def frames_of(file, layout: Layout, first: int, count: int, step: int) -> Iterator[tuple[int, np.ndarray]]:
    """Frames first, first + step, ... of an open file: (number of the first one, frames), some at a time. No bytes of other frames are read."""
    size = layout.frame.itemsize
    if step > 1:
        together = max(1, READ_BYTES // size)
        for i in range(0, count, together):
            parts = []
            for j in range(i, min(count, i + together)):
                file.seek(layout.begin + (first + j * step) * size)
                parts.append(file.read(size))
            yield first + i * step, np.frombuffer(b"".join(parts), layout.frame)
        return
    file.seek(layout.begin + first * size)
    together = max(1, READ_BYTES // size)
    for i in range(0, count, together):
        yield first + i, np.frombuffer(file.read(min(together, count - i) * size), layout.frame)


@dataclass
class FrameRange(InputPartition):
    """Frames of one file: the first, how many and how far apart, and the trajectory's number and time of the file's first frame."""

    path: str
    layout: Layout
    first: int
    count: int
    step: int
    offset: int
    begin_time: float = 0.0


def ranges(files: list[tuple[str, Layout]], start: int, stop: int | None, step: int, most_bytes: int) -> list[FrameRange]:
    """The frames start:stop:step of files that follow each other, in parts of at most `most_bytes` (or a frame). A file keeps the time
    of its header if that comes after the files before it; otherwise, as all our own files do, it goes on where they end."""
    out, offset, after = [], 0, float("-inf")
    for path, layout in files:
        spacing = layout.steps_a_frame * layout.time_step
        begin_time = max(layout.first_step * layout.time_step, after)
        after = begin_time + layout.frames * spacing if layout.frames else after
        end = layout.frames if stop is None else min(layout.frames, stop - offset)
        first = max(start - offset, 0) if start >= offset else (start - offset) % step
        count, together = max(0, -(-(end - first) // step)), max(1, most_bytes // layout.frame.itemsize)
        out += [FrameRange(path, layout, first + i * step, min(together, count - i), step, offset, begin_time) for i in range(0, count, together)]
        offset += layout.frames
    return out


class DcdReader(DataSourceReader):
    def __init__(self, path: str, spec: str | None, most_bytes: int):
        self.path, self.most_bytes = path, most_bytes
        self.start, self.stop, self.step = parse_slice(spec)

    def files(self) -> list[tuple[str, Layout]]:
        store, at = place_of(self.path)
        info = store.get_file_info(at)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at))
        named = sorted((x for x in found if x.type == fs.FileType.File and x.path.endswith(".dcd")), key=lambda x: x.base_name)
        if not named:
            raise FileNotFoundError(f"no .dcd files at {self.path}")
        out = []
        for x in named:
            with store.open_input_file(x.path) as file:
                out.append((x.path, layout_of(file, x.size)))
        if len({y.atoms for _, y in out}) > 1:
            raise ValueError(f"the files at {self.path} have different numbers of atoms")
        return out

    def partitions(self) -> list[InputPartition]:
        return ranges(self.files(), self.start, self.stop, self.step, self.most_bytes) or [FrameRange("", Layout("<", 0, False, 0, 0, 0, 1, 1.0), 0, 0, 1, 0)]

    def read(self, partition: FrameRange) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        store, _ = place_of(self.path)
        own = partition.layout
        with store.open_input_file(partition.path) as file:
            for first, frames in frames_of(file, own, partition.first, partition.count, partition.step):
                n = len(frames)
                local = first + np.arange(n) * partition.step
                place = np.stack([frames[c] for c in "xyz"], axis=-1).astype("f4").reshape(n, -1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype="i4") * 3 * own.atoms), pa.array(place.ravel()))
                cell = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype="i4") * CELL_NUMBERS), pa.array(frames["cell"].astype("f8").ravel())) if own.has_cell else pa.nulls(n, pa.list_(pa.float64()))
                time = partition.begin_time + local * own.steps_a_frame * own.time_step
                yield pa.RecordBatch.from_arrays([pa.array(partition.offset + local), pa.array(time.astype("f8")), cell, lists], ["frame", "time", "cell", "positions"])


@dataclass
class Written(WriterCommitMessage):
    path: str
    first: int


class DcdWriter(DataSourceArrowWriter):
    """A file per task that has rows; files are named by their first frame, so their order is that of the frames if each task has a range."""

    def __init__(self, path: str, overwrite: bool, time_step: float):
        self.path, self.overwrite, self.time_step, self.job = path, overwrite, time_step, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written | None:
        store, at = place_of(self.path)
        path, begun, frames, atoms, has_cell = f"{at}/{WRITING}-{self.job}/{uuid.uuid4().hex}.dcd", None, 0, 0, False
        file, layout = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            lists, cells = batch.column("positions"), batch.column("cell")
            if lists.null_count:
                raise ValueError("a frame without positions")
            values = lists.flatten().to_numpy(zero_copy_only=False).astype("f4")
            if file is None:
                begun, atoms, has_cell = batch.column("frame")[0].as_py(), len(lists[0]) // 3, cells.null_count == 0
                if not atoms or len(lists[0]) % 3:
                    raise ValueError("positions must be x, y, z of each atom")
                store.create_dir(path.rpartition("/")[0])
                file = store.open_output_stream(path)
                file.write(header(0, atoms, has_cell, time_step=self.time_step))  # readers count frames by the file's size
                layout = Layout("<", atoms, has_cell, 0, 0, 0, 1, 1.0)
            if len(values) != batch.num_rows * 3 * atoms or (cells.null_count == 0) != has_cell:
                raise ValueError("frames differ in their atoms, or some have a cell and some have none")
            out = np.zeros(batch.num_rows, layout.frame)
            place = values.reshape(batch.num_rows, atoms, 3)
            for i, c in enumerate("xyz"):
                out[c], out[f"{c}0"], out[f"{c}1"] = place[:, :, i], 4 * atoms, 4 * atoms
            if has_cell:
                out["cell"] = cells.flatten().to_numpy(zero_copy_only=False).reshape(-1, CELL_NUMBERS)
                out["cell0"] = out["cell1"] = 8 * CELL_NUMBERS
            file.write(out.tobytes())
            frames += batch.num_rows
        if file is None:
            return None
        file.close()
        return Written(path, begun)

    def _clear(self) -> None:
        store, at = place_of(self.path)
        if store.get_file_info(f"{at}/{WRITING}-{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{at}/{WRITING}-{self.job}")

    def commit(self, messages: list[Written | None]) -> None:
        store, at = place_of(self.path)
        store.create_dir(at)
        old = [x.path for x in store.get_file_info(fs.FileSelector(at)) if x.path.endswith(".dcd")]
        if self.overwrite:
            for x in old:
                store.delete_file(x)
        for x in sorted((x for x in messages if x), key=lambda x: x.first):
            store.move(x.path, f"{at}/{x.first:020d}-{uuid.uuid4().hex}.dcd")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()


class DcdSource(DataSource):
    """format("dcd"): options slice (start:stop:step) and partitionBytes; for writing timeStep. Columns: frame (its number in the
    trajectory, from 0), time, cell (null without one), positions (x, y, z of each atom)."""

    @classmethod
    def name(cls) -> str:
        return "dcd"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return DcdReader(self.options["path"], self.options.get("slice"), int(self.options.get("partitionBytes", PARTITION_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return DcdWriter(self.options["path"], overwrite, float(self.options.get("timeStep", 1.0)))


def read_trajectory(spark: SparkSession, path: str, spec: str | None = None, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """frame, time, cell, positions of the frames start:stop:step of a .dcd file or a folder of them."""
    spark.dataSource.register(DcdSource)
    out = spark.read.format("dcd").option("partitionBytes", partition_bytes)
    return (out.option("slice", spec) if spec else out).load(path)


def write_trajectory(df: DataFrame, path: str, time_step: float = 1.0, overwrite: bool = False) -> str:
    """Writes frame, positions (and cell, if there is one) by ranges of frames, a file each. Frames are numbered anew when read.
    Appended files follow those there are by their first frame."""
    spark = df.sparkSession
    spark.dataSource.register(DcdSource)
    cell = F.col("cell") if "cell" in df.columns else F.lit(None).cast("array<double>")
    rows = df.select(F.col("frame").cast("long").alias("frame"), F.lit(0.0).alias("time"), cell.alias("cell"), F.col("positions").cast("array<float>").alias("positions"))
    dealt = rows.repartitionByRange("frame").sortWithinPartitions("frame")
    dealt.write.format("dcd").option("timeStep", time_step).mode("overwrite" if overwrite else "append").save(path)
    return path


def atom_rows(frames: DataFrame) -> DataFrame:
    """frame, atom, x, y, z: a row per atom of each frame."""
    atoms = F.transform(F.sequence(F.lit(0), (F.size("positions") / 3).cast("int") - 1), lambda i: F.struct(i.cast("int").alias("atom"), *[F.get("positions", (3 * i + k).cast("int")).alias(c) for k, c in enumerate("xyz")]))
    return frames.where(F.size("positions") > 0).select("frame", F.inline(atoms))


def read_topology(spark: SparkSession, path: str) -> DataFrame:
    """file, atom (its place from 0), name, resname, chain, resid, x, y, z of the ATOM and HETATM lines of PDB files, of their first model."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", "\r?\n").alias("lines"))
    first = F.when(F.array_position("lines", F.lit("ENDMDL")) > 0, F.slice("lines", 1, F.array_position("lines", F.lit("ENDMDL")))).otherwise(F.col("lines"))
    atoms = F.filter(F.transform(first, lambda x: F.rtrim(x)), lambda x: x.rlike("^(ATOM  |HETATM)"))
    rows = text.select("file", F.posexplode(atoms).alias("atom", "line"))
    part = lambda begin, size: F.trim(F.substring("line", begin, size))
    # columns of the format, from 1. (fixed values)
    return rows.select("file", "atom", part(13, 4).alias("name"), part(18, 3).alias("resname"), part(22, 1).alias("chain"), part(23, 4).cast("int").alias("resid"), *[part(b, 8).cast("double").alias(c) for c, b in (("x", 31), ("y", 39), ("z", 47))])

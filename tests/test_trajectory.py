"""The trajectory source: files byte by byte, slices, and what is read of them."""

import io
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from motley.sources import trajectory as T


def dcd(frames, atoms, order="<", cell=None, first=0):
    """A file as the format says, written by hand."""
    pack = lambda f, *x: struct.pack(order + f, *x)
    record = lambda b: pack("i", len(b)) + b + pack("i", len(b))
    whole = [len(frames), first, 2, 0, 0, 0, 0, 0, 0]
    out = record(b"CORD" + pack("9i", *whole) + pack("f", 0.5) + pack("i", int(cell is not None)) + pack("8i", *[0] * 8) + pack("i", 24))
    out += record(pack("i", 2) + b"a".ljust(80) + b"b".ljust(80)) + record(pack("i", atoms))
    for f in frames:
        out += record(pack("6d", *cell)) if cell is not None else b""
        for axis in range(3):
            out += record(pack(f"{atoms}f", *f[axis::3]))
    return out


class Counted(io.BytesIO):
    got = 0

    def read(self, n=-1):
        out = super().read(n)
        self.got += len(out)
        return out


FRAMES = [[float(100 * i + j) for j in range(15)] for i in range(40)]


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("cell", [None, (1.0, 90.0, 2.0, 90.0, 90.0, 3.0)])
def test_reads_files_of_others(spark, tmp_path, order, cell):
    (tmp_path / "a.dcd").write_bytes(dcd(FRAMES[:25], 5, order, cell, first=10) + b"cut off")
    (tmp_path / "b.dcd").write_bytes(dcd(FRAMES[25:], 5, order, cell))
    (tmp_path / "notes.txt").write_text("not a trajectory")
    rows = T.read_trajectory(spark, str(tmp_path), partition_bytes=300).orderBy("frame").collect()
    assert [list(r["positions"]) for r in rows] == FRAMES
    assert [r["frame"] for r in rows] == [*range(40)]
    assert [r["time"] for r in rows[:3]] == [5.0, 6.0, 7.0]  # (10 + 2 i) * 0.5
    assert rows[0]["cell"] == (None if cell is None else list(cell))


@pytest.mark.parametrize("spec", ["", "::1", "3::7", "24:27:1", "7", "30:", ":26:5", "39:40", "40:", "5:5", "::100"])
def test_slices(spark, tmp_path, spec):
    (tmp_path / "a.dcd").write_bytes(dcd(FRAMES[:25], 5))
    (tmp_path / "b.dcd").write_bytes(dcd([], 5))
    (tmp_path / "c.dcd").write_bytes(dcd(FRAMES[25:], 5))
    start, stop, step = T.parse_slice(spec)
    df = T.read_trajectory(spark, str(tmp_path), spec, partition_bytes=400)
    assert {r["frame"]: list(r["positions"]) for r in df.collect()} == {i: FRAMES[i] for i in range(40)[start:stop:step]}


def test_tasks_get_ranges_of_frames(tmp_path):
    (tmp_path / "a.dcd").write_bytes(dcd(FRAMES, 5))
    size = 3 * (5 * 4 + 8)
    parts = T.DcdReader(str(tmp_path), "2:40:3", 4 * size).partitions()
    assert [(p.first, p.count) for p in parts] == [(2, 4), (14, 4), (26, 4), (38, 1)]


@pytest.mark.parametrize(("first", "count", "step"), [(4, 10, 1), (4, 10, 3), (0, 1, 9)])
def test_only_the_bytes_asked_for_are_read(first, count, step, monkeypatch):
    raw = dcd(FRAMES, 5)
    layout = T.layout_of(io.BytesIO(raw), len(raw))
    assert layout.frames == 40 and layout.frame.itemsize == 84
    monkeypatch.setattr(T, "READ_BYTES", 3 * 84)
    file = Counted(raw)
    got = [(at + i * step, f["y"].tolist()) for at, part in T.frames_of(file, layout, first, count, step) for i, f in enumerate(part)]
    assert got == [(i, FRAMES[i][1::3]) for i in range(first, first + count * step, step)]
    assert file.got == count * 84


def test_written_files(spark, tmp_path):
    rows = [(i, FRAMES[i], [1.0, 90.0, 1.0, 90.0, 90.0, 1.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "frame long, positions array<double>, cell array<double>").repartition(7)
    path = T.write_trajectory(df.where("frame < 30"), str(tmp_path / "t"), time_step=2.0)
    T.write_trajectory(df.where("frame >= 30"), path, time_step=2.0)
    back = T.read_trajectory(spark, path).orderBy("frame").collect()
    assert [list(r["positions"]) for r in back] == FRAMES and back[3]["time"] == 6.0 and back[0]["cell"][1] == 90.0
    assert not [x for x in (tmp_path / "t").iterdir() if not x.name.endswith(".dcd")]
    raw = sorted((tmp_path / "t").glob("*.dcd"))[0].read_bytes()
    layout = T.layout_of(io.BytesIO(raw), len(raw))
    assert (layout.begin, (len(raw) - layout.begin) % layout.frame.itemsize) == (196, 0)
    T.write_trajectory(df.where("frame < 2").drop("cell"), path, overwrite=True)
    assert [r["cell"] for r in T.read_trajectory(spark, path).collect()] == [None, None]


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    good = spark.createDataFrame([(0, [1.0, 2.0, 3.0])], "frame long, positions array<double>")
    path = T.write_trajectory(good, str(tmp_path / "t"))
    bad = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [1.0])], "frame long, positions array<double>").coalesce(1)
    with pytest.raises(Exception, match="differ|x, y, z"):
        T.write_trajectory(bad, path, overwrite=True)
    assert T.read_trajectory(spark, path).count() == 1


def test_refused(spark, tmp_path):
    (tmp_path / "a.dcd").write_bytes(b"something else")
    for spec, said in ((None, "not a DCD"), ("1:2:3:4", "three parts"), ("::0", "positive"), ("-1:", "negative")):
        with pytest.raises(Exception, match=said):
            T.read_trajectory(spark, str(tmp_path), spec).count()


def test_atoms_and_topology(spark, tmp_path):
    (tmp_path / "a.dcd").write_bytes(dcd(FRAMES[:2], 5))
    got = T.atom_rows(T.read_trajectory(spark, str(tmp_path))).where("frame = 1 and atom = 4").collect()
    assert [tuple(r) for r in got] == [(1, 4, 112.0, 113.0, 114.0)]
    line = "ATOM      1  N   MET A   1      38.428  13.104  -6.364  1.00 54.69           N  "
    (tmp_path / "a.pdb").write_text(f"HEADER\nMODEL 1\n{line}\nHETATM    2  CA  GLY B  12       1.000   2.000   3.000\nENDMDL\nMODEL 2\n{line}\nENDMDL\n")
    rows = T.read_topology(spark, str(tmp_path / "a.pdb")).drop("file").orderBy("atom").collect()
    assert [tuple(r) for r in rows] == [(0, "N", "MET", "A", 1, 38.428, 13.104, -6.364), (1, "CA", "GLY", "B", 12, 1.0, 2.0, 3.0)]
    assert np.isclose(T.read_trajectory(spark, str(tmp_path)).select(F.sum(F.size("positions"))).first()[0], 30)


def test_time_goes_on_over_files(spark, tmp_path):
    """Two files of a writer, which both begin at 0, are one trajectory in time too; a header's later begin is kept."""
    rows = [(i, FRAMES[i]) for i in range(40)]
    df = spark.createDataFrame(rows, "frame long, positions array<double>")
    path = T.write_trajectory(df.where("frame < 25"), str(tmp_path / "t"), time_step=2.0)
    T.write_trajectory(df.where("frame >= 25"), path, time_step=2.0)
    assert [r["time"] for r in T.read_trajectory(spark, path).orderBy("frame").collect()] == [2.0 * i for i in range(40)]
    assert [(r["frame"], r["time"]) for r in T.read_trajectory(spark, path, "7::3", 200).orderBy("frame").collect()] == [(i, 2.0 * i) for i in range(7, 40, 3)]
    one = T.Layout("<", 5, False, 0, 4, 0, 2, 0.5)
    later = T.Layout("<", 5, False, 0, 4, 100, 2, 0.5)
    assert [x.begin_time for x in T.ranges([("a", one), ("b", one), ("c", later), ("d", one)], 0, None, 1, 1 << 20)] == [0.0, 4.0, 50.0, 54.0]

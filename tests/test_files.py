"""Fixed-width record files and chart ticks."""

import math
import struct

import pytest

from meridian.model import POINTS
from meridian.operators import catalog, codec
from meridian.operators.folds import assign_chunks
from meridian.sources import files

FILES = "series string, file_name string, content binary"


def test_log_drops_a_torn_record(spark):
    rows = [(1000 + i, v) for i, v in enumerate([45.2, -0.0, math.inf, -1e300, 5e-324])]
    data = b"".join(struct.pack(">Qd", *r) for r in rows)
    got = files.log_points(spark.createDataFrame([("cpu", "wal.log", bytearray(data + b"1234567")), ("none", "wal.log", bytearray(b""))], FILES)).orderBy("seq").collect()
    assert [(r.ts, r.value) for r in got] == rows and {r.series for r in got} == {"cpu"}


def test_rollup_file(spark):
    rows = [(3600, 42.5, 40.0, 45.0, 100), (7200, -1.5, math.inf, -math.inf, 2**32 - 1)]
    data = bytearray(b"".join(struct.pack(">QdddI", *r) for r in rows))
    got = files.rollup_records(spark.createDataFrame([("s", "hourly", data), ("t", "hourly", data[:-1])], FILES)).collect()
    assert sorted(tuple(r)[1:] for r in got) == rows and {r.series for r in got} == {"s"}


def test_chunk_folder(spark, tmp_path):
    rows = [("s", 60 * i, float(i), i) for i in range(30)]
    framed = codec.frame(codec.encode(assign_chunks(spark.createDataFrame(rows, POINTS), max_points=12))).collect()
    (tmp_path / "s").mkdir()
    for f in framed:
        (tmp_path / "s" / f.file_name).write_bytes(bytes(f.content))
    (tmp_path / "s" / "chunk_0009.dat").write_bytes(b"junk")
    chunks = files.chunk_files(spark, str(tmp_path))
    back = codec.decode(chunks.where("error is null")).collect()
    assert sorted((r.ts, r.value) for r in back) == [r[1:3] for r in rows]
    assert [r.error for r in chunks.where("error is not null").collect()] == ["too short"]
    assert [tuple(r) for r in files.chunk_headers(chunks).collect()] == [
        ("s", "chunk_0000.dat", 0, 660, 12), ("s", "chunk_0001.dat", 720, 1380, 12), ("s", "chunk_0002.dat", 1440, 1740, 6)]


def test_index_file(spark, tmp_path):
    (tmp_path / "index.dat").write_text("chunk_0000.dat,1,2,3\n\nchunk_0001.dat,4,5,6\n")
    assert [tuple(r) for r in files.read_index(spark, str(tmp_path / "index.dat")).collect()] == [("chunk_0000.dat", 1, 2, 3), ("chunk_0001.dat", 4, 5, 6)]
    (tmp_path / "bad.dat").write_text("chunk_0000.dat,x,2,3\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_index(spark, str(tmp_path / "bad.dat")).collect()


def test_axis_ticks(spark):
    p = spark.createDataFrame([("s", t, 1.0, t) for t in (5, 1, 9, 3)], POINTS)
    assert sorted(r.ts for r in catalog.axis_ticks(p).collect()) == [1, 3, 9]

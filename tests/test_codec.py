"""Codec: bit-exact round trips, sizes, frames and their faults."""

import math
import random
import struct

import pytest

from meridian.model import POINTS
from meridian.operators import codec
from meridian.operators.folds import assign_chunks
from meridian.sources.synthetic import benchmark_points


def bits(v):
    return struct.unpack(">Q", struct.pack(">d", v))[0]


def round_trip(ts, values):
    b = [bits(v) for v in values]
    assert codec.decode_times(codec.encode_times(ts), len(ts)) == ts
    assert codec.decode_values(codec.encode_values(b), len(b)) == b


@pytest.mark.parametrize("ts, values", [
    ([], []), ([1735000000], [87.3]), ([1000 + 60 * i for i in range(100)], [72.5 + 0.01 * i for i in range(100)]), ([1000, 1060, 1000000], [1.0, 2.0, 3.0]),
    ([1000, 1000 + 5 * 10**9, 1000 + 10**10], [1.0, 1.0, 2.0]), (list(range(50)), [42.0] * 50), ([0, 1], [0.3, 0.1 + 0.2]), ([9, 5, 7], [-0.0, math.inf, -math.inf]),
    (list(range(50)), [[0.0001, 1e15, -3.14, 1 / 3, math.pi, math.e, -999.9][i % 7] for i in range(50)]), ([1, 2, 3], [math.nan, 5e-324, math.nan]),
])
def test_round_trips(ts, values):
    round_trip(ts, values)


def test_random_round_trips():
    r = random.Random(42)
    for _ in range(3000):
        n, t, ts = r.randrange(30), 10**9, []
        for _ in range(n):
            t += r.randrange(1, 3601)
            ts.append(t)
        kind = r.randrange(3)
        values = [r.uniform(-1000, 1000) if kind == 0 else round(r.random(), 2) if kind == 1 else struct.unpack(">d", struct.pack(">Q", r.getrandbits(64)))[0] for _ in ts]
        round_trip(ts, values)


@pytest.mark.parametrize("change, cost", [(0, 1), (63, 9), (-64, 9), (64, 12), (-256, 12), (256, 16), (-2048, 16), (2048, 36), (2**31 - 1, 36), (-(2**31), 36)])
def test_cost_of_time_classes(change, cost):
    ts = [10**10, 10**10 + 10, 10**10 + 20 + change]
    assert len(codec.encode_times(ts)) == -(-(128 + cost) // 8)
    round_trip(ts, [1.0] * 3)


def test_known_size():
    assert len(codec.encode_times([1000, 1060, 1120, 1180, 1500])) == 19


@pytest.mark.parametrize("change", [2**31, -(2**31) - 1])
def test_time_changes_that_do_not_fit_are_refused(change):
    with pytest.raises(codec.CodecError):
        codec.encode_times([10**11, 10**11 + 5, 10**11 + 10 + change])


def test_truncated_streams():
    ts, vs = [1, 2, 9], [bits(v) for v in (1.5, 2.5, 9.25)]
    for encode, decode, x in ((codec.encode_times, codec.decode_times, ts), (codec.encode_values, codec.decode_values, vs)):
        data = encode(x)
        with pytest.raises(codec.CodecError):
            decode(data[: len(data) // 2], 3)


def test_frames_and_their_faults(spark):
    rows = [("s", 1000 + 60 * i, 0.5 * i, i) for i in range(40)] + [("t", 5, 1.0, 41)]
    encoded = codec.encode(assign_chunks(spark.createDataFrame(rows, POINTS), max_points=16))
    files = codec.frame(encoded)
    back = codec.decode(codec.unframe(files).where("error is null"))
    assert sorted((r.series, r.ts, r.value) for r in back.collect()) == sorted(r[:3] for r in rows)
    one = files.where("series = 't'").first()
    c = bytes(one.content)
    assert c[:4] == codec.MAGIC and codec.frame_crc(c) == int.from_bytes(c[-4:], "big") and len(c) == 29 + 4 + 8 + 8 + 4
    flipped = bytes([*c[:35], c[35] ^ 1, *c[36:]])
    bad = [("t", "chunk_0000.dat", x) for x in (b"", c[:20], b"XXXX" + c[4:], c[:-6], flipped, c[:25] + b"\xff\xff\xff\xff" + c[29:])]
    got = codec.unframe(spark.createDataFrame([(s, n, bytearray(x)) for s, n, x in bad], "series string, file_name string, content binary")).collect()
    assert [r.error for r in got] == ["too short", "too short", "bad magic", "bad length", "bad checksum", "bad length"]


def test_time_bits_model_equals_the_stream(spark):
    rows = [("s", t, 1.0, i) for i, t in enumerate([5, 10, 15, 90, 4000, 4001, 9000, 9001, 200000])]
    total = codec.time_bits(spark.createDataFrame(rows, POINTS), ["series"]).agg({"bits": "sum"}).first()[0]
    assert -(-total // 8) == len(codec.encode_times([r[1] for r in rows]))


def test_value_xor(spark):
    rows = [("s", i, v, i) for i, v in enumerate([1.0, 1.0, 0.3, 0.1 + 0.2])]
    got = codec.value_xor(spark.createDataFrame(rows, POINTS), ["series"]).orderBy("seq").collect()
    assert got[1].xor == 0 and (got[3].xor, got[3].lead, got[3].tail) == (7, 61, 0)


def test_a_day_of_sine_packs_to_two_thirds(spark):
    r = codec.sizes(codec.encode(assign_chunks(benchmark_points(spark)))).first()
    assert r.raw_bytes == 1_382_400 and r.ratio >= 1.5

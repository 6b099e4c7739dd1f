"""Chunk codec: delta-of-delta times and XOR values as two bit streams, one chunk per task group.

Times: 64 bits, then the first delta in 64 bits, then per point the change of the delta in one of five
classes. Values: 64 bits, then per point the XOR with the one before: 0 if equal; 10 and the bits of the
last window if they fit it; else 11, leading zeros (5 bits), length (6 bits, less one) and the bits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.functions.scalar import float_bits, leading_zeros, trailing_zeros
from meridian.operators.rollup import lagged

# Classes of the change of the delta as (prefix, prefix bits, payload bits), and the frame.
CLASSES = [(0b10, 2, 7), (0b110, 3, 9), (0b1110, 4, 12), (0b1111, 4, 32)]
MAX_LEADING = 31
MAGIC, VERSION, HEADER = b"CHRN", 1, 29


class CodecError(ValueError):
    """A stream or frame that cannot be read."""


class BitWriter:
    def __init__(self):
        self.value, self.bits = 0, 0
        self.done = bytearray()

    def put(self, value: int, n: int) -> None:
        self.value = self.value << n | (value & ((1 << n) - 1))
        self.bits += n
        if self.bits >= 512:
            keep = self.bits % 8
            self.done += (self.value >> keep).to_bytes(self.bits // 8, "big")
            self.value &= (1 << keep) - 1
            self.bits = keep

    def bytes(self) -> bytes:
        pad = -self.bits % 8
        return bytes(self.done) + (self.value << pad).to_bytes((self.bits + pad) // 8, "big")


class BitReader:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def take(self, n: int) -> int:
        if self.at + n > self.end:
            raise CodecError("truncated stream")
        lo, hi = self.at // 8, (self.at + n + 7) // 8
        chunk = int.from_bytes(self.data[lo:hi], "big") >> (8 * hi - self.at - n)
        self.at += n
        return chunk & ((1 << n) - 1)


def encode_times(ts: list[int]) -> bytes:
    """Raises if a change of the delta needs more than 32 bits; it would come back wrong."""
    w = BitWriter()
    for i, t in enumerate(ts):
        if i == 0:
            w.put(t, 64)
        elif i == 1:
            w.put(t - ts[0], 64)
        else:
            change = t - 2 * ts[i - 1] + ts[i - 2]
            if change == 0:
                w.put(0, 1)
                continue
            for prefix, length, bits in CLASSES:
                if -(1 << (bits - 1)) <= change < 1 << (bits - 1):
                    w.put(prefix, length)
                    w.put(change, bits)
                    break
            else:
                raise CodecError(f"times change too fast: {change}")
    return w.bytes()


def decode_times(data: bytes, n: int) -> list[int]:
    r, out, delta = BitReader(data), [], 0
    for i in range(n):
        if i == 0:
            out.append(r.take(64))
            continue
        if i == 1:
            delta = _signed(r.take(64), 64)
        elif r.take(1):
            bits = 7 if not r.take(1) else 9 if not r.take(1) else 12 if not r.take(1) else 32
            delta += _signed(r.take(bits), bits)
        out.append(out[-1] + delta)
    return out


def _signed(x: int, bits: int) -> int:
    return x - (1 << bits) if x >> (bits - 1) else x


def encode_values(bits: list[int]) -> bytes:
    """Leading zeros are held to 31, what their field can say, so that any two values come back exactly."""
    w, before, lead, size = BitWriter(), 0, -1, 0
    for i, b in enumerate(bits):
        x = b ^ before
        before = b
        if i == 0:
            w.put(b, 64)
        elif x == 0:
            w.put(0, 1)
        else:
            z, tail = min(64 - x.bit_length(), MAX_LEADING), (x & -x).bit_length() - 1
            if lead >= 0 and z >= lead and tail >= 64 - lead - size:
                w.put(0b10, 2)
            else:
                lead, size = z, 64 - z - tail
                w.put(0b11, 2)
                w.put(lead, 5)
                w.put(size - 1, 6)
            w.put(x >> (64 - lead - size), size)
    return w.bytes()


def decode_values(data: bytes, n: int) -> list[int]:
    r, out, lead, size = BitReader(data), [], 0, 0
    for i in range(n):
        if i == 0:
            out.append(r.take(64))
        elif not r.take(1):
            out.append(out[-1])
        else:
            if r.take(1):
                lead, size = r.take(5), r.take(6) + 1
            if lead + size > 64:
                raise CodecError("bad window")
            out.append(out[-1] ^ r.take(size) << (64 - lead - size))
    return out


ENCODED = "series string, chunk long, count long, start_time long, end_time long, ts_bits binary, value_bits binary"


def encode(chunked: DataFrame) -> DataFrame:
    """One row per chunk of ``chunked(series, chunk, ts, value, seq)`` with its two streams.

    Rows come sorted, many chunks to a task; only the points of the chunk at hand are held, and a chunk is bounded by the rules
    that cut it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["series", "chunk", "count", "start_time", "end_time", "ts_bits", "value_bits"]
        types = [pa.string(), *[pa.int64()] * 4, pa.binary(), pa.binary()]
        key, ts, bits = None, [], []

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        def row() -> tuple:
            return (*key, len(ts), ts[0], ts[-1], encode_times(ts), encode_values(bits))

        for batch in batches:
            keys = list(zip(batch.column("series").to_pylist(), batch.column("chunk").to_pylist(), strict=True))
            times = batch.column("ts").to_pylist()
            values = np.ascontiguousarray(batch.column("value").to_numpy(zero_copy_only=False)).view(np.uint64).tolist()
            edges = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            done = []
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo < hi and keys[lo] != key:
                    if ts:
                        done.append(row())
                    key, ts, bits = keys[lo], [], []
                ts += times[lo:hi]
                bits += values[lo:hi]
            if done:
                yield packed(done)
        if ts:
            yield packed([row()])

    rows = chunked.select("series", "chunk", "ts", "value", "seq").repartition("series", "chunk")
    return rows.sortWithinPartitions("series", "chunk", "seq").mapInArrow(run, ENCODED)


def decode(encoded: DataFrame) -> DataFrame:
    """Points of encoded chunks: series, chunk, pos (place in the chunk), ts, value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ts = decode_times(r["ts_bits"], r["count"])
                value = np.array(decode_values(r["value_bits"], r["count"]), dtype=np.uint64).view(np.float64)
                n = len(ts)
                cols = [pa.array([r["series"]] * n, pa.string()), pa.array([r["chunk"]] * n, pa.int64()), pa.array(np.arange(n)), pa.array(ts, pa.int64()), pa.array(value)]
                yield pa.RecordBatch.from_arrays(cols, names=["series", "chunk", "pos", "ts", "value"])

    return encoded.select("series", "chunk", "count", "ts_bits", "value_bits").mapInArrow(run, "series string, chunk long, pos long, ts long, value double")


def _be(value: Column, width: int) -> Column:
    """Big-endian bytes of a non-negative number."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * width, "0"))


def frame(encoded: DataFrame) -> DataFrame:
    """Chunk files (series, file_name, content): header, length of the time stream, both streams, CRC-32 over all of it."""
    size = 4 + F.octet_length("ts_bits") + F.octet_length("value_bits")
    body = F.concat(
        F.lit(MAGIC), _be(F.lit(VERSION), 1), _be(F.col("count"), 4), _be(F.col("start_time"), 8), _be(F.col("end_time"), 8), _be(size, 4),
        _be(F.octet_length("ts_bits"), 4), F.col("ts_bits"), F.col("value_bits"),
    )
    return encoded.select("series", F.format_string("chunk_%04d.dat", "chunk").alias("file_name"), F.concat(body, _be(F.crc32(body), 4)).alias("content"))


def unframe(files: DataFrame) -> DataFrame:
    """Encoded chunks of chunk files, with ``error`` (null if sound): too short, bad magic, bad length, bad checksum."""

    def number(at: int | Column, width: int) -> Column:
        at = F.lit(at) if isinstance(at, int) else at
        return F.conv(F.hex(F.substring(F.col("content"), at, F.lit(width))), 16, 10).cast("decimal(20,0)").try_cast("long")

    n = F.octet_length("content")
    payload, split = number(26, 4), number(30, 4)
    total = F.lit(HEADER) + payload + 4
    error = (
        F.when(n < HEADER + 8, "too short")
        .when(F.substring(F.col("content"), F.lit(1), F.lit(4)) != F.lit(MAGIC), "bad magic")
        .when((n < total) | (split > payload - 4), "bad length")
        .when(F.crc32(F.substring(F.col("content"), F.lit(1), (total - 4).try_cast("int"))) != number((total - 3).try_cast("int"), 4), "bad checksum")
    )
    return files.withColumn("error", error).select(
        "series",
        F.regexp_extract("file_name", "([0-9]+)", 1).cast("long").alias("chunk"),
        number(6, 4).alias("count"),
        number(10, 8).alias("start_time"),
        number(18, 8).alias("end_time"),
        F.substring(F.col("content"), F.lit(HEADER + 5), split.try_cast("int")).alias("ts_bits"),
        F.substring(F.col("content"), (F.lit(HEADER + 5) + split).try_cast("int"), (payload - 4 - split).try_cast("int")).alias("value_bits"),
        "error",
    )


def frame_crc(content: bytes) -> int:
    """CRC-32 that a chunk file ends with."""
    return zlib.crc32(content[:-4])


def deltas(points: DataFrame, by: list[str]) -> DataFrame:
    """``delta`` and ``change`` (delta of the delta) of the times of each group, in order of arrival."""
    with_delta = lagged(points, by, "ts", "_before").withColumn("delta", F.col("ts") - F.col("_before"))
    return lagged(with_delta, by, "delta", "_before").withColumn("change", F.col("delta") - F.col("_before")).drop("_before")


def time_bits(points: DataFrame, by: list[str]) -> DataFrame:
    """Bits that each time costs: a model of ``encode_times`` in built-in functions."""
    d = deltas(points, by)
    cost = F.when(F.col("delta").isNull() | F.col("change").isNull(), 64).when(F.col("change") == 0, 1)
    for _, prefix, bits in CLASSES:
        cost = cost.when(F.col("change").between(-(1 << (bits - 1)), (1 << (bits - 1)) - 1), prefix + bits)
    return d.withColumn("bits", cost)


def value_xor(points: DataFrame, by: list[str]) -> DataFrame:
    """XOR of the bits of each value with the one before, and its leading and trailing zeros."""
    bits = lagged(points.withColumn("value_bits", float_bits("value")), by, "value_bits", "_before")
    x = bits.withColumn("xor", F.col("value_bits").bitwiseXOR(F.col("_before"))).drop("_before")
    return x.withColumns({"lead": leading_zeros(F.col("xor")), "tail": trailing_zeros(F.col("xor"))})


def sizes(encoded: DataFrame) -> DataFrame:
    """Raw bytes (16 per point), packed bytes and their ratio."""
    packed = F.sum(F.octet_length("ts_bits") + F.octet_length("value_bits"))
    return encoded.agg((16 * F.sum("count")).alias("raw_bytes"), packed.alias("compressed_bytes"), (16 * F.sum("count") / packed).alias("ratio"))

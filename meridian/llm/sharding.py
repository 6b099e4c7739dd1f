"""K-d tree sharding: split at distributed weighted medians along the widest metadata dimension."""

from __future__ import annotations

import heapq
import itertools
import os
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.llm.common import discard, materialize

#: Sums per pass that may reach the driver, for all nodes of a level together.
BINS = 1 << 16
#: Most nodes whose table is broadcast; beyond, Spark joins it as it sees fit.
BROADCAST_NODES = 10_000
#: A group of equal texts with more than this part of a shard's bytes is placed before the tree is built.
BOULDER = 16
#: Rows that are numbered together inside a shard.
ROWS_PER_BUCKET = 4096
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def _codes(docs: DataFrame, dims: dict[str, str]) -> list[Column]:
    """An order-keeping integer below 2^56 for each metadata value; null comes first as -1.

    A text counts by the seven bytes after those that all values of its column begin with, so any
    column of unequal values has a width; what agrees on these is one value here, and the tie hash
    separates it. The common beginning is that of the least and the greatest value.
    """
    texts = [c for c, kind in dims.items() if kind == "string"]
    ends = docs.agg(F.count("*"), *[f(F.col(c)) for c in texts for f in (F.min, F.max)]).first()[1:]
    codes = []
    for column, kind in dims.items():
        if kind == "string":
            low, high = (((x or "").encode()) for x in ends[2 * texts.index(column) :][:2])
            skip = len(os.path.commonprefix([low, high]))
            after = F.substring(F.encode(F.col(column), "UTF-8"), skip + 1, 7)
            number = F.conv(F.rpad(F.hex(after), 14, "0"), 16, 10).cast("long")
        else:
            number = F.col(column).cast("long")
        codes.append(F.coalesce(number, F.lit(-1).cast("long")))
    return codes


_TYPES = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "decimal(20,0)": pa.decimal128(20, 0)}


def _leaf_table(spark, nodes: list[dict], fields: str) -> DataFrame:
    """The fields of the nodes (at most one per shard) as a table, to be broadcast while it is small."""
    columns = [f.split() for f in fields.split(", ")]
    table = spark.createDataFrame(pa.table({n: pa.array([x[n] for x in nodes], _TYPES[t]) for n, t in columns}))
    return F.broadcast(table) if len(nodes) <= BROADCAST_NODES else table


def _weighted_cut(rows: DataFrame, nodes: list[dict], tolerance: float) -> None:
    """Give each node its ``cut``: (value, tie) up to which rows go left, near its weighted quantile.

    Passes over the narrow table shrink the bin that holds the quantile, first along the
    dimension, then along the tie hash of one value. Each pass is one partial aggregation
    for all nodes together; at most BINS sums come back, each with the range it covers.
    """
    spark = rows.sparkSession
    open_nodes = []
    for n in nodes:
        if 0 < n["want"] < n["w"]:
            n |= {"stage": "value", "lo": n["min"], "hi": n["max"], "base": 0.0, "value": 0}
            open_nodes.append(n)
        else:  # everything to one side
            n["cut"] = (n["max"] if n["want"] > 0 else n["min"] - 1, HIGHEST)
    while open_nodes:
        for n in open_nodes:
            n["step"] = Decimal(max(1, -(-(n["hi"] - n["lo"] + 1) // max(2, BINS // len(open_nodes)))))
            n["by_tie"] = n["stage"] == "tie"
        at = _leaf_table(spark, open_nodes, "node int, lo bigint, hi bigint, step decimal(20,0), by_tie boolean, value bigint")
        x = F.when(F.col("by_tie"), F.col("tie")).otherwise(F.col("v"))
        inside = F.when(F.col("by_tie"), F.col("v") == F.col("value")).otherwise(F.lit(True)) & x.between(F.col("lo"), F.col("hi"))
        got = (
            rows.join(at, "node")
            .where(inside)
            .groupBy("node", F.floor((x.cast("decimal(20,0)") - F.col("lo")) / F.col("step")).cast("int").alias("bin"))
            .agg(F.sum("weight").alias("w"), F.min(x).alias("lo"), F.max(x).alias("hi"))
            .collect()
        )
        bins: dict[int, list] = {}
        for node, _, w, lo, hi in got:
            bins.setdefault(node, []).append((lo, hi, float(w)))
        still = []
        for n in open_nodes:
            want, run = n["want"], n["base"]
            for lo, hi, w in sorted(bins.get(n["node"], [])):
                if run + w >= want:
                    break
                run += w
            else:
                lo, hi, w = n["lo"], n["hi"], 0.0
            single = lo == hi
            if w <= tolerance or (single and n["by_tie"]):
                upper = want - run > run + w - want  # the nearer edge of the bin
                edge = hi if upper else lo - 1
                if n["by_tie"]:
                    n["cut"] = (n["value"], edge) if edge >= LOWEST else (n["value"] - 1, HIGHEST)
                else:
                    n["cut"] = (edge, HIGHEST)
            elif single:
                n |= {"stage": "tie", "value": lo, "lo": LOWEST, "hi": HIGHEST, "base": run}
                still.append(n)
            else:
                n |= {"lo": lo, "hi": hi, "base": run}
                still.append(n)
        open_nodes = still


def kd_shards(rows: DataFrame, dims: list[str], weight: str, tie: str, room: list[float], tolerance: float | None = None) -> DataFrame:
    """Add ``shard`` (0 to len(``room``) - 1) so that the weights of shards come out in proportion to their ``room``.

    ``rows`` needs long columns ``dims`` (see ``_codes``), ``weight`` and ``tie`` (a hash that
    separates rows of equal metadata). A node holds a run of shards and is split in their middle, at
    the weighted quantile of the dimension whose range, against the whole table's, is the widest in that
    node. A cut may miss its quantile by ``tolerance`` (a five-hundredth of a shard by default). Rows
    follow the splits by one join per level with a table of at most one row per shard (broadcast up to
    BROADCAST_NODES rows), and each level is written, so that no pass repeats the joins before
    it. An empty table stays empty.
    """
    spark = rows.sparkSession
    state = materialize(rows.withColumn("node", F.lit(0)), "level")
    total = state.agg(F.sum(weight)).first()[0] or 0
    tolerance = max(1.0, float(total) / len(room) / 500) if tolerance is None else tolerance
    upto = [0.0, *itertools.accumulate(map(float, room))]
    leaves, spans = {0: len(room)}, {}
    while max(leaves.values()) > 1 and total:
        stats = state.groupBy("node").agg(
            F.sum(weight).alias("w"), *[f(d).alias(f"{p}_{d}") for d in dims for p, f in (("lo", F.min), ("hi", F.max))]
        ).collect()
        nodes = []
        for s in stats:
            if not spans:
                spans = {d: max(1, s[f"hi_{d}"] - s[f"lo_{d}"]) for d in dims}
            at, m = s["node"], leaves[s["node"]]
            if m == 1:
                continue
            widest = max(range(len(dims)), key=lambda i: (s[f"hi_{dims[i]}"] - s[f"lo_{dims[i]}"]) / spans[dims[i]])
            d, half = dims[widest], -(-m // 2)
            left, whole = upto[at + half] - upto[at], upto[at + m] - upto[at]
            share = left / whole if whole > 0 else half / m
            nodes.append(
                {"node": at, "dim": widest, "min": s[f"lo_{d}"], "max": s[f"hi_{d}"], "w": float(s["w"]), "want": float(s["w"]) * share, "left_leaves": half}
            )
        if nodes:
            at = _leaf_table(spark, nodes, "node int, dim int")
            along = state.join(at, "node").select(
                "node", F.get(F.array(*[F.col(d) for d in dims]), F.col("dim")).alias("v"), F.col(tie).alias("tie"), F.col(weight).alias("weight")
            )
            _weighted_cut(along, nodes, tolerance)
            for n in nodes:
                n |= {"cut_v": n["cut"][0], "cut_t": n["cut"][1]}
            cuts = _leaf_table(spark, nodes, "node int, dim int, cut_v bigint, cut_t bigint, left_leaves int")
            v = F.get(F.array(*[F.col(d) for d in dims]), F.col("dim"))
            left = (v < F.col("cut_v")) | ((v == F.col("cut_v")) & (F.col(tie) <= F.col("cut_t")))
            below = (
                state.join(cuts, "node", "left")
                .withColumn("node", F.when(F.col("dim").isNull() | left, F.col("node")).otherwise(F.col("node") + F.col("left_leaves")))
                .drop("dim", "cut_v", "cut_t", "left_leaves")
            )
            below = materialize(below, "level")
            discard(state)
            state = below
        # a node's number is its first shard, so children are numbered in order
        leaves = {k: v for at, m in leaves.items() for k, v in ((at, -(-m // 2)), (at + -(-m // 2), m // 2)) if v}
    return state.withColumnRenamed("node", "shard")


def place_boulders(sizes: list[int], total: int, n_shards: int) -> tuple[list[int], list[float]]:
    """The shard of each large unit (largest first, on the shard that holds least) and the room that each shard then
    has for the rest, so that all come out level but those that one unit alone fills beyond it."""
    heap, where = [(0, k) for k in range(n_shards)], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, k = heapq.heappop(heap)
        where[i] = k
        heapq.heappush(heap, (load + sizes[i], k))
    loads = sorted(heap)
    left, level, held = float(total - sum(sizes)), 0.0, 0
    for i, (load, _) in enumerate(loads):  # the level to which the rest fills the emptier shards
        held += load
        level = (left + held) / (i + 1)
        if i + 1 == n_shards or level <= loads[i + 1][0]:
            break
    return where, [max(0.0, level - load) for load, _ in sorted(heap, key=lambda x: x[1])]


def number_slots(rows: DataFrame, key: str, total: int) -> DataFrame:
    """Add ``slot``: 0, 1, 2, ... inside each shard. Shards are numbered bucket by bucket,
    so that no shard has to be sorted in one task."""
    buckets = max(1, -(-total // ROWS_PER_BUCKET))
    rows = rows.withColumn("bucket", F.pmod(F.col(key), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    counts = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inner = Window.partitionBy("shard", "bucket").orderBy(key)
    return (
        rows.join(counts, ["shard", "bucket"])
        .withColumn("slot", (F.col("first") + F.row_number().over(inner) - 1).cast("long"))
        .drop("bucket", "first")
    )


def shard_documents(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", dims: dict[str, str] | None = None) -> DataFrame:
    """Shard documents to near-equal bytes: id, size, text_crc32, shard, slot. Equal texts share a shard.

    ``dims`` maps metadata columns to 'string' or 'number'; the byte length joins them.
    size is the UTF-8 length of the text (null: 0) plus 16; the CRC of a null text is null. What the tree
    deals out is groups of equal texts (null texts are one group), each with the least metadata of its rows.
    Only a group of more bytes than a shard should hold is cut into parts, by row number. Groups and
    parts above a BOULDER-th of a shard (so at most BOULDER for each shard) are placed first, by
    size alone, and the tree fills the room they leave. Null metadata comes first in its dimension;
    groups alike in all metadata are told apart by a hash of the text; other columns are not read. An
    empty table gives an empty table.
    """
    dims = {"source": "string", "lang": "string"} if dims is None else dims
    text = F.col(text_col).cast("string")
    names = [f"dim_{i}" for i in range(len(dims))]
    narrow = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.coalesce(F.xxhash64(text), F.lit(0).cast("long")).alias("hash"),
        *[c.alias(n) for c, n in zip(_codes(docs, dims), names)],
    )
    narrow = materialize(narrow.withColumns({"row": F.monotonically_increasing_id(), "group": F.xxhash64("hash", "text_crc32", "size")}).drop("hash"), "shard-keys")
    count, total = narrow.agg(F.count("*"), F.sum("size")).first()
    fair = (total or 0) / n_shards

    def gathered(rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy(*by).agg(F.sum("size").alias("bytes"), *[F.min(n).alias(n) for n in names], F.min("size").alias("length"))

    groups = materialize(gathered(narrow, "group"), "groups")
    large = groups.where(F.col("bytes") > fair).select("group", F.ceil(F.col("bytes") * BOULDER / F.lit(fair or 1.0)).cast("long").alias("parts"))
    if large.isEmpty():
        units, parted = groups.withColumn("part", F.lit(0).cast("long")), narrow.withColumn("part", F.lit(0).cast("long"))
    else:
        large = F.broadcast(materialize(large, "large-groups"))  # fewer than shards
        part = F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")), F.lit(0).cast("long"))
        parted = narrow.join(large, "group", "left").withColumn("part", part)
        cut = gathered(parted.where("parts is not null"), "group", "part")
        units = groups.join(large, "group", "left_anti").withColumn("part", F.lit(0).cast("long")).unionByName(cut)
    units = materialize(units.withColumn("tie", F.xxhash64("group", "part")), "units")
    big = F.col("bytes") > fair / BOULDER
    boulders = units.where(big).select("group", "part", "bytes").collect()
    where, room = place_boulders([b.bytes for b in boulders], total or 0, n_shards)
    placed = kd_shards(units.where(~big), [*names, "length"], "bytes", "tie", room).select("group", "part", "shard")
    if boulders:
        columns = [[b.group for b in boulders], [b.part for b in boulders], where]
        types = (pa.int64(), pa.int64(), pa.int32())
        rows = pa.table({n: pa.array(c, t) for n, c, t in zip(("group", "part", "shard"), columns, types)})
        placed = placed.unionByName(docs.sparkSession.createDataFrame(rows))
    shards = materialize(parted.join(placed, ["group", "part"]).select("id", "size", "text_crc32", F.xxhash64("row").alias("tie"), "shard"), "shards")
    for used in (narrow, groups, units):
        discard(used)
    return number_slots(shards, "tie", count).select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot")


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return shard_documents(docs, 40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )

"""Best-fit packing of documents into training sequences of several permitted lengths."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import materialize, n_words

#: Permitted sequence lengths; a sequence of c words costs OVERHEAD + c + c * c / ATTENTION.
CAPACITIES = (256, 512, 1024, 2048)
OVERHEAD = 16
ATTENTION = 16_384
#: Documents that are packed together; pools are independent tasks.
POOL_ROWS = 20_000


def pack_pool(lengths: np.ndarray, capacities: Sequence[int], overhead: int, attention: int) -> tuple[list[int], list[int], list[int]]:
    """Pack items, all at most the largest capacity: (bin of each item, start in the bin, capacity of each bin).

    Longest first. An item goes to the open bin with the least room that holds it. Without
    one, a bin is opened in the size with the least cost for each word that can fill it: how full
    a size gets is found by filling its room, longest first, with what is left to pack.
    At the end every bin shrinks to the least capacity that holds its contents. Open bins are kept by
    room, and a bit set of the rooms in use gives the best fit in one step.
    """
    caps = sorted(capacities)
    bins_by_room: list[list[int]] = [[] for _ in range(caps[-1] + 1)]
    used_rooms = 0
    where, start = [0] * len(lengths), [0] * len(lengths)
    fill: list[int] = []
    left = np.bincount(lengths, minlength=caps[-1] + 1).tolist()
    lengths_left = sum(1 << size for size, n in enumerate(left) if n)

    def filled(room: int) -> int:
        """Words that the items left can put into a room."""
        free, open_ = room, lengths_left
        while free and (open_ := open_ & ((1 << (free + 1)) - 1)):
            size = open_.bit_length() - 1
            free -= size * min(left[size], free // size)
            open_ ^= 1 << size
        return room - free

    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        left[size] -= 1
        if not left[size]:
            lengths_left ^= 1 << size
        fits = used_rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            stack = bins_by_room[room]
            b = stack.pop()
            if not stack:
                used_rooms ^= 1 << room
        else:
            room = min((c for c in caps if c >= size), key=lambda c: ((overhead + c + c * c / attention) / (size + filled(c - size)), c))
            b = len(fill)
            fill.append(0)
        where[i], start[i] = b, fill[b]
        fill[b] += size
        room -= size
        if not bins_by_room[room]:
            used_rooms |= 1 << room
        bins_by_room[room].append(b)
    return where, start, [next(c for c in caps if c >= f) for f in fill]


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacities: Sequence[int] = CAPACITIES,
    overhead: int = OVERHEAD,
    attention: int = ATTENTION,
    pool_rows: int = POOL_ROWS,
    size_col: str | None = None,
) -> DataFrame:
    """Where every word of every document goes: rows (id, piece, first_word, words, bin, capacity, start).

    Lengths are words of the text, or ``size_col``. A document longer than the largest capacity
    is cut into pieces of that capacity and a rest; nothing is dropped. bin names a
    sequence over all pools (pool and number), start is the piece's place in it. Pools are
    dealt by a hash of the number of the row in a written table and hold about ``pool_rows`` documents whatever the
    input, its ids and repeats; each wastes at most its last bins. Full pieces of a long document never meet in one list: they are
    made where they are written, batch by batch. Null texts and texts without words have one
    empty piece without a bin (null bin, capacity and start); null ids and repeated rows are
    packed like others; other columns are not read; an empty table gives an empty table.
    """
    size = F.col(size_col).cast("long") if size_col else n_words(F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(size, F.lit(0)).alias("size"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows, "lengths")
    pools = max(1, -(-rows.count() // pool_rows))
    most = max(capacities)
    salt = F.pmod(F.xxhash64("row"), F.lit(pools)).cast("int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(pool, i, piece, first, words, b, cap, start):
            k = len(i)
            names = np.char.add(f"{pool}-", b.astype(str)) if k else []
            return pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int64()), pa.array(piece, pa.int64()), pa.array(first, pa.int64()), pa.array(words, pa.int64()),
                 pa.array(names, pa.string()), pa.array(cap, pa.int32()), pa.array(start, pa.int32())], names=names_out)

        names_out = ["id", "piece", "first_word", "words", "bin", "capacity", "start"]
        t = pa.Table.from_batches(batches)
        if not t.num_rows:
            return
        pool = t.column("pool")[0].as_py()
        ids, sizes = t.column("id"), t.column("size").to_numpy()
        full, rest = sizes // most, sizes % most
        ids_np = ids.to_pandas().astype("Int64").array  # null ids stay null
        k = np.flatnonzero(rest)
        where, start, caps = pack_pool(rest[k], capacities, overhead, attention)
        w, cap_of = np.array(where, dtype=np.int64), np.array(caps, dtype=np.int64)
        yield table(pool, ids_np[k], full[k], full[k] * most, rest[k], w, cap_of[w] if len(w) else w, np.array(start, dtype=np.int64))
        none = np.flatnonzero(sizes == 0)
        if len(none):
            z = np.zeros(len(none), np.int64)
            nothing = [pa.nulls(len(none), x) for x in (pa.string(), pa.int32(), pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(ids_np[none], pa.int64()), pa.array(z), pa.array(z), pa.array(z), *nothing], names=names_out)
        b = len(caps)
        for d in np.flatnonzero(full).tolist():
            for at in range(0, int(full[d]), 65536):
                piece = np.arange(at, min(int(full[d]), at + 65536))
                same = np.full(len(piece), most)
                who = pa.array([ids[d].as_py()] * len(piece), pa.int64())
                yield table(pool, who, piece, piece * most, same, b + np.arange(len(piece)), same, np.zeros(len(piece), np.int64))
                b += len(piece)

    schema = "id long, piece long, first_word long, words long, bin string, capacity int, start int"
    return (
        rows.select("id", "size", salt.alias("pool")).groupBy("pool").applyInArrow(run, schema).withColumnRenamed("id", id_col)
    )


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

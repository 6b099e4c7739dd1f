"""SimHash near-dedup: fingerprints, then a self-join of binary tries under a Hamming budget."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import connected_components, discard, link, materialize

BITS = 64
#: A pair of trie nodes goes to one task when both hold at most so many fingerprints.
NODE_ROWS = 2048
#: Words that are hashed at a time, so that a very long text needs bounded memory.
CHUNK = 1 << 18


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text: bit b is set if it is set in over half the shingle hashes.

    Lower-cases A-Z; words are split at ASCII white space; null or wordless texts give 0.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    n = len(words) - shingle + 1
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, CHUNK):
        part = words[at : min(at + CHUNK, n) + shingle - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(shingle)), strict=False))
        h = np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in grams), dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp long) of every row; texts are read in slices of an Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = []
            for at in range(0, batch.num_rows, 64):
                part = batch.column(1).slice(at, 64).cast(pa.binary()).to_pylist()
                fps += [fingerprint(t, shingle, seed) for t in part]
            fp = np.array(fps, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "id long, fp long"
    )


# -- the trie inside one task ------------------------------------------------------------------


def trie_join(unit: np.ndarray, side: np.ndarray, key: np.ndarray, depth: int, diff: np.ndarray, budget: int) -> np.ndarray:
    """Group label of every row (sorted by unit, side, key): rows within ``budget`` bits are joined.

    A trie node is an interval of the sorted keys. Pairs of nodes go down one bit at a time:
    children whose accumulated difference (``diff`` at the start) exceeds the budget are pruned,
    as are pairs that lie in one group already. Small pairs are compared by bit count.
    """
    n = len(key)
    label = np.arange(n)
    cut = np.flatnonzero((unit[1:] != unit[:-1]) | (side[1:] != side[:-1])) + 1
    lo = np.concatenate([[0], cut]).astype(np.int64)
    hi = np.concatenate([cut, [n]]).astype(np.int64)
    first = np.concatenate([[True], unit[lo[1:]] != unit[lo[:-1]]]) if len(lo) else np.zeros(0, bool)
    last = np.concatenate([first[1:], [True]])
    alone = first & last
    pairs = np.flatnonzero(first & ~last)  # unit with two sides: this interval and the next
    alo = np.concatenate([lo[alone], lo[pairs]])
    ahi = np.concatenate([hi[alone], hi[pairs]])
    blo = np.concatenate([lo[alone], lo[pairs + 1]])
    bhi = np.concatenate([hi[alone], hi[pairs + 1]])
    start = np.concatenate([np.zeros(alone.sum(), np.int64), diff[lo[pairs]]])
    ones = {}

    def mid(d: int, l: np.ndarray, h: np.ndarray) -> np.ndarray:
        if d not in ones:
            bit = (key >> np.uint64(BITS - 1 - d)) & np.uint64(1)
            ones[d] = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
        return h - (ones[d][h] - ones[d][l])

    stack = [(depth, alo, ahi, blo, bhi, start)]
    while stack:
        d, alo, ahi, blo, bhi, used = stack.pop()
        if len(alo) > 1 << 16:  # bounded memory: the rest waits
            for s in range(0, len(alo), 1 << 16):
                stack.append((d, *(x[s : s + (1 << 16)] for x in (alo, ahi, blo, bhi, used))))
            continue
        same = alo == blo
        size = (ahi - alo) * (bhi - blo)
        changes = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])]) if n else np.zeros(1)
        joined = (changes[ahi - 1] == changes[alo]) & (changes[bhi - 1] == changes[blo]) & (label[alo] == label[blo])
        live = ~joined & ~(same & (ahi - alo < 2))
        small = live & ((size <= 256) | (d >= BITS))
        for s in np.array_split(np.flatnonzero(small), max(1, int(size[small].sum()) >> 20)):
            if len(s):
                k = size[s]
                at = np.repeat(np.arange(len(s)), k)
                off = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                w = (bhi - blo)[s][at]
                a, b = alo[s][at] + off // w, blo[s][at] + off % w
                near = np.bitwise_count(key[a] ^ key[b]) <= budget
                label = link(label, a[near], b[near])
        g = np.flatnonzero(live & ~small)
        if not len(g):
            continue
        alo, ahi, blo, bhi, used, same = alo[g], ahi[g], blo[g], bhi[g], used[g], same[g]
        am, bm = mid(d, alo, ahi), mid(d, blo, bhi)
        kids = [
            (alo, am, blo, bm, used, np.ones(len(g), bool)),
            (am, ahi, bm, bhi, used, np.ones(len(g), bool)),
            (alo, am, bm, bhi, used + 1, np.ones(len(g), bool)),
            (am, ahi, blo, bm, used + 1, ~same),
        ]
        part = [np.concatenate(x) for x in zip(*kids, strict=True)]
        ok = part[5] & (part[0] < part[1]) & (part[2] < part[3]) & (part[4] <= budget)
        # near pairs last, so that they are taken first and later pairs are often joined already
        order = np.flatnonzero(ok)
        order = order[np.argsort(-part[4][order], kind="stable")]
        stack.append((d + 1, *(x[order] for x in part[:5])))
    return label


def _join_units(budget: int):
    """mapInArrow body: rows (unit, side, depth, diff, key, node) come sorted by unit; gives edges (a, b)."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        cols = {c: t.column(c).to_numpy() for c in ("unit", "side", "depth", "diff", "node")}
        key = t.column("key").to_numpy().view(np.uint64)
        out = []
        for depth in np.unique(cols["depth"]):
            pick = np.flatnonzero(cols["depth"] == depth)
            order = pick[np.lexsort((key[pick], cols["side"][pick], cols["unit"][pick]))]
            x = {c: v[order] for c, v in cols.items()}
            label = trie_join(x["unit"], x["side"], key[order], int(depth), x["diff"].astype(np.int64), budget)
            linked = np.flatnonzero(label != np.arange(len(label)))
            out.append((x["node"][linked], x["node"][label[linked]]))
        a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= 1 << 18:
                t = pa.Table.from_batches(held)
                unit = t.column("unit").to_numpy()
                done = int(np.searchsorted(unit != unit[-1], False)) if unit[0] == unit[-1] else int(np.flatnonzero(unit != unit[-1])[-1]) + 1
                if done:  # the last unit may go on in the next batch
                    yield solve(t.slice(0, done))
                    held, rows = t.slice(done).to_batches(), t.num_rows - done
        if rows:
            yield solve(pa.Table.from_batches(held))

    return run


# -- node pairs across tasks -------------------------------------------------------------------


def _rotated(fp: Column, band: int, width: int) -> Column:
    """The fingerprint with the bits of ``band`` in front."""
    s = band * width
    return fp if s == 0 else F.shiftleft(fp, s).bitwiseOR(F.shiftrightunsigned(fp, BITS - s))


def near_fingerprints(nodes: DataFrame, budget: int = 3, node_rows: int = NODE_ROWS) -> DataFrame:
    """Edges (a, b) of ``nodes(fp, node)`` that connect whatever lies within ``budget`` bits.

    Two fingerprints within the budget agree in one of ``budget + 1`` bands of bits. So there is
    one trie for each band, with that band's bits first: down to the end of the band only equal
    nodes pair up, which is where the work is dealt out. Below, a pair of nodes with more than
    ``node_rows`` fingerprints in one of them is split by the next 8 bits: pairs of children are
    made from the counts per child and pruned by the budget, before any fingerprint moves. Tasks
    return a spanning forest of what they linked, never all pairs of a group.
    """
    bands = budget + 1
    width = BITS // bands
    width -= width % 4
    keyed = nodes.select(
        "node",
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("band"), _rotated(F.col("fp"), i, width).alias("key")) for i in range(bands)])
        ).alias("k"),
    ).select("node", "k.band", "k.key")

    def prefix(depth: int) -> Column:
        return F.shiftrightunsigned("key", BITS - depth) if depth < BITS else F.col("key")

    def children(depth: int) -> DataFrame:
        return keyed.groupBy("band", prefix(depth).alias("p")).agg(F.count("*").alias("n"))

    depth = width
    frontier = children(depth).where("n > 1").select("band", "p", F.col("p").alias("q"), F.lit(0).alias("diff"), "n", F.col("n").alias("m"))
    units, scratch = [], []
    while True:
        frontier = materialize(frontier, "trie")
        scratch.append(frontier)
        fits = (F.greatest("n", "m") <= node_rows) | F.lit(depth >= BITS)
        unit = F.xxhash64(F.lit(depth), "band", "p", "q")
        ready = frontier.where(fits).withColumn("unit", unit)
        sides = ready.select("band", F.col("p").alias("at"), "unit", F.lit(0).alias("side"), "diff").unionByName(
            ready.where("p != q").select("band", F.col("q").alias("at"), "unit", F.lit(1).alias("side"), "diff")
        )
        units.append(
            keyed.withColumn("at", prefix(depth)).join(sides, ["band", "at"]).select(
                "unit", "side", F.lit(depth).alias("depth"), "diff", "key", "node"
            )
        )
        large = frontier.where(~fits)
        if depth >= BITS or large.isEmpty():
            break
        step = min(8, BITS - depth)
        kids = children(depth + step).withColumn("up", F.shiftrightunsigned("p", step))
        kp = kids.select("band", F.col("up").alias("p"), F.col("p").alias("cp"), F.col("n").alias("cn"))
        kq = kids.select("band", F.col("up").alias("q"), F.col("p").alias("cq"), F.col("n").alias("cm"))
        apart = F.bit_count(F.col("cp").bitwiseXOR(F.col("cq")).bitwiseAND(F.lit((1 << step) - 1)))
        frontier = (
            large.join(kp, ["band", "p"])
            .join(kq, ["band", "q"])
            .withColumn("diff", F.col("diff") + apart)
            .where((F.col("diff") <= budget) & ((F.col("p") != F.col("q")) | (F.col("cp") <= F.col("cq"))))
            .where((F.col("cp") != F.col("cq")) | (F.col("cn") > 1))
            .select("band", F.col("cp").alias("p"), F.col("cq").alias("q"), "diff", F.col("cn").alias("n"), F.col("cm").alias("m"))
        )
        depth += step
    work = units[0]
    for u in units[1:]:
        work = work.unionByName(u)
    edges = work.repartition("unit").sortWithinPartitions("unit").mapInArrow(_join_units(budget), "a long, b long")
    edges = materialize(edges, "links")
    for s in scratch:
        discard(s)
    return edges


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = 3, seed: int = 42
) -> DataFrame:
    """Group documents whose SimHash fingerprints differ in at most ``budget`` bits: id, fingerprint
    (16 hex digits) and component_id (smallest id reachable over such links).

    Equal fingerprints are one node from the start, so exact copies cost one row. Null and empty
    texts have fingerprint zero and are linked like any other; repeated rows come out repeated;
    rows with null ids link like others but never name a component (component_id is null where
    no row of it has an id); an empty table gives an empty table. Only the two named columns are read.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("id").alias("id")), "nodes")
    links = near_fingerprints(nodes.select("fp", F.col("fp").alias("node")), budget)
    parts = connected_components(links).withColumnRenamed("node", "fp")
    placed = nodes.join(parts, "fp", "left").select("fp", "id", F.coalesce("component", "fp").alias("component"))
    least = placed.groupBy("component").agg(F.min("id").alias("component_id"))
    named = materialize(placed.join(least, "component").select("fp", "component_id"), "groups")
    for used in (nodes, links):
        discard(used)
    return fps.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


# -- links by similarity -----------------------------------------------------------------------

#: Parts of a document whose fingerprints are compared, and the growth from one size class to the next.
PARTS = 24
GROWTH = 1.25


def shingle_set(text: bytes | None, shingle: int, seed: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted (see ``fingerprint``)."""
    words = (text or b"").lower().split()
    if 0 < len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    found = [np.zeros(0, np.uint64)]
    n = len(words) - shingle + 1
    for at in range(0, n, CHUNK):
        part = words[at : min(at + CHUNK, n) + shingle - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(shingle)), strict=False))
        found.append(np.unique(np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in grams), dtype=np.uint64)))
    return found[-1] if len(found) == 2 else np.unique(np.concatenate(found))


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def part_fingerprints(shingles: np.ndarray, similarity: float) -> np.ndarray:
    """Fingerprints of the parts that a set of shingles is dealt into by hash, for its own size class and the next.

    Two sets of Jaccard similarity s or more differ in at most (1-s)/(1+s) of their summed sizes. With
    one part more than that, one part at least is the same in both; so with up to PARTS parts no
    pair is missed. Larger sets give PARTS of their parts, each of which is the same with a
    chance of over 1/e: a pair right at s is missed with one of 1.5e-5. Sets of the similarity are in
    one class or in neighbours, so every set is dealt for its class and for the one above.
    """
    n = len(shingles)
    if not n:
        return np.zeros(0, np.uint64)
    out, mixed = [], _spread(shingles)
    size_class = int(np.log(n) / np.log(GROWTH))
    for level in (size_class, size_class + 1):
        parts = int(2 * (1 - similarity) / (1 + similarity) * GROWTH ** (level + 1)) + 1
        part = (mixed >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        order = np.argsort(part, kind="stable")
        order = order[: np.searchsorted(part[order], PARTS)]
        first = np.flatnonzero(np.concatenate([[True], part[order][1:] != part[order][:-1]])) if len(order) else np.zeros(0, int)
        if len(first):
            sums = np.add.reduceat(_spread(mixed[order] + np.uint64(1)), first)
            out.append(_spread(_spread(sums + part[order][first]) + np.uint64(level)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def similar_links(docs: DataFrame, id_col: str, text_col: str, shingle: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """Links (a, b) of documents whose sets of shingles have a Jaccard similarity of ``similarity`` or more.

    The fingerprints of parts of the documents are joined: a fingerprint that many share links
    each of them to the least of them only, so a large group is not paired off; its members share
    several, with different least ones. Every candidate is then decided on the two whole sets.
    ``similarity`` is at least 1/GROWTH. ids are longs without nulls that name one text each.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def over_texts(body, schema: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    part = batch.slice(at, 64)
                    sets = [shingle_set(t, shingle, seed) for t in part.column(1).cast(pa.binary()).to_pylist()]
                    yield body(part.column(0), sets)

        return lambda df: df.mapInArrow(run, schema)

    def keys(ids, sets):
        found = [part_fingerprints(x, similarity).view(np.int64) for x in sets]
        which = np.repeat(np.arange(len(found)), [len(x) for x in found])
        return pa.RecordBatch.from_arrays([ids.take(pa.array(which)), pa.array(np.concatenate(found))], names=["id", "key"])

    def whole(ids, sets):
        return pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes() for x in sets], pa.binary())], names=["id", "shingles"])

    parts = materialize(over_texts(keys, "id long, key long")(rows), "parts")
    least = parts.groupBy("key").agg(F.min("id").alias("other"), F.max("id").alias("last")).where("other < last").select("key", "other")
    pairs = materialize(parts.join(least, "key").where("id > other").select("id", "other").distinct(), "candidates")
    wanted = pairs.select("id").unionByName(pairs.select(F.col("other").alias("id"))).distinct()
    sets = materialize(over_texts(whole, "id long, shingles binary")(rows.join(wanted, "id", "left_semi").select("id", "text")), "shingles")
    # the candidates of one least document meet as narrow rows only; its set then goes to each of them
    both = pairs.join(sets.select(F.col("id").alias("other"), F.col("shingles").alias("others")), "other").join(sets, "id")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("shingles").to_pylist(), batch.column("others").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= similarity * max(len(x), len(y)) else 0
                ok.append(shared >= similarity * (len(x) + len(y) - shared))
            yield batch.select(["id", "other"]).filter(pa.array(ok, pa.bool_())).rename_columns(["a", "b"])

    links = materialize(both.select("id", "other", "shingles", "others").mapInArrow(decide, "a long, b long"), "links")
    for used in (parts, pairs, sets):
        discard(used)
    return links


def similar_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, budget: int = 3, similarity: float = 0.8, seed: int = 42
) -> DataFrame:
    """Groups of near-duplicates by similarity: rows (id, component_id), the smallest id reachable over links.

    Documents are linked if their SimHash fingerprints differ in at most ``budget`` bits (the trie join),
    or if the Jaccard similarity of their shingles is ``similarity`` or more (``similar_links``): of 64
    bits, texts right at 0.8 differ in about ten, a distance at which bits prune nothing. ids must not be
    null; rows with equal ids are one document and must have equal texts. Null and empty texts have
    fingerprint zero and link with each other; an empty table gives an empty table.
    """
    groups = materialize(near_duplicates(docs, id_col, text_col, shingle, budget, seed).select(F.col(id_col).alias("a"), F.col("component_id").alias("b")), "groups")
    links = similar_links(docs, id_col, text_col, shingle, similarity, seed)
    parts = connected_components(groups.unionByName(links))
    discard(links)
    ids = groups.select(F.col("a").alias("node")).distinct()
    return ids.join(parts, "node", "left").select(F.col("node").alias(id_col), F.coalesce("component", "node").alias("component_id"))


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

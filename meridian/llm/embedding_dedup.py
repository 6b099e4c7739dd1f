"""Embedding near-dedup: an exact metric range join over pivot cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import connected_components, discard, link, materialize

#: Vectors of a cell that are compared as one block, and how many of them at a time.
BLOCK = 16_384
STRIP = 512
#: Vectors that a cell should hold, most pivots, and most cells that a vector may stand in on the average
#: of the sample: more pivots than that would copy more than they prune.
CELL_ROWS = 512
MAX_PIVOTS = 4096
MAX_COPIES = 4.0
#: Numbers (of all vectors together) in the sample that pivots come from; it alone passes the driver.
SAMPLE_NUMBERS = 1 << 20
#: Slack on pruning tests, far above rounding and far below any distance that matters.
SLACK = 1e-9
RIM, CORE, VISITOR = 0, 1, 2


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component near 1: exact, and squares stay finite."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def choose_pivots(u: np.ndarray, wanted: int, radius: float) -> np.ndarray:
    """Pivots among the unit vectors of a sample: no two within 2 ``radius``, so that a tight group gets one, and as
    many (doubling, ``wanted`` at most) as keep the sample in MAX_COPIES cells each on average."""
    apart, taken = 1 - 2 * radius * radius, np.zeros(len(u), bool)
    chosen: list[int] = []
    for i in range(len(u)):
        if len(chosen) == wanted:
            break
        if not taken[i]:
            chosen.append(i)
            taken |= u @ u[i] > apart
    p, k = u[chosen], 1
    while k < len(p) and (_cells_of(u, p[: 2 * k], radius)[1].sum(axis=1) + 1).mean() <= MAX_COPIES:
        k *= 2
    return p[:k]


def _cells_of(u: np.ndarray, p: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest pivot of each vector, the lower-numbered cells that may hold a partner (a matrix), and whether
    it lies in the core of its cell.

    With unit vectors the metric is the chord. Let x have the nearest pivot p and y the nearest
    pivot q with |x-y| <= r. By the triangle inequality |x-q| <= |x-p| + 2r; the sharper form for
    Euclidean space is that x lies within r of the plane between p and q. One of the two cells
    is enough, so only the higher-numbered vector visits. Two vectors within r/2 of one pivot are
    within r of each other by the same inequality: the core of a cell is linked unseen.
    """
    dot = u @ p.T
    home = dot.argmax(axis=1)
    near = dot[np.arange(len(u)), home]
    gap = np.sqrt(np.maximum(2 - 2 * p @ p.T, 0))[home]
    visits = (near[:, None] - dot <= radius * gap + SLACK) & (np.arange(len(p))[None, :] < home[:, None])
    return home, visits, near >= 1 - radius * radius / 8 + SLACK


def assign_cells(vectors: DataFrame, pivots: dict[int, np.ndarray], radius: float, kind: str) -> DataFrame:
    """Rows (dim, cell, role, node, n, v) of ``vectors(node, n, embedding)``: each vector in the cell of its nearest pivot, in
    its core or rim, and as a visitor in other cells. v holds the components as ``kind``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                lists = part.column("embedding")
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                start = np.cumsum(size) - size
                for dim in np.unique(size):
                    own = np.flatnonzero(size == dim)
                    x = flat[start[own][:, None] + np.arange(dim)]
                    p = pivots.get(int(dim))
                    if p is None:
                        home, visits, core = np.zeros(len(own), int), np.zeros((len(own), 1), bool), np.zeros(len(own), bool)
                    else:
                        home, visits, core = _cells_of(_unit(x), p, radius)
                    row, cell = np.nonzero(visits)
                    raw = [v.tobytes() for v in x.astype(kind)]
                    row = np.concatenate([np.arange(len(own)), row])
                    take = pa.array(own[row])
                    columns = [
                        pa.array(np.full(len(row), dim, np.int32)),
                        pa.array(np.concatenate([home, cell]).astype(np.int32)),
                        pa.array(np.concatenate([np.where(core, CORE, RIM), np.full(len(cell), VISITOR)]).astype(np.int32)),
                        part.column("node").take(take),
                        part.column("n").take(take),
                        pa.array([raw[r] for r in row], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["dim", "cell", "role", "node", "n", "v"])

    return vectors.mapInArrow(run, "dim int, cell int, role int, node long, n long, v binary")


FOUND = "node long, links long, other long"


def _compare(threshold: float, kind: str):
    """One block against another (or itself): link counts of every row and a spanning forest."""

    def run(t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy()
        same = t.column("a")[0].as_py() == t.column("b")[0].as_py()
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if same else 1))
        node, n = t.column("node").to_numpy(), t.column("n").to_numpy()
        dim = t.column("dim")[0].as_py()
        x = np.frombuffer(b"".join(t.column("v").to_pylist()), dtype=kind).reshape(-1, dim).astype(np.float64)
        x = _scaled(x)
        square = (x * x).sum(axis=1)
        u = (x / np.sqrt(square)[:, None]).astype(np.float32)
        slack = max(1e-5, 1e-6 * dim)  # above the rounding of a single-precision product
        links, label = np.zeros(len(x)), np.arange(len(x))
        ub = u[b].T
        for at in range(0, len(a), STRIP):
            cos = u[a[at : at + STRIP]] @ ub
            i, j = np.nonzero(cos >= threshold - slack)
            i, j, cos = a[at + i], b[j], cos[i, j]
            if same:
                i, j, cos = (v[i < j] for v in (i, j, cos))
            close = np.flatnonzero(cos < threshold + slack)
            for c in np.array_split(close, 1 + len(close) * dim // (1 << 22)):  # decided in double precision
                top = (x[i[c]] * x[j[c]]).sum(axis=1)
                cos[c] = np.where(top / np.sqrt(square[i[c]] * square[j[c]]) >= threshold, 2, -2)
            hit = cos >= threshold
            i, j = i[hit], j[hit]
            links += np.bincount(i, weights=n[j], minlength=len(x)) + np.bincount(j, weights=n[i], minlength=len(x))
            label = link(label, i, j)
        some = np.flatnonzero(links > 0)
        columns = [node[some], links[some].astype(np.int64), node[label[some]]]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["node", "links", "other"])

    return run


def _range(low: Column, high: Column) -> Column:
    """low, low + 1, ... high; empty if high is less."""
    return F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def block_pairs(cells: DataFrame, block: int) -> DataFrame:
    """The rows of ``cells`` once for each pair of blocks (a, b) that they are compared in, with their side of it.

    The rim, the core and the visitors of a cell are cut into blocks, numbered in this order. The core is
    not compared with itself, nor visitors with visitors (they meet in another cell)."""
    blocks = lambda role: F.ceil(F.count_if(F.col("role") == role) / block).cast("int")
    sizes = cells.groupBy("dim", "cell").agg(*[blocks(k).alias(f"_{k}") for k in (RIM, CORE, VISITOR)])
    rim, homes, total = F.col("_0"), F.col("_0") + F.col("_1"), F.col("_0") + F.col("_1") + F.col("_2")
    by_role = lambda *v: F.when(F.col("role") == RIM, v[0]).when(F.col("role") == CORE, v[1]).otherwise(v[2])
    inside = F.pmod(F.xxhash64(F.lit(7), "node"), by_role(F.col("_0"), F.col("_1"), F.col("_2"))).cast("int")
    k = F.col("k")
    first = _range(by_role(k, homes, total), total - 1)
    second = _range(F.lit(0), by_role(k, rim, homes) - 1)
    pair = lambda a, b, side: F.struct(a.alias("a"), b.alias("b"), F.lit(side).alias("side"))
    return (
        cells.join(sizes, ["dim", "cell"])
        .withColumn("k", by_role(F.lit(0), rim, homes) + inside)
        .withColumn("u", F.explode(F.concat(F.transform(first, lambda x: pair(k, x, 0)), F.transform(second, lambda x: pair(x, k, 1)))))
        .select("dim", "cell", "u.a", "u.b", "u.side", "node", "n", "v")
    )


def near_embeddings(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.95,
    block: int = BLOCK,
    cell_rows: int = CELL_ROWS,
    seed: int = 0,
) -> DataFrame:
    """One row per vector: id, n_links (other vectors at cosine >= ``threshold``), component_id, kept.

    Equal vectors count as one with a multiplicity and have a key of their own, so null and repeated
    ids change no link. The pivots come from a sample of at most SAMPLE_NUMBERS components,
    those with the least hash; which ones they are changes the work, never the result.
    The rows of a cell are cut into blocks of ``block`` rows and pairs of blocks are compared, so a
    cell with a third of all vectors becomes many tasks of bounded size, and a tight group around a
    pivot (its core) is linked without comparison. Per block pair come counts and a spanning
    forest, not pairs. Exactness costs: where distances concentrate (vectors without clusters in many
    dimensions) hardly a cell can be skipped, and fewer pivots are taken.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing;
    vectors of different lengths do not link. Repeated rows link with each other and come
    out repeated; rows with a null id link like others but name no component (component_id is null, and
    kept true, where no row of it has an id); other columns are not read; an empty table gives an empty table.
    """
    kind = "<f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "<f8"
    v = F.col("embedding")
    bad = v.isNull() | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("vid"), F.col(vector_col).cast("array<float>" if kind == "<f4" else "array<double>").alias("embedding"))
    rows = rows.withColumn("key", F.when(~F.coalesce(bad, F.lit(True)), F.struct(F.xxhash64(v).alias("h1"), F.xxhash64(F.lit(1), v).alias("h2"), F.size(v).alias("dim"))))
    distinct = rows.where("key is not null").groupBy("key").agg(
        F.min("vid").alias("id"), F.count("*").alias("n"), F.first("embedding").alias("embedding")
    )
    distinct = materialize(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct-vectors")
    sizes = distinct.groupBy(F.col("key.dim").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(64).collect()
    radius, pivots = float(np.sqrt(max(0.0, 2 - 2 * threshold))), {}
    room = SAMPLE_NUMBERS
    for dim, count in sizes:  # rarer lengths have one cell each
        wanted = min(MAX_PIVOTS, count // cell_rows)
        if wanted > 1 and room >= 16 * dim:
            some = distinct.where(F.col("key.dim") == dim).orderBy(F.xxhash64(F.lit(seed), "key")).limit(min(8 * wanted, room // dim))
            u = _unit(np.array([r[0] for r in some.select("embedding").collect()], dtype=np.float64))
            pivots[dim] = choose_pivots(u, wanted, radius)
            room -= u.size
    cells = materialize(assign_cells(distinct.select("node", "n", "embedding").repartition("node"), pivots, radius, kind), "cells")
    found = block_pairs(cells, block).groupBy("dim", "cell", "a", "b").applyInArrow(_compare(threshold, kind), FOUND)
    cores = cells.where(F.col("role") == CORE)
    whole = cores.groupBy("dim", "cell").agg(F.sum("n").alias("all"), F.min("node").alias("other"))
    inner = cores.join(whole, ["dim", "cell"]).select("node", (F.col("all") - F.col("n")).alias("links"), "other")
    found = materialize(found.unionByName(inner), "found")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    placed = (
        distinct.select("key", "id", "n", "node")
        .join(counts, "node", "left")
        .join(parts, "node", "left")
        .select("key", "id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    )
    least = placed.groupBy("component").agg(F.min("id").alias("component_id"))
    named = materialize(placed.join(least, "component").select("key", "n_links", "component_id"), "groups")
    for used in (distinct, cells, found):
        discard(used)
    linked = rows.select("vid", "key").where("key is not null").join(named, "key").select("vid", "n_links", "component_id")
    apart = rows.where("key is null").select("vid", F.lit(0).cast("long").alias("n_links"), F.col("vid").alias("component_id"))
    return linked.unionByName(apart).select(
        F.col("vid").alias(id_col), "n_links", "component_id", F.col("vid").eqNullSafe(F.col("component_id")).alias("kept")
    )


def op2_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS least FROM r GROUP BY a),
n AS (SELECT a, count(*) AS links FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(links, 0) AS BIGINT) AS n_links, CAST(coalesce(least(vec_id, c.least), vec_id) AS BIGINT) AS component_id,
       vec_id = coalesce(least(vec_id, c.least), vec_id) AS kept
FROM embeddings LEFT JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a
"""

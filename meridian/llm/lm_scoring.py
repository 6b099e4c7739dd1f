"""LM scoring: trigram deleted interpolation with mixture weights by context frequency, learned by EM.

The texts are cut into blocks of tokens. A block is one row: its vocabulary as hashes and its
documents as ids into it. Each block sends the distinct n-grams it holds, with its own counts, to
hash partitions, which add them up and send back to each block the totals of its n-grams, in the
order of their hashes. Triples take their turn before pairs and words, so that only about half of the
n-grams are on disk at a time. So a frequent n-gram costs an entry per block, not per occurrence, and no
table of the corpus has to fit in a task or the driver. A block and a partition exchange a row only if
they share an n-gram, so there are never more rows than distinct n-grams in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import bucketed, discard, materialize, shuffles_dropped

#: Tokens of a block, and n-grams of a hash partition (about).
BLOCK_TOKENS = 1_000_000
PART_KEYS = 2_000_000
#: Spark's own limit of buckets (spark.sql.sources.bucketing.maxBuckets) that blocks and totals are dealt to; a
#: bucket works off its blocks one by one, so beyond it tasks get longer, not larger.
MOST_BUCKETS = 100_000
BUCKET_BLOCKS = 4
EM_ROUNDS = 20
#: Steps per octave in which relative frequencies (trigram, bigram, unigram) are told apart when the weights are learned.
GRID = (4, 4, 4)
#: Bits of a bigram's or trigram's hash beyond those that number the tokens: one n-gram in 2^24 meets another's.
SPARE_BITS = 24
UNI, BI, TRI = 0, 1, 2
KINDS = (UNI, BI, TRI)
#: Kinds that are counted together, turn by turn: about equal in bytes.
TURNS = ((TRI,), (UNI, BI))
#: Local ids 0 and 1: what stands before the first word, and the token after the last.
BEGIN, END = 0, 1
A, B, HELD_OUT = 0, 1, 2


def _pack(x: np.ndarray) -> bytes:
    """Compressed bytes of an array; the bytes of equal weight lie together."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes() if len(x) else b""
    return zstandard.compress(planes, 1)


def _unpack(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).ravel()


def _pack_sorted(x: np.ndarray) -> bytes:
    """Compressed bytes of a sorted array of hashes, as gaps."""
    return _pack(np.diff(x, prepend=np.uint64(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, "<u8"), dtype=np.uint64)


BLOCKS = "block long, tokens long, vocabulary binary, ids binary, starts binary, documents array<struct<row:bigint,id:bigint,fold:int,ends:boolean>>"


def block_table(docs: DataFrame, block_tokens: int) -> DataFrame:
    """Blocks of ``docs(id, fold, text)``. ids holds, for each (part of a) document, the two tokens before it
    and its tokens; starts where each begins. A long document may go on in the next block;
    ends marks its last part, row names the input row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows, blocks = TaskContext.get().partitionId() << 32, 0, 0

        def block(local, parts, documents):
            nonlocal blocks
            words = np.fromiter(
                (xxhash.xxh64_intdigest(w) if isinstance(w, bytes) else xxhash.xxh64_intdigest(b"", w) for w in local),
                np.uint64,
                len(local),
            )
            ids = np.concatenate(parts)
            # frequent words get small ids, which compress better
            order = np.argsort(-np.bincount(ids, minlength=len(local))[2:], kind="stable") + 2
            rank = np.concatenate([[0, 1], np.empty(len(order), np.int64)]).astype(np.uint32)
            rank[order] = np.arange(2, len(local), dtype=np.uint32)
            starts = np.cumsum([0, *map(len, parts)]).astype(np.uint32)
            names = ["block", "tokens", "vocabulary", "ids", "starts", "documents"]
            kind = pa.list_(pa.struct([("row", pa.int64()), ("id", pa.int64()), ("fold", pa.int32()), ("ends", pa.bool_())]))
            values = [
                pa.array([task + blocks], pa.int64()), pa.array([len(ids) - 2 * len(parts)], pa.int64()),
                *[pa.array([_pack(x)], pa.binary()) for x in (words[np.concatenate([[0, 1], order])], rank[ids], starts)],
                pa.array([documents], kind),
            ]
            blocks += 1
            return pa.RecordBatch.from_arrays(values, names=names)

        def fresh():
            return {42: BEGIN, 43: END}, [], []  # keys that no word equals

        (local, parts, documents), held = fresh(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = part.column("text").cast(pa.binary()).to_pylist()
                for doc, fold, text in zip(part.column("id").to_pylist(), part.column("fold").to_pylist(), texts, strict=True):
                    words = (text or b"").lower().split()
                    before, first, total = [42, 42], 0, len(words) + 1
                    while first < total:
                        took = min(total - first, max(1, block_tokens - held))
                        mine = words[first : first + took]
                        ids = [local.setdefault(w, len(local)) for w in before]
                        ids += [local.setdefault(w, len(local)) for w in mine]
                        first += took
                        if first == total:
                            ids.append(END)
                        before = [*before, *mine[-2:]][-2:]
                        parts.append(np.array(ids, dtype=np.uint32))
                        documents.append({"row": task + rows, "id": doc, "fold": fold, "ends": first == total})
                        held += took
                        if held >= block_tokens:
                            yield block(local, parts, documents)
                            (local, parts, documents), held = fresh(), 0
                    rows += 1
        if parts:
            yield block(local, parts, documents)

    return docs.mapInArrow(run, BLOCKS)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) ^ (b + (b << np.uint64(31)))
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def hash_bits(tokens: int) -> int:
    return min(64, SPARE_BITS + max(1, tokens).bit_length())


class Block:
    """A block taken apart: for each token its fold, document part and words, and the places of its n-grams and of its
    contexts in the block's own lists of distinct n-grams (the hashes of pairs and triples in order), those of ``kinds``."""

    def __init__(self, row: dict, bits: int, kinds: tuple[int, ...] = KINDS):
        self.name = row["block"]
        words = _unpack(row["vocabulary"], "<u8")
        ids, starts = _unpack(row["ids"], "<u4").view(np.int32), _unpack(row["starts"], "<u4").astype(np.int64)
        self.documents = row["documents"]
        first, second = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
        first[starts[:-1]], second[starts[:-1] + 1] = True, True
        at = np.flatnonzero(~first)
        lead = second[at]
        part = np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts) - 1)
        fold = np.array([d["fold"] for d in self.documents], dtype=np.int8)
        begins = ids[starts[:-1] + 1] == BEGIN
        shift = np.uint64(64 - bits)
        pair = _joined(words[ids[at - 1]], words[ids[at]])
        token = np.flatnonzero(~lead)
        self.keys = {UNI: words}
        if BI in kinds:
            self.keys[BI], pair_of = np.unique(pair >> shift, return_inverse=True)
            pair_of = pair_of.astype(np.int32)
            # the pair before a part counts where the document begins, as often as documents do
            self._pair_folds = np.where(lead & ~begins[part], HELD_OUT, fold[part]), pair_of
            self.pair_of, self.pair_context = pair_of[token], pair_of[token - 1]
        if TRI in kinds:
            self.keys[TRI], triple_of = np.unique(_joined(pair[token - 1], words[ids[at[token]]]) >> shift, return_inverse=True)
            self.triple_of = triple_of.astype(np.int32)
        self.token, self.context = ids[at[token]], ids[at[token] - 1]
        self.part = part[token]
        self.fold = fold[self.part]
        self.begins = [int((begins & (fold == f)).sum()) for f in (A, B)]

    def counts(self, kind: int) -> np.ndarray:
        """Training counts per fold (2 x n) of the n-grams of a kind; words count contexts at document starts too."""
        folds, which = (self.fold, self.token) if kind == UNI else self._pair_folds if kind == BI else (self.fold, self.triple_of)
        out = np.stack([np.bincount(which[folds == f], minlength=len(self.keys[kind])) for f in (A, B)])
        if kind == UNI:
            out[:, BEGIN] = self.begins
        return out


NGRAMS = "kind int, part int, block long, keys binary, a binary, b binary"


def _parts(block: Block, kind: int, parts: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of a block's n-grams by hash, the hash partitions that hold any, and where each begins (and the end)."""
    keys = block.keys[kind]
    order = np.argsort(keys) if kind == UNI else np.arange(len(keys))
    top = keys[order] if kind == UNI else keys << np.uint64(64 - bits)
    part = (top >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)  # partitions are ranges of the hash
    cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    return order, part[cut].astype(np.int64), np.append(cut, len(keys))


def block_ngrams(kinds: tuple[int, ...], parts: dict[int, int], bits: int):
    """mapInArrow body: the distinct n-grams of each block, of some kinds, with its counts, by hash partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                b = Block(batch.slice(k, 1).to_pylist()[0], bits, kinds)
                for kind in kinds:
                    order, part, edges = _parts(b, kind, parts[kind], bits)
                    keys, counts = b.keys[kind][order], b.counts(kind)[:, order].astype(np.uint32)
                    out = [
                        (kind, p, b.name, _pack_sorted(keys[lo:hi]), _pack(counts[A, lo:hi]), _pack(counts[B, lo:hi]))
                        for p, lo, hi in zip(part.tolist(), edges, edges[1:], strict=False)
                    ]
                    names = ["kind", "part", "block", "keys", "a", "b"]
                    types = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 3]
                    cols = zip(*out, strict=True) if out else [[]] * 6
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=names)

    return run


REPLIES = "kind int, part int, block long, a binary, b binary, types long, tokens_a long, tokens_b long"


def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """applyInArrow body for one partition: the totals of each block's n-grams, in the order it sent them.

    A row with null block carries the sums of the partition: trained n-grams and their tokens.
    """
    t = pa.Table.from_batches(batches)
    if not t.num_rows:
        return
    kind, part = t.column("kind")[0].as_py(), t.column("part")[0].as_py()
    keys = [_unpack_sorted(x.as_py()) for x in t.column("keys")]
    ends = np.cumsum([len(k) for k in keys])
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")
    ordered = flat[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    group = np.empty(len(flat), np.int32)
    group[order] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(ordered))))
    word = ordered[first] != np.uint64(xxhash.xxh64_intdigest(b"", 42)) if kind == UNI else np.ones(len(first), bool)
    totals = []
    for c in ("a", "b"):
        counts = np.concatenate([_unpack(x.as_py(), "<u4") for x in t.column(c)])
        totals.append(np.add.reduceat(counts[order].astype(np.int64), first))
    names = ["kind", "part", "block", "a", "b", "types", "tokens_a", "tokens_b"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    trained = int(((totals[A] + totals[B] > 0) & word).sum())
    sums = (kind, part, None, None, None, trained, *[int(x[word].sum()) for x in totals])
    yield pa.RecordBatch.from_arrays([pa.array([v], x) for v, x in zip(sums, types, strict=True)], names=names)
    for block, lo, hi in zip(t.column("block").to_pylist(), [0, *ends[:-1]], ends, strict=True):
        reply = (kind, part, block, *[_pack(x[group[lo:hi]].astype("<u8")) for x in totals], None, None, None)
        yield pa.RecordBatch.from_arrays([pa.array([v], x) for v, x in zip(reply, types, strict=True)], names=names)


def _totals(block: Block, parts: dict[int, int], bits: int, replies: list[dict]) -> list[np.ndarray]:
    """Counts per fold of the block's words, pairs and triples over all training documents."""
    out = []
    for kind in KINDS:
        order, part, edges = _parts(block, kind, parts[kind], bits)
        place = {p: k for k, p in enumerate(part.tolist())}
        counts = np.zeros((2, len(order)), np.int64)
        for r in replies:
            if r["kind"] == kind:
                k = place[r["part"]]
                at = order[edges[k] : edges[k + 1]]
                counts[A, at], counts[B, at] = _unpack(r["a"], "<u8"), _unpack(r["b"], "<u8")
        out.append(counts)
    return out


def _bucket(pairs: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Bucket of a context by its frequency: 64 and more by octaves of the pair's count, if it was seen; else, by
    octaves of the last word's count, 1 and more, or 0 if that is new too."""
    octave = lambda c: np.log2(np.maximum(c, 1)).astype(np.int64) + 1
    return np.where(pairs > 0, 63 + octave(pairs), np.where(words > 0, octave(words), 0))


def _frequencies(b: Block, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray, tokens: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Bucket of each token's context and the token's relative frequencies after two words, after one, and in all."""
    c2, c1 = pairs[b.pair_context], words[b.context]
    f = [triples[b.triple_of] / np.maximum(c2, 1), pairs[b.pair_of] / np.maximum(c1, 1), words[b.token] / max(1, tokens)]
    return _bucket(c2, c1), f


CELLS = "cell long, f3 float, f2 float, f1 float, n long"


def held_out_cells(tokens: list[int], parts: dict[int, int], bits: int):
    """cogroup body: the tokens of one training fold under the relative frequencies of the other,
    gathered by bucket (cell >> 33) and by the frequencies on a grid of 1/GRID octaves (their sums are kept)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        b = Block(left.to_pylist()[0], bits)
        totals = _totals(b, parts, bits, right.to_pylist())
        got = []
        for held, other in ((A, B), (B, A)):
            bucket, f = _frequencies(b, *[t[other] for t in totals], tokens[other])
            pick = b.fold == held
            got.append((bucket[pick], *[x[pick] for x in f]))
        bucket, *f = (np.concatenate(x) for x in zip(*got, strict=True))
        code = bucket
        for x, steps in zip(f, GRID, strict=True):  # eleven bits each; 1 stands for a frequency of zero
            code = (code << 11) | (np.where(x > 0, np.round(np.log2(np.maximum(x, 1e-18)) * steps), 1).astype(np.int64) + 1024)
        cell, inverse = np.unique(code, return_inverse=True)
        n = len(cell)
        cols = [
            pa.array(cell),
            *[pa.array(np.bincount(inverse, weights=x, minlength=n).astype(np.float32)) for x in f],
            pa.array(np.bincount(inverse, minlength=n)),
        ]
        return pa.Table.from_arrays(cols, names=["cell", "f3", "f2", "f1", "n"])

    return run


#: Weights that EM starts from and, without held-out tokens, of contexts that are new.
START, NEW = (0.3, 0.3, 0.3, 0.1), (0.0, 0.0, 0.9, 0.1)


def learn_weights(cells: DataFrame, uniform: float, rounds: int = EM_ROUNDS) -> dict[int, tuple[float, ...]]:
    """EM on the held-out counts: weights of trigram, bigram, unigram and uniform for each context bucket.

    Each round is one aggregation; one row per bucket (at most 128) comes back.
    """
    weights: dict[int, tuple[float, ...]] = {}
    for _ in range(rounds):
        known = [x for k, w in weights.items() for x in (F.lit(k), F.array(*map(F.lit, w)))]
        start = F.array(*map(F.lit, START))
        w = F.coalesce(F.try_element_at(F.create_map(*known), F.col("bucket")), start) if known else start
        top = [w[i] * x for i, x in enumerate((F.col("f3"), F.col("f2"), F.col("f1"), F.lit(uniform)))]
        p = top[0] + top[1] + top[2] + top[3]
        got = cells.groupBy("bucket").agg(*[F.sum(F.col("n") * x / p).alias(f"w{i}") for i, x in enumerate(top)]).collect()
        weights = {r.bucket: tuple(max(x, 1e-9 * sum(r[1:])) / sum(r[1:]) for x in r[1:]) for r in got}
        weights = {k: tuple(x / sum(w) for x in w) for k, w in weights.items()}
    return weights


SCORES = "row long, id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def score_blocks(types: int, tokens: list[int], parts: dict[int, int], bits: int, weights: dict[int, tuple[float, ...]]):
    """cogroup body: sums over the tokens of each document part."""
    table = np.array([weights.get(k, NEW) for k in range(128)])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        b = Block(left.to_pylist()[0], bits)
        totals = [t.sum(axis=0) for t in _totals(b, parts, bits, right.to_pylist())]
        total, c = sum(tokens), totals[UNI][b.token]
        bucket, f = _frequencies(b, *totals, total)
        p = table[bucket, 3] / (types + 1)
        for i, x in enumerate(f):
            p += table[bucket, i] * x
        base = np.log10((c + 0.5) / (total + 0.5 * (types + 1)))
        n = len(b.documents)
        cols = [
            pa.array([d["row"] for d in b.documents], pa.int64()),
            pa.array([d["id"] for d in b.documents], pa.int64()),
            pa.array([d["fold"] == HELD_OUT for d in b.documents], pa.bool_()),
            pa.array(np.bincount(b.part, minlength=n)),
            pa.array(np.bincount(b.part, weights=c > 0, minlength=n).astype(np.int64)),
            pa.array(np.bincount(b.part, weights=base, minlength=n).astype(float)),
            pa.array(np.bincount(b.part, weights=np.log10(p), minlength=n).astype(float)),
        ]
        return pa.Table.from_arrays(cols, names=["row", "id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def score_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    held_out=None,
    block_tokens: int = BLOCK_TOKENS,
    part_keys: int = PART_KEYS,
) -> DataFrame:
    """Score every document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words (A-Z lower-cased, split at ASCII white space) and one end token. Training
    documents are those outside ``held_out`` (a condition; by default crc32 of the id as text, modulo
    5, is 1). The model is P(w|uv) = l3 c(uvw)/c(uv) + l2 c(vw)/c(v) + l1 c(w)/N + l0/(V+1), the l by bucket of c(uv), or of c(v) if uv is new;
    the training documents are two folds, the tokens of each are held out from the counts of
    the other, and EM on these held-out counts gives the l. Counts then join both folds.
    score is the log10 probability of the document, base_score the one of the add-half unigram.

    Null and empty texts are one end token; a null id counts as an empty text id (not held out);
    repeated rows are scored as often as they stand and count as often; other columns are not read; an
    empty table gives an empty table. Without training documents every count is zero.
    """
    crc = F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8"))
    out = (crc % 5 == 1) if held_out is None else held_out
    fold = F.when(F.coalesce(out, F.lit(False)), F.lit(HELD_OUT)).otherwise((F.floor(crc / 5) % 2).cast("int"))
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), fold.alias("fold"), F.col(text_col).cast("string").alias("text"))
    about = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    expected = -(-about // (6 * block_tokens))
    # a task takes BUCKET_BLOCKS blocks or so, whose cells are added up before they are shuffled, while there are tasks for all cores
    buckets = max(1, min(MOST_BUCKETS, max(min(expected, docs.sparkSession.sparkContext.defaultParallelism), expected // BUCKET_BLOCKS)))
    blocks = bucketed(block_table(narrow, block_tokens), "blocks", "block", buckets)
    size = blocks.agg(F.sum("tokens")).first()[0] or 0
    parts, bits = {kind: max(1, -(-size // (part_keys * (2 if kind == UNI else 1)))) for kind in KINDS}, hash_bits(size)
    replies = None
    with shuffles_dropped(docs.sparkSession):
        for kinds in TURNS:
            ngrams = blocks.mapInArrow(block_ngrams(kinds, parts, bits), NGRAMS)
            answers = ngrams.groupBy("kind", "part").applyInArrow(add_up, REPLIES)
            replies = bucketed(answers.repartition(buckets, "block"), "counts", "block", buckets, replies)
    sums = replies.where(f"block is null and kind = {UNI}").agg(F.sum("types"), F.sum("tokens_a"), F.sum("tokens_b")).first()
    types, tokens = sums[0] or 0, [sums[1] or 0, sums[2] or 0]
    answers = replies.where("block is not null").select("kind", "part", "block", "a", "b")
    both = blocks.groupBy("block").cogroup(answers.groupBy("block"))
    cells = both.applyInArrow(held_out_cells(tokens, parts, bits), CELLS)
    cells = cells.groupBy("cell").agg(*[(F.sum(f) / F.sum("n")).alias(f) for f in ("f3", "f2", "f1")], F.sum("n").alias("n"))
    cells = cells.withColumn("bucket", F.shiftright("cell", 33).cast("int"))
    with shuffles_dropped(docs.sparkSession):
        cells = materialize(cells, "held-out")
        weights = learn_weights(cells, 1 / (types + 1))
        scored = both.applyInArrow(score_blocks(types, tokens, parts, bits, weights), SCORES)
        scored = materialize(scored, "scores")
    for used in (blocks, replies, cells):
        discard(used)
    return scored.groupBy("row").agg(
        F.first("id").alias(id_col),
        F.first("held_out").alias("held_out"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"),
        F.lit(sum(tokens)).cast("long").alias("train_tokens"),
        F.sum("base_score").alias("base_score"),
        F.sum("score").alias("score"),
    ).drop("row")


def op10_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

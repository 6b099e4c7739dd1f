"""Token ids, packed: best-fit-decreasing rows of ids with segment lengths and position resets."""

from __future__ import annotations

import base64
import glob
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of public tokenizer files, a parameter everywhere; the files are not part of this repository.
TOKENIZERS = "/opt/tokenizers"
SEQ_LEN = 2048
#: Tokens that a task gathers before it packs them.
POOL_TOKENS = 1 << 21

#: White space as the pre-tokenizer sees it, runs of it that it cannot match in one go, and characters encoded at a time.
BLANK = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
GAP = re.compile(f"[{BLANK}]{{1000,}}")
BREAK = re.compile(f"(?<=[^{BLANK}])[{BLANK}]")
STEP = 1 << 20

_loaded: dict[tuple[str, str], object] = {}


def tokenizer(folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken"):
    """The byte-level BPE in ``folder/name`` (a rank file), loaded once per Python worker."""
    if (folder, name) not in _loaded:
        import tiktoken

        #: Fixed value: the pre-tokenizer pattern that belongs to these ranks.
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        with open(os.path.join(folder, name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[folder, name] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[folder, name]


def encode(enc, text: str) -> np.ndarray:
    """The ids of a whole text, the same as ``encode_ordinary`` gives, for texts and gaps of any length.

    The pre-tokenizer always splits where white space follows something else, so long texts are
    cut there and encoded step by step. A run of white space is one piece of its own, without
    its last character if text follows; long runs skip the pattern, whose stack they would overflow.
    """

    def plain(at: int, end: int) -> None:
        while at < end:
            cut = BREAK.search(text, at + STEP, end) if end - at > STEP else None
            stop = cut.start() if cut else end
            ids.append(enc.encode_to_numpy(text[at:stop], disallowed_special=()))
            at = stop

    ids, at = [], 0
    for gap in GAP.finditer(text) if len(text) >= 1000 else ():
        plain(at, gap.start())
        at = gap.end() if gap.end() == len(text) else gap.end() - 1
        ids.append(np.array(enc._encode_single_piece(text[gap.start() : at]), dtype=np.uint32))
    plain(at, len(text))
    return np.concatenate(ids) if ids else np.zeros(0, np.uint32)


class CapacityTree:
    """Segment tree over the counts of bins by room: the least room that is at least a size."""

    def __init__(self, most: int):
        self.width = 1 << most.bit_length()
        self.count = [0] * (2 * self.width)

    def add(self, room: int, by: int) -> None:
        i = room + self.width
        while i:
            self.count[i] += by
            i >>= 1

    def at_least(self, size: int) -> int | None:
        i = size + self.width
        if self.count[i]:
            return size
        while i > 1:  # up to the first right sibling with a bin, then down to its left end
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.width:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.width
            i >>= 1
        return None


def best_fit_decreasing(lengths: np.ndarray, most: int) -> list[list[int]]:
    """Items of each bin: longest first, each into the fullest bin that holds it."""
    tree, open_bins = CapacityTree(most), [[] for _ in range(most + 1)]
    bins: list[list[int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        room = tree.at_least(size)
        if room is None:
            b, room = len(bins), most
            bins.append([])
        else:
            b = open_bins[room].pop()
            tree.add(room, -1)
        bins[b].append(i)
        if room > size:
            open_bins[room - size].append(b)
            tree.add(room - size, 1)
    return bins


@dataclass
class _Pool:
    ids: list[np.ndarray] = field(default_factory=list)
    docs: list[int | None] = field(default_factory=list)
    first: list[int] = field(default_factory=list)
    tokens: int = 0

    def add(self, doc: int | None, tokens: np.ndarray, seq_len: int) -> None:
        for at in range(0, len(tokens), seq_len):
            part = tokens[at : at + seq_len]
            self.ids.append(part)
            self.docs.append(doc)
            self.first.append(at)
            self.tokens += len(part)


SCHEMA = (
    "row_id long, length int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<bigint>, doc_starts array<bigint>"
)


def token_rows(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seq_len: int = SEQ_LEN,
    folder: str = TOKENIZERS,
    name: str = "byte_bpe_50k.tiktoken",
    end_id: int | None = 50256,
    pad_id: int = 50256,
    pool_tokens: int = POOL_TOKENS,
) -> DataFrame:
    """Packed sequences of token ids. Columns:

    row_id; length (tokens before padding); ids, ``seq_len`` little-endian ids padded with ``pad_id``
    (2 bytes each if the vocabulary fits, else 4), so rows laid end to end are the id
    matrix; cu_seqlens, 0 and the end of each segment; position_resets, where positions start again
    at 0 (the segment starts); doc_ids and doc_starts, each segment's document and first token in it.

    Every text, and then ``end_id`` unless None, is encoded whole; a document longer than ``seq_len`` is
    cut into segments that together give back all its tokens. Tasks pack their own documents pool by
    pool, so no text is shuffled; which documents share a row, and the ids of rows, depend on how the
    input is split. Null texts are empty: just an end token, or nothing without one. Null ids and
    repeated rows are kept; other columns are not read; an empty table gives no rows. ``folder`` must
    hold the tokenizer on every worker.
    """
    wide = max(end_id or 0, pad_id) >= 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizer(folder, name)
        kind = "<u4" if wide or enc.max_token_value >= 1 << 16 else "<u2"
        task = TaskContext.get().partitionId() << 32
        rows = 0

        def flush(pool: _Pool) -> Iterator[pa.RecordBatch]:
            nonlocal rows
            bins = best_fit_decreasing(np.array([len(x) for x in pool.ids], dtype=np.int64), seq_len)
            for at in range(0, len(bins), 512):
                out = {c: [] for c in ("row_id", "length", "ids", "cu", "resets", "docs", "starts")}
                for items in bins[at : at + 512]:
                    ends = np.cumsum([len(pool.ids[i]) for i in items])
                    row = np.full(seq_len, pad_id, dtype=kind)
                    row[: ends[-1]] = np.concatenate([pool.ids[i] for i in items])
                    out["row_id"].append(task + rows)
                    out["length"].append(int(ends[-1]))
                    out["ids"].append(row.tobytes())
                    out["cu"].append([0, *ends.tolist()])
                    out["resets"].append([0, *ends[:-1].tolist()])
                    out["docs"].append([pool.docs[i] for i in items])
                    out["starts"].append([pool.first[i] for i in items])
                    rows += 1
                types = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
                names = ("row_id", "length", "ids", "cu_seqlens", "position_resets", "doc_ids", "doc_starts")
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=names)

        pool = _Pool()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = encode(enc, text or "").astype(kind)
                    pool.add(doc, ids if end_id is None else np.append(ids, np.array(end_id, dtype=kind)), seq_len)
                    if pool.tokens >= pool_tokens:
                        yield from flush(pool)
                        pool = _Pool()
        if pool.ids:
            yield from flush(pool)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def positions(cu_seqlens: list[int], seq_len: int) -> np.ndarray:
    """Position of each slot: counts up from 0 in every segment; padding counts on as one segment."""
    cu = [*cu_seqlens, *([seq_len] if cu_seqlens[-1] < seq_len else [])]
    return np.concatenate([np.arange(b - a) for a, b in zip(cu, cu[1:], strict=False)])


def write_token_rows(rows: DataFrame, path: str) -> None:
    """Write packed rows as Parquet (binary id column) with Spark's committer, on any file system."""
    rows.write.mode("overwrite").parquet(path)


def read_id_matrix(path: str, seq_len: int, kind: str = "<u2") -> Iterator[np.ndarray]:
    """Id matrices (rows x ``seq_len``) of a local copy of what ``write_token_rows`` wrote, one for each row group."""
    import pyarrow.parquet as pq

    for name in sorted(glob.glob(os.path.join(path, "*.parquet"))):
        for g in range((f := pq.ParquetFile(name)).num_row_groups):
            ids = f.read_row_group(g, columns=["ids"]).column("ids").to_pylist()
            yield np.frombuffer(b"".join(ids), dtype=kind).reshape(-1, seq_len)


def op8_token_output(spark, sf_dir: str) -> DataFrame:
    return token_rows(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

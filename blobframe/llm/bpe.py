"""Byte-level BPE encoding and decoding with a two-tier lookup.

A minimal perfect hash over the vocabulary resolves pre-tokens that are tokens themselves; the others go through a heap of
candidate merges over linked bytes. Both tiers are behind a bounded memo per Python worker.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship
from .mph import MinimalPerfectHash

#: Pre-tokens in each of the two generations of a worker's memo; a full young one replaces the old one.
MEMO = 150_000


class Memo(dict):
    """Makes what it lacks; the maker decides what to keep."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        return self.make(key)


class Tokenizer:
    """Ranks and a splitting pattern, as a tiktoken rank file holds them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        by_id = {i: b for b, i in ranks.items()}
        self.table = [by_id.get(i) for i in range(max(by_id) + 1)]
        self.find = regex.compile(pattern).findall
        keys = list(ranks)
        self.mph = MinimalPerfectHash.build([xxhash.xxh64_intdigest(k, 0) for k in keys])
        slots = self.mph.slots(np.array([xxhash.xxh64_intdigest(k, 0) for k in keys], dtype=np.uint64))
        self.slot_key: list[bytes] = [b""] * len(keys)
        self.slot_id = [0] * len(keys)
        for s, k in zip(slots.tolist(), keys, strict=True):
            self.slot_key[s], self.slot_id[s] = k, ranks[k]
        self.memo = Memo(self.piece_ids)
        self.old: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> Tokenizer:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def whole(self, piece: bytes) -> int | None:
        """The id of a pre-token that is in the vocabulary."""
        s = self.mph.slot(xxhash.xxh64_intdigest(piece, 0))
        return self.slot_id[s] if self.slot_key[s] == piece else None

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Merges the lowest-ranked adjacent pair, leftmost first, until none is left."""
        n, get = len(piece), self.ranks.get
        # a candidate is one integer, rank | begin | end, so that the heap compares numbers
        sh = 20 if n < 1 << 20 else 40
        low, top, step = (1 << sh) - 1, 2 * sh, (1 << sh) + 1
        end = list(range(1, n + 1))  # end[i]: where the part that begins at i ends; 0 once it is swallowed
        before = list(range(-1, n - 1))
        at, heap = 2, []
        for i in range(n - 1):
            if (r := get(piece[i : i + 2])) is not None:
                heap.append(r << top | at)
            at += step
        heapify(heap)
        while heap:
            x = heappop(heap)
            i, stop = x >> sh & low, x & low
            mid = end[i]
            if not mid or mid >= stop or end[mid] != stop:
                continue
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                nxt = end[stop]
                if (r := get(piece[i:nxt])) is not None:
                    heappush(heap, r << top | i << sh | nxt)
            p = before[i]
            if p >= 0 and (r := get(piece[p:stop])) is not None:
                heappush(heap, r << top | p << sh | stop)
        out, i = [], 0
        while i < n:
            j = end[i]
            out.append(get(piece[i:j]))
            i = j
        return tuple(out)

    def piece_ids(self, piece: str) -> bytes:
        """Ids of one pre-token as 32-bit integers in bytes, the form in which they are remembered and joined."""
        ids = self.old.get(piece)
        if ids is None:
            raw = piece.encode("utf-8", "replace")
            one = self.whole(raw)
            ids = array("i", (one,) if one is not None else self.merge(raw)).tobytes()
        if len(piece) <= 64:
            self.memo[piece] = ids
        return ids

    def encode_bytes(self, text: str) -> bytes:
        if len(self.memo) >= MEMO:
            self.old, self.memo = self.memo, Memo(self.piece_ids)
        return b"".join(map(self.memo.__getitem__, self.find(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype=np.int32).tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))

    def decode_rows(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes of each row's ids, rows being the stretches between ends."""
        get = self.table.__getitem__
        return [b"".join(map(get, ids[s:e].tolist())) for s, e in zip(ends[:-1], ends[1:], strict=True)]


_loaded: dict[tuple[str, str], Tokenizer] = {}


def tokenizer(path: str, pattern: str) -> Tokenizer:
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Tokenizer.load(path, pattern)
    return _loaded[path, pattern]


def _slices(batch: pa.RecordBatch, column: str, limit: int = 1_000_000):
    """Row ranges of a batch of about `limit` characters, so that long rows do not pile up."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, n in enumerate(sizes):
        total += int(n)
        if total >= limit:
            yield batch.slice(at, i + 1 - at)
            at, total = i + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)


def _added(df: DataFrame, output: str, kind: T.DataType) -> tuple[list[str], T.StructType]:
    keep = [c for c in df.columns if c != output]
    return keep, T.StructType([*[df.schema[c] for c in keep], T.StructField(output, kind)])


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", output: str = "ids", decoded: str | None = None) -> DataFrame:
    """Adds `output` (array<int>): the ids of each row's whole text without special tokens, an empty array for a null or
    empty text. With a name in `decoded` the ids are decoded again in the same pass and that column (binary) holds their
    bytes. `path` is a rank file that every executor has. Rows are independent, so repeated rows, ties and empty tables need no
    rule; columns named like an output are replaced, others pass through."""
    ship(df.sparkSession)
    names = [output, decoded] if decoded else [output]
    keep = [c for c in df.columns if c not in names]
    kinds = [T.ArrayType(T.IntegerType(), False), T.BinaryType()]
    schema = T.StructType([*[df.schema[c] for c in keep], *[T.StructField(n, k) for n, k in zip(names, kinds, strict=False)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path, pattern)
        for whole in batches:
            for b in _slices(whole, text):
                rows = [tok.encode_bytes(t) if t else b"" for t in b.column(text).to_pylist()]
                ends = np.zeros(len(rows) + 1, dtype=np.int32)
                np.cumsum([len(r) // 4 for r in rows], out=ends[1:])
                flat = np.frombuffer(b"".join(rows), dtype=np.int32)
                out = [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                if decoded:
                    out.append(pa.array(tok.decode_rows(flat, ends), pa.binary()))
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *out], names=[*keep, *names])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", output: str = "decoded") -> DataFrame:
    """Adds `output` (binary): the bytes that each row's ids stand for, empty for null or no ids. An id outside the
    vocabulary is an error."""
    ship(df.sparkSession)
    keep, schema = _added(df, output, T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path, pattern)
        for b in batches:
            col = b.column(ids)
            out = tok.decode_rows(col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(out, pa.binary())], names=[*keep, output])

    return df.mapInArrow(run, schema)


def ids_text(ids):
    """Decimal ids joined by commas, as a column."""
    return F.concat_ws(",", F.col(ids).cast("array<string>"))

"""Token-id output: raw id payloads in shard files with a minimal perfect hash index per block.

File format. `<path>/blocks` is a Parquet table, one row per block of a shard:
  shard, block      place of the block; shards ascend by document key, blocks ascend within a shard
  base              ids of the shard before this block
  n_nulls, n_docs   documents with a null key (they come first), documents
  n_tokens, width   ids, bytes per id (2 or 4)
  lo, hi            least and greatest key
  payload           the ids of all documents, little-endian unsigned
  offsets           uint32[n_docs + 1], where each document's ids begin within the block
  keys              int64[n_docs - n_nulls], the keys in order
  seeds             uint32[], displacements of the minimal perfect hash over the distinct keys
  prints            uint32[distinct keys], fingerprint of the key in each slot
  firsts            uint32[distinct keys], ordinal of the first document of the key in each slot
`<path>/meta` holds the key boundaries of the shards, so that a key leads to its shard, block, slot and offset in constant time.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Memo, _slices
from .common import ship
from .mph import MinimalPerfectHash, _mix

#: A block ends with the document that brings it to so many ids or documents.
BLOCK_TOKENS, BLOCK_DOCS = 1_000_000, 8192
#: Chunks in each of the two generations of a worker's memo.
MEMO = 180_000
#: The character that stands for each byte in a byte-level vocabulary: itself if printable in Latin-1, else the next from 256.
_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_CHARS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_MARK_RUN = re.compile(r"[,.](?<=[^\w ].|_.) ")
# Fixed value: how the tokenizer file that the short way below is made for normalises and splits text.
_KNOWN = {
    "truncation": None,
    "padding": None,
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
_BLOCK = "shard int, block int, base long, n_nulls int, n_docs int, n_tokens long, width int, lo long, hi long, payload binary, offsets binary, keys binary, seeds binary, prints binary, firsts binary"


def _plain(text: str) -> str:
    """The text with line ends as blanks, and, where that cannot change its tokens, in lower case and with a blank before the
    commas and full stops that end a word: fewer kinds of chunks. It cannot if the text is composed (the tokenizer composes
    first), has no capital sigma (Python lowers that by its place) and no other mark stands before such a comma or stop."""
    text = text.replace("\n", " ")
    if "\u03a3" in text or not is_normalized("NFC", text) or _MARK_RUN.search(low := text.lower()):
        return text
    return low.replace(", ", " , ").replace(". ", " . ")


class ChunkEncoder:
    """Ids of texts as raw bytes. Where the tokenizer file normalises and splits text in the known way, texts are cut at blanks and
    line ends, where its own splitting cuts as well (it drops all white space and never reads across it), and a chunk is encoded
    once and remembered. With any other file, and where special tokens' strings are special, the library encodes whole texts."""

    def __init__(self, path: str, special_as_text: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_as_text
        self.width = 2 if self.tok.get_vocab_size(with_added_tokens=True) <= 65536 else 4
        self.dtype, self.code = np.dtype(f"<u{self.width}"), "H" if self.width == 2 else "I"
        self.model = self.tok.model
        file = json.loads(self.tok.to_str())
        self.known = special_as_text and all(file.get(k) == v for k, v in _KNOWN.items()) and not file["model"].get("dropout") and all(t["special"] for t in file["added_tokens"])
        self.old: dict[str, bytes] = {}
        self.memo = Memo(self.learn)

    def learn(self, chunk: str) -> bytes:
        """A run of letters with sentence marks behind it is one word and one run of marks to the tokenizer, so these go
        straight to its merge model; every other chunk takes the whole path."""
        out = self.old.get(chunk)
        if out is None:
            low = chunk.lower()
            word = low if low.isalpha() else low.rstrip(",.;:!?")
            if word.isalpha() and (word.isascii() or "\u03a3" not in chunk and is_normalized("NFC", chunk)):
                out = self.merged(word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_CHARS))
                if word is not low and len(word) < len(low):
                    out += self.merged(low[len(word) :])
            else:
                out = array(self.code, self.tok.encode(chunk, add_special_tokens=False).ids).tobytes() if chunk else b""
        if len(chunk) <= 64:
            self.memo[chunk] = out
        return out

    def merged(self, word: str) -> bytes:
        return array(self.code, [t.id for t in self.model.tokenize(word)]).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.known:
            return [array(self.code, self.tok.encode(t, add_special_tokens=False).ids).tobytes() if t else b"" for t in texts]
        if len(self.memo) > MEMO:
            self.old, self.memo = self.memo, Memo(self.learn)
        get = self.memo.__getitem__
        return [b"".join(map(get, _plain(t).split(" "))) if t else b"" for t in texts]


_encoders: dict[tuple[str, bool], ChunkEncoder] = {}


def _encoder(path: str, special_as_text: bool) -> ChunkEncoder:
    if (path, special_as_text) not in _encoders:
        _encoders[path, special_as_text] = ChunkEncoder(path, special_as_text)
    return _encoders[path, special_as_text]


def _shard(key: str, bounds: list[int], salt: Column) -> Column:
    """Bounds below the key; a key that is a bound several times is dealt over as many shards."""
    if not bounds:
        return F.lit(0)
    all_of = F.array(*[F.lit(b).cast("long") for b in bounds])
    below = F.size(F.filter(all_of, lambda b: b < F.col(key)))
    same = F.size(F.filter(all_of, lambda b: b == F.col(key)))
    return F.when(F.col(key).isNull(), 0).otherwise(below + F.pmod(salt, F.greatest(same, F.lit(1))).cast("int"))


def _key_hashes(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(keys.astype(np.int64).view(np.uint64), 7)


def write(
    df: DataFrame, path: str, vocabulary: str, key: str = "doc_id", text: str = "text", end_id: int = 1, shards: int | None = None, special_as_text: bool = True
) -> None:
    """Encodes each row's whole text (null: empty) with the tokenizers library, appends end_id and writes the ids to `path` in
    ascending order of `key`. Rows with a null key come first; rows with equal keys are all kept, next to each other, in an
    order by content. Special tokens' strings in a text are ordinary text unless special_as_text is False. Other columns are
    ignored; an empty table gives an empty file set."""
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = [(i + 1) / n for i in range(n - 1)]
    bounds = (rows.agg(F.percentile_approx("key", cuts, 10_000)).first()[0] if cuts else None) or []
    width = _encoder(vocabulary, special_as_text).width

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(vocabulary, special_as_text)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        for whole in batches:
            for b in _slices(whole, "text", 1_000_000):
                out = [p + end for p in enc.encode(b.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(out, pa.binary())], names=["key", "payload"])

    ids = rows.mapInArrow(encoded, "key long, payload binary")
    placed = ids.withColumn("shard", _shard("key", bounds, F.xxhash64("payload"))).repartition(n, "shard").sortWithinPartitions("key", "shard", "payload")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, base, keys, parts, total = None, 0, 0, [], [], 0
        for b in batches:
            for k, p, s in zip(b.column("key").to_pylist(), b.column("payload"), b.column("shard").to_pylist(), strict=True):
                if parts and (s != shard or total >= BLOCK_TOKENS * width or len(parts) >= BLOCK_DOCS):
                    yield _pack(shard, block, base, keys, parts, width)
                    base, block = (base + total // width, block + 1) if s == shard else (0, 0)
                    keys, parts, total = [], [], 0
                shard = s
                keys.append(k)
                parts.append(p.as_py())
                total += len(parts[-1])
        if parts:
            yield _pack(shard, block, base, keys, parts, width)

    placed.select("key", "payload", "shard").mapInArrow(packed, _BLOCK).write.parquet(f"{path}/blocks")
    spark.createDataFrame([(bounds, end_id, width)], "bounds array<long>, end_id int, width int").coalesce(1).write.parquet(f"{path}/meta")


def _pack(shard: int, block: int, base: int, keys: list, parts: list[bytes], width: int) -> pa.RecordBatch:
    nulls = sum(k is None for k in keys)
    real = np.array(keys[nulls:], dtype=np.int64)
    ends = np.zeros(len(parts) + 1, dtype=np.uint32)
    np.cumsum([len(p) // width for p in parts], out=ends[1:])
    distinct, first = np.unique(real, return_index=True)
    h = _key_hashes(distinct)
    mph = MinimalPerfectHash.build(h)
    prints, firsts = np.zeros(len(h), dtype=np.uint32), np.zeros(len(h), dtype=np.uint32)
    if len(h):
        slots = mph.slots(h)
        prints[slots] = (h >> np.uint64(32)).astype(np.uint32)
        firsts[slots] = first + nulls
    lo, hi = (int(real[0]), int(real[-1])) if len(real) else (None, None)
    row = [shard, block, base, nulls, len(parts), int(ends[-1]), width, lo, hi, b"".join(parts), ends.tobytes(), real.tobytes(), mph.seeds.tobytes(), prints.tobytes(), firsts.tobytes()]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 6]
    names = [f.split()[0] for f in _BLOCK.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=names)


class Block:
    """One block, opened for keyed access."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["payload"], dtype=f"<u{row['width']}")
        self.offsets = np.frombuffer(row["offsets"], dtype=np.uint32)
        self.keys = np.frombuffer(row["keys"], dtype=np.int64)
        self.prints = np.frombuffer(row["prints"], dtype=np.uint32)
        self.firsts = np.frombuffer(row["firsts"], dtype=np.uint32)
        self.mph = MinimalPerfectHash(len(self.prints), np.frombuffer(row["seeds"], dtype=np.uint32))
        self.nulls, self.base = row["n_nulls"], row["base"]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Ordinal of each key's first document, -1 where the block has no such key."""
        if not len(self.prints) or not len(keys):
            return np.full(len(keys), -1, dtype=np.int64)
        h = _key_hashes(np.asarray(keys))
        s = self.mph.slots(h)
        at = self.firsts[s].astype(np.int64)
        hit = (self.prints[s] == (h >> np.uint64(32)).astype(np.uint32)) & (self.keys[at - self.nulls] == keys)
        return np.where(hit, at, -1)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.offsets[i] : self.offsets[i + 1]]


def read(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """One row per document of the files: key, shard, at (its first id's place within the shard), start (ids of all documents
    before it), n_tokens and ids_crc32. Each keyed document is reached through the block's index."""
    ship(spark)
    blocks = spark.read.parquet(f"{path}/blocks")

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {n: b.column(n)[i].as_py() for n in b.schema.names}
                k = Block(row)
                n = row["n_docs"]
                # the first document of a key comes from the index, its repeats follow it
                real = k.find(k.keys)
                if len(real):
                    assert (real >= 0).all(), "a key is missing from its index"
                    new = np.concatenate([[True], k.keys[1:] != k.keys[:-1]])
                    run = np.arange(len(real)) - np.maximum.accumulate(np.where(new, np.arange(len(real)), 0))
                    real = real + run
                order = np.concatenate([np.arange(k.nulls), real]).astype(np.int64)
                size = (k.offsets[order + 1] - k.offsets[order]).astype(np.int64)
                crc = [zlib.crc32(k.document(j).astype("<u4").tobytes()) for j in order.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None] * k.nulls + k.keys.tolist(), pa.int64()), pa.array(np.full(n, row["shard"], dtype=np.int32)), pa.array(k.base + k.offsets[order].astype(np.int64)), pa.array(size), pa.array(crc, pa.int64())],
                    names=[key, "shard", "at", "n_tokens", "ids_crc32"],
                )

    docs = blocks.mapInArrow(opened, f"`{key}` long, shard int, at long, n_tokens long, ids_crc32 long")
    # as many rows as shards, a number that is set and does not follow the data
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("t"))
    totals = totals.selectExpr("shard", "coalesce(sum(t) over (order by shard rows between unbounded preceding and 1 preceding), 0) as before")
    return docs.join(F.broadcast(totals), "shard").select(key, "shard", "at", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def lookup(keys: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """The ids of each distinct non-null key of `keys` that is in the files at `path`: key and ids (array<long>), a row for
    each document of the key. A key leads to its shards by the boundaries and to its block by the block's range."""
    spark = keys.sparkSession
    ship(spark)
    blocks = spark.read.parquet(f"{path}/blocks")
    bounds = spark.read.parquet(f"{path}/meta").first()["bounds"]
    want = keys.select(F.col(key).cast("long").alias("key")).where("key is not null").distinct()
    if bounds:
        all_of = F.array(*[F.lit(b).cast("long") for b in bounds])
        low = F.size(F.filter(all_of, lambda b: b < F.col("key")))
        high = F.size(F.filter(all_of, lambda b: b <= F.col("key")))
        want = want.withColumn("shard", F.explode(F.sequence(low, high)))
    else:
        want = want.withColumn("shard", F.lit(0))
    at = blocks.select("shard", "block", "lo", "hi")
    asked = want.join(at, "shard").where("key between lo and hi").groupBy("shard", "block").agg(F.collect_list("key").alias("asked"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {n: b.column(n)[i].as_py() for n in b.schema.names}
                k, out = Block(row), []
                ask = np.array(row["asked"], dtype=np.int64)
                for q, j in zip(ask.tolist(), k.find(ask).tolist(), strict=True):
                    while 0 <= j < row["n_docs"] and k.keys[j - k.nulls] == q:
                        out.append((q, k.document(j).tolist()))
                        j += 1
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.list_(pa.int64()))], names=[key, "ids"])

    return blocks.join(asked, ["shard", "block"]).mapInArrow(fetch, f"`{key}` long, ids array<long>")

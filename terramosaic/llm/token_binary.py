"""Token ids in bit-plane shuffled binary shards.

A shard holds the ids of consecutive documents. Ids are cut into blocks of
``BLOCK`` ids; a block is transposed into planes (bit planes: bit k of every
id; byte planes: byte k of every id), and each plane is compressed with
zstandard on its own, which turns the unused high planes into a few bytes. The
chunk index at the end names every block's place, length and id count, so a
reader can fetch a range of ids without reading the rest.

    "TMBP0001" | planes of block 0 | planes of block 1 | ... | index (JSON, zstandard) | index length u64 | "TMBP0001"

Document ids, validity and lengths are further blocks of the same form.
Shards are written under the shared folder by a unique name and listed in a
manifest that Spark commits; a task that ran twice leaves a file that no
manifest names.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from terramosaic.llm.common import shared_path, text_bytes, written

MAGIC = b"TMBP0001"
#: Ids in a block.
BLOCK = 1 << 16
#: A shard is closed once it holds so many ids.
SHARD_IDS = 4 << 20
#: Text bytes that one encoding task takes.
TASK_BYTES = 48 << 20
END_ID = 2
#: Memo entries before the memo is emptied, and the longest word it keeps.
MEMO, MEMO_LEN = 500_000, 64


def default_vocab() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def to_planes(values: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block of little-endian unsigned integers."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize)
    if kind == "byte":
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(raw.shape[1])]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(bits.shape[1])]


def from_planes(planes: list[bytes], n: int, dtype: str, kind: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    if kind == "byte":
        raw = np.stack([np.frombuffer(p, np.uint8, n) for p in planes], axis=1) if n else np.zeros((0, size), np.uint8)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).reshape(-1).view(dtype)


class ShardWriter:
    def __init__(self, filesystem: pafs.FileSystem, folder: str, kind: str, level: int):
        self.fs, self.kind = filesystem, kind
        self.path = f"{folder}/{uuid.uuid4().hex}.tmbp"
        self.out = filesystem.open_output_stream(self.path)
        self.zip = zstandard.ZstdCompressor(level=level)
        self.out.write(MAGIC)
        self.at, self.blocks, self.pending, self.n_pending, self.n_ids = len(MAGIC), [], [], 0, 0
        self.doc_ids, self.valid, self.lengths = [], [], []

    def block(self, role: str, values: np.ndarray) -> None:
        planes = [self.zip.compress(p) for p in to_planes(values, self.kind)]
        self.blocks.append({"role": role, "at": self.at, "n": len(values), "dtype": values.dtype.str, "planes": [len(p) for p in planes]})
        for p in planes:
            self.out.write(p)
            self.at += len(p)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id or 0)
        self.valid.append(doc_id is not None)
        self.lengths.append(len(ids))
        self.pending.append(ids)
        self.n_pending += len(ids)
        self.n_ids += len(ids)
        if self.n_pending >= BLOCK:
            flat = np.concatenate(self.pending)
            full = len(flat) // BLOCK * BLOCK
            for i in range(0, full, BLOCK):
                self.block("ids", flat[i : i + BLOCK])
            self.pending, self.n_pending = [flat[full:]], len(flat) - full

    def close(self) -> None:
        if self.n_pending:
            self.block("ids", np.concatenate(self.pending))
        self.block("doc_id", np.array(self.doc_ids, "<i8"))
        self.block("valid", np.array(self.valid, "<u1"))
        self.block("length", np.array(self.lengths, "<u8"))
        index = self.zip.compress(json.dumps({"kind": self.kind, "blocks": self.blocks}).encode())
        self.out.write(index + struct.pack("<Q", len(index)) + MAGIC)
        self.out.close()


class ShardReader:
    def __init__(self, filesystem: pafs.FileSystem, path: str):
        self.file = filesystem.open_input_file(path)
        size, self.unzip = self.file.size(), zstandard.ZstdDecompressor()
        tail = self.file.read_at(16, size - 16)
        (length,) = struct.unpack("<Q", tail[:8])
        if tail[8:] != MAGIC or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"not a token shard: {path}")
        index = json.loads(self.unzip.decompress(self.file.read_at(length, size - 16 - length)))
        self.kind, self.blocks = index["kind"], index["blocks"]

    def load(self, block: dict) -> np.ndarray:
        raw, at, planes = self.file.read_at(sum(block["planes"]), block["at"]), 0, []
        for length in block["planes"]:
            planes.append(self.unzip.decompress(raw[at : at + length]))
            at += length
        return from_planes(planes, block["n"], block["dtype"], self.kind)

    def role(self, name: str) -> np.ndarray:
        return np.concatenate([self.load(b) for b in self.blocks if b["role"] == name])

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) in the order written; holds one document and one block at a time."""
        blocks = (b for b in self.blocks if b["role"] == "ids")
        held, have = [], 0
        for doc_id, valid, length in zip(self.role("doc_id").tolist(), self.role("valid").tolist(), self.role("length").tolist(), strict=True):
            while have < length:
                held.append(self.load(next(blocks)))
                have += len(held[-1])
            flat = np.concatenate(held) if len(held) != 1 else held[0]
            yield (doc_id if valid else None), flat[:length]
            held, have = [flat[length:]], have - length


class WordEncoder:
    """The tokenizers library over whole texts, with bounded memos.

    The tokenizer drops white space and never merges across it, so the ids of a
    text are those of its space-separated words in order. A word of Latin-1
    letters with at most one mark behind it is one or two pre-tokens that
    normalising only lower-cases; these go straight to the library's BPE model.
    Any other word goes through the library's whole pipeline, which also reads
    special tokens that stand in the text (no special token holds a space).
    """

    SIMPLE = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]?)").fullmatch

    def __init__(self, vocab: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocab)
        self.model = self.tokenizer.model
        self.memo: dict[str, bytes] = {}
        self.letters: dict[str, bytes] = {}
        # The byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from 256 on.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.alphabet = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in own)}

    def pipeline(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def pre_token(self, text: str) -> bytes:
        ids = self.letters.get(text)
        if ids is None:
            shown = text if text.isascii() else text.encode().decode("latin-1").translate(self.alphabet)
            ids = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
            if len(text) <= MEMO_LEN:
                if len(self.letters) >= MEMO:
                    self.letters.clear()
                self.letters[text] = ids
        return ids

    def learn(self, words: set[str]) -> None:
        other = []
        for word in words:
            simple = self.SIMPLE(word)
            if simple:
                letters, mark = simple.groups()
                self.memo[word] = self.pre_token(letters.lower()) + (self.pre_token(mark) if mark else b"")
            else:
                other.append(word)
        for i in range(0, len(other), 4096):
            part = other[i : i + 4096]
            self.memo.update(zip(part, self.pipeline(part), strict=True))

    def texts(self, texts: list[str]) -> Iterator[bytes]:
        memo = self.memo
        for text in texts:
            words = text.replace("\n", " ").split(" ")
            found = list(map(memo.get, words))
            if None in found:
                if len(memo) >= MEMO:
                    memo.clear()
                    missing = set(words)
                else:
                    missing = {w for w, ids in zip(words, found, strict=True) if ids is None}
                self.learn(missing)
                found = list(map(memo.__getitem__, words))
                for word in missing:
                    if len(word) > MEMO_LEN:
                        del memo[word]
            yield b"".join(found)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(vocab: str) -> WordEncoder:
    if vocab not in _ENCODERS:
        _ENCODERS[vocab] = WordEncoder(vocab)
    return _ENCODERS[vocab]


def write_tokens(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None, end_id: int = END_ID, kind: str = "byte", level: int = 3) -> DataFrame:
    """Encode and write shards in ascending id order; returns the manifest.

    Manifest: part, shard, path, n_docs, n_tokens. Rows are range-partitioned by
    (id, hash of the text), so that even one id that holds a third of all rows
    is spread; equal ids keep that order, and a null id comes first. Null text
    counts as empty, so it yields the end id alone. Extra columns are not read.
    """
    spark, vocab = docs.sparkSession, vocab or default_vocab()
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes(docs, text_col) // TASK_BYTES))
    ordered = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_tie"))
    ordered = ordered.repartitionByRange(parts, "_id", "_tie").sortWithinPartitions("_id", "_tie").withColumn("_part", F.spark_partition_id())

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = pafs.FileSystem.from_uri(folder)
        filesystem.create_dir(root, recursive=True)
        words, end = encoder(vocab), np.array([end_id], "<u4").tobytes()
        out, part, rows = None, 0, []

        def close() -> None:
            out.close()
            rows.append((part, len(rows), out.path.removeprefix(root), len(out.lengths), out.n_ids))

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                part = piece.column(3)[0].as_py()
                texts = [t or "" for t in piece.column(1).to_pylist()]
                for doc_id, ids in zip(piece.column(0).to_pylist(), words.texts(texts), strict=True):
                    out = out or ShardWriter(filesystem, root, kind, level)
                    out.add(doc_id, np.frombuffer(ids + end, "<u4"))
                    if out.n_ids >= SHARD_IDS:
                        close()
                        out = None
        if out is not None:
            close()
        names, types = ("part", "shard", "path", "n_docs", "n_tokens"), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], list(names))

    return written(ordered.mapInArrow(shards, "part int, shard int, path string, n_docs bigint, n_tokens bigint"), "token-manifest")


def read_tokens(manifest: DataFrame, folder: str, keep_ids: bool = True) -> DataFrame:
    """Read shards back: doc_id, start, n_tokens, ids_crc32 (and ids), each shard by its own task.

    ``start`` counts the ids of all documents before. The prefix sums run over
    one row a shard, in two levels.
    """
    totals = manifest.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    base = totals.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_base"))
    own = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")
    spark = manifest.sparkSession
    shards = manifest.withColumn("_own", own).join(base, "part").select((F.col("_base") + F.col("_own")).alias("start"), "path")
    shards = shards.repartition(max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for start, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found: list[tuple] = []
                for doc_id, ids in ShardReader(filesystem, root + path).documents():
                    found.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), ids.astype(np.int32) if keep_ids else None))
                    start += len(ids)
                    if len(found) == 2000:
                        yield packed(found)
                        found = []
                yield packed(found)

    def packed(found: list[tuple]) -> pa.RecordBatch:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        out = [pa.array([r[k] for r in found], pa.int64()) for k in range(4)]
        if keep_ids:
            names, out = [*names, "ids"], [*out, pa.array([r[4] for r in found], pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(out, names)

    return shards.mapInArrow(rows, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids)


def tokens_round_trip(spark: SparkSession, docs: DataFrame, keep_ids: bool = False, **options) -> DataFrame:
    """Write all documents to shards in the shared folder and return what reading them gives."""
    folder = shared_path(spark, "tokens")
    return read_tokens(write_tokens(docs, folder, **options), folder, keep_ids)

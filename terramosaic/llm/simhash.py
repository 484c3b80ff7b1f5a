"""SimHash near-duplicates found with Golay-code fuzzy hashing.

A fingerprint is 64 bits over three-word shingles. Fingerprints link at two or
fewer differing bits. To find all links without comparing all pairs, the 64
bits are cut into segments of 23, 23 and 18 bits. The Golay code puts every 23
bits within distance 3 of exactly one codeword, so a segment that differs in at
most one bit from another lies within distance 4 of that one's codeword: a
fingerprint is stored under its own codeword index and looked up under the
indices of all codewords within distance 4 (about five).

Pigeonhole: two errors in three segments leave one segment exact, and with the
pairs (0 exact, 1 near), (1 exact, 2 near), (2 exact, 0 near) every placing of
up to two errors is met by one of them. A key is the pair, the exact segment
and the near segment's codeword index. Keys are joined and candidates verified
on the whole fingerprints.

Only distinct fingerprints are joined: copies share one, so a large group of
copies is one row there. Components are found by alternating star operations
on the links; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terramosaic.llm.common import doc_chunks, remove_written, utf8, written
from terramosaic.llm.words import space_words

SHINGLE = 3
SEED = 42
MAX_DISTANCE = 2
#: Fingerprints stored under one key in one task.
CROWDED = 2000
#: Segments as (lowest bit, bits), and the pairs (exact, near).
SEGMENTS = ((0, 23), (23, 23), (46, 18))
PAIRS = ((0, 1), (1, 2), (2, 0))
#: Fixed value: generator polynomial of the binary Golay code of length 23.
GOLAY = 0b101011100011


def shingle_hashes(raw: bytes, size: int = SHINGLE, seed: int = SEED) -> list[int]:
    """XXH64 of each shingle, repeats included; the whole sequence if it is shorter."""
    own = space_words(raw)
    if not own:
        return []
    if len(own) < size:
        return [xxhash.xxh64_intdigest(b" ".join(own), seed)]
    return list(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(own[k:] for k in range(size)), strict=False)), repeat(seed)))


def majority(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One 64-bit fingerprint a segment: a bit is set if over half of the hashes have it; 0 for none."""
    n = len(offsets) - 1
    sums = np.zeros((n, 64), np.int64)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums[full] = np.add.reduceat(bits, offsets[:-1][full], axis=0, dtype=np.int64)
    set_bits = (2 * sums > np.diff(offsets)[:, None]).astype(np.uint8)
    return np.packbits(set_bits, axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp as signed long) for each row, over its whole text."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            out = np.zeros(batch.num_rows, np.uint64)
            for a, b in doc_chunks(offsets, 1 << 20):
                own = [shingle_hashes(raw[offsets[k] : offsets[k + 1]].tobytes()) for k in range(a, b)]
                flat = np.fromiter((h for hashes in own for h in hashes), np.uint64, sum(map(len, own)))
                out[a:b] = majority(flat, np.cumsum([0, *map(len, own)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], [id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(rows, f"`{id_col}` {id_type}, fp bigint")


@cache
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of all 12 high-bit values, the coset leader a syndrome, and all patterns of weight <= 4 by syndrome."""

    def remainder(x: int) -> int:
        for bit in range(22, 10, -1):
            if x >> bit & 1:
                x ^= GOLAY << (bit - 11)
        return x

    high = np.array([remainder(h << 11) for h in range(1 << 12)], np.int64)
    patterns = np.array([sum(1 << b for b in bits) for w in range(5) for bits in combinations(range(23), w)], np.int64)
    syndrome = high[patterns >> 11] ^ (patterns & 2047)
    leader = np.zeros(2048, np.int64)
    leader[syndrome[:2048]] = patterns[:2048]  # weight <= 3: one for each syndrome
    order = np.argsort(syndrome, kind="stable")
    return high, leader, patterns[order], np.searchsorted(syndrome[order], np.arange(2049))


def nearest_index(words: np.ndarray) -> np.ndarray:
    """Index (the 12 high bits) of the codeword within distance 3."""
    high, leader, _, _ = golay_tables()
    return (words ^ leader[high[words >> 11] ^ (words & 2047)]) >> 11


def near_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of every codeword within distance 4."""
    high, _, patterns, first = golay_tables()
    syndrome = high[words >> 11] ^ (words & 2047)
    counts = first[syndrome + 1] - first[syndrome]
    row = np.repeat(np.arange(len(words)), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first[syndrome], counts)
    return row, (words[row] ^ patterns[at]) >> 11


def fuzzy_keys(fps: np.ndarray, near: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) under which fingerprints are stored (near False) or looked up (near True)."""
    unsigned = fps.view(np.uint64)
    parts = [((unsigned >> np.uint64(low)) & np.uint64((1 << n) - 1)).astype(np.int64) for low, n in SEGMENTS]
    rows, keys = [], []
    for k, (exact, fuzzy) in enumerate(PAIRS):
        row, index = near_indices(parts[fuzzy]) if near else (np.arange(len(fps)), nearest_index(parts[fuzzy]))
        rows.append(row)
        keys.append((k << 35) | (parts[exact][row] << 12) | index)
    return np.concatenate(rows), np.concatenate(keys)


def fuzzy_pairs(distinct: DataFrame) -> DataFrame:
    """All pairs (a < b) of distinct fingerprints (column fp) at MAX_DISTANCE or fewer differing bits.

    Fingerprints of templated texts can crowd under one key. The stored side of
    a key with more than CROWDED fingerprints is dealt to several parts, and what
    is looked up goes to each of them, so no task holds a crowded key alone.
    """

    def keyed(near: bool):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                row, key = fuzzy_keys(fps, near)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row])], ["key", "b" if near else "a"])

        return rows

    stored = distinct.mapInArrow(keyed(False), "key bigint, a bigint")
    looked_up = distinct.mapInArrow(keyed(True), "key bigint, b bigint")
    crowded = stored.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED).select("key", F.ceil(F.col("n") / CROWDED).cast("int").alias("parts"))
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_DISTANCE)
    crowded = written(crowded, "crowded")
    if crowded.limit(1).count() == 0:
        return stored.join(looked_up, "key").where(close).select("a", "b").distinct()
    stored = stored.join(crowded, "key", "left").withColumn("part", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int"))
    looked_up = looked_up.join(crowded, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    return stored.drop("parts").join(looked_up.drop("parts"), ["key", "part"]).where(close).select("a", "b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the smallest node it reaches.

    Alternating large-star and small-star rounds; each shrinks the distance to
    the root and only keeps minima, so a node with very many links is an
    aggregate, never a collected list. Each round is written, which cuts lineage,
    and the round before is deleted.
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b"), "edges")
    before = mark(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        oriented = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = oriented.groupBy("a").agg(F.min("b").alias("m"))
        small = oriented.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        done, edges = edges, written(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        remove_written(done)
        after = mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for each row.

    component_id is the smallest id reachable over links, the row's own
    included. Null, empty and blank texts have fingerprint zero and are linked
    like any other. Repeated rows stay and share a component; null ids are never
    a component's smallest unless it has no other. Other columns are not read.
    """
    fps = written(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = fps.groupBy("fp").agg(F.min(id_col).alias("smallest"))
    roots = components(fuzzy_pairs(classes.select("fp")))
    linked = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "smallest", F.coalesce("root", "fp").alias("root"))
    named = linked.join(linked.groupBy("root").agg(F.min("smallest").alias("component_id")), "root").select("fp", "component_id")
    return fps.join(named, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

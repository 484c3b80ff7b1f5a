"""SimHash near-dedup at a similarity threshold: Golay-code keys propose pairs, an exact filter completes them.

Two documents are linked if their sets of five-word shingles have a Jaccard
similarity of at least 0.8. Such documents are mostly 3 to 10 bits apart in a
64-bit SimHash, more than segments of a Golay code can bridge, so the fuzzy
keys alone cannot give right results. Pairs are therefore proposed in two ways
and all of them verified on the shingles:

* the fuzzy keys of ``simhash`` over fingerprints of the same shingles, which
  bring together copies and nearly equal texts;
* a prefix filter that loses no pair: in one global order of shingles, similar
  sets share one of their first ``n - ceil(threshold * n) + 1``. The order puts
  shingles that stand in many documents last; it decides the work, never the
  result. Behind a common shingle enough must remain on both sides.

Before two texts are brought together, sketches bound what they can share: a
document's shingles are counted by a hash into SLOTS slots, and the overlap of
two sets is at most the sum of the smaller counts. The bound is exact, so
nothing is lost, and most pairs that share a passage only are dropped by it.

A large group of near copies would have a square of pairs. First each document
is paired with one other holder of each of its prefix shingles only (stars), and
what is similar is merged to components; this is done again while it pays, and
then pairs across components are tried. Pairs within a component need no try,
so the components are those of all similar pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terramosaic.llm.common import remove_written, tidy, utf8, written
from terramosaic.llm.simhash import components, fuzzy_pairs, majority, shingle_hashes
from terramosaic.llm.words import space_words

SHINGLE = 5
THRESHOLD = 0.8
#: The most shingles that the order names, and shingles counted together before those that stand once are forgotten.
MOST_COMMON, COUNTED = 400_000, 4 << 20
#: Slots of a sketch, and of one of a set of LARGE shingles or more.
SLOTS, MORE_SLOTS, LARGE = 64, 512, 1000
#: The most rounds of stars before all pairs across components are tried, and stars a key in later rounds; decides the work, never the result.
MOST_STARS, CENTRES = 4, 8
#: Bits of the map of nodes whose texts are read again for verifying.
MAP_BITS = 24


def node(text_col: str) -> Column:
    """Equal texts are one node; texts without a word are one as well."""
    return F.when(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(text_col)).otherwise(F.lit(0).cast("bigint"))


def shingles(raw: bytes, size: int = SHINGLE) -> frozenset[bytes]:
    """Distinct runs of ``size`` words; the whole sequence if it is shorter."""
    own = space_words(raw)
    if 0 < len(own) < size:
        return frozenset([b" ".join(own)])
    return frozenset(map(b" ".join, zip(*(own[k:] for k in range(size)), strict=False)))


def first_rows(batch: pa.RecordBatch) -> np.ndarray:
    """The first row of each node in a batch, so that copies in it are read once."""
    return np.sort(np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_index=True)[1])


class Together:
    """Counts the shingles of texts that are read together, in one array of fixed size unless a text alone is larger."""

    def __init__(self, most: int = COUNTED):
        self.own, self.n = np.empty(most, np.uint64), 0

    def full(self, more: int) -> bool:
        return self.n + more > len(self.own)

    def add(self, own: np.ndarray) -> None:
        """The distinct shingles of one text."""
        if self.full(len(own)):
            self.own = np.concatenate([self.own[: self.n], own])
        else:
            self.own[self.n : self.n + len(own)] = own
        self.n += len(own)

    def common(self) -> tuple[np.ndarray, np.ndarray]:
        """(shingles, counts) of those in several texts; all are forgotten."""
        found = self.own[: self.n]
        found.sort()
        again = found[1:] == found[:-1]
        heads = np.flatnonzero(again & ~np.concatenate([[False], again[:-1]])) if self.n > 1 else np.zeros(0, np.int64)
        out = found[heads], np.searchsorted(found, found[heads], "right") - heads
        self.n = 0
        return out


def surveyed(texts: DataFrame, size: int) -> DataFrame:
    """(kind, x, y): kind 0 a node and its fingerprint, kind 1 a shingle and in how many texts read together it stands, if in several."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        together = Together()

        def packed(kind: int, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int32)), pa.array(x), pa.array(y)], ["kind", "x", "y"])

        def common() -> pa.RecordBatch:
            found, n = together.common()
            return packed(1, found.view(np.int64), n.astype(np.int64))

        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            own_rows = first_rows(batch)
            prints = np.zeros(len(own_rows), np.uint64)
            for k, row in enumerate(own_rows.tolist()):
                own = np.array(shingle_hashes(raw[offsets[row] : offsets[row + 1]].tobytes(), size), np.uint64)
                prints[k] = majority(own, np.array([0, len(own)]))[0]
                own = np.unique(own)
                if together.full(len(own)):
                    yield common()
                together.add(own)
            yield packed(0, batch.column(0).to_numpy(zero_copy_only=False)[own_rows].astype(np.int64), prints.view(np.int64))
        yield common()

    return texts.select("node", "text").mapInArrow(tidy(rows), "kind int, x bigint, y bigint")


def common_shingles(survey: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of the shingles that stand in the most texts, over all documents; at most MOST_COMMON."""
    counts = survey.where("kind = 1").groupBy(F.col("x").alias("h")).agg(F.sum("y").alias("n")).where("n > 2")
    found = counts.orderBy(F.desc("n"), "h").limit(MOST_COMMON).toArrow()
    h, n = found["h"].to_numpy().astype(np.int64).view(np.uint64), found["n"].to_numpy().astype(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def sketch(own: np.ndarray) -> bytes:
    """Shingles by slot, as 16-bit counts that stop at their largest value (no bound is drawn from such a slot)."""
    slots = SLOTS if len(own) < LARGE else MORE_SLOTS
    return np.minimum(np.bincount((own >> np.uint64(20)).astype(np.int64) & (slots - 1), minlength=slots), 65535).astype("<u2").tobytes()


def most_shared(a: bytes, b: bytes) -> int:
    """A bound on the overlap of two sets, from their sketches."""
    x, y = np.frombuffer(a, "<u2").astype(np.int64), np.frombuffer(b, "<u2").astype(np.int64)
    if (x == 65535).any() or (y == 65535).any():
        return 1 << 60
    if len(x) > len(y):
        x = x.reshape(-1, len(y)).sum(axis=0)
    elif len(y) > len(x):
        y = y.reshape(-1, len(x)).sum(axis=0)
    return int(np.minimum(x, y).sum())


def prefixes(texts: DataFrame, common: tuple[np.ndarray, np.ndarray], size: int, threshold: float) -> DataFrame:
    """(node, n, sketch, keys): the number of distinct shingles, a sketch, and the first shingles in the global order."""
    shared = texts.sparkSession.sparkContext.broadcast(common)  # at most MOST_COMMON entries

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = shared.value
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            own_rows = first_rows(batch)
            sizes, keys, sketches = [], [], []
            for row in own_rows.tolist():
                own = np.unique(np.array(shingle_hashes(raw[offsets[row] : offsets[row + 1]].tobytes(), size), np.uint64))
                sketches.append(sketch(own))
                if len(own) and len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    own = own[np.argsort(np.where(known[at] == own, counts[at], 0), kind="stable")]
                sizes.append(len(own))
                keys.append(own[: len(own) - ceil(threshold * len(own) - 1e-9) + 1].view(np.int64))
            flat = pa.array(np.concatenate([*keys, np.zeros(0, np.int64)]))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own_rows)), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), lists], ["node", "n", "sketch", "keys"])

    return texts.select("node", "text").mapInArrow(tidy(rows), "node bigint, n int, sketch binary, keys array<bigint>")


def possible(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow the threshold."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3))
            best = np.array([most_shared(x.as_py(), y.as_py()) for x, y in zip(batch.column(4), batch.column(5), strict=True)], np.int64)
            yield batch.select([0, 1]).filter(pa.array(best * (1 + threshold) >= threshold * (n + m) - 1e-6, pa.bool_()))

    x = sets.select(F.col("node").alias("a"), "n", F.col("sketch").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("y"))
    both = pairs.join(x, "a").join(y, "b").where(F.least("n", "m") >= threshold * F.greatest("n", "m") - 1e-6)
    return both.select("a", "b", "n", "m", "x", "y").mapInArrow(tidy(rows), "a bigint, b bigint")


def texts_of(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the nodes, each once; a bit map of fixed size passes over most other texts before the exact join."""
    mask = (1 << MAP_BITS) - 1
    spot = F.col("node").bitwiseAND(F.lit(mask))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), spot.bitwiseAND(F.lit(63)).cast("int"))
    found = nodes.groupBy(F.shiftright(spot, 6).alias("w")).agg(F.bit_or(one).alias("bits")).toArrow()
    bits = np.zeros(1 << (MAP_BITS - 6), np.int64)
    bits[found["w"].to_numpy().astype(np.int64)] = found["bits"].to_numpy().astype(np.int64)
    shared = texts.sparkSession.sparkContext.broadcast(bits)  # 2 MB

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)[own := first_rows(batch)] & mask
            yield batch.take(pa.array(own[(shared.value[at >> 6] >> (at & 63) & 1).astype(bool)]))

    near = texts.select("node", "text").mapInArrow(tidy(rows), "node bigint, text string")
    return near.join(nodes.hint("shuffle_hash"), "node", "left_semi").groupBy("node").agg(F.min("text").alias("text"))


def similar(pairs: DataFrame, sets: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar, compared as sets of bytes."""
    pairs = written(possible(pairs, sets, threshold), "pairs")
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    own = written(texts_of(texts, nodes), "texts")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, held, keep = None, frozenset(), []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != last:
                    last, held = a, shingles(x.as_py().encode(), size)
                other = shingles(y.as_py().encode(), size)
                both = len(held & other)
                keep.append(both >= threshold * (len(held) + len(other) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sides = pairs.join(own.select(F.col("node").alias("b"), F.col("text").alias("y")), "b").join(own.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    out = written(sides.select("a", "b", "x", "y").mapInArrow(tidy(rows), "a bigint, b bigint"), "links")
    remove_written(pairs, own)
    return out


def similar_links(texts: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (a, b) of nodes that are similar, with the same components as all similar pairs of (node, text)."""
    survey = written(surveyed(texts, size), "survey")
    prints = survey.where("kind = 0").groupBy(F.col("x").alias("node")).agg(F.min("y").alias("fp"))
    smallest = prints.groupBy("fp").agg(F.min("node").alias("first"))
    equal = prints.join(smallest, "fp").where("node <> first").select(F.least("first", "node").alias("a"), F.greatest("first", "node").alias("b"))
    fuzzy = fuzzy_pairs(smallest.select("fp"))
    ends = [smallest.select(F.col("fp").alias(c), F.col("first").alias(f"n{c}")) for c in "ab"]
    fuzzy = fuzzy.join(ends[0], "a").join(ends[1], "b").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))

    sets = prefixes(texts, common_shingles(survey), size, threshold).where("n > 0")
    sets = written(sets.dropDuplicates(["node"]), "sets")
    sized = sets.select("node", "n", "sketch")
    keyed = sets.select("node", "n", F.posexplode("keys").alias("at", "key"))
    # The rest behind the shingle, with itself, bounds what is in common.
    keyed = keyed.select("key", "node", "n", (F.col("n") - F.col("at")).alias("rest"))
    holders = keyed.groupBy("key").agg(F.count("*").alias("holders"), F.min("node").alias("low"), F.bit_xor(F.xxhash64("node")).alias("mix")).where("holders > 1")
    # Shingles of one passage stand in the same documents: only the first of them in the order is needed, whose rest is the largest.
    shared = keyed.join(holders.hint("merge"), "key").select(F.xxhash64("holders", "low", "mix").alias("key"), "holders", "node", "n", "rest")
    shared = written(shared.groupBy("key", "node").agg(F.min("n").alias("n"), F.max("rest").alias("rest"), F.max("holders").alias("holders")), "shared")

    def enough(n: str, rest: str, m: str, more: str) -> Column:
        size_ok = F.least(n, m) >= threshold * F.greatest(n, m) - 1e-6
        return size_ok & (F.least(rest, more) >= threshold / (1 + threshold) * (F.col(n) + F.col(m)) - 1e-6)

    # Rounds of stars: under each key first the document that most others have something in common with, later
    # several drawn by a hash, are paired with all those of other components. What is similar is merged, and the
    # keys that still hold several components are looked at again; all pairs of components would be many more.
    proposed, links, tried, open_ = equal.unionByName(fuzzy), None, None, shared.withColumn("root", F.col("node"))
    for turn in range(MOST_STARS):
        if turn:
            drawn = [F.min(F.struct(F.xxhash64("node", F.lit(turn), F.lit(k)).alias("o"), "node", "root", "n", "rest")) for k in range(CENTRES)]
            centre = open_.groupBy("key").agg(F.array(*drawn).alias("c"))
        else:
            weighed = open_.join(open_.groupBy("node").agg(F.sum("holders").alias("weight")), "node")
            centre = weighed.groupBy("key").agg(F.array(F.max(F.struct("weight", "node", "root", "n", "rest"))).alias("c"))
        centre = centre.select("key", F.explode("c").alias("c")).select("key", F.col("c.node").alias("a"), F.col("c.root").alias("centre"), F.col("c.n").alias("m"), F.col("c.rest").alias("more"))
        star = open_.join(centre, "key").where((F.col("root") != F.col("centre")) & enough("n", "rest", "m", "more"))
        star = star.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"))
        fresh = star.unionByName(proposed).distinct() if turn == 0 else star.distinct().join(tried, ["a", "b"], "left_anti")
        fresh = written(fresh, "star")
        found = similar(fresh, sized, texts, size, threshold)
        links = found if links is None else written(links.unionByName(found), "links")
        tried = fresh if tried is None else written(tried.unionByName(fresh), "tried")
        named = written(shared.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node")), "named")
        mixed = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
        open_ = written(named.join(mixed, "key").select("key", "root", "node", "n", "rest", "holders"), "open")
        if found.count() * 64 < open_.count():  # few merge any more
            break
    # Bounds of each component's rows under a key first, so that components, not documents, are paired.
    groups = open_.groupBy("key", "root").agg(F.min("n").alias("n0"), F.max("n").alias("n1"), F.max("rest").alias("r"))
    x, y = groups.toDF("key", "ra", "an0", "an1", "ar"), groups.toDF("key", "rb", "bn0", "bn1", "br")
    can = (F.col("an1") >= threshold * F.col("bn0") - 1e-6) & (F.col("bn1") >= threshold * F.col("an0") - 1e-6)
    can &= F.least("ar", "br") >= threshold / (1 + threshold) * (F.col("an0") + F.col("bn0")) - 1e-6
    apart = x.join(y, "key").where((F.col("ra") < F.col("rb")) & can).select("key", "ra", "rb")
    left = open_.select("key", F.col("root").alias("ra"), F.col("node").alias("a"), "n", "rest")
    right = open_.select("key", F.col("root").alias("rb"), F.col("node").alias("b"), F.col("n").alias("m"), F.col("rest").alias("more"))
    across = apart.join(left, ["key", "ra"]).join(right, ["key", "rb"]).where(enough("n", "rest", "m", "more"))
    across = across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    more = similar(across, sized, texts, size, threshold)
    remove_written(survey, sets, shared, open_)
    return links.unionByName(more)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, one row of each component of similar texts: that with the smallest id, all columns kept.

    Decided by row: rows of one id stay apart if their texts are not linked. If
    the smallest id stands on several rows of a component, one of them stays,
    the one whose text has the smallest hash; equal rows are told apart by
    nothing, so any stays. Null, empty and blank texts have no word and are
    copies of each other. Rows with a null id stay. An empty table gives none.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    own = dict(zip(docs.columns, names, strict=True))
    key, plain = own[id_col], docs.toDF(*names)
    plain = plain.withColumn("_node", F.coalesce(node(own[text_col]), F.lit(0).cast("bigint")))
    counts = written(plain.groupBy(F.col("_node").alias("node"), F.col(key).alias("id")).agg(F.count("*").alias("n")), "counts")
    links = similar_links(plain.select(F.col("_node").alias("node"), F.col(own[text_col]).alias("text")), size, threshold)
    rooted = counts.where("id IS NOT NULL").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    keep = rooted.groupBy("root").agg(F.min(F.struct("id", "node")).alias("one")).select("one.id", "one.node")
    keep = written(keep.join(counts, ["id", "node"]).select(F.col("node").alias("_node"), F.col("id").alias(key), "n"), "keep")
    # Always a shuffled hash join: the rows kept grow with the input, so they are never broadcast.
    lone, several = (keep.where(c).drop("n").hint("shuffle_hash") for c in ("n = 1", "n > 1"))
    out = plain.join(lone, ["_node", key], "left_semi").select(*names)
    if keep.where("n > 1").limit(1).count():
        out = out.unionByName(plain.join(several, ["_node", key], "left_semi").dropDuplicates(["_node", key]).select(*names))
    return out.unionByName(plain.where(F.col(key).isNull()).select(*names)).toDF(*docs.columns)

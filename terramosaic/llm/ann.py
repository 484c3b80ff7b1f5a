"""Nearest neighbours by inner product: anisotropic quantisation proposes, exact bounds complete.

A vector is coded by one of 16 codewords in each small subspace, four bits a
subspace. Codebooks and codes minimise the score-aware loss

    |r|^2 + (eta - 1) * (r . x / |x|)^2,    r = x - quantised x,

which weighs the residual along the vector ``eta`` times as much as the one
across, since it is the parallel part that changes large inner products. Codes
are chosen by coordinate descent over subspaces, codebooks by one weighted
least-squares solve for all codewords together.

Vectors are dealt to coarse cells, those of a k-means of the sample. In a first
round a query looks into the cells whose centroid has the largest inner products
with it. How many depends on the data: it is measured on a part of the sample
that the cells were not fitted on, so that COVERAGE of the true neighbours lie
in them. Clustered vectors need few cells, vectors without structure most.

Cells are packed into blocks of near VECTOR_BLOCK vectors (a crowded cell is
spread over several), queries by their own nearest cell into blocks as well. A
block of queries travels to the blocks of vectors that hold its cells. There the
codes of the cells looked into are scanned with per-query tables of 16 partial
products a subspace (two subspaces share a byte, so a lookup covers two), the
best ``depth`` of the block are kept, and these are reranked exactly, in double
precision, on the original vectors.

Codes and sampled cells alone miss neighbours wherever the data is not like the
sample: lengths that differ widely, close copies that share a code, queries far
from the rest. So the k-th best score of the first round is only a floor that
the true neighbours cannot be below. The second round takes each query to every
cell that a bound (the centroid's product plus the query's length times the
cell's radius, or the lengths' product) lets reach its floor, and there to every
vector whose product in single precision, with its largest rounding error,
does; these are scored in double precision. No neighbour is lost by either.

The model is fitted on a bounded sample and has a fixed size; every vector is
indexed. With ``exact`` the first round is left out and nothing has a floor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terramosaic.llm.common import remove_written, written

#: Sample rows for the codebooks, and for the cells (fewer of them for long vectors, CELL_BYTES in all).
SAMPLE_ROWS, CELL_ROWS, CELL_BYTES = 6000, 32_768, 32 << 20
#: The most cells, and the share of neighbours that must lie in the cells that a query looks into first.
MAX_CELLS, COVERAGE = 2048, 0.98
#: Dimensions of a subspace, and the inner product (relative to the norm) above which scores matter.
SUBSPACE = 2
SCORE_FLOOR = 0.3
VECTOR_BLOCK, QUERY_BLOCK = 4096, 4096
#: Candidates of one block that the first round reranks exactly.
DEPTH = 160
#: Numbers of one array of vectors that are scored together.
SCORED = 4 << 20
#: Query blocks that one copy of a vector block serves; a block in more demand is copied.
SERVED = 64
#: The most tasks of a search.
MAX_TASKS = 20_000


class Quantiser:
    """Codebooks of shape (subspaces, 16, SUBSPACE), fitted on sample vectors."""

    def __init__(self, sample: np.ndarray, rounds: int = 6, seed: int = 11):
        n, self.dim = sample.shape
        self.sub = -(-self.dim // SUBSPACE)
        self.sub += self.sub % 2  # an even number, two to a byte
        self.eta = max(1.0, (self.dim - 1) * SCORE_FLOOR**2 / (1 - SCORE_FLOOR**2))
        x = self.cut(sample)
        rng = np.random.default_rng(seed)
        self.books = np.stack([x[rng.integers(0, n, 16), m] for m in range(self.sub)])
        self.books += rng.normal(0, 1e-3 * (x.std() + 1e-9), self.books.shape)
        codes = None
        for _ in range(rounds):
            codes = self.assign(x, codes)
            self.books = self.solve(x, codes)

    def cut(self, vectors: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(vectors), self.sub * SUBSPACE))
        padded[:, : self.dim] = vectors
        return padded.reshape(len(vectors), self.sub, SUBSPACE)

    @staticmethod
    def direction(x: np.ndarray) -> np.ndarray:
        norm = np.sqrt((x**2).sum(axis=(1, 2), keepdims=True))
        return x / np.maximum(norm, 1e-300)

    def assign(self, x: np.ndarray, codes: np.ndarray | None = None, sweeps: int = 2) -> np.ndarray:
        """Codes by coordinate descent on the score-aware loss."""
        unit = self.direction(x)
        across = np.stack([((x[:, m, None] - self.books[m][None]) ** 2).sum(axis=2) for m in range(self.sub)], axis=1)
        along = np.stack([((x[:, m, None] - self.books[m][None]) * unit[:, m, None]).sum(axis=2) for m in range(self.sub)], axis=1)
        codes = across.argmin(axis=2) if codes is None else codes.copy()
        rows = np.arange(len(x))
        total = np.take_along_axis(along, codes[:, :, None], axis=2)[:, :, 0].sum(axis=1)
        for _ in range(sweeps):
            for m in range(self.sub):
                rest = total - along[rows, m, codes[:, m]]
                codes[:, m] = (across[:, m] + (self.eta - 1) * (rest[:, None] + along[:, m]) ** 2).argmin(axis=1)
                total = rest + along[rows, m, codes[:, m]]
        return codes

    def solve(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The codebooks that minimise the loss for given codes: one linear system."""
        size = self.sub * 16 * SUBSPACE
        unit, gram, right = self.direction(x), np.zeros((size, size)), np.zeros(size)
        diagonal = np.zeros(size)
        at = ((np.arange(self.sub)[None] * 16 + codes)[:, :, None] * SUBSPACE + np.arange(SUBSPACE)).reshape(len(x), -1)
        for a in range(0, len(x), 1000):
            place, flat = at[a : a + 1000], x[a : a + 1000].reshape(-1, self.sub * SUBSPACE)
            wide = np.zeros((len(flat), size))
            np.put_along_axis(wide, place, unit[a : a + 1000].reshape(flat.shape), axis=1)
            gram += (self.eta - 1) * (wide.T @ wide)
            np.add.at(right, place, self.eta * flat)
            np.add.at(diagonal, place, 1.0)
        gram[np.arange(size), np.arange(size)] += diagonal + 1e-6
        books = np.linalg.solve(gram, right).reshape(self.sub, 16, SUBSPACE)
        used = diagonal.reshape(self.sub, 16, SUBSPACE)[:, :, :1] > 0
        return np.where(used, books, self.books)

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """Two four-bit codes to a byte."""
        codes = np.concatenate([self.assign(self.cut(vectors[a : a + 2048])) for a in range(0, len(vectors), 2048)])
        return (codes[:, ::2] << 4 | codes[:, 1::2]).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Partial products for each query and byte of code, shape (bytes, queries, 256)."""
        part = np.einsum("qmd,mkd->mqk", self.cut(queries), self.books)
        return (part[::2, :, :, None] + part[1::2, :, None, :]).reshape(self.sub // 2, len(queries), 256).astype(np.float32)


class Cells:
    """Centroids of a k-means, and how many of the nearest a query looks into."""

    def __init__(self, sample: np.ndarray, n: int, k: int, rounds: int = 8, seed: int = 13):
        rng = np.random.default_rng(seed)
        sample = np.unique(sample, axis=0)
        sample = sample[rng.permutation(len(sample))].astype(np.float32)
        test, own = sample[: min(4000, len(sample) // 4)], sample[min(4000, len(sample) // 4) :]
        count = max(1, min(MAX_CELLS, int(np.sqrt(n)), len(own) // 16))
        self.centroids = own[:count].copy()
        for _ in range(rounds):
            home = self.home(own)
            sums = np.zeros((count, sample.shape[1]))
            np.add.at(sums, home, own)
            held = np.bincount(home, minlength=count)
            self.centroids[held > 0] = (sums[held > 0] / held[held > 0, None]).astype(np.float32)
        # Neighbours lie along the first principal direction of the centroids, so near cells share a block.
        middle = self.centroids - self.centroids.mean(axis=0)
        axis = np.linalg.svd(middle.astype(np.float64), full_matrices=False)[2][0] if count > 1 else np.zeros(sample.shape[1])
        self.centroids = self.centroids[np.argsort(middle @ axis, kind="stable")]
        self.probes = count
        if count > 1 and len(test) > k:
            queries = test[:300]
            score = queries @ test.T
            score[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
            near = np.argpartition(-score, k - 1, axis=1)[:, :k]
            rank = np.argsort(np.argsort(-(queries @ self.centroids.T), axis=1), axis=1)
            place = np.sort(np.take_along_axis(rank, self.home(test)[near], axis=1).ravel())
            self.probes = int(place[min(len(place) - 1, int(np.ceil(COVERAGE * len(place))))]) + 1

    def home(self, vectors: np.ndarray) -> np.ndarray:
        """The nearest centroid of each vector."""
        half = (self.centroids**2).sum(axis=1) / 2
        return np.concatenate([np.zeros(0, np.int64), *((vectors[a : a + 4096].astype(np.float32) @ self.centroids.T - half).argmax(axis=1) for a in range(0, len(vectors), 4096))])

    def looked_into(self, queries: np.ndarray) -> np.ndarray:
        """A row a query, true for the cells that it looks into."""
        out = np.ones((len(queries), len(self.centroids)), bool)
        if self.probes < len(self.centroids):
            score = queries.astype(np.float32) @ self.centroids.T
            least = np.partition(score, len(self.centroids) - self.probes, axis=1)[:, len(self.centroids) - self.probes]
            out = score >= least[:, None]
        return out

    def can_reach(self, queries: np.ndarray, floors: np.ndarray, radius: np.ndarray, longest: np.ndarray) -> np.ndarray:
        """A row a query, true for the cells that may hold a vector whose inner product is no less than the query's floor.

        ``radius`` and ``longest`` are the largest distance from the centroid and
        the largest length in each cell. What cannot be told is true.
        """
        own, centre = queries.astype(np.float64), self.centroids.astype(np.float64)
        size = lengths(own)[:, None]
        with np.errstate(invalid="ignore", over="ignore"):
            most = np.minimum(own @ centre.T + size * (radius + 1e-9 * (radius + lengths(centre))), size * longest * (1 + 1e-9))
            return ~(most < floors[:, None])


def lengths(vectors: np.ndarray) -> np.ndarray:
    """Euclidean length of each row, without overflow."""
    most = np.maximum(np.abs(vectors).max(axis=1), 1e-300)
    return most * np.sqrt(((vectors / most[:, None]) ** 2).sum(axis=1))


class Held:
    """A block of vectors made ready for the second round; ``ids`` ascend.

    Of equal vectors with one id k rows, and then of equal vectors 2 k, those
    with the smallest ids, are enough for every query's k best of other ids.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, cell: np.ndarray, k: int):
        rows = np.arange(len(ids))
        group = np.unique(np.ascontiguousarray(vectors).view(f"V{vectors.dtype.itemsize * vectors.shape[1]}").ravel(), return_inverse=True)[1].ravel()
        for keys, most in (((ids, group), k), ((group,), 2 * k)):
            order = rows[np.lexsort((ids[rows], *(x[rows] for x in keys)))]
            new = np.any([x[order][1:] != x[order][:-1] for x in keys], axis=0)
            heads = np.concatenate([[0], np.flatnonzero(new) + 1])
            place = np.arange(len(order)) - np.repeat(heads, np.diff(np.append(heads, len(order))))
            rows = np.sort(order[place < most])
        self.ids, self.vectors, self.cell = ids[rows], vectors[rows].astype(np.float64), cell[rows]
        self.length = lengths(self.vectors)
        self.unit = (self.vectors / self.length[:, None]).astype(np.float32)

    def best(self, query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, wanted: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """(query_id, id, score): for each query its k best of the block, or all of them that are no less than its floor."""
        slack, out = (queries.shape[1] + 8) * 2.0**-23, []  # more than twice what single precision can be off
        for a in range(0, len(queries), 256):
            at = np.flatnonzero(wanted[a : a + 256].any(axis=0)[self.cell])
            if not len(at):
                continue
            own, who = queries[a : a + 256].astype(np.float64), query_ids[a : a + 256]
            length = lengths(own)
            most = ((own / length[:, None]).astype(np.float32) @ self.unit[at].T + slack) * self.length[at]
            most[self.ids[at] == who[:, None]] = -np.inf
            can = (most != -np.inf) & ~(most < (floors[a : a + 256] / length)[:, None])
            many = np.flatnonzero(can.sum(axis=1) > 4 * k)
            if len(many):  # what surely is among the block's k best is a floor as well
                least = np.nan_to_num(most[many] - 2 * slack * self.length[at], nan=-np.inf, posinf=np.inf, neginf=-np.inf)
                can[many] &= ~(most[many] < np.partition(least, len(at) - k, axis=1)[:, len(at) - k, None])
            query, near = np.nonzero(can)
            near, step = at[near], max(1, SCORED // queries.shape[1])
            score = np.concatenate([np.zeros(0), *((own[query[b : b + step]] * self.vectors[near[b : b + step]]).sum(axis=1) for b in range(0, len(near), step))])
            order = np.lexsort((self.ids[near], -score, query))
            place = np.arange(len(order)) - np.searchsorted(query, query)
            order = order[place < k]
            out.append((who[query[order]], self.ids[near[order]], score[order]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def search_block(model: Quantiser, query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, k: int, depth: int = DEPTH, cell: np.ndarray | None = None, wanted: np.ndarray | None = None) -> list[tuple[np.ndarray, ...]]:
    """The first round: the k best that the codes of one block propose for each query: (query_id, ids, scores). ``ids`` ascend.

    ``wanted`` (queries x cells) says which cells a query looks into, ``cell``
    which one each vector is of. Equal vectors are scanned once; of a group only
    the k + 1 smallest ids can be among the k best.
    """
    _, first, group = np.unique(np.ascontiguousarray(vectors).view(f"V{vectors.dtype.itemsize * vectors.shape[1]}").ravel(), return_index=True, return_inverse=True)
    cell = np.zeros(len(ids), np.int64) if cell is None else cell
    by_cell = np.argsort(cell[first], kind="stable")
    rank = np.empty(len(first), np.int64)
    rank[by_cell] = np.arange(len(first))
    first, group = first[by_cell], rank[group.ravel()]
    order = np.argsort(group, kind="stable")
    begin = np.searchsorted(group[order], np.arange(len(first) + 1))
    lone, unique, cell = codes[first], vectors[first].astype(np.float64), cell[first]
    cuts = np.flatnonzero(np.diff(cell, prepend=-1))
    depth, out = max(depth, 2 * k), []
    for a in range(0, len(queries), 256):
        own = queries[a : a + 256].astype(np.float64)
        scores = np.full((len(own), len(first)), -np.inf, np.float32)
        tables = model.tables(own)
        for low, high in zip(cuts.tolist(), [*cuts[1:].tolist(), len(first)], strict=True):
            who = np.arange(len(own)) if wanted is None else np.flatnonzero(wanted[a : a + 256, cell[low]])
            if len(who):
                part = np.zeros((len(who), high - low), np.float32)
                for b in range(tables.shape[0]):
                    part += tables[b][np.ix_(who, lone[low:high, b])]
                scores[who, low:high] = part
        for row in range(len(own)):
            near = np.argpartition(-scores[row], depth)[:depth] if len(first) > depth else np.arange(len(first))
            near = near[scores[row][near] > -np.inf]
            if not len(near):
                continue
            value = unique[near] @ own[row]
            if len(near) > 2 * k:  # keep what can still matter, ties included
                least = np.partition(value, len(value) - k - 1)[len(value) - k - 1]
                near, value = near[value >= least], value[value >= least]
            members = [order[begin[g] : min(begin[g + 1], begin[g] + k + 1)] for g in near.tolist()]
            place = np.concatenate(members)
            value = np.repeat(value, [len(m) for m in members])
            other = ids[place] != query_ids[a + row]
            place, value = place[other], value[other]
            best = np.lexsort((ids[place], -value))[:k]
            out.append((query_ids[a + row], ids[place[best]], value[best]))
    return out


def blocks_of(counts: dict[int, int], size: int) -> dict[int, tuple[int, int]]:
    """Cell -> (first block, blocks): neighbouring cells share a block of near ``size`` rows, a larger cell has several of its own."""
    out, block, held = {}, 0, 0
    for cell in sorted(counts):
        n = counts[cell]
        if held and held + n > size:
            block, held = block + 1, 0
        if n > size:
            many = -(-n // size)
            out[cell] = (block, many)
            block += many
        else:
            out[cell] = (block, 1)
            held += n
    return out


def usable(vector: Column) -> Column:
    """Not null or empty, all components finite, not all zero."""
    wide = vector.cast("array<double>")
    finite = F.forall(wide, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(wide, lambda v: v != 0)


def matrix_of(column: pa.ChunkedArray | pa.Array, dim: int, dtype: type) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), dtype).reshape(-1, dim)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", depth: int = DEPTH, exact: bool = False) -> DataFrame:
    """query_id, rank (from 1), id, score: each query's k nearest by inner product, none missing.

    Vectors that are null, empty, zero or hold a null or non-finite component
    take no part, nor do vectors of another length than the most common one
    (ties: the shorter), since they have no inner product with the rest. A query
    id on several rows is one query, by the smallest of its vectors. Rows with
    the query's own id are no candidates; other repeated rows are candidates of
    their own. Equal scores go to the smaller id. Fewer candidates than k give
    all of them; an empty table gives no row. ``depth`` and ``exact`` (every
    vector is looked at, without codes and floors) decide the work, never the
    result.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    dtype = np.float32 if kind == "float" else np.float64
    cast = "array<float>" if kind == "float" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast(cast).alias("_v"), F.coalesce(is_query, F.lit(False)).alias("_q")).where(usable(F.col("_v")) & F.col("_id").isNotNull())
    sizes = rows.groupBy(F.size("_v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], f"query_id bigint, rank int, `{id_col}` bigint, score double")
    dim, n = sizes[0]["dim"], sizes[0]["n"]
    rows = rows.where(F.size("_v") == dim)
    n_sample = max(SAMPLE_ROWS, min(CELL_ROWS, CELL_BYTES // (4 * dim)))
    share = int(np.ceil(1_000_000 * min(1.0, n_sample / n)))
    sample = rows.where(F.pmod(F.xxhash64("_id", "_v"), F.lit(1_000_000)) < share).select("_id", "_v").dropDuplicates(["_id"]).limit(2 * n_sample).toArrow()
    matrix = matrix_of(sample.column("_v"), dim, np.float64)
    matrix = matrix[np.lexsort((*matrix.T[:4], sample.column("_id").to_numpy()))]
    cells = Cells(matrix, n, k)
    model = Quantiser(matrix[:: max(1, -(-len(matrix) // SAMPLE_ROWS))])
    shared = spark.sparkContext.broadcast((model, cells))  # 16 codewords a subspace, MAX_CELLS centroids

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_model, own_cells = shared.value
        for batch in batches:
            own = matrix_of(batch.column(1), dim, dtype)
            codes = own_model.encode(own) if len(own) else np.zeros((0, 1), np.uint8)
            home = own_cells.home(own).astype(np.int32)
            wide = own.astype(np.float64)
            radius = lengths(wide - own_cells.centroids[home]) if len(own) else np.zeros(0)
            size = lengths(wide) if len(own) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in own], pa.binary()), batch.column(2), pa.array(home), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(radius), pa.array(size)], ["_id", "_v", "_q", "_cell", "_code", "_radius", "_length"])

    indexed = written(rows.mapInArrow(index, "_id bigint, _v binary, _q boolean, _cell int, _code binary, _radius double, _length double"), "ann-index")
    asked = written(indexed.where("_q").groupBy("_id").agg(F.min_by("_cell", "_v").alias("_cell"), F.min("_v").alias("_v")), "ann-queries")
    held = indexed.groupBy("_cell").agg(F.count("*").alias("n"), F.max("_radius").alias("radius"), F.max("_length").alias("length")).collect()  # at most MAX_CELLS rows
    wanted = asked.groupBy("_cell").agg(F.count("*").alias("n")).collect()
    homes = blocks_of({r["_cell"]: r["n"] for r in held}, VECTOR_BLOCK)
    query_homes = blocks_of({r["_cell"]: r["n"] for r in wanted}, QUERY_BLOCK)
    radius, longest = np.zeros((2, len(cells.centroids)))
    for r in held:
        radius[r["_cell"]], longest[r["_cell"]] = r["radius"], r["length"]
    n_blocks = 1 + max((a + b - 1 for a, b in homes.values()), default=0)
    n_query_blocks = 1 + max((a + b - 1 for a, b in query_homes.values()), default=0)
    copies = -(-n_query_blocks // SERVED)

    def block(places: dict[int, tuple[int, int]]) -> Column:
        table = F.create_map(*(F.lit(x) for cell, (first, many) in (places or {-1: (0, 1)}).items() for x in (cell, (first << 24) + many)))
        place = F.element_at(table, F.col("_cell"))
        return (F.shiftright(place, 24) + F.pmod(F.xxhash64("_id"), F.pmod(place, F.lit(1 << 24)))).cast("int").alias("_block")

    def pack_vectors(group: pa.Table) -> pa.Table:
        group = group.sort_by("_id")
        out = {"block": group.column("_block")[0].as_py(), "ids": group.column("_id").to_numpy().tobytes()}
        out |= {"vectors": b"".join(group.column("_v").to_pylist()), "codes": b"".join(group.column("_code").to_pylist()), "cells": group.column("_cell").to_numpy().tobytes()}
        return pa.table({c: pa.array([v], pa.int32() if c == "block" else pa.binary()) for c, v in out.items()})

    def cells_of(own: np.ndarray, floors: np.ndarray, last: bool) -> np.ndarray:
        """The cells that queries go to in this round."""
        own_cells = shared.value[1]
        return own_cells.can_reach(own, floors, radius, longest) if last else own_cells.looked_into(own)

    def pack_queries(last: bool):
        def pack(group: pa.Table) -> pa.Table:
            """A block of queries, and the vector blocks that it must see."""
            group = group.sort_by([("_cell", "ascending"), ("_id", "ascending")])
            raw, floors = b"".join(group.column("_v").to_pylist()), group.column("_floor").to_numpy()
            own, seen = np.frombuffer(raw, dtype).reshape(-1, dim), np.zeros(len(cells.centroids), bool)
            for a in range(0, len(own), 256):
                seen |= cells_of(own[a : a + 256], floors[a : a + 256], last).any(axis=0)
            need = sorted({x for c in np.flatnonzero(seen).tolist() if c in homes for x in range(homes[c][0], homes[c][0] + homes[c][1])})
            number = group.column("_block")[0].as_py()
            return pa.table({"number": pa.array([number], pa.int32()), "ids": pa.array([group.column("_id").to_numpy().tobytes()], pa.binary()), "vectors": pa.array([raw], pa.binary()), "floors": pa.array([floors.tobytes()], pa.binary()), "need": pa.array([need], pa.list_(pa.int32()))})

        return pack

    packed = indexed.select("_id", "_v", "_code", "_cell", block(homes)).groupBy("_block").applyInArrow(pack_vectors, "block int, ids binary, vectors binary, codes binary, cells binary")
    packed = written(packed, "ann-blocks")
    remove_written(indexed)
    nothing, n_tasks = F.lit(None).cast("binary"), max(1, min(MAX_TASKS, n_blocks * copies))

    def scan(last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A partition holds a block of vectors and then the queries that look into it."""
            here: tuple | Held = ()
            for batch in batches:
                for row in range(batch.num_rows):
                    ids = np.frombuffer(batch.column(3)[row].as_buffer(), np.int64)
                    own = np.frombuffer(batch.column(4)[row].as_buffer(), dtype).reshape(-1, dim)
                    if batch.column(2)[row].as_py() == 0:
                        codes = np.frombuffer(batch.column(5)[row].as_buffer(), np.uint8).reshape(len(ids), -1)
                        cell = np.frombuffer(batch.column(6)[row].as_buffer(), np.int32).astype(np.int64)
                        here = Held(ids, own, cell, k) if last else (ids, own, codes, cell)
                        continue
                    floors = np.frombuffer(batch.column(7)[row].as_buffer(), np.float64)
                    if last:
                        found = here.best(ids, own, floors, cells_of(own, floors, True), k)
                    else:
                        each = search_block(shared.value[0], ids, own, *here[:3], k, depth, here[3], cells_of(own, floors, False))
                        counts = [len(i) for _, i, _ in each]
                        found = (np.repeat(np.array([q for q, _, _ in each], np.int64), counts), *(np.concatenate([np.zeros(0, t), *(x[j] for x in each)]) for j, t in ((1, np.int64), (2, np.float64))))
                    if len(found[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", id_col, "score"])

        return run

    def searched(queries: DataFrame, last: bool) -> DataFrame:
        """One round: each query's k best of what it meets, ranked."""
        sides = packed.select("block", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), F.lit(0).alias("kind"), "ids", "vectors", "codes", "cells", nothing.alias("floors"))
        asking = queries.select("_id", "_v", "_cell", "_floor", block(query_homes)).groupBy("_block").applyInArrow(pack_queries(last), "number int, ids binary, vectors binary, floors binary, need array<int>")
        asking = asking.select(F.explode("need").alias("block"), (F.col("number") % copies).alias("copy"), F.lit(1).alias("kind"), "ids", "vectors", nothing.alias("codes"), nothing.alias("cells"), "floors")
        together = sides.unionByName(asking).repartitionById(n_tasks, F.pmod(F.col("block") * copies + F.col("copy"), F.lit(n_tasks)).cast("int")).sortWithinPartitions("block", "copy", "kind")
        best = together.mapInArrow(scan(last), f"query_id bigint, `{id_col}` bigint, score double")
        return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)).cast("int")).where(F.col("rank") <= k)

    lowest = F.lit(float("-inf"))
    if exact:
        asked = asked.withColumn("_floor", lowest)
    else:
        floors = searched(asked.withColumn("_floor", lowest), False).where((F.col("rank") == k) & (F.abs("score") < float("inf")))
        floors = written(floors.select(F.col("query_id").alias("_id"), F.col("score").alias("_floor")), "ann-floors")
        asked = asked.join(floors, "_id", "left").withColumn("_floor", F.coalesce("_floor", lowest))
    return searched(asked, True).select("query_id", "rank", id_col, "score")

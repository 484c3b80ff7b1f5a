"""Benchmark decontamination with suffix arrays over the training text.

Every shard of documents (a few megabytes of text in one task) gets a suffix
array over its word sequence, in full order: suffixes are ranked by as many
words as fit into an integer, and groups of equal rank are ranked again by the
rank that far behind, which doubles the words each time. A word that no item
holds ends a suffix, since nothing can match across it, and documents are apart.

Every benchmark suffix is then searched, all at once: a range of the array is
narrowed word by word by binary search until it is empty. The last range that
is not gives the longest verbatim match and its places; the range at the length
of a window gives every place of the window. Equal windows of several items
have one range, which is read once; items are put together document by document.
Documents are read where they lie: no shuffle.

The benchmark is taken in blocks of bounded size, one after the other: a pass
over the documents holds one block, and what it found travels on with them. So a
larger benchmark means more passes, never more memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terramosaic.llm.common import doc_chunks, remove_written, text_bytes, tidy, utf8, written
from terramosaic.llm.words import words

WINDOW = 10
#: Benchmark text of one pass.
BLOCK_BYTES = 32 << 20
#: Bytes of a text that are taken at once; a longer one is cut between words, with the words of a window but one as overlap.
LONG_BYTES = 8 << 20


class Block:
    """Items as one sequence of word ids, 0 behind each, with a window's length at each place where one begins (else 0)."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[str] = []
        ids, item, length, offset = [], [], [], []
        for item_id, text in items:
            own = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words((text or "").encode())]
            if own:
                n = len(own)
                ids += [*own, 0]
                item += [len(self.names)] * (n + 1)
                offset += range(n + 1)
                length += [min(n, window) if at <= max(0, n - window) else 0 for at in range(n + 1)]
                self.names.append("null" if item_id is None else str(item_id))
        self.ids, self.item, self.offset, self.window_at = (np.array(x, np.int32) for x in (ids, item, offset, length))


class SuffixShard:
    """Suffix array over word ids in full order; 0 is a word that no item holds, or the gap behind a document, and ends a suffix."""

    def __init__(self, ids: np.ndarray, n_words: int):
        bits = max(1, int(n_words).bit_length())
        width = max(1, 62 // bits)
        self.ids = np.concatenate([ids, np.zeros(width + 1, ids.dtype)]).astype(np.int64)
        start = np.flatnonzero(self.ids)
        key, alive = np.zeros(len(start), np.int64), np.ones(len(start), bool)
        for j in range(width):
            word = np.where(alive, self.ids[np.minimum(start + j, len(self.ids) - 1)], 0)
            alive &= word > 0
            key = key << bits | word
        order = np.argsort(key, kind="stable")
        self.suffixes, key, alive = start[order], key[order], alive[order]
        # Ranks by ``width`` words; suffixes that go on and share a rank are ranked again by the rank ``width`` behind.
        rank = np.zeros(len(self.ids) + width, np.int64)
        group = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1]) if len(key) else np.zeros(0, np.int64)
        low = np.repeat(group, np.diff(np.append(group, len(key))))
        rank[self.suffixes] = low + 1
        open_ = np.flatnonzero(alive & (np.repeat(np.diff(np.append(group, len(key))), np.diff(np.append(group, len(key)))) > 1)) if len(key) else group
        while len(open_):
            # Whole groups are open: their members share ``width`` words, so all of them go on or none does.
            own, first = self.suffixes[open_], low[open_]
            behind = rank[np.minimum(own + width, len(rank) - 1)]
            order = np.lexsort((behind, first))
            own, first, behind = own[order], first[order], behind[order]
            self.suffixes[open_] = own
            new = np.ones(len(open_), bool)
            new[1:] = (first[1:] != first[:-1]) | (behind[1:] != behind[:-1])
            heads = np.flatnonzero(new)
            sizes = np.diff(np.append(heads, len(open_)))
            low[open_] = np.repeat(open_[heads], sizes)
            rank[own] = low[open_] + 1
            open_ = open_[(np.repeat(sizes, sizes) > 1) & (behind > 0)]
            width *= 2

    def bound(self, word: np.ndarray, depth: np.ndarray, low: np.ndarray, high: np.ndarray, after: bool) -> np.ndarray:
        """The first place in low..high whose word at ``depth`` is not less than ``word`` (``after``: is greater), by halving."""
        low, high = low.copy(), high.copy()
        while (todo := low < high).any():
            middle = (low + high) // 2
            here = self.ids[np.minimum(self.suffixes[np.minimum(middle, len(self.suffixes) - 1)] + depth, len(self.ids) - 1)]
            right = todo & ((here <= word) if after else (here < word))
            low, high = np.where(right, middle + 1, low), np.where(todo & ~right, middle, high)
        return low

    def find(self, block: Block) -> tuple[np.ndarray, ...]:
        """(window starts in the block, low, high: their ranges; longest match of every suffix of the block, low, high)."""
        n = len(block.ids)
        at = np.flatnonzero(block.ids)
        low, high = np.zeros(len(at), np.int64), np.full(len(at), len(self.suffixes), np.int64)
        longest, best = np.zeros(n, np.int64), np.zeros((n, 2), np.int64)
        found: list[tuple[np.ndarray, ...]] = []
        depth = 0
        while len(at):
            word = block.ids[at + depth].astype(np.int64)
            deep = np.full(len(at), depth, np.int64)
            low, high = self.bound(word, deep, low, high, False), self.bound(word, deep, low, high, True)
            keep = (word > 0) & (low < high)
            at, low, high = at[keep], low[keep], high[keep]
            depth += 1
            longest[at], best[at, 0], best[at, 1] = depth, low, high
            whole = block.window_at[at] == depth
            if whole.any():
                found.append((at[whole], low[whole], high[whole]))
        start, a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        return start, a, b, longest, best[:, 0], best[:, 1]


def ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) over the ranges low..high."""
    counts = high - low
    row = np.repeat(np.arange(len(low)), counts)
    return row, np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)


def scan_shard(block: Block, pieces: list[list[bytes]], details: bool) -> list[tuple[list[tuple[int, int]], set[str], list[tuple[str, int, int, int]]]]:
    """(covered words, names of items, runs) of each document, given as words."""
    lengths = np.array([len(p) for p in pieces], np.int64)
    first = np.concatenate([[0], np.cumsum(lengths + 1)])  # one gap behind every document
    ids = np.zeros(int(first[-1]), np.int64)
    for a, own in zip(first.tolist(), pieces, strict=False):
        ids[a : a + len(own)] = np.fromiter(map(block.vocabulary.get, own, repeat(0)), np.int64, len(own))
    shard = SuffixShard(ids, len(block.vocabulary))
    start, low, high, _, _, _ = shard.find(block)
    # Equal windows have one range: its places are read once.
    window = block.window_at[start].astype(np.int64)
    _, lead, same = np.unique(low * (len(ids) + 1) + high, return_index=True, return_inverse=True)
    members = np.argsort(same, kind="stable")
    bounds = np.searchsorted(same[members], np.arange(len(lead) + 1))
    which, index = ranges(low[lead], high[lead])
    place = shard.suffixes[index]
    order = np.argsort(place, kind="stable")
    which, place = which[order], place[order]
    doc = np.searchsorted(first, place, "right") - 1
    ends = np.searchsorted(doc, np.arange(len(pieces) + 1))
    out = []
    for k in range(len(pieces)):
        own, spots = which[ends[k] : ends[k + 1]], place[ends[k] : ends[k + 1]] - first[k]
        covered: list[list[int]] = []
        for a, b in zip(spots.tolist(), (spots + window[lead[own]]).tolist(), strict=True):
            if covered and a <= covered[-1][1]:
                covered[-1][1] = max(covered[-1][1], b)
            else:
                covered.append([a, b])
        names = {block.names[i] for w in np.unique(own).tolist() for i in np.unique(block.item[start[members[bounds[w] : bounds[w + 1]]]]).tolist()}
        runs: list[tuple[str, int, int, int]] = []
        if details and len(own):
            ahead: dict[tuple[int, int], list[int]] = {}  # (item, diagonal) -> the run that is being read
            for w, spot in zip(own.tolist(), spots.tolist(), strict=True):
                for at in start[members[bounds[w] : bounds[w + 1]]].tolist():
                    item, offset, size = int(block.item[at]), int(block.offset[at]), int(block.window_at[at])
                    run = ahead.get((item, spot - offset))
                    if run is not None and run[0] + run[2] - size + 1 == spot:
                        run[2] += 1
                    else:
                        if run is not None:
                            runs.append((block.names[item], *run))
                        ahead[item, spot - offset] = [spot, offset, size]
            runs += [(block.names[item], *run) for (item, _), run in ahead.items()]
        out.append((list(map(tuple, covered)), names, sorted(runs)))
    return out


def pieces_of(raw: bytes, window: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first word, words before that come again, words) of the pieces of a text, cut between words."""
    at, first, carried = 0, 0, []
    while True:
        end = len(raw)
        if end - at > LONG_BYTES:
            end = at + LONG_BYTES
            while end < len(raw) and (raw[end] >= 128 or chr(raw[end]).isalnum()):
                end += 1
        own = words(raw[at:end])
        yield first - len(carried), len(carried), carried + own
        first += len(own)
        carried = (carried + own)[-(window - 1) :] if window > 1 else []
        at = end
        if at >= len(raw):
            return


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return list(map(tuple, out))


MATCH = pa.list_(pa.struct([("item", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64())]))


STATE = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("covered", pa.list_(pa.int64())), ("items", pa.list_(pa.string())), ("longest", pa.int64()), ("runs", MATCH)])
STATE_DDL = "struct<n_words:bigint,n_hit:bigint,covered:array<bigint>,items:array<string>,longest:bigint,runs:array<struct<item:string,doc_word:bigint,item_word:bigint,n_words:bigint>>>"


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> Iterator[Block]:
    """The benchmark in blocks of near BLOCK_BYTES, one at a time; one empty block for an empty benchmark."""
    items = benchmark.select(F.col(item_col).alias("_item"), F.col(text_col).alias("_text")).where(F.col("_text").isNotNull())
    n_blocks = max(1, -(-text_bytes(items, "_text") // BLOCK_BYTES))
    for k in range(n_blocks):
        part = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("_item", "_text"), F.lit(n_blocks)) == k)
        yield Block(sorted(((r["_item"], r["_text"]) for r in part.distinct().collect()), key=lambda r: (str(r[0]), r[1])), window)


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, keep: list[str] | None = None, details: bool = True) -> DataFrame:
    """One row for each document row, over its whole text.

    Columns: id (and the ``keep`` columns), n_words, n_hit, n_items,
    items_sha256, contaminated, longest_match and, with ``details``, matches
    (item, place in the document, place in the item, words). Matches are windows
    that follow each other, joined; longest_match is the longest run of covered
    words without details. An item of fewer words than the window is one window;
    items without words are no windows. Null or empty text has no words and is
    never contaminated; repeated rows and null ids are kept; repeated items count
    once by their id; an empty benchmark contaminates nothing. A text of more than
    LONG_BYTES is read in pieces, so its words are never all in memory at once.
    """
    keep = keep or []
    spark, kept = docs.sparkSession, [id_col, *(c for c in keep if c != id_col)]
    names = [f"_k{i}" for i in range(len(kept))]
    here = docs.select(F.col(text_col).alias("_text"), *(F.col(c).alias(n) for c, n in zip(kept, names, strict=True)), F.lit(None).cast(STATE_DDL).alias("_state"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in here.schema)
    before = None
    for block in blocks_of(benchmark, item_col, item_text_col, window):
        if before is not None:  # one more pass: what was found so far travels with the documents
            here = written(here, "contamination")
            if before != "first":
                remove_written(before)
        before = "first" if before is None else here
        here = here.mapInArrow(tidy(pass_over(spark.sparkContext.broadcast(block), window, details)), schema)
    state = F.col("_state")
    out = [F.col(n).alias(c) for n, c in zip(names, kept, strict=True)]
    out += [state["n_words"].alias("n_words"), state["n_hit"].alias("n_hit"), F.size(state["items"]).cast("bigint").alias("n_items"), F.sha2(F.array_join(state["items"], ","), 256).alias("items_sha256"), (F.size(state["covered"]) > 0).alias("contaminated"), state["longest"].alias("longest_match")]
    return here.select(*out, *[state["runs"].alias("matches")] * details)


def pass_over(shared, window: int, details: bool):
    """One block of items against all documents; ``_state`` gathers what is found."""

    def merged(old: dict | None, n_words: int, covered: list, items: set, runs: list) -> dict:
        if old is not None:
            flat = old["covered"]
            covered, items, runs = united([*covered, *zip(flat[::2], flat[1::2], strict=True)]), items | set(old["items"]), runs + [tuple(r.values()) for r in old["runs"]]
        longest = max((r[3] for r in runs), default=0) if details else max((b - a for a, b in covered), default=0)
        return {"n_words": n_words, "n_hit": sum(b - a for a, b in covered), "covered": [x for span in covered for x in span], "items": sorted(items), "longest": longest, "runs": [dict(zip(("item", "doc_word", "item_word", "n_words"), r, strict=True)) for r in sorted(runs)]}

    def long_text(block: Block, raw: bytes) -> tuple[int, list, set, list]:
        covered, items, runs, total = [], set(), {}, 0
        for first, again, own in pieces_of(raw, window):
            ((spans, names, found),) = scan_shard(block, [own], details)
            covered += [(a + first, b + first) for a, b in spans]
            items |= names
            total = first + len(own)
            for item, at, offset, size in found:  # a run over a cut is found in two parts that overlap
                key = (item, at + first - offset)
                a, b = at + first, at + first + size
                old = [r for r in runs.get(key, []) if r[1] >= a and r[0] <= b]
                runs[key] = [r for r in runs.get(key, []) if r not in old] + [(min([a, *(r[0] for r in old)]), max([b, *(r[1] for r in old)]))]
        return total, united(covered), items, [(item, a, a - diagonal, b - a) for (item, diagonal), spans in runs.items() for a, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            raw, offsets = utf8(batch.column(0))
            olds = batch.column(batch.num_columns - 1).to_pylist()
            for a, b in doc_chunks(offsets):
                if offsets[b] - offsets[a] > LONG_BYTES:
                    found = [long_text(block, raw[offsets[k] : offsets[k + 1]].tobytes()) for k in range(a, b)]
                else:
                    split = [words(raw[offsets[k] : offsets[k + 1]].tobytes()) for k in range(a, b)]
                    found = [(len(own), *x) for own, x in zip(split, scan_shard(block, split, details), strict=True)]
                states = [merged(old, *x) for old, x in zip(olds[a:b], found, strict=True)]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(states, STATE)], batch.schema.names)

    return run


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item, item_word, n_words, doc_id, doc_word) for every benchmark suffix: its longest verbatim match in any document.

    However short the match; n_words is 0 and there is no place where not even
    the first word occurs. Of several places the one with the smallest id and
    then word is given (a null id comes last). Each shard sends its best place
    of a suffix, so what is shuffled grows with shards times suffixes. A match
    lies in one piece of a very long text.
    """
    spark, found = docs.sparkSession, None
    id_type = docs.schema[id_col].dataType.simpleString()
    for block in blocks_of(benchmark, item_col, item_text_col, WINDOW):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                raw, offsets = utf8(batch.column(1))
                ids = batch.column(0).to_pylist()
                for a, b in doc_chunks(offsets):
                    parts = [(k, first, piece) for k in range(a, b) for first, _, piece in pieces_of(raw[offsets[k] : offsets[k + 1]].tobytes(), WINDOW)]
                    lengths = np.array([len(p) for _, _, p in parts], np.int64)
                    start = np.concatenate([[0], np.cumsum(lengths + 1)])
                    codes = np.zeros(int(start[-1]), np.int64)
                    for at, (_, _, piece) in zip(start.tolist(), parts, strict=False):
                        codes[at : at + len(piece)] = np.fromiter(map(own.vocabulary.get, piece, repeat(0)), np.int64, len(piece))
                    shard = SuffixShard(codes, len(own.vocabulary))
                    _, _, _, longest, low, high = shard.find(own)
                    at = np.flatnonzero(longest)
                    rank = {k: r for r, k in enumerate(sorted(range(a, b), key=lambda k: (ids[k] is None, ids[k])))}
                    part_of = np.searchsorted(start, shard.suffixes, "right") - 1
                    order = np.array([rank[k] for k, _, _ in parts], np.int64)[part_of] * (1 << 32) + np.array([f for _, f, _ in parts], np.int64)[part_of] + shard.suffixes - start[part_of] if len(shard.suffixes) else shard.suffixes
                    back = {r: k for k, r in rank.items()}
                    spot = [int(order[x:y].min()) for x, y in zip(low[at].tolist(), high[at].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([own.names[i] for i in own.item[at].tolist()], pa.string()), pa.array(own.offset[at].astype(np.int64)), pa.array(longest[at]), pa.array([ids[back[x >> 32]] for x in spot], batch.schema.field(0).type), pa.array([x & 0xFFFFFFFF for x in spot], pa.int64())], ["item", "item_word", "n_words", "doc_id", "doc_word"])

        best = docs.select(id_col, text_col).mapInArrow(run, f"item string, item_word bigint, n_words bigint, doc_id {id_type}, doc_word bigint")
        best = best.groupBy("item", "item_word").agg(F.min(F.struct((-F.col("n_words")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id", "doc_word")).alias("m"))
        every = spark.createDataFrame(sorted({(block.names[i], o) for i, o, w in zip(block.item.tolist(), block.offset.tolist(), block.ids.tolist(), strict=True) if w}), "item string, item_word bigint")
        part = every.join(best, ["item", "item_word"], "left").select("item", "item_word", F.coalesce(-F.col("m.n"), F.lit(0)).cast("bigint").alias("n_words"), F.col("m.doc_id").alias("doc_id"), F.col("m.doc_word").alias("doc_word"))
        found = part if found is None else found.unionByName(part)
    return found


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no benchmark window, with all their columns."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    text = names[docs.columns.index(options.pop("text_col", "text"))]
    id_col = names[docs.columns.index(options.pop("id_col", "doc_id"))]
    found = find_contamination(plain, benchmark, id_col=id_col, text_col=text, keep=names, details=False, **options)
    return found.where(~F.col("contaminated")).select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))

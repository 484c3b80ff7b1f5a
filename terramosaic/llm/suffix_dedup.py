"""Removal of repeated byte strings with a column-wise multi-document BWT.

Every byte covered by a WIDTH-byte string that also starts earlier (smaller
document id, or earlier in the same document) is removed; the first place of a
string stays.

**Partition.** A window is WIDTH bytes. Its anchor is the GRAM-byte string in it
with the smallest hash (the leftmost of several), so equal windows have equal
anchors at equal offsets, and neighbouring windows mostly share one. The windows
that share one place of an anchor are a run, of at most SPAN windows and about
35 on average; no window stands twice in a run. Windows with different anchors
are never equal, so anchors split the work into independent buckets.

**Filter.** Anchors are counted (each chunk of text sends one entry an anchor),
and only runs whose anchor occurs twice are looked at further. Runs with equal
bytes need no index: the first one stays, the others are repeats as a whole;
this is done within each group of documents and again within each bucket, so a
passage or a document that is copied very often shrinks to one run before
anything is built.

**Index.** The runs that remain in a bucket form the collection. Its
Burrows-Wheeler transform is built column-wise: each round inserts one symbol
(SYMBOL bytes) of every string, from the right, at the place that the transform
itself gives, and updates the common prefixes beside the inserted suffixes.
Transform, suffix starts and common prefixes live in sequential external files
that each round reads and writes anew. Suffixes whose common prefix reaches
WIDTH are equal windows; all but the first of a group are repeats.

A collection is bounded by COLLECTION_BYTES. A bucket with more is built as
several collections, anchor by anchor. One anchor with more (a line that stands
in very many different surroundings) is split by the smallest hash that its
windows have besides the anchor, and again by the next, until the parts fit:
equal windows have equal grams, so they always meet. Equal parts shrink to one.

Documents are shuffled once by a hash of their id; the rest of the shuffles
carries packed numbers and the surviving runs.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terramosaic.llm.common import doc_chunks, text_bytes, utf8

WIDTH, GRAM = 100, 32
SPAN = WIDTH - GRAM + 1
#: Bytes of one symbol of the transform: five, doubled, and a divisor of WIDTH.
SYMBOL = 20
#: Bytes by which a string that two runs must share to be looked at may fall short of a window, and one more.
SLACK = 10
#: Text bytes of one numpy pass, of one group of documents, and of one bucket's share.
PASS_BYTES, GROUP_BYTES, BUCKET_BYTES = 1 << 20, 2 << 20, 16 << 20
#: Groups of more bytes are made only beyond so many groups: groups times buckets rows are sent.
GROUPS, LARGE_GROUP_BYTES = 256, 8 << 20
#: Bytes of one collection; a bucket with more is built as several.
COLLECTION_BYTES = 8 << 20
#: Rows with one document id are told apart by their order, in the bits above a position.
ROW_SHIFT = 40
#: Low bits of a hash that carry a place within a pass.
PLACE_MASK = np.uint64((1 << 22) - 1)
NULL_ID = np.iinfo(np.int64).min
U = np.uint64


# ---- windows and anchors ---------------------------------------------------


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at each place, by doubling."""
    with np.errstate(over="ignore"):
        h, size, factor = (raw.astype(U) + U(1)) * U(0x9E3779B97F4A7C15), 1, U(0xD6E8FEB86659FD93)
        while size < GRAM:
            h = h[:-size] * factor + h[size:]
            size, factor = 2 * size, factor * factor
        h ^= h >> U(29)
        h *= U(0xBF58476D1CE4E5B9)
        h ^= h >> U(32)
    return h


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash at each place, place of the anchor of the window at each place).

    A window's anchor is the leftmost of its smallest hashes by the high bits;
    the low bits carry the place through the sliding minimum.
    """
    grams = gram_hashes(raw)
    return grams, sliding_places(grams)


def sliding_places(grams: np.ndarray) -> np.ndarray:
    low, size = (grams & ~PLACE_MASK) | np.arange(len(grams), dtype=U), 1
    while 2 * size <= SPAN:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = SPAN - size
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    return (low & PLACE_MASK).astype(np.int64)


def spread(anchor: np.ndarray) -> np.ndarray:
    """Minima are small numbers: spread them over all 64 bits, one to one."""
    with np.errstate(over="ignore"):
        anchor = (anchor ^ (anchor >> U(31))) * U(0x94D049BB133111EB)
        return anchor ^ (anchor >> U(29))


def segments(offsets: np.ndarray, limit: int = PASS_BYTES) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(byte from, byte to, [(document, first byte)]) of passes near ``limit`` bytes; long texts are cut with WIDTH - 1 bytes of overlap."""
    for a, b in doc_chunks(offsets, limit):
        if b - a > 1 or offsets[b] - offsets[a] <= 2 * limit:
            yield int(offsets[a]), int(offsets[b]), [(k, int(offsets[k])) for k in range(a, b)]
        else:
            for at in range(int(offsets[a]), int(offsets[b]), limit):
                yield at, min(int(offsets[b]), at + limit + WIDTH - 1), [(a, at)]


def runs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (document, start byte in ``raw``, windows, anchor, place of the anchor from the start)."""
    found = []
    for low, high, docs in segments(offsets):
        if high - low < WIDTH:
            continue
        grams, chosen = anchors(raw[low:high])
        inside, doc_of = np.zeros(len(chosen) + 1, bool), []
        edge = np.ones(len(chosen) + 1, bool)
        edge[1:-1] = chosen[1:] != chosen[:-1]
        for k, first in docs:
            end = min(int(offsets[k + 1]), high)
            if end - first >= WIDTH:
                inside[first - low : end - WIDTH + 1 - low] = True
                edge[first - low] = True
                doc_of.append((first - low, k))
        if not doc_of:
            continue
        edge[1:] |= ~inside[:-1]
        start = np.flatnonzero(edge[:-1] & inside[:-1])
        stop = np.flatnonzero(inside[:-1] & (edge[1:] | ~inside[1:])) + 1
        heads = np.array(doc_of)
        found.append((heads[np.searchsorted(heads[:, 0], start, "right") - 1, 1], start + low, stop - start, spread(grams[chosen[start]]), chosen[start] - start))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U, np.int64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


# ---- column-wise construction ----------------------------------------------


class Columns:
    """The arrays of the index, in files that are read from front to back and written anew.

    A round writes files of its own and deletes those of the round before: a
    file that is cut to nothing and written again is sent to the disk at once by
    some file systems, one that is deleted soon never gets there.
    """

    def __init__(self):
        self.folder = tempfile.mkdtemp(prefix="bwt-")
        self.turn = 0

    def put(self, **arrays: np.ndarray) -> None:
        self.turn += 1
        for name, values in arrays.items():
            values.tofile(f"{self.folder}/{name}-{self.turn}")
            if self.turn > 1:
                os.remove(f"{self.folder}/{name}-{self.turn - 1}")

    def get(self, name: str, dtype: type) -> np.ndarray:
        return np.fromfile(f"{self.folder}/{name}-{self.turn}", dtype)

    def close(self) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


def in_order(key: np.ndarray, key_bits: int) -> np.ndarray:
    """Places of the keys in ascending order, equal ones by place; key and place are sorted as one number if that holds both."""
    bits = len(key).bit_length()
    if key_bits + bits > 64:
        return np.argsort(key, kind="stable")
    return (np.sort(key.astype(U) << U(bits) | np.arange(len(key), dtype=U)) & U((1 << bits) - 1)).astype(np.int64)


def symbols(text: np.ndarray) -> np.ndarray:
    """A number for the SYMBOL bytes at each place: equal and ordered as the bytes are. Five bytes first, then by doubling."""
    size = 5
    key = np.zeros(len(text) - size + 1, U)
    for k in range(size):
        key = key << U(8) | text[k : k + len(key)]
    order = in_order(key, 8 * size)
    key = key[order]
    new = key[1:] != key[:-1]
    while True:
        name = np.empty(len(order), np.int32)
        name[order] = np.concatenate([[0], np.cumsum(new)])
        if size == SYMBOL:
            return name
        order = order[order >= size] - size  # by the second half
        first = name[order]
        again = in_order(first, len(text).bit_length())
        order, first = order[again], first[again]
        second = name[order + size]
        new = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        size *= 2


def common_prefix(name: np.ndarray, a: np.ndarray, b: np.ndarray, end_of: np.ndarray) -> np.ndarray:
    """Equal leading bytes, in whole symbols, of the suffixes at places a and b, at most WIDTH; a further symbol only where all before were equal."""
    out = np.zeros(len(a), np.uint8)
    live = np.flatnonzero(name[a] == name[b])
    a, b = a[live], b[live]
    limit = np.minimum(np.minimum(end_of[a] - a, end_of[b] - b) // SYMBOL * SYMBOL, WIDTH)
    for at in range(SYMBOL, WIDTH + 1, SYMBOL):
        out[live] = at
        more = np.flatnonzero(limit > at)
        more = more[name[a[more] + at] == name[b[more] + at]]
        if not len(more):
            break
        live, a, b, limit = live[more], a[more], b[more], limit[more]
    return out


def build(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix starts in order, common prefix with the suffix before) of a collection of strings, which a byte each sets apart.

    A symbol is SYMBOL bytes, so every string takes part SYMBOL times, whole and
    without its last bytes (where WIDTH are left): together they have a suffix
    at each place that WIDTH bytes follow, at a SYMBOLth of the rounds. The
    transform is kept by symbol: beside each suffix stands the place of the rest
    behind its first symbol, which is where the transform holds that symbol. So
    a new suffix goes behind those of smaller symbols, and of its own symbol
    from earlier places.
    """
    name = symbols(text)
    first_of, end_of = np.repeat(starts, lengths + 1).astype(np.int32), np.repeat(starts + lengths, lengths + 1).astype(np.int32)
    begin = np.concatenate([(starts + lengths - k)[lengths - k >= WIDTH] for k in range(SYMBOL)]).astype(np.int32)
    m, at = len(begin), np.arange(len(begin))  # empty suffixes come first
    files = Columns()
    try:
        files.put(start=np.zeros(0, np.int32), rest=np.zeros(0, np.int32), prefix=np.zeros(0, np.uint8))
        while len(at):
            start, rest, prefix = files.get("start", np.int32), files.get("rest", np.int32), files.get("prefix", np.uint8)
            begin = begin - np.int32(SYMBOL)
            fresh = name[begin].astype(np.int64) << 32 | at
            order = np.argsort(fresh)
            fresh, begin, at = fresh[order], begin[order], at[order]
            place = np.searchsorted(name[start].astype(np.int64) << 32 | rest, fresh) + np.arange(len(fresh))
            size = len(start) + len(place)
            old = np.ones(size, bool)
            old[place] = False
            moved = np.concatenate([np.arange(m, dtype=np.int32), (np.flatnonzero(old) + m).astype(np.int32)])
            merged = {}
            for key, before, added in (("start", start, begin), ("rest", moved[rest], moved[at]), ("prefix", prefix, 0)):
                merged[key] = np.empty(size, before.dtype)
                merged[key][old], merged[key][place] = before, added
            touched = np.zeros(size + 1, bool)
            touched[place] = touched[place + 1] = True
            touched[0] = touched[size] = False
            touched = np.flatnonzero(touched)
            merged["prefix"][touched] = common_prefix(name, merged["start"][touched - 1], merged["start"][touched], end_of)
            files.put(**merged)
            more = begin - SYMBOL >= first_of[begin]
            at, begin = place[more] + m, begin[more]
        return files.get("start", np.int32).astype(np.int64), files.get("prefix", np.uint8)
    finally:
        files.close()


def repeats(strings: list[bytes], doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of every window that stands earlier somewhere in the collection."""
    lengths = np.array([len(s) for s in strings], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    suffix, prefix = build(text, starts, lengths)
    joined = prefix >= WIDTH
    member = joined.copy()
    member[:-1] |= joined[1:]
    pick = np.flatnonzero(member)
    group = np.cumsum(~joined)[pick]
    string = np.searchsorted(starts, suffix[pick], "right") - 1
    offset = suffix[pick] - starts[string]
    order = np.lexsort((place[string] + offset, doc[string], group))
    later = np.zeros(len(pick), bool)
    later[1:] = group[order][1:] == group[order][:-1]
    return string[order][later], offset[order][later]


def split_runs(strings: list[bytes], base: np.ndarray, used: list[int]) -> tuple[np.ndarray, ...]:
    """Runs of one anchor (at ``base``) cut by the gram with the smallest hash besides those at the places ``used`` from the anchor.

    Gives (string, first byte, bytes, the gram's hash, its place from the anchor).
    Equal windows have equal hashes and places.
    """
    found, at = [], 0
    ends = np.cumsum([0, *map(len, strings)])
    while at < len(strings):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + PASS_BYTES, "right")) - 1)
        first, length = ends[at:end] - ends[at], np.diff(ends[at : end + 1])
        grams = gram_hashes(np.frombuffer(b"".join(strings[at:end]), np.uint8))
        whole, spots = grams.copy(), base[at:end, None] + np.array(used)
        grams[(spots + first[:, None])[(spots >= 0) & (spots <= (length - GRAM)[:, None])]] = ~U(0)
        chosen = sliding_places(grams)
        n = len(chosen)
        steps = np.zeros(n + 2, np.int64)
        np.add.at(steps, first, 1)
        np.add.at(steps, first + length - WIDTH + 1, -1)
        inside = np.cumsum(steps)[: n + 1] > 0
        edge = np.ones(n + 1, bool)
        edge[1:-1] = chosen[1:] != chosen[:-1]
        edge[first] = True
        edge[1:] |= ~inside[:-1]
        start = np.flatnonzero(edge[:-1] & inside[:-1])
        stop = np.flatnonzero(inside[:-1] & (edge[1:] | ~inside[1:])) + 1
        string = np.searchsorted(first, start, "right") - 1
        found.append((string + at, start - first[string], stop - start + WIDTH - 1, whole[chosen[start]], chosen[start] - first[string] - base[at:end][string]))
        at = end
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def first_of_equal(strings: list[bytes], doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether each string is the first of its equals, by document and place."""
    seen, first = set(), np.zeros(len(strings), bool)
    for k in np.lexsort((place, doc)).tolist():
        if strings[k] not in seen:
            seen.add(strings[k])
            first[k] = True
    return first


def collection_repeats(strings: list[bytes], doc: np.ndarray, place: np.ndarray, anchor: np.ndarray, offset_in: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As repeats(); built as collections of at most COLLECTION_BYTES, by anchor and then by further grams of a window.

    A run that is alone with its grams has no equal window and is done. Of equal
    pieces of cut runs the first one stays and the others are repeats as wholes,
    so what shares all of its SPAN grams, that is equal windows, is one piece.
    """
    out: list[tuple[np.ndarray, np.ndarray]] = []
    pending: list[tuple[np.ndarray, ...]] = []
    total = 0

    def build() -> None:
        nonlocal pending, total
        if pending:
            string, first, size = (np.concatenate(x) for x in zip(*pending, strict=True))
            own = [strings[k][a : a + n] for k, a, n in zip(string.tolist(), first.tolist(), size.tolist(), strict=True)]
            which, offset = repeats(own, doc[string], place[string] + first)
            out.append((string[which], first[which] + offset))
        pending, total = [], 0

    every = np.arange(len(strings))
    # (string, first byte, bytes, key) of runs with the grams at the places ``used`` from the anchor in common.
    todo = [(every, np.zeros(len(every), np.int64), np.array([len(s) for s in strings], np.int64), anchor, np.zeros(len(every), np.int64), [])]
    while todo:
        string, first, size, key, spot, used = todo.pop()
        order = np.lexsort((spot, key))
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (spot[order][1:] != spot[order][:-1])
        cuts = np.flatnonzero(new)
        counts = np.diff(np.append(cuts, len(order)))
        for a, n in zip(cuts[counts > 1].tolist(), counts[counts > 1].tolist(), strict=True):
            group = order[a : a + n]
            mine = (string[group], first[group], size[group])
            own, grams = int(mine[2].sum()) + n, [*used, int(spot[group[0]])]
            if own > COLLECTION_BYTES and len(grams) < SPAN:
                cut = [strings[k][x : x + m] for k, x, m in zip(*(y.tolist() for y in mine), strict=True)]
                part, low, length, fresh, place_of = split_runs(cut, offset_in[mine[0]] - mine[1], grams)
                keep = first_of_equal([cut[k][x : x + m] for k, x, m in zip(part.tolist(), low.tolist(), length.tolist(), strict=True)], doc[mine[0][part]], (place[mine[0]] + mine[1])[part] + low)
                again = np.flatnonzero(~keep)
                windows = length[again] - WIDTH + 1
                step = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
                out.append((np.repeat(mine[0][part[again]], windows), np.repeat((mine[1][part] + low)[again], windows) + step))
                part, low, length, fresh, place_of = (x[keep] for x in (part, low, length, fresh, place_of))
                todo.append((mine[0][part], mine[1][part] + low, length, fresh, place_of, grams))
                continue
            if total + own > COLLECTION_BYTES:
                build()
            pending.append(mine)
            total += own
    build()
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


# ---- the job ---------------------------------------------------------------

PASS, KNOWN = np.uint32(1 << 31), np.uint32(1 << 30)
GROUP_MASK = np.uint32((1 << 30) - 1)


def split_by(key: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple]:
    """(key, arrays) for each distinct key."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else []
    tails = [*heads[1:], len(key)]
    for a, b in zip(heads, tails, strict=False):
        yield int(key[a]), *(x[order[a:b]] for x in arrays)


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def in_parts(rows: list[tuple], schema: pa.Schema, limit: int = 2000) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(rows), limit):
        yield batch_of(rows[a : a + limit], schema)


ENTRIES = pa.schema([("bucket", pa.int32()), ("anchors", pa.binary()), ("groups", pa.binary())])
ANSWERS = pa.schema([("grp", pa.int32()), ("anchors", pa.binary())])
RUNS = pa.schema([("bucket", pa.int32()), ("grp", pa.int32()), ("whole", pa.bool_()), ("anchors", pa.binary()), ("docs", pa.binary()), ("places", pa.binary()), ("sizes", pa.binary()), ("offsets", pa.binary()), ("bytes", pa.binary())])
CUTS = pa.schema([("grp", pa.int32()), ("docs", pa.binary()), ("begins", pa.binary()), ("ends", pa.binary())])


def ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "bigint", pa.binary(): "binary", pa.bool_(): "boolean", pa.string(): "string"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def count_entries(n_buckets: int):
    """Each chunk sends one entry an anchor to the anchor's bucket, and the other groups that hold it anywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            raw, offsets = utf8(batch.column(0))
            groups = batch.column(1).to_numpy().astype(np.uint32)
            for a, b in doc_chunks(offsets):
                doc, _, _, anchor, _ = runs(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                group = groups[a:b][doc]
                order = np.lexsort((group, anchor))
                anchor, group = anchor[order], group[order]
                head = np.ones(len(anchor), bool)
                head[1:] = anchor[1:] != anchor[:-1]
                known = ~head
                known[:-1] |= ~head[1:]
                fresh = head.copy()
                fresh[1:] |= group[1:] != group[:-1]
                bucket = (anchor % U(n_buckets)).astype(np.int64)
                spread = np.flatnonzero(fresh & ~head)
                bucket[spread] = (np.arange(len(spread)) + turn) % n_buckets
                turn += len(spread)
                group = group | np.where(known, KNOWN, 0).astype(np.uint32) | np.where(head, 0, PASS).astype(np.uint32)
                yield from in_parts([(k, x.tobytes(), y.tobytes()) for k, x, y in split_by(bucket[fresh], anchor[fresh], group[fresh])], ENTRIES)

    return run


def answer_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tell every group which of its anchors occur twice."""
    anchor, group = [], []
    for batch in batches:
        for k in range(batch.num_rows):
            anchor.append(np.frombuffer(batch.column(1)[k].as_buffer(), U))
            group.append(np.frombuffer(batch.column(2)[k].as_buffer(), np.uint32))
    if not anchor:
        return
    anchor, group = np.concatenate(anchor), np.concatenate(group)
    twice = (group & PASS) > 0
    own = np.flatnonzero(~twice)
    own = own[np.argsort(anchor[own], kind="stable")]
    equal = anchor[own][1:] == anchor[own][:-1]
    twice[own[1:][equal]] = True
    twice[own[:-1][equal]] = True
    twice |= (group & KNOWN) > 0
    yield from in_parts([(g, x.tobytes()) for g, x in split_by((group[twice] & GROUP_MASK).astype(np.int64), anchor[twice])], ANSWERS)


def sorted_group(docs: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """A group's documents by (id, text), their ids, and the rank of each among rows of one id, shifted."""
    docs = docs.sort_by([("_id", "ascending"), ("_text", "ascending")]).combine_chunks()
    ids = docs.column("_id").fill_null(int(NULL_ID)).to_numpy()
    head = np.ones(len(ids), bool)
    head[1:] = ids[1:] != ids[:-1]
    first = np.maximum.accumulate(np.where(head, np.arange(len(ids)), 0))
    return docs, ids, (np.arange(len(ids)) - first) << ROW_SHIFT


def candidate_runs(n_buckets: int):
    """The runs of a group whose anchors occur twice; equal runs of the group are settled here."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        empty = RUNS.empty_table()
        if not answers.num_rows or not docs.num_rows:
            return empty
        known = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), U) for x in answers.column("anchors")]))
        group = docs.column("grp")[0].as_py()
        docs, ids, rank = sorted_group(docs)
        raw, offsets = utf8(docs.column("_text"))
        doc, begin, n_windows, anchor, shift = runs(raw, offsets)
        at = np.minimum(np.searchsorted(known, anchor), len(known) - 1)
        keep = known[at] == anchor
        doc, begin, size, anchor, shift = doc[keep], begin[keep], n_windows[keep] + WIDTH - 1, anchor[keep], shift[keep]
        whole, place = raw.tobytes(), begin - offsets[doc] + rank[doc]
        # Ids ascend except that a null id, which sorts last here, comes before all others.
        first = first_of_equal([whole[a : a + n] for a, n in zip(begin.tolist(), size.tolist(), strict=True)], ids[doc], place)
        rows = []
        picked = np.flatnonzero(first)
        for bucket, k in split_by((anchor[picked] % U(n_buckets)).astype(np.int64), picked):
            strings = b"".join(whole[a : a + n] for a, n in zip(begin[k].tolist(), size[k].tolist(), strict=True))
            rows.append((bucket, group, False, anchor[k].tobytes(), ids[doc[k]].tobytes(), place[k].tobytes(), size[k].astype(np.int32).tobytes(), shift[k].astype(np.uint8).tobytes(), strings))
        k = np.flatnonzero(~first)
        if len(k):
            rows.append((group % n_buckets, group, True, b"", ids[doc[k]].tobytes(), place[k].tobytes(), size[k].astype(np.int32).tobytes(), b"", b""))
        return pa.Table.from_batches(list(in_parts(rows, RUNS)), RUNS) if rows else empty

    return run


def merge_cuts(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Intervals of each document, joined where they touch."""
    order = np.lexsort((begin, doc))
    doc, begin, end = doc[order], begin[order], end[order]
    heads = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    out = []
    for a, b in zip(heads, [*heads[1:], len(doc)], strict=False):
        far = np.maximum.accumulate(end[a:b])
        new = np.concatenate([[True], begin[a + 1 : b] > far[:-1]])
        first = np.flatnonzero(new)
        out.append((np.full(len(first), doc[a]), begin[a:b][first], far[np.append(first[1:], b - a) - 1]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def may_share(own: list[int], strings: list[bytes], offset_in: np.ndarray) -> np.ndarray:
    """Runs that can share a window with another one of their anchor.

    A shared window holds the anchor ``left`` bytes from its start, and so, for
    the next lower multiple of SLACK, the WIDTH - SLACK + 1 bytes that begin that
    much before the anchor: another run has the same bytes there.
    """
    size, live = WIDTH - SLACK + 1, np.zeros(len(own), bool)
    runs = [(strings[k], at) for k, at in zip(own, offset_in[own].tolist(), strict=True)]
    for left in range(0, SPAN, SLACK):
        keys = [s[at - left : at - left + size] if left <= at <= len(s) - size + left else None for s, at in runs]
        seen = Counter(keys)
        seen[None] = 0
        live |= np.fromiter((seen[key] > 1 for key in keys), bool, len(keys))
    return live


def bucket_cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a bucket's runs remove, by group: equal runs as wholes, and equal windows of different runs."""
    doc, place, group, anchor, offset_in, strings = [], [], [], [], [], []
    for batch in batches:
        rows = []
        for row in range(batch.num_rows):
            g, whole = batch.column(1)[row].as_py(), batch.column(2)[row].as_py()
            d, p = (np.frombuffer(batch.column(c)[row].as_buffer(), np.int64) for c in (4, 5))
            n = np.frombuffer(batch.column(6)[row].as_buffer(), np.int32).astype(np.int64)
            if whole:
                rows.append((g, *(x.tobytes() for x in merge_cuts(d, p, p + n))))
                continue
            data, ends = batch.column(8)[row].as_py(), np.cumsum(n)
            strings += [data[b - k : b] for b, k in zip(ends.tolist(), n.tolist(), strict=True)]
            doc.append(d)
            place.append(p)
            group.append(np.full(len(d), g))
            anchor.append(np.frombuffer(batch.column(3)[row].as_buffer(), U))
            offset_in.append(np.frombuffer(batch.column(7)[row].as_buffer(), np.uint8).astype(np.int64))
        yield from in_parts(rows, CUTS)
    if not strings:
        return
    doc, place, group, anchor, offset_in = map(np.concatenate, (doc, place, group, anchor, offset_in))
    first = first_of_equal(strings, doc, place)
    own, again = np.flatnonzero(first), np.flatnonzero(~first)
    _, inverse, counts = np.unique(anchor[own], return_inverse=True, return_counts=True)
    own = own[counts[inverse] > 1]  # a run never repeats a window of its own, so one that is alone with its anchor is done
    own = own[may_share(own.tolist(), strings, offset_in)]
    string, offset = collection_repeats([strings[k] for k in own.tolist()], doc[own], place[own], anchor[own], offset_in[own])
    size = np.array([len(strings[k]) for k in again.tolist()], np.int64)
    all_doc = np.concatenate([doc[again], doc[own][string]])
    begin = np.concatenate([place[again], place[own][string] + offset])
    end = np.concatenate([place[again] + size, place[own][string] + offset + WIDTH])
    all_group = np.concatenate([group[again], group[own][string]])
    rows = [(g, *(x.tobytes() for x in merge_cuts(d, b, e))) for g, d, b, e in split_by(all_group, all_doc, begin, end)]
    yield from in_parts(rows, CUTS)


def apply_cuts(keep_text: bool):
    """Documents without their repeats."""

    def run(docs: pa.Table, cuts: pa.Table) -> pa.Table:
        docs, ids, rank = sorted_group(docs)
        raw, offsets = utf8(docs.column("_text"))
        keep = np.ones(len(raw) + 1, np.int32)
        steps = np.zeros(len(raw) + 1, np.int32)
        if cuts.num_rows:
            d, b, e = (np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in cuts.column(c)]) for c in ("docs", "begins", "ends"))
            # A row is found by its id and its rank among rows of that id.
            first = {}
            for row, key in enumerate(zip(ids.tolist(), rank.tolist(), strict=True)):
                first[key] = int(offsets[row])
            mask = (1 << ROW_SHIFT) - 1
            base = np.array([first[key] for key in zip(d.tolist(), ((b >> ROW_SHIFT) << ROW_SHIFT).tolist(), strict=True)], np.int64)
            np.add.at(steps, base + (b & mask), 1)
            np.add.at(steps, base + (e & mask), -1)
        removed = np.cumsum(steps[:-1]) > 0
        keep = ~removed
        out = []
        for k in range(len(ids)):
            a, b = int(offsets[k]), int(offsets[k + 1])
            gone = removed[a:b]
            spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (gone[0] if b > a else 0))
            left = raw[a:b][keep[a:b]].tobytes()
            out.append((b - a, int(gone.sum()), spans, hashlib.sha256(left).hexdigest(), left if keep_text else None))
        columns = {"_id": docs.column("_id"), "n_bytes": pa.array([r[0] for r in out], pa.int64()), "n_removed": pa.array([r[1] for r in out], pa.int64()), "n_spans": pa.array([r[2] for r in out], pa.int64()), "kept_sha256": pa.array([r[3] for r in out], pa.string())}
        if keep_text:
            columns["kept"] = pa.array([r[4] for r in out], pa.binary())
        return pa.table(columns)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """One row for each row: id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes).

    Null text counts as empty; texts under WIDTH bytes lose nothing. Rows that
    repeat an id count as later places of one document, ordered by text; a null
    id comes before all others. Other columns are not read.
    """
    total = text_bytes(docs, text_col)
    spark = docs.sparkSession
    n_groups = max(1, min(GROUPS, -(-total // GROUP_BYTES)), -(-total // LARGE_GROUP_BYTES))
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"), F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(n_groups)).cast("int").alias("grp"))
    entries = own.select("_text", "grp").mapInArrow(count_entries(n_buckets), ddl(ENTRIES))
    answers = entries.repartitionById(n_buckets, F.col("bucket")).mapInArrow(answer_entries, ddl(ANSWERS))
    found = own.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(candidate_runs(n_buckets), ddl(RUNS))
    cuts = found.repartitionById(n_buckets, F.col("bucket")).mapInArrow(bucket_cuts, ddl(CUTS))
    schema = "_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * keep_text
    return own.groupBy("grp").cogroup(cuts.groupBy("grp")).applyInArrow(apply_cuts(keep_text), schema).withColumnRenamed("_id", id_col)

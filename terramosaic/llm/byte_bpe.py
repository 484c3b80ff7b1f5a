"""Byte-level BPE encoding and decoding by backtracking over longest matches.

Every token of the rank file is a byte string; mapped to Latin-1 it becomes a
string of one character a byte, which is what the Aho-Corasick automaton holds.
The encoder walks a match of the split pattern left to right with the longest
token that the automaton finds at the current byte, or the next shorter token
that this one starts with, until it is compatible with the token before it: two
tokens are compatible if merging their joined bytes gives just
these two. That is seen at the seam: merges go by rank, so the parts that touch
there grow step by step into the two tokens, and the tokens are compatible if
no pair of parts across the seam merges before one of them is used up. A sequence whose neighbours are all compatible is the sequence that
the merges produce, so the walk backtracks only where no token fits, and marks
such byte positions as dead; no position is expanded twice. Compatibility is
memoised by token pair. The automaton is asked at a byte for the longest token
in the bytes that a token can span, so the time is linear in a piece's length.

Whole texts are encoded, a column at a time. A text is first cut at single
spaces between words (a cut the split pattern always makes itself), and every
distinct word is encoded once. Words are split together, and their distinct
pattern matches go through the automaton in one pass; the seams of all of them
are then looked up in a table. Short matches whose longest tokens do not all fit
are walked side by side, a step each a round, long or few ones one by one. Memos
are bounded and never change ids.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from terramosaic.llm.common import doc_chunks, tidy, utf8

#: Memo entries before a memo is emptied: first words of texts, pattern matches and token pairs of those walked one by one.
MEMO_WORDS, MEMO_PIECES, MEMO_PAIRS = 300_000, 150_000, 250_000
#: Slots (a power of two) of the table of seams, eight bytes each; a pair takes the place of another in its slot.
SEAM_BITS = 20
#: Text bytes that are encoded together; bounds the scratch memory of a worker.
SHARE_BYTES = 2 << 20
#: So few matches are walked one by one.
FEW = 50
#: Matches of whole texts that are encoded together, or those of one text.
MATCHES = 200_000
#: Longer pieces are not kept in the memo.
MEMO_LEN = 64

_SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Runs of white space that hold a space: what follows them decides where they are cut.
SPACED = f"{_SPACE} | {_SPACE}"


def default_vocab() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Trie:
    """Tokens by their bytes, for many lookups at once: a hash table of (node, byte) with the next node."""

    def __init__(self, ranks: dict[bytes, int]):
        nodes: dict[bytes, int] = {b"": 0}
        edges = []
        for raw in ranks:
            node = 0
            for k in range(1, len(raw) + 1):
                below = nodes.get(raw[:k])
                if below is None:
                    below = nodes[raw[:k]] = len(nodes)
                    edges.append((node << 9 | raw[k - 1], below))
                node = below
        self.token = np.full(len(nodes), -1, np.int64)
        self.token[[nodes[raw] for raw in ranks]] = list(ranks.values())
        self.bits = (4 * len(edges)).bit_length()
        self.edge, self.below = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        edge, below = np.array(edges, np.int64).T
        slot = hashed(edge, self.bits)
        while len(edge):
            free = self.edge[slot] < 0
            self.edge[slot[free]] = edge[free]  # of several in one slot the last stays
            here = self.edge[slot] == edge
            self.below[slot[here]] = below[here]
            edge, below, slot = edge[~here], below[~here], (slot[~here] + 1) & ((1 << self.bits) - 1)

    def longest(self, line: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The longest token at each place of a line that ends in what no token holds; -1: none."""
        out, going, node = np.full(len(at), -1, np.int64), np.arange(len(at)), np.zeros(len(at), np.int64)
        while len(going):
            edge = node << 9 | line[at]
            slot = hashed(edge, self.bits)
            held = self.edge[slot]
            while len(other := np.flatnonzero((held != edge) & (held >= 0))):
                slot[other] = (slot[other] + 1) & ((1 << self.bits) - 1)
                held[other] = self.edge[slot[other]]
            on = np.flatnonzero(held >= 0)
            going, node, at = going[on], self.below[slot[on]], at[on] + 1
            token = self.token[node]
            out[going] = np.where(token >= 0, token, out[going])
        return out


def hashed(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


class ByteBPE:
    """Encoder and decoder for one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        self.automaton = ahocorasick.Automaton()
        for raw, token in ranks.items():
            self.bytes_of[token] = raw
            self.automaton.add_word(raw.decode("latin-1"), token)
        self.automaton.make_automaton()
        self.length = [len(raw) for raw in self.bytes_of]
        self.sizes, self.raw = np.array(self.length), pa.array(self.bytes_of, pa.large_binary())
        #: For each token the next shorter token that it starts with, or -1.
        self.shorter = [next((ranks[raw[:k]] for k in range(len(raw) - 1, 0, -1) if raw[:k] in ranks), -1) for raw in self.bytes_of]
        self.shorter_of = np.array(self.shorter)
        self.width = max(self.length)
        #: For each token the parts at its left and right edge, from a byte up to itself; None if its merges do not give it.
        self.edges: dict[int, tuple[list[int], list[int]] | None] = {}
        self.split = regex.compile(pattern).findall
        self.compatible: dict[tuple[int, int], bool] = {}
        #: Pairs of tokens (32 bits each) and, in the lowest bit, whether they are compatible.
        self.seams: np.ndarray | None = None
        self.trie: Trie | None = None
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def merged(self, raw: bytes, below: float = float("inf")) -> list[int]:
        """The merges by definition, of ranks under ``below``: lowest rank first, leftmost among equals. For short strings."""
        parts, ranks = [raw[i : i + 1] for i in range(len(raw))], self.ranks
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def edges_of(self, token: int) -> tuple[list[int], list[int]] | None:
        """Parts at the left and at the right edge of a token; None unless every part has a lower rank than what it is merged to."""
        if token in self.edges:
            return self.edges[token]
        found = None
        if self.length[token] == 1:
            found = ([token], [token])
        else:
            parts = self.merged(self.bytes_of[token], token)
            if len(parts) == 2 and max(parts) < token and (left := self.edges_of(parts[0])) and (right := self.edges_of(parts[1])):
                found = ([*left[0], token], [*right[1], token])
        self.edges[token] = found
        return found

    def seam_holds(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of two tokens gives just these two."""
        own, other = self.edges_of(left), self.edges_of(right)
        if own is None or other is None:
            return self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        a_parts, b_parts, ranks, bytes_of = own[1], other[0], self.ranks, self.bytes_of
        i = j = 0
        while True:
            a, b = a_parts[i], b_parts[j]
            a_next = a_parts[i + 1] if i + 1 < len(a_parts) else None
            b_next = b_parts[j + 1] if j + 1 < len(b_parts) else None
            across = ranks.get(bytes_of[a] + bytes_of[b])
            if across is not None:
                # Of equal ranks the leftmost goes first: a merge in the left token before the seam, the seam before one in the right.
                if (a_next is None or across < a_next) and (b_next is None or across <= b_next):
                    return False
            if a_next is None and b_next is None:
                return True
            if b_next is None or (a_next is not None and a_next <= b_next):
                i += 1
            else:
                j += 1

    def fits(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) >= MEMO_PAIRS:
                self.compatible.clear()
            known = self.compatible[key] = self.seam_holds(left, right)
        return known

    def encode_piece(self, raw: bytes) -> list[int]:
        """Ids of one pattern match, in time linear in its length."""
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        text, n, width = raw.decode("latin-1"), len(raw), self.width
        longest, length, shorter, compatible = self.automaton.iter_long, self.length, self.shorter, self.compatible
        # One pass of the automaton gives the walk that never has to go back; mostly that is all.
        path = [token for _, token in longest(text)]
        last = -1
        for token in path:
            if last >= 0 and not (compatible[last, token] if (last, token) in compatible else self.fits(last, token)):
                break
            last = token
        else:
            return path
        dead: set[int] = set()
        path = []
        at, last = 0, -1
        token = next(longest(text[:width]))[1]
        while True:
            end = at + length[token]
            if end not in dead and (last < 0 or (compatible[last, token] if (last, token) in compatible else self.fits(last, token))):
                path.append(token)
                if end == n:
                    return path
                at, last = end, token
                token = next(longest(text[at : at + width]))[1]
                continue
            token = shorter[token]
            while token < 0:  # no token fits here: this position is dead, shorten the one before
                if not path:
                    raise ValueError("the vocabulary lacks a byte of this text")
                dead.add(at)
                token = path.pop()
                at -= length[token]
                token = shorter[token]
                last = path[-1] if path else -1

    def piece(self, text: str) -> bytes:
        ids = self.pieces.get(text)
        if ids is None:
            ids = packed(self.encode_piece(text.encode()))
            if len(text) <= MEMO_LEN:
                if len(self.pieces) >= MEMO_PIECES:
                    self.pieces.clear()
                self.pieces[text] = ids
        return ids

    def fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether pairs of tokens are compatible, from the table of seams."""
        if self.seams is None:
            self.seams = np.full(1 << SEAM_BITS, -1, np.int64)
        pairs = left << 32 | right
        slots = hashed(pairs, SEAM_BITS)
        held = self.seams[slots]
        out = (held & 1).astype(bool)
        lacking = np.flatnonzero(held >> 1 != pairs)
        if len(lacking):
            new, place = np.unique(pairs[lacking], return_inverse=True)
            holds = np.fromiter(map(self.seam_holds, (new >> 32).tolist(), (new & 0xFFFFFFFF).tolist()), bool, len(new))
            self.seams[hashed(new, SEAM_BITS)] = new << 1 | holds
            out[lacking] = holds[place]
        return out

    def encode_pieces(self, pieces: pa.Array) -> pa.Array:
        """Ids of distinct pattern matches, none empty: one pass of the automaton, and a walk for those that it does not settle."""
        raw, starts = utf8(pieces)
        n, sizes = len(pieces), np.diff(starts)
        # The matches with U+0100, which no token holds, after each.
        line = np.full(len(raw) + n, 0x100, "<u2")
        line[np.arange(len(raw)) + np.repeat(np.arange(n), sizes)] = raw
        found = np.fromiter(chain.from_iterable(self.automaton.iter_long(line.tobytes().decode("utf-16-le"))), np.int64)
        ends, tokens = found[::2], found[1::2]
        bounds = np.searchsorted(ends, starts + np.arange(n + 1))
        covered = np.concatenate(([0], np.cumsum(self.sizes[tokens])))[bounds]
        open_ = np.diff(covered) != sizes
        piece = np.repeat(np.arange(n), np.diff(bounds))
        seams = np.flatnonzero(piece[1:] == piece[:-1])
        open_[piece[seams[~self.fit(tokens[seams], tokens[seams + 1])]]] = True
        ids = binary(tokens.astype("<u4"), bounds * 4)
        parts, place = [ids], np.arange(n)
        short = np.flatnonzero(open_ & (sizes <= MEMO_LEN))
        if len(short) > FEW:
            path, depth = self.walk(line, (starts[:-1] + np.arange(n))[short], sizes[short])
            place[short] = n + np.arange(len(short))
            open_[short[depth > 0]] = False
            parts.append(binary(path[np.arange(path.shape[1]) < depth[:, None]], np.append(0, np.cumsum(depth) * 4)))
        left = np.flatnonzero(open_)
        if len(left):
            place[left] = sum(map(len, parts)) + np.arange(len(left))
            parts.append(pa.array(list(map(self.piece, pieces.take(pa.array(left)).to_pylist())), pa.large_binary()))
        return pa.concat_arrays(parts).take(pa.array(place)) if len(parts) > 1 else ids

    def walk(self, line: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The walk of encode_piece for many short matches at once, a step each a round: rows of ids, and how many; 0 where left to it."""
        trie = self.trie = self.trie or Trie(self.ranks)
        length, shorter = self.sizes, self.shorter_of
        path, depth = np.empty((len(starts), int(sizes.max())), "<u4"), np.zeros(len(starts), np.int64)
        dead = np.zeros(len(line), bool)
        at, stop = starts.copy(), starts + sizes
        token = trie.longest(line, at)
        going = np.arange(len(starts))
        while len(going) > FEW:
            now = token[going]
            back, on = going[now < 0], going[now >= 0]
            if len(back):  # no token fits here: this position is dead, shorten the one before
                lost = depth[back] == 0
                if lost.any():
                    going, back = np.setdiff1d(going, back[lost]), back[~lost]
                dead[at[back]] = True
                depth[back] -= 1
                popped = path[back, depth[back]].astype(np.int64)
                at[back] -= length[popped]
                token[back] = shorter[popped]
                now = now[now >= 0]
            end = at[on] + length[now]
            fine = ~dead[end]
            seams = np.flatnonzero(fine & (depth[on] > 0))
            fine[seams] = self.fit(path[on[seams], depth[on[seams]] - 1].astype(np.int64), now[seams])
            token[on[~fine]] = shorter[now[~fine]]
            on, end = on[fine], end[fine]
            path[on, depth[on]] = now[fine]
            depth[on] += 1
            at[on] = end
            on = on[end < stop[on]]
            token[on] = trie.longest(line, at[on])
            going = going[at[going] < stop[going]]
        depth[going] = 0
        return path, depth

    def encode_matches(self, matches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pattern matches, as bytes, and where each match's ids start; at last their size."""
        distinct = pa.array(matches, pa.large_string()).dictionary_encode()
        return contents(self.encode_pieces(distinct.dictionary).take(distinct.indices)) if matches else (np.zeros(0, np.uint8), np.zeros(1, np.int64))

    def encode_alone(self, texts: list[str]) -> pa.Array:
        """Ids of texts that the pattern splits one by one; those of short texts are kept."""
        new = [text for text in dict.fromkeys(texts) if text not in self.words]
        made: dict[str, bytes] = {}
        at = 0
        while at < len(new):
            first, matches, ends = at, [], [0]
            while at < len(new) and len(matches) < MATCHES:
                matches += self.split(new[at])
                ends.append(len(matches))
                at += 1
            ids, starts = self.encode_matches(matches)
            made.update(zip(new[first:at], binary(ids, starts[ends]).to_pylist(), strict=True))
        out = pa.array([made[text] if text in made else self.words[text] for text in texts], pa.large_binary())
        if len(self.words) >= MEMO_WORDS:
            self.words.clear()
        self.words.update((text, ids) for text, ids in made.items() if len(text) <= MEMO_LEN)
        return out

    def encode_words(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words, each with the space before it."""
        # What ends in white space (the end of a text) would be cut in another way before the next word's space.
        last = pc.match_substring_regex(words, f"(^|{_SPACE})$").to_numpy(zero_copy_only=False)
        inner = words.filter(pa.array(~last))
        parts = [self.encode_alone([" " + word for word in words.filter(pa.array(last)).to_pylist()])]
        if len(inner):
            line = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(inner)], pa.int32()), inner), " ")[0].as_py()
            matches = self.split(" " + line)
            firsts = [i for i, match in enumerate(matches) if match[0] == " "]
            if len(firsts) == len(inner):
                ids, starts = self.encode_matches(matches)
                parts.append(binary(ids, starts[[*firsts, len(matches)]]))
            else:  # a pattern that leaves spaces out
                parts.append(self.encode_alone([" " + word for word in inner.to_pylist()]))
        place = np.empty(len(words), np.int64)
        place[np.argsort(~last, kind="stable")] = np.arange(len(words))
        return pa.concat_arrays(parts).take(pa.array(place))

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts, null being empty, one after another, and at which id each text starts; at last their number."""
        texts = texts.fill_null("")
        spaced = pc.match_substring_regex(texts, SPACED)
        words = pc.split_pattern(pc.if_else(spaced, "", texts), " ")
        starts = words.offsets.to_numpy()
        # The first word of a text has no space before it; a text with such runs of white space is left to the pattern as a whole.
        first = np.zeros(starts[-1], bool)
        first[starts[:-1]] = True
        openings = pc.if_else(spaced, texts, words.values.take(pa.array(starts[:-1]))).to_pylist()
        rest = words.values.filter(pa.array(~first)).dictionary_encode()
        place = np.empty(len(first), np.int64)
        place[first] = np.arange(len(texts))
        place[~first] = rest.indices.to_numpy() + len(texts)
        ids, at = contents(pa.concat_arrays([self.encode_alone(openings), self.encode_words(rest.dictionary)]).take(pa.array(place)))
        return np.frombuffer(ids, "<u4"), at[starts] // 4

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        return self.encode_texts(pa.array([text], pa.string()))[0].tobytes()

    def forget(self) -> None:
        """Empty the memos and drop the tables."""
        self.words.clear()
        self.pieces.clear()
        self.compatible.clear()
        self.seams = self.trie = None

    def decode_texts(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of texts whose ids lie one after another, and where each text's bytes start; at last their number."""
        data, at = contents(self.raw.take(pa.array(ids)))
        return data, at[starts]

    def decode(self, ids: bytes) -> bytes:
        return self.decode_texts(np.frombuffer(ids, "<u4"), np.zeros(1, np.int64))[0].tobytes()


def binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The stretches of ``data`` between bounds in bytes."""
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def contents(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of a large binary column that starts at its buffers' start."""
    bounds = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1) if len(values) else np.zeros(1, np.int64)
    data = values.buffers()[2]
    return np.frombuffer(data, np.uint8)[: bounds[-1]] if data is not None and data.size else np.zeros(0, np.uint8), bounds


_CODECS: dict[tuple[str, str], ByteBPE] = {}


def codec(vocab: str, pattern: str) -> ByteBPE:
    """One codec for each worker process and vocabulary."""
    if (vocab, pattern) not in _CODECS:
        _CODECS[vocab, pattern] = ByteBPE(load_ranks(vocab), pattern)
    return _CODECS[vocab, pattern]


def forget() -> None:
    """Empty the memos of this process; the codecs themselves (a few MB) stay."""
    for kept in _CODECS.values():
        kept.forget()


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None, pattern: str | None = None, keep_ids: bool = True) -> DataFrame:
    """One row for each input row: id, n_tokens, ids (array), ids_sha256, decoded_sha256, lossless.

    A narrow map without a shuffle; other input columns are not read. Null text
    counts as empty (no ids, digests of nothing); a null id stays null; repeated
    rows give repeated results; an empty table gives an empty one. ``keep_ids``
    False leaves the id arrays out and returns the digests alone.
    """
    vocab, pattern = vocab or default_vocab(), pattern or default_pattern()
    id_type = docs.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocab, pattern)
        for batch in batches:
            raw, bounds = utf8(batch.column(1))
            for first, stop in doc_chunks(bounds, SHARE_BYTES):
                ids, starts = bpe.encode_texts(batch.column(1).slice(first, stop - first))
                back, ends = bpe.decode_texts(ids, starts)
                ids_hex, out_hex, same = [], [], []
                for i in range(stop - first):
                    decoded = back[ends[i] : ends[i + 1]]
                    ids_hex.append(hashlib.sha256(ids[starts[i] : starts[i + 1]]).hexdigest())
                    out_hex.append(hashlib.sha256(decoded).hexdigest())
                    same.append(np.array_equal(decoded, raw[bounds[first + i] : bounds[first + i + 1]]))
                out = {id_col: batch.column(0).slice(first, stop - first), "n_tokens": pa.array(np.diff(starts)), "ids_sha256": pa.array(ids_hex, pa.string()), "decoded_sha256": pa.array(out_hex, pa.string()), "lossless": pa.array(same, pa.bool_())}
                if keep_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_pydict(out)

    schema = f"`{id_col}` {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, lossless boolean"
    return docs.select(id_col, text_col).mapInArrow(tidy(rows, forget), schema + ", ids array<int>" * keep_ids)

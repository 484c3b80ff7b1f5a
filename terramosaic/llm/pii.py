"""Personal data: exact base patterns and a character-level BiLSTM-CRF.

The tagger reads characters as classes (letters, hexadecimal letters, digits
and the marks that matter), runs an LSTM in both directions, and scores tag
sequences with CRF transitions. It is trained in numpy, by maximum likelihood
with back-propagation through time, from windows with labelled spans; the
default training set is generated from a fixed seed, so the model does not
depend on the corpus. It is labelled with more than the base patterns know:
local phone numbers, cards with other separators, addresses with a written-out
at sign, and secrets (keys and tokens), a kind of its own. Weights are a few
thousand numbers and are broadcast.

A text is cut into windows of WINDOW characters at every STRIDE, and every
window is run. Reconciling is global: the emission scores of overlapping windows
are averaged, those near a window's edge with less weight, and the whole text is
decoded once under the CRF. That decode is exact and yet confined to the runs in
which a bound on the gain of every path allows it to leave "outside", and done in
blocks: a cut between blocks is kept only if all paths that survive LOOK
characters further on run through "outside" at the cut; otherwise the two blocks
are decoded as one. A piece of a text longer than PIECE, but for the last, is
done in blocks alone.

Tagged spans join the base spans if they pass the test of their kind (digits,
parts, Luhn, length) and overlap no base span. Base spans always stay.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from terramosaic.llm.common import tidy, utf8

#: Kinds of the base patterns, and all kinds in order.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
WINDOW, STRIDE = 192, 160
HIDDEN = 12
#: Characters of a training window.
TRAINED = 96
#: Windows of one numpy pass, and characters that are decoded together.
BATCH, PIECE = 1024, 1 << 19
#: Characters of a block of the decode, in which a cut is looked for, and by which a cut must be settled.
BLOCK, CHOICE, LOOK = 448, 32, 48
#: Score by which "outside" must be ahead to be taken without a decode; far above the rounding of one.
DOUBT = 0.05
#: Tags: 0 outside, 1 + k inside a span of kind k. Spans of one kind that touch are one.
TAGS = 1 + len(KINDS)

# ---- base patterns ---------------------------------------------------------

LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A number that does not start a match cannot start one from its middle, hence the look-behind.
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: An address with a written-out at sign, and a date, which is no phone number.
OBFUSCATED = re.compile(r"[A-Za-z0-9._%+-]+\s?[\[({]\s?at\s?[\])}]\s?[A-Za-z0-9-]+.*[A-Za-z]", re.IGNORECASE).fullmatch
DATE = re.compile(r"[0-9]{4}[-./ ][0-9]{1,2}[-./ ][0-9]{1,2}|[0-9]{1,2}[-./ ][0-9]{1,2}[-./ ][0-9]{4}").fullmatch


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found outwards from each at sign in linear time."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            free = found.end()
        else:
            free = max(free, at + 1)  # no local part reaches over an at sign
        at = text.find("@", free if free > at else at + 1)
    return out


def valid(kind: str, piece: str) -> bool:
    """The test that a span of each kind must pass; a base match meets its pattern besides."""
    if kind == "email":
        return "@" in piece or bool(OBFUSCATED(piece))
    if kind == "secret":
        return len(piece) >= 16 and len(set(piece)) >= 8 and any(c.isdigit() for c in piece) and any(c.isalpha() for c in piece) and not any(c.isspace() for c in piece)
    if kind == "ip":
        parts = piece.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and int(p[-400:]) <= 255 and (len(p) < 400 or not p[:-400].strip("0")) for p in parts)
    digits = "".join(c for c in piece if "0" <= c <= "9")
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if piece.startswith("+"):
        return 9 <= len(digits) <= 15
    return 7 <= len(digits) <= 15 and len(digits) < len(piece) and not DATE(piece)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns, by start and then kind as listed."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for k, pattern in ((1, IP), (2, CARD), (3, PHONE)):
        out += [(m.start(), k, m.end()) for m in pattern.finditer(text) if valid(KINDS[k], m[0])]
    return [(a, KINDS[k], b) for a, k, b in sorted(out)]


# ---- character classes -----------------------------------------------------

MARKS = "@.-+()%_,:;/='\"|!?#&*$ \n"
LOWER, UPPER, DIGIT, OTHER_LETTER, OTHER, LOWER_HEX, UPPER_HEX = range(7)
CLASSES = 7 + len(MARKS)


@cache
def class_table() -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    table[97:123], table[65:91], table[48:58] = LOWER, UPPER, DIGIT
    table[97:103], table[65:71] = LOWER_HEX, UPPER_HEX
    table[192:] = OTHER_LETTER
    for k, mark in enumerate(MARKS):
        table[ord(mark)] = 7 + k
    return table


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points < 256, class_table()[np.minimum(points, 255)], np.uint8(OTHER_LETTER))


# ---- the tagger ------------------------------------------------------------


def slope(y: np.ndarray) -> np.ndarray:
    """Derivative of x / (1 + |x|), from its value."""
    return (1 - np.abs(y)) ** 2


class Direction:
    """One LSTM over class ids; the input weights are a row a class.

    Its squashing function is x / (1 + |x|), moved to 0..1 for the gates, since a
    tanh would take most of the time of a scan.
    """

    def __init__(self, rng: np.random.Generator):
        self.p = {"x": rng.normal(0, 0.3, (CLASSES, 4 * HIDDEN)).astype(np.float32), "h": rng.normal(0, 0.3, (HIDDEN, 4 * HIDDEN)).astype(np.float32)}
        self.p["x"][:, HIDDEN : 2 * HIDDEN] += 1.0  # forget gates start open

    def forward(self, ids: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        n, steps = ids.shape
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, tape = np.zeros((steps, n, HIDDEN), np.float32), []
        z, size, from_h = np.empty((n, 4 * HIDDEN), np.float32), np.empty((n, 4 * HIDDEN), np.float32), np.empty((n, 4 * HIDDEN), np.float32)
        half, one, columns = np.float32(0.5), np.float32(1), np.ascontiguousarray(ids.T).astype(np.intp)
        for t in range(steps):
            np.take(self.p["x"], columns[t], axis=0, out=z, mode="clip")
            np.matmul(h, self.p["h"], out=from_h)
            z += from_h
            np.abs(z, out=size)
            size += one
            z /= size
            g, gates = z[:, 3 * HIDDEN :], z[:, : 3 * HIDDEN]
            gates *= half
            gates += half
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            before_h, before_c = h, c
            c = f * c
            c += i * g
            tc = c / (one + np.abs(c))
            h = o * tc
            out[t] = h
            if keep:
                tape.append((before_h, before_c, i.copy(), f.copy(), o.copy(), g.copy(), tc))
        return out, tape

    def scan(self, ids: np.ndarray, out: np.ndarray) -> None:
        """As forward(), into ``out`` (steps, HIDDEN, windows), an even number of windows, twice as large.

        This layout is fastest for long scans. Input weights are fetched for two
        windows at once; doubled states save the halving of every gate.
        """
        n, steps = ids.shape
        h, c = np.zeros((HIDDEN, n), np.float32), np.zeros((HIDDEN, n), np.float32)
        z, size, from_h = (np.empty((4 * HIDDEN, n), np.float32) for _ in range(3))
        one, half, weights = np.float32(1), np.float32(0.5), np.ascontiguousarray(self.p["h"].T) / np.float32(2)
        pairs = np.empty((4 * HIDDEN, CLASSES, CLASSES, 2), np.float32)
        pairs[..., 0], pairs[..., 1] = self.p["x"].T[:, :, None], self.p["x"].T[:, None, :]
        x, z_pairs = pairs.view(np.float64).reshape(4 * HIDDEN, CLASSES * CLASSES), z.view(np.float64)
        columns = np.ascontiguousarray((ids[::2].astype(np.intp) * CLASSES + ids[1::2]).T)
        gates, i, f, o, g = z[: 3 * HIDDEN], *(z[k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
        for t in range(steps):
            x.take(columns[t], axis=1, out=z_pairs, mode="clip")
            np.matmul(weights, h, out=from_h)
            z += from_h
            np.abs(z, out=size)
            size += one
            z /= size
            gates += one
            c *= f
            g *= i
            c += g
            c *= half
            h = out[t]
            np.abs(c, out=h)
            h += one
            np.divide(c, h, out=h)
            h *= o

    def backward(self, ids: np.ndarray, tape: list, grad: np.ndarray) -> dict[str, np.ndarray]:
        out = {k: np.zeros_like(v) for k, v in self.p.items()}
        dh, dc = np.zeros_like(grad[0]), np.zeros_like(grad[0])
        for t in range(len(tape) - 1, -1, -1):
            before_h, before_c, i, f, o, g, tc = tape[t]
            dh = dh + grad[t]
            dc = dc + dh * o * slope(tc)
            dz = np.concatenate([dc * g * slope(2 * i - 1) / 2, dc * before_c * slope(2 * f - 1) / 2, dh * tc * slope(2 * o - 1) / 2, dc * i * slope(g)], axis=1)
            out["x"] += (np.arange(CLASSES)[:, None] == ids[None, :, t]).astype(np.float32) @ dz
            out["h"] += before_h.T @ dz
            dh, dc = dz @ self.p["h"].T, dc * f
        return out


class Tagger:
    """Bidirectional LSTM with CRF transitions."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.left, self.right = Direction(rng), Direction(rng)
        self.p = {"out": rng.normal(0, 0.3, (2 * HIDDEN, TAGS)).astype(np.float32), "bias": np.zeros(TAGS, np.float32), "move": np.zeros((TAGS, TAGS), np.float32)}

    def states(self, ids: np.ndarray, keep: bool = False):
        a, tape_a = self.left.forward(ids, keep)
        b, tape_b = self.right.forward(ids[:, ::-1], keep)
        return np.concatenate([a, b[::-1]], axis=2), tape_a, tape_b

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """Tag scores of windows, shape (windows, characters, tags)."""
        n, steps = ids.shape
        if n % 2:
            return self.emissions(np.concatenate([ids, ids[-1:]]))[:n]
        states = np.empty((steps, 2 * HIDDEN, n), np.float32)
        self.left.scan(ids, states[:, :HIDDEN])
        self.right.scan(ids[:, ::-1], states[::-1, HIDDEN:])
        return (states.transpose(0, 2, 1) @ (self.p["out"] / np.float32(2)) + self.p["bias"]).transpose(1, 0, 2)

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, list[dict[str, np.ndarray]]]:
        """Mean negative log likelihood and its gradients, by the forward-backward algorithm."""
        h, tape_a, tape_b = self.states(ids, keep=True)
        emit = (h @ self.p["out"] + self.p["bias"]).astype(np.float64)
        move = self.p["move"].astype(np.float64)
        steps, n, _ = emit.shape
        alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
        alpha[0] = emit[0]
        for t in range(1, steps):
            alpha[t] = log_sum(alpha[t - 1][:, :, None] + move[None], 1) + emit[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = log_sum(move[None] + (emit[t + 1] + beta[t + 1])[:, None, :], 2)
        total = log_sum(alpha[-1], 1)
        d_emit = np.exp(alpha + beta - total[None, :, None])
        d_move = np.zeros_like(move)
        for t in range(1, steps):
            d_move += np.exp(alpha[t - 1][:, :, None] + move[None] + (emit[t] + beta[t])[:, None, :] - total[:, None, None]).sum(axis=0)
        rows = np.arange(n)
        gold = emit[0, rows, tags[:, 0]]
        d_emit[0, rows, tags[:, 0]] -= 1
        for t in range(1, steps):
            gold += emit[t, rows, tags[:, t]] + move[tags[:, t - 1], tags[:, t]]
            d_emit[t, rows, tags[:, t]] -= 1
            np.add.at(d_move, (tags[:, t - 1], tags[:, t]), -1)
        d_emit, d_move = (d_emit / n).astype(np.float32), (d_move / n).astype(np.float32)
        dh = d_emit @ self.p["out"].T
        own = {"out": np.einsum("tnh,tnk->hk", h, d_emit), "bias": d_emit.sum(axis=(0, 1)), "move": d_move}
        a = self.left.backward(ids, tape_a, dh[:, :, :HIDDEN])
        b = self.right.backward(ids[:, ::-1], tape_b, dh[::-1, :, HIDDEN:])
        return float((total - gold).mean()), [own, a, b]

    def fit(self, ids: np.ndarray, tags: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.06, seed: int = 6) -> list[float]:
        """Adam over shuffled batches, its rate falling to a tenth; returns the mean loss of each epoch."""
        rng = np.random.default_rng(seed)
        groups = [self.p, self.left.p, self.right.p]
        first = [{k: np.zeros_like(v) for k, v in g.items()} for g in groups]
        second = [{k: np.zeros_like(v) for k, v in g.items()} for g in groups]
        losses, step = [], 0
        for _ in range(epochs):
            seen, order = [], rng.permutation(len(ids))
            for a in range(0, len(ids), batch):
                pick = order[a : a + batch]
                loss, grads = self.gradients(ids[pick], tags[pick])
                seen.append(loss)
                step += 1
                now = rate * (1 - 0.9 * step / (epochs * -(-len(ids) // batch)))
                for g, grad, m, v in zip(groups, grads, first, second, strict=True):
                    for k in g:
                        clipped = np.clip(grad[k], -1, 1)
                        m[k] = 0.9 * m[k] + 0.1 * clipped
                        v[k] = 0.999 * v[k] + 0.001 * clipped**2
                        g[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            losses.append(float(np.mean(seen)))
        return losses


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


# ---- training data ---------------------------------------------------------


def labelled_example(rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """A text with labelled spans (start, end, kind), and numbers that are none of the kinds."""

    def word(n: int = 9) -> str:
        return "".join(chr(97 + c) if c < 24 else "é" for c in rng.integers(0, 25, rng.integers(1, n)))

    def digits(n: int) -> str:
        return "".join(map(str, rng.integers(0, 10, n)))

    def card() -> str:
        body = digits(int(rng.integers(13, 16)))
        number = next(body + str(d) for d in range(10) if luhn(body + str(d)))
        gap = str(rng.choice(["", " ", "-"]))
        return gap.join(number[i : i + 4] for i in range(0, len(number), 4))

    def phone() -> str:
        shape = str(rng.choice(["+d (ddd) ddd-dddd", "(ddd) ddd-dddd", "+dd ddd ddd dddd", "+dd.dd.dddd.dddd", "ddd-ddd-dddd", "0dd dddd dddd", "0ddd/ddd ddd dd", "+dd-ddddd-ddddd", "ddd.ddd.dddd", "(0dd) dddddd"]))
        return "".join(digits(1) if c == "d" else c for c in shape)

    def email() -> str:
        local = "".join(str(rng.choice([word(), digits(2), ".", "_", word()])) for _ in range(rng.integers(1, 4))) + word()
        at, dot = (("@", "."), ("@", "."), ("@", "."), (" [at] ", " [dot] "), ("(at)", "."), (" (at) ", " (dot) "))[int(rng.integers(0, 6))]
        return f"{local.replace('é', 'e')}{at}{word().replace('é', 'e')}{dot}{('example' + dot) * int(rng.integers(0, 2))}{rng.choice(['com', 'org', 'net', 'de', 'example'])}"

    def characters(alphabet: str, low: int, high: int) -> str:
        return "".join(str(rng.choice(list(alphabet))) for _ in range(int(rng.integers(low, high))))

    def secret() -> tuple[str, str, str]:
        """What leads to the secret, the secret, and what closes it."""
        body = (lambda: hashlib.sha1(digits(9).encode()).hexdigest(), lambda: hashlib.sha256(digits(9).encode()).hexdigest().upper()[: int(rng.integers(32, 64))], lambda: characters("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz23456789", 20, 44), lambda: "AKIA" + characters("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16, 17), lambda: "sk-" + characters("abcdefghijklmnopqrstuvwxyz0123456789", 24, 40))[int(rng.integers(0, 5))]()
        name = str(rng.choice(["token", "key", "secret", "password", "api_key", "TOKEN", "Key"]))
        lead, close = ((f'{name} = "', '"'), (f"{name}='", "'"), (f"{name}: ", ""), ("", ""))[int(rng.integers(0, 4))]
        return lead, body, close

    makers = (email, lambda: ".".join(map(str, rng.integers(0, 256, 4))), card, phone)
    decoys = (lambda: digits(int(rng.integers(1, 7))), lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"{digits(2)}.{digits(2)}.{digits(4)}", lambda: f"v{digits(1)}.{digits(1)}.{digits(2)}", lambda: f"@{word()}", lambda: f"{digits(2)}:{digits(2)}", lambda: f"{digits(3)},{digits(3)}.{digits(2)}", lambda: f"({word()})", lambda: f'{word()} = "{word()}"', lambda: f"{word()}{digits(2)}", lambda: characters("abcdef", 3, 9), lambda: word().upper() + str(rng.choice(["!!", "$$$", "%%%", "***"])), lambda: "".join(word() for _ in range(4)))
    text, spans = "", []
    for _ in range(int(rng.integers(5, 14))):
        draw = rng.random()
        if draw < 0.26:
            k = int(rng.integers(0, len(KINDS)))
            lead, piece, close = secret() if KINDS[k] == "secret" else ("", makers[k](), "")
            text += lead
            spans.append((len(text), len(text) + len(piece), k))
            piece += close
        elif draw < 0.42:
            piece = decoys[int(rng.integers(0, len(decoys)))]()
        else:
            piece = word()
            piece = piece.capitalize() if rng.random() < 0.15 else piece
        text += piece + str(rng.choice([" ", " ", " ", ", ", ". ", "\n", " | "]))
    return text, spans


def windows_of(length: int, window: int = WINDOW, stride: int = STRIDE) -> range:
    return range(0, max(1, length - (window - stride)), stride)


def training_windows(examples: list[tuple[str, list[tuple[int, int, int]]]]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of TRAINED characters, with their tags."""
    ids, tags, size = [], [], TRAINED
    for text, spans in examples:
        own, tag = classes(text), np.zeros(len(text) + size, np.int64)
        for a, b, k in spans:
            tag[a:b] = 1 + k
        for at in windows_of(len(text), size, 3 * size // 4):
            ids.append(padded(own[at : at + size], size))
            tags.append(tag[at : at + size])
    return np.array(ids), np.array(tags)


def padded(ids: np.ndarray, size: int) -> np.ndarray:
    """Filled with line ends."""
    return np.concatenate([ids, np.full(size - len(ids), 7 + MARKS.index("\n"), ids.dtype)])


@cache
def default_tagger(n: int = 1000, seed: int = 3) -> Tagger:
    """Trained on ``n`` generated texts."""
    rng, tagger = np.random.default_rng(seed), Tagger()
    tagger.fit(*training_windows([labelled_example(rng) for _ in range(n)]))
    return tagger


# ---- detection -------------------------------------------------------------


def edge_weights() -> np.ndarray:
    """How much a window says about each of its characters: little near its edges, where context is missing."""
    place = np.arange(WINDOW)
    return np.minimum(np.minimum(place, WINDOW - 1 - place) + 1, WINDOW - STRIDE).astype(np.float32)


def emissions_of(tagger: Tagger, pieces: list[tuple[np.ndarray, int, int]]) -> tuple[np.ndarray, list[int]]:
    """(tag scores, where each piece starts in them) of the characters low..high of some texts (classes, low, high): window scores, averaged.

    A window has STRIDE rows of scores, and a piece as many more, into which its last window reaches.
    """
    places, spots, own_ids, size = [], [], [], 0
    for own, low, high in pieces:
        first = max(0, (low - WINDOW) // STRIDE + 1) * STRIDE
        n = len(range(first, min(windows_of(len(own))[-1], high - 1) + 1, STRIDE))
        own_ids.append(padded(own[first : first + (n - 1) * STRIDE + WINDOW], (n + 1) * STRIDE))
        places.append(np.arange(size, size + n))
        spots.append(size * STRIDE + low - first)
        size += n + 1
    place, weight, both = np.concatenate(places), edge_weights(), WINDOW - STRIDE
    total = weight[:both] + weight[STRIDE:]
    after, before = (np.isin(place + step, place)[:, None] for step in (-1, 1))  # whether a window comes after, before another
    front, back = np.where(after, weight[:both] / total, np.float32(1)), np.where(before, weight[STRIDE:] / total, np.float32(1))
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate(own_ids), WINDOW)[::STRIDE]
    score = np.zeros((size, STRIDE, TAGS), np.float32)
    for a in range(0, len(place), BATCH):
        own = place[a : a + BATCH]
        emit = tagger.emissions(windows[own])
        emit[:, :both] *= front[a : a + BATCH, :, None]
        emit[:, STRIDE:] *= back[a : a + BATCH, :, None]
        score[own, both:] = emit[:, both:STRIDE]
        score[own, :both] += emit[:, :both]
        score[own + 1, :both] += emit[:, STRIDE:]
    return score.reshape(-1, TAGS), spots


def doubtful(tagger: Tagger, score: np.ndarray, bounds: list[tuple[int, int, bool, bool]]) -> list[list[tuple[int, int, bool, bool]]]:
    """The runs (low, high, begins, free) of whole pieces to which the decode can be confined, for each piece.

    A path that leaves "outside" for some characters gains at most the sum of
    their largest leads over "outside", with the best moves there, on and back.
    Where no such stretch around a character gains anything, the best path is
    outside. A run has one such character at either end, unless the piece begins
    or ends there.
    """
    move = tagger.p["move"].astype(np.float64) - float(tagger.p["move"][0, 0])
    there, on, back = move[0, 1:].max(), move[1:, 1:].max(), move[1:, 0].max()
    lead = score[:, 1].copy()
    for tag in range(2, TAGS):
        np.maximum(lead, score[:, tag], out=lead)
    lead -= score[:, 0]
    out = []
    for low, high, begins, _ in bounds:
        low += not begins  # already outside
        gain = lead[low:high] + on
        if not len(gain):
            out.append([])
            continue
        gain[0] += max(0.0, -there) * begins  # no move leads to the first character, or from the last
        gain[-1] += max(0.0, -back)
        gain = np.concatenate([[0.0], np.cumsum(gain)])
        most = np.maximum.accumulate(gain[:0:-1])[::-1] - np.minimum.accumulate(gain[:-1]) + (there + back - on)
        edge = np.flatnonzero(np.diff(most > -DOUBT, prepend=False, append=False)).tolist()
        end = high - low
        out.append([(low + max(a - 1, -(not begins)), low + min(b + 1, end), begins and a == 0, b == end) for a, b in zip(edge[::2], edge[1::2], strict=True)])
    return out


def blocks_in(score: np.ndarray, low: int, high: int, closed: set[int]) -> list[int]:
    """Where the decode of low..high may be cut: near every BLOCK characters, where "outside" leads most."""
    cuts, at = [], low + BLOCK
    end = high - LOOK
    while at + CHOICE <= end:
        lead = score[at : at + CHOICE, 0] - score[at : at + CHOICE, 1:].max(axis=1)
        spot = at + int(lead.argmax())
        if spot not in closed:
            cuts.append(spot)
        at += BLOCK
    return cuts


def best_paths(tagger: Tagger, score: np.ndarray, rows: list[tuple[int, int, int, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """(tags by row, whether the cut at its end is settled) of rows (start, cut, end, begins).

    A row that does not begin its text starts outside; a row whose cut is its end
    ends there freely, any other must be outside at its cut, and is read on to its end.
    """
    start, cut, end = (np.array([r[k] for r in rows]) for k in range(3))
    begins, free, move = np.array([r[3] for r in rows]), cut == end, tagger.p["move"].astype(np.float32)
    length, n = end - start, len(rows)
    steps, shortest = int(length.max()), int(length.min())
    outside = np.full((TAGS, 1), -1e9, np.float32)
    outside[0] = 0
    value = np.empty((steps, TAGS, n), np.float32)  # best score of each tag at each step
    value[0] = score[start].T + np.where(begins, np.float32(0), outside)
    option, stays = np.empty((TAGS, n), np.float32), np.empty((steps, n), bool)  # stays: outside comes from outside
    to = [m[:, None] for m in move]
    for t in range(1, steps):
        best, before = value[t], value[t - 1]
        np.add(before[0], to[0], out=best)
        alone = best[0].copy()
        for tag in range(1, TAGS):
            np.add(before[tag], to[tag], out=option)
            np.maximum(best, option, out=best)
        np.equal(best[0], alone, out=stays[t])
        best += score.take(start + t, axis=0, mode="clip").T
        if t >= shortest:
            best[:, t >= length] = before[:, t >= length]
    every, spot = np.arange(n), np.where(free, length - 1, cut - start)
    survivor = np.broadcast_to(np.arange(TAGS), (n, TAGS)).copy()
    path, first_spot = np.zeros((steps, n), np.int8), int(spot.min())
    path[spot, every] = np.where(free, value[steps - 1].argmax(axis=0), 0)
    for t in range(steps - 1, 0, -1):
        beyond = np.flatnonzero((t < length) & (t > spot))
        if len(beyond):
            came = (value[t - 1][:, beyond].T[:, None, :] + move.T[None]).argmax(axis=2)  # (row, to)
            survivor[beyond] = np.take_along_axis(came, survivor[beyond], axis=1)
        moved = np.flatnonzero((path[t] != 0) | ~stays[t] if t <= first_spot else ((path[t] != 0) | ~stays[t]) & (t <= spot))
        if len(moved):  # all others were outside before as well
            path[t - 1, moved] = (value[t - 1][:, moved] + move[:, path[t, moved]]).argmax(axis=0)
    path = path.T
    return path, free | (survivor == 0).all(axis=1)


def decoded(tagger: Tagger, score: np.ndarray, bounds: list[tuple[int, int, bool, bool]]) -> tuple[np.ndarray, list[int]]:
    """(tag of each character, where each piece is settled to) under the CRF, for pieces (low, high, begins, final) of ``score``.

    The result is that of one decode of a whole piece. A piece that is not final
    is settled to its last cut; 0 characters if there is none. A final piece is
    decoded where it can be other than outside.
    """
    tags, settled = np.zeros(len(score), np.int8), [high if final else low for low, high, _, final in bounds]
    whole = [k for k, b in enumerate(bounds) if b[3]]
    runs = [(None, *run) for found in doubtful(tagger, score, [bounds[k] for k in whole]) for run in found]
    runs += [(k, low, high, begins, False) for k, (low, high, begins, final) in enumerate(bounds) if not final]
    closed: list[set[int]] = [set() for _ in runs]
    todo = list(range(len(runs)))
    while todo:
        rows = []
        for r in todo:
            unsettled, low, high, begins, free = runs[r]
            starts = [low, *blocks_in(score, low, high, closed[r])]
            rows += [(a, b, min(high, b + LOOK), begins and a == low, r) for a, b in zip(starts, starts[1:], strict=False)]
            if unsettled is None:
                rows.append((starts[-1], high if free else high - 1, high, begins and len(starts) == 1, r))
            else:
                settled[unsettled] = starts[-1]
        again: set[int] = set()
        rows.sort(key=lambda row: row[2] - row[0])
        for a in range(0, len(rows), BATCH):
            part = rows[a : a + BATCH]
            path, ok = best_paths(tagger, score, [row[:4] for row in part])
            for (low, cut, end, _, r), own, sure in zip(part, path, ok.tolist(), strict=True):
                stop = end if cut == end else cut
                tags[low:stop] = own[: stop - low]
                if not sure and not (runs[r][0] is None and cut == runs[r][2] - 1):  # the last character of a run is outside
                    closed[r].add(cut)
                    again.add(r)
        todo = sorted(again)
    return tags, settled


def spans_in(tags: np.ndarray) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the runs of one tag."""
    edge = np.flatnonzero(np.diff(tags, prepend=0, append=0))
    return [(a, KINDS[tags[a] - 1], b) for a, b in zip(edge.tolist(), edge[1:].tolist(), strict=False) if tags[a]]


def tags_of(tagger: Tagger, texts: list[str]) -> list[np.ndarray]:
    """The best tags of whole texts. Texts are decoded together up to PIECE characters, a longer one piece after piece."""
    out: list[np.ndarray] = [np.zeros(len(t), np.int8) for t in texts]
    own = [classes(t) for t in texts]
    short = [k for k, t in enumerate(texts) if 0 < len(t) <= PIECE]
    for a, b in in_batches([texts[k] for k in short], PIECE):
        score, spots = emissions_of(tagger, [(own[k], 0, len(own[k])) for k in short[a:b]])
        tags, _ = decoded(tagger, score, [(x, x + len(own[k]), True, True) for k, x in zip(short[a:b], spots, strict=True)])
        for k, x in zip(short[a:b], spots, strict=True):
            out[k] = tags[x : x + len(own[k])]
    for k, text in enumerate(texts):
        at, size = 0, PIECE
        while len(text) > PIECE and at < len(text):
            high = min(len(text), at + size)
            score, (x,) = emissions_of(tagger, [(own[k], at, high)])
            tags, (end,) = decoded(tagger, score, [(x, x + high - at, at == 0, high == len(text))])
            out[k][at : at + end - x] = tags[x:end]
            size = PIECE if end > x else 2 * size
            at += end - x
    return out


def tagged_spans(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, str, int]]]:
    """Spans of the tagger for each whole text."""
    return [spans_in(tags) for tags in tags_of(tagger, texts)]


def apart(spans: list[tuple[int, str, int]], base: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """The spans, which do not overlap each other, that overlap no base span either; both by start, one pass."""
    out, at, reach = [], 0, 0
    for a, kind, b in spans:
        while at < len(base) and base[at][0] < b:
            reach = max(reach, base[at][2])
            at += 1
        if reach <= a:
            out.append((a, kind, b))
    return out


def admitted(kind: str, piece: str) -> str | None:
    """The kind under which a tagged span is taken, or None. A number of fewer digits than any card has is tried as a phone number."""
    if kind == "card" and sum("0" <= c <= "9" for c in piece) < 12:
        kind = "phone"
    return kind if valid(kind, piece) else None


def all_spans(tagger: Tagger, texts: list[str]) -> list[tuple[list, list]]:
    """(base spans, all spans) for each text."""
    out = []
    for text, tagged in zip(texts, tagged_spans(tagger, texts), strict=True):
        base = base_spans(text)
        extra = apart([(a, found, b) for a, kind, b in tagged if (found := admitted(kind, text[a:b]))], base)
        out.append((base, sorted(base + extra, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))))
    return out


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


def in_batches(texts: list[str], limit: int) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + max(WINDOW, len(texts[end])) <= limit):
            size += max(WINDOW, len(texts[end]))  # a window is run whole
            end += 1
        yield at, end
        at = end


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """One row for each row: id, a count a kind, base_sha256, spans; offsets are code points, end exclusive.

    A map without a shuffle over whole texts. Null or empty text has no spans
    (base_sha256 is that of nothing); repeated rows and null ids are kept; other
    columns are not read. Counts and base_sha256 are of the base spans; ``spans``
    has those of the tagger as well. Memory is bounded by a text and PIECE
    characters of scores, however long the text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger or default_tagger())  # fixed size
    id_type = docs.schema[id_col].dataType.simpleString()
    nothing = hashlib.sha256(b"").hexdigest()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            counts = np.zeros((len(BASE_KINDS), batch.num_rows), np.int64)
            digests, listed = [nothing] * batch.num_rows, [""] * batch.num_rows
            texts = [raw[x:y].tobytes().decode() for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            for a, b in in_batches(texts, PIECE):
                for k, (base, spans) in zip(range(a, b), all_spans(model, texts[a:b]), strict=True):
                    for _, kind, _ in base:
                        counts[BASE_KINDS.index(kind), k] += 1
                    if spans:
                        digests[k], listed[k] = hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts), pa.array(digests, pa.string()), pa.array(listed, pa.string())], [id_col, *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])

    schema = f"`{id_col}` {id_type}, " + ", ".join(f"n_{k} bigint" for k in BASE_KINDS) + ", base_sha256 string, spans string"
    return docs.select(id_col, text_col).mapInArrow(rows, schema)


def redacted(text: str, spans: list[tuple[int, str, int]]) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first names the whole."""
    out, done = [], 0
    for a, kind, b in spans:
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join(out) + text[done:]


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", tagger: Tagger | None = None) -> DataFrame:
    """The documents, all columns, with personal data replaced; ``length_col`` follows the new text.

    Texts without personal data, null included, are left exactly as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger or default_tagger())
    at = docs.columns.index(text_col)
    names = [f"_c{i}" for i in range(len(docs.columns))]
    counted = docs.columns.index(length_col) if length_col in docs.columns else None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            raw, offsets = utf8(batch.column(at))
            texts = [raw[x:y].tobytes().decode() for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            fresh: dict[int, str] = {}
            for a, b in in_batches(texts, PIECE):
                for k, text, (_, spans) in zip(range(a, b), texts[a:b], all_spans(model, texts[a:b]), strict=True):
                    if spans:
                        fresh[k] = redacted(text, spans)
            columns = list(batch.columns)
            if fresh:
                mask = np.zeros(batch.num_rows, bool)
                mask[list(fresh)] = True
                order = sorted(fresh)
                columns[at] = pa.compute.replace_with_mask(columns[at], pa.array(mask), pa.array([fresh[k] for k in order], columns[at].type))
                if counted is not None:
                    columns[counted] = pa.compute.replace_with_mask(columns[counted], pa.array(mask), pa.array([len(fresh[k]) for k in order], columns[counted].type))
            yield pa.RecordBatch.from_arrays(columns, names)

    plain = docs.toDF(*names)
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields, strict=True))
    return plain.mapInArrow(tidy(rows), schema).toDF(*docs.columns)

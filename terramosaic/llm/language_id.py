"""Language identification with error-correcting output codes.

Every language gets a binary codeword; one binary n-gram classifier a bit tells
the two halves of the languages apart. A classifier is the mean log odds of a
text's hashed byte trigrams under the two halves, scaled by the root of their
number and calibrated. Decoding adds up the classifiers' logistic losses
against every codeword, each weighted by how reliable that bit was in training,
and takes the nearest codeword; a text whose two nearest codewords are about
equally near is flagged as ambiguous.

The model is fitted on a bounded sample of labelled rows: of each language the
``SAMPLE_ROWS`` distinct texts with the smallest hash (fewer where there are
very many languages, at most ``SAMPLE_TOTAL`` in all). Whole texts are read; the
executors turn each into its trigram counts, and only these reach the driver.
Prediction covers whole texts and is a map without a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terramosaic.llm.common import doc_chunks, tidy, utf8

#: Bounds of the training sample: distinct texts of a language, and of all languages.
SAMPLE_ROWS, SAMPLE_TOTAL = 500, 20_000
#: Hash buckets of the trigrams.
BUCKETS = 4096
#: A score below this is ambiguous.
CERTAIN = 0.6
UNDETERMINED = "und"
#: Text bytes scored at once (a row of weights is gathered for each byte).
SCORE_BYTES = 1 << 20


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """A +-1 row a class: all splits up to 6 classes, beyond that the best of some random codes."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        splits = np.arange(1, 2 ** (n - 1))
        return np.array([[-1.0] * len(splits), *[[1.0 if s >> k & 1 else -1.0 for s in splits] for k in range(n - 1)]])
    rng, best, best_gap = np.random.default_rng(seed), None, -1
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], size=(n, int(np.ceil(10 * np.log2(n)))))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        gap = int((code.shape[1] - (code @ code.T - 2 * code.shape[1] * np.eye(n)).max()) / 2)
        if gap > best_gap:
            best, best_gap = code, gap
    return best


def trigram_buckets(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hash bucket of the trigram at each byte; BUCKETS where fewer than three bytes are left in the text."""
    low = raw.astype(np.uint32)
    low[(raw >= 65) & (raw <= 90)] += 32
    accent = np.zeros(len(raw), bool)
    accent[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    low[accent] += 32  # upper-case Latin-1 letters
    out = np.full(len(raw), BUCKETS, np.int64)
    if len(raw) > 2:
        gram = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
        out[:-2] = (gram * np.uint32(2654435761)) >> np.uint32(20)
    ends = offsets[1:][np.diff(offsets) > 0]
    starts = offsets[:-1][np.diff(offsets) > 0]
    out[np.maximum(ends - 1, starts)] = BUCKETS
    out[np.maximum(ends - 2, starts)] = BUCKETS
    return out


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of rows offsets[i]..offsets[i + 1]; zero for an empty segment."""
    out = np.zeros((len(offsets) - 1, values.shape[1]))
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, offsets[:-1][full], axis=0)
    return out


def trigram_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Trigrams of each text by bucket, as a row of BUCKETS counts; a long text is counted in pieces."""
    out = np.zeros((len(offsets) - 1, BUCKETS), np.int64)
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        for at in range(a, b, SCORE_BYTES):
            part = raw[at : min(b, at + SCORE_BYTES + 2)]
            grams = trigram_buckets(part, np.array([0, len(part)]))
            out[k] += np.bincount(grams[: max(0, len(part) - 2)], minlength=BUCKETS + 1)[:BUCKETS]
    return out


class Model:
    """Codewords, trigram log odds a bit, calibration and bit weights."""

    def __init__(self, texts: list[bytes], labels: list[str]):
        """Fit on texts at hand."""
        self.fit(trigram_counts(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])), labels)

    @classmethod
    def of_counts(cls, counts: np.ndarray, labels: list[str]) -> Model:
        model = cls.__new__(cls)
        model.fit(counts, labels)
        return model

    def fit(self, counts: np.ndarray, labels: list[str]) -> None:
        """``counts`` has a row of trigram counts for each labelled text."""
        self.languages = sorted(set(labels))
        self.code = codewords(len(self.languages))
        bits = self.code.shape[1] if len(self.languages) else 1
        self.weights = np.zeros((BUCKETS + 1, bits), np.float32)
        self.scale, self.reliability = np.ones(bits), np.ones(bits)
        if len(self.languages) < 2:
            return
        label = np.array([self.languages.index(x) for x in labels])
        total = np.stack([counts[label == k].sum(axis=0) for k in range(len(self.languages))]).astype(np.float64)
        share = (total + 0.5) / (total.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
        for b in range(bits):
            self.weights[:BUCKETS, b] = np.log(share[self.code[:, b] > 0].mean(axis=0)) - np.log(share[self.code[:, b] < 0].mean(axis=0))
        margin = (counts @ self.weights[:BUCKETS].astype(np.float64)) / np.sqrt(np.maximum(counts.sum(axis=1, keepdims=True), 1))
        sign = self.code[label]
        for _ in range(200):  # logistic calibration: one positive slope a bit
            slope = (-sign * margin / (1 + np.exp(np.clip(sign * margin * self.scale, -50, 50)))).mean(axis=0)
            self.scale = np.clip(self.scale - slope / (np.abs(margin).mean(axis=0) ** 2 + 1e-9), 1e-3, 20.0)
        error = (np.sign(margin) != sign).mean(axis=0)
        self.reliability = np.maximum(1 - 2 * error, 1e-3)

    def margins(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        grams = trigram_buckets(raw, offsets)
        n = segment_sums((grams < BUCKETS).astype(np.float32)[:, None], offsets)
        return segment_sums(np.take(self.weights, grams, axis=0), offsets) / np.sqrt(np.maximum(n, 1))

    def predict(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, score) of each text."""
        values = np.clip(self.margins(raw, offsets) * self.scale, -40, 40)
        losses = np.log1p(np.exp(-values[:, None, :] * self.code[None])) @ self.reliability
        near = np.exp(losses.min(axis=1, keepdims=True) - losses)
        return losses.argmin(axis=1), 1 / near.sum(axis=1)


def smallest_hashes(rows: DataFrame, size: int) -> list[tuple[str, int]]:
    """(label, hash) of the ``size`` smallest distinct hashes of each label.

    A task passes on at most ``size`` hashes a label, whatever the number of
    rows or copies, so neither a shuffle nor the driver sees more than that.
    """

    def bottom(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, np.ndarray] = {}
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            codes, hashes = coded.indices.to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for k, label in enumerate(coded.dictionary.to_pylist()):
                own = np.unique(np.concatenate([kept.get(label, hashes[:0]), hashes[codes == k]]))
                kept[label] = own[:size]
        for label, own in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(own), pa.string()), pa.array(own)], ["label", "h"])

    ranked = rows.select("label", "h").mapInArrow(bottom, "label string, h bigint").distinct()
    ranked = ranked.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("h"))).where(F.col("k") <= size)
    return sorted((r["label"], r["h"]) for r in ranked.select("label", "h").collect())


def train(docs: DataFrame, usable: Column, text_col: str = "text", label_col: str = "lang") -> Model:
    """Fit on the distinct texts with the smallest hashes, at most SAMPLE_ROWS a language, of the ``usable`` rows.

    Rows without text or label take no part; a text that is copied very often
    counts once. Without a labelled row nothing is learned, and with one
    language that language is always predicted.
    """
    spark = docs.sparkSession
    rows = docs.where(usable & F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    picked = smallest_hashes(rows, SAMPLE_ROWS)
    n_labels = len({label for label, _ in picked})
    if n_labels * SAMPLE_ROWS > SAMPLE_TOTAL:
        size, seen = max(1, SAMPLE_TOTAL // n_labels), Counter()
        picked = [p for p in picked if (seen.update([p[0]]) or seen[p[0]]) <= size]
    wanted = spark.sparkContext.broadcast(frozenset(picked))  # at most SAMPLE_TOTAL pairs
    hashes = spark.createDataFrame([(h,) for h in sorted({h for _, h in picked})], "h bigint")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[str, int]] = set()
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for k, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if key not in wanted.value or key in done:
                    continue
                done.add(key)
                own = trigram_counts(raw[offsets[k] : offsets[k + 1]], np.array([0, offsets[k + 1] - offsets[k]]))[0]
                at = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int64()), pa.array([at.astype("<u2").tobytes()], pa.binary()), pa.array([own[at].astype("<i8").tobytes()], pa.binary())], ["label", "h", "at", "n"])

    near = rows.join(F.broadcast(hashes), "h", "left_semi").select("label", "text", "h")  # bounded by SAMPLE_TOTAL
    counted = near.mapInArrow(count, "label string, h bigint, at binary, n binary").dropDuplicates(["label", "h"])
    found = sorted((r["label"], r["h"], r["at"], r["n"]) for r in counted.collect())
    counts = np.zeros((len(found), BUCKETS), np.int64 if len(found) <= 4000 else np.int32)
    for k, (_, _, at, n) in enumerate(found):
        counts[k, np.frombuffer(at, "<u2")] = np.frombuffer(n, "<i8")
    return Model.of_counts(counts, [label for label, _, _, _ in found])


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns with lang_pred, score (0 to 1) and ambiguous, one row for each row.

    Null text, or text without a letter, is ``und`` with score 0; so is every
    text where no language was learned. A text of under three bytes has no
    trigram and gets the first language with an even score; so does, by name,
    the first of several equally near codewords. Repeated rows get the same
    answer; only the text decides.
    """
    keep = docs.columns if keep is None else keep
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # fixed size: buckets x bits

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            raw, offsets = utf8(batch.column(0))
            classes, scores = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for a, b in doc_chunks(offsets, SCORE_BYTES):
                classes[a:b], scores[a:b] = predict_chunk(fitted, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            known = has_letter(raw, offsets) if fitted.languages else np.zeros(batch.num_rows, bool)
            names = [fitted.languages[c] if ok else UNDETERMINED for c, ok in zip(classes.tolist(), known.tolist(), strict=True)]
            scores = np.where(known, scores, 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(names, pa.string()), pa.array(scores), pa.array(known & (scores < CERTAIN))], [*keep, "lang_pred", "score", "ambiguous"])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "lang_pred string, score double, ambiguous boolean"])
    return docs.select(F.col(text_col).alias("_text"), *keep).mapInArrow(tidy(rows), schema)


def predict_chunk(model: Model, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As Model.predict, with one very long text scored in pieces whose sums are added."""
    if len(raw) <= 2 * SCORE_BYTES or len(offsets) > 2:
        return model.predict(raw, offsets)
    total, n = np.zeros(model.weights.shape[1]), 0
    for at in range(0, len(raw) - 2, SCORE_BYTES):
        part = raw[at : at + SCORE_BYTES + 2]
        grams = trigram_buckets(part, np.array([0, len(part)]))[: len(part) - 2]
        total += np.take(model.weights, grams, axis=0).sum(axis=0, dtype=np.float64)
        n += len(grams)
    values = np.clip(total / np.sqrt(max(n, 1)) * model.scale, -40, 40)
    losses = np.log1p(np.exp(-values[None, :] * model.code)) @ model.reliability
    return np.array([losses.argmin()]), np.array([1 / np.exp(losses.min() - losses).sum()])


def has_letter(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text holds a letter; the few without an ASCII letter are decoded."""
    low = raw | 32
    count = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122))])
    out = count[offsets[1:]] > count[offsets[:-1]]
    for k in np.flatnonzero(~out & (np.diff(offsets) > 0)).tolist():
        out[k] = any(map(str.isalpha, raw[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace")))
    return out


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``, is 0; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def identify_documents(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Train on the rows that are not held out, predict all rows."""
    model = train(docs, ~held_out(id_col) & F.col(id_col).isNotNull())
    return identify(docs, model, keep=[id_col]).withColumn("held_out", held_out(id_col))

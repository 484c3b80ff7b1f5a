"""op2 and op8 against the libraries themselves."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from terramosaic.llm import byte_bpe, token_binary
from terramosaic.llm.common import shared_path


@pytest.fixture(scope="module")
def reference():
    ranks = byte_bpe.load_ranks(byte_bpe.default_vocab())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(token_binary.default_vocab())


def texts(n, alphabet, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def test_byte_bpe_equals_the_library(reference):
    codec = byte_bpe.codec(byte_bpe.default_vocab(), byte_bpe.default_pattern())
    pieces = [t.decode("utf-8", "ignore") for t in codec.bytes_of]
    for text in [*texts(3000, list("ab  \n\t'sé🙂7#--aaaa ñ\u2003\u00a0ст"), 1), *texts(3000, pieces, 2)]:
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text), text
        assert codec.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 60_000, "ab" * 20_000, "é" * 20_000, "#-" * 20_000])
def test_byte_bpe_is_exact_on_very_long_pieces(reference, text):
    codec = byte_bpe.codec(byte_bpe.default_vocab(), byte_bpe.default_pattern())
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == reference.encode_ordinary(text)


def test_seams_agree_with_the_merges():
    codec = byte_bpe.codec(byte_bpe.default_vocab(), byte_bpe.default_pattern())
    rnd, tokens = random.Random(6), sorted(codec.ranks.values())
    for _ in range(20_000):
        left, right = rnd.choice(tokens), rnd.choice(tokens[: rnd.choice([300, 5000, len(tokens)])])
        assert codec.seam_holds(left, right) == (codec.merged(codec.bytes_of[left] + codec.bytes_of[right]) == [left, right]), (left, right)
    twins = [codec.ranks[c * 2] for c in (b"a", b" ", b"-", b"=") if c * 2 in codec.ranks]
    for left in twins:
        for right in tokens[:2000]:
            assert codec.seam_holds(left, right) == (codec.merged(codec.bytes_of[left] + codec.bytes_of[right]) == [left, right])


def test_irregular_ranks():
    """A vocabulary in which a part has a higher rank than what it is merged to."""
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"ab": 257, b"bc": 258, b"cab": 259}
    codec = byte_bpe.ByteBPE(ranks, r"[a-z]+")
    for n in range(1, 7):
        for k in range(3**n):
            text = "".join("abc"[k // 3**i % 3] for i in range(n))
            whole = codec.ranks.get(text.encode())
            assert np.frombuffer(codec.encode(text), "<u4").tolist() == ([whole] if whole is not None else codec.merged(text.encode())), text


@pytest.mark.parametrize("unit", ["é", "a", "ab", "xyzzy"])
def test_byte_bpe_is_linear(unit):
    import time

    codec = byte_bpe.codec(byte_bpe.default_vocab(), byte_bpe.default_pattern())
    took = []
    for n in (100_000, 1_000_000):
        raw = (unit * n).encode()[:n]
        raw = raw if len(unit.encode()) == len(unit) else raw[: n // 2 * 2]
        began = time.process_time()
        ids = codec.encode_piece(raw)
        took.append(time.process_time() - began)
        assert b"".join(codec.bytes_of[i] for i in ids) == raw
    assert took[1] < 25 * took[0] + 1


def test_byte_bpe_documents(reference, odd_documents, no_documents):
    rows = byte_bpe.encode_documents(odd_documents).collect()
    want = sorted((r["doc_id"] or -1, hashlib.sha256(np.array(reference.encode_ordinary(r["text"] or ""), "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in odd_documents.collect())
    assert sorted((r["doc_id"] or -1, r["ids_sha256"], r["decoded_sha256"]) for r in rows) == want
    assert all(r["lossless"] and len(r["ids"]) == r["n_tokens"] for r in rows)
    assert byte_bpe.encode_documents(no_documents).collect() == []


def test_words_equal_the_library(library):
    own = token_binary.encoder(token_binary.default_vocab())
    alphabet = [*"ab  \n\t'sé🙂7#-Aİ\u0301 ñß.,ÉÖÿÐ\u2003стΣ\x1f\x0b×÷ªº", "<|endoftext|>", "the", "ing, ", "Über. ", "<|startoftext|>", "<|endoftext|", "|>"]
    for text in texts(4000, alphabet, 3):
        assert np.frombuffer(next(iter(own.texts([text]))), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000])
def test_planes_round_trip(kind, n):
    values = np.random.default_rng(n).integers(0, 2**32, n).astype("<u4")
    if n or kind == "byte":
        assert (token_binary.from_planes(token_binary.to_planes(values, kind), n, "<u4", kind) == values).all()


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_token_files(spark, library, odd_documents, kind):
    docs = odd_documents  # whole texts, the very long ones too
    rows = token_binary.tokens_round_trip(spark, docs, keep_ids=True, kind=kind).orderBy("start").collect()
    source = sorted(docs.select("doc_id", "text").collect(), key=lambda r: -(10**9) if r["doc_id"] is None else r["doc_id"])
    assert [r["doc_id"] for r in rows] == [r["doc_id"] for r in source]
    start = 0
    for r in rows:
        assert r["start"] == start and r["ids"][-1] == token_binary.END_ID
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        start += r["n_tokens"]
    want = sorted((r["doc_id"] or -1, library.encode(r["text"] or "", add_special_tokens=False).ids + [2]) for r in source)
    assert sorted((r["doc_id"] or -1, r["ids"]) for r in rows) == want


def test_token_files_of_nothing(spark, no_documents):
    assert token_binary.tokens_round_trip(spark, no_documents).collect() == []


def test_many_shards_and_blocks(spark, monkeypatch, documents):
    monkeypatch.setattr(token_binary, "SHARD_IDS", 5000)
    folder = shared_path(spark, "t")
    manifest = token_binary.write_tokens(documents, folder)
    rows = token_binary.read_tokens(manifest, folder, keep_ids=False).orderBy("doc_id").collect()
    assert [r["start"] for r in rows[1:]] == [r["start"] + r["n_tokens"] for r in rows[:-1]]


def test_workers_keep_no_memo_for_other_operators(spark, documents):
    """A worker process that has encoded serves other operators next: it must not go on holding the memos."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from terramosaic.llm.common import tidy

    def memos(batches):
        from terramosaic.llm import byte_bpe as here

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"codecs": pa.array([len(here._CODECS)]), "held": pa.array([sum(len(c.words) + len(c.pieces) + len(c.compatible) for c in here._CODECS.values())])})

    byte_bpe.encode_documents(documents.repartition(8)).agg(F.sum("n_tokens")).collect()
    rows = spark.range(0, 64, 1, 8).mapInArrow(tidy(memos), "codecs bigint, held bigint").collect()
    assert max(r["codecs"] for r in rows) == 1 and {r["held"] for r in rows} == {0}


def invented(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(["tion", "ber", "é", "sch", "a", "nt", "ü", "que", "th", "er", "ñ"]) for _ in range(rnd.randint(2, 9))) + rnd.choice(["", ",", ".\nUn", "###"]) for _ in range(n)]


def test_new_words_are_encoded_together(reference, monkeypatch):
    """Words that no memo holds cost most of the time if each is walked by itself."""
    codec = byte_bpe.ByteBPE(byte_bpe.load_ranks(byte_bpe.default_vocab()), byte_bpe.default_pattern())
    alone, walk = [], codec.encode_piece
    monkeypatch.setattr(codec, "encode_piece", lambda raw: alone.append(raw) or walk(raw))
    text = " ".join(invented(20_000, 1))
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == reference.encode_ordinary(text)
    assert len(alone) < 500


def test_white_space_that_one_token_spans():
    """A run of white space is cut by what follows it, so a space inside a run is no cut."""
    ranks = {bytes([b]): b for b in range(256)} | {b"\n ": 256, b" a": 257, b"\xc2\xa0": 258, b" \xc2\xa0": 259}
    codec = byte_bpe.ByteBPE(ranks, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("white", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ["a\n \na", "a\n ", "a\n", "\n a", "a   a", "a  ", "a a\n a\n \n a", *texts(2000, list("a  \n "), 4)]:
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode_ordinary(text), text


def test_byte_bpe_columns(reference, monkeypatch):
    """Many texts at once, odd ones among them, with tables so small that pairs drive each other out."""
    import pyarrow as pa

    monkeypatch.setattr(byte_bpe, "SEAM_BITS", 3)
    monkeypatch.setattr(byte_bpe, "FEW", 0)
    monkeypatch.setattr(byte_bpe, "MATCHES", 50)
    monkeypatch.setattr(byte_bpe, "MEMO_WORDS", 20)
    codec = byte_bpe.ByteBPE(byte_bpe.load_ranks(byte_bpe.default_vocab()), byte_bpe.default_pattern())
    pieces = [t.decode("utf-8", "ignore") for t in codec.bytes_of]
    rows = [None, "", " ", "\n", "a", *texts(300, list("ab \n\t'sé🙂7#--aaaa ñ  ст"), 8), *texts(200, pieces, 9), " ".join(invented(3000, 2)), None, "a" * 3000 + " é " + "ab#" * 500, "x  y" * 100, ""]
    for column in (pa.array(rows), pa.array(rows).slice(7, 400), pa.array(rows[:0], pa.string()), pa.array([None, None], pa.string())):
        ids, starts = codec.encode_texts(column)
        back, ends = codec.decode_texts(ids, starts)
        values = [v or "" for v in column.to_pylist()]
        assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)] == [reference.encode_ordinary(v) for v in values]
        assert [back[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [v.encode() for v in values]


def test_pattern_that_leaves_spaces_out():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abc": 257, b"bc": 258}
    codec = byte_bpe.ByteBPE(ranks, r"[a-z]+")
    assert codec.decode(codec.encode("abc ab bc, cab")) == b"abcabbccab"


def test_batches_are_encoded_in_bounded_shares(spark, reference, documents, monkeypatch):
    """A worker's scratch memory does not grow with the batch; rows stay with their ids."""
    sizes, encode_texts = [], byte_bpe.ByteBPE.encode_texts
    monkeypatch.setattr(byte_bpe.ByteBPE, "encode_texts", lambda self, texts: sizes.append(texts.nbytes) or encode_texts(self, texts))
    kept = []
    monkeypatch.setattr(byte_bpe, "tidy", lambda rows, forget: kept.append(rows) or rows)
    monkeypatch.setattr(byte_bpe, "SHARE_BYTES", 20_000)
    byte_bpe.encode_documents(documents)
    (batch,) = documents.select("doc_id", "text").toArrow().combine_chunks().to_batches()
    found = {r["doc_id"]: r for part in kept[0](iter([batch])) for r in part.to_pylist()}
    longest = max(len((t or "").encode()) for t in batch.column(1).to_pylist())
    assert len(sizes) > 5 and max(sizes) < 25_000 + longest
    assert all(found[i]["ids"] == reference.encode_ordinary(t or "") and found[i]["lossless"] for i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True))

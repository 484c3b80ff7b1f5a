"""op1, op4, and the pipeline."""

import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terramosaic.llm import ann, chat


def test_recall_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    ids = np.array([r["vec_id"] for r in rows])
    x = np.array([r["embedding"] for r in rows], float)
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        score[q] = -np.inf
        best = ids[np.lexsort((ids, -score))[:20]]
        own = sorted(got[ids[q]])
        assert [k for k, _, _ in own] == list(range(1, 21))
        assert all(s == pytest.approx(float(x[np.flatnonzero(ids == v)[0]] @ x[q]), abs=1e-12) for _, v, s in own)
        hit, total = hit + len(set(best) & {v for _, v, _ in own}), total + 20
    assert hit / total >= 0.95


def test_nearest_of_odd_vectors(spark):
    nan, inf = math.nan, math.inf
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (1, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit("clash"))
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 1, 1.0), (0, 3, 2, 1.0), (0, 4, 20, 0.0), (20, 1, 1, 2.0), (20, 2, 1, 2.0), (20, 3, 2, 2.0), (20, 4, 0, 0.0)]
    assert ann.nearest(df.limit(0), F.lit(True)).collect() == []


def test_repeated_query_rows_are_one_query(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 6)))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    plain = [tuple(r) for r in ann.nearest(df, F.col("vec_id") == 20).orderBy("rank").collect()]
    assert [r[1] for r in plain] == list(range(1, 21)) and len({r[2] for r in plain}) == 20
    again = df.unionByName(df.where("vec_id = 20")).unionByName(df.where("vec_id = 20"))
    assert [tuple(r) for r in ann.nearest(again, F.col("vec_id") == 20).orderBy("rank").collect()] == plain
    few = ann.nearest(df, F.col("vec_id") == 20, k=50, depth=3).collect()
    assert len(few) == 50


def brute(ids, x, queries, k=20):
    out = {}
    for q in queries:
        score = x @ x[q]
        score[q] = -np.inf
        best = np.argpartition(-score, k)[: k + 1]
        out[int(ids[q])] = set(ids[best[np.lexsort((ids[best], -score[best]))[:k]]].tolist())
    return out


@pytest.mark.parametrize("clusters", [0, 300])
def test_recall_over_many_blocks(spark, clusters):
    """100,000 vectors with and without structure; with structure most cells are passed over."""
    import pyarrow as pa

    n, dim, rng = 100_000, 32, np.random.default_rng(7)
    x = rng.normal(size=(n, dim))
    if clusters:
        x = rng.normal(size=(clusters, dim))[rng.integers(0, clusters, n)] * 2 + 0.4 * x
    x = x.astype(np.float32).astype(float)
    flat = pa.FixedSizeListArray.from_arrays(pa.array(x.astype(np.float32).ravel()), dim).cast(pa.list_(pa.float32()))
    df = spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(n)), "embedding": flat})).repartition(8)
    cells = ann.Cells(x[:8000], n, 20)
    assert cells.probes < len(cells.centroids) // 4 if clusters else cells.probes > len(cells.centroids) // 4
    want = brute(np.arange(n), x, range(0, n, 500))
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 500 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert sum(len(want[q] & got[q]) for q in want) / (20 * len(want)) >= 0.93
    if clusters:
        few = {}
        for r in ann.nearest(df, F.col("vec_id") % 5000 == 0, exact=True).collect():
            few.setdefault(r["query_id"], set()).add(r["vec_id"])
        assert few == {q: want[q] for q in few} and len(few) == 20


def odd_vectors(kind, n, dim):
    """Vectors that a sample says little about: lengths far apart, close copies by the thousand, queries unlike the rest, one common direction."""
    rng = np.random.default_rng(19)
    x = rng.normal(size=(n, dim))
    if kind == "lengths":
        x *= rng.pareto(1.5, (n, 1)) + 0.01
    elif kind == "copies":
        x[: n // 2] = x[0] + 0.001 * x[: n // 2]
    elif kind == "queries":
        x[1:] = 3 * np.eye(dim)[rng.integers(0, 8, n - 1)] + 0.05 * x[1:]
        x[::500] = -rng.normal(size=(len(x[::500]), dim))
    elif kind == "direction":
        x = 0.1 * x + 5
    return x.astype(np.float32).astype(float)


@pytest.mark.parametrize("kind", ["lengths", "copies", "queries", "direction"])
def test_none_of_the_nearest_is_missed(spark, kind):
    import pyarrow as pa

    n, dim = 20_000, 24
    x = odd_vectors(kind, n, dim)
    flat = pa.FixedSizeListArray.from_arrays(pa.array(x.astype(np.float32).ravel()), dim).cast(pa.list_(pa.float32()))
    df = spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(n)), "embedding": flat})).repartition(4)
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 500 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert got == brute(np.arange(n), x, range(0, n, 500))


def test_rows_with_a_querys_own_id_crowd_nothing_out(spark):
    rows = [(20, [1.0, 1.0]) for _ in range(100)] + [(30, [1.0, 1.0]) for _ in range(3)] + [(i, [1.0, 1.0]) for i in range(31, 60)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = [r["vec_id"] for r in ann.nearest(df, F.col("vec_id") == 20).orderBy("rank").collect()]
    assert got == [30, 30, 30, *range(31, 48)]


def test_a_crowded_cell_is_spread_over_blocks():
    homes = ann.blocks_of({0: 10, 1: 20, 2: 9000, 5: 30, 6: 4090}, 4096)
    assert homes == {0: (0, 1), 1: (0, 1), 2: (1, 3), 5: (4, 1), 6: (5, 1)}


def test_many_equal_vectors_give_the_smallest_ids(spark):
    rows = [(i, [1.0, 1.0, 0.5, 0.25]) for i in range(1000)] + [(2000, [1.0, 0.9, 0.5, 0.25])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = [r["vec_id"] for r in ann.nearest(df, F.col("vec_id") == 2000).orderBy("rank").collect()]
    assert got == list(range(20))


CONV = "conv_id bigint, turn bigint, role string, text string"


def test_chat_round_trip(spark):
    odd = ["", None, "\\", "\\0", "\\1###", "####", "</turn>", "</turn>\n", "<</turn>>", "a: b", "é\n\n🙂", "### user: x</turn>\n", "\\</turn>\\0\\"]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(odd)]
    rows += [(2, 0, "assistant", "x"), (3, 0, "a:b</turn>\n###\\", "y"), (3, 1, None, "z"), (None, None, "user", "n"), (4, 5, "user", "b"), (4, 5, "user", "a"), (4, 5, "user", "a")]
    df = spark.createDataFrame(rows, CONV).withColumn("segments", F.lit(1))
    out = chat.format_conversations(df)
    parsed = {r["conv_id"]: [(t["role"], t["text"]) for t in r["t"]] for r in out.select("conv_id", chat.parse_formatted(F.col("formatted")).alias("t")).collect()}
    assert parsed[1] == [("user" if i % 2 == 0 else "assistant", t or "") for i, t in enumerate(odd)]
    assert parsed[3] == [("a:b</turn>\n###\\", "y"), ("", "z")]
    assert parsed[4] == [("user", "a"), ("user", "a"), ("user", "b")] and parsed[None] == [("user", "n")]
    dig = {r["conv_id"]: r for r in chat.digests(out).collect()}
    loss = "".join(t or "" for i, t in enumerate(odd) if i % 2)
    assert dig[1]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and dig[1]["loss_chars"] == len(loss)
    assert {k: r["valid"] for k, r in dig.items()} == {1: True, 2: False, 3: False, 4: False, None: True}
    assert chat.format_conversations(df.limit(0)).collect() == []


TEMPLATES = {
    "angle": chat.Template(open="<|im_start|>", after_role="\n", close="<|im_end|>\n", controls=("<|im_start|>", "<|im_end|>"), role_controls=("\n",)),
    "marks": chat.Template(open="[TURN(", after_role=")*] ", close="$^.+?\\E\\Q{2}|\n", controls=("[TURN(", "$^.+?"), role_controls=(")*]",)),
    "many": chat.Template(open="<a>", after_role="=", close="</a>", controls=("<a>", "</a>", *(f"<{k}>" for k in range(14)), "0", "1"), role_controls=("=", "9")),
}


@pytest.mark.parametrize("name", TEMPLATES)
def test_chat_round_trip_with_other_templates(spark, name):
    template = TEMPLATES[name]
    marks = [template.open, template.after_role, template.close, *template.controls, *template.role_controls, "\\", "\\Q", "\\E", "$1", "0", "a"]
    rnd = __import__("random").Random(2)
    texts = ["".join(rnd.choice(marks) for _ in range(rnd.randint(0, 6))) for _ in range(120)]
    rows = [(i // 4, i % 4, rnd.choice(["user", "assistant", template.close + "x", texts[i]]), t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, CONV)
    out = chat.format_conversations(df, template)
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["t"]] for r in out.select("conv_id", chat.parse_formatted(F.col("formatted"), template).alias("t")).collect()}
    assert got == {c: [(r, t) for k, _, r, t in rows if k == c] for c in got} and len(got) == 30
    loss = {r["conv_id"]: r["l"] for r in out.select("conv_id", chat.loss_text(F.col("segments"), template).alias("l")).collect()}
    assert loss == {c: "".join(t for k, _, r, t in rows if k == c and r == "assistant") for c in loss}


@pytest.mark.parametrize("change", [{"close": "\n"}, {"close": "x</turn>"}, {"controls": ("aa", "###"), "close": "aab"}, {"after_role": " "}, {"open": "> "}, {"controls": ("###", "</turn>", "\\n")}, {"controls": ("###", "</turn>", "")}])
def test_templates_that_cannot_be_read_back_are_refused(change):
    with pytest.raises(ValueError):
        chat.Template(**change)


def test_the_machine_names_the_failing_turn(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "assistant", "c"), (1, 3, "user", "d"), (1, 4, "assistant", "e"), (2, 0, "system", "s"), (2, 1, "user", "u"), (3, 0, "assistant", "x")]
    df = spark.createDataFrame(rows, CONV)
    out = {r["conv_id"]: (r["state"], r["error_turn"], r["valid"]) for r in chat.format_conversations(df).collect()}
    assert out == {1: ("error", 2, False), 2: ("user", None, True), 3: ("error", 0, False)}
    masked = chat.format_conversations(df, chat.Template(mask_errors=True))
    assert {r["conv_id"]: r["l"] for r in masked.select("conv_id", chat.loss_text(F.col("segments")).alias("l")).collect()} == {1: "b", 2: "", 3: ""}


def test_a_long_conversation(spark):
    n = 20_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text </turn> "), F.col("id")).alias("text"))
    r = chat.digests(chat.format_conversations(df)).first()
    want = "".join(f"text </turn> {i}" for i in range(1, n, 2))
    assert r["n_turns"] == n and r["valid"] and r["loss_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def test_chat_plan_is_native(spark, sf):
    from terramosaic.llm.queries import QUERIES

    plan = QUERIES["op4_chat_format"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pipeline_against_plain_stages(spark, sf):
    """Every stage on its own input, by plain code: what goes, what stays, what the last returns."""
    import re

    import public_tokenizers
    import tiktoken

    import corpus_pipeline as p
    from terramosaic.llm import byte_bpe, pii
    from test_near_copies import plain_kept
    from tests_llm_plain import LOWER, WORD

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    own = {r["doc_id"]: r["text"] for r in docs.collect()}
    stages = dict(p.STAGES)
    assert [n for n, _ in p.STAGES] == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "pii", "byte_bpe"]
    kept = stages["language_id"](spark, docs, sf)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {k for k, t in own.items() if any(map(str.isalpha, t))}
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    unique = {rows[i][0] for i in plain_kept(rows)}
    step = stages["simhash_near_dedup"](spark, kept, sf)
    assert step.columns == docs.columns and {r["doc_id"] for r in step.collect()} == unique
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = WORD.findall(r["text"].translate(LOWER))
        windows |= {tuple(w[a : a + 10]) for a in range(max(1, len(w) - 9))}
    clean = set()
    for k in unique:
        w = WORD.findall(own[k].translate(LOWER))
        if not any(tuple(w[a : a + 10]) in windows for a in range(len(w) - 9)):
            clean.add(k)
    step = stages["benchmark_decontamination"](spark, step, sf)
    assert {r["doc_id"] for r in step.collect()} == clean
    step = stages["pii"](spark, step, sf)
    for r in step.collect():
        spans = pii.base_spans(own[r["doc_id"]])
        assert len(r["text"]) == r["n_chars"] or not spans
        assert not pii.base_spans(r["text"])
        if not re.search("[0-9@]", own[r["doc_id"]]):
            assert r["text"] == own[r["doc_id"]]
    texts = {r["doc_id"]: r["text"] for r in step.collect()}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(byte_bpe.default_vocab()), special_tokens={})
    want = {k: hashlib.sha256(np.array(library.encode_ordinary(t), "<u4").tobytes()).hexdigest() for k, t in texts.items()}
    assert {r["doc_id"]: r["ids_sha256"] for r in p.run(spark, sf).collect()} == want
    assert json.dumps(sorted(want)) == json.dumps(sorted(clean))


def test_pipeline_stages_on_odd_rows(spark, odd_documents, no_documents, sf):
    import corpus_pipeline as p

    for name, stage in p.STAGES:
        for docs in (odd_documents, no_documents):
            out = stage(spark, docs, sf)
            out.collect()
            if name != "byte_bpe":
                assert out.columns == docs.columns

"""The pipeline's near-duplicate stage against all pairs of shingle sets."""

import random

from terramosaic.llm import near_copies


def plain_kept(rows):
    """Row numbers that stay, by comparing all pairs."""
    sets = [near_copies.shingles((t or "").encode()) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 5 * len(x & y) >= 4 * len(x | y):
                parent[find(i)] = find(j)
    best = {}
    for i, (k, _) in enumerate(rows):
        best.setdefault(find(i), []).append((k, i))
    return {min(v)[1] for v in best.values()}


def test_stage_drops_near_copies(spark):
    import corpus_pipeline as p

    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    for g in range(12):
        base = rnd.choices(vocabulary, k=rnd.choice((30, 120, 400)))
        for _ in range(8):
            own = list(base)
            for at in rnd.sample(range(len(own)), rnd.randint(0, 1 + len(own) // 40)):
                own[at] = rnd.choice(vocabulary)
            rows.append((len(rows), " ".join(own)))
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"] for r in dict(p.STAGES)["simhash_near_dedup"](spark, docs, "").collect()}
    assert got == {rows[i][0] for i in plain_kept(rows)}
    assert len(got) < 60


def test_stage_over_sf(spark, documents):
    import corpus_pipeline as p

    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = {r["doc_id"] for r in dict(p.STAGES)["simhash_near_dedup"](spark, documents, "").collect()}
    assert got == {rows[i][0] for i in plain_kept(rows)}


def test_rows_of_one_id_stay_apart(spark, odd_documents, no_documents):
    body = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(1, body), (1, other), (2, body + " x"), (2, other), (3, "a b"), (3, "a b"), (4, None), (5, " "), (None, body), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["text"] or "") for r in near_copies.keep_one(docs).collect())
    assert got == sorted([(1, body), (1, other), (3, "a b"), (4, ""), (-1, body), (-1, "")])
    kept = near_copies.keep_one(odd_documents)
    assert kept.columns == odd_documents.columns and kept.where("doc_id is null").count() == 2
    assert near_copies.keep_one(no_documents).collect() == []


def test_sketches_bound_the_overlap():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (1, 30, 700, 990, 1010, 3000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([rng.choice(a, max(1, n * 3 // 4), replace=False), rng.integers(0, 2**63, n // 3).astype(np.uint64)]))
        got = near_copies.most_shared(near_copies.sketch(a), near_copies.sketch(b))
        assert len(np.intersect1d(a, b)) <= got <= min(len(a), len(b))


def test_shingles_counted_together():
    """All that stand in several of the texts, in little more than the one array."""
    import tracemalloc
    from collections import Counter

    import numpy as np

    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 3000, int(n)).astype(np.uint64)) for n in rng.integers(0, 400, 50)]
    want = {h: n for h, n in Counter(int(h) for own in sets for h in own).items() if n > 1}
    for most in (1, 100_000):  # a text larger than the array makes it grow
        together = near_copies.Together(most)
        assert together.common()[0].tolist() == []
        for _ in range(2):
            for own in sets:
                together.add(own)
            found, n = together.common()
            assert dict(zip(found.tolist(), n.tolist(), strict=True)) == want
    tracemalloc.start()
    together = near_copies.Together(1 << 20)
    for k in range(16):
        together.add(np.arange(k << 16, (k + 1) << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    assert together.full(1) and together.common()[0].tolist() == []
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * (8 << 20)

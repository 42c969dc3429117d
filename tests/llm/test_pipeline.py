"""The pipeline's stages, each against a plain version on its own input."""

import random

import numpy as np

import corpus_pipeline
from marksmith.llm import pii, simhash_dedup
from tests.llm.test_operators import plain_components

SF = "/root/testdata/sf0.01"


def shingles(text, k=5):
    w = text.encode().lower().split()
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "pii", "packing"]
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    clean = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").collect()}
    kept = stages["toxicity"](spark, docs, SF).cache()
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and len(toxic & ids) <= 0.15 * len(toxic) and len(clean - ids) <= 0.05 * len(clean)

    single = stages["exact_dedup"](spark, kept, SF).cache()
    best = {}
    for r in kept.collect():
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert {(r.text, r.doc_id) for r in single.collect()} == set(best.items()) and single.columns == docs.columns

    apart = stages["near_dedup"](spark, single, SF).cache()
    rows = [(r.doc_id, shingles(r.text)) for r in single.collect()]
    edges = [(a, b) for i, (a, x) in enumerate(rows) for b, y in rows[:i] if (n := len(x & y)) and n >= simhash_dedup.SIMILARITY * (len(x) + len(y) - n)]
    least = plain_components(edges)
    want = {d for d, _ in rows if least.get(d, d) == d}
    got = {r.doc_id for r in apart.collect()}
    gone, missed, wrong = {d for d, _ in rows} - want, got - want, want - got
    print(f"{len(gone)} near copies, {len(missed)} missed, {len(wrong)} wrongly dropped")
    assert apart.columns == docs.columns and not wrong and len(missed) <= 0.1 * len(gone)

    covered = stages["pii"](spark, apart, SF).cache()
    before = {r.doc_id: r for r in apart.collect()}
    for r in covered.collect():
        assert r.text == pii.redact(before[r.doc_id].text) and r.n_chars == len(r.text) and (r.lang, r.source) == (before[r.doc_id].lang, before[r.doc_id].source)
    assert covered.columns == docs.columns and covered.schema == apart.schema

    packed = stages["packing"](spark, covered, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == got


def test_near_copies_among_texts_that_share_a_passage(spark):
    """Pairs of similarity 0.83 whose blocks are crowded by texts of similarity 0.42, which are to stay."""
    rng = random.Random(7)
    words = [f"w{k}" for k in range(20000)]
    passage = rng.choices(words, k=150)
    rows = [(k, passage + rng.choices(words, k=100)) for k in range(4000)]
    copies = [(10000 + k, own[:-22] + rng.choices(words, k=22)) for k, own in rows[:4000:80]]
    docs = spark.createDataFrame([(k, " ".join(own)) for k, own in rows + copies], "doc_id long, text string")
    kept = {r.doc_id for r in simhash_dedup.drop_near_duplicates(docs).select("doc_id").collect()}
    assert {k for k, _ in rows} <= kept
    found = sum(k not in kept for k, _ in copies)
    print(f"{found} of {len(copies)}")
    assert found >= 0.9 * len(copies), f"{found} of {len(copies)}"


def test_near_copies_among_texts_of_one_template(spark):
    """1,000 texts filled from a template of 600 words (alike to about 0.72) and a near copy of each (about 0.93): held against all pairs."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(5000)]
    template = rng.choices(words, k=600)

    def filled(base, slots):
        made = list(base)
        for k in rng.sample(range(len(made)), slots):
            made[k] = rng.choice(words)
        return made

    texts = [filled(template, 10) for _ in range(1000)]
    texts += [filled(t, 4) for t in texts]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(8)
    sets = [shingles(" ".join(t)) for t in texts]
    number = {x: k for k, x in enumerate(set().union(*sets))}
    held = np.zeros((len(texts), len(number)), dtype=np.float32)
    for k, x in enumerate(sets):
        held[k, [number[y] for y in x]] = 1
    shared, size = held @ held.T, held.sum(axis=1)
    close = shared >= simhash_dedup.SIMILARITY * (size[:, None] + size[None, :] - shared)
    edges = [(a, b) for a, b in zip(*(x.tolist() for x in np.nonzero(np.triu(close, 1))))]
    least = plain_components(edges)
    gone = {k for k in range(len(texts)) if least.get(k, k) != k}
    got = set(range(len(texts))) - {r.doc_id for r in simhash_dedup.drop_near_duplicates(docs).select("doc_id").collect()}
    print(f"{len(edges)} links, {len(gone)} to go, {len(got & gone)} found, {len(got - gone)} wrong")
    assert len(gone) >= 1000 and not got - gone and len(got & gone) >= 0.9 * len(gone)


def test_open_pairs_equal_brute_force():
    rng = np.random.default_rng(3)
    for sizes, parts in (([1] * 700, 1), ([600, 1, 2, 300, 1, 5], 1), ([600, 1, 2, 300, 1, 5], 2), ([900], 1), ([1], 1)):
        ties = np.repeat(np.arange(len(sizes)), sizes)
        n = len(ties)
        fps, apart = rng.integers(0, 1 << 63, (n, 8), dtype=np.uint64), (np.arange(n) % parts if parts > 1 else np.zeros(n, dtype=int))
        limits = [(4, 122), (8, 246)]
        got = [(i, j) for a, b in simhash_dedup.open_pairs(ties, fps, apart, limits) for i, j in zip(a.tolist(), b.tolist())]
        ok = np.ones((n, n), dtype=bool)
        for words, bits in limits:
            ok &= np.bitwise_count(fps[:, None, :words] ^ fps[None, :, :words]).sum(axis=2, dtype=np.int64) <= bits
        ok &= (ties[:, None] < ties) & ((apart[:, None] != apart) if parts > 1 else True)
        assert len(got) == len(set(got)) and set(got) == set(zip(*(x.tolist() for x in np.nonzero(ok))))

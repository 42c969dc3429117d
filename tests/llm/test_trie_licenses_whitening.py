"""Conversation trie, license scan and whitening against plain versions, with odd rows among the input."""

import hashlib
import random
import zlib
from collections import defaultdict
from fractions import Fraction
from math import sqrt

import numpy as np
import pytest

from marksmith.llm import conversation_trie, license_scan, whitening

SF = "/root/testdata/sf0.001"


def plain_trie(rows):
    held = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            held[c].append(((turn is not None, turn or 0, digest), role, text))
    turns = {c: [(r, t) for _, r, t in sorted(v)] for c, v in held.items()}
    built = {}
    for c, own in turns.items():
        h, anchor = zlib.crc32(str(c).encode()) % 6, c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = turns.get(anchor, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids, leaves, saved, out = defaultdict(int), defaultdict(int), defaultdict(int), set()
    for key in sorted(members, key=len, reverse=True):
        leaves[key] += not kids[key]
        if key:
            saved[key] += (len(members[key]) - 1) * len(key[-1][1])
            kids[key[:-1]] += 1
            leaves[key[:-1]] += leaves[key]
            saved[key[:-1]] += saved[key]
    for key, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(key))))
        parent = min(members[key[:-1]]) if key else None
        out.add((min(m), len(key), parent, len(m), kids[key], leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest()))
    return out


TURNS = "conv_id long, turn int, role string, text string, node binary, n_chars string, `rank` int"


@pytest.fixture(scope="module")
def odd_turns():
    rng, rows = random.Random(4), []
    for c in [*range(0, 40), *range(100, 330), -205, -7, 700]:
        for turn in range(rng.randint(1, 7)):
            rows.append((c, turn if turn != 2 else None, "user", rng.choice(["hi", "yes", "", "é漢"])))
    rows += [(5, 1, None, None), (5, 1, None, None), (5, None, "user", None), (None, 1, "user", "nobody"), (None, None, None, None), (301, 9, "user", "x" * 100_000)]
    rows += [(400, k, "user", "long") for k in range(700)] + [(c, 0, "user", "same end") for c in range(1000, 1400)]
    return rows


@pytest.mark.parametrize("least_heavy, queue", [(256, 1 << 18), (2, 1), (10**9, 3)])
def test_trie_equals_a_plain_one(spark, odd_turns, least_heavy, queue):
    frame = spark.createDataFrame([(*r, b"x", None, 1) for r in odd_turns], TURNS)
    got = conversation_trie.prefix_trie(frame, least_heavy=least_heavy, queue=queue).collect()
    want = plain_trie(odd_turns)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_trie_of_no_rows_and_of_one_turnless_conversation(spark):
    empty = spark.createDataFrame([], TURNS)
    assert conversation_trie.prefix_trie(empty).count() == 0
    c = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 1)  # its only turn is replaced by those of the absent 0
    only = spark.createDataFrame([(c, 0, "user", "a", None, None, None)], TURNS)
    sha = hashlib.sha256(str(c).encode()).hexdigest()
    assert [tuple(r) for r in conversation_trie.prefix_trie(only).collect()] == [(c, 0, None, 1, 0, 1, 0, sha)]


def test_trie_without_shared_heads_keeps_every_conversation(spark):
    frame = spark.createDataFrame([(c, t, "user", f"{t}", None, None, None) for c in (7, 8) for t in range(3)], TURNS)
    got = {(r.depth, r.n_convs, r.n_children, r.n_leaves) for r in conversation_trie.prefix_trie(frame, rebuilt=False).collect()}
    assert got == {(0, 2, 1, 1), (1, 2, 1, 1), (2, 2, 1, 1), (3, 2, 0, 1)}


def test_queue_gives_back_in_order_what_it_spilled():
    rng = random.Random(1)
    queue, held = conversation_trie.SpillingQueue(most=5), []
    for _ in range(2000):
        if rng.random() < 0.6 or not held:
            item = (rng.randint(-50, 50), rng.randbytes(3))
            queue.push(item)
            held.append(item)
        else:
            held.sort()
            assert queue.peek() == held[0] and queue.pop() == held.pop(0)
    assert queue.spilled > 10
    assert [queue.pop() for _ in range(len(held))] == sorted(held) and queue.peek() is None


def test_ids_of_a_crowded_end_are_hashed_in_order_over_pieces(spark):
    ends = spark.range(5000).selectExpr("unhex(if(id % 2 = 0, '01', '02')) AS node", "id AS conv_id")
    got = {bytes(r.node): r.ends_sha256 for r in conversation_trie.ends_hashes(ends, piece=7).collect()}
    assert got == {bytes([1 + k]): hashlib.sha256(",".join(map(str, range(k, 5000, 2))).encode()).hexdigest() for k in (0, 1)}


def plain_scan(text):
    w = license_scan.words_of(text or "")
    places = [(i, label) for phrase, label in license_scan.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    tokens = [(label, license_scan.words_of(t)) for label, t in license_scan.TEMPLATES]
    stride, met = max(len(t) for _, t in tokens), {}
    at = 0
    while True:
        block = set(w[at : at + 2 * stride])
        for label, t in tokens:
            share = len(block & set(t)) / len(set(t))
            if len(block & set(t)) >= license_scan.needed(len(set(t))):
                met[label] = max(met.get(label, 0), share)
        at += stride
        if at + stride >= len(w):
            break
    base = sorted({x[1] for x in places})
    score = 1.0 if base else max(met.values(), default=0.0)
    starts = [x[0] for x in places]
    return (len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted({*base, *met})), round(score, 12))


def test_licenses_equal_a_plain_scan(spark):
    rng = random.Random(6)
    prose = "the of and to in a is that it you any other word software license public use".split()
    texts = ["", None, " \n", "Under the MIT License under the mit license cc by-nc CC BY NC", "apache license version 2" * 3, "UNDER THE\x00MIT, LICENSE é漢"]
    for label, t in license_scan.TEMPLATES:
        cut = t.split()
        for drop in (0, 2, len(cut) // 6, len(cut) // 4, len(cut) // 2):
            kept = [x for k, x in enumerate(cut) if k not in set(rng.sample(range(len(cut)), drop))]
            texts.append(" ".join(rng.choices(prose, k=rng.randint(0, 150)) + kept + rng.choices(prose, k=rng.randint(0, 150))))
    texts += [" ".join(rng.choices(prose, k=n)) for n in (51, 52, 53, 103, 104, 105, 157, 5000)]
    texts += ["x " * 100_000 + license_scan.TEMPLATES[0][1]] + texts[:5]
    docs = spark.createDataFrame([(None if k == 7 else k % 40, t, "l", 1, None) for k, t in enumerate(texts)], "doc_id long, text string, label string, `row` int, blocks string")
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 12)) for r in license_scan.license_scan(docs).collect()), key=repr)
    assert got == sorted(((None if k == 7 else k % 40, *plain_scan(t)) for k, t in enumerate(texts)), key=repr)
    assert license_scan.license_scan(docs.limit(0)).count() == 0
    alone = license_scan.license_scan(docs, templates=()).collect()
    assert len(alone) == len(texts) and all(r.labels == r.base_labels for r in alone)


def test_scan_uses_no_python_workers(spark):
    plan = license_scan.license_scan(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def plain_determinant(m):
    """Bareiss: exact in whole numbers."""
    m, sign, before = [row[:] for row in m], 1, 1
    for k in range(len(m) - 1):
        if m[k][k] == 0:
            swap = next((i for i in range(k + 1, len(m)) if m[i][k]), None)
            if swap is None:
                return 0
            m[k], m[swap], sign = m[swap], m[k], -sign
        for i in range(k + 1, len(m)):
            for j in range(k + 1, len(m)):
                m[i][j] = (m[i][j] * m[k][k] - m[i][k] * m[k][j]) // before
        before = m[k][k]
    return sign * m[-1][-1]


def test_characteristic_polynomial_equals_determinants(spark):
    rng = random.Random(3)
    for d, rank in ((1, 1), (5, 5), (8, 3)):
        a = [[rng.randint(-10**6, 10**6) for _ in range(rank)] for _ in range(d)]
        m = [[sum(x * y for x, y in zip(r, s)) for s in a] for r in a]
        poly = whitening.characteristic_polynomial(spark, m)
        for t in (0, 1, -3, 10**13):
            assert sum(c * t**k for k, c in enumerate(poly)) == plain_determinant([[t * (i == j) - v for j, v in enumerate(row)] for i, row in enumerate(m)])


def test_roots_with_multiplicities_and_close_ones():
    def product(roots):
        poly = [1]
        for r in roots:
            poly = [(poly[k - 1] if k else 0) - r * (poly[k] if k < len(poly) else 0) for k in range(len(poly) + 1)]
        return poly

    big = 10**20
    found = whitening.largest_roots(product([big, big, big + 1, 7, 7, 7, 1, 0, 0]), 16)
    assert [(Fraction(r, 1 << whitening.ROOT_BITS), n) for r, n in found] == [(big + 1, 1), (big, 2), (7, 3), (1, 1)]
    assert whitening.largest_roots(product([big, 3]), 1) == [(big << whitening.ROOT_BITS, 1)]


VECTORS = "vec_id long, embedding array<float>, y string, n long, component int"


def test_whitening_equals_plain_figures(spark):
    rng = np.random.default_rng(5)
    mixed = rng.normal(size=(300, 6)) @ np.diag([3, 1, 1, 0.5, 0.2, 0])
    vectors = [v.tolist() for v in mixed.astype(np.float32)]
    rows = [(k, v) for k, v in enumerate(vectors)] + [(900 + k, vectors[0]) for k in range(200)] + [(3, vectors[3]), (None, vectors[5])]
    odd = [(1, None), (2, []), (4, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (5, [float("nan")] * 6), (6, [float("inf")] + [0.0] * 5), (7, [1.0, 2.0]), (8, [1e30] * 6)]
    frame = spark.createDataFrame([(i, v, "y", 7, 1) for i, v in rows + odd], VECTORS)
    got = whitening.whiten(frame).collect()
    x = np.floor(64 * np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, centred = len(fit), (fit - fit.mean(axis=0))
    values = np.linalg.eigvalsh(centred.T @ centred / n)[::-1]
    rank = 5  # the last dimension doesn't vary
    assert len(got) == len(rows) * rank and {r.n for r in got} == {n}
    assert max(r.identity_error for r in got) == min(r.identity_error for r in got) < 1e-9
    for k in range(rank):
        share = {r.explained for r in got if r.component == k + 1}
        assert len(share) == 1 and abs(share.pop() / (values[k] / values.sum()) - 1) < 1e-9
    want = sorted((i, int(((n * v.astype(object) - fit.sum(axis=0)) ** 2).sum())) for (i, _), v in zip(rows, x) if i is not None)
    assert sorted((r.vec_id, r.deviation) for r in got if r.component == 1 and r.vec_id is not None) == want
    # whitened coordinates give back the distances that the inverse covariance defines
    inverse = np.linalg.pinv(centred.T @ centred / n)
    lengths = defaultdict(float)
    for r in got:
        if r.vec_id is not None and 10 <= r.vec_id < 300:
            lengths[r.vec_id] += r.whitened**2
    for k, v in lengths.items():
        gap = x[k] - fit.mean(axis=0)
        assert abs(v - gap @ inverse @ gap) < 1e-6 * max(1, v)


def test_whitening_of_little(spark):
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(k, [1.0, 2.0], "", 1, 1) for k in range(5)], VECTORS)).count() == 0
    two = whitening.whiten(spark.createDataFrame([(k, [float(k), 2.0], "", 1, 1) for k in (0, 1)], VECTORS)).collect()
    assert sorted(abs(r.whitened) for r in two) == [1.0, 1.0] and {r.explained for r in two} == {1.0} and {r.deviation for r in two} == {64 * 64}


def test_vectors_are_right_where_roots_lie_close():
    d = 12
    q = np.linalg.qr(np.random.default_rng(2).integers(-9, 9, size=(d, d)).astype(float))[0]
    values = [10**12, 10**12 * (1 + 1e-9), 10**12 * (1 + 2e-9)] + [k + 1.0 for k in range(d - 3)]
    m = np.rint(q @ np.diag(values) @ q.T)
    m = [[int(m[max(i, j)][min(i, j)]) for j in range(d)] for i in range(d)]
    from marksmith.llm.whitening import largest_roots, null_vectors

    poly = [1]  # by Faddeev and Le Verrier, in whole numbers
    power, coefficients = [[int(i == j) for j in range(d)] for i in range(d)], [1]
    for k in range(1, d + 1):
        product = [[sum(m[i][t] * power[t][j] for t in range(d)) for j in range(d)] for i in range(d)]
        c = -sum(product[i][i] for i in range(d)) // k
        coefficients.append(c)
        power = [[product[i][j] + (c if i == j else 0) for j in range(d)] for i in range(d)]
    poly = coefficients[::-1]
    for root, count in largest_roots(poly, 3):
        assert count == 1
        v = [Fraction(x) for x in null_vectors(m, root, 1)[0]]
        exact = Fraction(root, 1 << whitening.ROOT_BITS)
        off = max(abs(sum(m[i][j] * v[j] for j in range(d)) - exact * v[i]) for i in range(d))
        assert off < 10**12 * 1e-14 and abs(sqrt(float(sum(x * x for x in v))) - 1) < 1e-15


def test_blocks_and_documents_are_read_alone(spark):
    import public_tokenizers

    from marksmith.llm import token_store

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = np.random.default_rng(3)
    ids = rng.geometric(0.01, 5000).astype(np.uint32)
    ids[::41] = 2**32 - 1
    segment = token_store.Segment(token_store.pack_segment(ids, np.array([1]), np.array([False]), np.array([5000])))
    for start, length in ((0, 1), (0, 5000), (255, 2), (256, 256), (4999, 1), (1000, 3000), (7, 0)):
        assert (token_store.unpack_range(segment, start, length) == ids[start : start + length]).all()
    rows = [(k % 50, f"text {k} " * (k % 7)) for k in range(200)] + [(None, "no id")] * 40 + [(7, "again")] * 60
    segments = token_store.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path)
    whole = sorted((r.doc_id, bytes(r.ids)) for r in token_store.read_tokens(segments, keep_ids=True).where("doc_id IN (7, 31)").collect())
    wanted = spark.createDataFrame([(7,), (31,), (7,), (None,), (9999,)], "doc_id long")
    found = token_store.read_documents(segments, wanted).collect()
    assert sorted((r.doc_id, bytes(r.ids)) for r in found) == whole and len(whole) == 68 and all(4 * r.n_tokens == len(r.ids) for r in found)
    assert token_store.read_documents(segments, wanted.limit(0)).count() == 0


def test_rows_without_id_are_parted(spark):
    import public_tokenizers

    from marksmith.llm import token_store

    rows = [(None, f"text {k}") for k in range(400)] + [(None, "same")] * 400
    segments = token_store.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json"))
    assert segments.count() >= 6  # of eight ranges

"""The classifiers' arithmetic against plain versions."""

import numpy as np

from marksmith.llm import quality, toxicity
from marksmith.llm.training import sigmoid


def random_net(rng):
    weights = {"embedding": rng.normal(size=(toxicity.BUCKETS, toxicity.DIMS)), "bias": rng.normal(size=toxicity.FILTERS * len(toxicity.WIDTHS))}
    weights["embedding"][toxicity.PAD] = 0
    weights |= {"out": rng.normal(size=toxicity.FILTERS * len(toxicity.WIDTHS)), "out_bias": rng.normal(size=1)}
    for w in toxicity.WIDTHS:
        weights[f"filter{w}"] = rng.normal(size=(w, toxicity.DIMS, toxicity.FILTERS))
    return weights


TEXTS = ["", "one", "one two", "some Words, and others; words again and a longer wordlike thing", "x " * 40]


def plain_logit(weights, parts, ids):
    """Every filter at every place, padding on both sides, one multiplication after the other."""
    gap = max(toxicity.WIDTHS) - 1
    padded = [0] * gap + ids.tolist() + [0] * gap
    vectors = [weights["embedding"][parts[k]].sum(axis=0) for k in padded]
    pooled = []
    for w in toxicity.WIDTHS:
        for f in range(toxicity.FILTERS):
            pooled.append(max(sum(float(vectors[p + j] @ weights[f"filter{w}"][j][:, f]) for j in range(w)) for p in range(len(ids) + gap)))
    h = np.maximum(np.array(pooled) + weights["bias"], 0)
    return float(h @ weights["out"] + weights["out_bias"][0])


def test_convolution_against_a_plain_one():
    words = toxicity.Vocabulary()
    docs = [words.ids(t) for t in TEXTS]
    parts, _ = words.taken()
    weights = random_net(np.random.default_rng(1))
    net = toxicity.Cnn(weights)
    assert np.allclose(net.logits(docs, net.added(parts)), [plain_logit(weights, parts, d) for d in docs], atol=1e-3)


def test_gradients_against_differences():
    words = toxicity.Vocabulary()
    docs = [words.ids(t) for t in TEXTS]
    parts, _ = words.taken()
    rng = np.random.default_rng(2)
    weights, labels, importance = random_net(rng), np.array([0, 1, 0, 1, 1.0]), rng.random(5)
    weights["out"] *= 0.03  # the losses stay far from their bounds

    def loss():
        p = sigmoid(np.array([plain_logit(weights, parts, d) for d in docs]))
        return float(-(importance * (labels * np.log(p) + (1 - labels) * np.log(1 - p))).sum())

    grads = toxicity.gradients(weights, parts, docs, labels, importance)
    for name, g in grads.items():
        flat = weights[name].reshape(-1)
        hit = np.flatnonzero(np.abs(g.reshape(-1)) > 1e-6)
        for k in rng.choice(hit, size=min(6, len(hit)), replace=False):
            kept, step = flat[k], 1e-5
            flat[k] = kept + step
            up = loss()
            flat[k] = kept - step
            down = loss()
            flat[k] = kept
            assert np.isclose((up - down) / (2 * step), g.reshape(-1)[k], rtol=1e-3, atol=1e-6), (name, k)


def plain_features(line, own_lines):
    data = line.encode()
    shares = [sum(b in kind for b in data) for kind in quality.CLASSES]
    shares.append(len(data) - sum(shares))
    parts = line.split()
    size = len(data)
    return [x / max(size, 1) for x in shares] + [
        np.log1p(size) / 5, min(size / max(len(parts), 1), 40) / 10, 1 - len(set(parts)) / max(len(parts), 1), float(line != "" and own_lines.count(line) > 1), float(size == 0), 1.0
    ]


def test_line_features_and_weights_against_plain_ones():
    texts = ["", "One line. Of 3 words!", "a b a b\n\nA|b\tc\na b a b\nüber #x", "x\n" * 5]
    got, size, begin = quality.line_features(texts)
    want, lengths = [], []
    for text in texts:
        lines = text.split("\n")
        own = [plain_features(x, lines) for x in lines]
        none = [0.0] * quality.FEATURES
        want += [a + b + c for a, b, c in zip(own, [none, *own[:-1]], [*own[1:], none])]
        lengths.append([len(x.encode()) + 1 for x in lines])
    assert np.allclose(got, want) and size.tolist() == sum(lengths, []) and begin.tolist() == [0, 1, 2, 7]
    rng = np.random.default_rng(4)
    net = quality.Field(rng.normal(size=got.shape[1]), rng.normal(size=(2, 2)))
    bad = net.badness(texts)
    for k, (a, sizes) in enumerate(zip(begin, lengths)):
        marginal, _ = quality.forward_backward(np.array(want[a : a + len(sizes)]) @ net.line, net.turn)
        assert np.isclose(bad[k], sum(m * n for m, n in zip(marginal, sizes)) / sum(sizes))

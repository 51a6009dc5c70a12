"""Co-training against held-out labels, and a brute-force fit of one step."""

import numpy as np

from tallyforge.llm import quality


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.score_quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    assert sum(g > b for g in good for b in bad) >= 0.97 * len(good) * len(bad)
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)


def test_odd_rows(spark):
    texts = [None, "", " \n", "word", "a\n\nb\n", "é" * 1000, "x " * 30_000, "same", "same"]
    docs = spark.createDataFrame([(k, t, None, None, None, 1) for k, t in enumerate(texts)] + [(None, "t", "en", "s", 5, 1)], "doc_id long, text string, lang string, source string, n_chars long, label int")
    labels = spark.createDataFrame([(1, 0, 0), (3, 1, 0), (4, 0, 0), (6, 1, 0), (7, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == len(texts) + 1 and all(0 <= r.score <= 1 for r in got)
    same = [r.score for r in got if r.doc_id in (7, 8)]
    assert same[0] == same[1]
    assert quality.score_quality(docs.limit(0), labels).count() == 0
    none = quality.score_quality(docs, labels.limit(0)).collect()
    assert all(abs(r.score - 0.5) < 1e-6 for r in none)


def test_names_are_hashed_whole():
    rows = quality.meta_features(["en"] * 3, ["https://a.example/1", "https://a.example/2", "https://b.example/1"], [5] * 3)
    assert len({tuple(r) for r in rows}) == 3


def brute_co_train(text, meta, label):
    """All rounds on whole arrays."""
    views, y0 = (text, meta), np.array([-1 if x is None else x for x in label])
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))

    def newton(x, w, y, c, ridge):
        p = sigmoid(x @ w)
        hessian = (x * (c * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        return w - np.linalg.solve(hessian, x.T @ (c * (p - y)) + ridge * w)

    known, w = (y0 >= 0).astype(float), [np.zeros(x.shape[1]) for x in views]
    for _ in range(quality.FIRST_STEPS):
        w = [newton(x, v, np.maximum(y0, 0), known, quality.RIDGE) for x, v in zip(views, w)]
    for _ in range(quality.ROUNDS):
        other = [sigmoid(x @ v) for x, v in zip(views, w)][::-1]
        taught = [np.where((y0 < 0) & ((o >= quality.CONFIDENT) | (o <= 1 - quality.CONFIDENT)), 1.0, 0.0) for o in other]
        for _ in range(quality.STEPS):
            w = [newton(x, v, np.where(t > 0, o > 0.5, np.maximum(y0, 0)), np.where(t > 0, quality.PSEUDO, known), quality.RIDGE) for x, v, o, t in zip(views, w, other, taught)]
    return w


def test_rounds_are_those_of_whole_arrays(spark):
    rng = np.random.default_rng(3)
    n = 240
    hidden = rng.normal(size=n)
    text, meta = rng.normal(size=(n, quality.TEXT_SIZE)) * 0.2, rng.normal(size=(n, quality.META_SIZE)) * 0.2
    text[:, 0] += 4 * hidden
    meta[:, 1] += 4 * hidden
    text, meta = text.astype(np.float32).astype(np.float64), meta.astype(np.float32).astype(np.float64)
    label = [int(hidden[k] > 0) if k % 3 == 0 else None for k in range(n)]
    rows = spark.createDataFrame([(k, text[k].tolist(), meta[k].tolist(), label[k]) for k in range(n)], "id long, text_view array<float>, meta_view array<float>, label int").repartition(3)
    want = brute_co_train(text, meta, label)
    for got, w in zip(quality.co_train(rows).weights, want):
        assert np.allclose(got, w, atol=1e-5)


def test_newton_step_is_the_whole_fit(spark):
    rng = np.random.default_rng(1)
    n = 300
    text, meta = rng.normal(size=(n, quality.TEXT_SIZE)) * 0.3, rng.normal(size=(n, quality.META_SIZE)) * 0.3
    label = [None if k % 3 == 0 else int(text[k, 0] + meta[k, 0] > 0) for k in range(n)]
    rows = spark.createDataFrame([(k, text[k].tolist(), meta[k].tolist(), label[k]) for k in range(n)], "id long, text_view array<float>, meta_view array<float>, label int").repartition(3)
    weights = [np.zeros(quality.TEXT_SIZE), np.zeros(quality.META_SIZE)]
    got, counts = quality._step(rows, weights)
    used = [k for k in range(n) if label[k] is not None]
    y = np.array([label[k] for k in used])
    assert counts == (y.sum(), len(y) - y.sum())
    for x, w in zip((text, meta), got):
        own = x.astype(np.float32).astype(np.float64)[used]
        want = np.linalg.solve(own.T @ own / 4 + quality.RIDGE * np.eye(own.shape[1]), own.T @ (y - 0.5))
        assert np.allclose(w, want, atol=1e-6)
    model = quality.co_train(rows)
    both, _, _ = model.score(text, meta)
    assert np.mean((both > 0.5) == (text[:, 0] + meta[:, 0] > 0)) > 0.8

"""Language model: base scores against plain sums, factors that sum to one, held-out gain."""

import math
import pickle
import re
import zlib
from collections import Counter

import numpy as np
from data import DOCS, SPACE, awkward, empty, words_of
from pyspark.sql import functions as F

from pairlace.llm import maxent_lm as lm
from pairlace.llm.queries import fold


def tokens(text):
    return [*(x for x in re.split(SPACE, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x), None]


def brute(docs):
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in docs}
    c = Counter(t for i, text in docs if not held[i] for t in tokens(text))
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(t := tokens(text)), sum(c[x] > 0 for x in t), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)) for i, text in docs}


def sentences(rng, k):
    """Words that follow each other in pairs, so that history tells."""
    out = []
    for _ in range(int(rng.integers(3, 30))):
        a = int(rng.integers(0, 40))
        out += [f"lead{a}", "of" if a % 2 else "ing", f"End{a}"]
    return " ".join(out)


def test_base_scores_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    docs = [(k, " ".join(words_of(rng, int(rng.integers(0, 90)), 900))) for k in range(200)] + [(200, None), (201, ""), (202, "ÄÖ äö Ab aB")]
    want = brute(docs)
    for heavy in (lm.HEAVY, 7):  # counts looked up, and counts joined
        monkeypatch.setattr(lm, "HEAVY", heavy)
        got = lm.score(spark.createDataFrame(docs, "doc_id long, text string"), fold() == 1).collect()
        assert len(got) == len(docs)
        for r in got:
            w = want[r.doc_id]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and math.isclose(r.base_score, w[4], rel_tol=1e-9)


def test_history_helps_on_held_out_text(spark):
    rng = np.random.default_rng(2)
    docs = spark.createDataFrame([(k, sentences(rng, k)) for k in range(800)], "doc_id long, text string")
    r = lm.score(docs, fold() == 1).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert r.s / r.n > r.b / r.n + 0.1


def test_heavy_counts_are_bounded(spark):
    counts = spark.createDataFrame([(k, 1 + 1000 // (k + 1)) for k in range(500)], "h long, c long")
    top = sorted((r.h, r.c) for r in lm.heavy_counts(counts, 50).collect())
    assert 30 < len(top) <= 50 and top == [(k, 1 + 1000 // (k + 1)) for k in range(len(top))]
    assert lm.heavy_counts(counts.where("c = 3"), 5).count() == 0
    assert lm.heavy_counts(counts).count() == 500


def test_classes_sum_to_one():
    rng = np.random.default_rng(3)
    w, b = rng.normal(0, 1, (lm.LEAST_ROWS, lm.CLASSES)).astype(np.float32), rng.normal(0, 1, lm.CLASSES).astype(np.float32)
    f = rng.integers(0, lm.LEAST_ROWS, (50, 2))
    odds, sums = lm.class_odds(f, w, b)
    plain = np.exp(w[f].astype(float).sum(1) + b)
    assert np.allclose(odds / sums[:, None], plain / plain.sum(1, keepdims=True), atol=1e-5)


def test_awkward_and_empty(spark):
    docs, n = awkward(spark)
    got = lm.score(docs, fold() == 1).collect()
    assert len(got) == n and all(math.isfinite(r.score) for r in got)
    assert lm.score(empty(spark), fold() == 1).count() == 0
    only_held = spark.createDataFrame([(1, "a b", "en", "web", 3)], DOCS)
    assert lm.score(only_held, F.lit(True)).first().n_known == 0


def test_history_tells_words_of_one_class_apart(spark):
    """Which of two words of one class follows is known from the word before."""
    names = [f"{k:03d}ing" for k in range(1000)]
    tail = lm.tokens(np.frombuffer(" ".join(names).encode(), np.uint8), np.array([0, 7 * 1000 - 1]))[1][:1000]
    assert len(set(tail)) == 1
    rng = np.random.default_rng(4)
    text = lambda: " ".join(f"lead{a} {names[a]}" for a in rng.integers(0, 20, 30))
    docs = spark.createDataFrame([(k, text()) for k in range(600)], "doc_id long, text string")
    r = lm.score(docs, fold() == 1).where("held_out").agg((F.sum("score") / F.sum("n_tokens")).alias("s")).first()
    # each second word is free among 20; a word that history does not tell costs another log10(20) / 2
    assert r.s > -math.log10(20) / 2 - 0.4


def test_paths_sum_to_one_and_without_weights_give_counts():
    rng = np.random.default_rng(5)
    depth = 8
    mass = np.where(rng.random(lm.CLASSES << depth) < 0.3, 0, rng.integers(1, 50, lm.CLASSES << depth) + 0.5)
    biases = lm.branch_biases(mass, depth)
    leaf = np.arange(7 << depth, 8 << depth)
    hist = np.repeat(rng.integers(0, 2**63, (1, 2), dtype=np.uint64), len(leaf), 0)
    v = rng.normal(0, 1, lm.LEAST_SLOTS).astype(np.float32)
    assert math.isclose(np.exp(lm.path_log_probs(hist, leaf, v, biases)).sum(), 1, rel_tol=1e-5)
    p = np.exp(lm.path_log_probs(hist, leaf, v * 0, biases))
    assert np.allclose(p, mass[leaf] / mass[leaf].sum(), atol=1e-6)
    assert lm.sizes(100) == (lm.LEAST_ROWS, lm.LEAST_SLOTS) and lm.sizes(10**7) == (lm.MOST_ROWS, lm.MOST_SLOTS)


def test_classes_are_balanced():
    n = np.zeros(lm.TAILS)
    n[:400] = 1 + 4000 // (1 + np.arange(400))
    classes = lm.balanced_classes(n)
    load = np.bincount(classes[:400], weights=n[:400], minlength=lm.CLASSES)
    assert classes[lm.TAILS] == 0 and load[0] == 0 and load[1:].max() <= max(n.max(), 1.5 * n.sum() / (lm.CLASSES - 1))
    assert set(classes[:-1]) <= set(range(1, lm.CLASSES))


def small_model(rng, texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.cumsum([0, *[len(t.encode()) for t in texts]])
    h, tail, first = lm.tokens(data, offs)
    u, at, c = np.unique(h, return_index=True, return_counts=True)
    classes = lm.balanced_classes(np.bincount(tail, minlength=lm.TAILS + 1)[: lm.TAILS])
    cls, depth = classes[tail[at]], 4
    mass = np.bincount(lm.leaves(u, cls, depth), weights=c + 0.5, minlength=lm.CLASSES << depth)
    rows, slots = rng.normal(0, 0.3, (64, lm.CLASSES)), rng.normal(0, 0.3, 1 << 10)
    counts, kinds = np.bincount(cls, weights=c, minlength=lm.CLASSES), np.bincount(cls, minlength=lm.CLASSES)
    return lm.Model(classes, rows, rng.normal(0, 0.3, lm.CLASSES), slots, mass, depth, counts.astype(float), kinds.astype(float)), (h, tail, first)


def log_likelihood(m, t):
    h, tail, first = t
    cls = m.classes[tail]
    hist = lm.histories(h, first)
    odds, sums = lm.class_odds(lm.features(hist, len(m.rows)), m.rows, m.bias)
    lp = np.log(odds[np.arange(len(h)), cls] / sums)
    return float((lp + lm.path_log_probs(hist, lm.leaves(h, cls, m.depth), m.slots, lm.branch_biases(m.mass, m.depth))).sum())


def test_gradient_against_finite_differences():
    rng = np.random.default_rng(6)
    m, t = small_model(rng, [sentences(rng, 0) for _ in range(8)])
    total, both = np.zeros((64, lm.CLASSES + 1)), np.zeros(1 << 10, np.complex64)
    over = lm.gradient(*t, m, lm.branch_biases(m.mass, m.depth), total, both)
    inner, n = both.real, both.imag
    eps = 1e-4
    for at in zip(rng.integers(0, 64, 12), rng.integers(0, lm.CLASSES, 12), strict=True):
        up, down = m.rows.copy(), m.rows.copy()
        up[at] += eps
        down[at] -= eps
        assert math.isclose(total[at], (log_likelihood(m._replace(rows=up), t) - log_likelihood(m._replace(rows=down), t)) / 2 / eps, abs_tol=2e-3)
    for at in np.argsort(-n)[:12]:
        up, down = m.slots.copy(), m.slots.copy()
        up[at] += eps
        down[at] -= eps
        assert math.isclose(inner[at], (log_likelihood(m._replace(slots=up), t) - log_likelihood(m._replace(slots=down), t)) / 2 / eps, abs_tol=5e-3)
    assert total[:, lm.CLASSES].sum() == 2 * len(t[0]) and n.sum() == 2 * m.depth * len(t[0]) and abs(over.sum()) < 1e-3


def test_score_against_a_plain_sum(spark):
    """The query's scores, token by token in plain Python, from the model that it trains."""
    rng = np.random.default_rng(8)
    docs = [(k, sentences(rng, k) + (f" only{k}" if k % 3 else "")) for k in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.score(df, fold() == 1).collect()}
    learn = df.where(fold() != 1)
    m = lm.fit(lm.token_counts(learn).persist(), learn)
    seen = Counter(t for i, text in docs if zlib.crc32(str(i).encode()) % 5 != 1 for t in tokens(text))
    biases = lm.branch_biases(m.mass, m.depth)
    for i, text in docs[::7]:
        data = np.frombuffer(text.encode(), np.uint8)
        h, tail, first = lm.tokens(data, np.array([0, len(data)]))
        cls = m.classes[tail]
        hist, total = lm.histories(h, first), 0.0
        for k, word in enumerate(tokens(text)):
            z = m.bias + sum(m.rows[int(x) % len(m.rows)] for x in hist[k])
            p = math.exp(z[cls[k]]) / sum(math.exp(v) for v in z)
            full = m.counts[cls[k]] + 0.5 * (m.kinds[cls[k]] + 1)
            if not seen[word]:
                total += math.log10(p * 0.5 / full)
                continue
            leaf = (int(cls[k]) << m.depth) | (int(h[k]) & ((1 << m.depth) - 1))
            for level in range(m.depth):
                node = leaf >> (m.depth - level)
                key = (node + ((level + 1) << 40)) * int(lm._EVEN) % 2**64
                per = len(m.slots) // 8
                logit = biases[level][node] + sum(m.slots[level * per + (((int(hist[k, j]) ^ key) * int(lm._ODD) % 2**64) >> (65 - per.bit_length()))] for j in (0, 1))
                p /= 1 + math.exp(-logit if leaf >> (m.depth - level - 1) & 1 else logit)
            total += math.log10(p * (1 - 0.5 / full) * (seen[word] + 0.5) / m.mass[leaf])
        assert math.isclose(total, got[i], rel_tol=1e-4)


def test_gradients_of_many_tasks_add_up_in_two_steps(spark, monkeypatch):
    rng = np.random.default_rng(9)
    docs = spark.createDataFrame([(k, sentences(rng, k)) for k in range(100)], "doc_id long, text string").repartition(8)
    counts = lm.token_counts(docs).persist()
    one = lm.fit(counts, docs)
    monkeypatch.setattr(lm, "FAN_IN", 3)
    two = lm.fit(counts, docs)
    assert np.allclose(one.rows, two.rows, atol=1e-4) and np.allclose(one.slots, two.slots, atol=1e-4)


def test_a_model_from_a_broadcast_keeps_the_dtypes_that_add_fast():
    m, _ = small_model(np.random.default_rng(10), ["a b c"])
    m = lm.native(pickle.loads(pickle.dumps(m._replace(rows=m.rows.astype(np.float32), bias=m.bias.astype(np.float32)))))
    assert all(v.dtype is np.dtype(v.dtype.type) for v in m if isinstance(v, np.ndarray))
    odds, _ = lm.class_odds(np.zeros((5, 2), np.int64), m.rows, m.bias)
    assert odds.dtype is np.dtype(np.float32)  # np.add.at compares the objects


def test_gradients_are_sent_where_slots_fired():
    rng = np.random.default_rng(11)
    for n, share in ((lm.BLOCK, 0.1), (33, 1), (7, 0)):
        v = np.where(rng.random(n) < share, rng.normal(0, 1, n), 0).astype(np.float16)
        data = lm.pressed(v)
        assert (lm.unpressed(data) == v).all() and len(data) == 4 + -(-n // 8) + 2 * np.count_nonzero(v)


def test_one_round_against_a_plain_step(spark):
    rng = np.random.default_rng(12)
    texts = [sentences(rng, k) for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    data, offs = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *[len(x.encode()) for x in texts]])
    m, _ = small_model(rng, texts)
    m = m._replace(rows=np.zeros((lm.LEAST_ROWS, lm.CLASSES), np.float32), bias=m.bias.astype(np.float32), slots=np.zeros(lm.LEAST_SLOTS, np.float32))
    got = lm.train(docs, m, rounds=1)
    total, both = np.zeros((lm.LEAST_ROWS, lm.CLASSES + 1)), np.zeros(lm.LEAST_SLOTS, np.complex64)
    t = lm.tokens(data, offs)
    over = lm.gradient(*t, m, lm.branch_biases(m.mass, m.depth), total, both)
    slots = (lm.DAMP * both.real / (0.25 * both.imag + lm.PRIOR)).clip(-3, 3)
    p = np.maximum(np.exp(m.bias), 0.01)
    rows = (total[:, : lm.CLASSES] * lm.CLASS_DAMP / (total[:, lm.CLASSES :] * p + lm.CLASS_PRIOR)).clip(-2, 2)
    assert np.count_nonzero(slots) > 500 and np.allclose(got.slots, slots, atol=5e-3) and np.allclose(got.rows, rows, atol=5e-3)
    assert np.allclose(got.bias, m.bias + (over * lm.CLASS_DAMP / (len(t[0]) * p + lm.CLASS_PRIOR)).clip(-2, 2), atol=5e-3)

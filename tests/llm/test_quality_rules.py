"""Counts against a plain version; outliers planted in clean statistics."""

import re
from collections import Counter

import numpy as np
from data import DOCS, SPACE, awkward, empty, words_of

from pairlace.llm import quality_rules as qr


def brute(text):
    text = text or ""
    w = [x for x in re.split(SPACE, text) if x]
    lines = [x for x in text.split("\n") if any(y for y in re.split(SPACE, x))]
    wins = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    rep = {p for k in range(len(w) - 7) if wins[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(rep)


def made(rng, k):
    w = words_of(rng, int(rng.integers(0, 120)), 30)
    if k % 3 == 0:
        w += w[:20] + w[:20]
    text = " ".join(w)
    if k % 4 == 0:
        text = text.replace("w1 ", "w1\n").replace("w2 ", "é漢\x85\n\n w2#|")
    return text + ("\n \t\n" if k % 5 == 0 else "")


def test_counts_against_brute_force(spark):
    rng = np.random.default_rng(2)
    docs = [(k, made(rng, k), "en", "web", 0) for k in range(150)] + [(150, None, None, None, None), (151, "", "en", "web", 0), (152, "\n\n#", "en", "web", 0)]
    got = {r.doc_id: r for r in qr.judge(spark.createDataFrame(docs, DOCS)).collect()}
    assert len(got) == len(docs)
    for i, text, *_ in docs:
        want = brute(text)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def test_outliers_go_and_clean_ones_stay(spark):
    rng = np.random.default_rng(3)
    names = [f"word{k}" for k in range(900)]
    plain = lambda n: " ".join(rng.choice(names, n))
    docs = [(k, plain(int(rng.integers(60, 400))) + ".", "en", "web", 0) for k in range(600)]
    docs += [(1000 + k, " ".join(f"#{x}|$%" for x in rng.choice(names, 200)), "en", "web", 0) for k in range(20)]
    docs += [(2000 + k, plain(100).upper(), "xx", "rare", 0) for k in range(5)]  # too few for a group of their own
    got = {r.doc_id: r for r in qr.judge(spark.createDataFrame(docs, DOCS)).collect()}
    assert not any(got[1000 + k].kept for k in range(20))
    assert sum(got[k].kept for k in range(600)) >= 597


def test_estimate_is_robust(spark):
    """A fifth of far rows does not move the centre."""
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(0, 1, (1000, 7)), 2)
    x[:200] += 30
    rows = spark.createDataFrame([("g", *map(float, r)) for r in x], "grp string, " + ", ".join(f"{f} double" for f in qr.FEATURES))
    mu = qr.fit(rows).first().mu
    assert np.abs(np.array(mu)).max() < 0.3


def plain_mcd(x, subset=0.6, starts=60):
    """Concentration from many random starts: the least determinant of covariances of so many rows."""
    rng, h = np.random.default_rng(0), int(np.ceil(subset * len(x)))
    best = np.inf
    for _ in range(starts):
        at = rng.choice(len(x), 9, replace=False)
        for _ in range(30):
            mu, cov = x[at].mean(0), np.cov(x[at].T, bias=True) + np.diag(np.array(qr.FLOOR) ** 2 * 1e-2)
            new = np.argsort(((x - mu) @ np.linalg.inv(cov) * (x - mu)).sum(1))[:h]
            if set(new) == set(at):
                break
            at = new
        best = min(best, np.linalg.slogdet(np.cov(x[at].T, bias=True) * qr.SCALE + np.diag(np.array(qr.FLOOR) ** 2 * 1e-2))[1])
    return best


def test_determinants_come_near_the_least(spark):
    """Against many random starts, for clean groups, for one with a far cluster, and a small one."""
    rng = np.random.default_rng(6)
    rows = []
    for name, n, far in (("clean", 200, 0), ("cluster", 200, 60), ("small", 40, 8)):
        x = rng.normal(0, 1, (n, 7)) * np.array([1, 0.5, 2, 1, 0.3, 0.3, 1])
        x[:far] += 6
        rows += [(name, *map(float, np.round(r, 2))) for r in x]
    df = spark.createDataFrame(rows, "grp string, " + ", ".join(f"{f} double" for f in qr.FEATURES))
    for r in qr.fit(df).collect():
        x = np.array([t[1:] for t in rows if t[0] == r.grp])
        det = np.linalg.slogdet(np.array(r["cov"]).reshape(7, 7) + np.diag(np.array(qr.FLOOR) ** 2 * 1e-2))[1]
        assert det <= plain_mcd(x) + 0.6 and np.abs(np.array(r.mu)).max() < 1


def test_small_sources_lean_on_their_language(spark):
    """A source of three odd rows doesn't make them usual; a large one has its own usual."""
    rng = np.random.default_rng(8)
    names = [f"word{k}" for k in range(900)]
    plain = lambda n: " ".join(rng.choice(names, n))
    odd = lambda: " ".join(f"#{x}|$%" for x in rng.choice(names, 200))
    docs = [(k, plain(int(rng.integers(60, 400))), "en", "web", 0) for k in range(400)]
    docs += [(1000 + k, odd(), "en", "tiny", 0) for k in range(3)] + [(2000 + k, odd(), "en", "codes", 0) for k in range(500)]
    got = {r.doc_id: r.kept for r in qr.judge(spark.createDataFrame(docs, DOCS)).collect()}
    assert sum(got[k] for k in range(400)) >= 397 and sum(got[2000 + k] for k in range(500)) >= 495


def test_awkward_and_empty(spark):
    docs, n = awkward(spark)
    assert qr.judge(docs).count() == n
    assert qr.judge(empty(spark)).count() == 0

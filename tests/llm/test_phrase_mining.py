"""Collocations against a plain count of all phrases."""

import re
from collections import Counter

import numpy as np
import pytest
from data import DOCS, awkward, empty

from pairlace.llm import phrase_mining as pm


def plain(rows, least, top):
    """Rows of (text, lang)."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f: Counter = Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang or "und", tuple(w[i : i + k])] += 1
    n: Counter = Counter()
    for (lang, p), c in f.items():
        n[lang] += c * (len(p) == 1)
    cand = {x: c for x, c in f.items() if len(x[1]) > 1 and c >= least}
    inside = {}
    for (lang, p), c in cand.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                inside[lang, p[i : i + k]] = max(c, inside.get((lang, p[i : i + k]), 0))
    out = []
    for (lang, p), a in cand.items():
        if inside.get((lang, p), 0) < a:
            score, cut = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.append((lang, " ".join(p), a, f[lang, p[:cut]], f[lang, p[cut:]], n[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(r[0], k, *r[1:]) for k, r in enumerate(own, 1)]
    return sorted(ranked)


def same(spark, rows, least, top=2000, docs=None):
    docs = spark.createDataFrame([(k, t, lang, "web", None) for k, (t, lang) in enumerate(rows)], DOCS) if docs is None else docs
    got = sorted(tuple(r) for r in pm.collocations(docs, least, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == plain(rows, least, top)
    return got


def texts(rng, n):
    """Words of a small vocabulary, fixed runs of words, and all kinds of separators."""
    words = [f"W{k}" for k in range(30)] + ["é", "Äß", "\x00x", "a b"]
    runs = [" ".join(words[int(k)] for k in rng.integers(0, 34, int(rng.integers(2, 8)))) for _ in range(6)]
    seps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "; ", "\r\n"]
    return ["".join((runs[int(rng.integers(6))] if rng.random() < 0.4 else words[int(rng.integers(34))]) + seps[int(rng.integers(11))] for _ in range(int(rng.integers(0, 60)))) for _ in range(n)]


@pytest.mark.parametrize("least", [3, 8])
def test_against_plain(spark, monkeypatch, least):
    rng = np.random.default_rng(least)
    monkeypatch.setattr(pm, "CHUNK", 500)
    monkeypatch.setattr(pm, "FLUSH_WORDS", 300)
    rows = [(t, ("en", "de", None)[int(rng.integers(3))]) for t in texts(rng, 120)]
    assert any(len(r[2].split(" ")) == 5 for r in same(spark, rows, least))
    same(spark, rows, least, top=7)


def test_full_buckets_hide_nothing(spark, monkeypatch):
    """Eight buckets for all phrases: each is marked, and the counts still decide."""
    monkeypatch.setattr(pm, "LEAST_BUCKETS", 1 << 16)
    monkeypatch.setattr(pm, "buckets_of", lambda g, salt, n: (g & np.uint64(7)).astype(np.int64))
    same(spark, [(t, "en") for t in texts(np.random.default_rng(4), 40)], 4)


def test_bitmaps_prune(spark):
    """Fewer phrases are counted than there are: those with a rare part or in a light bucket stay out."""
    rows = [(f"rare{k} common words here again rare{k + 1}", "en") for k in range(50)]
    docs = spark.createDataFrame([(k, t, lang, "web", None) for k, (t, lang) in enumerate(rows)], DOCS)
    found, totals = pm.frequent_phrases(docs, 10)
    assert totals.first().total == 300
    assert {r.phrase for r in found.collect()} == {" ".join(w) for i in range(4) for j in range(i + 1, 5) for w in ["common words here again".split()[i:j]]}


def test_products_beyond_64_bits(spark):
    df = spark.createDataFrame([(9 * 10**14, 7 * 10**17, 9 * 10**14 + 1, 10**15)], "a long, total long, l long, r long")
    wide = "cast({} as decimal(18,0))".format
    got = df.selectExpr(f"(cast(1000 as decimal(4,0)) * cast(a as decimal(15,0)) * {wide('total')}) div ({wide('l')} * {wide('r')}) as s").first().s
    assert got == 1000 * 9 * 10**14 * 7 * 10**17 // ((9 * 10**14 + 1) * 10**15)


def test_awkward_rows(spark):
    df, _ = awkward(spark)
    same(spark, [(r.text, r.lang) for r in df.select("text", "lang").collect()], 2, docs=df)


def test_empty_table(spark):
    assert pm.collocations(empty(spark)).count() == 0

"""Decontamination against a plain search of every window in every text."""

import hashlib
import re

import numpy as np
import pytest
from data import DOCS, awkward, empty, words_of

from pairlace.llm import decontaminate as de

BREAK = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return BREAK.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size=10):
    out = []
    for i, text in docs:
        w = words(text)
        hit, met = set(), set()
        for name, t in items:
            b = words(t)
            for win in {tuple(b[k : k + size]) for k in range(max(1, len(b) - size + 1))} - {()}:
                for s in range(len(w) - len(win) + 1):
                    if tuple(w[s : s + len(win)]) == win:
                        hit |= set(range(s, s + len(win)))
                        met.add(str(name))
        out.append((i, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def found(spark, docs, items):
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated) for r in de.contamination(d, b).collect()), key=str)


@pytest.mark.parametrize("small", [de.SMALL, 0])  # broadcast and shuffled probe terms
def test_against_brute_force(spark, small, monkeypatch):
    monkeypatch.setattr(de, "SMALL", small)
    rng = np.random.default_rng(5)
    items = [(k, " ".join(words_of(rng, int(n), 60))) for k, n in enumerate([3, 9, 10, 11, 40, 1, 25])]
    items += [(7, "A a a a a a a a a a a a a"), (8, None), (9, "..."), (10, items[4][1]), (11, "Grüße, naïve-élan 漢字")]
    docs = []
    for k in range(60):
        w = words_of(rng, int(rng.integers(0, 80)), 60)
        if k % 2:
            b = words(items[int(rng.integers(len(items)))][1])
            lo = int(rng.integers(0, max(1, len(b) - 9)))
            at = int(rng.integers(0, len(w) + 1))
            w[at:at] = [x.upper() for x in b[lo : lo + int(rng.integers(8, 30))]]
        docs.append((k, " ".join(w)))
    docs += [(60, "a " * 40), (61, None), (62, ""), (1, docs[1][1]), (63, "x Grüße NAÏVE élan"), (64, "GRüßE naïve (Élan) ÉLAN élan 漢字"), (None, "a " * 12)]
    want = brute(docs, items)
    assert sum(r[-1] for r in want) > 20 and found(spark, docs, items) == want


def test_long_items_held_whole(spark):
    """An item of many cells, whole, in parts across cells' borders, and with words changed."""
    rng = np.random.default_rng(8)
    w = [f"t{int(k)}" for k in rng.permutation(700)]
    docs = [(1, " ".join(w)), (2, " ".join(["pad"] * 33 + w[55:75] + ["pad"] + w[120:140])), (3, " ".join(x if k % 9 else "no" for k, x in enumerate(w))), (4, " ".join(w[:300] + ["no"] + w[300:]))]
    items = [(1, " ".join(w)), (2, " ".join(w[60:70]))]
    want = brute(docs, items)
    assert found(spark, docs, items) == want and [r[2] for r in want] == [700, 40, 0, 700]


def edits(win, w):
    """The fewest changes that make a stretch of ``w`` into ``win``."""
    row = [0] * (len(w) + 1)
    for i, x in enumerate(win, 1):
        new = [i]
        for j, y in enumerate(w, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def brute_near(docs, items, changes, size=10):
    out = []
    for i, text in docs:
        w, met = words(text), set()
        for name, t in items:
            b = words(t)
            if any(edits(b[k : k + size], w) <= changes for k in range(len(b) - size + 1)):
                met.add(str(name))
        out.append((i, tuple(sorted(met))))
    return sorted(out, key=str)


@pytest.mark.parametrize("small", [de.SMALL, 0])
def test_proximity_against_edit_distance(spark, small, monkeypatch):
    """Words changed, put in and left out, at the ends of texts too: all windows within two changes are found and no others."""
    monkeypatch.setattr(de, "SMALL", small)
    rng = np.random.default_rng(15)
    items = [(k, " ".join(words_of(rng, int(n), 50))) for k, n in enumerate([10, 10, 12, 30, 9, 3, 60])] + [(7, "a b " * 8), (8, None)]
    docs = []
    for k in range(150):
        b = words(items[int(rng.integers(0, 7))][1])
        lo = int(rng.integers(0, max(1, len(b) - 10)))
        w = b[lo : lo + 10 + k % 3]
        for _ in range(k % 5):
            at, how = int(rng.integers(0, len(w))), int(rng.integers(0, 3))
            w[at : at + (how != 1)] = [] if how == 2 else [words_of(rng, 1, 50)[0]]
        pad = [words_of(rng, int(n), 50) for n in rng.integers(0, 12, 2) * (k % 4 > 0)]
        docs.append((k, " ".join([*pad[0], *w, *pad[1]])))
    docs += [(150, "b a b a a b a b a b"), (151, None), (152, ""), (153, "a " * 30), (1, docs[1][1]), (None, docs[2][1])]
    want = brute_near(docs, items, 2)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, tuple(r.near_items)) for r in de.contamination(d, b).collect()), key=str)
    exact = {(i, n) for i, _, _, n, *_ in brute(docs, items)}
    assert got == want and sum(bool(m) for _, m in want) > 80 and sum(not m for _, m in want) > 20
    assert sum(bool(m) and (i, 0) in exact for i, m in want) > 30  # by proximity alone
    kept = {r.doc_id for r in de.drop_contaminated(d, b, changes=2).collect()}
    gone = {i for i, m in want if m} | {i for i, _, hit, *_ in brute(docs, items) if hit}
    assert kept == {i for i, _ in docs} - gone


def test_ninth_word_changed(spark):
    w = [f"t{k}" for k in range(15)]
    items = spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")
    often = ["x" if k % 3 == 2 else t for k, t in enumerate(w)]  # three changes in any ten words
    docs = spark.createDataFrame([(1, " ".join([*w[:8], "x", *w[9:]])), (2, " ".join(often)), (3, " ".join(w))], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.n_near_items) for r in de.contamination(docs, items).collect()}
    assert got == {1: (0, 0, 1), 2: (0, 0, 0), 3: (15, 1, 1)}


def test_awkward_and_empty(spark):
    docs, n = awkward(spark)
    items = spark.createDataFrame([(1, "a text without an id")], "item_id long, text string")
    got = de.contamination(docs, items).collect()
    assert len(got) == n and [r.doc_id for r in got if r.contaminated] == [None]
    kept = de.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == n - 1
    assert {(r.key, r._hit) for r in kept.collect()} == {("x", "x")}
    assert de.contamination(empty(spark), items).count() == 0
    assert not any(r.contaminated for r in de.contamination(docs, items.where("item_id < 0")).collect())
    assert spark.createDataFrame([], DOCS).count() == 0


def test_items_without_an_id(spark):
    d = spark.createDataFrame([(1, "a p q r s b"), (2, "x y z p q r s"), (3, "x y q p")], "doc_id long, text string")
    b = spark.createDataFrame([(None, "p q r s"), (3, "x y z"), (None, "s b")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r["items"], r.contaminated) for r in de.contamination(d, b).collect()}
    assert got == {1: (5, 1, [], True), 2: (7, 2, ["3"], True), 3: (0, 0, [], False)}
    assert [r.doc_id for r in de.drop_contaminated(d, b).collect()] == [3]

"""The audit against a plain one over all orders, document by document."""

import re
from collections import Counter
from itertools import permutations

import numpy as np
from data import DOCS, awkward, empty

from pairlace.llm import filter_audit as fa

LABELS = "doc_id long, quality int, toxic int"


def plain(rows, labels):
    """Rows of (doc_id, text, lang): each order is applied to each document."""
    least = {}
    for id_, text, _ in rows:
        if id_ is not None:
            least[text or ""] = min(id_, least.get(text or "", id_))
    out = Counter()
    for id_, text, lang in rows:
        t = text or ""
        w = [x for x in re.split("[\\x20\\x09-\\x0D]+", t) if x]
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": id_ is not None and id_ > least[t]}
        good, toxic = (any(x[0] == id_ and id_ is not None and x[k] == 1 for x in labels) for k in (1, 2))
        for order in permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                k = lang or "", "".join(order), step
                here = fails[f] and not gone
                out[k, "removed"] += here
                out[k, "redundant"] += fails[f] and gone
                out[k, "unique_fails"] += fails[f] and sum(fails.values()) == 1
                out[k, "good_lost"] += here and good
                out[k, "toxic_lost"] += here and toxic
                out[k[0], f, "shapley"] += here
                gone = gone or fails[f]
                out[k, "kept"] += not gone
    return out


def same(spark, rows, labels, docs=None):
    docs = spark.createDataFrame([(a, b, c, None, None) for a, b, c in rows], DOCS) if docs is None else docs
    want = plain(rows, labels)
    got = fa.audit(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == 600 * len({r[2] or "" for r in rows})
    for r in got:
        k = r.part, r.filter_order, r.step
        assert {c: r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")} == {c: want[k, c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")}
        assert r.shapley == want[r.part, r.filter_order[r.step - 1], "shapley"]


def texts(rng, n):
    kinds = [lambda: " ".join(f"w{k}" for k in rng.integers(0, 5000, 120)), lambda: " ".join(f"w{k}" for k in rng.integers(0, 20, 110)), lambda: "ABC DEF " * 10, lambda: "é # b", lambda: "short ÄÖ text"]
    return [kinds[int(rng.integers(len(kinds)))]() for _ in range(n)]


def test_against_plain(spark):
    rng = np.random.default_rng(5)
    pool = texts(rng, 40)
    rows = [(int(k), pool[int(rng.integers(len(pool)))], ("en", "de", None)[int(rng.integers(3))]) for k in rng.permutation(150)]
    labels = [(int(k), int(rng.integers(2)), int(rng.integers(2))) for k in rng.integers(0, 200, 120)]
    same(spark, rows, labels)


def test_colliding_fingerprints_and_flushes(spark, monkeypatch):
    """One fingerprint for all: chains tell texts apart by the texts."""
    rng = np.random.default_rng(6)
    chains, told = fa.Chains(), []
    for k in rng.permutation(200):
        told += chains.put(7, b"text %d" % (k % 9), int(k), {"en": 1})
    assert sorted(link[1] for _, link in chains.take()) == list(range(9)) and sorted(r[0] for r in told) == list(range(9, 200))
    monkeypatch.setattr(fa, "FLUSH_BYTES", 10)
    rows = [(fp, t, i, "en") for i, (fp, t) in enumerate([(1, "a" * 8), (1, "b" * 8), (1, "a" * 8), (2, "c"), (1, "b" * 8)])]
    met = sorted(fa._met(list(fa._settled(rows))))
    assert [(i, bool(mask & fa.COPY)) for i, _, mask, _ in met] == [(0, False), (1, False), (2, True), (3, False), (4, True)]


def test_awkward_rows(spark):
    df, _ = awkward(spark)
    rows = [(r.doc_id, r.text, r.lang) for r in df.select("doc_id", "text", "lang").collect()]
    same(spark, rows, [(1, 1, 0), (1, 0, 1), (None, 1, 1), (9, None, 1), (7, 1, None)], df)


def test_a_hot_text(spark):
    """Most rows have one text; each input partition passes it on once."""
    rows = [(k, "one text" if k % 3 else f"text {k}", "en") for k in range(400)]
    docs = spark.createDataFrame([(a, b, c, None, None) for a, b, c in rows], DOCS)
    masks = {r.doc_id: r.mask for r in fa.document_masks(docs).collect()}
    assert {k for k, m in masks.items() if m & fa.COPY} == {k for k, t, _ in rows if t == "one text" and k != 1}
    keyed = list(fa._settled([(5, t, k, "en") for k, t, _ in rows if t == "one text"]))
    assert sum(raw is not None for _, (raw, *_) in keyed) == 1


def test_empty_table(spark):
    assert fa.audit(empty(spark), spark.createDataFrame([], LABELS)).count() == 0

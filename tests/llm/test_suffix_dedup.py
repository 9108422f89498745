"""Removed bytes against a plain search of all strings, and the suffix order against sorting."""

import hashlib

import numpy as np
import pytest
from data import DOCS, awkward, empty

from pairlace.llm import suffix_dedup as sd


def plain(rows):
    """``n_bytes, n_removed, n_spans, kept_sha256`` of each (id, text)."""
    least: dict[bytes, int] = {}
    raws = [(i, (t or "").encode()) for i, t in rows]
    for i, raw in raws:
        if i is not None:
            for p in range(len(raw) - 49):
                s = raw[p : p + 50]
                least[s] = min(i, least.get(s, i))
    out = []
    for i, raw in raws:
        gone = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - 49):
            if i is not None and least[raw[p : p + 50]] < i:
                gone[p : p + 50] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone[:-1]]) if raw else b""
        out.append((i, len(raw), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def same(spark, rows, docs=None):
    docs = spark.createDataFrame([(i, t, "en", "web", None) for i, t in rows], DOCS) if docs is None else docs
    got = sorted((tuple(r) for r in sd.dedup(docs).collect()), key=str)
    assert got == plain(rows)
    return got


def passages(rng, n):
    """Texts of pieces from a small pool, so that strings of every length around 50 bytes are shared."""
    word = lambda: "".join(chr(97 + int(k)) for k in rng.integers(0, 26, int(rng.integers(1, 9))))
    pool = [" ".join(word() for _ in range(int(rng.integers(3, 60)))) + ("é" if rng.random() < 0.3 else "") for _ in range(12)]
    out = []
    for _ in range(n):
        parts = [pool[int(rng.integers(len(pool)))] if rng.random() < 0.5 else " ".join(word() for _ in range(int(rng.integers(1, 30)))) for _ in range(int(rng.integers(1, 6)))]
        out.append("".join(p[int(rng.integers(0, 8)) :] for p in parts))
    return out


@pytest.mark.parametrize("very", [2000, 2, 0])
def test_against_plain(spark, monkeypatch, very):
    """With several chunks, ranges and blocks, and with strings dealt by their own hash."""
    rng = np.random.default_rng(3)
    texts = passages(rng, 60)
    texts += [texts[3], texts[7][:-1], "ab" * 80, "ab" * 60 + "x", "a" * 49, "a" * 50, "b" * 120, "b" * 120, ""]
    rows = [(int(k), t) for k, t in zip(rng.permutation(len(texts)), texts, strict=True)]
    monkeypatch.setattr(sd, "VERY_MANY", very)
    monkeypatch.setattr(sd, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(sd, "KEY_RANGE_BYTES", 5000)
    monkeypatch.setattr(sd, "RANGE_BYTES", 2000)
    assert sum(r[2] for r in same(spark, rows)) > 1000


def test_blocks_and_flushes_agree(monkeypatch):
    """Anchors of a text cut into blocks cover the same strings."""
    data = np.frombuffer(" ".join(passages(np.random.default_rng(1), 30)).encode(), np.uint8)
    offs = np.array([0, 40, 90, 91, 700, len(data)])
    cover = lambda: sorted((int(t), int(q)) for qs, lo, hi, *_ in sd.anchors(data, offs) for q, a, b in zip(qs, lo, hi) for t in range(a, b + 1))
    whole = cover()
    assert [t for t, _ in whole] == [t for t in range(len(data) - 49) if np.searchsorted(offs, t, "right") == np.searchsorted(offs, t + 49, "right")]
    assert all(t <= q <= t + sd.SPREAD for t, q in whole)
    monkeypatch.setattr(sd, "BLOCK", 100)
    assert cover() == whole


def test_suffix_order_and_factors():
    rng = np.random.default_rng(2)
    texts = rng.integers(97, 99, (300, 7)).astype(np.uint8)
    order, tied = sd.suffix_order(texts)
    rows = [bytes(t) for t in texts]
    assert order.tolist() == sorted(range(300), key=lambda k: (rows[k], k))
    assert tied.tolist() == [k > 0 and rows[order[k]] == rows[order[k - 1]] for k in range(300)]
    for key in (rng.integers(0, 40, 300), np.arange(300), np.arange(300)[::-1], np.zeros(300, int)):
        assert sd.has_previous_factor(texts, key).tolist() == [any(rows[j] == rows[k] and key[j] < key[k] for j in range(300)) for k in range(300)]


def test_a_passage_in_most_documents(spark, monkeypatch):
    monkeypatch.setattr(sd, "VERY_MANY", 5)
    rows = [(k, f"own words {k * 7919} of the text {k} " + "a passage that very many documents hold, word by word and line by line " + f"and more {k}") for k in range(60)]
    assert sum(r[2] > 0 for r in same(spark, rows)) == 59


def test_awkward_rows(spark):
    df, _ = awkward(spark)
    same(spark, [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], df)


def test_empty_table(spark):
    assert sd.dedup(empty(spark)).count() == 0

"""Personal data: base spans against plain regular expressions, the random field on made sentences."""

import itertools
import re

import numpy as np
import pytest
from data import DOCS, awkward, empty
from hypothesis import given, settings
from hypothesis import strategies as st

from pairlace.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for c, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            twice = sum(sum(divmod(int(v) * (1 + k % 2), 10)) for k, v in enumerate(reversed(d)))
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 14 <= len(d) <= 19 and twice % 10 == 0, "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), m.end(), c))
    return sorted(out, key=lambda s: (s[0], s[2]))


@settings(max_examples=400, deadline=None)
@given(st.one_of(*[st.text(alphabet=a, max_size=60) for a in ("a@.-1 +", "0123456789. -", "+12 ().-", "ab@.é%1\n", "40 -")]))
def test_base_spans(text):
    assert pii.base_spans(text) == brute(text)


@pytest.fixture(scope="module")
def model(spark):
    return pii.train(pii.labelled_table(spark))


def test_base_and_added(spark, model):
    texts = ["Call (555) 123-4567 today", "write é.b@c-d.org, or 10.20.30.40!", "card 4111 1111 1111 1111 and +49 (30) 1234-5678.", "at 12:30 on 2024-01-02 for 300,000 of 5.5", None, "", "no digits here"]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame([(k, t, "en", "web", 0) for k, t in enumerate(texts)], DOCS), model).collect()}
    for k, t in enumerate(texts):
        want = [f"{pii.KINDS[c]}:{a}:{b}" for a, b, c in brute(t or "")]
        assert got[k].base == want and set(want) <= set(got[k].spans)
        assert [got[k][f"n_{x}"] for x in pii.KINDS] == [sum(w.startswith(x) for w in want) for x in pii.KINDS]
    assert "phone:5:19" in got[0].spans and got[0].base == []
    assert got[3].spans == [] and got[6].spans == []


def test_held_out_accuracy(model, spark):
    """On sentences of the same kind but other draws, nearly all labels are right."""
    w, t = model
    rows = pii.labelled_table(spark, n=900).collect()[600:]  # beyond the training rows of the same stream
    hit = total = 0
    for r in rows:
        y = pii.viterbi(w[pii.word_features(list(r.words))[None]].sum(2), t)[0]
        hit += sum(pii.LABELS[a] == b for a, b in zip(y, r.labels, strict=True))
        total += len(y)
    assert hit / total > 0.97


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    e, t = rng.normal(size=(5, 4, 3)), rng.normal(size=(3, 3))
    for chain, y in zip(e, pii.viterbi(e, t), strict=True):
        score = lambda p, c=chain: sum(c[k, a] for k, a in enumerate(p)) + sum(t[a, b] for a, b in itertools.pairwise(p))
        assert tuple(y) == max(itertools.product(range(3), repeat=4), key=score)


def test_awkward_and_empty(spark, model):
    docs, n = awkward(spark)
    assert pii.find(docs, model).count() == n and pii.find(empty(spark), model).count() == 0
    long = "1 " * 200_000 + "a@b.org"
    r = pii.find(spark.createDataFrame([(1, long, "en", "web", 0)], DOCS), model).first()
    assert r.n_email == 1 and r.base[-1] == f"email:{len(long) - 7}:{len(long)}"

"""Language identification: held-out accuracy, undecided texts, the kernel."""

import numpy as np
from data import DOCS, awkward, empty

from pairlace.llm import language_id as li

STOPS = {"en": "the of and to in is that it was for", "de": "der die und das ist nicht ein mit auf für", "fr": "le la les et des une est dans pour avec", "es": "el los las una que por para como más pero"}
ENDS = {"en": ["ing", "ed", "ly"], "de": ["ung", "lich", "en"], "fr": ["eux", "ait", "ique"], "es": ["ción", "ado", "mente"]}


def text(rng, lang, n):
    stem = lambda: "".join(rng.choice(list("abcdefghilmnoprstu"), int(rng.integers(2, 6))))
    return " ".join(str(rng.choice(STOPS[lang].split())) if rng.random() < 0.5 else stem() + str(rng.choice(ENDS[lang])) for _ in range(n))


def test_held_out_accuracy(spark):
    rng = np.random.default_rng(1)
    langs = [str(v) for v in rng.choice(list(STOPS), 900, p=[0.7, 0.1, 0.1, 0.1])]
    docs = spark.createDataFrame([(k, text(rng, v, int(rng.integers(12, 80))), v, "web", 0) for k, v in enumerate(langs)], DOCS)
    model = li.train(docs.where("doc_id % 3 <> 0"))
    got = li.identify(docs.where("doc_id % 3 = 0"), model).collect()
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_inputs_of_a_prediction(spark):
    """Neither lang, source nor id plays a part, and texts without a letter are undecided."""
    rng = np.random.default_rng(2)
    docs = spark.createDataFrame([(k, text(rng, v, 30), v, "web", 0) for k, v in enumerate(list(STOPS) * 40)], DOCS)
    model = li.train(docs)
    rows = [(1, "the thing was ending", "de", "a", 0), (2, "the thing was ending", None, None, None), (3, None, "en", "web", 0), (4, "12 34 !?", "en", "web", 0), (5, "«» — …", "en", "web", 0), (6, "漢字", "en", "web", 0), (7, "", "en", "web", 0)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in li.identify(spark.createDataFrame(rows, DOCS), model).collect()}
    assert got[1] == got[2] and got[1][0] == "en"
    assert all(got[k] == ("und", 0.0) for k in (3, 4, 5, 7)) and got[6][0] in STOPS


def test_kernel_counts_shared_grams():
    data = np.frombuffer(b"abcabcxy", np.uint8)
    x = li.presence(data, np.array([0, 3, 6, 8]))
    k = li.kernel(x, x)
    assert np.allclose(np.diag(k), 1) and np.isclose(k[0, 1], 1) and k[0, 2] == 0


def test_awkward_and_empty(spark):
    docs, n = awkward(spark)
    assert li.identify(docs, li.train(docs)).count() == n
    assert li.train(empty(spark)) is None
    assert {r.lang_pred for r in li.identify(docs, None).collect()} == {"und"}
    assert li.identify(empty(spark), li.train(docs)).count() == 0

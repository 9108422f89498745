"""Personal data by base patterns and a linear-chain conditional random field.

The patterns give spans of four kinds. The random field labels white-space words by features of their shapes and adds
the spans that no pattern span touches. It is trained on a small labelled table, by gradients from forward-backward,
and decoded by Viterbi in numpy batches. A word without digit and ``@`` whose neighbours have none either is outside
any span by definition; such words cut a text into short chains, which are decoded together by length.

Null text is empty. Whole texts are searched, of any length, each in one pass. Repeated rows get a row each; an empty table
gives no rows. Labels that score alike go by their order, spans that start alike by kind. Offsets
are code points, ends exclusive. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlace.llm.common import WHITE, only

# The kinds in their order, and the base patterns. Possessive forms match the same spans in linear time.
KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
LABELS = ("O", "EMAIL", "IP", "B-CARD", "I-CARD", "B-PHONE", "I-PHONE")
SHAPES, EPOCHS, RATE, L2 = 512, 120, 0.5, 1e-3
FIELDS = 7


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost spans around each ``@``; the local part reaches back to the last span or to another character."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        if at >= last:
            start = at
            while start > last and LOCAL.match(text[start - 1]):
                start -= 1
            m = DOMAIN.match(text, at + 1) if start < at else None
            if m:
                out.append((start, m.end()))
                last = m.end()
            elif start < at:
                last = at  # nothing before this @ can begin a span any more
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``start, end, kind`` of the base patterns, each kind by itself."""
    out = [(a, b, 0) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        parts = m.group().split(".")
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts):
            out.append((m.start(), m.end(), 1))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = NOT_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


# ---- the random field ----------------------------------------------------------------------------------------

def shape(word: str) -> str:
    """Letters as a, digits as 0, runs of equal signs cut to two; a very long word by its first and last parts."""
    w = word if len(word) <= 64 else word[:32] + word[-32:]
    w = re.sub(r"[^\W\d_]", "a", re.sub(r"[0-9]", "0", w))
    return re.sub(r"(.)\1{2,}", r"\1\1", w)


def _bucket(name: str, v: object) -> int:
    return zlib.crc32(f"{name}={v}".encode()) % SHAPES


def _own_buckets(w: str) -> tuple[int, ...]:
    """Buckets of the word's shape as its own, as a left and as a right neighbour's, then of its signs."""
    s, digits = shape(w), sum(map(w.count, "0123456789")) if len(w) <= 64 else 65
    signs = (w[:1] == "+", w[:1] == "(", "@" in w, "." in w, "-" in w)
    return _bucket("s", s), _bucket("l", s), _bucket("r", s), _bucket("d", min(digits, 20)), _bucket("f", signs), _bucket("dots", min(w.count("."), 5)), _bucket("n", (digits == len(w), min(len(w), 20)))


_remembered = lru_cache(1 << 16)(_own_buckets)


def word_features(words: list[str]) -> np.ndarray:
    """Buckets of each word: its shape, the neighbours' shapes, counts of digits, dots and signs. Short words that come
    again are looked up."""
    own = [_remembered(w) if len(w) <= 64 else _own_buckets(w) for w in words]
    left, right = [_bucket("l", "^"), *[o[1] for o in own[:-1]]], [*[o[2] for o in own[1:]], _bucket("r", "$")]
    return np.array([(o[0], a, b, *o[3:]) for o, a, b in zip(own, left, right, strict=True)], np.int64).reshape(-1, FIELDS)


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def train_crf(chains: list[tuple[list[str], list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Emission and transition weights by gradient ascent on the chains' mean log likelihood (Adagrad)."""
    n_l = len(LABELS)
    w, t = np.zeros((SHAPES, n_l)), np.zeros((n_l, n_l))
    gw2, gt2 = np.full_like(w, 1e-6), np.full_like(t, 1e-6)
    by: dict[int, list] = {}
    for words, labels in chains:
        if words:
            by.setdefault(len(words), []).append((word_features(words), labels))
    packs = [(np.stack([f for f, _ in v]), np.array([y for _, y in v])) for v in by.values()]
    total = sum(len(y) for _, y in packs) or 1
    for _ in range(EPOCHS):
        gw, gt = -L2 * w, -L2 * t
        for f, y in packs:
            e = w[f].sum(2)
            n, length = y.shape
            fwd, bwd = np.zeros((length, n, n_l)), np.zeros((length, n, n_l))
            fwd[0] = e[:, 0]
            for k in range(1, length):
                fwd[k] = e[:, k] + log_sum(fwd[k - 1][:, :, None] + t, 1)
            for k in range(length - 2, -1, -1):
                bwd[k] = log_sum(t[None] + (e[:, k + 1] + bwd[k + 1])[:, None, :], 2)
            z = log_sum(fwd[-1], 1)
            for k in range(length):
                d = -np.exp(fwd[k] + bwd[k] - z[:, None])
                d[np.arange(n), y[:, k]] += 1
                for c in range(FIELDS):
                    np.add.at(gw, f[:, k, c], d / total)
                if k:
                    pair = fwd[k - 1][:, :, None] + t + (e[:, k] + bwd[k])[:, None, :] - z[:, None, None]
                    gt -= np.exp(pair).sum(0) / total
                    np.add.at(gt, (y[:, k - 1], y[:, k]), 1 / total)
        gw2 += gw * gw
        gt2 += gt * gt
        w = w + RATE * gw / np.sqrt(gw2)
        t = t + RATE * gt / np.sqrt(gt2)
    return w, t


def viterbi(e: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The best labels of each chain (chains x length x labels)."""
    n, length, _ = e.shape
    best, back = e[:, 0], np.zeros((n, length, e.shape[2]), np.int64)
    for k in range(1, length):
        s = best[:, :, None] + t
        back[:, k] = s.argmax(1)
        best = s.max(1) + e[:, k]
    out = np.zeros((n, length), np.int64)
    out[:, -1] = best.argmax(1)
    for k in range(length - 1, 0, -1):
        out[:, k - 1] = back[np.arange(n), k, out[:, k]]
    return out


def chains_of(text: str) -> list[list[tuple[int, int]]]:
    """Spans of the words in each chain: words with a digit or ``@`` and one on each side."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    small = np.minimum(code, 255)
    word = ~(WHITE[small] & (code < 128))
    edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    hot = ((code >= 48) & (code <= 57)) | (code == 64)
    seen = np.concatenate([[0], np.cumsum(hot)])
    at = np.flatnonzero(seen[ends] > seen[starts])
    out: list[list[tuple[int, int]]] = []
    last = -1
    for i in at.tolist():
        lo = max(i - 1, 0)
        if out and lo <= last + 1:
            lo = last + 1
        else:
            out.append([])
        hi = min(i + 1, len(starts) - 1)
        out[-1] += [(int(starts[k]), int(ends[k])) for k in range(lo, hi + 1) if k > last]
        last = max(last, hi)
    return out


def field_spans(texts: list[str], model: tuple[np.ndarray, np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """Spans that the random field finds in each text; chains of all texts of one length are decoded together."""
    w, t = model
    by: dict[int, list] = {}
    for k, text in enumerate(texts):
        for chain in chains_of(text):
            by.setdefault(len(chain), []).append((k, chain, word_features([text[a:b] for a, b in chain])))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for items in by.values():
        for lo in range(0, len(items), 2000):
            part = items[lo : lo + 2000]
            labels = viterbi(w[np.stack([f for _, _, f in part])].sum(2), t)
            for (k, chain, _), ys in zip(part, labels.tolist(), strict=True):
                out[k] += spans_of(texts[k], chain, ys)
    return out


def sound(found: str, kind: int) -> bool:
    """Whether a labelled span can be of its kind at all: made of its signs, of a fit length, its checksum right."""
    digits = NOT_DIGIT.sub("", found)
    if kind == 0:
        local, _, domain = found.partition("@")
        return bool(local) and "." in domain and "@" not in domain
    if re.search(r"[^0-9\s().+/-]", found):
        return False
    if kind == 1:
        parts = found.split(".")
        return len(parts) == 4 and all(p.isdigit() and len(p) < 4 and int(p) <= 255 for p in parts)
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 9 <= len(digits) <= 15


def spans_of(text: str, chain: list[tuple[int, int]], labels: list[int]) -> list[tuple[int, int, int]]:
    """Labelled words as spans without punctuation at their ends; unsound ones go."""
    out, k = [], 0
    while k < len(chain):
        name = LABELS[labels[k]]
        if name == "O":
            k += 1
            continue
        kind = KINDS.index(name.split("-")[-1].lower())
        j = k + 1
        while j < len(chain) and LABELS[labels[j]] == "I-" + name[2:] and name[:1] in "BI":
            j += 1
        a, b = chain[k][0], chain[j - 1][1]
        k = j
        while a < b and not (text[a].isalnum() or text[a] in "+("):
            a += 1
        while b > a and not text[b - 1].isalnum():
            b -= 1
        if b - a < 100 and sound(text[a:b], kind):
            out.append((a, b, kind))
    return out


def labelled_table(spark: SparkSession, n: int = 600) -> DataFrame:
    """``words, labels``: a small table from templates, with dates, times, prices, versions and order numbers as what is
    no personal data."""
    rng = np.random.default_rng(11)
    dg = lambda k: "".join(rng.choice(list("0123456789"), k))
    ab = lambda: "".join(rng.choice(list("abcdehilmnorstu"), rng.integers(2, 9)))

    def one() -> list[tuple[str, str]]:
        k = int(rng.integers(0, 16))
        if k == 0:
            return [(f"{ab()}{rng.choice(['.', '_', ''])}{ab()}@{ab()}.{rng.choice(['com', 'org', 'net', 'de'])}", "EMAIL")]
        if k == 1:
            return [(".".join(str(rng.integers(1, 255)) for _ in range(4)), "IP")]
        if k == 2:
            return [(p, "I-CARD" if i else "B-CARD") for i, p in enumerate(dg(4) for _ in range(4))]
        if k == 3:
            return [(rng.choice([dg(16), "-".join(dg(4) for _ in range(4))]), "B-CARD")]
        if k == 4:
            return [(p, "I-PHONE" if i else "B-PHONE") for i, p in enumerate([f"+{dg(int(rng.integers(1, 3)))}", dg(3), dg(3), dg(4)])]
        if k == 5:
            return [(p, "I-PHONE" if i else "B-PHONE") for i, p in enumerate([f"+{dg(1)}", f"({dg(3)})", f"{dg(3)}-{dg(4)}"])]
        if k == 6:
            return [(f"+{dg(int(rng.integers(10, 13)))}", "B-PHONE")]
        if k == 7:
            return [(p, "I-PHONE" if i else "B-PHONE") for i, p in enumerate([f"({dg(3)})", f"{dg(3)}-{dg(4)}"])]
        if k == 8:
            return [(f"+{dg(1)}-{dg(3)}-{dg(3)}-{dg(4)}", "B-PHONE")]
        plain = [f"20{dg(2)}-{dg(2)}-{dg(2)}", f"{dg(2)}:{dg(2)}", f"{dg(2)}.{dg(2)}", f"{dg(1)}.{dg(1)}.{dg(2)}", dg(int(rng.integers(1, 6))), f"{dg(3)},{dg(3)}", f"#{dg(5)}", f"{ab()}{dg(2)}", f"@{ab()}", dg(int(rng.integers(6, 10))), f"{dg(2)}%", f"{dg(2)}/{dg(2)}/20{dg(2)}", f"{ab()}-{dg(4)}"]
        return [(str(rng.choice(plain)), "O")]

    rows = []
    for _ in range(n):
        row = [(ab(), "O")]
        for _ in range(int(rng.integers(1, 3))):
            found = one()
            if rng.random() < 0.3:
                found[-1] = (found[-1][0] + str(rng.choice([".", ",", ";"])), found[-1][1])
            row += found + [(ab() + str(rng.choice(["", ".", ","])), "O")] * int(rng.integers(1, 3))
        rows.append(([w for w, _ in row], [y for _, y in row]))
    return spark.createDataFrame(rows, "words array<string>, labels array<string>")


def train(table: DataFrame, most: int = 5000) -> tuple[np.ndarray, np.ndarray]:
    """The model from at most ``most`` rows of ``words, labels``, in order of their hash."""
    got = table.orderBy(F.xxhash64("words", "labels"), "words", "labels").limit(most).collect()
    return train_crf([(list(r.words), [LABELS.index(y) for y in r.labels]) for r in got])


def find(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``doc_id, base, added``: spans of the patterns and of the random field, as ``kind:start:end`` arrays with the
    counts ``n_email, n_ip, n_card, n_phone`` of the former."""
    names = [f"n_{k}" for k in KINDS]
    kinds = ", ".join(["doc_id long", *[f"{n} long" for n in names], "base array<string>", "spans array<string>"])
    d = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hint = re.compile("[0-9@]")

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                texts = pc.fill_null(batch.column("text"), "").to_pylist()
                hot = [k for k, v in enumerate(texts) if hint.search(v)]
                base: list[list] = [[] for _ in texts]
                spans: list[list] = [[] for _ in texts]
                added = field_spans([texts[k] for k in hot], model)
                for k, more in zip(hot, added, strict=True):
                    base[k] = base_spans(texts[k])
                    covered = np.zeros(len(texts[k]) + 1, bool)
                    for a, b, _ in base[k]:
                        covered[a:b] = True
                    spans[k] = sorted(base[k] + [s for s in more if not covered[s[0] : s[1]].any()], key=lambda s: (s[0], s[2], s[1]))
                told = lambda rows: pa.array([[f"{KINDS[c]}:{a}:{b}" for a, b, c in r] for r in rows], pa.list_(pa.string()))
                n = [pa.array([sum(s[2] == c for s in r) for r in base], pa.int64()) for c in range(len(KINDS))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *n, told(base), told(spans)], names=["doc_id", *names, "base", "spans"])

    return d.mapInArrow(run, kinds)

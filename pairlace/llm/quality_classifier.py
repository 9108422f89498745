"""Quality classifier by co-training.

Two views of a document have a classifier each: its content (hashed character trigrams) and its page metadata (source,
language and layout figures). Both start from a bounded sample of labelled rows. In each round a view labels
those rows of a bounded unlabelled pool it is surest of, and the other view learns from them too. In the end a
logistic rule, fitted on labelled rows held back, calibrates and combines the views; it scores every document.

Bounds: ``labelled`` and ``pool`` rows are fitted on, taken by least hash of the id; all documents are scored. Labels of
an id that disagree are left out; of rows with the same id one is fitted on. If there are no labels, or of one kind only, each document scores 1. Null text
is an empty text. A very long text is one chunk, counted whole. Scores at the threshold stay. Repeated rows get a row each;
an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlace.llm.common import WHITE, one_row_each, only, text_chunks, word_hashes, words_of

TRIGRAMS, SOURCES, FIGURES = 1024, 64, 12
LANGS = 16
LABELLED, POOL, ROUNDS, ADDED = 6000, 3000, 4, 300


def content_view(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Log counts of hashed byte trigrams, of unit length."""
    n = len(offs) - 1
    out = np.zeros((n, TRIGRAMS), np.float32)
    if len(data) >= 3:
        d = data.astype(np.uint32)
        h = ((d[:-2] * np.uint32(2654435761) ^ d[1:-1] * np.uint32(40503 * 65537) ^ d[2:] * np.uint32(2246822519)) * np.uint32(3266489917)) >> np.uint32(22)
        row = np.repeat(np.arange(n, dtype=np.int32), np.diff(offs))
        inside = row[:-2] == row[2:]
        out = np.bincount(row[:-2][inside] * TRIGRAMS + h[inside].astype(np.int64), minlength=n * TRIGRAMS).reshape(n, TRIGRAMS).astype(np.float32)
    out = np.log1p(out)
    return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-6)


def metadata_view(data: np.ndarray, offs: np.ndarray, langs: list, sources: list) -> np.ndarray:
    """Layout figures, then one-hot hashes of language and source."""
    n = len(offs) - 1
    starts, ends, first = words_of(data, offs)
    h = word_hashes(data, starts, ends)
    size = np.maximum(np.diff(offs), 1).astype(float)

    def share(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask)])
        return (c[offs[1:]] - c[offs[:-1]]) / size

    words = np.diff(first)
    uniq = np.array([len(np.unique(h[a:b])) for a, b in zip(first[:-1], first[1:], strict=True)]) / np.maximum(words, 1)
    same = np.concatenate([[0], np.cumsum(np.concatenate([[0], h[1:] == h[:-1]]))]) if len(h) else np.zeros(1)
    twice = (same[first[1:]] - same[np.minimum(first[:-1] + 1, first[1:])]) / np.maximum(words, 1)
    letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    upper, digit = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57)
    symbol = (data < 128) & ~letter & ~digit & ~WHITE[data]
    lines = share(data == 10) * size
    f = np.stack([np.log1p(size) / 10, np.log1p(words) / 8, np.log1p(lines) / 5, share(letter), share(upper), share(digit), share(symbol), share(WHITE[data]), uniq, twice, share(data == 33) * 5, share(data == 124) * 5], 1)
    out = np.zeros((n, FIGURES + LANGS + SOURCES), np.float32)
    out[:, :FIGURES] = f * 3
    for i, (a, b) in enumerate(zip(langs, sources, strict=True)):
        out[i, FIGURES + zlib.crc32(str(a).encode()) % LANGS] = 0.3
        out[i, FIGURES + LANGS + zlib.crc32(str(b).encode()) % SOURCES] = 0.3
    return out


def views(batch: pa.RecordBatch):
    lang, source = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
    for lo, hi, data, offs in text_chunks(batch):
        yield lo, hi, content_view(data, offs), metadata_view(data, offs, lang[lo:hi], source[lo:hi])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, l2: float = 1e-4, steps: int = 150, start: np.ndarray | None = None) -> np.ndarray:
    """Weights, the last one the bias, by accelerated gradient steps; ``w`` are row weights. Products are taken in the
    rows' own precision, so that no step copies them."""
    x1 = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = w / w.sum()
    lip = 0.25 * float((w * (x1 * x1).sum(1)).sum()) + l2
    b = np.zeros(x1.shape[1]) if start is None else start.copy()
    prev, t = b.copy(), 1.0
    for _ in range(steps):
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z = b + (t - 1) / t2 * (b - prev)
        off = w * (sigmoid(x1 @ z.astype(x1.dtype)) - y)
        grad = x1.T @ off.astype(x1.dtype) + l2 * np.r_[z[:-1], 0]
        prev, b, t = b, z - grad / lip, t2
    return b


def apply(b: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x @ b[:-1].astype(x.dtype) + b[-1]


def co_train(xs: list[np.ndarray], y: np.ndarray, pools: list[np.ndarray], rounds: int = ROUNDS, added: int = ADDED) -> tuple[list[np.ndarray], np.ndarray]:
    """The two views' weights and the combining rule. A quarter of the labelled rows is held back for the rule."""
    held = np.arange(len(y)) % 4 == 3
    if len(np.unique(y[held])) < 2 or len(np.unique(y[~held])) < 2:
        held[:] = False
    fit = ~held
    rule_on = held if held.any() else fit
    share = max(1, round(added * float(y.mean()))), max(1, round(added * float(1 - y.mean())))
    given: list[dict[int, int]] = [{}, {}]
    b: list = [None, None]
    for r in range(rounds + 1):
        for v in (0, 1):
            idx = np.array(sorted(given[v]), int)
            x = np.vstack([xs[v][fit], pools[v][idx]])
            t = np.r_[y[fit], [given[v][i] for i in idx]]
            w = np.r_[np.ones(fit.sum()), np.full(len(idx), 0.5)]
            b[v] = fit_logistic(x, t, w, start=b[v], steps=300 if r == 0 else 80)
        if r == rounds or not len(pools[0]):
            break
        for v in (0, 1):
            z = apply(b[v], pools[v])
            order = np.argsort(z, kind="stable")
            free = [i for i in order.tolist() if i not in given[1 - v]]
            for i in free[::-1][: share[0]]:
                if z[i] > 2:
                    given[1 - v][i] = 1
            for i in free[: share[1]]:
                if z[i] < -2:
                    given[1 - v][i] = 0
    z = np.stack([apply(b[v], xs[v][rule_on]) for v in (0, 1)], 1)
    rule = fit_logistic(z, y[rule_on], np.ones(int(rule_on.sum())), l2=1e-3, steps=800, start=np.array([0.5, 0.5, 0.0]))
    return b, rule


def _sampled(docs: DataFrame, n: int, seed: int) -> DataFrame:
    return docs.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(n)


def _collect_views(rows: DataFrame):
    """The two views of a bounded sample, on the driver, as half floats."""
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("v", pa.binary())])

    def run(batches):
        for batch in batches:
            for lo, hi, a, c in views(batch):
                both = np.hstack([a, c]).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("y").slice(lo, hi - lo), pa.array([r.tobytes() for r in both], pa.binary())], schema=schema)

    got = rows.select("doc_id", "text", "lang", "source", "y").mapInArrow(run, "doc_id long, y int, v binary").collect()
    got.sort(key=lambda r: (r.doc_id, r.v))
    x = np.stack([np.frombuffer(bytes(r.v), np.float16) for r in got]).astype(np.float32) if got else np.zeros((0, TRIGRAMS + FIGURES + LANGS + SOURCES), np.float32)
    return [x[:, :TRIGRAMS], x[:, TRIGRAMS:]], np.array([r.y for r in got], float)


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", labelled: int = LABELLED, pool: int = POOL):
    """``(views' weights, rule)``, or None where the labels hold fewer than two kinds."""
    d = only(docs, "doc_id", "text", "lang", "source").where(F.col("doc_id").isNotNull()).withColumn("doc_id", F.col("doc_id").cast("long"))
    known = only(labels, "doc_id", target).where(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.min(target).cast("int").alias("y"), F.max(target).cast("int").alias("_z")).where("y = _z and y in (0, 1)").drop("_z")
    ids = d.select("doc_id").distinct().join(known, "doc_id", "left")
    chosen = _sampled(ids.where("y is not null"), labelled, 1).unionByName(_sampled(ids.where("y is null"), pool, 2))
    xs, y = _collect_views(one_row_each(d.join(F.broadcast(chosen), "doc_id"), "doc_id"))  # at most labelled + pool rows
    have = ~np.isnan(y)
    if len(np.unique(y[have])) < 2:
        return None
    return co_train([x[have] for x in xs], y[have], [x[~have] for x in xs])


def score_quality(docs: DataFrame, labels: DataFrame, target: str = "quality", labelled: int = LABELLED, pool: int = POOL, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, p_content, p_metadata, score`` of each row and the columns ``keep``; the score is the chance that
    the document is a good one."""
    model = train(docs, labels, target, labelled, pool)
    d = docs
    for c in ("lang", "source", "text"):
        d = d if c in d.columns else d.withColumn(c, F.lit(None).cast("string"))
    out_cols = ["doc_id", *[c for c in keep if c != "doc_id"]]
    d = d.select(*dict.fromkeys([*out_cols, "text", "lang", "source"]))
    figures = [pa.field(c, pa.float64()) for c in ("p_content", "p_metadata", "score")]
    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in d.select(*out_cols).schema.fields] + [f"{f.name} double" for f in figures])

    def run(batches):
        for batch in batches:
            for lo, hi, a, c in views(batch):
                z = [apply(model[0][v], x) for v, x in ((0, a), (1, c))] if model else [np.full(hi - lo, 30.0)] * 2
                s = apply(model[1], np.stack(z, 1)) if model else z[0]
                part = batch.select(out_cols).slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(sigmoid(v)) for v in (*z, s)]], names=[*out_cols, *[f.name for f in figures]])

    return d.mapInArrow(run, kinds)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that score at least ``threshold``; columns as given."""
    names = docs.columns
    renamed = docs.toDF(*[c if c in ("doc_id", "text", "lang", "source") else f"_own_{k}" for k, c in enumerate(names)])
    scored = score_quality(renamed, labels, keep=tuple(renamed.columns)).where(F.col("score") >= threshold)
    return scored.select(*renamed.columns).toDF(*names)

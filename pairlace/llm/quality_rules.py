"""Quality rules with robust multivariate outliers.

Counts of each whole text give the base rules and a vector of transformed statistics. For each language and source the
minimum-covariance-determinant estimate finds the centre and spread of the tightest three fifths: from two starts, medians and
means, steps refit on the rows nearest by Mahalanobis distance until the determinant falls no more, and the start that ends with
the smaller determinant counts. Rows too far from the centre are rejected.

Steps are aggregates by group: sums of products, and quantiles over values rounded to hundredths, so that what a
group gathers is bounded however many rows it has. Groups of all sizes are treated alike: a language's estimate is drawn
towards that of all rows, and a source's towards its language's, as by a hundred more rows. Null text has
no words and fails the base rules. Null language and source are values of their own. A very long text is measured in one chunk of its own. Rows at
the same distance are taken or left together. Repeated rows get a row each; an empty table gives no rows. Extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlace.llm.common import WHITE, mix, only, stored, text_chunks, word_hashes, words_of

WINDOW, SUBSET, STEPS, PRIOR_ROWS = 8, 0.6, 5, 100
SCALE = 1.9  # the spread of a normal law in seven dimensions against that of its nearest three fifths
FEATURES = ("log_words", "log_word_chars", "symbols", "upper", "dup_lines", "repeats", "marks")
FLOOR = (0.4, 0.12, 0.35, 0.35, 0.15, 0.15, 0.35)  # least standard deviation of each, so that constants don't reject
CUT = 40.0  # squared distance; about chi-square's 1 - 1e-6 for seven statistics
_SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
_LINE = np.arange(256) == 10


def counts(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each text, and the shares behind the statistics."""
    n = len(offs) - 1
    starts, ends, first = words_of(data, offs)
    words = np.diff(first)

    def summed(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return c[offs[1:]] - c[offs[:-1]]

    point = (data & 0xC0) != 0x80
    out = {"n_words": words, "word_chars": summed(point & ~WHITE[data]), "n_symbols": summed(_SYMBOL[data])}
    ls, le, lf = words_of(data, offs, _LINE)
    inked = np.concatenate([[0], np.cumsum(~WHITE[data], dtype=np.int64)])
    has = inked[le] > inked[ls]
    row = np.repeat(np.arange(n), np.diff(lf))[has]
    lines = np.bincount(row, minlength=n)
    h = mix(word_hashes(data, ls, le)[has] + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) if len(ls) else np.zeros(0, np.uint64)
    _, at = np.unique(h, return_index=True)
    out["n_dup_lines"] = lines - np.bincount(row[at], minlength=n)
    out["lines"] = lines
    rep = np.zeros(n, np.int64)
    w = word_hashes(data, starts, ends)
    if len(w) >= WINDOW:
        m = len(w) - WINDOW + 1
        owner = np.repeat(np.arange(n), words)
        whole = owner[:m] == owner[WINDOW - 1 :]
        g = owner[:m].astype(np.uint64)
        for k in range(WINDOW):
            g = mix(g * np.uint64(0x2545F4914F6CDD1D) + w[k : k + m])
        at = np.flatnonzero(whole)
        _, inv, c = np.unique(g[at], return_inverse=True, return_counts=True)
        hit = at[c[inv] > 1]
        mark = np.zeros(len(w) + 1, np.int64)
        np.add.at(mark, hit, 1)
        np.add.at(mark, hit + WINDOW, -1)
        rep = np.bincount(owner[np.cumsum(mark[:-1]) > 0], minlength=n)
    out["n_repeat_words"] = rep
    letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    digit = (data >= 48) & (data <= 57)
    out["upper"] = summed((data >= 65) & (data <= 90))
    out["marks"] = summed((data < 128) & ~letter & ~digit & ~WHITE[data])
    return out


def statistics(c: dict[str, np.ndarray]) -> np.ndarray:
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    x = np.stack([
        np.log1p(c["n_words"]), np.log(chars / words), np.log(c["n_symbols"] / chars + 0.01), np.log(c["upper"] / chars + 0.02),
        c["n_dup_lines"] / np.maximum(c["lines"], 1), c["n_repeat_words"] / words, np.log(c["marks"] / chars + 0.02),
    ], 1)
    return np.round(x, 2)


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measure(batches):
    for batch in batches:
        for lo, hi, data, offs in text_chunks(batch):
            c = counts(data, offs)
            x = statistics(c)
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("lang"), part.column("source"), *[pa.array(c[k].astype(np.int64)) for k in BASE], *[pa.array(x[:, k]) for k in range(x.shape[1])]],
                names=["doc_id", "lang", "source", *BASE, *FEATURES],
            )


def measured(docs: DataFrame) -> DataFrame:
    d = only(docs, "doc_id", "text", "lang", "source").select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")])
    kinds = ", ".join(["doc_id long, lang string, source string", *[f"{k} long" for k in BASE], *[f"{k} double" for k in FEATURES]])
    return d.mapInArrow(_measure, kinds)


def grouped(rows: DataFrame) -> DataFrame:
    """Adds ``grp``, the language and source, and ``levels``: the groups whose estimates the row takes part in, its own, its
    language's and the common one."""
    mark = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    # the length says where the language ends, whatever characters it has
    own, lang = F.concat(F.coalesce(F.length("lang"), F.lit(0)), mark("lang"), F.lit("/"), mark("source")), F.concat(F.lit("lang"), mark("lang"))
    return rows.withColumn("grp", own).withColumn("levels", F.array(own, lang, F.lit("*")))


def _distance(rows: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``d2`` under the centre and inverse covariance of the row's ``keys``. The model has a row a group and start."""
    k = len(FEATURES)
    met = rows.join(model.select(*keys, "mu", "inv"), keys)
    diff = [F.col(f) - F.col("mu")[i] for i, f in enumerate(FEATURES)]
    met = met.withColumn("_d", F.array(*diff))
    d2 = sum((F.col("_d")[i] * F.col("_d")[j] * F.col("inv")[i * k + j] for i in range(k) for j in range(k)), F.lit(0.0))
    return met.withColumn("d2", d2).drop("_d", "mu", "inv")


def _estimate(n: int, sums: list[float], products: list[list[float]]) -> tuple[np.ndarray, np.ndarray, float]:
    """Centre, scaled covariance and log determinant of a group's nearest rows. The determinant has a small ridge, so that groups
    with constant statistics can be compared too."""
    m = np.array(sums) / n
    cov = (np.array(products) / n - np.outer(m, m)) * SCALE
    return m, cov, float(np.linalg.slogdet(cov + np.diag(np.array(FLOOR) ** 2 * 1e-2))[1])


def floored(cov: np.ndarray) -> np.ndarray:
    return cov + np.diag(np.maximum(np.array(FLOOR) ** 2 - np.diag(cov), 0) + 1e-6)


MODEL = "grp string, start int, n long, mu array<double>, cov array<double>, inv array<double>, det double"


def _step(batches):
    k = len(FEATURES)
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            mu, cov, det = _estimate(r.n, [getattr(r, f"s{i}") for i in range(k)], [[getattr(r, f"q{min(i, j)}_{max(i, j)}") for j in range(k)] for i in range(k)])
            out.append((r.grp, r.start, r.n, mu.tolist(), cov.ravel().tolist(), np.linalg.inv(floored(cov)).ravel().tolist(), det))
        yield pd.DataFrame(out, columns=["grp", "start", "n", "mu", "cov", "inv", "det"])


def fit(rows: DataFrame, subset: float = SUBSET, steps: int = STEPS) -> DataFrame:
    """``grp, n, mu, cov``: of each group's starts the one with the least determinant, from ``rows`` of ``grp`` and the statistics. One start
    is the medians with the spread around them, the other the mean of all rows with theirs; each goes on by concentration steps until no
    determinant falls any more, or ``steps``. The spread is scaled to that of the whole for a normal law."""
    k = len(FEATURES)
    middle = rows.groupBy("grp").agg(F.array(*[F.median(f) for f in FEATURES]).alias("mu"))
    middle = stored(middle)
    dev = rows.join(middle, "grp").groupBy("grp").agg(F.array(*[F.median(F.round(F.abs(F.col(f) - F.col("mu")[i]), 2)) for i, f in enumerate(FEATURES)]).alias("mad"))
    diagonal = lambda wide: F.array(*[(1 / (wide[i] * wide[i]) if i == j else F.lit(0.0)) for i in range(k) for j in range(k)])
    first = middle.join(dev, "grp").select("grp", F.lit(0).alias("start"), "mu", diagonal([F.greatest(F.col("mad")[i] * 1.4826, F.lit(FLOOR[i])) for i in range(k)]).alias("inv"))
    every = rows.groupBy("grp").agg(F.array(*[F.avg(f) for f in FEATURES]).alias("mu"), F.array(*[F.stddev_pop(f) for f in FEATURES]).alias("sd"))
    second = every.select("grp", F.lit(1).alias("start"), "mu", diagonal([F.greatest(F.col("sd")[i], F.lit(FLOOR[i])) for i in range(k)]).alias("inv"))
    model = stored(first.unionByName(second).withColumn("det", F.lit(float("inf"))))
    for _ in range(steps):
        far = _distance(rows.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1)))), model, ["grp", "start"]).withColumn("key", F.round(F.ln(F.col("d2") + 1e-3), 2))
        bound = stored(far.groupBy("grp", "start").agg(F.percentile("key", F.lit(subset)).alias("bound")))  # a row a group and start
        near = far.join(bound, ["grp", "start"]).where("key <= bound")
        sums = [F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)]
        sums += [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"q{i}_{j}") for i in range(k) for j in range(i, k)]
        now = stored(near.groupBy("grp", "start").agg(F.count("*").alias("n"), *sums).mapInPandas(_step, MODEL))
        falls = now.join(model.select("grp", "start", F.col("det").alias("_was")), ["grp", "start"]).where(F.col("det") < F.col("_was") - 1e-3).isEmpty()
        model = now
        if falls:
            break
    return stored(model.groupBy("grp").agg(F.min(F.struct("det", "start", "n", "mu", "cov")).alias("m")).select("grp", "m.n", "m.mu", "m.cov"))


def _pool(pdf: pd.DataFrame) -> pd.DataFrame:
    """A group's estimate drawn towards its language's, and that towards the common one, by ``PRIOR_ROWS`` rows of it."""
    k = len(FEATURES)
    mus, inv = [], []
    for r in pdf.itertuples(index=False):
        mu, cov = np.array(r.mu_all), np.array(r.cov_all).reshape(k, k)
        for n, m, c in ((r.n_lang, r.mu_lang, r.cov_lang), (r.n_own, r.mu_own, r.cov_own)):
            w = n / (n + PRIOR_ROWS)
            m, c = np.array(m), np.array(c).reshape(k, k)
            cov = w * c + (1 - w) * cov + w * (1 - w) * np.outer(m - mu, m - mu)
            mu = w * m + (1 - w) * mu
        mus.append(mu.tolist())
        inv.append(np.linalg.inv(floored(cov)).ravel().tolist())
    return pd.DataFrame({"grp": pdf["grp"], "mu": mus, "inv": inv})


def pooled(model: DataFrame, groups: DataFrame) -> DataFrame:
    """``grp, mu, inv`` for each of ``groups`` (``grp, lang``, the names of groups and of their languages)."""
    named = lambda by, name: model.select(F.col("grp").alias(by), *[F.col(c).alias(f"{c}_{name}") for c in ("n", "mu", "cov")])
    met = groups.join(named("grp", "own"), "grp").join(named("lang", "lang"), "lang").crossJoin(F.broadcast(named("_g", "all").where("_g = '*'").drop("_g")))  # one row
    return met.mapInPandas(lambda batches: map(_pool, batches), "grp string, mu array<double>, inv array<double>")


def judge(docs: DataFrame, cut: float = CUT) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``distance`` (squared) and ``kept``."""
    rows = stored(grouped(stored(measured(docs))))
    model = fit(rows.select(F.explode("levels").alias("grp"), *FEATURES))
    own = stored(pooled(model, rows.select("grp", F.col("levels")[1].alias("lang")).distinct()))
    scored = _distance(rows, own, ["grp"]).select("doc_id", *BASE, F.col("d2").alias("distance"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= cut))

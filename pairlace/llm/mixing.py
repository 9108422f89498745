"""Mixing sources to target weights by cube-method balanced sampling.

A source's target over its size gives each of its documents whole copies and one fractional inclusion probability. The
cube method decides the fraction: three open documents at a time move along the direction that keeps both the sum of
probabilities (documents) and the sum of probability times size (tokens), until one of them is in or out. This
flight runs in blocks of bounded size; a block leaves at most two open documents and its few smallest ones, which meet in
fewer blocks of the next level, until one block a source is left. That block flies from its largest documents to its
smallest, part by part: what rounding a part's last two open documents moves is spread over the smaller ones to come, and
the smallest dozen lands where the totals are nearest, by exact search. Of some such samples the nearest is taken, and a few
of its documents, of all sizes, are turned over, four at a time, where that comes nearer: sources of a few dozen documents with a heavy tail
land within a word of their target.

Draws come from a hash of source, block and level, so reruns agree. Null text has size 0; the null source is a source,
the last in order. Repeated rows are documents of their own; rows of equal size tie and go by their hash. Sources without
words have target 0. A very long text is one document like any other: its source comes as near its target as its other
documents allow. Empty tables give no rows; extra columns stay with their documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlace.llm.common import only, space_words, stored

BLOCK, MOST_COPIES, WEIGHTS = 2048, 3, (1, 2, 3)
HOLD, PARTS, SEARCHED, DRAWS, REPAIRED, REPAIRS = 16, (512, 64), 14, 6, 256, 60


def source_targets(sizes: DataFrame, most: int = MOST_COPIES, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``source, source_size, target`` from rows ``source, size``. Sources in order of code points take the weights in
    turn; no target passes ``most`` times its source, and the excess is shared by weight again. The level where
    sharing stops is found in one pass over the sources in order of their limit by weight; the windows run over one
    row a source."""
    s = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    rn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((rn - 1) % len(weights) + 1).cast("int"))
    s = s.withColumn("w", w).withColumn("cap", F.col("source_size") * float(most))
    every = Window.partitionBy(F.lit(0))
    before = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(every)).withColumn("all_w", F.sum("w").over(every))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    s = s.withColumn("stop", F.min(F.when(F.col("cap") / F.col("w") >= F.col("level"), F.struct(F.col("cap") / F.col("w"), F.col("level").alias("level")))).over(every)["level"])
    return s.select("source", "source_size", F.least("cap", F.col("stop") * F.col("w")).alias("target"))


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves probabilities until at most two are open; both sums stay as they were."""
    p = p.tolist()
    size = size.tolist()
    eps = 1e-9
    draws = rng.random(len(p) + 3).tolist()
    hand: list[int] = []
    k = 0
    for i in range(len(p)):
        if not eps < p[i] < 1 - eps:
            p[i] = float(p[i] >= 0.5)
            continue
        hand.append(i)
        while len(hand) == 3:
            a, b, c = (size[j] for j in hand)
            u = (c - b, a - c, b - a)
            if u == (0, 0, 0):
                u = (1.0, -1.0, 0.0)
            top = max(abs(x) for x in u)
            u = [x / top for x in u]
            up = min([(1 - p[j]) / x if x > 0 else -p[j] / x for j, x in zip(hand, u, strict=True) if x])
            down = min([p[j] / x if x > 0 else (p[j] - 1) / x for j, x in zip(hand, u, strict=True) if x])
            step = up if draws[k % len(draws)] * (up + down) < down else -down
            k += 1
            for j, x in zip(hand, u, strict=True):
                p[j] += step * x
            closed = [j for j in hand if not eps < p[j] < 1 - eps]
            if not closed:
                closed = [min(hand, key=lambda j: min(p[j], 1 - p[j]))]
            for j in closed:
                p[j] = float(p[j] >= 0.5)
            hand = [j for j in hand if j not in closed]
    return np.array(p)


def land(p: np.ndarray, size: np.ndarray, tokens: float = 0.0, docs: float = 0.0) -> np.ndarray:
    """Rounds the open probabilities, ``SEARCHED`` at most, so that tokens, then documents, are nearest to their sums;
    ``tokens`` and ``docs`` are wanted besides."""
    at = np.flatnonzero((p > 0) & (p < 1))
    bits = (np.arange(2 ** len(at))[:, None] >> np.arange(len(at)) & 1).astype(float)
    d = bits - p[at]
    best = np.lexsort((np.abs(d.sum(1) - docs), np.round(np.abs(d @ size[at] - tokens), 6)))[0]
    out = p.copy()
    out[at] = bits[best]
    return out


def rounded(p: np.ndarray, size: np.ndarray, up: float, down: float, rng: np.random.Generator) -> np.ndarray:
    """Rounds the open probabilities, two at most, each by its chance, of the ways whose change of tokens later rows
    can take: ``up`` more or ``down`` fewer."""
    at = np.flatnonzero((p > 0) & (p < 1))
    bits = (np.arange(2 ** len(at))[:, None] >> np.arange(len(at)) & 1).astype(float)
    owed = (p[at] - bits) @ size[at]
    beyond = np.round(np.maximum(0, np.maximum(owed - up, -owed - down)), 6)
    chance = np.where(bits == 1, p[at], 1 - p[at]).prod(1) * (beyond == beyond.min())
    out = p.copy()
    out[at] = bits[rng.choice(len(bits), p=chance / chance.sum())]
    return out


def shifted(p: np.ndarray, size: np.ndarray, tokens: float, docs: float) -> np.ndarray:
    """Open probabilities moved, within 0 and 1, by amounts linear in the size, so that they hold so many more tokens and
    documents; tokens alone where both can't be."""
    p = p.copy()
    for k in range(60):
        if abs(tokens) < 1e-6 and (abs(docs) < 1e-6 or k >= 30):
            break
        free = (p > 0) & (p < 1)
        s = size[free]
        if not len(s) or not s.any():
            break
        if k < 30 and s.min() < s.max():
            a, b = np.linalg.lstsq(np.array([[len(s), s.sum()], [s.sum(), (s * s).sum()]]), np.array([docs, tokens]), rcond=None)[0]
        else:
            a, b = tokens / s.sum(), 0.0
        new = p.copy()
        new[free] = np.clip(p[free] + a + b * s, 0, 1)
        tokens, docs = tokens - float(((new - p) * size).sum()), docs - float((new - p).sum())
        p = new
    return p


def repaired(out: np.ndarray, p: np.ndarray, size: np.ndarray, most: int = REPAIRED) -> np.ndarray:
    """``out`` with up to four rows turned over, so that tokens, then documents, come nearest to those of ``p``. Rows from all over
    the order of size, ``most`` at the most, are taken two at a time; each two meet the other twos that make good what is
    left. Sizes are whole numbers, so tokens within half a word of each other tie."""
    some = np.flatnonzero(size > 0)
    spread = lambda rows, n: rows[np.unique(np.linspace(0, len(rows) - 1, min(n, len(rows))).astype(int))] if len(rows) else rows
    few = min(some[out[some] > 0], some[out[some] == 0], key=len)  # nearly all may be in, or out
    pick = np.union1d(spread(some, most), spread(few, most // 4))
    turn = np.where(out[pick] > 0, -1, 1)
    change = np.r_[0.0, turn * size[pick]]  # the first is no row at all
    count = np.r_[0, turn]
    a, b = np.triu_indices(len(change), 1)
    a, b = np.r_[0, a], np.r_[0, b]
    two, docs = change[a] + change[b], count[a] + count[b]
    order = np.argsort(two, kind="stable")
    miss, far = float(((out - p) * size).sum()), float((out - p).sum())
    at = np.searchsorted(two[order], -miss - two)
    best, least = None, (np.floor(abs(miss) + 0.5), abs(far), abs(miss))
    for near in range(-4, 4):
        k = order[np.clip(at + near, 0, len(order) - 1)]
        apart = ((a != a[k]) | (a == 0)) & ((b != b[k]) | (b == 0)) & ((a != b[k]) | (a == 0)) & ((b != a[k]) | (b == 0))
        left = np.where(apart, np.abs(miss + two + two[k]), np.inf)
        whole, off = np.floor(left + 0.5), np.abs(far + docs + docs[k])
        j = int(np.lexsort((left, off, whole))[0])
        if (whole[j], off[j], left[j]) < least:
            best, least = (a[j], b[j], a[k[j]], b[k[j]]), (whole[j], off[j], left[j])
    out = out.copy()
    if best is not None:
        rows = pick[np.array([x for x in best if x], int) - 1]
        out[rows] = 1 - out[rows]
    return out


def settle(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The nearest to the tokens wanted of up to ``DRAWS`` samples, or the first that misses by no more than a smallest row; a few
    rows turned over then make good what it misses."""
    best, least = None, np.inf
    for _ in range(DRAWS):
        out = settled_once(p, size, rng)
        miss = abs(float(((out - p) * size).sum()))
        if miss < least:
            best, least = out, miss
        if least <= min(size[size > 0], default=0):
            break
    for _ in range(REPAIRS if best is not None else 0):
        better = repaired(best, p, size)
        if (better == best).all():
            break
        best = better
    return p.copy() if best is None else best


def settled_once(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """All probabilities to 0 or 1, from rows in order of size, the smallest last. Rows with more than a 64th of all tokens are
    a part of their own, so that all others make room for them."""
    p, tokens, docs, start = p.copy(), float((p * size).sum()), float(p.sum()), 0
    large = int((size * 64 > size.sum()).sum())
    for left in (len(p) - large, *PARTS, SEARCHED):
        end = max(start, len(p) - max(left, SEARCHED))
        if end > start:
            later = size[end:]
            part = flight(p[start:end], size[start:end], rng)
            p[start:end] = rounded(part, size[start:end], float(((1 - p[end:]) * later).sum()), float((p[end:] * later).sum()), rng)
            p[end:] = shifted(p[end:], later, tokens - float((p * size).sum()), docs - float(p.sum()))
            start = end
    return land(p, size, tokens - float((p * size).sum()), docs - float(p.sum()))


def _fly(level: int, last: bool, hold: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        none = (pdf["size"] > 0).rename("some")  # rows without words help no total: they fly first
        pdf = pdf.assign(some=none).sort_values(["some", "size", "h", "doc_id", "dup"], ascending=[True, False, True, True, True], kind="stable", ignore_index=True).drop(columns="some")
        rng = np.random.default_rng([int(np.uint64(np.int64(pdf.seed.iloc[0]))), level])
        p, size = pdf["p"].to_numpy(float), pdf["size"].to_numpy(float)
        if last:
            pdf["p"] = settle(p, size, rng)
        else:
            far = max(0, len(p) - hold)
            pdf["p"] = np.concatenate([flight(p[:far], size[:far], rng), p[far:]])
        return pdf

    return run


def choose(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``doc_id, dup, picked``: 0 or 1 for each row ``doc_id, dup, source, size, p`` by the cube method."""
    kinds = "doc_id long, dup int, source string, size long, p double, h long, blk long, seed long"
    open_ = rows.where("p > 0 and p < 1").withColumn("h", F.xxhash64("doc_id", "dup", "size"))
    done = rows.where("p <= 0 or p >= 1").select("doc_id", "dup", F.col("p").cast("int").alias("picked"))
    level, last = 0, False
    while not last:
        counts = open_.groupBy("source").agg(F.count("*").alias("n")).withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("n") / block)))
        counts = stored(counts)
        last = (counts.agg(F.max("blocks")).first()[0] or 1) == 1
        dealt = open_.join(counts.select(F.col("source").alias("_s"), "blocks"), F.col("source").eqNullSafe(F.col("_s")))
        dealt = dealt.withColumn("blk", F.pmod(F.xxhash64(F.lit(level), "h"), F.col("blocks"))).withColumn("seed", F.xxhash64("source", "blk"))
        flown = stored(dealt.select("doc_id", "dup", "source", "size", "p", "h", "blk", "seed").groupBy("source", "blk").applyInPandas(_fly(level, last, min(HOLD, block // 4)), kinds))
        done = done.unionByName(flown.where("p <= 0 or p >= 1").select("doc_id", "dup", F.col("p").cast("int").alias("picked")))
        open_ = flown.where("p > 0 and p < 1").drop("blk", "seed")
        level += 1
    return done


def _numbered(docs: DataFrame) -> DataFrame:
    """``row`` (all columns as given), ``doc_id, source, size, key, dup`` of each row. A row is known by its content's hash
    and its number among equal ones, so rows without an id don't meet in one task."""
    have = lambda c, kind: F.col(c).cast(kind) if c in docs.columns else F.lit(None).cast(kind)
    text, source = have("text", "string"), have("source", "string")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    d = docs.select(whole, have("doc_id", "long").alias("doc_id"), source.alias("source"), F.size(space_words(text)).cast("long").alias("size"), F.xxhash64(have("doc_id", "long"), source, text).alias("key"))
    return d.withColumn("dup", F.row_number().over(Window.partitionBy("key").orderBy(F.col("doc_id").asc_nulls_last(), F.col("source").asc_nulls_last(), "size")))


def _plan(narrow: DataFrame, most: int, weights: tuple[int, ...]) -> DataFrame:
    """``key, dup, doc_id, size, source_size, target, copies`` from ``key, dup, doc_id, source, size``."""
    targets = stored(source_targets(narrow, most, weights))
    rows = narrow.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("rate", F.least(F.lit(float(most)), rate)).withColumn("whole", F.floor(F.col("rate") + 1e-9))
    rows = stored(rows.withColumn("p", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole"))))
    rows = rows.withColumn("p", F.when(F.col("p") < 1e-9, F.lit(0.0)).otherwise(F.col("p")))
    picked = choose(rows.select(F.col("key").alias("doc_id"), "dup", "source", "size", "p")).withColumnRenamed("doc_id", "key")
    return rows.join(picked, ["key", "dup"]).select("key", "dup", "doc_id", "size", "source_size", "target", (F.col("whole") + F.col("picked")).cast("int").alias("copies"))


def mixture(docs: DataFrame, most: int = MOST_COPIES, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``doc_id, size, source_size, target, copies`` of each row."""
    narrow = stored(_numbered(only(docs, "doc_id", "text", "source")).drop("row"))
    return _plan(narrow, most, weights).drop("key", "dup")


def mix_documents(docs: DataFrame, most: int = MOST_COPIES, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The documents as the mixture takes them, a row for each copy; columns as given."""
    numbered = _numbered(docs)
    copies = _plan(stored(numbered.drop("row")), most, weights).where("copies > 0").select("key", "dup", "copies")
    met = numbered.select("row", "key", "dup").join(copies, ["key", "dup"])
    each = met.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
    return each.select(*[F.col("row")[c].alias(c) for c in docs.columns])

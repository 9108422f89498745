"""Language identification by a string kernel.

A text's set of hashed byte n-grams of two to four bytes, letters alone, gives the blended-spectrum presence kernel
``|x & z| / sqrt(|x| |z|)``. Nystroem landmarks from each language turn it into features, and one-versus-rest kernel
ridge regression is solved on a bounded sample of labelled rows. Scoring is two matrix products a batch.

Bounds: ``sample`` rows are fitted on, by least hash of the id, and the first ``landmarks`` of them in that order, as many
of each language, are kept; every row is scored, over its
whole text. Null text, empty text, and text without a letter, is ``und`` with score 0; so is everything if no labelled row
can be learned from. Rows with a null language or id teach nothing. A very long text sets most of the hashed n-grams, so
its kernel tells languages apart less sharply. Equal outputs go to the first language by name. Repeated rows get a row
each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlace.llm.common import LOWERED, one_row_each, only, text_chunks

BUCKETS, SAMPLE, LANDMARKS, RIDGE, SHARP = 8192, 4000, 160, 1e-2, 6.0
_LETTER = np.zeros(256, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
_LETTER[_LETTER == 0] = 32


def presence(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows of zeros and ones: which hashed n-grams each text has. Other bytes than letters count as one space."""
    n = len(offs) - 1
    out = np.zeros(n * BUCKETS, np.float32)
    d = _LETTER[LOWERED[data]].astype(np.uint32)
    row = np.repeat(np.arange(n, dtype=np.int64) * BUCKETS, np.diff(offs))
    gap = d == 32
    if len(d):
        keep = np.ones(len(d), bool)
        keep[1:] = ~(gap[1:] & gap[:-1])
        d, row = d[keep], row[keep]
    h = d.copy()
    for k in (1, 2, 3):
        if len(d) <= k:
            break
        h = h[:-1] * np.uint32(0x01000193) ^ d[k:] * np.uint32(0x9E3779B1)
        same = row[k:] == row[: len(row) - k]
        slot = (h * np.uint32(0x85EBCA6B)) >> np.uint32(19)
        out[row[k:][same] + slot[same]] = 1
    return out.reshape(n, BUCKETS)


def kernel(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    size = lambda m: np.sqrt(np.maximum(m.sum(1), 1))
    return (x @ z.T) / size(x)[:, None] / size(z)[None, :]


def fit(x: np.ndarray, langs: np.ndarray, landmarks: int = LANDMARKS, ridge: float = RIDGE):
    """``names, landmark rows, coefficients`` so that ``kernel(x, rows) @ coefficients`` are the languages' outputs."""
    names = np.unique(langs)
    each = max(1, landmarks // len(names))
    picked = np.concatenate([np.flatnonzero(langs == v)[:each] for v in names])
    z = x[picked]
    values, vectors = np.linalg.eigh(kernel(z, z).astype(float))
    ok = values > 1e-6
    root = vectors[:, ok] / np.sqrt(values[ok])
    phi = kernel(x, z) @ root
    y = (langs[:, None] == names[None, :]) * 2.0 - 1.0
    w = np.sqrt(1.0 / np.array([np.mean(langs == v) for v in langs]))[:, None]
    a = np.hstack([phi, np.ones((len(phi), 1))]) * w
    beta = np.linalg.solve(a.T @ a + ridge * len(phi) ** 0.5 * np.eye(a.shape[1]), a.T @ (y * w))
    return names, z.astype(np.uint8), (root @ beta[:-1]).astype(np.float32), beta[-1].astype(np.float32)


def train(rows: DataFrame, sample: int = SAMPLE):
    """The model from ``doc_id, text, lang``; None without a language. At most ``sample`` rows reach the driver, as
    bits."""
    d = only(rows, "doc_id", "text", "lang").where("lang is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    ids = d.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id").limit(sample)

    def run(batches):
        for batch in batches:
            for lo, hi, data, offs in text_chunks(batch, rows=1000):
                part = batch.slice(lo, hi - lo)
                bits = np.packbits(presence(data, offs).astype(bool), axis=1)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array([b.tobytes() for b in bits], pa.binary())], names=["doc_id", "lang", "bits"])

    chosen = one_row_each(d.where("doc_id is not null").join(F.broadcast(ids), "doc_id"), "doc_id")
    got = chosen.mapInArrow(run, "doc_id long, lang string, bits binary").collect()  # at most ``sample`` rows
    if not got:
        return None
    got.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.lang, bytes(r.bits)))  # landmarks are the first of each language: by hash, not by id
    x = np.unpackbits(np.stack([np.frombuffer(bytes(r.bits), np.uint8) for r in got]), axis=1).astype(np.float32)
    return fit(x, np.array([r.lang for r in got]))


def identify(docs: DataFrame, model, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, lang_pred, score`` and the columns ``keep`` of each row."""
    d = only(docs, "doc_id", "text", *keep).withColumn("text", F.col("text").cast("string"))
    kept = d.select("doc_id", *keep)
    names = list(kept.columns)
    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields] + ["lang_pred string", "score double"])

    def run(batches):
        z = model[1].astype(np.float32) if model else None
        for batch in batches:
            for lo, hi, data, offs in text_chunks(batch, limit=1 << 20, rows=1000):
                part = batch.slice(lo, hi - lo)
                pred, score = np.full(hi - lo, "und", object), np.zeros(hi - lo)
                if model:
                    k = kernel(presence(data, offs), z) @ model[2] + model[3]
                    e = np.exp(SHARP * (k - k.max(1, keepdims=True)))
                    best = k.argmax(1)
                    # a byte that can be part of a letter, then a letter indeed
                    inked = np.concatenate([[0], np.cumsum(_LETTER[LOWERED[data]] != 32)])
                    some = inked[offs[1:]] > inked[offs[:-1]]
                    ascii_ = np.concatenate([[0], np.cumsum((LOWERED[data] >= 97) & (LOWERED[data] <= 122))])
                    sure = ascii_[offs[1:]] > ascii_[offs[:-1]]
                    text = pc.cast(part.column("text"), pa.large_string())
                    for i in np.flatnonzero(some & ~sure):
                        sure[i] = any(map(str.isalpha, text[int(i)].as_py()))
                    pred[sure] = model[0][best[sure]]
                    score[sure] = (e.max(1) / e.sum(1))[sure]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(pred.tolist(), pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    return d.mapInArrow(run, kinds)

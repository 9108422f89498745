"""Phrase collocation mining by hashed level-wise counting (PCY and DHP).

Phrases are runs of 1 to 5 words within a piece of a text. There is one pass over the documents for each length k:

* a task counts, exactly, the k-word phrases that can be frequent: both of their (k-1)-word parts are marked in a bitmap of the
  frequent ones (Apriori), and their own bucket was marked in the pass before (PCY);
* in the same pass it counts, in hash buckets, the (k+1)-word phrases whose two k-word parts are still candidates (DHP). Buckets
  with at least the least count become the bitmap of the next pass.

Bitmaps have a bit a bucket, as many as a power of two near a 64th of the texts' bytes, ``MOST_BUCKETS`` (128 MB of bits) at
most; they alone are broadcast. They never hide a frequent phrase, as a bucket counts at least what each phrase in it counts; what
they let through wrongly is counted and dropped. Beyond 64 GB of text of one least count, buckets fill up and prune less: then more
phrases are counted exactly, by sums that combine within each task before the shuffle, with the same result.

Within a task, phrases are told apart by 128 bits of hash; rows that leave it carry the phrase itself and are summed by it, so
languages with a third of all rows, or a phrase in each of them, bring the shuffle one row a task and phrase.

A null text is an empty one, a null language is ``und``. Ties go by count, then by the phrase in byte order. Repeated rows count
each. Very long texts are cut at no place: a text is one unit, whatever its length. An empty table gives no row. Extra columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlace.llm.common import BYTE_KEY, LOWERED, for_join, forget, mix, only, stored, text_chunks, words_of

LONGEST = 5
BREAKS, SEPARATORS = np.zeros(256, bool), np.zeros(256, bool)
BREAKS[list(b".,;:!?\n\x0b\x0c\r")] = True
SEPARATORS[:] = BREAKS
SEPARATORS[list(b" \t")] = True
BLOCK = 1 << 16  # buckets in a row of counts or bits
LEAST_BUCKETS, MOST_BUCKETS = 1 << 16, 1 << 30
CHUNK = 256 << 10  # bytes of text at a time: arrays that stay in the cache
FLUSH_WORDS = 1_500_000  # words after which a task passes its counts on
_TURN = np.uint64(0x9E3779B97F4A7C15)
_SECOND = np.random.default_rng(20240702).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def flat(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans laid end to end: where each begins there, the places that they take from, and each place within its span."""
    lens = ends - starts
    at = np.cumsum(lens) - lens
    inside = np.arange(lens.sum()) - np.repeat(at, lens)
    return at, np.repeat(starts, lens) + inside, inside


def two_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word."""
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    at, place, inside = flat(starts, ends)
    powers = np.full(int((ends - starts).max()), _TURN, np.uint64)
    powers[0] = 1
    power = np.multiply.accumulate(powers)[inside]
    raw, n = data[place], (ends - starts).astype(np.uint64)
    return mix(np.add.reduceat(BYTE_KEY[raw] * power, at) + n), mix(np.add.reduceat(_SECOND[raw] * power, at) ^ n)


def longer(grams: np.ndarray, words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k + 1 words from those of k: one for each place where so many follow."""
    return mix(grams[: max(0, len(words) - k)]) * _TURN + words[k:]


def buckets_of(grams: np.ndarray, salt: np.ndarray, n: int) -> np.ndarray:
    return (mix(grams ^ salt) & np.uint64(n - 1)).astype(np.int64)


def salt_of(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def marked(bits: np.ndarray | None, at: np.ndarray) -> np.ndarray:
    return np.ones(len(at), bool) if bits is None else (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


PASS = "lang string, phrase string, n long, block long, at binary, counts binary"
_PASS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64()), ("block", pa.int64()), ("at", pa.binary()), ("counts", pa.binary())])


def bucket_rows(at: np.ndarray) -> pa.RecordBatch:
    """Counts of buckets, a row a block of them: places as 16-bit numbers, counts up to 255."""
    one, n = np.unique(at, return_counts=True)
    cut = np.flatnonzero(np.r_[True, one[1:] // BLOCK != one[:-1] // BLOCK, True]) if len(one) else np.zeros(1, np.int64)
    spans = list(zip(cut[:-1], cut[1:], strict=True))
    low, few = (one % BLOCK).astype(np.uint16), np.minimum(n, 255).astype(np.uint8)
    none = lambda f: pa.nulls(len(spans), f.type)
    return pa.RecordBatch.from_arrays(
        [*map(none, (_PASS.field(k) for k in range(3))), pa.array([int(one[a]) // BLOCK for a, _ in spans], pa.int64()), pa.array([low[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([few[a:b].tobytes() for a, b in spans], pa.binary())], schema=_PASS
    )


class Tally:
    """Exact counts of a task's phrases until they are passed on."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, g1, g2, lang, count, data, starts, ends, rep, k) -> None:
        """``rep``: the first word of each phrase; its k words are copied with a space between."""
        word = (rep[:, None] + np.arange(k)).ravel()
        lens = ends[word] - starts[word]
        room = lens + (np.arange(len(word)) % k != k - 1)
        out = np.full(int(room.sum()), 32, np.uint8)
        _, place, inside = flat(starts[word], ends[word])
        out[np.repeat(np.cumsum(room) - room, lens) + inside] = data[place]
        self.parts.append((g1, g2, lang, count, room.reshape(-1, k).sum(1), out))

    def take(self, langs: list[str]) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        g1, g2, lang, count, size, data = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts = []
        order = np.lexsort((g2, g1))
        new = np.r_[True, (g1[order][1:] != g1[order][:-1]) | (g2[order][1:] != g2[order][:-1])]
        total = np.add.reduceat(count[order], np.flatnonzero(new))
        rep = order[new]
        begin = (np.cumsum(size) - size)[rep]
        for lo in range(0, len(rep), 200_000):
            b, s = begin[lo : lo + 200_000], size[rep[lo : lo + 200_000]]
            _, place, _ = flat(b, b + s)
            offs = np.r_[0, np.cumsum(s)].astype(np.int32)
            phrase = pa.StringArray.from_buffers(len(s), pa.py_buffer(offs), pa.py_buffer(data[place]))
            name = pa.DictionaryArray.from_arrays(pa.array(lang[rep[lo : lo + 200_000]], pa.int32()), pa.array(langs)).cast(pa.string())
            none = lambda f, n=len(s): pa.nulls(n, f.type)
            yield pa.RecordBatch.from_arrays([name, phrase, pa.array(total[lo : lo + 200_000], pa.int64()), *map(none, (_PASS.field(k) for k in (3, 4, 5)))], schema=_PASS)


def unique_grams(g1: np.ndarray, g2: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each different phrase and language, its first place and how often it comes. Hashes of more than 64 bits decide."""
    order = np.lexsort((g2, g1 ^ salt))
    a, b = (g1 ^ salt)[order], g2[order]
    head = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return order[head], np.diff(np.r_[head, len(order)])


def count_pass(k: int, n_buckets: int, frequent, hashed, last: bool):
    """The kernel of pass k. ``frequent``: broadcast bits of the frequent phrases of k - 1 words, ``hashed``: of the buckets of
    those of k words; None in the first pass."""

    def run(batches):
        shorter, own = (None if b is None else np.frombuffer(b.value, np.uint8) for b in (frequent, hashed))
        langs: dict[str, int] = {}
        tally, buckets, seen = Tally(), [], 0

        def told():
            yield from tally.take(list(langs))
            if buckets:
                yield bucket_rows(np.concatenate(buckets))

        for batch in batches:
            codes = np.array([langs.setdefault(x, len(langs)) for x in batch.column("lang").to_pylist()], np.int32)
            salts = np.array([salt_of(x) for x in langs], np.uint64)
            for lo, hi, raw, offs in text_chunks(batch, limit=CHUNK):
                data = LOWERED[raw]
                starts, ends, first = words_of(data, offs, SEPARATORS)
                if len(starts) < k:
                    continue
                lang = np.repeat(codes[lo:hi], np.diff(first))
                salt = salts[lang]
                h1, h2 = two_hashes(data, starts, ends)
                piece = np.cumsum(BREAKS[data])[starts] + np.repeat(np.arange(hi - lo), np.diff(first))
                g1, g2 = h1, h2
                for j in range(1, k):
                    part, g1, g2 = g1, longer(g1, h1, j), longer(g2, h2, j)
                n = len(g1)
                here = piece[:n] == piece[k - 1 :]
                if k > 1:
                    ok = marked(shorter, buckets_of(part, salt[: n + 1], n_buckets))
                    here &= ok[:-1] & ok[1:] & marked(own, buckets_of(g1, salt[:n], n_buckets))
                if not last and n > 1:
                    both = np.flatnonzero(here[:-1] & here[1:] & (piece[: n - 1] == piece[k:]))
                    buckets.append(buckets_of(longer(g1, h1, k)[both], salt[both], n_buckets).astype(np.uint32))  # below 2**30
                at = np.flatnonzero(here)
                if len(at):
                    rep, count = unique_grams(g1[at], g2[at], salt[at])
                    rep = at[rep]
                    tally.add(g1[rep] ^ salt[rep], g2[rep], lang[rep], count, data, starts, ends, rep, k)
                seen += len(starts)
            if seen > FLUSH_WORDS:
                yield from told()
                buckets, seen = [], 0
        yield from told()

    return run


def phrase_buckets(k: int, n_buckets: int):
    """Buckets of given phrases of k words, in the form of a pass."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offs in text_chunks(batch, "phrase", rows=1 << 16):
                starts, ends, _ = words_of(data, offs, SEPARATORS)
                words = two_hashes(data, starts, ends)[0].reshape(hi - lo, k)
                g = words[:, 0]
                for j in range(1, k):
                    g = mix(g) * _TURN + words[:, j]
                salt = np.array([salt_of(x) for x in batch.column("lang").slice(lo, hi - lo).to_pylist()], np.uint64)
                yield bucket_rows(buckets_of(g, salt, n_buckets))

    return run


def bitmap(rows: DataFrame, n_buckets: int, least: int):
    """Broadcast bits of the buckets with a count of ``least`` in all rows. A task holds one block, a batch at a time."""

    def add(key, batches):
        total = np.zeros(BLOCK, np.int64)
        for batch in batches:
            for at, counts in zip(batch.column("at").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                total[np.frombuffer(at, np.uint16)] += np.frombuffer(counts, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], names=["block", "bits"])

    add.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    out = np.zeros(n_buckets >> 3, np.uint8)
    blocks = rows.where("block is not null").select("block", "at", "counts").groupBy("block").applyInArrow(add, "block long, bits binary")
    for r in blocks.toLocalIterator():  # n_buckets / 8 bytes in all
        out[r.block * (BLOCK >> 3) : (r.block + 1) * (BLOCK >> 3)] = np.frombuffer(r.bits, np.uint8)
    return rows.sparkSession.sparkContext.broadcast(out.tobytes())


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, k, n`` of the phrases of 1 to ``longest`` words that come at least ``least`` times, and ``lang, total`` with
    the count of all words. Both stored."""
    d = only(docs, "text", "lang").select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = LEAST_BUCKETS
    while n_buckets < min(size / 64, MOST_BUCKETS):
        n_buckets *= 2
    found, totals, frequent, hashed = None, None, None, None
    for k in range(1, longest + 1):
        rows = stored(d.mapInArrow(count_pass(k, n_buckets, frequent, hashed, k == longest), PASS))
        counts = rows.where("block is null").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        if k == 1:
            totals = stored(rows.where("block is null").groupBy("lang").agg(F.sum("n").alias("total")))
        own = stored(counts.where(F.col("n") >= least).select("lang", "phrase", F.lit(k).alias("k"), "n"))
        found = own if found is None else found.unionByName(own)
        if k < longest:
            if own.isEmpty():
                forget(rows)
                break
            hashed = bitmap(rows, n_buckets, least)
            frequent = bitmap(own.mapInArrow(phrase_buckets(k, n_buckets), PASS), n_buckets, 1)
        forget(rows)
    return found, totals


def collocations(docs: DataFrame, least: int = 100, top: int = 2000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's strongest phrases of 2 to 5 words. A phrase of count a, cut
    after its first words into parts of counts l and r, scores floor(1000 a n / (l r)) at its worst cut, n being the count of all
    words. Phrases within a longer candidate that comes as often are left out."""
    found, totals = frequent_phrases(docs, least)
    table = for_join(found.select("lang", "phrase", "n"))
    cand = found.where("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"))
    # a longer phrase with the same count has one of just one word more with it, on the way to the shorter one
    inner = found.where("k > 2").select("lang", F.explode(F.array(F.expr("substring_index(phrase, ' ', k - 1)"), F.expr("substring_index(phrase, ' ', 1 - k)"))).alias("phrase"), "n")
    best = inner.groupBy("lang", "phrase").agg(F.max("n").alias("_m"))
    kept = cand.join(best, ["lang", "phrase"], "left").where("_m is null or _m < a").drop("_m")
    cuts = kept.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.withColumn("_f", F.expr("substring_index(phrase, ' ', cut)")).withColumn("_s", F.expr("substring_index(phrase, ' ', cut - k)"))
    cuts = cuts.join(table.select("lang", F.col("phrase").alias("_f"), F.col("n").alias("l")), ["lang", "_f"]).join(table.select("lang", F.col("phrase").alias("_s"), F.col("n").alias("r")), ["lang", "_s"])
    cuts = cuts.join(for_join(totals), "lang")
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    cuts = cuts.withColumn("_x", F.lit(1000).cast("decimal(4,0)") * F.col("a").cast("decimal(15,0)") * wide("total")).withColumn("_y", wide("l") * wide("r")).withColumn("score", F.expr("_x div _y"))
    worst = cuts.groupBy("lang", "phrase", "a", F.col("total").alias("n")).agg(F.min(F.struct("score", "cut", "l", "r")).alias("w"))
    rows = worst.select("lang", "phrase", "a", "w.l", "w.r", "n", "w.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

"""MinHash near-dedup with HyperMinHash sketches.

A document's set is its distinct word shingles. A sketch holds 384 registers of one byte: the count of leading zeros (four
bits) and four mantissa bits of the least hash that fell into the bucket. Sets of different size need different
numbers of buckets for registers to be filled, so there is a scheme for each size class: ``3 * 2**(c - 3)`` buckets
for sets of 2**c and more, repeated under as many permutations as fill 384 registers. A document that could match one
of the next class is sketched in both. Six registers make a band: two sets of similarity 0.8 share none of the 64 bands
with a probability of 4e-9.

The nodes are the distinct sets, known by their size and 128 bits of their hashes, so thousands of copies cost one sketch, and
a doc_id with several texts is a node for each. Candidates never are all pairs of a bucket: a bucket has a hub, the
member that shares most buckets with others, and each member first meets the one hub that it shares most buckets with;
confirmed links give components; then those that still share a bucket across components meet by an exact prefix join on
their rarest shingles, so no link is lost and none within a component is paid for. Candidates of hubs pass the
collision-corrected estimate of the Jaccard similarity, then the full sets decide.

What grows with the input: a sketch of 384 bytes a set, 64 rows of two numbers a sketch (each shuffled twice: once to
count buckets, once to keep those with company), and the texts of sets with company, read from the documents once.
Tables of node numbers are broadcast up to 2 million rows, beyond which documents are shuffled to meet them.
A passage that many documents consist of, which are less similar than asked for, still costs a comparison a pair of them.

Null text, empty or blank text: an empty set, linked with nothing. Rows without an id link nothing but get the component of an
equal set. Repeated rows and ids are allowed; ties of hubs go by node number. A very long text is sketched in
chunks of its own and compared whole. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlace.llm.common import LOWERED, components, for_join, forget, mix, only, stored, text_chunks, with_least, word_hashes, words_of

REGISTERS, ROWS_PER_BAND, MANTISSA, MOST_ZEROS = 384, 6, 4, 14
BANDS = REGISTERS // ROWS_PER_BAND
TOP_CLASS = 10
_SEEDS = np.random.default_rng(77).integers(1, 2**63, (REGISTERS, 2), dtype=np.uint64) | np.uint64(1)
_BAND_KEYS = np.random.default_rng(78).integers(1, 2**63, ROWS_PER_BAND, dtype=np.uint64) | np.uint64(1)


def buckets_of(cls: int) -> int:
    return 1 if cls < 3 else min(REGISTERS, 3 * 2 ** (cls - 3))


def classes_of(n: int, similarity: float) -> list[int]:
    """The set's own size class, and the next if a set of that class could be similar enough."""
    own = min(TOP_CLASS, n.bit_length() - 1)
    return [own] if own == TOP_CLASS or n < similarity * 2 ** (own + 1) else [own, own + 1]


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A to Z lowered. Fewer words than ``width`` make one shingle."""
    data = LOWERED[data]
    starts, ends, first = words_of(data, offs)
    h = word_hashes(data, starts, ends)
    n = len(h)
    sh = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        sh = mix(sh * np.uint64(0x2545F4914F6CDD1D) + h[k : n - width + 1 + k]) if len(sh) else sh
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(sh[a : b - width + 1]))
        elif b > a:
            v = np.zeros(1, np.uint64)
            for k in range(a, b):
                v = mix(v * np.uint64(0x2545F4914F6CDD1D) + h[k : k + 1])
            out.append(mix(v + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray], cls: int) -> np.ndarray:
    """Registers (sets x 384, a byte each) under a class's scheme; 0 is an empty bucket."""
    k = buckets_of(cls)
    u = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    least = np.full(len(sets) * REGISTERS, np.uint64(2**64 - 1))
    for p in range(REGISTERS // k):
        v = mix(u * _SEEDS[p, 0] + _SEEDS[p, 1])
        bucket = ((v >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
        np.minimum.at(least, row * REGISTERS + p * k + bucket.astype(np.int64), mix(v ^ _SEEDS[p, 1]))
    top = np.floor(np.log2(np.maximum(least, np.uint64(1)).astype(np.float64))).astype(np.int64).clip(0, 63)
    zeros = (63 - top).astype(np.uint64)
    tail = (least << np.minimum(zeros + np.uint64(1), np.uint64(63))) >> np.uint64(64 - MANTISSA)
    packed = (((np.minimum(zeros, MOST_ZEROS) + np.uint64(1)) << np.uint64(MANTISSA)) | tail).astype(np.uint8)
    packed[least == np.uint64(2**64 - 1)] = 0
    return packed.reshape(len(sets), REGISTERS)


def chance_match(mantissa: int = MANTISSA) -> float:
    """How often two unrelated registers agree: equal leading zeros, then equal mantissas."""
    return sum(4.0**-z for z in range(1, 64)) / 2**mantissa


def estimate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Jaccard similarity of each pair of sketches, corrected for chance matches."""
    filled = (x > 0) | (y > 0)
    raw = ((x == y) & filled).sum(1) / np.maximum(filled.sum(1), 1)
    c = chance_match()
    return (raw - c) / (1 - c)


def _sketch_batches(width: int, similarity: float):
    names = ["uid", "doc_id", "th", "n", "h1", "h2", "cls", "regs"]

    def run(batches):
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 36
        for batch in batches:
            for lo, hi, data, offs in text_chunks(batch):
                sets = shingle_sets(data, offs, width)
                n = np.array([len(s) for s in sets])
                h1 = np.array([mix(s).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                h2 = np.array([np.bitwise_xor.reduce(mix(s * np.uint64(3) + np.uint64(7))) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                by: dict[int, list[int]] = {}
                for i, m in enumerate(n.tolist()):
                    for c in classes_of(m, similarity) if m else [-1]:
                        by.setdefault(c, []).append(i)
                part = batch.slice(lo, hi - lo)
                for c, rows in by.items():
                    regs = [b""] * len(rows) if c < 0 else [r.tobytes() for r in sketches([sets[i] for i in rows], c)]
                    at = np.array(rows)
                    own = [part.column(k).take(pa.array(at)) for k in ("doc_id", "th")]
                    yield pa.RecordBatch.from_arrays([pa.array(at + uid), *own, pa.array(n[at]), pa.array(h1[at]), pa.array(h2[at]), pa.array(np.full(len(at), c, np.int32)), pa.array(regs, pa.binary())], names=names)
                uid += hi - lo

    return run


def _bands(batches):
    schema = pa.schema([("key", pa.int64()), ("nc", pa.int64())])
    band = np.arange(BANDS, dtype=np.uint64)
    for batch in batches:
        for lo in range(0, batch.num_rows, 2000):
            b = batch.slice(lo, 2000)
            regs = np.frombuffer(b"".join(b.column("regs").to_pylist()), np.uint8).reshape(-1, BANDS, ROWS_PER_BAND).astype(np.uint64)
            nc = b.column("nc").to_numpy()
            cls = (nc & 15).astype(np.uint64)
            key = mix((regs * _BAND_KEYS).sum(2, dtype=np.uint64) + mix(cls[:, None] * np.uint64(1000) + band[None, :]))
            row, col = np.nonzero(regs.any(2))
            yield pa.RecordBatch.from_arrays([pa.array(key[row, col].view(np.int64)), pa.array(nc[row])], schema=schema)


def _likely(pairs: DataFrame, sketched: DataFrame, similarity: float) -> DataFrame:
    """Nodes ``x, y`` of the pairs whose estimate is within six standard errors of the similarity asked for. Pairs and
    sketches are of nodes under a scheme, ``nc``."""
    margin = 6 * (similarity * (1 - similarity) / REGISTERS * 1.3) ** 0.5

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 20_000):
                b = batch.slice(lo, 20_000)
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in ("rx", "ry"))
                yield b.select(["x", "y"]).filter(pa.array(estimate(x, y) >= similarity - margin))

    met = pairs.join(sketched.select(F.col("nc").alias("y"), F.col("regs").alias("ry")), "y")
    met = met.join(sketched.select(F.col("nc").alias("x"), F.col("regs").alias("rx")), "x")
    found = met.select("x", "y", "rx", "ry").mapInArrow(run, "x long, y long")
    return found.select(F.shiftright("x", 4).alias("x"), F.shiftright("y", 4).alias("y")).where("x <> y").distinct()


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Pairs of nodes whose full shingle sets are similar enough, by whole numbers. ``texts`` are ``node, text``; a pair moves
    the text of ``y``, and the text of ``x`` is joined where pairs are compared."""
    percent = round(similarity * 100)

    def run(batches):
        for batch in batches:
            sides = []
            for col in ("tx", "ty"):
                sides.append([s for _, _, data, offs in text_chunks(batch, col) for s in shingle_sets(data, offs, width)])
            ok = []
            for a, b in zip(*sides, strict=True):
                both = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(both > 0 and 100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["x", "y"]).filter(pa.array(ok, pa.bool_()))

    met = pairs.join(texts.select(F.col("node").alias("y"), F.col("text").alias("ty")), "y")
    met = met.join(texts.select(F.col("node").alias("x"), F.col("text").alias("tx")), "x")
    return met.select("x", "y", "tx", "ty").mapInArrow(run, "x long, y long")


def _texts_of(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """``node, text`` of the nodes ``node, at, th, many``: the text stands in the row whose id and text hash are ``at`` and
    ``th``. Where several rows may have both, one is taken."""
    found = docs.withColumnRenamed("doc_id", "at").join(for_join(nodes), ["at", "th"]).select("node", "many", "text")
    alone = found.where("not many").select("node", "text")
    return alone.unionByName(found.where("many").select("node", "text").dropDuplicates(["node"]))


def _prefix_pairs(open_: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """``x, y``: pairs of nodes of different components that could be similar, of those in ``open_``. With its
    shingles in order of rarity, a node shares one of its first ``n - ceil(similarity * n) + 1`` with each
    partner, and the first one shared bounds what both can have in common. So what many documents share, a common
    passage say, joins nobody whose own words set it apart. Sets meet only those of their own and the next range of sizes,
    ranges being as wide as the similarity allows. Nothing is lost: all three rules are exact."""
    t = round(similarity * 100)

    def run(batches):
        for batch in batches:
            for lo, hi, data, offs in text_chunks(batch):
                sets = shingle_sets(data, offs, width)
                at = pa.array(np.repeat(np.arange(hi - lo), [len(s) for s in sets]))
                flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
                n = pa.array(np.array([len(s) for s in sets], np.int64))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("node").take(at), n.take(at), pa.array(flat)], names=["node", "n", "s"])

    each = stored(texts.join(for_join(open_).select("node"), "node").select("node", "text").mapInArrow(run, "node long, n long, s long"))
    df = each.groupBy("s").agg(F.count("*").alias("df"))
    w = Window.partitionBy("node").orderBy("df", "s")
    head = each.join(df, "s").withColumn("p", F.row_number().over(w) - 1)
    head = head.where(f"p <= n - ceil({t} * n / 100) and df > 1").join(open_, "node")
    span = F.floor(F.ln("n") / float(np.log(100 / t)) + 1e-9).cast("int") if t < 100 else F.col("n").cast("int")
    head = stored(head.select("s", "node", "component", "n", "p", span.alias("span")))
    one = head.select("s", F.explode(F.array(F.col("span"), F.col("span") + 1)).alias("span"), F.col("span").alias("sx"), F.col("node").alias("x"), F.col("component").alias("cx"), F.col("n").alias("nx"), F.col("p").alias("px"))
    two = head.select("s", "span", F.col("node").alias("y"), F.col("component").alias("cy"), F.col("n").alias("ny"), F.col("p").alias("py"))
    can = F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) * (100 + t) >= t * (F.col("nx") + F.col("ny"))
    fits = (t * F.greatest("nx", "ny") <= 100 * F.least("nx", "ny")) & can
    once = (F.col("sx") < F.col("span")) | (F.col("x") < F.col("y"))
    met = one.join(two, ["s", "span"]).where(once & (F.col("cx") != F.col("cy")) & fits)
    return met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def _linked(full: DataFrame, sets: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """``node, component``: the least node of each linked set's component."""
    firsts = full.join(sets.select(F.col("node").alias("uid")), "uid").select((F.shiftleft("uid", 4) + F.col("cls") + 1).alias("nc"), "regs")
    bands = firsts.mapInArrow(_bands, "key long, nc long")
    meets = stored(bands.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"))  # buckets with company
    kept = stored(bands.join(meets, "key"))
    # the text that copies were made from is met in more and larger buckets than any copy, and links to most of them
    degree = kept.groupBy("nc").agg(F.sum("m").alias("deg"))
    hub = kept.join(degree, "nc").groupBy("key").agg(F.max(F.struct("deg", "nc")).alias("h")).select("key", F.col("h.nc").alias("x"))
    met = kept.select("key", F.col("nc").alias("y")).join(hub, "key").where("x <> y").groupBy("x", "y").agg(F.count("*").alias("c"))
    star = stored(met.groupBy("y").agg(F.max(F.struct("c", "x")).alias("h")).select(F.col("h.x").alias("x"), "y"))
    company = kept.select(F.shiftright("nc", 4).alias("node")).distinct()
    texts = stored(_texts_of(stored(sets.join(company, "node").select("node", "at", "th", "many")), docs))
    links = stored(_confirmed(stored(_likely(star, firsts, similarity)), texts, width, similarity))
    comp = stored(components(links, "x", "y"))
    tied = kept.select("key", F.shiftright("nc", 4).alias("node")).join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    tied = stored(tied)
    forget(meets, kept)
    apart = tied.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    open_ = stored(tied.join(apart, "key", "left_semi").select("node", "component").distinct())
    forget(tied)
    more = stored(_confirmed(stored(_prefix_pairs(open_, texts, width, similarity)), texts, width, similarity))
    found = stored(components(links.unionByName(more), "x", "y"))
    forget(texts)
    return found


def _components_of(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """``doc_id, th, n_shingles, component_id``, a row for each row of ``docs``; ``th`` is the text's hash."""
    d = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    sk = stored(d.mapInArrow(_sketch_batches(width, similarity), "uid long, doc_id long, th long, n long, h1 long, h2 long, cls int, regs binary"))
    own = F.col("cls") == F.least(F.lit(TOP_CLASS), F.floor(F.log2("n") + 1e-12)).cast("int")
    rows = stored(sk.where((F.col("n") == 0) | own).select("uid", "doc_id", "th", "n", "h1", "h2"))
    named = rows.where("n > 0 and doc_id is not null")
    first = lambda c: F.min_by(c, "uid")
    sets = stored(named.groupBy("n", "h1", "h2").agg(F.min("uid").alias("node"), F.min("doc_id").alias("rep"), first("doc_id").alias("at"), first("th").alias("th"), (F.count("*") > 1).alias("many")))
    found = _linked(sk.where("n > 0 and doc_id is not null"), sets, d, width, similarity)
    forget(sk)
    linked = stored(found.join(sets.select("node", "rep"), "node").select(F.col("component").alias("u"), F.col("rep").alias("v"), "node"))
    named = sets.join(with_least(linked).select("node", "m"), "node", "left").select("n", "h1", "h2", F.coalesce("m", "rep").alias("component_id"))
    out = rows.join(named, ["n", "h1", "h2"], "left")
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``doc_id, n_shingles, component_id``, a row for each row of ``docs``: the least doc_id reachable over links
    of ``similarity`` and more."""
    return _components_of(docs, width, similarity).drop("th")


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents without near copies: of each component the row whose doc_id names it stays, of
    repeated rows with that id and text one; rows without an id stay. Columns as given."""
    comp = stored(_components_of(docs, width, similarity).where("doc_id is not null"))
    key = lambda frame, c: (F.xxhash64(frame["text"].cast("string")) if c == "_th" else frame["doc_id"].cast("long"))
    by = lambda t: (key(docs, "_id") == t["_id"]) & (key(docs, "_th") == t["_th"])
    gone = for_join(stored(comp.where("doc_id <> component_id").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct()))
    kept = comp.where("doc_id = component_id").groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.count("*").alias("_n"))
    twice = stored(kept.where("_n > 1").drop("_n"))
    stay = docs.join(gone, by(gone), "left_anti")
    if twice.isEmpty():
        return stay
    twice = for_join(twice)
    return stay.join(twice, by(twice), "left_anti").unionByName(stay.join(twice, by(twice), "left_semi").dropDuplicates(["doc_id", "text"]))

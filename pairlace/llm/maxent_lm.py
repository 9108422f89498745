"""A hashed maximum-entropy language model with class-factored softmax.

``P(word | history) = P(class | history) * P(word | class, history)``. The class is predicted by a softmax over hashed
features of the history: the word before, and the word before that (a skip). Within the class a
tree of two-way softmaxes leads to the word: the bits of the word's hash name its path, and each branching has weights of
its own for the word before and for the skip, one number each, kept in a table of hashed slots. Classes are balanced:
words go to them by their last two bytes and length, the most frequent such groups first, each to the class least used.

A branch's bias is the log odds of the counts under it (half a count for each word), so without weights the path gives
the word's share of its class. There are ``DEPTH`` levels, 256 paths in each of 32 classes; words that share the whole path
are told apart by their counts. Half a count of each class is for the unknown word. All factors sum to one, so scores are log
probabilities.

Training runs in rounds: each takes one slice of the training documents, tasks sum the gradient over their tokens at the
current weights, blocks of the gradient are added up by Spark in two steps, so no worker gets a record of every task, and every
weight is stepped by its sum over how often it fired, those of slots where they are summed. A task sends the slots that fired
and no others. All slices together are all training documents. The tables grow with the training vocabulary, up to
``MOST_ROWS`` rows for classes and ``MOST_SLOTS`` slots for branches.

Token counts are exact over the whole corpus. The most frequent tokens, ``HEAVY`` at most, are looked up in each task; the
others join their counts in a shuffle that has no hot key left. Null text is empty and has the end token alone, and so has
blank text; a row without an id is never held out. A very long text is scored in one chunk of its own, with history
throughout. Equal counts tie by hash. Repeated rows get a row each. Extra columns are ignored. Without training rows counts
are 0 and classes alike; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlace.llm.common import LOWERED, mix, only, stored, text_chunks, word_hashes, words_of

CLASSES, ROUNDS, HEAVY, TAILS = 32, 3, 100_000, 1 << 19
DEPTH, LEAST_ROWS, MOST_ROWS, LEAST_SLOTS, MOST_SLOTS = 8, 1 << 13, 1 << 14, 1 << 16, 1 << 22
PRIOR, DAMP, CLASS_PRIOR, CLASS_DAMP = 0.7, 1.0, 20.0, 1.0
BLOCK, FAN_IN, SCALE = 1 << 14, 64, 4096  # gradients travel as half floats of a 4096th, up to 2**28
END = np.uint64(0x5EED)
_ODD, _EVEN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_CHUNK = 1 << 19


class Model(NamedTuple):
    classes: np.ndarray  #: class of each tail; the last one is the end token's
    rows: np.ndarray  #: class weights, a row of ``CLASSES`` for each feature
    bias: np.ndarray  #: class bias
    slots: np.ndarray  #: branch weights
    mass: np.ndarray  #: counts at the end of each path, half a one for each word in them
    depth: int
    counts: np.ndarray  #: training tokens of each class
    kinds: np.ndarray  #: distinct training tokens of each class


def native(model: Model) -> Model:
    """The same arrays with numpy's own dtype objects: unpickled ones have others, with which ``np.add.at`` is many times slower."""
    return Model(*[v.view(v.dtype.type) if isinstance(v, np.ndarray) else v for v in model])


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``hash, tail, first``: A to Z lowered words and an end token for each text. A tail stands for a word's last two
    bytes and its length."""
    data = LOWERED[data]
    starts, ends, first = words_of(data, offs)
    h = word_hashes(data, starts, ends)
    tail = np.zeros(0, np.int64)
    if len(h):
        tail = (data[ends - 1].astype(np.int64) << 11) | (data[np.maximum(ends - 2, starts)].astype(np.int64) << 3) | np.minimum(ends - starts, 7)
    n = len(offs) - 1
    return np.insert(h, first[1:], END), np.insert(tail, first[1:], TAILS), first + np.arange(n + 1)


def balanced_classes(by_tail: np.ndarray) -> np.ndarray:
    """The class of each tail. The end token has class 0; tails seen go, the most frequent first, to the class with the
    fewest tokens; tails never seen go by hash."""
    out = np.zeros(TAILS + 1, np.int64)
    out[:TAILS] = (mix(np.arange(TAILS, dtype=np.uint64)) % np.uint64(CLASSES - 1)).astype(np.int64) + 1
    load = [(0.0, k) for k in range(1, CLASSES)]
    for t in np.argsort(-by_tail, kind="stable")[: np.count_nonzero(by_tail)]:
        n, k = heapq.heappop(load)
        out[t] = k
        heapq.heappush(load, (n + float(by_tail[t]), k))
    return out


def histories(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Two hashes for each token, from what stands before it in its text: the word before, and the one before that."""
    n = len(h)
    one, two = np.full(n, END), np.full(n, END)
    one[1:], two[2:] = h[:-1], h[:-2]
    start = first[:-1]
    one[start] = END
    for at in (start, start + 1):
        two[at[at < n]] = END
    return np.stack([mix(one), mix(two ^ np.uint64(0xABCDEF))], 1)


def features(hist: np.ndarray, rows: int) -> np.ndarray:
    return (hist % np.uint64(rows)).astype(np.int64)


def sizes(kinds: float) -> tuple[int, int]:
    """Rows of class weights and slots of branch weights for so many kinds of words."""
    grown = lambda n, least, most: int(min(most, max(least, 2 ** np.ceil(np.log2(max(n, 1))))))
    return grown(kinds, LEAST_ROWS, MOST_ROWS), grown(32 * kinds, LEAST_SLOTS, MOST_SLOTS)


def leaves(h: np.ndarray, cls: np.ndarray, depth: int) -> np.ndarray:
    """The end of each word's path: its class, then ``depth`` bits of its hash."""
    return (cls.astype(np.int64) << depth) | (h & np.uint64((1 << depth) - 1)).astype(np.int64)


def branch_biases(mass: np.ndarray, depth: int) -> list[np.ndarray]:
    """For each level and node the log odds of the counts under its second branch."""
    out = []
    for k in range(depth):
        m = np.maximum(mass.reshape(CLASSES << k, 2, -1).sum(2), 1e-9)
        out.append(np.log(m[:, 1] / m[:, 0]).clip(-25, 25).astype(np.float32))
    return out


def branches(hist: np.ndarray, leaf: np.ndarray, slots: np.ndarray, biases: list[np.ndarray]):
    """``slots fired, bit taken, log odds of the second branch`` at each level of the tokens' paths. A level has a region of
    the slots to itself, small enough to stay in a core's cache while a chunk of tokens passes it."""
    per = len(slots) // (1 << (len(biases) - 1).bit_length())
    shift = np.uint64(65 - per.bit_length())
    for k, bias in enumerate(biases):
        node = leaf >> (len(biases) - k)
        key = (node.astype(np.uint64) + (np.uint64(k + 1) << np.uint64(40))) * _EVEN
        fired = [(((hist[:, j] ^ key) * _ODD) >> shift).astype(np.int64) + k * per for j in (0, 1)]
        z = bias[node]
        for at in fired:
            z += slots[at]
        yield fired, (leaf >> (len(biases) - k - 1)) & 1, z


def path_log_probs(hist: np.ndarray, leaf: np.ndarray, slots: np.ndarray, biases: list[np.ndarray]) -> np.ndarray:
    p = np.ones(len(leaf))
    for _, bit, z in branches(hist, leaf, slots, biases):
        p /= 1 + np.exp(np.where(bit == 1, -z, z).clip(-30, 30))
    return np.log(np.maximum(p, 1e-300))


def class_odds(f: np.ndarray, rows: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The odds of each class, and their sum. Weights are bounded by their steps, so that no odds overflow."""
    z = rows[f[:, 0]]
    z += rows[f[:, 1]]
    z += bias
    np.exp(z, out=z)
    return z, z.sum(1)


def gradient(h, tail, first, model: Model, biases: list[np.ndarray], total: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Adds observed less expected classes (``total``, with how often each feature fired) and branches (``inner``, complex:
    the gradient, and how often the slot fired); gives the classes' sums over all tokens."""
    cls = model.classes[tail]
    hist = histories(h, first)
    f = features(hist, len(total))
    d, whole = class_odds(f, model.rows, model.bias)
    d *= (-1 / whole)[:, None]
    d[np.arange(len(cls)), cls] += 1
    lane, flat = np.arange(CLASSES), total.reshape(-1)
    for k in (0, 1):
        np.add.at(flat, (f[:, k, None] * (CLASSES + 1) + lane).reshape(-1), d.reshape(-1))
        total[:, CLASSES] += np.bincount(f[:, k], minlength=len(total))
    one = np.float32(1)
    for fired, bit, z in branches(hist, leaves(h, cls, model.depth), model.slots, biases):
        e = (bit.astype(np.float32) - one / (one + np.exp(-z))).astype(np.complex64)
        e.imag = one
        for at in fired:
            np.add.at(inner, at, e)  # one visit to the slot for both
    return d.sum(0)


def token_counts(docs: DataFrame) -> DataFrame:
    """``h, tail, c``: each token's count over all rows; tasks sum their own first."""
    schema = pa.schema([("h", pa.int64()), ("tail", pa.int32()), ("c", pa.int64())])

    def merged(parts):
        h, k, c = (np.concatenate(v) for v in zip(*parts, strict=True))
        u, at, inv = np.unique(h, return_index=True, return_inverse=True)
        return u, k[at], np.bincount(inv, weights=c, minlength=len(u)).astype(np.int64)

    def batch_of(p):
        return pa.RecordBatch.from_arrays([pa.array(p[0].view(np.int64)), pa.array(p[1].astype(np.int32)), pa.array(p[2])], schema=schema)

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for _, _, data, offs in text_chunks(batch):
                h, tail, _ = tokens(data, offs)
                parts.append(merged([(h, tail, np.ones(len(h), np.int64))]))
                held += len(parts[-1][0])
                if held > 1_000_000:
                    parts = [merged(parts)]
                    held = len(parts[0][0])
                    if held > 500_000:
                        yield batch_of(parts[0])
                        parts, held = [], 0
        if parts:
            yield batch_of(merged(parts))

    return docs.select("text").mapInArrow(run, "h long, tail int, c long").groupBy("h").agg(F.first("tail").alias("tail"), F.sum("c").alias("c"))


def heavy_counts(counts: DataFrame, most: int | None = None) -> DataFrame:
    """``h, c`` of the most frequent tokens, ``most`` (``HEAVY``) at most: whole classes of like counts, from the top, as far
    as they fit. A histogram of the classes, some hundred rows, says how far; nothing is sorted or gathered."""
    cls = F.floor(F.log2("c") * 8).cast("int")
    left, least = HEAVY if most is None else most, None
    for r in sorted(counts.groupBy(cls.alias("k")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.k):
        left -= r.n
        if left < 0:
            break
        least = r.k
    return counts.where(F.lit(False) if least is None else cls >= least).select("h", "c")


def leaf_mass(counts: DataFrame, classes: np.ndarray, depth: int) -> np.ndarray:
    """Counts, with half a one for each word, at the end of each path. Spark sums them by path, then lays them out by block."""
    n, per = CLASSES << depth, 1 << 12

    def paths(batches):
        for batch in batches:
            h, tail = batch.column("h").to_numpy().view(np.uint64), batch.column("tail").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(leaves(h, classes[tail], depth)), pa.array(batch.column("c").to_numpy() + 0.5)], names=["leaf", "m"])

    def lay(pdf):
        out, b = np.zeros(per), pdf.iloc[:1][["blk"]].copy()
        out[pdf.leaf.to_numpy() % per] = pdf.m.to_numpy()
        b["g"] = [out.tobytes()]
        return b

    sums = counts.select("h", "tail", "c").mapInArrow(paths, "leaf long, m double").groupBy("leaf").agg(F.sum("m").alias("m"))
    mass = np.zeros(max(n, per))
    for r in sums.withColumn("blk", F.floor(F.col("leaf") / per).cast("int")).groupBy("blk").applyInPandas(lay, "blk int, g binary").collect():  # fixed size
        mass[r.blk * per : (r.blk + 1) * per] = np.frombuffer(bytes(r.g))
    return mass[:n].astype(np.float32)


def pressed(v: np.ndarray) -> bytes:
    """Half floats as bytes: how many, a bit for each, and those that are not zero."""
    some = v != 0
    return np.int32(len(v)).tobytes() + np.packbits(some).tobytes() + v[some].tobytes()


def unpressed(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, np.int32, 1)[0])
    some = np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), 4), count=n).astype(bool)
    out = np.zeros(n)
    out[some] = np.frombuffer(data, np.float16, offset=4 + -(-n // 8))
    return out


def _adder(read, n_slots: int = 0):
    """Adds up the vectors of a group, got by ``read``, as single floats. The last adder makes the steps of ``n_slots`` slots from the
    pairs in their blocks."""
    def add(pdf):
        out, total = pdf.iloc[:1].copy(), 0.0
        for v in pdf.g:
            total = total + read(v).astype(np.float64)
        if int(out.blk.iloc[0]) * BLOCK < 2 * n_slots:
            total = slot_steps(*(total.reshape(-1, 2).T * SCALE))
        out["g"] = [total.astype(np.float32).tobytes()]
        return out

    return add


def train(docs: DataFrame, model: Model, rounds: int = ROUNDS) -> Model:
    """The model with its weights after one pass over the rows ``doc_id, text`` in slices; gradients are summed by blocks.
    Tasks are few and large, as each sends one gradient."""
    n_rows, n_slots = len(model.rows), len(model.slots)
    schema = pa.schema([("blk", pa.int32()), ("task", pa.int32()), ("g", pa.binary())])
    sc = docs.sparkSession.sparkContext
    fixed = sc.broadcast(branch_biases(model.mass, model.depth))
    for r in range(rounds):
        now = sc.broadcast(model)  # fixed size

        def run(batches, now=now):
            from pyspark import TaskContext

            m, total, over = native(now.value), np.zeros((n_rows, CLASSES + 1), np.float32), np.zeros(CLASSES + 1)
            inner = np.zeros(n_slots, np.complex64)
            for batch in batches:
                for _, _, data, offs in text_chunks(batch, limit=_CHUNK):
                    t = tokens(data, offs)
                    over[:CLASSES] += gradient(*t, m, fixed.value, total, inner)
                    over[CLASSES] += len(t[0])
            if over[CLASSES]:
                flat = (np.concatenate([inner.view(np.float32), total.reshape(-1), over.astype(np.float32)]) / np.float32(SCALE)).astype(np.float16)
                for k in range(0, len(flat), 64 * BLOCK):
                    part = [pressed(flat[j : j + BLOCK]) for j in range(k, min(len(flat), k + 64 * BLOCK), BLOCK)]
                    at = np.arange(len(part)) + k // BLOCK
                    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.full(len(part), TaskContext.get().partitionId()), pa.int32()), pa.array(part, pa.binary())], schema=schema)

        part = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(rounds)) == r).select("text")
        tasks = max(sc.defaultParallelism, part.rdd.getNumPartitions() // 8)
        sent = part.coalesce(tasks).mapInArrow(run, "blk int, task int, g binary")
        read = unpressed
        if tasks > FAN_IN:  # no worker gets a record of every task
            sent = sent.withColumn("task", F.pmod("task", F.lit(-(-tasks // FAN_IN)))).groupBy("blk", "task").applyInPandas(_adder(read), "blk int, task int, g binary")
            read = lambda v: np.frombuffer(v, np.float32)
        steps, rest, told = np.zeros(n_slots, np.float32), np.zeros((n_rows + 1) * (CLASSES + 1), np.float32), False
        for x in sent.groupBy("blk").applyInPandas(_adder(read, n_slots), "blk int, task int, g binary").toLocalIterator():  # a partition's blocks at a time
            v, at = np.frombuffer(x.g, np.float32), x.blk * BLOCK
            into, at = (steps, at // 2) if at < 2 * n_slots else (rest, at - 2 * n_slots)
            into[at : at + len(v)] = v
            told = True
        now.destroy()  # else each round's weights stay on every executor's disk
        if told:
            rest *= np.float32(SCALE)
            model = stepped(model, rest[: -CLASSES - 1], steps, rest[-CLASSES - 1 :])
        del steps, rest
    fixed.destroy()
    return model


def slot_steps(inner: np.ndarray, fired_n: np.ndarray) -> np.ndarray:
    return (DAMP * inner / (0.25 * fired_n + PRIOR)).clip(-3, 3)


def stepped(model: Model, total: np.ndarray, steps: np.ndarray, over: np.ndarray) -> Model:
    """Every weight moved by its gradient over how often it fired (for slots: by their ``steps``). Features that fire together each
    take a part."""
    full, p = total.reshape(-1, CLASSES + 1), np.maximum(np.exp(model.bias), 0.01)
    rows = model.rows + (full[:, :CLASSES] * CLASS_DAMP / (full[:, CLASSES:] * p + CLASS_PRIOR)).clip(-2, 2)
    bias = model.bias + (over[:CLASSES] * CLASS_DAMP / (over[CLASSES] * p + CLASS_PRIOR)).clip(-2, 2)
    return model._replace(rows=rows.astype(np.float32), bias=bias.astype(np.float32), slots=model.slots + steps)


def fit(counts: DataFrame, learn: DataFrame) -> Model:
    """The model from the stored token counts and the rows they were counted in. A row a tail comes to the driver, ``TAILS``
    at most."""
    tails = counts.groupBy("tail").agg(F.sum("c").alias("c"), F.count("*").alias("n")).toArrow()
    by_tail, kinds = np.zeros(TAILS + 1), np.zeros(TAILS + 1)
    at = tails.column("tail").to_numpy()
    by_tail[at], kinds[at] = tails.column("c").to_numpy(), tails.column("n").to_numpy()
    classes = balanced_classes(by_tail[:TAILS])
    cls_n, cls_v = (np.bincount(classes, weights=v, minlength=CLASSES) for v in (by_tail, kinds))
    n_rows, n_slots = sizes(float(cls_v.sum()))
    bias = np.log((cls_n + 1) / (cls_n.sum() + CLASSES)).astype(np.float32)
    start = Model(classes, np.zeros((n_rows, CLASSES), np.float32), bias, np.zeros(n_slots, np.float32), leaf_mass(counts, classes, DEPTH), DEPTH, cls_n, cls_v)
    return train(learn, start)


def _score_batches(now):
    names = ["uid", "doc_id", "held_out", "h", "cls", "n", "known", "base", "lm", "path"]

    def run(batches):
        from pyspark import TaskContext

        m, heavy, count = now.value
        biases, log_mass = branch_biases(m.mass, m.depth), np.log10(np.maximum(m.mass, 0.5))
        uid = TaskContext.get().partitionId() << 40
        total, kinds = m.counts.sum(), m.kinds.sum()
        known = np.log10(1 - 0.5 / (m.counts + 0.5 * (m.kinds + 1)).clip(0.75))
        whole = lambda c: np.log10((c + 0.5) / (total + 0.5 * (kinds + 1)))
        for batch in batches:
            for lo, hi, data, offs in text_chunks(batch, limit=_CHUNK):
                h, tail, first = tokens(data, offs)
                cls = m.classes[tail]
                hist, leaf = histories(h, first), leaves(h, cls, m.depth)
                odds, sums = class_odds(features(hist, len(m.rows)), m.rows, m.bias)
                lp = np.log10(odds[np.arange(len(h)), cls] / sums.astype(float))
                path = path_log_probs(hist, leaf, m.slots, biases) / np.log(10) + known[cls] - log_mass[leaf]  # of a known word, but for its count
                at = np.minimum(np.searchsorted(heavy, h), max(0, len(heavy) - 1))
                hit = heavy[at] == h if len(heavy) else np.zeros(len(h), bool)
                row = np.repeat(np.arange(hi - lo), np.diff(first))
                c = np.where(hit, count[at] if len(heavy) else 0, 0)
                add = lambda v: np.bincount(row, weights=v, minlength=hi - lo)  # noqa: E731, B023
                ids = np.arange(hi - lo) + uid
                uid += hi - lo
                part = batch.slice(lo, hi - lo)
                base = add(np.where(hit, whole(c), 0.0))
                lm = add(lp + np.where(hit, path + np.log10(c + 0.5), 0.0))
                none = pa.nulls(hi - lo, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ids), part.column("doc_id"), part.column("held_out"), none, none.cast(pa.int32()), pa.array(np.diff(first)), pa.array(add(hit & (c > 0)).astype(np.int64)), pa.array(base), pa.array(lm), pa.nulls(hi - lo, pa.float64())], names=names)
                if (rest := np.flatnonzero(~hit)).size:
                    key = np.stack([row[rest].astype(np.uint64), h[rest]], 1)
                    order = np.lexsort((key[:, 1], key[:, 0]))
                    key, k, path = key[order], cls[rest][order], path[rest][order]
                    cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
                    n = np.diff(np.append(cut, len(key)))
                    some = len(cut)
                    zero = pa.array(np.zeros(some))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[key[cut, 0].astype(np.int64)]), pa.nulls(some, pa.int64()), pa.nulls(some, pa.bool_()), pa.array(key[cut, 1].view(np.int64)), pa.array(k[cut], pa.int32()), pa.array(n), pa.array(np.zeros(some, np.int64)), zero, zero, pa.array(np.add.reduceat(path, cut))], names=names)

    return run


def score(docs: DataFrame, held_out) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each row, learning from the rows
    whose ``held_out`` is false."""
    spark = docs.sparkSession
    d = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    learn = d.where(~F.col("held_out"))
    counts = stored(token_counts(learn))
    model = fit(counts, learn)
    total, kinds = float(model.counts.sum()), float(model.kinds.sum())
    top = heavy_counts(counts).toArrow()  # at most HEAVY rows
    heavy = top.column("h").to_numpy().view(np.uint64)
    order = np.argsort(heavy)
    now = spark.sparkContext.broadcast((model, heavy[order], top.column("c").to_numpy()[order]))
    schema = "uid long, doc_id long, held_out boolean, h long, cls int, n long, known long, base double, lm double, path double"
    parts = stored(d.mapInArrow(_score_batches(now), schema))
    found = parts.where("h is not null").select("uid", "h", "cls", "n", "path").join(counts.select("h", "c"), "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    in_class = spark.createDataFrame([(k, float(model.counts[k] + 0.5 * (model.kinds[k] + 1))) for k in range(CLASSES)], "cls int, z double")
    found = found.join(F.broadcast(in_class), "cls")  # a row a class
    rest = found.groupBy("uid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("k2"), F.sum(F.col("n") * F.log10((F.col("c") + 0.5) / (total + 0.5 * (kinds + 1)))).alias("b2"),
        F.sum(F.when(F.col("c") > 0, F.col("path") + F.col("n") * F.log10(F.col("c") + 0.5)).otherwise(F.col("n") * F.log10(0.5 / F.col("z")))).alias("l2"),
    )
    out = parts.where("h is null").join(rest, "uid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("known") + zero("k2")).cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + zero("b2")).alias("base_score"), (F.col("lm") + zero("l2")).alias("score"),
    )

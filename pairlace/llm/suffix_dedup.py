"""Suffix-array dedup: each byte within a string of 50 bytes that also starts in a document with a smaller id is removed.

A string of ``WIDTH`` bytes holds 19 overlapping pieces of ``PIECE`` bytes; the one with the least hash is its anchor, wherever the
string stands. So strings that are equal have equal anchors, and only a tenth of the places of a text are anchors.

1. Rows are fingerprinted (SHA-256). A row whose whole text a smaller id has goes as a whole and takes no further part.
2. Anchors' hashes are sent to ranges of hashes, as packed arrays that hold a hash once a task and chunk of documents. A range
   says which hashes at least two documents have, and whether very many do.
3. Chunks cut the surroundings of those anchors (68 bytes at most: all strings with that anchor), each different one once,
   and send them to ranges of anchors. An anchor that very many documents have would bring a range one row a document (the text
   around a passage differs): there each string is sent by its own hash, so equal ones meet and different ones part.
4. A range sorts all suffixes that start in its surroundings to the depth of ``WIDTH`` bytes: its part of the suffix array. From the
   order it takes longest-previous-factors: for a suffix, the nearest ones before and after it in suffix order that lie in an
   earlier document. Where one shares ``WIDTH`` bytes, the string has an earlier copy.
5. Chunks gather what the ranges found into spans of documents, and one pass over the documents cuts them.

Ids, hashes and short contexts are shuffled, besides the texts once, compressed. A task holds a chunk (8 MB of text) or a range,
whose number follows the bytes of all texts. A hash or string brings a range one entry a chunk at most, so neither a passage in
a third of all documents nor a large group of copies fills a task.

A null text is an empty one. A row without an id is never cut and nobody's source. Rows with equal ids are not earlier than
each other; repeated rows get equal results. Strings never cross documents, and repeats within a document alone stay. Texts
of fewer than 50 bytes stay. Bytes of a character may be cut apart, as strings are of bytes. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlace.llm.common import BYTE_KEY, forget, meet, mix, only, stored, text_chunks

WIDTH, PIECE = 50, 32
SPREAD = WIDTH - PIECE  # a string starts at most so many bytes before its anchor
BLOCK = 1 << 16  # places hashed at a time: arrays that stay in the cache
CHUNK_BYTES, KEY_RANGE_BYTES, RANGE_BYTES = 8 << 20, 12 << 20, 4 << 20
VERY_MANY = 2000  # documents with one anchor, beyond which its strings are dealt by their own hash
_FACTORS = np.random.default_rng(20240613).integers(1, 2**63, 8, dtype=np.uint64) | np.uint64(1)
_LOW, _TURN = np.uint64((1 << 32) - 1), np.uint64(0x9E3779B97F4A7C15)


def piece_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``PIECE`` bytes at each place, by doubling."""
    h, m, k = BYTE_KEY[data], 1, 0
    while m < PIECE:
        h = h[:-m] * _FACTORS[k] + h[m:]
        m, k = 2 * m, k + 1
    return mix(h)


def anchors(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """``anchor, first, last, hash, hash at first, hash at the end`` of the anchors of texts laid end to end at ``offs``: the
    strings that start from first to last have that anchor. The three hashes tell the bytes from first to the end of the last."""
    ends = offs[1:]
    for lo in range(0, len(data) - WIDTH + 1, BLOCK):
        n = min(BLOCK, len(data) - WIDTH + 1 - lo)  # strings that start in the block
        h = piece_hashes(data[lo : lo + n + WIDTH - 1])
        least = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while 2 * span <= SPREAD + 1:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if rest := SPREAD + 1 - span:
            least = np.minimum(least[:-rest], least[rest:])
        at = (least[:n] & _LOW).astype(np.int64)
        whole = np.ones(n, bool)
        for e in ends[np.searchsorted(ends, lo, "right") : np.searchsorted(ends, lo + n + WIDTH)]:
            whole[max(0, e - WIDTH + 1 - lo) : max(0, e - lo)] = False
        start = np.flatnonzero(whole)
        if not len(start):
            continue
        a = at[start]
        new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (start[1:] != start[:-1] + 1)])
        q, first, last = a[new], start[new], start[np.r_[new[1:], len(start)] - 1]
        yield q + lo, first + lo, last + lo, mix(h[q] ^ _TURN), h[first], h[last + SPREAD]  # least hashes are small ones: spread them


def range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def in_range(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """A hash's range and its low half."""
    return range_of(hashes, ranges).astype(np.uint64) << np.uint64(32) | (hashes & _LOW)


def squeezed(*arrays: np.ndarray) -> list[bytes]:
    return [pa.compress(np.ascontiguousarray(a).tobytes(), codec="zstd", asbytes=True) if a.size else b"" for a in arrays]


def unsqueezed(raw: bytes, size: int, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, size * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind) if size else np.zeros(0, kind)


# ---- 2: anchors that several documents have -------------------------------------------------------------------

#: A task's anchors of a range: sorted hashes as differences, with the chunk of each and its documents there.
KEYS = "range long, size long, data binary, chunks binary, counts binary"
_KEYS = pa.schema([("range", pa.int64()), ("size", pa.int64()), ("data", pa.binary()), ("chunks", pa.binary()), ("counts", pa.binary())])
FLUSH_ANCHORS = 1_000_000


def columns_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else schema.empty_table()


def _key_rows(key: np.ndarray, chunk: np.ndarray, row: np.ndarray) -> Iterator[tuple]:
    order = np.argsort(chunk.astype(np.uint16) if chunk.max() < 1 << 16 else chunk, kind="stable")
    order = order[np.argsort(key[order], kind="stable")]  # rows of a hash and chunk stay in order
    key, chunk, row = key[order], chunk[order], row[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])]
    docs = np.add.reduceat(np.r_[True, new[1:] | (row[1:] != row[:-1])].astype(np.int64), np.flatnonzero(new))
    key, chunk = key[new], chunk[new]
    r, low = (key >> np.uint64(32)).astype(np.int64), (key & _LOW).astype(np.uint32)
    cut = np.flatnonzero(np.r_[True, r[1:] != r[:-1], True])
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        yield int(r[lo]), hi - lo, *squeezed(np.diff(low[lo:hi], prepend=np.uint32(0)), chunk[lo:hi].astype(np.uint32), np.minimum(docs[lo:hi], 255).astype(np.uint8))


def _emit_keys(ranges: int):
    def run(batches):
        held, n, row = [], 0, 0

        def told():
            key, chunk, own = (np.concatenate(x) for x in zip(*held, strict=True))
            return columns_of(list(_key_rows(key, chunk, own)), _KEYS).to_batches()

        for batch in batches:
            chunks = batch.column("chunk").to_numpy(zero_copy_only=False).astype(np.uint32)
            for lo, _, data, offs in text_chunks(batch, limit=4 * BLOCK):
                for q, _, _, h, _, _ in anchors(data, offs):
                    own = lo + np.searchsorted(offs, q, "right") - 1
                    held.append((in_range(h, ranges), chunks[own], (row + own).astype(np.int32)))
                    n += len(q)
            row += batch.num_rows
            if n > FLUSH_ANCHORS:
                yield from told()
                held, n = [], 0
        if held:
            yield from told()

    return run


#: What a range tells a chunk: which of its anchors are shared (differences of sorted hashes), and whether by very many.
SHARED = "chunk long, kind int, range long, size long, data binary, also binary"
_SHARED = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("range", pa.int64()), ("size", pa.int64()), ("data", pa.binary()), ("also", pa.binary())])


def _shared_keys(table: pa.Table) -> pa.Table:
    r, sizes = table["range"][0].as_py(), table["size"].to_pylist()
    every = lambda c, kind: [unsqueezed(x, n, kind) for x, n in zip(table[c].to_pylist(), sizes, strict=True)]
    key = np.concatenate([np.cumsum(x, dtype=np.uint32) for x in every("data", np.uint32)])
    chunk, docs = np.concatenate(every("chunks", np.uint32)), np.concatenate(every("counts", np.uint8))
    one, at = np.unique(key, return_inverse=True)
    total = np.bincount(at, weights=docs, minlength=len(one))[at]
    keep = total > 1
    pair, first = np.unique(chunk[keep].astype(np.uint64) << np.uint64(32) | key[keep], return_index=True)
    very, chunk, key = (total[keep] > VERY_MANY)[first].astype(np.uint8), (pair >> np.uint64(32)).astype(np.int64), (pair & _LOW).astype(np.uint32)
    cut = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1], True]) if len(pair) else np.zeros(1, np.int64)
    return columns_of([(int(chunk[lo]), 1, r, hi - lo, *squeezed(np.diff(key[lo:hi], prepend=np.uint32(0)), very[lo:hi])) for lo, hi in zip(cut[:-1], cut[1:], strict=True)], _SHARED)


# ---- 3: what stands around them -------------------------------------------------------------------------------

#: ``range`` is -1 for a row of documents (their ids and fingerprints). ``data`` holds the surroundings, ``own`` for each the
#: first and last start in it and its least id; ``also`` who has it: surroundings, document, place.
AROUND = "range long, chunk long, size long, uses long, data binary, own binary, also binary"
_AROUND = pa.schema([("range", pa.int64()), ("chunk", pa.int64()), ("size", pa.int64()), ("uses", pa.int64()), ("data", pa.binary()), ("own", pa.binary()), ("also", pa.binary())])
OWN = np.dtype([("first", "u1"), ("last", "u1"), ("id", "<i8")])
USE = np.dtype([("around", "<i4"), ("doc", "<i4"), ("at", "<i8")])


#: Rows of a chunk. Kind 0: a task's documents, text compressed. Kind 1: as in ``SHARED``. Kind 2: a copy (its id in ``size``).
DEALT = "chunk long, kind int, range long, size long, data binary, also binary, ids binary, prints binary"
_DEALT = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("range", pa.int64()), ("size", pa.int64()), ("data", pa.binary()), ("also", pa.binary()), ("ids", pa.binary()), ("prints", pa.binary())])


def _pack_texts(batches):
    """A task's documents by chunk: compressed text, with lengths, ids and fingerprints."""
    held: dict[int, list] = {}

    def told():
        rows = []
        for chunk, docs in held.items():
            ids, prints, texts = zip(*docs, strict=True)
            lengths = np.array([len(t) for t in texts], np.int64)
            rows.append((chunk, 0, None, int(lengths.sum()), pa.compress(b"".join(texts), codec="zstd", asbytes=True), lengths.tobytes(), np.array(ids, np.int64).tobytes(), b"".join(prints)))
        return columns_of(rows, _DEALT).to_batches()

    n = 0
    for batch in batches:
        raw = pc.cast(batch.column("text"), pa.binary()).to_pylist()
        for chunk, id_, fingerprint, text in zip(*(batch.column(c).to_pylist() for c in ("chunk", "doc_id", "print")), raw, strict=True):
            held.setdefault(chunk, []).append((id_, fingerprint, text))
            n += len(text)
        if n > 4 * CHUNK_BYTES:
            yield from told()
            held.clear()
            n = 0
    yield from told()


def _around(ranges: int, parts: int):
    """A chunk: the surroundings of its shared anchors, a row a range."""
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        chunk = rows[0]["chunk"]
        gone = {(x["size"], x["prints"]) for x in rows if x["kind"] == 2}
        keys = [(np.cumsum(unsqueezed(x["data"], x["size"], np.uint32), dtype=np.uint32).astype(np.uint64) | np.uint64(x["range"] << 32), unsqueezed(x["also"], x["size"], np.uint8)) for x in rows if x["kind"] == 1]
        ids, prints, texts = [], [], []
        for x in rows:
            if x["kind"] == 0:
                raw, at = pa.decompress(x["data"], x["size"], codec="zstd", asbytes=True), 0
                for k, (id_, n) in enumerate(zip(np.frombuffer(x["ids"], np.int64).tolist(), np.frombuffer(x["also"], np.int64).tolist(), strict=True)):
                    if (id_, p := x["prints"][32 * k : 32 * k + 32]) not in gone:
                        gone.add((id_, p))  # of repeated rows one is enough
                        ids.append(id_)
                        prints.append(p)
                        texts.append(raw[at : at + n])
                    at += n
        del rows
        if not texts or not keys:
            return _AROUND.empty_table()
        key, many = (np.concatenate(x) for x in zip(*keys, strict=True))
        order = np.argsort(key)
        key, many = key[order], many[order]
        data = np.frombuffer(b"".join(texts), np.uint8)
        offs = np.r_[0, np.cumsum([len(t) for t in texts])]
        kept = []
        for q, first, last, h, h0, h1 in anchors(data, offs):
            own = in_range(h, ranges)
            at = np.minimum(np.searchsorted(key, own), len(key) - 1)
            hit = key[at] == own
            very = hit & (many[at] > 0)
            hit &= ~very
            kept.append((q[hit] - SPREAD, first[hit], last[hit], h[hit], mix(h0[hit] ^ np.uint64(1)) + h[hit] * np.uint64(3), mix(h1[hit]) ^ h[hit]))
            if very.any():  # each string for itself
                lo, n = first[very], (last - first)[very] + 1
                t = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                g = piece_hashes(data[t[0] : t[-1] + WIDTH])
                a, b = g[t - t[0]], g[t - t[0] + SPREAD]
                kept.append((t, t, t, mix(a * np.uint64(5) + b), mix(a ^ np.uint64(7)), mix(b ^ np.uint64(9))))
        base, first, last, route, c1, c2 = (np.concatenate(x) for x in zip(*kept, strict=True)) if kept else [np.zeros(0, np.int64)] * 6
        if not len(base):
            return _AROUND.empty_table()
        doc = np.searchsorted(offs, first, "right") - 1
        ids_ = np.array(ids, np.int64)
        shape = (first - base) * 64 + (last - base)
        r = range_of(route.astype(np.uint64), parts)
        order = np.lexsort((ids_[doc], shape, c2, c1, r))
        base, first, last, doc, shape, r, c1, c2 = (x[order] for x in (base, first, last, doc, shape, r, c1, c2))
        new = np.r_[True, (r[1:] != r[:-1]) | (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1]) | (shape[1:] != shape[:-1])]
        what, head = np.cumsum(new) - 1, np.flatnonzero(new)  # within a group the least id comes first
        cut = np.flatnonzero(np.r_[True, r[1:] != r[:-1], True])
        out = [(-1, chunk, len(ids), 0, ids_.tobytes(), b"".join(prints), offs[:-1].astype(np.int64).tobytes())]
        step = np.arange(WIDTH + SPREAD)
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            u = head[what[lo] : what[hi - 1] + 1]
            place = base[u][:, None] + step
            bytes_ = np.where((place >= first[u][:, None]) & (place < last[u][:, None] + WIDTH), data[np.clip(place, 0, len(data) - 1)], 0).astype(np.uint8)
            own = np.zeros(len(u), OWN)
            own["first"], own["last"], own["id"] = first[u] - base[u], last[u] - base[u], ids_[doc[u]]
            use = np.zeros(hi - lo, USE)
            use["around"], use["doc"], use["at"] = what[lo:hi] - what[lo], doc[lo:hi], base[lo:hi]
            out.append((int(r[lo]), chunk, len(u), hi - lo, *squeezed(bytes_, own, use)))
        return columns_of(out, _AROUND)

    return run


# ---- 4: suffix order and longest previous factors --------------------------------------------------------------

def suffix_order(texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of equally long byte strings (a row each), and whether each shares all its bytes with the one before it in
    that order; ties stay in order of the rows."""
    n, m = texts.shape
    words = []
    for at in range(0, m, 8):
        eight = np.zeros((n, 8), np.uint8)
        eight[:, : min(8, m - at)] = texts[:, at : at + 8]
        words.append(eight.view(">u8")[:, 0].astype(np.uint64))
    order = np.lexsort(words[::-1])
    tied = np.ones(n, bool)
    tied[:1] = False
    for w in words:
        tied[1:] &= w[order][1:] == w[order][:-1]
    return order, tied


def _smaller_before(key: np.ndarray, tied: np.ndarray) -> np.ndarray:
    """Whether the nearest place before with a smaller key can be reached over tied neighbours. Pointers jump over stretches
    that are known to hold no smaller key, so rounds follow the log of the longest stretch."""
    before, live, found = np.arange(len(key)) - 1, tied.copy(), np.zeros(len(key), bool)
    todo = np.flatnonzero(live)
    while len(todo):
        p = before[todo]
        hit = key[p] < key[todo]
        found[todo[hit]] = True
        todo, p = todo[~hit], p[~hit]
        on, beyond = live[p], before[p]
        live[todo], before[todo] = on, beyond
        todo = todo[on]
    return found


def has_previous_factor(texts: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each byte string whether an equal one has a smaller key: the previous or the next smaller place in suffix order
    shares its whole length."""
    order, tied = suffix_order(texts)
    k = key[order]
    found = _smaller_before(k, tied) | _smaller_before(k[::-1], np.r_[False, tied[1:][::-1]] if len(k) else tied)[::-1]
    out = np.zeros(len(key), bool)
    out[order] = found
    return out


FACTORS = "range long, chunk long, size long, data binary"
_FACTORS_SCHEMA = pa.schema([("range", pa.int64()), ("chunk", pa.int64()), ("size", pa.int64()), ("data", pa.binary())])
FACTOR = np.dtype([("id", "<i8"), ("starts", "<u4")])  # the least id that has these surroundings; bits: the starts that it has from another


def _range_factors(table: pa.Table) -> pa.Table:
    sizes = table["size"].to_pylist()
    around = np.concatenate([unsqueezed(x, n * (WIDTH + SPREAD), np.uint8).reshape(n, -1) for x, n in zip(table["data"].to_pylist(), sizes, strict=True)])
    own = np.concatenate([unsqueezed(x, n, OWN) for x, n in zip(table["own"].to_pylist(), sizes, strict=True)])
    # equal surroundings of different chunks are one, with their least id
    order, tied = suffix_order(np.c_[around, own["first"], own["last"]])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(~tied) - 1
    least = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, own["id"])
    one = order[~tied]
    first, n = own["first"][one].astype(np.int64), own["last"][one].astype(np.int64) - own["first"][one] + 1
    which = np.repeat(np.arange(len(one)), n)
    start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[which]
    cells = np.lib.stride_tricks.sliding_window_view(around, WIDTH, axis=1)[one[which], start]
    found = has_previous_factor(cells, least[which])
    bits = np.zeros(len(one), np.uint32)
    np.bitwise_or.at(bits, which[found], np.uint32(1) << start[found].astype(np.uint32))
    told = np.zeros(len(group), FACTOR)
    told["id"], told["starts"] = least[group], bits[group]
    cut = np.r_[0, np.cumsum(sizes)]
    return pa.table([table["range"], table["chunk"], table["size"], pa.array([squeezed(told[a:b])[0] for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], schema=_FACTORS_SCHEMA)


# ---- 5: spans --------------------------------------------------------------------------------------------------

SPANS = "doc_id long, print binary, cuts array<long>"
_SPANS = pa.schema([("doc_id", pa.int64()), ("print", pa.binary()), ("cuts", pa.list_(pa.int64()))])


def _chunk_spans(table: pa.Table) -> pa.Table:
    """A chunk's documents with their removed runs, ``start, end`` by turns."""
    rows = table.to_pylist()
    uses = {x["range"]: x for x in rows if x["kind"] == 0}
    docs = uses.get(-1)
    if docs is None:
        return _SPANS.empty_table()
    ids, offs = np.frombuffer(docs["data"], np.int64), np.frombuffer(docs["also"], np.int64)
    doc, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for x in rows:
        if x["kind"] == 1:
            use = unsqueezed(uses[x["range"]]["also"], uses[x["range"]]["uses"], USE)
            own = unsqueezed(uses[x["range"]]["own"], x["size"], OWN)[use["around"]]
            told = unsqueezed(x["data"], x["size"], FACTOR)[use["around"]]
            late = ids[use["doc"]] > told["id"]
            for start in range(SPREAD + 1):
                hit = (own["first"] <= start) & (start <= own["last"]) & (late | (told["starts"] >> np.uint32(start) & 1 > 0))
                doc.append(use["doc"][hit].astype(np.int64))
                at.append(use["at"][hit] + start)
    doc, at = np.concatenate(doc), np.concatenate(at)
    if not len(doc):
        return _SPANS.empty_table()
    at = np.unique(at)  # places in the chunk, so documents follow one another
    doc = np.searchsorted(offs, at, "right") - 1
    new = np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + WIDTH)]
    head = np.flatnonzero(new)
    spans = np.stack([at[head], at[np.r_[head[1:], len(at)] - 1] + WIDTH], 1) - offs[doc[head]][:, None]
    owner = doc[head]
    cut = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1], True])
    out = [(int(ids[owner[a]]), docs["own"][32 * owner[a] : 32 * owner[a] + 32], spans[a:b].ravel().tolist()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return columns_of(out, _SPANS)


def fingerprint(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _read(docs: DataFrame) -> DataFrame:
    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, print, cuts``: for each id and text (SHA-256) that loses bytes, the removed runs as ``start, end`` by turns. Stored."""
    texts = _read(docs).select("doc_id", "text", fingerprint(F.col("text")).alias("print"))
    small = stored(texts.select("doc_id", "print", F.octet_length("text").cast("long").alias("bytes")).where(F.col("doc_id").isNotNull() & (F.col("bytes") >= WIDTH)))
    total = small.agg(F.sum("bytes")).first()[0] or 0
    chunks, ranges, parts = (max(1, -(-total // b)) for b in (CHUNK_BYTES, KEY_RANGE_BYTES, RANGE_BYTES))
    firsts = stored(small.groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    copies = stored(meet(small, firsts, "print", "n").where("doc_id > least").select("doc_id", "print", "bytes").distinct())
    chunk = F.pmod(F.xxhash64("doc_id", "print"), F.lit(chunks)).alias("chunk")
    long = texts.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= WIDTH)).select(chunk, "doc_id", "print", "text")
    shared = long.select("chunk", "text").mapInArrow(_emit_keys(ranges), KEYS).groupBy("range").applyInArrow(_shared_keys, SHARED)
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    dealt = long.mapInArrow(_pack_texts, DEALT).unionByName(stored(shared).select("*", *none("binary", "ids", "prints")))
    dealt = dealt.unionByName(copies.select(chunk, F.lit(2).alias("kind"), *none("long", "range"), F.col("doc_id").alias("size"), *none("binary", "data", "also", "ids"), F.col("print").alias("prints")))
    around = stored(dealt.groupBy("chunk").applyInArrow(_around(ranges, parts), AROUND))
    factors = around.where("range >= 0").select("range", "chunk", "size", "data", "own").groupBy("range").applyInArrow(_range_factors, FACTORS)
    uses = around.select("range", "chunk", F.lit(0).alias("kind"), "size", "uses", F.when(F.col("range") < 0, F.col("data")).alias("data"), "own", "also")
    back = factors.select("range", "chunk", F.lit(1).alias("kind"), "size", *none("long", "uses"), "data", *none("binary", "own", "also"))
    spans = uses.unionByName(back).groupBy("chunk").applyInArrow(_chunk_spans, SPANS)
    whole = copies.select("doc_id", "print", F.array(F.lit(0).cast("long"), "bytes").alias("cuts"))
    out = stored(spans.unionByName(whole))
    forget(around)
    return out


def _cut(batches):
    for batch in batches:
        raw = pc.cast(batch.column("text"), pa.binary()).to_pylist()
        rows = []
        for id_, text, cuts in zip(batch.column("doc_id").to_pylist(), raw, batch.column("cuts").to_pylist(), strict=True):
            at = [0, *(cuts or []), len(text)]
            kept = hashlib.sha256()
            for lo, hi in zip(at[::2], at[1::2], strict=True):
                kept.update(text[lo:hi])
            rows.append((id_, len(text), sum(at[2:-1:2]) - sum(at[1:-1:2]), len(at) // 2 - 1, kept.hexdigest()))
        yield from columns_of(rows, _RESULT).to_batches()


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
MOST_CUTS = 4_000_000  # numbers in the spans, beyond which they are not broadcast


def dedup(docs: DataFrame) -> DataFrame:
    """A row for each document: its bytes, those removed, in how many runs, and the SHA-256 of what stays."""
    spans = repeated_spans(docs)
    size = spans.agg(F.count("*") + F.coalesce(F.sum(F.size("cuts")), F.lit(0))).first()[0]
    texts = _read(docs).select("doc_id", "text", fingerprint(F.col("text")).alias("print"))
    met = texts.join(F.broadcast(spans) if size <= MOST_CUTS else spans, ["doc_id", "print"], "left")
    return met.select("doc_id", "text", "cuts").mapInArrow(_cut, RESULT)

"""Filter interaction audit: what each of five text filters removes, in every order of applying them.

The filters (words are runs without white space, case counts): A fewer than 100 words, B fewer than 80 distinct words in 100,
C more than 10 capitals A-Z in 100 code points, D one of ``#$%&*|``, E the text of a smaller doc_id.

Copies are found on a fingerprint-routed RDD. A partition of the input first settles what it can by itself: of each text it
keeps the least id and tells the other ids at once, so a text that fills a third of the table leaves each partition once. What is
kept goes to the partition of its xxhash64, into a chain of the texts with that fingerprint, each with its full text and its
least id so far; every other id is emitted. ``combineByKey`` then merges vectors of counts by mask of failed filters, 96 numbers a
part, from which all orders follow. A partition holds the distinct texts dealt to it, whose
number follows the bytes of all texts; labels join rows of a few numbers, never texts.

A null text is an empty one. A null id is no smaller than another and has none smaller, so it fails no E; rows with equal ids and
texts fail it together or not at all. A document is good or toxic if any of its labels says so; labels without an id
play no part. Repeated rows count each. An empty table gives no part. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlace.llm.common import only

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
FLUSH_BYTES = 64 << 20  # of distinct texts that an input partition holds before it passes them on
ROUTED_BYTES = 16 << 20  # of texts dealt to a partition, were they all different
_NO_CAPITAL = bytes(b for b in range(256) if not 65 <= b <= 90)
_FIRST_BYTE = bytes(b for b in range(256) if b & 0xC0 != 0x80)  # each code point has one
_MARK = re.compile(rb"[#$%&*|]")


def text_mask(raw: bytes) -> int:
    """Bits 0 to 3 for A to D. ``bytes.split`` splits at the six ASCII white spaces."""
    words = raw.split()
    points = len(raw) - len(raw.translate(None, _FIRST_BYTE))
    fails = len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(raw.translate(None, _NO_CAPITAL)) > 10 * points, bool(_MARK.search(raw))
    return sum(f << k for k, f in enumerate(fails))


class Chains:
    """Chains by fingerprint of ``[text, least id, its rows by part, mask]``; a row that is not the least of its text is
    told as ``id, part, mask, rows``."""

    def __init__(self) -> None:
        self.by_print: dict[int, list[list]] = {}
        self.held = 0

    def put(self, fingerprint: int, raw: bytes, id_: int, parts: dict[str, int], mask: int | None = None) -> Iterator[tuple]:
        chain = self.by_print.setdefault(fingerprint, [])
        link = next((x for x in chain if x[0] == raw), None)
        if link is None:
            chain.append([raw, id_, Counter(parts), text_mask(raw) if mask is None else mask])
            self.held += len(raw)
        elif id_ == link[1]:
            link[2].update(parts)
        else:
            if id_ < link[1]:
                (link[1], link[2]), (id_, parts) = (id_, Counter(parts)), (link[1], link[2])
            for part, n in parts.items():
                yield id_, part, link[3] | COPY, n

    def take(self) -> Iterator[tuple[int, list]]:
        """The links with their fingerprints; none is left."""
        for fingerprint, chain in self.by_print.items():
            for link in chain:
                yield fingerprint, link
        self.by_print, self.held = {}, 0


def _settled(rows: Iterable) -> Iterator[tuple[int, tuple]]:
    """``key, (None, row told)`` or ``fingerprint, (text, id, parts, mask)`` of an input partition."""
    chains = Chains()
    for fingerprint, text, id_, part in rows:
        raw = text.encode()
        if id_ is None:
            yield fingerprint, (None, (None, part, text_mask(raw), 1))
            continue
        for told in chains.put(fingerprint, raw, id_, {part: 1}):
            yield hash(told[0]), (None, told)  # dealt by id: a hot text's ids go everywhere
        if chains.held > FLUSH_BYTES:
            yield from ((f, tuple(link)) for f, link in chains.take())
    yield from ((f, tuple(link)) for f, link in chains.take())


def _met(records: Iterable) -> Iterator[tuple]:
    """``id, part, mask, rows`` of what was routed to one partition."""
    chains = Chains()
    for fingerprint, (raw, *rest) in records:
        if raw is None:
            yield rest[0]
        else:
            yield from chains.put(fingerprint, raw, *rest)
    for _, (_, id_, parts, mask) in chains.take():
        for part, n in parts.items():
            yield id_, part, mask, n


def document_masks(docs: DataFrame) -> DataFrame:
    """``doc_id, part, mask, n``: rows of each document that fail the filters of ``mask``; documents with bit 4 are the
    non-minimum ids of their text."""
    d = only(docs, "doc_id", "text", "lang")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = d.agg(F.sum(F.octet_length(text))).first()[0] or 0
    rows: RDD = d.select(F.xxhash64(text), text, F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit(""))).rdd.map(tuple)
    parts = max(-(-size // ROUTED_BYTES), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = rows.mapPartitions(_settled).partitionBy(parts, int).mapPartitions(_met)
    return docs.sparkSession.createDataFrame(met, "doc_id long, part string, mask int, n long").groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))


def label_flags(labels: DataFrame) -> DataFrame:
    """``doc_id, good, toxic``: 1 where any label of the document says so."""
    said = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(c)
    return only(labels, "doc_id", "quality", "toxic").where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(said("quality"), said("toxic"))


def mask_counts(masks: DataFrame, labels: DataFrame) -> RDD:
    """``part, vector``: rows, good rows and toxic rows (3 by 32) by mask of failed filters."""
    labelled = masks.join(label_flags(labels), "doc_id", "left").select("part", "mask", "n", F.coalesce("quality", F.lit(0)), F.coalesce("toxic", F.lit(0)))

    def add(v: np.ndarray, row: tuple) -> np.ndarray:
        mask, n, good, toxic = row
        v[:, mask] += np.array([n, n * good, n * toxic])
        return v

    return labelled.rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(lambda row: add(np.zeros((3, 1 << len(FILTERS)), np.int64), row), add, lambda a, b: a + b)


def order_rows(part: str, v: np.ndarray) -> list[tuple]:
    """The audit's rows of a part: each order of the filters, each step."""
    masks = np.arange(1 << len(FILTERS))
    fails = {f: masks >> k & 1 == 1 for k, f in enumerate(FILTERS)}
    removed = dict.fromkeys(FILTERS, 0)
    out = []
    for order in permutations(FILTERS):
        alive = np.ones(len(masks), bool)
        for step, f in enumerate(order, 1):
            here, before = alive & fails[f], ~alive & fails[f]
            alive = alive & ~fails[f]
            n, good, toxic = (int(x) for x in v[:, here].sum(1))
            removed[f] += n
            out.append((part, "".join(order), step, int(v[0, alive].sum()), n, int(v[0, before].sum()), int(v[0, 1 << FILTERS.index(f)]), good, toxic))
    return [(*r, removed[r[1][r[2] - 1]]) for r in out]


AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part (the language, an empty string for null), order of the filters and step."""
    return docs.sparkSession.createDataFrame(mask_counts(document_masks(docs), labels).flatMap(lambda x: order_rows(*x)), AUDIT)

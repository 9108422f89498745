"""Helpers that the operators share: stored tables, words as numpy arrays, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE_SPLIT = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or the one that the session was given. Without either there is an error, as a
    local folder would be a different one on each executor; in local mode, on one machine, the warehouse serves."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found is None and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return found or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"


def stored(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends here, and any executor can read it again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Removes stored tables that nothing reads any more. What was made from them must be stored itself."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            if path.getName().startswith("table-"):
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def for_join(table: DataFrame, most: int = 2_000_000) -> DataFrame:
    """A stored table of few narrow columns, to be broadcast if it has at most ``most`` rows (some 50 MB); beyond that
    Spark shuffles both sides."""
    return F.broadcast(table) if table.count() <= most else table


def lower_ascii(text: Column) -> Column:
    """A to Z in lower case and nothing else; the fast path takes texts of one byte a character."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def space_words(text: Column) -> Column:
    """The words between white space; an empty array for null."""
    return F.coalesce(F.array_remove(F.split(text, SPACE_SPLIT), ""), F.array().cast("array<string>"))


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns, with nulls where one is missing; extra columns play no part."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).alias(c) for c in columns])


def one_row_each(rows: DataFrame, key: str) -> DataFrame:
    """Of rows with equal ``key`` the greatest alone, so that rows chosen by a bounded set of keys are bounded too."""
    rest = [c for c in rows.columns if c != key]
    one = rows.groupBy(key).agg(F.max(F.struct(*rest)).alias("_r"))
    return one.select(key, *[F.col("_r")[c].alias(c) for c in rest])


# ---- words as arrays -----------------------------------------------------------------------------------------

_BYTE = np.arange(256)
WHITE = (_BYTE == 32) | ((_BYTE >= 9) & (_BYTE <= 13))
LOWERED = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
_RNG = np.random.default_rng(20240501)
BYTE_KEY = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = 2 << 20, rows: int = 4000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``first row, row after the last, bytes, offsets``: whole texts, about ``limit`` bytes and at most ``rows`` texts at a
    time; null is empty. A text longer than the limit comes alone."""
    a = pc.fill_null(pc.cast(batch.column(column), pa.large_string()), "")
    n = len(a)
    offs = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = a.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n, lo + rows)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words_of(data: np.ndarray, offs: np.ndarray, space: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``starts, ends, first``: byte spans of the words of all texts; text k has words first[k] to first[k + 1]."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = ~space[data]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    at = offs[:-1][offs[:-1] < len(data)]
    start[at] = word[at]
    last = offs[1:][offs[1:] > 0] - 1
    end[last] = word[last]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    place = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=place[1:])
    inside = np.arange(place[-1]) - np.repeat(place[:-1], lens)
    powers = np.full(int(lens.max()), _ODD, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    value = BYTE_KEY[data[np.repeat(starts, lens) + inside]] * powers[inside]
    return mix(np.add.reduceat(value, place[:-1]) + lens.astype(np.uint64))


# ---- connected components ------------------------------------------------------------------------------------

LEAST_HEAVY, MOST_HEAVY = 1000, 100_000


def meet(rows: DataFrame, table: DataFrame, key: str, n: str, how: str = "inner") -> DataFrame:
    """``rows`` joined (``inner``) with the stored ``table``, or those it lacks (``left_anti``). The table has a row a key, with
    the number ``n`` of rows that the key has. Keys with more rows than a 100,000th of all (and than 1,000) are not shuffled
    but broadcast: there are 100,000 at most, as their rows add up to no more than all rows."""
    total, most = table.agg(F.sum(n), F.max(n)).first()
    cut = max(LEAST_HEAVY, (total or 0) // MOST_HEAVY)
    if (most or 0) <= cut:  # no such key: a plain join does, and a smaller plan
        return rows.join(table, key) if how == "inner" else rows.join(table.select(key), key, "left_anti")
    heavy, light = F.broadcast(table.where(F.col(n) > cut)), table.where(F.col(n) <= cut)  # heavy: at most MOST_HEAVY rows
    rest = rows.join(heavy.select(key), key, "left_anti")
    if how == "left_anti":
        return rest.join(light.select(key), key, "left_anti")
    return rows.join(heavy, key).unionByName(rest.join(light, key))


def with_least(pairs: DataFrame) -> DataFrame:
    """The stored rows ``u, v`` with ``m``, the least ``v`` of their ``u``. Minima combine before the shuffle, and nodes with
    very many rows are not shuffled."""
    return meet(pairs, stored(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d"))), "u", "d").drop("d")


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """``node, component`` of each node that has an edge; the component is its least node. Alternates large-star
    and small-star steps (each node's neighbours are tied to its least neighbour), so the rounds follow the log of
    the longest path. A node with very many neighbours never comes into one task. Each round is stored. Nulls
    and loops are no edges. Raises if ``rounds`` do not suffice, rather than return a partial answer."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    e = stored(e)
    mark = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v")
        large = stored(large.distinct())
        tied = with_least(large)
        small = tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(tied.select("u", F.col("m").alias("v")))
        e = stored(small.where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        mark = now
    raise RuntimeError(f"components not settled in {rounds} rounds")


def gapless_rank(df: DataFrame, keys: list[str], order: list[Column], salt: Column, name: str = "rank") -> DataFrame:
    """Adds the row's place, from 0 without gaps, among rows with equal ``keys``. Rows are ranked within (keys, salt)
    and salts are laid end to end, so no task sorts all rows of a hot key; ``salt`` must be a function of the row."""
    from pyspark.sql import Window

    salted = df.withColumn("_salt", salt)
    sizes = salted.groupBy(*keys, "_salt").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    inner = Window.partitionBy(*keys, "_salt").orderBy(*order)
    placed = salted.withColumn("_rn", F.row_number().over(inner) - 1).join(offsets, [*keys, "_salt"])
    return placed.withColumn(name, (F.col("_rn") + F.col("_off")).cast("long")).drop("_rn", "_off", "_salt")

"""Writers. Text output is ordered by a distributed sort, so it may span several part files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlace.operators.tiles import numbered_parts
from pairlace.operators.weights import Distances

# Symbols by state code.
SYMBOLS = "ACGT-"
LINES, TEXT_BYTES = 1 << 15, 1 << 22  # lines in a value, bytes in a batch


def unique_path(spark, wanted: str) -> str:
    """``wanted``, or the first of ``wanted.1``, ``wanted.2`` ... that does not exist on its file system."""
    jvm = spark.sparkContext._jvm
    path, n = wanted, 0
    while True:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return path
        n += 1
        path = f"{wanted}.{n}"


def couplings_name(alignment_id: str, size: int, base: int, n_edges: int, outliers: bool = False) -> str:
    return f"{alignment_id}.{size}.couplings.{base}-based.{n_edges}edges" + (".outliers" if outliers else "")


def couplings_lines(couplings: DataFrame) -> DataFrame:
    """``value``: pos1 pos2 distance flag MI, strongest first."""
    return couplings.orderBy(F.desc("mi"), "pos1", "pos2").select(
        F.concat_ws(" ", "pos1", "pos2", "distance", F.col("direct").cast("int"), F.format_string("%.6f", "mi")).alias("value")
    )


def outliers_lines(outliers: DataFrame) -> DataFrame:
    """``value``: the couplings fields, MI without gaps, gap effect and the extreme flag."""
    return outliers.orderBy(F.desc("mi"), "pos1", "pos2").select(
        F.concat_ws(
            " ", "pos1", "pos2", "distance", F.col("direct").cast("int"), F.format_string("%.6f", "mi"),
            F.format_string("%.6f", "mi_wo_gaps"), F.format_string("%.1f", "gap_effect"), F.col("extreme").cast("int"),
        ).alias("value")
    )


def alignment_lines(cells: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """``sample, value``: a FASTA record for each sample. One sample's symbols come together, no more."""
    symbol = F.substring(F.lit(SYMBOLS), F.col("state") + 1, 1)
    rows = cells.groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("pos", symbol.alias("c")))).alias("cells"))
    text = rows.select("sample", F.array_join(F.transform("cells", lambda x: x["c"]), "").alias("sequence"))
    if names is None:
        return text.select("sample", F.concat(F.lit(">"), F.col("sample").cast("string"), F.lit("\n"), "sequence").alias("value"))
    return text.join(names.select("sample", "name"), "sample").select("sample", F.concat(F.lit(">"), "name", F.lit("\n"), "sequence").alias("value"))


def write_lines(lines: DataFrame, path: str) -> str:
    """Writes the column ``value`` to a new folder; the name is made unique first."""
    to = unique_path(lines.sparkSession, path)
    lines.select("value").write.mode("errorifexists").text(to)
    return to


def write_alignment(cells: DataFrame, path: str, names: DataFrame | None = None) -> str:
    return write_lines(alignment_lines(cells, names).orderBy("sample"), path)


def write_weights(weights: DataFrame, path: str) -> str:
    return write_lines(weights.orderBy("sample").select(F.col("weight").cast("string").alias("value")), path)


def write_frequencies(profile: DataFrame, path: str) -> str:
    return write_lines(profile.orderBy("pos", "state").select(F.concat_ws(" ", "pos", "state", "n", F.format_string("%.6f", "freq")).alias("value")), path)


def _digits(v: np.ndarray) -> np.ndarray:
    """Numbers in decimals, a row of bytes each, filled up with zero bytes."""
    return v.astype("S").view(np.uint8).reshape(len(v), -1)


def _closed(text: np.ndarray) -> bytes:
    return text.tobytes().translate(None, b"\0")


def _texts(rows: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """``s, part, value``, some megabytes at once."""
    held, size = [], 0

    def told():
        s, part, value = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(part, pa.int64()), pa.array(value, pa.string())], names=["s", "part", "value"])

    for row in rows:
        held.append(row)
        size += len(row[2])
        if size > TEXT_BYTES:
            yield told()
            held, size = [], 0
    if held:
        yield told()


def _pair_lines(s: np.ndarray, t: np.ndarray, n: np.ndarray, differ: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A line a pair s < t; lines of one s, and of so many t, in one value."""
    whole, numbers = (n > 0).all(), _digits(np.arange(int(differ.max(initial=0)) + 1))
    differ = differ if differ.dtype.kind in "ui" else differ.astype(np.int64)
    other = _digits(t)
    wide, far = other.shape[1], numbers.shape[1]

    def rows():
        for k, one in enumerate(s):
            own = _digits(s[k : k + 1])
            head = own.shape[1]
            for lo in range(int(np.searchsorted(t, one, "right")), len(t), LINES):
                at = slice(lo, lo + LINES)
                if not whole:
                    at = np.flatnonzero(n[k, at]) + lo
                line = np.full((len(t[at]), head + wide + far + 3), ord(" "), np.uint8)
                line[:, :head], line[:, head + 1 : head + 1 + wide] = own, other[at]
                line[:, head + wide + 2 : -1], line[:, -1] = numbers[differ[k, at]], ord("\n")
                if len(line):
                    yield int(one), int(t[at][0]), _closed(line)[:-1]

    yield from _texts(rows())


def _matrix_lines(s: np.ndarray, t: np.ndarray, n: np.ndarray, differ: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A sample's distances to ``t``, in order."""
    whole, numbers = (n > 0).all(), _digits(np.arange(int(differ.max(initial=0)) + 1))
    differ = differ if differ.dtype.kind in "ui" else differ.astype(np.int64)
    numbers = np.pad(numbers, ((0, 0), (0, 1)), constant_values=ord(" "))

    def rows():
        for k, one in enumerate(s):
            mine = differ[k] if whole else differ[k][n[k] > 0]
            if len(mine):
                yield int(one), int(t[0]), _closed(numbers[mine])[:-1]

    yield from _texts(rows())


ROWS = "s long, part long, value string"


def distance_lines(distances: Distances) -> DataFrame:
    """``value``: lines ``s t distance`` of pairs s < t, several in a value, in order. Where a task can't hold all samples, the text of tiles is sorted."""
    if distances.ordered():
        return distances.in_order(_pair_lines, ROWS).select("value")
    tiles = distances.in_tiles(_pair_lines, ROWS)
    n = max(1, -(-distances.packed.n_loci // distances.packed.block))
    step = max(1, n // (4 * tiles.sparkSession.sparkContext.defaultParallelism))
    blocks = tiles.withColumn("_to", F.floor(F.col("blk") / step).cast("int"))
    return numbered_parts(blocks, (n - 1) // step + 1, "_to").sortWithinPartitions("s", "part").select("value")


def write_distances(distances: Distances, path: str, compression: str = "none") -> str:
    """A line a pair, in order. ``compression`` is that of the files, which readers of text tell by their names; ``gzip`` at its fastest."""
    to = unique_path(distances.packed.loci.sparkSession, path)
    distance_lines(distances).write.mode("errorifexists").options(**{"compression": compression, "zlib.compress.level": "BEST_SPEED"}).text(to)
    return to


def distance_matrix_lines(distances: Distances) -> DataFrame:
    """``sample, value``: the square form, a line of distances for each sample in order of the other; ``distances`` with ``square``. Where a
    task can't hold all samples, one line's stretches come together, no more."""
    if distances.ordered():
        return distances.in_order(_matrix_lines, ROWS).select(F.col("s").alias("sample"), "value")
    parts = distances.in_tiles(_matrix_lines, ROWS).select("s", F.struct("part", "value").alias("p"))
    line = parts.groupBy("s").agg(F.array_sort(F.collect_list("p")).alias("l"))
    return line.select(F.col("s").alias("sample"), F.array_join("l.value", " ").alias("value"))

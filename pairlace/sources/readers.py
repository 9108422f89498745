"""Readers: FASTA alignments, white-space lists and edge lists. None of them infers a schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlace.functions.scalars import symbol_state
from pairlace.operators.alignment import RaggedAlignmentError


class EmptyAlignmentError(ValueError):
    """The input holds no sequence."""


def _lines(spark: SparkSession, paths: str | list[str], **options) -> DataFrame:
    """``value`` of each record with where it stands: the path's place in the list, the file, the split and the row. Spark
    reads files in an order of its own, so the row number alone says nothing across splits."""
    parts = []
    for k, path in enumerate([paths] if isinstance(paths, str) else paths):
        read = spark.read.text(path, **options)
        parts.append(read.select("value", F.lit(k).alias("_src"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_blk")))
    return reduce(DataFrame.unionByName, parts)


SPLIT = ["_src", "_file", "_blk"]


def _numbered(rows: DataFrame, name: str, size: Column | None = None) -> DataFrame:
    """Adds each row's place, from 0 in file order, where a row takes ``size`` places (one if None). Rows are counted within
    their split; splits are laid end to end by a window over one row a split."""
    tagged = rows.withColumn("_m", F.monotonically_increasing_id()).withColumn("_size", F.lit(1) if size is None else size)
    sizes = tagged.groupBy(*SPLIT).agg(F.sum("_size").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy(*SPLIT).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.coalesce(F.sum("_size").over(Window.partitionBy(*SPLIT).orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = tagged.withColumn("_in", inside).join(starts, SPLIT)
    return placed.withColumn(name, (F.col("_off") + F.col("_in")).cast("long")).drop(*SPLIT, "_m", "_size", "_off", "_in")


def read_sequences(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``sample long, name string, sequence string``. Wrapped lines, CRLF and blank lines are allowed; samples are
    numbered from 0 in the order of the list and of each file. Raises EmptyAlignmentError if there is no sequence."""
    records = _lines(spark, path, lineSep="\n>").where(F.length(F.trim("value")) > 0)
    record = F.regexp_replace("value", r"^\s*>", "")
    out = records.withColumns({
        "name": F.trim(F.regexp_replace(F.regexp_extract(record, r"^[^\n]*", 0), "\r", "")),
        "sequence": F.regexp_replace(F.regexp_replace(record, r"^[^\n]*", ""), r"\s", ""),
    }).where(F.length("sequence") > 0)
    if out.isEmpty():
        raise EmptyAlignmentError(f"no sequence in {path}")
    return _numbered(out, "sample").select("sample", "name", "sequence")


def cells_of(sequences: DataFrame) -> DataFrame:
    """``sample, pos int (from 0), state tinyint``, one row for each symbol."""
    return sequences.select("sample", F.posexplode(F.split("sequence", "(?<=.)(?=.)")).alias("pos", "symbol")).select(
        "sample", "pos", symbol_state(F.col("symbol")).alias("state")
    )


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The cells of an alignment. Raises RaggedAlignmentError where sequences differ in length."""
    rows = read_sequences(spark, path)
    short, long = rows.select(F.struct(F.length("sequence").alias("n"), "name").alias("r")).agg(F.min("r"), F.max("r")).first()
    if short.n != long.n:
        raise RaggedAlignmentError(f"sequence {short.name!r} has {short.n} symbols and {long.name!r} has {long.n}")
    return cells_of(rows)


def _words(spark: SparkSession, path: str) -> DataFrame:
    """``idx, word``: the words of a white-space list and their places in it, whatever the line breaks."""
    lines = _lines(spark, path).withColumn("words", F.filter(F.split("value", r"\s+"), lambda x: x != "")).where("size(words) > 0")
    numbered = _numbered(lines, "_at", F.size("words"))
    return numbered.select("_at", F.posexplode("words").alias("_k", "word")).select((F.col("_at") + F.col("_k")).alias("idx"), "word")


def read_loci_list(spark: SparkSession, path: str, base: int = 1, name: str = "pos") -> DataFrame:
    """Distinct integers of a white-space list, shifted to base 0. For include, exclude and sample lists."""
    return _words(spark, path).select((F.col("word").cast("int") - base).alias(name)).distinct()


def read_indexed_list(spark: SparkSession, path: str, index: str, value: str, kind: str = "double", expected: int | None = None) -> DataFrame:
    """A white-space list with the place of each value: sample weights, or the position of each column. Raises
    ValueError if ``expected`` is given and the list has another length."""
    out = _words(spark, path).select(F.col("idx").alias(index), F.col("word").cast(kind).alias(value))
    if expected is not None and (n := out.count()) != expected:
        raise ValueError(f"{path} holds {n} values; {expected} are needed")
    return out


def read_edges(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``i, j, mi`` of one network kept in one or several space-separated files."""
    return spark.read.csv(paths, sep=" ", schema="i long, j long, mi double")


def read_couplings(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The couplings file: space separated, no header."""
    return spark.read.csv(path, sep=" ", schema="pos1 long, pos2 long, distance long, direct int, mi double")

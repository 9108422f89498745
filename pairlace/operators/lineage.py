"""Cutting lineage where a frame is read several times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation


def shared_copy(df: DataFrame) -> DataFrame:
    """A copy in the shared checkpoint folder, so a lost executor costs nothing already computed. The folder is that
    of spark.checkpoint.dir, or the one that the session was given; a local folder of our own would be a different one on each
    executor, so without either there is an error. In local mode, where there is one machine, Spark's own warehouse serves."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def counted_copy(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict]:
    """A shared copy, with aggregates of its rows that are taken as they are written: no further job reads them."""
    seen = Observation()
    out = shared_copy(df.observe(seen, *[c.alias(name) for name, c in counts.items()]))
    return out, seen.get

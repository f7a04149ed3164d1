"""Incremental ingest: documents that are new, put through the batch stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def first_versions(stream: DataFrame, key: str, order: list[str] = ()) -> DataFrame:
    """Of a stream of rows, the first version of each key: that of the earliest batch, in it the least by ``order``
    and then by all columns, so no version is picked by chance.

    State is kept by key: the batch in which it came first and the version it had.  A key is given out with
    every batch that has rows of it; ``__new`` tells whether that batch is its first.  Keys combine
    map-side, so a key with many rows is one row a task.  Rows with a null key are one key.
    """
    rest = [c for c in stream.columns if c != key and c not in order]
    version = F.struct("__batch", *order, *rest)
    best = stream.withColumn("__batch", F.current_timestamp()).groupBy(key).agg(F.min(version).alias("v"), F.max("__batch").alias("now"))
    return best.select((F.col("v.__batch") == F.col("now")).alias("__new"), *[F.col(c) if c == key else F.col(f"v.`{c}`").alias(c) for c in stream.columns])


def ingest(spark: SparkSession, source: str, schema, target: str, checkpoint: str, key: str, stages: list[Callable[[DataFrame], DataFrame]] = (), format: str = "json", order: list[str] = (), known: DataFrame | None = None):
    """A query over files that arrive in ``source``: new documents pass the stages and go to ``target``.

    What was seen is kept as state by key, so a batch costs what it holds; the target is never read.  Each
    batch has a folder of its own, ``batch=<number>``, which is written whole: a batch that runs again after a
    failure replaces what it left.  The stages are those of the batch build, so both give the same rows.
    ``known`` has keys that the target got in another way.  ``trigger(availableNow)`` takes what is there and ends.
    """

    def batch(rows: DataFrame, number: int) -> None:
        out = rows.where("__new").drop("__new")
        if known is not None:
            out = out.join(known.select(key).distinct(), key, "left_anti")
        for stage in stages:
            out = stage(out)
        out.write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch={number}")

    stream = first_versions(spark.readStream.format(format).schema(schema).load(source), key, list(order))
    return stream.writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested(spark: SparkSession, target: str) -> DataFrame:
    """All rows of a target, without the number of the batch that brought them."""
    return spark.read.parquet(target).drop("batch")

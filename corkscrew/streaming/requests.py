"""Requests arriving as files, answered as they arrive (Structured Streaming).

This replaces the single-machine HTTP endpoint: each micro-batch of
request files is joined to the (persisted) neighbour index with the same
plan as the batch ``recommend``. Output is written per batch id
(``batch_id=<n>`` folders, overwritten on replay), so a restart after a
failure re-answers the unfinished batch without duplicating rows; the
checkpoint folder records which files were already consumed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import fixed
from ..operators.recommend import Recommender, recommend

REQUEST_SCHEMA = "request_id bigint, features string, color string"


def answer_batch(rec: Recommender, colors: DataFrame, sink_dir: str, k: int, unknown: str, fallback: bool):
    """foreachBatch body: recommend for one micro-batch and write it under its batch id."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # counted and searched: read once
        try:
            ans = recommend(rec, batch, colors, k, unknown, fallback)
            ans.write.mode("overwrite").parquet(f"{sink_dir}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return run


def stream_recommend(
    spark: SparkSession,
    rec: Recommender,
    colors: DataFrame,
    source_dir: str,
    sink_dir: str,
    checkpoint_dir: str,
    fmt: str = "parquet",
    k: int = fixed.KNN_QUERY_K,
    unknown: str = "pass",
    fallback: bool = True,
    max_files_per_trigger: int | None = None,
    available_now: bool = True,
):
    """Start the stream; with ``available_now`` it drains the folder and stops."""
    reader = spark.readStream.schema(REQUEST_SCHEMA).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(source_dir)
    writer = (
        stream.writeStream.foreachBatch(answer_batch(rec, colors, sink_dir, k, unknown, fallback))
        .option("checkpointLocation", checkpoint_dir)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    query = writer.start()
    if available_now:
        query.awaitTermination()
    return query


def read_answers(spark: SparkSession, sink_dir: str) -> DataFrame:
    """All answers written so far (the batch id is kept as a column)."""
    return spark.read.parquet(sink_dir)

"""Feedback as streams: skips that are kept once, and counts of artists per listener (STM-1, STM-2, STM-4).

Streams read a folder of Parquet files and stop when they have read what is there
(``availableNow``); with the same checkpoint a later run goes on from there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.plans import standin
from cadenza.sources.sinks import new_keys
from cadenza.sources.work import base


def work_folder(spark: SparkSession) -> str:
    return f"{base(spark)}/cadenza-stream-{uuid.uuid4().hex}"


def upsert_keys(events: DataFrame, key: str, table: str, checkpoint: str) -> DataFrame:
    """Append each batch's new keys to a table; a batch that is run again adds nothing."""
    spark = events.sparkSession
    spark.createDataFrame([], f"{key} string").write.mode("append").parquet(table)

    def add(batch: DataFrame, number: int) -> None:
        known = spark.read.schema(f"{key} string").parquet(table)
        new_keys(known, batch.select(key), key).write.mode("append").parquet(table)

    events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(f"{key} string").parquet(table)


def count_artists(events: DataFrame, table: str, checkpoint: str) -> DataFrame:
    """user_id, artist, n over all batches: each batch adds its counts, keyed by its number.

    Counts are aggregated within a batch; reading sums the batches, and a batch that is run
    again replaces its own rows.
    """
    spark = events.sparkSession

    def add(batch: DataFrame, number: int) -> None:
        counts = batch.select("user_id", F.explode("artists").alias("artist")).groupBy("user_id", "artist").agg(F.count("*").alias("n"))
        counts.write.mode("overwrite").parquet(f"{table}/batch={number}")

    spark.createDataFrame([], "user_id bigint, artist string, n bigint").write.mode("overwrite").parquet(f"{table}/batch=-1")
    events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(table).groupBy("user_id", "artist").agg(F.sum("n").alias("n"))


def _events(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Events of a kind as a stream, with the uri of their track."""
    schema = standin.table(spark, sf_dir, "events").schema
    number = standin.table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0]
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(f"{sf_dir}/events.parquet")
    uri = F.concat(F.lit("library://track/"), (F.col("event_id") % ((number or 0) + 1)).cast("string"))
    return rows.where(F.col("event_type") == kind).withColumn("uri", uri)


def replay_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark)
    return upsert_keys(_events(spark, sf_dir, "error"), "uri", f"{folder}/skipped", f"{folder}/checkpoint")


def replay_artist_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark)
    clicks = _events(spark, sf_dir, "click").join(standin.tracks(spark, sf_dir).select("uri", "artists"), "uri")
    return count_artists(clicks, f"{folder}/counts", f"{folder}/checkpoint")

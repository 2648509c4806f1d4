"""Writers (SNK-*). Plain Parquet has no MERGE, so updates make a new snapshot of a table."""

from __future__ import annotations

import json
import urllib.request

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.vectors import format_vector


def insert_ignore(target: DataFrame, rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """``target`` and those rows whose key it lacks, the first of each key by ``order``.

    Without ``order`` rows with equal keys are taken as equal.
    """
    return target.unionByName(new_keys(target, rows, key, order).select(*target.columns))


def new_keys(target: DataFrame, rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """The rows that ``insert_ignore`` adds."""
    if order is None:
        once = rows.dropDuplicates([key])
    else:
        first = Window.partitionBy(key).orderBy(order)
        once = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return once.where(F.col(key).isNotNull()).join(target.select(key), key, "left_anti")


def keyed_update(target: DataFrame, updates: DataFrame, key: str, column: str, order: str | None = None) -> DataFrame:
    """``target`` with the column of matching updates, the last of each key by ``order``; unknown keys do nothing.

    An update to null sets null. Of updates that are equal in ``order``, or of all without
    one, the largest value counts, so that the result doesn't depend on the layout.
    """
    ranks = ["_order", "_set", "_value"] if order else ["_set", "_value"]
    rows = updates.where(F.col(key).isNotNull()).select(F.col(key), *([F.col(order).alias("_order")] if order else []), F.col(column).isNotNull().alias("_set"), F.col(column).cast(target.schema[column].dataType).alias("_value"))
    last = rows.groupBy(key).agg(F.max(F.struct(*ranks)).alias("_new"))
    merged = target.join(last, key, "left")
    return merged.withColumn(column, F.when(F.col("_new").isNotNull(), F.col("_new._value")).otherwise(F.col(column))).select(*target.columns)


def publish(df: DataFrame, path: str) -> DataFrame:
    """Write a snapshot to a folder of its own, so that the table that was read stays whole."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def update_statements(updates: DataFrame) -> DataFrame:
    """One UPDATE statement for each (uri, embedding), quotes escaped: an export for databases."""
    uri = F.regexp_replace("uri", "'", "''")
    return updates.select(F.concat(F.lit("UPDATE track SET embedding = '"), format_vector("embedding"), F.lit("'::vector WHERE uri = '"), uri, F.lit("';")).alias("value"))


def write_statements(updates: DataFrame, path: str) -> None:
    update_statements(updates).write.mode("overwrite").text(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def post_playlist(playlist: DataFrame, webhook: str | None) -> str:
    """Send the uris in order to a webhook: "skipped" without one, "sent", or an error raised.

    A playlist is a result of at most some hundred rows.
    """
    if not webhook:
        return "skipped"
    ids = [r.uri for r in playlist.orderBy("pos").select("uri").collect()]
    body = json.dumps({"media_ids": ids}).encode()
    request = urllib.request.Request(webhook, body, {"Content-Type": "application/json"}, method="POST")
    with urllib.request.urlopen(request, timeout=60) as response:
        if response.status >= 300:
            raise OSError(f"the webhook answered {response.status}")
    return "sent"

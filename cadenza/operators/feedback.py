"""Skipped and liked tracks (JN-1 to JN-3, JN-6, JN-8, SNK-2, SNK-3, FLT-11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.vectors import hash_uniform
from cadenza.sources.sinks import insert_ignore


def without_skipped_songs(tracks: DataFrame, skipped: DataFrame) -> DataFrame:
    return tracks.join(skipped.select("uri"), "uri", "left_anti")


def without_skipped_artists(tracks: DataFrame, skipped: DataFrame) -> DataFrame:
    """Tracks none of whose artists is skipped: equi-joins on exploded names, not a nested loop."""
    names = tracks.select("uri", F.explode("artists").alias("name")).where("name is not null")
    hit = names.join(skipped.select("name"), "name", "left_semi").select("uri").distinct()
    return tracks.join(hit, "uri", "left_anti")


def without_skipped(tracks: DataFrame, songs: DataFrame, artists: DataFrame) -> DataFrame:
    return without_skipped_artists(without_skipped_songs(tracks, songs), artists)


def liked_tracks(tracks: DataFrame, liked: DataFrame) -> DataFrame:
    """Liked tracks that have an embedding."""
    return tracks.where("embedding is not null").join(liked.select("uri"), "uri", "left_semi")


def soft_skip(rows: DataFrame, skipped: DataFrame, seed: int, share: float = 0.3) -> DataFrame:
    """Drops a row of a skipped artist with a chance of ``share``, drawn from uri and seed."""
    keep = without_skipped_artists(rows.select("uri", "artists").dropDuplicates(["uri"]), skipped).select("uri", F.lit(True).alias("_free"))
    drawn = hash_uniform(F.col("uri"), F.lit(seed)) < share
    return rows.join(keep, "uri", "left").where(F.coalesce("_free", ~drawn)).drop("_free")


def skip_track(skipped: DataFrame, uri: str) -> DataFrame:
    return insert_ignore(skipped, skipped.sparkSession.createDataFrame([(uri,)], "uri string"), "uri")


def skip_artists(skipped: DataFrame, names: list[str]) -> DataFrame:
    """``skipped`` with the names that it lacks; no names change nothing."""
    if not names:
        return skipped
    return insert_ignore(skipped, skipped.sparkSession.createDataFrame([(n,) for n in names], "name string"), "name")


def like_track(liked: DataFrame, uri: str) -> DataFrame:
    """An extension: likes are only read otherwise."""
    return skip_track(liked, uri)

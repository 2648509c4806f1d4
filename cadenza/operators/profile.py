"""Query vectors from seeds and liked tracks (section 2.8, steps 1 to 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.vectors import blend, centroid, l2norm
from cadenza.operators.feedback import liked_tracks
from cadenza.operators.similarity import random_track

ALPHA = 0.6


def query_vectors(tracks: DataFrame, requests: DataFrame, liked: DataFrame, alpha: float = ALPHA, seed: int = 0) -> DataFrame:
    """query, vector for each request (query, seeds: array of uris).

    Seeds and likes blend as alpha s + (1 - alpha) c, normalised; one alone is taken as it
    is; without any, a random embedded track. Seeds that are unknown or not embedded don't count.
    """
    seeds = requests.select("query", F.explode("seeds").alias("uri")).dropDuplicates().join(tracks.where("embedding is not null").select("uri", "embedding"), "uri")
    s = centroid(seeds, ["query"], "embedding", "s")
    c = centroid(liked_tracks(tracks, liked).withColumn("_all", F.lit(1)), ["_all"], "embedding", "c").drop("_all")
    r = random_track(tracks, seed).join(tracks, "uri").select(l2norm("embedding").alias("r"))
    # c and r are one row each at most.
    every = requests.select("query").distinct().join(s, "query", "left").join(F.broadcast(c), F.lit(True), "left").join(F.broadcast(r), F.lit(True), "left")
    mixed = F.when(F.col("s").isNotNull() & F.col("c").isNotNull(), l2norm(blend("s", "c", alpha)))
    return every.select("query", F.coalesce(mixed, "s", "c", "r").alias("vector"))

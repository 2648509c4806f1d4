"""The service's functions over tables in folders (CMP-8, CMP-10, SRV-1)."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import feedback, ingest, playlist, profile, rerank, similarity
from cadenza.sources import sinks, tables


class Engine:
    """Recommendations and feedback. Feedback tables are small key tables; each change is a new snapshot."""

    def __init__(self, spark: SparkSession, config: tables.Config, tracks: DataFrame, liked: DataFrame, skipped_songs: DataFrame, skipped_artists: DataFrame) -> None:
        self.spark, self.config, self.tracks, self.liked = spark, config, tracks, liked
        self.skipped_songs, self.skipped_artists = skipped_songs, skipped_artists
        self.next: DataFrame | None = None

    def status(self) -> dict:
        return {"status": "ok", "prepared": self.next is not None}

    def _snapshot(self, df: DataFrame, name: str) -> DataFrame:
        return sinks.publish(df, f"{self.config.tables.rstrip('/')}/{name}-{uuid.uuid4().hex}")

    def recommend(self, seeds: list[str] = [], limit: int = 30, ann_pool: int | None = None, weight: float = 0.7, exclude: list[str] = [], alpha: float = profile.ALPHA, floor: float = similarity.CANDIDATE_FLOOR, selection: rerank.Selection = rerank.Selection()) -> DataFrame:
        """pos, uri, name, artists, album, similarity: empty without any embedded track."""
        request = self.spark.createDataFrame([("request", seeds)], "query string, seeds array<string>")
        queries = profile.query_vectors(self.tracks, request, self.liked, alpha, selection.seed)
        pool = similarity.candidates(self.tracks, queries, self.skipped_songs, self.skipped_artists, similarity.pool_size(limit, ann_pool), exclude, floor=floor, seed=selection.seed)
        return rerank.rerank(pool, queries, replace(selection, limit=limit, weight=weight)).select("pos", "uri", "name", "artists", "album", "similarity")

    def find_similar_tracks(self, uri: str, floor: float = similarity.FLOOR, seed: int = 0) -> DataFrame:
        similarity.seed(self.tracks, uri)
        asked = self.spark.createDataFrame([(uri,)], "query string")
        return playlist.similar_tracks(self.tracks, asked, self.skipped_songs, self.skipped_artists, floor, seed).select("pos", "uri")

    def skip_track(self, uri: str) -> None:
        self.skipped_songs = self._snapshot(feedback.skip_track(self.skipped_songs, uri), "skipped_songs")

    def skip_artists(self, names: list[str]) -> None:
        if names:
            self.skipped_artists = self._snapshot(feedback.skip_artists(self.skipped_artists, names), "skipped_artists")

    def like_track(self, uri: str) -> None:
        self.liked = self._snapshot(feedback.like_track(self.liked, uri), "liked_songs")

    def now_playing(self, queue: DataFrame) -> DataFrame:
        return ingest.current_item(queue)

    def skip_current(self, queue: DataFrame) -> str:
        """Skip the current track and its artists; "not found" if nothing plays."""
        item = self.now_playing(queue).first()
        if item is None:
            return "not found"
        self.skip_track(item.uri)
        self.skip_artists([a for a in item.artists or [] if a])
        return "skipped"

    def prepare_next(self, **options) -> None:
        self.next = self._snapshot(self.recommend(**options), "next")

    def play_prepared(self, **options) -> DataFrame:
        """Send the prepared playlist, which is made now if there is none; gives it back."""
        if self.next is None:
            self.prepare_next(**options)
        sinks.post_playlist(self.next, self.config.webhook)
        return self.next

    def play_next(self, **options) -> DataFrame:
        """Send the prepared playlist and prepare another; gives back the one that is played."""
        playing = self.play_prepared(**options)
        self.prepare_next(**options)
        return playing

    def coverage(self) -> dict:
        row = ingest.coverage(self.tracks)[2].first()
        return {"completed": row.completed, "missing": row.missing}

    def lengths(self) -> DataFrame:
        """Vector lengths in use: more than one means that embedders were mixed."""
        return self.tracks.where("embedding is not null").groupBy(F.size("embedding").alias("dimension")).agg(F.count("*").alias("n"))

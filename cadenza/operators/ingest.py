"""From a library's response to tracks, files and embeddings (CMP-10 to CMP-15, JN-9, JN-10, UDF-1)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.names import ARTISTS
from cadenza.functions.text import AUDIO, basename, dictionary_names, extension, sanitize, stem, unnumbered
from cadenza.sources.sinks import keyed_update
from cadenza.sources.tables import list_media


def flatten(library: DataFrame) -> DataFrame:
    """uri, name, credit (artist names joined by ", "), album of each track of a response (PRJ-5)."""
    track = library.select(F.explode("service_response.tracks").alias("t"))
    return track.select("t.uri", "t.name", F.array_join(F.transform("t.artists", lambda a: a["name"]), ", ").alias("credit"), F.col("t.album.name").alias("album"))


def tracks_of(library: DataFrame, names: list[str] = ARTISTS, match: str = "substring") -> DataFrame:
    """New track rows without embeddings; artists are the dictionary's names in the credit."""
    flat = flatten(library)
    return flat.select("uri", "name", dictionary_names(F.col("credit"), names, match).alias("artists"), "album", F.lit(None).cast("array<float>").alias("embedding"))


def coverage(tracks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tracks without and with an embedding, and how many of each (CMP-12)."""
    columns = ["uri", "name", "artists", "album"]
    counts = tracks.agg(F.count_if(F.col("embedding").isNull()).alias("missing"), F.count_if(F.col("embedding").isNotNull()).alias("completed"))
    return tracks.where("embedding is null").select(*columns), tracks.where("embedding is not null").select(*columns), counts


def current_item(queue: DataFrame, *keys: str) -> DataFrame:
    """uri, name, album, artists of the first active player's media item, in the response's order (FLT-12).

    ``keys`` names columns of ``queue`` that the result has too.
    """
    players = F.transform(F.map_entries("service_response"), lambda p: p["value"])
    playing = F.filter(players, lambda p: p["active"] & p["current_item"]["media_item"].isNotNull())
    item = queue.select(*keys, F.get(playing, F.lit(0))["current_item"]["media_item"].alias("m")).where("m is not null")
    return item.select(*keys, "m.uri", "m.name", F.col("m.album.name").alias("album"), F.transform("m.artists", lambda a: a["name"]).alias("artists"))


def match_media(tracks: DataFrame, listing: DataFrame) -> DataFrame:
    """uri, key: each track's audio file in a listing of keys (JN-9).

    The file's name is the track's, or two digits, a dash and the track's, in any case. It
    stands below ``artist/album/``, or anywhere below ``artist/`` for a track without an
    album. The first artist with a hit counts, and the first key of it in order.
    """
    named = tracks.select("uri", F.lower(sanitize(F.col("name"))).alias("title"), sanitize(F.col("album")).alias("album"), F.posexplode(F.filter(F.transform("artists", sanitize), lambda a: a != "")).alias("ord", "artist")).where("title <> ''")
    files = listing.select("key", F.split("key", "/").alias("parts"), stem(F.col("key")).alias("stem")).where(extension(F.col("key")).isin(*AUDIO) & (F.size("parts") > 1))
    titles = F.filter(F.array_distinct(F.array(F.lower("stem"), F.lower(unnumbered(F.col("stem"))))), lambda t: t != "")
    titled = files.select("key", "parts", F.explode(titles).alias("title")).withColumn("artist", F.col("parts")[0])
    # One key per folder below the artist, and one for the artist alone, when the album is empty.
    below = titled.withColumn("album", F.when(F.size("parts") > 2, F.col("parts")[1])).where("album is not null and album <> ''").select("key", "title", "artist", "album")
    hit = named.where("album <> ''").join(below, ["artist", "album", "title"]).select("uri", "ord", "key")
    loose = named.where("album = ''").join(titled.select("key", "title", "artist"), ["artist", "title"]).select("uri", "ord", "key")
    return _first(hit.union(loose))


def match_media_exact(tracks: DataFrame, listing: DataFrame) -> DataFrame:
    """The same with exact paths ``artist/album/name.mp3`` only (JN-10)."""
    path = F.concat_ws("/", F.col("artist"), sanitize(F.col("album")), F.concat(sanitize(F.col("name")), F.lit(".mp3")))
    wanted = tracks.select("uri", "name", "album", F.posexplode(F.transform("artists", sanitize)).alias("ord", "artist")).select("uri", "ord", path.alias("key"))
    return _first(wanted.join(listing.select("key"), "key").select("uri", "ord", "key"))


def _first(hits: DataFrame) -> DataFrame:
    return hits.groupBy("uri").agg(F.min(F.struct("ord", "key"))["key"].alias("key"))


def to_embed(work: DataFrame, done: DataFrame) -> DataFrame:
    """Tracks of a work list whose uri has no stored embedding (FLT-13)."""
    return work.join(done.where("embedding is not null and size(embedding) > 0").select("uri"), "uri", "left_anti")


def stub_frames(content: bytes, dimension: int) -> np.ndarray | None:
    """Stand-in for an audio model: frames of ``dimension`` numbers from the bytes, None without bytes."""
    if not content:
        return None
    digests = [hashlib.sha256(content[i : i + 4096]).digest() for i in range(0, len(content), 4096)]
    return np.stack([np.resize(np.frombuffer(d, np.uint8).astype(np.float64) / 255, dimension) for d in digests])


def embed(files: DataFrame, dimension: int = 512, model: Callable[[bytes, int], np.ndarray | None] = stub_frames) -> DataFrame:
    """uri, embedding for rows with uri and content: the mean of the model's frames (UDF-1, AGG-4).

    The model is loaded with the function, once for a worker. Empty content, no frames and
    NaN means give no row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = []
            for uri, content in zip(rows["uri"], rows["content"]):
                frames = model(bytes(content), dimension) if content is not None else None
                if frames is not None and len(frames):
                    mean = frames.mean(axis=0)
                    if not np.isnan(mean).any():
                        found.append((uri, mean.astype(np.float32)))
            yield pd.DataFrame(found, columns=["uri", "embedding"])

    return files.select("uri", "content").mapInPandas(run, "uri string, embedding array<float>")


def embed_missing(tracks: DataFrame, listing: DataFrame, files: DataFrame, done: DataFrame, dimension: int = 512, model: Callable = stub_frames, match: Callable = match_media) -> DataFrame:
    """Embeddings of tracks that lack one and whose file is found, without those stored (CMP-13).

    ``files`` has key and content; only matched files are read into the model.
    """
    work = to_embed(tracks.where("embedding is null").select("uri", "name", "artists", "album"), done)
    found = match(work, listing).join(files.select("key", "content"), "key")
    return embed(found, dimension, model)


def shuffled(work: DataFrame, seed: int) -> DataFrame:
    """A work list in random order (TOP-8): dealt to tasks at random, and each task's rows in order of a hash.

    Spark has no order between tasks, so that's what a shuffle of the list is for: every
    part of it is taken up at once and runs that stop early leave no region untouched.
    """
    order = F.xxhash64("uri", F.lit(seed))
    return work.repartition(order).sortWithinPartitions(order)


def store_embeddings(tracks: DataFrame, listing: DataFrame, files: DataFrame, store: str, dimension: int = 512, model: Callable = stub_frames, rounds: int = 8, seed: int = 0) -> DataFrame:
    """uri, embedding: the key-value table in ``store`` after all missing embeddings were put there (SNK-8).

    The work list goes in ``rounds`` parts by a hash of the uri; each part is appended as
    soon as it is made, and what the table has already isn't made again. So a job that
    broke goes on where it was, at the cost of one part at most.
    """
    spark, kind = tracks.sparkSession, "uri string, embedding array<float>"
    spark.createDataFrame([], kind).write.mode("append").parquet(store)
    for turn in range(rounds):
        part = tracks.where(F.pmod(F.xxhash64("uri", F.lit(seed)), F.lit(rounds)) == turn)
        done = spark.read.schema(kind).parquet(store)
        embed_missing(shuffled(part, seed), listing, files, done, dimension, model).write.mode("append").parquet(store)
    return spark.read.schema(kind).parquet(store)


def embed_local(tracks: DataFrame, folder: str, dimension: int = 256, model: Callable = stub_frames) -> DataFrame:
    """``tracks`` with the embeddings of those that lacked one and have a file in ``folder`` (CMP-14).

    Files are matched by their exact path; the keyed update gives one new snapshot, so
    either all of the embeddings are there or none. Tracks without a file, or whose file
    gives no embedding, stay as they are.
    """
    files = list_media(tracks.sparkSession, folder, content=True)
    none = tracks.sparkSession.createDataFrame([], "uri string, embedding array<float>")
    made = embed_missing(tracks, files.select("key"), files, none, dimension, model, match_media_exact)
    return keyed_update(tracks, made, "uri", "embedding")


def frame_mean(frames: DataFrame, key: str = "uri", column: str = "frames") -> DataFrame:
    """Mean vector of an array of frames, by built-in functions; NaN or no frames give no row."""
    each = frames.select(key, F.explode(column).alias("f")).select(key, F.posexplode("f").alias("i", "x"))
    means = each.groupBy(key, "i").agg(F.avg("x").alias("x"))
    packed = means.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("p")).select(key, F.col("p.x").alias("embedding"))
    return packed.where(~F.exists("embedding", F.isnan))

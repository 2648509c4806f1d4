"""Cosine top-k searches (CMP-1 to CMP-6, CMP-9, JN-5, TOP-*).

A track table has uri, name, artists, album, embedding. Results are ordered by
similarity, then uri. Tracks and queries without an embedding, or with a zero vector, are
in no result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.vectors import cosine, hash_number, hash_uniform, vector_mean
from cadenza.operators.feedback import without_skipped
from cadenza.session import ship

FLOOR, CANDIDATE_FLOOR, JITTER = 0.5, 0.55, 0.02
#: Queries held by a worker at once; more are taken in rounds. Rows that a task holds for them before it passes them on.
QUERY_BLOCK, HELD_ROWS = 4096, 1_000_000
#: Queries that array functions answer, broadcast without a further check.
FEW = 1024


def _bounds(sim: Column, floor: float | None, ceiling: float | None) -> Column:
    out = sim.isNotNull()
    out = out & (sim > floor) if floor is not None else out
    return out & (sim < ceiling) if ceiling is not None else out


def ranked(rows: DataFrame, keys: list[str], k: int, score: str = "similarity") -> DataFrame:
    """The first k of each group by score and uri, with their position from 1."""
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(score), "uri")
    return rows.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k)


def top_k_expressions(corpus: DataFrame, queries: DataFrame, k: int, floor: float | None = FLOOR, ceiling: float | None = None) -> DataFrame:
    """query, uri, similarity, pos by array functions alone: for a few queries, which are broadcast.

    ``queries`` has query and vector; more than ``FEW`` rows go to ``top_k``, with the same result.
    """
    if len(queries.where("vector is not null").limit(FEW + 1).collect()) > FEW:
        return top_k(corpus, queries, k, floor, ceiling)
    usable = corpus.where("embedding is not null").select("uri", F.col("embedding").cast("array<double>").alias("v"))
    sim = usable.crossJoin(F.broadcast(queries.where("vector is not null"))).select("query", "uri", cosine("v", "vector").alias("similarity"))
    return ranked(sim.where(_bounds(F.col("similarity"), floor, ceiling)), ["query"], k)


def top_k(corpus: DataFrame, queries: DataFrame, k: int, floor: float | None = FLOOR, ceiling: float | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """query, uri, similarity, pos by matrix products: queries are broadcast in blocks of ``block``.

    Every block is one pass over the corpus. A task keeps k rows for each query, so what is
    shuffled is k rows per query and task, never all pairs.
    """
    return ranked(_searched(corpus, queries, k, floor, ceiling, block).drop("score"), ["query"], k)


def _searched(corpus: DataFrame, queries: DataFrame, k: int, floor: float | None, ceiling: float | None, block: int, jitter: float = 0.0, seed: int = 0) -> DataFrame:
    """query, uri, similarity, score: rows among which the first k of each query by score are."""
    spark = corpus.sparkSession
    ship(spark)
    asked = queries.where("vector is not null").select("query", F.col("vector").cast("array<double>").alias("vector"))
    first = asked.limit(block + 1).collect()
    # Blocks are dealt by a hash, so that one has a few standard deviations more queries than ``block`` at most.
    turns = 1 if len(first) <= block else -(-asked.count() // block)
    usable = corpus.where("embedding is not null").select("uri", F.col("embedding").cast("array<double>").alias("v"))
    parts = []
    for turn in range(turns):
        mine = first if turns == 1 else asked.where(F.pmod(F.xxhash64("query"), F.lit(turns)) == turn).collect()
        held = spark.sparkContext.broadcast([(r.query, r.vector) for r in mine])
        parts.append(usable.mapInArrow(_search(held, k, floor, ceiling, jitter, seed), "query string, uri string, similarity double, score double"))
    return functools.reduce(DataFrame.union, parts)


def _search(held, k: int, floor: float | None, ceiling: float | None, jitter: float, seed: int):
    def first(scores: np.ndarray) -> np.ndarray:
        """Places of the k largest and of those that tie with the last of them."""
        if len(scores) <= k:
            return np.arange(len(scores))
        return np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])

    def emit(found: list[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
        for q, (uris, sims, scores) in enumerate(found):
            if len(uris):
                yield pa.RecordBatch.from_arrays([pa.array([names[q]] * len(uris), pa.string()), pa.array(uris.tolist(), pa.string()), pa.array(sims), pa.array(scores)], names=["query", "uri", "similarity", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, object), np.zeros(0), np.zeros(0)
        names = [q for q, _ in held.value]
        by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in {len(v) for _, v in held.value}:
            places = np.array([i for i, (_, v) in enumerate(held.value) if len(v) == size])
            by_size[size] = places, np.array([held.value[i][1] for i in places], np.float64)
        kept = [none] * len(names)
        for batch in batches:
            uris = np.array(batch.column(0).to_pylist(), object)
            vectors = [np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64) if x.is_valid else np.zeros(0) for x in batch.column(1)]
            noise = jitter * np.array([hash_number(u, seed) for u in uris]) if jitter else None
            for size, (places, matrix) in by_size.items():
                rows = np.array([i for i, v in enumerate(vectors) if len(v) == size], int)
                if not len(rows) or not size:
                    continue
                block = np.stack([vectors[i] for i in rows])
                scale = np.sqrt(np.outer((matrix * matrix).sum(axis=1), (block * block).sum(axis=1)))
                with np.errstate(invalid="ignore", divide="ignore"):
                    sim = np.clip(np.where(scale > 0, matrix @ block.T / scale, -np.inf), -np.inf, 1.0)
                sim[sim > 1 - 1e-12] = 1.0  # equal vectors, whatever the order of summation
                for q, row in zip(places.tolist(), sim):
                    good = np.isfinite(row)
                    good &= row > floor if floor is not None else True
                    good &= row < ceiling if ceiling is not None else True
                    hit = np.flatnonzero(good)
                    value = row[hit] if noise is None else row[hit] + noise[rows[hit]]
                    best = first(value)
                    new = uris[rows[hit[best]]], row[hit[best]], value[best]
                    if len(kept[q][0]):
                        new = tuple(np.concatenate(x) for x in zip(kept[q], new))
                        best = first(new[2])
                        new = tuple(x[best] for x in new)
                    kept[q] = new
            if sum(len(x[0]) for x in kept) > HELD_ROWS:
                yield from emit(kept, names)
                kept = [none] * len(names)
        yield from emit(kept, names)

    return run


def seed(tracks: DataFrame, uri: str):
    """The row of a track; an error without one or without an embedding."""
    row = tracks.where(F.col("uri") == uri).select("uri", "embedding").first()
    if row is None:
        raise LookupError(f"track {uri} not found")
    if row.embedding is None:
        raise ValueError(f"track {uri} has no embedding yet")
    return row


def related(tracks: DataFrame, uri: str, limit: int = 20, exclude: list[str] = [], floor: float = FLOOR) -> DataFrame:
    """The tracks nearest to one track, which may be among them (CMP-1)."""
    row = seed(tracks, uri)
    query = tracks.sparkSession.createDataFrame([(uri, [float(x) for x in row.embedding])], "query string, vector array<double>")
    pool = tracks.where(~F.col("uri").isin(exclude)) if exclude else tracks
    return top_k_expressions(pool, query, limit, floor).join(tracks.select("uri", "name", "artists"), "uri").select("pos", "uri", "name", "artists", "similarity")


def group_queries(tracks: DataFrame, queries: DataFrame, by: str, mode: str = "literal") -> DataFrame:
    """query, vector: the mean embedding of the query track's group (CMP-2).

    ``literal`` averages the query's own row only, ``centroid`` all tracks with the same
    artists array or album.
    """
    if mode == "literal":
        return tracks.join(queries.select(F.col("query").alias("uri")), "uri").select(F.col("uri").alias("query"), F.col("embedding").cast("array<double>").alias("vector"))
    groups = vector_mean(tracks, [by], "embedding", "vector")
    asked = tracks.join(queries.select(F.col("query").alias("uri")), "uri").select(F.col("uri").alias("query"), by)
    return asked.join(groups, by).select("query", "vector")


def similar_groups(tracks: DataFrame, queries: DataFrame, by: str, k: int = 30, mode: str = "literal", floor: float = FLOOR) -> DataFrame:
    """Tracks with floor < similarity < 1 to the group of each query track (CMP-3, CMP-4)."""
    return top_k(tracks, group_queries(tracks, queries, by, mode), k, floor, 1.0)


def solo_tracks(tracks: DataFrame, artist: str) -> DataFrame:
    """Tracks credited to exactly this artist, with similarity 1 (FLT-2, PRJ-3)."""
    return tracks.where(F.col("artists") == F.array(F.lit(artist))).select("uri", "name", "artists", F.lit(1.0).alias("similarity"))


def random_solo_tracks(tracks: DataFrame, artist: str, limit: int, seed: int) -> DataFrame:
    return solo_tracks(tracks, artist).orderBy(hash_uniform(F.col("uri"), F.lit(seed)), "uri").limit(limit)


def random_track(tracks: DataFrame, seed: int) -> DataFrame:
    """One embedded track (CMP-6); no row if there is none."""
    return tracks.where("embedding is not null").select("uri").orderBy(hash_uniform(F.col("uri"), F.lit(seed)), "uri").limit(1)


def pool_size(limit: int, ann_pool: int | None = None) -> int:
    """Candidates for a playlist: the factor 8 comes in twice."""
    return max((ann_pool if ann_pool is not None else max(limit * 8, 600)) * 8, 600)


def candidates(tracks: DataFrame, queries: DataFrame, skipped_songs: DataFrame, skipped_artists: DataFrame, pool: int, exclude: list[str] = [], jitter: float = JITTER, floor: float = CANDIDATE_FLOOR, seed: int = 0) -> DataFrame:
    """query, uri, name, artists, album, embedding, similarity, score, pos (CMP-9).

    The score is the similarity and noise in [0, jitter), computed once. The noise comes
    before the cut, and a task cuts to ``pool`` rows for each query, so a pool of any size
    is cut before the shuffle. Only the final pool is joined with the tracks' other
    columns: to carry vectors of ``pool`` rows from every task would shuffle more.
    """
    free = without_skipped(tracks.where("embedding is not null"), skipped_songs, skipped_artists)
    free = free.where(~F.col("uri").isin(exclude)) if exclude else free
    found = ranked(_searched(free, queries, pool, floor, None, QUERY_BLOCK, jitter, seed), ["query"], pool, "score")
    return found.join(tracks.select("uri", "name", "artists", "album", "embedding"), "uri")

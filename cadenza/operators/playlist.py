"""Chains, merging, interleaving and run lengths of playlists (IT-1, IT-3, WIN-*, AGG-9, CMP-7).

Lists are rows with (query, pos); order is never implicit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.vectors import format_rounded, hash_uniform
from cadenza.operators.feedback import soft_skip, without_skipped_songs
from cadenza.operators.similarity import FLOOR, similar_groups, top_k
from cadenza.session import ship
from cadenza.sources.work import drop, keep

CHAIN, BATCH, STREAK = 40, 3, 3
#: Solo tracks that may stand for an artist, and how many of an artist's a draw of them sorts on average.
SOLOS, DRAWN = 3, 32
ROW = "query string, pos int, uri string, name string, artists array<string>, similarity double, sim_source string"


def first_wins(rows: DataFrame, keys: list[str] = ["query"]) -> DataFrame:
    """The first row of each uri by pos; rows with a null or empty uri go (AGG-9, FLT-10)."""
    order = Window.partitionBy(*keys, "uri").orderBy("pos")
    return rows.where("uri is not null and uri <> ''").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def streaks(rows: DataFrame, keys: list[str] = ["query"]) -> DataFrame:
    """Adds ``streak``: how many rows in a row, up to this one, share an artist with the one before (WIN-1)."""
    order = Window.partitionBy(*keys).orderBy("pos")
    shares = F.coalesce(F.arrays_overlap("artists", F.lag("artists").over(order)), F.lit(False))
    runs = rows.withColumn("_run", F.sum(F.when(shares, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.withColumn("streak", F.row_number().over(Window.partitionBy(*keys, "_run").orderBy("pos"))).drop("_run")


def cap_streaks(rows: DataFrame, limit: int = STREAK, keys: list[str] = ["query"]) -> DataFrame:
    """Rows with a streak of at most ``limit``; removed rows still count for those after them (WIN-2)."""
    return streaks(rows, keys).where(F.col("streak") <= limit).drop("streak")


def artist_counts(rows: DataFrame, keys: list[str] = ["query"]) -> DataFrame:
    """Rows of each artist (AGG-5)."""
    return rows.select(*keys, F.explode("artists").alias("artist")).groupBy(*keys, "artist").agg(F.count("*").alias("n"))


def walk(start: str, near: dict[str, list[tuple[str, float]]], limit: int = CHAIN, batch: int = BATCH) -> list[tuple[str, float]]:
    """The chain from lists of nearest neighbours, which hold the track itself too.

    The first batch excludes nothing; each later batch takes the nearest of the last
    element that the chain lacks. The last batch may go beyond ``limit``.
    """
    chain = near.get(start, [])[:batch]
    held = {u for u, _ in chain}
    while chain and len(chain) < limit:
        more = [x for x in near.get(chain[-1][0], []) if x[0] not in held][:batch]
        if not more:
            break
        chain = chain + more
        held.update(u for u, _ in more)
    return chain


def chain_walk(tracks: DataFrame, seeds: DataFrame, limit: int = CHAIN, batch: int = BATCH, floor: float = FLOOR) -> DataFrame:
    """query, pos, uri, similarity: the chain of each seed (query), one search per step for all seeds.

    At most limit - 1 tracks of a chain are excluded when it is extended, so the nearest
    limit - 1 + batch tracks of the last one hold its next batch. Each step searches for
    the last elements of all chains together and keeps only the next batch of each. The
    embedded tracks are written once, so that steps don't make the track table again.
    """
    spark = tracks.sparkSession
    embedded = keep(spark, tracks.where("embedding is not null").select("uri", "embedding"))
    state = keep(spark, seeds.select("query", F.col("query").alias("last"), F.array().cast("array<struct<uri: string, similarity: double>>").alias("chain")))
    for step in range(-(-limit // batch) + limit):  # short batches make more steps
        ends = state.select(F.col("last").alias("uri")).distinct().join(embedded, "uri").select(F.col("uri").alias("query"), F.col("embedding").alias("vector"))
        near = top_k(embedded, ends, limit - 1 + batch, floor).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("pos", "uri", "similarity"))).alias("near")).select(F.col("query").alias("last"), "near")
        open_ = (F.size("chain") < limit) & F.col("last").isNotNull()
        fresh = F.filter(F.coalesce("near", F.array()), lambda x: ~F.array_contains(F.coalesce(F.col("chain.uri"), F.array()), x["uri"]))
        added = F.transform(F.slice(fresh, 1, batch), lambda x: F.struct(x["uri"].alias("uri"), x["similarity"].alias("similarity")))
        new = state.join(near, "last", "left").withColumn("more", F.when(open_, added).otherwise(F.array()))
        before, state = state, keep(spark, new.select("query", F.when(F.size("more") > 0, F.element_at("more", -1)["uri"]).alias("last"), F.concat("chain", "more").alias("chain")))
        drop(before)
        if state.where(F.col("last").isNotNull() & (F.size("chain") < limit)).isEmpty():
            break
    drop(embedded)
    return state.select("query", F.posexplode("chain").alias("i", "c")).select("query", (F.col("i") + 1).cast("int").alias("pos"), "c.uri", "c.similarity")


def chain_from_graph(graph: DataFrame, seeds: DataFrame, limit: int = CHAIN, batch: int = BATCH) -> DataFrame:
    """The same from a graph (query, uri, similarity, pos) of limit - 1 + batch neighbours, self included.

    Each step is a join of the chains' last elements with the graph.
    """
    spark = graph.sparkSession
    near = keep(spark, graph.groupBy(F.col("query").alias("last")).agg(F.sort_array(F.collect_list(F.struct("pos", "uri", "similarity"))).alias("near")))
    state = keep(spark, seeds.select("query", F.col("query").alias("last"), F.array().cast("array<struct<uri: string, similarity: double>>").alias("chain")))
    for step in range(-(-limit // batch) + limit):
        open_ = (F.size("chain") < limit) & F.col("last").isNotNull()
        fresh = F.filter(F.coalesce("near", F.array()), lambda x: ~F.array_contains(F.coalesce(F.col("chain.uri"), F.array()), x["uri"]))
        added = F.transform(F.slice(fresh, 1, batch), lambda x: F.struct(x["uri"].alias("uri"), x["similarity"].alias("similarity")))
        new = state.join(near, "last", "left").withColumn("more", F.when(open_, added).otherwise(F.array()))
        before, state = state, keep(spark, new.select("query", F.when(F.size("more") > 0, F.element_at("more", -1)["uri"]).alias("last"), F.concat("chain", "more").alias("chain")))
        drop(before)
        if state.where(F.col("last").isNotNull() & (F.size("chain") < limit)).isEmpty():
            break
    drop(near)
    return state.select("query", F.posexplode("chain").alias("i", "c")).select("query", (F.col("i") + 1).cast("int").alias("pos"), "c.uri", "c.similarity")


def listing(rows: DataFrame) -> DataFrame:
    """One line for each track of a playlist: artists, name, similarity with three decimals, uri (STR-8)."""
    line = F.concat(F.array_join("artists", ", "), F.lit(": "), F.col("name"), F.lit(", similarity: "), format_rounded("similarity"), F.lit(", uri: "), F.col("uri"))
    return rows.select("query", "pos", line.alias("line"))


def weave(rows: list[dict], solos: dict[str, list[dict]], draws: dict[str, float]) -> list[dict]:
    """Puts random solo tracks of a row's artists before it, from the last row to the first.

    A row whose next row shares an artist stays as it is, and the next row is the first of
    what stands there by then. Otherwise each of its artists gives one track if the row
    before shares an artist, else two or three by the row's draw; a uri comes once within
    what is put in.
    """
    out: list[dict] = []
    for i in range(len(rows) - 1, -1, -1):
        row = rows[i]
        own = set(row["artists"])
        if out and own & set(out[0]["artists"]):
            out.insert(0, row)
            continue
        n = 1 if i and own & set(rows[i - 1]["artists"]) else 2 if draws[row["uri"]] < 0.5 else 3
        group = [t for a in row["artists"] for t in solos.get(a, [])[:n]] + [row]
        seen: set[str] = set()
        out[:0] = [t for t in group if not (t["uri"] in seen or seen.add(t["uri"]))]
    return out


def draw_solos(rows: DataFrame, tracks: DataFrame, seed: int = 0) -> DataFrame:
    """query, artist, n, uri, name, artists: three solo tracks of each artist of a query's rows, the first by hash.

    Every pair of a query and a solo track of its artists is hashed, but of an artist's m
    tracks only those with a hash below ``DRAWN`` / m are written and sorted. A pair of query
    and artist that finds less than it needs there is drawn from all tracks of the artist.
    """
    spark = rows.sparkSession
    solo = tracks.where(F.size("artists") == 1).select(F.col("artists")[0].alias("artist"), "uri", "name", "artists")
    wanted = rows.select("query", F.explode("artists").alias("artist")).distinct()
    asked = keep(spark, wanted.join(solo.groupBy("artist").agg(F.count("*").alias("m")), "artist"))
    # Dealt by uri: a track table in a few files would otherwise be hashed by a few tasks.
    pairs = solo.repartition(spark.sparkContext.defaultParallelism, "uri")
    drawn = hash_uniform(F.col("uri"), F.col("query"), F.lit(seed))
    low = keep(spark, pairs.join(asked, "artist").where(drawn < DRAWN / F.col("m")).drop("m"))
    found = low.groupBy("query", "artist").agg(F.count("*").alias("found"))
    short = asked.join(found, ["query", "artist"], "left").where(F.coalesce("found", F.lit(0)) < F.least("m", F.lit(SOLOS))).select("query", "artist")
    if not short.isEmpty():
        low = low.join(short, ["query", "artist"], "left_anti").unionByName(pairs.join(short, "artist").select(*low.columns))
    order = Window.partitionBy("query", "artist").orderBy(drawn, "uri")
    return low.withColumn("n", F.row_number().over(order)).where(F.col("n") <= SOLOS).select("query", "artist", "n", "uri", "name", "artists")


def interleave(rows: DataFrame, tracks: DataFrame, seed: int = 0) -> DataFrame:
    """``weave`` for the list of each query; at most three solo tracks per artist are joined beforehand."""
    ship(rows.sparkSession)
    rows = keep(rows.sparkSession, rows)
    few = draw_solos(rows, tracks, seed)
    left = rows.select("query", F.lit(0).alias("kind"), F.col("pos").cast("int").alias("pos"), F.lit(None).cast("string").alias("artist"), "uri", "name", "artists", "similarity", "sim_source", hash_uniform(F.lit("n"), F.col("uri"), F.col("query"), F.lit(seed)).alias("draw"))
    right = few.select("query", F.lit(1), F.col("n"), "artist", "uri", "name", "artists", F.lit(1.0), F.lit("solo"), F.lit(0.0))

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["kind", "artist", "pos"], kind="stable")
        records = [dict(r, artists=list(r["artists"]) if r["artists"] is not None else []) for r in group.to_dict("records")]
        main = sorted((r for r in records if r["kind"] == 0), key=lambda r: r["pos"])
        solos: dict[str, list[dict]] = {}
        for r in records:
            if r["kind"] == 1:
                solos.setdefault(r["artist"], []).append(r)
        found = weave(main, solos, {r["uri"]: r["draw"] for r in main})
        return pd.DataFrame([(key[0], i, r["uri"], r["name"], r["artists"], r["similarity"], r["sim_source"]) for i, r in enumerate(found, 1)], columns=["query", "pos", "uri", "name", "artists", "similarity", "sim_source"])

    return left.union(right).groupBy("query").applyInPandas(run, ROW)


def merged(tracks: DataFrame, queries: DataFrame, floor: float = FLOOR, limit: int = CHAIN) -> DataFrame:
    """Chain, similar artists, similar albums and related tracks of each query, first wins, by similarity."""
    embedded = keep(tracks.sparkSession, tracks.where("embedding is not null"))
    seeds = embedded.join(queries.select(F.col("query").alias("uri")), "uri").select(F.col("uri").alias("query"), F.col("embedding").alias("vector"))
    parts = [
        ("chain", chain_walk(embedded, queries, limit, BATCH, floor)),
        ("artists", similar_groups(embedded, queries, "artists", 30, "literal", floor)),
        ("album", similar_groups(embedded, queries, "album", 30, "literal", floor)),
        ("related", top_k(embedded, seeds, 20, floor)),
    ]
    every = None
    for i, (name, part) in enumerate(parts):
        rows = part.select("query", (F.lit(i * 1000) + F.col("pos")).alias("pos"), "uri", "similarity", F.lit(name).alias("sim_source"))
        every = rows if every is None else every.union(rows)
    once = first_wins(every)
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "pos")
    sorted_ = once.withColumn("pos", F.row_number().over(order))
    return sorted_.join(tracks.select("uri", "name", "artists"), "uri").select("query", "pos", "uri", "name", "artists", "similarity", "sim_source")


def similar_tracks(tracks: DataFrame, queries: DataFrame, skipped_songs: DataFrame, skipped_artists: DataFrame, floor: float = FLOOR, seed: int = 0, limit: int = CHAIN) -> DataFrame:
    """query, pos, uri, name, artists, similarity, sim_source: the whole playlist (CMP-7)."""
    woven = keep(tracks.sparkSession, interleave(merged(tracks, queries, floor, limit), tracks, seed))
    counted = streaks(woven)
    kept = soft_skip(counted, skipped_artists, seed).where(F.col("streak") <= STREAK).drop("streak")
    free = without_skipped_songs(first_wins(kept), skipped_songs)
    order = Window.partitionBy("query").orderBy("pos")
    return free.withColumn("pos", F.row_number().over(order)).select("query", "pos", "uri", "name", "artists", "similarity", "sim_source")

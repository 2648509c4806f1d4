"""Queries over the stand-in tables, one or more per operator, with their SQL for another engine."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions import text as T
from cadenza.functions import vectors as V
from cadenza.functions.names import ARTISTS
from cadenza.operators import feedback, ingest, playlist, profile, rerank, similarity
from cadenza.plans import standin as S
from cadenza.plans.standin import FLOOR, SQL, cosine_sql, hash_sql, unit_sql
from cadenza.sources import sinks, tables, work
from cadenza.streaming import feedback as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
KEYS = [0, 1, 7, 42, 150]
_LIST = ", ".join(f"'library://track/{k}'" for k in KEYS)
_SOLO = "Brand#12"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _flat(df: DataFrame) -> DataFrame:
    """Artists as one string, for comparisons."""
    return df.withColumn("artists", F.array_join("artists", "|"))


def _uris(keys: list[int]) -> list[str]:
    return [f"library://track/{k}" for k in keys]


# ---------------------------------------------------------------- sources and filters


@query(f"{SQL} SELECT uri, name, array_to_string(artists, '|') AS artists, album FROM track WHERE uri = 'library://track/42'")
def src_point_lookup(spark, sf_dir):
    return _flat(S.tracks(spark, sf_dir).where("uri = 'library://track/42'").select("uri", "name", "artists", "album"))


@query(f"{SQL} SELECT uri, name, array_to_string(artists, '|') AS artists, album FROM track WHERE uri IN ({_LIST})")
def src_multi_lookup(spark, sf_dir):
    keys = spark.createDataFrame([(u,) for u in _uris(KEYS)], "uri string")
    return _flat(S.tracks(spark, sf_dir).join(F.broadcast(keys), "uri", "left_semi").select("uri", "name", "artists", "album"))


@query(f"{SQL} SELECT CAST(count(*) FILTER (embedding IS NULL) AS BIGINT) AS missing, CAST(count(embedding) AS BIGINT) AS completed FROM track")
def flt_null_split_counts(spark, sf_dir):
    return ingest.coverage(S.tracks(spark, sf_dir))[2]


@query(f"{SQL} SELECT uri, name, array_to_string(artists, '|') AS artists, album FROM track WHERE embedding IS NULL")
def coverage_missing(spark, sf_dir):
    return _flat(ingest.coverage(S.tracks(spark, sf_dir))[0])


@query(f"{SQL} SELECT uri, name, array_to_string(artists, '|') AS artists, CAST(1 AS DOUBLE) AS similarity FROM track WHERE artists = ['{_SOLO}'] ORDER BY {hash_sql('uri', "'42'")}, uri LIMIT 5")
def flt_solo_artist(spark, sf_dir):
    return _flat(similarity.random_solo_tracks(S.tracks(spark, sf_dir), _SOLO, 5, 42))


@query(f"{SQL} SELECT uri FROM track")
def flt_not_in_empty(spark, sf_dir):
    none = spark.createDataFrame([], "uri string")
    return S.tracks(spark, sf_dir).join(none, "uri", "left_anti").select("uri")


@query(f"{SQL} SELECT uri FROM track WHERE uri NOT IN ({_LIST})")
def flt_not_in_list(spark, sf_dir):
    return S.tracks(spark, sf_dir).where(~F.col("uri").isin(_uris(KEYS))).select("uri")


@query(f"{SQL} SELECT uri FROM track t WHERE NOT EXISTS (SELECT 1 FROM skipped_artists s WHERE list_contains(t.artists, s.name))")
def anti_skipped_artists(spark, sf_dir):
    return feedback.without_skipped_artists(S.tracks(spark, sf_dir), S.skipped_artists(spark)).select("uri")


@query(f"{SQL} SELECT uri FROM track t WHERE NOT EXISTS (SELECT 1 FROM skipped_songs s WHERE s.uri = t.uri)")
def anti_skipped_songs(spark, sf_dir):
    return feedback.without_skipped_songs(S.tracks(spark, sf_dir), S.skipped_songs(spark, sf_dir)).select("uri")


@query(f"{SQL} SELECT uri FROM track WHERE embedding IS NOT NULL AND uri IN (SELECT uri FROM liked)")
def semi_liked(spark, sf_dir):
    return feedback.liked_tracks(S.tracks(spark, sf_dir), S.liked(spark, sf_dir)).select("uri")


# ---------------------------------------------------------------- vectors

_PAIRS = "pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, CAST(a.embedding AS DOUBLE[]) AS x, CAST(b.embedding AS DOUBLE[]) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


def _pairs(spark, sf_dir):
    v = S.table(spark, sf_dir, "embeddings")
    a = v.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"))
    return a.join(v.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("y")), "a")


@query(f"WITH {_PAIRS} SELECT a, b, round(list_inner_product(x, y), 6) AS dot FROM pairs")
def vec_dot(spark, sf_dir):
    return _pairs(spark, sf_dir).select("a", "b", F.round(V.dot("x", "y"), 6).alias("dot"))


@query(f"WITH {_PAIRS} SELECT a, b, round({cosine_sql('x', 'y')}, 6) AS similarity FROM pairs")
def vec_cosine_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("a", "b", F.round(V.cosine("x", "y"), 6).alias("similarity"))


@query(f"SELECT vec_id, round(u[1], 6) AS first, round(u[64], 6) AS last, round(list_sum(u), 6) AS total FROM (SELECT vec_id, {unit_sql('list_transform(CAST(embedding AS DOUBLE[]), lambda z: z * 3)')} AS u FROM embeddings)")
def vec_l2norm(spark, sf_dir):
    u = S.table(spark, sf_dir, "embeddings").select("vec_id", V.l2norm(F.transform(F.col("embedding").cast("array<double>"), lambda z: z * 3)).alias("u"))
    return u.select("vec_id", F.round(F.element_at("u", 1), 6).alias("first"), F.round(F.element_at("u", 64), 6).alias("last"), F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(f"WITH {_PAIRS} SELECT a, b, round(0.6 * x[1] + 0.4 * y[1], 6) AS first, round(list_sum(list_transform(list_zip(x, y), lambda z: 0.6 * z[1] + 0.4 * z[2])), 6) AS total FROM pairs")
def vec_blend(spark, sf_dir):
    m = _pairs(spark, sf_dir).select("a", "b", V.blend("x", "y", 0.6).alias("m"))
    return m.select("a", "b", F.round(F.element_at("m", 1), 6).alias("first"), F.round(F.aggregate("m", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("SELECT vec_id, CAST(len(embedding) AS INT) AS n, round(list_sum(list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 6))), 6) AS total FROM embeddings")
def vec_text_roundtrip(spark, sf_dir):
    back = S.table(spark, sf_dir, "embeddings").select("vec_id", V.parse_vector(V.format_vector("embedding")).alias("v"))
    return back.select("vec_id", F.size("v").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("SELECT vec_id, vec_id % 7 = 0 AS bad FROM embeddings")
def vec_has_nan(spark, sf_dir):
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x, i: F.when((F.col("vec_id") % 7 == 0) & (i == 9), F.lit(float("nan"))).otherwise(x))
    return S.table(spark, sf_dir, "embeddings").select("vec_id", V.has_nan(v).alias("bad"))


# ---------------------------------------------------------------- similarity


def _found(df: DataFrame) -> DataFrame:
    return df.select("query", F.col("pos").cast("int").alias("pos"), "uri", F.round("similarity", 6).alias("similarity"))


def _top_sql(k: int, where: str, vectors: str = "asked", corpus: str = "track") -> str:
    return f"""sim AS (SELECT q.query, t.uri, {cosine_sql('t.embedding', 'q.vector')} AS similarity FROM {corpus} t, {vectors} q WHERE t.embedding IS NOT NULL AND q.vector IS NOT NULL),
ranked AS (SELECT query, uri, similarity, CAST(row_number() OVER (PARTITION BY query ORDER BY similarity DESC, uri) AS INT) AS pos FROM sim WHERE {where})
SELECT query, pos, uri, round(similarity, 6) AS similarity FROM ranked WHERE pos <= {k}"""


@query(f"{SQL}, {_top_sql(20, f'similarity > {FLOOR}')}")
def related_topk(spark, sf_dir):
    return _found(similarity.top_k(S.tracks(spark, sf_dir), S.asked(spark, sf_dir), 20, FLOOR))


@query(f"{SQL}, {_top_sql(20, f'similarity > {FLOOR}', vectors="(SELECT * FROM asked WHERE query = 'library://track/100')", corpus="(SELECT * FROM track WHERE p_partkey % 10 <> 1)")}")
def related_one(spark, sf_dir):
    """The search that starts from one track's row, with tracks to leave out."""
    tracks = S.tracks(spark, sf_dir)
    left_out = [r.uri for r in tracks.where("cast(split(uri, '/')[3] as bigint) % 10 = 1").select("uri").collect()]
    found = similarity.related(tracks, "library://track/100", 20, left_out, FLOOR)
    return _found(found.withColumn("query", F.lit("library://track/100")))


@query(f"{SQL}, {_top_sql(10, 'true')}")
def knn_graph_hof(spark, sf_dir):
    return _found(similarity.top_k_expressions(S.tracks(spark, sf_dir), S.asked(spark, sf_dir), 10, None))


@query(f"{SQL}, {_top_sql(10, 'true')}")
def knn_graph_blas(spark, sf_dir):
    return _found(similarity.top_k(S.tracks(spark, sf_dir), S.asked(spark, sf_dir), 10, None))


def _group_sql(by: str, mode: str) -> str:
    if mode == "literal":
        return "asked"
    return f"""(SELECT a.query, g.vector FROM asked a JOIN track t ON t.uri = a.query JOIN (
  SELECT {by}, list(m ORDER BY i) AS vector FROM (SELECT {by}, i, avg(x) AS m FROM (SELECT {by}, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM track WHERE embedding IS NOT NULL) GROUP BY {by}, i) GROUP BY {by}
) g USING ({by}))"""


def _group_query(name: str, by: str, mode: str) -> None:
    def run(spark, sf_dir):
        return _found(similarity.similar_groups(S.tracks(spark, sf_dir), S.asked(spark, sf_dir).select("query"), by, 30, mode, FLOOR))

    run.__name__ = name
    where = f"round(similarity, 12) > {FLOOR} AND similarity < 1 - 1e-12"
    query(f"{SQL}, {_top_sql(30, where, _group_sql(by, mode))}")(run)


for _by, _name in (("artists", "artist"), ("album", "album")):
    for _mode in ("literal", "centroid"):
        _group_query(f"related_{_name}_{_mode}", _by, _mode)

_CENTROID = f"SELECT {{keys}} list(m ORDER BY i) AS c FROM (SELECT {{keys}} i, avg(x) AS m FROM (SELECT {{keys}} unnest(u) AS x, generate_subscripts(u, 1) AS i FROM {{rows}}) GROUP BY {{keys}} i) {{group}}"


@query(f"{SQL}, u AS (SELECT {unit_sql('embedding')} AS u FROM track WHERE embedding IS NOT NULL AND uri IN (SELECT uri FROM liked)), c AS ({_CENTROID.format(keys='', rows='u', group='')}) SELECT round(c[1], 6) AS first, round(list_sum(c), 6) AS total FROM (SELECT {unit_sql('c')} AS c FROM c WHERE c IS NOT NULL)")
def centroid_liked(spark, sf_dir):
    rows = feedback.liked_tracks(S.tracks(spark, sf_dir), S.liked(spark, sf_dir)).withColumn("g", F.lit(1))
    c = V.centroid(rows, ["g"], "embedding", "c")
    return c.select(F.round(F.element_at("c", 1), 6).alias("first"), F.round(F.aggregate("c", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(f"{SQL}, u AS (SELECT album, {unit_sql('embedding')} AS u FROM track WHERE embedding IS NOT NULL), c AS ({_CENTROID.format(keys='album,', rows='u', group='GROUP BY album')}) SELECT album, round(c[1], 6) AS first, round(list_sum(c), 6) AS total FROM (SELECT album, {unit_sql('c')} AS c FROM c)")
def centroid_by_group(spark, sf_dir):
    c = V.centroid(S.tracks(spark, sf_dir).where("embedding is not null"), ["album"], "embedding", "c")
    return c.select("album", F.round(F.element_at("c", 1), 6).alias("first"), F.round(F.aggregate("c", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


_BLEND = f"""{SQL}, req AS (SELECT 'r' || CAST(floor(p_partkey / 300) AS BIGINT) AS query, uri FROM track WHERE p_partkey % 100 = 0),
su AS (SELECT query, {unit_sql('embedding')} AS u FROM req JOIN track USING (uri) WHERE embedding IS NOT NULL),
s0 AS ({_CENTROID.format(keys='query,', rows='su', group='GROUP BY query')}), s AS (SELECT query, {unit_sql('c')} AS s FROM s0),
lu AS (SELECT {unit_sql('embedding')} AS u FROM track WHERE embedding IS NOT NULL AND uri IN (SELECT uri FROM liked)),
l0 AS ({_CENTROID.format(keys='', rows='lu', group='')}), l AS (SELECT {unit_sql('c')} AS c FROM l0 WHERE c IS NOT NULL),
b0 AS (SELECT query, CASE WHEN s IS NOT NULL AND c IS NOT NULL THEN list_transform(list_zip(s, c), lambda z: 0.6 * z[1] + 0.4 * z[2]) ELSE coalesce(s, c) END AS b FROM (SELECT DISTINCT query FROM req) LEFT JOIN s USING (query) LEFT JOIN l ON true),
blended AS (SELECT query, {unit_sql('b')} AS vector FROM b0)"""


@query(f"{_BLEND} SELECT query, round(vector[1], 6) AS first, round(list_sum(vector), 6) AS total FROM blended")
def query_vector_blend(spark, sf_dir):
    q = profile.query_vectors(S.tracks(spark, sf_dir), S.requests(spark, sf_dir), S.liked(spark, sf_dir))
    return q.select("query", F.round(F.element_at("vector", 1), 6).alias("first"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


_FREE = "free AS (SELECT * FROM track t WHERE embedding IS NOT NULL AND NOT EXISTS (SELECT 1 FROM skipped_artists s WHERE list_contains(t.artists, s.name)) AND NOT EXISTS (SELECT 1 FROM skipped_songs s WHERE s.uri = t.uri))"


@query(f"{SQL}, {_FREE}, {_top_sql(100, f'similarity > {FLOOR}', 'asked', 'free')}")
def candidates_pool(spark, sf_dir):
    return _found(similarity.candidates(S.tracks(spark, sf_dir), S.asked(spark, sf_dir), S.skipped_songs(spark, sf_dir), S.skipped_artists(spark), 100, jitter=0.0, floor=FLOOR))


@query(
    f"""{SQL}, {_FREE}, sim AS (SELECT q.query, t.uri, {cosine_sql('t.embedding', 'q.vector')} AS similarity FROM free t, asked q),
scored AS (SELECT *, similarity + 0.02 * {hash_sql('uri', "'7'")} AS score FROM sim WHERE similarity > {FLOOR}),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, uri) AS INT) AS pos FROM scored)
SELECT query, pos, uri, round(similarity, 6) AS similarity, round(score, 6) AS score FROM ranked WHERE pos <= 50"""
)
def candidates_jitter_hash(spark, sf_dir):
    found = similarity.candidates(S.tracks(spark, sf_dir), S.asked(spark, sf_dir), S.skipped_songs(spark, sf_dir), S.skipped_artists(spark), 50, jitter=0.02, floor=FLOOR, seed=7)
    return found.select("query", F.col("pos").cast("int").alias("pos"), "uri", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"))


@query(f"{SQL} SELECT uri FROM track WHERE embedding IS NOT NULL ORDER BY {hash_sql('uri', "'11'")}, uri LIMIT 1")
def random_track_hash(spark, sf_dir):
    return similarity.random_track(S.tracks(spark, sf_dir), 11)


# ---------------------------------------------------------------- lists

_LISTS = "lists AS (SELECT album AS query, uri, artists, CAST(row_number() OVER (PARTITION BY album ORDER BY uri) AS INT) AS pos FROM track)"
_STREAK = f"{SQL}, {_LISTS}, shares AS (SELECT *, CASE WHEN coalesce(list_has_any(artists, lag(artists) OVER (PARTITION BY query ORDER BY pos)), false) THEN 0 ELSE 1 END AS brk FROM lists), runs AS (SELECT *, sum(brk) OVER (PARTITION BY query ORDER BY pos) AS run FROM shares), streaks AS (SELECT query, pos, uri, CAST(row_number() OVER (PARTITION BY query, run ORDER BY pos) AS INT) AS streak FROM runs)"


def _lists(spark, sf_dir):
    """A playlist for each album."""
    order = Window.partitionBy("album").orderBy("uri")
    return S.tracks(spark, sf_dir).withColumn("pos", F.row_number().over(order)).withColumn("query", F.col("album")).drop("embedding")


@query(f"{SQL}, {_LISTS} SELECT query, pos, array_to_string(artists, ', ') || ': ' || name || ', similarity: ' || printf('%.3f', pos / 8.0) || ', uri: ' || uri AS line FROM lists JOIN (SELECT uri, name FROM track) USING (uri) WHERE pos <= 40")
def playlist_listing(spark, sf_dir):
    return playlist.listing(_lists(spark, sf_dir).where("pos <= 40").withColumn("similarity", F.col("pos") / 8))


@query(f"{_STREAK} SELECT query, pos, uri, streak FROM streaks")
def streak_count(spark, sf_dir):
    return playlist.streaks(_lists(spark, sf_dir)).select("query", "pos", "uri", "streak")


@query(f"{_STREAK} SELECT query, pos, uri FROM streaks WHERE streak <= 3")
def streak_cap(spark, sf_dir):
    return playlist.cap_streaks(_lists(spark, sf_dir), 3).select("query", "pos", "uri")


@query(f"{SQL}, twice AS (SELECT uri, album, 0 AS src, p_partkey AS n FROM track UNION ALL SELECT uri, 'again', 1, p_partkey FROM track WHERE embedding IS NOT NULL) SELECT uri, album FROM (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY src) AS r FROM twice) WHERE r = 1")
def dedup_first_wins(spark, sf_dir):
    t = S.tracks(spark, sf_dir)
    both = t.select("uri", "album", F.lit(0).alias("pos")).union(t.where("embedding is not null").select("uri", F.lit("again"), F.lit(1)))
    return playlist.first_wins(both.withColumn("query", F.lit("all"))).select("uri", "album")


@query(f"{SQL} SELECT uri FROM track t WHERE NOT (EXISTS (SELECT 1 FROM skipped_artists s WHERE list_contains(t.artists, s.name)) AND {hash_sql('uri', "'5'")} < 0.3)")
def soft_skip_hash(spark, sf_dir):
    return feedback.soft_skip(S.tracks(spark, sf_dir), S.skipped_artists(spark), 5).select("uri")


@query(f"{SQL}, {_LISTS} SELECT query, artist, CAST(count(*) AS BIGINT) AS n FROM (SELECT query, unnest(artists) AS artist FROM lists) GROUP BY ALL")
def artist_counts(spark, sf_dir):
    return playlist.artist_counts(_lists(spark, sf_dir))


_CHAIN = f"""{SQL}, sims AS (SELECT a.uri AS last, b.uri, {cosine_sql('a.embedding', 'b.embedding')} AS similarity FROM track a, track b WHERE a.embedding IS NOT NULL AND b.embedding IS NOT NULL),
near AS (SELECT last, list({{'uri': uri, 'similarity': similarity}} ORDER BY similarity DESC, uri) AS near FROM sims WHERE similarity > 0.2 GROUP BY last),
chains AS (
  SELECT query, query AS last, CAST([] AS STRUCT(uri VARCHAR, similarity DOUBLE)[]) AS chain FROM asked
  UNION ALL
  SELECT query, more[-1].uri, list_concat(chain, more)
  FROM (SELECT c.query, c.chain, list_filter(n.near, lambda x: NOT list_contains(list_transform(c.chain, lambda y: y.uri), x.uri))[1:3] AS more FROM chains c JOIN near n ON n.last = c.last WHERE len(c.chain) < 40)
  WHERE len(more) > 0
), longest AS (SELECT query, arg_max(chain, len(chain)) AS chain FROM chains GROUP BY query),
rows AS (SELECT query, unnest(chain) AS c, generate_subscripts(chain, 1) AS pos FROM longest)
SELECT query, CAST(pos AS INT) AS pos, c.uri AS uri, round(c.similarity, 6) AS similarity FROM rows"""


@query(_CHAIN)
def chain_walk(spark, sf_dir):
    found = playlist.chain_walk(S.tracks(spark, sf_dir), S.asked(spark, sf_dir).select("query"), 40, 3, 0.2)
    return _found(found)


def _pool(spark, sf_dir, jitter):
    q = profile.query_vectors(S.tracks(spark, sf_dir), S.requests(spark, sf_dir), S.liked(spark, sf_dir))
    found = similarity.candidates(S.tracks(spark, sf_dir), q, S.skipped_songs(spark, sf_dir), S.skipped_artists(spark), similarity.pool_size(60, 800), jitter=jitter, floor=0.0)
    return found, q


def _picks(df: DataFrame) -> DataFrame:
    return df.select("query", "pos", "uri", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"))


def _mmr(limit: int, weight: float = 0.7, jitter: float = 0.0, selection: str = "argmax", seed: int = 0, noise: float = 0.0, inertia: float = 0.9, penalties: tuple[float, float] = (0.03, 0.06)) -> str:
    """The selection, one step a round: candidates in order of the pool with the largest similarity to the picks."""
    draw = f"{hash_sql("'pick'", 'query', 'pos + 1', f"'{seed}'")}"
    weights = f"list_transform(scores, lambda x: exp(x / {0.12}))"
    explore = hash_sql("'explore'", "query", "pos + 1", f"'{seed}'")
    gumbel = f"list_transform(scores, lambda x, i: x / 0.12 - ln(-ln(greatest({hash_sql('c[i].uri', 'query', 'pos + 1', f"'{seed}'")}, 1e-12))))"
    best = {
        "argmax": "list_position(scores, list_max(scores))",
        "softmax": f"list_position(list_transform(range(1, len(c) + 1), lambda i: {draw} * list_sum(w) - list_sum(w[1:i]) <= 0), true)",
        "gumbel": f"list_position({gumbel}, list_max({gumbel}))",
        "epsilon": f"CASE WHEN pos > 0 AND len(c) > 1 AND {explore} < 0.08 THEN list_position(scores, list_reverse_sort(scores)[CAST(floor({draw} * least(30, len(c))) AS INT) + 1]) ELSE list_position(scores, list_max(scores)) END",
    }[selection]
    unit = unit_sql("m")
    moved = f"list_transform(list_zip(q, c[best].u), lambda z: {inertia} * z[1] + {1 - inertia!r} * z[2])"
    shaken = f"list_transform({unit}, lambda x, i: x + {noise} * (2 * {hash_sql("'noise'", 'query', 'pos + 1', 'i', f"'{seed}'")} - 1))" if noise else unit
    spread = "CASE WHEN pos = 0 THEN 0 ELSE near[i] END"
    counted = "coalesce(list_sum(list_transform(x.artists, lambda a: len(list_filter(picked, lambda p: p = a)))), 0)"
    shares = "CASE WHEN list_has_any(x.artists, last) THEN greatest(0, streak - 2) ELSE 0 END"
    return f"""{_BLEND}, {_FREE},
pool0 AS (SELECT q.query, t.uri, t.artists, {unit_sql('t.embedding')} AS u, {cosine_sql('t.embedding', 'q.vector')} AS similarity, q.vector FROM free t, blended q),
pool AS (SELECT *, similarity + {jitter} * {hash_sql('uri', "'0'")} AS score FROM pool0 WHERE similarity > 0),
cand AS (SELECT query, any_value(vector) AS q, list({{'uri': uri, 'u': u, 'artists': artists, 'sim': similarity}} ORDER BY score DESC, uri) AS c FROM pool GROUP BY query),
steps AS (
  SELECT query, 0 AS pos, c, q, CAST(NULL AS VARCHAR) AS uri, CAST(NULL AS DOUBLE) AS sim, CAST(NULL AS DOUBLE) AS score, list_transform(c, lambda x: CAST(-2 AS DOUBLE)) AS near, CAST([] AS VARCHAR[]) AS picked, CAST([] AS VARCHAR[]) AS last, 0 AS streak FROM cand
  UNION ALL
  SELECT query, pos + 1, list_filter(c, lambda x, i: i <> best), {unit_sql('s')}, c[best].uri, c[best].sim, scores[best],
    list_filter(list_transform(c, lambda x, i: greatest(near[i], list_inner_product(x.u, c[best].u))), lambda x, i: i <> best),
    list_concat(picked, c[best].artists), c[best].artists, CASE WHEN list_has_any(c[best].artists, last) THEN streak + 1 ELSE 1 END
  FROM (SELECT *, {shaken} AS s FROM (SELECT *, {moved} AS m FROM (SELECT *, {best} AS best FROM (SELECT *, {weights} AS w FROM
    (SELECT *, list_transform(c, lambda x, i: {weight} * list_inner_product(x.u, q) - {1 - weight!r} * {spread} - {penalties[0]} * {counted} - {penalties[1]} * {shares}) AS scores FROM steps WHERE pos < {limit} AND len(c) > 0)))))
)
SELECT query, CAST(pos AS INT) AS pos, uri, round(sim, 6) AS similarity, round(score, 6) AS score FROM steps WHERE pos > 0"""


@query(_mmr(30, inertia=1.0, penalties=(0.0, 0.0)))
def mmr_argmax(spark, sf_dir):
    """A query that stays as it is, and nothing penalised."""
    pool, q = _pool(spark, sf_dir, 0.0)
    plain = rerank.Selection(limit=30, selection="argmax", penalty_global=0.0, penalty_streak=0.0, inertia=1.0, noise=0.0)
    return _picks(rerank.rerank(pool, q, plain))


@query(_mmr(30))
def mmr_penalty_argmax(spark, sf_dir):
    pool, q = _pool(spark, sf_dir, 0.0)
    return _picks(rerank.rerank(pool, q, rerank.Selection(limit=30, selection="argmax", noise=0.0)))


@query(_mmr(30, selection="gumbel", seed=5))
def mmr_gumbel(spark, sf_dir):
    pool, q = _pool(spark, sf_dir, 0.0)
    return _picks(rerank.rerank(pool, q, rerank.Selection(limit=30, selection="gumbel", noise=0.0, seed=5)))


@query(_mmr(30, selection="epsilon", seed=2))
def mmr_epsilon(spark, sf_dir):
    pool, q = _pool(spark, sf_dir, 0.0)
    return _picks(rerank.rerank(pool, q, rerank.Selection(limit=30, selection="epsilon", noise=0.0, seed=2)))


@query(_mmr(30, selection="softmax", seed=3, noise=0.01))
def mmr_softmax(spark, sf_dir):
    pool, q = _pool(spark, sf_dir, 0.0)
    return _picks(rerank.rerank(pool, q, rerank.Selection(limit=30, seed=3)))


@query(_mmr(60, weight=0.8, jitter=similarity.JITTER, selection="softmax", seed=1, noise=0.01))
def recommend(spark, sf_dir):
    pool, q = _pool(spark, sf_dir, similarity.JITTER)
    return _picks(rerank.rerank(pool, q, rerank.Selection(limit=60, weight=0.8, seed=1)))


def _weave(rows: str, seed: int) -> str:
    """CTEs ending in woven (query, pos, uri, artists, similarity) for the CTE ``rows`` (query, pos, uri, artists, similarity)."""
    return f"""wanted AS (SELECT DISTINCT query, unnest(artists) AS artist FROM {rows}),
solo AS (SELECT query, artist, list({{'uri': uri, 'artists': artists, 'similarity': CAST(1 AS DOUBLE)}} ORDER BY h, uri)[1:3] AS few
  FROM (SELECT w.query, w.artist, t.uri, t.artists, {hash_sql('t.uri', 'w.query', f"'{seed}'")} AS h FROM wanted w JOIN track t ON t.artists = [w.artist]) GROUP BY query, artist),
byq AS (SELECT query, list({{'artist': artist, 'few': few}}) AS solos FROM solo GROUP BY query),
listed AS (SELECT r.query, list({{'uri': r.uri, 'artists': r.artists, 'similarity': r.similarity, 'draw': {hash_sql("'n'", 'r.uri', 'r.query', f"'{seed}'")}}} ORDER BY r.pos) AS r FROM {rows} r GROUP BY r.query),
turns AS (
  SELECT query, len(r) AS i, r, coalesce(solos, []) AS solos, CAST([] AS STRUCT(uri VARCHAR, artists VARCHAR[], similarity DOUBLE)[]) AS out FROM listed LEFT JOIN byq USING (query)
  UNION ALL
  SELECT query, i - 1, r, solos, list_concat(CASE WHEN len(out) > 0 AND list_has_any(own, out[1].artists) THEN [me] ELSE list_filter(g, lambda x, j: list_position(list_transform(g, lambda y: y.uri), x.uri) = j) END, out)
  FROM (SELECT *, list_concat(flatten(list_transform(own, lambda a: coalesce(list_filter(solos, lambda s: s.artist = a)[1].few, [])[1:n])), [me]) AS g
    FROM (SELECT *, r[i].artists AS own, {{'uri': r[i].uri, 'artists': r[i].artists, 'similarity': r[i].similarity}} AS me,
      CASE WHEN i > 1 AND list_has_any(r[i].artists, r[greatest(i - 1, 1)].artists) THEN 1 WHEN r[i].draw < 0.5 THEN 2 ELSE 3 END AS n FROM turns WHERE i > 0))
),
woven AS (SELECT query, pos, o.uri AS uri, o.artists AS artists, o.similarity AS similarity FROM (SELECT query, unnest(out) AS o, generate_subscripts(out, 1) AS pos FROM turns WHERE i = 0))"""


_RELATED = _top_sql(20, f"similarity > {FLOOR}").replace("SELECT query, pos, uri, round(similarity, 6) AS similarity FROM ranked WHERE pos <= 20", "found AS (SELECT r.query, r.pos, r.uri, t.artists, r.similarity FROM ranked r JOIN track t ON t.uri = r.uri WHERE r.pos <= 20)")


@query(f"""{SQL}, {_RELATED.replace("found AS", ", found AS", 1)}, {_weave("found", 9)}
SELECT query, CAST(pos AS INT) AS pos, uri, array_to_string(artists, '|') AS artists, round(similarity, 6) AS similarity FROM woven""")
def artist_interleave(spark, sf_dir):
    tracks = S.tracks(spark, sf_dir)
    found = similarity.top_k(tracks, S.asked(spark, sf_dir), 20, FLOOR).join(tracks.select("uri", "name", "artists"), "uri").withColumn("sim_source", F.lit("related"))
    return _flat(playlist.interleave(found, tracks, 9)).select("query", "pos", "uri", "artists", F.round("similarity", 6).alias("similarity"))


_PLAYLIST = f"""{_CHAIN.replace("SELECT query, CAST(pos AS INT) AS pos, c.uri AS uri, round(c.similarity, 6) AS similarity FROM rows", "")}
, chained AS (SELECT query, pos, c.uri AS uri, c.similarity AS similarity, 'chain' AS src, 0 AS k FROM rows),
around AS (SELECT a.query, s.uri, s.similarity FROM asked a JOIN sims s ON s.last = a.query WHERE s.similarity > 0.2),
grouped AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, uri) AS pos, uri, similarity FROM around WHERE similarity < 1 - 1e-12),
close AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, uri) AS pos, uri, similarity FROM around),
every AS (SELECT * FROM chained UNION ALL SELECT *, 'artists', 1000 FROM grouped WHERE pos <= 30 UNION ALL SELECT *, 'album', 2000 FROM grouped WHERE pos <= 30 UNION ALL SELECT *, 'related', 3000 FROM close WHERE pos <= 20),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, uri ORDER BY k + pos) AS n FROM every) WHERE n = 1),
merged AS (SELECT o.query, row_number() OVER (PARTITION BY o.query ORDER BY o.similarity DESC, k + pos) AS pos, o.uri, t.artists, o.similarity FROM once o JOIN track t ON t.uri = o.uri),
{_weave("merged", 4)},
sharing AS (SELECT *, CASE WHEN coalesce(list_has_any(artists, lag(artists) OVER (PARTITION BY query ORDER BY pos)), false) THEN 0 ELSE 1 END AS brk FROM woven),
run AS (SELECT *, sum(brk) OVER (PARTITION BY query ORDER BY pos) AS run FROM sharing),
streak AS (SELECT *, row_number() OVER (PARTITION BY query, run ORDER BY pos) AS streak FROM run),
capped AS (SELECT * FROM streak t WHERE streak <= 3 AND NOT (EXISTS (SELECT 1 FROM skipped_artists s WHERE list_contains(t.artists, s.name)) AND {hash_sql('uri', "'4'")} < 0.3)),
first AS (SELECT *, row_number() OVER (PARTITION BY query, uri ORDER BY pos) AS n FROM capped)
SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY pos) AS INT) AS pos, uri, round(similarity, 6) AS similarity FROM first f WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM skipped_songs s WHERE s.uri = f.uri)"""


@query(_PLAYLIST)
def similar_tracks_playlist(spark, sf_dir):
    found = playlist.similar_tracks(S.tracks(spark, sf_dir), S.asked(spark, sf_dir).select("query"), S.skipped_songs(spark, sf_dir), S.skipped_artists(spark), floor=0.2, seed=4)
    return found.select("query", "pos", "uri", F.round("similarity", 6).alias("similarity"))


# ---------------------------------------------------------------- ingestion

_CREDITS = "concat(CASE p_size % 4 WHEN 0 THEN 'Ed Sheeran feat. Meek Mill' WHEN 1 THEN 'Sia' WHEN 2 THEN 'Elton John _ Leon Russell' ELSE p_brand END, ', ', p_type)"
_NAMES_SQL = ", ".join("'" + n.replace("'", "''") + "'" for n in ARTISTS)


def _library(spark, sf_dir):
    """A library response as JSON text, made of parts and parsed by the schema."""
    part = S.table(spark, sf_dir, "part")
    names = F.split(F.expr(_CREDITS), ", ")
    track = F.struct(_text("p_partkey").alias("uri"), F.col("p_name").alias("name"), F.transform(names, lambda n: F.struct(n.alias("name"))).alias("artists"), F.struct(F.col("p_type").alias("name")).alias("album"))
    raw = part.select(F.to_json(F.struct(F.struct(F.array(track).alias("tracks")).alias("service_response"))).alias("body"))
    return raw.select(F.from_json("body", tables.LIBRARY).alias("r")).select("r.*")


def _text(column: str):
    return F.concat(F.lit("library://track/"), F.col(column).cast("string"))


@query(f"SELECT 'library://track/' || p_partkey AS uri, p_name AS name, {_CREDITS} AS credit, p_type AS album FROM part")
def ingest_flatten(spark, sf_dir):
    return ingest.flatten(_library(spark, sf_dir))


@query(f"SELECT 'library://track/' || p_partkey AS uri, array_to_string(list_filter([{_NAMES_SQL}], lambda n: contains({_CREDITS}, n)), '|') AS artists, p_type AS album FROM part")
def ingest_dictionary_match(spark, sf_dir):
    return _flat(ingest.tracks_of(_library(spark, sf_dir))).select("uri", "artists", "album")


@query(f"SELECT doc_id, array_to_string(list_filter([{_NAMES_SQL}], lambda n: contains(text, n)), '|') AS names FROM documents")
def dictionary_in_texts(spark, sf_dir):
    return S.table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.dictionary_names(F.col("text"), ARTISTS), "|").alias("names"))


@query(f"{SQL}, new AS (SELECT DISTINCT 'library://track/' || (p_partkey * 2) AS uri, 'new' AS album FROM track) SELECT uri, album FROM track UNION ALL SELECT uri, album FROM new WHERE uri NOT IN (SELECT uri FROM track)")
def insert_ignore(spark, sf_dir):
    target = S.tracks(spark, sf_dir).select("uri", "album")
    part = S.table(spark, sf_dir, "part").select(F.concat(F.lit("library://track/"), (F.col("p_partkey") * 2).cast("string")).alias("uri"), F.lit("new").alias("album"))
    return sinks.insert_ignore(target, part.union(part), "uri")


@query(f"{SQL} SELECT uri, round(coalesce(CASE WHEN p_partkey % 3 = 0 THEN -p_partkey END, embedding[1]), 6) AS first FROM track")
def keyed_update(spark, sf_dir):
    part = S.table(spark, sf_dir, "part").where("p_partkey % 3 = 0")
    updates = part.select(_text("p_partkey").alias("uri"), F.array((-F.col("p_partkey")).cast("double")).alias("embedding"), F.lit(2).alias("n"))
    older = updates.select("uri", F.array(F.lit(0.5)), F.lit(1))
    found = sinks.keyed_update(S.tracks(spark, sf_dir), updates.union(older), "uri", "embedding", "n")
    return found.select("uri", F.round(F.get("embedding", F.lit(0)), 6).alias("first"))


@query(f"{SQL} SELECT uri AS key FROM skipped_songs UNION SELECT 'library://track/1' UNION SELECT 'new' UNION SELECT name FROM skipped_artists UNION SELECT 'Brand#9'")
def skip_feedback(spark, sf_dir):
    """A skip of a track that is skipped already or isn't, and of its artists; each key once."""
    songs = feedback.skip_track(feedback.skip_track(feedback.skip_track(S.skipped_songs(spark, sf_dir), "library://track/1"), "new"), "new")
    artists = feedback.skip_artists(feedback.skip_artists(S.skipped_artists(spark), ["Brand#3", "Brand#9", "Brand#9"]), [])
    return songs.select(F.col("uri").alias("key")).union(artists)


@query(f"{SQL} SELECT uri, name, album FROM track")
def publish_snapshot(spark, sf_dir):
    """A snapshot in a folder of its own and a JSON export, each written and read again."""
    folder = f"{work.base(spark)}/cadenza-published-{uuid.uuid4().hex}"
    kept = sinks.publish(S.tracks(spark, sf_dir).select("uri", "name", "album"), f"{folder}/tracks")
    sinks.write_json(kept.where("uri < 'library://track/5'"), f"{folder}/json")
    back = spark.read.schema(kept.schema).json(f"{folder}/json")
    return back.union(kept.where("not uri < 'library://track/5'"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_brand WHEN p_size % 4 = 1 THEN p_brand || '|' || p_type WHEN p_size % 4 = 2 THEN 'a, ' || p_brand ELSE '' END AS artists FROM part")
def work_list_artists(spark, sf_dir):
    """Artists of a work list as one name, a list with blanks, a name with a comma, or nothing."""
    size = F.col("p_size") % 4
    text = F.when(size == 0, F.col("p_brand")).when(size == 1, F.to_json(F.array("p_brand", F.lit(" "), "p_type"))).when(size == 2, F.concat(F.lit("a, "), "p_brand"))
    return S.table(spark, sf_dir, "part").select("p_partkey", F.array_join(tables.as_list(text), "|").alias("artists"))


@query(f"{SQL} SELECT uri FROM track WHERE embedding IS NULL")
def work_list_shuffle(spark, sf_dir):
    return ingest.shuffled(S.tracks(spark, sf_dir).where("embedding is null"), 3).select("uri")


def _listing(spark, sf_dir, numbered: bool):
    """Media keys of the tracks: artist/album/NN - name.ext."""
    t = S.tracks(spark, sf_dir).where(F.size("artists") > 0)
    number = F.format_string("%02d - ", F.pmod(F.crc32("uri"), F.lit(50)).cast("int"))
    ext = F.when(F.length("uri") % 2 == 0, F.lit(".MP3")).otherwise(F.lit(".txt")) if numbered else F.lit(".mp3")
    name = F.concat(number, F.upper(T.sanitize(F.col("name")))) if numbered else T.sanitize(F.col("name"))
    return t.select(F.concat_ws("/", T.sanitize(F.element_at("artists", -1)), T.sanitize(F.col("album")), F.concat(name, ext)).alias("key"))


@query(f"{SQL} SELECT uri, artists[-1] || '/' || replace(album, '/', '_') || '/' || k AS key FROM (SELECT *, upper(name) || '.MP3' AS k FROM track) WHERE len(artists) > 0 AND length(uri) % 2 = 0 AND false")
def media_match_none(spark, sf_dir):
    """Keys with other extensions match nothing."""
    keys = _listing(spark, sf_dir, False).select(F.regexp_replace("key", "mp3$", "txt").alias("key"))
    return ingest.match_media(S.tracks(spark, sf_dir), keys)


@query(f"{SQL} SELECT uri, artists[-1] || '/' || replace(album, '/', '_') || '/' || upper(name) || '.MP3' AS key FROM track WHERE len(artists) > 0 AND length(uri) % 2 = 0")
def media_match_remote(spark, sf_dir):
    """The key of each track, without the number in front of the file's name."""
    found = ingest.match_media(S.tracks(spark, sf_dir), _listing(spark, sf_dir, True))
    return found.select("uri", F.regexp_replace("key", r"/\d{2} - ([^/]*)$", "/$1").alias("key"))


@query(f"{SQL} SELECT uri, artists[-1] || '/' || album || '/' || name || '.mp3' AS key FROM track WHERE len(artists) > 0")
def media_match_local(spark, sf_dir):
    return ingest.match_media_exact(S.tracks(spark, sf_dir), _listing(spark, sf_dir, False))


@query("SELECT c_custkey, 'library://track/' || (CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN c_custkey ELSE c_custkey + 1 END) AS uri FROM customer WHERE c_custkey % 5 <> 0")
def queue_current_item(spark, sf_dir):
    key = F.col("c_custkey")
    item = lambda n: F.struct(F.struct(F.concat(F.lit("library://track/"), n.cast("string")).alias("uri"), F.array(F.struct(F.col("c_name").alias("name"))).alias("artists")).alias("media_item"))
    player = lambda active, n: F.struct(active.alias("active"), item(n).alias("current_item"))
    players = F.create_map(F.lit("z"), player((key % 2 == 0) & (key % 5 != 0), key), F.lit("b"), player(key % 5 != 0, key + 1))
    raw = S.table(spark, sf_dir, "customer").select("c_custkey", F.to_json(F.struct(players.alias("service_response"))).alias("body"))
    parsed = raw.select("c_custkey", F.from_json("body", tables.QUEUE)["service_response"].alias("service_response"))
    return ingest.current_item(parsed, "c_custkey").select("c_custkey", "uri")


@query(f"{SQL} SELECT uri, round(list_sum(embedding) * 2, 6) AS total FROM track WHERE embedding IS NOT NULL")
def embed_stub_mean(spark, sf_dir):
    three = lambda v: F.array(v, F.transform(v, lambda x: x * 2), F.transform(v, lambda x: x * 3))
    frames = S.tracks(spark, sf_dir).where("embedding is not null").select("uri", three(F.col("embedding")).alias("frames"))
    return ingest.frame_mean(frames).select("uri", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(f"{SQL} SELECT uri FROM track WHERE p_partkey % 4 <> 0")
def embed_resume(spark, sf_dir):
    done = S.table(spark, sf_dir, "part").where("p_partkey % 4 = 0").select(_text("p_partkey").alias("uri"), F.array(F.lit(0.1)).alias("embedding"))
    return ingest.to_embed(S.tracks(spark, sf_dir), done).select("uri")


@query(
    """WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS uri, hex(encode(text)) AS h FROM documents WHERE text <> ''),
pieces AS (SELECT uri, unnest(list_transform(range(0, CAST(ceil(length(h) / 8192.0) AS BIGINT)), lambda i: sha256(unhex(substr(h, CAST(8192 * i + 1 AS BIGINT), 8192))))) AS s FROM d),
bytes AS (SELECT uri, s, unnest(range(0, 16)) AS j FROM pieces),
means AS (SELECT uri, j, avg(CAST('0x' || substr(s, CAST(2 * j + 1 AS BIGINT), 2) AS INT) / 255.0) AS x FROM bytes GROUP BY uri, j)
SELECT uri, round(max(x) FILTER (j = 0), 4) AS first, round(sum(x), 4) AS total FROM means GROUP BY uri"""
)
def embed_documents(spark, sf_dir):
    """The pluggable embedder over whole texts, with the stub model."""
    files = S.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("uri"), F.col("text").cast("binary").alias("content"))
    v = F.col("embedding").cast("array<double>")
    return ingest.embed(files, 16).select("uri", F.round(F.element_at(v, 1), 4).alias("first"), F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query(
    f"""{SQL}, keys AS (SELECT uri, artists[-1] || '/' || album || '/' || name || '.mp3' AS key FROM track WHERE len(artists) > 0 AND embedding IS NULL),
bytes AS (SELECT uri, unnest(range(0, 16)) AS j, sha256(key) AS s FROM keys),
numbers AS (SELECT uri, j, CAST('0x' || substr(s, CAST(2 * j + 1 AS BIGINT), 2) AS INT) / 255.0 AS x FROM bytes)
SELECT uri, round(max(x) FILTER (j = 0), 4) AS first, round(sum(x), 4) AS total FROM numbers GROUP BY uri"""
)
def embed_store(spark, sf_dir):
    """The resumable job: a first run that ends early, and one that makes what is missing. A file's bytes are its key."""
    tracks = S.tracks(spark, sf_dir)
    listing = _listing(spark, sf_dir, False).distinct()
    files = listing.select("key", F.col("key").cast("binary").alias("content"))
    store = f"{work.base(spark)}/cadenza-embeddings-{uuid.uuid4().hex}"
    ingest.store_embeddings(tracks.where("crc32(uri) % 3 = 0"), listing, files, store, 16, rounds=1)
    done = ingest.store_embeddings(tracks, listing, files, store, 16, rounds=2)
    v = F.col("embedding").cast("array<double>")
    return done.select("uri", F.round(F.element_at(v, 1), 4).alias("first"), F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query(f"{SQL} SELECT 'UPDATE track SET embedding = ''[' || array_to_string(list_transform(embedding, lambda x: printf('%.6f', x)), ',') || ']''::vector WHERE uri = ''' || uri || ''';' AS value FROM track WHERE embedding IS NOT NULL")
def update_statements(spark, sf_dir):
    return sinks.update_statements(S.tracks(spark, sf_dir).where("embedding is not null"))


# ---------------------------------------------------------------- streams

_N = "(SELECT max(p_partkey) + 1 FROM part)"


@query(f"SELECT DISTINCT 'library://track/' || (event_id % {_N}) AS uri FROM events WHERE event_type = 'error'")
def stream_skip_upsert(spark, sf_dir):
    return stream.replay_skips(spark, sf_dir)


@query(f"{SQL} SELECT user_id, artist, CAST(count(*) AS BIGINT) AS n FROM (SELECT user_id, unnest(artists) AS artist FROM events JOIN track ON uri = 'library://track/' || (event_id % {_N}) WHERE event_type = 'click') GROUP BY ALL")
def stream_artist_state(spark, sf_dir):
    return stream.replay_artist_counts(spark, sf_dir)

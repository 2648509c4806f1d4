"""The track tables, made from the star schema's parts and the embeddings, on both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Searches ask with every track whose number is divisible by this.
EVERY = 100
FLOOR = 0.15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, vectors = table(spark, sf_dir, "part"), table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    artists = F.when(F.col("p_size") % 11 == 0, F.array().cast("array<string>")).when(F.col("p_size") % 5 == 0, F.array("p_brand", "p_type")).otherwise(F.array("p_brand"))
    number = F.col("p_partkey").cast("string")
    joined = part.join(vectors, part.p_partkey == vectors.vec_id, "left")
    return joined.select(_uri("p_partkey").alias("uri"), F.concat_ws(" ", "p_name", number).alias("name"), artists.alias("artists"), F.col("p_type").alias("album"), F.col("embedding").cast("array<double>").alias("embedding"))


def _uri(column: str):
    return F.concat(F.lit("library://track/"), F.col(column).cast("string"))


def liked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_size % 13 = 0").select(_uri("p_partkey").alias("uri"))


def skipped_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_size % 7 = 0").select(_uri("p_partkey").alias("uri"))


def skipped_artists(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES ('Brand#3'), ('Brand#7') AS t(name)")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query, vector: the query set of searches."""
    part, vectors = table(spark, sf_dir, "part").where(f"p_partkey % {EVERY} = 0"), table(spark, sf_dir, "embeddings")
    return part.join(vectors, part.p_partkey == vectors.vec_id).select(_uri("p_partkey").alias("query"), F.col("embedding").cast("array<double>").alias("vector"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query, seeds: one request for each group of 100 query tracks' numbers, with up to three seeds."""
    part = table(spark, sf_dir, "part").where(f"p_partkey % {EVERY} = 0")
    group = F.floor(F.col("p_partkey") / (3 * EVERY))
    return part.groupBy(F.concat(F.lit("r"), group.cast("string")).alias("query")).agg(F.sort_array(F.collect_list(_uri("p_partkey"))).alias("seeds"))


SQL = """
WITH RECURSIVE track AS (
  SELECT 'library://track/' || p_partkey AS uri, p_name || ' ' || p_partkey AS name,
    CASE WHEN p_size % 11 = 0 THEN CAST([] AS VARCHAR[]) WHEN p_size % 5 = 0 THEN [p_brand, p_type] ELSE [p_brand] END AS artists,
    p_type AS album, CAST(e.embedding AS DOUBLE[]) AS embedding, p_partkey
  FROM part p LEFT JOIN embeddings e ON e.vec_id = p.p_partkey
), liked AS (SELECT 'library://track/' || p_partkey AS uri FROM part WHERE p_size % 13 = 0
), skipped_songs AS (SELECT 'library://track/' || p_partkey AS uri FROM part WHERE p_size % 7 = 0
), skipped_artists AS (SELECT * FROM (VALUES ('Brand#3'), ('Brand#7')) t(name)
), asked AS (SELECT uri AS query, embedding AS vector FROM track WHERE p_partkey % 100 = 0 AND embedding IS NOT NULL
)"""


def cosine_sql(a: str, b: str) -> str:
    return f"greatest(-1, least(1, list_inner_product({a}, {b}) / sqrt(list_inner_product({a}, {a}) * list_inner_product({b}, {b}))))"


def hash_sql(*parts: str) -> str:
    return f"CAST(('0x' || substr(md5({" || ':' || ".join(parts)}), 1, 8)) AS UBIGINT) / 4294967296.0"


def unit_sql(v: str) -> str:
    return f"list_transform({v}, lambda x: x / CASE WHEN list_inner_product({v}, {v}) = 0 THEN 1 ELSE sqrt(list_inner_product({v}, {v})) END)"

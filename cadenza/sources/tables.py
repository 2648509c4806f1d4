"""Schemas and readers (SRC-*, D1 to D14)."""

from __future__ import annotations

import json
import os
import re
import urllib.request
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, SimpleDataSourceStreamReader

TRACK = "uri string, name string, artists array<string>, album string, embedding array<float>"
_ITEM = "media_type: string, uri: string, name: string, version: string, image: string"
_ARTIST = f"struct<{_ITEM}>"
_ALBUM = f"struct<{_ITEM}, artists: array<{_ARTIST}>>"
LIBRARY_TRACK = f"struct<{_ITEM}, artists: array<{_ARTIST}>, album: {_ALBUM}>"
LIBRARY = f"service_response struct<artists: array<{_ARTIST}>, albums: array<{_ALBUM}>, tracks: array<{LIBRARY_TRACK}>, playlists: array<{_ARTIST}>, radio: array<{_ARTIST}>, audiobooks: array<string>, podcasts: array<string>>"
_QUEUE_ITEM = f"struct<queue_item_id: string, name: string, duration: double, media_item: {LIBRARY_TRACK}, stream_title: string, stream_details: struct<content_type: string, sample_rate: int, bit_depth: int, provider: string, item_id: string>>"
QUEUE = f"service_response map<string, struct<queue_id: string, active: boolean, name: string, items: int, shuffle_enabled: boolean, repeat_mode: string, current_index: int, elapsed_time: double, current_item: {_QUEUE_ITEM}, next_item: {_QUEUE_ITEM}>>"


@dataclass(frozen=True)
class Config:
    """Where a deployment's tables and services are; the database is required, the webhook isn't (SRC-15)."""

    tables: str
    host: str | None = None
    token: str | None = None
    webhook: str | None = None
    dimension: int = 512

    def __post_init__(self) -> None:
        if not self.tables:
            raise ValueError("the folder of the tables is required")

    @classmethod
    def from_environment(cls, env: Mapping[str, str] | None = None) -> Config:
        """From DATABASE_URL (the tables' folder, required), HOST, TOKEN, WEBHOOK_URL and DIMENSION."""
        env = os.environ if env is None else env
        if not env.get("DATABASE_URL"):
            raise ValueError("DATABASE_URL is not set")
        return cls(env["DATABASE_URL"], env.get("HOST"), env.get("TOKEN"), env.get("WEBHOOK_URL"), int(env.get("DIMENSION") or 512))


def read_tracks(spark: SparkSession, path: str, dimension: int | None = None) -> DataFrame:
    """The track table; with ``dimension``, vectors of another length are an error when read."""
    tracks = spark.read.schema(TRACK).parquet(path)
    if dimension is None:
        return tracks
    wrong = F.col("embedding").isNotNull() & (F.size("embedding") != dimension)
    return tracks.withColumn("embedding", F.when(wrong, F.raise_error(F.lit(f"an embedding isn't {dimension} long")).cast("array<float>")).otherwise(F.col("embedding")))


def read_library(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LIBRARY).option("multiLine", True).json(path)


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUEUE).option("multiLine", True).json(path)


def read_work_list(spark: SparkSession, path: str) -> DataFrame:
    """A list of tracks; ``artists`` may be one name instead of a list (ARR-5), then ``artist`` too."""
    raw = spark.read.schema("uri string, name string, artists string, artist string, album string").option("multiLine", True).json(path)
    return raw.select("uri", "name", as_list(F.coalesce("artists", "artist")).alias("artists"), "album")


def as_list(text: Column) -> Column:
    """JSON text of a list of strings, or one plain string, as a list; null and blank names go."""
    some = F.when(text.rlike(r"^\s*\["), F.from_json(text, "array<string>")).otherwise(F.array(text))
    return F.filter(F.coalesce(some, F.array().cast("array<string>")), lambda a: a.isNotNull() & (F.trim(a) != ""))


def list_media(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """key, path, length of the files below a folder, with their bytes if asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(glob_quoted(path))
    folder = re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", path.rstrip("/"))
    key = F.regexp_replace("path", f"^.*?{folder}/", "")
    return files.select(key.alias("key"), "path", "length", *(["content"] if content else []))


def glob_quoted(path: str) -> str:
    """A path that stands for itself where a pattern is expected."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


class HttpJson(DataSource):
    """One JSON response of a POST request, as one row of text: options url, token, body.

    As a stream, each micro-batch is one request (STM-5).
    """

    @classmethod
    def name(cls) -> str:
        return "http_json"

    def schema(self) -> str:
        return "body string"

    def reader(self, schema) -> DataSourceReader:
        return _HttpReader(dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _HttpPoller(dict(self.options))


def _ask(options: dict) -> str:
    headers = {"Content-Type": "application/json"}
    if options.get("token"):
        headers["Authorization"] = f"Bearer {options['token']}"
    request = urllib.request.Request(options["url"], options.get("body", "{}").encode(), headers, method="POST")
    with urllib.request.urlopen(request, timeout=60) as response:
        return response.read().decode()


class _HttpReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def read(self, partition):
        yield (_ask(self.options),)


class _HttpPoller(SimpleDataSourceStreamReader):
    """Offsets count the requests. A response can't be asked for again, so a batch that is replayed after a crash is empty."""

    def __init__(self, options: dict) -> None:
        self.options = options

    def initialOffset(self) -> dict:
        return {"requests": 0}

    def read(self, start: dict):
        return iter([(_ask(self.options),)]), {"requests": start["requests"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([])


def fetch(spark: SparkSession, url: str, token: str | None, body: dict, schema: str) -> DataFrame:
    """A service's JSON response, parsed by an explicit schema."""
    spark.dataSource.register(HttpJson)
    raw = spark.read.format("http_json").options(url=url, token=token or "", body=json.dumps(body)).load()
    return raw.select(F.from_json("body", schema).alias("r")).select("r.*")


def poll(spark: SparkSession, url: str, token: str | None, body: dict, schema: str) -> DataFrame:
    """A service's responses as a stream, one for each micro-batch; its trigger sets how often it is asked."""
    spark.dataSource.register(HttpJson)
    raw = spark.readStream.format("http_json").options(url=url, token=token or "", body=json.dumps(body)).load()
    return raw.select(F.from_json("body", schema).alias("r")).select("r.*")

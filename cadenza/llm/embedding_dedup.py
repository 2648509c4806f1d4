"""Near-duplicate embeddings by cross-polytope hashing (operator 6).

Each table rotates the unit vectors pseudo-randomly (three rounds of random signs and a
fast Hadamard transform) and hashes them to the nearest of the 2d points of the
cross-polytope, several hashes to a table. A vector is also put into the buckets that its
second nearest points give (multiprobe). Vectors that share a bucket are compared by
cosine in double precision.

Vectors with equal components are one class first, aggregated before the shuffle. A
bucket's vectors are compared in tiles of bounded size, as matrix products; a bucket with
more vectors is cut into blocks, and every pair of blocks is a tile, so no pair is lost
and no task holds an unbounded bucket. Pairs aren't emitted: a tile gives each vector its
number of links and one edge to its group. A pair that meets in several buckets counts in
the smallest of them only.

The number of hashes to a table follows the logarithm of the number of vectors, so that
buckets stay small; the number of tables grows with it to keep recall: 4 tables of 1 or 2
hashes, 8 of 3, 16 of 4. Pairs with a cosine of 0.95 exactly, the least that links, then
share a bucket with a chance of 0.999 or more in 64 dimensions and of 0.993 or more in 256;
pairs that are closer with a higher one.

Defined results: vectors that are null, empty, zero or hold null or non-finite components
link with nothing; neither do vectors of different lengths. Copies link with each other.
Rows with a null vec_id take part, with a null id; repeated vec_ids are vectors of their
own whose component is the smallest id of the group. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import Workspace, components, lean, long_list, mix

COSINE = 0.95
TABLES = 4
BLOCK = 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (a power of two long), unscaled."""
    n, d = x.shape
    step = 1
    while step < d:
        x = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return x


def buckets(unit: np.ndarray, tables: int, hashes: int) -> np.ndarray:
    """Bucket numbers of each unit vector: in each table the nearest, and one for each hash's second nearest point."""
    n, dim = unit.shape
    width = 1 << max(1, math.ceil(math.log2(max(2, dim))))
    padded = np.zeros((n, width))
    padded[:, :dim] = unit
    rows = np.arange(n)
    rng = np.random.Generator(np.random.PCG64([6, dim]))
    out = []
    for table in range(tables):
        first, second = [], []
        for _ in range(hashes):
            x = padded
            for _ in range(3):
                x = hadamard(x * rng.choice([-1.0, 1.0], width))
            size = np.abs(x)
            best = size.argmax(axis=1)
            first.append(2 * best + (x[rows, best] < 0))
            size[rows, best] = -1
            best = size.argmax(axis=1)
            second.append(2 * best + (x[rows, best] < 0))
        for swapped in range(hashes + 1):
            code = np.full(n, (dim << 16) + table, np.uint64)
            for i in range(hashes):
                code = mix(code * np.uint64(0x9E3779B97F4A7C15) + (second if i + 1 == swapped else first)[i].astype(np.uint64))
            out.append(code)
    return np.stack(out, axis=1).view(np.int64)


def _matrix(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors (double) of one length at a time, without lists that can't be compared."""
    usable: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, value in enumerate(lists):
        if value.is_valid and len(value) and not value.values.null_count:
            vector = value.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if np.isfinite(vector).all() and (norm := np.abs(vector).max()) > 0 and np.isfinite(norm):
                usable.setdefault(len(vector), []).append((i, vector))
    for found in usable.values():
        yield np.array([i for i, _ in found]), np.stack([v for _, v in found])


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A key of the components for each vector that can link, null for others."""
    for batch in batches:
        keys: list = [None] * batch.num_rows
        for rows, vectors in _matrix(batch.column(1)):
            for i, vector in zip(rows.tolist(), vectors + 0.0):  # -0 as 0
                keys[i] = int(np.uint64(xxhash.xxh3_64_intdigest(vector.tobytes())).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64())], names=["vec_id", "v", "key"])


def _hash(tables: int, hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                for rows, vectors in _matrix(part.column(1)):
                    found = np.sort(buckets(_unit(vectors), tables, hashes), axis=1)
                    take = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(take), part.column(1).take(take), part.column(2).take(take), long_list(found.reshape(-1), np.full(len(rows), found.shape[1]))],
                        names=["key", "v", "m", "sig"],
                    )

    return run


def _tile(cosine: float):
    def compare(bucket: int, cross: bool, key: np.ndarray, block: np.ndarray, m: np.ndarray, vectors: np.ndarray, sig: list[np.ndarray]) -> tuple | None:
        unit = _unit(vectors)
        linked = unit @ unit.T >= cosine
        linked &= (block[:, None] != block[None, :]) if cross else ~np.eye(len(key), dtype=bool)
        hit = np.flatnonzero(linked.any(axis=1))
        if not len(hit):
            return None
        linked, m, key = linked[np.ix_(hit, hit)], m[hit], key[hit]
        # Pairs that share a smaller bucket count there.
        earlier = [sig[i][sig[i] < bucket] for i in hit]
        every = np.unique(np.concatenate(earlier))
        if len(every):
            has = np.zeros((len(hit), len(every)), np.float32)
            for i, found in enumerate(earlier):
                has[i, np.searchsorted(every, found)] = 1
            linked &= ~(has @ has.T > 0)
        links = linked @ m
        root, before = key, None
        while before is None or (root != before).any():
            before = root
            root = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1))
        some = links > 0
        return key[some], links[some], root[some]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        tile: tuple | None = None

        def close() -> pa.RecordBatch | None:
            table = pa.Table.from_batches(held).combine_chunks()
            column = {name: table.column(name).combine_chunks() if table.column(name).num_chunks != 1 else table.column(name).chunk(0) for name in table.column_names}
            vectors = [x.values.to_numpy(zero_copy_only=False).astype(np.float64) for x in column["v"]]
            size = len(vectors[0])
            if len(vectors) < 2 or any(len(v) != size for v in vectors):
                return None
            sig = [x.values.to_numpy(zero_copy_only=False) for x in column["sig"]]
            found = compare(tile[0], tile[1] != tile[2], column["key"].to_numpy(), column["block"].to_numpy(), column["m"].to_numpy(), np.stack(vectors), sig)
            return None if found is None else pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["key", "links", "root"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = [batch.column(i).to_numpy() for i in range(3)]
            change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in ids], axis=0)) + 1
            edges = [0, *change.tolist(), batch.num_rows]
            for lo, hi in zip(edges, edges[1:]):
                this = tuple(int(x[lo]) for x in ids)
                if tile is not None and this != tile:
                    if (out := close()) is not None:
                        yield out
                    held = []
                tile = this
                held.append(batch.slice(lo, hi - lo))
        if held and (out := close()) is not None:
            yield out

    return run


def near_duplicates(table: DataFrame, cosine: float = COSINE, tables: int = TABLES, block: int = BLOCK, hashes: int | None = None, work: Workspace | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``table`` (vec_id, embedding)."""
    work = work or Workspace(table.sparkSession)
    vectors = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").alias("v"))
    kind = dict(vectors.dtypes)["v"]
    if kind not in ("array<float>", "array<double>"):
        vectors, kind = vectors.withColumn("v", F.col("v").cast("array<double>")), "array<double>"
    keyed = vectors.mapInArrow(lean(_classes), f"vec_id bigint, v {kind}, key bigint")
    rows = work.keep(keyed.select("vec_id", "key"), "rows")
    least = F.min(F.struct(F.col("vec_id").isNull().alias("none"), "vec_id", "v"))
    classes = work.keep(keyed.where("key is not null").groupBy("key").agg(least.alias("r"), F.count("*").alias("m")).select("key", F.col("r.v").alias("v"), "m", F.col("r.vec_id").alias("first")), "classes")

    count = max(2, classes.count())
    length = classes.agg(F.max(F.size("v"))).first()[0] or 2
    hashes = hashes or max(1, round(math.log(count) / math.log(2 * max(2, length))))
    tables *= 2 ** max(0, hashes - 2)
    hashed = work.keep(classes.select("key", "v", "m").mapInArrow(lean(_hash(tables, hashes)), f"key bigint, v {kind}, m bigint, sig array<bigint>"), "hashed")
    places = hashed.select("key", F.explode(F.array_distinct("sig")).alias("bucket"))
    sizes = work.keep(places.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    shared = places.join(sizes, "bucket").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    cut = shared.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    met = cut.select("key", "bucket", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tiles = met.select("key", "bucket", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    full = tiles.join(hashed, "key").select("bucket", "i", "j", "block", "key", "m", "v", "sig")
    dealt = full.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    found = work.keep(dealt.mapInArrow(lean(_tile(cosine)), "key bigint, links bigint, root bigint"), "found")

    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    groups = components(found.where("key <> root").select(F.col("key").alias("a"), F.col("root").alias("b")), work)
    each = classes.select("key", "first", "m").join(links, "key", "left").join(groups, classes.key == groups.id, "left").select("key", "first", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "key").alias("group"))
    each = work.keep(each, "each")
    named = work.keep(each.groupBy("group").agg(F.min("first").alias("component_id")), "named")
    known = work.keep(each.join(named, "group").select("key", "n_links", "component_id"), "known")
    work.only("rows", "known")
    inside = rows.where("key is not null").join(known, "key").select("vec_id", "n_links", "component_id")
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return inside.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

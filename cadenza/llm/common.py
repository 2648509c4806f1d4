"""Shared parts of the training-data operators: work tables, word arrays, components.

Work tables cut lineage: they are written as Parquet below the folder that the
cluster names in ``spark.checkpoint.dir``, so a lost executor costs the tasks of the
running stage and never an earlier one.

The word functions read the UTF-8 bytes of an Arrow string column as one numpy array.
Words are runs of bytes of a class; all of the classes in use are decided by ASCII
bytes alone, so every byte of 0x80 and more counts as part of a word.
"""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.session import ship
from cadenza.sources.work import base, delete

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a batch for Python workers, which hold a few copies of one; a longer row is a batch of its own.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def prepare(spark: SparkSession) -> None:
    """Send the code to the executors, and keep batches small unless the session has its own size."""
    ship(spark)
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, BATCH_BYTES)


class Workspace:
    """Tables of one run below ``spark.checkpoint.dir`` (a temporary folder in a session on one machine without it).

    A result may read some of them when it is written, so whoever gave the workspace
    releases it after that. What is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        prepare(spark)
        self.spark = spark
        self.root = f"{base(spark)}/cadenza-{uuid.uuid4().hex}"
        self.names: set[str] = set()
        _open[self.root] = self

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back; its shuffle files go once it is written."""
        path = f"{self.root}/{name}"
        self.names.add(name)
        self.append(df, path)
        return self.spark.read.schema(df.schema).parquet(path)

    def append(self, df: DataFrame, path: str) -> None:
        """Add ``df`` to the table in ``path``."""
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("append").option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        self.names.discard(name)
        delete(self.spark, f"{self.root}/{name}")

    def only(self, *names: str) -> None:
        """Delete all tables but these."""
        for name in self.names - {*names}:
            self.drop(name)

    def release(self) -> None:
        """Delete all tables; results that read them must have been written before."""
        _open.pop(self.root, None)
        delete(self.spark, self.root)


_open: dict[str, Workspace] = {}


@atexit.register
def _release_all() -> None:
    for work in list(_open.values()):
        try:
            work.release()
        except Exception:  # noqa: BLE001  the session has ended before, nothing can be deleted through it
            _open.clear()


# ---------------------------------------------------------------- memory of Python workers

_resident: dict[str, object] = {}


def resident(key: str, make: Callable):
    """What ``make`` gives, kept in a worker between its tasks. A key is an operator, a colon and a name.

    Spark uses a worker for one operator after the other, so an operator's tables go when
    another one asks for its own; without this a worker would hold the tables of all.
    """
    if key not in _resident:
        others = [k for k in _resident if k.partition(":")[0] != key.partition(":")[0]]
        for other in others:
            del _resident[other]
        if others:
            trim()
        _resident[key] = make()
    return _resident[key]


def trim() -> None:
    """Give memory that is free back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run: Callable) -> Callable:
    """``run`` for Arrow batches, with its free memory given back when a task ends."""

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return lean_run


# ---------------------------------------------------------------- words as arrays

_BYTES = np.arange(256)
#: Words of ``[^\x20\x09-\x0D]+``.
NOT_SPACE = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
#: Words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` in text with A-Z lower-cased.
ALNUM = (
    ((_BYTES >= 0x30) & (_BYTES <= 0x39))
    | ((_BYTES >= 0x61) & (_BYTES <= 0x7A))
    | ((_BYTES >= 0x41) & (_BYTES <= 0x5A))
    | (_BYTES >= 0x80)
)
#: A-Z to a-z, other bytes unchanged.
FOLD = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)



def alnum(data: np.ndarray) -> np.ndarray:
    """``ALNUM[data]`` by comparisons, which are faster than a look-up of each byte."""
    return ((data | np.uint8(0x20)) - np.uint8(0x61) < 26) | (data - np.uint8(0x30) < 10) | (data >= 0x80)


_GRAM = np.uint64(0xD6E8FEB86659FD93)
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: The first 0 to 8 bytes of a little-endian number.
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Longer words are hashed one by one.
_LONG = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser that spreads every input bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def strings(column: pa.Array) -> pa.Array:
    """The column as one plain string array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column, "") if column.null_count else column


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array and the offsets of its rows in them."""
    column = strings(column)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), offs - offs[0]
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def slices(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows [lo, hi) with their bytes, about ``limit`` bytes at a time (one row at least)."""
    data, offs = text_bytes(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def word_spans(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the index of each row's first word (one more at the end)."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    w = is_word[data]
    begins, ends = w.copy(), w.copy()
    begins[1:] &= ~w[:-1]
    ends[:-1] &= ~w[1:]
    at = offs[offs < n]
    begins[at] = w[at]
    at = offs[offs > 0] - 1
    ends[at] = w[at]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """A 64-bit hash of each word's bytes, eight at a time; ``fold`` takes A-Z as a-z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:-8] = data
    if fold:
        padded[:-8] += (data - np.uint8(0x41) < 26).view(np.uint8) << np.uint8(5)  # FOLD[data], without a look-up of each byte
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place
    lens = ends - starts
    out = eight[starts]
    out &= _MASK[np.minimum(lens, 8)]
    out ^= lens.astype(np.uint64) * _GRAM
    out *= _ODD
    rows, done = np.flatnonzero((lens > 8) & (lens <= _LONG)), 8
    while len(rows):
        more, left = out[rows], lens[rows] - done
        more ^= more >> np.uint64(32)
        more ^= eight[starts[rows] + done] & _MASK[np.minimum(left, 8)]
        out[rows] = more * _ODD
        rows, done = rows[left > 8], done + 8
    for row in np.flatnonzero(lens > _LONG):
        out[row] = xxhash.xxh3_64_intdigest(padded[starts[row] : ends[row]].tobytes())
    return mix(out)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words, whatever row they stand in."""
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= _GRAM
        out += words[j : j + n]
    return mix(out)


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's k-word shingles, and the offsets of the rows in them.

    A row with fewer words has its whole sequence as one shingle; one without words none.
    """
    n_words = np.diff(first)
    size = np.where(n_words >= k, n_words - k + 1, (n_words > 0).astype(np.int64))
    offs = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(int(offs[-1]), np.uint64)
    short = (n_words > 0) & (n_words < k)
    place = np.arange(len(words))
    whole = place + k <= np.repeat(first[1:], n_words)
    grams = gram_hashes(words, k)
    mask = np.ones(len(out), bool)
    mask[offs[:-1][short]] = False
    out[mask] = grams[place[whole]]
    for row in np.flatnonzero(short):
        part = words[first[row] : first[row + 1]]
        out[offs[row]] = gram_hashes(part, len(part))[0] ^ np.uint64(len(part))
    return out, offs


def long_list(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """An array<bigint> column from flat values and the size of each row."""
    offs = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values.astype(np.int64, copy=False)))


# ---------------------------------------------------------------- components


def components(edges: DataFrame, work: Workspace, name: str = "cc") -> DataFrame:
    """(id, component): the smallest id reachable over the undirected edges (a, b).

    Each round takes the smallest label among a node's neighbours and then the label of
    that label; the number of rounds grows with the logarithm of a component's diameter.
    Aggregation is partial before the shuffle, so a hub costs no task more than others.
    """
    both = work.keep(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(),
        f"{name}-edges",
    )
    labels = work.keep(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")), f"{name}-0")
    step = 0
    while True:
        step += 1
        around = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("label").alias("m"))
        near = labels.join(around, labels.id == around.a).select("id", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("up"))
        new = work.keep(near.join(up, "label").select("id", "old", F.least("label", "up").alias("label")), f"{name}-{step}")
        work.drop(f"{name}-{step - 1}")
        if new.where("old <> label").isEmpty():
            work.drop(f"{name}-edges")
            return new.select("id", F.col("label").alias("component"))
        labels = new.select("id", "label")

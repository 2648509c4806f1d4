"""Near-duplicate documents by min-max hashing (operator 3).

Every permutation of the shingle hashes gives two signature values, its minimum and its
maximum, so 32 hash evaluations per shingle fill the 64 values of the signature. Four
values make a band: two documents of similarity 0.85 miss all 16 bands with a chance of
about 7e-6. Documents that share a band are candidates; links are confirmed on the full
shingle sets.

Scale: documents with equal shingle sets are one class first (aggregated before the
shuffle), and only class representatives are compared. A band's bucket isn't expanded
into pairs: its members meet the one member that shares most buckets with others (the
centre of a group of edited copies shares more than any other). Where a bucket's members
are then still in different components, their sets are packed into blocks that are bounded
in sets and in shingles, every block is compared with itself and every other as a tile, by
matrix products, and a tile gives only the components that it joins. So no link within a
bucket is lost, a tile reads two rows at most, and pairs are never rows.
Text is shuffled once, for candidates alone after that.

Defined results: a null text has no words; a document without words has no shingles,
its own id as component, and is kept. With fewer than five words, the whole sequence is
the one shingle. Rows with a null id are never linked: component null, kept. Rows that
repeat an id are each linked by their own text. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import NOT_SPACE, Workspace, components, lean, long_list, mix, shingles, slices, word_hashes, word_spans

PERMUTATIONS, ROWS, BANDS = 32, 4, 16
SHINGLE = 5
PERCENT = 85
#: Sets and shingles in a block of a bucket (about, and one set at least), and shingles in a step of a tile's product.
BLOCK, BLOCK_SHINGLES, STEP = 512, 1 << 18, 8192
SIGNED = "doc_id bigint, tk bigint, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>"

_rng = np.random.Generator(np.random.PCG64(85))
_XOR = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + _rng.integers(0, 2, PERMUTATIONS, dtype=np.uint64)
_ODD = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WEIGHT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def signatures(grams: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Minimum and maximum under each permutation, for rows that have shingles."""
    out = np.empty((len(offs), 2 * PERMUTATIONS), np.uint64)
    for k in range(PERMUTATIONS):
        h = (grams ^ _XOR[k]) * _ODD[k]
        out[:, 2 * k] = np.minimum.reduceat(h, offs)
        out[:, 2 * k + 1] = np.maximum.reduceat(h, offs)
    return out


def band_hashes(signature: np.ndarray) -> np.ndarray:
    bands = signature.reshape(len(signature), BANDS, ROWS)
    return mix((bands * _WEIGHT).sum(axis=2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def shingle_sets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = word_spans(data, offs, NOT_SPACE)
    return shingles(word_hashes(data, starts, ends, fold=True), first, SHINGLE)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offs in slices(batch.column(1)):
            grams, at = shingle_sets(data, offs)
            size = np.diff(at)
            full = np.flatnonzero(size)
            n, digest = np.zeros(hi - lo, np.int64), np.zeros((hi - lo, 2), np.int64)
            for row in full:
                found = np.unique(grams[at[row] : at[row + 1]])
                n[row] = len(found)
                digest[row] = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64)
            bands = band_hashes(signatures(grams, at[:-1][full])) if len(full) else np.zeros((0, BANDS), np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[lo:hi], batch.column(2)[lo:hi], pa.array(n), pa.array(digest[:, 0]), pa.array(digest[:, 1]), long_list(bands.reshape(-1).view(np.int64), np.where(size > 0, BANDS, 0))],
                names=["doc_id", "tk", "n_shingles", "d1", "d2", "bands"],
            )


def _sets(column: pa.Array) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for lo, hi, data, offs in slices(column):
        grams, at = shingle_sets(data, offs)
        out += [np.unique(grams[at[i] : at[i + 1]]) for i in range(hi - lo)]
    return out


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_id, kept_set = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            linked = []
            for lo in range(0, len(a), 256):
                hi = min(lo + 256, len(a))
                new = [i for i in range(lo, hi) if b[i] != (b[i - 1] if i else kept_id)]
                sets = dict(zip(new, _sets(batch.column(3).take(pa.array(new, pa.int64()))) if new else []))
                for i, x in enumerate(_sets(batch.column(2)[lo:hi]), lo):
                    if i in sets:
                        kept_id, kept_set = b[i], sets[i]
                    shared = len(np.intersect1d(x, kept_set, assume_unique=True))
                    linked.append(100 * shared >= percent * (len(x) + len(kept_set) - shared))
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            sets = _sets(batch.column(1)[lo : lo + 500])
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0)[lo : lo + 500], long_list(flat.view(np.int64), np.array([len(x) for x in sets], np.int64))], names=["id", "grams"])


def joined(labels: np.ndarray, sets: list[np.ndarray], percent: int, cut: int | None = None) -> np.ndarray:
    """The label of each set after links between the sets, the smallest of those that they join.

    With ``cut``, only links between the first ``cut`` sets and the others count.
    """
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    useful = often > 1
    column = np.where(useful, np.cumsum(useful) - 1, -1)[column]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    a, b = (slice(0, cut), slice(cut, None)) if cut else (slice(None), slice(None))
    shared = np.zeros((len(size[a]), len(size[b])), np.float32)
    for lo in range(0, int(useful.sum()), STEP):
        part = slice(*np.searchsorted(column, [lo, lo + STEP]))
        has = np.zeros((len(sets), STEP), np.float32)
        has[owner[part], column[part] - lo] = 1
        shared += has[a] @ has[b].T
    shared = shared.astype(np.int64)
    linked = 100 * shared >= percent * (size[a][:, None] + size[b][None, :] - shared)
    out, before = labels.copy(), None
    while before is None or (out != before).any():
        before = out.copy()
        out[a] = np.minimum(out[a], np.where(linked, out[b][None, :], np.iinfo(np.int64).max).min(axis=1))
        out[b] = np.minimum(out[b], np.where(linked, out[a][:, None], np.iinfo(np.int64).max).min(axis=0))
    return out


PACKED = "bh bigint, block int, blocks int, labels array<bigint>, sizes array<bigint>, grams array<bigint>"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block of a bucket; rows come sorted by bucket and block."""
    held: list[tuple] = []

    def close() -> pa.RecordBatch:
        bh, block, blocks = held[0][:3]
        sets = [row[4] for row in held]
        lists = [np.array([row[3] for row in held]), np.array([len(x) for x in sets]), np.concatenate(sets)]
        return pa.RecordBatch.from_arrays(
            [pa.array([bh]), pa.array([block], pa.int32()), pa.array([blocks], pa.int32()), *(long_list(x, np.array([len(x)])) for x in lists)],
            names=["bh", "block", "blocks", "labels", "sizes", "grams"],
        )

    for batch in batches:
        sets = [x.values.to_numpy(zero_copy_only=False) for x in batch.column(4)]
        for row in zip(*(batch.column(i).to_pylist() for i in range(4)), sets):
            if held and held[0][:2] != row[:2]:
                yield close()
                held = []
            held.append(row)
    if held:
        yield close()


def _tile(percent: int):
    """Edges between labels from tiles of one block or two; rows come sorted by tile."""

    def close(held: list[tuple]) -> pa.RecordBatch | None:
        labels = np.concatenate([row[3] for row in held])
        if len(np.unique(labels)) < 2 or held[0][1] != held[0][2] and len(held) < 2:
            return None
        sets = [x for row in held for x in np.split(row[5], np.cumsum(row[4])[:-1])]
        after = joined(labels, sets, percent, len(held[0][3]) if len(held) > 1 else None)
        edges = sorted({(int(a), int(b)) for a, b in zip(labels, after) if a != b})
        return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], names=["a", "b"]) if edges else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            lists = [[x.values.to_numpy(zero_copy_only=False) for x in batch.column(i)] for i in (3, 4, 5)]
            for row in zip(*(batch.column(i).to_pylist() for i in range(3)), *lists):
                if held and held[0][:3] != row[:3]:
                    if (out := close(held)) is not None:
                        yield out
                    held = []
                held.append(row)
        if held and (out := close(held)) is not None:
            yield out

    return run


def near_duplicates(docs: DataFrame, percent: int = PERCENT, work: Workspace | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    return linked_rows(docs, percent, work).drop("tk")


def linked_rows(docs: DataFrame, percent: int = PERCENT, work: Workspace | None = None) -> DataFrame:
    """The same with tk, a hash of the text, which tells rows with one doc_id apart."""
    work = work or Workspace(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tk", F.xxhash64("text"))
    signed = work.keep(texts.mapInArrow(lean(_sign), SIGNED), "signed")
    real = signed.where("n_shingles > 0 and doc_id is not null")
    # One representative for each class of equal sets, with its bands, aggregated before the shuffle.
    # Classes are named by their digest, as a repeated doc_id can stand for several.
    classes = work.keep(real.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "tk", "n_shingles", "bands")).alias("r")).select("d1", "d2", "r.*"), "classes")
    rows = classes.select(F.col("d1").alias("id"), F.col("n_shingles").alias("n"), F.explode("bands").alias("bh"))
    # Aggregates are written before they are joined, so that a join can split a hot bucket.
    sizes = work.keep(rows.groupBy("bh").agg(F.count("*").alias("m")).where("m > 1"), "sizes")
    shared = work.keep(rows.join(sizes, "bh"), "shared")
    weight = shared.groupBy("id").agg(F.sum("m").alias("w"))
    members = work.keep(shared.join(weight, "id").select("bh", "id", "n", "w"), "members")
    work.drop("shared")
    centre = members.groupBy("bh").agg(F.max(F.struct("w", F.bitwise_not("id").alias("neg"), "n")).alias("c"))
    centre = work.keep(centre.select("bh", F.bitwise_not("c.neg").alias("b"), F.col("c.n").alias("nb")), "centre")
    close = F.least("n", "nb") * 100 >= F.greatest("n", "nb") * percent
    pairs = work.keep(members.join(centre, "bh").where((F.col("id") != F.col("b")) & close).select(F.col("id").alias("a"), "b").distinct(), "pairs")

    # Sort-merge joins, whatever the size: the text's side is never small, the ids' grow with it.
    ids = members.select("id").distinct().hint("merge").join(classes.select(F.col("d1").alias("id"), "doc_id", "tk"), "id")
    candidates = work.keep(texts.join(ids.hint("merge"), ["doc_id", "tk"]).select("id", "text"), "candidates")
    left, right = candidates.toDF("a", "text_a"), candidates.toDF("b", "text_b")
    both = pairs.hint("merge").join(left, "a").hint("merge").join(right, "b").select("a", "b", "text_a", "text_b")
    links = work.keep(both.mapInArrow(lean(_verify(percent)), "a bigint, b bigint"), "links")

    groups = components(links, work, "star")
    labelled = members.join(groups, "id", "left").select("bh", "id", "n", F.coalesce("component", "id").alias("label"))
    state = labelled.groupBy("bh").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("m"), F.sum("n").alias("all_n"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("all")).where("x <> y")
    # Buckets with the same members need to be looked at once.
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("all_n") / BLOCK_SHINGLES)).cast("int")
    mixed = work.keep(state.groupBy("m", "all_n", "all").agg(F.min("bh").alias("bh")).select("bh", blocks.alias("blocks")), "mixed")
    open_rows = work.keep(labelled.join(mixed, "bh"), "open")
    if not open_rows.isEmpty():
        need = open_rows.select("id").distinct()
        sets = candidates.join(need.hint("merge"), "id", "left_semi").mapInArrow(lean(_gather), "id bigint, grams array<bigint>")
        block = open_rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        placed = block.hint("merge").join(sets, "id").select("bh", "block", "blocks", "label", "grams")
        packed = work.keep(placed.repartition("bh", "block").sortWithinPartitions("bh", "block").mapInArrow(lean(_pack), PACKED), "packed")
        alone = packed.where("blocks = 1").select("bh", F.lit(0).alias("i"), F.lit(0).alias("j"), "labels", "sizes", "grams")
        others = packed.where("blocks > 1").select("bh", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "labels", "sizes", "grams")
        tiles = others.select("bh", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "labels", "sizes", "grams")
        edges = "a bigint, b bigint"
        more = alone.mapInArrow(lean(_tile(percent)), edges).union(tiles.repartition("bh", "i", "j").sortWithinPartitions("bh", "i", "j").mapInArrow(lean(_tile(percent)), edges))
        more = work.keep(more, "more")
        work.drop("packed")
        if not more.isEmpty():
            groups = components(links.union(more), work, "all")
    work.drop("candidates")

    named = work.keep(classes.select("d1", "d2", "doc_id").join(groups, classes.d1 == groups.id, "left").select("d1", "d2", "doc_id", F.coalesce("component", "d1").alias("component")), "named")
    first = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = real.select("doc_id", "tk", "n_shingles", "d1", "d2").join(named.join(work.keep(first, "first"), "component").select("d1", "d2", "component_id"), ["d1", "d2"])
    alone = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "tk", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.select("doc_id", "tk", "n_shingles", "component_id").union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

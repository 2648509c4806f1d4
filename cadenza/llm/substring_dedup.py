"""Removal of passages that an earlier document already has (operator 4).

A window is ``n`` consecutive words of one document. Every word covered by a window whose
word sequence also starts in a document with a smaller doc_id is removed; windows are
judged on the input.

Matching is done by suffix automata: an automaton holds reference passages, each state
knows the smallest doc_id among the places that end there, and passages are streamed
through it for matching statistics; where the statistic reaches ``n`` words, the state of
the last ``n`` words tells the first document of that window. ``remove_reference`` does
this with shards of a given reference, one broadcast automaton after the other.

Against the corpus itself, broadcasting an automaton of each shard to all documents
would read every document once per shard, so work would grow with the square of the
corpus. ``remove_repeats`` therefore routes instead of broadcasting. In each window the
smallest of its 6-word hashes is the window's anchor; equal windows have equal anchors.
Runs of windows with one anchor form a passage of about 17 words. Only passages whose
anchor occurs in two documents are kept (a count over all documents), passages with equal
words are merged with their smallest doc_id before the shuffle, and each anchor's
distinct passages make the shard that its automaton is built on. An anchor with very many
distinct passages isn't put into one task: its windows are grouped one by one instead.

Text is shuffled once; after that only documents with a shared anchor are read again.

Defined results: a null text has no words and an empty kept text. Documents with fewer
than ``n`` words lose nothing. Rows with a null doc_id lose nothing and are no reference.
Rows that repeat a doc_id never remove each other's words. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import NOT_SPACE, Workspace, gram_hashes, lean, long_list, slices, strings, word_hashes, word_spans

WINDOW = 13
GRAM = 6
#: Distinct passages of one anchor above which its windows are grouped one by one.
SHARD_PASSAGES = 2048
#: Words of a broadcast automaton, about 0.5 KB each in a worker, and words of a piece of a reference text.
SHARD_WORDS, PIECE = 200_000, 5_000


class SuffixAutomaton:
    """Suffix automaton of several word sequences, with the smallest label per state."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.low: list[float] = [float("inf")]

    def _copy(self, state: int, length: int) -> int:
        self.next.append(dict(self.next[state]))
        self.link.append(self.link[state])
        self.length.append(length)
        self.low.append(float("inf"))
        return len(self.link) - 1

    def _redirect(self, p: int, word: object, old: int) -> int:
        """The state for the sequences that reach ``old`` from ``p`` and above, split off if needed."""
        if self.length[p] + 1 == self.length[old]:
            return old
        new = self._copy(old, self.length[p] + 1)
        self.link[old] = new
        while p >= 0 and self.next[p].get(word) == old:
            self.next[p][word] = new
            p = self.link[p]
        return new

    def add(self, words: list, label: int) -> None:
        last = 0
        for word in words:
            known = self.next[last].get(word)
            if known is not None:
                last = self._redirect(last, word, known)
            else:
                self.next.append({})
                self.link.append(0)
                self.length.append(self.length[last] + 1)
                self.low.append(float("inf"))
                state, p = len(self.link) - 1, last
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = state
                    p = self.link[p]
                if p >= 0:
                    self.link[state] = self._redirect(p, word, self.next[p][word])
                last = state
            self.low[last] = min(self.low[last], label)

    def finish(self) -> SuffixAutomaton:
        """Pass labels from longer sequences to their suffixes."""
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            up = self.link[state]
            if self.low[state] < self.low[up]:
                self.low[up] = self.low[state]
        return self

    def first_labels(self, words: list, n: int) -> list:
        """For each window of n words: the smallest label of its occurrences (inf: none)."""
        out, state, matched = [], 0, 0
        follow, link, length = self.next, self.link, self.length
        for i, word in enumerate(words):
            while state and word not in follow[state]:
                state = link[state]
                matched = length[state]
            if word in follow[state]:
                state = follow[state][word]
                matched += 1
            if matched >= n:
                while length[link[state]] >= n:
                    state = link[state]
                matched = min(matched, length[state])
            if i >= n - 1:
                out.append(self.low[state] if matched >= n else float("inf"))
        return out


def _runs(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: row, anchor hash, first window, last window (words from 0 in the row)."""
    starts, ends, first = word_spans(data, offs, NOT_SPACE)
    words = word_hashes(data, starts, ends, fold=False)
    gram = min(GRAM, n)
    n_windows = len(words) - n + 1
    if n_windows <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    grams = gram_hashes(words, gram)
    best = np.arange(len(grams))
    width, span = n - gram + 1, 1
    while span < width:  # the leftmost smallest of each `span` hashes, by doubling
        step = min(span, width - span)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(grams[left] <= grams[right], left, right)
        span += step
    best = best[:n_windows]
    row = np.repeat(np.arange(len(offs) - 1), np.diff(first))[:n_windows]
    inside = np.flatnonzero(np.arange(n_windows) + n <= first[row + 1])
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    at, of = best[inside], row[inside]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (of[1:] != of[:-1])]))
    last = np.concatenate([new[1:], [len(inside)]]) - 1
    of = of[new]
    return of, grams[at[new]].view(np.int64), inside[new] - first[of], inside[last] - first[of]


def _anchors(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offs in slices(batch.column(1)):
                row, anchor, _, _ = _runs(data, offs, n)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), ids[lo:hi].take(pa.array(row))], names=["anchor", "doc_id"])

    return run


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words joined by one space for rows without shared anchors; the others keep their text."""
    for batch in batches:
        texts, shared = strings(batch.column(2)), batch.column(3)
        counts, out = [], []
        for text, keep in zip(texts, shared.is_valid().to_pylist()):
            raw = text.as_buffer().to_pybytes()
            words = raw.split()
            counts.append(len(words))
            out.append(raw if keep else b" ".join(words))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(out, pa.binary()).cast(pa.string()), shared, *batch.columns[4:]],
            names=["doc_id", "tk", "n_words", "text", "anchors", *batch.schema.names[4:]],
        )


def _passages(n: int, with_text: bool):
    """Passages whose anchor is among the row's shared ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, texts, shared = batch.column(0), batch.column(1), strings(batch.column(2)), batch.column(3)
            for lo, hi, data, offs in slices(texts):
                row, anchor, begin, end = _runs(data, offs, n)
                edges = np.searchsorted(row, np.arange(hi - lo + 1))
                keep = np.zeros(len(row), bool)
                for i in range(hi - lo):
                    part = slice(edges[i], edges[i + 1])
                    keep[part] = np.isin(anchor[part], shared[lo + i].values.to_numpy())
                row, anchor, begin, end = row[keep], anchor[keep], begin[keep], end[keep]
                raw, out, seen, words = data.tobytes(), [], -1, []
                for i, b, e in zip(row.tolist(), begin.tolist(), end.tolist()):
                    if i != seen:
                        seen, words = i, raw[offs[i] : offs[i + 1]].split()
                    out.append(b" ".join(words[b : e + n]))
                take = pa.array(row + lo)
                if with_text:
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(out, pa.binary()).cast(pa.string()), ids.take(take)], names=["anchor", "passage", "doc_id"])
                else:
                    digest = np.array([xxhash.xxh3_64_intdigest(x) for x in out], np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(digest), ids.take(take), keys.take(take), pa.array(begin)], names=["anchor", "digest", "doc_id", "tk", "start"])

    return run


def _match(n: int):
    """First documents of every window, one automaton for each anchor; rows come sorted by anchor."""

    def shard(group: list[tuple[int, str, int, int]]) -> Iterator[tuple]:
        if len(group) == 1:
            anchor, passage, low, high = group[0]
            if low < high:
                yield anchor, xxhash.xxh3_64_intdigest(passage), [low] * (passage.count(" ") + 2 - n)
            return
        if len({x for g in group for x in g[2:]}) < 2:
            return
        automaton = SuffixAutomaton()
        split = [(g[1].split(" "), g) for g in group]
        for words, g in split:
            automaton.add(words, g[2])
        automaton.finish()
        for words, (anchor, passage, _, high) in split:
            firsts = automaton.first_labels(words, n)
            if min(firsts) < high:
                yield anchor, xxhash.xxh3_64_intdigest(passage), firsts

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array(np.array([r[1] for r in rows], np.uint64).view(np.int64)),
                long_list(np.array([x for r in rows for x in r[2]], np.int64), np.array([len(r[2]) for r in rows], np.int64)),
            ],
            names=["anchor", "digest", "firsts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            rows: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and group[0][0] != row[0]:
                    rows.extend(shard(group))
                    group = []
                group.append(row)
            yield emit(rows)
        if group:
            yield emit(list(shard(group)))

    return run


def _windows(n: int):
    """The windows of hot anchors' passages, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors, digests, places, windows, lows = [], [], [], [], []
            for anchor, passage, low, _ in zip(*(c.to_pylist() for c in batch.columns)):
                words = passage.split(" ")
                digest = int(np.uint64(xxhash.xxh3_64_intdigest(passage)).view(np.int64))
                for i in range(len(words) - n + 1):
                    anchors.append(anchor)
                    digests.append(digest)
                    places.append(i)
                    windows.append(xxhash.xxh3_128_digest(" ".join(words[i : i + n])))
                    lows.append(low)
            yield pa.RecordBatch.from_arrays([pa.array(anchors, pa.int64()), pa.array(digests, pa.int64()), pa.array(places, pa.int32()), pa.array(windows, pa.binary()), pa.array(lows, pa.int64())], names=["anchor", "digest", "i", "w", "low"])

    return run


def _remove(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for doc, text, hits in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                words = text.as_buffer().to_pybytes().split()
                cover = np.zeros(len(words) + 1, np.int64)
                if hits.is_valid:
                    for hit in hits.as_py():
                        for i, low in enumerate(hit["firsts"], hit["start"]):
                            if low < doc:
                                cover[i] += 1
                                cover[i + n] -= 1
                gone = np.cumsum(cover[:-1]) > 0
                removed.append(int(gone.sum()))
                kept.append(b" ".join(w for w, x in zip(words, gone.tolist()) if not x) if removed[-1] else b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), *batch.columns[4:]],
                names=["doc_id", "n_words", "n_removed", "kept_text", *batch.schema.names[4:]],
            )

    return run


def remove_repeats(docs: DataFrame, n: int = WINDOW, extra: tuple[str, ...] = (), work: Workspace | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text for every row of ``docs`` (doc_id, text).

    ``extra`` names columns of ``docs`` that the result has too.
    """
    work = work or Workspace(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("tk"), F.col("text").cast("string").alias("text"), *extra)
    more = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in base.schema[3:])
    real = base.where("doc_id is not null")
    found = real.select("doc_id", "text").mapInArrow(lean(_anchors(n)), "anchor bigint, doc_id bigint")
    shared = work.keep(found.groupBy("anchor").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x < y").select("anchor"), "shared")
    per_doc = work.keep(found.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors")), "per-doc")
    joined = base.join(per_doc, "doc_id", "left").select("doc_id", "tk", "text", "anchors", *extra)
    split = work.keep(joined.mapInArrow(lean(_split), f"doc_id bigint, tk bigint, n_words bigint, text string, anchors array<bigint>{more}"), "split")
    work.drop("per-doc")
    work.drop("shared")

    clean = split.where("anchors is null").select("doc_id", "n_words", F.lit(0).cast("bigint").alias("n_removed"), F.col("text").alias("kept_text"), *extra)
    touched = split.where("anchors is not null")
    source = touched.select("doc_id", "tk", "text", "anchors")
    passages = source.mapInArrow(lean(_passages(n, True)), "anchor bigint, passage string, doc_id bigint")
    distinct = work.keep(passages.groupBy("anchor", "passage").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")), "distinct")
    hot = work.keep(distinct.groupBy("anchor").agg(F.count("*").alias("m")).where(F.col("m") > SHARD_PASSAGES).select("anchor"), "hot")
    normal = distinct.join(hot, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor")
    firsts = normal.mapInArrow(lean(_match(n)), "anchor bigint, digest bigint, firsts array<bigint>")
    if not hot.isEmpty():
        rows = distinct.join(hot, "anchor", "left_semi").mapInArrow(lean(_windows(n)), "anchor bigint, digest bigint, i int, w binary, low bigint")
        least = work.keep(rows.groupBy("w").agg(F.min("low").alias("first")), "least")
        ordered = rows.join(least, "w").groupBy("anchor", "digest").agg(F.sort_array(F.collect_list(F.struct("i", "first"))).alias("f"))
        firsts = firsts.union(ordered.select("anchor", "digest", F.col("f.first").alias("firsts")))
    firsts = work.keep(firsts, "firsts")
    work.drop("distinct")
    places = source.mapInArrow(lean(_passages(n, False)), "anchor bigint, digest bigint, doc_id bigint, tk bigint, start bigint")
    hits = places.join(firsts, ["anchor", "digest"]).where(F.array_min("firsts") < F.col("doc_id"))
    by_row = work.keep(hits.groupBy("doc_id", "tk").agg(F.collect_list(F.struct("start", "firsts")).alias("hits")), "hits")
    work.drop("firsts")
    cut = touched.join(by_row, ["doc_id", "tk"], "left").select("doc_id", "n_words", "text", "hits", *extra)
    return clean.union(cut.mapInArrow(lean(_remove(n)), f"doc_id bigint, n_words bigint, n_removed bigint, kept_text string{more}"))


def _pieces(n: int, shards: int):
    """Texts as pieces of at most ``PIECE`` words that overlap by n - 1, each with its shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            for text in strings(batch.column(0)):
                words = text.as_buffer().to_pybytes().split()
                out += [b" ".join(words[i : i + PIECE]) for i in range(0, max(0, len(words) - n + 1), PIECE - n + 1)]
            shard = [xxhash.xxh3_64_intdigest(x) % shards for x in out]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())], names=["shard", "piece"])

    return run


def _covered(held, n: int):
    """Starts of the windows that a broadcast automaton has, for rows with any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = held.value
        for batch in batches:
            rows, starts = [], []
            for i, text in enumerate(strings(batch.column(2))):
                found = [j for j, label in enumerate(automaton.first_labels(text.as_buffer().to_pybytes().split(), n)) if label == 0]
                if found:
                    rows.append(i)
                    starts.append(found)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(starts, pa.list_(pa.int64()))], names=["doc_id", "tk", "starts"])

    return run


def _without(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept = [], [], []
            for text, starts in zip(strings(batch.column(1)), batch.column(2)):
                words = text.as_buffer().to_pybytes().split()
                cover = np.zeros(len(words) + 1, np.int64)
                if starts.is_valid:
                    at = np.unique(np.array([j for part in starts.as_py() for j in part], np.int64))
                    cover[at] += 1
                    cover[at + n] -= 1
                gone = (np.cumsum(cover[:-1]) > 0).tolist()
                counts.append(len(words))
                removed.append(sum(gone))
                kept.append(b" ".join(w for w, x in zip(words, gone) if not x))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def remove_reference(docs: DataFrame, reference: DataFrame, n: int = WINDOW, shard_words: int = SHARD_WORDS, work: Workspace | None = None) -> DataFrame:
    """``docs`` (doc_id, text) without the spans of n words or more that the texts of a reference have.

    The reference (text) is dealt into shards of about ``shard_words`` words. One shard after
    the other comes to the driver, its automaton is broadcast, every document is streamed
    through it, the windows found are written, and the automaton is dropped: each shard
    is a pass over the documents. Returns doc_id, n_words, n_removed, kept_text as above.
    """
    spark = docs.sparkSession
    work = work or Workspace(spark)
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("tk"), F.col("text").cast("string").alias("text"))
    texts = reference.select(F.col("text").cast("string").alias("text")).where("text is not null")
    # A word and the space after it take two bytes at least, so a shard has this many words at most, chance of the hash aside.
    shards = max(1, -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (2 * shard_words)))
    pieces = work.keep(texts.mapInArrow(lean(_pieces(n, shards)), "shard bigint, piece string").distinct(), "pieces")
    found = None
    for shard in range(shards):
        automaton = SuffixAutomaton()
        for piece in pieces.where(F.col("shard") == shard).select("piece").toArrow()["piece"].to_pylist():
            automaton.add(piece.encode().split(), 0)
        held = spark.sparkContext.broadcast(automaton.finish())
        part = work.keep(base.mapInArrow(lean(_covered(held, n)), "doc_id bigint, tk bigint, starts array<bigint>"), f"found-{shard}")
        held.destroy()
        found = part if found is None else found.union(part)
    work.drop("pieces")
    # Rows that are equal have equal windows.
    each = found.distinct().groupBy(F.col("doc_id").alias("of"), F.col("tk").alias("key")).agg(F.collect_list("starts").alias("starts"))
    cut = base.join(each, base.doc_id.eqNullSafe(each.of) & (base.tk == each.key), "left").select("doc_id", "text", "starts")
    return cut.mapInArrow(lean(_without(n)), "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")

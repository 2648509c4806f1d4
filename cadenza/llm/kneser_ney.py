"""Quality by a modified Kneser-Ney language model (operator 7).

The model is an interpolated modified Kneser-Ney model of order 3 over words, one for each
language, trained on trusted text, the documents labelled with quality 1. The vocabulary is
open: the unigrams interpolate with a model of spellings, itself a modified Kneser-Ney model
of order 4 over 48 symbols (letters in lower case, classes of digits, punctuation and
non-ASCII bytes, and the end of a word). Words are runs of letters, digits and non-ASCII
bytes, told apart by all of their bytes with A-Z as a-z; any other byte but white space is
a word of its own. Perplexity is for each symbol, so languages and unseen words compare.

N-grams are dealt to shards by the word in their middle, y of x y z. A shard then has all
that the trigrams x y z and the bigrams y z need: counts, continuation counts, totals of
the contexts x y and y. What isn't there, the continuation counts of single words z, is
summed over the shards. Documents send their n-grams to the same shards, packed, with the
probability of z that the interpolation ends in, and a shard gives back one sum of
logarithms for each document. So every n-gram is shuffled once to be counted and once to be
scored, text is never shuffled, and what is held grows with the trusted text.

A word that makes more than a share of a shard of all middles is dealt to several shards by
the word before it; a pair that does, by the word after it too. The totals that such shards
lack come from sums over all shards. Which words are common is measured on one of
``SAMPLE`` documents: it decides where an n-gram is counted, never its number.

Shards are taken in ``PASSES`` turns, each of which reads the documents again, so that the
disk holds one turn's n-grams only. The ``KNOWN`` words with most continuations, about 50
MB, are broadcast; n-grams that end in another word leave their shard with the sum so far
and are joined with the whole table of words. Besides these, only the spelling models, of
at most 48^4 entries for each language, are broadcast; a worker loads a language's model
when it meets it and holds ``LOADED`` of them. Each language with trusted text has a model
of its own, all others share one that is trained on all trusted text.

A document is kept if its perplexity is at most the ``QUANTILE`` quantile of the trusted
documents of its language that the model wasn't trained on: word n-grams know the text that
they were counted on, so other text would fall behind it. One of ``HELD`` trusted documents
is held out by a hash of its id, in languages with ``LEAST`` of them. In other languages
the quantile is that of all documents, as no trusted one can be compared.

Defined results: null and empty texts and those of white space have a null perplexity and
aren't kept. A null language is the language ''. Without any trusted text there is no
evidence: all perplexities are those of the uniform model, and documents with words are
kept. Rows with null or repeated doc_ids are scored like any other; of repeated labels the
largest counts. Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import FOLD, Workspace, alnum, lean, mix, resident, slices, trim, word_hashes

ORDER, SYMBOLS = 4, 48
QUANTILE = 0.98
#: Model of the languages without trusted text; the others are named by "=" and their language.
SHARED = "*"
#: Spelling models that a worker holds.
LOADED = 8
#: Bytes of trusted text for each shard of n-grams, turns in which the shards are taken, and n-grams that a worker packs together.
SHARD, PASSES, PACKED = 8 << 20, 4, 1_000_000
#: Shards that small corpora have at most, and how many times ``SHARD`` of any text a shard may have.
SPREAD, STREAMED = 48, 8
#: Words whose continuation counts are broadcast, 12 bytes each; ids of trusted documents that are.
KNOWN, BROADCAST_IDS = 4_000_000, 4_000_000
#: Common words are sought in one of so many documents.
SAMPLE = 16
#: One of so many trusted documents is held out, in languages with so many at least.
HELD, LEAST = 8, 20


def _symbol_table() -> np.ndarray:
    """Symbol of each byte: 0 space, 1 digit, 2-27 letters, 28-33 punctuation, 34-47 the rest."""
    out = np.zeros(256, np.int32)
    marks = {ord(c): 28 + i for i, group in enumerate((".", ",", "'\"", ";:", "!?")) for c in group}
    for byte in range(256):
        low = int(FOLD[byte])
        if byte >= 0x80:
            out[byte] = 34 + byte % 14
        elif 0x61 <= low <= 0x7A:
            out[byte] = 2 + low - 0x61
        elif 0x30 <= byte <= 0x39:
            out[byte] = 1
        elif byte > 0x20:
            out[byte] = marks.get(byte, 33)
    return out


_SYMBOL = _symbol_table()


def grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code of the n-gram that ends at each byte (spaces before the text), and the rows' offsets."""
    return _codes(data, offs).astype(np.int64), offs


def _codes(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    heads = offs[:-1][offs[:-1] < len(data)]
    symbols = _SYMBOL[data]
    code, before = symbols.copy(), symbols
    for j in range(1, ORDER):
        before = _before(before, heads, 0)
        code += before * np.int32(SYMBOLS**j)
    return code


def _before(values: np.ndarray, heads: np.ndarray, pad) -> np.ndarray:
    """The value before each one; ``pad`` at the heads of rows."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[heads] = pad
    return out


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the index of each row's first word (one more at the end)."""
    word = alnum(data)
    joined = np.zeros(len(data) + 1, bool)  # the byte goes on with the word of the byte before
    joined[1:-1] = word[1:] & word[:-1]
    joined[offs] = False
    some = data > 0x20  # the bytes that aren't symbol 0
    starts = np.flatnonzero(some & ~joined[:-1])
    return starts, np.flatnonzero(some & ~joined[1:]) + 1, np.searchsorted(starts, offs)


def spelt(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the words, each with a space as its end, and the words' offsets in them."""
    offs = np.concatenate([[0], np.cumsum(ends - starts + 1)])
    place = np.arange(offs[-1]) + np.repeat(starts - offs[:-1], ends - starts + 1)
    out = data[np.minimum(place, len(data) - 1)]
    out[offs[1:] - 1] = 0x20
    return out, offs


def word_grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, model: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes x, y, z of each word z and the two before it; they differ between models."""
    salt = np.frombuffer(hashlib.blake2b(model.encode(), digest_size=8).digest(), np.uint64)
    z = mix(word_hashes(data, starts, ends, fold=True) ^ salt)
    heads, pad = first[:-1][np.diff(first) > 0], mix(salt)
    y = _before(z, heads, pad)
    return _before(y, heads, pad), y, z


def key(*words: np.ndarray) -> np.ndarray:
    """A hash of the n-gram of the given words."""
    out = np.full(len(words[0]), len(words), np.uint64)
    for w in words:
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + w)
    return out.view(np.int64)


def _by_model(langs: pa.Array, column: pa.Array, model_of) -> Iterator[tuple]:
    """Model, rows, bytes, offsets and words of texts, one model and about 1 MB at a time."""
    names = np.array([model_of(x) for x in langs.to_pylist()], object)
    for model in sorted({*names}):
        rows = np.flatnonzero(names == model)
        for lo, hi, data, offs in slices(column.take(pa.array(rows))):
            yield model, rows[lo:hi], data, offs, tokens(data, offs)


def _summed(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of the columns, with the sums of their counts."""
    if not len(counts):
        return columns, counts
    order = np.lexsort(columns)
    columns = [c[order] for c in columns]
    new = np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])])
    return [c[new] for c in columns], np.add.reduceat(counts[order], np.flatnonzero(new))


def _models(lang: str, shared: bool) -> list[str]:
    return [f"={lang}", SHARED] if shared else [f"={lang}"]


def _symbols(shared: bool):
    """Counts of symbol n-grams (lang, code, c) of a batch's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, parts in itertools.groupby(_by_model(batch.column(0), batch.column(1), lambda x: x), lambda x: x[0]):
                counts = np.zeros(SYMBOLS**ORDER, np.int32)
                for _, _, data, offs, (starts, ends, _) in parts:
                    np.add.at(counts, grams(*spelt(data, starts, ends))[0], np.int32(1))
                code = np.flatnonzero(counts)
                for model in _models(own, shared):
                    yield pa.RecordBatch.from_arrays([pa.array([model] * len(code), pa.string()), pa.array(code), pa.array(counts[code].astype(np.int64))], names=["lang", "code", "c"])

    return run


def _less(counts: DataFrame, work: Workspace, name: str) -> DataFrame:
    """Counts with ``taken``, the discount of their language."""
    ones = [F.count(F.when(F.col("c") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)]
    y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1))
    cut = [(F.lit(i) - (i + 1) * y * F.col(f"n{i + 1}") / F.greatest(F.col(f"n{i}"), F.lit(1))) for i in (1, 2, 3)]
    # Discounts that small counts of counts would put out of (0, i) are set inside.
    discount = counts.groupBy("lang").agg(*ones).select("lang", *(F.least(F.greatest(d, F.lit(0.1)), F.lit(i - 0.1)).alias(f"d{i}") for i, d in enumerate(cut, 1)))
    taken = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    discount = work.keep(discount.coalesce(1), name)  # a row for each language
    return counts.join(discount, "lang").withColumn("taken", taken)


def estimate(counts: DataFrame, work: Workspace) -> DataFrame:
    """lang, n, code, alpha, gamma: discounted probabilities and back-off weights of all orders.

    ``code`` is an n-gram with its ``alpha``, the discounted relative count; and a context
    of an n-gram, with ``gamma``, the weight of the next lower order after it.
    """
    out = None
    for n in range(ORDER, 0, -1):
        counts = work.keep(counts, f"count-{n}")
        each = _less(counts, work, f"discount-{n}").withColumn("context", F.floor(F.col("code") / SYMBOLS))
        total = each.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.sum("taken").alias("spare"))
        alpha = each.join(total, ["lang", "context"]).select("lang", F.lit(n).alias("n"), "code", ((F.col("c") - F.col("taken")) / F.col("total")).alias("alpha"), F.lit(None).cast("double").alias("gamma"))
        gamma = total.select("lang", F.lit(n).alias("n"), F.col("context").alias("code"), F.lit(None).cast("double").alias("alpha"), (F.col("spare") / F.col("total")).alias("gamma"))
        part = alpha.union(gamma)
        out = part if out is None else out.union(part)
        # The next lower order counts the distinct symbols before each n-gram.
        counts = counts.groupBy("lang", F.pmod(F.col("code"), F.lit(SYMBOLS ** (n - 1))).alias("code")).agg(F.count("*").alias("c"))
    return out


def assemble(n: np.ndarray, code: np.ndarray, alpha: np.ndarray, gamma: np.ndarray) -> np.ndarray:
    """Log probability of every n-gram of the highest order, by interpolation from the lowest up.

    P(w | h) = alpha(h w) + gamma(h) P(w | h without its first symbol). The highest order is
    filled for one first symbol of h after the other, so that only the result is large.
    """
    below = np.full(SYMBOLS, 1.0 / SYMBOLS)
    for order in range(1, ORDER + 1):
        contexts = SYMBOLS ** (order - 1)
        mine = np.flatnonzero(n == order)
        mine = mine[np.argsort(code[mine], kind="stable")]
        grams, weights = mine[~np.isnan(alpha[mine])], mine[~np.isnan(gamma[mine])]
        weight = np.ones(contexts)
        weight[code[weights]] = gamma[weights]
        parts = SYMBOLS if order > 1 else 1
        size = contexts * SYMBOLS // parts
        out = np.empty(contexts * SYMBOLS, np.float32 if order == ORDER else np.float64)
        edges = np.searchsorted(code[grams], np.arange(parts + 1) * size)
        for part in range(parts):
            lo = part * size
            each = np.repeat(weight[lo // SYMBOLS : (lo + size) // SYMBOLS], SYMBOLS) * below
            at = grams[edges[part] : edges[part + 1]]
            each[code[at] - lo] += alpha[at]
            out[lo : lo + size] = np.log(each) if order == ORDER else each
        below = out
    return below


def compact(log_p: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``log_p`` as the rows that differ, one after the other, and what to add to a code for its place in them, by context.

    A context that isn't among the model's ``contexts`` has the row of all such contexts with
    its last symbols. A model has seen few of the contexts that there could be.
    """
    rows = log_p.reshape(-1, SYMBOLS)
    of = np.arange(len(rows))
    other = np.ones(len(rows), bool)
    other[contexts] = False
    other = np.flatnonzero(other)
    one = np.empty(len(rows) // SYMBOLS, np.int64)
    one[other % len(one)] = other
    of[other] = one[other % len(one)]
    kept, where = np.unique(of, return_inverse=True)
    return rows[kept].reshape(-1), ((where - np.arange(len(rows))) * SYMBOLS).astype(np.int32)


def _spelling(table: DataFrame, names: list[str], run: str):
    """The function that gives a language's log probabilities of symbol n-grams, on any worker."""
    spark, held = table.sparkSession, {}
    size = {r.lang: r.n for r in table.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    some: list[str] = []
    for i, name in enumerate(names):
        some.append(name)
        # At most 2 * 48^4 rows a language; small languages are fetched together.
        if i + 1 < len(names) and sum(size[x] for x in some) + size[names[i + 1]] <= 4_000_000 and len(some) < 500:
            continue
        rows = table.where(F.col("lang").isin(some)).toArrow()
        of = np.array(rows["lang"].to_pylist(), object)
        columns = [rows[c].to_numpy() for c in ("n", "code", "alpha", "gamma")]
        for x in some:
            part = [c[of == x] for c in columns]
            held[x] = spark.sparkContext.broadcast([part[0].astype(np.int8), part[1].astype(np.int32), part[2].astype(np.float32), part[3].astype(np.float32)])
        some = []

    def model(name: str) -> tuple[np.ndarray, np.ndarray]:
        tables = resident("spelling:", dict)
        if (run, name) not in tables:
            own = [k for k in tables if k[0] == run]
            for old in [k for k in tables if k[0] != run] + own[: len(own) - LOADED + 1 if len(own) >= LOADED else 0]:
                del tables[old]
            none = np.zeros(0)
            n, code, alpha, gamma = held[name].value if name in held else (none, none.astype(int), none, none)
            tables[run, name] = compact(assemble(n, code, alpha, gamma), code[(n == ORDER) & ~np.isnan(gamma)])
            trim()  # the whole table is ten times as large
        return tables[run, name]

    def spell(name: str, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct words, the log probabilities of their spellings, and where each word of z is among them."""
        words, (where,) = _coded(z)
        at = np.empty(len(words), np.int64)
        at[where] = np.arange(len(z))  # any place of a word will do
        letters, offs = spelt(data, starts[at], ends[at])
        log_p, shift = model(name)
        code = _codes(letters, offs)
        code += shift[code // np.int32(SYMBOLS)]
        return words, np.add.reduceat(log_p[code].astype(np.float64), offs[:-1]), where

    return spell


# ---------------------------------------------------------------- n-grams of words, packed and dealt

BLOBS = "shard int, kind tinyint, lang string, data binary"
COUNTED, COMMON, ASKED = 0, 1, 2
#: Bytes of packed n-grams that a worker hands over at once, and documents' sums that it holds.
SENT, SUMS = 2 << 20, 1_000_000


def pack(*columns: np.ndarray) -> bytes:
    """Arrays as one compressed string, bytes of equal weight together."""
    head = ";".join(f"{c.dtype.str},{len(c)}" for c in columns).encode()
    raw = b"".join(c.view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns)
    return len(head).to_bytes(4, "little") + len(raw).to_bytes(8, "little") + head + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    cut, size = int.from_bytes(data[:4], "little"), int.from_bytes(data[4:12], "little")
    raw = pa.decompress(data[12 + cut :], decompressed_size=size, codec="zstd", asbytes=True) if size else b""
    out, at = [], 0
    for kind, n in (x.split(",") for x in data[12 : 12 + cut].decode().split(";")):
        dtype, n = np.dtype(kind), int(n)
        part = np.frombuffer(raw, np.uint8, n * dtype.itemsize, at).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(part.T).reshape(-1).view(dtype))
        at += n * dtype.itemsize
    return out


def _blobs(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int8(), pa.string(), pa.binary()))], names=["shard", "kind", "lang", "data"])


def _narrow(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint16 if not len(values) or values.max() < 1 << 16 else np.uint32)


def _coded(*columns: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct words, and each column as places among them."""
    found = pa.array(np.concatenate(columns)).dictionary_encode()  # by hashes, much faster than to sort all
    words, codes = found.dictionary.to_numpy(), found.indices.to_numpy()
    order = np.argsort(words)
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    return words[order], np.split(rank[codes], len(columns))


def _steps(words: np.ndarray) -> np.ndarray:
    return np.diff(words, prepend=np.uint64(0))


class Route:
    """The shard of each n-gram x y z. ``ways`` gives the number of shards of common words, ``pairs`` the common pairs."""

    def __init__(self, shards: int, ways: dict[int, int], pairs: set[int]) -> None:
        self.shards = shards
        self.words = np.array(sorted(ways), np.uint64)
        self.ways = np.array([ways[int(w)] for w in self.words], np.uint64)
        self.pairs = np.array(sorted(pairs), np.int64)

    def common(self, words: np.ndarray) -> np.ndarray:
        """Number of each word among the common ones, or -1."""
        if not len(self.words):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, at, -1)

    def first(self, y: np.ndarray) -> np.ndarray:
        # Words are hashes: their last 32 bits, as a share of the shards.
        return ((y & np.uint64(0xFFFFFFFF)) * np.uint64(self.shards) >> np.uint64(32)).astype(np.int64)

    def __call__(self, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
        out, number = self.first(y), self.common(y)
        some = np.flatnonzero(number >= 0)
        if len(some):
            x, y, z = x[some], y[some], z[some]
            by = np.where(np.isin(key(x, y), self.pairs), key(z, x), key(x)).view(np.uint64)
            out[some] = (out[some] + (mix(by) % self.ways[number[some]]).astype(np.int64)) % self.shards
        return out


def _common(shards: int, model_of):
    """Words and pairs that make more than half of a shard's share of a batch; with the number of all (what 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, total = [], 0
            for name, _, data, offs, (starts, ends, first) in _by_model(batch.column(0), batch.column(1), model_of):
                if len(starts):
                    x, y, _ = word_grams(data, starts, ends, first, name)
                    total += len(y)
                    for what, values in ((0, y.view(np.int64)), (1, key(x, y))):
                        values, n = np.unique(values, return_counts=True)
                        often = n >= max(2, len(y) / (2 * shards))
                        found += [(what, int(v), int(c)) for v, c in zip(values[often], n[often])]
            found.append((2, 0, total))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], kind) for i, kind in enumerate((pa.int8(), pa.int64(), pa.int64()))], names=["what", "a", "n"])

    return run


def _dealer(route: Route, turn: int, turns: int, shared: bool, model_of, spell: Callable | None, known: Callable | None, weights: dict[str, float], counted: bool):
    """Blobs of a turn's shards: n-grams of the rows to train on (``counted``), and those that rows ask for (``spell``).

    Columns are lang, text, train, key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, str], list[tuple]] = {}
        taken = np.arange(route.shards) % turns == turn
        size = 0

        def take(kind: int, name: str, *columns: np.ndarray) -> int:
            if len(columns[0]):
                held.setdefault((kind, name), []).append(columns)
            return len(columns[0])

        def flush() -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            while held:
                (kind, name), parts = held.popitem()
                columns = list(zip(*parts))
                del parts
                order = np.argsort(np.concatenate(columns[0]), kind="stable")  # in linear time if there are 2^16 shards at most
                for i, c in enumerate(columns):  # one column is there twice at a time
                    columns[i] = np.concatenate(c)
                    del c
                    columns[i] = columns[i][order]
                del order
                shard = columns[0]
                edges = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
                for lo, hi in zip(edges, edges[1:]):
                    x, y, z, *more = (c[lo:hi] for c in columns[1:])
                    words, codes = _coded(y, x, z)
                    if kind == COUNTED:
                        codes, counts = _summed(codes[::-1], np.ones(hi - lo, np.int64))
                        data = pack(_steps(words), *map(_narrow, codes[::-1]), _narrow(counts))
                    else:
                        value, doc = more
                        values = np.zeros(len(words), np.float32)
                        values[codes[2]] = value
                        new = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                        data = pack(_steps(words), *map(_narrow, codes), values, doc[new], _narrow(np.diff(new, append=len(doc))))
                    rows.append((int(shard[lo]), kind, name, data))
                    if sum(len(r[3]) for r in rows) > SENT:
                        yield _blobs(rows)
                        rows = []
            if rows:
                yield _blobs(rows)

        for batch in batches:
            if not batch.num_rows:
                continue
            train, keys = batch.column(2).to_numpy(zero_copy_only=False).astype(bool), batch.column(3).to_numpy()
            for lang, rows, data, offs, (starts, ends, first) in _by_model(batch.column(0), batch.column(1), lambda x: x):
                if not len(starts):
                    continue
                words_in, trained = np.diff(first), train[rows]
                row = np.repeat(rows, words_in) if spell is not None else None
                asks = model_of(lang)
                for name in dict.fromkeys([asks] * (spell is not None) + _models(lang, shared) * bool(counted and trained.any())):
                    x, y, z = word_grams(data, starts, ends, first, name)
                    shard = route(x, y, z)
                    mine, shard = taken[shard], _narrow(shard)
                    if counted and trained.any() and name in _models(lang, shared):
                        some = np.flatnonzero(mine & np.repeat(trained, words_in))
                        size += take(COUNTED, name, shard[some], x[some], y[some], z[some])
                    if spell is not None and name == asks:
                        some = np.flatnonzero(mine)
                        if len(some):
                            words, s, where = spell(name, data, starts[some], ends[some], z[some])
                            more, sure = known(words)
                            value = weights.get(name, 1.0) * np.exp(s) + more
                            value = np.where(sure, value, -value).astype(np.float32)
                            size += take(ASKED, name, shard[some], x[some], y[some], z[some], value[where], keys[row[some]])
                if size >= PACKED:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


def _spread(route: Route, turn: int, turns: int):
    """Blobs of the bigrams (lang, y, z, c) after common words, for each shard of the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, z, c = (batch.column(i).to_numpy() for i in (1, 2, 3))
            number, names = route.common(y.view(np.uint64)), np.array(batch.column(0).to_pylist(), object)
            rows = []
            for word in np.unique(number):
                at = number == word
                part = pack(y[at], z[at], c[at])
                base = int(route.first(route.words[word : word + 1])[0])
                rows += [(shard, COMMON, names[at][0], part) for way in range(int(route.ways[word])) if (shard := (base + way) % route.shards) % turns == turn]
            yield _blobs(rows)

    return run


# ---------------------------------------------------------------- shards


def _groups(rows: pa.Table) -> Iterator[tuple[str, dict[int, list[list[np.ndarray]]]]]:
    """Each model with its unpacked blobs by kind."""
    names, kinds, data = (rows[c].to_pylist() for c in ("lang", "kind", "data"))
    for name in sorted({*names}):
        held: dict[int, list] = {}
        for i, n in enumerate(names):
            if n == name:
                held.setdefault(kinds[i], []).append(unpack(data[i]))
                data[i] = None
        yield name, held


def _trigrams(blobs: list[list[np.ndarray]]) -> tuple[np.ndarray, ...]:
    """Keys in order, x, y, z and counts of the distinct trigrams. Takes the blobs out of their list."""
    n = sum(len(b[1]) for b in blobs)
    x, y, z, c = (np.empty(n, kind) for kind in (np.uint64, np.uint64, np.uint64, np.int64))
    lo = 0
    while blobs:
        steps, cy, cx, cz, counts = blobs.pop()
        words, hi = np.cumsum(steps), lo + len(cy)
        x[lo:hi], y[lo:hi], z[lo:hi], c[lo:hi] = words[cx], words[cy], words[cz], counts
        lo = hi
    keys = key(x, y, z)
    order, first = _runs(keys)
    c = np.add.reduceat(c[order], first)
    order = order[first]
    return keys[order], x[order], y[order], z[order], c


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the keys, and where in it each distinct one begins."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return order, np.flatnonzero(new)


def _numbers(order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The number of each key among the distinct ones."""
    out = np.empty(len(order), np.int32)
    out[order] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(first, append=len(order)))
    return out


def _totals(keys: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys; sum of c, and how many are 1, 2, more, for each; number of each key among the distinct ones."""
    order, first = _runs(keys)
    c = c[order]
    totals = np.empty((len(first), 4), np.int64)
    for i, w in enumerate((c, c == 1, c == 2, c > 2)):
        totals[:, i] = np.add.reduceat(w, first, dtype=np.int64)
    return keys[order[first]], totals, _numbers(order, first)


def _trimmed(run: Callable) -> Callable:
    """``run`` for a group's table, with its free memory given back afterwards."""

    def trimmed_run(rows: pa.Table) -> pa.Table:
        try:
            return run(rows)
        finally:
            trim()

    return trimmed_run


STATS = "kind tinyint, lang string, a bigint, b bigint, n bigint, ones bigint, twos bigint, more bigint"


def _stats(route: Route):
    """What a shard tells the others: counts of counts (kinds 3, 2), continuations (1), common words' bigrams (9) and pairs (8)."""

    def run(rows: pa.Table) -> pa.Table:
        out: list[tuple] = []

        def tell(kind: int, lang: str, a: np.ndarray, b: np.ndarray | None, n: np.ndarray, more: np.ndarray | None = None) -> None:
            size, none = len(a), np.zeros(len(a), np.int64)
            columns = [a, none if b is None else b, n, *(more.T if more is not None else [none] * 3)]
            out.append((np.full(size, kind, np.int8), [lang] * size, *(c.astype(np.int64, copy=False) for c in columns)))

        for lang, held in _groups(rows):
            _, x, y, z, c = _trigrams(held.pop(COUNTED, []))
            often = np.arange(1, 5)
            tell(3, lang, often, None, np.array([(c == i).sum() for i in often]))
            pairs, sums, _ = _totals(key(x, y), c)
            del x, c
            shared = np.isin(pairs, route.pairs)
            tell(8, lang, pairs[shared], None, sums[shared, 0], sums[shared, 1:])
            order, first = _runs(key(y, z))
            c2, order = np.diff(first, append=len(order)), order[first]
            y, z = y[order], z[order]
            usual = route.common(y) < 0
            tell(9, lang, y[~usual].view(np.int64), z[~usual].view(np.int64), c2[~usual])
            tell(2, lang, often, None, np.array([(c2[usual] == i).sum() for i in often]))
            words, n = np.unique(z[usual], return_counts=True)
            tell(1, lang, words.view(np.int64), None, n)
        names = ["kind", "lang", "a", "b", "n", "ones", "twos", "more"]
        columns = [[x for part in out for x in part[1]] if i == 1 else np.concatenate([part[i] for part in out]) for i in range(8)]
        return pa.table({n: pa.array(v, pa.string()) if n == "lang" else pa.array(v) for n, v in zip(names, columns)})

    return run


def cuts(often: list[int]) -> np.ndarray:
    """Discounts of counts 1, 2 and more from the numbers of counts 1 to 4, set inside (0, i)."""
    y = often[0] / max(often[0] + 2 * often[1], 1)
    return np.array([min(max(i - (i + 1) * y * often[i] / max(often[i - 1], 1), 0.1), i - 0.1) for i in (1, 2, 3)])


class Places:
    """Places of wanted keys in sorted keys, as ``_find`` gives them.

    Keys are hashes, so their first bits tell about where each stands and a step or two
    are left; halving an interval takes many steps, each of them far from the one before.
    """

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.append(keys, np.iinfo(np.int64).max)
        bits = max(1, len(keys).bit_length() - 1)
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(self._top(keys), np.arange(1 << bits)).astype(np.int32)

    def _top(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) ^ np.uint64(1 << 63)) >> self.shift).view(np.int64)

    def __call__(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.keys) - 1
        if not n:
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = self.start[self._top(wanted)]
        low = np.flatnonzero(self.keys[at] < wanted)
        while len(low):
            at[low] += 1
            low = low[self.keys[at[low]] < wanted[low]]
        return np.minimum(at, n - 1), (self.keys[at] == wanted) & (at < n)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted key in the sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


SCORED = "bucket int, data binary, key bigint, z bigint, p double, b double"


class _ShardModel:
    """Discounted shares a and back-off weights g of a shard's n-grams, by sorted keys."""

    def __init__(self, route: Route, cut: list[np.ndarray], words: dict, pairs: dict, counted: list, common: list) -> None:
        d = [np.append(0.0, x) for x in cut]
        less = lambda order, c: d[order - 1][np.minimum(c, 3)]
        spare = lambda order, t: t[:, 1:] @ d[order - 1][1:] / t[:, 0]
        k3, x, y, z, c3 = _trigrams(counted)
        self.find3 = Places(k3)
        del k3
        contexts, t3, where = _totals(key(x, y), c3)
        del x
        self.find_context = Places(contexts)
        for i in np.flatnonzero(np.isin(contexts, route.pairs)):
            t3[i] = pairs[int(contexts[i])]
        self.a3 = (c3 - less(3, c3)) / t3[where, 0]
        self.g3 = spare(3, t3)
        del contexts, t3, where, c3
        usual = route.common(y) < 0
        y, z = y[usual], z[usual]
        k2 = key(y, z)
        del z
        order, first = _runs(k2)
        c2, order = np.diff(first, append=len(order)), order[first]
        k2, y2 = k2[order], y[order].view(np.int64)
        del y
        for by, bz, bc in common:
            k2, y2, c2 = np.append(k2, key(by.view(np.uint64), bz.view(np.uint64))), np.append(y2, by), np.append(c2, bc)
        order = np.argsort(k2)
        self.find2, y2, c2 = Places(k2[order]), y2[order], c2[order]
        self.k1, t2, where = _totals(y2, c2)
        for i in np.flatnonzero(route.common(self.k1.view(np.uint64)) >= 0):
            t2[i] = words[int(self.k1[i])]
        self.a2 = (c2 - less(2, c2)) / t2[where, 0]
        self.g2 = spare(2, t2)

    def line(self, w: np.ndarray, cx: np.ndarray, cy: np.ndarray, cz: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """p and b for each n-gram: its probability is p + b P(z)."""
        at1, seen1 = _find(self.k1, w.view(np.int64))
        p, b = np.zeros(len(cy)), np.ones(len(cy))
        some = np.flatnonzero(seen1[cy])  # those whose middle is in the model
        if len(some):
            x, y, z = w[cx[some]], w[cy[some]], w[cz[some]]
            at, seen = self.find2(key(y, z))
            lower, rest = np.where(seen, self.a2[at], 0.0), self.g2[at1[cy[some]]]
            at, after = self.find_context(key(x, y))
            gamma = np.where(after, self.g3[at], 1.0) if len(self.g3) else np.ones(len(some))
            high, both = np.zeros(len(some)), np.flatnonzero(seen & after)
            at, seen = self.find3(key(x[both], y[both], z[both]))
            high[both[seen]] = self.a3[at[seen]]
            p[some], b[some] = high + gamma * lower, gamma * rest
        return p, b


def _scorer(route: Route, cut: dict[str, list[np.ndarray]], words: dict[int, np.ndarray], pairs: dict[int, np.ndarray], buckets: int):
    """Sums of logarithms by document, packed by buckets of keys; n-grams that end in a word that isn't known yet with p and b of p + b P(z).

    ``cut`` has each model's discounts by order, ``words`` and ``pairs`` the totals of common
    ones. Rows come sorted by shard, model and kind, so a shard's counts are there before
    the first document asks, and one packed row of documents is open at a time. Sums are
    added up over the shards of a task.
    """

    names, kinds = ["bucket", "data", "key", "z", "p", "b"], (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64())

    def sums(keys: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
        bucket = (mix(keys.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        some = np.flatnonzero(np.diff(edges))
        data = [pack(keys[at := order[edges[i] : edges[i + 1]]], s[at]) for i in some]
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(data, pa.binary()), *(pa.nulls(len(some), t) for t in kinds[2:])], names=names)

    def later(*columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.nulls(len(columns[0]), t) for t in kinds[:2]), *map(pa.array, columns)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident("sums:", dict)  # so that a worker doesn't hold spelling models beside a shard's
        here, model, counted, common = None, None, [], []
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def added() -> tuple[np.ndarray, np.ndarray]:
            keys, where = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(where, np.concatenate([s for _, s in held]), len(keys))

        for batch in batches:
            for shard, kind, lang, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if (shard, lang) != here:
                    here, model, counted, common = (shard, lang), None, [], []
                parts = unpack(data.as_buffer().to_pybytes())
                if kind != ASKED:
                    (counted if kind == COUNTED else common).append(parts)
                    continue
                if model is None:
                    model = _ShardModel(route, cut.get(lang, [np.zeros(3)] * 3), words, pairs, counted, common)
                    counted, common = [], []
                steps, cy, cx, cz, value, keys, sizes = parts
                w = np.cumsum(steps)
                p, b = model.line(w, cx, cy, cz)
                last, doc = value[cz].astype(np.float64), np.repeat(np.arange(len(keys)), sizes)
                p += b * np.abs(last)
                late = np.flatnonzero(last < 0)
                if len(late):
                    yield later(keys[doc[late]], w[cz[late]].view(np.int64), p[late], b[late])
                    p[late] = 1.0
                held.append((keys, np.bincount(doc, np.log(p), len(keys))))
                size += len(keys)
                if size > SUMS:
                    held = [added()]
                    size = len(held[0][0])
                    if 2 * size > SUMS:
                        yield sums(*held[0])
                        held, size = [], 0
        if held:
            yield sums(*added())

    return run


def _add_up(rows: pa.Table) -> pa.Table:
    """The sum of each key of a bucket."""
    parts = [unpack(x) for x in rows["data"].to_pylist()]
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return pa.table({"key": keys, "s": np.bincount(where, np.concatenate([s for _, s in parts]), len(keys))})


def shards_of(size: int, trusted: int, shard: int) -> int:
    """The number of shards for so many bytes of text.

    A shard holds the counts of its trusted n-grams, but documents' n-grams pass through it.
    So trusted text, of which a shard takes ``shard`` bytes, makes many shards, other text
    few: the packed n-grams of a worker are cut by shards, and small cuts pack worse.
    """
    return max(1, min(-(-size // shard), SPREAD), -(-trusted // shard), -(-size // (STREAMED * shard)))


def held_out() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(HELD)) == 0


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of symbols of each text, in the last column."""
    for batch in batches:
        for lo, hi, data, offs in slices(batch.column(4)):
            starts, ends, first = tokens(data, offs)
            row = np.repeat(np.arange(hi - lo), np.diff(first))
            symbols = np.bincount(row, ends - starts + 1, hi - lo).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i)[lo:hi] for i in range(4)), pa.array(symbols)], names=["doc_id", "lang", "key", "good", "symbols"])


def quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, shard: int = SHARD, passes: int = PASSES, known: int = KNOWN, sample: int = SAMPLE, work: Workspace | None = None) -> DataFrame:
    """doc_id, lang, perplexity, threshold, kept for every row of ``docs`` (doc_id, lang, text)."""
    spark = docs.sparkSession
    work = work or Workspace(spark)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("key", F.xxhash64("doc_id", "lang", "text"))
    good = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("quality").alias("quality")).where("quality = 1")
    good = work.keep(good.select("doc_id", F.lit(True).alias("mark")), "good")
    few = good.count() <= BROADCAST_IDS
    marked = texts.join(F.broadcast(good) if few else good, "doc_id", "left")
    marked = marked.select("doc_id", "lang", "key", (F.col("mark").isNotNull() & F.coalesce(F.col("text").rlike(r"[^\x00-\x20]"), F.lit(False))).alias("good"), "text")
    if not few:
        marked = work.keep(marked, "marked")
    is_good, is_held = F.when(F.col("good"), 1), F.when(F.col("good") & held_out(), 1)
    per_lang = marked.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("size"), F.count(is_good).alias("n"), F.sum(F.when(F.col("good"), F.octet_length("text"))).alias("trusted"), F.count(is_held).alias("out")).collect()
    own = {r.lang for r in per_lang if r.n}
    held = held_out() & F.col("lang").isin([r.lang for r in per_lang if r.n >= LEAST and 0 < r.out < r.n])
    shared = bool(own) and len(own) < len(per_lang)

    def model_of(lang: str) -> str:
        return f"={lang}" if lang in own else SHARED

    train = F.col("good") & ~held
    symbols = marked.where(train).select("lang", "text").mapInArrow(lean(_symbols(shared)), "lang string, code bigint, c bigint")
    symbols = work.keep(symbols.groupBy("lang", "code").agg(F.sum("c").alias("c")), "symbols")
    table = work.keep(estimate(symbols, work), "model")
    spell = _spelling(table, sorted(f"={x}" for x in own) + [SHARED] * shared, work.root)

    size = sum(r.size or 0 for r in per_lang)
    shards = shards_of(size, sum(r.trusted or 0 for r in per_lang), shard)
    passes = max(1, min(passes, shards // 4))  # a turn of a few shards costs more than the disk that it saves
    route = _routed(marked, shards, sample, model_of, work)
    rows = marked.select("lang", "text", train.alias("train"), "key")

    halves = max(1, passes // 2)
    parts = []
    for turn in range(halves):
        blobs = rows.where("train").mapInArrow(lean(_dealer(route, turn, halves, shared, model_of, None, None, {}, True)), BLOBS)
        told = blobs.groupBy("shard").applyInArrow(_trimmed(_stats(route)), STATS)
        parts.append(work.keep(told.groupBy("kind", "lang", "a", "b").agg(*(F.sum(c).alias(c) for c in ("n", "ones", "twos", "more"))), f"stats-{turn}"))
    stats = functools.reduce(DataFrame.union, parts)
    common = work.keep(stats.where("kind = 9").groupBy("lang", F.col("a").alias("y"), F.col("b").alias("z")).agg(F.sum("n").alias("c")), "common")
    ends = stats.where("kind = 1").select("lang", F.col("a").alias("z"), "n").union(common.select("lang", "z", F.lit(1).cast("bigint")))
    ends = work.keep(ends.groupBy("lang", "z").agg(F.sum("n").alias("c")), "ends")

    totals = [F.sum("c").alias("total"), *(F.count(F.when(F.col("c") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)), F.count(F.when(F.col("c") > 2, 1)).alias("more")]
    often: dict[str, list[list[int]]] = {f"={x}": [[0] * 4 for _ in range(3)] for x in own} | {SHARED: [[0] * 4 for _ in range(3)]}
    for r in stats.where("kind in (2, 3)").groupBy("kind", "lang", "a").agg(F.sum("n").alias("n")).collect():
        often[r.lang][r.kind - 1][r.a - 1] += r.n
    for r in common.groupBy("lang").agg(*totals).collect():
        often[r.lang][1] = [a + b for a, b in zip(often[r.lang][1], (r.n1, r.n2, r.n3, r.n4))]
    first = {r.lang: r for r in ends.groupBy("lang").agg(*totals).collect()}
    for name, r in first.items():
        often[name][0] = [r.n1, r.n2, r.n3, r.n4]
    cut = {name: [cuts(o) for o in orders] for name, orders in often.items()}
    weights = {name: float(cut[name][0] @ np.array([r.n1, r.n2, r.more]) / r.total) for name, r in first.items()}
    of_words = {r.y: np.array([r.total, r.n1, r.n2, r.more]) for r in common.groupBy("y").agg(*totals).collect()}
    of_pairs = {r.a: np.array([r.n, r.ones, r.twos, r.more]) for r in stats.where("kind = 8").groupBy("a").agg(*(F.sum(c).alias(c) for c in ("n", "ones", "twos", "more"))).collect()}

    by_lang = [(name, float(r.total), *map(float, cut[name][0])) for name, r in first.items()]
    # As an Arrow table: rows in a list would go through Python workers of another kind, which stay beside the others.
    by_lang = spark.createDataFrame(pa.table({c: pa.array([r[i] for r in by_lang], pa.float64() if i else pa.string()) for i, c in enumerate(("lang", "total", "d1", "d2", "d3"))}))
    share = (F.col("c") - F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))) / F.col("total")
    alphas = work.keep(ends.join(by_lang, "lang").select("z", "c", share.alias("alpha")), "alphas")
    for i in range(halves):
        work.drop(f"stats-{i}")
    work.drop("ends")
    least, number = 0, 0
    sizes = sorted(((r.c, r.n) for r in alphas.groupBy("c").agg(F.count("*").alias("n")).collect()), reverse=True)
    for c, n in sizes:
        number += n
        if number > known:
            least = c + 1
            break
    most = alphas.where(F.col("c") >= least).select("z", "alpha").toArrow().sort_by("z")
    kept = spark.sparkContext.broadcast((most["z"].to_numpy(), most["alpha"].to_numpy().astype(np.float32)))

    def find(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Discounted share of each word, and whether that is known here."""
        at, seen = _find(kept.value[0], words.view(np.int64))
        if not len(kept.value[0]):
            return np.zeros(len(words)), np.full(len(words), not least)
        return np.where(seen, kept.value[1][at], 0.0), seen | (not least)

    parts = []
    for turn in range(passes):
        blobs = rows.mapInArrow(lean(_dealer(route, turn, passes, shared, model_of, spell, find, weights, True)), BLOBS)
        if len(route.words):
            blobs = blobs.union(common.select("lang", "y", "z", "c").mapInArrow(lean(_spread(route, turn, passes)), BLOBS))
        blobs = blobs.repartition("shard").sortWithinPartitions("shard", "lang", "kind")
        scored = blobs.mapInArrow(lean(_scorer(route, cut, of_words, of_pairs, max(1, size // (8 * shard)))), SCORED)
        if least:  # words beyond the broadcast ones
            scored = work.keep(scored, f"scored-{turn}")
        part = scored.where("bucket is not null").select("bucket", "data").groupBy("bucket").applyInArrow(_trimmed(_add_up), "key bigint, s double")
        if least:
            late = scored.where("bucket is null").join(alphas.where(F.col("c") < least).select("z", "alpha"), "z", "left")
            late = late.select("key", F.log(F.col("p") + F.col("b") * F.coalesce("alpha", F.lit(0.0))).alias("s"))
            part = part.union(late).groupBy("key").agg(F.sum("s").alias("s"))
        parts.append(work.keep(part, f"part-{turn}"))
        if least:
            work.drop(f"scored-{turn}")
    work.drop("common")
    work.drop("alphas")

    # Equal rows have one key: their logarithms and their symbols are both summed over them.
    rows = work.keep(marked.select("doc_id", "lang", "key", "good", "text").mapInArrow(lean(_lengths), "doc_id bigint, lang string, key bigint, good boolean, symbols bigint"), "rows")
    if not few:
        work.drop("marked")
    summed = functools.reduce(DataFrame.union, parts).groupBy("key").agg(F.sum("s").alias("s"))
    length = rows.groupBy("key").agg(F.sum("symbols").alias("n")).where("n > 0")
    each = work.keep(summed.join(length, "key").select("key", F.exp(-F.col("s") / F.col("n")).alias("perplexity")), "each")
    for turn in range(passes):
        work.drop(f"part-{turn}")
    scored = work.keep(rows.join(each, "key", "left").select("doc_id", "lang", "good", "perplexity"), "scored")
    of = F.percentile_approx("perplexity", F.lit(quantile), F.lit(100_000)).alias("t")
    per_trusted = scored.where(held & F.col("good")).groupBy("lang").agg(of)
    limits = scored.groupBy("lang").agg(F.percentile_approx("perplexity", F.lit(quantile), F.lit(100_000)).alias("any")).join(per_trusted, "lang", "left")
    limits = work.keep(limits.select("lang", F.coalesce("t", "any").alias("threshold")).coalesce(1), "limits")
    work.only("scored", "limits")
    kept_row = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False))
    return scored.join(limits, "lang").select("doc_id", "lang", "perplexity", "threshold", kept_row.alias("kept"))


def _routed(marked: DataFrame, shards: int, sample: int, model_of, work: Workspace) -> Route:
    """The route with the words and pairs that are too common for one shard: at most 2 * shards of them."""
    if shards < 2:
        return Route(shards, {}, set())
    some = marked.where(F.pmod(F.xxhash64("key"), F.lit(sample)) == 0).select("lang", "text")
    found = some.mapInArrow(lean(_common(shards, model_of)), "what tinyint, a bigint, n bigint").groupBy("what", "a").agg(F.sum("n").alias("n"))
    found = work.keep(found, "frequent")
    total = found.where("what = 2").agg(F.sum("n")).first()[0] or 0
    often = found.where((F.col("what") < 2) & (F.col("n") * shards >= 1.5 * total)).collect() if total else []
    work.drop("frequent")
    ways = {int(np.int64(r.a).view(np.uint64)): min(shards, -(-r.n * shards // total)) for r in often if r.what == 0}
    return Route(shards, ways, {r.a for r in often if r.what == 1})

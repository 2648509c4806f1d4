"""Toxic spans by a linear-chain conditional random field (operator 8).

Features of a token are its lower-cased word and the first 4, 5 and 6 bytes of it.
Documents are labelled, tokens aren't, so token labels come from a greedy cover: the
feature that stands in most toxic documents not yet explained, and in nearly no others,
marks its tokens as toxic, until no feature explains enough of them. The field is trained
on these tokens; its chain runs over the tokens that have a known feature, with separate
transition weights for neighbours and for tokens further apart. Forward-backward marginals
give each token its chance to be toxic; a document's score is calibrated on the largest
marginal and on their sum, and runs of toxic tokens are reported with their offsets.

Training takes a bounded sample: at most ``sample_rows`` different rows of each label, of
texts up to ``sample_chars`` characters, chosen by a hash of the id, and never rows whose
crc32(doc_id as text) mod 5 is 0. Every whole text is scored, in one pass without a
shuffle. Labels, language, source and id are no inputs of a score.

Defined results: a null text is scored as an empty one; texts without known features get
the calibrated score of no evidence. Without toxic or without other training rows every
score is the smoothed share of toxic rows, or 0 without rows. Null doc_ids aren't held
out. Repeated rows are scored each; of repeated labels the largest counts. Other columns
are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import ALNUM, FOLD, lean, mix, prepare, slices, word_hashes, word_spans

SAMPLE_ROWS = 2500
SAMPLE_CHARS = 20_000
PREFIXES = (4, 5, 6)
#: A feature explains toxic documents if it stands in so many, and in so few others.
MIN_TOXIC, MAX_SHARE = 3, 0.02
MAX_FEATURES = 4000
SPANS = "array<struct<begin: bigint, end: bigint, marginal: double>>"


def token_features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, index of each row's first token; keys of each token's features, 0 for none."""
    starts, ends, first = word_spans(data, offs, ALNUM)
    keys = np.zeros((len(starts), 1 + len(PREFIXES)), np.uint64)
    keys[:, 0] = word_hashes(data, starts, ends, fold=True) | np.uint64(1 << 63)
    lower = np.concatenate([FOLD[data], np.zeros(8, np.uint8)])
    packed = np.zeros(len(starts), np.uint64)
    done = 0
    for i, size in enumerate(PREFIXES, 1):
        for j in range(done, size):
            packed |= lower[starts + j].astype(np.uint64) << np.uint64(8 * j)
        done = size
        keys[:, i] = np.where(ends - starts >= size, packed | np.uint64(size << 56), 0)
    return starts, ends, first, keys


@dataclass
class Field:
    """A trained field: feature keys (sorted) and weights, bias, transitions, calibration."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    #: [0: neighbours, 1: further apart][label before][label].
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2, 2)))
    #: Of the largest marginal, the logarithm of one plus their sum, and nothing.
    calibration: np.ndarray = field(default_factory=lambda: np.zeros(3))
    constant: float | None = 0.0

    def __post_init__(self) -> None:
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(mix(self.keys) >> np.uint64(48)).astype(np.int64)] = True

    def known(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token numbers and feature numbers of all known features."""
        flat = keys.reshape(-1)
        maybe = np.flatnonzero(self.seen[(mix(flat) >> np.uint64(48)).astype(np.int64)] & (flat > 0))
        if not len(maybe) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, flat[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == flat[maybe]
        return maybe[hit] // keys.shape[1], at[hit]

    def marginals(self, emission: np.ndarray, apart: np.ndarray) -> np.ndarray:
        """Chance of each token of one chain to be toxic, by forward and backward sums."""
        n = len(emission)
        e = np.zeros((n, 2))
        e[:, 1] = emission
        e = np.exp(e - e.max(axis=1, keepdims=True))
        moves = np.exp(self.moves)
        ahead = np.empty((n, 2))
        ahead[0] = e[0] / e[0].sum()
        for i in range(1, n):
            x = (ahead[i - 1] @ moves[apart[i]]) * e[i]
            ahead[i] = x / x.sum()
        out, back = np.empty(n), np.ones(2)
        for i in range(n - 1, -1, -1):
            x = ahead[i] * back
            out[i] = x[1] / x.sum()
            if i:
                back = moves[apart[i]] @ (e[i] * back)
                back /= back.sum()
        return out

    def score(self, largest: np.ndarray, total: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(largest), self.constant)
        x = np.stack([largest, np.log1p(total), np.ones(len(largest))], axis=1)
        return 1 / (1 + np.exp(-np.clip(x @ self.calibration, -30, 30)))

    def read(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        """Score and toxic spans (byte offsets in the row, mean marginal) of each row."""
        starts, ends, first, keys = token_features(data, offs)
        token, number = self.known(keys)
        rows = len(offs) - 1
        largest, total, spans = np.zeros(rows), np.zeros(rows), [[] for _ in range(rows)]
        if len(token):
            tokens, at = np.unique(token, return_index=True)
            emission = np.add.reduceat(self.weights[number], at) + self.bias
            row = np.searchsorted(first, tokens, side="right") - 1
            edges = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1], [True]]))
            for lo, hi in zip(edges, edges[1:]):
                place = tokens[lo:hi]
                apart = (np.diff(place, prepend=place[0]) > 1).astype(np.int64)
                p = self.marginals(emission[lo:hi], apart)
                r = row[lo]
                largest[r], total[r] = p.max(), p.sum()
                toxic = np.flatnonzero(p >= 0.5)
                for run in np.split(toxic, np.flatnonzero(np.diff(place[toxic]) > 1) + 1) if len(toxic) else []:
                    spans[r].append((int(starts[place[run[0]]] - offs[r]), int(ends[place[run[-1]]] - offs[r]), float(p[run].mean())))
        return self.score(largest, total), spans


def cover(sets: list[np.ndarray], toxic: np.ndarray) -> set[int]:
    """Features that explain toxic rows, greedily; ``sets`` holds each row's distinct features."""
    others = Counter(int(k) for s, t in zip(sets, toxic) if not t for k in s)
    where: dict[int, set[int]] = {}
    for i, (s, t) in enumerate(zip(sets, toxic)):
        if t:
            for k in s:
                where.setdefault(int(k), set()).add(i)
    share = max(1.0, (len(sets) - toxic.sum()) / max(1, toxic.sum()))
    # Rates of toxic and other rows, as if both were equally many.
    where = {k: rows for k, rows in where.items() if len(rows) >= MIN_TOXIC and others[k] / share <= MAX_SHARE * len(rows)}
    chosen: set[int] = set()
    while where:
        best = max(where, key=lambda k: (len(where[k]), -others[k], k))
        rows = where.pop(best)
        if len(rows) < MIN_TOXIC:
            break
        chosen.add(best)
        done = set(rows)
        for k in list(where):
            where[k] -= done
            if len(where[k]) < MIN_TOXIC:
                del where[k]
    return chosen


def train(texts: list[str], toxic: np.ndarray, rounds: int = 80) -> Field:
    """A field from whole texts and their labels (0, 1)."""
    n, n_toxic = len(texts), int(toxic.sum())
    if not n_toxic or n_toxic == n:
        return Field(constant=min(0.49, (n_toxic + 0.5) / (n + 1)) if n and not n_toxic else ((n_toxic + 0.5) / (n + 1) if n else 0.0))
    rows = [token_features(d, o) for _, _, d, o in slices(pa.array(texts), limit=0)]
    sets = [np.unique(keys[keys > 0]) for *_, keys in rows]
    # The same text more than once counts once.
    first = {text: i for i, text in reversed(list(enumerate(texts)))}
    once = np.array(sorted(first.values()))
    chosen = cover([sets[i] for i in once], toxic[once])
    support = Counter(int(k) for s in sets for k in s)
    signal = Counter(int(k) for s, t in zip(sets, toxic) if t for k in s)
    # Features that lean to toxic rows without explaining them compete with those that do.
    usual = n_toxic / n
    strong = sorted((k for k in signal if support[k] >= MIN_TOXIC and signal[k] >= 2 * usual * support[k] and k not in chosen), key=lambda k: (-signal[k] / support[k], -support[k], k))
    keys = np.array(sorted({*chosen, *strong[: MAX_FEATURES - len(chosen)]}), np.uint64)
    model = Field(keys=keys, weights=np.zeros(len(keys)), constant=None)
    marks = np.isin(keys, np.array(sorted(chosen), np.uint64))

    chains = []
    for *_, features in rows:
        token, number = model.known(features)
        tokens, at = np.unique(token, return_index=True)
        label = np.maximum.reduceat(marks[number], at) if len(at) else np.zeros(0, bool)
        chains.append((tokens, token, number, label))
    _fit(model, chains, rounds)

    largest, total = np.zeros(n), np.zeros(n)
    for i, (tokens, token, number, _) in enumerate(chains):
        if len(tokens):
            at = np.searchsorted(token, tokens)
            p = model.marginals(np.add.reduceat(model.weights[number], at) + model.bias, (np.diff(tokens, prepend=tokens[0]) > 1).astype(np.int64))
            largest[i], total[i] = p.max(), p.sum()
    model.calibration = _logistic(np.stack([largest, np.log1p(total), np.ones(n)], axis=1), toxic)
    return model


def _fit(model: Field, chains: list, rounds: int) -> None:
    """Gradient ascent (Adam) on the penalised log-likelihood, all chains at once, step by step."""
    used = [c for c in chains if len(c[0])]
    if not used:
        return
    longest = max(len(c[0]) for c in used)
    order = sorted(used, key=lambda c: -len(c[0]))
    width = len(order)
    label, apart, live = np.zeros((longest, width), np.int64), np.zeros((longest, width), np.int64), np.zeros((longest, width), bool)
    where, number = [], []
    for j, (tokens, token, feature, marked) in enumerate(order):
        k = len(tokens)
        label[:k, j], live[:k, j] = marked, True
        apart[:k, j] = np.diff(tokens, prepend=tokens[0]) > 1
        where.append(np.searchsorted(tokens, token) * width + j)
        number.append(feature)
    where, number = np.concatenate(where), np.concatenate(number)
    alive = live.sum(axis=1)
    total = live.sum()
    gold_emit = np.bincount(number, label.reshape(-1)[where], len(model.keys))
    gold_bias = (label * live).sum()
    gold_move = np.zeros((2, 2, 2))
    for i in range(1, longest):
        m = alive[i]
        np.add.at(gold_move, (apart[i, :m], label[i - 1, :m], label[i, :m]), 1)

    theta = np.zeros(len(model.keys) + 1 + 8)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        weights, bias, moves = theta[: len(model.keys)], theta[len(model.keys)], np.exp(theta[-8:].reshape(2, 2, 2))
        emission = np.bincount(where, weights[number], longest * width).reshape(longest, width) + bias
        e = np.exp(np.stack([np.minimum(0, -emission), np.minimum(0, emission)], axis=2))
        ahead = np.empty_like(e)
        ahead[0] = e[0] / e[0].sum(axis=1, keepdims=True)
        for i in range(1, longest):
            m = alive[i]
            x = np.einsum("js,jst->jt", ahead[i - 1, :m], moves[apart[i, :m]]) * e[i, :m]
            ahead[i, :m] = x / x.sum(axis=1, keepdims=True)
        back = np.ones((width, 2))
        p = np.zeros((longest, width))
        expect = np.zeros((2, 2, 2))
        for i in range(longest - 1, -1, -1):
            m = alive[i]
            x = ahead[i, :m] * back[:m]
            p[i, :m] = x[:, 1] / x.sum(axis=1)
            if i:
                right = e[i, :m] * back[:m]
                pair = ahead[i - 1, :m, :, None] * moves[apart[i, :m]] * right[:, None, :]
                pair /= pair.sum(axis=(1, 2), keepdims=True)
                for kind in (0, 1):
                    expect[kind] += pair[apart[i, :m] == kind].sum(axis=0)
                new = np.einsum("jst,jt->js", moves[apart[i, :m]], right)
                back[:m] = new / new.sum(axis=1, keepdims=True)
        slope = np.concatenate([gold_emit - np.bincount(number, p.reshape(-1)[where], len(model.keys)), [gold_bias - p.sum()], (gold_move - expect).reshape(-1)])
        slope = slope / np.sqrt(total) - 0.01 * theta
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope * slope
        theta = theta + 0.15 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    model.weights, model.bias, model.moves = theta[: len(model.keys)].copy(), float(theta[len(model.keys)]), theta[-8:].reshape(2, 2, 2).copy()


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    """Penalised logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - penalty * len(y) * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + penalty * len(y) * np.eye(len(w))
        w = w + np.linalg.solve(bend, slope)
    return w


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("bigint").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> Field:
    """Train on the labelled documents that aren't held out.

    At most ``sample_rows`` different rows (doc_id, text) of each label come to the driver,
    each of at most ``sample_chars`` characters, however often an id is repeated.
    """
    marks = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    marks = marks.where(~held_out(F.col("doc_id")))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") <= sample_chars)
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64("text"), F.col("text")]
    parts = []
    for label in (0, 1):
        picked = marks.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
        # At most sample_rows ids of 16 bytes each.
        rows = texts.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic").distinct()
        parts.append(rows.orderBy(*order).limit(sample_rows).toArrow())
    rows = pa.concat_tables(parts).sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return train(rows["text"].to_pylist(), rows["toxic"].to_numpy().astype(np.int64) if rows.num_rows else np.zeros(0, np.int64))


def _mapped(docs: DataFrame, model: Field, filtered: bool) -> DataFrame:
    """Adds score and spans to the rows; ``filtered``: only rows with a score under 0.5, unchanged."""
    prepare(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")
    names = docs.columns + ([] if filtered else ["score", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column(place)):
                scores, spans = model.read(data, offs)
                rows = batch.slice(lo, hi - lo)
                if filtered:
                    yield rows.filter(pa.array(scores < 0.5))
                    continue
                out = []
                for r, found in enumerate(spans):
                    if found:  # bytes to characters
                        chars = np.concatenate([[0], np.cumsum((data[offs[r] : offs[r + 1]] & 0xC0) != 0x80)])
                        found = [{"begin": int(chars[b]), "end": int(chars[e]), "marginal": m} for b, e, m in found]
                    out.append(found)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(scores), pa.array(out, kind)], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(lean(run), schema if filtered else f"{schema}, score double, spans {SPANS}")


def filter_rows(docs: DataFrame, model: Field) -> DataFrame:
    """The rows of ``docs`` whose text isn't taken as toxic, with all their columns."""
    return _mapped(docs.withColumn("text", F.col("text").cast("string")), model, True)


def tag(docs: DataFrame, model: Field) -> DataFrame:
    """doc_id, held_out, score, predicted, spans (characters) for every row of ``docs`` (doc_id, text)."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tagged = _mapped(texts, model, False)
    return tagged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")

"""Greedy selection by maximal marginal relevance with a moving query (IT-2, section 2.8).

The selection is serial within a request, so each request is one group; a pool is at most
some thousand rows. Across requests it runs in parallel.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.vectors import gumbel_number, hash_number
from cadenza.session import ship

RESULT = "query string, pos int, uri string, name string, artists array<string>, album string, similarity double, score double"


@dataclass(frozen=True)
class Selection:
    """Parameters. ``selection`` is softmax, argmax, gumbel or epsilon."""

    limit: int = 30
    weight: float = 0.7
    penalty_global: float = 0.03
    penalty_streak: float = 0.06
    free_streak: int = 2
    selection: str = "softmax"
    temperature: float = 0.12
    epsilon: float = 0.08
    top: int = 30
    inertia: float = 0.9
    noise: float = 0.01
    seed: int = 0
    max_per_artist: int | None = None
    enforce_max_per_artist: bool = False


@dataclass
class State:
    """What earlier picks leave: counts of artists, the last pick's artists, the streak's length."""

    counts: dict[str, int] = field(default_factory=dict)
    last: tuple[str, ...] = ()
    streak: int = 0

    def add(self, artists: list[str]) -> None:
        for a in artists:
            self.counts[a] = self.counts.get(a, 0) + 1
        self.streak = self.streak + 1 if set(artists) & set(self.last) else 1
        self.last = tuple(artists)


class Credits:
    """The candidates of each artist, and what the state says of each candidate."""

    def __init__(self, artists: list[list[str]], state: State) -> None:
        self.size, self.state = len(artists), state
        self.of: dict[str, list[int]] = {}
        for i, names in enumerate(artists):
            for a in names:
                self.of.setdefault(a, []).append(i)
        #: Sum of the counts of each candidate's artists, and the largest of them.
        self.total, self.most = np.zeros(self.size), np.zeros(self.size)
        for a, n in state.counts.items():
            self._count(a, n, n)

    def _count(self, artist: str, more: int, now: int) -> None:
        rows = self.of.get(artist)
        if rows is not None:
            np.add.at(self.total, rows, more)
            self.most[rows] = np.maximum(self.most[rows], now)

    def add(self, artists: list[str]) -> None:
        self.state.add(artists)
        for a in artists:
            self._count(a, 1, self.state.counts[a])

    def penalty(self, p: Selection) -> np.ndarray:
        shares = np.zeros(self.size, bool)
        for a in self.state.last:
            shares[self.of.get(a, [])] = True
        return p.penalty_global * self.total + p.penalty_streak * np.where(shares, max(0, self.state.streak - p.free_streak), 0)


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.sqrt((v * v).sum(axis=-1, keepdims=True))
    return v / np.where((n == 0) | np.isnan(n), 1.0, n)


def softmax_index(scores: np.ndarray, temperature: float, draw: float) -> int:
    """Inverse of the cumulative weights at draw in [0, 1); a NaN gives the last index, all zeros the first."""
    with np.errstate(over="ignore", invalid="ignore"):
        weights = np.exp(scores / max(1e-6, temperature))
        total = weights.sum()
        below = np.flatnonzero(draw * total - np.cumsum(weights) <= 0)
    return int(below[0]) if len(below) else len(scores) - 1


def select(vectors: np.ndarray, artists: list[list[str]], query: np.ndarray, p: Selection, state: State | None = None, name: str = "", uris: list[str] | None = None) -> tuple[list[int], list[float]]:
    """Indices of the picks in order, and the score of each when picked.

    The largest similarity of each candidate to the picks and the counts of its artists are
    kept from step to step, so a pick costs one matrix-vector product and an update of the
    candidates that share an artist with it. The first pick has no diversity term.

    All draws are hashes of ``name`` (the request), the step and the seed (RND-6): softmax
    takes one number and the inverse of the cumulative weights, gumbel one of each uri,
    epsilon two, the noise one of each component.
    """
    credits = Credits(artists, state or State())
    unit, q = _unit(vectors.astype(np.float64)), query.astype(np.float64)
    uris = uris if uris is not None else [str(i) for i in range(len(unit))]
    left = np.ones(len(unit), bool)
    nearest, picks, values = np.full(len(unit), -np.inf), [], []
    while len(picks) < p.limit and left.any():
        step = len(picks) + 1
        spread = nearest if picks else np.zeros(len(unit))
        scores = p.weight * (unit @ q) - (1 - p.weight) * spread - credits.penalty(p)
        open_rows = np.flatnonzero(left & (credits.most < p.max_per_artist) if p.enforce_max_per_artist and p.max_per_artist is not None else left)
        if not len(open_rows):
            break
        here = scores[open_rows]
        if p.selection == "softmax":
            at = softmax_index(here, p.temperature, hash_number("pick", name, step, p.seed))
        elif p.selection == "gumbel":
            at = int(np.argmax(here / max(1e-6, p.temperature) + np.array([gumbel_number(uris[i], name, step, p.seed) for i in open_rows])))
        elif p.selection == "epsilon" and picks and len(here) > 1 and hash_number("explore", name, step, p.seed) < p.epsilon:
            at = int(np.argsort(-here, kind="stable")[int(hash_number("pick", name, step, p.seed) * min(p.top, len(here)))])
        else:
            at = int(np.argmax(here))
        best = int(open_rows[at])
        left[best] = False
        picks.append(best)
        values.append(float(scores[best]))
        credits.add(artists[best])
        nearest = np.maximum(nearest, unit @ unit[best])
        q = _unit(p.inertia * q + (1 - p.inertia) * unit[best])
        if p.noise:
            q = _unit(q + p.noise * (2 * np.array([hash_number("noise", name, step, i, p.seed) for i in range(1, len(q) + 1)]) - 1))
    return picks, values


def rerank(pool: DataFrame, queries: DataFrame, p: Selection = Selection()) -> DataFrame:
    """The playlist of each query from its candidates; ``similarity`` is that to the original query."""
    ship(pool.sparkSession)

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, [("pos", "ascending"), ("uri", "ascending")])).combine_chunks()
        column = {c: rows[c].combine_chunks() for c in rows.column_names}
        vectors = column["embedding"].flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
        artists = [a or [] for a in column["artists"].to_pylist()]
        vector = np.asarray(column["vector"][0].as_py(), np.float64)
        picks, values = select(vectors, artists, vector, p, name=column["query"][0].as_py(), uris=column["uri"].to_pylist())
        out = rows.select(["query", "uri", "name", "artists", "album", "similarity"]).take(pa.array(picks, pa.int64()))
        out = out.add_column(1, "pos", pa.array(np.arange(1, len(picks) + 1, dtype=np.int32)))
        return out.append_column("score", pa.array(values, pa.float64()))

    columns = pool.select("query", F.col("pos").cast("int").alias("pos"), "uri", "name", "artists", "album", F.col("embedding").cast("array<double>").alias("embedding"), "similarity")
    joined = columns.join(queries.select("query", F.col("vector").cast("array<double>").alias("vector")), "query")
    return joined.groupBy("query").applyInArrow(run, RESULT)

"""Byte-level BPE encoding and decoding by prefix dynamic programming (operator 2).

The encoding of a byte string is the one sequence of tokens in which every two neighbours
*fit*: encoded together, they stay as they are. So every prefix has exactly one valid
last token, the token that ends there and fits the last token of the prefix before it.
Storing that token for every prefix gives the whole encoding by walking back, makes an
append cost only the appended bytes, and makes an edit cost only the pieces around it.

Text is first cut by the vocabulary's pattern and each match is encoded separately. A
worker keeps the encodings of pieces that it has seen in a table of bounded size.

Defined results: a null or empty text has no tokens; decoding gives back the UTF-8 bytes
of the text. Ids are stored as little-endian unsigned 32-bit integers in one binary value.
Rows with null or repeated doc_ids are encoded like any other; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import lean, prepare, resident, strings

RANKS = "byte_bpe_50k.tiktoken"
#: Pieces whose encodings a worker keeps.
CACHE_PIECES = 200_000
#: Code points below this are split by explicit character classes, which is faster.
PLAIN = 0x250
#: The code points of Unicode White_Space, which the pattern's \s means.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _explicit(pattern: str, classes: dict[str, str]) -> str:
    r"""The pattern with ``\p{L}``, ``\p{N}``, ``\s`` and ``\S`` written as characters."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        name = next((x for x in classes if pattern.startswith(x, i)), None)
        if name:
            out.append(classes[name] if inside else f"[{classes[name]}]")
            i += len(name)
        elif pattern.startswith("\\S", i) and not inside:
            out.append(f"[^{classes['\\s']}]")
            i += 2
        else:
            inside = pattern[i] == "[" or inside and pattern[i] != "]"
            out.append(pattern[i])
            i += 1
    return "".join(out)


class Splitter:
    """All matches of a pattern; text of low code points goes through the faster engine."""

    def __init__(self, pattern: str) -> None:
        def of(kind: str) -> str:
            return re.escape("".join(c for c in map(chr, range(PLAIN)) if unicodedata.category(c)[0] == kind))

        space = re.escape(SPACE)
        self.full = regex.compile(_explicit(pattern, {"\\s": space})).findall
        self.plain = re.compile(_explicit(pattern, {"\\p{L}": of("L"), "\\p{N}": of("N"), "\\s": space})).findall
        self.other = re.compile(f"[^\x00-{chr(PLAIN - 1)}]").search

    def __call__(self, text: str) -> list[str]:
        return self.plain(text) if text.isascii() or not self.other(text) else self.full(text)


class PrefixEncoder:
    """The unique valid last token of every prefix."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.unreachable: set[int] = set()
        self._fits: dict[int, bool] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                self._derive(token, rank)
        # Tokens by their bytes from the last to the first.
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for token, rank in ranks.items():
            if rank in self.unreachable:
                continue
            node = 0
            for byte in reversed(token):
                step = self.children[node].get(byte)
                if step is None:
                    step = len(self.children)
                    self.children[node][byte] = step
                    self.children.append({})
                    self.token.append(-1)
                node = step
            self.token[node] = rank

    def _derive(self, token: bytes, rank: int) -> None:
        """The last merge that makes a token: its two parts, by merging its bytes with lower ranks."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                found = self.ranks.get(parts[i] + parts[i + 1], rank)
                if found < best:
                    best, at = found, i
            if at < 0:
                self.unreachable.add(rank)
                return
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        self.parts[rank] = (self.ranks[parts[0]], self.ranks[parts[1]])

    def fits(self, a: int, b: int) -> bool:
        """Whether a followed by b stays so: no merge across the border comes first.

        The tokens are taken apart from the last merge back. At each step the border
        tokens could merge if their merge ranks before the one undone; of equal ranks the
        left one comes first.
        """
        key = a << 32 | b
        known = self._fits.get(key)
        if known is not None:
            return known
        limit, x, y, out = len(self.bytes) + (1 << 31), a, b, None
        while out is None:
            if self.ranks.get(self.bytes[x] + self.bytes[y], limit) < limit:
                out = False
            else:
                left, right = x if x in self.parts else -1, y if y in self.parts else -1
                if left < 0 and right < 0:
                    out = True
                elif left > right:
                    limit, x = left, self.parts[left][1]
                else:
                    limit, y = right + 1, self.parts[right][0]
        if len(self._fits) >= 250_000:
            self._fits.clear()
        self._fits[key] = out
        return out

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """Add to ``last``, which holds the last token of each prefix so far, those of the rest of ``data``."""
        children, token, fits = self.children, self.token, self._fits
        for end in range(len(last) + 1, len(data) + 1):
            node, start, found = 0, end, -1
            while start:
                start -= 1
                node = children[node].get(data[start])
                if node is None:
                    break
                t = token[node]
                if t >= 0:
                    if not start:
                        found = t
                        break
                    p = last[start - 1]
                    if p >= 0:
                        ok = fits.get(p << 32 | t)
                        if ok or ok is None and self.fits(p, t):
                            found = t
                            break
            last.append(found)
        return last

    def tokens(self, last: list[int]) -> list[int]:
        out, end = [], len(last)
        while end:
            t = last[end - 1]
            out.append(t)
            end -= len(self.bytes[t])
        out.reverse()
        return out

    def encode(self, data: bytes) -> list[int]:
        return self.tokens(self.extend(data, []))


class EncodedText:
    """A text with the prefix tables of its pieces: exact appends and edits without a new start."""

    def __init__(self, encoder: PrefixEncoder, split: Splitter, text: str = "") -> None:
        self.encoder, self.split = encoder, split
        self.pieces: list[str] = []
        self.tables: list[list[int]] = []
        self.append(text)

    def _table(self, piece: str, old: dict[str, list[int]] | None = None) -> list[int]:
        for start, table in (old or {}).items():
            if piece.startswith(start):
                return self.encoder.extend(piece.encode(), table)
        return self.encoder.extend(piece.encode(), [])

    def append(self, text: str) -> None:
        """Only the last two pieces can change (``'r`` and ``e``); a table is extended if its piece grows."""
        if not text:
            return
        tail, tables = self.pieces[-2:], self.tables[-2:]
        del self.pieces[-2:], self.tables[-2:]
        old = dict(zip(tail, tables))
        for piece in self.split("".join(tail) + text):
            self.pieces.append(piece)
            self.tables.append(self._table(piece, old))
            old = {k: v for k, v in old.items() if v is not self.tables[-1]}

    def replace(self, begin: int, end: int, text: str) -> None:
        """Put ``text`` in place of characters [begin, end); pieces are cut anew until a border is an old one."""
        starts = np.concatenate([[0], np.cumsum([len(p) for p in self.pieces])]).astype(int)
        i = max(0, int(np.searchsorted(starts, begin, side="right")) - 3)
        whole = "".join(self.pieces)
        new = whole[:begin] + text + whole[end:]
        shift = len(text) - (end - begin)
        borders = {int(s) + shift: k for k, s in enumerate(starts[:-1]) if s >= end}
        at, pieces, tables = int(starts[i]), [], []
        size = 1 << 12
        while at < len(new):
            part = self.split(new[at : at + size])
            more = at + size < len(new)
            if more and len(part) < 3:
                size *= 2
                continue
            for piece in part[:-2] if more else part:
                if at in borders and at > begin + len(text):
                    k = borders[at]
                    self.pieces[i:], self.tables[i:] = pieces + self.pieces[k:], tables + self.tables[k:]
                    return
                pieces.append(piece)
                tables.append(self._table(piece))
                at += len(piece)
        self.pieces[i:], self.tables[i:] = pieces, tables

    @property
    def ids(self) -> list[int]:
        return [t for table in self.tables for t in self.encoder.tokens(table)]


class _Cache(dict):
    """Encodings of pieces as packed ids, emptied when full."""

    def __init__(self, encoder: PrefixEncoder) -> None:
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_PIECES:
            self.clear()
        out = np.array(self.encoder.encode(piece.encode()), "<u4").tobytes()
        if len(piece) < 64:
            self[piece] = out
        return out


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}


def _tools(content: bytes, pattern: str) -> tuple[Splitter, _Cache]:
    key = hashlib.sha256(content + pattern.encode()).hexdigest()
    return resident(f"bpe:encode-{key}", lambda: (Splitter(pattern), _Cache(PrefixEncoder(read_ranks(content)))))


def _token_bytes(content: bytes) -> list[bytes]:
    def make() -> list[bytes]:
        ranks = read_ranks(content)
        table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        return table

    return resident(f"bpe:decode-{hashlib.sha256(content).hexdigest()}", make)


def _vocabulary(spark: SparkSession, path: str | None):
    """The rank file, a few MB at most, for every worker."""
    prepare(spark)
    with open(path or public_tokenizers.path(RANKS), "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def _ids(texts: pa.Array, split: Splitter, cache: _Cache) -> pa.Array:
    get = cache.__getitem__
    return pa.array([b"".join(map(get, split(text))) for text in texts.to_pylist()], pa.binary())


def _decoded(ids: pa.Array, table: list[bytes]) -> pa.Array:
    get = table.__getitem__
    return pa.array([b"".join(map(get, np.frombuffer(x.as_buffer(), "<u4").tolist())) if x.is_valid else b"" for x in ids], pa.binary())


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) for every row of ``docs`` (doc_id, text)."""
    held = _vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = _tools(held.value, pattern)
        for batch in batches:
            texts = strings(batch.column(1))
            for lo in range(0, len(texts), 1000):
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo : lo + 1000], _ids(texts[lo : lo + 1000], *tools)], names=["doc_id", "ids"])

    return _texts(docs).mapInArrow(lean(run), "doc_id bigint, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Adds ``decoded``, the bytes of the ids, to the rows that ``encode`` gives."""
    held = _vocabulary(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _token_bytes(held.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                yield pa.RecordBatch.from_arrays([*part.columns, _decoded(part.column(1), table)], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(lean(run), "doc_id bigint, ids binary, decoded binary")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """What ``decode`` gives for the ids of ``encode``, both in one pass."""
    held = _vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools, table = _tools(held.value, pattern), _token_bytes(held.value)
        for batch in batches:
            texts = strings(batch.column(1))
            for lo in range(0, len(texts), 1000):
                ids = _ids(texts[lo : lo + 1000], *tools)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo : lo + 1000], ids, _decoded(ids, table)], names=["doc_id", "ids", "decoded"])

    return _texts(docs).mapInArrow(lean(run), "doc_id bigint, ids binary, decoded binary")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded, then decoded from the ids."""
    both = round_trip(docs)
    return both.select("doc_id", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

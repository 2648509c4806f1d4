"""Token counts through a digest cache (operator 10).

A document's content is normalised and its SHA-256 joined, together with the digest of the
tokenizer file, to the counts that the cache table holds. Only one copy of each content
that misses is encoded, its count is appended to the cache, and all documents then take
their counts from the cache.

The library decides every count. The file says how: if it lower-cases text, cuts it by a
pattern that no white space matches and encodes each piece on its own, then runs of ASCII
white space are one space in the normalised content, and a worker encodes each distinct
piece once with the library and adds up the counts of a text's pieces. Texts with code
points of 0x250 and more, where normalisation can change characters, and all texts under
any other file, go through the library as a whole, and content is what it is.

Scale: digests alone are joined with the cache. The digests that miss are broadcast while
they number at most ``BROADCAST_MISSES``, so that no text of a hit is shuffled; more are
joined, with the same result. One copy per digest is taken before the shuffle, so copies
cost nothing after it.

Defined results: a null text counts as empty: 0 bytes, 0 tokens. Rows with null or
repeated doc_ids are counted like any other; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.byte_bpe import Splitter
from cadenza.llm.common import Workspace, lean, resident, strings

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
CACHE_PIECES = 300_000
BROADCAST_MISSES = 1_000_000
CACHE = "tokenizer string, digest binary, n_tokens bigint"
#: The one character below 0x250 that grows a combining mark in lower case.
DOTTED = "İ"


def rules(content: bytes) -> tuple[str, list[str]] | None:
    """The pattern and the special tokens of a file whose texts can be counted piece by piece, else None."""
    try:
        file = json.loads(content)
    except (UnicodeDecodeError, ValueError):
        return None
    steps = (file.get("normalizer") or {}).get("normalizers") or []
    cut = (file.get("pre_tokenizer") or {}).get("pretokenizers") or []
    folded = [x.get("type") for x in steps] == ["NFC", "Replace", "Lowercase"] and (steps[1].get("pattern"), steps[1].get("content")) == ({"Regex": "\\s+"}, " ")
    if not folded or [x.get("type") for x in cut] != ["Split", "ByteLevel"]:
        return None
    split, byte_level = cut
    plain = split.get("behavior") == "Removed" and split.get("invert") and not byte_level.get("add_prefix_space") and not byte_level.get("use_regex")
    pattern = (split.get("pattern") or {}).get("Regex", "")
    # No piece may hold or depend on white space.
    bare = re.sub(r"\[\^[^\]]*\\s[^\]]*\]", "", pattern)
    if not plain or not pattern or re.search(r"\s|\\[sSbBAZzWDX]|\(\?|[\^$.]", bare) or "[^" in bare:
        return None
    special = file.get("added_tokens") or []
    if any(t.get(k) for t in special for k in ("normalized", "single_word", "lstrip", "rstrip")):
        return None
    return pattern, sorted((t["content"] for t in special), key=len, reverse=True)


class Library:
    """Counts of whole texts, by tokenizers or, for files that aren't JSON, by sentencepiece."""

    def __init__(self, content: bytes) -> None:
        self.model = None
        if content.lstrip()[:1] == b"{":
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_str(content.decode())
            self.model.no_truncation()
            self.model.no_padding()
        else:
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_proto=content)

    def count(self, texts: list[str]) -> list[int]:
        if self.model is None:
            return [len(x) for x in self.pieces.encode(texts, num_threads=1)]
        return [len(x.ids) for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]


class PieceCounter:
    """Token counts of texts from the library's counts of their pieces."""

    def __init__(self, content: bytes, pattern: str, special: list[str]) -> None:
        self.library = Library(content)
        self.split = Splitter(pattern)
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")
        self.known: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        out, cut = [], []
        for text in texts:
            if not text.isascii() and (self.split.other(text) or DOTTED in text):
                out.append(self.library.count([text])[0])
                cut.append([])
                continue
            parts = self.special.split(text)
            out.append(len(parts) - 1)
            cut.append([p for part in parts for p in self.split.plain(part.lower())])
        known = self.known
        if len(known) > CACHE_PIECES:
            known.clear()
        missing = list({p for pieces in cut for p in pieces if p not in known})
        known.update(zip(missing, self.library.count(missing)))
        get = known.__getitem__
        return [n + sum(map(get, pieces)) for n, pieces in zip(out, cut)]


def _counter(content: bytes) -> Library | PieceCounter:
    found = rules(content)
    return resident(f"counts:{hashlib.sha256(content).hexdigest()}", lambda: PieceCounter(content, *found) if found else Library(content))


def count_tokens(docs: DataFrame, path: str | None = None, cache: str | None = None, limit: int = LIMIT, broadcast_misses: int = BROADCAST_MISSES, work: Workspace | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs`` (doc_id, text).

    ``cache`` is the folder of the cache table, kept between runs and shared by all
    executors; without it the run has a cache of its own.
    """
    spark = docs.sparkSession
    work = work or Workspace(spark)
    own, cache = cache is None, cache or f"{work.root}/cache"
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as file:
        content = file.read()
    version = hashlib.sha256(content).hexdigest()
    held = spark.sparkContext.broadcast(content)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = F.trim(F.regexp_replace(text, "[ \\t\\n\\x0B\\f\\r]+", " ")) if rules(content) else text
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.octet_length(text).cast("bigint").alias("n_bytes"), F.unhex(F.sha2(plain, 256)).alias("digest"), plain.alias("plain"))

    # Makes the folder of a new cache readable.
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)

    def stored() -> DataFrame:
        return spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(held.value)
        for batch in batches:
            texts = strings(batch.column(1))
            for lo in range(0, len(texts), 500):
                counts = counter.count(texts[lo : lo + 500].to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([version] * len(counts)), batch.column(0)[lo : lo + 500], pa.array(counts, pa.int64())], names=["tokenizer", "digest", "n_tokens"])

    wanted = rows
    if not own and not stored().isEmpty():
        missing = work.keep(rows.select("digest").distinct().join(stored().select("digest"), "digest", "left_anti"), "missing")
        few = missing.count() <= broadcast_misses
        wanted = rows.join(F.broadcast(missing) if few else missing, "digest", "left_semi")
    misses = wanted.groupBy("digest").agg(F.first("plain").alias("plain"))
    work.append(misses.select("digest", "plain").mapInArrow(lean(run), CACHE), cache)
    # As a table, so that the join can split a digest that many documents share.
    counts = work.keep(stored(), "counts")
    counted = rows.select("doc_id", "n_bytes", "digest").join(counts, "digest")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

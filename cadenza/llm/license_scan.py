"""Fuzzy search for short licence notices (operator 1).

A notice of which at most k characters may be edited is split into k + 1 pieces: by the
pigeonhole principle one piece stands unchanged in every such match. All pieces of all
notices are sought at once by one Aho-Corasick automaton; around each piece found, the
regex library's bounded-error matching verifies the edits and reports the span. Base
phrases are sought as whole words without edits by the same automaton.

Both work on the words of the text with A-Z lower-cased, joined by one space, so that
punctuation and line breaks don't matter; non-ASCII characters are parts of words, and an
edit is one of a character.

Everything happens within a row: no shuffle, and memory for one batch of texts.

Defined results: a null text counts as empty; without a place, first_word and last_word
are null, labels empty, score 0. Rows with null or repeated doc_ids are scanned like any
other; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import ALNUM, FOLD, lean, prepare, resident, strings

#: The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices, their labels and the edits allowed.
NOTICES = (
    ("gnu general public license", "gpl", 2),
    ("gnu lesser general public license", "lgpl", 2),
    ("gnu affero general public license", "agpl", 2),
    ("apache license version 2", "apache", 2),
    ("released under the mit license", "mit", 2),
    ("permission is hereby granted free of charge to any person", "mit", 4),
    ("redistribution and use in source and binary forms", "bsd", 3),
    ("mozilla public license", "mpl", 2),
    ("licensed under cc by nc", "cc-by-nc", 1),
    ("licensed under cc by sa", "cc-by-sa", 1),
    ("creative commons attribution", "cc-by", 2),
    ("gnu free documentation license", "gfdl", 2),
    ("eclipse public license", "epl", 2),
    ("boost software license", "bsl", 2),
    ("european union public licence", "eupl", 2),
    ("bsd 3 clause license", "bsd", 2),
    ("isc license", "isc", 0),
    ("this is free and unencumbered software released into the public domain", "unlicense", 4),
    ("licensed under cc by nd", "cc-by-nd", 1),
    ("creative commons zero", "cc0", 1),
    ("dedicated to the public domain", "public-domain", 2),
    ("spdx license identifier mit", "mit", 1),
    ("spdx license identifier apache", "apache", 1),
    ("spdx license identifier gpl", "gpl", 1),
    ("spdx license identifier lgpl", "lgpl", 1),
    ("spdx license identifier agpl", "agpl", 1),
    ("spdx license identifier bsd", "bsd", 1),
    ("spdx license identifier mpl", "mpl", 1),
    ("spdx license identifier cc by", "cc-by", 1),
    ("spdx license identifier cc0", "cc0", 1),
    ("all rights reserved", "reserved", 1),
)
SPANS = "array<struct<label: string, first_word: bigint, last_word: bigint, edits: int>>"
SCHEMA = f"doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans {SPANS}"

_TABLE = bytes(int(FOLD[i]) if ALNUM[i] else 0x20 for i in range(256))


class Scanner:
    def __init__(self, base: dict[str, str], notices: tuple) -> None:
        self.base, self.notices = base, notices
        pieces: dict[str, list[tuple[int, int]]] = {}
        for phrase in base:
            pieces.setdefault(f" {phrase} ", []).append((-1, 0))
        self.patterns = []
        for number, (phrase, _, edits) in enumerate(notices):
            cuts = [len(phrase) * i // (edits + 1) for i in range(edits + 2)]
            for begin, end in zip(cuts, cuts[1:]):
                pieces.setdefault(phrase[begin:end], []).append((number, begin))
            self.patterns.append(regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(phrase)}){{e<={edits}}}(?![^ ])"))
        self.seeds = ahocorasick.Automaton()
        for piece, uses in pieces.items():
            self.seeds.add_word(piece, (piece, uses))
        self.seeds.make_automaton()

    def scan(self, raw: bytes) -> tuple[int, list[tuple[str, int]], list[tuple[str, int, int, int]]]:
        """Number of words, base places (label, first word), verified spans (label, first, last word, edits).

        Time is proportional to the text and its places: words are counted once, and a window
        whose text was verified before has the same matches.
        """
        words = raw.translate(_TABLE).split()
        text = (b" " + b" ".join(words) + b" ").decode()
        places: list[tuple[str, int]] = []
        best: dict[tuple[str, int, int], int] = {}
        tried: set[tuple[int, int]] = set()
        verified: dict[tuple[int, str], tuple[int, int, int] | None] = {}
        begins: list[int] = []  # of each word, once they are needed
        for end, (piece, uses) in self.seeds.iter(text):
            if not begins:
                begins = np.cumsum([1, *(len(w) + 1 for w in text.split())]).tolist()
            start = end - len(piece) + 1
            for number, offset in uses:
                if number < 0:
                    places.append((self.base[piece[1:-1]], bisect_right(begins, start + 1) - 1))
                    continue
                phrase, label, edits = self.notices[number]
                window = start - offset - edits
                if (number, window) in tried:
                    continue
                tried.add((number, window))
                low = max(0, window - 1)
                part = text[low : window + len(phrase) + 2 * edits + 2]
                if (number, part) not in verified:
                    found = self.patterns[number].search(part, 1 if window > 0 else 0, len(part) - 1 if low + len(part) < len(text) else len(part))
                    if found:
                        begin, stop = found.span()
                        verified[number, part] = begin + (found[0][:1] == " "), stop - (found[0][-1:] == " "), sum(found.fuzzy_counts)
                    else:
                        verified[number, part] = None
                if (match := verified[number, part]) is not None:
                    begin, stop, count = match
                    span = label, bisect_right(begins, low + begin) - 1, bisect_right(begins, low + stop - 1) - 1
                    best[span] = min(best.get(span, edits), count)
        return len(words), places, [(*span, edits) for span, edits in sorted(best.items())]


def _score(places: list, spans: list) -> float:
    """1 for an exact place; a fuzzy span loses a tenth per edit."""
    return max([1.0 if places else 0.0, *(max(0.0, 0.95 - 0.1 * edits) for *_, edits in spans)])


def scan(docs: DataFrame, base: dict[str, str] | None = None, notices: tuple = NOTICES) -> DataFrame:
    """One row for every row of ``docs`` (doc_id, text), with labels and the verified spans."""
    prepare(docs.sparkSession)
    base = BASE if base is None else base

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = resident(f"licences:{sorted(base.items())}-{notices}", lambda: Scanner(base, notices))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())]))]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        for batch in batches:
            rows = []
            for text in strings(batch.column(1)):
                n, places, spans = scanner.scan(text.as_buffer().to_pybytes())
                at = [p for _, p in places]
                plain = {label for label, _ in places}
                every = plain | {s[0] for s in spans}
                rows.append((n, len(places), min(at, default=None), max(at, default=None), ",".join(sorted(plain)), ",".join(sorted(every)), _score(places, spans), [dict(zip(("label", "first_word", "last_word", "edits"), s)) for s in spans]))
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *names])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(lean(run), SCHEMA)

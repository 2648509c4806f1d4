"""Names, paths and files (STR-*, ARR-6)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The extensions of audio files.
AUDIO = (".mp3", ".flac", ".wav", ".m4a", ".ogg")


def sanitize(name: Column) -> Column:
    """``/``, ``:`` and ``?`` as ``_``, no white space around; null as empty."""
    return F.coalesce(F.regexp_replace(F.regexp_replace(name, "[/:?]", "_"), r"^\s+|\s+$", ""), F.lit(""))


def basename(key: Column) -> Column:
    return F.element_at(F.split(key, "/"), -1)


def extension(key: Column) -> Column:
    return F.lower(F.regexp_extract(basename(key), r"[^.](\.[^.]*)$", 1))


def stem(key: Column) -> Column:
    """The file name without its extension."""
    return F.regexp_replace(basename(key), r"(?<=[^.])\.[^.]*$", "")


#: Fixed value: a file name with its number on an album.
NUMBERED = r"^(\d{2})\s*-\s*(.+)$"


def unnumbered(name: Column) -> Column:
    """What follows two digits and a dash; empty if the name doesn't start so."""
    return F.regexp_extract(name, NUMBERED, 2)


def dictionary_names(text: Column, names: list[str], match: str = "substring") -> Column:
    """The names that the text contains, in the order of ``names``.

    ``substring`` finds a name inside other words too; ``exact`` takes the text as a list
    separated by ", ".
    """
    known = F.array(*(F.lit(n) for n in names))
    if match == "exact":
        parts = F.split(text, ", ")
        return F.filter(known, lambda n: F.array_contains(parts, n))
    return F.filter(known, lambda n: F.contains(text, n))

"""Chat formatting with a role automaton and loss flags (operator 9, DataFrame functions only).

A template names for each role the text before and after a turn and whether the turn
counts for the loss. A finite-state machine over roles says whether the order of turns is
valid. The output of a conversation is its segments, texts with a loss flag each, and
their concatenation. Inside turns, each of the characters ``\\``, ``<`` and ``[`` is
followed by a ``\\``, so that no control string can occur there; taking that ``\\`` away
again gives the turn back.

A conversation's turns must meet in one row, as its text is one string; no other rows
meet. Turns are ordered by turn, then role and text.

Defined results: null roles and texts count as empty, null turns come first, repeated rows
are turns of their own. A null conv_id is one conversation. Roles that the template
doesn't name are written with their name and make the conversation invalid, as does a
wrong order. An empty table has no rows. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: role: (text before, text after, counts for the loss).
TEMPLATE = {
    "system": ("<sys>", "</sys>", False),
    "user": ("[INST] ", " [/INST]", False),
    "assistant": ("<reply>", "</s>", True),
}
BEGIN = "<s>"
#: Roles without a template entry: <role NAME>TEXT</role>, the name URL-encoded.
OTHER = ("<role ", ">", "</role>")
#: state: {role: next state}; what isn't listed leads to "invalid".
ORDER = {
    "start": {"system": "told", "user": "asked"},
    "told": {"user": "asked"},
    "asked": {"assistant": "answered"},
    "answered": {"user": "asked"},
}
FINAL = "answered"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"[\\<\[]", r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[])\\", "$1")


def _by_role(role: Column, of, other: Column) -> Column:
    out = other
    for name, entry in TEMPLATE.items():
        out = F.when(role == name, of(entry)).otherwise(out)
    return out


def _step(state: Column, role: Column) -> Column:
    moves = [((state == here) & (role == name), there) for here, row in ORDER.items() for name, there in row.items()]
    return reduce(lambda out, move: F.when(move[0], F.lit(move[1])).otherwise(out), moves, F.lit("invalid"))


def _segments(turn: Column) -> Column:
    role = turn["role"]
    named = F.concat(F.lit(OTHER[0]), F.url_encode(role), F.lit(OTHER[1]))
    parts = (
        (_by_role(role, lambda e: F.lit(e[0]), named), F.lit(False)),
        (escape(turn["text"]), _by_role(role, lambda e: F.lit(e[2]), F.lit(False))),
        (_by_role(role, lambda e: F.lit(e[1]), F.lit(OTHER[2])), F.lit(False)),
    )
    return F.array(*(F.struct(text.alias("text"), loss.alias("loss")) for text, loss in parts))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, segments, formatted, valid for each conversation of ``turns`` (conv_id, turn, role, text)."""
    row = F.struct(F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    grouped = turns.groupBy(F.col("conv_id").cast("bigint").alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("turns"))
    start = F.array(F.struct(F.lit(BEGIN).alias("text"), F.lit(False).alias("loss")))
    state = F.aggregate("turns", F.lit("start"), lambda s, t: _step(s, t["role"]))
    made = grouped.select("conv_id", F.concat(start, F.flatten(F.transform("turns", _segments))).alias("segments"), (state == FINAL).alias("valid"))
    return made.select("conv_id", "segments", F.array_join("segments.text", "").alias("formatted"), "valid")


def read_back(formatted: Column) -> Column:
    """The turns, (role, text) structs, that a formatted conversation holds."""
    # Only control strings have a "<" or "[" without a "\\" after it.
    parts = F.split(formatted, r"[<\[](?!\\)")

    def turn(part: Column) -> Column:
        out = F.struct(F.url_decode(F.substring_index(F.substr(part, F.lit(len(OTHER[0]))), OTHER[1], 1)).alias("role"), unescape(F.substr(part, F.instr(part, OTHER[1]) + len(OTHER[1]))).alias("text"))
        for name, (before, after, _) in TEMPLATE.items():
            inner = F.substr(part, F.lit(len(before)))
            spare = len(after) - len(after.lstrip())
            inner = F.substr(inner, F.lit(1), F.length(inner) - spare) if spare else inner
            out = F.when(part.startswith(before[1:]), F.struct(F.lit(name).alias("role"), unescape(inner).alias("text"))).otherwise(out)
        return out

    starts = [before[1:] for before, _, _ in TEMPLATE.values()] + [OTHER[0][1:]]
    return F.transform(F.filter(parts, lambda p: reduce(lambda a, b: a | b, (p.startswith(s) for s in starts))), turn)


def summary(formatted: DataFrame) -> DataFrame:
    """Counts and digests of each formatted conversation, all read back from the output."""
    read = formatted.select("conv_id", "valid", "formatted", read_back(F.col("formatted")).alias("turns"), unescape(F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), "")).alias("loss_text"))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        "valid",
    )


def with_control_strings(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The conversations and one more, number -7, whose texts are control strings."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    return conversations.select("conv_id", "turn", "role", "text").union(extra)


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, lag(role, 1, '') OVER o AS before, lead(role, 1, '') OVER o AS after,
    length(regexp_replace(text, '[\\<\[]', '\0' || '\\', 'g')) + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 15 WHEN 'assistant' THEN 11
      ELSE 14 + length(url_encode(role)) END AS chars
  FROM turns WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(chars) AS BIGINT) AS formatted_chars,
  bool_and(CASE before WHEN '' THEN role IN ('system', 'user') WHEN 'system' THEN role = 'user' WHEN 'user' THEN role = 'assistant' WHEN 'assistant' THEN role = 'user' ELSE false END
    AND (after <> '' OR role = 'assistant')) AS valid
FROM sized GROUP BY conv_id
"""

"""Benchmark decontamination by MinHash containment search (operator 5, DataFrame functions only).

Finds benchmark items of which a document contains at least 0.8 of the distinct five-word
shingles, however long the document is. Items are partitioned by size: class p holds the
items of 2^p to 2^(p+1)-1 shingles. The signature of an item is the smallest values of one
permutation of its shingle hashes (a bottom-k MinHash), and each class has its own k: a
document with 0.8 of an item's shingles misses at most a fifth of them, so with k of more
than a fifth of the class's largest size one of the k values must be in the document.
Candidates therefore miss nothing; they are verified by exact containment of full sets.

Words are those of the text in lower case, split at ASCII characters that are neither
letters nor digits; a text of fewer than five words has its whole sequence as one shingle.
An item that short is sought in documents of any length, as the same words in a row; the
SQL finds it only as a whole text, and has the same results where no item is that short.

Scale: documents are read once and not shuffled. Signatures are broadcast only while they
number at most ``BROADCAST_ROWS``; beyond that, (document, shingle) rows are joined by
shuffles instead, with the same result.

Defined results: null and empty texts, on either side, have no shingles and no result.
Repeated rows give one result. Rows that repeat an id, on either side, are each judged by
their own text. A null doc_id or item_id stays null in the result. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import Workspace

SHINGLE = 5
SIMILARITY = 0.8
BROADCAST_ROWS = 500_000
#: ASCII characters that separate words.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def with_words(docs: DataFrame, key: str) -> DataFrame:
    words = F.array_remove(F.split(F.lower(F.col("text").cast("string")), SEPARATORS), "")
    return docs.select(F.col(key).cast("bigint").alias(key), words.alias("words"), F.xxhash64(F.col("text").cast("string")).alias("digest"))


def _shingles(words: Column, k: int, lengths: tuple[int, ...] = ()) -> Column:
    """Shingles of k words, and those of an item of n words for each n of ``lengths``."""

    def run(w: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.xxhash64(F.array_join(F.slice(w, i, n), " "), F.lit(n)))

    def of(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k))))
        short = F.array(F.xxhash64(F.array_join(w, " "), F.size(w)))
        out = F.when(F.size(w) >= k, grams).when(F.size(w) > 0, short).otherwise(F.array().cast("array<bigint>"))
        runs = [F.when(F.size(w) >= n, run(w, n)).otherwise(F.array().cast("array<bigint>")) for n in lengths]
        return F.concat(out, *runs) if runs else out

    # As a variable of a lambda the words are split once, not again for every shingle.
    return F.get(F.transform(F.array(words), of), F.lit(0))


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, k: int = SHINGLE, broadcast_rows: int = BROADCAST_ROWS, work: Workspace | None = None) -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared, containment of each document and item it contains."""
    found = contaminated_rows(docs, benchmark, similarity, k, broadcast_rows, work).drop("digest").distinct()
    return found.select("doc_id", "item_id", F.col("q").alias("n_shingles"), "n_shared", (F.col("n_shared") / F.col("q")).alias("containment"))


def contaminated_rows(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, k: int = SHINGLE, broadcast_rows: int = BROADCAST_ROWS, work: Workspace | None = None) -> DataFrame:
    """doc_id, digest, item_id, q, n_shared; ``digest`` tells rows with one doc_id apart by their text."""
    work = work or Workspace(docs.sparkSession)
    items = with_words(benchmark, "item_id")
    sizes = items.select(F.size("words").alias("n")).where(f"n between 1 and {k - 1}").distinct()
    lengths = tuple(sorted(row.n for row in sizes.collect()))
    items = items.select("item_id", F.array_distinct(_shingles(F.col("words"), k)).alias("grams"))
    items = work.keep(items.select("item_id", "grams", F.size("grams").cast("bigint").alias("q")).where("q > 0").distinct(), "items")
    largest = F.pow(F.lit(2.0), F.floor(F.log2("q")) + 1) - 1
    kept = F.floor(largest * (1 - similarity) + 1e-9).cast("int") + 1
    ordered = F.sort_array(F.transform("grams", lambda g: F.struct(F.xxhash64(g, F.lit(k)).alias("h"), g.alias("gram"))))
    smallest = items.withColumn("s", F.slice(ordered, 1, kept))
    signature = work.keep(smallest.select("item_id", F.xxhash64("grams").alias("item"), "q", F.explode("s.gram").alias("gram")), "signature")

    sets = with_words(docs, "doc_id").select("doc_id", "digest", _shingles(F.col("words"), k, lengths).alias("sh"))
    enough = F.col("n_shared") >= F.ceil(F.col("q") * similarity - 1e-9)
    if signature.count() <= broadcast_rows:
        hit = sets.select("doc_id", "digest", "sh", F.explode("sh").alias("gram")).join(F.broadcast(signature.select("item_id", "gram")), "gram")
        whole = F.broadcast(items.toDF("item", "grams", "q"))
        shared = F.size(F.array_intersect("grams", "sh")).cast("bigint")
        pairs = hit.join(whole, F.col("item_id").eqNullSafe(F.col("item"))).select("doc_id", "digest", "item_id", "q", shared.alias("n_shared"))
        return pairs.where(enough).distinct()
    unit = ["doc_id", "digest", "item_id", "item", "q"]
    rows = sets.select("doc_id", "digest", F.explode(F.array_distinct("sh")).alias("gram")).distinct()
    every = work.keep(items.select("item_id", F.xxhash64("grams").alias("item"), "q", F.explode("grams").alias("gram")), "every")
    candidates = rows.join(signature, "gram").select(unit).distinct()
    same = F.lit(True)
    for c in unit:
        same &= F.col(f"c.{c}").eqNullSafe(F.col(f"m.{c}"))
    counted = rows.join(every, "gram").groupBy(unit).agg(F.count("*").alias("n_shared"))
    found = counted.alias("m").join(candidates.alias("c"), same, "left_semi").where(enough)
    return found.select("doc_id", "digest", "item_id", "q", "n_shared").distinct()


ORACLE = """
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, list_filter(regexp_split_to_array(lower(text), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') FROM benchmark
), grams AS (
  SELECT DISTINCT side, id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ') || ' #'] ELSE [] END) AS g
  FROM words
), items AS (SELECT id, g, count(*) OVER (PARTITION BY id) AS q FROM grams WHERE side = 'b')
SELECT d.id AS doc_id, i.id AS item_id, CAST(i.q AS BIGINT) AS n_shingles, CAST(count(*) AS BIGINT) AS n_shared, count(*) / CAST(i.q AS DOUBLE) AS containment
FROM items i JOIN grams d ON d.side = 'd' AND d.g = i.g
GROUP BY d.id, i.id, i.q
HAVING count(*) >= ceil(i.q * 0.8 - 1e-9)
"""

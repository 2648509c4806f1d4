"""A corpus from raw documents to tokens: toxicity, near-dedup, substring dedup, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but
the last return the columns of documents (doc_id, text, lang, source, n_chars). With a
workspace as a fourth argument a stage's tables can be deleted once its result is written. A table
with other or missing columns is read as if it had these, missing ones null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import byte_bpe, decontaminate, minmax_dedup, substring_dedup, toxicity_crf
from cadenza.llm.common import Workspace

KINDS = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*((F.col(c) if c in docs.columns else F.lit(None)).cast(kind).alias(c) for c, kind in KINDS.items()))


#: Least similarity of near duplicates, in percent.
SIMILARITY = 80

def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` but those of ``gone`` (doc_id, tk: a hash of the text); ids may be null or repeated."""
    same = docs.doc_id.eqNullSafe(gone.doc_id) & (F.xxhash64(docs.text) == gone.tk)
    return docs.join(gone, same, "left_anti").select(*KINDS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str, work: Workspace | None = None) -> DataFrame:
    """Documents that the tagger doesn't take as toxic. The text goes along, so nothing is joined."""
    docs = _documents(docs)
    model = toxicity_crf.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity_crf.filter_rows(docs, model)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str, work: Workspace | None = None) -> DataFrame:
    """One document of each group of near duplicates (0.8 or more), the one with the smallest doc_id."""
    docs, work = _documents(docs), work or Workspace(spark)
    dropped = work.keep(minmax_dedup.linked_rows(docs, SIMILARITY, work).where("not kept").select("doc_id", "tk").distinct(), "dropped")
    work.only("dropped")
    return _without(docs, dropped)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, work: Workspace | None = None) -> DataFrame:
    """Documents without the passages that an earlier one has; texts are left as words and single spaces."""
    docs = _documents(docs)
    return substring_dedup.remove_repeats(docs, extra=("lang", "source"), work=work).select(
        "doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("bigint").alias("n_chars")
    )


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str, work: Workspace | None = None) -> DataFrame:
    """Documents without 0.8 or more of a benchmark item."""
    docs, work = _documents(docs), work or Workspace(spark)
    rows = decontaminate.contaminated_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), work=work)
    found = work.keep(rows.select("doc_id", F.col("digest").alias("tk")).distinct(), "found")
    work.only("found")
    return _without(docs, found)


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, work: Workspace | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and of the bytes decoded from them."""
    return byte_bpe.digests(_documents(docs))


STAGES = [
    ("toxicity", toxicity),
    ("minhash_dedup", minhash_dedup),
    ("substring_dedup", substring_dedup_stage),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe_stage),
]

#: A trained tagger can't be written in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``. A stage's work tables go when its result is written, its input with them.

    Runs have tables of their own, so several may go on in one session. What the result
    reads, the documents after the last stage but one, goes when the driver ends.
    """
    kept = Workspace(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        work = Workspace(spark)
        docs = kept.keep(stage(spark, docs, sf_dir, work), name)
        work.release()
        if before:
            kept.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)

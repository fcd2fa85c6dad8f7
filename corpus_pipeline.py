"""The corpus pipeline: five stages, each an operator of tactus.llm applied to what the stage before it kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, and
``mix`` also each one's position, by which the last sorts its rows.
``run`` writes each stage's rows to the shared folder and reads them again, so a lost executor costs one stage at most.

Edge cases, for every stage: a null text counts as empty and stays null where rows go on; ids may be null or repeat; rows that
repeat wholly are one group of copies; ties go to the least doc_id, then the least text hash; texts of any length are read
whole; further columns, whatever their names, go on up to ``mix`` (the last stage returns its own columns); an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tactus.llm import bpe, mixing, nearcopies, pii, quality, simhash
from tactus.llm.common import vocabulary, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no rule of the threshold table."""
    return quality.kept_only(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group within three bits of a fingerprint, as in op4_simhash: the least doc_id."""
    return simhash.one_of_each(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 at least, exact): the least doc_id."""
    return simhash.one_of_each(docs, nearcopies.components(docs))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by marks, n_chars counted anew."""
    return pii.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their slot and place in the Pfair order of their sources' temperature weights."""
    return mixing.positioned(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token count and the digests of its ids and of the bytes they decode to, in the order of ``mix``.

    The rows are written before they are sorted, as a sort reads its input twice.
    """
    rows = bpe.encoded(docs, vocabulary("byte_bpe_multi_50k.tiktoken"), carried=mixing.POSITION)
    return written(rows, "encoded").orderBy(*mixing.POSITION).drop(*mixing.POSITION)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("pii", redact), ("mixing", mix), ("byte_bpe", encode)]
#: The same with all near copies found; tests/llm holds STAGES to the groups of op4_simhash.
WHOLE_STAGES = [(name, near_copies if stage is near_dedup else stage) for name, stage in STAGES]

#: Fingerprints, redaction and BPE are beyond SQL; tests/llm holds run() against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, stages: list = STAGES) -> DataFrame:
    """All stages over documents; the rows are in the order of the mixing schedule."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in stages[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return stages[-1][1](spark, docs, sf_dir)

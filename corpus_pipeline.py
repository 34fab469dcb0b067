"""The corpus pipeline: quality, toxicity, near copies, mixture, pieces. Each stage works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lifelane.llm import bottomk, mixing, quality, sentencepiece_codec, toxicity
from lifelane.llm.common import stored, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier (fitted on labelled rows of docs) rejects.

    Null and empty texts are scored as empty; repeated rows are judged each; without labels the score is the prior's,
    one half, and all rows stay.
    """
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that score as toxic.

    Null and empty texts have no evidence and stay; repeated rows are judged each; without labels the seed terms and
    default weights decide.
    """
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 or more of its five-word shingles stays: the smallest id.

    Of rows of one id one stays. Texts without words, null ones too, are nobody's copies. Rows without an id all stay.
    """
    return bottomk.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents until each source has its share of words.

    Texts without words are not taken. Ties are broken by a hash of the row, so reruns agree; a null source is one too.
    """
    return mixing.mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the piece ids of each text, and the text that they decode to; null texts have null in both, repeated rows each."""
    return sentencepiece_codec.encode(docs, decoded="decoded")


STAGES = [
    ("quality", keep_quality),
    ("toxicity", keep_clean),
    ("near_dedup", keep_one_of_near_copies),
    ("mixture", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: SQL can't express the classifiers and the pieces; tests/llm compares run() with the stages' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents in turn, each written and read again for the next; an empty table gives an empty one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

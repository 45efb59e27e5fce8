"""The corpus pipeline: rejects low quality, keeps one of each near-duplicate group, drops benchmark passages, removes
personal data and encodes what is left.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written and read again as the next
stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import decontaminate, near_copies, pieces, pii, quality
from corvane.llm.common import table, unused, written

#: Documents of a lower score are rejected.
QUALITY_THRESHOLD = 0.3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored at the threshold or above; a null or empty text has the prior's score."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    score = unused(docs, "__score")
    return quality.score_documents(docs, model, score).where(F.col(score) >= QUALITY_THRESHOLD).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies: five-word shingles, Jaccard similarity 0.8 or more."""
    return near_copies.drop_near_copies(docs).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data replaced by its kind in brackets."""
    return pii.redact_documents(docs, pii.train(docs))


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with the ids of their pieces."""
    encoded = pieces.encode_documents(docs)
    return encoded.select("doc_id", "lang", "source", "n_chars", "encoded.n_pieces", "encoded.ids", "encoded.ids_sha256", "encoded.lossless")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("sentencepiece_encoding", sentencepiece_encoding),
]

#: The classifier and the network cannot be put in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

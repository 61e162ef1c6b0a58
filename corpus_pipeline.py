"""A corpus from raw documents: five stages, each on the rows that the one before kept.

Defined cases, of every stage: null texts are empty ones and stay as they are (the mix takes none of them, as they have
no words); rows without doc_id and rows that repeat one are rows like others; texts of any length are read whole; an
empty table gives an empty one; extra columns go through unchanged, whatever their names. Ties: see the operators.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkmill.llm import bpe, lines, mixing, near_dedup, quality
from chunkmill.llm.common import for_exit, read, shared_dir, spare
from chunkmill.llm.queries import THRESHOLD, vocabulary


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score says that they are unlikely of good quality go. It learns from all labelled rows' ids but held-out ones."""
    model = quality.fit(docs, quality.split(read(spark, sf_dir, "labels"), "quality", 5, 0))
    score = spare(docs.columns, "score")
    return quality.scored(docs, model, tuple(docs.columns), score).where(F.col(score) >= THRESHOLD).drop(score)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line stands for go; so do documents that lose all their lines. n_chars follows the text."""
    n_lines, n_kept = spare(docs.columns, "n_lines"), spare(docs.columns, "n_kept")
    found = lines.deduplicated(docs, (n_lines, n_kept)).where((F.col(n_kept) > 0) | (F.col(n_lines) == 0))
    n_chars = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")} if "n_chars" in docs.columns else {}
    return found.select(*[n_chars.get(c, F.col(f"`{c}`")) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (5-word shingles, 0.8) stays."""
    return near_dedup.keep_one(docs, 80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources to their target weights: rows go, stay or repeat."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text of the mix, with their number and digests."""
    return bpe.encoded(docs, vocabulary(), with_ids=True)


STAGES = [("quality classifier", quality_classifier), ("line dedup", line_dedup), ("near-duplicates", near_duplicates), ("mixing", mix), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        for_exit(spark, path)
        docs = spark.read.parquet(path)
    return docs


#: A classifier's scores, fuzzy lines and byte-pair merges are not SQL: the stages are tested one by one.
ORACLE_SQL = None

"""Corpus pipeline: documents -> language filter -> near-duplicates -> benchmark decontamination ->
source mix -> token ids in binary files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages docs is written as
Parquet and read again. All but the last return the columns of documents.

Defined results: every stage decides by rows, not by doc_id, so that null and repeated doc_ids are documents
like others; the mix writes a document as many times as it takes it, and each copy is encoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import common
from barloom.llm.binary_output import read_ids, write_ids
from barloom.llm.decontamination import without_items
from barloom.llm.language_id import FOLDS, identify
from barloom.llm.mixing import mixed
from barloom.llm.near_dedup import without_near_duplicates

#: Documents below this cosine with every language are rejected, like those without letters; and those of
#: which less than half of the letters belong to a language that was learnt.
MIN_SCORE, MIN_KNOWN = 0.02, 0.5


def _quoted(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters (null and empty texts too), in letters that no labelled document of
    any language has, or like no language."""
    labelled = docs.where(F.coalesce(common.crc_bucket(F.col("doc_id"), FOLDS) != 0, F.lit(True)))
    told = identify(docs, labelled, docs.columns, ("__lang_pred", "__score", "__known"))
    return told.where(f"__lang_pred <> 'und' AND __score >= {MIN_SCORE} AND __known >= {MIN_KNOWN}").select(*_quoted(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: that of the smallest doc_id (null last), then text hash."""
    return without_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    return without_items(docs, common.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix wants it."""
    return mixed(docs)


def binary_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token ids; a row a document, read back from the files."""
    return read_ids(write_ids(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("binary_ids", binary_ids),
]

#: The language and token stages have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.keep(docs, name)
    return docs

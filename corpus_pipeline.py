"""A training-corpus pipeline over ``documents``: each stage works on all that the one before kept.

The stages, in order: documents that score as toxic go; lines of which an
earlier document holds one alike go; one document of each near-duplicate class
stays; documents are repeated or left out so that sources reach their target
weights; what is left is packed into token sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.llm.common import shared_folder, table
from folioquery.llm.line_dedup import dedup_lines
from folioquery.llm.mixing import mix
from folioquery.llm.near_dedup import drop_near_duplicates
from folioquery.llm.packing import pack
from folioquery.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; the others stay as they are.

    Null texts count as empty and score like texts without any marked word. Each
    row is judged by its text, so repeated rows go or stay together; null ids
    stay unless their text is toxic. Without toxic labels, or without documents,
    nothing goes. Further columns are carried along, whatever their names.
    """
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; every document stays, with the rest of its text and its new length.

    Null and empty texts and blank lines stay as they are. Of equal lines the one
    that comes first by id (null first), text hash and place stays; rows equal in
    id and text count as one. Further columns are carried along, whatever their
    names; an empty table stays empty.
    """
    cleaned = dedup_lines(docs, min_equal=1).select(*docs.columns)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: the one with the least id (null last), of several the one with the least text hash.

    Rows equal in id and text are one; null texts count as empty, and texts
    without words are alike only if they are equal. Columns stay as they are,
    whatever their names; an empty table stays empty.
    """
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as its source's target takes it.

    Null sources are one source, null texts have no words and follow their
    source's rate, equal rows have a draw each. Columns stay as they are,
    whatever their names; an empty table, or one without words, gives no rows.
    """
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens.

    Null texts count as empty and give the closing id alone; every row is a
    document of its own, null and repeated ids too. Further columns aren't read;
    an empty table gives no rows.
    """
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: The first stage trains a model and the last one tokenises, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs

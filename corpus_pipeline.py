"""From raw documents to token ids: toxic documents go, then shared lines, near copies and contaminated documents; the rest is encoded.

Every stage works on all rows that the one before kept and returns the columns
of ``documents``, but for the last, which returns each document's ids.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estimara.llm import bpe, decontam, linededup, shared, similar, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more go. A null or empty text gets the rate of the labelled rows and stays with usual labels; rows
    with a null id are scored like all others; equal texts have equal scores, so repeated rows go or stay together; an empty table stays
    empty; columns of any further names stay as they are.
    """
    return toxicity.drop_toxic(docs, _read(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, with n_chars as it now is; one that only repeats others has an empty text."""
    kept = linededup.drop_lines(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (fingerprints within 4 bits, or five-word Jaccard similarity of 0.8 or more), the document with the smallest id stays."""
    return similar.drop_similar(docs, n=5, bits=4)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words on end of a benchmark item (or the whole of a shorter one) go. Null and empty texts hold none and
    stay; rows are told by id and text, so rows with a null id are judged, and repeated ones go or stay together; there are no ties; very
    long texts count whole; columns of any further names stay as they are.
    """
    return decontam.drop_contaminated(docs, _read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests and ids (unsigned 32-bit, little endian), a row for each row. A null text is the empty one, without ids;
    repeated rows and null ids stay; an empty table gives an empty result; other columns aren't looked at.
    """
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES: list[tuple[str, Stage]] = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("simhash_near_dedup", drop_near_copies), ("decontamination", drop_contaminated), ("byte_bpe", encode)]
#: No SQL has the nearest neighbours, fingerprints and merges; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's result is written as Parquet and read again."""
    docs, folder = _read(spark, sf_dir, "documents"), shared.folder(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs

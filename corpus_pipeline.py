"""The corpus pipeline: stages over the documents, each run on all that the one before has kept.

Every stage passes on all columns of its input. Defined cases: an empty table stays empty; a
document with a null or empty text fails the quality rules; of near duplicates exactly one row
stays, so of repeated rows, rows that share an id and rows without an id as well: the smallest id, nulls last,
then the lowest MD5 of the text, then of the row; what loses all its words to substring dedup stays with
an empty text and is not taken by the mix, which takes words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coordlytics.llm import minhash, mixing, quality_rules, repeats, sentencepiece_codec
from coordlytics.llm.store import stored

SPAN = 35  # words that may not occur twice
SHINGLE, SIMILARITY = 5, 80  # words, percent


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.judged(docs, labels).filter("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the first by id, of each group of near duplicates, repeated rows and rows without an id included."""
    return minhash.one_of_each(docs, width=SHINGLE, percent=SIMILARITY)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the passages that occur anywhere else."""
    left = repeats.without_repeats(docs, span=SPAN, give_text=True)
    columns = []
    for name in docs.columns:
        if name == "text":
            columns.append(F.col("text"))
        elif name == "n_chars":
            columns.append(F.char_length("text").cast(docs.schema[name].dataType).alias(name))
        else:
            columns.append(F.col(f"row.`{name}`").alias(name))
    return left.select(*columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The weighted mix of the sources; a document that is taken repeatedly has as many rows."""
    return mixing.mixed_documents(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document of the mix, in its order."""
    import public_tokenizers

    coded = sentencepiece_codec.coded(docs, public_tokenizers.path("piece_bpe_32k.model"), ["doc_id", "source"])
    return coded.select("row.*", "n_tokens", "ids", "decoded_sha256", "round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality), ("near duplicates", near_duplicates), ("substring dedup", substrings),
    ("mixing sources", mix), ("pieces", pieces)]

ORACLE_SQL = None  # learned rules and tokenizer pieces have no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, "stage-" + name.replace(" ", "-"))
    return docs

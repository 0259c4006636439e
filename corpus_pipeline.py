"""A cleaning pipeline over documents: toxicity, near copies, benchmark leaks, personal data, packing.

Cases, in every stage: all columns of the documents are kept, whatever their names; a null text counts as empty (it is clean, no copy of
anything, and one token long); rows that repeat a doc_id, or have none, are judged each by its own text, and of rows that repeat both doc_id and
text the second stage keeps one; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm import decontam, ngram_join, packing, pii, toxicity
from tracelode.llm.common import materialise, table
from tracelode.llm.tokens import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is one half or more go; the field is fitted on the labels of those that came. Each row is judged by its own text."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, that with the least doc_id; documents without words stay."""
    return ngram_join.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a near copy of a benchmark item go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to placeholders; n_chars, if there is such a column, is counted anew."""
    done = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return done
    return done.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 4096."""
    packed = packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), end_id=1, budget=4096, keep_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("pii", redact_private),
    ("packing", pack),
]

#: Learned scores and packing aren't expressible in SQL; tests/llm holds the stages and the whole against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""

    def step(docs: DataFrame, stage: tuple) -> DataFrame:
        name, function = stage
        return materialise(function(spark, docs, sf_dir), f"stage-{name}")

    return reduce(step, STAGES, table(spark, sf_dir, "documents"))

"""A corpus from raw documents to packed sequences: each stage is one operator over all that the one before kept."""

from __future__ import annotations

from contextlib import ExitStack

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.llm import decontam, packing, simhash, substring, toxicity
from sievelake.llm._session import checkpoint, scratch_table, table

#: A repeated string goes if it has so many bytes or whole words.
REPEATED_BYTES, REPEATED_WORDS = 240, 50
#: Bytes of the strings that are searched: no more than any 50 words take, the spaces between them included.
SEARCHED_BYTES = 96


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the labels don't make toxic, all columns. Null and empty texts, repeated rows and unlabelled tables stay as they are; an empty table stays empty."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8), the one with the least doc_id. Null and wordless texts are one group; of repeated rows one stays."""
    return simhash.deduplicate(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without passages of 50 words or 240 bytes that stand anywhere else too; ``n_chars`` is counted anew. Null texts stay null, a text that is all repeated becomes empty."""
    cut = substring.without_repeated(docs, SEARCHED_BYTES, REPEATED_BYTES, REPEATED_WORDS)
    return cut.withColumn("n_chars", F.length("text").cast(cut.schema["n_chars"].dataType)) if "n_chars" in cut.columns else cut


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item to 0.8 of its weighted shingles. Null texts and null items hold nothing."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of documents, every document in one; a null text takes one token. An empty table gives no bins."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeated_passages),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("best_fit_packing", pack_sequences),
]

#: SQL can express none of the stages. Tests hold near copies, repeated passages, leaks and packing against brute force, and toxicity against planted and held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read by the next one."""
    with ExitStack() as tables:
        docs = table(spark, sf_dir, "documents")
        for _, stage in STAGES[:-1]:
            docs = tables.enter_context(scratch_table(stage(spark, docs, sf_dir)))
        return checkpoint(STAGES[-1][1](spark, docs, sf_dir))

"""A corpus pipeline of five of the operators: each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm import decontaminate, jaccard, packing, quality, substring
from quillstone.llm.common import materialise
from quillstone.llm.queries import tokenizer_path

#: Near copies: 0.8 of five-word shingles. Repeated passages: 50 words or more.
SHINGLE_WORDS, SIMILARITY_PERCENT, PASSAGE_WORDS = 5, 80, 50


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled ones among them, doesn't reject. Null and empty texts go by their score; rows with a null id and repeated rows by their texts."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies. Rows with a null id, without words, and repeated rows of an id that stays are kept."""
    return jaccard.keep_first(docs, words=SHINGLE_WORDS, percent=SIMILARITY_PERCENT)


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that a document with a smaller id has too. Rows with a null id are kept as they are; null and empty texts have no passages."""
    return substring.remove_repeats(docs, PASSAGE_WORDS)


def no_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no test item occurs. Rows with a null id or text are kept; an empty benchmark keeps all."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents as sequences of power-of-two lengths, with their token ids. Null and empty texts are their end token; a null id stays null; no documents give no pieces."""
    return packing.pack(docs, tokenizer_path(), with_ids=True)


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each),
    ("substring dedup", no_repeats),
    ("benchmark decontamination", no_leaks),
    ("packing", packed),
]

#: SQL can't train the classifier. Each operator has brute-force tests of its own; the pipeline's test plants cases and looks what stays.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents; each but the last is written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)

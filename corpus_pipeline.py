"""From raw documents to token ids: five stages, each one of the text operators, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm.bpe import encoded_digest
from tidemill.llm.common import materialize
from tidemill.llm.exact_dedup import keep_distinct
from tidemill.llm.langid import known_language
from tidemill.llm.mixing import mixed_documents
from tidemill.llm.neardup import keep_one_of_each


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the table's labels teach (letter n-gram vectors); und and strange ones go. Null and empty
    texts and those without letters are und. Rows with null or repeated ids are judged each by its text; an empty table stays empty."""
    return known_language(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, white space aside: the longest, then the smallest id, null last. Null and empty texts are one
    text, of rows that are alike throughout one stays, and an empty table stays empty."""
    return keep_distinct(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates: SimHash candidates, of which whole sets of
    five-word shingles with a similarity of 0.8 or more decide. Equal texts are near, and so are all null and empty ones. A null id is larger than any;
    rows with repeated ids are documents of their own; an empty table stays empty."""
    return keep_one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, documents repeated as often as it takes them. A null source is one of its own, texts without words are
    taken by none, null ids are dealt by their texts, rows with repeated ids are documents of their own; an empty table stays empty."""
    return mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, as digests, a row a document, repeated ones too. A null text counts as empty, which
    has no ids; an empty table stays empty."""
    return encoded_digest(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("encoding", encoding)]
#: Language ID, SimHash and BPE have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)

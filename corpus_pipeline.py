"""A corpus from documents to packed sequences: language, quality, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet
to the shared folder and reads again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glimmer.llm import langid, packing, quality, simhash
from glimmer.llm.shared import cut, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text some language model accepts. Null, empty and letterless texts have no language
    and go; very long texts are read whole; repeated rows are judged alike; ties in entropy go to the first
    language by name; a table without labelled rows, or without rows, keeps none; other columns pass."""
    return langid.keep_known_languages(docs, langid.fit(langid.training_rows(docs)))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. Null and short texts fail; very long texts are read whole;
    repeated rows are judged alike; an empty table stays empty; columns of any name pass."""
    return quality.keep_good(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; of equal rows one stays.
    Null and empty texts are one group; rows without an id stay; very long texts count whole; an empty table
    stays empty; columns of any name pass."""
    return simhash.drop_near_duplicates(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences. Null and empty texts are one end id each;
    texts of any length are cut, not shortened; repeated rows and null ids keep their pieces; equal lengths are
    dealt by partition; an empty table gives no pieces; other columns are not read."""
    return packing.pack(docs, packing.word_tokenizer())


STAGES = [
    ("language", known_language),
    ("quality", good_quality),
    ("near_duplicates", without_near_duplicates),
    ("packing", packed),
]

#: The models and the search have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

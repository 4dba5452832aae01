"""Raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept and returns
a DataFrame, which is written as Parquet and read again as the next stage's ``docs``. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import minhash_dedup, mixing, packing, quality, suffix_dedup
from ledgerloom.session import Scratch, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier doesn't reject."""
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash_dedup.one_of_each(docs, Scratch(spark, "minhash"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of over 50 words that another document has too."""
    return suffix_dedup.clean(docs, spark, suffix_dedup.WORDS)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares; a document read twice is two rows."""
    return mixing.mixed(docs, spark, mixing.PASSAGE)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", good_quality),
    ("near_copies", without_near_copies),
    ("repeats", without_repeats),
    ("mixing", mixed_sources),
    ("packing", packed),
]

#: Dictionaries, signatures and the construction of repeats have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(name, stage(spark, docs, sf_dir))
    return docs

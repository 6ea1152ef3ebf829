"""A corpus pipeline of five stages over ``documents``: quality, near duplicates, benchmark, personal data, mix.

Each stage reads what its predecessor kept, written as Parquet to the folder
that driver and executors share. All but the last return the columns of
``documents``, and rows may have more columns of any name; the mix replaces those
named like the columns it adds.

Defined results, for every stage: an empty table gives an empty table; texts of
any length are read whole. Null and empty texts have no words, so the quality
stage drops them; later stages, given such rows, treat equal ones as near
duplicates, find neither benchmark text nor personal data in them, and take 0
words from them. Rows with a null id are never trusted or learned from, and
otherwise treated like others; null sources are one source. Repeated rows and
ties get equal verdicts, and one row of each class stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlint.llm import common, decontaminate, mixing, pii, quality, simhash


OWN = ("doc_id", "text")


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and rest, a struct of all other columns, so that none clashes with what an operator adds."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in OWN]
    return docs.select(*OWN, F.struct(*rest or [F.lit(None).cast("int").alias("none")]).alias("rest"))


def _unpacked(x: DataFrame, docs: DataFrame) -> DataFrame:
    return x.select(*[(F.col(c) if c.lower() in OWN else F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    model = quality.fit(docs, common.read_table(spark, sf_dir, "labels"))
    return _unpacked(quality.score(_packed(docs), model).where("kept"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: that of the smallest id, once.

    Rows that share an id are told apart by their columns. A component whose
    documents have no id keeps one of them.
    """
    return simhash.near_duplicates(docs)


#: Words of a benchmark window whose occurrence alone condemns a document, and of one that does so where it covers a twentieth of the words.
LEAK, SHORT_LEAK = 8, 3


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark text.

    A document goes if a whole window (13 words, or all of a shorter item's) of
    ``LEAK`` words or more occurs in it, however long the document is, or if it
    is contaminated and the windows found have ``SHORT_LEAK`` words or more. Items of one or
    two words are common words and condemn nothing.
    """
    x = decontaminate.find(_packed(docs), common.read_table(spark, sf_dir, "benchmark"))
    leaks = (F.col("longest") >= LEAK) | (F.col("contaminated") & (F.col("longest") >= SHORT_LEAK))
    return _unpacked(x.where(~leaks), docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes from each."""
    return mixing.mix(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("pii", personal_data),
    ("source mix", source_mix),
]

#: The bootstrapped patterns and the quality model have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn; what a stage wrote for itself, and its input, are deleted once its result is written."""
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with common.scope() as made:
            out = common.save(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        common.discard(docs, *[x for x in made if x is not out])
        docs = out
    return docs

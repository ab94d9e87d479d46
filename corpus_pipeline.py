"""The corpus pipeline: five stages over ``documents``, each written and read again.

Each stage keeps all columns of its input; the last adds its own (``size``, ``source_size``, ``target``, ``taken``, ``first_slot``,
``pieces``) and keeps the documents that the mixture takes words of. A column of the input that bears one of these names gives way to it.

Defined cases: rows with a null text pass the first three stages and are empty after the fourth, so the mixture takes nothing of them and they go; empty texts
go likewise; texts of any length are worked on whole; rows without a doc_id own no lines and are nobody's near copies, but are scored, decontaminated and mixed; rows equal in doc_id
and text become one in the third stage; of near copies the smallest doc_id stays, so there are no ties; empty tables give empty results; without labels nothing is toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywren.llm import decontaminate, line_dedup, mixing, near_dedup, toxicity
from tallywren.session import new_path, remove_path, scratch


def counted(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_chars`` as the changed texts have it."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents scored toxic go."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: lines that an earlier document owns go; documents stay."""
    return counted(line_dedup.dedup_lines(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of each group of near copies the smallest doc_id stays."""
    return near_dedup.dedup(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: hit spans go, and documents that they cover for the most part."""
    return counted(decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: the documents that the mixture takes, with the words taken and their slots."""
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_passages),
    ("source_mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' last table. What a stage writes for itself goes as soon as its table is written, and that table once the next one is."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs


# A learned classifier, an automaton and a MinHash index stand between documents and rows.
ORACLE_SQL = None

"""A corpus cleaned in stages, each one operator over all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


from leadloom.llm import contamination, lines, mixing, simhash, toxicity
from leadloom.llm.shared import new_folder, read


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model rejects go."""
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"))


def boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many documents of a source go from the texts; n_chars follows."""
    return lines.without_boilerplate(docs, length="n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; fingerprints within 4 bits and similarity 0.8 on five words link documents."""
    return simhash.one_per_group(docs, shingled=True)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with enough benchmark words go."""
    return contamination.without_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, with rates that bring the domains to their target weights."""
    return mixing.mix(docs, mixing.label_domains(read(spark, sf_dir, "labels")), mixing.TARGETS)


STAGES = [
    ("toxicity", toxic_documents),
    ("line dedup", boilerplate),
    ("near duplicates", near_duplicates),
    ("decontamination", benchmark_passages),
    ("mixing", mixture),
]

#: Training and iteration are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage is written as Parquet and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = new_folder(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""A training corpus from raw documents: five stages, each written and read again as the next one's input.

Every stage works on all documents that the one before kept. A document rejected as toxic, a copy of an
earlier one, or one that holds a benchmark passage goes; repeated passages go from the later document.
A document that line deduplication leaves without a word goes too; one that was empty before stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factweave.llm import decontam, linedup, minhash, packing, toxicity
from factweave.llm.common import stored, table
from factweave.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays under 0.7, by a model of the labelled documents."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep(docs, model, threshold=0.7)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks that earlier documents have."""
    left = linedup.without_repeats(docs, cuts="__cuts")
    worded = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    rows = left.where((F.size("__cuts") == 0) | worded)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.size("__cuts") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.drop("__cuts")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group alike in five-word shingles at 0.8."""
    return minhash.first_of_group(docs, words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontam.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4,096 tokens."""
    return packing.pack(docs, tokenizer_path(), limit=4096, end=2)


STAGES = [("toxicity", drop_toxic), ("line dedup", cut_repeats), ("near dedup", drop_near_duplicates), ("decontamination", drop_contaminated), ("packing", pack)]

#: Alignment, near duplicates under transitivity and a fitted model are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

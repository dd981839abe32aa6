"""A corpus pipeline over `documents`: each stage is written as Parquet and read again as the next one's input.

Stages: toxic documents go; of each class of near-duplicates one document stays; documents that hold benchmark passages go;
sources are mixed to their weights (a document may go, or come up to three times); what is left is shuffled into shards.
All stages but the last return the columns of documents, also those that have the name of a column that an operator adds;
the last adds shard and slot (in place of columns so named). Null and empty texts are clean, form one class, of which one
document stays, and are taken or not without a word's difference; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import materialise, unused
from factloom.llm.decontaminate import decontaminate
from factloom.llm.mixing import OUT, mix, repeat
from factloom.llm.sharding import shard_rows
from factloom.llm.simhash import deduplicate
from factloom.llm.toxicity import fit
from factloom.session import ship

SHARDS = 24


def set_aside(docs: DataFrame, names: list[str]) -> tuple[DataFrame, list[Column]]:
    """docs, its columns of these names renamed, and what to select to have the columns of docs back."""
    clash = [c for c in docs.columns if c.lower() in names]
    new = dict(zip(clash, unused(docs, *clash)))
    return docs.withColumnsRenamed(new), [F.col(f"`{new.get(c, c)}`").alias(c) for c in docs.columns]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    labels = ship(spark).read.parquet(f"{sf_dir}/labels.parquet")
    rows, columns = set_aside(docs, ["score", "predicted"])
    return fit(rows, labels).scored(rows).filter("predicted = 0").select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the smallest doc_id."""
    ship(spark)
    return deduplicate(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate(docs, ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    rows, columns = set_aside(docs, OUT)
    return repeat(mix(rows)).select(*columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and slot."""
    return shard_rows(docs, SHARDS)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

ORACLE_SQL = None  # models, fingerprints and keyed shuffles are beyond SQL; tests/llm hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{name}")
    return docs

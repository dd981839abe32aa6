"""Clusters of facts about one concept: the same subject, predicate, period and scope, whatever the case."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import display_name, some, title


def keyed(facts: DataFrame) -> DataFrame:
    """facts with cluster_id and the canonical fields."""
    parts = {"_s": F.lower(F.trim("subject")), "_p": F.lower(F.trim("predicate")), "_t": F.upper(some(F.col("period"))), "_c": F.lower(some(F.col("scope")))}
    rows = facts.withColumns(parts)
    # a null and an empty part must not give the same key
    key = F.concat_ws("\u0001", *[F.coalesce(F.concat(F.lit("="), p), F.lit("-")) for p in parts])
    return rows.withColumn("cluster_id", F.sha2(key, 256))


def cluster_members(facts: DataFrame) -> DataFrame:
    return keyed(facts).select("cluster_id", F.col("id").alias("fact_id"), F.lit(1.0).alias("similarity_score"), F.col("created_at").alias("added_at")).dropDuplicates(["cluster_id", "fact_id"])


def clusters(facts: DataFrame) -> DataFrame:
    """One row for each concept, with its facts and source documents counted."""
    g = (
        keyed(facts)
        .groupBy("cluster_id", "_s", "_p", "_t", "_c")
        .agg(F.count_distinct("id").alias("fact_count"), F.count_distinct("document_id").alias("source_doc_count"), F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"))
    )
    subject, predicate = title(F.col("_s")), title(F.col("_p"))
    about = F.concat(F.lit("Consolidated observations for "), subject, F.lit(" "), predicate, F.coalesce(F.concat(F.lit(" in "), F.col("_t")), F.lit("")))
    return g.select(
        F.col("cluster_id").alias("id"), subject.alias("canonical_subject"), predicate.alias("canonical_predicate"), F.col("_t").alias("canonical_period"), F.col("_c").alias("canonical_scope"),
        display_name(F.col("_s"), F.col("_p"), F.col("_t"), F.col("_c")).alias("display_name"), about.alias("description"), "fact_count", "source_doc_count", "created_at", "updated_at",
    )

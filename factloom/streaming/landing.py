"""Incremental ingestion: pages that land as Parquet files are worked into the store batch by batch."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.plans.ingest import ingest
from factloom.plans.store import Store

PAGES = "document_id string, filename string, page_number int, text string"


def watch_pages(spark: SparkSession, landing: str, store: Store, checkpoint: str, trigger: dict | None = None, name: str = "pages"):
    """A streaming query over landing. Each document's pages land in one file. The number of the last batch worked in is part of
    the store's snapshot, so a batch that is replayed, after a failure at any point, changes no table twice. `name` tells queries
    that feed the same store apart; it goes with one checkpoint."""

    def batch(rows: DataFrame, number: int) -> None:
        docs = rows.groupBy(F.col("document_id").alias("id")).agg(F.first("filename").alias("filename"), F.count("*").cast("int").alias("page_count"), F.sha2(F.concat_ws("\u0001", F.sort_array(F.collect_list(F.sha2(F.concat_ws("\u0001", F.format_string("%010d", "page_number"), "text"), 256)))), 256).alias("file_hash"))
        ingest(store, rows.drop("filename"), docs, now=datetime.now(UTC).isoformat(), batch=(name, number))

    stream = spark.readStream.schema(PAGES).parquet(landing)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

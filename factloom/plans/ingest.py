"""From pages to the whole data model: one lazy plan up to facts, then clusters, pairs and relationships."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import vocab as V
from factloom.functions.text import word_count
from factloom.operators.chunking import chunk_pages
from factloom.operators.cluster import cluster_members, clusters, keyed
from factloom.operators.extract import extract_facts, may_tell
from factloom.operators.match import candidate_pairs, capped, hold
from factloom.operators.relate import classify
from factloom.plans.ledger import build_facts
from factloom.plans.store import Store, Tables
from factloom.session import cut

def facts_of_pages(pages: DataFrame, limit: int = V.CHUNK_WORDS, overlap: int = V.OVERLAP_WORDS, now: str = "2024-01-01T00:00:00+00:00", held: list[DataFrame] | None = None) -> DataFrame:
    """All facts, accepted and rejected, of pages (document_id, page_number, text)."""
    chunks = chunk_pages(pages.filter(may_tell(F.col("text"))), limit, overlap)
    # a chunk that is all of its page goes with its facts; only the facts of parted pages are joined to them
    whole = extract_facts(chunks.filter("whole").withColumn("page_text", F.col("text")), ("page_text",))
    texts = pages.select(F.col("document_id").alias("_d"), F.col("page_number").alias("_p"), F.col("text").alias("page_text"))
    parted = extract_facts(chunks.filter("not whole")).join(texts, (F.col("document_id") == F.col("_d")) & (F.col("page_number") == F.col("_p")), "left").drop("_d", "_p").withColumn("page_text", F.coalesce("page_text", F.lit("")))
    paged = whole.unionByName(parted)
    key = F.concat_ws("\u0001", "document_id", F.col("page_number").cast("string"), "chunk_id", F.col("ordinal").cast("string"), "subject", "predicate", "value")
    return build_facts(paged.withColumns({"id": F.sha2(key, 256), "created_at": F.lit(now)}), held=held).drop("page_text")


def knowledge(facts: DataFrame, documents: DataFrame, cap: int | None = None, new: str | None = None, held: list[DataFrame] | None = None) -> dict[str, DataFrame]:
    """Clusters, memberships, candidate pairs and relationships of the accepted facts; with `new`, a column of facts, only the
    pairs and relationships that hold a fact where it is true. `owner` is the document that brought a pair."""
    names = documents.select(F.col("id").alias("_d"), "filename")
    own = facts.filter("status = 'ACCEPTED'").join(names, F.col("document_id") == F.col("_d"), "left").drop("_d")
    pairs = candidate_pairs(own, new=None if new is None else F.col(new), held=held)
    pairs = pairs if cap is None else capped(pairs, cap)
    pairs = pairs if held is None else hold(pairs, held)  # two tables are made of them
    # who brought a pair: the new side
    owner = F.col("a_document_id") if new is None else F.when(F.coalesce(F.col(f"a_{new}"), F.lit(False)), F.col("a_document_id")).otherwise(F.col("b_document_id"))
    related = classify(pairs).filter("type != 'UNRELATED'")
    return {
        "fact_clusters": clusters(own),
        "cluster_members": cluster_members(own),
        "candidate_pairs": pairs.select(F.sha2(F.concat_ws("__", "a_id", "b_id"), 256).alias("id"), F.col("a_id").alias("fact_a_id"), F.col("b_id").alias("fact_b_id"), "match_reason", "match_score", F.lit("PENDING").alias("status"), F.greatest("a_created_at", "b_created_at").alias("created_at"), owner.alias("owner")),
        "relationships": related.select("id", F.col("a_id").alias("fact_a_id"), F.col("b_id").alias("fact_b_id"), "canonical_key", "type", "reasoning", "confidence", "comparison_context", "created_at", owner.alias("owner")),
    }


def page_counts(pages: DataFrame) -> DataFrame:
    """Counters of a run for each document, from its pages."""
    has = F.length(F.trim("text")) >= 10
    return pages.groupBy("document_id").agg(F.count("*").alias("total_pages"), F.count_if(has).alias("pages_with_text"), F.sum(word_count(F.col("text"))).alias("words"))


def run_counts(tables: Tables, pages: DataFrame) -> DataFrame:
    """Counters of a run for each document of pages: its pages, chunks, facts, and the pairs and relationships it takes part in."""
    counts = page_counts(pages).withColumnRenamed("document_id", "_d")
    facts = tables.read("facts").join(counts.select("_d"), F.col("document_id") == F.col("_d"), "left_semi")
    home = facts.select(F.col("id").alias("_f"), F.col("document_id").alias("_d"))

    def touched(name: str) -> DataFrame:
        rows = tables.read(name).select("id", "fact_a_id", "fact_b_id")
        sides = [rows.join(home, F.col(side) == F.col("_f")).select("_d", "id") for side in ("fact_a_id", "fact_b_id")]
        return sides[0].unionByName(sides[1]).groupBy("_d").agg(F.count_distinct("id").alias(name))

    of_facts = facts.groupBy(F.col("document_id").alias("_d")).agg(
        F.count("*").alias("raw_facts"), F.count_if(F.col("status") == "ACCEPTED").alias("accepted_facts"),
        F.count_if(F.col("status") == "REJECTED").alias("rejected_facts"), F.count_if(F.col("grounding_status") == "VERIFIED").alias("grounded_facts"),
    )
    chunks = chunk_pages(pages).groupBy(F.col("document_id").alias("_d")).agg(F.count("*").alias("chunks_created"))
    for more in (chunks, of_facts, touched("candidate_pairs"), touched("relationships")):
        counts = counts.join(more, "_d", "left")
    return counts.na.fill(0).withColumnRenamed("_d", "document_id")


def outcomes(pages: DataFrame, documents: DataFrame, now: str) -> DataFrame:
    """documents with their state after the run: FAILED with the first message where a page carries an `error`, else COMPLETED."""
    done = documents.withColumns({"progress_pct": F.lit(100), "updated_at": F.lit(now)})
    if "error" not in pages.columns:
        return done.withColumn("status", F.lit("COMPLETED"))
    errors = pages.filter("error is not null").groupBy(F.col("document_id").alias("_d")).agg(F.min("error").alias("_e"))
    joined = done.drop("error_message").join(errors, F.col("id") == F.col("_d"), "left")
    failed = F.col("_e").isNotNull()
    return joined.withColumns({"status": F.when(failed, "FAILED").otherwise("COMPLETED"), "progress_pct": F.when(failed, 0).otherwise(100), "error_message": F.col("_e")}).drop("_d", "_e")


def ingest(store: Store, pages: DataFrame, documents: DataFrame, now: str = "2024-01-01T00:00:00+00:00", cap: int | None = None, batch: tuple[str, int] | None = None) -> None:
    """Write documents, facts and all that follows from them, in one change; documents that were there before are processed anew.

    Only the given documents' facts are compared, with each other and with the stored ones; pairs and relationships among other
    documents stay as they are, and so do clusters that none of the given documents' facts is or was in. A page with an `error`
    fails its document, which keeps its row and message and brings no facts. `batch` (query, number) is worked in once: given again,
    it changes nothing.
    """
    if batch and store.done(batch):
        return
    began, held = time.time(), []
    # both are read several times, and what they come from need not give the same rows again
    pages, documents = cut(pages), cut(documents)
    ended = cut(outcomes(pages, documents, now))
    ids = ended.select("id").distinct()
    if "error" in pages.columns:
        pages = pages.join(ended.filter("status = 'FAILED'").select("id"), F.col("document_id") == F.col("id"), "left_anti").drop("error")
    with store.change(batch) as c:
        before = cut(c.read("facts").join(ids.withColumnRenamed("id", "_d"), F.col("document_id") == F.col("_d"), "left_semi").select("id"))
        was_in = cut(c.read("cluster_members").join(before.toDF("_f"), F.col("fact_id") == F.col("_f"), "left_semi").select("cluster_id"))
        c.replace("documents", ended, "id", ids)
        c.replace("facts", facts_of_pages(pages, now=now, held=held), "document_id", ids, ("document_id",))
        marked = c.read("facts").join(ids.select(F.col("id").alias("_d"), F.lit(True).alias("_new")), F.col("document_id") == F.col("_d"), "left").drop("_d")
        made = knowledge(marked, c.read("documents"), cap, "_new", held)
        for name in ("candidate_pairs", "relationships"):
            c.replace(name, made[name], "owner", before, ("fact_a_id", "fact_b_id"))
        own = marked.filter("_new and status = 'ACCEPTED'")
        members = cluster_members(own).join(own.select(F.col("id").alias("fact_id"), "document_id"), "fact_id")
        c.replace("cluster_members", members, "document_id", before, ("fact_id",))
        c.recount(was_in.unionByName(keyed(own).select("cluster_id")))
        runs = run_counts(c, pages).withColumns({"id": F.concat_ws("#", "document_id", F.lit(now)), "stage": F.lit("COMPLETED"), "created_at": F.lit(now)})
        runs = cut(runs.withColumn("execution_time_ms", F.lit(int((time.time() - began) * 1000))))
        c.replace("diagnostics", runs, "document_id", runs.select("id"))
    for df in held:
        df.unpersist()

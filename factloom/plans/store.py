"""The data model as Parquet tables: typed empty tables, keyed replacement, deletes with their cascade, all or nothing.

Rows lie in buckets by a hash of their owner (the document that brought them; for clusters the cluster), each bucket in a folder
of its own. A change writes new folders for the buckets it touches and nothing else; other buckets stay as they are. What a table
consists of is told by a snapshot, a small file that names the folder of each table's buckets and the stream batches worked in.
A change of several tables counts once its snapshot is put by one rename: readers open tables through the newest snapshot, so
they see all of it or nothing, and a change that breaks off leaves only folders that no snapshot names, which the next one
removes. KEPT snapshots stay, so that those who read an older one can finish. There is one writer at a time; a second one's
rename finds the number taken and fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.cluster import clusters, keyed
from factloom.session import cut

KEPT = 3  # snapshots, the newest among them
BUCKETS = 64  # of each table of a new store; a store keeps its own number

SCHEMAS = {
    "documents": "id string, filename string, file_hash string, file_size bigint, page_count int, status string, progress_pct int, progress_message string, error_message string, duplicate_of string, metadata struct<file_size:bigint,total_chars:bigint,pages_with_text:int>, created_at string, updated_at string",
    "pages": "document_id string, page_number int, text string, char_count int, has_text boolean",
    "chunks": "chunk_id string, document_id string, page_number int, chunk_ordinal int, start_page int, end_page int, text string, word_count int",
    "facts": "id string, document_id string, page_number int, chunk_id string, subject string, predicate string, value string, fact_type string, qualifiers map<string,string>, period string, scope string, unit string, currency string, normalized_value double, normalized_unit string, evidence_quote string, normalized_evidence string, grounding_status string, grounding_score double, quality_score double, confidence double, status string, rejection_reason string, created_at string",
    "candidate_pairs": "id string, fact_a_id string, fact_b_id string, match_reason string, match_score double, status string, created_at string",
    "relationships": "id string, fact_a_id string, fact_b_id string, canonical_key string, type string, reasoning string, confidence double, comparison_context map<string,string>, created_at string",
    "fact_clusters": "id string, canonical_subject string, canonical_predicate string, canonical_period string, canonical_scope string, display_name string, description string, fact_count bigint, source_doc_count bigint, created_at string, updated_at string",
    "cluster_members": "cluster_id string, fact_id string, similarity_score double, added_at string",
    "diagnostics": "id string, document_id string, stage string, total_pages int, pages_with_text int, chunks_created int, raw_facts int, accepted_facts int, rejected_facts int, grounded_facts int, candidate_pairs int, relationships int, execution_time_ms bigint, logs array<string>, created_at string",
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def conform(df: DataFrame, name: str, *more: str) -> DataFrame:
    """df with exactly the table's columns, and those in `more`; those it lacks are null."""
    want = [c.split(" ", 1) for c in [*_split(SCHEMAS[name]), *more]]
    return df.select(*[(F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in want])


def _split(schema: str) -> list[str]:
    out, depth = [""], 0
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return [x.strip() for x in out]


class Tables:
    """The tables as one snapshot names them."""

    def __init__(self, spark: SparkSession, state: dict):
        self.spark, self.state = spark, state

    def read(self, name: str) -> DataFrame:
        return self._stored(name).drop("_bucket")

    def _stored(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """Rows of the table, or of some of its buckets, with the bucket."""
        held = self.state["tables"].get(name, {})
        paths = [path for bucket, path in sorted(held.items()) if buckets is None or int(bucket) in buckets]
        if not paths:
            return empty(self.spark, name).withColumn("_bucket", F.lit(0))
        return self.spark.read.schema(f"{SCHEMAS[name]}, _bucket int").parquet(*paths)


class Change(Tables):
    """Tables with what one change has written to them so far."""

    def __init__(self, store: Store, state: dict):
        super().__init__(store.spark, state)
        self.store = store

    def replace(self, name: str, fresh: DataFrame, owner: str | Column, gone: DataFrame | None = None, on: tuple[str, ...] = ("id",)) -> None:
        """Put in the rows of `fresh` and take out the stored rows of which one of the columns `on` is in `gone` (one column).
        Only buckets that hold either are written."""
        count = self.state["buckets"]
        fresh = fresh.withColumn("_bucket", F.pmod(F.xxhash64(F.col(owner) if isinstance(owner, str) else owner), F.lit(count)).cast("int"))
        fresh = cut(conform(fresh, name, "_bucket int"))
        touched = fresh.select("_bucket")
        if gone is not None:
            gone = gone.toDF("_gone").distinct()
            for c in on:
                touched = touched.unionByName(self._stored(name).join(gone, F.col(c) == F.col("_gone"), "left_semi").select("_bucket"))
        touched = sorted(r[0] for r in touched.distinct().collect())  # as many as there are buckets at most
        if not touched:
            return
        stay = self._stored(name, touched)
        for c in on if gone is not None else ():
            stay = stay.join(gone, F.col(c) == F.col("_gone"), "left_anti")
        folder = f"{self.store.folder}/{name}/{uuid.uuid4().hex}"
        rows = stay.unionByName(fresh).withColumn("bucket", F.col("_bucket")).hint("rebalance", "bucket")
        rows.write.partitionBy("bucket").parquet(folder)
        held = dict(self.state["tables"].get(name, {}))
        for bucket in touched:
            held.pop(str(bucket), None)
        self.state["tables"][name] = held | {at.rsplit("=", 1)[1]: at for at in self.store.listed(folder) if "/bucket=" in at}

    def recount(self, cluster_ids: DataFrame) -> None:
        """Count the clusters of the given ids (cluster_id) anew from the facts; those without facts go."""
        rows = keyed(self.read("facts").filter("status = 'ACCEPTED'")).join(cluster_ids.distinct(), "cluster_id", "left_semi")
        self.replace("fact_clusters", clusters(rows), "id", cluster_ids)


class Store:
    """Named tables under one folder (any file system that Spark reaches)."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self._jvm = spark.sparkContext._jvm
        self._path = lambda p: self._jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def listed(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(s.getPath().toString() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def snapshots(self) -> list[str]:
        """Paths of the snapshots, oldest first."""
        return [p for p in self.listed(f"{self.folder}/_snapshots") if p.endswith(".json")]

    def state(self) -> dict:
        """What the newest snapshot says."""
        found = self.snapshots()
        return self._load(found[-1]) if found else {"number": 0, "buckets": self.buckets, "tables": {}, "batches": {}}

    def _load(self, path: str) -> dict:
        stream = self._fs.open(self._path(path))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, name: str) -> DataFrame:
        return self.now().read(name)

    def now(self) -> Tables:
        """All tables as they are now, whatever is written later (for as long as the snapshot is kept)."""
        return Tables(self.spark, self.state())

    @contextmanager
    def change(self, batch: tuple[str, int] | None = None) -> Iterator[Change]:
        """A change of any tables, committed at the end of the block, or not at all if it fails. `batch` is noted in the same commit
        as worked in: (query, number)."""
        change = Change(self, self.state())
        yield change
        if batch:
            change.state["batches"][batch[0]] = batch[1]
        self._commit(change.state)

    def done(self, batch: tuple[str, int]) -> bool:
        """Whether the batch has been worked in."""
        return self.state()["batches"].get(batch[0], -1) >= batch[1]

    def _commit(self, state: dict) -> None:
        state["number"] += 1
        top, put = f"{self.folder}/_snapshots", f"{self.folder}/_snapshots/{state['number']:012d}.json"
        draft = self._path(f"{top}/{uuid.uuid4().hex}.draft")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if self._fs.exists(self._path(put)) or not self._fs.rename(draft, self._path(put)):
            raise RuntimeError("another writer has changed the store")
        self._clean()

    def _clean(self) -> None:
        """Remove old snapshots and the folders that no kept snapshot names."""
        found = self.snapshots()
        named = {at.rsplit("/", 1)[0] for path in found[-KEPT:] for held in self._load(path)["tables"].values() for at in held.values()}
        for path in found[:-KEPT]:
            self._fs.delete(self._path(path), False)
        for name in SCHEMAS:
            for folder in self.listed(f"{self.folder}/{name}"):
                if folder not in named:
                    self._fs.delete(self._path(folder), True)

    def delete_document(self, document_id: str) -> None:
        """The document, its facts, their pairs, relationships and memberships; its clusters are counted anew."""
        with self.change() as c:
            own = self.spark.createDataFrame([(document_id,)], "id string")
            gone = cut(c.read("facts").filter(F.col("document_id") == document_id).select("id"))
            shared = cut(c.read("cluster_members").join(gone, F.col("fact_id") == F.col("id"), "left_semi").select("cluster_id"))
            nothing = lambda name: empty(self.spark, name)
            c.replace("documents", nothing("documents"), "id", own)
            for name in ("facts", "diagnostics"):
                c.replace(name, nothing(name), "document_id", own, ("document_id",))
            for name in ("relationships", "candidate_pairs"):
                c.replace(name, nothing(name), "id", gone, ("fact_a_id", "fact_b_id"))
            c.replace("cluster_members", nothing("cluster_members"), "fact_id", gone, ("fact_id",))
            c.recount(shared)

    def delete_all(self) -> None:
        with self.change() as c:
            c.state["tables"] = {}

    def set_status(self, document_id: str, status: str, progress: int, message: str, now: str, error: str | None = None) -> None:
        with self.change() as c:
            new = {"status": F.lit(status), "progress_pct": F.lit(progress), "progress_message": F.lit(message), "error_message": F.lit(error).cast("string"), "updated_at": F.lit(now)}
            own = c.read("documents").filter(F.col("id") == document_id)
            c.replace("documents", own.withColumns(new), "id", own.select("id"))


def _untouched(df: DataFrame, gone: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.join(gone.withColumnRenamed("id", "_gone"), F.col(c) == F.col("_gone"), "left_anti")
    return df


def without_document(facts: DataFrame, relationships: DataFrame, document_id: str, a: str = "a_id", b: str = "b_id") -> tuple[DataFrame, DataFrame]:
    gone = facts.filter(F.col("document_id") == document_id).select("id")
    return facts.filter(F.col("document_id") != document_id), _untouched(relationships, gone, a, b)

"""Read queries: each takes the frames of the data model and gives a lazy frame in the shape of the API's answer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import vocab as V
from factloom.functions.periods import sort_key
from factloom.functions.text import title
from factloom.operators.match import as_side


def contains(column: str, wanted: str) -> Column:
    """Case-insensitive; % and _ in what is asked for stay wildcards."""
    return F.lower(column).like("%" + wanted.strip().lower() + "%")


def filtered(df: DataFrame, *tests: Column | None) -> DataFrame:
    """df with those tests applied that were asked for."""
    return reduce(lambda d, t: d if t is None else d.filter(t), tests, df)


def page(df: DataFrame, limit: int, offset: int, most: int) -> DataFrame:
    if not 1 <= limit <= most or offset < 0:
        raise ValueError(f"limit must be 1 to {most} and offset 0 or more")
    return df.offset(offset).limit(limit)


def list_documents(documents: DataFrame, facts: DataFrame) -> DataFrame:
    """Documents with their accepted, verified and partly verified facts counted; those without facts stay."""
    accepted = facts.filter("status = 'ACCEPTED'").groupBy("document_id").agg(F.count("id").alias("facts_count"), F.count_if(F.col("grounding_status").isin("VERIFIED", "PARTIAL")).alias("grounded_count"))
    joined = documents.join(accepted, documents.id == accepted.document_id, "left").drop("document_id")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("facts_count", "grounded_count")}).orderBy(F.desc("created_at"), "id")


def get_document(documents: DataFrame, facts: DataFrame, document_id: str) -> DataFrame:
    return list_documents(documents.filter(F.col("id") == document_id), facts.filter(F.col("document_id") == document_id))


def with_filename(facts: DataFrame, documents: DataFrame) -> DataFrame:
    names = documents.select(F.col("id").alias("_d"), F.col("filename").alias("document_filename"))
    return facts.join(names, F.col("document_id") == F.col("_d")).drop("_d")


def list_facts(
    facts: DataFrame, documents: DataFrame, status: str = "ACCEPTED", document_id: str | None = None, subject: str | None = None, predicate: str | None = None, fact_type: str | None = None,
    period: str | None = None, grounding_status: str | None = None, min_confidence: float | None = None, limit: int = 100, offset: int = 0,
) -> DataFrame:
    own = filtered(
        facts, F.col("status") == status, F.col("document_id") == document_id if document_id else None, contains("subject", subject) if subject else None, contains("predicate", predicate) if predicate else None,
        F.col("fact_type") == fact_type if fact_type else None, contains("period", period) if period else None, F.col("grounding_status") == grounding_status if grounding_status else None,
        F.col("confidence") >= min_confidence if min_confidence is not None else None,
    )
    return page(with_filename(own, documents).orderBy(F.desc("confidence"), F.desc("created_at"), "id"), limit, offset, 500)


def full_relationships(relationships: DataFrame, facts: DataFrame, documents: DataFrame) -> DataFrame:
    """Relationships with both facts and their documents."""
    r = relationships.select("id", F.col("a_id").alias("fact_a_id"), F.col("b_id").alias("fact_b_id"), "canonical_key", "type", "reasoning", "confidence", "created_at")
    columns = ["id", "document_id", "page_number", "subject", "predicate", "value", "period", "scope", "evidence_quote", "document_filename"]
    f = with_filename(facts, documents).select(*columns)
    a, b = as_side(f, "fact_a"), as_side(f, "fact_b")
    return r.join(a.withColumnRenamed("fact_a_id", "_a"), F.col("fact_a_id") == F.col("_a")).drop("_a").join(b.withColumnRenamed("fact_b_id", "_b"), F.col("fact_b_id") == F.col("_b")).drop("_b")


def list_relationships(relationships: DataFrame, facts: DataFrame, documents: DataFrame, type: str | None = None, min_confidence: float | None = None, document_id: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:  # noqa: A002
    asked = filtered(relationships, F.col("type") == type.upper() if type else None, F.col("confidence") >= min_confidence if min_confidence is not None else None)
    full = filtered(full_relationships(asked, facts, documents), (F.col("fact_a_document_id") == document_id) | (F.col("fact_b_document_id") == document_id) if document_id else None)
    return page(full.orderBy(F.desc("confidence"), F.desc("created_at"), "id"), limit, offset, 500)


def relationship_detail(relationships: DataFrame, facts: DataFrame, documents: DataFrame, relationship_id: str) -> DataFrame:
    """The relationship and, as structs, both facts whole."""
    one = relationships.filter(F.col("id") == relationship_id).select("id", "a_id", "b_id", "type", "reasoning", "confidence", "comparison_context", "created_at")
    f = with_filename(facts, documents)
    whole = f.select(F.col("id").alias("_f"), F.struct(*f.columns).alias("fact"))
    a, b = whole.withColumnsRenamed({"_f": "_a", "fact": "fact_a"}), whole.withColumnsRenamed({"_f": "_b", "fact": "fact_b"})
    return one.join(a, F.col("a_id") == F.col("_a")).join(b, F.col("b_id") == F.col("_b")).drop("_a", "_b")


def fact_relationships(relationships: DataFrame, facts: DataFrame, documents: DataFrame, fact_id: str) -> DataFrame:
    """The relationships in which a fact is either side."""
    own = relationships.filter((F.col("a_id") == fact_id) | (F.col("b_id") == fact_id))
    return full_relationships(own, facts, documents).orderBy(F.desc("confidence"), "id")


def fact_detail(facts: DataFrame, documents: DataFrame, relationships: DataFrame, clusters: DataFrame, members: DataFrame, fact_id: str) -> DataFrame:
    """One row: the fact, its relationships (confidence first) and its cluster."""
    fact = with_filename(facts.filter(F.col("id") == fact_id), documents)
    rel = fact_relationships(relationships, facts, documents, fact_id)
    listed = rel.groupBy(F.lit(fact_id).alias("_r")).agg(F.sort_array(F.collect_list(F.struct((-F.col("confidence")).alias("order"), "id", "type", "reasoning", "confidence"))).alias("relationships"))
    cluster = members.filter(F.col("fact_id") == fact_id).join(clusters.withColumnRenamed("id", "_c"), F.col("cluster_id") == F.col("_c")).orderBy("cluster_id").limit(1).select(F.col("fact_id").alias("_m"), "cluster_id", "display_name")
    return fact.join(listed, fact.id == F.col("_r"), "left").join(cluster, fact.id == F.col("_m"), "left").drop("_r", "_m")


def list_clusters(clusters: DataFrame, subject: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    return page(filtered(clusters, contains("canonical_subject", subject) if subject else None).orderBy(F.desc("fact_count"), F.desc("updated_at"), "id"), limit, offset, 200)


def cluster_detail(members: DataFrame, facts: DataFrame, documents: DataFrame, cluster_id: str | None = None) -> DataFrame:
    """Members of a cluster (or of all), periods ascending with unknown ones first, confidence first."""
    own = filtered(members, F.col("cluster_id") == cluster_id if cluster_id else None).select("cluster_id", "fact_id", "similarity_score")
    return own.join(with_filename(facts, documents), F.col("fact_id") == F.col("id")).orderBy("cluster_id", F.asc_nulls_first("period"), F.desc("confidence"), "id")


def timeline(facts: DataFrame, documents: DataFrame, subject: str | None = None, predicate: str | None = None, document_id: str | None = None) -> DataFrame:
    """Dated accepted facts in groups of one subject and predicate, in time order; groups in the order of their first fact."""
    dated = filtered(
        facts.filter("status = 'ACCEPTED' AND period IS NOT NULL AND trim(period) != ''"), contains("subject", subject) if subject else None, contains("predicate", predicate) if predicate else None,
        F.col("document_id") == document_id if document_id else None,
    )
    rows = with_filename(dated, documents).withColumns({"date_sort_key": sort_key(F.col("period")), "group_subject": title(F.col("subject")), "group_predicate": title(F.col("predicate"))})
    item = F.struct("date_sort_key", "id", "period", "value", "document_filename", "page_number", "confidence")
    groups = rows.groupBy("group_subject", "group_predicate").agg(F.sort_array(F.collect_list(item)).alias("timeline"), F.min(F.struct("date_sort_key", "id")).alias("_first"))
    return groups.orderBy("_first").drop("_first")


REVIEW = ["id", "review_type", "title", "reason", "severity", "document_id", "document_filename", "page_number", "evidence_quote", "relationship_id", "fact_id", "created_at"]


def review_queue(relationships: DataFrame, facts: DataFrame, documents: DataFrame, severity: str | None = None, review_type: str | None = None) -> DataFrame:
    """What a person should look at: five kinds of items, each with its own order and limit; filters come after the limits."""
    none = F.lit(None).cast("string")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    c = F.col

    def items(df: DataFrame, prefix: str, kind: str, **fields: Column) -> DataFrame:
        given = {"id": say(prefix, c("id")), "review_type": F.lit(kind), "relationship_id": none, "fact_id": none, "created_at": c("created_at")} | fields
        return df.select(*[given[name].alias(name) for name in REVIEW])

    f = with_filename(facts, documents)
    fact_fields = {"document_id": c("document_id"), "document_filename": c("document_filename"), "page_number": c("page_number"), "evidence_quote": c("evidence_quote"), "fact_id": c("id")}
    percent = lambda x: F.floor(x * 100).cast("string")
    accepted = f.filter("status = 'ACCEPTED'")
    contradictions = items(
        full_relationships(relationships.filter("type = 'CONTRADICT'"), facts, documents), "rev_contra_", "CONTRADICTION",
        title=say("Direct Contradiction: ", c("fact_a_subject"), " ", c("fact_a_predicate")), reason=c("reasoning"), severity=F.when(c("confidence") >= 0.85, "high").otherwise("medium"), document_id=none,
        document_filename=say(c("fact_a_document_filename"), " vs ", c("fact_b_document_filename")), page_number=c("fact_a_page_number"),
        evidence_quote=say('Doc A: "', c("fact_a_evidence_quote"), '" vs Doc B: "', c("fact_b_evidence_quote"), '"'), relationship_id=c("id"),
    )
    rejected = items(
        f.filter("status = 'REJECTED'").orderBy(F.desc("created_at"), "id").limit(50), "rev_rej_", "REJECTED_FACT", title=say("Rejected Extraction: '", c("subject"), " - ", c("predicate"), "'"),
        reason=F.coalesce("rejection_reason", F.lit("Semantic validation rejected noise or isolated numerical fragment.")), severity=F.lit("low"), **fact_fields,
    )
    ungrounded = items(
        accepted.filter("grounding_status = 'UNVERIFIED' OR grounding_score < 0.70").orderBy("grounding_score", "id").limit(50), "rev_ground_", "UNGROUNDED",
        title=say("Weak Evidence Grounding (", percent(c("grounding_score")), "%): ", c("subject"), " ", c("predicate")),
        reason=F.lit("The claim could not be fully matched to verbatim source page text. Review source wording."), severity=F.when(c("grounding_score") < 0.5, "medium").otherwise("low"), **fact_fields,
    )
    unsure = items(
        accepted.filter("confidence < 0.60 AND grounding_status != 'UNVERIFIED'").orderBy("confidence", "id").limit(30), "rev_conf_", "LOW_CONFIDENCE",
        title=say("Low Confidence Claim (", percent(c("confidence")), "%): ", c("subject"), " ", c("predicate")), reason=F.lit("Claim has weak qualifiers or low semantic clarity."), severity=F.lit("low"), **fact_fields,
    )
    failed = items(
        documents.filter("status = 'FAILED'"), "rev_doc_", "WARNING", title=say("Document Ingestion Failed: ", c("filename")), reason=F.coalesce("error_message", F.lit("Fatal error during document parsing or extraction.")),
        severity=F.lit("high"), document_id=c("id"), document_filename=c("filename"), page_number=F.lit(None).cast("int"), evidence_quote=none, created_at=c("updated_at"),
    )
    every = reduce(DataFrame.unionByName, [contradictions, rejected, ungrounded, unsure, failed])
    return filtered(every, c("severity") == severity.lower() if severity else None, c("review_type") == review_type.upper() if review_type else None)


def dashboard_stats(documents: DataFrame, facts: DataFrame, relationships: DataFrame) -> DataFrame:
    """One row of counts, each table read once."""
    accepted = F.col("status") == "ACCEPTED"
    d = documents.agg(F.count("*").alias("total_documents"), F.count_if(F.col("status") == "FAILED").alias("_failed"))
    f = facts.agg(
        F.count_if(accepted).alias("total_facts"), F.count_if(accepted & (F.col("grounding_status") == "VERIFIED")).alias("verified_facts"), F.count_if(F.col("status") == "REJECTED").alias("_rejected"),
        F.count_if(accepted & ((F.col("grounding_status") == "UNVERIFIED") | (F.col("confidence") < 0.60))).alias("_weak"),
    )
    kinds = {"corroborations": "CORROBORATE", "contradictions": "CONTRADICT", "reconciliations": "RECONCILE"}
    r = relationships.agg(F.count("*").alias("total_relationships"), *[F.count_if(F.col("type") == t).alias(n) for n, t in kinds.items()])
    one = d.withColumn("_k", F.lit(1)).join(f.withColumn("_k", F.lit(1)), "_k").join(r.withColumn("_k", F.lit(1)), "_k")
    total = F.col("_weak") + F.col("contradictions") + F.col("_rejected") + F.col("_failed")
    return one.withColumn("needs_review_count", total).drop("_k", "_failed", "_rejected", "_weak")


def recent_activity(documents: DataFrame, relationships: DataFrame) -> DataFrame:
    """The eight latest of the five latest documents and the five latest relationships."""
    docs = documents.select(F.lit("document").alias("item_type"), "id", F.col("filename").alias("title"), F.col("status").alias("subtitle"), "created_at").orderBy(F.desc("created_at"), "id").limit(5)
    rels = relationships.select(F.lit("relationship").alias("item_type"), "id", F.concat("type", F.lit(": "), "a_subject", F.lit(" "), "a_predicate").alias("title"), F.col("reasoning").alias("subtitle"), "created_at")
    return docs.unionByName(rels.orderBy(F.desc("created_at"), "id").limit(5)).orderBy(F.desc("created_at"), "id").limit(8)


def list_diagnostics(diagnostics: DataFrame, documents: DataFrame, document_id: str | None = None, limit: int = 20) -> DataFrame:
    own = filtered(diagnostics, F.col("document_id") == document_id if document_id else None)
    names = documents.select(F.col("id").alias("_d"), F.col("filename").alias("document_filename"))
    return page(own.join(names, F.col("document_id") == F.col("_d"), "left").drop("_d").orderBy(F.desc("created_at"), "id"), limit, 0, 100)


def latest_diagnostic(diagnostics: DataFrame) -> DataFrame:
    """The last run of each document."""
    last = Window.partitionBy("document_id").orderBy(F.desc("created_at"), F.desc("id"))
    return diagnostics.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


# --- audits ---------------------------------------------------------------------------------------------------------------


def contaminated(facts: DataFrame) -> DataFrame:
    bad = F.lower("predicate").isin(V.AUDIT_PREDICATES) | F.lower("value").isin(V.AUDIT_VALUES) | F.lower("subject").isin(V.AUDIT_SUBJECTS)
    return facts.filter("status = 'ACCEPTED'").agg(F.count_if(bad).alias("n"))


def verb_pairs(relationships: DataFrame) -> DataFrame:
    a, b = F.lower("a_predicate"), F.lower("b_predicate")
    return relationships.agg(F.count_if((a == b) & a.isin(V.AUDIT_VERBS)).alias("n"))


def by_type(relationships: DataFrame) -> DataFrame:
    return relationships.groupBy("type").agg(F.count("*").alias("n"))


def summary_counts(facts: DataFrame, relationships: DataFrame, clusters: DataFrame) -> DataFrame:
    f = facts.agg(F.count_if(F.col("status") == "ACCEPTED").alias("accepted"), F.count_if(F.col("status") == "REJECTED").alias("rejected")).withColumn("_k", F.lit(1))
    r, k = (df.agg(F.count("*").alias(n)).withColumn("_k", F.lit(1)) for df, n in ((relationships, "relationships"), (clusters, "clusters")))
    return f.join(r, "_k").join(k, "_k").drop("_k")


def top_facts(facts: DataFrame, documents: DataFrame, k: int = 15) -> DataFrame:
    best = with_filename(facts.filter("status = 'ACCEPTED'"), documents).orderBy(F.desc("confidence"), "id").limit(k)
    return best.select("id", "subject", "predicate", "value", "period", "grounding_status", "confidence", "document_filename")


def sample_relationships(relationships: DataFrame, k: int = 10) -> DataFrame:
    return relationships.orderBy("id").limit(k).select("id", "a_subject", "a_predicate", F.col("a_value").alias("v1"), F.col("b_value").alias("v2"), "type", "confidence")


def explain_zero_facts(counts: DataFrame) -> DataFrame:
    """counts (total_pages, pages_with_text, raw_facts, accepted_facts, rejected_facts) with a message for people."""
    c = F.col
    message = (
        F.when(c("total_pages") == 0, "The PDF contains 0 pages or could not be opened.")
        .when(c("pages_with_text") == 0, "No extractable text was found on any page (the document may be a scanned image requiring OCR).")
        .when(c("raw_facts") == 0, "No claims or numerical metrics were identified in the document text by the extractor.")
        .when((c("accepted_facts") == 0) & (c("rejected_facts") > 0), F.concat(F.lit("All "), c("rejected_facts").cast("string"), F.lit(" extracted candidate facts were rejected by the validation layer (e.g. isolated numbers, missing evidence, or malformed claims).")))
        .otherwise("Extraction finished normally.")
    )
    return counts.withColumn("message", message)

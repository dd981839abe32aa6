"""The queries of this engine by name, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import metrics, periods, quality, text, values
from factloom.functions import vocab as V
from factloom.operators import chunking, extract, match, relate, replies
from factloom.operators import ground as grounding
from factloom.plans import ledger, reports, sql, store, views
from factloom.plans.ingest import facts_of_pages
from factloom.session import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql_text: str | None = None):
    """Register the function under its name, with the SQL of the same result."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql_text:
            ORACLE_SQL[f.__name__] = sql_text
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


# --- sources and text -----------------------------------------------------------------------------------------------------


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def scan_documents(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", "lang", "source", "n_chars")


@query("SELECT doc_id, sha256(text) AS file_hash FROM documents")
def content_hash(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("file_hash"))


@query("SELECT d.doc_id, CASE WHEN d.doc_id <> f.first THEN f.first END AS duplicate_of FROM (SELECT doc_id, sha256(text) AS h FROM documents) d JOIN (SELECT sha256(text) AS h, min(doc_id) AS first FROM documents GROUP BY 1) f ON d.h = f.h")
def duplicate_of(spark, sf_dir):
    """Of equal contents the oldest row; a plain aggregate and a join, so a hot content does not meet in one window."""
    hashed = _docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("h"))
    first = hashed.groupBy("h").agg(F.min("doc_id").alias("first"))
    return hashed.join(first, "h").select("doc_id", F.when(F.col("doc_id") != F.col("first"), F.col("first")).alias("duplicate_of"))


@query(f"SELECT doc_id, sha256({sql.clean_text('text')}) AS cleaned FROM documents")
def clean_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2(text.clean_text(F.col("text")), 256).alias("cleaned"))


@query(f"SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, sha256(array_to_string(s, chr(1))) AS digest FROM (SELECT doc_id, {sql.sentences('text')} AS s FROM documents)")
def split_sentences(spark, sf_dir):
    s = _docs(spark, sf_dir).select("doc_id", text.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.sha2(F.array_join("s", "\u0001"), 256).alias("digest"))


@query(f"SELECT doc_id, CAST({sql.word_count('text')} AS BIGINT) AS n_words FROM documents")
def word_count(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.word_count(F.col("text")).cast("long").alias("n_words"))


def _page_texts(spark, sf_dir):
    return _docs(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"), "text")


@query(
    rf"SELECT doc_id AS document_id, CAST({sql.word_count('text')} AS BIGINT) AS word_count, sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS digest FROM documents "
    rf"WHERE {sql.word_count('text')} BETWEEN 1 AND 1000"
)
def chunk_small_pages(spark, sf_dir):
    chunks = chunking.chunk_pages(_page_texts(spark, sf_dir).filter(text.word_count(F.col("text")) <= V.CHUNK_WORDS))
    return chunks.select("document_id", F.col("word_count").cast("long").alias("word_count"), F.sha2("text", 256).alias("digest"))


@query()
def chunk_overlap(spark, sf_dir):
    chunks = chunking.chunk_pages(_page_texts(spark, sf_dir).filter(text.word_count(F.col("text")) > V.CHUNK_WORDS))
    return chunks.select("document_id", "chunk_ordinal", "word_count", F.sha2("text", 256).alias("digest"))


@query(f"SELECT doc_id, sha256({sql.grounding_text('text')}) AS normalized FROM documents")
def ground_text_norm(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2(text.grounding_text(F.col("text")), 256).alias("normalized"))


@query(f"SELECT doc_id, sha256({sql.comparison_text(sql.grounding_text('text'))}) AS compared FROM documents")
def ground_compare_norm(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2(text.comparison_text(text.grounding_text(F.col("text"))), 256).alias("compared"))


QUOTE = "substr(text, 41, 80)"


@query(
    f"SELECT doc_id, contains(lower({sql.grounding_text('text')}), lower({sql.grounding_text(QUOTE)})) AND {sql.grounding_text(QUOTE)} <> '' AS verified FROM documents"
)
def ground_exact(spark, sf_dir):
    """A quote from a fixed place of each text, found in its text again."""
    rows = _docs(spark, sf_dir).select("doc_id", text.grounding_text(F.col("text")).alias("p"), text.grounding_text(F.substring("text", 41, 80)).alias("q"))
    return rows.select("doc_id", (F.contains(F.lower("p"), F.lower("q")) & (F.col("q") != "")).alias("verified"))


@query(
    f"SELECT doc_id, round(len(list_intersect(list_distinct(a), list_distinct(b)))::DOUBLE / len(list_distinct(a)), 4) AS share FROM (SELECT doc_id, {sql.tokens(sql.comparison_text(sql.grounding_text('substr(text, 1, 400)')))} AS a, "
    f"{sql.tokens(sql.comparison_text(sql.grounding_text('substr(text, 401)')))} AS b FROM documents) WHERE len(a) > 0"
)
def ground_token_overlap(spark, sf_dir):
    """How many of the tokens of a text's opening come up again in the rest."""
    norm = lambda c: text.tokens(text.comparison_text(text.grounding_text(c)))
    rows = _docs(spark, sf_dir).select("doc_id", norm(F.substring("text", 1, 400)).alias("a"), norm(F.substring("text", 401, 2**31 - 1)).alias("b"))
    return rows.filter(F.size("a") > 0).select("doc_id", F.round(grounding.token_overlap(F.col("a"), F.col("b")), 4).alias("share"))


@query()
def ground_fuzzy(spark, sf_dir):
    """Quotes with a word left out: no exact level finds them."""
    d = _docs(spark, sf_dir)
    words = F.split(F.trim(F.col("text")), r"\s+")
    quote = F.array_join(F.concat(F.slice(words, 1, 6), F.slice(words, 8, 6)), " ")
    rows = d.select("doc_id", quote.alias("evidence_quote"), F.col("text").alias("page_text"))
    return grounding.ground(rows).select("doc_id", "grounding_score", "grounding_status")


# --- gates and normalisation ----------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, CAST(len(list_filter(string_split(text, ' '), lambda w: {sql.meaningless('w')})) AS INTEGER) AS meaningless FROM documents")
def meaningless_number(spark, sf_dir):
    """How many words of each whole text are lone numbers."""
    words = F.split("text", " ")
    return _docs(spark, sf_dir).select("doc_id", F.size(F.filter(words, quality.meaningless_number)).alias("meaningless"))


@query(sql.FACTS + " SELECT id, quality_score FROM facts")
def fact_quality(spark, sf_dir):
    return ledger.facts(spark, sf_dir).select("id", "quality_score")


@query(sql.FACTS + " SELECT id, status, rejection_reason FROM facts")
def validate_facts(spark, sf_dir):
    return ledger.facts(spark, sf_dir).select("id", "status", "rejection_reason")


@query(sql.FACTS + " SELECT id, grounding_status, grounding_score, confidence FROM facts")
def fact_confidence(spark, sf_dir):
    return ledger.facts(spark, sf_dir).select("id", "grounding_status", "grounding_score", "confidence")


#: The forms in which a date's fiscal period may be written.
_FORMS = ["'FY' || yy", "'FY 20' || yy", "'Fiscal 20' || yy", "'Q' || q || ' FY' || yy", "q || 'Q FY20' || yy", "'20' || yy", "'20' || yy || '-' || mm", "'20' || yy || '-' || mm || '-15'", "'H1 FY' || yy", "'sometime'", "''", "CAST(NULL AS STRING)"]
_DATES = "SELECT DISTINCT lpad(CAST((year(o_orderdate) + 24) % 100 AS {s}), 2, '0') AS yy, CAST(quarter(o_orderdate) AS {s}) AS q, lpad(CAST(month(o_orderdate) AS {s}), 2, '0') AS mm FROM orders"
_PERIODS_SQL = "WITH d AS (" + _DATES.format(s="VARCHAR") + "), forms AS (" + " UNION ".join(f"SELECT {f.replace('STRING', 'VARCHAR')} AS raw FROM d" for f in _FORMS) + ") "


def _periods(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("factloom_orders")
    dates = spark.sql(_DATES.format(s="STRING").replace("FROM orders", "FROM factloom_orders"))
    return dates.select(F.explode(F.array(*[F.expr(f) for f in _FORMS])).alias("raw")).distinct()


@query(_PERIODS_SQL + f"SELECT raw, {sql.normalize_period('raw')} AS period FROM forms")
def normalize_period(spark, sf_dir):
    return _periods(spark, sf_dir).select("raw", periods.normalize_period(F.col("raw")).alias("period"))


@query(_PERIODS_SQL + f"SELECT raw, {sql.sort_key(sql.normalize_period('raw'))} AS date_sort_key FROM forms")
def timeline_keys(spark, sf_dir):
    return _periods(spark, sf_dir).select("raw", periods.sort_key(periods.normalize_period(F.col("raw"))).alias("date_sort_key"))


#: The forms in which an amount may be written.
_AMOUNTS = ["'$' || n", "'₹' || n || ' crore'", "'Rs. ' || n || ' lakh'", "n || '%'", "n || ' per cent'", "n || ' million'", "n || 'Mn'", "n || ' liters'", "n || ' bar'", "'€' || n || 'bn'", "'USD ' || n", "n || ' units'", "'none'", "n || ' percent'"]


@query("WITH v AS (SELECT DISTINCT format('{:,}', CAST(floor(p_retailprice) AS BIGINT)) AS n FROM part), forms AS (" + " UNION ".join(f"SELECT {f} AS value FROM v" for f in _AMOUNTS) + f") SELECT value, {sql.value_columns('value')} FROM forms")
def normalize_value(spark, sf_dir):
    v = table(spark, sf_dir, "part").select(F.format_number(F.floor("p_retailprice"), 0).alias("n")).distinct()
    forms = v.select(F.explode(F.array(*[F.expr(f) for f in _AMOUNTS])).alias("value")).distinct()
    return forms.select("value", values.normalize_value(F.col("value"), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("n")).select("value", "n.*")


@query(sql.FACTS + " SELECT id, normalized_value, normalized_unit, currency, period FROM facts")
def normalize_fact(spark, sf_dir):
    return ledger.facts(spark, sf_dir).select("id", "normalized_value", "normalized_unit", "currency", "period")


# --- matching -------------------------------------------------------------------------------------------------------------

_NAMES = "SELECT DISTINCT p_name || CASE p_size % 5 WHEN 0 THEN ' revenue' WHEN 1 THEN ' operating pressure' WHEN 2 THEN ' shipments' WHEN 3 THEN ' net tax revenue' ELSE '' END AS predicate FROM part"


def _predicates(spark, sf_dir):
    table(spark, sf_dir, "part").createOrReplaceTempView("factloom_part")
    return spark.sql(_NAMES.replace("FROM part", "FROM factloom_part"))


@query(f"SELECT predicate, {sql.metric_family('predicate')} AS family FROM ({_NAMES})")
def metric_family(spark, sf_dir):
    return _predicates(spark, sf_dir).select("predicate", metrics.metric_family(F.col("predicate")).alias("family"))


@query(f"SELECT predicate, array_to_string(list_sort({sql.core_tokens('predicate', V.METRIC_STOP_WORDS)}), ' ') AS tokens FROM ({_NAMES})")
def predicate_tokens(spark, sf_dir):
    return _predicates(spark, sf_dir).select("predicate", F.array_join(F.array_sort(metrics.predicate_tokens(F.col("predicate"))), " ").alias("tokens"))


@query()
def predicate_similarity(spark, sf_dir):
    return match.similar(_predicates(spark, sf_dir), "predicate", V.LEAST_PREDICATE).toDF("pred_a", "pred_b", "pred_score")


@query()
def subject_similarity(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.initcap("p_name").alias("subject"))
    return match.similar(names, "subject", V.LEAST_SUBJECT).toDF("subj_a", "subj_b", "subj_score")


@query(sql.PAIRS + " SELECT a_id AS fact_a_id, b_id AS fact_b_id, match_score, match_reason FROM pairs")
def candidate_pairs(spark, sf_dir):
    return ledger.pairs(spark, sf_dir).select(F.col("a_id").alias("fact_a_id"), F.col("b_id").alias("fact_b_id"), "match_score", "match_reason")


@query(
    sql.PAIRS
    + """, ordered AS (
  SELECT *, row_number() OVER (PARTITION BY CASE WHEN a_created_at > b_created_at THEN a_document_id ELSE b_document_id END
    ORDER BY CASE WHEN a_created_at > b_created_at THEN a_created_at ELSE b_created_at END, CASE WHEN a_created_at > b_created_at THEN a_id ELSE b_id END,
             CASE WHEN a_created_at > b_created_at THEN b_created_at ELSE a_created_at END, CASE WHEN a_created_at > b_created_at THEN b_id ELSE a_id END) AS n FROM pairs
) SELECT a_id AS fact_a_id, b_id AS fact_b_id, match_score FROM ordered WHERE n <= 40"""
)
def candidate_pairs_capped(spark, sf_dir):
    return match.capped(ledger.pairs(spark, sf_dir)).select(F.col("a_id").alias("fact_a_id"), F.col("b_id").alias("fact_b_id"), "match_score")


_REL = "canonical_key, type, reasoning, confidence, created_at"


@query(sql.RELATIONS + f" SELECT {_REL} FROM relationships")
def relationships(spark, sf_dir):
    return ledger.relationships(spark, sf_dir).select(*_REL.split(", "))


@query(sql.RELATIONS + " SELECT canonical_key, type, CASE WHEN type = 'CORROBORATE' THEN 0.5 ELSE confidence END AS confidence FROM relationships")
def relationship_upsert(spark, sf_dir):
    """Stored relationships written over by newer ones of the same key."""
    stored = ledger.relationships(spark, sf_dir).select("id", "canonical_key", "type", "confidence", "created_at")
    newer = stored.filter("type = 'CORROBORATE'").withColumn("confidence", F.lit(0.5))
    return relate.upsert(stored, newer).select("canonical_key", "type", "confidence")


# --- clusters and time ----------------------------------------------------------------------------------------------------

_CL = "id, canonical_subject, canonical_predicate, canonical_period, canonical_scope, fact_count, source_doc_count, created_at, updated_at"


@query(sql.CLUSTERS + f" SELECT {_CL} FROM clusters")
def clusters(spark, sf_dir):
    return ledger.fact_clusters(spark, sf_dir)[0].select(*_CL.split(", "))


@query(sql.CLUSTERS + " SELECT cluster_id, fact_id, 1.0::DOUBLE AS similarity_score, added_at FROM members")
def cluster_members(spark, sf_dir):
    return ledger.fact_clusters(spark, sf_dir)[1]


@query(sql.CLUSTERS + " SELECT id, canonical_subject, canonical_predicate, fact_count, updated_at FROM clusters WHERE lower(canonical_subject) LIKE '%nation_1%' ORDER BY fact_count DESC, updated_at DESC, id LIMIT 50")
def list_clusters(spark, sf_dir):
    return views.list_clusters(ledger.fact_clusters(spark, sf_dir)[0], subject="nation_1").select("id", "canonical_subject", "canonical_predicate", "fact_count", "updated_at")


@query(sql.CLUSTERS + " SELECT m.cluster_id, f.id, f.period, f.confidence, f.filename AS document_filename FROM members m JOIN facts f ON m.fact_id = f.id")
def cluster_detail(spark, sf_dir):
    own = ledger.facts(spark, sf_dir)
    _, members = ledger.fact_clusters(spark, sf_dir)
    return views.cluster_detail(members, own.drop("filename"), ledger.documents(spark, sf_dir)).select("cluster_id", "id", "period", "confidence", "document_filename")


@query(
    sql.FACTS
    + f""", keyed AS (SELECT {sql.title("subject")} AS group_subject, {sql.title("predicate")} AS group_predicate, {sql.sort_key("period")} AS k, id, value FROM facts WHERE status = 'ACCEPTED' AND coalesce(trim(period), '') <> '')
SELECT group_subject, group_predicate, count(*) AS n, string_agg(k || '=' || value, ';' ORDER BY k, id) AS line FROM keyed GROUP BY 1, 2"""
)
def timeline_groups(spark, sf_dir):
    groups = views.timeline(ledger.facts(spark, sf_dir).drop("filename"), ledger.documents(spark, sf_dir))
    line = F.array_join(F.transform("timeline", lambda x: F.concat(x["date_sort_key"], F.lit("="), x["value"])), ";")
    return groups.select("group_subject", "group_predicate", F.size("timeline").cast("long").alias("n"), line.alias("line"))


# --- lists and details ----------------------------------------------------------------------------------------------------

_FACT = "id, subject, predicate, value, period, confidence, created_at, document_filename"
_FACT_SQL = _FACT.replace("document_filename", "filename AS document_filename")


def _own(spark, sf_dir):
    return ledger.facts(spark, sf_dir).drop("filename"), ledger.documents(spark, sf_dir)


@query(sql.FACTS + f" SELECT {_FACT_SQL} FROM facts WHERE status = 'ACCEPTED' AND confidence >= 0.5 ORDER BY confidence DESC, created_at DESC, id LIMIT 100 OFFSET 10")
def list_facts(spark, sf_dir):
    return views.list_facts(*_own(spark, sf_dir), min_confidence=0.5, limit=100, offset=10).select(*_FACT.split(", "))


@query(sql.FACTS + f" SELECT {_FACT_SQL} FROM facts WHERE status = 'ACCEPTED' AND lower(subject) LIKE '%nation_2%' AND lower(predicate) LIKE '%revenue%' AND document_id = 'orders_ledger' ORDER BY confidence DESC, created_at DESC, id LIMIT 500")
def facts_contains(spark, sf_dir):
    return views.list_facts(*_own(spark, sf_dir), subject=" Nation_2 ", predicate="Revenue", document_id="orders_ledger", limit=500).select(*_FACT.split(", "))


@query(sql.RELATIONS + ", one AS (SELECT min(id) AS id FROM facts WHERE status = 'ACCEPTED') SELECT o.id, count(r.id) AS n_relationships, max(r.confidence) AS best FROM one o LEFT JOIN relationships r ON o.id = r.a_id OR o.id = r.b_id GROUP BY o.id")
def fact_detail(spark, sf_dir):
    own, docs = _own(spark, sf_dir)
    fact_id = own.filter("status = 'ACCEPTED'").agg(F.min("id")).first()[0]
    c, m = ledger.fact_clusters(spark, sf_dir)
    detail = views.fact_detail(own, docs, ledger.relationships(spark, sf_dir), c, m, fact_id)
    listed = F.coalesce("relationships", F.array().cast(detail.schema["relationships"].dataType))
    return detail.select("id", F.size(listed).cast("long").alias("n_relationships"), F.array_max(F.transform(listed, lambda r: r["confidence"])).alias("best"))


@query(
    sql.FACTS + sql.DOCS
    + """ SELECT d.id, d.filename, d.file_hash, d.file_size, d.status, count(f.id) FILTER (f.status = 'ACCEPTED') AS facts_count,
  count(f.id) FILTER (f.status = 'ACCEPTED' AND f.grounding_status IN ('VERIFIED', 'PARTIAL')) AS grounded_count
FROM docs d LEFT JOIN facts f ON f.document_id = d.id GROUP BY d.id, d.filename, d.file_hash, d.file_size, d.status"""
)
def list_documents(spark, sf_dir):
    own, docs = _own(spark, sf_dir)
    return views.list_documents(docs, own).select("id", "filename", "file_hash", "file_size", "status", "facts_count", "grounded_count")


@query(
    sql.FACTS + " SELECT 'line_ledger' AS id, count(*) FILTER (status = 'ACCEPTED') AS facts_count, count(*) FILTER (status = 'ACCEPTED' AND grounding_status IN ('VERIFIED', 'PARTIAL')) AS grounded_count FROM facts WHERE document_id = 'line_ledger'"
)
def get_document(spark, sf_dir):
    own, docs = _own(spark, sf_dir)
    return views.get_document(docs, own, "line_ledger").select("id", "facts_count", "grounded_count")


@query(
    sql.RELATIONS
    + """ SELECT id, type, confidence, a_subject AS fact_a_subject, b_predicate AS fact_b_predicate, a_filename AS fact_a_document_filename, b_filename AS fact_b_document_filename
FROM relationships WHERE type = 'RECONCILE' AND confidence >= 0.5 AND (a_document_id = 'line_ledger' OR b_document_id = 'line_ledger') ORDER BY confidence DESC, created_at DESC, id LIMIT 100"""
)
def list_relationships(spark, sf_dir):
    own, docs = _own(spark, sf_dir)
    found = views.list_relationships(ledger.relationships(spark, sf_dir), own, docs, type="reconcile", min_confidence=0.5, document_id="line_ledger")
    return found.select("id", "type", "confidence", "fact_a_subject", "fact_b_predicate", "fact_a_document_filename", "fact_b_document_filename")


@query(
    sql.RELATIONS
    + " SELECT id, type, a_value AS value_a, b_value AS value_b, a_period AS period_a, b_period AS period_b, a_filename AS file_a, b_filename AS file_b FROM relationships WHERE id = (SELECT min(id) FROM relationships)"
)
def relationship_detail(spark, sf_dir):
    own, docs = _own(spark, sf_dir)
    rel = ledger.relationships(spark, sf_dir)
    one = views.relationship_detail(rel, own, docs, rel.agg(F.min("id")).first()[0])
    return one.select("id", "type", *[F.col(f"fact_{s}.{c}").alias(f"{n}_{s}") for c, n in (("value", "value"), ("period", "period"), ("document_filename", "file")) for s in "ab"])


@query(
    sql.RELATIONS + sql.DOCS
    + """, rejected AS (SELECT * FROM facts WHERE status = 'REJECTED' ORDER BY created_at DESC, id LIMIT 50),
ungrounded AS (SELECT * FROM facts WHERE status = 'ACCEPTED' AND (grounding_status = 'UNVERIFIED' OR grounding_score < 0.70) ORDER BY grounding_score, id LIMIT 50),
unsure AS (SELECT * FROM facts WHERE status = 'ACCEPTED' AND confidence < 0.60 AND grounding_status <> 'UNVERIFIED' ORDER BY confidence, id LIMIT 30)
SELECT 'rev_contra_' || id AS id, 'CONTRADICTION' AS review_type, CASE WHEN confidence >= 0.85 THEN 'high' ELSE 'medium' END AS severity, 'Direct Contradiction: ' || a_subject || ' ' || a_predicate AS title FROM relationships WHERE type = 'CONTRADICT'
UNION ALL SELECT 'rev_rej_' || id, 'REJECTED_FACT', 'low', 'Rejected Extraction: ''' || subject || ' - ' || predicate || '''' FROM rejected
UNION ALL SELECT 'rev_ground_' || id, 'UNGROUNDED', CASE WHEN grounding_score < 0.5 THEN 'medium' ELSE 'low' END, 'Weak Evidence Grounding (' || CAST(CAST(floor(grounding_score * 100) AS BIGINT) AS VARCHAR) || '%): ' || subject || ' ' || predicate FROM ungrounded
UNION ALL SELECT 'rev_conf_' || id, 'LOW_CONFIDENCE', 'low', 'Low Confidence Claim (' || CAST(CAST(floor(confidence * 100) AS BIGINT) AS VARCHAR) || '%): ' || subject || ' ' || predicate FROM unsure
UNION ALL SELECT 'rev_doc_' || id, 'WARNING', 'high', 'Document Ingestion Failed: ' || filename FROM docs WHERE status = 'FAILED'"""
)
def review_queue(spark, sf_dir):
    own, docs = _own(spark, sf_dir)
    return views.review_queue(ledger.relationships(spark, sf_dir), own, docs).select("id", "review_type", "severity", "title")


@query(
    sql.RELATIONS + sql.DOCS
    + """ SELECT (SELECT count(*) FROM docs) AS total_documents, (SELECT count(*) FROM facts WHERE status = 'ACCEPTED') AS total_facts,
 (SELECT count(*) FROM facts WHERE status = 'ACCEPTED' AND grounding_status = 'VERIFIED') AS verified_facts, (SELECT count(*) FROM relationships) AS total_relationships,
 (SELECT count(*) FROM relationships WHERE type = 'CORROBORATE') AS corroborations, (SELECT count(*) FROM relationships WHERE type = 'CONTRADICT') AS contradictions,
 (SELECT count(*) FROM relationships WHERE type = 'RECONCILE') AS reconciliations,
 (SELECT count(*) FROM facts WHERE status = 'REJECTED' OR grounding_status = 'UNVERIFIED' OR confidence < 0.60) + (SELECT count(*) FROM relationships WHERE type = 'CONTRADICT') + (SELECT count(*) FROM docs WHERE status = 'FAILED') AS needs_review_count"""
)
def dashboard_stats(spark, sf_dir):
    own, docs = _own(spark, sf_dir)
    return views.dashboard_stats(docs, own, ledger.relationships(spark, sf_dir))


@query(
    sql.RELATIONS + sql.DOCS
    + """, d5 AS (SELECT 'document' AS item_type, id, filename AS title, status AS subtitle, created_at FROM docs ORDER BY created_at DESC, id LIMIT 5),
r5 AS (SELECT 'relationship' AS item_type, id, type || ': ' || a_subject || ' ' || a_predicate AS title, reasoning AS subtitle, created_at FROM relationships ORDER BY created_at DESC, id LIMIT 5)
SELECT * FROM (SELECT * FROM d5 UNION ALL SELECT * FROM r5) ORDER BY created_at DESC, id LIMIT 8"""
)
def recent_activity(spark, sf_dir):
    return views.recent_activity(ledger.documents(spark, sf_dir), ledger.relationships(spark, sf_dir))


_RUNS = """, per AS (SELECT document_id, count(DISTINCT page_number) AS total_pages, count(*) AS raw_facts, count(*) FILTER (status = 'ACCEPTED') AS accepted_facts, max(created_at) AS last FROM facts GROUP BY document_id),
runs AS (SELECT document_id || '#' || CAST(run AS VARCHAR) AS id, document_id, total_pages, raw_facts, accepted_facts, CASE WHEN run = 1 THEN '2023' || substr(last, 5) ELSE last END AS created_at FROM per, (VALUES (1), (2)) v(run))"""
_RUN = ["id", "document_id", "total_pages", "raw_facts", "accepted_facts", "created_at"]


@query(sql.FACTS + _RUNS + f" SELECT {', '.join(_RUN)}, document_id || '.pdf' AS document_filename FROM runs ORDER BY created_at DESC, id LIMIT 20")
def list_diagnostics(spark, sf_dir):
    return views.list_diagnostics(ledger.diagnostics(spark, sf_dir), ledger.documents(spark, sf_dir)).select(*_RUN, "document_filename")


@query(sql.FACTS + _RUNS + f" SELECT {', '.join(_RUN)} FROM runs WHERE id LIKE '%#2'")
def latest_diagnostic(spark, sf_dir):
    return views.latest_diagnostic(ledger.diagnostics(spark, sf_dir)).select(*_RUN)


# --- audits ---------------------------------------------------------------------------------------------------------------


@query(sql.FACTS + f" SELECT count(*) FILTER (lower(predicate) IN {sql.in_list(V.AUDIT_PREDICATES)} OR lower(value) IN {sql.in_list(V.AUDIT_VALUES)} OR lower(subject) IN {sql.in_list(V.AUDIT_SUBJECTS)}) AS n FROM facts WHERE status = 'ACCEPTED'")
def audit_contaminated(spark, sf_dir):
    return views.contaminated(ledger.facts(spark, sf_dir))


@query(sql.RELATIONS + f" SELECT count(*) FILTER (lower(a_predicate) = lower(b_predicate) AND lower(a_predicate) IN {sql.in_list(V.AUDIT_VERBS)}) AS n FROM relationships")
def audit_verb_pairs(spark, sf_dir):
    return views.verb_pairs(ledger.relationships(spark, sf_dir))


@query(sql.RELATIONS + " SELECT type, count(*) AS n FROM relationships GROUP BY type")
def audit_unrelated(spark, sf_dir):
    """Stored relationships by type: no UNRELATED may be among them."""
    return views.by_type(ledger.relationships(spark, sf_dir))


@query(sql.RELATIONS + " SELECT count(*) FILTER (status = 'ACCEPTED') AS accepted, count(*) FILTER (status = 'REJECTED') AS rejected, (SELECT count(*) FROM relationships) AS relationships, (SELECT count(DISTINCT (lower(subject), lower(predicate), period, scope)) FROM facts WHERE status = 'ACCEPTED') AS clusters FROM facts")
def summary_counts(spark, sf_dir):
    return views.summary_counts(ledger.facts(spark, sf_dir), ledger.relationships(spark, sf_dir), ledger.fact_clusters(spark, sf_dir)[0])


@query(sql.FACTS + " SELECT id, subject, predicate, value, period, grounding_status, confidence, filename AS document_filename FROM facts WHERE status = 'ACCEPTED' ORDER BY confidence DESC, id LIMIT 15")
def top_facts(spark, sf_dir):
    return views.top_facts(*_own(spark, sf_dir))


@query(sql.RELATIONS + " SELECT id, a_subject, a_predicate, a_value AS v1, b_value AS v2, type, confidence FROM relationships ORDER BY id LIMIT 10")
def sample_relationships(spark, sf_dir):
    return views.sample_relationships(ledger.relationships(spark, sf_dir))


# --- storage and extraction -----------------------------------------------------------------------------------------------


@query(sql.RELATIONS + " SELECT 'facts' AS name, count(*) AS n FROM facts WHERE document_id <> 'line_ledger' UNION ALL SELECT 'relationships', count(*) FROM relationships WHERE a_document_id <> 'line_ledger' AND b_document_id <> 'line_ledger'")
def delete_document_cascade(spark, sf_dir):
    """What is left of facts and relationships when one document goes."""
    facts, rels = store.without_document(ledger.facts(spark, sf_dir), ledger.relationships(spark, sf_dir), "line_ledger")
    count = lambda name, df: df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
    return count("facts", facts).unionByName(count("relationships", rels))


_FOUND = ["document_id", "ordinal", "subject", "predicate", "value", "fact_type", "period", "scope", "unit", "currency", "evidence_quote"]


@query("WITH " + reports.REPORTS_SQL + f" SELECT {', '.join(_FOUND)} FROM found")
def extract_reports(spark, sf_dir):
    """Rule extraction over a report page of each order: all three sentence patterns and call-out blocks."""
    return extract.extract_facts(chunking.chunk_pages(reports.report_pages(spark, sf_dir))).select(*_FOUND)


_INGESTED = ["document_id", "subject", "predicate", "value", "status", "grounding_status", "grounding_score", "confidence", "normalized_value", "normalized_unit", "currency", "period", "scope"]


@query(
    "WITH " + reports.REPORTS_SQL + "," + reports.INGESTED_SQL
    + f""" SELECT document_id, subject, predicate, value, 'ACCEPTED' AS status, 'VERIFIED' AS grounding_status, 1.0::DOUBLE AS grounding_score, round(least(0.98::DOUBLE, greatest(0.2::DOUBLE, 0.55::DOUBLE + quality_score * 0.45::DOUBLE)), 3) AS confidence,
 normalized_value, coalesce(normalized_unit, unit) AS normalized_unit, coalesce(currency, normalized_currency) AS currency, {sql.normalize_period("period")} AS period, scope FROM valued WHERE rejection_reason IS NULL
 UNION ALL SELECT document_id, subject, predicate, value, 'REJECTED', 'UNVERIFIED', 0.0, 0.1, NULL, NULL, currency, period, scope FROM valued WHERE rejection_reason IS NOT NULL"""
)
def ingest_reports(spark, sf_dir):
    """The whole way from report pages, one an order, to judged, grounded and normalised facts."""
    return facts_of_pages(reports.report_pages(spark, sf_dir)).select(*_INGESTED)


_MERGED = ["document_id", "subject", "predicate", "value", "fact_type", "period", "evidence_quote", "from_model"]


@query("WITH " + reports.REPORTS_SQL + "," + reports.REPLIES_SQL + f" SELECT {', '.join(_MERGED)} FROM merged")
def model_reply_facts(spark, sf_dir):
    """Facts out of model replies to the reports, cleaned, and what the rules find beside them."""
    chunks = chunking.chunk_pages(reports.report_pages(spark, sf_dir)).join(reports.report_replies(spark, sf_dir), "document_id")
    return replies.merged_facts(chunks).select(*_MERGED)


@query(
    sql.RELATIONS
    + """ SELECT id, CASE instr('0123456789abcdef', id[1]) % 4 WHEN 0 THEN 'UNRELATED' ELSE type END AS type,
 CASE instr('0123456789abcdef', id[1]) % 4 WHEN 0 THEN 0.5 WHEN 1 THEN round(least(0.98::DOUBLE, greatest(0.4::DOUBLE, 0.5::DOUBLE * 0.4 + confidence * 0.6::DOUBLE)), 3) ELSE confidence END AS confidence FROM relationships"""
)
def model_opinions(spark, sf_dir):
    """Relationships with a model's opinion joined in: one pair in four is called unrelated, one gets an opinion on its own type,
    one an answer that cannot be read, one none."""
    k = F.position(F.substring("id", 1, 1), F.lit("0123456789abcdef")) % 4
    reply = F.when(k == 0, '{"relationship_type": "unrelated"}').when(k == 1, F.to_json(F.struct(F.lower("type").alias("relationship_type"), F.lit(0.5).alias("confidence")))).when(k == 2, "no opinion")
    return replies.with_opinions(ledger.relationships(spark, sf_dir).withColumn("reply", reply)).select("id", "type", "confidence")


@query()
def extract_heuristic(spark, sf_dir):
    """Rule extraction over whole documents, each with report lines made from the business tables: the ledgers' lines are dealt to
    97 lots, and a document gets all lines of its lot."""
    docs = _docs(spark, sf_dir)
    lines = ledger.raw_ledger(spark, sf_dir).select(F.concat(F.col("subject"), F.lit(" reported "), F.col("predicate"), F.lit(" of "), F.col("value"), F.lit(" in FY2024.")).alias("line"), "id")
    lots = lines.groupBy(F.pmod(F.xxhash64("id"), F.lit(97)).alias("lot")).agg(F.array_join(F.sort_array(F.collect_list("line")), " ").alias("lines"))  # some 1250 lines at every scale
    pages = docs.withColumn("lot", F.pmod("doc_id", F.lit(97))).join(F.broadcast(lots), "lot", "left")
    pages = pages.select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"), F.concat_ws("\n\n", "lines", "text").alias("text"))
    facts = extract.extract_facts(chunking.chunk_pages(pages))
    return facts.select("document_id", "ordinal", "subject", "predicate", "value", "fact_type", "period", "unit", "currency")


@query()
def ingest_documents(spark, sf_dir):
    """The whole way from page text to judged, grounded and normalised facts."""
    pages = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("document_id"), F.lit(1).alias("page_number"), "text")
    return facts_of_pages(pages).select("id", "document_id", "subject", "predicate", "value", "status", "confidence")

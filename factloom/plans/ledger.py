"""Facts from the business tables: what the reference's queries run on, made from orders and lineitem.

Five ledgers play the part of documents. Yearly and quarterly amounts per nation become facts with an evidence quote on a
page; the facts then pass the same gates, grounding and normalisation as extracted ones, the fuzzy level included: some pages
tell a quote in other words and in another order, so that the share of common words exceeds every string ratio (SQL can follow).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.quality import judge
from factloom.functions.values import normalize_fact
from factloom.operators.cluster import cluster_members, clusters
from factloom.operators.ground import fact_confidence, ground
from factloom.operators.match import candidate_pairs, hold
from factloom.operators.relate import classify
from factloom.session import table

#: (document, month of its creation)
LEDGERS = [("orders_ledger", "01"), ("line_ledger", "02"), ("quarter_ledger", "03"), ("volume_ledger", "04"), ("noise_ledger", "05")]


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def raw_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw facts with their page text."""
    nation, customer, orders, items = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders", "lineitem"))
    home = customer.join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey).select("c_custkey", "n_nationkey", "n_name")
    placed = orders.join(home, orders.o_custkey == home.c_custkey).select("o_orderkey", "o_totalprice", "n_nationkey", "n_name", F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q"))
    sold = items.join(placed, items.l_orderkey == placed.o_orderkey)
    fiscal = F.concat(F.lit("FY"), _two((F.col("y") + 24) % 100))
    money = lambda c: F.concat(F.lit("$"), F.format_number(F.round(c).cast("bigint"), 0))
    key = ["n_nationkey", "n_name", "y"]
    # decimals: a sum of doubles that ends near .5 would hang on the order of addition
    cents = lambda c, digits=12: F.col(c).cast(f"decimal({digits},2)")
    net = cents("l_extendedprice") * (1 - cents("l_discount", 4)) * (1 + cents("l_tax", 4))
    line = lambda d, predicate, value, period, q=F.lit(0): [F.lit(d).alias("document_id"), "n_nationkey", "n_name", "y", q.alias("q"), F.lit(predicate).alias("predicate"), value.alias("value"), period.alias("period")]
    yearly = placed.groupBy(*key).agg(F.sum(cents("o_totalprice")).alias("v")).select(*line("orders_ledger", "revenue", money(F.col("v")), fiscal))
    quarterly = placed.groupBy(*key, "q").agg(F.sum(cents("o_totalprice")).alias("v")).select(*line("quarter_ledger", "revenue", money(F.col("v")), F.concat(F.lit("Q"), F.col("q").cast("string"), F.lit(" "), fiscal), F.col("q")))
    of_lines = sold.groupBy(*key).agg(F.sum(net).alias("v"), F.sum(cents("l_quantity")).alias("n"))
    lines = of_lines.select(*line("line_ledger", "total revenue", money(F.col("v")), fiscal))
    volumes = of_lines.select(*line("volume_ledger", "shipments", F.format_number(F.round("n").cast("bigint"), 0), fiscal))
    noise = nation.withColumn("y", F.lit(1995)).select(*line("noise_ledger", "increased", F.col("n_nationkey").cast("string"), fiscal))
    rows = yearly.unionByName(quarterly).unionByName(lines).unionByName(volumes).unionByName(noise)
    name, nk = F.col("n_name"), F.col("n_nationkey")
    scope = F.when((F.col("document_id") == "orders_ledger") & (nk % 3 == 0), "consolidated").when((F.col("document_id") == "line_ledger") & (nk % 6 == 0), "standalone")
    rows = rows.withColumn("evidence_quote", F.concat(name, F.lit(" reported "), F.col("predicate"), F.lit(" of "), F.col("value"), F.lit(" in "), F.col("period"), F.lit(".")))
    page = (
        F.when(nk % 4 < 2, F.concat(F.lit("Annual note. "), F.col("evidence_quote"), F.lit(" All figures are audited.")))
        .when(nk % 8 == 2, F.concat(F.lit("In "), F.col("period"), F.lit(" came "), F.col("value"), F.lit(" of "), F.col("predicate"), F.lit(", as "), name, F.lit(" posted.")))
        .when(nk % 8 == 6, F.concat(F.when(F.col("document_id") == "volume_ledger", "In ").otherwise("During "), F.col("period"), F.lit(" came "), F.col("value"), F.lit(", near "), F.col("predicate"), F.lit(", as "), name, F.lit(" posted.")))
        .otherwise(F.concat(F.lit("No figures were published for "), name, F.lit(".")))
    )
    month = F.element_at(F.create_map(*[F.lit(x) for pair in LEDGERS for x in pair]), F.col("document_id"))
    created = F.concat(F.lit("2024-"), month, F.lit("-"), _two(nk + 1), F.lit("T00:"), _two((F.col("y") + 24) % 100), F.lit(":"), _two(F.col("q")), F.lit("+00:00"))
    none = F.lit(None).cast("string")
    return rows.select(
        F.sha2(F.concat_ws("\u0001", "document_id", nk.cast("string"), "period", "n_name", "predicate", "value"), 256).alias("id"), "document_id", F.concat("document_id", F.lit(".pdf")).alias("filename"),
        (nk + 1).cast("int").alias("page_number"), name.alias("subject"), "predicate", "value", F.lit("financial_metric").alias("fact_type"), "period", scope.alias("scope"), none.alias("unit"), none.alias("currency"),
        "evidence_quote", page.alias("page_text"), created.alias("created_at"),
    )


def build_facts(raw: DataFrame, held: list[DataFrame] | None = None) -> DataFrame:
    """Gates, grounding, confidence and normalisation of raw facts; rejected ones are kept as they came."""
    judged = hold(judge(raw), held)  # both branches read it
    accepted = normalize_fact(ground(judged.filter("status = 'ACCEPTED'"))).drop("matched_snippet")
    accepted = accepted.withColumn("confidence", fact_confidence(F.col("grounding_score"), F.col("quality_score")))
    rejected = judged.filter("status = 'REJECTED'").withColumns(
        {"grounding_status": F.lit("UNVERIFIED"), "grounding_score": F.lit(0.0), "confidence": F.lit(0.1), "normalized_evidence": F.lit(None).cast("string"), "normalized_value": F.lit(None).cast("double"), "normalized_unit": F.lit(None).cast("string")}
    )
    return accepted.unionByName(rejected)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledgers' facts, judged, grounded at all levels and normalised."""
    # every query below reads them several times over; what is lost with an executor is computed again
    return build_facts(raw_ledger(spark, sf_dir).persist()).persist()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledgers as documents, and one that failed."""
    n = {t: table(spark, sf_dir, t).agg(F.count("*").alias("file_size")) for t in ("orders", "lineitem", "nation", "region")}
    sources = {"orders_ledger": "orders", "line_ledger": "lineitem", "quarter_ledger": "orders", "volume_ledger": "lineitem", "noise_ledger": "nation", "failed_ledger": "region"}
    months = dict(LEDGERS) | {"failed_ledger": "06"}
    out = None
    for doc, source in sources.items():
        failed = doc == "failed_ledger"
        at = f"2024-{months[doc]}-01T00:00:00+00:00"
        row = n[source].select(
            F.lit(doc).alias("id"), F.lit(f"{doc}.pdf").alias("filename"), F.sha2(F.lit(source), 256).alias("file_hash"), "file_size", F.lit("FAILED" if failed else "COMPLETED").alias("status"),
            F.lit("unreadable file" if failed else None).cast("string").alias("error_message"), F.lit(at).alias("created_at"), F.lit(at).alias("updated_at"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidate_pairs(facts(spark, sf_dir).filter("status = 'ACCEPTED'").drop("page_text")).persist()


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(pairs(spark, sf_dir)).filter("type != 'UNRELATED'")


def fact_clusters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = facts(spark, sf_dir).filter("status = 'ACCEPTED'")
    return clusters(own), cluster_members(own)


def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of one run for each document, and of an earlier one."""
    f = facts(spark, sf_dir)
    per = f.groupBy("document_id").agg(
        F.count_distinct("page_number").alias("total_pages"), F.count("*").alias("raw_facts"), F.count_if(F.col("status") == "ACCEPTED").alias("accepted_facts"),
        F.count_if(F.col("status") == "REJECTED").alias("rejected_facts"), F.count_if(F.col("grounding_status") == "VERIFIED").alias("grounded_facts"), F.max("created_at").alias("created_at"),
    )
    runs = per.withColumn("run", F.explode(F.array(F.lit(1), F.lit(2))))
    at = F.when(F.col("run") == 1, F.concat(F.lit("2023"), F.substring("created_at", 5, 100))).otherwise(F.col("created_at"))
    return runs.withColumns({"created_at": at, "id": F.concat_ws("#", "document_id", F.col("run").cast("string"))})

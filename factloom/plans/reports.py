"""A report page for each order: text that all extraction rules read, told from the columns of the business tables.

A page holds a financial or macro sentence, an operational volume, a technical specification and a call-out block; which form
each takes hangs on the order's key. So the facts that extraction must find are known from the same columns, in SQL as well, and
their number grows with the orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.plans.sql import quality, reason, value_columns
from factloom.session import once, table

_K = "o_orderkey"

#: One form a key's remainder: the sentence, with the columns of `orders_of` in braces.
FINANCIAL = [
    "{c_name} reported revenue of ${amount} in {fy}.",
    "{c_name} recorded net profit of ₹{amount} crore for {fy} on a consolidated basis.",
    "Revenue for {fy} stood at ${amount} million.",
    "{n_name} retail inflation was {rate}% in {fy}.",
]
VOLUMES = ["{n_name} handled parcel volume of {quantity} thousand in {fy}.", "Our nwc days reached {quantity} days in {fy}."]
DEVICES = ["The Model {key} features a water tank capacity of {rate} liters.", "Model {key} operates with a pump pressure of {quantity} bar.", "Power consumption is rated at {quantity} watts."]
CALLOUTS = ["{rate}%\nShare of goods returned in India", "{quantity} Mn\nGoods ordered by Infosys", "${amount}\nOrders still open", ">{quantity} days\nTime from order to door", "₹{amount} Cr\nReceipts owed to the RBI"]


def orders_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders with what their reports tell."""
    nation, customer, orders, items = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders", "lineitem"))
    home = customer.join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey).select("c_custkey", "c_name", F.translate("n_name", "_", " ").alias("n_name"))
    sold = items.groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("decimal(12,2)")).cast("bigint").alias("q"))
    rows = orders.join(home, orders.o_custkey == home.c_custkey).join(sold, orders.o_orderkey == sold.l_orderkey, "left")
    k = F.col(_K)
    return rows.select(
        _K, k.cast("string").alias("key"), "c_name", "n_name", F.format_number(F.floor("o_totalprice"), 0).alias("amount"), F.format_number(F.coalesce("q", F.lit(0)) + 100, 0).alias("quantity"),
        F.concat_ws(".", (k % 9 + 1).cast("string"), (k % 7 + 1).cast("string")).alias("rate"), F.concat(F.lit("FY"), F.lpad(((F.year("o_orderdate") + 26) % 100).cast("string"), 2, "0")).alias("fy"),
    )


def _filled(form: str) -> Column:
    parts = form.replace("}", "{").split("{")
    return F.concat(*[F.col(p) if i % 2 else F.lit(p) for i, p in enumerate(parts) if p])


def _chosen(forms: list[str]) -> Column:
    out = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        out = F.when(F.col(_K) % len(forms) == i, _filled(form)).otherwise(out)
    return out


def report_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, page_number, text), one page an order."""
    text = F.concat(F.concat_ws(" ", _chosen(FINANCIAL), _chosen(VOLUMES), _chosen(DEVICES)), F.lit("\n\n"), _chosen(CALLOUTS))
    told = once(orders_of(spark, sf_dir), "text", text)  # else each test of a text by the rules would put it together again
    return told.select(F.col("key").alias("document_id"), F.lit(1).alias("page_number"), "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "document_id")  # the patterns cost more than the shuffle; a small scan would be one task, and so would small partitions put together


def report_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, reply): what a model might answer to each report, by the order's key: a fact in a fenced block, a metric in
    the subject's place without a quote, no JSON, no facts, and no answer."""
    plain = F.struct(F.col("c_name").alias("subject"), F.lit("Revenue").alias("predicate"), _filled("${amount}").alias("value"), F.lit("financial_metric").alias("fact_type"), F.col("fy").alias("period"), _chosen(FINANCIAL).alias("evidence_quote"))
    turned = F.struct(F.lit("EBITDA").alias("subject"), F.lit("Value").alias("predicate"), F.col("quantity").alias("value"), F.lit("figure").alias("fact_type"), F.lit("n/a").alias("period"), F.lit("").alias("evidence_quote"))
    said = lambda fact: F.to_json(F.struct(F.array(fact).alias("facts")))
    k = F.col(_K) % 5
    reply = F.when(k == 0, F.concat(F.lit("```json\n"), said(plain), F.lit("\n```"))).when(k == 1, said(turned)).when(k == 2, "I found no facts {").when(k == 3, '{"facts": []}')
    return orders_of(spark, sf_dir).select(F.col("key").alias("document_id"), reply.alias("reply"))


# --- the same in SQL: what must be found ----------------------------------------------------------------------------------


def _sql_filled(form: str) -> str:
    parts = form.replace("}", "{").split("{")
    return "(" + " || ".join(p if i % 2 else "'" + p.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for i, p in enumerate(parts) if p) + ")"


def _sql_chosen(forms: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN {_K} % {len(forms)} = {i} THEN {_sql_filled(f)}" for i, f in enumerate(forms)) + " END"


def _pick(n: int, *values: str) -> str:
    return "CASE " + " ".join(f"WHEN {_K} % {n} = {i} THEN {v}" for i, v in enumerate(values)) + " END"


REPORTS_SQL = f"""
orders_of AS (
  SELECT {_K}, CAST({_K} AS VARCHAR) AS key, c_name, replace(n_name, '_', ' ') AS n_name, format('{{:,}}', CAST(floor(o_totalprice) AS BIGINT)) AS amount,
         format('{{:,}}', CAST(trunc(coalesce(q, 0)) AS BIGINT) + 100) AS quantity, CAST({_K} % 9 + 1 AS VARCHAR) || '.' || CAST({_K} % 7 + 1 AS VARCHAR) AS rate,
         'FY' || lpad(CAST((year(o_orderdate) + 26) % 100 AS VARCHAR), 2, '0') AS fy
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT l_orderkey, sum(l_quantity::DECIMAL(12,2)) AS q FROM lineitem GROUP BY l_orderkey) ON l_orderkey = {_K}
),
told AS (SELECT *, {_sql_chosen(FINANCIAL)} AS s0, {_sql_chosen(VOLUMES)} AS s1, {_sql_chosen(DEVICES)} AS s2, {_sql_chosen(CALLOUTS)} AS block FROM orders_of),
reports AS (SELECT *, s0 || ' ' || s1 || ' ' || s2 || chr(10) || chr(10) || block AS page_text FROM told),
named AS (SELECT *, {_pick(5, "'India'", "'Infosys'", "'Company'", "'Company'", "'RBI'")} AS about FROM reports),
found AS (
  SELECT key AS document_id, page_text, 0 AS ordinal, {_pick(4, "c_name", "c_name", "about", "n_name")} AS subject, {_pick(4, "'revenue'", "'net profit'", "'revenue'", "'retail inflation'")} AS predicate,
         {_pick(4, "'$' || amount", "'₹' || amount || ' crore'", "'$' || amount || ' million'", "rate || '%'")} AS value, {_pick(4, *["'financial_metric'"] * 3, "'percentage'")} AS fact_type, fy AS period,
         {_pick(4, "NULL", "'consolidated'", "NULL", "NULL")} AS scope, {_pick(4, "NULL", "'crore'", "'million'", "'%'")} AS unit, {_pick(4, "'USD'", "'INR'", "'USD'", "NULL")} AS currency, s0 AS evidence_quote FROM named
  UNION ALL
  SELECT key, page_text, 1, {_pick(2, "n_name", "about")}, {_pick(2, "'parcel volume'", "'nwc days'")}, {_pick(2, "quantity || ' thousand'", "quantity || ' days'")}, 'numerical_metric', fy, NULL, {_pick(2, "NULL", "'days'")}, NULL, s1 FROM named
  UNION ALL
  SELECT key, page_text, 2, {_pick(3, "'Model ' || key", "'Model ' || key", "CASE about WHEN 'Company' THEN 'Appliance' ELSE about END")}, {_pick(3, "'water tank capacity'", "'pump pressure'", "'power consumption'")},
         {_pick(3, "rate || ' liters'", "quantity || ' bar'", "quantity || ' watts'")}, 'numerical_metric', NULL, 'device_specification', {_pick(3, "'liters'", "'bar'", "'watts'")}, NULL, s2 FROM named
  UNION ALL
  SELECT key, page_text, 1000000, about, lower(split_part(block, chr(10), 2)), split_part(block, chr(10), 1), {_pick(5, "'percentage'", *["'numerical_metric'"] * 4)},
         CASE fy WHEN 'FY24' THEN 'FY2024' WHEN 'FY23' THEN 'FY2023' END, NULL, NULL, {_pick(5, "NULL", "NULL", "'USD'", "NULL", "'INR'")}, replace(block, chr(10), ' ') FROM named
)"""

#: The found facts judged, grounded (each quote stands in its page) and normalised.
INGESTED_SQL = f"""
scored AS (SELECT *, {quality("subject", "predicate", "value", "evidence_quote", "period", "(coalesce(unit, currency) IS NOT NULL)")} AS quality_score FROM found),
judged AS (SELECT *, {reason("subject", "predicate", "value", "evidence_quote", "quality_score", "page_text")} AS rejection_reason FROM scored),
valued AS (SELECT *, {value_columns("value")} FROM judged)"""

#: The replies' facts, of the form that the cleaning gives them, before the rules' others.
REPLIES_SQL = r"""
replied AS (
  SELECT key AS document_id, c_name AS subject, 'Revenue' AS predicate, '$' || amount AS value, 'financial_metric' AS fact_type, fy AS period, s0 AS evidence_quote FROM reports WHERE o_orderkey % 5 = 0
  UNION ALL
  SELECT key, 'Infosys', 'EBITDA', quantity, 'numerical_metric', NULL,
         regexp_replace(coalesce(nullif(regexp_extract(page_text, '[^.?!]*?' || regexp_escape(quantity[:10]) || '[^.?!]*?[.?!]'), ''), page_text[:200]), '^\s+|\s+$', '', 'g') FROM reports WHERE o_orderkey % 5 = 1
),
merged AS (
  SELECT *, TRUE AS from_model FROM replied
  UNION ALL
  SELECT f.document_id, f.subject, f.predicate, f.value, f.fact_type, f.period, f.evidence_quote, FALSE FROM found f
  ANTI JOIN replied r ON f.document_id = r.document_id AND lower(f.subject) = lower(r.subject) AND lower(f.predicate) = lower(r.predicate) AND lower(f.value) = lower(r.value)
)"""

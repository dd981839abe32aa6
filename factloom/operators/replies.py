"""Facts and opinions out of a column of model replies (JSON text, perhaps fenced): no client, the replies are given.

A reply that is null was not asked for; one that is no JSON object, or whose `facts` are null, failed: both leave the rules' facts
as they are. Items of `facts` that are no objects count for nothing. A field that is null, false, 0 or empty is taken as empty;
numbers are taken as they are written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import vocab as V
from factloom.functions.text import some
from factloom.operators.extract import extract_facts, first_wins, loose, titled
from factloom.operators.relate import blend_model
from factloom.session import once

_SPACE = r"(?U)^\s+|\s+$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _SPACE, "")


def unfenced(reply: Column) -> Column:
    """The reply without the code fence around it."""
    return strip(F.regexp_replace(strip(reply), r"\A```(?:json)?|```\z", ""))


def worth_asking(text: Column) -> Column:
    """Whether a chunk has enough text for a model: 15 words, and no table of contents."""
    words, count = F.size(F.array_remove(F.split(text, r"(?U)\s+"), "")), lambda x: F.size(F.split(text, x)) - 1
    return (words >= 15) & ~((count(r"\.\.\.") > 8) | ((count(r"\.") > 30) & (words < 70)))


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit(kind)), F.lit(False))


def _field(item: Column, name: str) -> Column:
    """A field's text; empty where it is null, false, zero or absent."""
    value = F.try_variant_get(item, f"$.{name}", "variant")
    text = F.when(_is(value, "BOOLEAN"), F.when(value.cast("boolean"), "True")).when(_is(value, "STRING"), value.cast("string"))
    return F.coalesce(text.when(F.coalesce(value.try_cast("double") == 0, F.lit(False)), None).otherwise(value.try_cast("string")), F.lit(""))


def parsed(reply: Column) -> Column:
    """The reply as a variant; null where it failed."""
    found = F.try_parse_json(unfenced(reply))
    empty = F.contains(F.regexp_replace(unfenced(reply), r"\s", ""), F.lit('"facts":null'))
    return F.when(_is(found, "OBJECT") & ~(empty & F.try_variant_get(found, "$.facts", "variant").isNull()), found)


def reply_facts(chunks: DataFrame, reply: str = "reply") -> DataFrame:
    """The facts that the replies to chunks state, cleaned: those without subject, predicate or value go; a metric that stands
    as the subject of a `value` becomes the predicate; short quotes become the sentence around the value."""
    items = F.coalesce(F.try_variant_get(parsed(F.col(reply)), "$.facts", "array<variant>"), F.array().cast("array<variant>"))
    rows = chunks.select("document_id", "page_number", "chunk_id", "text", F.posexplode(items).alias("ordinal", "_i"))
    names = ["subject", "predicate", "value", "fact_type", "period", "scope", "unit", "currency", "evidence_quote"]
    is_object = _is(F.col("_i"), "OBJECT")
    rows = rows.filter(is_object).select("*", *[strip(_field(F.col("_i"), n)).alias(n) for n in names])
    rows = rows.filter("subject != '' and predicate != '' and value != ''")
    turned = F.lower("predicate").isin(V.REPLY_VALUE_WORDS) & F.lower("subject").isin(V.REPLY_METRICS)
    entity = some(F.regexp_extract("text", rf"(?i)\b({loose(V.REPLY_SUBJECTS, ' ')})\b", 1))
    # the sentence around the first characters of the value, which may hold a point themselves
    around = F.concat(F.lit(r"[^.?!]*?\Q"), F.replace(F.substring("value", 1, 10), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E[^.?!]*?[.?!]"))
    quote = F.coalesce(strip(F.regexp_substr(F.col("text"), around)), strip(F.substring("text", 1, 200)))
    stated = lambda name, none: F.when(~F.lower(name).isin("", *none), F.col(name))
    kind = F.when(F.col("fact_type") == "", "other").when(F.col("fact_type").isin(V.FACT_TYPES), F.col("fact_type")).when(F.col("value").rlike(r"(?U)\d"), "numerical_metric").otherwise("semantic_claim")
    none = ["none", "null", "n/a"]
    qualifiers = F.coalesce(F.try_variant_get("_i", "$.qualifiers", "map<string,string>"), F.create_map().cast("map<string,string>"))
    return rows.select(
        "document_id", "page_number", "chunk_id", "ordinal", F.when(turned, F.coalesce(titled(entity, V.REPLY_SUBJECTS), F.lit("Company"))).otherwise(F.col("subject")).alias("subject"),
        F.when(turned, F.col("subject")).otherwise(F.col("predicate")).alias("predicate"), "value", kind.alias("fact_type"), stated("period", [*none, "unspecified"]).alias("period"),
        stated("scope", [*none, "unspecified"]).alias("scope"), stated("unit", none).alias("unit"), stated("currency", none).alias("currency"), qualifiers.alias("qualifiers"),
        F.when(F.length("evidence_quote") < 15, quote).otherwise(F.col("evidence_quote")).alias("evidence_quote"),
    )


def merged_facts(chunks: DataFrame, reply: str = "reply") -> DataFrame:
    """Facts of replies and of the rules, with `from_model`. Where a reply can be read, of equal subject, predicate and value the
    reply's stays, else the rules' first; other chunks have all that the rules find."""
    flagged = once(chunks, "_readable", parsed(F.col(reply)).isNotNull())
    rules = extract_facts(flagged.drop(reply), ("_readable",)).withColumn("_rank", F.lit(1))
    told = reply_facts(chunks, reply).withColumns({"_rank": F.lit(0), "_readable": F.lit(True)})
    # one pass over all facts: the rules' are not worked out again for the chunks whose replies cannot be read
    return first_wins(rules.unionByName(told), "_rank", F.col("_readable")).withColumn("from_model", F.col("_rank") == 0).drop("_rank", "_readable")


def with_opinions(related: DataFrame, reply: str = "reply") -> DataFrame:
    """Rule results with a model's opinion joined in. Unreadable replies, and pairs that the rules call unrelated, change nothing."""
    opinion = F.try_parse_json(unfenced(F.col(reply)))
    opinion = F.when(_is(opinion, "OBJECT") & (F.col("type") != "UNRELATED"), opinion)
    kind = F.upper(_field(F.col("_o"), "relationship_type"))
    sure = F.coalesce(F.try_variant_get("_o", "$.confidence", "double"), F.lit(0.85))
    asked = F.col("_o").isNotNull()
    rows = related.withColumn("_o", opinion).withColumns({"model_type": F.when(asked, F.when(kind.isin(V.RELATION_TYPES), kind).otherwise(F.col("type"))), "model_confidence": F.when(asked, sure)})
    why = some(_field(F.col("_o"), "reasoning"))
    unrelated = F.col("model_type") == "UNRELATED"
    reasoning = F.when(asked & unrelated, F.coalesce(why, F.lit("The facts do not describe the same underlying claim or measurement context."))).otherwise(F.coalesce(why, F.col("reasoning")))
    return blend_model(rows.withColumn("reasoning", reasoning)).drop("_o", "model_type", "model_confidence")

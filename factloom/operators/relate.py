"""Classify candidate pairs as corroborating, contradicting, reconcilable or unrelated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import vocab as V
from factloom.functions.quality import one_of


def canonical_key(a: Column, b: Column) -> Column:
    return F.concat_ws("__", F.least(a, b), F.greatest(a, b))


def differ(a: Column, b: Column) -> Column:
    """Both known and not equal."""
    return F.coalesce(a != b, F.lit(False))


def values_match() -> Column:
    """Numbers within 1.5 % of the first one and no differing units; without numbers, equal text that is not filler."""
    a, b = F.col("a_normalized_value"), F.col("b_normalized_value")
    units = differ(F.col("a_normalized_unit"), F.col("b_normalized_unit"))
    text_a, text_b = F.lower(F.trim("a_value")), F.lower(F.trim("b_value"))
    # F.when keeps the division from being evaluated at zero
    close = F.when(a == 0, b == 0).otherwise((F.abs(a - b) / F.when(a != 0, F.abs(a)) < V.TOLERANCE) & ~units)
    return F.coalesce(F.when(a.isNotNull() & b.isNotNull(), close).otherwise((text_a == text_b) & ~one_of(text_a, V.GENERIC_WORDS)), F.lit(False))


def base_confidence(stored_quality: str = "default") -> Column:
    quality = lambda s: F.lit(0.85) if stored_quality == "default" else F.coalesce(f"{s}_quality_score", F.lit(0.85))
    grounding = lambda s: F.coalesce(f"{s}_grounding_score", F.lit(0.9))
    return F.least(F.lit(0.98), F.greatest(F.lit(0.5), F.sqrt(quality("a") * quality("b") * grounding("a") * grounding("b"))))


def classify(pairs: DataFrame, stored_quality: str = "default") -> DataFrame:
    """pairs with type, reasoning, confidence, comparison_context (a map) and canonical_key."""
    c = F.col
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    shown = lambda x: F.coalesce(x, F.lit("None"))
    doc_a, doc_b = F.coalesce("a_filename", F.lit("Document A")), F.coalesce("b_filename", F.lit("Document B"))
    subject, pred_a, pred_b = F.trim("a_subject"), F.lower(F.trim("a_predicate")), F.lower(F.trim("b_predicate"))
    val_a, val_b = F.trim("a_value"), F.trim("b_value")
    stated = lambda p: F.coalesce(p, F.lit("")) != ""
    period, scope, unit = (differ(c(f"a_{k}"), c(f"b_{k}")) for k in ("period", "scope", "normalized_unit"))
    same_period = F.coalesce(c("a_period") == c("b_period"), F.lit(False))
    no_period = ~stated(c("a_period")) & ~stated(c("b_period"))
    generic = one_of(pred_a, V.VERB_PREDICATES) | one_of(pred_b, V.VERB_PREDICATES) | one_of(F.lower(val_a), V.GENERIC_WORDS) | one_of(F.lower(val_b), V.GENERIC_WORDS)
    quarterly = F.contains(F.lower("a_period"), F.lit("q")) != F.contains(F.lower("b_period"), F.lit("q"))
    base, match = c("_base"), c("_match")

    def outcome(kind: str, confidence: Column, reasoning: Column, **context: Column) -> Column:
        entries = F.map_from_arrays(F.array(*map(F.lit, context)), F.array(*[v.cast("string") for v in context.values()])) if context else F.create_map().cast("map<string,string>")
        return F.struct(F.lit(kind).alias("type"), reasoning.alias("reasoning"), F.round(confidence, 3).alias("confidence"), entries.alias("context"))

    for_period = F.when(stated(c("a_period")), text(" for ", c("a_period"))).otherwise("")
    in_scope = F.when(stated(c("a_scope")), text(" (", c("a_scope"), ")")).otherwise("")
    result = (
        F.when(generic, outcome("UNRELATED", F.lit(0.2), F.lit("Facts contain generic action verbs or non-metric attributes and cannot be compared.")))
        .when(c("pred_score") < V.LEAST_PREDICATE, outcome("UNRELATED", F.lit(0.3), text("Metrics '", pred_a, "' and '", pred_b, "' represent distinct, incompatible categories.")))
        .when(c("subj_score") < V.LEAST_SUBJECT, outcome("UNRELATED", F.lit(0.3), text("Entities '", subject, "' and '", F.trim("b_subject"), "' do not refer to the same organization or subject.")))
        .when(
            match & ~period & ~scope & ~unit,
            outcome(
                "CORROBORATE", base * 0.98, text("Both documents (", doc_a, " and ", doc_b, ") independently corroborate ", subject, "'s ", pred_a, " of ", val_a, for_period, in_scope, "."),
                matching_metric=pred_a, matching_value=F.coalesce(c("a_normalized_value").cast("string"), val_a), period=c("a_period"), scope=c("a_scope"),
            ),
        )
        .when(
            period,
            outcome(
                "RECONCILE", base * 0.94,
                F.when(quarterly, text("Apparent contradiction reconciled: '", doc_a, "' reports for quarterly period ", c("a_period"), " (", val_a, ") while '", doc_b, "' reports for full-year ", c("b_period"), " (", val_b, ")."))
                .otherwise(text("Apparent numerical variance reconciled: reported values represent different fiscal time horizons (", c("a_period"), " with ", val_a, " vs ", c("b_period"), " with ", val_b, ").")),
                reconciling_factor=F.lit("temporal_difference"), period_a=c("a_period"), period_b=c("b_period"),
            ),
        )
        .when(
            scope,
            outcome(
                "RECONCILE", base * 0.92, text("Reported values for ", pred_a, " differ due to reporting scope: '", doc_a, "' reports ", c("a_scope"), " (", val_a, ") whereas '", doc_b, "' reports ", c("b_scope"), " (", val_b, ")."),
                reconciling_factor=F.lit("scope_difference"), scope_a=c("a_scope"), scope_b=c("b_scope"),
            ),
        )
        .when(
            unit,
            outcome(
                "RECONCILE", base * 0.90, text("Both documents measure ", pred_a, ", but report in different unit/currency scales (", F.coalesce("a_normalized_unit", val_a), " vs ", F.coalesce("b_normalized_unit", val_b), ")."),
                reconciling_factor=F.lit("unit_difference"), unit_a=c("a_normalized_unit"), unit_b=c("b_normalized_unit"),
            ),
        )
        .when(
            ~match & (same_period | no_period) & (c("pred_score") >= 0.85),
            outcome(
                "CONTRADICT", base * 0.92,
                text(
                    "Direct contradiction detected for ", subject, " - ", pred_a, " ", F.when(stated(c("a_period")), text("for ", c("a_period"))).otherwise("for the same timeframe"), ": '", doc_a, "' reports ", val_a,
                    " whereas '", doc_b, "' reports ", val_b, ". With matching reporting periods and scopes, these figures represent genuinely conflicting claims.",
                ),
                conflict=F.lit("true"), value_a=val_a, value_b=val_b, period=c("a_period"),
            ),
        )
        .otherwise(outcome("UNRELATED", F.lit(0.4), text("The facts do not describe comparable claims (", pred_a, " vs ", pred_b, ").")))
    )
    rows = pairs.withColumns({"_base": base_confidence(stored_quality), "_match": values_match()}).withColumn("_r", result)
    out = rows.withColumns({"type": c("_r.type"), "reasoning": c("_r.reasoning"), "confidence": c("_r.confidence"), "comparison_context": c("_r.context"), "canonical_key": canonical_key(c("a_id"), c("b_id"))})
    return out.withColumn("id", F.sha2("canonical_key", 256)).withColumn("created_at", F.greatest("a_created_at", "b_created_at")).drop("_base", "_match", "_r")


def relationships(facts: DataFrame, stored_quality: str = "default") -> DataFrame:
    """All related pairs of accepted facts; unrelated ones are not kept."""
    from factloom.operators.match import candidate_pairs

    return classify(candidate_pairs(facts.filter("status = 'ACCEPTED'")), stored_quality).filter("type != 'UNRELATED'")


def upsert(stored: DataFrame, new: DataFrame, key: str = "canonical_key") -> DataFrame:
    """stored and new rows, of each key the last written: new before stored, then the later created_at, then id."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = Window.partitionBy(key).orderBy(F.desc("_new"), F.desc("created_at"), F.desc("id"))
    return both.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_new", "_n")


def blend_model(rule: DataFrame) -> DataFrame:
    """Join a model's opinion (model_type, model_confidence, null: none asked) into rule results."""
    asked = F.col("model_type").isNotNull() & (F.col("type") != "UNRELATED")
    mixed = F.round(F.least(F.lit(0.98), F.greatest(F.lit(0.4), F.col("model_confidence") * 0.4 + F.col("confidence") * 0.6)), 3)
    confidence = F.when(asked & (F.col("model_type") == "UNRELATED"), 0.5).when(asked, mixed).otherwise(F.col("confidence"))
    return rule.withColumns({"confidence": confidence, "type": F.when(asked, F.col("model_type")).otherwise(F.col("type"))})

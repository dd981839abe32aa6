"""Rule gates for raw facts: lone numbers, quality score and the reason for which a fact is rejected."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import vocab as V
from factloom.functions.text import squeeze, stands_in

FISCAL_HEADER = r"(?i)^(?:(?:FY|CY|Q[1-4])\s*\d{2,4}[\s,/–-]*)+$"


def meaningless_number(text: Column) -> Column:
    return F.trim(text).rlike("(?i)^(?:" + "|".join(V.LONE_NUMBERS) + ")$")


def one_of(text: Column, words: list[str]) -> Column:
    """Membership in a word list, as one pattern: a long IN list is a node per word in every plan that holds it."""
    return text.rlike("^(?:" + "|".join(map(re.escape, words)) + ")\\z")


def contains_any(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(words))


def clean(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def starts_lower(text: Column) -> Column:
    return text.rlike(r"^\p{Ll}")


def fact_quality(subject: Column, predicate: Column, value: Column, evidence: Column, period: Column, unit: Column, currency: Column) -> Column:
    """0.30 subject + 0.30 predicate + 0.20 value + 0.10 context + 0.10 evidence, rounded to 3."""
    subject, predicate, value, evidence = map(clean, (subject, predicate, value, evidence))
    stated = lambda c: F.coalesce(c, F.lit("")) != ""
    measured = stated(unit) | stated(currency)
    of_subject = (
        F.when((subject == "") | one_of(F.lower(subject), V.GENERIC_WORDS) | starts_lower(subject), 0.0)
        .when(subject.rlike(r"^\p{Lu}") & (F.length(subject) >= 3), F.when(contains_any(F.lower(subject), V.ENTITY_TERMS), 1.0).otherwise(0.85))
        .otherwise(0.5)
    )
    of_predicate = (
        F.when(contains_any(F.lower(predicate), V.METRIC_KEYWORDS), 1.0).when(one_of(F.lower(predicate), V.VERB_PREDICATES), 0.0).when(F.length(predicate) >= 4, 0.7).otherwise(0.5)
    )
    of_value = (
        F.when(value.rlike(r"\d"), F.when(measured | value.rlike("[₹$€£%]"), 1.0).when((F.length(value) > 1) & ~meaningless_number(value), 0.75).otherwise(0.2))
        .when(one_of(F.lower(value), V.GENERIC_WORDS), 0.0)
        .otherwise(0.6)
    )
    of_context = F.lit(0.5) + F.when(stated(period), 0.3).otherwise(0.0) + F.when(measured, 0.2).otherwise(0.0)
    of_evidence = F.when(F.length(evidence) >= 40, 1.0).when(F.length(evidence) >= 25, 0.8).otherwise(0.3)
    return F.round(of_subject * 0.3 + of_predicate * 0.3 + of_value * 0.2 + of_context * 0.1 + of_evidence * 0.1, 3)


def accepted_subject(subject: Column) -> Column:
    """The subject as it is kept: a few names written in lower case, and e-/i- names, get a capital."""
    s = clean(subject)
    known = one_of(F.lower(s), V.LOWER_CASE_NAMES) | s.rlike("^(?:e-|i-)")
    return F.when(starts_lower(s) & known, F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, F.lit(2), F.length(s)))).otherwise(s)


def rejection_reason(raw: Column, subject: Column, predicate: Column, value: Column, evidence: Column, quality: Column, page: Column) -> Column:
    """The first gate that a fact fails, in words; null if it passes all. `subject` is the one that would be kept, and
    `quality` the score with it; all texts trimmed, none null."""
    low, named, amount = F.lower(subject), F.lower(predicate), F.lower(value)
    says = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    # the order of the list decides which ending is named
    ending = F.coalesce(*[F.when(F.endswith(low, F.lit(" " + e)), F.lit(e)) for e in V.FRAGMENT_ENDINGS], F.lit(""))
    opening = F.coalesce(*[F.when(F.startswith(low, F.lit(p)), F.lit(p.strip())) for p in V.FRAGMENT_PREFIXES], F.lit(""))
    gates = [
        (raw == "", F.lit("Missing subject / entity")),
        (F.length(raw) < 2, says("Subject is too short or ambiguous: '", raw, "'")),
        (predicate == "", F.lit("Missing predicate / metric")),
        (F.length(predicate) < 2, says("Predicate is too short or ambiguous: '", predicate, "'")),
        (value == "", F.lit("Missing fact value")),
        (meaningless_number(value), says("Meaningless number: value '", value, "' is an isolated digit or footnote marker without an associated metric")),
        (evidence == "", F.lit("Missing evidence quote")),
        (F.length(evidence) < 15, says("Evidence quote is too brief to substantiate a claim: '", evidence, "'")),
        (one_of(F.lower(raw), V.GENERIC_WORDS), says("Subject '", raw, "' is a generic verb, pronoun, or preposition, not an entity")),
        (starts_lower(subject), says("Subject '", raw, "' starts with a lowercase letter, indicating an arbitrary sentence fragment")),
        (ending != "", says("Subject '", subject, "' ends with dangling connector '", ending, "', indicating a broken fragment")),
        (opening != "", says("Subject '", subject, "' begins with clause connector '", opening, "', indicating a broken fragment")),
        (subject.rlike(r"(?U)^[0-9\W_]+$"), says("Subject '", subject, "' contains no valid entity characters")),
        (one_of(named, V.VERB_PREDICATES + V.GENERIC_WORDS), says("Predicate '", predicate, "' is a generic verb or word without an associated metric name")),
        (one_of(named, V.PUNCTUATION_PREDICATES), says("Predicate '", predicate, "' is a punctuation artifact")),
        (predicate.rlike(r"^\d+$") | predicate.rlike(FISCAL_HEADER), says("Predicate '", predicate, "' is purely a number or period, not a metric")),
        (one_of(amount, V.GENERIC_WORDS + V.VERB_PREDICATES), says("Value '", value, "' is a generic action word rather than a metric quantity or state")),
        (amount.isin([";", ":"]), says("Value '", value, "' is purely punctuation")),
        (low == named, says("Subject and predicate are identical ('", subject, "'), which does not form a meaningful claim")),
        ((named == amount) & ~named.isin(["true", "false", "yes", "no"]), says("Predicate and value are identical ('", predicate, "'), indicating a redundant extraction fragment")),
        (quality < V.LEAST_QUALITY, says("Fact quality score ", F.format_string("%.2f", quality), " is below minimum threshold (0.60)")),
        (~F.coalesce(stands_in(evidence, page), F.lit(False)) & (overlap(evidence, page) < V.LEAST_OVERLAP), F.lit("Evidence quote does not sufficiently overlap with source chunk text")),
    ]
    out = F.when(*gates[0])
    for test, reason in gates[1:]:
        out = out.when(test, reason)
    return out


def overlap(evidence: Column, page: Column) -> Column:
    """The share of the evidence's words of more than two letters that the page contains; null if there is nothing to compare."""
    text = squeeze(F.lower(page))
    words = F.regexp_extract_all(squeeze(F.lower(evidence)), F.lit(r"(?U)(\w{3,})"), F.lit(1))
    found = F.size(F.filter(words, lambda w: F.contains(text, w)))
    return F.when((F.coalesce(page, F.lit("")) != "") & (F.size(words) > 0), found / F.size(words))


def judge(raw_facts):
    """raw_facts (with page_text) and quality_score, rejection_reason, status; accepted subjects as they are kept."""
    texts = {f"_{c}": clean(F.col(c)) for c in ("subject", "predicate", "value", "evidence_quote")}
    rows = raw_facts.withColumns(texts | {"_kept": accepted_subject(F.col("subject"))})
    quality = fact_quality(F.col("_kept"), F.col("predicate"), F.col("value"), F.col("evidence_quote"), F.col("period"), F.col("unit"), F.col("currency"))
    reason = rejection_reason(F.col("_subject"), F.col("_kept"), F.col("_predicate"), F.col("_value"), F.col("_evidence_quote"), F.col("quality_score"), F.col("page_text"))
    judged = rows.withColumn("quality_score", quality).withColumn("rejection_reason", reason)
    passed = F.col("rejection_reason").isNull()
    return judged.withColumns({"status": F.when(passed, "ACCEPTED").otherwise("REJECTED"), "subject": F.when(passed, F.col("_kept")).otherwise(F.col("subject"))}).drop(*texts, "_kept")

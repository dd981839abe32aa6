"""Amounts: number, unit and currency of a value as written."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import vocab as V
from factloom.functions.text import some

NUMBER = r"([\d,]+(?:\.\d+)?)"


def first_of(cases: list[tuple[Column, Column]]) -> Column:
    """The value of the first case that holds, else null."""
    out = F.when(*cases[0])
    for test, value in cases[1:]:
        out = out.when(test, value)
    return out


def currency_of(text: Column, given: Column) -> Column:
    signs = [(F.contains(text, F.lit(s)), F.lit(c)) for s, c in V.CURRENCY_SIGNS]
    words = [(text.rlike(rf"\b{w}\b"), F.lit(c)) for w, c in V.CURRENCY_WORDS]
    stated = F.upper(F.trim(given))
    return first_of([*signs, *words, (stated.isin(V.CURRENCIES), stated)])


def normalize_value(value: Column, unit: Column, currency: Column) -> Column:
    """struct(normalized_value, normalized_unit, normalized_currency) of a value, with the unit and currency stated beside it."""
    text, side = F.lower(F.trim(value)), F.lower(F.trim(unit))
    percent = F.contains(text, F.lit("%")) | F.contains(text, F.lit("percent")) | F.contains(text, F.lit("per cent"))
    lettered = text.rlike("[a-z]")  # all names are letters: most amounts need no search for each
    in_text = F.when(lettered, first_of([(text.rlike(rf"(?:\b|(?<=\d)){name}\b"), F.lit(name)) for name, _ in V.MULTIPLIERS]))
    technical = F.when(lettered | unit.isNotNull(), first_of([(text.rlike(rf"\b{re.escape(n)}\b") | F.coalesce(F.lower(unit) == n, F.lit(False)), F.lit(u)) for n, u in V.UNITS]))
    found = F.struct(
        F.replace(some(F.regexp_extract(text, NUMBER, 1)), F.lit(","), F.lit("")).try_cast("double").alias("number"),
        currency_of(text, currency).alias("money"),
        F.coalesce(in_text, F.when(side.isin([n for n, _ in V.MULTIPLIERS]), side)).alias("scale"),
        F.coalesce(technical, F.when(F.lower(unit) == "%", "%")).alias("technical"),
        (percent | F.coalesce(F.contains(unit, F.lit("%")) | F.contains(unit, F.lit("per cent")), F.lit(False))).alias("percent"),
        F.trim(some(unit)).alias("unit"),
        (value.isNull() | (value == "")).alias("empty"),
    )
    factors = F.create_map(*[F.lit(v) for pair in V.MULTIPLIERS for v in pair])
    none, no_number = F.lit(None).cast("string"), F.lit(None).cast("double")
    make = lambda n, u, c: F.struct(n.alias("normalized_value"), u.alias("normalized_unit"), c.alias("normalized_currency"))

    def settle(p: Column) -> Column:
        factor = F.coalesce(F.try_element_at(factors, p["scale"]), F.lit(1.0))
        return (
            F.when(p["empty"], make(no_number, none, none))
            .when(p["percent"] & p["number"].isNotNull(), make(p["number"], F.lit("%"), none))
            .when(p["number"].isNull(), make(no_number, none, p["money"]))
            .otherwise(make(p["number"] * factor, F.coalesce(p["money"], p["technical"], p["scale"], p["unit"]), p["money"]))
        )

    # the parts are worked out once and bound to a name by the one-element transform
    return F.element_at(F.transform(F.array(found), settle), 1)


def normalize_fact(facts):
    """facts with normalized_value, normalized_unit, a currency where none was stated, and the canonical period."""
    from factloom.functions.periods import normalize_period

    parsed = facts.withColumn("_n", normalize_value(F.col("value"), F.col("unit"), F.col("currency")))
    return parsed.withColumns(
        {
            "normalized_value": F.col("_n.normalized_value"),
            "normalized_unit": F.col("_n.normalized_unit"),
            "currency": F.coalesce(some(F.col("currency")), F.col("_n.normalized_currency")),
            "period": F.coalesce(normalize_period(F.col("period")), F.col("period")),
        }
    ).drop("_n")

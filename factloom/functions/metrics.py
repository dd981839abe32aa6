"""Metric families, token sets and similarities of subjects and predicates."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import vocab as V


def core_tokens(text: Column, stop: list[str]) -> Column:
    """Distinct ASCII words of two letters or more, without stop words."""
    return F.array_except(F.regexp_extract_all(F.lower(text), F.lit(r"\b([a-z]{2,})\b"), F.lit(1)), F.array(*map(F.lit, stop)))


def predicate_tokens(text: Column) -> Column:
    return core_tokens(text, V.METRIC_STOP_WORDS)


def subject_tokens(text: Column) -> Column:
    return core_tokens(text, V.ENTITY_STOP_WORDS)


def metric_family(predicate: Column) -> Column:
    """The first family with a member in the predicate; null if there is none."""
    text = F.trim(F.lower(predicate))
    out = None
    for k, (family, members) in enumerate(V.METRIC_FAMILIES):
        names = "|".join(map(re.escape, members))
        test = text.rlike(names if k < 2 else rf"\b(?:{names})\b")
        out = F.when(test, family) if out is None else out.when(test, family)
    return out


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else None for x, y in zip(a.tolist(), b.tolist())], dtype="float64")


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity, which no built-in function has; Arrow batches, only on rows that need it."""
    return F.pandas_udf(_ratios, "double")(a, b)


def modifier_conflict(a: Column, b: Column) -> Column:
    has = lambda tokens, words: F.arrays_overlap(tokens, F.array(*map(F.lit, words)))
    out = F.lit(False)
    for one, other in V.MODIFIER_CONFLICTS:
        out = out | (has(a, one) & has(b, other)) | (has(a, other) & has(b, one))
    return out


#: Characters that are counted one by one for the bound of a string ratio; all others count as one.
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "


def letter_counts(text: Column) -> Column:
    """How often each of LETTERS occurs, and last how many other characters."""
    each = F.transform(F.split(F.lit(LETTERS), ""), lambda c: F.when(c == "", 0).otherwise(F.length(text) - F.length(F.replace(text, c, F.lit("")))))
    return F.concat(each, F.array(F.length(text) - F.aggregate(each, F.lit(0), lambda a, x: a + x)))


def ratio_bound(a: Column, b: Column, counts_a: Column, counts_b: Column) -> Column:
    """No string ratio of a and b is above this: twice the letters that both have, over all."""
    both = F.aggregate(F.zip_with(counts_a, counts_b, lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    return 2.0 * both / (F.length(a) + F.length(b))


def predicate_features(names):
    """Distinct predicates (a column `value`) with what their similarity is worked out from."""
    rows = names.withColumns({"family": metric_family(F.col("value")), "tokens": predicate_tokens(F.col("value"))})
    rows = rows.withColumn("joined", F.array_join(F.array_sort("tokens"), " "))
    return rows.withColumn("letters", letter_counts(F.col("joined")))


def subject_features(names):
    rows = names.withColumns({"low": F.trim(F.lower("value")), "tokens": subject_tokens(F.col("value"))})
    return rows.withColumn("letters", letter_counts(F.col("low")))


def _predicate_rule() -> tuple[Column, Column, Column]:
    """Whether families decide, the score by them, and the share of tokens."""
    both = F.col("a_family").isNotNull() & F.col("b_family").isNotNull()
    shared = F.size(F.array_intersect("a_tokens", "b_tokens"))
    family = F.when(F.col("a_family") != F.col("b_family"), 0.0).when(modifier_conflict(F.col("a_tokens"), F.col("b_tokens")), 0.0).otherwise(1.0)
    return both, family, F.when(shared == 0, 0.0).otherwise(shared / F.size(F.array_union("a_tokens", "b_tokens")))


def predicate_possible(least: float) -> Column:
    """Whether a pair of predicate features (a_*, b_*) can score `least`."""
    both, family, jaccard = _predicate_rule()
    bound = ratio_bound(F.col("a_joined"), F.col("b_joined"), F.col("a_letters"), F.col("b_letters"))
    return F.when(both, family >= least).when(jaccard == 0, F.lit(False)).otherwise((jaccard >= least) | (bound >= least))


def predicate_scores(pairs):
    """pairs of predicate features (a_*, b_*) with score. The string ratio is taken only where neither families nor token
    sets decide."""
    both, family, jaccard = _predicate_rule()
    open_ = ~both & (jaccard > 0) & (jaccard < 1)
    decided = pairs.filter(~open_).withColumn("score", F.when(both, family).otherwise(jaccard))
    ratio = sequence_ratio(F.col("a_joined"), F.col("b_joined"))
    return decided.unionByName(pairs.filter(open_).withColumn("_r", ratio).withColumn("score", F.greatest(jaccard, F.col("_r"))).drop("_r"))


def _subject_rule() -> Column:
    """The score where no string ratio is needed, else null."""
    shared = F.size(F.array_intersect("a_tokens", "b_tokens"))
    return (
        F.when(F.col("a_low") == F.col("b_low"), 1.0)
        .when((F.size("a_tokens") == 0) | (F.size("b_tokens") == 0), 0.0)
        .when(shared > 0, shared / F.greatest(F.size("a_tokens"), F.size("b_tokens")))
        .when(F.contains("a_low", F.col("b_low")) | F.contains("b_low", F.col("a_low")), 0.85)
    )


def subject_possible(least: float) -> Column:
    """Whether a pair of subject features (a_*, b_*) can score `least`."""
    bound = ratio_bound(F.col("a_low"), F.col("b_low"), F.col("a_letters"), F.col("b_letters"))
    return F.coalesce(_subject_rule() >= least, bound >= 0.8)


def subject_scores(pairs):
    """pairs of subject features (a_*, b_*) with score. The string ratio is taken only where nothing else decides."""
    native = _subject_rule()
    decided = pairs.filter(native.isNotNull()).withColumn("score", native)
    open_ = pairs.filter(native.isNull()).withColumn("_r", sequence_ratio(F.col("a_low"), F.col("b_low")))
    return decided.unionByName(open_.withColumn("score", F.when(F.col("_r") >= 0.8, F.col("_r")).otherwise(0.0)).drop("_r"))

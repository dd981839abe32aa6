"""Candidate pairs: facts of different documents about the same subject and a comparable metric.

Similarity is worked out once for distinct subjects and distinct predicates, not for pairs of facts, by a prefix-filtered
set-similarity join; facts are then joined to the similar subjects and predicates by equality. No pair is lost:

* Subjects are similar if they share 0.6 of the larger one's core tokens. Of n tokens, ceil(0.6 n) must then be shared, so one of
  the n - ceil(0.6 n) + 1 rarest is: only those are keys, on both sides.
* Without a shared token, one contains the other or the string ratio is 0.8. A ratio of 0.8 means M >= 0.4 S matching characters of
  S, in at most S - 2M + 1 runs, so at least 0.2 S - 1 pairs of neighbouring characters are shared; with S >= 5/3 n that is n / 3 - 1.
  Keys are the rarest pairs of one side that must hold one of these (for containment, the rarest is enough), against all pairs of the
  other. Lengths 2 and 3 may share no pair (`ab`, `axb`): such subjects meet by single characters.
* Predicates are similar if their families are equal, or else by tokens or, with any token shared, a string ratio of 0.65: there all
  tokens are keys, with a class of the joined tokens' length, which the ratio bounds by (2 - 0.65) / 0.65 on either side.

Keys that many values share are split: with more than CELL values on a side, both sides are dealt into cells of about CELL values, and
each pair of cells is a join key of its own, so no key brings a task more than about CELL ** 2 candidates. What can be decided from
lengths, letters and sets is, as expressions; the string ratio itself is Python, on rows that nothing else decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import vocab as V
from factloom.functions.metrics import predicate_features, predicate_possible, predicate_scores, subject_features, subject_possible, subject_scores
from factloom.session import cut


def as_side(facts: DataFrame, side: str) -> DataFrame:
    return facts.select([F.col(f"`{c}`").alias(f"{side}_{c}") for c in facts.columns])


def hold(df: DataFrame, held: list[DataFrame] | None) -> DataFrame:
    """df, persisted; who passes a list finds it there and can release it when the results are written."""
    df = df.persist()
    if held is not None:
        held.append(df)
    return df


#: Values of a key on one side that a task compares with as many of the other.
CELL = 2000
#: Lengths whose joined tokens can have the least ratio differ by at most one class.
LENGTH_STEP = (2 - V.LEAST_PREDICATE) / V.LEAST_PREDICATE


def predicate_keys(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys of each side, one a row, with the predicate's features."""
    step = F.floor(F.log(F.greatest(F.length("joined"), F.lit(1))) / F.log(F.lit(LENGTH_STEP)))
    family = F.when(F.col("family").isNotNull(), F.array(F.concat(F.lit("F:"), "family"))).otherwise(F.array().cast("array<string>"))
    keys = lambda *moves: F.concat(family, *[F.transform("tokens", lambda t: F.concat(F.lit("T:"), t, F.lit(":"), (step + m).cast("string"))) for m in moves])
    return tuple(features.withColumn("_k", F.explode(F.array_distinct(k))) for k in (keys(0), keys(-1, 0, 1)))


def runs(text: Column, n: int) -> Column:
    """All runs of n characters."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - (n - 1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.concat(F.lit(f"{n}:"), F.substring(text, i, F.lit(n))))


def subject_keys(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys of each side, one a row, with the subject's features. The left side has the rarest runs, the right side all."""
    low, n = F.col("low"), F.length("low")
    some = F.size("tokens") > 0  # a subject without core tokens can only equal another
    none = F.array().cast("array<string>")
    two = F.when(some, runs(low, 2)).otherwise(none)
    one = F.when(some & (n <= 3), runs(low, 1)).otherwise(none)
    signs = features.select("value", F.explode(F.concat(F.transform("tokens", lambda t: F.concat(F.lit("T:"), t)), two)).alias("_k"))
    counted = signs.join(signs.groupBy("_k").agg(F.count("*").alias("_n")), "_k")
    ordered = counted.groupBy("value").agg(F.sort_array(F.collect_list(F.struct("_n", "_k"))).alias("_o"))
    own = lambda kind: F.transform(F.filter("_o", lambda x: x["_k"].startswith(kind)), lambda x: x["_k"])
    rows = features.join(ordered, "value", "left")
    rarest_tokens = F.slice(own("T:"), 1, F.size("tokens") - F.ceil(F.size("tokens") * V.LEAST_SUBJECT).cast("int") + 1)
    rarest_runs = F.slice(own("2:"), 1, F.greatest(F.lit(1), n - F.greatest(F.lit(1), F.ceil(n / 3).cast("int") - 1)))
    equal = F.array(F.concat(F.lit("E:"), low))
    keys = lambda near: F.array_distinct(F.concat(equal, F.when(some, F.concat(rarest_tokens, near, one)).otherwise(none)))
    return tuple(rows.withColumn("_k", F.explode(keys(near))).drop("_o") for near in (rarest_runs, two))


def in_cells(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keyed rows as sides a_* and b_*, to be joined on _k, _ca and _cb: the rows of a key of many values are dealt into cells, and
    given once for each cell of the other side."""
    count = lambda rows, to: rows.groupBy("_k").agg(F.ceil(F.count("*") / CELL).cast("int").alias(to))
    # a row for each key of more than CELL values: a CELL-th of the keyed rows at most
    cells = count(a, "_ca").join(count(b, "_cb"), "_k").filter("_ca > 1 or _cb > 1")

    def dealt(rows: DataFrame, side: str, own: str, other: str) -> DataFrame:
        rows = as_side(rows, side).withColumnRenamed(f"{side}__k", "_k").join(cells, "_k", "left")
        at = F.pmod(F.xxhash64(f"{side}_value"), F.coalesce(own, F.lit(1))).cast("int")
        return rows.withColumns({own: at, other: F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))})

    return dealt(a, "a", "_ca", "_cb"), dealt(b, "b", "_cb", "_ca")


def meet(a: DataFrame, b: DataFrame, possible: Column) -> DataFrame:
    """Distinct pairs (a_*, b_*) of keyed rows that share a key and are possible."""
    one, other = in_cells(a, b)
    return one.join(other, ["_k", "_ca", "_cb"]).filter(possible).drop("_k", "_ca", "_cb").dropDuplicates(["a_value", "b_value"])


def similar(values: DataFrame, kind: str, least: float, new: DataFrame | None = None, held: list[DataFrame] | None = None) -> DataFrame:
    """(a, b, score): the ordered pairs of distinct values of one column that score at least `least`; with `new`, some of the
    values, only pairs that hold one of them. Keys suit the thresholds of the rules or higher ones."""
    names = lambda v: v.toDF("value").filter("value is not null").distinct()
    features, scores_of, keys, possible = (predicate_features, predicate_scores, predicate_keys, predicate_possible) if kind == "predicate" else (subject_features, subject_scores, subject_keys, subject_possible)
    # what is worked out of the values is written, so that the plan of the pairs does not repeat it
    rows = features(names(values))
    if new is not None:
        rows = rows.join(names(new).withColumn("fresh", F.lit(True)), "value", "left")
    left, right = (hold(k, held) for k in keys(cut(rows)))
    wanted = possible(least)
    if new is not None:
        wanted = wanted & (F.coalesce("a_fresh", F.lit(False)) | F.coalesce("b_fresh", F.lit(False)))
    met = cut(meet(left, right, wanted))
    swap = {f"{x}_{c}": f"{y}_{c}" for c in left.columns if c != "_k" for x, y in (("a", "b"), ("b", "a"))}
    # the string ratio may depend on the order of its arguments
    both = met.unionByName(met.select([F.col(c).alias(swap[c]) for c in met.columns])).dropDuplicates(["a_value", "b_value"])
    return scores_of(both).filter(F.col("score") >= least).select(F.col("a_value").alias("a"), F.col("b_value").alias("b"), "score")


def period_score(a: Column, b: Column) -> Column:
    stated = lambda p: F.coalesce(p, F.lit("")) != ""
    shared = F.lit(False)
    for y in V.SAME_YEARS:
        shared = shared | (F.contains(a, F.lit(y)) & F.contains(b, F.lit(y)))
    return F.when(stated(a) & stated(b), F.when(a == b, 1.0).when(shared, 0.8).otherwise(0.6)).when(~stated(a) & ~stated(b), 0.7).otherwise(0.6)


def scored(pairs: DataFrame) -> DataFrame:
    """pairs of facts (a_*, b_*) with subj_score and pred_score: match_score and match_reason."""
    when = period_score(F.col("a_period"), F.col("b_period"))
    text = lambda *parts: F.concat(*[F.lit(p) if not isinstance(p, Column) else p for p in parts])
    pa_, pb = F.col("a_period"), F.col("b_period")
    note = (
        F.when(when == 1.0, text("identical period (", pa_, ")"))
        .when(when == 0.8, text("overlapping fiscal timeframe (", pa_, " vs ", pb, ")"))
        .when(when == 0.7, F.lit("unspecified temporal context"))
        .when(pa_.isNotNull() & pb.isNotNull() & (pa_ != "") & (pb != ""), text("comparable reporting periods (", pa_, " vs ", pb, ")"))
    )
    total = F.col("pred_score") * 0.5 + F.col("subj_score") * 0.35 + when * 0.15
    return (
        pairs.withColumn("_total", total)
        .withColumn("match_score", F.round("_total", 4))
        .withColumn(
            "match_reason",
            F.concat_ws(" + ", text("subject alignment ('", F.col("a_subject"), "' ~ '", F.col("b_subject"), "')"), text("metric alignment ('", F.col("a_predicate"), "' ~ '", F.col("b_predicate"), "')"), note),
        )
    )


def candidate_pairs(facts: DataFrame, least: float = V.LEAST_SCORE, new: Column | None = None, held: list[DataFrame] | None = None) -> DataFrame:
    """Pairs of facts a < b (by id) of different documents with match_score and match_reason; all columns of both sides.

    With `new`, a condition on facts, only pairs that hold a fact it is true of: what is stored is not compared again.
    """
    fresh = None if new is None else facts.filter(new)
    of = lambda c: None if fresh is None else fresh.select(c)
    subjects = similar(facts.select("subject"), "subject", V.LEAST_SUBJECT, of("subject"), held).toDF("subj_a", "subj_b", "subj_score")
    predicates = similar(facts.select("predicate"), "predicate", V.LEAST_PREDICATE, of("predicate"), held).toDF("pred_a", "pred_b", "pred_score")
    same = (F.col("subj_b") == F.col("b_subject")) & (F.col("pred_b") == F.col("b_predicate")) & (F.col("a_id") < F.col("b_id")) & (F.col("a_document_id") != F.col("b_document_id"))

    def meet(a: DataFrame, b: DataFrame) -> DataFrame:
        reach = as_side(a, "a").join(subjects, F.col("a_subject") == F.col("subj_a")).join(predicates, F.col("a_predicate") == F.col("pred_a"))
        return reach.join(as_side(b, "b"), same).drop("subj_a", "subj_b", "pred_a", "pred_b")

    met = meet(facts, facts) if fresh is None else meet(fresh, facts).unionByName(meet(facts.filter(~F.coalesce(new, F.lit(False))), fresh))
    kinds = F.array("a_fact_type", "b_fact_type")
    apart = F.array_contains(kinds, "financial_metric") & F.array_contains(kinds, "device_specification")
    return scored(met.filter(~F.coalesce(apart, F.lit(False)))).filter(F.col("_total") >= least).drop("_total")


def capped(pairs: DataFrame, cap: int = V.PAIR_CAP) -> DataFrame:
    """At most `cap` pairs for each document: the later document's, in the order of the two facts' arrival (then of their ids)."""
    late = F.col("a_created_at") > F.col("b_created_at")
    new = F.when(late, F.struct(F.col("a_created_at").alias("t"), F.col("a_id").alias("i"))).otherwise(F.struct(F.col("b_created_at").alias("t"), F.col("b_id").alias("i")))
    old = F.when(late, F.struct(F.col("b_created_at").alias("t"), F.col("b_id").alias("i"))).otherwise(F.struct(F.col("a_created_at").alias("t"), F.col("a_id").alias("i")))
    order = Window.partitionBy("_doc").orderBy("_new", "_old")
    keyed = pairs.withColumns({"_doc": F.when(late, F.col("a_document_id")).otherwise(F.col("b_document_id")), "_new": new, "_old": old})
    return keyed.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= cap).drop("_doc", "_new", "_old", "_n")

"""Model replies: cleaning, precedence over the rules, and opinions on pairs, with results worked out by hand."""

import json

from pyspark.sql import functions as F

from factloom.operators.replies import merged_facts, reply_facts, unfenced, with_opinions, worth_asking

TEXT = "Infosys had a good year. EBITDA was Rs. 350 crore in FY2024. The tank holds 1.8 liters. Staff grew."


def chunks(spark, *replies):
    return spark.createDataFrame([("d", 1, f"c{k}", TEXT, r) for k, r in enumerate(replies)], "document_id string, page_number int, chunk_id string, text string, reply string")


def facts_of(spark, *items):
    return [r.asDict() for r in reply_facts(chunks(spark, json.dumps({"facts": list(items)}))).orderBy("ordinal").collect()]


def test_fences(spark):
    rows = ['```json\n{"a":1}\n```', '```{"a":1}```', ' {"a":1} ', "", "``````"]
    assert [r[0] for r in spark.createDataFrame([(r,) for r in rows], "r string").select(unfenced(F.col("r"))).collect()] == ['{"a":1}'] * 3 + ["", ""]


def test_cleaning(spark):
    base = {"subject": "Infosys", "predicate": "margin", "value": "12%", "fact_type": "percentage", "evidence_quote": "a quote of enough length"}
    got = facts_of(
        spark, base, base | {"value": " "}, base | {"subject": None}, "text", 7, base | {"subject": "EBITDA", "predicate": "Value", "value": "350 crore", "evidence_quote": "short"},
        base | {"value": 1.8, "fact_type": "size", "evidence_quote": None, "period": "Unspecified", "unit": "unspecified", "currency": "N/A", "qualifiers": {"a": "b"}}, base | {"value": "none said", "fact_type": "odd", "evidence_quote": "", "qualifiers": [1]},
        base | {"value": 0}, base | {"value": "0", "fact_type": None, "scope": " group "},
    )
    assert [g["ordinal"] for g in got] == [0, 5, 6, 7, 9]
    assert (got[0]["subject"], got[0]["fact_type"], got[0]["evidence_quote"], got[0]["qualifiers"]) == ("Infosys", "percentage", base["evidence_quote"], {})
    assert (got[1]["subject"], got[1]["predicate"], got[1]["evidence_quote"]) == ("Infosys", "EBITDA", "350 crore in FY2024.")
    assert (got[2]["value"], got[2]["fact_type"], got[2]["evidence_quote"]) == ("1.8", "numerical_metric", "The tank holds 1.8 liters.")
    assert (got[2]["period"], got[2]["unit"], got[2]["currency"], got[2]["qualifiers"]) == (None, "unspecified", None, {"a": "b"})
    assert (got[3]["fact_type"], got[3]["evidence_quote"], got[3]["qualifiers"]) == ("semantic_claim", TEXT, {})
    assert (got[4]["value"], got[4]["fact_type"], got[4]["scope"]) == ("0", "other", "group")


def test_replies_come_before_rules(spark):
    own = {"subject": "infosys", "predicate": "EBITDA", "value": "rs. 350 crore", "evidence_quote": "EBITDA was Rs. 350 crore in FY2024."}
    got = merged_facts(chunks(spark, json.dumps({"facts": [own, own]}), None, "no json", '{"facts": null}', "[1]", '{"other": 1}', '{"facts": "x"}')).filter(F.lower("predicate") == "ebitda").collect()
    by = {}
    for r in got:
        by.setdefault(r.chunk_id, []).append((r.subject, r.from_model))
    assert by == {"c0": [("infosys", True)]} | {f"c{k}": [("Infosys", False)] for k in range(1, 7)}


def test_worth_asking(spark):
    texts = ["word " * 14, "word " * 15, "a ... " * 9 + "word " * 20, "1. a " * 31, "1. a " * 31 + "word " * 40, ""]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(worth_asking(F.col("t"))).collect()] == [False, True, False, False, True, False]


def test_opinions(spark):
    replies = ['{"relationship_type": "contradict", "confidence": 0.5, "reasoning": "because"}', '{"relationship_type": "UNRELATED"}', '{"relationship_type": "odd"}', "nonsense", None, '```json\n{"confidence": 0.0}\n```']
    rows = [(k, t, "rule", 0.9, r) for t in ("CORROBORATE", "UNRELATED") for k, r in enumerate(replies)]
    got = {(r.k, r.reasoning, r.type, r.confidence) for r in with_opinions(spark.createDataFrame(rows, "k int, type string, reasoning string, confidence double, reply string")).collect()}
    assert got == {(0, "because", "CONTRADICT", 0.74), (1, "The facts do not describe the same underlying claim or measurement context.", "UNRELATED", 0.5), (2, "rule", "CORROBORATE", 0.88), (3, "rule", "CORROBORATE", 0.9), (4, "rule", "CORROBORATE", 0.9), (5, "rule", "CORROBORATE", 0.54)} | {
        (k, "rule", "UNRELATED", 0.9) for k in range(6)
    }

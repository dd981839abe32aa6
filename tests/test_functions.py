"""Scalar functions against hand-worked values."""

import random

from pyspark.sql import functions as F

from factloom.functions import periods, quality, text, values
from factloom.operators.chunking import pack
from factloom.operators.ground import fact_confidence, ground


def one(spark, rows, expression, columns="x string"):
    return [r[0] for r in spark.createDataFrame(rows, columns).select(expression.alias("v")).collect()]


def test_periods(spark):
    cases = {"FY24": "FY2024", "FY 2024": "FY2024", "Fiscal 2024": "FY2024", "Q1 FY24": "Q1 FY2024", "1Q FY2024": "Q1 FY2024", "2024": "CY2024", "2023-24": "FY2024", "2024-03-31": "FY2003", "H1 FY24": "FY2024", "Q1 FY2023-24": "Q1 FY2023", "soon": "soon"}
    assert one(spark, [(k,) for k in cases], periods.normalize_period(F.col("x"))) == list(cases.values())
    assert one(spark, [(None,), ("",)], periods.normalize_period(F.col("x"))) == [None, None]


def test_sort_keys(spark):
    order = ["FY2022", "FY2023", "Q1 FY2024", "FY2024", "FY2025"]
    keys = one(spark, [(x,) for x in order], periods.sort_key(F.col("x")))
    assert keys == sorted(keys)
    cases = {None: "9999-99-99", "CY2024": "2024-12-CY", "Q4 FY2024": "2024-03-Q4", "sometime": "9998-SOMETIME"}
    assert one(spark, [(k,) for k in cases], periods.sort_key(F.col("x"))) == list(cases.values())


def test_values(spark):
    none = F.lit(None).cast("string")
    cases = {"₹1,000 crore": (1e10, "INR"), "₹10 billion": (1e10, "INR"), "$500 million": (5e8, "USD"), "14.5%": (14.5, "%"), "1.8 liters": (1.8, "liters"), "15 bar": (15.0, "bar"), "-5%": (5.0, "%"), ",": (None, None), "740Mn": (7.4e8, "mn"), "740 million": (7.4e8, "million"), "": (None, None)}
    got = one(spark, [(k,) for k in cases], values.normalize_value(F.col("x"), none, none))
    assert [(r.normalized_value, r.normalized_unit) for r in got] == list(cases.values())


def test_lone_numbers(spark):
    cases = {"4": True, "4 FY23": True, "Page 12": True, "• 4": True, "mild": True, "₹2,500 crore": False, "15 bar": False}
    assert one(spark, [(k,) for k in cases], quality.meaningless_number(F.col("x"))) == list(cases.values())


def test_sentences_and_title(spark):
    got = one(spark, [("Rs. 5 cr. was paid. It was re-\nported!  Yes?\n\nNew para",)], text.sentences(F.col("x")))[0]
    assert got == ["Rs. 5 cr. was paid.", "It was reported!", "Yes?", "New para"]
    assert one(spark, [("e-commerce o'neil",), (None,)], text.title(F.col("x"))) == ["E-Commerce O'Neil", None]
    assert one(spark, [(None,), ("",)], text.sentences(F.col("x"))) == [[], []]


def test_gates(spark):
    rows = [
        ("Acme Logistics", "revenue", "₹2,500 crore", "Acme Logistics reported revenue of ₹2,500 crore."), ("Acme", "revenue", "5 crore", ""), ("Acme", "increased", "5 crore", "Acme increased to 5 crore."),
        ("we have", "revenue", "5 crore", "we have revenue of 5 crore"), ("Acme", "revenue", "4", "Acme revenue page number 4"), ("delhivery", "revenue", "5 crore", "delhivery revenue of 5 crore"),
    ]
    df = spark.createDataFrame([(*r, None, None, None, r[3]) for r in rows], "subject string, predicate string, value string, evidence_quote string, period string, unit string, currency string, page_text string")
    got = quality.judge(df).collect()
    assert [r.status for r in got] == ["ACCEPTED", "REJECTED", "REJECTED", "REJECTED", "REJECTED", "ACCEPTED"]
    assert got[1].rejection_reason == "Missing evidence quote" and got[5].subject == "Delhivery"


def test_grounding(spark):
    page = "Intro. Acme reported revenue of ₹2,500 crore in FY2024, up 12 per cent from last year. More text follows here."
    rows = [("Acme reported revenue of Rs. 2,500 crore in FY2024", page), ("Acme reported revenue of 2,500 crore during FY-2024", page), ("The coffee machine has a water tank", page), ("", page), ("x", None)]
    got = [r for r in ground(spark.createDataFrame(rows, "evidence_quote string, page_text string").withColumn("k", F.monotonically_increasing_id())).orderBy("k").collect()]
    assert got[0].grounding_score == 1.0 and got[0].grounding_status == "VERIFIED" and got[3].matched_snippet is None
    assert got[1].grounding_score >= 0.8 and got[2].grounding_score < 0.6
    assert [r.grounding_status for r in got[3:]] == ["UNVERIFIED", "UNVERIFIED"]
    assert one(spark, [("1",)], fact_confidence(F.lit(1.0), F.lit(0.9))) == [0.955]


def test_fuzzy_grounding_against_brute_force(spark):
    """The ratio over windows equals a search written out in plain Python; so do blend and snippet."""
    import difflib
    import random
    import re

    rng = random.Random(7)
    vocabulary = "acme revenue crore margin parcels shipped 2,500 fy2024 in of up to a (net) \"ebitda\" growth warehouse 12% ₹350 volume".split()
    pages = [" ".join(rng.choices(vocabulary, k=n)) for n in (3, 12, 60, 400)]
    quotes = [" ".join(rng.choices(vocabulary, k=n)) for n in (1, 2, 7, 15)] + ["zebra yak of", "zz yy xx"]
    rows = [(q, p) for q in quotes for p in pages]

    def best(q, p, most):
        kept = re.findall(r"[a-z0-9%₹]{2,}", re.sub(r"(\d)\s+%", r"\1%", re.sub(r"₹\s*", "₹", q)))
        telling = {t for t in kept if len(t) > 3 or re.search(r"\d", t)} or set(kept)
        words, n = p.split(), len(q.split())
        places = [k for k, w in enumerate(words) if re.sub(r"^[^\w₹]+|[^\w₹]+$", "", w) in telling] or list(range(0, len(words), max(1, n // 2)))
        ratios = [(difflib.SequenceMatcher(None, q, x).ratio(), x) for x in (" ".join(words[k : k + int(n * 1.2) + 2]) for k in sorted({max(0, k - int(n * 0.8)) for k in places})[:most])]
        return next((r for r in ratios if r[0] > 0.95), max(ratios, key=lambda r: r[0]))

    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, evidence_quote string, page_text string")
    for most in (15, 2, None):
        got = {r.k: r for r in ground(df, most=most).collect()}
        fuzzy = 0
        for k, (q, p) in enumerate(rows):
            if got[k].grounding_score == 1.0 and got[k].matched_snippet in (q, None):
                continue
            ratio, stretch = best(q, p, most)
            kept = lambda x: re.findall(r"[a-z0-9%₹]{2,}", re.sub(r"(\d)\s+%", r"\1%", re.sub(r"₹\s*", "₹", x)))
            share = len(set(kept(q)) & set(kept(p))) / len(set(kept(q)))
            want = max(ratio, share * 0.95) if share > 0.8 else max(ratio, share * 0.85) if share > 0.6 else ratio * share
            assert abs(got[k].grounding_score - min(1.0, want)) < 1e-4, (q, p, most)
            assert got[k].matched_snippet == (stretch if ratio else None)
            fuzzy += 1
        assert fuzzy >= 12


def plain_pack(sizes, limit, overlap):
    """Places of the runs, by hand."""
    runs, run, words = [], [], 0
    for at, n in enumerate(sizes):
        if run and words + n > limit:
            runs.append((run[0], at))
            kept, held = [], 0
            for k in reversed(run):
                if held + sizes[k] > overlap:
                    break
                kept.insert(0, k)
                held += sizes[k]
            run, words = kept, held
        run.append(at)
        words += n
    return [*runs, (run[0], len(sizes))] if run else runs


def test_pack(spark):
    """Runs of few and of 100,000 sentences, with empty, large and hot sizes, equal the plain packer's."""
    rng = random.Random(3)
    cases = [[], [5], [2000], [0, 0, 0], [100] * 30, [990, 20, 20, 990, 150, 151, 0, 1], [rng.choice([0, 1, 7, 20, 60, 400, 1500]) for _ in range(400)], [rng.randint(1, 30) for _ in range(100_000)]]
    rows = spark.createDataFrame([(k, sizes) for k, sizes in enumerate(cases)], "k int, sizes array<int>").withColumn("parts", F.transform("sizes", lambda n, at: at.cast("string")))
    for limit, overlap in ((1000, 150), (100, 20)):
        some = rows if limit == 1000 else rows.filter("k < 7")
        got = {r.k: r.runs for r in some.select("k", pack(F.col("parts"), F.col("sizes"), limit, overlap).alias("runs")).collect()}
        for k, sizes in enumerate(cases[: len(got)]):
            assert got[k] == [" ".join(map(str, range(i, j))) for i, j in plain_pack(sizes, limit, overlap)]

"""From pages to relationships, with the results worked out by hand from the rules."""

import difflib
import functools
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from factloom.functions import vocab as V
from factloom.functions.metrics import predicate_features
from factloom.operators import match
from factloom.operators.extract import callouts, first_wins
from factloom.operators.match import similar
from factloom.operators.relate import upsert
from factloom.plans.ingest import facts_of_pages, ingest, knowledge
from factloom.plans.store import SCHEMAS, Change, Store
from factloom.sources.pages import document_totals, flag_duplicates, parse_pages, scan_files
from factloom.streaming.landing import watch_pages

PAGES = [
    ("d1", 1, "Acme Logistics reported revenue of Rs. 2,500 crore in FY2024. EBITDA was Rs. 350 crore in FY2024."),
    ("d3", 1, "Acme Logistics reported revenue of Rs. 3,200 crore in FY2024."),
    ("d2", 1, "Acme Logistics reported revenue of Rs. 2,500 crore in FY2024."),
    ("d4", 1, "Acme Logistics reported revenue of Rs. 650 crore in Q1 FY2024."),
    ("d6", 1, "The DeLonghi Magnifica features a water tank capacity of 1.8 liters. The machine operates with an operating pressure of 15 bar. Power consumption is rated at 1450 watts."),
    ("d5", 1, "Increased. And the 4 FY23. Page 12."),
    ("d0", 1, ""),
]
SCHEMA = "document_id string, page_number int, text string"


@pytest.fixture(scope="module")
def facts(spark):
    return facts_of_pages(spark.createDataFrame(PAGES, SCHEMA)).persist()


def test_facts(facts):
    got = {(r.document_id, r.subject, r.predicate, r.normalized_value, r.normalized_unit, r.period) for r in facts.filter("status = 'ACCEPTED'").collect()}
    assert ("d1", "Acme Logistics", "revenue", 2.5e10, "INR", "FY2024") in got
    assert ("d4", "Acme Logistics", "revenue", 6.5e9, "INR", "Q1 FY2024") in got
    assert ("d6", "DeLonghi Magnifica", "water tank capacity", 1.8, "liters", None) in got
    assert sum(d == "d6" for d, *_ in got) == 3 and not any(d in ("d5", "d0") for d, *_ in got)


def test_relationships(spark, facts):
    docs = spark.createDataFrame([(d, f"{d}.pdf") for d, *_ in PAGES], "id string, filename string")
    rel = knowledge(facts, docs)["relationships"].join(facts.select(F.col("id").alias("a"), F.col("document_id").alias("da")), F.col("fact_a_id") == F.col("a")).join(facts.select(F.col("id").alias("b"), F.col("document_id").alias("db")), F.col("fact_b_id") == F.col("b"))
    got = {(frozenset((r.da, r.db)), r.type): r.confidence for r in rel.filter(F.col("reasoning").contains("revenue") | (F.col("type") == "RECONCILE")).collect()}
    kinds = {k for k in got}
    assert (frozenset(("d1", "d2")), "CORROBORATE") in kinds
    assert (frozenset(("d1", "d3")), "CONTRADICT") in kinds and (frozenset(("d2", "d3")), "CONTRADICT") in kinds
    assert all((frozenset(("d4", d)), "RECONCILE") in kinds for d in ("d1", "d2", "d3"))
    assert 0.8 < got[(frozenset(("d1", "d2")), "CORROBORATE")] <= 0.98


STOP = set("the a an ltd limited inc corp corporation company group holdings technologies services our your its".split())


@functools.cache
def plain_features(name):
    low = name.lower().strip()
    return low, {w for w in re.findall(r"\b[a-z]{2,}\b", low)} - STOP


def plain_subject_score(a, b):
    (a, ta), (b, tb) = plain_features(a), plain_features(b)
    if a == b:
        return 1.0
    if not ta or not tb:
        return 0.0
    if not ta.isdisjoint(tb):
        return len(ta & tb) / max(len(ta), len(tb))
    if a in b or b in a:
        return 0.85
    if 2 * min(len(a), len(b)) < 0.8 * (len(a) + len(b)):
        return 0.0
    m = difflib.SequenceMatcher(None, a, b)
    return r if m.quick_ratio() >= 0.8 and (r := m.ratio()) >= 0.8 else 0.0


def varied_names(n, seed):
    """Names of which a third holds one word, with near copies, short ones and odd ones."""
    rng, words = random.Random(seed), ["acme", "global", "delta", "north", "solar", "metro", "nova", "prime", "orbit", "vertex", "zen", "hp", "ab"]
    word = lambda: rng.choice(words) if rng.random() < 0.5 else "".join(rng.choices("abcdeilnorst", k=rng.randint(2, 9)))
    out = {"ab", "axb", "abc", "b", "The Group", "é ab", "", "Ab-Cd", "abcabcabcabc", "x y"}
    while len(out) < n:
        name = " ".join([*["Acme"] * (rng.random() < 0.33), *(word() for _ in range(rng.randint(1, 4))), *["Ltd"] * (rng.random() < 0.2)])
        out.add(name.title() if rng.random() < 0.7 else name)
        if rng.random() < 0.5:
            at = rng.randrange(len(name) + 1)
            out.add(name[:at] + rng.choice(["x", "q ", "", "-"]) + name[at + rng.randint(0, 1) :])
    return sorted(out)[:n]


@pytest.mark.parametrize("cell", [50, 2000])
def test_blocking_loses_no_pair(spark, monkeypatch, cell):
    """The join's similarity equals the comparison of all pairs, with keys split or whole."""
    monkeypatch.setattr(match, "CELL", cell)
    names = ["Acme Logistics", "Acme Logistics Ltd", "Acmee", "Acme", "Delhivery", "Delhivery Limited", "hp", "hpq corp", "Infosys", "Infosis", "The Group", "Tata Motors", "x", *varied_names(2000 if cell == 2000 else 300, 5)]
    got = {(r.a, r.b): r.score for r in similar(spark.createDataFrame([(n,) for n in [*names, None]], "subject string"), "subject", 0.6).collect()}
    want = {(a, b): s for a, b in itertools.product(set(names), repeat=2) if (s := plain_subject_score(a, b)) >= 0.6}
    assert got == want and len(want) > len(names)


def test_predicates_lose_no_pair(spark):
    rng, words = random.Random(4), ["total", "revenue", "net", "profit", "growth", "tank", "capacity", "pressure", "deficit", "parcel", "volume", "tax", "margin", "loss", "waters", "water", "revenues"]
    names = sorted({" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(350)} | {" ".join(["total", *("".join(rng.choices("aeinrst", k=rng.randint(2, 12))) for _ in range(rng.randint(1, 3)))]) for _ in range(250)} | {"", "x", "5 %"})
    frame = spark.createDataFrame([(n,) for n in names], "predicate string")
    got = {(r.a, r.b): r.score for r in similar(frame, "predicate", 0.65).collect()}
    features = [r for r in predicate_features(frame.toDF("value")).collect()]

    def conflict(a, b):
        return any((set(a) & set(x) and set(b) & set(y)) or (set(a) & set(y) and set(b) & set(x)) for x, y in V.MODIFIER_CONFLICTS)

    def score(a, b):
        if a.family and b.family:
            return float(a.family == b.family and not conflict(a.tokens, b.tokens))
        shared = set(a.tokens) & set(b.tokens)
        jaccard = len(shared) / len(set(a.tokens) | set(b.tokens)) if shared else 0.0
        return max(jaccard, difflib.SequenceMatcher(None, " ".join(sorted(a.tokens)), " ".join(sorted(b.tokens))).ratio()) if 0 < jaccard < 1 else jaccard

    want = {(a.value, b.value): s for a, b in itertools.product(features, repeat=2) if (s := score(a, b)) >= 0.65}
    assert got == want and len(want) > len(names)


def test_hot_keys_are_split(spark, monkeypatch):
    """Where a word stands in a third of all names, no pair of cells has many more than CELL ** 2 candidates."""
    monkeypatch.setattr(match, "CELL", 100)
    rows = spark.range(3000).select(F.col("id").cast("string").alias("value"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("_k"))
    assert match.meet(rows, rows, F.col("a_value") != F.col("b_value")).count() == 1000 * 999
    for side in match.in_cells(rows, rows):
        sizes = [r["count"] for r in side.filter("_k = 'hot'").groupBy("_ca", "_cb").count().collect()]
        assert len(sizes) == 100 and max(sizes) <= 2 * 100 and sum(sizes) == 1000 * 10


def test_callouts(spark):
    def found(text):
        return [tuple(r) for r in spark.createDataFrame([(text,)], "x string").select(callouts(F.col("x"))).first()[0]]

    text = "740Mn\n  Express parcels shipped\n₹81,415Mn\n\n(1)\n**\nRevenue from services\n4\nSome label with many words\n4\nShort label\nFY24\n12\nFY23 FY24\n,\nOnly commas\n9\nNote\n15%"
    assert found(text) == [("740Mn", "Express parcels shipped"), ("₹81,415Mn", "Revenue from services"), ("4", "Short label")]
    assert found("5 days\nRs 500\nRevenue growth") == [("5 days", "Rs 500")]  # a line that was a label is not a value again
    assert found("Rs 500\nRs 600\nRs 700\nRevenue growth") == [("Rs 500", "Rs 600"), ("Rs 700", "Revenue growth")]
    assert found("") == [] and found("7%") == []


def test_first_wins_and_upsert(spark):
    f = spark.createDataFrame([("c", "A", "p", "1", 1, 0), ("c", "a", "P", "1", 0, 1)], "chunk_id string, subject string, predicate string, value string, rank int, ordinal int")
    assert [r["rank"] for r in first_wins(f, "rank").collect()] == [0]
    old = spark.createDataFrame([("k1", "i1", "t1"), ("k2", "i2", "t1")], "canonical_key string, id string, created_at string")
    new = spark.createDataFrame([("k1", "i9", "t0")], "canonical_key string, id string, created_at string")
    assert sorted(r.id for r in upsert(old, new).collect()) == ["i2", "i9"]


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.read("facts").count() == 0
    pages = spark.createDataFrame(PAGES[:2], SCHEMA)
    docs = spark.createDataFrame([("d1", "d1.pdf"), ("d3", "d3.pdf")], "id string, filename string")
    ingest(store, pages, docs)
    first = sorted(r.id for r in store.read("facts").collect())
    ingest(store, pages, docs)
    assert sorted(r.id for r in store.read("facts").collect()) == first and store.read("documents").count() == 2
    assert store.read("relationships").count() >= 1
    store.set_status("d1", "FAILED", 0, "gone", "2024-02-01", "unreadable")
    assert store.read("documents").filter("status = 'FAILED'").count() == 1
    store.delete_document("d1")
    assert store.read("relationships").count() == 0 and {r.document_id for r in store.read("facts").collect()} == {"d3"}
    assert store.read("fact_clusters").agg(F.max("source_doc_count")).first()[0] == 1
    store.delete_all()
    assert store.read("documents").count() == 0


def test_ingest_compares_only_new_documents(spark, tmp_path):
    """Documents that come one after the other leave the same tables as all at once."""
    docs = spark.createDataFrame([(d, f"{d}.pdf") for d in ("d1", "d2", "d3")], "id string, filename string")
    pages = spark.createDataFrame(PAGES[:3], SCHEMA)
    whole, steps = Store(spark, str(tmp_path / "whole")), Store(spark, str(tmp_path / "steps"))
    ingest(whole, pages, docs)
    for some in (["d1", "d3"], ["d2"]):
        ingest(steps, pages.filter(F.col("document_id").isin(some)), docs.filter(F.col("id").isin(some)))
    for name in ("facts", "candidate_pairs", "relationships", "fact_clusters", "cluster_members"):
        rows = [sorted(str(r) for r in s.read(name).collect()) for s in (whole, steps)]
        assert rows[0] == rows[1] and rows[0], name
    last = steps.read("diagnostics").filter("document_id = 'd2'").first()
    assert last.candidate_pairs > 0 and last.relationships > 0 and last.chunks_created == 1 and last.accepted_facts > 0
    steps.delete_document("d2")
    ingest(steps, pages.filter("document_id = 'd2'"), docs.filter("id = 'd2'"))  # deleted and brought again: as before
    for name in ("facts", "candidate_pairs", "relationships", "fact_clusters", "cluster_members"):
        assert sorted(str(r) for r in steps.read(name).collect()) == sorted(str(r) for r in whole.read(name).collect()), name


def tables_of(store):
    return {n: sorted(str(r) for r in store.read(n).collect()) for n in SCHEMAS}


def test_changes_are_all_or_nothing(spark, tmp_path, monkeypatch):
    """A change that breaks between two tables leaves what readers see, wherever it breaks; the next one cleans up."""
    store = Store(spark, str(tmp_path), buckets=4)
    pages, docs = spark.createDataFrame(PAGES[:2], SCHEMA), spark.createDataFrame([("d1", "d1.pdf"), ("d3", "d3.pdf")], "id string, filename string")
    ingest(store, pages, docs)
    old, reader = tables_of(store), store.now()
    real = Change.replace
    for fails_at in ("facts", "relationships", "diagnostics"):

        def broken(self, name, *args, fails_at=fails_at, **more):
            if name == fails_at:
                raise OSError("lost")
            real(self, name, *args, **more)

        monkeypatch.setattr(Change, "replace", broken)
        with pytest.raises(OSError):
            ingest(store, spark.createDataFrame(PAGES[2:4], SCHEMA), spark.createDataFrame([("d2", "d2.pdf"), ("d4", "d4.pdf")], "id string, filename string"))
        with pytest.raises(OSError):
            store.delete_document("d1")
        assert tables_of(store) == old
    monkeypatch.setattr(Change, "replace", real)
    with store.change() as mine:
        with store.change():
            pass
        with pytest.raises(RuntimeError):  # a second writer is told
            store._commit(mine.state)
        mine.state = store.state()
    store.delete_document("d1")
    assert {r.document_id for r in store.read("facts").collect()} == {"d3"}
    assert sorted(str(r) for r in reader.read("facts").collect()) == old["facts"]  # who opened the old snapshot reads it still


def test_one_document_touches_its_buckets(spark, tmp_path):
    """One document more in a store of 200 writes its own buckets only."""
    store = Store(spark, str(tmp_path), buckets=32)
    many = [(f"n{i}", 1, f"Company{chr(97 + i % 26)}{chr(97 + i // 26)} Works reported revenue of Rs. {i + 10} crore in FY2024.") for i in range(200)]
    ingest(store, spark.createDataFrame(many, SCHEMA), spark.createDataFrame([(d, d) for d, *_ in many], "id string, filename string"))
    before = store.state()["tables"]
    ingest(store, spark.createDataFrame(PAGES[:1], SCHEMA), spark.createDataFrame([("d1", "d1.pdf")], "id string, filename string"))
    after = store.state()["tables"]
    for name in ("documents", "facts", "cluster_members", "diagnostics"):
        changed = [b for b in after[name] if after[name][b] != before[name].get(b)]
        assert len(changed) == 1 and len(after[name]) > 25, name
    assert sum(after["fact_clusters"][b] != before["fact_clusters"].get(b) for b in after["fact_clusters"]) <= 2
    assert store.read("documents").count() == 201


def test_failed_documents(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    pages = spark.createDataFrame([("d1", 1, PAGES[0][2], None), ("bad", None, None, "no such font"), ("d3", 1, PAGES[1][2], None)], f"{SCHEMA}, error string")
    ingest(store, pages, spark.createDataFrame([(d, d) for d in ("d1", "bad", "d3", "none")], "id string, filename string"))
    assert {r.id: (r.status, r.error_message) for r in store.read("documents").collect()} == {"d1": ("COMPLETED", None), "d3": ("COMPLETED", None), "none": ("COMPLETED", None), "bad": ("FAILED", "no such font")}
    assert {r.document_id for r in store.read("facts").collect()} == {"d1", "d3"}


def test_stream_replays_change_nothing(spark, tmp_path):
    """Batches of a stream are worked in once: after a replay of the last batch, and after a failure in the middle of one."""
    store, landing, checkpoint = Store(spark, str(tmp_path / "store")), str(tmp_path / "in"), tmp_path / "checkpoint"
    land = lambda rows: spark.createDataFrame([(d, f"{d}.pdf", n, t) for d, n, t in rows], "document_id string, filename string, page_number int, text string").coalesce(1).write.mode("append").parquet(landing)
    run = lambda: watch_pages(spark, landing, store, str(checkpoint)).awaitTermination()
    land(PAGES[:2])
    run()
    land(PAGES[2:3])
    run()
    old = tables_of(store)
    assert len(old["diagnostics"]) == len(old["documents"]) == 3 and old["relationships"] and store.state()["batches"] == {"pages": 1}
    for mark in checkpoint.glob("commits/*1*"):  # as if the query had ended between the store's commit and its own
        mark.unlink()
    run()
    assert tables_of(store) == old


def test_sources(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1 one\ftwo pages here")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1 one\ftwo pages here")
    (tmp_path / "c.pdf").write_bytes(b"not a pdf")
    files = scan_files(spark, str(tmp_path)).orderBy("path")
    assert [r.filename for r in files.collect()] == ["a.pdf", "b.pdf"]
    docs = files.select(F.col("filename").alias("id"), "file_hash", F.col("filename").alias("created_at"))
    assert {r.id: r.duplicate_of for r in flag_duplicates(docs).collect()} == {"a.pdf": None, "b.pdf": "a.pdf"}
    pages = parse_pages(files.select(F.col("filename").alias("document_id"), "content"), lambda b: b.decode().split("\f"))
    totals = {r.document_id: (r.page_count, r.pages_with_text) for r in document_totals(pages).collect()}
    assert totals == {"a.pdf": (2, 2), "b.pdf": (2, 2)}

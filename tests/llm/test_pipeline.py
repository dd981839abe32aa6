"""The stages of the corpus pipeline, one after the other, each against plain Python on its own input."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_small import plain_features, vocabulary

import corpus_pipeline
from factloom.llm import mixing, simhash
from factloom.llm.common import row_hash

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, score string, size string, _size string"


def plain_toxic(rows):
    """Without labels a text is rejected for two listed or obfuscated words."""
    return [r for r in rows if not r.text or (f := plain_features(r.text))["insult_words"] + f["obfuscated_words"] < 2]


def plain_classes(rows):
    """One row of each class of fingerprints within three bits: that of the smallest id (nulls last)."""
    prints = [simhash.fingerprint(r.text, 5) for r in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if ((prints[i] ^ prints[j]) & ((1 << 64) - 1)).bit_count() <= 3:
                old, new = root[i], root[j]
                root = [new if x == old else x for x in root]
    classes = {}
    for r, x in zip(rows, root):
        classes.setdefault(x, []).append(r)
    return [min(c, key=lambda r: (r.doc_id is None, r.doc_id or 0)) for c in classes.values()]


def plain_leaks(rows, passages):
    """Without the texts that hold a passage word by word."""
    return [r for r in rows if not any(f" {p} " in f" {' '.join((r.text or '').lower().split())} " for p in passages)]


def plain_mix(rows, hashes):
    """All passes of all sources' queues in one list by virtual finish time, cut at the budget; rows that finish together
    stand or fall together. hashes: of each row, in the order of rows, what places it in its queue."""
    words = [len((r.text or "").split()) for r in rows]
    sources = sorted({r.source for r in rows}, key=lambda s: (s is None, s))
    turns = []
    for k, s in enumerate(sources):
        queue = sorted((h, i) for i, (r, h) in enumerate(zip(rows, hashes)) if r.source == s)
        size, upto = sum(words[i] for _, i in queue), 0
        for _, i in queue:
            upto += words[i]
            turns += [((e * size + upto) / (k % 3 + 1), i) for e in range(3)]
    taken, total, out = Counter(), 0, Counter()
    for at, i in turns:
        taken[at] += words[i]
    ends = []
    for at in sorted(taken):
        total += taken[at]
        if total > sum(words):
            break
        ends.append(at)
    for at, i in turns:
        if ends and at <= ends[-1]:
            out[rows[i].doc_id] += 1
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(20)
    text = vocabulary(rng, 3000)
    passages = [text(30) for _ in range(4)]
    rows = [(i, text(rng.randint(6, 90)), "aaab"[i % 4]) for i in range(40)]
    rows += [(100 + i, f"{text(9)} idiot {text(5)} you m0ron and 1d1ot {text(9)}", "a") for i in range(5)]
    rows += [(200 + i, rows[i][1].upper() if i % 2 else rows[i][1] + "  ", "c") for i in range(9)] + [rows[3]] * 4
    rows += [(300 + i, f"{text(30)} {p} {text(40)}", None) for i, p in enumerate(passages)]
    rows += [(400, None, "a"), (401, "", "b"), (402, " \n", None), (None, text(20), "d"), (403, text(30_000), "d"), (404, text(3), None)]
    path = str(tmp_path_factory.mktemp("corpus"))
    table = [(i, t, s, None, len(t or ""), "kept", str(i), "too") for i, t, s in rows]
    spark.createDataFrame(table, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, passages


def test_stages_against_plain_ones(spark, folder):
    path, passages = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    key = lambda r: repr(tuple(r))
    for name, plain in {"toxicity": plain_toxic, "near_duplicates": plain_classes, "decontamination": lambda rows: plain_leaks(rows, passages)}.items():
        before = docs.collect()
        docs = corpus_pipeline.materialise(stages[name](spark, docs, path), name)
        got = docs.collect()
        assert docs.columns == columns and sorted(map(key, got)) == sorted(map(key, plain(before))) and len(got) < len(before), name
    # a row's place in its queue goes by hashes of its columns and its words
    hashed = corpus_pipeline.set_aside(docs, corpus_pipeline.OUT)[0].withColumn("_n", mixing.words(F.col("text")))
    hashed = hashed.select("doc_id", "text", "source", row_hash(hashed, 606).alias("h"), row_hash(hashed, 607).alias("g")).collect()
    mixed = corpus_pipeline.materialise(stages["mixing"](spark, docs, path), "mixing")
    rows = mixed.collect()
    assert mixed.columns == columns and Counter(r.doc_id for r in rows) == plain_mix(hashed, [(r.h, r.g) for r in hashed])
    assert all((r.score, r["size"], r._size) == ("kept", str(r.doc_id) if r.doc_id is not None else "None", "too") for r in rows)
    last = stages["sharding"](spark, mixed, path)
    got = last.collect()
    assert sorted(map(key, last.select(*columns).collect())) == sorted(map(key, rows))
    sizes = [sum(r.shard == s for r in got) for s in range(corpus_pipeline.SHARDS)]
    assert max(sizes) - min(sizes) <= 1 and sorted((r.shard, r.slot) for r in got) == [(s, k) for s, n in enumerate(sizes) for k in range(n)]
    whole = corpus_pipeline.run(spark, path).select("doc_id", "shard", "slot").collect()
    assert sorted(map(key, whole)) == sorted(map(key, (last.select("doc_id", "shard", "slot").collect())))


def test_empty_tables_pass(spark, folder, tmp_path):
    path = folder[0]
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    for table in ("benchmark", "labels"):
        spark.read.parquet(f"{path}/{table}.parquet").limit(0).write.parquet(str(tmp_path / f"{table}.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() == 0 and {"shard", "slot"} < set(got.columns)

"""SimHash near-duplicates by anchor-point covering.

Fingerprints: one vote per word shingle of the whole text (repeats included) and bit of its XXH64.

Candidates: two fingerprints that differ in at most 3 bits differ in at most 1 bit in one half of their 64 bits. In each
32-bit half the anchors are the words of a covering code: a perfect Hamming code on 31 bits, whose every word has exactly
one code word within distance 1, times one free bit. So the covering radius is 1, and with the threshold of 1 that is left
for a half, a fingerprint is replicated to every anchor within 2: its own ("home") and 16 or fewer others. Of two
fingerprints that are close in a half, each one's home is among the anchors of the other, so comparing, per anchor, the
fingerprints at home there with all that were replicated there misses no link.

Distinct fingerprints only are replicated (copies share one). An anchor's fingerprints are compared in blocks of CHUNK:
an anchor with more is split into several keys, each pair of blocks meeting under one of them, so no task holds an
unbounded group. A comparison puts out a spanning forest of the links that it finds, not all pairs.

Components: alternating large-star and small-star steps on the links (joins and minima by key, each step written to the
shared folder) until nothing changes.

Defined results: a text without words (null, empty, white space) has fingerprint zero and is linked like any other; a text
with fewer words than the shingle is one shingle; repeated rows share fingerprint and component; a null doc_id takes part
in links but cannot be a component's smallest id unless the component has no other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import materialise, partitions, unused

CHUNK = 4096


def fingerprint(text: str | None, width: int) -> int:
    """The 64-bit fingerprint; bytes.split() splits at exactly the six white-space characters of the contract."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(width, len(words))
    stops = ends[width - 1 :].tolist()
    starts = [0, *(ends[: len(words) - width] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, stops)], ">u8")
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        votes += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprints(docs: DataFrame, width: int, to: str = "fp") -> DataFrame:
    """docs and `to`, the fingerprint of the column text as a signed long."""

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([_signed(fingerprint(t, width)) for t in texts.tolist()], dtype="int64")

    # so marked, Spark neither repeats it in a filter of its own beside the column nor takes a second Python worker a task for it
    return docs.withColumn(to, prints.asNondeterministic()("text"))


# --- the code -----------------------------------------------------------------------------------------------------------

#: Pairs of positions 1..31 whose exclusive or is s, for each syndrome s.
PAIRS = [[(i, j) for i, j in combinations(range(1, 32), 2) if i ^ j == s] for s in range(32)]


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Of 32-bit words whose bits 1..31 are the code's positions: the exclusive or of the positions that are set."""
    s = np.zeros(len(words), np.int64)
    for i in range(1, 32):
        s ^= np.where((words >> i) & 1, i, 0)
    return s


def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each 32-bit word all anchors within 2 of it: (index of the word, anchor, whether it is the word's home)."""
    s = _syndromes(words)
    home = np.where(s > 0, words ^ (np.int64(1) << s), words)
    all_ = np.arange(len(words))
    at, to, own = [all_, all_], [home, home ^ 1], [np.ones(len(words), bool), np.zeros(len(words), bool)]  # bit 0 is the free one
    for k in range(15):
        far = np.flatnonzero(s > 0)
        first, second = (np.array([PAIRS[x][k][side] if x else 0 for x in range(32)], np.int64)[s[far]] for side in (0, 1))
        at.append(far)
        to.append(words[far] ^ (np.int64(1) << first) ^ (np.int64(1) << second))
        own.append(np.zeros(len(far), bool))
    return np.concatenate(at), np.concatenate(to), np.concatenate(own)


def replicate(prints: DataFrame) -> DataFrame:
    """(half, anchor, fp, home) for each distinct fingerprint."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(whole), 50_000):
                fp = whole[at : at + 50_000]
                for half in (0, 1):
                    index, to, own = anchors((fp >> (32 * half)) & np.int64(0xFFFFFFFF))
                    yield pa.RecordBatch.from_arrays([pa.array(to * 2 + half), pa.array(fp[index]), pa.array(own)], ["anchor", "fp", "home"])

    return prints.mapInArrow(spread, "anchor long, fp long, home boolean")


def links_at_anchors(prints: DataFrame, threshold: int, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b), a > b, whose connected components are those of all pairs of fingerprints within the threshold."""
    spark = prints.sparkSession
    spread = materialise(replicate(prints), "anchors")
    large = spread.groupBy("anchor").agg(F.count("*").alias("_n")).filter(F.col("_n") > chunk).select("anchor", F.ceil(F.col("_n") / chunk).cast("int").alias("_parts"))
    # few anchors are large, but nothing bounds their number: Spark broadcasts them only if their measured size allows it
    keyed = spread.join(large, "anchor", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("_parts")).cast("int")
    others = F.sequence(F.lit(0), F.col("_parts") - 1)
    cell = F.when(F.col("home"), F.transform(others, lambda j: F.struct(mine.alias("i"), j.alias("j"), F.lit(True).alias("home"))))
    cells = F.concat(F.coalesce(cell, F.array().cast("array<struct<i:int,j:int,home:boolean>>")), F.transform(others, lambda i: F.struct(i.alias("i"), mine.alias("j"), F.lit(False).alias("home"))))
    split = keyed.select("anchor", "fp", F.explode(cells).alias("_c")).select("anchor", F.col("_c.i").alias("i"), F.col("_c.j").alias("j"), F.col("_c.home").alias("home"), "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("anchor", "i", "j", "home", "fp")])
            new = np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(0)) + 1
            cuts = [0, *new.tolist(), rows.shape[1]]
            out_a, out_b = [], []
            for a, b in zip(cuts, cuts[1:]):
                part = rows[:, a:b]
                if held and (held[-1][:3, -1] != part[:3, 0]).any():
                    forest(np.concatenate([h[3:] for h in held], 1), threshold, out_a, out_b)
                    held = []
                held.append(part)
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])
        out_a, out_b = [], []
        if held:
            forest(np.concatenate([h[3:] for h in held], 1), threshold, out_a, out_b)
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    dealt = split.repartition(partitions(spark), "anchor", "i", "j").sortWithinPartitions("anchor", "i", "j")
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def forest(group: np.ndarray, threshold: int, out_a: list[int], out_b: list[int]) -> None:
    """Append a spanning forest of the links between a group's home fingerprints and all its fingerprints.
    group: rows home (0/1) and fingerprint. Links point from the larger to the smallest of the tree."""
    home = group[0].astype(bool)
    if group.shape[1] < 2 or not home.any():
        return
    ours, all_ = np.unique(group[1][home]), np.unique(group[1])
    if len(all_) < 2:
        return
    parent = np.arange(len(all_))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    where, step = np.searchsorted(all_, ours), max(1, 2_000_000 // len(all_))
    for at in range(0, len(ours), step):
        near = np.bitwise_count((ours[at : at + step, None] ^ all_[None, :]).view(np.uint64)) <= threshold
        for x, y in zip(*np.nonzero(near)):
            u, v = find(where[at + x]), find(y)
            if u != v:
                parent[max(u, v)] = min(u, v)
    roots = np.array([find(x) for x in range(len(all_))])
    for x in np.flatnonzero(roots != np.arange(len(all_))).tolist():
        out_a.append(int(all_[x]))
        out_b.append(int(all_[roots[x]]))


def components(links: DataFrame) -> DataFrame:
    """(node, root): for each node of the links the smallest node of its connected component."""
    edges = materialise(links.select("a", "b"), "links")
    last = None
    while True:
        # large star: every larger neighbour of a node is linked to the node's smallest neighbour, or the node itself
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        # small star: a node and its smaller neighbours are linked to the smallest of them
        large = materialise(large.filter("a != b").distinct(), "star")
        least = large.groupBy("a").agg(F.min("b").alias("_m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("_m").alias("b")).unionByName(least.select("a", F.col("_m").alias("b")))
        edges = materialise(small.filter("a != b").distinct(), "star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:  # the same links as before: every tree is a star round its smallest node
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = now


def near_duplicates(rows: DataFrame, threshold: int = 3) -> DataFrame:
    """rows (doc_id, fp) with component_id, the smallest doc_id that can be reached by links, and root, the class's smallest
    fingerprint."""
    rows = materialise(rows, "prints")
    prints = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    trees = components(links_at_anchors(prints.select("fp"), threshold))
    rooted = prints.join(trees, prints.fp == trees.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted, "rooted")
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(rooted.join(names, "root").select("fp", "root", "component_id"), "fp")


def deduplicate(docs: DataFrame, width: int = 5, threshold: int = 3) -> DataFrame:
    """docs without all but one row of each class: a row with the class's smallest doc_id stays.

    Width and threshold are those of the operator's contract for pipelines (five-word shingles, 3 bits: a similarity well
    over 0.8). All texts without words share fingerprint zero and so are one class, of which one row stays. Of rows that share
    the class's smallest doc_id, one stays. All columns pass through unchanged, whatever their names.
    """
    fp, own, print_ = unused(docs, "fp", "own", "print")
    marked = with_fingerprints(docs, width, fp)
    classes = near_duplicates(marked.select("doc_id", F.col(fp).alias("fp")), threshold)
    first = F.min_by(F.struct("doc_id", "fp"), F.struct(F.col("doc_id").isNull(), "doc_id", "fp"))
    stay = classes.groupBy("root").agg(first.alias("s")).select(F.col("s.doc_id").alias(own), F.col("s.fp").alias(print_))
    kept = marked.join(stay, F.col("doc_id").eqNullSafe(F.col(own)) & (F.col(fp) == F.col(print_)), "left_semi")
    return kept.dropDuplicates(["doc_id", fp]).drop(fp)


def op7_simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marked = with_fingerprints(docs, 3).drop("text")
    return near_duplicates(marked).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

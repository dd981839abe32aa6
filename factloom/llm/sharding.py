"""Reproducible shuffle and sharding by a Feistel permutation over global row numbers (DataFrame functions only).

Rows are numbered 0..n-1 in the order of two hashes of the whole row (ties: equal rows, which are interchangeable; two rows
that differ share both hashes with a chance of 2^-128), so the numbering depends on the rows alone, not on how they are
partitioned. A Feistel network over Z_a x Z_b (a*b just above n)
permutes the numbers; a value that falls on n or above is permuted again (cycle walking). The position p gives
shard = p mod k and slot = p div k: shard sizes differ by one row at most, slots have no gaps, and either can be computed
from a row number alone without looking at another row.

Defined results: an empty table gives an empty result; null and empty texts are rows like any other; repeated rows get
places of their own; very long texts are hashed whole. Input columns named `shard` or `slot` are replaced by the output;
all others pass through unchanged, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import number_rows, row_hash, unused, utf8_bytes

ROUNDS = 8


def halves(n: int) -> tuple[int, int]:
    """Sides a, b of the smallest near-square grid with at least n cells."""
    a = max(1, math.isqrt(n - 1) + 1) if n else 1
    return a, max(1, -(-n // a))


def feistel(x: Column, n: int, seed: int, rounds: int = ROUNDS) -> Column:
    """One pass of the network over 0..a*b-1: alternately each half is shifted by a keyed hash of the other."""
    a, b = (F.lit(v).cast("long") for v in halves(n))
    start = F.struct((x % a).alias("left"), F.expr("0L").alias("right")).withField("right", F.floor(x / a).cast("long"))

    def turn(s: Column, k: Column) -> Column:
        shift = lambda other, side: F.pmod(F.xxhash64(other, k, F.lit(seed).cast("long")), side)
        left = F.when(k % 2 == 0, (s["left"] + shift(s["right"], a)) % a).otherwise(s["left"])
        right = F.when(k % 2 == 1, (s["right"] + shift(s["left"], b)) % b).otherwise(s["right"])
        return F.struct(left.alias("left"), right.alias("right"))

    keys = F.array(*[F.lit(k) for k in range(rounds)])
    return F.aggregate(keys, start, turn, lambda s: s["right"] * a + s["left"])


def walks(spark: SparkSession, n: int, seed: int) -> int:
    """How often a value below n may have to be permuted again.

    Each of the fewer than sqrt(n)+1 cells from n on is permuted once; what remains is to follow these images. Chains that
    start at a cell which no other outer cell leads to are the only ones that a value below n can enter; a cycle that lies
    wholly among the outer cells is none, and is not walked.
    """
    a, b = halves(n)
    leads = {r.id: r.x for r in spark.range(n, a * b).select("id", feistel(F.col("id"), n, seed).alias("x")).collect()}
    longest = 0
    for cell in leads.keys() - set(leads.values()):
        steps = 0
        while cell >= n:
            cell, steps = leads[cell], steps + 1
        longest = max(longest, steps)
    return longest


def permuted(spark: SparkSession, x: Column, n: int, seed: int) -> Column:
    """The place of row number x in a shuffle of 0..n-1."""
    first, steps = feistel(x, n, seed), walks(spark, n, seed)
    if not steps:
        return first
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, lambda y, _: F.when(y < n, y).otherwise(feistel(y, n, seed)))


def shard_rows(df: DataFrame, shards: int, seed: int = 20240) -> DataFrame:
    """df with `shard` (0..shards-1) and `slot` (0.. without gaps in each shard)."""
    df = df.drop("shard", "slot")
    first, second, rank, place = unused(df, "first", "second", "rank", "place")
    hashed = df.withColumns({first: row_hash(df, seed), second: row_hash(df, seed + 1)})
    ranked, n = number_rows(hashed, [first, second], "shards", rank)
    return (
        ranked.withColumn(place, permuted(df.sparkSession, F.col(rank), max(n, 1), seed))
        .withColumn("shard", (F.col(place) % shards).cast("int"))
        .withColumn("slot", F.floor(F.col(place) / shards).cast("long"))
        .drop(first, second, rank, place)
    )


def op2_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards whose row counts differ by one at most (law `rows`)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", (utf8_bytes(F.col("text")) + 8).alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    return shard_rows(rows, 24).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

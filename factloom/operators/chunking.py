"""Chunks of pages: short pages whole, long ones as overlapping runs of sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import vocab as V
from factloom.functions.text import sentences, strip, word_count
from factloom.session import once


def pack(parts: Column, sizes: Column, limit: int, overlap: int) -> Column:
    """Runs of sentences (`sizes` are their words) of at most `limit` words; each run starts with the last sentences of the one
    before that make up at most `overlap` words.

    One pass over the sentences that keeps the finished runs as texts, the open run and its words: a sentence costs a step over the
    open run alone, and only a run that closes looks back over its sentences. (Taking slices of the whole array instead would copy
    it for each run.)"""
    nothing = F.array().cast("array<struct<s:string,n:int>>")
    start = F.struct(F.array().cast("array<string>").alias("done"), nothing.alias("open"), F.lit(0).alias("words"))
    text = lambda run: F.array(F.array_join(F.transform(run, lambda x: x["s"]), " "))

    def tail(run: Column) -> Column:
        """The last sentences that fit the overlap, and their words."""
        state = lambda kept, words, full: F.struct(kept.alias("kept"), words.alias("words"), F.lit(full).alias("full"))
        return F.aggregate(
            F.reverse(run), state(nothing, F.lit(0), False),
            lambda a, x: F.when(a["full"] | (a["words"] + x["n"] > overlap), state(a["kept"], a["words"], True)).otherwise(state(F.concat(F.array(x), a["kept"]), a["words"] + x["n"], False)),
        )

    def step(a: Column, x: Column) -> Column:
        full = (F.size(a["open"]) > 0) & (a["words"] + x["n"] > limit)
        kept = tail(a["open"])
        closed = F.struct(F.concat(a["done"], text(a["open"])).alias("done"), F.concat(kept["kept"], F.array(x)).alias("open"), (kept["words"] + x["n"]).alias("words"))
        return F.when(full, closed).otherwise(F.struct(a["done"].alias("done"), F.concat(a["open"], F.array(x)).alias("open"), (a["words"] + x["n"]).alias("words")))

    sized = F.zip_with(parts, sizes, lambda s, n: F.struct(s.alias("s"), n.alias("n")))
    return F.aggregate(sized, start, step, lambda a: F.when(F.size(a["open"]) > 0, F.concat(a["done"], text(a["open"]))).otherwise(a["done"]))


def chunk_pages(pages: DataFrame, limit: int = V.CHUNK_WORDS, overlap: int = V.OVERLAP_WORDS) -> DataFrame:
    """(document_id, page_number, chunk_ordinal, start_page, end_page, chunk_id, text, word_count, whole) for pages with text;
    `whole` where the chunk is all of its page."""
    p = once(pages.select("document_id", "page_number", F.col("text").alias("_raw")), "_body", strip(F.col("_raw")))
    short = F.length("_body") < 2 * limit  # more words would need more characters
    p = once(p.filter("_body != ''"), "whole", short | (word_count(F.col("_body")) <= limit)).drop("_raw")
    split = once(p.filter("not whole"), "_s", sentences(F.col("_body"))).withColumn("_w", F.transform("_s", word_count))
    split = split.select("document_id", "page_number", "whole", F.posexplode(pack(F.col("_s"), F.col("_w"), limit, overlap)).alias("chunk_ordinal", "text"))
    out = p.filter("whole").select("document_id", "page_number", "whole", F.lit(0).alias("chunk_ordinal"), F.col("_body").alias("text")).unionByName(split)
    key = F.sha2(F.concat_ws("\u0001", F.col("document_id").cast("string"), "page_number", "chunk_ordinal", "text"), 256)
    return out.select("document_id", "page_number", "chunk_ordinal", F.col("page_number").alias("start_page"), F.col("page_number").alias("end_page"), key.alias("chunk_id"), "text", word_count(F.col("text")).alias("word_count"), "whole")

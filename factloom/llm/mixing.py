"""Mix sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash and pass up to `epochs` times. The virtual finish time of a document in
epoch e is (e * source size + words up to and with it) / weight of the source. Taking documents in the order of virtual
time, as a fair queue would, gives each source words in proportion to its weight until its epochs are used up; the mix ends
where the words taken reach the budget, here the words of all documents. That is the water-filling rule of the targets:
target = min(epochs * source size, level * weight), the level such that the targets sum to the budget.

Three running sums do all of it, each over a range-sort whose ranges follow the table's size: words by (source, hash) give
the places in each source's queue, words by virtual time give the end of the mix, and sizes and weights of the sources by
the time at which they are used up give the level. No task sees a whole source; rows with equal keys may be split.

Defined results: null or empty texts have size 0 and are taken with no words; a null source is a source of its own, the
last in order; equal rows are interchangeable; an empty table gives an empty result. Input columns named as the output
columns (size, source_size, weight, target, copies, taken) are replaced; all others pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import WORD, materialise, number_rows, row_hash, running_sums, unused

OUT = ["size", "source_size", "weight", "target", "copies", "taken"]


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, epochs: int, cycle: int) -> tuple[DataFrame, float, int]:
    """sized: source and size. One row for each source with its size, weight and target, and the words of the sources before
    it; the level; the budget."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("last", F.col("source").isNull())
    ranked, _ = number_rows(sums, ["last", "source"], "sources", "rank")
    own = ranked.withColumns({"weight": (F.col("rank") % cycle + 1).cast("double"), "most": F.col("source_size") * epochs})
    own = running_sums(own, ["rank"], {"source_size": "upto"}, "weights").withColumn("before", F.col("upto") - F.col("source_size"))
    budget = int(own.agg(F.sum("source_size")).first()[0] or 0)
    # sources by the virtual time at which they are used up; those used up at one time make one row
    turns = own.groupBy((F.col("most") / F.col("weight")).alias("at")).agg(F.sum("most").cast("double").alias("most"), F.sum("weight").alias("weight"))
    turns = running_sums(turns, ["at"], {"most": "most_upto", "weight": "weight_upto"}, "turns")
    total = turns.agg(F.sum("weight")).first()[0] or 0.0
    taken = F.col("most_upto") + F.col("at") * (total - F.col("weight_upto"))
    level = (budget - (F.col("most_upto") - F.col("most"))) / (total - (F.col("weight_upto") - F.col("weight")))
    # sums of doubles may fall short by their rounding
    level = turns.filter(taken >= budget * (1 - 1e-12)).agg(F.min_by(level, "at")).first()[0] or 0.0
    return own.withColumn("target", F.least(F.col("most").cast("double"), F.lit(level) * F.col("weight"))).select("source", "source_size", "weight", "target", "before"), level, budget


def mix(docs: DataFrame, size: Column | None = None, epochs: int = 3, cycle: int = 3, seed: int = 606) -> DataFrame:
    """docs (with a source, and a text unless `size` gives the words of a row) and for each row its size, its source's size,
    weight and target, and how often and with how many words the mix takes it."""
    n, last, first, second, upto, before, name = unused(docs, "n", "last", "first", "second", "upto", "before", "name")
    docs = docs.withColumn(n, words(F.col("text")) if size is None else size).drop(*OUT)
    docs = docs.withColumns({last: F.col("source").isNull(), first: row_hash(docs, seed), second: row_hash(docs, seed + 1)})
    queue = running_sums(docs, [last, "source", first, second], {n: upto}, "queue")
    own, level, budget = targets(queue.select("source", F.col(n).alias("size")), epochs, cycle)
    own = materialise(own.withColumnsRenamed({"source": name, "before": before}), "targets")  # written first, so that Spark knows its size
    placed = queue.join(own, F.col("source").eqNullSafe(F.col(name))).withColumn(upto, F.col(upto) - F.col(before))

    def finish(epoch: Column | int) -> Column:
        return (epoch * F.col("source_size") + F.col(upto)) / F.col("weight")

    turns = placed.select(F.col(n).alias("size"), F.explode(F.array(*[finish(F.lit(e)) for e in range(epochs)])).alias("at"))
    end = _end(turns, level, budget)
    copies = sum((F.when(finish(F.lit(e)) <= end, 1).otherwise(0) for e in range(epochs)), F.lit(0))
    mixed = placed.withColumn("copies", copies).withColumnRenamed(n, "size").withColumn("taken", (F.col("size") * F.col("copies")).cast("long"))
    return mixed.drop(last, first, second, upto, before, name)


def _end(turns: DataFrame, level: float, budget: int) -> float:
    """The last virtual time at which all that has finished still fits the budget. Those that share a time stand or fall
    together. The end lies just beyond the level, so what finishes far beyond it is sorted only if need be."""
    horizon, farthest = 1.25 * level, turns.agg(F.max("at")).first()[0]
    while farthest is not None:
        near = running_sums(turns.filter(F.col("at") <= horizon), ["at"], {"size": "upto"}, "times")
        over = near.filter(F.col("upto") > budget).agg(F.min("at")).first()[0]
        if over is not None or horizon >= farthest:
            end = (near if over is None else near.filter(F.col("at") < over)).agg(F.max("at")).first()[0]
            return -1.0 if end is None else end
        horizon = max(2 * horizon, 1.0)
    return -1.0


def repeat(mixed: DataFrame) -> DataFrame:
    """Each row as often as the mix takes it."""
    copy = unused(mixed, "copy")[0]
    return mixed.filter("copies > 0").withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("copies")))).drop(copy)


def op6_fair_queue_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # written first: a range-sort reads its input twice
    rows = materialise(docs.select("doc_id", "source", words(F.col("text")).alias("words"), F.xxhash64("text").alias("text")), "rows")
    return mix(rows, F.col("words")).select("doc_id", "size", "source_size", "target", "taken", "weight", "copies")

"""Nearest neighbours by inner product from randomly rotated one-bit codes, with error bounds and exact reranking.

Index: vectors of one length are dealt to lists by their nearest centre. The centres are fitted by k-means on a bounded
sample (at most FIT_FLOATS numbers, chosen by hash); every vector is indexed. What a vector differs from its centre by is
rotated by one random orthogonal matrix and reduced to the signs of its coordinates (packed bits) and two scalars: its
length r and the inner product f of its unit vector with its code. There are about sqrt(n) lists for n vectors.

Estimate: for a query q whose rotation q' is cut to PLANES bits a coordinate, <q, o> = <q, centre> + r <q', code> / f, and
<q', code> comes from counting bits that the packed code shares with each bit plane of q'. Its error is at most
r |q| sqrt(1 - f^2) / f (Cauchy-Schwarz), and about EPSILON / sqrt(d - 1) of that but for chance of the rotation; the
latter is the bound used, together with the same for what the cut of q' leaves out. With d - 1 <= EPSILON^2 it is the
certain one. Every vector of a searched list whose upper bound reaches the query's threshold is reranked, uncapped: its
exact inner product is taken in double precision from the original vectors.

Search, in two passes. Within a list, inner products with q scatter about <q, centre> with a deviation of |q| times the
list's root mean square r / sqrt(d). From this follows how many of a query's neighbours a list can be expected to hold. The
first pass searches the lists that hold FIRST of them; the k-th best found is the query's threshold, and no neighbour lies
below it. The second searches as many further lists as make up RECALL of the vectors expected above that threshold. Queries
with fewer than k candidates in the first pass search all lists.

Hot groups: equal vectors are one entry with the k + 1 smallest of its ids, as no other can be among k nearest; lists are
cut into pieces of at most BLOCK entries, and the queries of a list into parts of about QUERIES, so a task's memory and
work do not grow with a list. Queries pass as a stream; only one piece is held.

Recall against brute force (sf0.01, sf0.1, check_s and check_l; all queries, k 20) is in the README; it is at least 0.93.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part as query or
candidate; vectors of another length than the query's are not candidates; ties go to the smaller vec_id; a query is not
its own candidate, nor are rows with its vec_id; repeated vec_ids are searched once per row, and count as candidates once
per row; a null vec_id takes part as a candidate only, after all others of its score; an empty table gives an empty
result. Columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import materialise, partitions

BLOCK, QUERIES, PLANES, EPSILON = 8192, 2048, 5, 2.0
FIRST, RECALL, FIT_FLOATS, TURNS = 0.25, 0.97, 8_000_000, 4
SEED = 88


@dataclass
class Index:
    entries: DataFrame  # list, piece, d, embedding, ids, bits, length, f: one row per distinct vector
    centres: dict[int, np.ndarray]  # d to lists x d
    first: dict[int, int]  # d to the number of its first list
    sizes: dict[int, np.ndarray]  # d to the vectors in each list
    spread: dict[int, np.ndarray]  # d to each list's deviation of inner products with a unit vector
    pieces: dict[int, int]  # of the lists that have several


def rotation(d: int) -> np.ndarray:
    """A random orthogonal matrix; the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng(SEED + d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def vectors_of(column: pa.ListArray, d: int) -> np.ndarray:
    """A batch's vectors of length d as rows in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of 0 and 1 as bytes, filled up to whole 64-bit words."""
    rows = np.packbits(bits, axis=1)
    return np.pad(rows, ((0, 0), (0, -rows.shape[1] % 8)))


def encode(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each vector's difference from its centre: packed signs of the rotation, length, inner product of unit vector and code."""
    turned = (vectors - centres) @ rotation(vectors.shape[1]).T
    length = np.linalg.norm(turned, axis=1)
    f = np.abs(turned).sum(1) / (sqrt(vectors.shape[1]) * np.maximum(length, 1e-300))
    return packed(turned >= 0), length, np.where(length > 0, f, 1.0)


def cut(queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit planes of the rotated queries (query, plane, byte), and for each query: step, lowest value, sum of what the planes
    stand for, length of what they leave out, length of the query."""
    turned = queries @ rotation(queries.shape[1]).T
    low = turned.min(1)
    step = np.maximum(turned.max(1) - low, 1e-300) / (2**PLANES - 1)
    units = np.rint((turned - low[:, None]) / step[:, None]).astype(np.int64)
    kept = low[:, None] + step[:, None] * units
    planes = np.stack([packed(units >> k & 1) for k in range(PLANES)], axis=1)
    return planes, np.stack([step, low, kept.sum(1), np.linalg.norm(turned - kept, axis=1), np.linalg.norm(queries, axis=1)], axis=1)


def upper_and_slack(planes: np.ndarray, scalars: np.ndarray, at_centre: np.ndarray, bits: np.ndarray, length: np.ndarray, f: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Upper bounds of <q, o> for queries (rows) and codes (columns), and by how much the lower ones lie below."""
    words, codes = planes.view(np.uint64), bits.view(np.uint64)
    shared = np.zeros((len(planes), len(codes)), np.int32)
    for k in range(PLANES):
        for w in range(codes.shape[1]):
            shared += np.bitwise_count(words[:, k, w, None] & codes[None, :, w]).astype(np.int32) << k
    step, low, total, left, size = (x.astype(np.float32) for x in scalars.T)
    ones = np.bitwise_count(codes).sum(1).astype(np.float32)
    along = (2 * step)[:, None] * shared + ((2 * low)[:, None] * ones[None, :] - total[:, None])
    share, reach = min(1.0, EPSILON / sqrt(max(d - 1, 1))), (length / f).astype(np.float32)
    slack = np.float32(share) * (size[:, None] * (reach * np.sqrt(np.maximum(1 - f * f, 0)).astype(np.float32))[None, :] + left[:, None] * reach[None, :]) + 1e-5 * size[:, None]
    return at_centre.astype(np.float32)[:, None] + along * (reach / np.float32(sqrt(d)))[None, :] + slack, 2 * slack


# --- the index ------------------------------------------------------------------------------------------------------------


def _usable(e: Column) -> Column:
    return e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)


def centres_of(sample: np.ndarray, lists: int) -> np.ndarray:
    """k-means: a few turns from a choice of the sample's vectors."""
    centres = sample[np.random.default_rng(SEED).permutation(len(sample))[:lists]].copy()
    for _ in range(TURNS):
        owner = nearest(sample, centres)
        order = np.argsort(owner, kind="stable")
        held, begin = np.unique(owner[order], return_index=True)
        sums = np.add.reduceat(sample[order], begin, axis=0)
        centres[held] = sums / np.diff(np.append(begin, len(order)))[:, None]
    return centres


def nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each vector."""
    half, out = 0.5 * (centres * centres).sum(1), []
    step = max(1, 4_000_000 // len(centres))
    for a in range(0, len(vectors), step):
        out.append(np.argmax(vectors[a : a + step] @ centres.T - half, axis=1))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def build_index(vectors: DataFrame, k: int = 20) -> Index:
    """vectors: vec_id and embedding. For searches of up to k nearest."""
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding").filter(_usable(F.col("embedding")))
    # of equal vectors only the k + 1 smallest ids, each as often as k times, can be among k nearest; counted before they are ranked
    times = rows.groupBy("embedding", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("times"))
    ranked = times.withColumn("place", F.row_number().over(Window.partitionBy("embedding").orderBy(F.asc_nulls_last("vec_id")))).filter(F.col("place") <= k + 1)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "vec_id", "times"))), lambda x: F.array_repeat(x["vec_id"], x["times"]))
    entries = materialise(ranked.groupBy("embedding").agg(F.flatten(listed).alias("ids")).withColumn("d", F.size("embedding")), "vectors")
    counts = {r.d: r.n for r in entries.groupBy("d").agg(F.count("*").alias("n")).collect()}  # a row for each length of vectors

    # one row for each length of vectors
    limits = [(d, int(min(1.0, FIT_FLOATS / (len(counts) * d * n)) * (1 << 30))) for d, n in counts.items()]
    chosen = entries.join(F.broadcast(spark.createDataFrame(limits, "d int, most int")), "d").filter(F.pmod(F.xxhash64("embedding", F.lit(SEED)), F.lit(1 << 30)) < F.col("most"))
    taken: dict[int, list] = {d: [] for d in counts}
    for r in chosen.select("d", "embedding").orderBy("embedding").toLocalIterator():
        taken[r.d].append(np.array(r.embedding, np.float32))
    centres, first = {}, {}
    for d, n in sorted(counts.items()):
        lists = max(1, min(round(sqrt(n)), len(taken[d]) // 8))
        centres[d] = centres_of(np.stack(taken[d]), lists) if lists > 1 else np.zeros((1, d), np.float32)
        first[d] = sum(len(c) for c in centres.values()) - len(centres[d])
    sent = spark.sparkContext.broadcast((centres, first))  # of the sample's size at most

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, first = sent.value
        for batch in batches:
            lengths = batch.column("d").to_numpy()
            for d in np.unique(lengths).tolist():
                rows = batch.filter(pa.array(lengths == d))
                vectors = vectors_of(rows.column("embedding"), d)
                owner = nearest(vectors.astype(np.float32), centres[d])
                bits, length, f = encode(vectors, centres[d][owner])
                new = [pa.array(owner + first[d], pa.int64()), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(length), pa.array(f)]
                yield pa.RecordBatch.from_arrays([*rows.columns, *new], [*rows.schema.names, "list", "bits", "length", "f"])

    kind = entries.schema["embedding"].dataType.simpleString()
    coded = materialise(entries.mapInArrow(code, f"embedding {kind}, ids array<long>, d int, list long, bits binary, length double, f double"), "codes")
    # a row for each list: as many as there are centres
    lists = materialise(coded.groupBy("d", "list").agg(F.count("*").alias("n"), F.ceil(F.count("*") / BLOCK).cast("int").alias("pieces"), F.avg(F.col("length") * F.col("length")).alias("square")), "lists")
    sizes, spread, pieces = {d: np.zeros(len(c), np.int64) for d, c in centres.items()}, {d: np.zeros(len(c)) for d, c in centres.items()}, {}
    for r in lists.toLocalIterator():
        sizes[r.d][r.list - first[r.d]], spread[r.d][r.list - first[r.d]] = r.n, sqrt(r.square / r.d)
        if r.pieces > 1:
            pieces[r.list] = r.pieces
    placed = coded.join(F.broadcast(lists.select("list", "pieces")), "list").withColumn("piece", F.pmod(F.xxhash64("embedding"), F.col("pieces")).cast("int")).drop("pieces")
    return Index(placed, centres, first, sizes, spread, pieces)


# --- the search -----------------------------------------------------------------------------------------------------------


def _tail(x: np.ndarray) -> np.ndarray:
    """The share of a normal distribution above x deviations, to about 1e-3 of it (logistic form)."""
    return 1 / (1 + np.exp(np.clip(1.5976 * x + 0.070566 * x**3, -50, 50)))


def lists_to_search(at_centres: np.ndarray, length: np.ndarray, sizes: np.ndarray, spread: np.ndarray, k: int, least: np.ndarray | None) -> np.ndarray:
    """(query, list) booleans. Without `least`, the lists of the first pass; with it (each query's threshold), those of both."""
    deviation = np.maximum(length[:, None] * spread[None, :], 1e-12)
    expected = lambda t: sizes[None, :] * _tail((t[:, None] - at_centres) / deviation)
    if least is None:
        low, high = (at_centres - 8 * deviation).min(1), (at_centres + 8 * deviation).max(1)
        for _ in range(30):  # the threshold above which k vectors are expected
            mid = (low + high) / 2
            more = expected(mid).sum(1) > k
            low, high = np.where(more, mid, low), np.where(more, high, mid)
        hits = expected(low)
    else:
        hits = expected(least)
    order = np.argsort(-hits, axis=1, kind="stable")
    sums = np.cumsum(np.take_along_axis(hits, order, 1), axis=1)
    if least is None:  # enough lists for FIRST, and for k vectors several times over
        held = np.cumsum(sizes[order], axis=1)
        done = (sums >= FIRST * sums[:, -1:]) & (held >= 4 * (k + 1))
    else:
        done = (sums >= RECALL * sums[:, -1:]) & np.isfinite(least)[:, None]
    n = np.minimum((~done).sum(1) + 1, len(sizes))
    chosen = np.zeros(hits.shape, bool)
    np.put_along_axis(chosen, order, np.arange(len(sizes))[None, :] < n[:, None], 1)
    return chosen & (sizes > 0)[None, :]


def search(index: Index, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries (vec_id, embedding) its k nearest in the index."""
    spark = queries.sparkSession
    usable = queries.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & _usable(F.col("embedding")))
    asked = materialise(usable.withColumn("d", F.size("embedding")), "queries").withColumn("row", F.monotonically_increasing_id())
    asked = materialise(asked, "asked")
    kind = asked.schema["embedding"].dataType.simpleString()
    sent = spark.sparkContext.broadcast((index.centres, index.first, index.sizes, index.spread, index.pieces))
    probe = f"list long, piece int, row long, vec_id long, d int, embedding {kind}, at double, least double, planes binary, scalars array<double>"

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, first, sizes, spread, pieces = sent.value
        for batch in batches:
            lengths = batch.column("d").to_numpy()
            for d in [d for d in np.unique(lengths).tolist() if d in centres]:
                rows = batch.filter(pa.array(lengths == d))
                for a in range(0, rows.num_rows, max(1, 500_000 // len(centres[d]))):
                    part = rows.slice(a, max(1, 500_000 // len(centres[d])))
                    q = vectors_of(part.column("embedding"), d)
                    at, length = q @ centres[d].T.astype(float), np.linalg.norm(q, axis=1)
                    chosen = lists_to_search(at, length, sizes[d], spread[d], k, None)
                    least = part.column("least").to_numpy(zero_copy_only=False)
                    if not np.isnan(least).any():
                        chosen = lists_to_search(at, length, sizes[d], spread[d], k, least) & ~chosen
                    i, j = np.nonzero(chosen)
                    number = j + first[d]
                    parts = np.array([pieces.get(x, 1) for x in number.tolist()], np.int64)
                    i, j, number = (np.repeat(x, parts) for x in (i, j, number))
                    piece = np.arange(len(i)) - np.repeat(np.cumsum(parts) - parts, parts)
                    planes, scalars = cut(q)
                    pick = pa.array(i)
                    own = [part.column(c).take(pick) for c in ("row", "vec_id", "d", "embedding")]
                    more = [pa.array(at[i, j]), part.column("least").take(pick), pa.array([p.tobytes() for p in planes], pa.binary()).take(pick), pa.array(list(scalars), pa.list_(pa.float64())).take(pick)]
                    yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(piece, pa.int32()), *own, *more], [c.split()[0] for c in probe.split(", ")])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by piece, its entries before its queries."""
        key, held, piece = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("list", "piece", "part")])
            asks = batch.column("row").is_valid().to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0) | (asks[1:] != asks[:-1])) + 1).tolist(), batch.num_rows]
            out = []
            for a, b in zip(cuts, cuts[1:]):
                run, now = batch.slice(a, b - a), tuple(keys[:, a].tolist())
                if now != key:
                    key, held, piece = now, [], None
                if not asks[a]:
                    held.append(run)
                elif held:
                    piece = piece or Piece(held)
                    out += piece.best(run, k)
            if out:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([o[c] for o in out]) for c in range(4)], ["row", "query_id", "score", "ids"])

    def searched(asked: DataFrame) -> DataFrame:
        """(row, query_id, score, ids): the best k + 1 entries of each piece for each query that searches it."""
        asks = materialise(asked.mapInArrow(probes, probe), "probes")
        crowds = asks.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts")).filter("parts > 1")  # lists at most: as bounded as the centres
        crowds = F.broadcast(materialise(crowds, "crowds"))
        parts = F.coalesce("parts", F.lit(1))
        asks = asks.join(crowds, "list", "left").withColumn("part", F.pmod(F.xxhash64("row"), parts).cast("int")).drop("parts")
        wanted = asks.select("list", "piece", "part").distinct()
        codes = index.entries.select("list", "piece", "d", "embedding", "ids", "bits", "length", "f").join(wanted, ["list", "piece"])
        rows = codes.unionByName(asks, allowMissingColumns=True)
        dealt = rows.repartition(partitions(spark), "list", "piece", "part").sortWithinPartitions("list", "piece", "part", F.asc_nulls_first("row"))
        names = ["list", "piece", "part", "row", "vec_id", "d", "embedding", "at", "least", "planes", "scalars", "ids", "bits", "length", "f"]
        return dealt.select(*names).mapInArrow(look, "row long, query_id long, score double, ids array<long>")

    def neighbours(found: DataFrame) -> DataFrame:
        each = found.select("row", "query_id", "score", F.explode("ids").alias("vec_id")).filter(~F.col("vec_id").eqNullSafe(F.col("query_id")))
        order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
        return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    near = materialise(searched(asked.withColumn("least", F.lit(float("nan")))), "near")
    least = neighbours(near).groupBy("row").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
    further = asked.join(least, "row", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    return neighbours(near.unionByName(searched(further))).select("query_id", "rank", "vec_id", "score")


class Piece:
    """The entries of one piece of a list, and the search in it."""

    def __init__(self, runs: list[pa.RecordBatch]):
        self.d = runs[0].column("d")[0].as_py()
        join = lambda c: pa.concat_arrays([r.column(c) for r in runs])
        self.vectors, self.ids = vectors_of(join("embedding"), self.d), join("ids")
        self.length, self.f = join("length").to_numpy(), join("f").to_numpy()
        self.bits = np.frombuffer(b"".join(join("bits").to_pylist()), np.uint8).reshape(len(self.length), -1)

    def best(self, asks: pa.RecordBatch, k: int) -> list[list[pa.Array]]:
        """For each query the exact best k + 1 (one of them may be the query itself) of the entries that its bounds allow."""
        out, step = [], max(1, 1_000_000 // len(self.length))
        for a in range(0, asks.num_rows, step):
            part = asks.slice(a, step)
            planes = np.frombuffer(b"".join(part.column("planes").to_pylist()), np.uint8).reshape(part.num_rows, PLANES, -1)
            scalars = part.column("scalars").flatten().to_numpy().reshape(part.num_rows, -1)
            upper, slack = upper_and_slack(planes, scalars, part.column("at").to_numpy(), self.bits, self.length, self.f, self.d)
            least = part.column("least").to_numpy(zero_copy_only=False)
            if np.isnan(least).any():  # first pass: the k + 1 best lower bounds here set the mark
                n = upper.shape[1]
                least = np.full(len(upper), -np.inf) if n <= k + 1 else np.partition(upper - slack, n - k - 1, axis=1)[:, n - k - 1]
            i, j = np.nonzero(upper >= least[:, None])
            queries, score = vectors_of(part.column("embedding"), self.d), np.empty(len(i))
            for b in range(0, len(i), 50_000):
                score[b : b + 50_000] = np.einsum("ij,ij->i", queries[i[b : b + 50_000]], self.vectors[j[b : b + 50_000]])
            keep = np.flatnonzero(score >= np.where(np.isfinite(least), least, -np.inf)[i] - 1e-4 * scalars[i, 4] * (1 + self.length[j]))
            i, j, score = i[keep], j[keep], score[keep]
            order = np.lexsort((-score, i))
            i, j, score = i[order], j[order], score[order]
            begin = np.searchsorted(i, np.arange(part.num_rows))
            # entries with equal scores at the end of the k + 1 may hold smaller ids than those before: all of them go on
            last = np.minimum(begin[i] + k, np.searchsorted(i, i, "right") - 1)
            keep = score >= score[last]
            pick = pa.array(i[keep])
            out.append([part.column("row").take(pick), part.column("vec_id").take(pick), pa.array(score[keep]), self.ids.take(pa.array(j[keep]))])
        return out


def op8_one_bit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(build_index(vectors, 20), vectors.filter(F.col("vec_id") % 20 == 0), 20)

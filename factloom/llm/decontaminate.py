"""Benchmark decontamination by latent semantic retrieval.

1. The distinct texts as hashed terms, each with its number of copies; from them the terms' document frequencies over all
   documents.
2. A randomised SVD of TF-IDF passages: the benchmark's passages, and all windows of all distinct texts (both halves weigh
   alike; nothing is sampled), in two passes: one finds the space, one its best directions. The products with the passage
   matrix run on the executors and are summed there; the driver holds matrices of 2^BITS x (RANK + EXTRA) only.
3. Every window of every document is projected; windows come in two lengths, in steps that let each passage of up to SPAN
   words lie wholly in one. A window is a candidate for a passage if their cosine passes a bound set by the passage's share
   of the window, and the window's projection holds at least PART of the passage's in its direction. Both bounds lie well
   below what step 4 asks for (half of the passage's rarity). Nothing is capped.
4. A candidate is confirmed on the words themselves: the longest common subsequence with the passage, the share of the
   passage's rarity (IDF) that occurs in the window, and for looser matches (paraphrases) the passage's answer, its last
   words, which must be there in order. A passage of fewer than LEAST words is confirmed only word for word, in one run.

Benchmark items longer than SPAN words are cut into passages of which each counts by itself. Passages come to the workers
in blocks of about PASSAGES; more blocks mean more passes over the documents, not larger ones.

The latent space alone makes candidates. It is an approximate search: KEEP and PART are set so that what exhaustive confirmation
of all windows finds is found (recall is measured in the tests, on paraphrases that keep half of a passage, passages of common
words that stand in a third of all documents, and few documents).

Defined results: null and empty texts match nothing; an item without words matches nothing; an item that occurs in several
rows of a document id is one result row; ties of windows go to the first; a null doc_id or item_id is an id like any other; an
empty benchmark or empty documents give an empty result. The column for the matches is replaced, all others pass through.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import materialise, unused

BITS, RANK, EXTRA = 16, 64, 16
BLOCK = 16
WINDOWS = ((3, 1), (6, 2))  # blocks in a window, blocks between windows
SPAN, LEAST, PASSAGES = 64, 6, 4096
KEEP = 0.08  # of the cosine that a passage lying in a window must reach by its share of the window
PART = 0.28  # of a passage's own projection that a window's must hold in its direction
STRICT, LOOSE = 0.75, 0.5
AT_ONCE, FIT_AT_ONCE = 200_000, 200_000  # tokens looked at together, in the search and in the fit, one document at least
ROWS, TERMS = 2000, 1024  # rows that the search returns together, terms whose parts of a product travel together
LETTERS, MIX = 1_000_000, np.uint64(0x9E3779B97F4A7C15)  # bytes or letters cut into words together, one word at least; an odd number
MATCH = "array<struct<item_id:long,cosine:double,lcs:double,rarity:double,answer:double>>"

_TOKENS, _BREAK = re.compile(r"\w+"), re.compile(r"\W")


def tokens(text: str | None) -> list[str]:
    return _TOKENS.findall(text.lower()) if text else []


@cache
def word_letters() -> np.ndarray:
    """Whether a code point belongs to words, as tokens() has it."""
    out = np.zeros(sys.maxunicode + 1, bool)
    for m in _TOKENS.finditer("".join(map(chr, range(len(out))))):
        out[m.start() : m.end()] = True
    return out


def hashed(letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The terms of words, given by their code points end to end and their lengths: a polynomial in the code points, mixed."""
    if not len(sizes):
        return np.zeros(0, np.uint16)
    begin = np.cumsum(sizes) - sizes
    powers = np.cumprod(np.full(sizes.max(), MIX, np.uint64))
    sums = np.add.reduceat(letters * powers[np.arange(len(letters)) - np.repeat(begin, sizes)], begin)
    return ((sums ^ sums >> np.uint64(32)) * MIX >> np.uint64(64 - BITS)).astype(np.uint16)


def cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The terms of all texts' words end to end, and how many each text has."""
    texts = texts.cast(pa.binary())
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    terms, counts = [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)]
    for first, last in runs(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), LETTERS):
        own = [(t.as_py() or b"").decode("utf-8", "replace").lower() for t in texts[first:last]]
        ends = np.cumsum([len(t) + 1 for t in own])
        at, own = 0, "\n".join(own)
        words = np.zeros(len(ends), np.int64)  # in the texts up to each
        while at < len(own):  # a long text goes in parts that end between words
            stop = _BREAK.search(own, at + LETTERS)
            end = stop.end() if stop else len(own)
            letters = np.frombuffer(own[at:end].encode("utf-32-le"), np.uint32)
            inside = word_letters()[letters]
            edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
            terms.append(hashed(letters[inside], edges[1::2] - edges[::2]))
            words += np.searchsorted(edges[::2] + at, ends)
            at = end
        counts.append(np.diff(words, prepend=0))
    return np.concatenate(terms), np.concatenate(counts)


def term_arrays(text: Column) -> Column:
    """The hashed ids of a text's words, in order, each as a short of either sign: the same words that tokens() cuts."""

    @F.arrow_udf("array<smallint>")
    def terms(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            ids, counts = cut(batch)
            yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids.view(np.int16)))

    return terms(text)


def term_ids(words: list[str]) -> np.ndarray:
    """The hashed ids of words."""
    return hashed(np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32), np.fromiter(map(len, words), np.int64, len(words))).astype(np.int64)


def term(word: str) -> int:
    """The same for one word."""
    return int(term_ids([word])[0])


def flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """A batch's ids end to end, and where each document's begin."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ids = column.flatten().to_numpy(zero_copy_only=False)
    return ids.view(np.uint16) if ids.dtype == np.int16 else ids, np.concatenate([[0], np.cumsum(sizes)])


def runs(starts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(first, last) of some documents after others, as many as make up `most` words, one at least; last is not among them."""
    first = 0
    while first < len(starts) - 1:
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + most, "right")) - 1)
        yield first, last
        first = last


def distinct_texts(rows: DataFrame) -> DataFrame:
    """(terms, copies): the different ones of the rows' only column, the texts' hashed words, and how many rows have each."""
    return materialise(rows.toDF("terms").groupBy("terms").agg(F.count("*").alias("copies")), "texts", "zstd")


def count_terms(ids: np.ndarray, starts: np.ndarray, copies: np.ndarray, into: np.ndarray) -> None:
    """Add to `into` how many of some texts' copies have each term."""
    for first, last in runs(starts, FIT_AT_ONCE):
        # a document counts once for a term: the distinct pairs of text and term
        pairs = distinct(np.repeat(np.arange(first, last) << BITS, np.diff(starts[first : last + 1])) | ids[starts[first] : starts[last]])[0]
        into += np.bincount(pairs & ((1 << BITS) - 1), copies[pairs >> BITS], 1 << BITS).astype(np.int64)


def document_frequencies(docs: DataFrame, texts: DataFrame | None = None) -> tuple[np.ndarray, int, int]:
    """How many documents have each hashed term, how many documents there are, and how many windows of SPAN words the distinct
    texts have. texts: the distinct texts of docs, where they are known already."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((1 << BITS) + 2, np.int64)
        for batch in batches:
            ids, starts = flat(batch.column(0))
            copies = batch.column(1).to_numpy()
            count_terms(ids, starts, copies, seen[:-2])
            seen[-2] += copies.sum()
            seen[-1] += (-(-np.diff(starts) // SPAN)).sum()
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["term", "n"])

    df = np.zeros((1 << BITS) + 2, np.int64)
    texts = distinct_texts(docs.select(term_arrays(F.col("text")))) if texts is None else texts
    for r in texts.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        df[r.term] = r.n
    return df[:-2], int(df[-2]), int(df[-1])


def idf_of(df: np.ndarray, n: int) -> np.ndarray:
    """Smooth weights, 1 at least: a passage that stands in every document still has all its words."""
    return (np.log((n + 1) / (np.minimum(df, n) + 1)) + 1).astype(np.float32)


def pieces(words: list[str]) -> list[list[str]]:
    """An item's passages of at most SPAN words; the last one reaches back so that none is a short rest."""
    if not words:
        return []
    starts = list(range(0, max(1, len(words) - SPAN + 1), SPAN))
    if starts[-1] + SPAN < len(words):
        starts.append(len(words) - SPAN)
    return [words[s : s + SPAN] for s in starts]


def passages_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, passage): the distinct passages of all items, their words joined by spaces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = [" ".join(p) for p in pieces(tokens(text))]
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(own), pa.int64()), pa.array(own, pa.string())], ["item_id", "passage"])

    return materialise(benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(cut, "item_id long, passage string").distinct(), "passages")


# --- the latent space -----------------------------------------------------------------------------------------------------


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in ascending order, and how often each occurs."""
    keys = np.sort(keys)
    begin = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[begin], np.diff(begin, append=len(keys))


def window_rows(ids: np.ndarray, starts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts' windows of SPAN words, end to end: the number of each one's window, the term and the weight, each window of
    length 1 and its terms in ascending order."""
    sizes = np.diff(starts)
    first = np.concatenate([[0], np.cumsum(-(-sizes // SPAN))])[:-1]  # the number of each text's first window
    window = np.repeat(first, sizes) + (np.arange(len(ids)) - np.repeat(starts[:-1], sizes)) // SPAN
    keys, times = distinct(window << BITS | ids)
    window, term = keys >> BITS, keys & ((1 << BITS) - 1)
    weights = times * idf[term]
    norms = np.sqrt(np.bincount(window, weights * weights))
    return window, term, (weights / np.maximum(norms, 1e-12)[window]).astype(np.float32)


def summed(rows: np.ndarray, at: np.ndarray, weights: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The weighted sums of rows[at], runs of which begin at `begin`. Long runs are multiplied one by one; the k-th members of
    all others that have as many are added at once."""
    size = np.diff(begin, append=len(at))
    longest = np.argsort(-size, kind="stable")
    begin, size = begin[longest], size[longest]
    added = np.zeros((len(begin), rows.shape[1]), np.float32)
    long = int(np.count_nonzero(size > BLOCK))
    for i, (a, n) in enumerate(zip(begin[:long].tolist(), size[:long].tolist())):
        added[i] = weights[a : a + n] @ rows.take(at[a : a + n], axis=0)
    for k in range(BLOCK):
        m = int(np.count_nonzero(size > k))
        which = begin[long:m] + k
        added[long:m] += rows.take(at[which], axis=0) * weights[which, None]
    out = np.empty_like(added)
    out[longest] = added
    return out


def cuts(ids: np.ndarray, starts: np.ndarray, idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """window_rows of some texts after others, as many as make up FIT_AT_ONCE words, one at least."""
    for first, last in runs(starts, FIT_AT_ONCE):
        if starts[last] > starts[first]:
            yield window_rows(ids[starts[first] : starts[last]], starts[first : last + 1] - starts[first], idf)


def product(ids: np.ndarray, starts: np.ndarray, idf: np.ndarray, start: tuple[np.ndarray, np.ndarray], into: np.ndarray, lift: float = 1.0) -> None:
    """Add A' A w to `into`, A the windows of some texts, each times lift, w with one value a term: its column and its sign."""
    (column, sign), width = start, into.shape[1]
    for window, term, weights in cuts(ids, starts, idf):
        y = np.bincount(window * width + column[term], weights * sign[term], (int(window[-1]) + 1) * width).reshape(-1, width).astype(np.float32)
        order = np.argsort(term.astype(np.uint16), kind="stable")
        term = term[order]
        begin = np.flatnonzero(np.diff(term, prepend=-1))
        into[term[begin]] += lift * lift * summed(y, window[order], weights[order], begin)


def square(ids: np.ndarray, starts: np.ndarray, idf: np.ndarray, w: np.ndarray) -> np.ndarray:
    """(A w)' A w, A the windows of some texts."""
    out = np.zeros((w.shape[1], w.shape[1]))
    for window, term, weights in cuts(ids, starts, idf):
        y = summed(w, term, weights, np.flatnonzero(np.diff(window, prepend=-1)))
        out += y.T @ y
    return out


PART_OF_PRODUCT = "block long, at binary, part binary"  # a block's first term, which of its terms have a row, these rows


def rows_of(block: int, z: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of a block of terms that are not zero."""
    at = np.flatnonzero(z.any(1)).astype(np.int32)
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([at.tobytes()], pa.binary()), pa.array([z[at].tobytes()], pa.binary())], ["block", "at", "part"])


def products(texts: DataFrame, sent: Broadcast) -> DataFrame:
    """Each task's part of A' A w, A the windows of all texts, in blocks of terms; sent: weights and w. A part is as large as the
    whole product however few texts it comes from, so there are as many as there are cores, not as many as there are files."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = np.zeros((1 << BITS, RANK + EXTRA), np.float32)
        for batch in batches:
            product(*flat(batch.column(0)), *sent.value, z)
        for block in range(0, 1 << BITS, TERMS):
            yield from rows_of(block, z[block : block + TERMS])

    return texts.select("terms").coalesce(texts.sparkSession.sparkContext.defaultParallelism).mapInArrow(part, PART_OF_PRODUCT)


def summed_parts(parts: DataFrame) -> DataFrame:
    """The sums of the tasks' parts."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, at, v in zip(*batch.columns):
                z = out.setdefault(block.as_py(), np.zeros((TERMS, RANK + EXTRA), np.float32))
                z[np.frombuffer(at.as_py(), np.int32)] += np.frombuffer(v.as_py(), np.float32).reshape(-1, RANK + EXTRA)
        for block, z in out.items():
            yield from rows_of(block, z)

    return parts.repartition("block").mapInArrow(add, PART_OF_PRODUCT)


def latent_space(docs: DataFrame, n_windows: float, passages: list[list[str]], idf: np.ndarray, texts: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (terms x RANK) and singular values of the passage matrix: all windows of all distinct texts, and
    the passages, so lifted that both weigh alike. texts: the distinct texts of docs, where they are known already."""
    spark, rng = docs.sparkSession, np.random.default_rng(4)
    texts = distinct_texts(docs.select(term_arrays(F.col("text")))) if texts is None else texts
    start = rng.integers(0, RANK + EXTRA, 1 << BITS), rng.choice(np.array([-1, 1], np.float32), 1 << BITS)
    sent = spark.sparkContext.broadcast((idf, start))

    # A' A w, A the passage matrix
    z = np.zeros((1 << BITS, RANK + EXTRA), np.float32)
    for r in summed_parts(products(texts, sent)).toLocalIterator():
        z[r.block + np.frombuffer(r.at, np.int32)] = np.frombuffer(r.part, np.float32).reshape(-1, RANK + EXTRA)
    lift = float(np.sqrt(max(1, n_windows) / max(1, len(passages))))
    own = np.concatenate([term_ids(p) for p in passages]), np.concatenate([[0], np.cumsum([len(p) for p in passages])])  # one block's
    product(*own, idf, start, z, lift)
    w = np.linalg.qr(z)[0].astype(np.float32)
    held = spark.sparkContext.broadcast(w)

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((RANK + EXTRA, RANK + EXTRA))
        for batch in batches:
            out += square(*flat(batch.column(0)), sent.value[0], held.value)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size)), pa.array(out.ravel())], ["at", "x"])

    # the best directions of that space and how much of all windows they hold
    total = (lift * lift * square(*own, idf, w)).ravel()
    for r in texts.select("terms").mapInArrow(squares, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toLocalIterator():
        total[r.at] += r.x
    sent.unpersist()
    held.unpersist()
    values, turn = np.linalg.eigh(total.reshape(RANK + EXTRA, -1))
    best = np.argsort(-values)[:RANK]
    return (w @ turn[:, best]).astype(np.float32), np.sqrt(np.maximum(values[best], 0))


# --- words ----------------------------------------------------------------------------------------------------------------


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, one big-integer step for each word of b."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        if m := places.get(w):
            hit = row & m
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def answer_size(passage: list[str]) -> int:
    """How many of a passage's last words are its answer (all, where it has fewer)."""
    return max(4, len(passage) // 4)


class Judge:
    """The passages of one block of items with their projections, and the test of documents against them."""

    def __init__(self, passages: list[tuple[int | None, list[str]]], idf: np.ndarray, basis: np.ndarray, values: np.ndarray):
        self.passages = passages
        scale = np.where(values > 1e-3 * max(values.max(initial=0), 1e-9), 1 / np.maximum(values, 1e-9), 0)
        self.table = ((basis * scale.astype(np.float32)) * idf[:, None]).astype(np.float32)
        self.weights = [dict(zip(words, idf[term_ids(words)].tolist())) for _, words in passages]
        self.rarity, self.idf = np.array([sum(own.values()) or 1.0 for own in self.weights]), idf
        q = np.stack([self.table[term_ids(w)].sum(0) for _, w in passages])
        length = np.linalg.norm(q, axis=1)
        self.queries = (q / np.maximum(length, 1e-12)[:, None]).T.astype(np.float32)
        self.part = (PART * length).astype(np.float32)
        lengths = np.array([len(w) for _, w in passages], np.float32)
        # a bit for each term of a passage: 2^BITS / 8 bytes a passage
        held = np.zeros((len(passages), 1 << BITS >> 3), np.uint8)
        for j, (_, w) in enumerate(passages):
            t = term_ids(w)
            np.bitwise_or.at(held[j], t >> 3, (1 << (t & 7)).astype(np.uint8))
        self.holds, self.enough = held, LOOSE * lengths
        # the places of a passage at which a term stands, a bit each, by passage and term; and the places of its answer
        keys = np.concatenate([j << BITS | term_ids(w) for j, (_, w) in enumerate(passages)])
        places = np.concatenate([np.uint64(1) << np.arange(len(w), dtype=np.uint64) for _, w in passages])
        order = np.argsort(keys, kind="stable")
        begin = np.flatnonzero(np.diff(keys[order], prepend=-1))
        self.keys, self.places = keys[order][begin], np.bitwise_or.reduceat(places[order], begin)
        self.ends = np.array([sum(1 << k for k in range(len(w))[-answer_size(w) :]) for _, w in passages], np.uint64)
        whole = lengths < LEAST
        self.loose, self.strict = np.where(whole, lengths, LOOSE * lengths), np.where(whole, lengths, STRICT * lengths)
        self.answer = STRICT * np.bitwise_count(self.ends)
        self.least = [(KEEP * np.sqrt(np.minimum(1, lengths / (n * BLOCK)))).astype(np.float32) for n, _ in WINDOWS]

    def share_enough(self, part: np.ndarray, begin: np.ndarray, size: int, end: np.ndarray, passage: np.ndarray) -> np.ndarray:
        """Of windows and passages, those that step 4 may confirm. LOOSE of the passage's words and of its rarity are in the window,
        words that occur twice counted twice; and in any order the window has the words of as many places of the passage, or of
        the passage and its answer, as the common subsequences must have in order."""
        terms = np.lib.stride_tricks.sliding_window_view(np.concatenate([part, np.zeros(size, part.dtype)]), size)[begin]
        has = self.holds.ravel().take((passage * self.holds.shape[1])[:, None] + (terms >> 3)) >> (terms & 7).astype(np.uint8) & 1
        has &= np.arange(size) < (end - begin)[:, None]
        some = np.flatnonzero(has.sum(1, dtype=np.uint8) >= self.enough[passage])  # a window has fewer than 256 words
        some = some[(has[some] * self.idf[terms[some]]).sum(1) >= (LOOSE - 1e-6) * self.rarity[passage[some]]]
        out = np.zeros(len(passage), bool)
        if len(some):
            own, (pair, word) = passage[some], np.nonzero(has[some])
            places = self.places[np.searchsorted(self.keys, own[pair] << BITS | terms[some[pair], word])]
            places = np.bitwise_or.reduceat(places, np.flatnonzero(np.diff(pair, prepend=-1)))
            share, answer = np.bitwise_count(places), np.bitwise_count(places & self.ends[own])
            out[some[(share >= self.strict[own]) | (share >= self.loose[own]) & (answer >= self.answer[own])]] = True
        return out

    def block_sums(self, ids: np.ndarray, block: np.ndarray, n_blocks: int) -> np.ndarray:
        """The sum of the projected words of each block; words come block by block. The k-th words of all blocks that have as
        many are added at once, those of the fullest blocks first."""
        sums = np.zeros((n_blocks, self.table.shape[1]), np.float32)
        begin = np.flatnonzero(np.diff(block, prepend=-1))
        size = np.diff(begin, append=len(block))
        fullest = np.argsort(-size, kind="stable")
        begin, into = begin[fullest], block[begin[fullest]]
        added = np.zeros((len(begin), self.table.shape[1]), np.float32)
        for k in range(int(size.max(initial=0))):
            m = int(np.count_nonzero(size > k))
            added[:m] += self.table.take(ids[begin[:m] + k], axis=0)
        sums[into] = added
        return sums

    def candidates(self, ids: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
        """(document, first word, end, passage, cosine) of all windows that come near a passage."""
        for first, last in runs(starts, AT_ONCE):
            part, own = ids[starts[first] : starts[last]], starts[first : last + 1] - starts[first]
            n_blocks = -(-np.diff(own) // BLOCK)
            base = np.concatenate([[0], np.cumsum(n_blocks)])
            doc = np.repeat(np.arange(last - first), np.diff(own))
            in_doc = np.arange(int(base[-1])) - np.repeat(base[:-1], n_blocks)
            begin_of = np.repeat(own[:-1], n_blocks) + BLOCK * in_doc  # of each block, in the words looked at
            end_of = np.minimum(begin_of + BLOCK, np.repeat(own[1:], n_blocks))
            sums = self.block_sums(part, base[doc] + (np.arange(len(part)) - own[doc]) // BLOCK, int(base[-1]))
            for (n, step), least in zip(WINDOWS, self.least):
                count = np.where(n_blocks > 0, -(-np.maximum(1, n_blocks - n + step) // step), 0)
                which = np.repeat(np.arange(last - first), count)
                nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
                begin = base[which] + step * nth
                end = np.minimum(begin + n, base[which + 1])
                for a in range(0, len(begin), 20_000):
                    s, e = begin[a : a + 20_000], end[a : a + 20_000]
                    window = sums[s]
                    for k in range(1, n):
                        window += np.where((s + k < e)[:, None], sums[np.minimum(s + k, len(sums) - 1)], 0)
                    along = window @ self.queries
                    at, passage = np.divmod(np.flatnonzero(along >= self.part), len(self.part))
                    size = np.maximum(np.linalg.norm(window, axis=1), 1e-12)[at]
                    cosine = along[at, passage] / size
                    near = np.flatnonzero(cosine >= least[passage])
                    for c in range(0, len(near), 50_000):
                        few = near[c : c + 50_000]
                        few = few[self.share_enough(part, begin_of[s[at[few]]], n * BLOCK, end_of[e[at[few]] - 1], passage[few])]
                        for i, j, x in zip(at[few].tolist(), passage[few].tolist(), cosine[few].tolist()):
                            d, begin_at = int(which[a + i]), int(s[i])
                            yield first + d, BLOCK * (begin_at - int(base[d])), BLOCK * (int(e[i]) - int(base[d])), j, x

    def matches(self, column: pa.ListArray, texts: pa.StringArray) -> list[list[dict]]:
        """The confirmed items of each document of a batch."""
        found: dict[int, dict[int, dict]] = {}
        words: tuple[int, list[str]] = (-1, [])
        for doc, begin, end, passage, cosine in sorted(self.candidates(*flat(column))):
            if words[0] != doc:
                words = doc, tokens(texts[doc].cast(pa.binary()).as_py().decode("utf-8", "replace"))
            self.confirm(words[1][begin:end], passage, cosine, found.setdefault(doc, {}))
        return [list(found.get(i, {}).values()) for i in range(len(column))]

    def confirm(self, window: list[str], j: int, cosine: float, best: dict[int, dict]) -> None:
        item, passage = self.passages[j]
        own = self.weights[j]
        if sum(map(own.__contains__, window)) < LOOSE * len(passage):  # no more words can be in common
            return
        if len(passage) < LEAST and not any(window[i : i + len(passage)] == passage for i, w in enumerate(window) if w == passage[0]):
            return
        here = set(window)
        rarity = sum(x for w, x in own.items() if w in here) / self.rarity[j]
        if rarity < LOOSE:
            return
        share = lcs(passage, window) / len(passage)
        end = passage[-answer_size(passage) :]
        answer = lcs(end, window) / len(end)
        if share >= STRICT and rarity >= STRICT or share >= LOOSE and answer >= STRICT:
            if item not in best or share > best[item]["lcs"]:
                best[item] = {"item_id": item, "cosine": cosine, "lcs": share, "rarity": rarity, "answer": answer}


def with_matches(docs: DataFrame, benchmark: DataFrame, to: str = "matches", per_block: int = PASSAGES) -> DataFrame:
    """docs (with a text) and a column `to`: the benchmark items (item_id, text) found in it, with the scores that confirmed them."""
    spark, docs = docs.sparkSession, docs.drop(to)
    terms = unused(docs, "terms")[0]
    # written once, for cutting texts into words costs more than reading the words again; packed well, for it holds all texts
    ready = materialise(docs.withColumn(terms, term_arrays(F.col("text"))), "terms", "zstd")
    texts = distinct_texts(ready.select(terms))
    df, n, windows = document_frequencies(ready, texts)
    idf, known = idf_of(df, n), passages_of(benchmark)
    blocks = max(1, -(-known.count() // per_block))
    out = ready.withColumn(to, F.array().cast(MATCH))
    for b in range(blocks):
        rows = known.filter(F.pmod(F.xxhash64("item_id", "passage"), F.lit(blocks)) == b).orderBy("item_id", "passage").collect()  # about per_block
        passages = [(r.item_id, r.passage.split(" ")) for r in rows]
        if not passages or not n:
            continue
        basis, values = latent_space(ready, windows, [w for _, w in passages], idf, texts)
        sent = spark.sparkContext.broadcast((passages, idf, basis, values))

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            judge = Judge(*sent.value)
            for batch in (whole.slice(a, ROWS) for whole in batches for a in range(0, whole.num_rows, ROWS)):
                found = judge.matches(batch.column(terms), batch.column("text"))
                at = batch.schema.get_field_index(to)
                column = pa.array([old + new for old, new in zip(batch.column(at).to_pylist(), found)], batch.schema.field(at).type)
                yield batch.set_column(at, batch.schema.field(at), column)

        out = out.mapInArrow(find, out.schema)
    return out.drop(terms)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a benchmark passage."""
    to = unused(docs, "matches")[0]
    return with_matches(docs, benchmark, to).filter(F.size(to) == 0).drop(to)


def op4_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id) of all leaks, with the scores that confirmed them."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = with_matches(docs.select("doc_id", "text"), benchmark).select("doc_id", F.explode("matches").alias("m"))
    best = F.max_by(F.struct("m.cosine", "m.lcs", "m.rarity", "m.answer"), F.struct("m.lcs", "m.cosine")).alias("b")
    return found.groupBy("doc_id", F.col("m.item_id").alias("item_id")).agg(best).select("doc_id", "item_id", "b.cosine", "b.lcs", "b.rarity", "b.answer")

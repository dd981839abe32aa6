"""Alignment of two tokenizers over a corpus, with inverted bitmaps of token pairs.

A is a byte-level BPE tokenizer, given a space and the text; B a SentencePiece model, given the text (it adds the space). Places
where tokens of both end cut the tokens into groups; two tokens that end there together are linked. How often an id pair is
linked in the whole corpus comes from an index:

1. Each task encodes its rows and inverts them: for each id pair the documents that hold it, as a bitmap over the 65,536 places of a
   block of its rows (sorted 16-bit places while those are shorter). Plane 0 is the documents; further planes are the
   binary digits of the further times that a document holds the pair. Bitmaps are put out whenever LINKS links are held.
2. Bitmaps of a pair, block and plane are OR-merged and popcounted: plane 0 gives document counts, all planes together link counts.
   A pair has one row a block and plane at most, so no key can hold many rows: bytes for a pair that stands in
   every document are one bit a document and plane.
3. Counts, and whether a count is the highest of its B id, go back to the postings, and these to their block, where they are added
   up for each document. No row is made for a document and a pair.

Words are encoded once for each task's worker as long as its memory (MEMO segments) holds them: both tokenizers work within
pre-tokens, so texts are cut where pre-tokens of both end and what lies between is encoded and aligned by itself. Characters on
whose class the two splitting libraries differ send a text the plain way, whole.

Defined results: null and empty texts, and texts whose joined token bytes of A or B are not those of space and text (B rewrites
some characters), have no tokens: zeros, and no groups (an empty value); repeated rows count each; texts of any length are
encoded whole; columns in `keep` pass through whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.bpe import splitter
from factloom.llm.common import materialise, partitions, unused
from factloom.llm.tokens import boundaries_once, model

BLOCK = 1 << 16
#: Links that a task holds before it puts out bitmaps; segments that a worker remembers.
LINKS, MEMO = 4_000_000, 400_000
#: Ids are below 2 ** 20, so that a pair and a place fit one 64-bit number.
ID_BITS, PLACE_BITS = 20, 16
#: Bytes of a bitmap of a whole block. Shorter values are sorted places of 16 bits.
WHOLE = BLOCK // 8

_opened: dict = {}


def tokenizer(name: str):
    """The named tokenizer file and the bytes of each of its ids, opened once per worker."""
    if name not in _opened:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(public_tokenizers.path(name))
        found.encode_special_tokens = True
        _opened[name] = found, token_bytes(found.get_vocab(with_added_tokens=True))
    return _opened[name]


def token_bytes(vocabulary: dict[str, int]) -> list[bytes]:
    """The bytes of byte-level entries: visible characters of Latin-1 stand for their own byte, the other bytes, in order, for the
    characters from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    value = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, number in vocabulary.items():
        out[number] = bytes(value[c] for c in token) if all(c in value for c in token) else token.encode()
    return out


def piece_bytes(name: str) -> list[bytes]:
    if ("pieces", name) not in _opened:
        m = model(name)
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        _opened["pieces", name] = [bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    return _opened["pieces", name]


class Aligner:
    """Encodes and aligns texts; remembers what it has seen of segments."""

    def __init__(self, a: str, b: str):
        self.a, self.bytes_a = tokenizer(a)
        self.b, self.bytes_b = model(b), piece_bytes(b)
        self.split_a, self.pattern_b = splitter(), boundaries_once(b)
        self.lead = len(self.b.encode("\n"))
        self.size_a, self.size_b = (np.array([len(x) for x in of], "i8") for of in (self.bytes_a, self.bytes_b))
        # ids as text, followed by what separates them from the next: one inside a group, or the last of the group's side
        self.names_a, self.names_b = ([np.array([f"{i}{sign}" for i in range(len(of))], object) for sign in signs] for of, signs in ((self.bytes_a, ",|"), (self.bytes_b, ",;")))
        self.alike, self.odd = set(), set()
        self.forget()

    def forget(self) -> None:
        """Start anew: what is known of the segments, by their numbers."""
        self.memo: dict = {}
        self.shown: list[str] = []
        self.n_a = self.n_b = self.n_links = np.zeros(0, "i8")
        self.links = np.zeros(0, "i8")

    def apart(self, text: str) -> bool:
        """Whether both libraries that split A's pre-tokens class all characters of the text alike, and B keeps them."""
        signs = set(text)
        for c in signs - self.alike - self.odd:
            probe = f"a{c}1{c}!{c} {c}{c}b"
            same = c != "▁" and [*map(len, self.split_a(probe))] == [e - s for _, (s, e) in self.a.pre_tokenizer.pre_tokenize_str(probe)]
            (self.alike if same else self.odd).add(c)
        return self.pattern_b is not None and self.odd.isdisjoint(signs)

    def segments(self, text: str) -> list:
        """The text's segments: a word that is a pre-token of both, or the words of A and of B up to where both end."""
        text = " " + text
        if not self.apart(text):
            return [((text,), None)]
        words_a, words_b, out, i, j = self.split_a(text), self.pattern_b.findall(text), [], 0, 0
        while i < len(words_a):
            if words_a[i] == words_b[j]:
                out.append(words_a[i])
                i, j = i + 1, j + 1
                continue
            first_a, first_b, ahead = i, j, len(words_a[i]) - len(words_b[j])
            i, j = i + 1, j + 1
            while ahead:
                if ahead < 0:
                    ahead += len(words_a[i])
                    i += 1
                else:
                    ahead -= len(words_b[j])
                    j += 1
            out.append((tuple(words_a[first_a:i]), tuple(words_b[first_b:j])))
        return out

    def learn(self, segments: list) -> None:
        """Encode and align segments not seen yet, all at once: their tokens stand in one row, and places where both end are looked
        up there. A segment whose tokens' bytes are not those of the text gets a count of -1."""
        cut = [((s,), (s,)) if isinstance(s, str) else s for s in segments]
        words_a = list({w for a, _ in cut for w in a})
        words_b = list({w for _, b in cut for w in b or ()})
        ids_a = dict(zip(words_a, (x.ids for x in self.a.encode_batch_fast(words_a, add_special_tokens=False))))
        ids_b = dict(zip(words_b, (x[self.lead :] for x in self.b.encode([f"\n{w}" for w in words_b], num_threads=1))))
        a = [ids_a[s] if isinstance(s, str) else [i for w in s[0] for i in ids_a[w]] for s in segments]
        b = [ids_b[s] if isinstance(s, str) else [i for w in s[1] for i in ids_b[w]] if s[1] else self.b.encode(s[0][0][1:], num_threads=1) for s in segments]
        raw = [s if isinstance(s, str) else "".join(s[0]) for s in segments]
        joined_a, joined_b = (b"".join([of[i] for ids in all_ for i in ids]) for of, all_ in ((self.bytes_a, a), (self.bytes_b, b)))
        good = [True] * len(segments)
        if not joined_a == joined_b == "".join(raw).encode():
            good = [b"".join([self.bytes_a[i] for i in x]) == b"".join([self.bytes_b[i] for i in y]) == r.encode() for x, y, r in zip(a, b, raw)]
            a, b = ([ids for ids, g in zip(all_, good) if g] for all_ in (a, b))
        shown, n_a, n_b, n_links, links = self.align(a, b)
        at, marks = np.flatnonzero(good), np.full((3, len(segments)), -1)
        marks[:, at] = n_a, n_b, n_links
        for k, segment in enumerate(segments, len(self.shown)):
            self.memo[segment] = k
        each = iter(shown)
        self.shown += [next(each) if g else "" for g in good]
        self.n_a, self.n_b, self.n_links = (np.concatenate([old, new]) for old, new in zip((self.n_a, self.n_b, self.n_links), marks))
        self.links = np.concatenate([self.links, links])

    def align(self, a: list[list[int]], b: list[list[int]]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of segments whose tokens cover the same bytes: the groups as text, the numbers of tokens and links, and all links."""
        n_a, n_b = (np.fromiter(map(len, x), "i8", len(x)) for x in (a, b))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(x), "i8", int(n.sum())) for x, n in ((a, n_a), (b, n_b)))
        ends_a, ends_b = np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b])
        last_a, last_b = np.isin(ends_a, ends_b, assume_unique=True), np.isin(ends_b, ends_a, assume_unique=True)
        at_a, at_b = np.flatnonzero(last_a), np.flatnonzero(last_b)
        links = flat_a[at_a] << ID_BITS | flat_b[at_b]
        of = np.repeat(np.arange(len(a)), n_a)[at_a]
        # groups one after the other, each A's tokens and then B's
        before_b = np.concatenate([[0], at_b + 1])[np.cumsum(last_a) - last_a]
        upto_a = (at_a + 1)[np.cumsum(last_b) - last_b]
        signs = np.empty(len(flat_a) + len(flat_b), object)
        signs[np.arange(len(flat_a)) + before_b] = np.where(last_a, self.names_a[1][flat_a], self.names_a[0][flat_a])
        signs[np.arange(len(flat_b)) + upto_a] = np.where(last_b, self.names_b[1][flat_b], self.names_b[0][flat_b])
        signs, ends = signs.tolist(), np.cumsum(n_a + n_b).tolist()
        return ["".join(signs[i:j]) for i, j in zip([0, *ends], ends)], n_a, n_b, np.bincount(of, minlength=len(a)), links

    def texts(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """For each text its groups, and its numbers of A's and B's tokens and of links; and all links, text by text."""
        cut = [self.segments(text) if text else [] for text in texts]
        fresh = {s for segments in cut for s in segments if s not in self.memo}
        if len(self.memo) + len(fresh) > MEMO:
            self.forget()
            fresh = {s for segments in cut for s in segments}
        self.learn(list(fresh))
        memo, shown = self.memo, self.shown
        found = [[memo[s] for s in segments] for segments in cut]
        if (self.n_a < 0).any():
            bad = set(np.flatnonzero(self.n_a < 0).tolist())
            found = [[] if not bad.isdisjoint(ks) else ks for ks in found]
        sizes = np.fromiter(map(len, found), "i8", len(found))
        flat, of = np.fromiter(chain.from_iterable(found), "i8", int(sizes.sum())), np.repeat(np.arange(len(found)), sizes)
        numbers = np.stack([np.bincount(of, n[flat], len(found)) for n in (self.n_a, self.n_b, self.n_links)]).astype("i8")
        n = np.maximum(self.n_links, 0)
        starts, n = (np.cumsum(n) - n)[flat], n[flat]
        links = self.links[np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum())]
        return ["".join([shown[k] for k in ks])[:-1] for ks in found], numbers, links, np.repeat(of, n)


def planes(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray, list[bytes]]]:
    """(plane, pairs, bitmaps) of keys pair << PLACE_BITS | place, one for each link: plane 0 holds each place once, plane k + 1
    those whose further times have the binary digit k."""
    held, times = np.unique(keys, return_counts=True)
    for plane in range(1 + int(times.max(initial=1) - 1).bit_length()):
        chosen = held if not plane else held[(times - 1) >> (plane - 1) & 1 == 1]
        pairs, at = chosen >> PLACE_BITS, (chosen & (BLOCK - 1)).astype("<u2")
        starts = np.flatnonzero(np.diff(pairs, prepend=-1))
        yield plane, pairs[starts], [bitmap(at[i:j]) for i, j in zip(starts, [*starts[1:], len(at)])]


def bitmap(places: np.ndarray) -> bytes:
    """A bitmap of sorted places, or the places while they are shorter."""
    if 2 * len(places) < WHOLE:
        return places.tobytes()
    bits = np.zeros(BLOCK, "u1")
    bits[places] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def places(value: bytes) -> np.ndarray:
    """Places of a bitmap."""
    if len(value) < WHOLE:
        return np.frombuffer(value, "<u2")
    return np.flatnonzero(np.unpackbits(np.frombuffer(value, "u1"), bitorder="little")).astype("<u2")


def weight(plane: Column) -> Column:
    """Links that a bit of a plane stands for."""
    return F.when(plane == 0, 1).otherwise(F.pow(F.lit(2), plane - 1)).cast("long")


def encode_pairs(docs: DataFrame, a: str, b: str, text: str, keep: list[str]) -> DataFrame:
    """Rows of documents (block, place, numbers, groups, doc) and rows of postings (block, plane, pair, bitmap)."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(0).alias(unused(docs, "none")[0])).alias("doc"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    schema = f"block long, place int, plane int, pair long, bitmap binary, n_a long, n_b long, n_groups long, groups string, doc {kind}"
    fields = ["block", "place", "plane", "pair", "bitmap", "n_a", "n_b", "n_groups", "groups", "doc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = ("aligner", a, b)
        if both not in _opened:
            _opened[both] = Aligner(a, b)
        aligner, block, place, keys, held = _opened[both], TaskContext.get().partitionId() << 32, 0, [], 0

        def out() -> Iterator[pa.RecordBatch]:
            if keys:
                for plane, pairs, values in planes(np.concatenate(keys)):
                    n, none = len(pairs), lambda k: pa.nulls(k)  # noqa: B023
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block] * n, pa.int64()), none(n).cast(pa.int32()), pa.array([plane] * n, pa.int32()), pa.array(pairs, pa.int64()), pa.array(values, pa.binary()),
                         *[none(n).cast(pa.int64())] * 3, none(n).cast(pa.string()), pa.nulls(n, doc_type)], fields)

        doc_type = None
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                doc_type, n = batch.column("doc").type, batch.num_rows
                if place + n > BLOCK or held > LINKS:
                    yield from out()
                    keys, held = [], 0
                    if place + n > BLOCK:
                        block, place = block + 1, 0
                shown, numbers, links, of = aligner.texts(batch.column("text").to_pylist())
                keys.append(links << PLACE_BITS | (of + place))
                held += len(links)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * n, pa.int64()), pa.array(range(place, place + n), pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()),
                     *[pa.array(numbers[k]) for k in range(3)], pa.array(shown, pa.string()), batch.column("doc")], fields)
                place += n
        if doc_type is not None:
            yield from out()

    return rows.mapInArrow(run, schema)


def merged(postings: DataFrame) -> DataFrame:
    """One row for each pair, block and plane, its bitmaps OR-merged, and the bits set in it."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, []
        for batch in batches:
            rows: list[tuple] = []
            for key, value in zip(zip(*(batch.column(c).to_pylist() for c in ("pair", "block", "plane"))), batch.column("bitmap").to_pylist()):
                if key != last and own:
                    rows.append((*last, *joined(own)))
                    own = []
                last = key
                own.append(value)
            yield batch_of(rows)
        if own:
            yield batch_of([(*last, *joined(own))])

    def joined(values: list[bytes]) -> tuple[bytes, int]:
        if len(values) == 1 and len(values[0]) < WHOLE:
            return values[0], len(values[0]) // 2
        all_ = np.unique(np.concatenate([places(v) for v in values]))
        return bitmap(all_), len(all_)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64()))], ["pair", "block", "plane", "bitmap", "n"])

    dealt = postings.repartition(partitions(postings.sparkSession), "pair").sortWithinPartitions("pair", "block", "plane")
    return dealt.mapInArrow(merge, "pair long, block long, plane int, bitmap binary, n long")


def pair_counts(index: DataFrame) -> DataFrame:
    """For each id pair the documents and the links that hold it, and whether no pair of its B id has more links."""
    counts = index.groupBy("pair").agg(F.sum(F.when(F.col("plane") == 0, F.col("n")).otherwise(0)).alias("documents"), F.sum(F.col("n") * weight(F.col("plane"))).alias("links"))
    counts = materialise(counts.select("pair", F.shiftright("pair", ID_BITS).alias("a"), F.col("pair").bitwiseAND(F.lit((1 << ID_BITS) - 1)).alias("b"), "documents", "links"), "pairs")
    # as many rows as B's vocabulary has ids
    most = F.broadcast(counts.groupBy("b").agg(F.max("links").alias("most")))
    return counts.join(most, "b").select("pair", "a", "b", "documents", "links", (F.col("links") == F.col("most")).alias("best"))


def align(docs: DataFrame, a: str, b: str, text: str = "text", keep: list[str] | None = None, groups: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The columns `keep` of docs (all, if not given) with n_a, n_b, n_groups, n_links, n_best, count_sum and groups, the text's
    groups as `a1,a2|b1;a3|b2,b3` or what the expression `groups` makes of that column; and the table of pair counts."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != "groups"]
    shown = F.col("groups") if groups is None else groups
    rows = materialise(encode_pairs(docs, a, b, text, keep).withColumn("groups", F.when(F.col("place").isNotNull(), shown)), "aligned")
    index = materialise(merged(rows.filter("place is null").select("pair", "block", "plane", "bitmap")), "postings")
    counts = pair_counts(index)
    scored = index.join(counts.select("pair", "links", "best"), "pair").select("block", "bitmap", (weight(F.col("plane")) * F.col("links")).alias("adds"), F.when(F.col("best"), weight(F.col("plane"))).otherwise(0).alias("bests"))
    texts = rows.filter("place is not null").select("block", "place", "n_a", "n_b", "n_groups", "groups", "doc")
    kind = texts.schema["doc"].dataType.simpleString()

    def give_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block, the block's postings before its documents."""
        last, sums, bests = None, None, None
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1), len(blocks)] if len(blocks) else []
            for i, j in zip(cuts, cuts[1:]):
                if blocks[i] != last:
                    last, sums, bests = blocks[i], np.zeros(BLOCK, "i8"), np.zeros(BLOCK, "i8")
                part = batch.slice(i, j - i)
                at = part.column("place").to_pylist()
                here = next((k for k, p in enumerate(at) if p is not None), len(at))
                values = [places(v) for v in part.column("bitmap").slice(0, here).to_pylist()]
                if values:
                    to, sizes = np.concatenate(values), [len(v) for v in values]
                    np.add.at(sums, to, np.repeat(part.column("adds").slice(0, here).to_numpy(), sizes))
                    np.add.at(bests, to, np.repeat(part.column("bests").slice(0, here).to_numpy(), sizes))
                out = part.slice(here)
                if out.num_rows:
                    at = np.array(at[here:])
                    yield pa.RecordBatch.from_arrays([*[out.column(c) for c in ("n_a", "n_b", "n_groups")], pa.array(bests[at]), pa.array(sums[at]), out.column("groups"), out.column("doc")], ["n_a", "n_b", "n_groups", "n_best", "count_sum", "groups", "doc"])

    both = scored.unionByName(texts, allowMissingColumns=True)
    met = both.repartition(partitions(docs.sparkSession), "block").sortWithinPartitions("block", F.col("place").isNotNull())
    done = met.mapInArrow(give_back, f"n_a long, n_b long, n_groups long, n_best long, count_sum long, groups {texts.schema['groups'].dataType.simpleString()}, doc {kind}")
    return done.select(*[F.col(f"doc.`{c}`") for c in keep], "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups"), counts


A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    shown = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256))
    return align(docs, A, B, keep=["doc_id"], groups=shown)[0].withColumnRenamed("groups", "groups_sha256")

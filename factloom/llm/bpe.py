"""Byte-level BPE encoding and decoding of whole texts, by a global shuffle of distinct words.

A text is cut into pre-tokens by a fixed pattern and each is merged by itself, so a text's ids are those of its pre-tokens in
order. Each distinct word is encoded once:

1. Frequent words are looked for in a sample of about SAMPLE documents, encoded and broadcast. A word must make up 1/HEAD of the
   sample's words, and one longer than HEAD_BYTES proportionally more, so the table holds at most HEAD * HEAD_BYTES bytes of text
   whatever the corpus: it is what keeps words that stand in a third of all texts out of the shuffle. It only decides where a
   word is looked up; no id depends on it.
2. Every row belongs to a block of about BLOCK_BYTES of text, by a hash of the row. All other words are exploded as (word, block),
   each once, and brought together by word; there each distinct one is encoded, and its ids (which say what the word is) go to the blocks that hold it.
3. The texts, compressed, meet the ids of their blocks' words, and the ids are put together by the positions of the words.

Ids travel and are returned as packed little-endian unsigned 32-bit integers, the form in which token files are written.
Decoding joins the table of token bytes, which is as long as the vocabulary: a broadcast of bounded size.

Defined results: null and empty texts have no ids (an empty value, not a null) and decode to no bytes; repeated rows get equal
results each; words of any length are encoded whole; columns of any name pass through untouched (the result column replaces
one of its own name); an empty table gives an empty result. Ids outside the vocabulary end decoding with an error; null ids
decode to null.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import partitions, row_hash, unused

HEAD, HEAD_BYTES, SAMPLE = 1_000_000, 48, 20_000
#: Bytes of text for each block: with it, the words that one task holds at a time are bounded.
BLOCK_BYTES = 8_000_000
#: (word, block) pairs that a task holds before it puts them out, and bytes of ids in a batch.
FLUSH, OUT_BYTES = 100_000, 4_000_000

_opened: dict = {}


def encoder(name: str):
    """The named rank file of the public tokenizers as an encoder, opened once per worker."""
    if name not in _opened:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(name), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _opened[name] = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _opened[name]


def splitter():
    """Cuts a text into pre-tokens."""
    if "pattern" not in _opened:
        import public_tokenizers
        import regex

        _opened["pattern"] = regex.compile(public_tokenizers.PATTERN)
    return _opened["pattern"].findall


def word_ids(name: str, words: list[str]) -> list[bytes]:
    """Packed ids of each word."""
    encode = encoder(name).encode_ordinary
    return [np.array(encode(word), "<u4").tobytes() for word in words]


def pack(**columns: pa.Array) -> bytes:
    """Columns as one compressed value: shuffled so, a word takes a fifth of what a row of its own would."""
    batch, sink = pa.RecordBatch.from_arrays(list(columns.values()), list(columns)), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(value: bytes) -> pa.Table:
    return pa.ipc.open_stream(value).read_all()


def frequent(texts: DataFrame) -> list[str]:
    """The frequent words of a sample."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = splitter(), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(split(text or ""))
            if len(seen) > FLUSH:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
                seen = Counter()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    counted = texts.mapInArrow(count, "word string, n long").persist()
    total = counted.agg(F.sum("n")).first()[0] or 0
    often = (F.col("n") > 1) & (F.col("n") * HEAD >= F.lit(total) * F.greatest(F.lit(1.0), F.octet_length("word") / HEAD_BYTES))
    words = [r.word for r in counted.groupBy("word").agg(F.sum("n").alias("n")).filter(often).select("word").toLocalIterator()]
    counted.unpersist()
    return words


def encode(docs: DataFrame, name: str, text: str = "text", to: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all, if not given) and the packed ids of the text."""
    spark, n = docs.sparkSession, partitions(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != to.lower()]
    rows, size = docs.agg(F.count("*"), F.sum(F.octet_length(text))).first()
    blocks = max(n, (size or 0) // BLOCK_BYTES + 1)
    share = SAMPLE / max(1, rows)
    words = frequent((docs if share >= 1 else docs.sample(share, seed=11)).select(text))
    head = spark.sparkContext.broadcast(dict(zip(words, word_ids(name, words))))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words that the table does not hold, each with the blocks that need it, by the bucket of the word."""
        split, known, wanted, held = splitter(), head.value, {}, 0

        def out() -> Iterator[pa.RecordBatch]:
            buckets: dict[int, tuple[list, list]] = {}
            for block, words in sorted(wanted.items()):
                for word in sorted(words):
                    into = buckets.setdefault(crc32(word.encode()) % blocks, ([], []))
                    into[0].append(word)
                    into[1].append(block)
            for bucket, (words, needed) in buckets.items():
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([pack(word=pa.array(words, pa.string()), block=pa.array(needed, pa.int64()))], pa.binary())], ["bucket", "words"])

        for batch in batches:
            for block, value in zip(batch.column("block").to_pylist(), batch.column("text").to_pylist()):
                fresh = [word for word in set(split(value or "")) if word not in known]
                wanted.setdefault(block, set()).update(fresh)
                held += len(fresh)
                if held > FLUSH:
                    yield from out()
                    wanted, held = {}, 0
        yield from out()

    def encode_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket: each distinct word of a bucket is encoded, and its ids go to every block that needs it."""

        def out(parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
            table = pa.concat_tables(parts).combine_chunks()
            coded = table["word"].chunk(0).dictionary_encode()
            ids = pa.array(word_ids(name, coded.dictionary.to_pylist()), pa.binary())
            pairs = np.unique(np.stack([table["block"].to_numpy(), coded.indices.to_numpy().astype("i8")]), axis=1)
            starts = np.flatnonzero(np.diff(pairs[0], prepend=-1))
            for a, b in zip(starts, [*starts[1:], pairs.shape[1]]):
                at = pa.array(pairs[1, a:b])
                payload = pack(ids=ids.take(at))
                yield pa.RecordBatch.from_arrays([pa.array([pairs[0, a]], pa.int64()), pa.array([payload], pa.binary())], ["block", "payload"])

        last, parts = None, []
        for batch in batches:
            for bucket, words in zip(batch.column("bucket").to_pylist(), batch.column("words").to_pylist()):
                if bucket != last and parts:
                    yield from out(parts)
                    parts = []
                last = bucket
                parts.append(unpack(words))
        if parts:
            yield from out(parts)

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(value or "").encode() for value in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array([pa.compress(r, "zstd", asbytes=True) if r else b"" for r in raw], pa.binary()), pa.array(map(len, raw), pa.int64()), batch.column("doc")], ["block", "payload", "size", "doc"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block, the block's words before its texts."""
        split, known, tokens, rest, last = splitter(), head.value, token_bytes(name), {}, None
        for batch in batches:
            ids, rows, held = [], [], 0
            for i, (block, payload, size) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("block", "payload", "size")))):
                if block != last:
                    rest, last = {}, block
                if size is None:
                    ids_of = unpack(payload)["ids"].combine_chunks()
                    rest.update(zip(words_of(tokens, ids_of), ids_of.to_pylist()))
                    continue
                words = split(pa.decompress(payload, size, "zstd", asbytes=True).decode()) if size else ()
                ids.append(b"".join([known[word] if word in known else rest[word] for word in words]))
                rows.append(i)
                held += len(ids[-1])
                if held > OUT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), batch.column("doc").take(pa.array(rows, pa.int64()))], ["ids", "doc"])
                    ids, rows, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), batch.column("doc").take(pa.array(rows, pa.int64()))], ["ids", "doc"])
            pa.default_memory_pool().release_unused()

    # the one column besides `keep` holds its place where nothing is kept
    placed = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(0).alias(unused(docs, "none")[0])).alias("doc"), F.col(text).alias("text"), F.pmod(row_hash(docs, 11), F.lit(blocks)).alias("block"))
    kind = placed.schema["doc"].dataType.simpleString()
    found = placed.select("block", "text").mapInArrow(rare, "bucket long, words binary")
    coded = found.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(encode_bucket, "block long, payload binary")
    texts = placed.mapInArrow(shrink, f"block long, payload binary, size long, doc {kind}")
    both = coded.withColumns({"size": F.lit(None).cast("long"), "doc": F.lit(None).cast(kind)}).unionByName(texts)
    met = both.repartition(n, "block").sortWithinPartitions("block", F.col("size").isNotNull())
    return met.mapInArrow(assemble, f"ids binary, doc {kind}").select(*[F.col(f"doc.`{c}`") for c in keep], F.col("ids").alias(to))


def decode(df: DataFrame, name: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """df with the bytes that packed ids stand for."""

    @F.arrow_udf("binary")
    def join(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = token_bytes(name)
        for batch in batches:
            yield pa.array([joined(tokens, x.as_py()) if x.is_valid else None for x in batch], pa.binary())
            pa.default_memory_pool().release_unused()

    return df.withColumn(to, join(F.col(ids)))


def joined(tokens: pa.Array, ids: bytes) -> bytes:
    """The bytes of the ids, one after the other."""
    if not ids:
        return b""
    found = tokens.take(pa.array(np.frombuffer(ids, "<u4").astype("i8")))
    if found.null_count:
        raise ValueError("an id that stands for no token")
    _, ends, data = found.buffers()
    return data[: int(np.frombuffer(ends, "<i4", len(found) + 1)[-1])].to_pybytes()


def words_of(tokens: pa.Array, ids: pa.Array) -> list[str]:
    """The words that packed ids stand for: a word is what its ids decode to, so that it need not travel with them."""
    flat = pa.array(np.frombuffer(b"".join(ids.to_pylist()), "<u4").astype("i8"))
    _, ends, data = tokens.take(flat).buffers()
    sizes = np.fromiter((len(x) // 4 for x in ids.to_pylist()), "i8", len(ids))
    upto = np.frombuffer(ends, "<i4", len(flat) + 1)[np.cumsum([0, *sizes])]
    return pa.Array.from_buffers(pa.string(), len(ids), [None, pa.py_buffer(upto.astype("<i4").tobytes()), data]).to_pylist()


def token_bytes(name: str) -> pa.Array:
    """The token-byte table: the bytes of each id, in order of the ids."""
    if ("bytes", name) not in _opened:
        own = encoder(name)
        table = dict(zip(map(own.encode_single_token, own.token_byte_values()), own.token_byte_values()))
        _opened["bytes", name] = pa.array([table.get(i) for i in range(max(table) + 1)], pa.binary())
    return _opened["bytes", name]


RANKS = "byte_bpe_50k.tiktoken"


def op11_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    encoded = decode(encode(docs, RANKS, keep=["doc_id"]), RANKS)
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

"""Token counts of whole texts under a SentencePiece model, without ever holding token ids of documents.

The model puts one space before the text, writes spaces as U+2581 and merges pieces bottom-up. A merge across a place of the
text makes a piece that holds both characters beside it. So where no piece of the vocabulary has U+2581 after another
character, or letters, digits and other signs side by side, the pieces of a text are those of its pre-tokens: a run of spaces
with the letters, digits or signs after it. `boundaries` reads all that from the vocabulary; what does not hold there makes
the pre-tokens coarser, up to the whole text, and the counts are still right.

1. Frequent pre-tokens are looked for in a sample of about SAMPLE documents, encoded once each and broadcast. An entry must
   make up 1/HEAD of the sample's pre-tokens, and one longer than HEAD_BYTES proportionally more, so the table holds at most
   HEAD * HEAD_BYTES bytes of text whatever the corpus. It only decides where a pre-token is looked up; no count depends
   on it.
2. Per document, the frequencies of pre-tokens are joined to that table in place. The rest become (pre-token, row, times)
   rows, which are brought together by pre-token; each distinct one is encoded once there and its pieces go to all rows
   that hold it. Sums by row complete the counts.

Defined results: null and empty texts have 0 tokens; repeated rows are counted each on its own (rows carry a number within
the job); very long pre-tokens are encoded whole; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import materialise, partitions, utf8_bytes

HEAD, HEAD_BYTES, SAMPLE = 1_000_000, 48, 20_000
#: A task's counter is put out and emptied when it holds this many pre-tokens.
FLUSH = 300_000

_models: dict = {}


def model(name: str):
    """The named model of the public tokenizer files, opened once per worker."""
    if name not in _models:
        import public_tokenizers
        import sentencepiece

        _models[name] = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    return _models[name]


def boundaries(name: str) -> re.Pattern | None:
    """The pattern of pre-tokens (spaces written as such), or None if the vocabulary has pieces that span spaces."""
    m = model(name)
    pieces = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
    if any("▁" in p.lstrip("▁") for p in pieces) or len(m.encode(" ")) != 1 or m.encode("a▁b") != m.encode("a b"):
        return None
    alone = "" if any("\n" in p and len(p) > 1 for p in pieces) else r"\n"
    lines = r"|\n" if alone else ""
    # signs that the pattern language counts as word characters but are not letters, such as superscripts
    odd = re.escape("".join(sorted({c for p in pieces for c in p if re.match(r"[^\W\d_]", c) and not c.isalpha()})))
    kinds = [rf"[^\W\d_{odd}]+", r"\d+", rf"(?:[^\w {alone}]|[_{odd}])+"]
    if all(any(re.fullmatch(k, rest) for k in kinds) for p in pieces if (rest := p.lstrip("▁"))):
        return re.compile(rf" *(?:{'|'.join(kinds)})| +{lines}")
    return re.compile(rf" *[^ {alone}]+| +{lines}")


_patterns: dict = {}


def boundaries_once(name: str) -> re.Pattern | None:
    if name not in _patterns:
        _patterns[name] = boundaries(name)
    return _patterns[name]


def count_pieces(name: str, tokens: list[str]) -> list[int]:
    """Pieces of each pre-token. A first `\\n` stands between the model's own leading space and the pre-token, so that the
    latter is encoded as it is inside a text; its pieces are taken off again."""
    m = model(name)
    if not boundaries_once(name):
        return [len(ids) for ids in m.encode([t[1:] for t in tokens], num_threads=1)]
    lead = len(m.encode("\n"))
    return [len(ids) - lead for ids in m.encode([f"\n{t}" for t in tokens], num_threads=1)]


def pre_tokens(pattern: re.Pattern | None, text: str) -> list[str]:
    if not text:
        return []
    text = " " + text.replace("▁", " ")
    return pattern.findall(text) if pattern else [text]


def frequent(texts: DataFrame, name: str) -> dict[str, int]:
    """Pieces of the frequent pre-tokens of a sample."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, seen = boundaries_once(name), Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(pre_tokens(pattern, text))
            if len(seen) > FLUSH:
                yield out()
                seen = Counter()
        if seen:
            yield out()

    sums = materialise(texts.select("text").mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")), "pieces")
    total = sums.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * HEAD >= F.lit(total) * F.greatest(F.lit(1.0), F.octet_length("token") / HEAD_BYTES)
    words = [r.token for r in sums.filter(often & (F.col("n") > 1)).select("token").toLocalIterator()]
    return dict(zip(words, count_pieces(name, words)))


def count_tokens(docs: DataFrame, name: str, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs and n_tokens for each row."""
    spark = docs.sparkSession
    share = SAMPLE / max(1, docs.count())
    sample = docs if share >= 1 else docs.sample(share, seed=9)
    head = spark.sparkContext.broadcast(frequent(sample, name))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row (no token) with what is known of each document, and rows for the pre-tokens still to be looked up."""
        pattern, known = boundaries_once(name), head.value
        for batch in batches:
            tokens, rows, times, docs = [], [], [], []
            for i, (row, text) in enumerate(zip(batch.column("_row").to_pylist(), batch.column("text").to_pylist())):
                counts = Counter(pre_tokens(pattern, text))
                rest = [t for t in counts if t not in known]
                docs += [i] + [None] * len(rest)
                tokens.append(None)
                rows.append(row)
                times.append(sum(n * known[t] for t, n in counts.items() if t in known))
                tokens += rest
                rows += [row] * len(rest)
                times += [counts[t] for t in rest]
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array(rows, pa.int64()), pa.array(times, pa.int64()), batch.column("doc").take(pa.array(docs, pa.int64()))], ["token", "row", "times", "doc"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by pre-token: each is encoded where it first comes up."""
        last, pieces = None, 0
        for batch in batches:
            runs = batch.column("token").dictionary_encode()
            words = runs.dictionary.to_pylist()
            if not words:
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("times"), batch.column("doc")], ["row", "n", "doc"])
                continue
            counts = [pieces, *count_pieces(name, words[1:])] if words[0] == last else count_pieces(name, words)
            last, pieces = words[-1], counts[-1]
            each = pa.array(counts, pa.int64()).take(runs.indices).fill_null(1)  # no token: what is known already
            yield pa.RecordBatch.from_arrays([batch.column("row"), pc.multiply(batch.column("times"), each), batch.column("doc")], ["row", "n", "doc"])

    rows = docs.select(F.struct(*keep).alias("doc"), "text").withColumn("_row", F.monotonically_increasing_id())
    kind = rows.schema["doc"].dataType.simpleString()
    found = rows.mapInArrow(look_up, f"token string, row long, times long, doc {kind}")
    # what has no token to look up is spread by its row
    key = F.when(F.col("token").isNull(), F.xxhash64("row")).otherwise(F.xxhash64("token"))
    dealt = found.withColumn("_key", key).repartition(partitions(spark), "_key").sortWithinPartitions("token").drop("_key")
    sums = dealt.mapInArrow(encode, f"row long, n long, doc {kind}").groupBy("row").agg(F.sum("n").alias("n_tokens"), F.first("doc", ignorenulls=True).alias("doc"))
    return sums.select("doc.*", "n_tokens")


MODEL, LIMIT = "piece_bpe_32k.model", 4096


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", utf8_bytes(F.col("text")).alias("n_bytes"))
    counted = count_tokens(docs, MODEL, ["doc_id", "n_bytes"])
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))

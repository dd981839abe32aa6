"""Byte-level BPE, Merkle manifests and token alignment against the libraries and brute force, on odd inputs and clashing columns."""

from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import align, bpe, manifest, registry

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = [None, "", " ", "\n\n  \n", "don't we'll  go\t12 34,567!! naïve été 東京 🙂🙂", "<|endoftext|> <s> </s>", "a▁b ▁ c", "x\x00y\x1c z", "word " * 3000 + "tail", "q" * 5000, "՘⃁ odd", "same text here", "same text here", "  lead", "end  "]


def docs(spark, texts=TEXTS):
    rows = spark.createDataFrame([(i if i % 7 else None, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)
    return rows.withColumns({"ids": F.lit("clash"), "block": F.lit(1), "_k": F.lit("k"), "place": F.lit(2), "doc": F.lit("d"), "n": F.monotonically_increasing_id()})


# --- byte-level BPE -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("head", [bpe.HEAD, 10])
def test_bpe_is_the_librarys(spark, monkeypatch, head):
    """With most words from the table of frequent ones, and with nearly all of them shuffled."""
    monkeypatch.setattr(bpe, "HEAD", head)
    rows = docs(spark)
    got = bpe.decode(bpe.encode(rows, bpe.RANKS, to="tokens"), bpe.RANKS, ids="tokens", to="again").collect()
    assert sorted(got[0].asDict()) == sorted([*rows.columns, "tokens", "again"]) and len(got) == len(TEXTS)
    for r in got:
        assert np.frombuffer(r.tokens, "<u4").tolist() == bpe.encoder(bpe.RANKS).encode_ordinary(r.text or "")
        assert bytes(r.again).decode() == (r.text or "") and (r.ids, r.block, r.doc) == ("clash", 1, "d")
    assert bpe.encode(rows.limit(0), bpe.RANKS).count() == 0
    assert bpe.encode(rows, bpe.RANKS, keep=[]).columns == ["ids"]
    with pytest.raises(Exception, match="index|token"):
        bpe.decode(spark.createDataFrame([(bytes(4 * b"\xff"),)], "ids binary"), bpe.RANKS).collect()


# --- Merkle manifest ------------------------------------------------------------------------------------------------------


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_path(levels, place):
    out = []
    for nodes in levels[:-1]:
        first = place // 3 * 3
        run = nodes[first : first + 3]
        out.append((run[: place - first], run[place - first + 1 :]))
        place //= 3
    return out


def plain_manifest(rows):
    shown = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: digest(*map(shown, (r.doc_id, r.source, r.lang, r.n_chars, text)))
    sources = sorted({r.source for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = [sorted((r for r in rows if r.source == s), key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text))) for s in sources]
    trees = [plain_levels([leaf(r, r.text) for r in g]) for g in groups]
    top = plain_levels([t[-1][0] for t in trees])
    out = []
    for k, group in enumerate(groups):
        for place, r in enumerate(group):
            path, text = plain_path(trees[k], place) + plain_path(top, k), r.text
            if r.doc_id is not None and crc32(str(r.doc_id).encode()) % 2 == 0 and text:
                text = text.replace("\n", "")
            node = leaf(r, text)
            for left, right in path:
                node = digest(*left, node, *right)
            out.append((r.doc_id or -1, leaf(r, r.text), trees[k][-1][0], top[-1][0], digest(*[x for a, b in path for x in a + b]), node, node == top[-1][0]))
    return sorted(out)


@pytest.mark.parametrize(("n", "most"), [(1, 8), (2, 1), (90, 2), (400, 2), (400, 8)])
def test_manifest_is_the_plain_one(spark, n, most):
    """One leaf, a hot source in many superblocks, many sources of one row, null ids and sources, equal rows."""
    rows = [(None if i % 50 == 3 else i, f"a{i}\nb" if i % 3 else None, None if i % 11 == 0 else "en", (None, "hot", f"s{i}é", "b")[min(3, i % 7)] if i % 2 else "hot", i if i % 5 else None) for i in range(n)]
    frame = spark.createDataFrame(rows + rows[-2:] * (n > 1), DOCS).withColumns({"tree": F.lit("t"), "node": F.lit("n"), "cell": F.lit("c"), "leaf_": F.lit("x")})
    changed = [F.translate("text", "\n", "") if c == "text" else F.col(c) for c in manifest.FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, manifest.leaf(*changed))
    got = manifest.manifest(frame, manifest.FIELDS, "doc_id", "source", tampered, keep=["doc_id", "tree", "node", "cell"], most=most).collect()
    assert all((r.tree, r.node, r.cell) == ("t", "n", "c") for r in got)
    assert sorted((r.doc_id if r.doc_id is not None and r.doc_id == r.doc_id and r.doc_id else -1, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got) == plain_manifest(frame.collect())


def test_manifest_of_nothing(spark):
    assert manifest.manifest(spark.createDataFrame([], DOCS), manifest.FIELDS, "doc_id", "source").count() == 0


# --- alignment ------------------------------------------------------------------------------------------------------------


def plain_alignment(text):
    """Tokens, links and groups of a text as both libraries give them."""
    tokenizer, bytes_a = align.tokenizer(align.A)
    a, b = tokenizer.encode(f" {text}", add_special_tokens=False).ids, align.model(align.B).encode(text)
    parts = [[bytes_a[i] for i in a], [align.piece_bytes(align.B)[i] for i in b]]
    if any(b"".join(p) != f" {text}".encode() for p in parts):
        return None
    ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
    links, groups, i, j = [], [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        to_a, to_b = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
        groups.append(",".join(map(str, a[i:to_a])) + "|" + ",".join(map(str, b[j:to_b])))
        links.append((a[to_a - 1], b[to_b - 1]))
        i, j = to_a, to_b
    return len(a), len(b), links, ";".join(groups)


@pytest.mark.parametrize("small", [False, True])
def test_alignment_is_the_plain_one(spark, monkeypatch, small):
    """Whole, and with bitmaps put out in parts that are merged."""
    if small:
        monkeypatch.setattr(align, "LINKS", 5)
    rows = docs(spark).coalesce(1 if small else 2)
    out, counts = align.align(rows, align.A, align.B)
    got = {r.n: r for r in out.collect()}
    assert sorted(next(iter(got.values())).asDict()) == sorted([*rows.columns, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])
    plain = {r.n: plain_alignment(r.text) if r.text else None for r in rows.collect()}
    times = Counter(x for p in plain.values() if p for x in p[2])
    most = Counter()
    for (_, b), n in times.items():
        most[b] = max(most[b], n)
    assert None in plain.values() and len(got) == len(TEXTS)
    for n, p in plain.items():
        r, want = got[n], (0, 0, 0, 0, 0, "") if p is None else (p[0], p[1], len(p[2]), sum(times[x] == most[x[1]] for x in p[2]), sum(times[x] for x in p[2]), p[3])
        assert (r.n_a, r.n_b, r.n_links, r.n_best, r.count_sum, r.groups) == want and r.n_groups == r.n_links
    documents = Counter(x for p in plain.values() if p for x in set(p[2]))
    assert {(r.a, r.b): (r.documents, r.links, r.best) for r in counts.collect()} == {x: (documents[x], n, n == most[x[1]]) for x, n in times.items()}
    assert align.align(rows.limit(0), align.A, align.B)[0].count() == 0


def test_bitmaps():
    for places in ([], [0], [65535], list(range(0, 65536, 9)), list(range(65536))):
        value = align.bitmap(np.array(places, "<u2"))
        assert align.places(value).tolist() == places and len(value) <= align.WHOLE
    keys = np.array([7 << 16 | 5] * 6 + [7 << 16 | 9] + [3 << 16 | 5] * 2)
    found = [(plane, pair, align.places(v).tolist()) for plane, pairs, values in align.planes(keys) for pair, v in zip(pairs.tolist(), values)]
    assert found == [(0, 3, [5]), (0, 7, [5, 9]), (1, 3, [5]), (1, 7, [5]), (3, 7, [5])]  # 6 = 1 + 5, 2 = 1 + 1


# --- the queries ----------------------------------------------------------------------------------------------------------


def test_new_queries_return_every_document(spark):
    folder = "/root/testdata/sf0.001"
    for name, columns in {"op11_bpe_round_trip": 4, "op12_merkle_manifest": 7, "op13_token_alignment": 8}.items():
        got = registry.QUERIES[name](spark, folder)
        assert len(got.columns) == columns and got.count() == spark.read.parquet(f"{folder}/documents.parquet").count()

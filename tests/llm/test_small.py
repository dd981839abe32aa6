"""Pure functions and small tables: brute force, round trips and the defined results of odd inputs."""

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from factloom.llm import ann, chat, decontaminate, mixing, sharding, simhash, tokens, toxicity, urlfilter, warc
from factloom.llm.common import running_sums

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


# --- sharding -------------------------------------------------------------------------------------------------------------


def plain_walks(image, n):
    """Steps from each number below n through outer cells, followed one by one."""
    longest = 0
    for x in range(n):
        y, steps = image[x], 0
        while y >= n:
            y, steps = image[y], steps + 1
        longest = max(longest, steps)
    return longest


@pytest.mark.parametrize("n", [1, 2, 3, 7, 50, 101, 942, 943, 1000, 5003])
def test_permutation(spark, n):
    got = spark.range(n).select(sharding.permuted(spark, F.col("id"), n, 20240).alias("p")).collect()
    assert sorted(r.p for r in got) == list(range(n))
    a, b = sharding.halves(n)
    image = [r.x for r in spark.range(a * b).select("id", sharding.feistel(F.col("id"), n, 20240).alias("x")).orderBy("id").collect()]
    assert sorted(image) == list(range(a * b))
    assert sharding.walks(spark, n, 20240) == plain_walks(image, n)


def test_walks_of_every_small_count(spark):
    """For many counts at once: each cell's image, by the network's own rule in a table of counts."""
    for n in range(1, 120):
        a, b = sharding.halves(n)
        assert n <= a * b < n + a
    steps = [sharding.walks(spark, n, 20240) for n in range(930, 950)]
    assert max(steps) <= 31  # fewer than the outer cells


def test_plan_of_the_walk_is_small(spark):
    plans = [spark.range(n).select(sharding.permuted(spark, F.col("id"), n, 20240))._jdf.queryExecution().toString() for n in (942, 1000, 99_991)]
    assert max(map(len, plans)) < 20_000


def test_shards(spark):
    rows = docs(spark, [(i, "same" if i % 3 else None, None) for i in range(50)] + [(7, "same", None)] * 3).withColumn("shard", F.lit("clash"))
    got = sharding.shard_rows(rows, 4).collect()
    assert len(got) == 53
    for s in range(4):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots))) and len(slots) in (13, 14)
    again = sharding.shard_rows(rows.repartition(7), 4).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in got if r.doc_id != 7) == sorted((r.doc_id, r.shard, r.slot) for r in again if r.doc_id != 7)
    assert sharding.shard_rows(rows.limit(0), 4).count() == 0


def test_shards_of_clashing_columns_and_long_texts(spark):
    long_ = "word " * 200_000
    rows = docs(spark, [(i, long_ if i == 4 else str(i), None) for i in range(9)] + [(None, None, None)])
    for c in ("_first", "_second", "_rank", "_place", "_at", "_part", "_spread", "_start", "n"):
        rows = rows.withColumn(c, F.lit(c))
    got = sharding.shard_rows(rows, 3).collect()
    assert sorted((r.shard, r.slot) for r in got) == sorted((s, t) for s in range(3) for t in range(4 if s == 0 else 3))
    assert all(r[c] == c for r in got for c in ("_first", "_second", "_rank", "_place", "_at", "_part", "_spread", "_start", "n"))
    assert sorted(len(r.text or "") for r in got)[-1] == 1_000_000


# --- mixing ---------------------------------------------------------------------------------------------------------------


def test_mix(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * 1 for _ in range(rng.randint(1, 9))), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(400)] + [(900, None, "b"), (901, "", "a")]
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    total = sum(r["size"] for r in got)
    order = sorted({r.source for r in got}, key=lambda s: (s is None, s))
    size = {s: sum(r["size"] for r in got if r.source == s) for s in order}
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, open_, left = {}, set(order), total  # water filling by hand
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * size[s]}
        target |= {s: float(3 * size[s]) for s in full} or share
        left -= sum(3 * size[s] for s in full)
        open_ = open_ - full if full else set()
    for s in order:
        mine = [r for r in got if r.source == s]
        assert all(abs(r.target - target[s]) < 1e-6 * max(1, total) for r in mine)
        assert abs(sum(r.taken for r in mine) - target[s]) <= 9
        assert all(r.taken in (0, r["size"], 2 * r["size"], 3 * r["size"]) for r in mine)
    assert sum(r.taken for r in got) <= total
    assert mixing.mix(docs(spark, [])).count() == 0
    assert mixing.mix(docs(spark, [(1, None, "a"), (2, "", None)])).filter("taken = 0").count() == 2


def test_mix_is_sort_and_truncate(spark):
    """The copies that the operator takes are those of a plain queue: all passes by virtual time, cut at the budget."""
    rng = random.Random(8)
    rows = [(i, "w " * rng.randint(0, 12), rng.choice("aaab")) for i in range(120)] + [(500, "w " * 400, "c")] + [(600, "same words here", "d")] * 9
    rows = docs(spark, rows).withColumns({"_n": F.lit("n"), "_upto": F.lit("upto"), "size": F.lit("clash"), "_part": F.lit(7)})
    got = mixing.mix(rows).collect()
    assert all(r._n == "n" and r._upto == "upto" and r._part == 7 for r in got)
    queue = {}
    for r in rows.drop("size").withColumns({"h": F.xxhash64(F.lit(606).cast("long"), *sorted(c for c in [*rows.columns, ] if c != "size")), "words": mixing.words(F.col("text"))}).collect():
        queue.setdefault(r.source, []).append((r.h, r.doc_id, r.words))
    assert sum(r["size"] for r in got) == sum(w for q in queue.values() for *_, w in q)
    turns = []
    size = {s: sum(w for *_, w in q) for s, q in queue.items()}
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(size))}
    copies = {}
    for r in got:
        copies.setdefault((r.source, r.doc_id), []).append(r.copies)
    for s in queue:  # places in the queue are the operator's business; its copies fall by their order alone
        taken = sum(r.taken for r in got if r.source == s)
        target = next(r.target for r in got if r.source == s)
        assert abs(taken - target) <= max(w for *_, w in queue[s]) + max(w for q in queue.values() for *_, w in q) * weight[s]
        assert {c for (x, _), cs in copies.items() if x == s for c in cs} <= set(range(4))
        levels = [r.copies for r in got if r.source == s and r["size"]]
        assert max(levels) - min(levels) <= 1
    assert sum(r.taken for r in got) <= sum(size.values())
    assert sorted(r.doc_id for r in mixing.repeat(mixing.mix(rows)).collect()) == sorted(x for (_, d), cs in copies.items() for c in cs for x in [d] * c)


def test_running_sums(spark):
    rng = random.Random(9)
    rows = [(i, rng.randint(0, 5), rng.random()) for i in range(300)] + [(7, 2, 0.5)] * 200
    got = running_sums(spark.createDataFrame(rows, "k long, n long, x double"), ["k"], {"n": "n_upto", "x": "x_upto"}, "test").collect()
    seen_n = seen_x = 0
    for r in sorted(got, key=lambda r: (r.k, r.n_upto, r.x_upto)):
        seen_n, seen_x = seen_n + r.n, seen_x + r.x
        assert r.n_upto == seen_n and abs(r.x_upto - seen_x) < 1e-9


# --- urls -----------------------------------------------------------------------------------------------------------------


def test_urls(spark):
    urls = ["http://A.Example.com/en/1?x", "https://www.example.com/en/", "http://example.com/fr/1", "http://x.net/es/9#t", "net/es/", None, "http://", "http://example.com", "http://notexample.com/en/", "ftp://y.net/fr/a://b"]
    want = [("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("com/", "allow"), ("net/es/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("com/", "allow"), ("net/fr/", "block")]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = [(r.rule, r.verdict) for r in urlfilter.judge(pages, urlfilter.RULES).orderBy("page_id").collect()]
    assert got == want
    joined = [(r.rule, r.verdict) for r in urlfilter.judge(pages, urlfilter.RULES, max_bytes=0).orderBy("page_id").collect()]
    assert joined == want
    assert urlfilter.judge(pages, []).filter("verdict != 'allow'").count() == 0
    assert urlfilter.judge(pages.limit(0), urlfilter.RULES).count() == 0


def plain_verdict(url, rules):
    if url is None or "://" not in url:
        host, path = "", ""
    else:
        rest = url.split("://", 1)[1]
        host = next((rest[:i] for i, c in enumerate(rest) if c in "/?#"), rest)
        path = next((rest[len(host) :][:i] for i, c in enumerate(rest[len(host) :]) if c in "?#"), rest[len(host) :])
        host = "".join(c.lower() if c.isascii() else c for c in host)
    last = {(h, p): v for h, p, v in rules}
    fits = [(len((h + p).encode()), len(h.encode()), h + p, v) for (h, p), v in last.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, "allow")


def test_urls_both_ways_against_brute_force(spark):
    """Ties of equal length, rules given twice, letters of several bytes, repeated and very long urls."""
    rules = [("y.com", "/q", "allow"), ("com", "/q/r.a", "block"), ("a.com", "/ab", "block"), ("com", "/abcd", "allow"), ("é.fr", "/é", "block"), ("fr", "/éab", "allow"), ("y.com", "/q", "block"), ("com", "", "allow"), ("a.com", "", "block")]
    urls = ["http://y.com/q/r.a", "http://x.a.com/abcd", "http://é.fr/éab", "http://A.COM", "http://com/", None, "", "http://y.com/q/r.a", "https://y.com/" + "q/" * 50_000, "http://y.com/q#://com/abcd", "http://ya.com/ab"]
    pages = spark.createDataFrame([(i, u, "x", "y", "z") for i, u in enumerate(urls)], "page_id long, url string, _found string, _row string, verdict string")
    want = [plain_verdict(u, rules) for u in urls]
    for most in (urlfilter.MAX_BYTES, 0):
        got = urlfilter.judge(pages, rules, max_bytes=most).orderBy("page_id").collect()
        assert [(r.rule, r.verdict) for r in got] == want and all((r._found, r._row) == ("x", "y") for r in got)


# --- decontamination ------------------------------------------------------------------------------------------------------


def test_lcs():
    def plain(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 30))] for _ in range(2))
        assert decontaminate.lcs(a, b) == plain(a, b)


def test_leaks(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    vocabulary = [word() for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(20 + i)) for i in range(10)] + [(90, "quite short one"), (91, None), (92, ""), (93, text(150))]
    clean = [(i, text(rng.randint(5, 300))) for i in range(60)]
    leaky = [(100 + i, f"{text(77)} {items[i][1].upper()}. {text(50)}") for i in range(10)]
    long_ = [(200, f"{text(20_000)} {items[3][1]} {text(500)}")]
    short = [(400, f"{text(30)} Quite, short one! {text(9)}"), (401, f"{text(9)} quite so short a one {text(9)}"), (402, "quite short one")]
    part = [(403, f"{text(40)} {' '.join(items[-1][1].split()[70:140])} {text(40)}")]
    rows = docs(spark, [(i, t, "s") for i, t in clean + leaky + long_ + short + part] + [(300, None, None), (301, "", None)] + [(100, leaky[0][1], "s")] * 2 + [(None, leaky[1][1], "s")])
    rows = rows.withColumns({"_terms": F.lit("x"), "_matches": F.lit("y")})
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = {(100 + i, i) for i in range(10)} | {(200, 3), (400, 90), (402, 90), (403, 93), (None, 1)}
    for per_block in (decontaminate.PASSAGES, 5):  # all passages at once, and in several blocks
        got = decontaminate.with_matches(rows, benchmark, per_block=per_block).filter("_terms = 'x' and _matches = 'y'").select("doc_id", F.explode("matches.item_id").alias("item")).collect()
        assert {(r.doc_id, r.item) for r in got} == want
    assert decontaminate.decontaminate(rows, benchmark.limit(0)).count() == rows.count()
    assert decontaminate.decontaminate(rows.limit(0), benchmark).count() == 0


def vocabulary(rng, n):
    """A word maker over n invented words."""
    words = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(n)]
    return lambda k: " ".join(rng.choice(words) for _ in range(k))


def leaks(rows, benchmark):
    return {(r.doc_id, r.item) for r in decontaminate.with_matches(rows, benchmark).select("doc_id", F.explode("matches.item_id").alias("item")).collect()}


def test_leaks_in_a_third_of_the_rows(spark):
    text = vocabulary(random.Random(11), 3000)
    hot, other = text(30), text(24)
    rows = [(i, f"{text(40)} {hot} {text(60)}" if i % 3 == 0 else text(120), "s") for i in range(90)] + [(200, f"{text(30)} {other}", "s")]
    benchmark = spark.createDataFrame([(1, hot), (2, other)], "item_id long, text string")
    assert leaks(docs(spark, rows), benchmark) == {(i, 1) for i in range(0, 90, 3)} | {(200, 2)}


def test_leak_in_every_row(spark):
    text = vocabulary(random.Random(12), 3000)
    hot = text(30)
    rows = [(i, f"{text(40)} {hot} {text(60)}", "s") for i in range(60)]
    assert leaks(docs(spark, rows), spark.createDataFrame([(1, hot)], "item_id long, text string")) == {(i, 1) for i in range(60)}


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_leaks_among_few_rows(spark, n):
    text = vocabulary(random.Random(13), 3000)
    item = text(25)
    rows = [(0, f"{text(50)} {item} {text(30)}", "s")] + [(i, text(100), "s") for i in range(1, n)]
    assert leaks(docs(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string")) == {(0, 1)}


def every_window(words, passage, judge, j):
    """What longest common subsequence and answer confirm, over all windows of the two lengths that begin at any word."""
    sizes = [n * decontaminate.BLOCK for n, _ in decontaminate.WINDOWS]
    for size in sizes:
        for s in range(max(1, len(words) - size + 1)):
            judge.confirm(words[s : s + size], j, 0.0, best := {})
            if best:
                return True
    return False


def test_paraphrases_against_all_windows(spark):
    """Words swapped, dropped, replaced and reordered: at least nine of ten documents that an exhaustive search over all
    windows confirms are found, and none that it does not."""
    rng = random.Random(15)
    text = vocabulary(rng, 3000)
    items = [(i, text(20 + 3 * i)) for i in range(14)]
    planted = []
    for i, t in items * 4:
        words = t.split()
        cut = len(words) - max(4, len(words) // 4)
        kind = len(planted) % 4
        for _ in range(len(words) // 6):
            at = rng.randrange(cut)
            if kind == 0:
                words[at] = text(1)
            elif kind == 1 and cut > 8:
                del words[at]
                cut -= 1
            elif kind == 2 and at:
                words[at - 1], words[at] = words[at], words[at - 1]
        if kind == 3:
            half = cut // 4
            words = words[half:cut] + words[:half] + words[cut:]
        planted.append(f"{text(rng.randint(0, 120))} {' '.join(words)} {text(rng.randint(0, 120))}")
    rows = docs(spark, [(i, t, "s") for i, t in enumerate(planted + [text(200) for _ in range(80)])])
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = leaks(rows, benchmark)
    df, n, windows = decontaminate.document_frequencies(rows)
    idf = decontaminate.idf_of(df, n)
    passages = [(i, t.split()) for i, t in items]
    judge = decontaminate.Judge(passages, idf, *decontaminate.latent_space(rows, windows, [w for _, w in passages], idf))
    plain = {(r.doc_id, i) for r in rows.collect() for j, (i, p) in enumerate(passages) if every_window(r.text.split(), p, judge, j)}
    assert len(plain) >= 50
    assert got <= plain and len(got) >= 0.9 * len(plain)


def test_candidates_hold_every_paraphrase(spark):
    """Half of a passage's words and its answer kept: what longest common subsequence and answer confirm on all windows is a candidate."""
    rng = random.Random(14)
    text = vocabulary(rng, 3000)
    passages = [(i, text(24 + 2 * i).split()) for i in range(12)]
    planted = []
    for _, words in passages * 6:
        cut = len(words) - max(4, len(words) // 4)
        dropped = set(rng.sample(range(cut), len(words) // 2))
        kept = [text(1) if i in dropped else w for i, w in enumerate(words)]
        planted.append(f"{text(rng.randint(0, 90))} {' '.join(kept)} {text(rng.randint(0, 90))}")
    rows = docs(spark, [(i, t, "s") for i, t in enumerate(planted + [text(150) for _ in range(60)])])
    df, n, windows = decontaminate.document_frequencies(rows)
    idf = decontaminate.idf_of(df, n)
    judge = decontaminate.Judge(passages, idf, *decontaminate.latent_space(rows, windows, [w for _, w in passages], idf))
    column = pa.array([decontaminate.term_ids(t.split()).tolist() for t in planted], pa.list_(pa.int32()))
    plain = set()
    for d, words in enumerate(map(str.split, planted)):
        blocks = -(-len(words) // decontaminate.BLOCK)
        for size, step in decontaminate.WINDOWS:
            for s in range(0, max(1, blocks - size + step), step):
                for j in range(len(passages)):
                    judge.confirm(words[decontaminate.BLOCK * s : decontaminate.BLOCK * (s + size)], j, 0.0, best := {})
                    if best:
                        plain.add((d, decontaminate.BLOCK * s, j))
    assert len({d for d, _, _ in plain}) > 10
    assert plain <= {(d, s, j) for d, s, _, j, _ in judge.candidates(*decontaminate.flat(column))}


# --- warc -----------------------------------------------------------------------------------------------------------------


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u1", "same"), (2, "u\r\n2", "same"), (5, None, "é" * 9000), (6, "u", None), (7, "u", ""), (8, "u", "x"), (8, "u", "x")], "page_id long, url string, html string")
    manifest = warc.write_archive(pages, str(tmp_path / "a"), roll=200)
    got = sorted(warc.read_archive(manifest, str(tmp_path / "a")).collect(), key=lambda r: (r.page_id, r.record_type))
    assert [(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got] == [(1, "revisit", 2, 4), (2, "response", None, 4), (5, "response", None, 18000), (6, "revisit", 7, 0), (7, "response", None, 0), (8, "response", None, 1), (8, "response", None, 1)]
    assert bytes(got[2].payload).decode() == "é" * 9000 and got[1].payload_digest == warc.bare(hashlib.sha1(b"same").hexdigest())
    other = warc.write_archive(pages, str(tmp_path / "b"), roll=200)
    assert sorted((r.file, r.sha256) for r in manifest.collect()) == sorted((r.file, r.sha256) for r in other.collect())
    assert warc.write_archive(pages.limit(0), str(tmp_path / "c")).count() == 0
    assert [(r.page_id, r.url) for r in got] == [(1, "u1"), (2, "u\r\n2"), (5, None), (6, "u"), (7, "u"), (8, "u"), (8, "u")]
    assert not [f for f in (tmp_path / "a").iterdir() if f.name.startswith(".part")]


def test_warc_urls_and_thresholds(spark, tmp_path):
    urls = ["http://a/%20?x=%0D", "http://b/\t%41", " spaced ", "", None, "é: x", "\x7f%"]
    pages = spark.createDataFrame([(i, u, "same body", i) for i, u in enumerate(urls)] + [(None, "n", "other", 9)], "page_id long, url string, html string, digest long")
    got = {r.page_id: r for r in warc.read_archive(warc.write_archive(pages, str(tmp_path / "a"), least=10), str(tmp_path / "a")).collect()}
    assert {i: got[i].url for i in range(7)} == dict(enumerate(urls)) and all(r.record_type == "response" for r in got.values())
    revisits = warc.read_archive(warc.write_archive(pages, str(tmp_path / "b")), str(tmp_path / "b")).filter("record_type = 'revisit'").collect()
    assert {(r.page_id, r.refers_to) for r in revisits} == {(i, 6) for i in range(6)} and {r.page_id: r.url for r in revisits} == dict(list(enumerate(urls))[:6])


def test_warc_copies_have_ids_of_their_own(spark, tmp_path):
    """Rows of equal id and payload, with equal and with other urls, many and with a null id: every record id is its own."""
    rows = [(7, f"u{i % 40}", "same") for i in range(120)] + [(None, None if i % 3 else "v", "") for i in range(90)] + [(None, "w", "same")] * 2 + [(i, f"p{i}", f"text {i}") for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    folder = str(tmp_path / "a")
    manifest = warc.write_archive(pages, folder, roll=500)
    found = [warc.parse(m) for r in manifest.collect() for m in warc.members(open(f"{folder}/{r.file}", "rb"))]
    ids = {f["WARC-Record-ID"] for f in found}
    assert len(found) == len(rows) == len(ids) and {f["WARC-Refers-To"] for f in found if "WARC-Refers-To" in f} <= ids
    got = warc.read_archive(manifest, folder).collect()
    text = lambda r: bytes(r.payload).decode() if r.record_type == "response" else None
    plain = [(i, u, "revisit" if i is None and h == "same" else "response", 7 if i is None and h == "same" else None, None if i is None and h == "same" else h) for i, u, h in rows]
    assert sorted(map(repr, ((r.page_id, r.url, r.record_type, r.refers_to, text(r)) for r in got))) == sorted(map(repr, plain))
    other = warc.write_archive(pages.repartition(2), str(tmp_path / "b"), roll=500)
    assert sorted(f["WARC-Record-ID"] for r in other.collect() for f in map(warc.parse, warc.members(open(f"{tmp_path}/b/{r.file}", "rb")))) == sorted(ids)


# --- simhash --------------------------------------------------------------------------------------------------------------


def test_fingerprints():
    def plain(t, k):
        w = (t or "").encode().lower().split()
        hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))] if w else []
        return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))

    rng = random.Random(4)
    for t in ["", None, " \t", "a", "A b", "a b c", "É\u00a0x b\x0bc d", " ".join(rng.choice("abcdefg") for _ in range(999))]:
        assert simhash.fingerprint(t, 3) == plain(t, 3)


def test_links(spark):
    """Components equal those of all pairs within three bits, with hot anchors split into several keys."""
    rng = np.random.default_rng(5)
    base = rng.integers(-(1 << 63), 1 << 63, 40, np.int64)
    near = [int(b) for b in base]
    for b in base[:12]:
        for _ in range(25):
            x = int(b) & ((1 << 64) - 1)
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(bit)
            near.append(simhash._signed(x))
    near = sorted(set(near))
    rows = spark.createDataFrame([(i, f) for i, f in enumerate(near)] + [(9000, near[0]), (9000, near[0])], "doc_id long, fp long")
    root = list(range(len(near)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(near)):
        for j in range(i):
            if ((near[i] ^ near[j]) & ((1 << 64) - 1)).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    links = simhash.links_at_anchors(rows.select("fp").distinct(), 3, chunk=8)
    assert links.filter("a <= b").count() == 0
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(rows).collect()}
    assert got == {i: find(i) for i in range(len(near))} | {9000: find(0)}


def test_deduplicate(spark):
    rows = docs(spark, [(3, "one two three four five six", "a"), (1, "One two  three four five six", "b"), (1, "One two  three four five six", "b"), (2, "quite another text with other words in it", None), (4, None, None), (5, "", None)])
    assert sorted(r.doc_id for r in simhash.deduplicate(rows).collect()) == [1, 2, 4]
    assert simhash.deduplicate(rows.limit(0)).count() == 0
    # null ids, one id with two texts of a class, long texts, clashing columns
    long_ = " ".join(str(i % 977) for i in range(100_000))
    odd = docs(spark, [(None, "a b c d e f", "x"), (7, "A b c d e f", "x"), (7, "a b  c d e f", "y"), (8, long_, "x"), (9, long_ + " ", "x"), (None, "z y x w v u", "x"), (None, "z y x w v u", "x")]).withColumns({"_fp": F.lit(1), "_own": F.lit(2), "fp": F.lit(3)})
    got = simhash.deduplicate(odd).collect()
    assert sorted((r.doc_id is None, r.doc_id, r._fp, r._own, r.fp) for r in got) == [(False, 7, 1, 2, 3), (False, 8, 1, 2, 3), (True, None, 1, 2, 3)]


# --- nearest neighbours ---------------------------------------------------------------------------------------------------


def plain_neighbours(rows, queries, k):
    """(query row, rank, vec_id, score) over all pairs; rows: (vec_id, vector)."""
    out = {}
    for n, (q, v) in enumerate(queries):
        scored = [(round(float(np.dot(v, w)), 9), i) for i, w in rows if i != q and len(w) == len(v)]
        out[n] = sorted(scored, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 24)) / 5
    x[50:90] = x[50]
    good = [(i, v.tolist()) for i, v in enumerate(x)] + [(480, [1.0, 2.0]), (500, [3.0, 1.0]), (17, x[3].tolist()), (17, x[3].tolist())]
    odd = [(400, None), (420, [0.0] * 24), (440, [float("nan")] * 24), (460, [None] * 24), (481, [])]
    vectors = spark.createDataFrame(good + odd, "vec_id long, embedding array<double>").withColumns({"list": F.lit("clash"), "row": F.lit(1)})
    index = ann.build_index(vectors, 20)
    got = {}
    for r in ann.search(index, vectors.filter("vec_id % 20 = 0"), 20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, round(r.score, 9)))
    queries = [(i, v) for i, v in good if i % 20 == 0]
    want = plain_neighbours(good, queries, 20)
    assert set(got) == {q for q, _ in queries}
    found = total = 0
    for n, (q, _) in enumerate(queries):
        mine = sorted(got[q])
        assert [r for r, *_ in mine] == list(range(1, len(want[n]) + 1))
        found += len({(v, s) for _, v, s in mine} & {(i, s) for s, i in want[n]})
        total += len(want[n])
        if q == 60:  # a hot group: its copies come first, by id
            assert [v for _, v, _ in mine] == [i for i in range(50, 71) if i != 60]
    assert found >= 0.95 * total
    assert ann.search(ann.build_index(vectors.limit(0)), vectors, 20).count() == 0


def test_recall_on_clustered_and_random_vectors(spark):
    rng = np.random.default_rng(16)
    middle = rng.standard_normal((30, 48))
    x = np.concatenate([middle[rng.integers(0, 30, 2500)] + 0.4 * rng.standard_normal((2500, 48)), rng.standard_normal((1500, 48))])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found, queries = 0, range(0, len(x), 20)
    got = {}
    for r in ann.search(ann.build_index(rows, 20), rows.filter("vec_id % 20 = 0"), 20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    for q in queries:
        s = x @ x[q]
        s[q] = -np.inf
        found += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert found >= 0.9 * 20 * len(queries)


def test_bounds_hold(spark):
    """Estimates from packed bits: the certain bound always holds, the narrower one but for chance."""
    rng = np.random.default_rng(17)
    for d in (8, 64, 100):
        q, x, c = rng.standard_normal((40, d)), rng.standard_normal((500, d)), rng.standard_normal(d) / 3
        upper, width = ann.upper_and_slack(*ann.cut(q), q @ c, *ann.encode(x, np.tile(c, (500, 1))), d)
        exact = q @ x.T
        assert (exact <= upper + 1e-3).mean() > 0.95 and (exact >= upper - width - 1e-3).mean() > 0.95
        if d == 8:
            continue
        share = ann.EPSILON / np.sqrt(d - 1)
        assert (exact <= upper + width * (1 / share - 1) / 2 + 1e-3).all()


# --- tokens ---------------------------------------------------------------------------------------------------------------


def test_token_counts(spark):
    texts = ["", None, " ", "  a  b", "a\tb\nc\n\n d", "ﬁ ½² Ａ 123abc", "▁x a▁b", "<s> hi </s>", "x" * 5000, "é　z", "a_b {_} 1,234.5 ²."] + ["word and more. " * 40] * 3
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]), tokens.MODEL, ["doc_id"]).collect()}
    m = tokens.model(tokens.MODEL)
    assert got == {i: len(m.encode(t or "")) for i, t in enumerate(texts)}
    odd = docs(spark, [(None, "a b", "s"), (None, "a b", "s"), (3, "xy" * 100_000 + " end", "s")]).withColumns({"token": F.lit("t"), "row": F.lit(5), "_row": F.lit(6), "doc": F.lit("d")})
    rows = tokens.count_tokens(odd, tokens.MODEL, ["doc_id", "token", "row", "_row", "doc"]).collect()
    assert sorted((r.doc_id is None, r.n_tokens, r.token, r.row, r._row, r.doc) for r in rows) == sorted([(True, len(m.encode("a b")), "t", 5, 6, "d")] * 2 + [(False, len(m.encode("xy" * 100_000 + " end")), "t", 5, 6, "d")])
    assert tokens.count_tokens(odd.limit(0), tokens.MODEL, ["doc_id"]).count() == 0


def test_latent_space_is_fitted_on_all_texts(spark, monkeypatch):
    """The products and frequencies of all windows against a plain matrix: changing any one text changes the fit; copies count
    in the frequencies and once in the fit."""
    monkeypatch.setattr(decontaminate, "FIT_PASSAGES", 4, raising=False)  # a fit on about so many windows would differ
    text = vocabulary(random.Random(16), 500)
    rows = [(i, text(40 + 9 * i), "s") for i in range(30)]
    rows = docs(spark, rows + [(100, rows[0][1], "s"), (101, None, "s"), (102, "", "s")])
    passages = [text(20).split() for _ in range(3)]
    df, n, windows = decontaminate.document_frequencies(rows)
    plain = np.zeros(1 << decontaminate.BITS, int)
    texts = [decontaminate.tokens(r.text) for r in rows.collect()]
    for words in texts:
        plain[list({decontaminate.term(w) for w in words})] += 1
    cut = [w[a : a + decontaminate.SPAN] for w in {tuple(w) for w in texts} for a in range(0, len(w), decontaminate.SPAN)]
    assert n == 33 and (df == plain).all() and windows == len(cut)
    idf = decontaminate.idf_of(df, n)
    matrix = np.zeros((len(cut) + len(passages), 1 << decontaminate.BITS))
    for row, words in zip(matrix, cut + passages):
        np.add.at(row, decontaminate.term_ids(words), 1)
    matrix *= idf
    matrix /= np.linalg.norm(matrix, axis=1)[:, None]
    matrix[len(cut) :] *= np.sqrt(windows / len(passages))
    basis, values = decontaminate.latent_space(rows, windows, passages, idf)
    assert np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-3)
    # nearly all that the best directions of the whole matrix hold is in the space
    best = np.linalg.svd(matrix, compute_uv=False)[: decontaminate.RANK]
    assert (np.linalg.norm(matrix @ basis) / np.linalg.norm(best)) ** 2 > 0.85
    every = np.linalg.norm(matrix[: len(cut)] @ basis, axis=1)
    assert (every > 0.1).all()  # a window left out of the fit would hardly lie in the space of the others
    # the product with all windows, exactly
    rng = np.random.default_rng(5)
    start = rng.integers(0, 8, 1 << decontaminate.BITS), rng.choice(np.array([-1, 1], np.float32), 1 << decontaminate.BITS)
    w = np.zeros((1 << decontaminate.BITS, 8))
    w[np.arange(len(w)), start[0]] = start[1]
    ids = [decontaminate.term_ids(list(x)) for x in {tuple(w) for w in texts}]
    got = np.zeros((1 << decontaminate.BITS, 8), np.float32)
    decontaminate.product(np.concatenate(ids), np.concatenate([[0], np.cumsum([len(x) for x in ids])]), idf, start, got)
    held = rng.standard_normal((1 << decontaminate.BITS, 8)).astype(np.float32)
    flat = np.concatenate(ids), np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    assert np.allclose(decontaminate.square(*flat, idf, held), (matrix[: len(cut)] @ held).T @ (matrix[: len(cut)] @ held), rtol=1e-3, atol=1e-2)
    assert np.allclose(got, matrix[: len(cut)].T @ (matrix[: len(cut)] @ w), atol=1e-3)


def test_fit_and_counts_take_bounded_room(spark):
    """As many parts of the product as cores, whatever the number of files; a batch's words are neither copied nor counted at once."""
    text = vocabulary(random.Random(17), 500)
    rows = spark.createDataFrame([(text(70),) for _ in range(60)], "text string")
    texts = decontaminate.distinct_texts(rows.select(decontaminate.term_arrays(F.col("text"))))
    rng = np.random.default_rng(6)
    start = rng.integers(0, 80, 1 << decontaminate.BITS), rng.choice(np.array([-1, 1], np.float32), 1 << decontaminate.BITS)
    sent = spark.sparkContext.broadcast((np.ones(1 << decontaminate.BITS, np.float32), start))
    cores = spark.sparkContext.defaultParallelism
    parts = decontaminate.products(texts.repartition(5 * cores), sent)
    assert parts.rdd.getNumPartitions() <= cores
    got = np.zeros((1 << decontaminate.BITS, 80), np.float32)
    for r in decontaminate.summed_parts(parts).collect():
        got[r.block + np.frombuffer(r.at, np.int32)] += np.frombuffer(r.part, np.float32).reshape(-1, 80)
    ids = [decontaminate.term_ids(decontaminate.tokens(r.text)) for r in rows.collect()]
    flat = np.concatenate(ids), np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    want = np.zeros((1 << decontaminate.BITS, 80), np.float32)
    decontaminate.product(*flat, *sent.value, want)
    assert want.any() and np.allclose(got, want, atol=1e-3)
    # of 6 million words
    starts = np.arange(0, 6_000_001, 500)
    column = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(rng.integers(-(1 << 15), 1 << 15, 6_000_000).astype(np.int16)))
    seen = np.zeros(1 << decontaminate.BITS, np.int64)
    tracemalloc.start()
    words, starts = decontaminate.flat(column)
    decontaminate.count_terms(words, starts, np.full(len(column), 2), seen)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48_000_000  # the words alone, as long integers
    assert seen.sum() == 2 * sum(len(set(words[a : a + 500].tolist())) for a in range(0, 6_000_000, 500))


def test_a_stage_takes_fingerprints_once(spark):
    rows = docs(spark, [(i, f"some words of text {i}", "s") for i in range(20)] + [(None, "", "s"), (30, "some words of text 3", "s")])
    kept = simhash.deduplicate(rows)
    assert kept._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert kept.count() == 21


def test_terms_are_those_of_the_words_that_confirm(spark, monkeypatch):
    """Null, empty and odd texts: the hashed words stand at the same places as the words that step 4 looks at."""
    odd = ["", "\n", "a", "Straße ﬁ İstanbul ΟΔΟΣ ΣΑΣ", "x_1, ２３ ½ ² Ⅷ 漢字—かな e\u0301 a\u200db", "\U0001e030\U00010570 \U0001f600\U000105ab", "ab" * 3000, "_", "ñ " * 999, None, "end"]
    rows = spark.createDataFrame(list(enumerate(odd)), "i int, text string").withColumn("text", F.when(F.col("i") == 2, F.expr("cast(X'6162ff6320c3' as string)")).otherwise(F.col("text")))
    odd[2] = b"ab\xffc \xc3".decode("utf-8", "replace")
    for most in (decontaminate.LETTERS, 1, 40):
        monkeypatch.setattr(decontaminate, "LETTERS", most)
        ids, counts = decontaminate.cut(pa.array([t and t.encode() for t in odd], pa.binary()))
        assert counts.tolist() == [len(decontaminate.tokens(t)) for t in odd]
        assert ids.tolist() == [decontaminate.term(w) for t in odd for w in decontaminate.tokens(t)]
    got = {r.i: [x & 0xFFFF for x in r.terms] for r in rows.select("i", decontaminate.term_arrays(F.col("text")).alias("terms")).collect()}
    assert got == {i: decontaminate.term_ids(decontaminate.tokens(t)).tolist() for i, t in enumerate(odd)}
    assert len(set(decontaminate.term_ids([f"w{i}" for i in range(2000)]).tolist())) > 1900  # spread like a random hash
    item = " ".join(f"w{i}" for i in range(20))
    leaky = docs(spark, [(1, "\U0001e030\U00010570 \U0001f600\U000105ab " * 30 + item + " z" * 40, "s")])
    assert leaks(leaky, spark.createDataFrame([(7, item)], "item_id long, text string")) == {(1, 7)}


def test_candidates_are_those_that_words_can_confirm():
    """Half of a passage's words in a window make no candidate where its answer is missing; with the answer, or three quarters of
    the words, they do. A word that stands twice in the passage counts for both places."""
    text = vocabulary(random.Random(18), 3000)
    words = text(30).split()
    words[3] = words[9]
    idf = np.ones(1 << decontaminate.BITS, np.float32)
    rng = np.random.default_rng(7)
    basis = np.linalg.qr(rng.standard_normal((1 << decontaminate.BITS, 8)))[0].astype(np.float32)
    judge = decontaminate.Judge([(1, words), (2, text(4).split())], idf, basis, np.ones(8))
    other = text(20).split()
    windows = [words[:18] + other, words[:10] + words[-7:] + other, words[:23] + other, words[:3] + words[4:23] + other, words[-7:] + other]
    ids, size = np.concatenate([decontaminate.term_ids(w[:38]) for w in windows]), [len(w[:38]) for w in windows]
    end = np.cumsum(size)
    one = np.zeros(len(windows), int)
    assert judge.share_enough(ids, end - size, 48, end, one).tolist() == [False, True, True, True, False]
    assert judge.share_enough(ids, end - size, 48, end, one + 1).tolist() == [False] * 5


# --- toxicity -------------------------------------------------------------------------------------------------------------


def plain_features(text):
    """The features that do not hang on the learned list, over the whole text at once."""
    low = (text or "").lower()
    words = toxicity._WORDS.findall(low)
    n, listed = max(1, len(words)), toxicity._LISTED
    at = {k: [i for i, w in enumerate(words) if listed.get(w) == k] for k in range(4)}
    near = sum(any(abs(i - j) <= toxicity.NEAR for j in at[3]) for i in at[0] + at[1] + at[2])
    return {
        "insult_words": len(at[0]), "coarse": 1000 * len(at[1]) / n, "threats": 1000 * len(at[2]) / n, "second_person": 1000 * len(at[3]) / n, "near_second_person": 1000 * near / n, "kinds": len({w for w in words if listed.get(w, 3) < 3}),
        "capitals": 100 * sum(c in toxicity.string.ascii_uppercase for c in text) / max(1, sum(map(len, words))), "shouted": 100 * sum(len(w) > 2 and w.isupper() for w in toxicity._WORDS.findall(text)) / n,
        "punctuation": 100 * sum(c in "!?#$%&*" for c in text) / max(1, len(text)), "runs": 1000 * len(toxicity._RUNS.findall(text)) / n, "obfuscated_words": toxicity._obfuscated(low), "length": float(np.log1p(n)),
    }


def test_remembered_tokens_take_little_memory():
    """Words on no list share a row for each length, whatever their number; features are those of tokens described apart."""
    rng = random.Random(17)
    text = " ".join("".join(rng.choice("bcdfgklmnprst") for _ in range(rng.randint(5, 12))) + rng.choice(["", ",", "!"]) for _ in range(60_000)) + " you idiot"
    known = toxicity.Tokens({"glarn$": 2.0})
    got = toxicity.features(text, known)
    assert len(known) > 50_000 and known.table.nbytes < 0.6 * len(known) * len(toxicity.COUNTED) * 8
    rows = np.array([known.describe(t)[0] for t in text.split()])
    assert (known.rows(text.split())[1] == rows).all()
    forgetful = toxicity.Tokens({"glarn$": 2.0}, 1)
    assert got == toxicity.features(text, forgetful) == toxicity.features(text, known)


def test_features():
    plain = toxicity.Tokens({})
    assert toxicity.features(None, plain) == toxicity.features("", plain) == toxicity.features(" \n", plain) == [0.0] * len(toxicity.FEATURES)
    f = dict(zip(toxicity.FEATURES, toxicity.features("You IDIOT, you 1d1ot and st*pid m.o.r.o.n!", plain)))
    assert f["insult_words"] == 1 and f["obfuscated_words"] == 3 and f["near_second_person"] > 0 and f["capitals"] > 0
    rng = random.Random(10)
    bits = ["you", "IDIOT", "moron...", "1d1ot!", "plain", "Words", "SHOUT", "kill", "shit?!", "m.o.r.o.n", "don't", "é", "--", "12", "your-fool"]
    for k in (3, 30, 3000):
        text = " ".join(rng.choices(bits, k=k))
        f = dict(zip(toxicity.FEATURES, toxicity.features(text, plain)))
        assert all(abs(f[c] - x) < 1e-9 for c, x in plain_features(text).items()), k
    # words of very long tokens keep their place among the others
    bits += ["/".join(["bbbbb"] * 12 + ["idiot"]), "x" * 200, "you-" * 30, "kill/" * 25 + "YOU"]
    for k in (3, 60, 3000):
        text = " ".join(rng.choices(bits, k=k))
        f = dict(zip(toxicity.FEATURES, toxicity.features(text, plain)))
        assert all(abs(f[c] - x) < 1e-9 for c, x in plain_features(text).items()), k
    for pad in (9, 10, 11, 12, 13):  # the token's length passes 64 characters here
        text = " ".join(["you", *["word"] * 40, "/".join(["bbbbb"] * pad + ["idiot"])])
        assert dict(zip(toxicity.FEATURES, toxicity.features(text, plain)))["near_second_person"] == 0
    learned = dict(zip(toxicity.FEATURES, toxicity.features("glarn foo glarnish", toxicity.Tokens({"glarn$": 2.0, "glar": 1.5}))))
    assert (learned["learned_words"], learned["learned_kinds"], learned["learned_most"], learned["learned"]) == (2, 2, 2.0, 3500 / 3)


def test_unlabelled(spark):
    rows = docs(spark, [(1, "a moron and a liar", "s"), (2, "fine", "s"), (3, None, None), (4, "one moron", "s"), (None, "moron " * 40_000, "s")]).withColumns({"features": F.lit("x"), "row": F.lit("y"), "score": F.lit(7)})
    got = toxicity.fit(rows, spark.createDataFrame([], "doc_id long, toxic int")).scored(rows).collect()
    assert {r.doc_id: (round(r.score, 4), r.predicted) for r in got} == {1: (0.5, 1), 2: (0.0, 0), 3: (0.0, 0), 4: (0.3333, 0), None: (1.0, 1)}
    assert all((r.features, r.row) == ("x", "y") for r in got)
    assert toxicity.fit(rows.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).scored(rows.limit(0)).count() == 0


def labelled(spark, rng, n):
    """Documents whose toxic part is marked by invented words, and their labels."""
    text = vocabulary(rng, 1500)
    marks = [f"zor{a}k{b}" for a in "aeiou" for b in "aeiou"]
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        rows.append((i, f"{text(rng.randint(5, 60))} {' '.join(rng.choices(marks, k=6)) if toxic else ''} {text(10)}", int(toxic)))
    return docs(spark, [(i, t, "s") for i, t, _ in rows]), spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")


def test_fit(spark):
    """Planted labels: held-out rows are told apart, scores keep the trees' order, and held-out labels play no part."""
    rows, labels = labelled(spark, random.Random(18), 800)
    model = toxicity.fit(rows, labels)
    assert model.trees is not None
    held = toxicity.fold(F.col("doc_id")) == 0
    got = model.scored(rows).join(labels, "doc_id").withColumn("held", held).collect()
    out = [r for r in got if r.held]
    assert len(out) > 100 and sum(r.predicted == r.toxic for r in out) >= 0.95 * len(out) and all(0 <= r.score <= 1 for r in got)
    # isotonic: the calibrated level never falls as the trees' score rises
    work = toxicity.described(rows, {0: model.weights}, F.lit(0)).withColumn("vector", toxicity.array_to_vector("features"))
    raw = {r.doc_id: r.raw for r in model.trees.transform(work).withColumn("raw", toxicity.vector_to_array("probability")[1]).select("doc_id", "raw").collect()}
    ordered = [r.score for r in sorted(got, key=lambda r: raw[r.doc_id])]
    assert all(b >= a - 1e-9 for a, b in zip(ordered, ordered[1:]))
    # turned labels of held-out rows change nothing, nor do the order of rows or other columns
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.fit(rows, turned).scored(rows.withColumns({"lang": F.lit("xx"), "source": F.lit("other")})).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in got)


def test_training_is_bounded_where_an_id_has_many_documents(spark):
    rows, labels = labelled(spark, random.Random(31), 40)
    many = rows.unionByName(docs(spark, [(1, f"text number {i} of one id", "s") for i in range(3000)]))
    train, _ = toxicity.training_texts(many, labels, 200)
    assert 100 < train.count() < 300


def test_parts_are_even_and_keep_copies_together(spark):
    rows, labels = labelled(spark, random.Random(19), 100)
    copies = rows.filter("doc_id < 8").withColumn("doc_id", F.col("doc_id") + 1000)
    train, parts = toxicity.training_texts(rows.unionByName(copies), labels.unionByName(labels.filter("doc_id < 8").withColumn("doc_id", F.col("doc_id") + 1000)), 40_000)
    counts = {(r.label, r.part): r["count"] for r in train.groupBy("label", "part").count().collect()}
    assert parts == 4 and train.count() == train.select("text").distinct().count()
    for label in (0.0, 1.0):
        sizes = [counts[label, k] for k in range(4)]
        assert max(sizes) - min(sizes) <= 1


# --- chat -----------------------------------------------------------------------------------------------------------------


def test_round_trip():
    rng = random.Random(7)
    bits = ["\\", "###", "</turn>", "\n", ":", ": ", "a", "é", " ", "#", "assistant", "\ue000"]
    for _ in range(500):
        turns = [("".join(rng.choices(bits, k=rng.randint(0, 4))) if rng.random() < 0.5 else "assistant", "".join(rng.choices(bits, k=rng.randint(0, 9)))) for _ in range(rng.randint(0, 5))]
        text, where, texts, rewrites = chat.spans(turns, chat.heading)
        assert not rewrites and chat.parse(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in texts] == [t for _, t in turns]
        assert "".join(text[a:b] for a, b in where) == text


def foreign():
    """Two templates (made here, so that they travel to the workers with the code that uses them): one with other marks, texts
    in their middle, a cue at the end and nothing escaped, and one that shows only the last text."""

    def cued(turns):
        return "<s>" + "".join(f"[{role.upper()}|{text}|{len(role)}]" for role, text in turns) + "<cue>"

    def only_last(turns):
        return "".join(f"[{r}]" for r, _ in turns[:-1]) + "".join(f"[{r}]{t}" for r, t in turns[-1:])

    return cued, only_last


def test_rewriting_template():
    assert chat.spans([("user", "hello"), ("assistant", "yes"), ("user", "more")], foreign()[1])[3]


def test_foreign_templates(spark):
    rows = spark.createDataFrame([(1, 0, "user", "q|u"), (1, 1, "assistant", "|a]"), (1, 2, "user", ""), (1, 3, "assistant", "bb"), (2, 0, "assistant", "only")], "conv_id long, turn long, role string, text string")
    cued, only_last = foreign()
    template = chat.Template(cued)
    made = chat.format_conversations(rows, template)
    got = {r.conv_id: r for r in chat.digests(made, template).collect()}
    turns = [("user", "q|u"), ("assistant", "|a]"), ("user", ""), ("assistant", "bb")]
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert (got[1].loss_chars, got[1].loss_sha256) == (5, hashlib.sha256(b"|a]bb").hexdigest()) and got[2].loss_chars == 4
    assert got[1].formatted_chars == len(cued(turns)) and not got[1].rewrites_history
    rewriting = chat.Template(only_last)
    lost = {r.conv_id: r for r in chat.digests(chat.format_conversations(rows, rewriting), rewriting).collect()}
    assert lost[1].rewrites_history and lost[1].loss_chars == 0 and lost[1].turns_sha256 is None and not lost[2].rewrites_history


def test_conversations(spark):
    long_ = "x\\" * 100_000
    rows = spark.createDataFrame([(1, 1, "assistant", None), (1, 0, "user", "q"), (1, 1, "assistant", "a"), (None, None, None, "x"), (3, 0, "assistant", long_)], "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(rows)).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 1 and got[1].turns_sha256 == hashlib.sha256(b"user\nq\nassistant\n\nassistant\na\n").hexdigest()
    assert got[None].n_turns == 1 and got[3].loss_sha256 == hashlib.sha256(long_.encode()).hexdigest()
    assert chat.format_conversations(rows.limit(0)).count() == 0

"""URL filter: a sorted array of 64-bit digests, memory-mapped by every Python worker.

Rules are (host, path prefix, verdict). Their keys `host/path` are hashed by xxhash64, sorted and written to one file with
the full strings behind them. The file goes to the executors by SparkContext.addFile and is memory-mapped there, so the
workers of one machine share its pages. Each url is probed with those of its host's suffixes and path prefixes whose
lengths occur among the rules, by one vectorised binary search per batch; a hit counts only if the stored string is equal,
so digest collisions cannot decide. Of the rules that fit, the one with most UTF-8 bytes in host and path wins, of equally
long ones that with the longer host (then host and path are the same text); of rules given twice the last one holds.

The file's size is checked against MAX_BYTES before it is shipped. Beyond that, `judge_by_join` does the same by a shuffled
join on the digest with the string compared, without shipping anything.

Defined results: a null url, or one without `://`, has an empty host and path and fits no rule; such urls and all others
that no rule fits get the default verdict (allow); an empty rule list judges everything so; repeated rows are judged alike;
very long urls are judged whole; an empty table gives an empty result. Columns named host, path, rule or verdict are replaced,
all others pass through unchanged.
"""

from __future__ import annotations

import os
import struct
import tempfile

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import unused

Rule = tuple[str, str, str]  # host, path prefix, verdict

MAX_BYTES = 256 << 20
VERDICTS = ("allow", "block")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def encode(rules: list[Rule]) -> bytes:
    """The array as one block: counts, digests in order, offsets into the strings, verdicts, host lengths, strings."""
    by_key = {f"{h}\0{p}".encode(): (len(h.encode()), VERDICTS.index(v)) for h, p, v in rules}
    keys = sorted(by_key, key=lambda k: (xxhash.xxh64_intdigest(k), k))
    digests = np.array([xxhash.xxh64_intdigest(k) for k in keys], "<u8")
    offsets = np.cumsum([0, *map(len, keys)]).astype("<i8")
    return b"".join([struct.pack("<q", len(keys)), digests.tobytes(), offsets.tobytes(), np.array([by_key[k][1] for k in keys], "<i8").tobytes(), np.array([by_key[k][0] for k in keys], "<i8").tobytes(), *keys])


class DigestArray:
    """The memory-mapped array in a worker."""

    def __init__(self, path: str):
        block = np.memmap(path, np.uint8, "r")
        n = int(block[:8].view("<i8")[0])
        cut = np.cumsum([8, 8 * n, 8 * (n + 1), 8 * n, 8 * n])
        self.digests = block[cut[0] : cut[1]].view("<u8")
        self.offsets = block[cut[1] : cut[2]].view("<i8")
        self.verdicts = block[cut[2] : cut[3]].view("<i8")
        self.hosts = block[cut[3] : cut[4]].view("<i8")
        self.strings = block[cut[4] :]
        self.host_lengths = sorted(set(self.hosts.tolist()))
        self.path_lengths = sorted(set((np.diff(self.offsets) - 1 - self.hosts).tolist()))

    def string(self, i: int) -> bytes:
        return self.strings[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def longest(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[int]]:
        """For each url the longest rule that fits (its string and number), or none."""
        owner, keys = [], []
        for i, (h, p) in enumerate(zip(hosts, paths)):
            host, path = h.encode(), p.encode()
            tails = [host[len(host) - n :] for n in self.host_lengths if n == len(host) or n < len(host) and host[len(host) - n - 1 : len(host) - n] == b"."]
            if tails:
                heads = [path[:n] for n in self.path_lengths if n <= len(path)]
                keys += [t + b"\0" + q for t in tails for q in heads]
                owner += [i] * (len(tails) * len(heads))
        best: list[tuple[int, int, int]] = [(-1, -1, -1)] * len(hosts)  # length, the host's part of it, number
        if keys and len(self.digests):
            probes = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), "<u8", len(keys))
            at = np.searchsorted(self.digests, probes)
            for k in np.flatnonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == probes).tolist():
                j = int(at[k])
                while j < len(self.digests) and self.digests[j] == probes[k]:  # past those that only share the digest
                    if self.string(j) == keys[k]:
                        best[owner[k]] = max(best[owner[k]], (len(keys[k]), int(self.hosts[j]), j))
                        break
                    j += 1
        return [None if j < 0 else self.string(j).replace(b"\0", b"", 1).decode() for *_, j in best], [j for *_, j in best]


_open: dict[str, DigestArray] = {}


def _array(name: str) -> DigestArray:
    if name not in _open:
        _open.clear()
        _open[name] = DigestArray(SparkFiles.get(name))
    return _open[name]


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow", max_bytes: int = MAX_BYTES) -> DataFrame:
    """pages (with a url) and host, path, rule (null: none fits) and verdict; columns of those names are replaced."""
    spark, block = pages.sparkSession, encode(rules)
    hosted = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    if len(block) > max_bytes:
        return judge_by_join(hosted, rules, default)
    name = f"urls-{xxhash.xxh128_hexdigest(block)}.bin"
    if not any(str(f).endswith(name) for f in spark.sparkContext.listFiles):  # the name holds the contents' digest
        folder = tempfile.mkdtemp(prefix="spark-urls-")
        with open(os.path.join(folder, name), "wb") as f:
            f.write(block)
        spark.sparkContext.addFile(os.path.join(folder, name))

    @F.pandas_udf("rule string, verdict string")
    def probe(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        array = _array(name)
        found, at = array.longest(hosts.tolist(), paths.tolist())
        return pd.DataFrame({"rule": pd.Series(found, dtype=object), "verdict": [default if j < 0 else VERDICTS[int(array.verdicts[j])] for j in at]})

    found = unused(hosted, "found")[0]
    return hosted.withColumn(found, probe("host", "path")).withColumns({"rule": F.col(found)["rule"], "verdict": F.col(found)["verdict"]}).drop(found)


def judge_by_join(hosted: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """The same for rule lists too large to ship: candidate keys are joined to the rules by digest and string."""
    spark = hosted.sparkSession
    table = spark.createDataFrame([(h, p, v, i) for i, (h, p, v) in enumerate(rules)], "h string, p string, v string, i long")
    table = table.groupBy("h", "p").agg(F.max_by("v", "i").alias("v")).withColumn("digest", F.xxhash64("h", "p"))
    lengths = sorted({len(p) for _, p, _ in rules})
    row, found = unused(hosted, "row", "found")
    parts = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    heads = F.array_distinct(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]))
    keyed = hosted.withColumn(row, F.monotonically_increasing_id())
    probes = keyed.select(row, F.explode(tails).alias("h"), heads.alias("ps")).select(row, "h", F.explode("ps").alias("p")).filter("p is not null").withColumn("digest", F.xxhash64("h", "p"))
    length = F.struct(F.octet_length("h") + F.octet_length("p"), F.octet_length("h"))
    hits = probes.join(table, ["digest", "h", "p"]).groupBy(row).agg(F.max_by(F.struct(F.concat("h", "p").alias("rule"), "v"), length).alias(found))
    return keyed.join(hits, row, "left").withColumns({"rule": F.col(found)["rule"], "verdict": F.coalesce(F.col(found)["v"], F.lit(default))}).drop(row, found)


#: The rules of the query.
RULES: list[Rule] = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = r"""
WITH parts AS (
  SELECT page_id,
         CASE WHEN contains(url, '://') THEN split_part(regexp_replace(substr(url, strpos(url, '://') + 3), '[/?#](.|\n|\r)*$', ''), chr(0), 1) ELSE '' END AS raw_host,
         CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), split AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path
  FROM parts
), rules(h, p, v) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), best AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM split JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id
)
SELECT s.page_id, coalesce(s.host, '') AS host, coalesce(s.path, '') AS path, b.rule, coalesce(b.v, 'allow') AS verdict
FROM split s LEFT JOIN best b ON s.page_id = b.page_id
"""

"""Merkle manifest of a dataset: a tree of digests for each source, one tree over the sources' roots, and a proof for each row.

H is the lowercase hex SHA-256 of its inputs joined, digests as hex text. A leaf is H of the named columns, each `-` if null, else
its UTF-8 byte count, `:` and its value. Per source, leaves ascend by id; while more than one node is left, every ARITY
consecutive ones (the last run may be shorter, even one) become their H. The sources' roots, null first and then by UTF-8 bytes,
make the upper tree by the same rule.

Trees are cut into superblocks of span = ARITY ** LEVELS consecutive leaves, so that a source that holds a third of all rows is
many groups and no group holds more than 2 * span rows (small trees share one).

1. Climbing: rows are numbered by one range-sort; each superblock is reduced to its node; those are the leaves of the next pass,
   until one is left: log(n) / log(span) passes, three for 10 ** 11 rows. Only digests travel, never texts.
2. Descending: from the top, nodes and the required outer nodes (the siblings of their superblock, level by level) are cogrouped by
   superblock in applyInPandas, which finishes the local reduction, joins the inner siblings to the outer ones and, for leaves,
   folds each one up to the root.

Defined results: rows with a null id come first; rows of equal source and id follow the order of their leaves, equal rows in any
order (the tree is the same, their proofs are those of their places); null sources make one tree of their own; an empty table
gives an empty result; a single row has an empty proof, whose digest is H of nothing; columns of other names pass through if
they are in `keep`, whatever they are called.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import materialise, number_rows

ARITY, LEVELS = 3, 8
#: Up to so many sources their table is broadcast to the leaves; beyond, it is joined by sorting, which splits hot keys.
BROADCAST_SOURCES = 200_000

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
PATH = "path array<struct<left:string,right:string>>"


def leaf(*values: Column) -> Column:
    """Digest of the values."""
    parts = []
    for value in values:
        shown = value.cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown)))
    return F.sha2(F.concat(*parts), 256)


def digest(nodes: list[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def levels_of(nodes: list[str], whole: bool, most: int) -> list[list[str]]:
    """The nodes of each level, from the given ones up: to the one node of a whole tree, or all `most` of a superblock."""
    levels = [nodes]
    while len(levels[-1]) > 1 if whole else len(levels) <= most:
        last = levels[-1]
        levels.append([digest(last[i : i + ARITY]) for i in range(0, len(last), ARITY)])
    return levels


def siblings(levels: list[list[str]], place: int) -> list[dict]:
    """What stands to the left and to the right of the node's run, level by level."""
    steps = []
    for nodes in levels[:-1]:
        first = place - place % ARITY
        run = nodes[first : first + ARITY]
        steps.append({"left": "".join(run[: place - first]), "right": "".join(run[place - first + 1 :])})
        place //= ARITY
    return steps


def fold(node: str, path: list[dict]) -> str:
    for step in path:
        node = digest([step["left"], node, step["right"]])
    return node


def cell(tree: str, block: Column, large: Column, span: int) -> Column:
    """The group of a superblock: by its first leaf's number, or for small trees by where the tree begins."""
    return F.when(large, F.col(tree) + block * span).otherwise(-1 - F.floor(F.col(tree) / span)).cast("long")


def climb(nodes: DataFrame, most: int) -> list[DataFrame]:
    """nodes (tree, pos, n, node), n the leaves of the tree, and what each pass makes of them, down to one node a tree."""
    span = ARITY**most

    def reduce(group: pd.DataFrame) -> pd.DataFrame:
        made = []
        for tree, part in group.groupby("tree"):
            part, n = part.sort_values("pos"), int(part["n"].iloc[0])
            made.append((tree, int(part["pos"].iloc[0]) // span, -(-n // span), levels_of(part["node"].tolist(), n <= span, most)[-1][0]))
        return pd.DataFrame(made, columns=["tree", "pos", "n", "node"])

    levels = [nodes]
    while levels[-1].filter("n > 1").limit(1).count():
        grouped = levels[-1].withColumn("cell", cell("tree", F.floor(F.col("pos") / span), F.col("n") > span, span)).groupBy("cell")
        levels.append(materialise(grouped.applyInPandas(reduce, "tree long, pos long, n long, node string"), "superblocks"))
    return levels


def descend(nodes: DataFrame, above: DataFrame, most: int, finish=None, schema: str = "") -> DataFrame:
    """nodes with the siblings of their whole way to the root. `above` has (tree, pos, n, path, subroot, root) of their
    superblocks; `finish` turns rows with their paths into the rows wanted (by default those of `above`'s own form)."""
    span = ARITY**most

    def meet(inner: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        ways = {(o.tree, o.pos): o for o in outer.itertuples(index=False)}
        parts = []
        for tree, part in inner.groupby("tree"):
            part = part.sort_values("pos")
            way = ways[tree, int(part["pos"].iloc[0]) // span]
            outward = [{"left": s["left"], "right": s["right"]} for s in way.path]
            levels = levels_of(part["node"].tolist(), int(part["n"].iloc[0]) <= span, most)
            parts.append(part.assign(path=[siblings(levels, k) + outward for k in range(len(part))], subroot=way.subroot, root=way.root))
        found = pd.concat(parts) if parts else inner.assign(path=None, subroot=None, root=None)
        return finish(found) if finish else found[["tree", "pos", "n", "path", "subroot", "root"]]

    inner = nodes.withColumn("cell", cell("tree", F.floor(F.col("pos") / span), F.col("n") > span, span)).groupBy("cell")
    outer = above.withColumn("cell", cell("tree", F.col("pos"), F.col("n") > 1, span)).groupBy("cell")
    return inner.cogroup(outer).applyInPandas(meet, schema or f"tree long, pos long, n long, {PATH}, subroot string, root string")


def manifest(docs: DataFrame, fields: list[str], ident: str, source: str, tampered: Column | None = None, keep: list[str] | None = None, most: int = LEVELS) -> DataFrame:
    """The columns `keep` (by default the id) with leaf, subroot, root, proof (the siblings joined), proof_sha256, folded_root
    and verified. `tampered` is a column expression over docs: the leaf to fold instead of the true one, where it is not null."""
    keep = keep or [ident]
    rows = docs.select(
        F.col(f"`{source}`").alias("source"), F.col(f"`{ident}`").alias("ident"), leaf(*[F.col(f"`{c}`") for c in fields]).alias("node"),
        (F.lit(None).cast("string") if tampered is None else tampered).alias("other"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"),
    )
    numbered, _ = number_rows(rows, ["source", "ident", "node"], "leaves", "number")
    trees = materialise(numbered.groupBy("source").agg(F.min("number").alias("tree"), F.count("*").alias("n")), "trees")
    one = F.broadcast if trees.count() <= BROADCAST_SOURCES else (lambda t: t)
    leaves = numbered.join(one(trees.withColumnRenamed("source", "its")), F.col("source").eqNullSafe(F.col("its")))
    leaves = leaves.select("tree", (F.col("number") - F.col("tree")).alias("pos"), "n", "node", "other", "kept")
    leaves = materialise(leaves, "placed")
    lower = climb(leaves.select("tree", "pos", "n", "node"), most)
    subroots = lower[-1].select(F.col("tree").alias("of"), "node")
    ordered, n = number_rows(subroots, ["of"], "subroots", "pos")
    upper = climb(ordered.select(F.lit(0).cast("long").alias("tree"), "pos", F.lit(n).cast("long").alias("n"), "node"), most)
    way = upper[-1].select("tree", "pos", "n", F.expr("cast(array() as array<struct<left:string,right:string>>)").alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root"))
    for nodes in reversed(upper[:-1]):
        way = descend(nodes, way, most)
    way = way.select("pos", "path", "root").join(ordered.select("pos", "of", "node"), "pos")
    way = way.select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("pos"), F.lit(1).cast("long").alias("n"), "path", F.col("node").alias("subroot"), "root")
    for nodes in reversed(lower[1:-1]):
        way = descend(nodes, way, most)

    def finish(found: pd.DataFrame) -> pd.DataFrame:
        proofs = ["".join(s["left"] + s["right"] for s in path) for path in found["path"]]
        folded = [fold(other if isinstance(other, str) else node, path) for other, node, path in zip(found["other"], found["node"], found["path"])]
        return pd.DataFrame({
            "kept": found["kept"], "leaf": found["node"], "subroot": found["subroot"], "root": found["root"], "proof": proofs, "proof_sha256": [digest([p]) for p in proofs],
            "folded_root": folded, "verified": [f == r for f, r in zip(folded, found["root"])],
        })

    kept = rows.schema["kept"].dataType.simpleString()
    done = descend(leaves, way, most, finish, f"kept {kept}, leaf string, subroot string, root string, proof string, proof_sha256 string, folded_root string, verified boolean")
    return done.select(*[F.col(f"kept.`{c}`") for c in keep], "leaf", "subroot", "root", "proof", "proof_sha256", "folded_root", "verified")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id has an even checksum are tampered with: the line feeds of their text go."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    changed = [F.translate("text", "\n", "") if c == "text" else F.col(c) for c in FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, leaf(*changed))
    return manifest(docs, FIELDS, "doc_id", "source", tampered).drop("proof")

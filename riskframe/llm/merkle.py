"""Merkle manifest of a table: leaves, subtree per group, root, proofs, verification.

A row's leaf is the SHA-256 of its fields.  Per group the leaves, in id order, are
hashed in runs of ``ARITY`` until one node is left, the group's subroot; the
subroots, in group order, are hashed likewise to the root.

Cogrouped subtree exchange.  Leaves are numbered per group by a range
partitioning and offsets (no single-partition window).  ``ARITY ** HEIGHT`` = 4,096
consecutive leaves are a superblock.  Upwards, ``applyInPandas`` turns every
superblock into one outer node, and superblocks of outer nodes into nodes further
out, until one is left per group.  Downwards, every superblock is cogrouped with
the one outer row it needs -- the siblings between it and the root -- and one
``applyInPandas`` call finishes the reduction inside the block, joins the inner and
outer parts of every proof and folds them with the leaf found on verification.
A task holds one superblock's digests, never texts and never a whole group, so
one group with most of the rows is many blocks.

Defined results: a null field is hashed as ``-``; a null group is a group and comes
first; null ids come first in their group, rows of equal id are ordered by their
leaf (rows equal in everything have equal leaves and may swap places); a group of one
leaf has that leaf as its subroot; a run of one node is hashed like any other; a
tree of one leaf has no siblings and its proof is the hash of nothing; an empty
table gives an empty table; columns other than the named ones are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import broadcast_within, parallelism, save

#: Nodes of a run, and levels inside a superblock.
ARITY, HEIGHT = 8, 4
BLOCK = ARITY ** HEIGHT


def digest(s: str) -> str:
    return hashlib.sha256(s.encode("ascii")).hexdigest()


def encoded(value: Column) -> Column:
    """``-`` for null, else byte count, colon, value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(c) for c in fields]).cast("binary"), 256)


# --- inside a superblock --------------------------------------------------

def depth(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    d = 0
    while n > 1:
        n, d = -(-n // ARITY), d + 1
    return d


def levels(digests: list[str], n: int) -> list[list[str]]:
    """The block's nodes level by level; ``n`` nodes stand in the whole group."""
    out = [digests]
    for _ in range(min(HEIGHT, depth(n))):
        last = out[-1]
        out.append([digest("".join(last[i:i + ARITY])) for i in range(0, len(last), ARITY)])
    return out


def siblings(tree: list[list[str]], i: int) -> list[str]:
    """``left|right`` siblings of node ``i`` of the lowest level, upwards inside the block."""
    out = []
    for nodes in tree[:-1]:
        a = i - i % ARITY
        out.append("".join(nodes[a:i]) + "|" + "".join(nodes[i + 1:a + ARITY]))
        i //= ARITY
    return out


def _up(block: pd.DataFrame) -> pd.DataFrame:
    block = block.sort_values("pos")
    n = int(block["n"].iat[0])
    top = levels(block["digest"].tolist(), n)[-1]
    return pd.DataFrame({"key": [block["key"].iat[0]], "pos": [int(block["pos"].iat[0]) // BLOCK], "n": [-(-n // BLOCK)], "digest": top})


def _down(block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """Every node of a block with its siblings up to the root."""
    if block.empty:
        return pd.DataFrame({"key": [], "pos": [], "digest": [], "path": [], "subroot": [], "root": []})
    block = block.sort_values("pos")
    up = outer.iloc[0]
    tree = levels(block["digest"].tolist(), int(block["n"].iat[0]))
    path = list(up["path"])
    return pd.DataFrame({"key": block["key"], "pos": block["pos"], "digest": block["digest"], "path": [siblings(tree, i) + path for i in range(len(block))],
                         "subroot": up["subroot"], "root": up["root"]})


def _prove(block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """Leaves of a block: proof digest, and the root folded from the leaf that was found."""
    cols = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
    if block.empty:
        return pd.DataFrame({c: [] for c in cols})
    block = block.sort_values("pos")
    up = outer.iloc[0]
    tree = levels(block["digest"].tolist(), int(block["n"].iat[0]))
    path = [p.split("|") for p in up["path"]]
    proofs, folded = [], []
    for i, node in enumerate(block["found"]):
        way = [p.split("|") for p in siblings(tree, i)] + path
        proofs.append(digest("".join(a + b for a, b in way)))
        for a, b in way:
            node = digest(a + node + b)
        folded.append(node)
    return pd.DataFrame({"id": block["id"], "leaf": block["digest"], "subroot": up["subroot"], "root": up["root"], "proof_sha256": proofs, "folded_root": folded})


# --- over the cluster -----------------------------------------------------

def numbered(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with pos (from 0) and n, per ``key``, in ``order`` (nulls first)."""
    by = ["key", *order, "__tie"]
    t = save(rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(parallelism(rows.sparkSession), *by)
             .withColumn("__p", F.spark_partition_id()), name)
    # one row per (range, key that has rows in it)
    w = Window.partitionBy("key").orderBy("__p")
    c = t.groupBy("key", "__p").count().select(
        F.col("key").alias("__k"), F.col("__p").alias("__q"), (F.sum("count").over(w) - F.col("count")).alias("__before"),
        F.sum("count").over(Window.partitionBy("key")).alias("n"))
    c = broadcast_within(save(c, name + "-offsets"))
    w = Window.partitionBy("key", "__p").orderBy(*order, "__tie")
    return t.join(c, (t["key"] == c["__k"]) & (t["__p"] == c["__q"])).select(
        *rows.columns, (F.row_number().over(w) - 1 + F.col("__before")).cast("bigint").alias("pos"), "n")


_NODE = "key string, pos long, n long, digest string"
_PATH = "key string, pos long, digest string, path array<string>, subroot string, root string"


def _block(x: DataFrame, column: str = "pos") -> DataFrame:
    return x.withColumn("block", F.expr(f"{column} div {BLOCK}"))


def _reduced(nodes: DataFrame, name: str) -> list[DataFrame]:
    """Node tables from ``nodes`` (key, pos, n, digest) up to one node per key."""
    out = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        # a table of nodes needs no more partitions than it has blocks
        out.append(save(_block(out[-1].select("key", "pos", "n", "digest")).groupBy("key", "block").applyInPandas(_up, _NODE), name))
        most = -(-most // BLOCK)
    return out


def _spread(tables: list[DataFrame], top: DataFrame, name: str) -> DataFrame:
    """Siblings up to the root for the nodes of the second table (blocks of the first)."""
    for t in reversed(tables[1:-1]):
        nodes = _block(t.select("key", "pos", "n", "digest"))
        top = save(nodes.groupBy("key", "block").cogroup(top.withColumnRenamed("pos", "block").groupBy("key", "block")).applyInPandas(_down, _PATH), name)
    return top


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang",
             fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), found: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: the id, leaf, subroot, root, proof_sha256 (hash
    of the siblings level by level, left to right), folded_root and verified.

    ``found`` gives columns as they are met on verification (default: unchanged);
    folded_root comes from the leaf of those and the siblings of the manifest."""
    found = found or {}
    kept = [F.col(f"`{c}`") for c in fields]
    met = [found.get(c, F.col(f"`{c}`")) for c in fields]
    group = F.col(f"`{group_col}`").cast("string")
    # null sorts before every name: a mark ahead of it
    rows = docs.select(F.coalesce(F.concat(F.lit("1"), group), F.lit("0")).alias("key"), F.col(f"`{id_col}`").alias("id"),
                       leaf(kept).alias("digest"), (leaf(met) if found else leaf(kept)).alias("found"))
    leaves = save(numbered(rows, ["id", "digest"], "merkle-leaves"), "merkle-numbered")
    trees = _reduced(leaves, "merkle-nodes")

    subroots = trees[-1].select(F.lit("").alias("key"), F.col("key").alias("group"), "digest") if len(trees) > 1 else \
        leaves.select(F.lit("").alias("key"), F.col("key").alias("group"), "digest")
    subroots = save(numbered(subroots, ["group"], "merkle-subroots"), "merkle-subroots")
    tops = _reduced(subroots, "merkle-top")
    start = tops[-1].select("key", "pos", "digest", F.array().cast("array<string>").alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    top = _spread(tops, start, "merkle-top-paths")
    if len(tops) > 1:
        lowest = _block(subroots.select("key", "pos", "n", "digest"))
        top = lowest.groupBy("key", "block").cogroup(top.withColumnRenamed("pos", "block").groupBy("key", "block")).applyInPandas(_down, _PATH)
    # the outer row of a group: its subroot's siblings in the tree of subroots
    groups = save(subroots.select(F.col("pos").alias("p"), "group").join(top.select("pos", "digest", "path", "root"), F.col("p") == F.col("pos"))
                  .select(F.col("group").alias("key"), F.lit(0).cast("bigint").alias("pos"), "digest", "path", F.col("digest").alias("subroot"), "root"), "merkle-groups")
    outer = _spread(trees, groups, "merkle-paths")

    kind = docs.schema[id_col].dataType
    blocks = _block(leaves.withColumn("id", F.col("id").cast("string")))
    out = blocks.groupBy("key", "block").cogroup(outer.select("key", F.col("pos").alias("block"), "path", "subroot", "root").groupBy("key", "block")).applyInPandas(
        _prove, "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return out.select(F.col("id").cast(kind).alias(id_col), "leaf", "subroot", "root", "proof_sha256", "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"))

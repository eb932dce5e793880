"""Merkle manifest of a dataset: a tree for each part, a tree over the parts' roots, proofs and checks of all rows.

Rows are ordered by one exchange into ranges of (tree, key), so a position in its tree is a place in a range plus the counts of
the ranges before it: no task holds a whole tree. Blocks of 2**BLOCK consecutive leaves are reduced in tasks, each leaf with its
siblings inside its block. The block roots are few: up to TOP of them the driver builds the rest of the trees and broadcasts each
block's path to the root of its tree; more of them are leaves of the same step again. Executors then join the paths and fold each row.

A node is the lower-case hex SHA-256 of its children's hex digests (of one alone where a level has an odd end); a tree of one leaf is that leaf.
Siblings are stored as one byte for the side (l, r, or - for none) and 32 bytes of digest.

Null values count as ``-`` in a leaf. Rows with a null key come first in their tree, rows with a null part form a tree of their own, the first
one; rows with an equal key follow the order of their digests, so repeated rows have proofs of their own. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchloom.llm.common import materialize, release

#: Leaves of a block: two to this power.
BLOCK = 10
#: Nodes that the driver takes at most: about 1.5 MB of digests, and 8 MB of paths to broadcast.
TOP = 1 << 14
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NONE = b"-"


def digest(children: list[bytes]) -> bytes:
    """The node above children."""
    return hashlib.sha256("".join([c.hex() for c in children]).encode()).digest()


def reduce_block(nodes: list[bytes], levels: int | None = None) -> tuple[bytes, list[bytes]]:
    """The node above nodes (``levels`` higher, else the first that stands alone), and the path of each node to it."""
    paths: list[list[bytes]] = [[] for _ in nodes]
    done = 0
    while (len(nodes) > 1) if levels is None else (done < levels):
        for i, path in enumerate(paths):
            at = (i >> done) ^ 1
            path.append((b"l" if at < (i >> done) else b"r") + nodes[at] if at < len(nodes) else NONE)
        nodes = [digest(nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        done += 1
    return nodes[0], [b"".join(p) for p in paths]


def steps(path: bytes) -> list[tuple[bytes, bytes]]:
    """Side and digest of each step of a path; the digest is empty where there is no sibling."""
    out, at = [], 0
    while at < len(path):
        side = path[at : at + 1]
        n = 1 if side == NONE else 33
        out.append((side, path[at + 1 : at + n]))
        at += n
    return out


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its siblings give."""
    for side, other in steps(path):
        leaf = digest([leaf] if side == NONE else [other, leaf] if side == b"l" else [leaf, other])
    return leaf


def leaf_of(docs: DataFrame, plus: int = 0) -> Column:
    """The leaf of a row in hex; ``plus`` is added to n_chars."""

    def part(name: str) -> Column:
        value = docs[name] + plus if plus and name == "n_chars" else docs[name]
        value = value.cast("string")
        return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.sha2(F.concat(*map(part, FIELDS)), 256)


def _tops(leaves: DataFrame) -> DataFrame:
    """``forest`` of at most TOP leaves, built by the driver."""
    trees: dict[str, list] = {}
    for r in leaves.select("tree", "key", "leaf").orderBy("tree", "key", "leaf").collect():
        trees.setdefault(r["tree"], []).append((r["key"], bytes(r["leaf"])))
    rows = []
    for tree, members in trees.items():
        root, paths = reduce_block([d for _, d in members])
        rows += [(tree, k, d, i, p, root) for i, ((k, d), p) in enumerate(zip(members, paths, strict=True))]
    kind = leaves.schema["key"].dataType.simpleString()
    return F.broadcast(leaves.sparkSession.createDataFrame(rows, f"tree string, key {kind}, leaf binary, pos long, path binary, root binary"))


def placed(leaves: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """tree, key, leaf and keep, with pos (the place in the tree, from 0) and n (the leaves of the tree)."""
    order = ["tree", "key", "leaf", "row"]
    ordered = leaves.repartitionByRange(*order).sortWithinPartitions(*order).select("tree", "key", "leaf", *keep, F.monotonically_increasing_id().alias("at"))
    ordered = materialize(ordered, "ordered").withColumn("part", F.shiftrightunsigned("at", 33))
    counts = ordered.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy("tree").orderBy("part")) - F.col("c")
    counts = counts.select("tree", "part", "first", before.alias("before"), F.sum("c").over(Window.partitionBy("tree")).alias("n"))
    return ordered.join(counts, ["tree", "part"]).select("tree", "key", "leaf", *keep, (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "n")


def forest(leaves: DataFrame, keep: tuple[str, ...] = (), small: bool = False, block: int = BLOCK, top: int = TOP) -> DataFrame:
    """tree, key, leaf and keep of all leaves, with pos, path (to the root of the tree) and root.

    leaves: tree (string), key (orders a tree), leaf (binary) and row (tells equal leaves apart), a written table. With
    ``small``, up to ``top`` leaves are left to the driver; it does not carry columns of keep.
    """
    if small and not keep and leaves.limit(top + 1).count() <= top:
        return _tops(leaves)
    rows = placed(leaves, keep).withColumn("block", F.shiftright("pos", block))
    fields = [f for f in rows.schema if f.name in ("tree", "key", "leaf", *keep, "pos", "n", "block")]
    names = [f.name for f in fields]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "path binary, top binary"])

    def reduce_one(group: pa.Table) -> pa.Table:
        group = group.sort_by("pos")
        root, paths = reduce_block(group["leaf"].to_pylist(), block if group["n"][0].as_py() > 1 << block else None)
        table = group.select(names).append_column("path", pa.array(paths, pa.binary()))
        return table.append_column("top", pa.array([root] * len(paths), pa.binary()))

    blocks = materialize(rows.groupBy("tree", "block").applyInArrow(reduce_one, schema), "blocks")
    first = (F.col("pos") == F.shiftleft("block", block)) & (F.col("n") > 1 << block)
    tops = materialize(blocks.where(first).select("tree", F.col("block").alias("key"), F.col("top").alias("leaf"), F.lit(0).alias("row")), "tops")
    above = forest(tops, small=True, block=block, top=top).select("tree", F.col("key").alias("block"), F.col("path").alias("__rest"), F.col("root").alias("__root"))
    joined = blocks.join(above, ["tree", "block"], "left")
    path = F.concat("path", F.coalesce("__rest", F.lit(b"")))
    return joined.select("tree", "key", "leaf", *keep, "pos", path.alias("path"), F.coalesce("__root", "top").alias("root"))


def manifest(docs: DataFrame, tampered: Column | None = None, block: int = BLOCK, top: int = TOP) -> DataFrame:
    """doc_id, leaf, subroot, root, siblings (those on the way to the root, joined), sides (a letter for each level), folded_root and
    verified of each row, digests in hex.

    Trees are the values of lang, leaves go by doc_id. Where ``tampered`` holds, the row is checked as if n_chars were one more.
    """
    changed = F.when(F.coalesce(tampered, F.lit(False)), F.unhex(leaf_of(docs, 1))) if tampered is not None else F.lit(None).cast("binary")
    tree = F.when(docs["lang"].isNull(), "0").otherwise(F.concat(F.lit("1"), docs["lang"]))
    slim = docs.select(tree.alias("tree"), docs["doc_id"].alias("key"), F.unhex(leaf_of(docs)).alias("leaf"), changed.alias("changed"), F.monotonically_increasing_id().alias("row"))
    rows = forest(materialize(slim, "leaves"), ("changed",), block=block, top=top)
    subroots = materialize(rows.where("pos = 0").select(F.lit("").alias("tree"), F.col("tree").alias("key"), F.col("root").alias("leaf"), F.lit(0).alias("row")), "subroots")
    last = forest(subroots, small=True, block=block, top=top).select(F.col("key").alias("tree"), F.col("path").alias("__rest"), F.col("root").alias("__root"))
    whole = rows.join(last, "tree").select("key", "leaf", "changed", "root", "__root", F.concat("path", "__rest").alias("path"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    names = ["doc_id", "leaf", "subroot", "root", "siblings", "sides", "folded_root", "verified"]

    def check(batches):
        text = lambda values: pa.array([v.hex() for v in values], pa.string())
        for b in batches:
            leaves, others, subs, roots, paths = (b.column(i).to_pylist() for i in range(1, 6))
            folded = [fold(x if o is None else o, p) for x, o, p in zip(leaves, others, paths, strict=True)]
            walked = [steps(p) for p in paths]
            siblings = text(b"".join([d for _, d in w]) for w in walked)
            sides = pa.array([b"".join([s for s, _ in w]).decode() for w in walked], pa.string())
            good = pa.array([f == r for f, r in zip(folded, roots, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), text(leaves), text(subs), text(roots), siblings, sides, text(folded), good], names=names)
        release()

    return whole.mapInArrow(check, f"doc_id {kind}, leaf string, subroot string, root string, siblings string, sides string, folded_root string, verified boolean")


def manifest_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: tampering is tried where 7 divides the hash of doc_id."""
    tried = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 7 == 0
    return manifest(docs, tried).select("doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), "folded_root", "verified")

"""Merkle manifest of a dataset: one hash tree a group, one above the groups, kept in blocks in van
Emde Boas order, with proofs of single rows.

A tree over n leaves is cut into aligned blocks of so many levels (BLOCK): block b of stage 0 has the leaves
b * 2^levels and on, its root is leaf b of stage 1, and so on up to one root. A block is a row of a
table whose nodes lie in van Emde Boas order: the upper half of its levels first, then the subtrees
below from left to right, each stored in the same way. ``places`` is the address arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_batch, narrow, running_totals, written

BLOCK = 10  # levels of hashing in a block: 1,024 leaves, 64 KB of digests
DIGEST = 32


# ---------------------------------------------------------------- layout
def places(levels: int, depth: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Where node ``index`` of ``depth`` (0: root) lies in a perfect tree of ``levels`` levels."""
    if levels == 1:
        return np.zeros(len(depth), np.int64)
    upper = levels // 2
    lower = levels - upper
    out = np.empty(len(depth), np.int64)
    top = depth < upper
    out[top] = places(upper, depth[top], index[top])
    d, i = depth[~top] - upper, index[~top]
    out[~top] = (1 << upper) - 1 + (i >> d) * ((1 << lower) - 1) + places(lower, d, i & ((1 << d) - 1))
    return out


@cache
def layout(height: int) -> list[np.ndarray]:
    """[h]: places of all nodes at height h (0: leaves) of a block whose leaves are ``height`` below its root."""
    return [places(height + 1, np.full(1 << (height - h), height - h), np.arange(1 << (height - h))) for h in range(height + 1)]


def _parent(nodes: Sequence[bytes]) -> bytes:
    """H of the nodes' hexadecimal digests, one after the other."""
    return sha256("".join(n.hex() for n in nodes).encode()).digest()


def heights(leaves: int, levels: int) -> int:
    """Levels of hashing: ``levels`` in a block that is one of several, or, if that is 0, to a single node."""
    return levels or max(leaves - 1, 0).bit_length()


def build_block(leaves: Sequence[bytes], levels: int) -> tuple[bytes, bytes]:
    """(nodes in van Emde Boas order, root). Slots beyond the last leaf stay empty."""
    height = heights(len(leaves), levels)
    at = layout(height)
    nodes = np.zeros(((2 << height) - 1, DIGEST), np.uint8)
    row = list(leaves)
    for h in range(height + 1):
        nodes[at[h][:len(row)]] = np.frombuffer(b"".join(row), np.uint8).reshape(-1, DIGEST)
        if h < height:
            row = [_parent(row[k:k + 2]) for k in range(0, len(row), 2)]
    return nodes.tobytes(), row[0]


def siblings(nodes: bytes, leaves: int, levels: int) -> list[list[tuple[int, bytes]]]:
    """For each leaf of a stored block, from the leaf up: (side, digest), where side is 0 for a node that is alone
    in its run, 1 for a sibling on the left and 2 for one on the right."""
    height = heights(leaves, levels)
    at, table = layout(height), np.frombuffer(nodes, np.uint8).reshape(-1, DIGEST)
    out: list[list[tuple[int, bytes]]] = [[] for _ in range(leaves)]
    count = leaves
    for h in range(height):
        digests = [d.tobytes() for d in table[at[h][:count]]]
        for k in range(leaves):
            other = (k >> h) ^ 1
            out[k].append((0, b"") if other >= count else (1 if other < (k >> h) else 2, digests[other]))
        count = (count + 1) // 2
    return out


def fold(digest: bytes, path: Sequence[tuple[int, bytes]]) -> bytes:
    """The digest at the end of a path."""
    for side, other in path:
        digest = _parent([digest] if side == 0 else [other, digest] if side == 1 else [digest, other])
    return digest


def pack(path: Sequence[tuple[int, bytes]]) -> bytes:
    return b"".join(bytes([side]) + other.ljust(DIGEST, b"\0") for side, other in path)


def unpack(path: bytes) -> list[tuple[int, bytes]]:
    return [(path[k], path[k + 1:k + 1 + DIGEST] if path[k] else b"") for k in range(0, len(path), 1 + DIGEST)]


# ---------------------------------------------------------------- construction
_BLOCKS = pa.schema([("tree", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("levels", pa.int32()), ("nodes", pa.binary()), ("root", pa.binary())])
_BLOCKS_DDL = "tree long, block long, n long, levels int, nodes binary, root binary"


def build(leaves: DataFrame, name: str, levels: int = BLOCK) -> list[DataFrame]:
    """Tables of blocks, one for each stage, from leaves (tree, row, n_rows, hash), where ``row`` counts a tree's
    leaves from 0. Stages follow from the largest tree; a tree that is done in a stage has no rows in the next."""

    def one_block(rows: pa.Table) -> pa.Table:
        """At most 2^levels leaves."""
        rows = rows.sort_by("row")
        own = levels if rows["n_rows"][0].as_py() > 1 << levels else 0
        nodes, root = build_block(rows["hash"].to_pylist(), own)
        first = rows.slice(0, 1)
        return pa.Table.from_batches([as_batch(_BLOCKS, first["tree"].to_pylist(), [first["row"][0].as_py() >> levels], [rows.num_rows], [own], [nodes], [root])])

    out, most = [], leaves.agg(F.max("n_rows")).first()[0]  # one number
    while most:
        blocks = leaves.withColumn("_block", F.shiftright("row", levels)).groupBy("tree", "_block").applyInArrow(one_block, _BLOCKS_DDL)
        out.append(written(blocks, name))
        most = (most + (1 << levels) - 1) >> levels if most > 1 << levels else 0
        size = out[-1].groupBy("tree").agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1").withColumnRenamed("tree", "_tree")
        leaves = out[-1].join(size, F.col("tree") == F.col("_tree")).select("tree", F.col("block").alias("row"), "n_rows", F.col("root").alias("hash"))
    return out


def roots(stages: list[DataFrame]) -> DataFrame:
    """(tree, root): of each tree the block that is alone."""
    out = None
    for blocks in stages:
        done = blocks.filter("levels = 0").select("tree", "root")
        out = done if out is None else out.unionByName(done)
    return out


def _paths_below(blocks: DataFrame, levels: int) -> DataFrame:
    """(_tree, _row, path) of each leaf of stored blocks with the paths of their roots."""
    schema = pa.schema([("_tree", pa.int64()), ("_row", pa.int64()), ("path", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                tree, block, n, own, nodes, above = (batch.column(c)[r].as_py() for c in ("tree", "block", "n", "levels", "nodes", "above"))
                yield as_batch(schema, [tree] * n, [(block << levels) + k for k in range(n)], [pack(p) + above for p in siblings(nodes, n, own)])

    return blocks.mapInArrow(run, "_tree long, _row long, path binary")


def block_paths(stages: list[DataFrame], tops: DataFrame | None, name: str, levels: int = BLOCK) -> DataFrame:
    """The blocks of stage 0 with ``above``, the packed path from a block's root to the end: down the
    stages, a block's path is that of the leaf it is in the block above, or ``tops`` (tree, path) for
    the last one of a tree."""
    given = None
    for blocks in reversed(stages):
        now = blocks
        if tops is not None:
            now = now.join(tops.select(F.col("tree").alias("_top"), F.col("path").alias("_top_path")), (F.col("tree") == F.col("_top")) & (F.col("levels") == 0), "left")
        else:
            now = now.withColumn("_top_path", F.lit(b""))
        if given is not None:
            now = now.join(given, (F.col("tree") == F.col("_tree")) & (F.col("block") == F.col("_row")) & (F.col("levels") > 0), "left")
        else:
            now = now.withColumn("path", F.lit(None).cast("binary"))
        now = written(now.select(*blocks.columns, F.coalesce("path", "_top_path", F.lit(b"")).alias("above")), name)
        given = _paths_below(now, levels)
    return now


# ---------------------------------------------------------------- rows as leaves
def leaf_hash(*fields: Column) -> Column:
    """sha256 of all fields: ``-`` if null, else UTF-8 byte count, a colon and the value."""
    def one(c: Column) -> Column:
        value = c.cast("string")
        return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))
    return F.sha2(F.concat(*[one(c) for c in fields]), 256)


def _verify(rows: pa.Table, blocks: pa.Table) -> pa.Table:
    """Proofs of one block's rows, checked against the stored siblings."""
    block = blocks.to_pylist()[0]
    above = unpack(block["above"])
    paths = siblings(block["nodes"], block["n"], block["levels"])
    ends: dict[bytes, bytes] = {}  # of digests at the block's root
    proof, folded = [], []
    for at, digest in zip(rows["at"].to_pylist(), rows["shown"].to_pylist(), strict=True):
        path = paths[at]
        proof.append(_parent([other for side, other in path + above if side]).hex())
        at_root = fold(digest, path)
        if at_root not in ends:
            ends[at_root] = fold(at_root, above)
        folded.append(ends[at_root].hex())
    return pa.table({"doc_id": rows["doc_id"], "tree": rows["tree"], "leaf": [x.hex() for x in rows["hash"].to_pylist()],
                     "proof_sha256": proof, "folded_root": folded})


def manifest(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id",
             group_col: str = "lang", changed_col: str = "n_chars", tampered: Column | None = None, levels: int = BLOCK) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    A row's leaf is ``leaf_hash`` of ``fields``. The leaves of a group (of equal ``group_col``, null
    first) are its tree's, in the order of ``id_col``, nulls first; rows that repeat an id follow in the
    order of their leaves, so that equal rows are interchangeable. The groups' roots are the leaves of
    the tree above, in the order of the groups' UTF-8 bytes. A node that is alone in its run is
    hashed by itself; a lone leaf is its tree's root. ``proof_sha256`` is H of the siblings from the leaf
    up to the root.

    Rows where ``tampered`` holds are shown to the check with ``changed_col`` raised by 1 (null stays);
    ``folded_root`` comes from the shown leaf and the stored siblings, ``verified`` says whether it is the root.

    Leaves are numbered by distributed prefix sums; a task holds a block of 2^levels leaves and its path.
    Null fields are leaves' ``-``. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    used = {f"f{k}": c for k, c in enumerate(fields)}
    rows = narrow(docs, doc_id=id_col, group=group_col, **used)
    leaf = leaf_hash(*[F.col(c) for c in used])
    shown = leaf_hash(*[F.try_add(F.col(c), F.lit(1)) if name == changed_col else F.col(c) for c, name in used.items()])
    rows = rows.select("doc_id", "group", leaf.alias("leaf"), F.when(F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False)), shown).alias("other"))
    placed = written(running_totals(rows, [F.col("doc_id").asc_nulls_first(), F.col("leaf")], [], group="group"), "leaves")
    sizes = placed.groupBy("group").agg(F.count(F.lit(1)).alias("n_rows"))
    trees = written(running_totals(sizes, [F.col("group").asc_nulls_first()], []).select(F.col("group").alias("_group"), "n_rows", F.col("row").alias("tree")), "trees")
    numbered = placed.join(trees, F.col("group").eqNullSafe(F.col("_group"))).select(
        "doc_id", "tree", "row", "n_rows", F.unhex("leaf").alias("hash"), F.unhex(F.coalesce("other", "leaf")).alias("shown"))
    numbered = written(numbered, "numbered")
    stages = build(numbered.select("tree", "row", "n_rows", "hash"), "blocks", levels)
    columns = "doc_id long, tree long, leaf string, proof_sha256 string, folded_root string"
    if not stages:
        return spark.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    subroots = written(roots(stages), "subroots")
    n_trees = trees.count()
    above = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("row"), F.lit(n_trees).cast("long").alias("n_rows"), F.col("root").alias("hash"))
    top = build(above, "top", levels)
    root = F.lit(roots(top).first()["root"].hex())
    tops = _paths_below(block_paths(top, None, "top_paths", levels), levels)
    tops = written(tops.select(F.col("_row").alias("tree"), "path"), "tops")
    ready = block_paths(stages, tops, "paths", levels)
    numbered = numbered.withColumns({"block": F.shiftright("row", levels), "at": F.col("row") % (1 << levels)})
    checked = numbered.groupBy("tree", "block").cogroup(ready.groupBy("tree", "block")).applyInArrow(_verify, columns)
    subroots = subroots.select(F.col("tree").alias("_tree"), F.lower(F.hex("root")).alias("subroot"))
    out = checked.join(subroots, F.col("tree") == F.col("_tree"))
    return out.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))

"""Merkle manifest of a dataset, its trees stored in van Emde Boas order.

Records are leaves; the leaves of one tree (here: of one language) stand in
key order, and every 8 consecutive nodes become the digest of the next level.
Trees are cut into aligned blocks of 512 leaves, so a block is a whole 8-ary
subtree of four levels.  A block's digests are one binary value in van Emde
Boas order: the levels are split at half, the upper half comes first, then the
subtrees below it one after the other, each laid out the same way, so any path
from leaf to root touches few neighbouring stretches whatever the size of a
cache line or page.  :func:`address` gives the place of a node by arithmetic
alone; the construction and the retrieval of siblings both use it.  The roots
of the blocks are the leaves of the next stage's blocks, and the roots of all
trees those of one last tree.

The manifest is a folder of Parquet tables (``kind=part/stage=k`` the blocks of
the trees, ``kind=whole/stage=k`` those of the tree of trees).  A proof goes
down block by block: the siblings above a block are made once and handed to the
blocks below it.

At scale the records are read once for their digests; what is sorted and
shuffled after that are 32-byte digests with their keys.  Positions come from
counts per sorted range, so a tree that holds most rows is cut like any other.

Defined cases: a null field is ``-``; a null key sorts last within its tree, a
null tree first among the trees (apart from the empty name); records with one
key are ordered by digest, and repeated records are leaves of their own; a tree
of one leaf has that leaf as its root and no siblings; an empty table gives an
empty manifest and no proofs; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tsq.llm.base import fold_of, partitions, prepare, stored

#: Children of a node.
FAN = 8
#: Levels between a block's root and its leaves; a block has FAN ** HEIGHT leaves.
HEIGHT = 3
BLOCK = FAN ** HEIGHT
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

PROOF_DDL = ("tree string, doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
             "folded_root string, verified boolean, proof_nodes int")


def record_digest(*fields: Column) -> Column:
    """Lowercase hex sha256 of all fields, each its UTF-8 byte count, a colon and its text (null: ``-``)."""
    text = [f.cast("string") for f in fields]
    part = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]
    return F.sha2(F.concat(*part).cast("binary"), 256)


def _size(levels: int) -> int:
    return (FAN ** levels - 1) // (FAN - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Place in van Emde Boas order of the nodes ``index`` of one depth (the
    root has depth 0) in a full tree of so many levels."""
    index = np.asarray(index, np.int64)
    at = np.zeros(index.shape, np.int64)
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        levels, depth = levels - top, depth - top
        below = FAN ** depth
        at += _size(top) + index // below * _size(levels)
        index = index % below
    return at


@lru_cache(maxsize=32)
def _places(height: int, depth: int) -> list[int]:
    return address(height + 1, depth, np.arange(FAN ** depth)).tolist()


def _digest(children: list[bytes]) -> bytes:
    return sha256(b"".join(children).hex().encode()).digest()


def height_of(leaves: int) -> int:
    """Levels above the leaves of a tree that is one block."""
    h = 0
    while FAN ** h < leaves:
        h += 1
    return h


def build_block(leaves: list[bytes], height: int) -> bytes:
    """All digests of a block in van Emde Boas order (places without a node hold zeros)."""
    out = bytearray(32 * _size(height + 1))
    row = leaves
    for depth in range(height, -1, -1):
        for at, node in zip(_places(height, depth), row):
            out[32 * at:32 * at + 32] = node
        if depth:
            row = [_digest(row[i:i + FAN]) for i in range(0, len(row), FAN)]
    return bytes(out)


def siblings(nodes: bytes, height: int, leaves: int, i: int) -> list[tuple[int, list[bytes]]]:
    """For each level from the leaf ``i`` up: its place in its run, and the run's other digests."""
    out = []
    for depth in range(height, 0, -1):
        there = -(-leaves // FAN ** (height - depth))
        first = i - i % FAN
        at = _places(height, depth)[first:min(first + FAN, there)]
        out.append((i - first, [nodes[32 * a:32 * a + 32] for j, a in enumerate(at) if first + j != i]))
        i //= FAN
    return out


def fold(leaf: bytes, proof: list[tuple[int, list[bytes]]]) -> bytes:
    """The root that a leaf and the siblings of a proof lead to."""
    for place, others in proof:
        leaf = _digest([*others[:place], leaf, *others[place:]])
    return leaf


def proof_digest(proof: list[tuple[int, list[bytes]]]) -> bytes:
    """Digest of all siblings, level by level, left to right."""
    return _digest([d for _, others in proof for d in others])


def _pack(proof) -> bytes:
    return b"".join(bytes([place, len(others)]) + b"".join(others) for place, others in proof)


def _unpack(data: bytes) -> list[tuple[int, list[bytes]]]:
    out, at = [], 0
    while at < len(data):
        place, n = data[at], data[at + 1]
        out.append((place, [data[j:j + 32] for j in range(at + 2, at + 2 + 32 * n, 32)]))
        at += 2 + 32 * n
    return out


def _numbered(leaves: DataFrame, order: list[str], name: str) -> DataFrame:
    """``leaves`` with ``pos`` (from 0 within the tree, by ``order``) and ``total``.

    Range-sorted once; rows that are alike in everything are spread by a salt."""
    n = partitions(leaves.sparkSession)
    keys = [F.col("tree"), *[F.col(c).asc_nulls_last() for c in order], F.col("salt")]
    sorted_rows = (leaves.withColumn("salt", F.monotonically_increasing_id())
                   .repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("salt")
                   .withColumn("place", F.monotonically_increasing_id()))
    sorted_rows = stored(sorted_rows, name).withColumn("part", F.shiftright("place", 33))
    count = sorted_rows.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("place").alias("first"))
    whole = Window.partitionBy("tree")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = count.select("tree", "part", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"),
                          F.sum("rows").over(whole).alias("total"))
    return (sorted_rows.join(offset, ["tree", "part"])
            .withColumn("pos", F.col("place") + F.col("shift")).drop("part", "place", "shift"))


def _blocks(leaves: DataFrame, carried: list[str]) -> DataFrame:
    """One row for each block of numbered leaves (tree, pos, total, leaf, ``carried``)."""
    ddl = {f.name: f.dataType.simpleString() for f in leaves.schema}

    def make(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        first, total = table.column("pos")[0].as_py(), table.column("total")[0].as_py()
        height = HEIGHT if total > BLOCK else height_of(total)
        nodes = build_block(table.column("leaf").to_pylist(), height)
        return pa.table({"tree": table.column("tree")[:1], "block": pa.array([first // BLOCK], pa.int64()),
                         "total": pa.array([total], pa.int64()), "leaves": pa.array([len(table)], pa.int32()),
                         "height": pa.array([height], pa.int32()), "nodes": pa.array([nodes], pa.binary()),
                         "top": pa.array([nodes[:32]], pa.binary()),
                         **{c: pa.array([table.column(c).to_pylist()], pa.list_(table.schema.field(c).type)) for c in carried}})

    own = "".join(f", {c} array<{ddl[c]}>" for c in carried)
    return (leaves.groupBy("tree", F.floor(F.col("pos") / BLOCK).cast("long").alias("block"))
            .applyInArrow(make, f"tree string, block long, total long, leaves int, height int, nodes binary, top binary{own}"))


def _write_trees(leaves: DataFrame, path: str, carried: list[str], total: int) -> int:
    """Write the blocks of all trees, stage by stage; the number of stages.
    ``total``: leaves of the largest tree."""
    spark = leaves.sparkSession
    stage = 0
    while total:
        _blocks(leaves, carried if stage == 0 else []).write.parquet(f"{path}/stage={stage}")
        total = -(-total // BLOCK) if total > BLOCK else 0
        leaves = (spark.read.parquet(f"{path}/stage={stage}").where(F.col("total") > BLOCK)
                  .select("tree", F.col("block").alias("pos"), F.col("top").alias("leaf"),
                          F.floor((F.col("total") + (BLOCK - 1)) / BLOCK).cast("long").alias("total")))
        stage += 1
    return stage


def _subroots(spark: SparkSession, path: str, stages: int) -> DataFrame:
    """tree, stage and top digest of each tree's last block."""
    found = [spark.read.parquet(f"{path}/stage={k}").where(F.col("total") <= BLOCK)
             .select("tree", F.lit(k).alias("stage"), "top") for k in range(stages)]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def write_manifest(records: DataFrame, path: str) -> dict[str, int]:
    """Write the manifest of ``records`` (tree, doc_id, leaf and checked as
    hex digests: the record's own, and that of the copy to be checked against
    it); how many stages the trees and the tree of trees have."""
    spark = records.sparkSession
    prepare(spark)
    named = F.coalesce(F.concat(F.lit("="), F.col("tree")), F.lit(""))  # a null tree comes first
    r = stored(records.select(named.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"),
                              F.unhex("leaf").alias("leaf"), F.unhex("checked").alias("checked")), "merkle-leaves")
    numbered = _numbered(r, ["doc_id", "leaf"], "merkle-order")
    largest = numbered.agg(F.max("total")).first()[0] or 0
    stages = _write_trees(numbered, f"{path}/kind=part", ["doc_id", "checked"], largest)
    if not stages:
        return {"part": 0, "whole": 0}
    tops = _subroots(spark, f"{path}/kind=part", stages).select(F.col("tree").alias("name"), F.col("top").alias("leaf"))
    tops = _numbered(tops.withColumn("tree", F.lit("")), ["name"], "merkle-tops")
    trees = tops.agg(F.max("total")).first()[0]
    return {"part": stages, "whole": _write_trees(tops, f"{path}/kind=whole", ["name"], trees)}


def _down(blocks: DataFrame, above: DataFrame, field: str, ddl: str) -> DataFrame:
    """For each leaf of each block: ``field`` and the siblings from there to the root."""
    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                rest = row["above"]
                own = [_pack(siblings(row["nodes"], row["height"], row["leaves"], i)) + rest for i in range(row["leaves"])]
                names = row["name"] if field == "name" else [row["block"] * BLOCK + i for i in range(row["leaves"])]
                n = len(own)
                tree = names if field == "name" else [row["tree"]] * n
                yield pa.RecordBatch.from_pydict({
                    "tree": pa.array(tree, pa.string()), "block": pa.array([0] * n if field == "name" else names, pa.int64()),
                    "above": pa.array(own, pa.binary()), "subroot": pa.array([row["subroot"]] * n, pa.binary()),
                    "root": pa.array([row["root"]] * n, pa.binary())})

    return blocks.join(above, ["tree", "block"]).mapInArrow(paths, ddl)


_ABOVE = "tree string, block long, above binary, subroot binary, root binary"


def _proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with what stands above them to one row for each of their records."""
    for batch in batches:
        for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
            nodes, height, n, root = row["nodes"], row["height"], row["leaves"], row["root"]
            above = _unpack(row["above"])
            at = _places(height, height)
            leaf = [nodes[32 * a:32 * a + 32] for a in at[:n]]
            proof = [siblings(nodes, height, n, i) + above for i in range(n)]
            folded = [fold(c, p) for c, p in zip(row["checked"], proof)]
            yield pa.RecordBatch.from_pydict({
                "tree": pa.array([row["tree"][1:] if row["tree"] else None] * n, pa.string()),
                "doc_id": pa.array(row["doc_id"], pa.int64()), "leaf": [d.hex() for d in leaf],
                "subroot": [row["subroot"].hex()] * n, "root": [root.hex()] * n,
                "proof_sha256": [proof_digest(p).hex() for p in proof], "folded_root": [d.hex() for d in folded],
                "verified": [d == root for d in folded],
                "proof_nodes": pa.array([sum(len(o) for _, o in p) for p in proof], pa.int32())})


def check_copies(spark: SparkSession, path: str, stages: dict[str, int]) -> DataFrame:
    """Each record of a manifest with its proof's digest, and whether the
    digest ``checked`` leads to the root with the siblings of the manifest."""
    if not stages["part"]:
        return spark.createDataFrame([], PROOF_DDL)
    empty = F.lit(b"")
    last = stages["whole"] - 1
    block = {(kind, k): spark.read.parquet(f"{path}/kind={kind}/stage={k}") for kind in stages for k in range(stages[kind])}
    above = block["whole", last].select("tree", "block", empty.alias("above"), empty.alias("subroot"), F.col("top").alias("root"))
    for k in range(last, 0, -1):
        above = _down(block["whole", k], above, "pos", _ABOVE)
    # the path above each tree, with its own top
    tops = _subroots(spark, f"{path}/kind=part", stages["part"])
    over = (_down(block["whole", 0], above, "name", _ABOVE).drop("subroot").join(tops, "tree")
            .select("tree", "block", "above", F.col("top").alias("subroot"), "root", "stage"))
    over = stored(over, "merkle-above")
    above = None
    for k in range(stages["part"] - 1, -1, -1):
        begins = over.where(F.col("stage") == k).drop("stage")
        above = begins if above is None else above.unionByName(begins)
        if k:
            above = _down(block["part", k], above, "pos", _ABOVE)
    return block["part", 0].join(above, ["tree", "block"]).mapInArrow(_proofs, PROOF_DDL)


def tampered(docs: DataFrame) -> DataFrame:
    """Documents whose copies the query checks: where 3 divides the crc32 of
    the id (a null id: of nothing), the copy's text has its A-Z lower-cased."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "n_chars", F.col("text").cast("string").alias("text"))
    changed = F.when(fold_of(F.col("doc_id"), 3) == 0, F.translate("text", UPPER, UPPER.lower())).otherwise(F.col("text"))
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    return d.select(F.col("lang").cast("string").alias("tree"), "doc_id", record_digest(*fields, F.col("text")).alias("leaf"),
                    record_digest(*fields, changed).alias("checked"))

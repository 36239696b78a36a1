"""N-gram Jaccard join by MinHash LSH in trees of one fixed depth (operator 6).

Documents are sets of shingles of five words.  Documents with equal sets are
one class and are joined as one.  Each class has ``TREES`` signatures of a
fixed number of min-hashes (banding): the longest at which the expected recall
of pairs at the threshold reaches the target (:func:`depth_for`, from the
constants, not from the data).  Classes with one signature in some tree (under
one node) are candidates, and every pair of candidates is verified on its whole
shingle sets.  A pair of similarity s is no candidate with probability
(1 - s**depth)**TREES: 5e-8 at the threshold 0.8 (depth 4), less above.

No candidate is dropped and none is expanded into rows: the classes under a node
are cut into blocks, pairs of blocks are compared within one task, and only
each class's number of links and its component within the task leave it.  A
node with n classes is read n / BLOCK times.  A pair that meets in several
trees counts in the first one, which a class's own labels tell without any
exchange.  Linked classes get the least doc_id of their connected component as
class id (star contraction over rows, every round written to the shared folder).

Defined cases: null, empty and wordless texts have no shingles and link to
nothing (each is a class of its own); texts of one to four words are one
shingle; rows that repeat an id or a text are documents of their own; a null id
counts as a document, and a class of null ids alone has a null class id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsq.llm.base import give_back, partitions, plain, prepare, slices, stored
from tsq.llm.hashing import mix, shingles, words

SHINGLE, THRESHOLD = 5, 0.8
TREES, DEEPEST, RECALL = 32, 16, 0.9999999
#: Sets up to which intersections are counted by matrix products.
DENSE = 256
#: Classes and shingles that a block of a trie node holds, about.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 21

SIGNATURE_DDL = "doc_id long, class binary, shingles int, labels array<long>"
SET_DDL = "doc_id long, class binary, labels array<long>, hashes binary"
LINK_DDL = "class binary, texts long, docs long, root binary"
_LABELS = pa.list_(pa.int64())


def depth_for(threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, deepest: int = DEEPEST) -> int:
    """The longest signature, ``deepest`` at most, at which a pair of the
    threshold's similarity meets in some tree with the target probability
    1 - (1 - s^depth)^trees."""
    depth = deepest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def _seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def signatures(texts: pa.Array, depth: int):
    """Of each text: 16 bytes that tell its shingle set (none for no shingle),
    the set's size, and one label per tree (hash of tree and min-hashes)."""
    h, made = shingles(*(lambda w: (w[0], w[3]))(words(texts)), SHINGLE)
    begin = np.cumsum(made) - made
    full = np.flatnonzero(made)
    labels = np.zeros((len(texts), TREES), np.uint64)
    seeds = _seeds(TREES * depth)
    if len(full):
        at = begin[full]
        for t in range(TREES):
            x = np.full(len(full), t + 1, np.uint64)
            for k in range(depth):
                least = np.minimum.reduceat(mix_light(h, seeds[t * depth + k]), at)
                x = mix(x * np.uint64(0x9E3779B97F4A7C15) + least)
            labels[full, t] = x
    keys, sizes = [None] * len(texts), np.zeros(len(texts), np.int64)
    other = np.uint64(0xA24BAED4963EE407)
    for i in full.tolist():
        s = np.unique(h[begin[i]:begin[i] + made[i]])
        sizes[i] = len(s)
        keys[i] = np.array([s.sum(), mix(s ^ other).sum()], np.uint64).tobytes()
    return keys, sizes, labels, h, begin, made


def mix_light(h: np.ndarray, seed: np.uint64) -> np.ndarray:
    """One of a family of orders of hashes that are mixed already."""
    x = h * seed
    return x ^ (x >> np.uint64(29))


def _sign(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            give_back()
            text = plain(batch.column(1))
            for i, j in slices(text):
                keys, sizes, labels, *_ = signatures(text[i:j], depth)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], pa.array(keys, pa.binary()), pa.array(sizes.astype(np.int32)), _label_lists(labels)],
                    names=["doc_id", "class", "shingles", "labels"])
    return run


def _label_lists(labels: np.ndarray) -> pa.Array:
    n = len(labels)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * TREES), pa.array(labels.view(np.int64).ravel()))


def _sets(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            give_back()
            text = plain(batch.column(1))
            for i, j in slices(text):
                keys, sizes, labels, h, begin, made = signatures(text[i:j], depth)
                sets = [np.unique(h[a:a + n]).tobytes() for a, n in zip(begin, made)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(keys, pa.binary()), _label_lists(labels), pa.array(sets, pa.binary())],
                                                 names=["doc_id", "class", "labels", "hashes"])
    return run


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections (n x n; the diagonal isn't used).

    Each hash adds one to all pairs of sets that have it; a hash that most
    sets have is counted by the few sets that lack it."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    if n == 2:
        out = np.zeros((2, 2), np.int32)
        out[0, 1] = out[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return out
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n, dtype=np.int32), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, int)
    have = np.diff(np.append(first, len(flat)))
    out = np.zeros((n, n), np.int32)
    if n <= DENSE:  # one matrix product for some thousand hashes at a time
        keep = np.repeat(have > 1, have)
        rows, column = owner[keep], np.repeat(np.arange(int((have > 1).sum())), have[have > 1])
        for a in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            lo, hi = np.searchsorted(column, [a, a + 4096])
            dense = np.zeros((n, int(column[hi - 1]) + 1 - a), np.float32)
            dense[rows[lo:hi], column[lo:hi] - a] = 1
            out += (dense @ dense.T).astype(np.int32)
        return out
    everyone, lacking, common = np.arange(n), np.zeros(n, np.int32), 0
    for a, m in zip(first[have > 1].tolist(), have[have > 1].tolist()):
        who = owner[a:a + m]
        if 2 * m <= n:
            out[np.ix_(who, who)] += 1
            continue
        common += 1
        if m < n:
            without = np.setdiff1d(everyone, who, assume_unique=True)
            lacking[without] += 1
            out[np.ix_(without, without)] += 1
    return out + common - lacking[:, None] - lacking[None, :]


def _roots(link: np.ndarray) -> np.ndarray:
    """Least index of each one's component."""
    n = len(link)
    root = np.arange(n)
    linked = link.any(1)
    while True:
        low = root.copy()
        for i in np.flatnonzero(linked).tolist():
            low[i] = min(low[i], int(root[link[i]].min()))
        low = np.minimum(low, low[low])
        if (low == root).all():
            return root
        root = low


def _compare(threshold: float):
    def group(tree: int, cross: bool, rows: list[tuple]) -> list[tuple]:
        # copies of an id can bring a class twice
        seen: dict[bytes, tuple] = {}
        for r in rows:
            seen.setdefault(r[0], r)
        rows = list(seen.values())
        if len(rows) < 2:
            return []
        sets = [np.frombuffer(r[2], np.uint64) for r in rows]
        size = np.array([len(s) for s in sets])
        both = shared(sets)
        link = np.empty(both.shape, bool)
        for i in range(0, len(rows), 256):  # J >= t is |both| (1 + t) >= t (|a| + |b|)
            link[i:i + 256] = both[i:i + 256] * (1 + threshold) >= threshold * (size[i:i + 256, None] + size[None, :]) - 1e-9
        np.fill_diagonal(link, False)
        del both
        if not link.any():
            return []
        root = _roots(link)
        mine = link  # pairs that count here
        if cross:
            side = np.array([r[4] for r in rows])
            mine = mine & (side[:, None] != side[None, :])
        label = np.array([r[1] for r in rows])
        for t in range(tree):  # they met in an earlier tree
            mine = mine & (label[:, t][:, None] != label[:, t][None, :])
        copies = np.array([r[3] for r in rows])
        texts, docs = mine.sum(1), np.array([copies[m].sum() for m in mine])
        return [(rows[i][0], int(texts[i]), int(docs[i]), rows[root[i]][0]) for i in np.flatnonzero(link.any(1)).tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []

        def out(found):
            cols = list(zip(*found)) if found else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int64(), pa.binary()))],
                                              names=["class", "texts", "docs", "root"])

        for batch in batches:
            node, tree, a, b, side, copies = (batch.column(c).to_pylist() for c in (0, 1, 2, 3, 4, 5))
            cls, hashes = batch.column(6), batch.column(8)
            labels = np.asarray(batch.column(7).flatten()).reshape(-1, TREES)
            found = []
            for i in range(batch.num_rows):
                here = (node[i], tree[i], a[i], b[i])
                if here != at:
                    if len(rows) > 1:
                        found += group(at[1], at[2] != at[3], rows)
                    at, rows = here, []
                rows.append((cls[i].as_py(), labels[i].copy(), hashes[i].as_py(), copies[i], side[i]))
            yield out(found)
        if len(rows) > 1:
            yield out(group(at[1], at[2] != at[3], rows))
        rows.clear()
        give_back()
    return run


def components(edges: DataFrame) -> DataFrame:
    """node, root of all nodes of ``edges`` (u, v): root is the least node of
    the connected component.  Rounds of large-star and small-star, each over
    rows and written to the shared folder, until nothing changes."""
    def stars(e: DataFrame, pairs: DataFrame) -> DataFrame:
        """Every pair (u, v) becomes (v, least neighbour of u)."""
        low = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        return pairs.join(low, "u")

    e = stored(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (stars(e, both).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
                 .where("u != v").distinct())
        # small star: of a node's lesser neighbours and itself, all but the least point to the least
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = (large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("low").alias("v")),
                                                               F.struct(F.col("u").alias("u"), F.col("low").alias("v")))).alias("p"))
                 .select("p.u", "p.v").where("u != v").distinct())
        e = stored(small, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Per document (doc_id, text): doc_id, class_id, n_links (other documents
    of equal or linked texts), n_text_links (other classes of equal texts that
    are linked), copies (documents with the same shingles), class (binary, null
    without words)."""
    spark = docs.sparkSession
    prepare(spark)
    depth = depth_for(threshold, recall)
    n = partitions(spark)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stored(d.mapInArrow(_sign(depth), SIGNATURE_DDL), "jaccard-signatures")
    classes = (signed.where(F.col("class").isNotNull()).groupBy("class")
               .agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("labels").alias("labels"), F.first("shingles").alias("shingles")))
    members = stored(classes, "jaccard-classes")
    spots = members.select("class", "rep", "copies", "shingles", F.posexplode("labels").alias("tree", "node"))
    # nodes with company; of nodes with the same classes the first tree's is enough
    nodes = (spots.groupBy("tree", "node")
             .agg(F.count("*").alias("n"), F.sum("shingles").alias("mass"),
                  F.sum(F.xxhash64("class").cast("decimal(38,0)")).alias("same"))
             .where("n > 1").groupBy("n", "same").agg(F.min(F.struct("tree", "node", "mass")).alias("at"))
             .select("at.tree", "at.node", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("at.mass") / BLOCK_SHINGLES)).cast("int").alias("blocks")))
    busy = stored(spots.drop("shingles").join(nodes, ["tree", "node"])
                  .groupBy("class").agg(F.first("rep").alias("rep"), F.first("copies").alias("copies"),
                                        F.collect_list(F.struct("tree", "node", "blocks")).alias("at")), "jaccard-busy")
    # the shingles of classes with company, from one text of each
    texts = d.join(busy.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").unionByName(
        d.where("doc_id is null"))
    sets = texts.mapInArrow(_sets(depth), SET_DDL).drop("doc_id").dropDuplicates(["class"])
    placed = (sets.join(busy, "class").select("class", "labels", "hashes", "copies", F.explode("at").alias("at"))
              .select("class", "labels", "hashes", "copies", "at.tree", "at.node", "at.blocks")
              .withColumn("own", F.pmod(F.xxhash64("class", "node"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("node", "tree", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"),
                      F.col("own").alias("side"), "copies", "class", "labels", "hashes"))
    links = stored(placed.repartition(n, "node", "a", "b").sortWithinPartitions("node", "tree", "a", "b")
                   .mapInArrow(_compare(threshold), LINK_DDL), "jaccard-links")
    totals = links.groupBy("class").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    roots = components(links.select(F.col("class").alias("u"), F.col("root").alias("v")))
    linked = (totals.join(roots.withColumnRenamed("node", "class"), "class", "left")
              .join(members.select("class", "rep"), "class")
              .withColumn("root", F.coalesce("root", "class")))
    least = linked.groupBy("root").agg(F.min("rep").alias("class_id"))
    linked = linked.join(least, "root").select("class", "texts", "docs", "class_id")
    # written, so that the last join is a plain one of two shuffles, which AQE can split at a hot class
    per_class = stored(members.select("class", "rep", "copies").join(linked, "class", "left"), "jaccard-found")
    return (signed.select("doc_id", "class").join(per_class, "class", "left")
            .select("doc_id",
                    F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.coalesce("class_id", "rep")).alias("class_id"),
                    (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("docs", F.lit(0))).alias("n_links"),
                    F.coalesce("texts", F.lit(0)).cast("long").alias("n_text_links"),
                    F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), "class"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the least of their class, all
    columns kept.  Rows with one doc_id are one document here: they stay if any
    of them does.  Documents without words and rows with a null id stay."""
    found = jaccard_classes(docs).where("class is not null and doc_id is not null")
    gone = stored(found.groupBy("doc_id").agg(F.min(F.col("doc_id") > F.col("class_id")).alias("gone")).where("gone").select("doc_id"), "jaccard-gone")
    return docs.join(gone, "doc_id", "left_anti").select([F.col(f"`{c}`") for c in docs.columns])

"""Re-indexing of long series: pooling, chunks, patches, segments,
padding, pyramid ids, sinusoid codes.

Everything is expressed on long-form rows (key, t, value): a reshape is a
new index computed from ``t`` (and the series length from a small count
table), pooling is a ``groupBy`` on the new index.  No series is ever
gathered into an array.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsq.operators.index import _keys
from tsq.operators.windows import with_count


def pool(df: DataFrame, keys, t: str, value: str, window: int, how: str = "avg") -> DataFrame:
    """Non-overlapping pooling by ``window`` rows; incomplete tail dropped.
    Output (keys, t = bucket, value)."""
    keys = _keys(keys)
    d = with_count(df, keys)
    d = d.filter(F.col(t) < F.floor(F.col("_n") / F.lit(window)) * F.lit(window))
    fn = {"avg": F.avg, "max": F.max, "min": F.min, "sum": F.sum}[how]
    return d.groupBy(*keys, F.floor(F.col(t) / F.lit(window)).cast("long").alias(t)).agg(fn(value).alias(value))


def pool_levels(df: DataFrame, keys, t: str, value: str, window: int, levels: int, how: str = "avg") -> DataFrame:
    """Repeated pooling: level 0 = input, level k = pooling of level k-1."""
    keys = _keys(keys)
    cur = df.select(*keys, t, value)
    out = cur.withColumn("level", F.lit(0))
    for lv in range(1, levels + 1):
        cur = pool(cur, keys, t, value, window, how)
        out = out.unionByName(cur.withColumn("level", F.lit(lv)))
    return out


def maxpool_overlap(df: DataFrame, keys, t: str, value: str) -> DataFrame:
    """max over kernel 3, stride 2, padding 1: out[i] = max(x[2i-1..2i+1])."""
    keys = _keys(keys)
    d = df.select(*keys, t, value)
    # each row feeds outputs i with 2i-1 <= t <= 2i+1
    cand = F.filter(F.array(F.floor((F.col(t) - 1) / 2), F.floor(F.col(t) / 2), F.floor((F.col(t) + 1) / 2)),
                    lambda i: (F.lit(2) * i - 1 <= F.col(t)) & (F.col(t) <= F.lit(2) * i + 1))
    d = d.withColumn("_i", F.explode(F.array_distinct(cand)))
    n = with_count(df, keys).select(*keys, "_n").distinct()
    d = d.join(n, keys) if keys else d.crossJoin(F.broadcast(n))
    # output length floor((n + 2 - 3) / 2) + 1
    d = d.filter(F.col("_i") <= F.floor((F.col("_n") - 1) / 2))
    return d.groupBy(*keys, F.col("_i").cast("long").alias(t)).agg(F.max(value).alias(value))


def chunks(df: DataFrame, keys, t: str, size: int, mode: str = "continuous") -> DataFrame:
    """Reshape T into chunks of ``size``: continuous (chunk = t // size,
    pos = t % size) or interval sampling (chunk = t % n_chunks,
    pos = t // n_chunks); only complete chunks are kept."""
    keys = _keys(keys)
    d = with_count(df, keys)
    n_chunks = F.floor(F.col("_n") / F.lit(size))
    d = d.filter(F.col(t) < n_chunks * F.lit(size))
    if mode == "continuous":
        chunk, pos = F.floor(F.col(t) / F.lit(size)), F.col(t) % F.lit(size)
    else:
        chunk, pos = F.col(t) % n_chunks, F.floor(F.col(t) / n_chunks)
    return d.withColumn("chunk", chunk.cast("long")).withColumn("pos", pos.cast("long")).drop("_n")


def edge_pad(df: DataFrame, keys, t: str, value: str, pad: int) -> DataFrame:
    """Append ``pad`` copies of each series' last value (right edge
    replication)."""
    keys = _keys(keys)
    last = df.groupBy(*keys).agg(F.max(t).alias("_tl"), F.max_by(value, t).alias("_vl"))
    pads = last.select(*keys, F.explode(F.sequence(F.col("_tl") + 1, F.col("_tl") + F.lit(pad))).alias(t),
                       F.col("_vl").alias(value))
    return df.select(*keys, t, value).unionByName(pads)


def patches(df: DataFrame, keys, t: str, value: str, length: int, stride: int) -> DataFrame:
    """Overlapping patches (``length``, ``stride``) after right edge
    replication by ``stride`` points; long form (patch_id, pos)."""
    keys = _keys(keys)
    p = edge_pad(df, keys, t, value, stride)
    p = with_count(p, keys)
    n_patch = F.floor((F.col("_n") - F.lit(length)) / F.lit(stride)) + 1
    lo = F.greatest(F.ceil((F.col(t) - F.lit(length - 1)) / F.lit(stride)), F.lit(0))
    hi = F.least(F.floor(F.col(t) / F.lit(stride)), n_patch - 1)
    p = p.withColumn("patch_id", F.explode(F.when(lo <= hi, F.sequence(lo.cast("long"), hi.cast("long")))))
    return p.withColumn("pos", (F.col(t) - F.col("patch_id") * F.lit(stride)).cast("int")).drop("_n")


def segments(df: DataFrame, keys, t: str, value: str, seg_len: int) -> DataFrame:
    """Non-overlapping segments after right edge replication up to a
    multiple of ``seg_len``; long form (segment_id, pos)."""
    keys = _keys(keys)
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    padn = n.withColumn("_pad", (F.ceil(F.col("_n") / F.lit(seg_len)) * F.lit(seg_len) - F.col("_n")).cast("int"))
    last = df.groupBy(*keys).agg(F.max(t).alias("_tl"), F.max_by(value, t).alias("_vl")).join(padn, keys) if keys else None
    if last is None:
        last = df.agg(F.max(t).alias("_tl"), F.max_by(value, t).alias("_vl")).crossJoin(padn)
    pads = last.filter(F.col("_pad") > 0).select(
        *keys, F.explode(F.sequence(F.col("_tl") + 1, F.col("_tl") + F.col("_pad"))).alias(t), F.col("_vl").alias(value))
    d = df.select(*keys, t, value).unionByName(pads)
    return d.withColumn("segment_id", F.floor(F.col(t) / F.lit(seg_len)).cast("long")) \
        .withColumn("pos", (F.col(t) % F.lit(seg_len)).cast("int"))


def segment_merge(seg: DataFrame, keys, win: int = 2) -> DataFrame:
    """Merge ``win`` adjacent segments; when the count is not a multiple,
    the last segments are repeated to fill the final group."""
    keys = _keys(keys)
    cnt = seg.groupBy(*keys).agg(F.max("segment_id").alias("_ms"), F.max("pos").alias("_mp"))
    d = seg.join(cnt, keys) if keys else seg.crossJoin(F.broadcast(cnt))
    n_seg = F.col("_ms") + 1
    pad = (F.ceil(n_seg / F.lit(win)) * F.lit(win) - n_seg).cast("long")
    # a segment s feeds slot s, and the repeated tail slots n_seg.. are
    # copies of the last `pad` segments
    slots = F.array_union(F.array(F.col("segment_id")),
                          F.when(F.col("segment_id") >= n_seg - pad,
                                 F.array(F.col("segment_id") + pad)).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("_slot", F.explode(slots))
    return d.withColumn("merged_id", F.floor(F.col("_slot") / F.lit(win)).cast("long")) \
        .withColumn("pos", ((F.col("_slot") % F.lit(win)) * (F.col("_mp") + 1) + F.col("pos")).cast("int")) \
        .drop("_slot", "_ms", "_mp")


def pad_to_multiple(df: DataFrame, keys, t: str, value: str, period: int) -> DataFrame:
    """Zero-pad each series to a multiple of ``period`` and fold it into a
    (cycle, phase) grid."""
    keys = _keys(keys)
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    target = F.ceil(F.col("_n") / F.lit(period)) * F.lit(period)
    pads = n.filter(target > F.col("_n")).select(
        *keys, F.explode(F.sequence(F.col("_n"), (target - 1).cast("long"))).alias(t), F.lit(0.0).alias(value))
    d = df.select(*keys, t, value).unionByName(pads)
    return d.withColumn("cycle", F.floor(F.col(t) / F.lit(period)).cast("long")) \
        .withColumn("phase", (F.col(t) % F.lit(period)).cast("int"))


def pad_clip(df: DataFrame, keys, t: str, value: str, max_len: int) -> DataFrame:
    """Clip or zero-pad each series to ``max_len``; ``mask`` = 1 on real
    points, padded values are 0."""
    keys = _keys(keys)
    real = df.filter(F.col(t) < max_len).select(*keys, t, value, F.lit(1).alias("mask"))
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    pads = n.filter(F.col("_n") < max_len).select(
        *keys, F.explode(F.sequence(F.col("_n"), F.lit(max_len - 1).cast("long"))).alias(t),
        F.lit(0.0).alias(value), F.lit(0).alias("mask"))
    return real.unionByName(pads)


def subsample(df: DataFrame, keys, t: str, limit: int = 256, factor: int = 2) -> DataFrame:
    """Series longer than ``limit`` keep every ``factor``-th point
    (re-indexed); shorter ones are unchanged."""
    keys = _keys(keys)
    d = with_count(df, keys)
    long_ = F.col("_n") > limit
    d = d.filter(~long_ | (F.col(t) % F.lit(factor) == 0))
    return d.withColumn(t, F.when(long_, (F.col(t) / F.lit(factor)).cast("long")).otherwise(F.col(t))).drop("_n")


def pyramid_index(df: DataFrame, keys, t: str, windows: Sequence[int]) -> DataFrame:
    """Bucket id of every point at each coarser level (level sizes
    L, L//w1, L//(w1*w2), ...; the last bucket of a level absorbs the
    rest)."""
    keys = _keys(keys)
    d = with_count(df, keys)
    size = F.col("_n")
    cur = F.col(t)
    for j, w in enumerate(windows, start=1):
        size = F.floor(size / F.lit(w))
        cur = F.least(F.floor(cur / F.lit(w)), size - 1)
        d = d.withColumn(f"level_{j}", cur.cast("long"))
    return d.drop("_n")


def sinusoid(code, d_model: int) -> list:
    """sin/cos position code: dim 2i = sin(p * exp(-2i ln(1e4)/d)),
    dim 2i+1 = cos(...); returns a (dim, value) array to explode."""
    p = F.col(code).cast("double") if isinstance(code, str) else code.cast("double")
    items = []
    for i in range(0, d_model, 2):
        div = math.exp(-i * math.log(10000.0) / d_model)
        items.append(F.struct(F.lit(i).alias("dim"), F.sin(p * F.lit(div)).alias("value")))
        if i + 1 < d_model:
            items.append(F.struct(F.lit(i + 1).alias("dim"), F.cos(p * F.lit(div)).alias("value")))
    return F.array(*items)

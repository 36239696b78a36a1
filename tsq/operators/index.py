"""Row positions and block-local windows for long series.

Spark has no row position, and ``Window.partitionBy(series).orderBy(t)`` sends
a whole series to one task.  A series may hold a third of all rows, so the
operators here never window over a whole series:

* :func:`series_index` gives each row its 0-based position ``t`` inside its
  series.  Rows are cut into coarse buckets of the order key (default: one
  day for timestamps, one month for dates); a small table of per-bucket counts
  gives each bucket its start offset (prefix sum over buckets), and
  ``row_number`` runs inside (series, bucket) only.
* :func:`halo` cuts each series into blocks of ``block`` consecutive rows and
  copies the last ``back`` rows of a block into the next block (and the first
  ``ahead`` rows into the previous one).  Any window whose frame reaches at
  most ``back`` rows back and ``ahead`` rows forward gives exactly the
  whole-series answer when run per (series, block); the copies are dropped
  afterwards with :func:`core_rows`.
* :func:`fill_forward` / :func:`fill_backward` carry the last (next) non-null
  value over gaps of any length with a per-block carry table, again without a
  whole-series window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_COL = "_blk"
HALO_COL = "_halo"


def _keys(keys: str | Sequence[str] | None) -> list[str]:
    if keys is None:
        return []
    return [keys] if isinstance(keys, str) else list(keys)


def _null_safe_on(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & a[c].eqNullSafe(b[c])
    return cond


def default_bucket(df: DataFrame, order: str) -> Column:
    dt = df.schema[order].dataType
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        # event-level timestamps: one bucket per series and day
        return F.date_trunc("day", F.col(order))
    if isinstance(dt, T.DateType):
        return F.date_trunc("month", F.col(order))
    return F.floor(F.col(order).cast("double") / F.lit(65536.0))


def series_index(
    df: DataFrame,
    keys: str | Sequence[str] | None,
    order: str | Sequence[str],
    out: str = "t",
    bucket: Column | None = None,
) -> DataFrame:
    """Add ``out`` = 0-based position of each row in its series by ``order``.

    ``order`` may list tie-breakers after the main order key; the bucket is
    computed from the first one and must be monotone in it.
    """
    keys = _keys(keys)
    order = _keys(order)
    b = bucket if bucket is not None else default_bucket(df, order[0])
    with_b = df.withColumn("_ib", b)
    counts = with_b.groupBy(*keys, "_ib").agg(F.count(F.lit(1)).alias("_n"))
    wb = Window.partitionBy(*keys).orderBy("_ib").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(*keys, "_ib", F.coalesce(F.sum("_n").over(wb), F.lit(0)).alias("_off"))
    offs = offs.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_ib", "_off").withColumnRenamed("_ib", "_ib2")
    cond = F.col("_ib").eqNullSafe(F.col("_ib2"))
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    j = with_b.join(offs, cond).drop("_ib2", *[f"_k_{k}" for k in keys])
    w = Window.partitionBy(*keys, "_ib").orderBy(*order)
    return j.withColumn(out, F.col("_off") + F.row_number().over(w) - 1).drop("_ib", "_off")


def halo(
    df: DataFrame, t: str = "t", back: int = 0, ahead: int = 0, block: int = 4096
) -> DataFrame:
    """Assign rows to blocks of ``block`` rows with ``back``/``ahead`` copies.

    A block is at least as long as its halo.  Adds ``_blk`` (block id) and
    ``_halo`` (True for copied rows).  Window
    with ``Window.partitionBy(*keys, '_blk').orderBy(t)`` and keep
    ``core_rows``.
    """
    block = max(block, back, ahead)  # copies reach the neighbouring blocks only
    tc = F.col(t)
    blk = F.floor(tc / F.lit(block)).cast("long")
    pos = tc - blk * F.lit(block)
    cands = [F.struct(blk.alias(BLOCK_COL), F.lit(False).alias(HALO_COL))]
    if back > 0:
        cands.append(F.when(pos >= F.lit(block - back),
                            F.struct((blk + 1).alias(BLOCK_COL), F.lit(True).alias(HALO_COL))))
    if ahead > 0:
        cands.append(F.when((pos < F.lit(ahead)) & (blk > 0),
                            F.struct((blk - 1).alias(BLOCK_COL), F.lit(True).alias(HALO_COL))))
    arr = F.filter(F.array(*cands), lambda s: s.isNotNull())
    cols = [c for c in df.columns]
    return df.select(*cols, F.inline(arr))


def block_window(keys: str | Sequence[str] | None, t: str = "t"):
    return Window.partitionBy(*_keys(keys), BLOCK_COL).orderBy(t)


def core_rows(df: DataFrame) -> DataFrame:
    return df.filter(~F.col(HALO_COL)).drop(BLOCK_COL, HALO_COL)


def _fill(df: DataFrame, keys, t: str, cols: Sequence[str], block: int, forward: bool) -> DataFrame:
    keys = _keys(keys)
    blk = F.floor(F.col(t) / F.lit(block)).cast("long")
    d = df.withColumn("_fb", blk)
    # last (first) non-null value of every column per block: a small table
    pick = F.max_by if forward else F.min_by
    per_blk = d.groupBy(*keys, "_fb").agg(
        *[pick(F.col(c), F.when(F.col(c).isNotNull(), F.col(t))).alias(f"_v_{c}") for c in cols]
    )
    # carry into each block = last non-null of all earlier (later) blocks
    if forward:
        wc = Window.partitionBy(*keys).orderBy("_fb").rowsBetween(Window.unboundedPreceding, -1)
        carry = per_blk.select(*keys, "_fb", *[F.last(f"_v_{c}", ignorenulls=True).over(wc).alias(f"_c_{c}") for c in cols])
    else:
        wc = Window.partitionBy(*keys).orderBy("_fb").rowsBetween(1, Window.unboundedFollowing)
        carry = per_blk.select(*keys, "_fb", *[F.first(f"_v_{c}", ignorenulls=True).over(wc).alias(f"_c_{c}") for c in cols])
    carry = carry.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_fb").alias("_fb2"),
                         *[f"_c_{c}" for c in cols])
    cond = F.col("_fb").eqNullSafe(F.col("_fb2"))
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    j = d.join(carry, cond, "left")
    if forward:
        w = Window.partitionBy(*keys, "_fb").orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
        filled = [F.coalesce(F.last(c, ignorenulls=True).over(w), F.col(f"_c_{c}")).alias(c) for c in cols]
    else:
        w = Window.partitionBy(*keys, "_fb").orderBy(t).rowsBetween(0, Window.unboundedFollowing)
        filled = [F.coalesce(F.first(c, ignorenulls=True).over(w), F.col(f"_c_{c}")).alias(c) for c in cols]
    keep = [c for c in df.columns if c not in cols]
    out = j.select(*keep, *filled)
    return out.select(*df.columns)


def fill_forward(df: DataFrame, keys, t: str, cols: Sequence[str], block: int = 65536) -> DataFrame:
    """Carry the last non-null value forward within each series (exact)."""
    return _fill(df, keys, t, list(cols), block, True)


def fill_backward(df: DataFrame, keys, t: str, cols: Sequence[str], block: int = 65536) -> DataFrame:
    """Carry the next non-null value backward within each series (exact)."""
    return _fill(df, keys, t, list(cols), block, False)


def running_sum(
    df: DataFrame,
    keys: str | Sequence[str] | None,
    order: str | Sequence[str],
    value: str,
    out: str,
    bucket: Column | None = None,
    inclusive: bool = True,
) -> DataFrame:
    """Running sum of ``value`` in ``order`` per series, without a
    whole-series window: per-bucket totals -> prefix offsets (small table)
    + running sum inside (series, bucket).  ``inclusive=False`` excludes
    the current row."""
    keys = _keys(keys)
    order = _keys(order)
    b = bucket if bucket is not None else default_bucket(df, order[0])
    with_b = df.withColumn("_ib", b)
    tot = with_b.groupBy(*keys, "_ib").agg(F.sum(value).alias("_s"))
    wb = Window.partitionBy(*keys).orderBy("_ib").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_ib").alias("_ib2"),
                      F.coalesce(F.sum("_s").over(wb), F.lit(0)).alias("_off"))
    cond = F.col("_ib").eqNullSafe(F.col("_ib2"))
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    j = with_b.join(offs, cond).drop("_ib2", *[f"_k_{k}" for k in keys])
    upper = 0 if inclusive else -1
    w = Window.partitionBy(*keys, "_ib").orderBy(*order).rowsBetween(Window.unboundedPreceding, upper)
    return j.withColumn(out, F.col("_off") + F.coalesce(F.sum(value).over(w), F.lit(0))).drop("_ib", "_off")


def series_index_ranged(df: DataFrame, keys: str | Sequence[str] | None, order: str | Sequence[str],
                        out: str = "t") -> DataFrame:
    """Row positions with no bucket choice: range-partition by (keys,
    order) -- sampled bounds split even one hot series across tasks -- sort
    inside partitions, and take positions from the file-ordered scan id.

    The partitioned, id-tagged rows are materialised once so every consumer
    sees the same ids; per (partition, series) first id and count form a
    small table whose prefix sums over partitions give each run's offset.
    ``order`` should be total (add a tie-breaker) for a unique order."""
    from tsq.session import materialize
    keys, order = _keys(keys), _keys(order)
    d = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    d = materialize(d.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id()),
                    "ranged-index")
    g = d.groupBy("_pid", *keys).agg(F.min("_mid").alias("_m0"), F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    g = g.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_pid").alias("_p2"), "_m0",
                 F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_off"))
    cond = F.col("_pid") == F.col("_p2")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    j = d.join(g, cond).withColumn(out, F.col("_off") + F.col("_mid") - F.col("_m0"))
    return j.drop("_pid", "_mid", "_p2", "_m0", "_off", *[f"_k_{k}" for k in keys])

"""Alignment of text, vectors and metadata to series rows (joins by key).

The reference aligns by array position; here every join is an equi-join on
keys so Catalyst/AQE pick broadcast or sort-merge from runtime sizes, and a
hot key is split by AQE's skew handling.  The as-of join is exact and has
no interval join and no per-key gathering: ranks come from the distributed
index, the number of right rows before each left row from a distributed
running count, and the k latest matches are an equi-join on (key, rank).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsq.functions import rng
from tsq.operators.index import _keys, running_sum, series_index


def asof_last_k(left: DataFrame, right: DataFrame, keys, left_time: str, right_time: str, k: int,
                right_order: Sequence[str] = (), strict: bool = True, bucket_unit: str = "month") -> DataFrame:
    """For every left row, the (up to) ``k`` latest right rows of the same
    key with right_time < left_time (<= when ``strict`` is False).

    Returns left rows x matches with ``match_rank`` 1 = latest; left rows
    without a match are kept with NULL right columns (rank NULL).
    """
    keys = _keys(keys)
    rord = [right_time, *right_order]
    r = series_index(right, keys, rord, out="_rr",
                     bucket=F.date_trunc(bucket_unit, F.col(right_time).cast("timestamp")))
    # kinds: right rows first at equal time for <=, left first for <
    kr, kl = (1, 0) if strict else (0, 1)
    lt_type = left.schema[left_time].dataType.simpleString()
    u = left.select(*keys, F.col(left_time).cast("timestamp").alias("_tm"), F.lit(kl).alias("_kind"),
                    F.lit(0).alias("_isr"), F.col(left_time).alias("_lt")).distinct() \
        .unionByName(r.select(*keys, F.col(right_time).cast("timestamp").alias("_tm"), F.lit(kr).alias("_kind"),
                              F.lit(1).alias("_isr"), F.lit(None).cast(lt_type).alias("_lt")))
    u = running_sum(u, keys, ["_tm", "_kind"], "_isr", "_c", bucket=F.date_trunc(bucket_unit, F.col("_tm")))
    # left rows are identified by (keys, left_time): equal pairs share matches
    cnt = u.filter(F.col("_isr") == 0).select(*keys, F.col("_lt").alias(left_time), "_c")
    ranks = cnt.select(*keys, left_time, F.explode(F.sequence(F.lit(1), F.lit(k))).alias("match_rank"), "_c") \
        .withColumn("_rr", F.col("_c") - F.col("match_rank")).filter(F.col("_rr") >= 0).drop("_c")
    lk = left.join(ranks, [*keys, left_time], "left")
    rr = r.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in r.columns]).withColumnRenamed("_rr", "_rr_r")
    cond = F.col("_rr") == F.col("_rr_r")
    for c in keys:
        cond = cond & (F.col(c) == F.col(f"_r_{c}"))
    return lk.join(rr, cond, "left").drop("_rr", "_rr_r", *[f"_r_{c}" for c in keys])


def pick_partner(df: DataFrame, group: str, id_col: str, seed: int, out: str = "partner_id") -> DataFrame:
    """One random other member of the same group per row (no all-pairs):
    members are ranked by id inside their group (distributed index), the
    partner is the member (rank + 1 + floor(u * (n - 1))) mod n, fetched by
    an equi-join on (group, rank).  Groups of one get no partner."""
    r = series_index(df.select(group, id_col), group, id_col, out="_rk",
                     bucket=F.floor(F.col(id_col) / F.lit(65536)))
    n = r.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    r = r.join(n, group)
    u = rng.uniform(group, id_col, F.lit("partner"), F.lit(seed))
    r = r.withColumn("_pr", (F.col("_rk") + 1 + F.floor(u * (F.col("_n") - 1))) % F.col("_n"))
    other = r.select(F.col(group).alias("_g"), F.col("_rk").alias("_pr2"), F.col(id_col).alias(out))
    j = r.filter(F.col("_n") > 1).join(other, (F.col(group) == F.col("_g")) & (F.col("_pr") == F.col("_pr2")))
    return j.select(id_col, group, out)


def pick_others(df: DataFrame, group: str, id_col: str, k: int, seed: int, tag: str, out: str = "other_id") -> DataFrame:
    """Up to ``k`` distinct members of *other* groups per row, drawn from the
    whole table: all rows stand in one order (groups one after the other, a
    hash order inside), a row's own group is a run of it, and the k members
    stand at equal distances from a random place among the rest (equi-join on
    the place).  Adds ``j`` (0..k-1)."""
    base = df.select(group, id_col).withColumn("_h", rng.uniform(group, id_col, F.lit(tag), F.lit(seed)))
    r = series_index(base, group, ["_h", id_col], out="_rk", bucket=F.floor(F.col("_h") * F.lit(1024.0)))
    # one row per group: its size, its first place, and the number of all rows
    sizes = base.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    runs = sizes.select(group, "_n", (F.sum("_n").over(Window.orderBy(group)) - F.col("_n")).alias("_first"))
    runs = runs.crossJoin(F.broadcast(sizes.agg(F.sum("_n").alias("_all"))))
    r = r.join(runs, group).withColumn("_at", F.col("_first") + F.col("_rk"))
    rest = F.col("_all") - F.col("_n")
    d = r.filter(rest > 0).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).filter(F.col("j") < rest)
    start = F.floor(rng.uniform(group, id_col, F.lit(tag + "-off"), F.lit(seed)) * rest)
    place = (start + F.col("j") * F.greatest(F.floor(rest / F.lit(k)), F.lit(1))) % rest
    d = d.withColumn("_to", (F.col("_first") + F.col("_n") + place) % F.col("_all"))
    other = r.select(F.col("_at").alias("_to2"), F.col(id_col).alias(out))
    return d.join(other, F.col("_to") == F.col("_to2")).select(id_col, group, "j", out)


def pick_members(df: DataFrame, group: str | None, id_col: str, k: int, seed: int, tag: str,
                 exclude_self: bool = True, out: str = "member_id") -> DataFrame:
    """Up to ``k`` distinct other members of the same group (of the whole
    table when ``group`` is None) per row, taken consecutively from a
    hash-random offset in the group's hash order (equi-join on (group,
    rank)); no all-pairs.  Adds ``j`` (0..k-1)."""
    gk = [group] if group else []
    gcol = F.col(group) if group else F.lit(0)
    base = df.select(*gk, id_col).withColumn("_h", rng.uniform(gcol, id_col, F.lit(tag), F.lit(seed)))
    r = series_index(base, group, ["_h", id_col], out="_rk", bucket=F.floor(F.col("_h") * F.lit(1024.0)))
    if gk:
        r = r.join(r.groupBy(group).agg(F.count(F.lit(1)).alias("_n")), group)
    else:
        r = r.crossJoin(F.broadcast(r.agg(F.count(F.lit(1)).alias("_n"))))
    m = F.col("_n") - 1 if exclude_self else F.col("_n")
    o = F.floor(rng.uniform(gcol, id_col, F.lit(tag + "-off"), F.lit(seed)) * m)
    d = r.filter(m > 0).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    d = d.filter(F.col("j") < m)
    tgt = ((F.col("_rk") + 1 + (o + F.col("j")) % m) % F.col("_n")) if exclude_self else ((o + F.col("j")) % F.col("_n"))
    d = d.withColumn("_tr", tgt)
    other = r.select(*[F.col(c).alias("_g") for c in gk], F.col("_rk").alias("_tr2"), F.col(id_col).alias(out))
    cond = F.col("_tr") == F.col("_tr2")
    if gk:
        cond = cond & (F.col(group) == F.col("_g"))
    j = d.join(other, cond)
    return j.select(id_col, *gk, "j", out)

"""Exponential smoothing of series of any length, exact with nulls.

y_t = (1 - alpha) y + alpha x for the last y; over a gap the old value fades
with every row: y_t = (w y + alpha x) / (w + alpha), w = (1 - alpha)^g, where g
counts the rows since the last non-null x.  Rows with a null x keep y; before
the first non-null x there is none.

A series is cut into blocks of rows.  What a block does to the y that comes in
is affine in it, so a block is summed up by a few numbers; one pass over the
small table of blocks gives each block its incoming y, and then every block is
finished on its own.  No term is cut off, and no block reads another's rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsq.operators.index import _keys

BLOCK_ROWS = 4096


class Smooth(NamedTuple):
    """One smoothing: column ``x``, weight ``alpha`` of the newest value, name
    of the result, and the column that holds y before the first row (if any)."""

    x: str
    alpha: float
    out: str
    init: str | None = None


def _local(x: np.ndarray, alpha: float):
    """A block on its own: index of the first value (-1: none), smoothed values
    as if it began there, and the share of that first y in each later one."""
    there = np.flatnonzero(~np.isnan(x))
    if not len(there):
        return -1, np.full(len(x), np.nan), np.zeros(len(x))
    y = pd.Series(x).ewm(alpha=alpha, adjust=False, ignore_na=False).mean().to_numpy()
    fade = (1.0 - alpha) ** np.diff(there)
    kept = np.ones(len(x))
    kept[there[1:]] = fade / (fade + alpha)
    return int(there[0]), y, np.cumprod(kept)


def _enter(y: float, age: int, first: int, x: float, alpha: float) -> float:
    """y at a block's first value, ``first`` rows into it."""
    if np.isnan(y):
        return x
    w = (1.0 - alpha) ** (age + first + 1)
    return (w * y + alpha * x) / (w + alpha)


#: Groups of more rows are smoothed one by one, shorter ones row by row for all groups at once.
LONG_ROWS = 512


def _starts(table: pa.Table, by: Sequence[str]) -> np.ndarray:
    """Index of the first row of each run of equal values (null equals null)."""
    new = np.zeros(len(table), bool)
    new[:1] = True
    for c in by:
        code = np.asarray(table.column(c).combine_chunks().dictionary_encode("encode").indices)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def _whole_groups(batches: Iterator[pa.RecordBatch], by: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups and the groups' first rows, from rows sorted by
    the group; the last group of a batch waits for the next one."""
    open_ = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if open_ is None else pa.concat_tables([open_, table]).combine_chunks()
        starts = _starts(table, by)
        if starts[-1]:
            yield table.slice(0, starts[-1]), starts[:-1]
        open_ = table.slice(starts[-1])
    if open_ is not None:
        yield open_, np.zeros(1, int)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return np.asarray(table.column(name).combine_chunks().cast(pa.float64()).fill_null(np.nan), float)


def _locals(x: np.ndarray, starts: np.ndarray, alpha: float):
    """:func:`_local` of many groups: first (one for each group), smoothed
    values and shares (one for each row)."""
    size = np.diff(np.append(starts, len(x)))
    first, y, kept = np.full(len(size), -1), np.full(len(x), np.nan), np.ones(len(x))
    for g in np.flatnonzero(size > LONG_ROWS):
        rows = slice(starts[g], starts[g] + size[g])
        first[g], y[rows], kept[rows] = _local(x[rows], alpha)
    short = np.flatnonzero(size <= LONG_ROWS)
    order = short[np.argsort(-size[short], kind="stable")]
    at, most = starts[order], size[order]
    now, weight, share, begin = np.full(len(order), np.nan), np.ones(len(order)), np.ones(len(order)), np.full(len(order), -1)
    for i in range(int(most.max(initial=0))):
        m = int(np.searchsorted(-most, -i, side="left"))  # groups of more than i rows
        rows = at[:m] + i
        v, w, f = x[rows], now[:m], weight[:m]
        there, begun = ~np.isnan(v), ~np.isnan(w)
        f *= 1.0 - alpha
        moved, new = there & begun, there & ~begun
        w[:] = np.where(moved & (w != v), (f * w + alpha * v) / (f + alpha), np.where(new, v, w))
        share[:m][moved] *= (f / (f + alpha))[moved]
        f[there] = 1.0
        begin[:m][new] = i
        y[rows], kept[rows] = w, share[:m]
    first[order] = begin
    return first, y, kept


def smoothed(df: DataFrame, keys: str | Sequence[str] | None, t: str, specs: Sequence[Smooth], block: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with a column for each smoothing; ``t`` is the dense row position
    inside a series (:func:`tsq.operators.index.series_index`).

    Blocks and series are read as sorted rows, many of them in each Arrow batch:
    a task holds a batch and one unfinished block, whatever the number of series."""
    keys = _keys(keys)
    ids = [f"_k{i}" for i in range(len(keys))]
    taken = list(dict.fromkeys([s.x for s in specs] + [s.init for s in specs if s.init]))
    cols = {c: f"_x{i}" for i, c in enumerate(taken)}
    d = df.select(*[F.col(k).alias(n) for k, n in zip(keys, ids)], F.lit(0).alias("_g"), F.col(t).cast("long").alias("_t"),
                  F.floor(F.col(t) / F.lit(block)).cast("long").alias("_b"), *[F.col(c).cast("double").alias(n) for c, n in cols.items()])
    group = [*ids, "_g"]
    id_fields = [T.StructField(n, df.schema[k].dataType) for k, n in zip(keys, ids)] + [T.StructField("_g", T.IntegerType())]
    block_fields = [*id_fields, T.StructField("_b", T.LongType())]
    n_specs = range(len(specs))
    order = [*group, F.col("_b").asc_nulls_last()]

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole_groups(batches, [*group, "_b"]):
            ends = np.append(starts[1:], len(table))
            out = {c: table.column(c).take(starts) for c in [*group, "_b"]} | {"n": ends - starts}
            for i, s in enumerate(specs):
                x = _numbers(table, cols[s.x])
                first, y, kept = _locals(x, starts, s.alpha)
                there = np.maximum.accumulate(np.where(np.isnan(x), -1, np.arange(len(x))))  # the last value's row
                out |= {f"first{i}": first, f"x{i}": np.where(first < 0, np.nan, x[starts + np.maximum(first, 0)]),
                        f"kept{i}": np.where(first < 0, 0.0, kept[ends - 1]), f"y{i}": y[ends - 1],
                        f"age{i}": np.where(first < 0, ends - starts, ends - 1 - there[ends - 1]),
                        f"init{i}": _numbers(table, cols[s.init])[starts] if s.init else np.full(len(starts), np.nan)}
            yield from pa.table(out).combine_chunks().to_batches()

    sum_schema = T.StructType([*block_fields, T.StructField("n", T.LongType()),
                               *[T.StructField(f"{name}{i}", kind) for i in n_specs for name, kind in (
                                   ("first", T.LongType()), ("x", T.DoubleType()), ("kept", T.DoubleType()), ("y", T.DoubleType()),
                                   ("age", T.LongType()), ("init", T.DoubleType()))]])
    blocks = d.repartition(*group, "_b").sortWithinPartitions(*order, "_t").mapInArrow(summary, sum_schema)

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, whose = [], None  # of the series that the last batch ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            begins = set(_starts(table, group).tolist())
            here = [table.column(c)[0] for c in group]
            if whose is not None and all(a.equals(b) for a, b in zip(here, whose)):
                begins.discard(0)
            out = {c: table.column(c) for c in [*group, "_b"]}
            rows = list(zip(*(table.column(f"{name}{i}").to_pylist() for i in n_specs for name in ("first", "x", "kept", "y", "age", "init"))))
            sizes, found = table.column("n").to_pylist(), []
            for k, (n, row) in enumerate(zip(sizes, rows)):
                if k in begins:
                    states = [(row[6 * i + 5], 0) for i in n_specs]
                found.append(states)
                after = []
                for i, s in enumerate(specs):
                    (y, age), (first, x, kept, end, left, _) = states[i], row[6 * i:6 * i + 6]
                    after.append((y, age + n) if first < 0 else (end + kept * (_enter(y, age, first, x, s.alpha) - x), left))
                states = after
            whose = [table.column(c)[-1] for c in group]
            for i in n_specs:
                out |= {f"in{i}": pa.array([f[i][0] for f in found], pa.float64()), f"since{i}": pa.array([f[i][1] for f in found], pa.int64())}
            yield from pa.table(out).combine_chunks().to_batches()

    in_fields = [T.StructField(f"{name}{i}", kind) for i in n_specs for name, kind in (("in", T.DoubleType()), ("since", T.LongType()))]
    incoming = blocks.repartition(*group).sortWithinPartitions(*order).mapInArrow(carry, T.StructType([*block_fields, *in_fields]))
    # a block's state comes as a row before its own
    whole = (d.withColumn("_own", F.lit(True)).unionByName(incoming.withColumn("_own", F.lit(False)), allowMissingColumns=True)
             .repartition(*group, "_b").sortWithinPartitions(*order, "_own", "_t"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, heads in _whole_groups(batches, [*group, "_b"]):
            own = np.ones(len(table), bool)
            own[heads] = False
            rows = table.filter(pa.array(own))
            starts = heads - np.arange(len(heads))  # among the blocks' own rows
            out = {c: rows.column(c) for c in [*ids, "_t"]}
            size = np.diff(np.append(starts, len(rows)))
            place = np.arange(len(rows)) - np.repeat(starts, size)
            for i, s in enumerate(specs):
                x = _numbers(rows, cols[s.x])
                before, age = _numbers(table, f"in{i}")[heads], _numbers(table, f"since{i}")[heads]
                first, y, kept = _locals(x, starts, s.alpha)
                begin = x[starts + np.maximum(first, 0)]
                with np.errstate(invalid="ignore"):  # an infinite value
                    w = (1.0 - s.alpha) ** (age + first + 1)
                    moved = np.where(np.isnan(before), begin, (w * before + s.alpha * begin) / (w + s.alpha)) - begin
                    y = y + kept * np.repeat(moved, size)
                none = place < np.repeat(np.where(first < 0, size, first), size)
                y = np.where(none, np.repeat(before, size), y)
                out[f"_y{i}"] = pa.array(y, pa.float64(), from_pandas=True)
            yield from pa.table(out).combine_chunks().to_batches()

    end_schema = T.StructType([*id_fields[:-1], T.StructField("_t", T.LongType()), *[T.StructField(f"_y{i}", T.DoubleType()) for i in n_specs]])
    done = whole.mapInArrow(finish, end_schema)
    done = done.select(*ids, "_t", *[F.col(f"_y{i}").alias(s.out) for i, s in enumerate(specs)])
    cond = df[t] == F.col("_t")
    for k, n in zip(keys, ids):
        cond = cond & df[k].eqNullSafe(F.col(n))
    return df.join(done.hint("merge"), cond, "left").drop(*ids, "_t")


def convergence(df: DataFrame, keys: str | Sequence[str] | None, t: str, x: str, fast: float, slow: float, signal: float,
                filled: str = "_filled", block: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with ``macd`` (the fast less the slow smoothing of ``x``, given
    by their weights), ``macd_signal`` (its smoothing) and ``filled`` (``x``
    carried forward), all in one pass over the blocks.

    A block is affine in what comes in: the two smoothings, their difference's
    smoothing, the last value and the rows since.  Its summary holds its own
    end values and the responses of the signal's end to each of these; one walk
    along a series' summaries gives every block its incoming state, and the
    rows are finished where their block lies, with all columns of ``df``."""
    keys = _keys(keys)
    d = df.withColumns({"_b": F.floor(F.col(t) / F.lit(block)).cast("long"), "_g": F.lit(0), "_x": F.col(x).cast("double")})
    id_fields, own = [df.schema[k] for k in keys], list(df.columns)

    def answer(v: np.ndarray) -> np.ndarray:
        """The signal of ``v`` from 0."""
        return pd.Series(np.append(0.0, v)).ewm(alpha=signal, adjust=False).mean().to_numpy()[1:]

    def summary(table: pa.Table) -> pa.Table:
        table = table.sort_by(t)
        v = np.asarray(table.column("_x").combine_chunks().fill_null(np.nan), float)
        n = len(v)
        first, f, keep_f = _local(v, fast)
        _, s, keep_s = _local(v, slow)
        if first < 0:
            ends, last = [np.nan] * 9, n
        else:
            at = np.arange(n) >= first
            here = lambda a: np.where(at, a, 0.0)
            apart = here(np.nan_to_num(f - s))
            begun = pd.Series((f - s)[first:]).ewm(alpha=signal, adjust=False).mean().to_numpy()[-1]
            last = int(np.flatnonzero(~np.isnan(v))[-1])
            ends = [v[first], v[last], f[-1], keep_f[-1], s[-1], keep_s[-1], begun, answer(apart)[-1], answer((~at).astype(float))[-1]]
            ends += [answer(here(keep_f))[-1], answer(here(keep_s))[-1]]
        ends += [np.nan] * (len(_ENDS) - len(ends))
        cols = {k: table.column(k)[:1] for k in [*keys, "_b"]}
        return pa.table(cols | {"n": pa.array([n], pa.int64()), "first": pa.array([first], pa.int64()), "age": pa.array([n - 1 - last if first >= 0 else n], pa.int64()),
                                "ends": pa.array([ends], pa.list_(pa.float64()))})

    b_field = T.StructField("_b", T.LongType())
    summed = T.StructType([*id_fields, b_field, *[T.StructField(c, T.LongType()) for c in ("n", "first", "age")], T.StructField("ends", T.ArrayType(T.DoubleType()))])
    blocks = d.select(*keys, "_g", "_b", F.col(t), "_x").groupBy(*keys, "_g", "_b").applyInArrow(summary, summed)

    def carry(table: pa.Table) -> pa.Table:
        table = table.sort_by("_b")
        state, age, out = [np.nan] * 4, 0, []  # fast, slow, signal, last value
        for n, first, left, ends in zip(*(table.column(c).to_pylist() for c in ("n", "first", "age", "ends"))):
            out.append([*state, float(age)])
            f, s, g, _ = state
            fade = (1.0 - signal) ** n
            if first < 0:
                if not np.isnan(f):
                    state[2] = fade * g + (1.0 - fade) * (f - s)
                age += n
                continue
            e = dict(zip(_ENDS, ends))
            if np.isnan(f):
                state = [e["fast"], e["slow"], e["begun"], e["last"]]
            else:
                up = _enter(f, age, first, e["x"], fast) - e["x"]
                down = _enter(s, age, first, e["x"], slow) - e["x"]
                state = [e["fast"] + e["keep_fast"] * up, e["slow"] + e["keep_slow"] * down,
                         fade * g + e["own"] + e["before"] * (f - s) + e["to_fast"] * up - e["to_slow"] * down, e["last"]]
            age = left
        return pa.table({k: table.column(k) for k in [*keys, "_b"]} | {"_in": pa.array(out, pa.list_(pa.float64()))})

    entering = T.StructType([*id_fields, b_field, T.StructField("_in", T.ArrayType(T.DoubleType()))])
    incoming = blocks.withColumn("_g", F.lit(0)).groupBy(*keys, "_g").applyInArrow(carry, entering)
    incoming = incoming.withColumnsRenamed({k: f"_in_{k}" for k in [*keys, "_b"]})
    cond = F.col("_b") == F.col("_in__b")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_in_{k}"))
    whole = d.join(incoming, cond, "left").drop(*[f"_in_{k}" for k in [*keys, "_b"]])

    def finish(table: pa.Table) -> pa.Table:
        table = table.sort_by(t)
        v = np.asarray(table.column("_x").combine_chunks().fill_null(np.nan), float)
        f, s, g, last, age = table.column("_in")[0].as_py()
        first, y_f, keep_f = _local(v, fast)
        _, y_s, keep_s = _local(v, slow)
        if first < 0:
            y_f, y_s = np.full(len(v), f), np.full(len(v), s)
        else:
            y_f = y_f + keep_f * (_enter(f, int(age), first, v[first], fast) - v[first])
            y_s = y_s + keep_s * (_enter(s, int(age), first, v[first], slow) - v[first])
            y_f[:first], y_s[:first] = f, s
        macd = y_f - y_s
        line = pd.Series(np.append(g, macd)).ewm(alpha=signal, adjust=False).mean().to_numpy()[1:]
        known = pd.Series(np.append(last, v)).ffill().to_numpy()[1:]
        out = table.select(own)
        for name, a in ((filled, known), ("macd", macd), ("macd_signal", line)):
            out = out.append_column(name, pa.array(a, pa.float64(), from_pandas=True))
        return out

    done = T.StructType([*df.schema.fields, *[T.StructField(c, T.DoubleType()) for c in (filled, "macd", "macd_signal")]])
    return whole.groupBy(*keys, "_g", "_b").applyInArrow(finish, done)


#: What a block's summary holds besides its counts.
_ENDS = ["x", "last", "fast", "keep_fast", "slow", "keep_slow", "begun", "own", "before", "to_fast", "to_slow"]

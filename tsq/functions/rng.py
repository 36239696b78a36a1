"""Deterministic random numbers from a hash of the row's key.

u = (first 32 bits of md5(key parts joined by '|') + 0.5) / 2^32 lies in
(0, 1) and depends only on the key, never on partitioning or task retries,
so a lost executor recomputes the same numbers and DuckDB can reproduce
them: ('0x' || substr(md5(s), 1, 8))::UBIGINT.  Normals by Box-Muller.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296.0


def _key(*parts) -> Column:
    return F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else F.lit(p) if not isinstance(p, Column) else p).cast("string")
                              for p in parts])


def uniform(*parts) -> Column:
    h = F.conv(F.substring(F.md5(_key(*parts)), 1, 8), 16, 10).cast("double")
    return (h + F.lit(0.5)) / F.lit(TWO32)


def normal(*parts, mean: float = 0.0, sd: float = 1.0) -> Column:
    u1 = uniform(*parts, F.lit("n1"))
    u2 = uniform(*parts, F.lit("n2"))
    z = F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
    return F.lit(mean) + F.lit(sd) * z


def sql_uniform(*parts: str) -> str:
    """DuckDB twin of :func:`uniform` (parts are SQL expressions)."""
    key = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return (f"((CAST(CAST(('0x' || substr(md5({key}), 1, 8)) AS UBIGINT) AS DOUBLE) + CAST(0.5 AS DOUBLE))"
            f" / CAST({TWO32!r} AS DOUBLE))")


def sql_normal(*parts: str, mean: float = 0.0, sd: float = 1.0) -> str:
    u1 = sql_uniform(*parts, "'n1'")
    u2 = sql_uniform(*parts, "'n2'")
    z = f"(sqrt(CAST(-2.0 AS DOUBLE) * ln({u1})) * cos(CAST('{2.0 * math.pi!r}' AS DOUBLE) * {u2}))"
    return f"(CAST('{float(mean)!r}' AS DOUBLE) + CAST('{float(sd)!r}' AS DOUBLE) * {z})"

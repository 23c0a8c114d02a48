"""Repeatable random draws from md5 of a key.

A draw depends only on ``(seed, row key, tag)``, never on row order or
partitioning, so retries, repartitioning and executor loss give the same
values, and DuckDB can compute the same numbers.

    u = (int(first 8 hex digits of md5(key)) + 0.5) / 2^32      in (0, 1)
    z = sqrt(-2 ln u_a) * cos(2 pi u_b)                         (Box-Muller)
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = float(2 ** 32)


def key(parts: Sequence) -> Column:
    """``a|b|c`` from literals (str / int) and Columns."""
    items = []
    for i, p in enumerate(parts):
        if i:
            items.append(F.lit("|"))
        items.append(p.cast("string") if isinstance(p, Column) else F.lit(str(p)))
    return F.concat(*items)


def hash32(parts: Sequence) -> Column:
    return F.conv(F.substring(F.md5(key(parts)), 1, 8), 16, 10).cast("bigint")


def hash60(parts: Sequence) -> Column:
    """60-bit ordering key (15 hex digits fit a BIGINT)."""
    return F.conv(F.substring(F.md5(key(parts)), 1, 15), 16, 10).cast("bigint")


def uniform(parts: Sequence) -> Column:
    return (hash32(parts).cast("double") + F.lit(0.5)) / F.lit(TWO32)


def gaussian(parts: Sequence) -> Column:
    u1 = uniform(list(parts) + ["a"])
    u2 = uniform(list(parts) + ["b"])
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def py_rank_key(parts: Sequence) -> str:
    """Plan-time ordering key for metadata (column names), same md5 rule."""
    return hashlib.md5("|".join(str(p) for p in parts).encode()).hexdigest()


def py_uniform(parts: Sequence) -> float:
    """``uniform`` of plain values."""
    return (int(py_rank_key(parts)[:8], 16) + 0.5) / TWO32


# ---------------------------------------------------------------- SQL twins

def sql_key(parts: Sequence, cols: set[str]) -> str:
    items = []
    for i, p in enumerate(parts):
        if i:
            items.append("'|'")
        items.append(f"CAST({p} AS VARCHAR)" if p in cols else f"'{p}'")
    return f"concat({', '.join(items)})"


def sql_uniform(parts: Sequence, cols: set[str]) -> str:
    return f"((CAST(('0x' || substr(md5({sql_key(parts, cols)}), 1, 8)) AS BIGINT) + 0.5) / {TWO32!r})"


def sql_gaussian(parts: Sequence, cols: set[str]) -> str:
    u1 = sql_uniform(list(parts) + ["a"], cols)
    u2 = sql_uniform(list(parts) + ["b"], cols)
    return f"(sqrt(-2.0 * ln({u1})) * cos({2.0 * math.pi!r} * {u2}))"


def sql_hash60(parts: Sequence, cols: set[str]) -> str:
    return f"CAST(('0x' || substr(md5({sql_key(parts, cols)}), 1, 15)) AS BIGINT)"

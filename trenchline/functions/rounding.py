"""Rounding that matches the report's number formatting, as JVM expressions.

The reports round a double to one decimal the way Python's ``round(x, 1)``
does (half-even on the *exact binary value*), and later print it with
``'%.0f'`` (half-even again).  Spark's ``round`` is half-up and ``bround``
works on the shortest decimal form, so each disagrees on some values
(2.25 -> 2.2 in Python, 2.3 with ``round``; 2.45 -> 2.5 in Python, 2.4 with
``bround``).

``py_round1`` reproduces Python exactly with plain double arithmetic:
10*x is formed exactly as s + e (s = 8x + 2x rounded, e its error by the
two-sum identity), so the tie test sees the exact product.  No UDF; the same
arithmetic is emitted as SQL text for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def py_round1(x: Column) -> Column:
    a = F.abs(x)
    p = a * F.lit(8.0)
    q = a * F.lit(2.0)
    s = p + q
    bv = s - p
    e = (p - (s - bv)) + (q - bv)
    f = F.floor(s)
    d = s - f
    half = F.lit(0.5)
    up = (d > half) | ((d == half) & ((e > 0) | ((e == 0) & (f % 2 == 1))))
    r = (f + F.when(up, F.lit(1)).otherwise(F.lit(0))) / F.lit(10.0)
    return F.when(x.isNull(), F.lit(None).cast("double")).when(x < 0, -r).otherwise(r)


def py_format0(x: Column) -> Column:
    """Text of ``'%.0f' % x`` for finite x (half-even, exact for 1-decimal inputs)."""
    return F.bround(x, 0).cast("bigint").cast("string")


def py_round1_sql(x: str) -> str:
    """The same computation as SQL text (DuckDB / Spark SQL)."""
    a = f"abs({x})"
    p = f"({a} * 8e0)"
    q = f"({a} * 2e0)"
    s = f"({p} + {q})"
    bv = f"({s} - {p})"
    e = f"(({p} - ({s} - {bv})) + ({q} - {bv}))"
    f_ = f"floor({s})"
    d = f"({s} - {f_})"
    up = f"(({d} > 0.5e0) or ({d} = 0.5e0 and ({e} > 0 or ({e} = 0 and {f_} % 2 = 1))))"
    r = f"(({f_} + case when {up} then 1 else 0 end) / 10e0)"
    return f"(case when {x} is null then null when {x} < 0 then -{r} else {r} end)"

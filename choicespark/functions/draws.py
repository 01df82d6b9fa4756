"""Keyed, partition-independent random draws.

A draw is a pure function of (seed, stream name, row key): the first 32 bits
of ``md5(seed|stream|key)`` scaled to [0, 1).  Unlike ``rand(seed)`` the value
does not depend on how rows are partitioned, so a job recomputed after an
executor loss, or run at a different parallelism, draws the same numbers.

Each helper has a Spark ``Column`` form and a SQL-text form; the SQL form is
used to write the DuckDB oracle queries with the same arithmetic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _key(key: str | Column) -> Column:
    return (F.col(key) if isinstance(key, str) else key).cast("string")


def hash32(seed: int, stream: str, key: str | Column) -> Column:
    """Unsigned 32-bit integer from the keyed md5 (as bigint)."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(stream), _key(key)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def uniform(seed: int, stream: str, key: str | Column) -> Column:
    """u in [0, 1)."""
    if isinstance(key, str):  # one SQL expression: a single JVM call when building large plans
        return F.expr(f"CAST(conv(substring(md5(concat_ws('|', '{seed}', '{stream}', CAST(`{key}` AS STRING))), 1, 8),"
                      f" 16, 10) AS BIGINT) / {TWO_32!r}D")
    return hash32(seed, stream, key) / F.lit(TWO_32)


def int_draw(seed: int, stream: str, key: str | Column, lo: int, hi_exclusive: int) -> Column:
    """Integer in [lo, hi_exclusive) (``randint`` convention)."""
    width = hi_exclusive - lo
    return (F.floor(uniform(seed, stream, key) * F.lit(float(width))) + F.lit(lo)).cast("int")


def real_draw(seed: int, stream: str, key: str | Column, lo: float, hi: float) -> Column:
    return F.lit(lo) + uniform(seed, stream, key) * F.lit(hi - lo)


def bool_draw(seed: int, stream: str, key: str | Column, p: float) -> Column:
    return uniform(seed, stream, key) < F.lit(p)


def gumbel(seed: int, stream: str, key: str | Column, scale: float = 1.0) -> Column:
    """Gumbel(0, scale) by inversion; the +0.5 keeps the argument inside (0, 1)."""
    p = (hash32(seed, stream, key) + F.lit(0.5)) / F.lit(TWO_32)
    return F.lit(-scale) * F.ln(-F.ln(p))


def cumulative(weights: Sequence[float]) -> list[float]:
    out, acc = [], 0.0
    for w in weights:
        acc += w
        out.append(acc)
    return out


def weighted_choice(u: Column, options: Sequence[tuple[object, float]]) -> Column:
    """First option whose cumulative weight exceeds u; the last option is the fallback."""
    cum = cumulative([w for _, w in options])
    expr = None
    for (value, _), c in zip(options[:-1], cum[:-1]):
        expr = F.when(u < F.lit(c), F.lit(value)) if expr is None else expr.when(u < F.lit(c), F.lit(value))
    last = F.lit(options[-1][0])
    return last if expr is None else expr.otherwise(last)


def pick(u: Column, values: Sequence[str]) -> Column:
    """Uniform pick from a fixed list."""
    arr = F.array(*[F.lit(v) for v in values])
    return F.element_at(arr, (F.floor(u * F.lit(float(len(values)))) + 1).cast("int"))


# ---------------------------------------------------------------- SQL text forms


def dbl(x: float) -> str:
    """A double literal parsed from its shortest round-trip text (no DECIMAL detour)."""
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def sql_hash32(seed: int, stream: str, key_sql: str) -> str:
    return (
        f"CAST(('0x' || substr(md5(concat_ws('|', '{seed}', '{stream}', CAST({key_sql} AS VARCHAR))), 1, 8)) AS BIGINT)"
    )


def sql_uniform(seed: int, stream: str, key_sql: str) -> str:
    return f"({sql_hash32(seed, stream, key_sql)} / {dbl(TWO_32)})"


def sql_int_draw(seed: int, stream: str, key_sql: str, lo: int, hi_exclusive: int) -> str:
    return f"CAST(floor({sql_uniform(seed, stream, key_sql)} * {dbl(hi_exclusive - lo)}) + {lo} AS INTEGER)"


def sql_real_draw(seed: int, stream: str, key_sql: str, lo: float, hi: float) -> str:
    return f"({dbl(lo)} + {sql_uniform(seed, stream, key_sql)} * {dbl(hi - lo)})"


def sql_bool_draw(seed: int, stream: str, key_sql: str, p: float) -> str:
    return f"({sql_uniform(seed, stream, key_sql)} < {dbl(p)})"


def sql_gumbel(seed: int, stream: str, key_sql: str, scale: float = 1.0) -> str:
    p = f"(({sql_hash32(seed, stream, key_sql)} + {dbl(0.5)}) / {dbl(TWO_32)})"
    return f"({dbl(-scale)} * ln(-ln({p})))"


def sql_weighted_choice(u_sql: str, options: Sequence[tuple[object, float]]) -> str:
    cum = cumulative([w for _, w in options])
    parts = ["CASE"]
    for (value, _), c in zip(options[:-1], cum[:-1]):
        parts.append(f"WHEN {u_sql} < {dbl(c)} THEN {_sql_lit(value)}")
    parts.append(f"ELSE {_sql_lit(options[-1][0])} END")
    return " ".join(parts)


def sql_pick(u_sql: str, values: Sequence[str]) -> str:
    arr = "[" + ", ".join(_sql_lit(v) for v in values) + "]"
    return f"({arr})[CAST(floor({u_sql} * {dbl(len(values))}) AS INTEGER) + 1]"


def _sql_lit(v: object) -> str:
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(v)

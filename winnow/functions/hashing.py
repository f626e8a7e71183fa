"""Deterministic, engine-independent random draws.

A random draw is "order by md5(seed:salt:id)": exact size, reproducible,
independent of partitioning, and spelled the same way in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw_key(seed, salt: str, *parts) -> Column:
    """md5 hex of 'seed:salt:part1:part2...' (parts are columns)."""
    cols = [F.lit(str(seed)), F.lit(salt)] + [F.col(p).cast("string") if isinstance(p, str)
                                                else p.cast("string") for p in parts]
    return F.md5(F.concat_ws(":", *cols))


def sql_draw_key(seed, salt: str, *parts: str) -> str:
    inner = " || ':' || ".join([f"'{seed}'", f"'{salt}'"] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"md5({inner})"


def sql_sign_bit(seed, salt: str, i: str, j: str) -> str:
    """+1.0 / -1.0 from bit j % 128 of md5(seed:salt:i:(j // 128)), first bit first."""
    digit = f"substr({sql_draw_key(seed, salt, i, f'({j} // 128)')}, CAST({j} % 128 // 4 + 1 AS BIGINT), 1)"
    value = f"(instr('0123456789abcdef', {digit}) - 1)"
    return f"(CASE WHEN ({value} >> CAST(3 - {j} % 4 AS INTEGER)) & 1 = 0 THEN 1.0 ELSE -1.0 END)"

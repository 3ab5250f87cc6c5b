"""Where queries register under a name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, *parts: str):
    """Register a function (spark, sf_dir) -> DataFrame; ``parts`` are common table expressions and the final SELECT."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if parts:
            *tables, last = parts
            ORACLE_SQL[name] = untied((f"WITH {', '.join(tables)} " if tables else "") + last)
        return f

    return add


def rounded(df, *names: str, places: int = 6):
    """Doubles brought to the nearest multiple of 2^-20 (6 places), so that the order of sums doesn't show in a comparison
    of values; another number of places rounds decimally."""
    from pyspark.sql import functions as F

    from ..functions.scalar import grid

    return df.withColumns({n: grid(F.col(n)) if places == 6 else F.round(n, places) for n in (names or [n for n, t in df.dtypes if t == "double"])})


def untied(sql: str) -> str:
    """The same for every round(x, 6) of an SQL text."""
    at = 0
    while (at := sql.find("round(", at)) >= 0:
        depth, end = 1, at + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        body = sql[at + 6 : end - 1]
        if body.endswith(", 6"):
            new = f"(round_even(({body[:-3]}) * 1048576.0::DOUBLE, 0) / 1048576.0::DOUBLE + 0.0::DOUBLE)"
            sql, at = sql[:at] + new + sql[end:], at + 1
        at += 6
    return sql

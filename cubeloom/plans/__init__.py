"""Plan helpers: how keys are derived so that joins stay equi-joins."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries of a dimension table up to which it travels as a literal array or broadcast.
LITERAL_ENTRIES = 20_000


def lookup(df: DataFrame, key: str | list[str], table: DataFrame, entries: int, how: str = "inner") -> DataFrame:
    """Join a table of known size on a key or keys: broadcast while it is small, else left to the planner."""
    return df.join(F.broadcast(table) if entries <= LITERAL_ENTRIES else table, key, how)


def literal_array(values: list, kind: str = "") -> Column:
    """A constant array parsed in one call, however long; ``kind`` casts its elements."""

    def text(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, dt.datetime):
            return f"TIMESTAMP'{v.isoformat(sep=' ')}'"
        if isinstance(v, dt.date):
            return f"DATE'{v.isoformat()}'"
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return f"{v!r}D" if isinstance(v, float) else str(v)

    if not all(v is None or type(v) in (int, float, str, dt.date, dt.datetime) for v in values):
        return F.array(*[F.lit(v) for v in values])
    out = F.expr(f"array({', '.join(map(text, values))})")
    return out.cast(f"array<{kind}>") if kind else out


def interval_of(value: Column, breaks: list, left_open: bool = False) -> Column:
    """1-based interval of sorted breaks that holds a value, [a, b) by default, null outside: no range join.

    Two-level search over literal breaks keeps the expression small for many breaks.
    """
    literal = literal_array(breaks)
    below = F.size(F.filter(literal, (lambda b: b < value) if left_open else (lambda b: b <= value)))
    return F.when((below >= 1) & (below < len(breaks)), below)


def scan_report(df: DataFrame) -> dict:
    """What a plan does with its scan: pushed filters, read schema, exchanges."""
    text = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pick = lambda k: [x.split(":", 1)[1].strip() for x in text.splitlines() if x.startswith(k)]
    return {"pushed": pick("PushedFilters"), "read": pick("ReadSchema"), "exchanges": text.count("Arguments: hashpartitioning(")}

"""EXPLAIN: a plan as rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def explain(df: DataFrame) -> DataFrame:
    """step, depth, type, detail of the physical plan, outermost first."""
    rows = []
    for i, line in enumerate(df._jdf.queryExecution().executedPlan().toString().splitlines()):
        m = re.match(r"^([ :|+\-*()0-9]*)(\w+)\s*(.*)$", line)
        if m:
            rows.append((i, len(m[1]) // 3, m[2], m[3][:400]))
    return df.sparkSession.createDataFrame(rows, "step int, depth int, type string, detail string")


def exchanges(df: DataFrame) -> int:
    """How many shuffles the plan has before adaptive changes."""
    return len(re.findall(r"\bExchange (?:hash|range|Single|RoundRobin)", df._jdf.queryExecution().executedPlan().toString()))

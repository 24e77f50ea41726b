"""Guarded ad-hoc SQL over an audit's views, and their description."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

READING = ("select", "with", "explain", "values", "describe")
DEFAULT_ROWS, MOST_ROWS = 200, 5000


def first_keyword(sql: str) -> str:
    """The first word after white space and comments, in lower case."""
    rest = re.sub(r"\A(?:\s+|--[^\n]*(?:\n|\Z)|/\*.*?\*/)+", "", sql, flags=re.DOTALL)
    return re.match(r"[^\s(]*", rest)[0].lower()


def guard(sql: str) -> str:
    """The statement, if it is a single one that only reads."""
    body = sql.strip().rstrip("; \t\r\n")
    if ";" in body:
        raise ValueError("only a single statement is allowed")
    if first_keyword(body) not in READING:
        raise ValueError("only statements that read are allowed")
    return body


def query(spark: SparkSession, sql: str, max_rows: int = DEFAULT_ROWS) -> dict:
    """columns, rows, row_count and whether rows were left out, as the tool returns them; at most 5000 rows."""
    most = min(max(1, max_rows), MOST_ROWS)
    df: DataFrame = spark.sql(guard(sql))
    rows = df.limit(most + 1).collect()
    return {"columns": df.columns, "rows": [list(r) for r in rows[:most]], "row_count": min(len(rows), most), "truncated": len(rows) > most}


def register(views: dict[str, DataFrame]) -> None:
    for name, df in views.items():
        df.createOrReplaceTempView(name)


def describe(spark: SparkSession, names: list[str]) -> dict[str, list[tuple[str, str]]]:
    return {n: [(f.name, f.dataType.simpleString()) for f in spark.table(n).schema] for n in names}

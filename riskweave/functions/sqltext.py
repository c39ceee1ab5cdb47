"""Small helpers around SQL texts. Catalyst parses and types queries; these only look things up."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def tables_of(sql: str) -> dict[str, str]:
    """Alias to table of what follows FROM and JOIN (a table without alias is its own)."""
    words = {"on", "where", "left", "right", "inner", "full", "join", "group", "order", "limit", "union", "cross", "lateral", "having"}
    sql, found = re.sub(r"'(?:[^'\\]|\\.|'')*'", "''", sql), {}
    for table, alias in re.findall(r"\b(?:from|join)\s+([\w.`]+)(?:\s+(?:as\s+)?(\w+))?", sql, flags=re.IGNORECASE):
        found[alias if alias and alias.lower() not in words else table] = table
    return found


def column_types(spark: SparkSession, sql: str) -> dict[str, dict[str, str]]:
    """Alias to the columns and types of its table, from the catalog."""
    return {a: dict(spark.table(t).dtypes) for a, t in tables_of(sql).items()}


def cast_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Columns cast without failing: what does not parse is null."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS {t})") for c, t in types.items()})


def format_sql(sql: str) -> str:
    """One clause a line, blanks collapsed, keywords in capitals (texts in quotes stay)."""
    parts = re.split(r"('(?:[^'\\]|\\.|'')*')", sql)
    for i in range(0, len(parts), 2):
        x = re.sub(r"\s+", " ", parts[i])
        x = re.sub(r"\b(select|from|where|group by|order by|having|limit|union all|union|left join|inner join|right join|full join|join|on|and|or|as|case|when|then|else|end|desc|asc|is|not|null|in|between|like)\b", lambda m: m[0].upper(), x, flags=re.IGNORECASE)
        parts[i] = re.sub(r" ?\b(FROM|WHERE|GROUP BY|ORDER BY|HAVING|LIMIT|UNION ALL|UNION|(?:LEFT |INNER |RIGHT |FULL )?JOIN)\b", r"\n\1", x)
    return "".join(parts).strip()


def subqueries(sql: str) -> list[tuple[int, str]]:
    """(depth, text) of the subqueries in brackets after FROM or JOIN, deepest first."""
    found, stack = [], []
    for i, ch in enumerate(sql):
        if ch == "(":
            stack.append((i, bool(re.search(r"\b(from|join)\s*$", sql[:i], flags=re.IGNORECASE))))
        elif ch == ")" and stack:
            at, nested = stack.pop()
            if nested:
                found.append((1 + sum(s[1] for s in stack), sql[at + 1 : i].strip()))
    return sorted(found, key=lambda x: -x[0])

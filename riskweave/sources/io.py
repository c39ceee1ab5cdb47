"""Sources and sinks: tables, files, SQL engines, stage folders and reports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.core import coerce_numeric, null_nans

FORMATS = ("parquet", "orc", "csv", "json", "avro", "text")


def get_data(spark: SparkSession, src: DataFrame | str, **options) -> DataFrame:
    """A data frame as it is, or a file or folder by its ending (Parquet if none); NaN becomes null."""
    if isinstance(src, DataFrame):
        return null_nans(src)
    kind = next((k for k in FORMATS if src.rstrip("/").endswith(f".{k}")), "parquet")
    reader = spark.read.options(**options)
    return null_nans(reader.csv(src, header=True, inferSchema="schema" not in options) if kind == "csv" else reader.format(kind).load(src))


def execute(spark: SparkSession, sql: str, engine: str = "spark", columns: list[str] | None = None, partition_on: str | None = None, partitions: int = 32, bounds: tuple | None = None, predicates: list[str] | None = None, **jdbc) -> DataFrame:
    """Run SQL in Spark's catalog, or elsewhere by JDBC (``url`` and further options given by the
    caller, never by this library). Errors are raised.

    By JDBC the rows come in one task unless ``partition_on`` names a column of the result, a number,
    date or timestamp: they then come in ``partitions`` tasks by equal steps between ``bounds``, which
    are asked of the engine where not given. Bounds only place the steps: rows beyond them, and
    nulls, come too. ``predicates``, for columns of uneven or other kinds, are conditions that each
    hold for a task's rows; that every row meets exactly one of them is up to the caller. Names of
    columns are written, and quoted, as the engine wants them. Filters and choices of columns made
    on the result reach the engine in every form.
    """
    if engine == "spark":
        out = spark.sql(sql)
    elif engine == "jdbc":
        out = _by_jdbc(spark, sql, partition_on, partitions, bounds, predicates, jdbc)
    else:
        raise ValueError(f"unknown engine {engine!r}")
    return out.toDF(*columns) if columns else out


def _by_jdbc(spark: SparkSession, sql: str, on: str | None, partitions: int, bounds: tuple | None, predicates: list[str] | None, options: dict) -> DataFrame:
    if on and predicates:
        raise ValueError("rows are divided by a column or by predicates, not by both")
    source = f"({sql}) parted"
    if predicates:
        rest = {k: str(v) for k, v in options.items() if k != "url"}
        return spark.read.jdbc(options["url"], source, predicates=predicates, properties=rest)
    reader = spark.read.format("jdbc").options(**options)
    if not on:
        return reader.option("query", sql).load()
    if bounds is None:
        asked = spark.read.format("jdbc").options(**options).option("query", f"SELECT MIN({on}) AS lo, MAX({on}) AS hi FROM {source}").load()
        bounds = tuple(asked.first())
    if bounds[0] is None or bounds[0] == bounds[1]:  # no value, or one: no steps to take
        return reader.option("query", sql).load()
    return reader.options(dbtable=source, partitionColumn=on, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=partitions).load()


def download_table(spark: SparkSession, table: str, path: str, kind: str = "parquet", overwrite: bool = False, **options) -> str:
    """A table to files, column names without the table's prefix; existing files stay unless asked."""
    df = spark.table(table)
    df = coerce_numeric(df.toDF(*[c.split(".")[-1] for c in df.columns]))
    df.write.mode("overwrite" if overwrite else "ignore").options(**({"header": True} if kind == "csv" else {}) | options).format(kind).save(path)
    return path


def create_table(spark: SparkSession, src: DataFrame | str, table: str, overwrite: bool = False, kind: str = "parquet", **options) -> None:
    """Files or a data frame to a catalog table."""
    get_data(spark, src, **options).write.mode("overwrite" if overwrite else "errorifexists").format(kind).saveAsTable(table)


def ddl(df: DataFrame, table: str, decimals: bool = True) -> str:
    """``CREATE TABLE`` text: doubles as DECIMAL(20,12), whole numbers as BIGINT, the rest STRING."""
    def kind(t):
        if isinstance(t, (T.DoubleType, T.FloatType)):
            return "DECIMAL(20,12)" if decimals else "DOUBLE"
        return "BIGINT" if isinstance(t, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)) else "STRING"
    return f"CREATE TABLE IF NOT EXISTS {table} ({', '.join(f'`{f.name}` {kind(f.dataType)}' for f in df.schema)})"


def sandbox(scores: DataFrame, requests: DataFrame, model_id: str, task_id: str, day: str, key: str = "id") -> DataFrame:
    """Left join of the scores of one model and task, the conditions being part of the join, for the
    requests of one day, best score first."""
    on = (requests[key].cast("string") == scores[key].cast("string")) & (scores["model_id"] == model_id) & (scores["task_id"] == task_id)
    return requests.where(F.substring(F.col("ts").cast("string"), 1, 10) == day).join(scores, on, "left").select(requests["*"], scores["score"]).orderBy(F.col("score").desc_nulls_last(), key)


class StageFolder:
    """Layout of a stage's results: ``train/``, ``test/`` and ``report/`` under a folder."""

    def __init__(self, root: str, name: str):
        self.root, self.name = root.rstrip("/"), name

    def data(self, part: str) -> str:
        return f"{self.root}/{part}/{self.name}_result.parquet"

    @property
    def meta(self) -> str:
        return f"{self.root}/train/{self.name}_enc"

    def report(self, name: str) -> str:
        return f"{self.root}/report/{name}.json"

    def write(self, **parts: DataFrame | None) -> dict[str, str]:
        for k, df in parts.items():
            if df is not None:
                df.write.mode("overwrite").parquet(self.data(k))
        return {k: self.data(k) for k, df in parts.items() if df is not None}


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a row, nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def report_json(obj) -> str:
    """JSON text of small report values; NaN and infinities are null."""
    def clean(x):
        if isinstance(x, float) and (x != x or x in (float("inf"), float("-inf"))):
            return None
        if isinstance(x, dict):
            return {str(k): clean(v) for k, v in x.items()}
        return [clean(v) for v in x] if isinstance(x, (list, tuple, set)) else x
    return json.dumps(clean(obj), default=str, ensure_ascii=False)


def table_to_dicts(df: DataFrame, most: int = 100_000) -> list[dict]:
    """Rows of a report table as dictionaries; larger tables are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("not a report table")
    return [r.asDict(recursive=True) for r in rows]


def workbook(reports: dict[str, DataFrame], folder: str, most: int = 100_000) -> list[str]:
    """Report tables to one CSV each in a folder of the driver's, named by sheet; a workbook where a
    writer is installed. Tables of more than ``most`` rows are refused, as they are no reports."""
    import pandas as pd

    out = []
    frames = {k: pd.DataFrame(table_to_dicts(df, most), columns=df.columns) for k, df in reports.items()}
    Path(folder).mkdir(parents=True, exist_ok=True)
    for k, pdf in frames.items():
        pdf.to_csv(f"{folder}/{k}.csv", index=False)
        out.append(f"{folder}/{k}.csv")
    try:
        import openpyxl  # noqa: F401

        with pd.ExcelWriter(f"{folder}/reports.xlsx") as w:
            for k, pdf in frames.items():
                pdf.to_excel(w, sheet_name=k[:31], index=False)
        out.append(f"{folder}/reports.xlsx")
    except ImportError:
        pass
    return out

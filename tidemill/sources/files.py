"""Readers and sinks."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def column_names(schema_map: Mapping[int, str], n: int) -> list[str]:
    """The names of n positions; a position without a name is ``col_<position>``."""
    return [schema_map.get(i) or f"col_{i}" for i in range(n)]


def load_schema_map(path: str) -> dict[int, str]:
    """Position -> name from a JSON file, or a YAML one where a YAML parser is installed."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        import yaml

        data = yaml.safe_load(text)
    else:
        data = json.loads(text)
    columns = data.get("columns", data) if isinstance(data, dict) else data
    if isinstance(columns, dict):
        return {int(k): v["name"] if isinstance(v, dict) else v for k, v in columns.items()}
    return {int(c["position"]): c["name"] for c in columns}


def read_ragged(spark: SparkSession, path: str, names: Sequence[str], most_rows: int | None = None, line_breaks: bool = False) -> DataFrame:
    """A delimited export with a header: short rows are padded with '', long ones cut; undecodable bytes are replaced.

    A file is read in splits, a line a row. With ``line_breaks`` values may hold line breaks, and each
    file is one task.
    """
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = spark.read.csv(path, schema=schema, header=True, enforceSchema=True, quote='"', escape='"', multiLine=line_breaks,
                        mode="PERMISSIVE", encoding="UTF-8", nullValue="\x00", emptyValue="")
    df = df.select(*[F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names])
    return df.limit(most_rows) if most_rows is not None else df


def read_limits(spark: SparkSession, path: str) -> DataFrame:
    """The table of limits by code; codes are trimmed and upper-cased."""
    schema = "SERVICE_CODE string, SEUIL_VIGILANCE_UNITAIRE_MRU double, SEUIL_CUMUL_JOURNALIER_MRU double"
    df = spark.read.csv(path, schema=schema, header=True)
    return df.withColumn("SERVICE_CODE", F.upper(F.trim("SERVICE_CODE")))


def write_table(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    (df.write.mode("overwrite").partitionBy(*by) if by else df.write.mode("overwrite")).parquet(path)


def export_csv(df: DataFrame, path: str, columns: Mapping[str, str], one_file: bool = False) -> None:
    """Selected columns under new names as CSV with a header."""
    out = df.select(*[F.col(c).alias(n) for c, n in columns.items()])
    (out.coalesce(1) if one_file else out).write.mode("overwrite").csv(path, header=True)


def validate_export(spark: SparkSession, path: str, expected: Sequence[str]) -> dict:
    """Missing and extra columns and the number of rows of an export."""
    df = spark.read.csv(path, header=True)
    return {"missing": [c for c in expected if c not in df.columns], "extra": [c for c in df.columns if c not in expected],
            "rows": df.count(), "valid": list(df.columns) == list(expected)}


def write_report(report: Mapping, path: str) -> None:
    """A small report as JSON."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(report, f, indent=2, default=str, ensure_ascii=False)

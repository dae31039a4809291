"""Readers and writers by format, with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Options that make a format keep nulls, line breaks and time stamps as they are.
_MICROS = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"
_TIMES = {"timestampNTZFormat": _MICROS, "timestampFormat": _MICROS + "[XXX]"}
OPTIONS: dict[str, dict[str, str]] = {
    "csv": {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "nullValue": "\\N", **_TIMES},
    "json": {"ignoreNullFields": "false", **_TIMES},
    "xml": {"rowTag": "row", **_TIMES},
    "parquet": {},
    "orc": {},
    "text": {"lineSep": "\n"},
}


def write(df: DataFrame, kind: str, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    writer = df.write.format(kind).options(**_options(kind)).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def read(spark: SparkSession, kind: str, path: str, schema: StructType | str) -> DataFrame:
    """Always with a schema: inferring one reads the data twice."""
    return spark.read.format(kind).options(**_options(kind)).schema(schema).load(path)


def read_jdbc(spark: SparkSession, url: str, name: str, column: str, low: int, high: int, partitions: int, **options: str) -> DataFrame:
    """A database table in ``partitions`` ranges of a numeric column, read side by side. The driver class must be on the class path."""
    bounds = {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(partitions)}
    return spark.read.format("jdbc").options(url=url, dbtable=name, **bounds, **options).load()


def write_jdbc(df: DataFrame, url: str, name: str, partitions: int, mode: str = "errorifexists", **options: str) -> None:
    """``df`` into a database table, over ``partitions`` connections at most."""
    df.coalesce(partitions).write.format("jdbc").mode(mode).options(url=url, dbtable=name, **options).save()


def _options(kind: str) -> dict[str, str]:
    if kind not in OPTIONS:
        raise ValueError(f"format {kind!r} is not among {', '.join(sorted(OPTIONS))}")
    return OPTIONS[kind]

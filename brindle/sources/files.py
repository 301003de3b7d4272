"""Loads and exports as dialects name them, over Spark's readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

#: Reader of each file format; others go to Spark by their own name.
FORMATS = {"CSV": "csv", "TEXT": "text", "JSON": "json", "PARQUET": "parquet", "ORC": "orc", "XML": "xml", "AVRO": "avro"}


def options(**given) -> dict[str, str]:
    """Spark's options for COPY's and LOAD's words."""
    names = {"delimiter": "sep", "fields_terminated_by": "sep", "enclosed_by": "quote", "escaped_by": "escape", "lines_terminated_by": "lineSep", "null": "nullValue", "encoding": "encoding", "header": "header", "ignore_lines": "skip", "dateformat": "dateFormat", "timeformat": "timestampFormat"}
    return {names.get(k.lower(), k): str(v).lower() if isinstance(v, bool) else str(v) for k, v in given.items() if k != "ignore_lines"}


def copy_from(spark: SparkSession, path: str, schema: str, kind: str = "CSV", where: str | None = None, mapping: dict[str, str] | None = None, **given) -> DataFrame:
    """COPY .. FROM, LOAD DATA, BULK INSERT, stage and broker loads: read with a schema, map columns, filter."""
    reader = spark.read.format(FORMATS.get(kind.upper(), kind.lower())).options(**options(**given))
    df = reader.schema(schema).load(path) if kind.upper() != "TEXT" else reader.load(path)
    if mapping:
        df = df.selectExpr(*(f"{e} AS `{c}`" for c, e in mapping.items()))
    return df.where(where) if where else df


def copy_to(df: DataFrame, path: str, kind: str = "CSV", mode: str = "errorifexists", partition_by: list[str] | None = None, most_rows: int | None = None, **given) -> None:
    """COPY .. TO, UNLOAD, EXPORT, SELECT INTO OUTFILE."""
    writer = df.write.format(FORMATS.get(kind.upper(), kind.lower())).mode(mode).options(**options(**given))
    writer = writer.option("maxRecordsPerFile", most_rows) if most_rows else writer
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def partition_scan(df: DataFrame, condition: Column) -> DataFrame:
    """A scan of some partitions: a filter on partition columns, which Spark prunes."""
    return df.where(condition)


def as_of(versions: DataFrame, valid_from: str, moment, keys: list[str]) -> DataFrame:
    """Time travel over a history table: the last version of every key that is not later than ``moment``."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(valid_from)))
    return versions.where(F.col(valid_from) <= moment).withColumn("__n", last).where("__n = 1").drop("__n")

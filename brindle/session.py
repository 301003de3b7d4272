"""Sessions and the tables of a data folder."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(cpus: int | str = "*", memory: str = "8g") -> SparkSession:
    """A local session with the settings that the engine expects; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("brindle")
        .config("spark.sql.shuffle.partitions", 8 if cpus == "*" else int(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str, text: str | None = None) -> None:
    """Name the tables of the folder as temporary views; with ``text`` only those that it mentions."""
    for name in TABLES:
        if text is None or re.search(rf"\b{name}\b", text, re.I):
            table(spark, sf_dir, name).createOrReplaceTempView(name)

"""Joins that Spark SQL has no form for, as compositions of joins, windows and unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import checkpointed


def asof(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, take: list[str], keep: str = "left") -> DataFrame:
    """Each left row with the last right row of the same ``by`` that is not later; equal right times take the greatest row.

    Both sides are united and ordered once per key, so the cost is one shuffle and one sort whatever the matches. Rows
    with a null time or key match nothing. ``keep``: ``left`` keeps rows without a match, ``inner`` drops them.
    """
    a = left.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(by)), F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__left"), F.lit(None).cast(_struct(right, take)).alias("__right"))
    b = right.where(F.col(right_time).isNotNull()).select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(by)), F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("__left"), F.struct(*take).alias("__right"))
    keys = [f"__k{i}" for i in range(len(by))]
    order = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("__t"), "__side", F.asc_nulls_first("__right")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    usable = F.col("__t").isNotNull()
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    seen = a.unionByName(b).withColumn("__last", F.when(usable, F.last("__right", ignorenulls=True).over(order))).where("__side = 1")
    out = seen if keep == "left" else seen.where("__last IS NOT NULL")
    return out.select("__left.*", *(F.col(f"__last.{c}").alias(c) for c in take))


def _struct(df: DataFrame, columns: list[str]):
    return df.select(F.struct(*columns)).schema[0].dataType


def range_join(points: DataFrame, spans: DataFrame, point: str, low: str, high: str, width: float, on: list[str] | None = None) -> DataFrame:
    """Rows with ``low <= point < high``, by buckets of ``width`` instead of a nested loop.

    A span is posted under every bucket that it meets, so ``width`` should be about the spans' length.
    """
    bucket = F.floor(F.col(point) / width)
    posted = spans.where(F.col(low) < F.col(high)).withColumn("__b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    met = points.withColumn("__b", bucket).join(posted, ["__b", *(on or [])])
    return met.where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("__b")


def right_semi(left: DataFrame, right: DataFrame, on) -> DataFrame:
    return right.join(left, on, "left_semi")


def right_anti(left: DataFrame, right: DataFrame, on) -> DataFrame:
    return right.join(left, on, "left_anti")


def densified(facts: DataFrame, keys: list[str], dimension: DataFrame, on: list[str]) -> DataFrame:
    """A partitioned outer join: every combination of the facts' ``keys`` with each row of a small dimension."""
    combos = facts.select(*keys).distinct().join(dimension)
    return combos.join(facts, [*keys, *on], "left")


def lookup(left: DataFrame, right: DataFrame, local: str, foreign: str, name: str, fields: list[str]) -> DataFrame:
    """The matching right rows as a sorted array column ``name``; an empty array where nothing matches."""
    packed = right.groupBy(F.col(foreign).alias("__key")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    joined = left.join(packed, F.col(local) == F.col("__key"), "left").drop("__key")
    return joined.withColumn(name, F.coalesce(name, F.array().cast(joined.schema[name].dataType)))


def salted(left: DataFrame, right: DataFrame, on: list[str], salts: int, how: str = "inner") -> DataFrame:
    """An equi-join whose hot keys are spread over ``salts`` tasks: the right side comes once for each salt."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("rows of the repeated side must not come out on their own")
    a = left.withColumn("__s", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    b = right.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [*on, "__s"], how).drop("__s")


def pairs(df: DataFrame, by: list[str], key: str, size: int = 4096) -> DataFrame:
    """All ``a`` < ``b`` of ``key`` that share ``by``: a self-join of large groups in tiles.

    A group's keys are dealt into blocks of about ``size``, and a tile is two blocks or one with itself. Tiles lie in
    partitions of their own, so a group is spread over many tasks, and a task holds two blocks. A pair meets in one tile
    only, and rows are copied once for each block of their group.
    """
    known = df.select(*by, F.col(key).alias("__key")).dropna()
    sizes = known.groupBy(*by).agg(F.ceil(F.count("*") / size).cast("int").alias("__blocks"))
    dealt = known.join(sizes, by).groupBy(*by, "__blocks", F.pmod(F.xxhash64("__key"), "__blocks").cast("int").alias("__i"))
    blocks = checkpointed(dealt.agg(F.collect_list("__key").alias("__keys")))
    met = blocks.agg(F.sum(F.col("__blocks") - F.col("__i"))).first()[0] or 1  # one row
    tasks, at = max(4 * df.sparkSession.sparkContext.defaultParallelism, min(met, 1 << 14)), [*by, "__i", "__j"]
    left = blocks.select(*by, "__i", F.explode(F.sequence("__i", F.col("__blocks") - 1)).alias("__j"), F.col("__keys").alias("__left"))
    right = blocks.select(*by, F.explode(F.sequence(F.lit(0), "__i")).alias("__i"), F.col("__i").alias("__j"), F.col("__keys").alias("__right"))
    # A row at a time meets a block, as Spark buffers what one row explodes to; the copies are too many to broadcast.
    first = left.repartition(tasks, *at).select(*at, F.explode("__left").alias("__a"))
    tiles = first.join(right.repartition(tasks, *at).hint("merge"), at)
    both = tiles.select("__i", "__j", "__a", F.explode("__right").alias("__b")).where("__i < __j OR __a < __b")
    return both.select(F.least("__a", "__b").alias("a"), F.greatest("__a", "__b").alias("b"))


def greater_than_all(left: DataFrame, right: DataFrame, x: str, y: str) -> DataFrame:
    """``x > ALL (SELECT y ..)``: true over no rows; unknown, so dropped, once a ``y`` is null and none refutes it."""
    sums = right.agg(F.max(y).alias("__top"), F.count("*").alias("__n"), F.count(y).alias("__known"))
    holds: Column = (F.col("__n") == 0) | ((F.col("__n") == F.col("__known")) & (F.col(x) > F.col("__top")))
    return left.join(F.broadcast(sums)).where(holds).drop("__top", "__n", "__known")  # one row

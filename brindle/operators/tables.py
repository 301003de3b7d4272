"""Table operators: distinct on, ties, pivots, samples, set operations by name, hierarchies, row changes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

# Choosing rows


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", rank).where("__n = 1").drop("__n")


def fetch_with_ties(df: DataFrame, n: int, keys: list[str], descending: bool = False) -> DataFrame:
    """The first ``n`` rows and all that tie with the last: a limit finds their keys, so nothing is ranked in one task."""
    first = df.orderBy(*(F.desc_nulls_last(k) if descending else F.asc_nulls_last(k) for k in keys)).limit(n)
    found = first.select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct()  # Spark broadcasts it if it is small
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return df.join(found, same, "left_semi")


def per_partition_limit(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", rank).where(F.col("__n") <= n).drop("__n")


def percent(df: DataFrame, share: float, order: list[Column]) -> DataFrame:
    """The first ``share`` percent of the rows, rounded up.

    Rows are dealt into ranges of the order and counted; whole ranges before the cut come as they are, and only the range
    in which the cut lies is ranked.
    """
    from ..sources.scratch import checkpointed

    ranges = checkpointed(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    sizes = sorted(map(tuple, ranges.groupBy("__p").count().collect()))  # a row for each range
    left, whole, last = -(-int(sum(n for _, n in sizes) * share * 1000) // 100_000), [], None
    for part, n in sizes:
        if left < n:
            last = part
            break
        whole.append(part)
        left -= n
    out = ranges.where(F.col("__p").isin(whole)) if whole else ranges.limit(0)
    if last is not None and left:
        out = out.unionByName(ranges.where(F.col("__p") == last).orderBy(*order).limit(left))
    return out.drop("__p")


def exact_sample(df: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` rows by a seeded order."""
    return df.orderBy(F.xxhash64(F.lit(seed), *df.columns)).limit(n)


def weighted_sample(df: DataFrame, n: int, weight: str, seed: int) -> DataFrame:
    """``n`` rows without replacement, with chances by weight: the smallest exponential keys."""
    key = -F.log((F.pmod(F.xxhash64(F.lit(seed), *df.columns), F.lit(2**52)) + 1) / float(2**52)) / F.col(weight)
    return df.where(F.col(weight) > 0).orderBy(key).limit(n)


# Shape


def map_reduce(df: DataFrame, emit: Column, reduced: Column) -> DataFrame:
    """``emit`` gives an array of (``key``, ``value``) for each row; ``reduced`` aggregates ``value`` for each ``key``."""
    return df.select(F.inline(emit)).groupBy("key").agg(reduced.alias("value"))


def star_like(df: DataFrame, pattern: str) -> DataFrame:
    """The columns whose names match an ILIKE pattern."""
    import re

    regex = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern)
    return df.select(*[c for c in df.columns if re.fullmatch(regex, c, re.I | re.S)])


def pivot_any(df: DataFrame, keys: list[str], column: str, value: Column, default=None) -> DataFrame:
    """A pivot over whatever values there are, in their order; ``default`` for missing cells."""
    made = df.groupBy(*keys).pivot(column).agg(value)
    return made if default is None else made.fillna(default)


def tuple_pivot(df: DataFrame, name: str, value: str, by: list[str]) -> DataFrame:
    """A map of attribute to value per group."""
    return df.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, value)))).alias("tuple"))


def union_by_name(parts: list[DataFrame], outer: bool = False, distinct: bool = False) -> DataFrame:
    """Columns meet by name; ``outer`` fills what a part lacks with null."""
    made = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=outer), parts)
    return made.distinct() if distinct else made


def corresponding(parts: list[DataFrame], on: list[str] | None = None) -> DataFrame:
    """The union over the columns that all parts share."""
    shared = on or [c for c in parts[0].columns if all(c in p.columns for p in parts)]
    return reduce(lambda a, b: a.union(b), [p.select(*shared) for p in parts]).distinct()


# Hierarchies


def closure(edges: DataFrame, parent: str, child: str, start: DataFrame, most: int | None = None) -> DataFrame:
    """Distinct reachability from the ``node`` of ``start``: ``node`` and the least ``depth``, to a fixpoint or, if given, depth ``most``.

    The UNION (distinct) form of a recursive query, which Spark SQL lacks. Every round's frontier is checkpointed, so plans
    stay short and no executor has the only copy.
    """
    from ..sources.scratch import checkpointed

    links = edges.select(F.col(parent).alias("__p"), F.col(child).alias("__c"))
    seen = checkpointed(start.select(F.col("node"), F.lit(0).alias("depth")).distinct())
    front = seen
    depth = 0
    while most is None or depth < most:
        depth += 1
        new = front.join(links, F.col("node") == F.col("__p")).select(F.col("__c").alias("node")).distinct().join(seen, "node", "left_anti")
        front = checkpointed(new.withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return seen
        seen = checkpointed(seen.unionByName(front))
    return seen


#: Up to so many distinct edges are given to every worker (12 bytes each and their nodes); rows in a batch that a worker gives back.
HELD_EDGES, BATCH = 1 << 22, 1 << 16


def shortest(edges: DataFrame, source: str, target: str) -> DataFrame:
    """All pairs ``a``, ``b`` that a path of one or more edges joins, with the least number ``d`` of edges, to a fixpoint.

    The pairs can be as many as the square of the nodes. Edges of up to ``HELD_EDGES`` go to all workers, and each source is
    searched when its pairs are read, breadth first, so that no pair is stored. More edges are joined round by round.
    """
    from ..sources.scratch import checkpointed

    links = checkpointed(edges.select(F.col(source).alias("a"), F.col(target).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct())
    kind, other = (f.dataType for f in links.schema)
    if kind == other and isinstance(kind, (IntegralType, StringType)) and links.count() <= HELD_EDGES:
        return _searched(links)
    steps = links.select(F.col("a").alias("__via"), F.col("b").alias("__next"))
    front = links.withColumn("d", F.lit(1))
    parts, depth = [front], 1
    while not front.isEmpty():
        depth += 1
        further = front.join(steps, F.col("b") == F.col("__via")).select("a", F.col("__next").alias("b")).distinct()
        front = checkpointed(further.join(reduce(DataFrame.unionByName, parts), ["a", "b"], "left_anti").withColumn("d", F.lit(depth)))
        parts.append(front)
        if len(parts) > 32:  # short plans
            parts = [checkpointed(reduce(DataFrame.unionByName, parts))]
    return reduce(DataFrame.unionByName, parts)


def _searched(links: DataFrame) -> DataFrame:
    """``shortest`` over edges that a worker holds: nodes are numbered, sources first."""
    found, context = links.toArrow(), links.sparkSession.sparkContext
    coded = pa.chunked_array([*found["a"].chunks, *found["b"].chunks], found["a"].type).combine_chunks().dictionary_encode()
    codes, n = coded.indices.to_numpy(), len(coded.dictionary)
    a, b = codes[: found.num_rows], codes[found.num_rows :]
    first = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n))])
    held = context.broadcast((coded.dictionary, first, b[np.argsort(a, kind="stable")]))
    sources, batch = int(a.max(initial=-1)) + 1, BATCH
    tasks = max(1, min(sources, max(4 * context.defaultParallelism, min(sources * n >> 26, 1 << 14))))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, first, targets = held.value
        depth, place = np.zeros(len(nodes), np.int32), np.empty(len(nodes), np.int64)

        def reached(start: int) -> tuple[np.ndarray, np.ndarray]:
            front, fronts, d = np.array([start]), [], 0
            while len(front):
                d += 1
                at, many = first[front], first[front + 1] - first[front]
                ends = np.cumsum(many)
                front = targets[np.repeat(at - ends + many, many) + np.arange(ends[-1])]
                front = front[depth[front] == 0]
                order = np.arange(len(front))
                place[front] = order
                front = front[place[front] == order]  # each node once
                depth[front] = d
                fronts.append(front)
            every = np.concatenate(fronts)
            far = depth[every]
            depth[every] = 0
            return every, far

        def made(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            starts = np.repeat([s for s, _, _ in rows], [len(e) for _, e, _ in rows])
            ends, far = (np.concatenate([r[k] for r in rows]) for k in (1, 2))
            for at in range(0, len(ends), batch):
                cut = slice(at, at + batch)
                yield pa.RecordBatch.from_arrays([nodes.take(pa.array(starts[cut])), nodes.take(pa.array(ends[cut])), pa.array(far[cut])], ["a", "b", "d"])

        rows, n = [], 0
        for part in batches:
            for start in part.column(0).to_numpy():
                rows.append((start, *reached(start)))
                n += len(rows[-1][1])
                if n >= batch:
                    yield from made(rows)
                    rows, n = [], 0
        if rows:
            yield from made(rows)

    return links.sparkSession.range(0, sources, 1, tasks).mapInArrow(pairs, links.withColumn("d", F.lit(1)).schema)


# Row changes: each gives the table's new state


def _once(source: DataFrame, keys: list[str]) -> DataFrame:
    """``source``, which fails where two rows have the same keys."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    many = F.raise_error(F.lit("several source rows have the same keys")).cast("boolean")
    return source.withColumn("__many", n).where(F.when(known & (F.col("__many") > 1), many).otherwise(F.lit(True))).drop("__many")


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the source replace those with the same keys; the rest is inserted. Repeated keys in the source are an error."""
    source = _once(source, keys)
    kept = target.join(source.select(*keys), keys, "left_anti").select(*target.columns)
    return kept.unionByName(source.select(*target.columns))


def update_from(target: DataFrame, source: DataFrame, keys: list[str], changes: dict[str, Column]) -> DataFrame:
    """Set columns of the rows that match; ``changes`` may use the source's columns as ``s.name``. Repeated keys in the source are an error."""
    joined = target.alias("t").join(_once(source, keys).alias("s"), [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys], "left")
    hit = F.col(f"s.{keys[0]}").isNotNull()
    return joined.select(*(F.when(hit, changes[c]).otherwise(F.col(f"t.{c}")).alias(c) if c in changes else F.col(f"t.{c}").alias(c) for c in target.columns))


def delete_where(target: DataFrame, condition: Column) -> DataFrame:
    """Rows stay where the condition is false or unknown."""
    return target.where(~F.coalesce(condition, F.lit(False)))


def delete_using(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    return target.join(source, keys, "left_anti")


class Merge:
    """MERGE as clauses in order: the first whose condition holds decides what becomes of a row."""

    def __init__(self, target: DataFrame, source: DataFrame, keys: list[str]):
        self.target, self.source, self.keys = target, source, keys
        self.matched: list[tuple[Column, dict[str, Column] | None]] = []
        self.missing: list[tuple[Column, dict[str, Column]]] = []
        self.orphaned: list[tuple[Column, dict[str, Column] | None]] = []

    def when_matched(self, condition: Column | None = None, update: dict[str, Column] | None = None) -> Merge:
        """Update, or delete without ``update``."""
        self.matched.append((F.lit(True) if condition is None else condition, update))
        return self

    def when_not_matched(self, insert: dict[str, Column], condition: Column | None = None) -> Merge:
        self.missing.append((F.lit(True) if condition is None else condition, insert))
        return self

    def when_not_matched_by_source(self, condition: Column | None = None, update: dict[str, Column] | None = None) -> Merge:
        self.orphaned.append((F.lit(True) if condition is None else condition, update))
        return self

    def result(self) -> DataFrame:
        """The new state. A target row that several source rows match is an error."""
        columns = self.target.columns
        t = self.target.withColumn("__t", F.lit(True)).alias("t")
        many = Window.partitionBy(*self.keys)
        s = self.source.withColumn("__n", F.count("*").over(many)).withColumn("__s", F.lit(True)).alias("s")
        both = t.join(s, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in self.keys], "full")
        in_t, in_s = F.col("t.__t").isNotNull(), F.col("s.__s").isNotNull()
        error = F.when(in_t & in_s & (F.col("s.__n") > 1), F.raise_error(F.lit("several source rows match one target row")).cast("int")).otherwise(0)
        case = F.when(error > 0, -1)
        made: list[dict[str, Column] | None] = []
        for place, clauses in ((in_t & in_s, self.matched), (~in_t & in_s, self.missing), (in_t & ~in_s, self.orphaned)):
            for condition, change in clauses:
                case = case.when(place & condition, len(made))
                made.append(change)
        case = case.when(in_t, -2).otherwise(-3)
        inserts = range(len(self.matched), len(self.matched) + len(self.missing))
        chosen = both.withColumn("__case", case)
        drops = [k for k, change in enumerate(made) if change is None]
        chosen = chosen.where((F.col("__case") != -3) & ~F.col("__case").isin(drops) if drops else F.col("__case") != -3)
        out = []
        for c in columns:
            value = None
            for k, change in enumerate(made):
                if change is None:
                    continue
                new = change.get(c, F.lit(None) if k in inserts else F.col(f"t.{c}"))
                value = F.when(F.col("__case") == k, new) if value is None else value.when(F.col("__case") == k, new)
            out.append((F.col(f"t.{c}") if value is None else value.otherwise(F.col(f"t.{c}"))).cast(self.target.schema[c].dataType).alias(c))
        return chosen.select(*out)


def insert_first(df: DataFrame, branches: list[tuple[str, Column]], otherwise: str | None = None) -> dict[str, DataFrame]:
    """Every row to the first branch whose condition holds."""
    out, before = {}, F.lit(False)
    for name, condition in branches:
        holds = F.coalesce(condition, F.lit(False))
        out[name] = df.where(holds & ~before)
        before = before | holds
    if otherwise:
        out[otherwise] = df.where(~before)
    return out


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Inserted and deleted rows between two states, with repeats."""
    return new.exceptAll(old).withColumn("change", F.lit("insert")).unionByName(old.exceptAll(new).withColumn("change", F.lit("delete")))

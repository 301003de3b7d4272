"""Lineage, review, schema differences, constraints and policies over DataFrames and their plans."""

from __future__ import annotations

import re
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lineage(df: DataFrame) -> DataFrame:
    """(``output``, ``source``): the base columns from which each output column is computed, from the analysed plan."""
    spark = df.sparkSession
    plan = df._jdf.queryExecution().analyzed()
    parents: dict[int, set[int]] = {}
    names: dict[int, str] = {}

    def refs(expression) -> set[int]:
        it, out = expression.references().iterator(), set()
        while it.hasNext():
            out.add(it.next().exprId().id())
        return out

    def visit(node) -> None:
        kids = node.children()
        for k in range(kids.size()):
            visit(kids.apply(k))
        label = node.nodeName()
        if kids.size() == 0:
            found = re.search(r"([\w.-]+)\.parquet", node.toString()) or re.search(r"([\w.]+)", label)
            place = _place(node) or found[1]
            for k in range(node.output().size()):
                a = node.output().apply(k)
                names[a.exprId().id()] = f"{place}.{a.name()}"
        expressions = node.expressions()
        for k in range(expressions.size()):
            e = expressions.apply(k)
            if e.getClass().getSimpleName() == "Alias":
                parents.setdefault(e.exprId().id(), set()).update(refs(e.child()))
        if label in ("Union", "Intersect", "Except", "Intersect All", "Except All"):
            for k in range(node.output().size()):
                parents.setdefault(node.output().apply(k).exprId().id(), set()).update(kids.apply(j).output().apply(k).exprId().id() for j in range(kids.size()))

    visit(plan)

    def base(i: int, seen: frozenset = frozenset()) -> set[str]:
        if i in names:
            return {names[i]}
        if i in seen:
            return set()
        return {s for p in parents.get(i, ()) for s in base(p, seen | {i})}

    rows = []
    for k in range(plan.output().size()):
        a = plan.output().apply(k)
        rows += [(a.name(), s) for s in sorted(base(a.exprId().id()))]
    return spark.createDataFrame(rows, "output string, source string")


def _place(node) -> str | None:
    try:
        paths = node.relation().location().rootPaths()
        return re.sub(r"\.parquet$", "", paths.apply(0).getName())
    except Exception:  # a leaf that is no file relation has no paths
        return None


#: Review rules by name: a pattern that a statement should not have, and what it means.
RULES = {
    "select-all": (r"\bselect\s+(?:\w+\.)?\*", "name the columns that are needed"),
    "where-required": (r"^\s*(?:update|delete\s+from)\b(?!.*\bwhere\b)", "a change without a condition reaches every row"),
    "leading-wildcard": (r"\blike\s+'%", "a pattern that starts with a wildcard reads everything"),
    "order-by-rand": (r"\border\s+by\s+rand\s*\(", "ordering by random numbers sorts everything"),
    "cross-join": (r"\bcross\s+join\b", "every pair of rows is made"),
    "drop-cascade": (r"\bdrop\b.*\bcascade\b", "dependent objects go too"),
}


def review(sql: str, rules: dict[str, tuple[str, str]] | None = None) -> list[tuple[str, str]]:
    """(rule, advice) for each rule that a statement breaks."""
    text = re.sub(r"--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S)
    return [(name, advice) for name, (pattern, advice) in (rules or RULES).items() if re.search(pattern, text, re.I | re.S)]


def schema_diff(spark: SparkSession, old: T.StructType, new: T.StructType) -> DataFrame:
    """(``change``, ``column``, ``before``, ``after``) between two schemas."""
    a, b = {f.name: f for f in old}, {f.name: f for f in new}
    rows = [("drop", k, a[k].dataType.simpleString(), None) for k in a if k not in b]
    rows += [("add", k, None, b[k].dataType.simpleString()) for k in b if k not in a]
    for k in a.keys() & b.keys():
        x, y = a[k], b[k]
        if x.dataType != y.dataType:
            rows.append(("type", k, x.dataType.simpleString(), y.dataType.simpleString()))
        if x.nullable != y.nullable:
            rows.append(("null", k, str(x.nullable).lower(), str(y.nullable).lower()))
    return spark.createDataFrame(sorted(rows), "change string, column string, before string, after string")


def migration(table: str, old: T.StructType, new: T.StructType) -> list[str]:
    """ALTER statements that take a table from one schema to the other."""
    a, b = {f.name: f for f in old}, {f.name: f for f in new}
    out = [f"ALTER TABLE {table} DROP COLUMN {k}" for k in a if k not in b]
    out += [f"ALTER TABLE {table} ADD COLUMN {k} {b[k].dataType.simpleString().upper()}" for k in b if k not in a]
    return out + [f"ALTER TABLE {table} ALTER COLUMN {k} TYPE {b[k].dataType.simpleString().upper()}" for k in a if k in b and a[k].dataType != b[k].dataType]


def ordered(dependencies: dict[str, set[str]]) -> list[str]:
    """Objects after those that they depend on; a cycle is an error."""
    return list(TopologicalSorter({k: sorted(v) for k, v in sorted(dependencies.items())}).static_order())


# Constraints: the rows that violate them


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, foreign: str, key: str) -> DataFrame:
    """Child rows whose non-null reference has no parent."""
    return child.where(F.col(foreign).isNotNull()).join(parent.select(F.col(key).alias(foreign)), foreign, "left_anti").select(*child.columns)


def check_failures(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the check is false; unknown passes."""
    return df.where(~F.coalesce(condition, F.lit(True)))


# Policies


def masked(df: DataFrame, row_policy: Column | None = None, masks: dict[str, Column] | None = None) -> DataFrame:
    """The rows that a policy lets through, with masked columns."""
    out = df.where(row_policy) if row_policy is not None else df
    return out.withColumns(masks) if masks else out

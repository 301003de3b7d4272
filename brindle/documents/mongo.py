"""Filter documents, expressions and aggregation pipelines of a document database as DataFrame operations."""

from __future__ import annotations

import re
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dialect import haversine

Document = dict[str, Any]

_COMPARE = {"$eq": "__eq__", "$gt": "__gt__", "$gte": "__ge__", "$lt": "__lt__", "$lte": "__le__"}
_TYPES = {"string": "string", "int": "int", "long": "bigint", "double": "double", "bool": "boolean", "date": "timestamp", "array": "array", "object": "struct", "decimal": "decimal"}


def _both(parts: list[Column], how) -> Column:
    return reduce(how, parts) if parts else F.lit(True)


def predicate(query: Document) -> Column:
    """A filter document as a condition."""
    parts = []
    for key, value in query.items():
        if key == "$and":
            parts.append(_both([predicate(q) for q in value], lambda a, b: a & b))
        elif key == "$or":
            parts.append(_both([predicate(q) for q in value], lambda a, b: a | b))
        elif key == "$nor":
            parts.append(~F.coalesce(_both([predicate(q) for q in value], lambda a, b: a | b), F.lit(False)))
        elif key == "$expr":
            parts.append(expression(value))
        elif key == "$text":
            words = value["$search"].lower().split()
            tokens = F.split(F.lower(F.col(value.get("$field", "text"))), r"\W+")
            parts.append(F.arrays_overlap(tokens, F.array(*map(F.lit, words))))
        elif key.startswith("$"):
            raise ValueError(f"{key} is not supported")
        else:
            parts.append(_field(F.col(key), value))
    return _both(parts, lambda a, b: a & b)


def _field(column: Column, value: Any) -> Column:
    if not (isinstance(value, dict) and any(k.startswith("$") for k in value)):
        return column.isNull() if value is None else column == F.lit(value)
    parts = []
    for op, x in value.items():
        if op in _COMPARE:
            parts.append(column.isNull() if op == "$eq" and x is None else getattr(column, _COMPARE[op])(F.lit(x)))
        elif op == "$ne":
            parts.append(column.isNotNull() if x is None else ~column.eqNullSafe(F.lit(x)))
        elif op in ("$in", "$nin"):
            found = F.coalesce(column.isin([v for v in x if v is not None]), F.lit(False)) | (column.isNull() if None in x else F.lit(False))
            parts.append(found if op == "$in" else ~found)
        elif op == "$exists":
            parts.append(column.isNotNull() if x else column.isNull())
        elif op == "$not":
            parts.append(~F.coalesce(_field(column, x), F.lit(False)))
        elif op == "$regex":
            flags = f"(?{value['$options']})" if value.get("$options") else ""
            parts.append(column.rlike(flags + x))
        elif op == "$options":
            continue
        elif op == "$mod":
            parts.append(column % x[0] == x[1])
        elif op == "$size":
            parts.append(F.size(column) == x)
        elif op == "$all":
            parts.append(_both([F.array_contains(column, F.lit(v)) for v in x], lambda a, b: a & b))
        elif op == "$elemMatch":
            parts.append(F.exists(column, lambda e, q=x: _element(e, q)))
        elif op == "$geoWithin":
            parts.append(_within(column, x))
        elif op in ("$near", "$nearSphere"):
            parts.append(column.isNotNull())
            parts += [getattr(_metres(column, x), how)(x[word]) for word, how in (("$minDistance", "__ge__"), ("$maxDistance", "__le__")) if word in x]
        elif op == "$type":
            parts.append(F.typeof(column).startswith(_TYPES[x]))
        else:
            raise ValueError(f"{op} is not supported")
    return _both(parts, lambda a, b: a & b)


# Positions are arrays of longitude and latitude, as the coordinates of a point document are.


def _within(column: Column, shape: Document) -> Column:
    """Inside of a ``$box`` (two corners) or a ``$centerSphere`` (centre, radius in radians)."""
    (kind, value), = shape.items()
    if kind == "$box":
        (left, below), (right, above) = value
        return column[0].between(left, right) & column[1].between(below, above)
    if kind == "$centerSphere":
        (lon, lat), radius = value
        return haversine(column[1], column[0], F.lit(lat), F.lit(lon)) / 6371 <= radius
    raise ValueError(f"{kind} is not supported")


def _metres(column: Column, near: Document) -> Column:
    lon, lat = near["$geometry"]["coordinates"]
    return haversine(column[1], column[0], F.lit(lat), F.lit(lon)) * 1000


def _element(element: Column, query: Document) -> Column:
    if all(k.startswith("$") for k in query):
        return _field(element, query)
    return _both([_field(element[k], v) for k, v in query.items()], lambda a, b: a & b)


def expression(value: Any) -> Column:
    """An aggregation expression as a column."""
    if isinstance(value, str) and value.startswith("$"):
        return F.col(value[1:])
    if isinstance(value, list):
        return F.array(*map(expression, value))
    if not isinstance(value, dict):
        return F.lit(value)
    if len(value) != 1 or not next(iter(value)).startswith("$"):
        return F.struct(*(expression(v).alias(k) for k, v in value.items()))
    (op, args), = value.items()
    many = [expression(a) for a in (args if isinstance(args, list) else [args])] if op not in ("$cond", "$switch", "$dateToString", "$literal", "$filter", "$map") else []
    one = {"$year": F.year, "$month": F.month, "$dayOfMonth": F.dayofmonth, "$hour": F.hour, "$toUpper": F.upper, "$toLower": F.lower, "$size": F.size, "$abs": F.abs, "$ceil": F.ceil, "$floor": F.floor, "$sqrt": F.sqrt, "$strLenCP": F.length, "$not": lambda c: ~c, "$toString": lambda c: c.cast("string"), "$toInt": lambda c: c.cast("int"), "$toDouble": lambda c: c.cast("double")}
    two = {"$subtract": lambda a, b: a - b, "$divide": lambda a, b: a / b, "$mod": lambda a, b: a % b, "$pow": F.pow, "$eq": lambda a, b: a.eqNullSafe(b), "$ne": lambda a, b: ~a.eqNullSafe(b), "$gt": lambda a, b: a > b, "$gte": lambda a, b: a >= b, "$lt": lambda a, b: a < b, "$lte": lambda a, b: a <= b, "$ifNull": F.coalesce, "$arrayElemAt": lambda a, i: F.get(a, i), "$in": lambda x, a: F.array_contains(a, x), "$split": F.split}
    fold = {"$add": lambda a, b: a + b, "$multiply": lambda a, b: a * b, "$and": lambda a, b: a & b, "$or": lambda a, b: a | b}
    if op in one:
        return one[op](many[0])
    if op in two:
        return two[op](*many)
    if op in fold:
        return reduce(fold[op], many)
    if op == "$concat":
        return F.concat(*many)
    if op == "$round":
        return F.round(many[0], args[1] if isinstance(args, list) and len(args) > 1 else 0)
    if op == "$literal":
        return F.lit(args)
    if op == "$max" or op == "$min":
        return (F.greatest if op == "$max" else F.least)(*many)
    if op == "$cond":
        test, yes, no = args if isinstance(args, list) else (args["if"], args["then"], args["else"])
        return F.when(expression(test), expression(yes)).otherwise(expression(no))
    if op == "$switch":
        out = None
        for branch in args["branches"]:
            test, then = expression(branch["case"]), expression(branch["then"])
            out = F.when(test, then) if out is None else out.when(test, then)
        return out.otherwise(expression(args.get("default")))
    raise ValueError(f"{op} is not supported")


def _accumulator(value: Document) -> Column:
    (op, arg), = value.items()
    simple = {"$sum": F.sum, "$avg": F.avg, "$min": F.min, "$max": F.max, "$stdDevPop": F.stddev_pop, "$stdDevSamp": F.stddev_samp, "$first": F.first, "$last": F.last}
    if op == "$count":
        return F.count(F.lit(1))
    if op == "$sum" and isinstance(arg, (int, float)):
        return F.sum(F.lit(arg))
    if op == "$push":
        return F.array_sort(F.collect_list(expression(arg)))
    if op == "$addToSet":
        return F.array_sort(F.collect_set(expression(arg)))
    return simple[op](expression(arg))


def _add(df: DataFrame, fields: Document) -> DataFrame:
    return df.withColumns({k: expression(v) for k, v in fields.items()})


def _project(df: DataFrame, spec: Document) -> DataFrame:
    kept = {k: v for k, v in spec.items() if not (v in (0, False) and not isinstance(v, dict))}
    if not kept or set(kept) <= {"_id"} and len(kept) < len(spec):
        return df.drop(*[k for k in spec if k not in kept])
    plain = lambda v: v is True or (isinstance(v, int) and not isinstance(v, bool) and v == 1)
    columns = [F.col(k).alias(k.split(".")[-1]) if plain(v) else expression(v).alias(k) for k, v in kept.items()]
    if "_id" in df.columns and "_id" not in spec:
        columns.insert(0, F.col("_id"))
    return df.select(*columns)


def _group(df: DataFrame, spec: Document) -> DataFrame:
    key = spec["_id"]
    sums = [_accumulator(v).alias(k) for k, v in spec.items() if k != "_id"]
    if key is None:
        return df.agg(*sums).select(F.lit(None).cast("string").alias("_id"), "*")
    return df.groupBy(expression(key).alias("_id")).agg(*sums)


def _bucket(df: DataFrame, spec: Document) -> DataFrame:
    bounds, x = spec["boundaries"], expression(spec["groupBy"])
    case = None
    for low, high in zip(bounds, bounds[1:]):
        test = (x >= low) & (x < high)
        case = F.when(test, F.lit(low)) if case is None else case.when(test, F.lit(low))
    if "default" in spec:
        case = case.otherwise(F.lit(spec["default"]))
    else:
        case = case.otherwise(F.raise_error(F.lit("a value lies outside the boundaries")))
    output = spec.get("output", {"count": {"$sum": 1}})
    return df.groupBy(case.alias("_id")).agg(*(_accumulator(v).alias(k) for k, v in output.items()))


def _unwind(df: DataFrame, spec: str | Document) -> DataFrame:
    spec = {"path": spec} if isinstance(spec, str) else spec
    name = spec["path"][1:]
    keep = spec.get("preserveNullAndEmptyArrays", False)
    index = spec.get("includeArrayIndex")
    made = (F.posexplode_outer if keep else F.posexplode)(F.col(name))
    out = df.select(*(c for c in df.columns if c != name), made.alias("__pos", name))
    out = out.withColumnRenamed("__pos", index) if index else out.drop("__pos")
    return out.select(*df.columns, *([index] if index else []))


def _sort(df: DataFrame, spec: Document) -> DataFrame:
    return df.orderBy(*(F.asc_nulls_first(k) if d > 0 else F.desc_nulls_last(k) for k, d in spec.items()))


def _windows(df: DataFrame, spec: Document) -> DataFrame:
    window = Window.partitionBy(expression(spec["partitionBy"])) if "partitionBy" in spec else Window.partitionBy(F.lit(0))
    order = [F.asc_nulls_first(k) if d > 0 else F.desc_nulls_last(k) for k, d in spec.get("sortBy", {}).items()]
    out = {}
    for name, value in spec["output"].items():
        frame = value.get("window", {}).get("documents")
        call = {k: v for k, v in value.items() if k != "window"}
        own = window.orderBy(*order) if order else window
        (op, arg), = call.items()
        if op in ("$rank", "$denseRank", "$documentNumber"):
            out[name] = {"$rank": F.rank, "$denseRank": F.dense_rank, "$documentNumber": F.row_number}[op]().over(own)
            continue
        if op == "$shift":
            out[name] = F.lag(expression(arg["output"]), -arg["by"], arg.get("default")).over(own)
            continue
        edge = {"unbounded": (Window.unboundedPreceding, Window.unboundedFollowing), "current": (0, 0)}
        low, high = (edge.get(x, (x, x))[k] for k, x in enumerate(frame)) if frame else (Window.unboundedPreceding, Window.unboundedFollowing)
        out[name] = _accumulator(call).over(own.rowsBetween(low, high))
    return df.withColumns(out)


def _fill(df: DataFrame, spec: Document) -> DataFrame:
    window = Window.partitionBy(*spec.get("partitionByFields", [F.lit(0)])).orderBy(*spec.get("sortBy", {})).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({k: F.coalesce(F.col(k), F.last(k, ignorenulls=True).over(window) if v.get("method") == "locf" else F.lit(v.get("value"))) for k, v in spec["output"].items()})


def facet(df: DataFrame, spec: Document, tables: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The pipelines of $facet, a result for each."""
    return {name: aggregate(df, stages, tables) for name, stages in spec.items()}


def aggregate(df: DataFrame, pipeline: list[Document], tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Run a pipeline; ``tables`` are the collections that its stages may name."""
    tables = tables or {}
    for stage in pipeline:
        (op, spec), = stage.items()
        if op == "$match":
            df = df.where(predicate(spec))
        elif op in ("$addFields", "$set"):
            df = _add(df, spec)
        elif op == "$unset":
            df = df.drop(*([spec] if isinstance(spec, str) else spec))
        elif op == "$project":
            df = _project(df, spec)
        elif op == "$group":
            df = _group(df, spec)
        elif op == "$bucket":
            df = _bucket(df, spec)
        elif op == "$bucketAuto":
            tile = F.ntile(spec["buckets"]).over(Window.orderBy(expression(spec["groupBy"])))
            x = expression(spec["groupBy"])
            df = df.withColumn("__b", tile).groupBy("__b").agg(F.struct(F.min(x).alias("min"), F.max(x).alias("max")).alias("_id"), F.count(F.lit(1)).alias("count")).drop("__b")
        elif op == "$sortByCount":
            df = df.groupBy(expression(spec).alias("_id")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "_id")
        elif op == "$count":
            df = df.agg(F.count(F.lit(1)).alias(spec))
        elif op == "$unwind":
            df = _unwind(df, spec)
        elif op == "$sort":
            df = _sort(df, spec)
        elif op == "$limit":
            df = df.limit(spec)
        elif op == "$skip":
            df = df.offset(spec)
        elif op == "$sample":
            df = df.orderBy(F.rand(7)).limit(spec["size"])
        elif op == "$replaceRoot" or op == "$replaceWith":
            df = df.select(expression(spec["newRoot"] if op == "$replaceRoot" else spec).alias("__root")).select("__root.*")
        elif op == "$lookup":
            from ..operators.joins import lookup

            other = tables[spec["from"]]
            df = lookup(df, other, spec["localField"], spec["foreignField"], spec["as"], other.columns)
        elif op == "$graphLookup":
            from ..operators.tables import closure

            other = tables[spec["from"]]
            roots = df.select(expression(spec["startWith"]).alias("node"))
            df = closure(other.where(F.col(spec["connectToField"]).isNotNull()), spec["connectFromField"], spec["connectToField"], roots, spec.get("maxDepth"))
        elif op == "$unionWith":
            other = tables[spec if isinstance(spec, str) else spec["coll"]]
            df = df.unionByName(aggregate(other, [] if isinstance(spec, str) else spec.get("pipeline", []), tables), allowMissingColumns=True)
        elif op == "$setWindowFields":
            df = _windows(df, spec)
        elif op == "$fill":
            df = _fill(df, spec)
        elif op == "$densify":
            df = _densify(df, spec)
        elif op == "$out":
            df.write.mode("overwrite").parquet(spec)
        else:
            raise ValueError(f"{op} is not supported")
    return df


def _densify(df: DataFrame, spec: Document) -> DataFrame:
    """Rows for missing values of a numeric field between its bounds."""
    name, step, keys = spec["field"], spec["range"]["step"], spec.get("partitionByFields", [])
    bounds = df.groupBy(*keys).agg(F.min(name).alias("__lo"), F.max(name).alias("__hi"))
    grid = bounds.select(*keys, F.explode(F.sequence("__lo", "__hi", F.lit(step).cast(df.schema[name].dataType if not isinstance(df.schema[name].dataType, T.TimestampType) else "int"))).alias(name))
    return grid.join(df, [*keys, name], "full").select(*df.columns)


def find(df: DataFrame, query: Document | None = None, projection: Document | None = None, sort: Document | None = None, limit: int | None = None, skip: int | None = None) -> DataFrame:
    """Rows that match; without a sort, ``$near`` puts the nearest first, and rows equally near in the order of their fields."""
    found = aggregate(df, [{"$match": query or {}}])
    near = [(k, v.get("$near") or v.get("$nearSphere")) for k, v in (query or {}).items() if isinstance(v, dict) and v.keys() & {"$near", "$nearSphere"}]
    if near and not sort:
        fields = [F.col(f"`{f.name}`") for f in found.schema if not re.search(r"\b(map<|variant|interval)", f.dataType.simpleString())]
        found = found.orderBy(*(_metres(F.col(k), v) for k, v in near), *fields)
    stages: list[Document] = [{"$sort": sort}] if sort else []
    stages += [{"$skip": skip}] if skip else []
    stages += [{"$limit": limit}] if limit else []
    stages += [{"$project": projection}] if projection else []
    return aggregate(found, stages)


def count_documents(df: DataFrame, query: Document) -> int:
    return df.where(predicate(query)).count()


def distinct(df: DataFrame, field: str, query: Document | None = None) -> DataFrame:
    return df.where(predicate(query or {})).select(field).distinct()


def update_many(df: DataFrame, query: Document, update: Document) -> DataFrame:
    """The collection after ``$set``, ``$inc``, ``$mul`` and ``$unset`` of the rows that match."""
    hit = F.coalesce(predicate(query), F.lit(False))
    new = {k: F.lit(v) for k, v in update.get("$set", {}).items()}
    new |= {k: F.col(k) + v for k, v in update.get("$inc", {}).items()} | {k: F.col(k) * v for k, v in update.get("$mul", {}).items()} | {k: F.lit(None) for k in update.get("$unset", {})}
    return df.select(*(F.when(hit, new[c]).otherwise(F.col(c)).cast(df.schema[c].dataType).alias(c) if c in new else F.col(c) for c in df.columns))


def delete_many(df: DataFrame, query: Document) -> DataFrame:
    return df.where(~F.coalesce(predicate(query), F.lit(False)))


#: Stages that keep the shape of their input.
SHAPE_KEPT = ("$match", "$sort", "$limit", "$skip", "$sample")


def keeps_shape(pipeline: list[Document]) -> bool:
    return all(next(iter(stage)) in SHAPE_KEPT for stage in pipeline)


def predicate_fields(query: Document) -> set[str]:
    """The field paths that a filter reads."""
    out: set[str] = set()
    for key, value in query.items():
        if key in ("$and", "$or", "$nor"):
            for q in value:
                out |= predicate_fields(q)
        elif not key.startswith("$"):
            out.add(key)
            if isinstance(value, dict) and "$elemMatch" in value:
                out |= {f"{key}.{x}" for x in predicate_fields(value["$elemMatch"])}
    return out

"""Search request bodies (bool queries, ranges, sorts, terms aggregations) as DataFrame operations."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import haversine

_TOKENS = r"\W+"
Field = Callable[[str], Column]
#: Words of a range besides its bounds.
_RANGE_WORDS = {"boost", "format", "time_zone", "relation", "include_lower", "include_upper"}


def _tokens(column: Column) -> Column:
    return F.split(F.lower(column), _TOKENS)


def _line(column: Column) -> Column:
    """The tokens in one line with a space before and after each."""
    return F.concat(F.lit(" "), F.array_join(F.array_remove(_tokens(column), ""), " "), F.lit(" "))


def _words(text: str) -> list[str]:
    """The tokens of a query, as those of a text."""
    return [w for w in re.split(_TOKENS, text.lower(), flags=re.ASCII) if w]


def condition(query: dict[str, Any], field: Field = F.col) -> Column:
    """A query clause as a condition; ``field`` gives the column of a name."""
    (kind, body), = query.items()
    if kind == "match_all":
        return F.lit(True)
    if kind == "match_none":
        return F.lit(False)
    if kind == "bool":
        return _bool(body, field)
    if kind == "constant_score":
        return condition(body["filter"], field)
    if kind == "nested":  # some element of the array meets the whole query
        inner = body["path"] + "."
        return F.coalesce(F.exists(field(body["path"]), lambda x: F.coalesce(condition(body["query"], lambda name: x[name.removeprefix(inner)]), F.lit(False))), F.lit(False))
    if kind == "has_child":
        raise ValueError("has_child needs its children: give them to search()")
    if kind == "ids":
        return field("_id").isin(body["values"])
    if kind == "exists":
        return field(body["field"]).isNotNull()
    if kind == "multi_match":
        return reduce(lambda a, b: a | b, [F.coalesce(condition({"match": {name: body["query"]}}, field), F.lit(False)) for name in body["fields"]])
    if kind == "geo_distance":
        (name, value), = ((k, v) for k, v in body.items() if k not in ("distance", "distance_type", "boost"))
        return haversine(field(name)["lat"], field(name)["lon"], F.lit(value["lat"]), F.lit(value["lon"])) <= _kilometres(body["distance"])
    (name, value), = ((k, v) for k, v in body.items() if k != "boost")
    column = field(name)
    if kind == "term":
        return column == F.lit(value["value"] if isinstance(value, dict) else value)
    if kind == "terms":
        return column.isin(value)
    if kind == "range":
        return _range(column, value)
    if kind == "prefix":
        return column.startswith(value["value"] if isinstance(value, dict) else value)
    if kind == "wildcard":
        text = value["value"] if isinstance(value, dict) else value
        return column.rlike("^" + fnmatch.translate(text).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z") + "$")
    if kind == "regexp":
        return column.rlike(f"^(?:{value['value'] if isinstance(value, dict) else value})$")
    if kind == "fuzzy":
        text = value["value"] if isinstance(value, dict) else value
        return F.levenshtein(column, F.lit(text)) <= int(value.get("fuzziness", 2) if isinstance(value, dict) else 2)
    if kind in ("match", "match_phrase", "match_phrase_prefix", "match_bool_prefix"):
        words = _words(value["query"] if isinstance(value, dict) else value)
        if not words:
            return F.lit(False)
        if kind == "match_phrase":
            return _line(column).contains(f" {' '.join(words)} ")
        if kind == "match_phrase_prefix":
            return _line(column).contains(f" {' '.join(words)}")
        every = isinstance(value, dict) and value.get("operator", "or").lower() == "and"
        hits = [F.array_contains(_tokens(column), w) for w in words]
        if kind == "match_bool_prefix":
            hits[-1] = _line(column).contains(f" {words[-1]}")
        return reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), hits)
    if kind == "geo_bounding_box":
        first, last = value["top_left"], value["bottom_right"]
        return column["lat"].between(last["lat"], first["lat"]) & column["lon"].between(first["lon"], last["lon"])
    raise ValueError(f"{kind} is not supported")


#: Kilometres of each unit of length.
UNITS = {"m": 0.001, "km": 1.0, "mi": 1.609344, "yd": 0.0009144, "ft": 0.0003048, "nmi": 1.852}


def _kilometres(distance: str) -> float:
    m = re.fullmatch(r"\s*([\d.]+)\s*([a-z]*)\s*", distance)
    if not m or (m[2] or "m") not in UNITS:
        raise ValueError(f"{distance} is no distance")
    return float(m[1]) * UNITS[m[2] or "m"]


def _range(column: Column, value: dict[str, Any]) -> Column:
    """Bounds by gt, gte, lt and lte, or by from and to, which count unless include_lower and include_upper say no."""
    if unknown := value.keys() - {"gt", "gte", "lt", "lte", "from", "to"} - _RANGE_WORDS:
        raise ValueError(f"a range has no {', '.join(sorted(unknown))}")
    bounds = dict(value)
    if bounds.get("from") is not None:
        bounds["gte" if value.get("include_lower", True) else "gt"] = bounds["from"]
    if bounds.get("to") is not None:
        bounds["lte" if value.get("include_upper", True) else "lt"] = bounds["to"]
    compare = {"gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}
    parts = [getattr(column, how)(F.lit(bounds[word])) for word, how in compare.items() if bounds.get(word) is not None]
    return reduce(lambda a, b: a & b, parts) if parts else column.isNotNull()


def _bool(body: dict[str, Any], field: Field) -> Column:
    clauses = lambda name: [condition(q, field) for q in (body.get(name) if isinstance(body.get(name), list) else [body[name]] if name in body else [])]
    parts = clauses("must") + clauses("filter") + [~F.coalesce(c, F.lit(False)) for c in clauses("must_not")]
    if should := clauses("should"):
        least = int(body.get("minimum_should_match", 0 if parts else 1))
        if least:
            parts.append(reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(False)).cast("int") for c in should]) >= least)
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def _with_children(df: DataFrame, node: Any, children: dict[str, tuple[DataFrame, str, str]], marks: list[str]) -> tuple[DataFrame, Any]:
    """``df`` with a mark for each has_child clause, and the clauses as tests of their marks."""
    if isinstance(node, list):
        out = []
        for x in node:
            df, made = _with_children(df, x, children, marks)
            out.append(made)
        return df, out
    if not isinstance(node, dict):
        return df, node
    if "has_child" in node:
        body, mark = node["has_child"], f"__child_{len(marks)}"
        marks.append(mark)
        child, key, own = children[body["type"]]
        found = child.where(condition(body["query"])).select(F.col(key).alias(f"{mark}_key")).distinct().withColumn(mark, F.lit(True))
        return df.join(found, F.col(own) == F.col(f"{mark}_key"), "left"), {"exists": {"field": mark}}
    out = {}
    for k, x in node.items():
        df, out[k] = _with_children(df, x, children, marks)
    return df, out


def search(df: DataFrame, body: dict[str, Any], children: dict[str, tuple[DataFrame, str, str]] | None = None) -> DataFrame:
    """The hits of a request: query, ``_source`` filter, sort, from and size.

    ``children``: of each child type its rows, their column that names the parent, and the parent's column that it names.
    """
    marks: list[str] = []
    out = df
    if "query" in body:
        out, query = _with_children(df, body["query"], children or {}, marks)
        out = out.where(condition(query)).drop(*(x for mark in marks for x in (mark, f"{mark}_key")))
    order = []
    for item in body.get("sort", []):
        name, how = (item, "asc") if isinstance(item, str) else next(iter(item.items()))
        how = how if isinstance(how, str) else how.get("order", "asc")
        order.append(F.desc_nulls_last(name) if how == "desc" else F.asc_nulls_last(name))
    out = out.orderBy(*order) if order else out
    if body.get("from"):
        out = out.offset(body["from"])
    out = out.limit(body.get("size", 10))
    source = body.get("_source")
    if isinstance(source, dict):
        keep = [c for c in df.columns if any(fnmatch.fnmatch(c, p) for p in source.get("includes", ["*"])) and not any(fnmatch.fnmatch(c, p) for p in source.get("excludes", []))]
        return out.select(*keep)
    return out.select(*source) if isinstance(source, list) else out


def terms(df: DataFrame, body: dict[str, Any], field: str, metrics: dict[str, Column] | None = None) -> DataFrame:
    """A terms aggregation: ``key``, ``doc_count`` and metrics."""
    out = df.where(condition(body["query"])) if "query" in body else df
    return out.groupBy(F.col(field).alias("key")).agg(F.count(F.lit(1)).alias("doc_count"), *(v.alias(k) for k, v in (metrics or {}).items()))


#: Parts of a request from which values could leak past masked fields.
BLOCKED = ("aggs", "aggregations", "suggest", "script_fields", "runtime_mappings", "highlight", "collapse")


def analysed(body: dict[str, Any]) -> dict[str, Any]:
    """What a request asks for: blocked features, fields, sort fields and predicate fields."""
    fields: set[str] = set()

    def visit(node: Any) -> None:
        if isinstance(node, list):
            for x in node:
                visit(x)
        elif isinstance(node, dict):
            for kind, inner in node.items():
                if kind in ("bool", "must", "must_not", "should", "filter", "nested", "query", "constant_score"):
                    visit(inner)
                elif kind == "exists":
                    fields.add(inner["field"])
                elif isinstance(inner, dict):
                    fields.update(k for k in inner if k != "boost")

    visit(body.get("query", {}))
    source = body.get("_source")
    return {"blocked": [k for k in BLOCKED if k in body], "source": source if isinstance(source, list) else (source or {}).get("includes", []) if isinstance(source, dict) else [], "sort": [s if isinstance(s, str) else next(iter(s)) for s in body.get("sort", [])], "predicates": sorted(fields)}

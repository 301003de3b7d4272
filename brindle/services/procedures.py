"""Stored procedures: Python functions that ``CALL`` runs by their names."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Procedure = Callable[..., DataFrame]
_PARTS = re.compile(r"'(?:[^']|'')*'|[(\[{]|[)\]}]|,")


def arguments(text: str) -> list[str]:
    """The arguments of a call, cut at the commas outside of quotes and brackets."""
    out, depth, begin = [], 0, 0
    for m in _PARTS.finditer(text):
        if m[0] in "([{":
            depth += 1
        elif m[0] in ")]}":
            depth -= 1
        elif m[0] == "," and depth == 0:
            out.append(text[begin : m.start()].strip())
            begin = m.end()
    last = text[begin:].strip()
    return out + [last] if last else out


class Procedures:
    """The procedures that a session knows."""

    def __init__(self, spark: SparkSession):
        self.spark, self.known = spark, {}

    def add(self, name: str, procedure: Procedure) -> None:
        self.known[name.lower()] = procedure

    def call(self, statement: str) -> DataFrame:
        """Run ``CALL name(1, 'x', size => 2)``; arguments are SQL expressions."""
        m = re.fullmatch(r"\s*CALL\s+([\w.]+)\s*(?:\((.*)\))?\s*;?\s*", statement, re.I | re.S)
        if not m:
            raise ValueError(f"no call: {statement}")
        if m[1].lower() not in self.known:
            raise ValueError(f"no procedure is named {m[1]}")
        given = [re.fullmatch(r"(?:(\w+)\s*=>\s*)?(.*)", a, re.S).groups() for a in arguments(m[2] or "")]
        values = list(self.spark.sql("SELECT " + ", ".join(f"{x} AS a{k}" for k, (_, x) in enumerate(given))).first()) if given else []
        plain = [v for (name, _), v in zip(given, values) if not name]
        return self.known[m[1].lower()](*plain, **{name: v for (name, _), v in zip(given, values) if name})

"""Row-pattern matching over ordered partitions.

A pattern is compiled once to a backtracking matcher over the rows of one partition; the conditions of its variables are
computed beforehand in the JVM as boolean columns (with ``lag``/``lead`` for neighbours), so Python only walks flags.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(\{\s*\d*\s*,?\s*\d*\s*\}|[A-Za-z_]\w*|[()|*+?^$])")


def parse(pattern: str):
    """A pattern as a tree: ("var", name), ("cat", parts), ("alt", parts), ("rep", part, least, most, greedy), ("start",), ("end",)."""
    tokens, at = [], 0
    pattern = pattern.strip()
    while at < len(pattern):
        if not (m := _TOKEN.match(pattern, at)):
            raise ValueError(f"the pattern cannot be read from {pattern[at:]!r}")
        tokens.append(m[1].replace(" ", ""))
        at = m.end()
        while at < len(pattern) and pattern[at].isspace():
            at += 1
    place = 0

    def peek() -> str:
        return tokens[place] if place < len(tokens) else ""

    def alternatives():
        nonlocal place
        parts = [sequence()]
        while peek() == "|":
            place += 1
            parts.append(sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence():
        parts = []
        while peek() not in ("", "|", ")"):
            parts.append(repeated())
        return ("cat", parts)

    def repeated():
        nonlocal place
        token = peek()
        place += 1
        if token == "(":
            node = alternatives()
            if peek() != ")":
                raise ValueError("a bracket is not closed")
            place += 1
        elif token in ("^", "$"):
            return ("start",) if token == "^" else ("end",)
        elif re.match(r"[A-Za-z_]", token):
            node = ("var", token)
        else:
            raise ValueError(f"{token!r} has nothing to repeat")
        token = peek()
        if token in ("*", "+", "?") or token.startswith("{"):
            place += 1
            if token.startswith("{"):
                low, comma, high = token[1:-1].partition(",")
                least, most = int(low or 0), (int(high) if high else None if comma else int(low))
            else:
                least, most = {"*": (0, None), "+": (1, None), "?": (0, 1)}[token]
            lazy = peek() == "?"
            place += lazy
            node = ("rep", node, least, most, not lazy)
        return node

    tree = alternatives()
    if place != len(tokens):
        raise ValueError("a bracket is closed that was not opened")
    return tree


def matcher(tree) -> Callable[[dict[str, list[bool]], int, int], list[tuple[int, str]] | None]:
    """A function of flags by variable, start and row count that gives the matched (row, variable)s or none."""

    def step(node, flags, n, at, path, then):
        kind = node[0]
        if kind == "var":
            return then(at + 1, (path, (at, node[1]))) if at < n and flags[node[1]][at] else None
        if kind == "start":
            return then(at, path) if at == 0 else None
        if kind == "end":
            return then(at, path) if at == n else None
        if kind == "cat":
            def run(k, at, path):
                return then(at, path) if k == len(node[1]) else step(node[1][k], flags, n, at, path, lambda a, p: run(k + 1, a, p))

            return run(0, at, path)
        if kind == "alt":
            for part in node[1]:
                if (found := step(part, flags, n, at, path, then)) is not None:
                    return found
            return None
        _, part, least, most, greedy = node
        if part[0] == "var":  # a run of one variable needs no recursion
            run, flag = 0, flags[part[1]]
            while at + run < n and flag[at + run] and (most is None or run < most):
                run += 1
            for k in range(run, least - 1, -1) if greedy else range(least, run + 1):
                longer = path
                for j in range(k):
                    longer = (longer, (at + j, part[1]))
                if (found := then(at + k, longer)) is not None:
                    return found
            return None

        def again(count, at, path):
            more = lambda: step(part, flags, n, at, path, lambda a, p: again(count + 1, a, p) if a > at or count < least else None) if most is None or count < most else None
            done = lambda: then(at, path) if count >= least else None
            for option in (more, done) if greedy else (done, more):
                if (found := option()) is not None:
                    return found
            return None

        return again(0, at, path)

    def find(flags, start, n):
        found = step(tree, flags, n, start, None, lambda at, path: (path,))
        if found is None:
            return None
        rows, path = [], found[0]
        while path is not None:
            path, last = path
            rows.append(last)
        return rows[::-1]

    return find


def match_recognize(df: DataFrame, partition: list[str], order: list[Column], pattern: str, define: dict[str, Column], after: str = "past last row", all_rows: bool = False) -> DataFrame:
    """Every matched row with ``match_number``, ``match_variable`` and ``match_row`` (from 1); an empty match gives no row.

    Conditions in ``define`` are columns over the row and, by window functions over ``window(partition, order)``, its
    neighbours; variables without one match every row. ``after``: ``past last row`` or ``to next row``. With
    ``all_rows`` rows outside of matches come too, with nulls. Measures are aggregates over the result.
    """
    if after not in ("past last row", "to next row"):
        raise ValueError("skipping goes past the last row or to the next row")
    names = sorted(set(re.findall(r"[A-Za-z_]\w*", pattern)))
    flags = df.withColumns({f"__f_{v}": F.coalesce(define.get(v, F.lit(True)), F.lit(False)) for v in names})
    flags = flags.withColumn("__n", F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", match_number long, match_variable string, match_row long"
    find, columns = matcher(parse(pattern)), df.columns

    def matched(rows: pd.DataFrame) -> pd.DataFrame:
        """Matches in whole partitions, one after the other."""
        whole = {v: rows[f"__f_{v}"].tolist() for v in names}
        starts = np.append(np.flatnonzero(rows["__n"].to_numpy() == 1), len(rows))
        picked = []
        for first, end in zip(starts.tolist(), starts[1:].tolist()):
            held = {v: flags[first:end] for v, flags in whole.items()}
            n, at, number = end - first, 0, 0
            while at < n:
                found = find(held, at, n)
                if not found:
                    at += 1
                    continue
                number += 1
                picked += [(first + row, number, v, k) for k, (row, v) in enumerate(found, 1)]
                at = found[-1][0] + 1 if after == "past last row" else at + 1
        out = rows.iloc[[p[0] for p in picked]][columns].copy()
        out["match_number"], out["match_variable"], out["match_row"] = [p[1] for p in picked], [p[2] for p in picked], [p[3] for p in picked]
        if all_rows:
            rest = rows.drop(rows.index[sorted({p[0] for p in picked})])[columns].assign(match_number=None, match_variable=None, match_row=None)
            out = pd.concat([out, rest]) if len(rest) else out
        return out.astype({"match_number": "Int64", "match_variable": object, "match_row": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The window leaves each partition's rows together and in order: number 1 starts the next, so no further shuffle."""
        open_: list[pd.DataFrame] = []
        for batch in batches:
            last = np.flatnonzero(batch["__n"].to_numpy() == 1)
            if open_ and len(last):
                done = pd.concat([*open_, batch.iloc[: last[-1]]], ignore_index=True)
                open_ = [batch.iloc[last[-1] :]]
                yield matched(done)
            elif len(last) and last[-1]:
                yield matched(batch.iloc[: last[-1]].reset_index(drop=True))
                open_ = [batch.iloc[last[-1] :]]
            else:
                open_.append(batch)
        if open_:
            yield matched(pd.concat(open_, ignore_index=True))

    return flags.mapInPandas(run, kind)

"""Graph patterns over a table of nodes and a table of edges."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import checkpointed

#: The edge patterns, and which edges each follows: to the right, to the left, undirected.
DIRECTIONS = {"->": "r", "<-": "l", "~": "u", "<~": "lu", "~>": "ru", "<->": "rl", "-": "rlu"}
RESTRICTORS = (None, "trail", "acyclic", "simple")
SELECTORS = (None, "any", "any shortest", "all shortest")
_EDGE = re.compile(r"(<?[-~])(?:\[\s*\w*\s*(?::\s*(\w+))?\s*\]([-~]>?)|(>?))(?:\{\s*(\d*)\s*(,?)\s*(\d*)\s*\}|([*+?]))?")
_NODE = re.compile(r"\s*\(\s*\w*\s*\)\s*")
_PATH = "start", "__at", "end", "nodes", "edges"


@dataclass(frozen=True)
class Step:
    """An edge pattern: its direction, the edge's label if it must have one, and how often it repeats (``most`` None: any number)."""

    direction: str = "->"
    label: str | None = None
    least: int = 1
    most: int | None = 1


def parse(pattern: str) -> list[Step]:
    """The steps of a path pattern, as ``(a)-[e:label]->{1,3}(b)~(c)``."""
    node = _NODE.match(pattern)
    if not node:
        raise ValueError(f"a path starts with a node: {pattern}")
    at, steps = node.end(), []
    while at < len(pattern):
        edge = _EDGE.match(pattern, at)
        node = edge and _NODE.match(pattern, edge.end())
        if not node:
            raise ValueError(f"no edge and node at place {at} of {pattern}")
        left, label, right, arrow, least, comma, most, sign = edge.groups()
        direction = left + ((right or "")[1:] if right else arrow)
        if direction not in DIRECTIONS or right and right[0] != left[-1]:
            raise ValueError(f"{direction} is no edge pattern")
        if sign:
            times = {"*": (0, None), "+": (1, None), "?": (0, 1)}[sign]
        elif least is None:
            times = (1, 1)
        else:
            times = (int(least or 0), (int(most) if most else None) if comma else int(least))
        steps.append(Step(direction, label, *times))
        at = node.end()
    return steps


def _moves(edges: DataFrame, step: Step) -> DataFrame:
    """(``__edge``, ``__from``, ``__to``): the moves that a step allows; an edge from a node to itself is one move."""
    kinds = DIRECTIONS[step.direction]
    edges = edges.where("source IS NOT NULL AND target IS NOT NULL")
    edges = edges.where(F.col("label") == step.label) if step.label else edges
    directed, turned = F.coalesce(F.col("directed"), F.lit(True)), F.col("source") != F.col("target")
    move = lambda rows, a, b: rows.select(F.col("edge").alias("__edge"), F.col(a).alias("__from"), F.col(b).alias("__to"))
    parts = []
    if "r" in kinds:
        parts.append(move(edges.where(directed), "source", "target"))
    if "l" in kinds:
        parts.append(move(edges.where(directed & turned if "r" in kinds else directed), "target", "source"))
    if "u" in kinds:
        parts += [move(edges.where(~directed), "source", "target"), move(edges.where(~directed & turned), "target", "source")]
    return reduce(DataFrame.unionByName, parts)


def _allowed(restrictor: str | None) -> Column:
    """Whether a path may go on by a move."""
    if restrictor == "trail":
        return ~F.array_contains("edges", F.col("__edge"))
    if restrictor == "acyclic":
        return ~F.array_contains("nodes", F.col("__to"))
    if restrictor == "simple":  # only a path's end may be its start, and there it ends
        closed = (F.size("edges") > 0) & (F.col("start") == F.col("end"))
        return ~closed & (~F.array_contains("nodes", F.col("__to")) | (F.col("__to") == F.col("start")))
    return F.lit(True)


def _longer(paths: DataFrame, moves: DataFrame, restrictor: str | None) -> DataFrame:
    grown = paths.join(moves, F.col("end") == F.col("__from")).where(_allowed(restrictor))
    return grown.select("start", "__at", F.col("__to").alias("end"), F.concat("nodes", F.array("__to")).alias("nodes"), F.concat("edges", F.array("__edge")).alias("edges"))


def _one(paths: DataFrame, *keys: str) -> DataFrame:
    """The shortest path of each key, the least among equals."""
    best = paths.groupBy(*keys).agg(F.min(F.struct(F.size("edges").alias("n"), "nodes", "edges")).alias("best"))
    return best.select(*keys, "best.nodes", "best.edges")


def match(nodes: DataFrame, edges: DataFrame, pattern: str | list[Step], restrictor: str | None = None, selector: str | None = None) -> DataFrame:
    """The paths of a pattern: ``start``, ``end``, ``nodes`` and ``edges`` in their order, and ``length``.

    ``nodes``: ``node``; ``edges``: ``edge``, ``source``, ``target``, ``directed`` and, for labels, ``label``. A restrictor
    forbids repeated edges (trail), nodes (acyclic), or nodes but for the start at the end (simple). A selector keeps for
    each start and end one path (any: one of the shortest) or all shortest ones. A repetition without a bound needs one of
    the two, so that it ends. Its rounds and those of other repetitions are checkpointed; with a selector and no restrictor
    a round goes on only from nodes that it reaches for the first time. Null nodes and ends of edges join nothing; no
    nodes or no edges give no paths but the empty ones of patterns that allow them.
    """
    if restrictor not in RESTRICTORS or selector not in SELECTORS:
        raise ValueError(f"{restrictor}, {selector}")
    steps = parse(pattern) if isinstance(pattern, str) else pattern
    ids = nodes.select(F.col("node").alias("start")).where("start IS NOT NULL")
    hop = edges.select("edge").schema["edge"].dataType.simpleString()
    paths = ids.select("start", F.col("start").alias("__at"), F.col("start").alias("end"), F.array("start").alias("nodes"), F.expr(f"CAST(array() AS array<{hop}>)").alias("edges"))
    for step in steps:
        paths = _stepped(paths, _moves(edges, step), step, restrictor, selector)
    out = paths.select("start", "end", "nodes", "edges")
    if selector == "all shortest":
        order = Window.partitionBy("start", "end").orderBy(F.size("edges"))
        out = out.withColumn("__rank", F.rank().over(order)).where("__rank = 1").drop("__rank")
    elif selector:
        out = _one(out, "start", "end")
    return out.withColumn("length", F.size("edges"))


def _stepped(paths: DataFrame, moves: DataFrame, step: Step, restrictor: str | None, selector: str | None) -> DataFrame:
    front = paths.withColumn("__at", F.col("end"))
    if (step.least, step.most) == (1, 1):
        return _longer(front, moves, restrictor)
    if step.most is None and not (restrictor or selector):
        raise ValueError("a repetition without a bound needs a restrictor or a selector")
    prune, key = selector and not restrictor, ["start", "__at", "end"]
    front, moves = checkpointed(front), checkpointed(moves)
    found, seen, k = [front] if step.least == 0 else [], None, 0
    while True:
        if prune and k >= step.least:
            reached = front.select(*key).distinct()
            seen = checkpointed(reached if seen is None else seen.unionByName(reached))
        if k == step.most:
            break
        k += 1
        front = _longer(front, moves, restrictor)
        if prune:
            front = front if seen is None else front.join(seen, key, "left_anti")
            front = front if selector == "all shortest" else _one(front, *key).select(*_PATH)
        front = checkpointed(front)
        if front.isEmpty():
            break
        if k >= step.least:
            found.append(front)
    return reduce(DataFrame.unionByName, found) if found else front

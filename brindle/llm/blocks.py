"""A stated query set against all vectors, in blocks: both searches build an index per block and answer query groups.

Rows are dealt into blocks by the hash of their id, so that no cell or common vector makes a block large. Every block's
index is built once and kept as one row of a table in the shared folder; queries are packed into groups. Each pair of
block and group is one row for a Python worker, whose few best then meet in one ranking per query.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_parts, written

#: Rows that make a block of their own while there are fewer blocks than cores.
LEAST_ROWS = 4096


def vectors(table: DataFrame, id_column: str, vector: str, zero: bool) -> DataFrame:
    """(``id``, ``vec``) of the rows that take part: of the most usual size, all components finite, and not zero unless ``zero``."""
    rows = table.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0")
    finite = rows.where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    if not zero:
        finite = finite.where(F.exists("vec", lambda x: x != 0))
    usual = finite.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return finite.where(F.size("vec") == (usual["n"] if usual else 0))


def distinct(ids: np.ndarray, vecs: np.ndarray, most: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct vectors, by their least id, and the ``most`` least ids of each: more equal ones are never asked for."""
    order = np.argsort(ids, kind="stable")
    ids, vecs = ids[order], np.ascontiguousarray(vecs[order]) + 0.0
    keys = vecs.view(np.dtype((np.void, vecs.dtype.itemsize * vecs.shape[1]))).ravel()
    _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    by = np.argsort(inverse, kind="stable")
    cuts = np.searchsorted(inverse[by], np.arange(len(first) + 1))
    rank = np.argsort(ids[first], kind="stable")
    return vecs[first[rank]], [ids[by[cuts[r] : min(cuts[r + 1], cuts[r] + most)]] for r in rank]


class Leaves:
    """Vectors in leaves; a query visits leaves in its own order, in rounds, until its stop rule holds."""

    def __init__(self, members: np.ndarray, vecs: np.ndarray):
        """``members``: (leaves, size) rows of ``vecs``, -1 where a leaf is short."""
        self.members, self.vecs = members, vecs

    def search(self, queries: np.ndarray, bounds: np.ndarray, k: int, done: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], step: int = 8) -> tuple[list[np.ndarray], np.ndarray]:
        """Per query the rows of its ``k`` best found, and the number of verified vectors.

        ``bounds``: (queries, leaves), leaves with the lowest first. ``done(queries, next bound, k-th best product)`` says
        which queries stop.
        """
        n, leaves = bounds.shape
        order = np.argsort(bounds, axis=1, kind="stable")
        sorted_bounds = np.take_along_axis(bounds, order, axis=1)
        best = np.full((n, k), -np.inf)
        rows = np.full((n, k), -1)
        seen = np.zeros(n, np.int64)
        live, at = np.arange(n), 0
        while len(live) and at < leaves:
            for some in np.array_split(live, max(1, len(live) // 32)):
                cand = self.members[order[some, at : at + step]].reshape(len(some), -1)
                there = cand >= 0
                product = np.matmul(self.vecs[cand], queries[some][:, :, None])[:, :, 0]
                product[~there] = -np.inf
                seen[some] += there.sum(axis=1)
                both, names = np.concatenate([best[some], product], axis=1), np.concatenate([rows[some], cand], axis=1)
                top = np.argpartition(-both, k - 1, axis=1)[:, :k]
                edge = np.take_along_axis(both, top, axis=1).min(axis=1, keepdims=True)
                for q in np.flatnonzero(((both == edge).sum(axis=1) > (np.take_along_axis(both, top, axis=1) == edge).sum(axis=1)) & (edge[:, 0] > -np.inf)):
                    top[q] = np.lexsort((names[q], -both[q]))[:k]  # of ties those with the smaller ids
                best[some], rows[some] = np.take_along_axis(both, top, axis=1), np.take_along_axis(names, top, axis=1)
            at += step
            if at < leaves:
                live = live[~done(live, sorted_bounds[live, at], best[live].min(axis=1))]
        return [r[b > -np.inf] for r, b in zip(rows, best)], seen


def chunked(order: np.ndarray, cuts: np.ndarray, size: int) -> np.ndarray:
    """Leaves of at most ``size`` of the rows in ``order``, none across ``cuts``."""
    out = []
    for a, b in zip(cuts, cuts[1:]):
        for low in range(a, b, size):
            part = order[low : min(b, low + size)]
            out.append(np.pad(part, (0, size - len(part)), constant_values=-1))
    return np.array(out, np.int64).reshape(-1, size)


def search(rows: DataFrame, every: int, k: int, build: Callable[[np.ndarray, np.ndarray], object], answer: Callable[[object, np.ndarray, np.ndarray], list[tuple[np.ndarray, np.ndarray]]], kind: str, block_rows: int, group_rows: int) -> DataFrame:
    """The ``k`` best (``query_id``, ``rank``, ``vec_id``, ``score``) for the rows whose id ``every`` divides.

    Rows that share such an id ask once, with the least of their vectors. ``build(ids, vectors)`` makes a block's index; ``answer(index, ids, vectors)`` gives ids and scores for each query.
    """
    spark = rows.sparkSession
    n = rows.count()
    parts = shuffle_parts(spark)
    blocks = max(1, -(-n // block_rows), min(parts, -(-n // LEAST_ROWS)))  # a small table is spread over the cores
    groups = max(1, -(-n // every // group_rows))

    def index(key, part: pd.DataFrame) -> pd.DataFrame:
        made = build(part["id"].to_numpy(), np.stack(part["vec"].to_numpy()))
        return pd.DataFrame({"block": [key[0]], "index": [pickle.dumps(made)]})

    def pack(key, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"group": [key[0]], "queries": [pickle.dumps((part["id"].to_numpy(), np.stack(part["vec"].to_numpy())))]})

    dealt = lambda many, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(many)).cast("int")
    indexes = written(rows.groupBy(dealt(blocks, 1).alias("block")).applyInPandas(index, "block int, index binary"), "indexes")
    questions = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("vec").alias("vec"))
    asked = questions.groupBy(dealt(groups, 2).alias("group")).applyInPandas(pack, "group int, queries binary")
    pairs = indexes.select("block", "index", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")).join(asked.hint("shuffle_hash"), "group")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for made, packed in zip(batch["index"], batch["queries"]):
                ids, vecs = pickle.loads(packed)
                found = answer(pickle.loads(made), ids, vecs)
                counts = [len(a) for a, _ in found]
                yield pd.DataFrame({"query_id": np.repeat(ids, counts), "vec_id": np.concatenate([a for a, _ in found]).astype(np.int64), "score": np.concatenate([b for _, b in found])})

    spread = pairs.repartition(max(parts, min(blocks * groups, 8 * parts)), "block", "group") if blocks * groups > 1 else pairs
    near = spread.select("index", "queries").mapInPandas(find, f"query_id long, vec_id long, score {kind}")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def expand(found: list[np.ndarray], own: np.ndarray, ids: list[np.ndarray], score: Callable[[int, np.ndarray], np.ndarray], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids and exact scores of each query's ``k`` best: found distinct vectors with their ids, without the query's own."""
    out = []
    for q, rows in enumerate(found):
        values = score(q, rows)
        many = [ids[r] for r in rows]
        names = np.concatenate(many) if many else np.zeros(0, np.int64)
        values = np.repeat(values, [len(m) for m in many])
        other = names != own[q]
        names, values = names[other], values[other]
        order = np.lexsort((names, -values))[:k]
        out.append((names[order], values[order]))
    return out

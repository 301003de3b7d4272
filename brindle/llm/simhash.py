"""SimHash near-duplicate groups through an inverted index over byte positions.

A fingerprint has 64 bits in 8 positional bytes. Two fingerprints that differ in at most ``max_bits`` bits differ in at
most ``max_bits`` of the bytes, so they share at least ``8 - max_bits`` positional bytes. The index posts every distinct
fingerprint under *groups* of positions. With four differing bits a pair shares at least 4 of the 8 bytes; the positions
fall into 3 blocks (0-2, 3-5, 6-7), so two shared positions lie in one block, and posting each fingerprint under the
7 position pairs inside the blocks meets every such pair at least once. In a posting list the shared positional bytes of
each pair are tallied, pairs below the guaranteed minimum go, and the rest is verified on the bits.

Posting lists longer than ``tile`` are cut into tiles that are compared two at a time in separate tasks, so that no task
holds an unbounded list. A task emits a spanning forest of the links that it finds, not the links, so what is emitted
grows with the fingerprints and not with the square of a group. Components come from alternating minimum-neighbour
steps over tables in the shared folder.

Nulls: a null text is an empty one. Texts without words have fingerprint zero, which links like any other. Rows with a
null id take part in the linking; an id that is null never names a component unless all ids of the component are null.
Repeated rows share a fingerprint and come back repeated. An empty table gives no rows. Only the id and the text column
are read, so further columns can have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, shuffle_parts, written

WORDS = 4
MAX_BITS = 4
TILE = 4096
HASH_SEED = 42
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprints(texts: list[str | None], words: int = WORDS) -> np.ndarray:
    """The SimHash of every text: a bit is set if it is set in more than half of the shingle hashes."""
    from xxhash import xxh64_intdigest

    out = np.zeros(len(texts), np.uint64)
    for at, text in enumerate(texts):
        tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not tokens:
            continue
        if len(tokens) <= words:
            out[at] = xxh64_intdigest(b" ".join(tokens), HASH_SEED)
            continue
        line = b" ".join(tokens)
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
        starts = [0, *ends[:-words].tolist()]
        hashes = np.fromiter((xxh64_intdigest(line[a:b], HASH_SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())), np.uint64, len(starts))
        n = len(hashes)
        if n < 400:
            ones = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1).sum(axis=0, dtype=np.int64)
        else:
            parts = hashes.view(np.uint8).reshape(n, 8)
            ones = np.concatenate([np.bincount(parts[:, k], minlength=256) @ _BITS for k in range(8)])
        out[at] = np.packbits(ones * 2 > n).view(np.uint64)[0]
    return out


def fingerprint(text: Column, words: int = WORDS) -> Column:
    """The fingerprint of a text column as a signed 64-bit integer with the same bits."""

    @F.pandas_udf("long")
    def simhash(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(fingerprints([x if isinstance(x, str) else None for x in part], words).view(np.int64))

    return simhash(text)


def _blocks(max_bits: int) -> list[tuple[int, ...]]:
    """Groups of positions such that sharing ``8 - max_bits`` positions means to share all of some group."""
    shared = 8 - max_bits
    if shared < 1:
        raise ValueError("fingerprints that may differ in every byte share nothing to index")
    if shared < 4:
        return [(k,) for k in range(8)]
    return [(a, b) for block in ((0, 1, 2), (3, 4, 5), (6, 7)) for i, a in enumerate(block) for b in block[i + 1 :]]


def _forest(left: np.ndarray, right: np.ndarray | None, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as stars around each component's least member, of the links within ``left`` or across both."""
    nodes = left if right is None else np.concatenate([left, right])
    root = np.arange(len(nodes))
    split, step = len(left), 256
    other = left if right is None else right
    bytes_of = np.ascontiguousarray(other.view(np.uint8).reshape(-1, 8).T)
    for at in range(0, len(left), step):
        mine = left[at : at + step]
        low = at if right is None else 0
        own = mine.view(np.uint8).reshape(-1, 8)
        shared = np.zeros((len(mine), len(other) - low), np.uint8)
        for k in range(8):  # the tally of shared positional bytes
            shared += own[:, k, None] == bytes_of[k][None, low:]
        rows, cols = np.nonzero(shared >= 8 - max_bits)
        cols += low
        near = np.bitwise_count(mine[rows] ^ other[cols]) <= max_bits
        rows, cols = rows[near] + at, cols[near] + (0 if right is None else split)
        while True:  # all links of the step at once: the higher root goes below the lower one
            a, b = root[rows], root[cols]
            apart = a != b
            if not apart.any():
                break
            rows, cols, a, b = rows[apart], cols[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (up := root[root]).tobytes() != root.tobytes():
                root = up
    tops = root
    inner = np.nonzero(tops != np.arange(len(nodes)))[0]
    return nodes[inner].view(np.int64), nodes[tops[inner]].view(np.int64)


def links(distinct: DataFrame, max_bits: int = MAX_BITS, tile: int = TILE) -> DataFrame:
    """Links (``a``, ``b``) that connect exactly what all pairs of the distinct fingerprints ``fp`` would connect."""
    spark = distinct.sparkSession
    groups = _blocks(max_bits)
    byte = lambda k: F.shiftrightunsigned("fp", 8 * k).bitwiseAND(255)
    keys = [F.lit(g << 16) + sum((byte(k) * (256**i) for i, k in enumerate(ks)), F.lit(0)) for g, ks in enumerate(groups)]
    posted = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = posted.groupBy("key").count().where(F.col("count") > 1)
    long_lists = written(sizes.where(F.col("count") > tile), "long")
    # short lists: many to a task
    parts = shuffle_parts(spark)
    schema = "a long, b long"

    def short(rows: pd.DataFrame) -> pd.DataFrame:
        """All short posting lists of one range of keys."""
        rows = rows.sort_values(["key", "fp"])
        fps, key = rows["fp"].to_numpy().view(np.uint64), rows["key"].to_numpy()
        cuts = np.flatnonzero(np.diff(key)) + 1
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
        size = ends - starts
        for n in np.unique(size[(size > 1) & (size <= 24)]):  # equal lengths together
            at = starts[size == n]
            for block in np.array_split(at, max(1, len(at) * int(n) // 200_000)):
                lists = fps[block[:, None] + np.arange(n)]
                for i in range(1, n):
                    for j in range(i):
                        x, y = lists[:, i], lists[:, j]
                        apart = x ^ y
                        tally = (apart.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
                        near = np.flatnonzero(tally >= 8 - max_bits)
                        near = near[np.bitwise_count(apart[near]) <= max_bits]
                        if len(near):
                            a.append(x[near].view(np.int64))
                            b.append(y[near].view(np.int64))
        for i in np.flatnonzero(size > 24):
            x, y = _forest(fps[starts[i] : ends[i]], None, max_bits)
            a.append(x)
            b.append(y)
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}).drop_duplicates()

    def tiled(key, rows: pd.DataFrame) -> pd.DataFrame:
        first, second = key[1], key[2]
        mine = rows.loc[rows["tile"] == first, "fp"].to_numpy().view(np.uint64)
        rest = None if first == second else rows.loc[rows["tile"] == second, "fp"].to_numpy().view(np.uint64)
        x, y = _forest(mine, rest, max_bits)
        return pd.DataFrame({"a": x, "b": y})

    ranges = F.pmod(F.xxhash64("key"), F.lit(parts * 4)).cast("int").alias("range")
    light = posted.join(long_lists.select("key"), "key", "left_anti")
    found = light.select("fp", "key", ranges).groupBy("range").applyInPandas(short, schema)
    tiles = F.ceil(F.col("count") / tile).cast("int")
    heavy = posted.join(long_lists, "key").select("fp", "key", tiles.alias("n"), F.pmod(F.xxhash64("fp"), tiles).cast("int").alias("tile"))
    pairs = heavy.select("key", "tile", "fp", F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.struct(F.least(k, "tile").alias("first"), F.greatest(k, "tile").alias("second")))).alias("pair"))
    pairs = pairs.select("key", "tile", "fp", "pair.first", "pair.second")
    return found.unionByName(pairs.groupBy("key", "first", "second").applyInPandas(tiled, schema))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """The least node (``root``) that each ``node`` of the undirected links (``a``, ``b``) reaches.

    Large-star and small-star steps in turn: each links neighbours to the least node of the neighbourhood. Every round
    is written to the shared folder, so no lineage grows and no executor holds the only copy.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        new = written(small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        sums = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if sums == before:
            return new.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now, before = new, sums
    raise RuntimeError("the components did not settle")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` (the least id that is reachable) of each row."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    marked = grouped(rows, words, max_bits)
    least = written(marked.groupBy("group").agg(F.min("doc_id").alias("component_id")), "least")  # so that the join can split a hot group
    joined = marked.join(least, "group")
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def grouped(rows: DataFrame, words: int, max_bits: int) -> DataFrame:
    """(``doc_id``, ``fp``, ``group``) of rows (``doc_id``, ``text``)."""
    marked = written(rows.select("doc_id", fingerprint(F.col("text"), words).alias("fp")), "fingerprints")
    roots = components(links(marked.select("fp").distinct(), max_bits))
    return marked.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("doc_id", "fp", F.coalesce("root", "fp").alias("group"))


def keep_one(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the least id; of repeated rows, one."""
    row, fp = free_name(docs, "row__"), free_name(docs, "fp__")
    kept = written(docs.withColumns({row: F.monotonically_increasing_id(), fp: fingerprint(F.col(text), words)}), "documents")
    marks = kept.select(F.col(row).alias("row"), F.col(fp).alias("fp"), F.col(id_column).alias("id"))
    roots = components(links(marks.select("fp").distinct(), max_bits))
    named = marks.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("row", "id", F.coalesce("root", "fp").alias("group"))
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row"))
    chosen = written(named.groupBy("group").agg(F.min(order)["row"].alias("first")), "chosen")  # so that the join can split a hot group
    gone = written(named.join(chosen, "group").where("row <> first").select(F.col("row").alias(row)), "gone")
    return kept.join(gone, row, "left_anti").select(*docs.columns)

"""Mixing sources to target weights by hierarchical budgets over a domain-language-source tree.

A budget of tokens is passed down the tree by the children's weights. A child that cannot take its share, because its
leaves hold fewer tokens in all their epochs, takes what it has; what is short goes to its siblings by their weights, and
only what all siblings together cannot take goes to the parent's siblings. A leaf with a budget of b tokens out of a takes
``b // a`` whole epochs and then a prefix of the next one: every epoch has its own order, by a seeded hash of the row, and
the prefix has the rows up to the last that fits.

Finding a prefix needs no sort of a leaf: rows fall into buckets by the leading bits of the hash, sums of buckets name the
one bucket per leaf in which the prefix ends, and only that bucket's rows are summed one by one. What remains is one
threshold per leaf, so that selecting is a filter and no text is shuffled. The leaves (not the rows) are counted on the
driver.

Nulls: a null in a tree column is a leaf of its own, a null text has no tokens, a null id is hashed like a value. Ties:
rows alike in every column have the same hash and come or stay together. Rows without tokens come if the prefix reaches
them. Very long texts that exceed what is left end the prefix. An empty table or a budget of zero gives no rows with
tokens. Columns of the input may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, written

SEED = 17
BUCKET_BITS = 12
TEMPER = 0.7
#: White space between words, as fixed for all word counts here.
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The number of words of a text."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")).cast("long")


@dataclass
class Node:
    """A node of the tree with the tokens that lie below it."""

    tokens: int = 0
    children: dict[str | None, Node] = field(default_factory=dict)


def tree(leaves: dict[tuple, int]) -> Node:
    root = Node()
    for path, tokens in leaves.items():
        node = root
        node.tokens += tokens
        for part in path:
            node = node.children.setdefault(part, Node())
            node.tokens += tokens
    return root


def budgets(leaves: dict[tuple, int], budget: float, weights: dict[tuple, float] | None = None, epochs: int = 1, temper: float = TEMPER) -> dict[tuple, int]:
    """The tokens of each leaf. ``weights`` has those of paths, also of inner nodes; others weigh their tokens to the power ``temper``."""
    weights, out = weights or {}, {}
    if not leaves:
        return out

    def pass_down(node: Node, path: tuple, amount: float) -> None:
        if not node.children:
            out[path] = int(amount + 1e-6)
            return
        weigh = lambda k: float(weights.get((*path, k), node.children[k].tokens ** temper if node.children[k].tokens else 0.0))
        room = {k: child.tokens * epochs for k, child in node.children.items()}
        share, open_, left = dict.fromkeys(node.children, 0.0), {k for k in node.children if room[k] and weigh(k) > 0}, min(amount, sum(room.values()))
        while open_ and left > 1e-9:
            total = sum(weigh(k) for k in open_)
            full = {k for k in open_ if share[k] + left * weigh(k) / total >= room[k]}
            if not full:
                for k in open_:
                    share[k] += left * weigh(k) / total
                break
            for k in full:  # what these cannot take goes to their siblings in the next turn
                left -= room[k] - share[k]
                share[k] = room[k]
            open_ -= full
        for k, child in node.children.items():
            pass_down(child, (*path, k), share[k])

    pass_down(tree(leaves), (), min(budget, epochs * sum(leaves.values())))
    return out


def mix(docs: DataFrame, levels: list[Column], budget: float, weights: dict[tuple, float] | None = None, epochs: int = 1, temper: float = TEMPER, tokens: Column | None = None, id_column: str = "doc_id", text: str = "text", seed: int = SEED, epoch_column: str | None = None, bits: int = BUCKET_BITS) -> DataFrame:
    """``docs`` as mixed: its columns, and ``epoch_column`` if one is named.

    ``levels``: the tree from the root down. ``budget``: tokens, or below or equal to 1 that share of the tokens there are.
    """
    spark = docs.sparkSession
    names = [f"level_{k}" for k in range(len(levels))]
    every = [F.col(f"`{c}`").cast("string") for c in docs.columns]
    tokens = words(F.col(text)) if tokens is None else tokens
    row = F.xxhash64(*every)
    light = written(docs.select(*(x.cast("string").alias(n) for x, n in zip(levels, names)), F.col(id_column).cast("string").alias("ident"), row.alias("tie"), tokens.alias("tokens")), "sizes")
    found = light.groupBy(*names).agg(F.sum("tokens").alias("tokens")).collect()  # a row for each leaf
    leaves = {tuple(r[n] for n in names): int(r["tokens"] or 0) for r in found}
    total = sum(leaves.values())
    given = budgets(leaves, budget * total if budget <= 1 else budget, weights, epochs, temper)
    kind = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField("whole", T.IntegerType()), T.StructField("rest", T.LongType())])
    plan = spark.createDataFrame([(*path, *(divmod(given[path], leaves[path]) if leaves[path] else (min(1, epochs), 0))) for path in leaves], kind)
    # The bucket in which each leaf's prefix ends, then the last row that fits.
    part = light.alias("l").join(plan.alias("p"), _all([F.col(f"l.{n}").eqNullSafe(F.col(f"p.{n}")) for n in names])).select(*(F.col(f"l.{n}").alias(n) for n in names), "tie", "tokens", "whole", "rest", F.xxhash64(F.lit(seed), "whole", "ident").alias("key"))
    part = part.where("rest > 0").withColumn("bucket", F.shiftright("key", 64 - bits))
    by = Window.partitionBy(*names)
    sums = part.groupBy(*names, "bucket", "rest").agg(F.sum("tokens").alias("tokens"))
    running = sums.withColumn("before", F.coalesce(F.sum("tokens").over(by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    edge = running.where("before <= rest AND before + tokens > rest").select(*(F.col(n).alias(f"e_{n}") for n in names), F.col("bucket").alias("e_bucket"), (F.col("rest") - F.col("before")).alias("left"))
    inside = part.join(edge, _all([F.col(n).eqNullSafe(F.col(f"e_{n}")) for n in names]) & (F.col("bucket") == F.col("e_bucket")))
    summed = inside.withColumn("sum", F.sum("tokens").over(by.orderBy("key", "tie").rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    last = summed.groupBy(*names).agg(F.max(F.when(F.col("sum") <= F.col("left"), F.struct("key", "tie"))).alias("last"), F.min("e_bucket").alias("bucket")).collect()  # a row for each leaf
    ends = {tuple(r[n] for n in names): ((r["last"]["key"], r["last"]["tie"]) if r["last"] else ((int(r["bucket"]) << (64 - bits)) - 1 if r["bucket"] > -(1 << (bits - 1)) else -(1 << 63), 2**63 - 1 if r["bucket"] > -(1 << (bits - 1)) else -(1 << 63))) for r in last}
    top = (2**63 - 1, 2**63 - 1)
    new = [free_name(docs, x) for x in ("mix_whole", "mix_key", "mix_tie", *(f"mix_{n}" for n in names))]
    kind = T.StructType([T.StructField(n, T.StringType()) for n in new[3:]] + [T.StructField(new[0], T.IntegerType()), T.StructField(new[1], T.LongType()), T.StructField(new[2], T.LongType())])
    rows = []
    for path in leaves:
        whole, rest = divmod(given[path], leaves[path]) if leaves[path] else (min(1, epochs), 0)
        rows.append((*path, whole, *(ends.get(path, top) if rest else (None, None))))
    marks = spark.createDataFrame(rows, kind)
    joined = docs.join(marks, _all([x.cast("string").eqNullSafe(F.col(n)) for x, n in zip(levels, new[3:])]))
    key = F.xxhash64(F.lit(seed), F.col(new[0]), F.col(id_column).cast("string"))
    fits = F.col(new[1]).isNotNull() & ((key < F.col(new[1])) | ((key == F.col(new[1])) & (row <= F.col(new[2]))))
    count = F.col(new[0]) + fits.cast("int")
    epoch = free_name(docs, epoch_column or "mix_epoch")
    taken = joined.withColumn(epoch, F.explode(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))))
    return taken.select(*(F.col(f"`{c}`") for c in docs.columns), *([F.col(epoch).alias(epoch_column)] if epoch_column else []))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for x in conditions[1:]:
        out = out & x
    return out


def domain(source: Column) -> Column:
    """The domain of a source: a quarter of the sources each, by the number in the name; others are ``other``."""
    number = F.regexp_extract(source, r"(\d+)$", 1)
    return F.when(F.coalesce(number, F.lit("")) == "", F.lit("other")).otherwise(F.concat(F.lit("domain"), (F.right(number, F.lit(2)).cast("int") % 4).cast("string")))

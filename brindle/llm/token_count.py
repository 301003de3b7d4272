"""Token counts by heap-and-linked-list byte-pair merging, without identifiers.

A text in the library's form (a word mark before it and for every space) is cut into units, each a run of marks and what
follows up to the next mark: no piece of the vocabulary has a mark behind another character, so no merge crosses a unit.
Within a unit the symbols form a linked list; adjacent pairs whose join is a piece lie in a heap by rank, then place, and
the lowest is popped and merged until none is left. The count is the number of first symbols minus the merges, plus,
where a character is no piece and falls back to bytes, its further bytes. Counts of units are kept in a bounded cache.

Nulls: a null text counts as empty and has no tokens; a null id stays null. Repeated rows are counted each. Very long
texts, also those without a space, take a heap in proportion to their length. An empty table gives no rows. Only the id
and the text column are read, so further columns can have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept
from .encoding import TwoAges

LIMIT = 4096
#: The library's word mark.
MARK = "▁"
#: Bytes of each of the two caches of units.
UNITS = 96 << 20


class Counter:
    """Counts the tokens that a byte-pair model of the sentencepiece library gives."""

    def __init__(self, path: str, units: int = UNITS):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as form

        model = form.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or spec.name != "identity" or spec.remove_extra_whitespaces or not (spec.add_dummy_prefix and spec.escape_whitespaces):
            raise ValueError("the model isn't a byte-pair model with byte fallback over unchanged text")
        kind = sentencepiece_model_pb2_types(form)
        if any(p.type == kind["USER_DEFINED"] for p in model.pieces):
            raise ValueError("pieces set by users aren't supported")
        self.rank = {p.piece: -p.score for p in model.pieces if p.type in (kind["NORMAL"], kind["UNUSED"])}
        if any(MARK in p.lstrip(MARK) for p in self.rank):
            raise ValueError("a piece crosses words")
        del sentencepiece
        self.units = TwoAges(self.merged, units)

    def merged(self, unit: str) -> int:
        """Tokens of one unit."""
        rank, n = self.rank, len(unit)
        ends = list(range(1, n + 1))  # where the symbol that starts here ends; 0: it was merged away
        before = list(range(-1, n - 1))
        heap = [(r, k, k + 2) for k in range(n - 1) if (r := rank.get(unit[k : k + 2])) is not None]
        heapify(heap)
        merges = 0
        while heap:
            _, left, end = heappop(heap)
            middle = ends[left]
            if not middle or middle >= end or ends[middle] != end:
                continue
            ends[left], ends[middle] = end, 0
            merges += 1
            if end < n:
                before[end] = left
                after = ends[end]
                if (r := rank.get(unit[left:after])) is not None:
                    heappush(heap, (r, left, after))
            if left:
                at = before[left]
                if (r := rank.get(unit[at:end])) is not None:
                    heappush(heap, (r, at, end))
        count = n - merges
        for k in range(n):
            if ends[k] == k + 1 and unit[k] not in rank:
                count += len(unit[k].encode("utf-8", "surrogatepass")) - 1
        return count

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if MARK in text:
            text = text.replace(MARK, " ")
        units = text.split(" ")
        if "" not in units:
            return sum(map(self.of.__getitem__, units))
        total, marks = 0, 1
        for unit in units:
            if unit:
                total += self.of[unit] if marks == 1 else self.units[MARK * marks + unit]
                marks = 1
            else:
                marks += 1
        return total + (self.units[MARK * (marks - 1)] if marks > 1 else 0)

    @property
    def of(self) -> TwoAges:
        """Counts of units after one mark, by what follows the mark."""
        if "_of" not in self.__dict__:
            self._of = TwoAges(lambda unit: self.merged(MARK + unit), 2 * self.units.most)
        return self._of


def sentencepiece_model_pb2_types(form) -> dict[str, int]:
    """The numbers of the piece types."""
    return dict(form.ModelProto.SentencePiece.Type.items())


def counter(path: str) -> Counter:
    return kept(("counter", path), lambda: Counter(path))


def n_tokens(text: Column, model: str) -> Column:
    """The number of tokens of a text column."""

    @F.pandas_udf("long")
    def counted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(model).count
        for part in parts:
            yield pd.Series([count(x) if isinstance(x, str) else 0 for x in part], dtype="int64")

    return counted(text)


def token_counts(docs: DataFrame, model: str, id_column: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every row."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"), n_tokens(F.col(text), model).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)

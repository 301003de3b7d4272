"""A hierarchical Pitman-Yor language model: Chinese-restaurant seating by Gibbs sampling, averaged predictions.

A token is a word or a text's end. The restaurant of a context serves the tokens that follow it; a context is the whole word
before, or a text's start. Contexts whose words end alike (``CONTEXTS`` classes by the hash of the last letters; one class
for a text's start) share a parent, and all classes share the root restaurant over tokens, whose base measure is uniform
over the known tokens and one unknown token. A customer of a restaurant sits at a table of its dish or opens one, and each
table is a customer of the parent.

Steps over tables in the shared folder, none of which holds more than one block or one range of words:

1. Documents are tokenised into *blocks*. A block keeps its documents as numbers of its distinct (word, context) pairs
   and asks for every pair once, by ranges of the words' hashes, with its training count.
2. Ranges add up the counts of all blocks. Seating is sampled range by range, since a dish's tables in all contexts and
   at the root lie in one range: customers of small dishes are removed and reseated one by one with their tables' sizes,
   large dishes are emptied and seated anew, one customer after the other up to ``ALONE`` and then in steps of a small
   share of those seated. What ranges share are the sums over all dishes of each restaurant (customers, tables): a first
   run of sweeps finds them, a second one with these sums collects samples. Those of the classes and the root are few;
   those of the contexts are added up by ranges of the contexts' hashes, and each range of words gets back its own.
3. The average over samples of each pair's predictive probability goes back to the blocks that asked, in their order, and
   blocks add up the logarithms of each document's tokens.

Ranges and blocks are worked off in ``PASSES`` parts, one after the other: a part's input goes when its result is written,
so that shuffles and tables never hold everything twice.

All training documents are counted. Words are known by 64 bits of their XXH64, so that 2^32 distinct words would be
expected to hold about one collision. Nulls: a null text is empty and has its end alone; a null id stays null and, as
the crc32 of the empty text is 0, is a training row. Repeated rows count each. Very long texts make their block larger.
With no training rows every token is unknown. An empty table gives no rows. Only the id and the text column are read, so
further columns can have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, drop, shuffle_parts, stored, trim, written

CONTEXTS = 64
BLOCK_TOKENS = 1_000_000
BURN_IN = 2
SAMPLES = 3
SMALL = 8
#: Customers of a large dish that are seated one by one; later ones come in steps of the share 1 / SHARE of those seated.
ALONE, SHARE = 128, 64
#: Parts in which ranges and blocks are worked off.
PASSES = 4
#: Bytes of the input for each range of words, at most.
RANGE_BYTES = 64 << 20
#: Of the contexts, the classes and the root.
STRENGTH = (1.0, 1.0, 1.0)
SEED = 42
#: Stands for a text's end; no word has this hash but by accident.
END = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Stands for a text's start as a context.
START = np.uint64(0xFFFFFFFFFFFFFFFE)


def _planes(values: np.ndarray, kind: str) -> bytes:
    """Numbers as one run of bytes for each of their positions: the high ones are alike and compress."""
    values = np.ascontiguousarray(values, np.dtype(kind))
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _joined(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(np.dtype(kind)).ravel()


class _Numbers(dict):
    """Numbers for words in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def class_of(word: bytes) -> int:
    """The class of a context: by its last three bytes without marks."""
    return 1 + zlib.crc32(word.rstrip(b".,;:!?")[-3:]) % (CONTEXTS - 1)


#: A block's documents (``ids`` to ``fan``) or what it asks of one range (``range`` to ``counts``).
_BLOCK = pa.schema([("part", pa.int32()), ("block", pa.int64()), *((k, pa.binary()) for k in ("ids", "known", "held", "lengths", "pairs", "fan")), ("range", pa.int32()), *((k, pa.binary()) for k in ("words", "names", "classes", "contexts", "counts"))])
_KINDS = "block long, ids binary, known binary, held binary, lengths binary, pairs binary, fan binary, range int, words binary, names binary, classes binary, contexts binary, counts binary"


def _pass(number: int, ranges: int) -> int:
    """The part in which a range is worked off."""
    return number * PASSES // ranges


def _group(block: int) -> int:
    """The part in which a block is worked off."""
    return (block + (block >> 32)) % PASSES


def _block(number: int, words: _Numbers, docs: list, ranges: int) -> pa.RecordBatch:
    """One block: its documents as pair numbers, and its requests in the pairs' order."""
    from xxhash import xxh64_intdigest

    n = len(words)
    hashes = np.empty(n + 1, np.uint64)
    hashes[:n] = np.fromiter((xxh64_intdigest(w) for w in words), np.uint64, n)
    hashes[n] = END
    after = np.zeros(n + 2, np.uint8)  # the class of a word as a context; at the end: a text's start
    after[:n] = np.fromiter(map(class_of, words), np.uint8, n)
    order = np.argsort(hashes, kind="stable")
    place = np.empty(n + 1, np.int64)
    place[order] = np.arange(n + 1)
    lengths = np.array([len(d[3]) + 1 for d in docs], np.int64)
    tokens = np.concatenate([np.append(d[3], n) for d in docs])
    before = np.concatenate([[n + 1], tokens[:-1]])
    before[np.cumsum(lengths)[:-1]] = n + 1
    codes = place[tokens] * (n + 2) + before
    pairs, inverse = np.unique(codes, return_inverse=True)
    held = np.array([d[2] for d in docs], np.uint8)
    counts = np.bincount(inverse, np.repeat(1 - held, lengths), minlength=len(pairs)).astype("<u4")
    word_of, context = pairs // (n + 2), pairs % (n + 2)
    fan = np.bincount(word_of, minlength=n + 1).astype("<u4")
    sorted_hashes = hashes[order]
    where = (sorted_hashes >> np.uint64(32)).astype(np.int64) * ranges >> 32
    cuts = np.searchsorted(where, np.arange(ranges + 1))
    ends = np.concatenate([[0], np.cumsum(fan, dtype=np.int64)])
    names = np.append(hashes, START)
    rows = [{"part": PASSES + _group(number), "block": number, "ids": np.array([d[0] for d in docs], "<i8").tobytes(), "known": np.array([d[1] for d in docs], np.uint8).tobytes(), "held": held.tobytes(), "lengths": lengths.tobytes(), "pairs": _planes(inverse, "<u4"), "fan": _planes(fan, "<u4")}]
    for r in range(ranges):
        a, b = cuts[r], cuts[r + 1]
        if a < b:
            x, y = ends[a], ends[b]
            used, local = np.unique(context[x:y], return_inverse=True)
            rows.append({"part": _pass(r, ranges), "block": number, "range": r, "words": sorted_hashes[a:b].tobytes(), "fan": _planes(fan[a:b], "<u4"), "names": names[used].tobytes(), "classes": after[used].tobytes(), "contexts": _planes(local, "<u4"), "counts": _planes(counts[x:y], "<u4")})
    return pa.RecordBatch.from_pylist(rows, schema=_BLOCK)


def blocks(docs: DataFrame, ranges: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The documents (``doc_id``, ``text``, ``held_out``) as blocks."""

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, words, rows, total = TaskContext.get().partitionId() << 32, _Numbers(), [], 0
        for batch in batches:
            for doc, text, held in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                parts = (text.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
                rows.append((doc or 0, doc is not None, held, np.fromiter(map(words.__getitem__, parts), np.int64, len(parts))))
                total += len(parts) + 1
                if total >= block_tokens:
                    yield _block(number, words, rows, ranges)
                    number, words, rows, total = number + 1, _Numbers(), [], 0
                    trim()
        if rows:
            yield _block(number, words, rows, ranges)
            del words, rows
            trim()

    return docs.mapInArrow(tokenised, f"part int, {_KINDS}")


def _merged(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The distinct numbers of all parts, where each is first, and the places of every part's numbers."""
    names, first, places = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)
    return names, first, np.split(places, np.cumsum([len(x) for x in parts])[:-1])


_RANGE = "range int, blocks binary, words long, contexts binary, classes binary, pairs binary, counts binary, of_pairs array<binary>"


def summed(asked: DataFrame) -> DataFrame:
    """One row for each range: its contexts, the counts of all blocks, and which places each block asked for."""

    def add(key, rows: pd.DataFrame) -> pd.DataFrame:
        trim()
        rows = rows.sort_values("block")
        words, _, of_words = _merged([np.frombuffer(x, np.uint64) for x in rows["words"]])
        contexts, first, of_contexts = _merged([np.frombuffer(x, np.uint64) for x in rows["names"]])
        classes = np.concatenate([np.frombuffer(x, np.uint8) for x in rows["classes"]])[first]
        codes = [np.repeat(w, _joined(f, "<u4")) * len(contexts) + c[_joined(x, "<u4")] for w, f, c, x in zip(of_words, rows["fan"], of_contexts, rows["contexts"])]
        pairs, _, of_pairs = _merged(codes)
        counts = np.bincount(np.concatenate(of_pairs), np.concatenate([_joined(x, "<u4") for x in rows["counts"]]), minlength=len(pairs)).astype(np.int64)
        return pd.DataFrame({"range": [key[0]], "blocks": [rows["block"].to_numpy().astype("<i8").tobytes()], "words": [len(words)], "contexts": [contexts.tobytes()], "classes": [classes.tobytes()], "pairs": [_planes(pairs, "<i8")], "counts": [_planes(counts, "<i8")], "of_pairs": [[_planes(x, "<u4") for x in of_pairs]]})

    return asked.select("block", "range", "words", "fan", "names", "classes", "contexts", "counts").groupBy("range").applyInPandas(add, _RANGE)


def reseat_small(sizes: np.ndarray, weight: np.ndarray, discount: float, draw: np.random.Generator) -> np.ndarray:
    """One Gibbs sweep over dishes with equally many customers: ``sizes`` (dishes, most tables), ``weight`` of a new table."""
    n, most = sizes.shape
    each = np.arange(n)
    for _ in range(most):
        up = sizes.cumsum(axis=1)
        leaves = (up <= (draw.random(n, np.float32) * most)[:, None]).sum(axis=1).clip(max=most - 1)
        sizes[each, leaves] -= 1
        old = np.where(sizes > 0, sizes - np.float32(discount), np.float32(0)).cumsum(axis=1)
        at = (old <= (draw.random(n, np.float32) * (old[:, -1] + weight))[:, None]).sum(axis=1)
        at = np.where(at == most, (sizes == 0).argmax(axis=1), at)
        sizes[each, at] += 1
    return sizes


def seat_large(counts: np.ndarray, weight: np.ndarray, discount: float, draw: np.random.Generator) -> np.ndarray:
    """Tables of dishes with many customers, who are seated anew from the first on."""
    tables, seated = np.ones(len(counts)), 1
    order = np.argsort(-counts)
    left = counts[order].astype(np.float64)
    while len(left) and (live := int(np.searchsorted(-left, -seated))):
        now, new = tables[order[:live]], weight[order[:live]]
        opens = np.clip(new / (np.maximum(seated - discount * now, 1e-9) + new), 0, 1)
        if seated < ALONE:
            tables[order[:live]] = now + (draw.random(live) < opens)
            seated += 1
        else:
            step = seated // SHARE
            tables[order[:live]] = now + draw.binomial(np.minimum(left[:live] - seated, step).astype(np.int64), opens)
            seated += step
    return np.minimum(tables, counts)


class Seats:
    """The tables of all dishes of one level in one range."""

    def __init__(self, small: int = SMALL):
        self.small, self.sizes = small, {}

    def sweep(self, counts: np.ndarray, weight: np.ndarray, discount: float, draw: np.random.Generator, sticky: bool) -> np.ndarray:
        """Reseat; ``sticky``: the counts are those of the sweep before, so tables are kept and customers move one by one."""
        tables = (counts > 0).astype(np.float64)
        for c in range(2, self.small + 1):
            at = np.flatnonzero(counts == c)
            if not len(at):
                continue
            sizes = self.sizes.get(c) if sticky else None
            if sizes is None:
                sizes = np.zeros((len(at), c), np.float32)
                sizes[:, 0] = c
            sizes = reseat_small(sizes, weight[at].astype(np.float32), discount, draw)
            if sticky:
                self.sizes[c] = sizes
            tables[at] = (sizes > 0).sum(axis=1)
        at = np.flatnonzero(counts > self.small)
        tables[at] = seat_large(counts[at], weight[at], discount, draw)
        return tables


class Pairs:
    """The pairs of one range: of each its word and context, and of each (word, class) the same."""

    def __init__(self, row: dict):
        self.pairs, self.counts, self.words = _joined(row["pairs"], "<i8"), _joined(row["counts"], "<i8"), int(row["words"])
        self.names, classes = np.frombuffer(row["contexts"], np.uint64), np.frombuffer(row["classes"], np.uint8)
        self.word, self.context = np.divmod(self.pairs, len(self.names))
        mid, self.mid = np.unique(self.word * CONTEXTS + classes[self.context], return_inverse=True)
        self.mid_word, self.mid_class = np.divmod(mid, CONTEXTS)

    def up(self, tables: np.ndarray) -> np.ndarray:
        """Customers of the (word, class) dishes."""
        return np.bincount(self.mid, tables, minlength=len(self.mid_word))

    def per_context(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.context, values, minlength=len(self.names))


def run(row, shares: pd.DataFrame, sums: dict, burn_in: int, samples: int, seed: int):
    """Sweeps over one range. Yields the pairs, the samples' mean of their probabilities, and the totals of tables."""
    p = Pairs(row)
    shares = shares.sort_values("owner")
    customers, seated = (np.concatenate([_joined(x, "<i8") for x in shares[k]]).astype(float) for k in ("customers", "tables"))
    draw = np.random.default_rng([seed, int(row["range"])])
    d2, d1, d0, (s2, s1, s0) = sums["d2"], sums["d1"], sums["d0"], STRENGTH
    lift = (s2 + d2 * seated)[p.context]
    lift_mid, below = (s1 + d1 * sums["tables"])[p.mid_class], (s1 + sums["customers"])[p.mid_class]
    base, spread = 1.0 / (sums["distinct"] + 1), s0 + d0 * sums["root_tables"]
    children, middle, root = Seats(), Seats(), Seats()
    of_mid = p.up(p.counts > 0)
    mid_tables = (of_mid > 0).astype(np.float64)
    of_word = np.bincount(p.mid_word, mid_tables, minlength=p.words)
    upper = (of_word > 0).astype(np.float64)

    def parents() -> tuple[np.ndarray, np.ndarray]:
        top = ((np.maximum(of_word - d0 * upper, 0) + spread * base) / (s0 + sums["root_customers"]))[p.mid_word]
        return top, (np.maximum(of_mid - d1 * mid_tables, 0) + lift_mid * top) / below

    mean, of_contexts, totals = np.zeros(len(p.pairs)), np.zeros(len(p.names)), np.zeros(2 * CONTEXTS + 2)
    for k in range(burn_in + samples):
        top, parent = parents()
        tables = children.sweep(p.counts, lift * parent[p.mid], d2, draw, sticky=True)
        of_mid = p.up(tables)
        mid_tables = middle.sweep(of_mid.astype(np.int64), lift_mid * top, d1, draw, sticky=False)
        of_word = np.bincount(p.mid_word, mid_tables, minlength=p.words)
        upper = root.sweep(of_word.astype(np.int64), np.full(p.words, spread * base), d0, draw, sticky=False)
        if k >= burn_in:
            mean += (np.maximum(p.counts - d2 * tables, 0) + lift * parents()[1][p.mid]) / (s2 + customers)[p.context]
            of_contexts += p.per_context(tables)
            totals += np.concatenate([np.bincount(p.mid_class, of_mid, minlength=CONTEXTS), np.bincount(p.mid_class, mid_tables, minlength=CONTEXTS), [of_word.sum(), upper.sum()]])
    return p, mean / samples, of_contexts / samples, totals / samples


#: Of a range the sums of its contexts, cut by the ranges of their hashes; under owner -1 those of classes and root.
_PART = "range int, owner int, names binary, customers binary, tables binary, totals array<double>"


def _parts(number: int, p: Pairs, tables: np.ndarray, totals: np.ndarray, ranges: int) -> pd.DataFrame:
    customers, owner = p.per_context(p.counts), (p.names >> np.uint64(32)).astype(np.int64) * ranges >> 32
    cuts = np.searchsorted(owner, np.arange(ranges + 1))
    rows = [(number, -1, None, None, None, totals.astype(float))]
    rows += [(number, r, p.names[a:b].tobytes(), _planes(customers[a:b], "<i8"), _planes(tables[a:b], "<i8"), None) for r, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
    return pd.DataFrame(rows, columns=["range", "owner", "names", "customers", "tables", "totals"])


def _totals(parts: DataFrame) -> np.ndarray:
    """The sums of classes and root over all ranges."""
    found = parts.where("owner = -1").select(F.posexplode("totals").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect()  # a few times CONTEXTS rows
    return np.array([r["x"] for r in sorted(found)])


_SHARE = "range int, owner int, customers binary, tables binary"


def shares(parts: DataFrame) -> DataFrame:
    """For each range, the sums of its contexts over all ranges."""

    def add(key, rows: pd.DataFrame) -> pd.DataFrame:
        names, _, places = _merged([np.frombuffer(x, np.uint64) for x in rows["names"]])
        out = rows[["range", "owner"]].copy()
        for name in ("customers", "tables"):
            whole = np.bincount(np.concatenate(places), np.concatenate([_joined(x, "<i8") for x in rows[name]]), minlength=len(names))
            out[name] = [_planes(whole[x], "<i8") for x in places]
        trim()
        return out

    return parts.where("owner >= 0").drop("totals").groupBy("owner").applyInPandas(add, _SHARE)


def _first_parts(counted: DataFrame, ranges: int) -> tuple[str, dict]:
    """Customers and dishes of every restaurant; discounts from how many dishes have one and two customers."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                p = Pairs(row)
                of_mid = p.up(p.counts > 0)
                fan = np.bincount(p.mid_word, of_mid > 0, minlength=p.words)
                few = [(x == k).sum() for x in (p.counts, of_mid, fan) for k in (1, 2)]
                size = lambda x: np.bincount(p.mid_class, x, minlength=CONTEXTS)
                yield _parts(row["range"], p, p.per_context(p.counts > 0), np.concatenate([size(of_mid), size(of_mid > 0), [fan.sum(), (fan > 0).sum(), p.counts.sum(), *few]]), ranges)
                trim()

    parts = counted.select("range", "words", "contexts", "classes", "pairs", "counts").mapInPandas(look, _PART)
    path = stored(parts, "parts")
    parts = counted.sparkSession.read.schema(_PART).parquet(path)
    found = _totals(parts)
    if not len(found):
        found = np.zeros(2 * CONTEXTS + 9)
    rate = lambda ones, twos: float(np.clip(ones / (ones + 2 * twos) if ones else 0.5, 0.05, 0.95))
    rest = found[2 * CONTEXTS :]
    return path, _sums(found) | {"distinct": int(rest[1]), "tokens": int(rest[2]), "d2": rate(*rest[3:5]), "d1": rate(*rest[5:7]), "d0": rate(*rest[7:9])}


def _sums(found: np.ndarray) -> dict:
    return {"customers": found[:CONTEXTS], "tables": found[CONTEXTS : 2 * CONTEXTS], "root_customers": found[2 * CONTEXTS], "root_tables": found[2 * CONTEXTS + 1]}


def held_out(id_column: str = "doc_id"):
    """True for rows that are not learned from: the crc32 of the id as text has remainder 2 by 7."""
    return crc_of_id(id_column) % 7 == 2


def score(docs: DataFrame, id_column: str = "doc_id", text: str = "text", burn_in: int = BURN_IN, samples: int = SAMPLES, seed: int = SEED, ranges: int | None = None) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` and ``perplexity`` of each row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), held_out(id_column).alias("held_out"))
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    ranges = ranges or max(shuffle_parts(spark), min(size, 1 << 50) // RANGE_BYTES)
    made = stored(blocks(rows, ranges), "blocks", "part")
    table = lambda paths, kinds: spark.read.schema(kinds).parquet(*([paths] if isinstance(paths, str) else paths))
    in_turn = lambda path, kinds, part: table(path, f"{kinds}, part int").where(F.col("part") == part).drop("part")

    counted = []
    for k in range(PASSES):
        counted.append(stored(summed(in_turn(made, _KINDS, k)), "ranges"))
        drop(spark, f"{made}/part={k}")
    light = ["range", "words", "contexts", "classes", "pairs", "counts"]
    first, sums = _first_parts(table(counted, _RANGE), ranges)

    def shared(paths: list[str]) -> str:
        out = stored(shares(table(paths, _PART)), "shares")
        for path in paths:
            drop(spark, path)
        return out

    def mine(path: str, k: int) -> DataFrame:
        """The shares of the ranges of a part."""
        return table(path, _SHARE).where(F.floor(F.col("range") * PASSES / ranges) == k).groupBy("range")

    def sit(key, row: pd.DataFrame, share: pd.DataFrame) -> pd.DataFrame:
        p, _, tables, totals = run(row.iloc[0], share, sums, burn_in, 1, seed)
        trim()
        return _parts(key[0], p, tables, totals, ranges)

    known = shared([first])
    seated = [stored(table(path, _RANGE).select(light).groupBy("range").cogroup(mine(known, k)).applyInPandas(sit, _PART), "parts") for k, path in enumerate(counted)]
    drop(spark, known)
    found = _totals(table(seated, _PART))
    final = sums | (_sums(found) if len(found) else {})
    known = shared(seated)

    def reply(key, row: pd.DataFrame, share: pd.DataFrame) -> pd.DataFrame:
        one = row.iloc[0]
        p, mean, _, _ = run(one, share, final, burn_in, samples, seed)
        trim()
        per_word = np.bincount(p.word, p.counts, minlength=p.words).astype("<i8")
        value = np.log10(np.maximum(mean, 1e-300)).astype("<f4")
        out = []
        for block, of_pairs in zip(np.frombuffer(one["blocks"], "<i8").tolist(), one["of_pairs"]):
            places = _joined(of_pairs, "<u4")
            word = p.word[places]
            out.append((_group(block), block, key[0], _planes(per_word[word[np.flatnonzero(np.diff(word, prepend=-1))]], "<i8"), _planes(value[places], "<f4")))
        return pd.DataFrame(out, columns=["part", "block", "range", "counts", "logs"])

    answer = "block long, range int, counts binary, logs binary"
    replies = []
    for k, path in enumerate(counted):
        replies.append(stored(table(path, _RANGE).groupBy("range").cogroup(mine(known, k)).applyInPandas(reply, f"part int, {answer}"), "answers", "part"))
        drop(spark, path)
    drop(spark, known)
    base = float(np.log10(sums["tokens"] + sums["distinct"] + 1))
    train = sums["tokens"]

    def total(key, block: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        trim()
        parts = parts.sort_values("range")
        one = block.iloc[0]
        fan = _joined(one["fan"], "<u4")
        counts = np.repeat(np.concatenate([_joined(x, "<i8") for x in parts["counts"]]), fan)
        logs = np.concatenate([_joined(x, "<f4") for x in parts["logs"]]).astype(float)
        plain = np.log10(counts + 1.0) - base
        lengths = np.frombuffer(one["lengths"], np.int64)
        pairs = _joined(one["pairs"], "<u4")
        starts = np.cumsum(lengths) - lengths
        known = np.frombuffer(one["known"], np.uint8).astype(bool)
        return pd.DataFrame({
            "doc_id": pd.Series(np.frombuffer(one["ids"], "<i8"), dtype="Int64").mask(~known),
            "held_out": np.frombuffer(one["held"], np.uint8).astype(bool),
            "n_tokens": lengths,
            "n_known": np.add.reduceat((counts > 0)[pairs].astype(np.int64), starts),
            "train_tokens": train,
            "base_score": np.add.reduceat(plain[pairs], starts),
            "score": np.add.reduceat(logs[pairs], starts),
        })

    kinds = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = None
    for k in range(PASSES):
        kept = in_turn(made, _KINDS, PASSES + k).select("block", "ids", "known", "held", "lengths", "pairs", "fan").groupBy("block")
        asked = reduce(DataFrame.unionByName, (in_turn(path, answer, k) for path in replies))
        some = written(kept.cogroup(asked.groupBy("block")).applyInPandas(total, kinds), "scores")
        scored = some if scored is None else scored.unionByName(some)
        for path in (f"{made}/part={PASSES + k}", *(f"{x}/part={k}" for x in replies)):
            drop(spark, path)
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))

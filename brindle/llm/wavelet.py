"""Token ids in wavelet matrices, one file for each shard of documents.

A shard holds the ids of consecutive documents. Level by level, from the highest bit, the bits of all ids form a plane,
and the ids are dealt stably into those with a 0 and those with a 1 for the next level. Planes are kept in compressed
blocks with the ones before each block, so one file supports access by place, counting (rank) and occurrence lookup
(select) without being unpacked whole.

File: ``MAGIC``, length of the header (unsigned 32-bit), header (JSON: tokens, levels, documents, zeros of each level,
sizes of the sections), ids of the documents (64-bit) with their null marks and ends, then per level the block index
(bytes and ones before each block) and the blocks.

Documents go into shards in ascending order of id, nulls first, equal ids by text. Nulls: a null text counts as empty
and gives its end token alone; a null id is kept as null. Repeated rows are stored each. Shards close after the document
that fills them, so a very long document is one shard's. An empty table gives no shards and no rows. Only the id and the
text column are read, so further columns can have any name.

A shard is written under a name of its attempt, and only shards that a finished task has reported are in the manifest
that readers use: a task that runs twice leaves an unused file, never a wrong one.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, shuffle_parts, written
from .encoding import encoder

END = 2
SHARD_TOKENS = 8_000_000
MAGIC = b"WVMX0001"
#: Bytes of a plane in each block.
BLOCK = 1 << 16
#: Ids that are dealt at a time, so that their places stay in a core's cache.
RUN = 1 << 17


def build(ids: np.ndarray, levels: int) -> tuple[list[int], list[bytes]]:
    """The zeros and the packed bits of each level."""
    zeros, planes = [], []
    for level in range(levels - 1, -1, -1):
        bit, plane, none, some = ids.dtype.type(1 << level), [], [ids[:0]], []
        for k in range(0, len(ids), RUN):
            run = ids[k : k + RUN]
            ones = (run & bit).astype(bool)
            plane.append(np.packbits(ones, bitorder="little").tobytes())
            none.append(run.take(np.flatnonzero(~ones)))
            some.append(run.take(np.flatnonzero(ones)))
        planes.append(b"".join(plane))
        zeros.append(sum(map(len, none)))
        ids = np.concatenate(none + some)
    return zeros, planes


def pack_shard(ids: np.ndarray, docs: list[int | None], ends: np.ndarray, levels: int) -> bytes:
    """The bytes of a shard file; ``ends`` are the documents' ends in ``ids``."""
    zeros, planes = build(ids, levels)
    press = zstandard.ZstdCompressor(level=1)
    sections = []
    for plane in planes:
        cuts = [plane[k : k + BLOCK] for k in range(0, len(plane), BLOCK)]
        ones = [int(np.bitwise_count(np.frombuffer(c, np.uint8)).sum(dtype=np.int64)) for c in cuts]
        blocks = [press.compress(c) for c in cuts]
        index = np.zeros((2, len(cuts) + 1), "<i8")
        index[0, 1:], index[1, 1:] = np.cumsum([len(b) for b in blocks]), np.cumsum(ones)
        sections.append(index.tobytes() + b"".join(blocks))
    known = np.array([d is not None for d in docs], np.uint8)
    table = np.array([d or 0 for d in docs], "<i8").tobytes() + known.tobytes() + ends.astype("<i8").tobytes()
    head = json.dumps({"tokens": len(ids), "levels": levels, "docs": len(docs), "zeros": zeros, "sizes": [len(s) for s in sections]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, table, *sections])


class Shard:
    """A shard file: ``access``, ``rank`` and ``select`` read only the blocks that they need; ``ids`` reads all."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a shard of wavelet matrices")
        (size,) = struct.unpack_from("<I", data, 8)
        head = json.loads(data[12 : 12 + size])
        self.data, self.n, self.levels, self.zeros = data, head["tokens"], head["levels"], head["zeros"]
        at, n = 12 + size, head["docs"]
        known = np.frombuffer(data, np.uint8, n, at + 8 * n)
        self.docs = [int(d) if k else None for d, k in zip(np.frombuffer(data, "<i8", n, at), known)]
        self.ends = np.frombuffer(data, "<i8", n, at + 9 * n)
        at += 17 * n
        blocks = -(-(-(-self.n // 8)) // BLOCK)
        self.planes = []
        for section in head["sizes"]:
            index = np.frombuffer(data, "<i8", 2 * (blocks + 1), at).reshape(2, -1)
            self.planes.append((at + index.nbytes, index[0], index[1]))
            at += section
        self._open: dict[tuple[int, int], np.ndarray] = {}

    def _block(self, level: int, k: int) -> np.ndarray:
        if (level, k) not in self._open:
            if len(self._open) >= 64:
                self._open.clear()
            at, places, _ = self.planes[level]
            self._open[level, k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.data[at + places[k] : at + places[k + 1]]), np.uint8)
        return self._open[level, k]

    def _bit(self, level: int, i: int) -> int:
        block = self._block(level, i // (8 * BLOCK))
        i %= 8 * BLOCK
        return block[i // 8] >> (i % 8) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones before place ``i``."""
        k, rest = divmod(i, 8 * BLOCK)
        total = int(self.planes[level][2][k])
        if rest:
            block = self._block(level, k)
            total += int(np.bitwise_count(block[: rest // 8]).sum(dtype=np.int64))
            if rest % 8:
                total += (int(block[rest // 8]) & ((1 << rest % 8) - 1)).bit_count()
        return total

    def access(self, i: int) -> int:
        """The id at place ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.levels):
            bit = int(self._bit(level, i))
            ones = self._ones(level, i)
            value, i = value << 1 | bit, self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        low = 0
        for level in range(self.levels):
            if token >> (self.levels - 1 - level) & 1:
                low, i = (self.zeros[level] + self._ones(level, x) for x in (low, i))
            else:
                low, i = low - self._ones(level, low), i - self._ones(level, i)
        return low, i

    def rank(self, token: int, i: int | None = None) -> int:
        """How often ``token`` is among the first ``i`` ids."""
        low, high = self._range(token, self.n if i is None else i)
        return high - low

    def select(self, token: int, k: int) -> int:
        """The place of occurrence ``k`` (from 0) of ``token``."""
        if not 0 <= k < self.rank(token):
            raise IndexError(k)
        at = self._range(token, 0)[0] + k
        for level in range(self.levels - 1, -1, -1):
            one = token >> (self.levels - 1 - level) & 1
            want = at - self.zeros[level] if one else at
            low, high = 0, self.n - 1
            while low < high:  # the least place with more than `want` such bits up to and with it
                middle = (low + high) // 2
                ones = self._ones(level, middle + 1)
                low, high = (low, middle) if (ones if one else middle + 1 - ones) > want else (middle + 1, high)
            at = low
        return at

    def ids(self, kind=np.uint16) -> np.ndarray:
        """All ids in their order."""
        kind = np.dtype(kind)
        now = np.zeros(self.n, kind)
        for level in range(self.levels - 1, -1, -1):
            at, places, _ = self.planes[level]
            raw = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(self.data[at + a : at + b]) for a, b in zip(places, places[1:])), np.uint8)
            bit, out, low, high = kind.type(1 << (self.levels - 1 - level)), np.empty_like(now), 0, self.zeros[level]
            for k in range(0, self.n, RUN):
                run = out[k : k + RUN]
                ones = np.unpackbits(raw[k // 8 : (k + RUN) // 8], count=len(run), bitorder="little").view(bool)
                zero, one = np.flatnonzero(~ones), np.flatnonzero(ones)
                run[zero] = now[low : low + len(zero)]
                run[one] = now[high : high + len(one)] | bit
                low, high = low + len(zero), high + len(one)
            now = out
        return now


def write_shards(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text: str = "text", end: int = END, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the shards and return their manifest: ``part``, ``shard``, ``path``, ``n_docs``, ``n_tokens``, ``n_bytes``."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/shards"
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    dealt = rows.repartitionByRange(shuffle_parts(spark), F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    kinds = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer)
        levels = max(1, (max(ids_of.library.get_vocab_size(), end + 1) - 1).bit_length())
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        last = np.array([end], ids_of.kind)
        names, parts, total, shard = [], [], 0, 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate([x for pair in parts for x in (pair, last)])
            ends = np.cumsum([len(p) + 1 for p in parts])
            data = pack_shard(ids, names, ends, levels)
            place, at = fs.FileSystem.from_uri(folder)
            place.create_dir(at, recursive=True)
            name = f"{part:06d}-{shard:06d}-{attempt}.wvmx"
            with place.open_output_stream(f"{at}/{name}") as out:
                out.write(data)
            return pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "path": f"{folder}/{name}", "n_docs": len(names), "n_tokens": len(ids), "n_bytes": len(data)}], schema=kinds)

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), ids_of.encode_all(batch.column(1))):
                names.append(doc)
                parts.append(ids)
                total += len(parts[-1]) + 1
                if total >= shard_tokens:
                    yield close()
                    names, parts, total, shard = [], [], 0, shard + 1
        if names:
            yield close()

    return written(dealt.mapInArrow(store, "part int, shard int, path string, n_docs long, n_tokens long, n_bytes long"), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Per document of the shards: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids`` (unsigned 32-bit)."""
    order = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    placed = manifest.select("path", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("start"))
    kinds = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                place, at = fs.FileSystem.from_uri(path)
                with place.open_input_stream(at) as file:
                    shard = Shard(file.read())
                ids, ends = shard.ids(np.uint16 if shard.levels <= 16 else np.uint32).astype("<u4"), shard.ends
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                for k in range(0, len(ends), 512):
                    a, b = starts[k : k + 512], ends[k : k + 512]
                    texts = [ids[x:y].tobytes() for x, y in zip(a, b)]
                    yield pa.RecordBatch.from_arrays([pa.array(shard.docs[k : k + 512], pa.int64()), pa.array(a + start), pa.array(b - a), pa.array(texts, pa.binary())], schema=kinds)

    parts = shuffle_parts(manifest.sparkSession)
    return placed.repartition(parts).mapInArrow(load, "doc_id long, start long, n_tokens long, ids binary")

"""WARC archives: deduplicated writing, and reading by boundary-chain verification.

Writing: of records with equal payloads of at least ``least_bytes`` bytes, that with the smallest page id is a response
and the others are revisits that refer to it; smaller ones are all responses. Equal payloads are found by their SHA-256.
Only digests that occur more than once are joined back to the pages; Spark broadcasts them if their table is small and
shuffles otherwise, where a hot digest is a skewed join that can be split.

Reading: archives are cut at fixed byte ranges that know nothing of records. Every task looks in its range for the magic
of a record, reads the header there and emits a candidate and its successor's offset. Within a range the chain of every
candidate is followed to where it leaves the range; then pointer jumping from the start of each file, doubling the
stride at every round, marks the entries of ranges that are reached, and only records on those chains are kept. Headers
are read on to their end, whatever their length, and reading fails unless every archive's chain ends at its last byte with
as many records as its manifest says. Magic
inside a payload starts no chain that the file's start reaches, so it is rejected.

Nulls: a null html is an empty payload; a null page id is kept, sorts after all others and is never the response of a
page with an id; a null url is left out of the header. Ties: rows that share payload and page id with the response are
responses too. An empty table gives an empty archive and no rows. Very large records are read by one task, in the memory
of one record. Only the id, url and html columns are read, so further columns can have any name.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, shuffle_parts, written

LEAST_BYTES = 100
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 4 << 20
#: Fixed values of the format.
MAGIC = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
#: What is read at once past a range; longer headers are read on.
HEADER_BYTES = 1 << 16
#: Says of a header that the bytes at hand do not hold its end.
MORE = ({}, -1)
FIXED_DATE = "2000-01-01T00:00:00Z"


def _record_id(page: int | None, salt: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{page}/{salt}'.encode()).hexdigest())}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool) -> bytes:
    """The bytes of one record; a revisit has no payload of its own."""
    lines = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page, digest)}", f"WARC-Date: {FIXED_DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(first, digest)}", f"X-Refers-To-Page: {first}"]
    if page is not None:
        lines.append(f"X-Page-ID: {page}")
    body = b"" if revisit else payload
    lines += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    return MAGIC + "\r\n".join(lines).encode() + END + body + END


def decide(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(``digest``, ``first``) of payloads that more than one page has."""
    marks = pages.select("page_id", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("size")).where(F.col("size") >= least_bytes)
    many = marks.groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1")
    return written(many.select("digest", "first"), "repeated")


def write(pages: DataFrame, id_column: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the archives and return their manifest: ``path``, ``n_records``, ``n_bytes``."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc"
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(b"")).alias("payload"))
    same = decide(rows, least_bytes)
    marked = rows.withColumn("digest", F.sha2("payload", 256)).join(same.withColumn("known", F.lit(True)), "digest", "left")
    decided = marked.select("page_id", "url", "payload", "digest", "first", (F.coalesce("known", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit"))

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, at = fs.FileSystem.from_uri(folder)
        place.create_dir(at, recursive=True)
        part, attempt, k, out = TaskContext.get().partitionId(), uuid.uuid4().hex, 0, None
        for batch in batches:
            for page, url, payload, digest, first, revisit in zip(batch["page_id"].astype("Int64"), batch["url"], batch["payload"], batch["digest"], batch["first"].astype("Int64"), batch["revisit"]):
                if out is None:
                    name = f"{part:06d}-{k:06d}-{attempt}.warc"
                    out, n, size = place.open_output_stream(f"{at}/{name}"), 0, 0
                data = record(None if pd.isna(page) else int(page), url, bytes(payload), digest, None if pd.isna(first) else int(first), bool(revisit))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    out.close()
                    out, k = None, k + 1
                    yield pd.DataFrame({"path": [f"{folder}/{name}"], "n_records": [n], "n_bytes": [size]})
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [f"{folder}/{name}"], "n_records": [n], "n_bytes": [size]})

    return written(decided.mapInPandas(store, "path string, n_records long, n_bytes long"), "manifest")


def header(block: bytes, at: int) -> tuple[dict[str, str], int] | None:
    """The fields of a header that starts at ``at`` and where its content starts; none if it is no header, or ``MORE``."""
    if not block.startswith(MAGIC, at):
        return None
    fields, here = {}, at + len(MAGIC)
    while (end := block.find(b"\r\n", here)) != here:
        if end < 0:
            return MORE
        name, colon, value = block[here:end].partition(b":")
        if not colon:
            return None
        fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
        here = end + 2
    if not fields.get("content-length", "").isdigit() or "warc-type" not in fields:
        return None
    return fields, end + 2


def _whole_header(file, block: bytes, base: int, at: int, size: int) -> tuple[bytes, tuple[dict[str, str], int] | None]:
    """``block``, which starts at ``base``, read on to the end of the header at ``at`` or of the file; and that header."""
    step = HEADER_BYTES
    while (head := header(block, at)) is MORE and base + len(block) < size:
        file.seek(base + len(block))
        block += file.read(min(step, size - base - len(block)))
        step *= 2
    return block, None if head is MORE else head


_CANDIDATE = "path string, low long, at long, next long, leaves long, n long"


def candidates(manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Every offset that looks like a record's, its successor's, where its chain leaves the range, and its records till there."""
    ranges = manifest.select("path", "n_bytes", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n_bytes") - 1, F.lit(0)), F.lit(range_bytes))).alias("low"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, size, low in zip(batch["path"], batch["n_bytes"], batch["low"]):
                place, name = fs.FileSystem.from_uri(path)
                high = min(low + range_bytes, size)
                with place.open_input_file(name) as file:
                    file.seek(low)
                    block = file.read(min(high + HEADER_BYTES, size) - low)
                    found, at = {}, block.find(MAGIC)
                    while 0 <= at < high - low:
                        block, head = _whole_header(file, block, low, at, size)
                        if head is not None:
                            after = low + head[1] + int(head[0]["content-length"]) + len(END)
                            if after <= size:
                                found[low + at] = after
                        at = block.find(MAGIC, at + 1)
                leaves: dict[int, int] = {}
                count: dict[int, int] = {}
                for here in sorted(found, reverse=True):  # a chain that ends at no candidate leaves nowhere
                    after = found[here]
                    leaves[here] = after if after >= high or after not in found else leaves[after]
                    count[here] = 1 + count.get(after, 0)
                yield pd.DataFrame({"path": path, "low": low, "at": list(found), "next": list(found.values()), "leaves": [leaves[x] for x in found], "n": [count[x] for x in found]})

    return written(ranges.repartition(shuffle_parts(manifest.sparkSession)).mapInPandas(scan, _CANDIDATE), "candidates")


def reached(found: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(``path``, ``at``) of the range entries that lie on the chain from each file's start, by pointer jumping."""
    entered = found.select("path", F.col("leaves").alias("at")).distinct()
    jumps = found.where("at = 0").unionByName(found.join(entered, ["path", "at"], "left_semi").where("at > 0"))
    jumps = written(jumps.select("path", "at", F.col("leaves").alias("to")), "jumps")
    here = written(jumps.where("at = 0").select("path", "at"), "reached")
    n = here.count()
    for _ in range(most_rounds):
        further = here.join(jumps, ["path", "at"]).select("path", F.col("to").alias("at")).join(jumps.select("path", "at"), ["path", "at"], "left_semi")
        now = written(here.unionByName(further).distinct(), "reached")
        if (m := now.count()) == n:
            return now
        here, n = now, m
        ahead = jumps.select("path", F.col("at").alias("to"), F.col("to").alias("beyond"))
        jumps = written(jumps.join(ahead, ["path", "to"]).select("path", "at", F.col("beyond").alias("to")).unionByName(jumps.join(ahead, ["path", "to"], "left_anti").select("path", "at", "to")), "jumps")
    raise RuntimeError("the chains did not end")


def verify(manifest: DataFrame, found: DataFrame, entries: DataFrame) -> None:
    """Fail unless the chain of every archive ends at its last byte and has as many records as its manifest says."""
    ended = entries.join(found, ["path", "at"]).groupBy("path").agg(F.max("leaves").alias("end"), F.sum("n").alias("n"))
    wrong = manifest.join(ended, "path", "left").where("NOT (end <=> n_bytes AND n <=> n_records)").first()
    if wrong is not None:
        raise ValueError(f"{wrong.path}: the chain ends at {wrong.end} of {wrong.n_bytes} bytes with {wrong.n} of {wrong.n_records} records")


def read(manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The verified records: ``page_id``, ``url``, ``record_type``, ``payload_digest``, ``refers_to``, ``refers_to_record``, ``record_id``, ``payload``."""
    found = candidates(manifest, range_bytes)
    entries = reached(found)
    verify(manifest, found, entries)
    ranges = entries.join(found.select("path", "at", "low"), ["path", "at"]).select("path", "low", F.col("at").alias("entry"))  # a chain enters a range once

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["page_id", "url", "record_type", "payload_digest", "refers_to", "record_id", "refers_to_record", "payload"]
        for batch in batches:
            for path, low, entry in zip(batch["path"], batch["low"], batch["entry"]):
                place, name = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with place.open_input_file(name) as file:
                    size = file.size()
                    high = min(low + range_bytes, size)
                    file.seek(entry)
                    block, base, at = file.read(min(high + HEADER_BYTES, size) - entry), entry, entry
                    while at < high:
                        block, (fields, start) = _whole_header(file, block, base, at - base, size)
                        end = start + int(fields["content-length"])
                        if end > len(block):
                            file.seek(base + start)
                            payload = file.read(end - start)
                        else:
                            payload = block[start:end]
                        page, first = fields.get("x-page-id"), fields.get("x-refers-to-page")
                        revisit = fields["warc-type"] == "revisit"
                        digest = fields["warc-payload-digest"].partition(":")[2]
                        if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{path}: the payload at {at} does not have its digest")
                        rows.append((None if page is None else int(page), fields.get("warc-target-uri"), fields["warc-type"], digest, None if first in (None, "None") else int(first), fields["warc-record-id"], fields.get("warc-refers-to"), None if revisit else payload))
                        held += len(payload)
                        at = base + end + len(END)
                        if held > 1 << 22:
                            yield _frame(rows, columns)
                            rows, held = [], 0
                yield _frame(rows, columns)

    kinds = "page_id long, url string, record_type string, payload_digest string, refers_to long, record_id string, refers_to_record string, payload binary"
    return ranges.select("path", "low", "entry").repartition(shuffle_parts(manifest.sparkSession)).mapInPandas(load, kinds)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=columns)
    return frame.astype({"page_id": "Int64", "refers_to": "Int64"})


def digests(records: DataFrame) -> DataFrame:
    """Of read records: ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``; a revisit has its response's length."""
    light = written(records.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "record_id", "refers_to_record"), "records")
    own = light.where("record_type = 'response'")
    sizes = own.groupBy(F.col("record_id").alias("refers_to_record")).agg(F.max("payload_bytes").alias("size"))
    again = light.where("record_type <> 'response'").drop("payload_bytes").join(sizes, "refers_to_record", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return own.select(columns).unionByName(again.withColumnRenamed("size", "payload_bytes").select(columns))

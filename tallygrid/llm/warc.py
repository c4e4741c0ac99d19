"""Web archives: writing WARC records with revisits, and reading them by boundary-chain verification.

Writing. Of pages with equal payloads (of ``min_bytes`` or more) the one with the smallest id becomes a response record, the others become
revisits that refer to it. Spark's text writer ends every record with the blank lines that the format asks for, so archives go to any
file system. A record has at most one row of the input; a task writes one file.

Reading. The text reader cuts the files at the magic line ``WARC/1.1``, wherever it stands, also inside payloads. A task turns every piece
that starts with a header into a candidate: where it begins and, by its Content-Length, where its successor begins. Within a file the
candidates form a chain from offset 0; pointer jumping marks what the chain reaches, and everything else was payload. Records
whose payload holds the magic come in several pieces; only those are read a second time and put together. Payload digests are computed
from what was read. A file's candidates (not its payloads) are the unit of one task.

Defined results: a null payload is empty; a null or odd url is written without line ends; an id that repeats stands for one page; a
broken chain ends its file at the break, and ``verified`` tells whether the payload has the digest its header names; empty tables
give no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.llm.textkit import byte_strings, shared_path, stored

MAGIC = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

FIELDS = "record_type string, page_id string, refers_to string, named_digest string, named_bytes long, payload_digest string, payload_bytes long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def revisits(pages: DataFrame, min_bytes: int, id_col: str, payload_col: str) -> DataFrame:
    """(page, first): pages whose payload a page with a smaller id has as well."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = byte_strings(batch.column(1))
            columns = [batch.column(0), pa.array(list(map(digest, payloads)), pa.string()), pa.array([len(p) for p in payloads], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page", "digest", "bytes"])

    found = stored(pages.select(id_col, payload_col).mapInArrow(run, f"page {kind}, digest string, bytes long").where(F.col("bytes") >= min_bytes), "payloads")
    same = found.groupBy(F.col("digest").alias("same")).agg(F.min("page").alias("first"), F.max("page").alias("last")).where("first <> last")
    same = stored(same.drop("last"), "same-payloads")
    out = found.join(same, F.col("digest") == F.col("same")).where(F.col("page") > F.col("first"))
    return stored(out.groupBy("page").agg(F.min("first").alias("first")), "revisits")


def header(page: str, url: str, payload: bytes, first: str | None) -> bytes:
    """Header and block of a record."""
    block = HTTP + payload if first is None else b""
    lines = ["WARC-Type: " + ("response" if first is None else "revisit"), f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Date: {DATE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Bytes: {len(payload)}"]
    if first is not None:
        lines += [f"WARC-Refers-To: <urn:page:{first}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return MAGIC + "\r\n".join(lines).encode() + END + block


def write(pages: DataFrame, path: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """One record per row, one archive per task."""
    again = revisits(pages, min_bytes, id_col, payload_col)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(payload_col).cast("binary").alias("payload"))
    rows = rows.join(again, F.col("id") == F.col("page"), "left")
    rows = rows.select(F.col("id").cast("string"), F.col("url").cast("string"), "payload", F.col("first").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, payloads, firsts = (c.to_pylist() for c in batch.columns)
            for lo in range(0, len(ids), 256):
                part = slice(lo, lo + 256)
                records = [header(i or "", u or "", p or b"", f) for i, u, p, f in zip(ids[part], urls[part], payloads[part], firsts[part])]
                yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], ["record"])

    records = rows.mapInArrow(run, "record binary").select(F.col("record").cast("string"))
    records.write.option("lineSep", END.decode()).text(path)


def _field(head: dict[bytes, bytes], name: bytes) -> str | None:
    value = head.get(name)
    return None if value is None else value.decode(errors="replace")


def _urn(value: str | None) -> str | None:
    return (value or "").removeprefix("<urn:page:").removesuffix(">") or None


def parse(piece: bytes) -> tuple[int, dict[bytes, bytes], int] | None:
    """(bytes of the header, its fields, bytes that header, block and end take), or None for what has no header of a record."""
    size = piece.find(END) + len(END)
    if size < len(END):
        return None
    head = dict(line.split(b": ", 1) for line in piece[: size - len(END)].split(b"\r\n") if b": " in line)
    length = head.get(b"Content-Length", b"")
    return (size, head, size + int(length) + len(END)) if length.isdigit() and b"WARC-Type" in head else None


def describe(piece: bytes) -> tuple | None:
    """The fields of a whole record, with the digest and size of its payload; those of a revisit come from its header."""
    size, head, need = parse(piece)
    kind, named = _field(head, b"WARC-Type"), (_field(head, b"WARC-Payload-Digest") or "").removeprefix("sha1:")
    named_bytes = int(_field(head, b"X-Payload-Bytes") or 0)
    own = (named, named_bytes)
    if kind != "revisit":
        block = piece[size : need - len(END)]
        payload = block[block.find(END) + len(END) :] if block.startswith(b"HTTP/") else block
        own = (digest(payload), len(payload))
    return kind, _urn(_field(head, b"WARC-Record-ID")), _urn(_field(head, b"WARC-Refers-To")), named, named_bytes, *own


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    read = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("piece"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """The rows with a number within their block of a file; a task reads a block in order."""
    last, number = None, 0
    for batch in batches:
        for file, block, piece in zip(*(c.to_pylist() for c in batch.columns)):
            number = number + 1 if (file, block) == last else 0
            last = (file, block)
            yield file, block, number, piece


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every piece: its size and, for a candidate, the bytes it needs; the record's fields where the piece holds it whole."""
    names = ["file", "block", "number", "size", "need"] + [f.split()[0] for f in FIELDS.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for file, block, number, piece in _numbered(batches):
            found = parse(piece)
            whole = describe(piece) if found is not None and found[2] == len(piece) else (None,) * 7
            rows.append((file, block, number, len(piece), None if found is None else found[2], *whole))
            if len(rows) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return _pieces(spark, path).mapInArrow(run, f"file string, block long, number long, size long, need long, {FIELDS}")


def chained(first: int, follows: np.ndarray) -> np.ndarray:
    """Which nodes the chain from ``first`` reaches, by pointer jumping; the last node is the end and follows itself."""
    reached = np.zeros(len(follows), bool)
    reached[first] = True
    jump = follows
    for _ in range(max(1, int(len(follows)).bit_length())):
        reached[jump[reached]] = True
        jump = jump[jump]
    return reached


def _reachable(file: pa.Table) -> pa.Table:
    """The pieces of the records of one file, with the record's offset, the piece's part in it and the number of parts."""
    file = file.sort_by([("block", "ascending"), ("number", "ascending")])
    size, need = file.column("size").to_numpy(), np.nan_to_num(file.column("need").to_numpy(zero_copy_only=False), nan=-1).astype(np.int64)
    n = len(size)
    begin = np.concatenate([[0], np.cumsum(size + len(MAGIC))])  # where each piece begins; its magic stands before that
    goal = np.where(need >= 0, begin[:-1] + need, -1)
    follows = np.searchsorted(begin, goal + len(MAGIC))
    ok = (need >= 0) & (follows <= n)
    ok[ok] = begin[follows[ok]] == goal[ok] + len(MAGIC)
    follows = np.where(ok, follows, n)
    reached = chained(min(1, n), np.concatenate([follows, [n]]))[:n] & ok if n > 1 and size[0] == 0 else np.zeros(n, bool)
    starts = np.flatnonzero(reached)
    parts = follows[starts] - starts
    index = np.repeat(starts, parts) + np.concatenate([np.arange(p) for p in parts]) if len(starts) else np.zeros(0, np.int64)
    owner = np.repeat(starts, parts)
    out = file.take(pa.array(index.astype(np.int64))).drop_columns(["size", "need"])
    out = out.append_column("offset", pa.array(begin[owner] - len(MAGIC), pa.int64()))
    out = out.append_column("part", pa.array((index - owner).astype(np.int64)))
    return out.append_column("parts", pa.array(np.repeat(parts, parts).astype(np.int64)))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives: type, page, payload size and digest, what a revisit refers to, and whether the digest is right."""
    layout = f"file string, block long, number long, {FIELDS}, offset long, part long, parts long"
    found = stored(stored(candidates(spark, path), "candidates").groupBy("file").applyInArrow(_reachable, layout), "records")
    fields = [f.split()[0] for f in FIELDS.split(", ")]
    whole = found.where("parts = 1").select(*fields)
    wanted = stored(found.where("parts > 1").select(F.col("file").alias("f"), F.col("block").alias("b"), F.col("number").alias("n"), "offset", "part"), "split-records")
    if not wanted.isEmpty():
        whole = whole.union(_joined(_pieces(spark, path), wanted))
    verified = (F.col("named_digest") == F.col("payload_digest")) & (F.col("named_bytes") == F.col("payload_bytes"))
    return whole.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", verified.alias("verified"))


def _joined(pieces: DataFrame, wanted: DataFrame) -> DataFrame:
    """Records put together from the pieces that the magic inside their payloads cut."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, block, n, piece in _numbered(batches):
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([n], pa.int64()), pa.array([piece], pa.binary())], ["file", "block", "number", "piece"])

    def describe_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for batch in batches:
            rows = [describe(MAGIC.join(p["piece"] for p in parts)) for parts in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], [f.split()[0] for f in FIELDS.split(", ")])

    numbered = pieces.mapInArrow(number, "file string, block long, number long, piece binary")
    own = numbered.join(wanted, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")) & (F.col("number") == F.col("n")))
    records = own.groupBy("file", "offset").agg(F.array_sort(F.collect_list(F.struct("part", "piece"))).alias("parts"))
    return records.select("parts").mapInArrow(describe_all, FIELDS)


def round_trip(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write the pages to archives in the shared folder and read those."""
    path = shared_path(pages.sparkSession, "archives")
    write(pages, path, min_bytes, id_col, url_col, payload_col)
    return read(pages.sparkSession, path)

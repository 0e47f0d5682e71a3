"""WARC archives of pages: a writer, and a sequential reader.

Every record is a gzip member of its own. Of pages with the same payload one is a ``response`` record and the others are
``revisit`` records that refer to it. The reader walks through the members of a file one after the other, inflates them
in pieces, takes as many bytes as ``Content-Length`` says, and verifies the block digest.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outpulse.llm.common import shared_folder

#: A task starts another archive after so many compressed bytes, so a reader's task holds no more than that and a record.
ARCHIVE_BYTES = 16 << 20
#: Bytes that the reader inflates at a time.
PIECE = 64 << 10

_PAGE = "urn:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Closes a member of 16 MiB or more, see ``members``.
_EMPTY_MEMBER = zlib.compress(b"", wbits=31)

RECORD = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("refers_to", pa.int64()),
        ("payload", pa.binary()),
        ("problem", pa.string()),
    ]
)
RECORD_DDL = (
    "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, "
    "payload binary, problem string"
)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _header_value(text: str | None) -> str:
    """A header line must stay one line."""
    return (text or "").replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, revisits: bool, head: int | None) -> bytes:
    """The bytes of one record. A revisit has an empty block and the digest and length of the full payload."""
    block = b"" if revisits else payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisits else 'response'}",
        f"WARC-Record-ID: <{_PAGE}{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {_header_value(url)}" if url is not None else None,
        f"WARC-Profile: {_PROFILE}" if revisits else None,
        f"WARC-Refers-To: <{_PAGE}{head}>" if revisits else None,
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(line for line in lines if line is not None).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(rows: Iterator[tuple], archive_bytes: int = ARCHIVE_BYTES) -> Iterator[tuple[int, bytes]]:
    """``(number of the archive, gzip member)`` of each row, every member ending in a zero byte.

    The last byte of a member is the highest byte of its length, zero below 16 MiB. From there on an empty member
    follows, which readers skip.
    """
    archive, size = 0, 0
    for row in rows:
        plain = record(*row)
        packer = zlib.compressobj(wbits=31)
        member = packer.compress(plain) + packer.flush()
        if member[-1]:
            member += _EMPTY_MEMBER
        if size and size + len(member) > archive_bytes:
            archive, size = archive + 1, 0
        size += len(member)
        yield archive, member


def _write_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()

    def rows() -> Iterator[tuple]:
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for page_id, url, payload, revisits, head in zip(*columns):
                yield page_id, url, payload or b"", revisits, head

    names, values, size = [], [], 0
    for archive, member in members(rows()):
        # Spark's text writer ends each value with the separator, here the member's last byte.
        names.append(f"{task:06d}-{archive:05d}")
        values.append(member[:-1])
        size += len(member)
        if size > 8 << 20:
            yield pa.record_batch([pa.array(names, pa.string()), pa.array(values, pa.binary())], ["archive", "value"])
            names, values, size = [], [], 0
    if values:
        yield pa.record_batch([pa.array(names, pa.string()), pa.array(values, pa.binary())], ["archive", "value"])


def with_heads(pages: DataFrame, payload: Column, min_bytes: int = 0) -> DataFrame:
    """``pages(page_id, url, ...)`` with ``payload``, ``revisits`` and ``head``.

    Equal payloads of at least ``min_bytes`` have the largest ``page_id`` among them as head. Only payloads that occur
    under several ids take part in the join back; Spark splits the rows of a frequent one.
    """
    held = pages.select("page_id", "url", payload.alias("payload"))
    keyed = held.withColumn("digest", F.sha1("payload"))
    # A null id and a number are two ids.
    several = F.max("page_id").isNotNull() & ((F.max("page_id") != F.min("page_id")) | (F.count("page_id") < F.count("*")))
    heads = keyed.filter(F.length("payload") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("head"), several.alias("several"))
    joined = keyed.join(heads.filter("several").select("digest", "head"), "digest", "left")
    revisits = F.coalesce(F.col("head").isNotNull() & ~F.col("head").eqNullSafe(F.col("page_id")), F.lit(False))
    return joined.select("page_id", "url", "payload", revisits.alias("revisits"), "head")


def write_archives(pages: DataFrame, path: str, html: str = "html", min_bytes: int = 0) -> None:
    """Writes a record per row of ``pages(page_id, url, html)`` below ``path``, which must be new.

    A null html is an empty payload. Rows that repeat the id and payload of a response are responses as well, as a
    record cannot refer to itself. A null id never is the head of another page. Other columns are not read.

    The files are written by Spark's text writer, so any store that Spark reaches will do, and a task that is run again
    leaves no second copy.
    """
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = with_heads(pages, payload, min_bytes)
    packed = rows.mapInArrow(_write_batches, "archive string, value binary")
    packed.select("archive", F.col("value").cast("string").alias("value")).write.partitionBy("archive").option(
        "lineSep", "\0"
    ).text(path)


class _Members:
    """Inflates the members of a file piece by piece."""

    def __init__(self, data: bytes):
        self.data, self.at = memoryview(data), 0

    def pieces(self) -> Iterator[bytes]:
        """The plain bytes of the next member; afterwards ``at`` is where the one after it begins."""
        inflater, pending = zlib.decompressobj(wbits=31), b""
        while not inflater.eof:
            if not pending:
                pending = bytes(self.data[self.at : self.at + PIECE])
                if not pending:
                    raise ValueError("the file ends inside a member")
                self.at += len(pending)
            plain = inflater.decompress(pending, PIECE)
            pending = inflater.unconsumed_tail
            if plain:
                yield plain
        self.at -= len(inflater.unused_data)


def _page_of(value: str | None) -> int | None:
    number = (value or "").strip("<>").removeprefix(_PAGE)
    return int(number) if number.lstrip("-").isdigit() else None


def read_record(pieces: Iterator[bytes]) -> dict | None:
    """The record of a member, or None for an empty member. Raises ValueError when it is malformed."""
    head = b""
    while (end := head.find(b"\r\n\r\n")) < 0:
        piece = next(pieces, None)
        if piece is None:
            if head:
                raise ValueError("a header without end")
            return None
        head += piece
    version, *lines = head[:end].decode("utf-8", "replace").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
    length = int(headers["content-length"])
    digest, block, rest = hashlib.sha1(), [], head[end + 4 :]
    left = length
    while True:
        part = rest[:left]
        digest.update(part)
        block.append(part)
        left -= len(part)
        rest = rest[len(part) :]
        if not left:
            break
        rest = next(pieces, None)
        if rest is None:
            raise ValueError("the block is shorter than its length")
    tail = rest + b"".join(pieces)
    if tail != b"\r\n\r\n":
        raise ValueError("the record does not end after its block")
    found = f"sha1:{base64.b32encode(digest.digest()).decode()}"
    if headers.get("warc-block-digest", found) != found:
        raise ValueError("the block digest differs")
    payload_digest = headers.get("warc-payload-digest", found).removeprefix("sha1:")
    kind = headers.get("warc-type")
    if kind != "revisit" and f"sha1:{payload_digest}" != found:
        raise ValueError("the payload digest differs")
    bytes_in_full = headers.get("x-payload-length") if kind == "revisit" else length
    return {
        "page_id": _page_of(headers.get("warc-record-id")),
        "url": headers.get("warc-target-uri"),
        "record_type": kind,
        "payload_bytes": None if bytes_in_full is None else int(bytes_in_full),
        "payload_digest": payload_digest,
        "refers_to": _page_of(headers.get("warc-refers-to")),
        "payload": b"".join(block) if kind != "revisit" else None,
        "problem": None,
    }


def read_file(data: bytes) -> Iterator[dict]:
    """The records of a file, one by one. A record that is malformed, or a broken rest of the file, is a row with
    ``problem`` set."""
    source = _Members(data)
    while source.at < len(data):
        pieces = source.pieces()
        try:
            found = read_record(pieces)
        except (ValueError, KeyError) as error:
            found = dict.fromkeys(RECORD.names) | {"problem": str(error)}
        except zlib.error as error:
            yield dict.fromkeys(RECORD.names) | {"problem": str(error)}
            return
        try:
            for _ in pieces:
                pass
        except (ValueError, zlib.error) as error:
            yield dict.fromkeys(RECORD.names) | {"problem": str(error)}
            return
        if found is not None:
            yield found


def _read_batches(with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for row in read_file(content.as_py()):
                    size += len(row["payload"] or b"")
                    rows.append(row if with_payload else row | {"payload": None})
                    if size > 8 << 20 or len(rows) == 10_000:
                        yield pa.RecordBatch.from_pylist(rows, RECORD)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, RECORD)

    return read


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row per record of the archives below ``path``; rows that could not be read have ``problem`` set.

    A file is one task's work, as only a walk from its start finds the members.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(_read_batches(with_payload), RECORD_DDL)


def round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` written to archives in the shared folder and read back."""
    import uuid

    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, min_bytes=min_bytes)
    return read_archives(spark, path, with_payload=False)

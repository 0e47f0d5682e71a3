"""Best-fit packing of tokenised documents into sequences of fixed length.

Bounded-space online best-fit: a task packs the pieces that arrive one after the other with a fixed number of open
sequences. A bitset with a bit per free space finds the fullest open sequence that still takes a piece. When none does
and all are open, the fullest closes.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outpulse.llm.common import as_bytes

CAPACITY = 1024
END_ID = 2
OPEN_BINS = 8192
#: Pieces that arrive at a time; of these the longest is placed first.
ARRIVING = 4096
#: Text that the byte-level vocabulary knows as one special token.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256

PIECES_DDL = "row_no bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED_DDL = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


def load_encoding(ranks: str, pattern: str):
    """The byte-level BPE of a rank file. Its ids are those of the JSON file of the same vocabulary."""
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("pack", pat_str=pattern, mergeable_ranks=table, special_tokens={SPECIAL: SPECIAL_ID})


def token_ids(encoding, text: str) -> list[int]:
    """As ``tokenizers`` encodes with ``add_special_tokens=False``: the special token's own text is its id."""
    return encoding.encode(text, allowed_special="all") if SPECIAL in text else encoding.encode_ordinary(text)


def cut(ids: list[int], capacity: int = CAPACITY) -> Iterator[tuple[int, int, int]]:
    """``(start, length, crc32)`` of the pieces: whole capacities, a shorter rest first."""
    packed = memoryview(np.asarray(ids, "<u4").tobytes())
    start, length = 0, len(ids) % capacity or capacity
    while start < len(ids):
        yield start, length, zlib.crc32(packed[4 * start : 4 * (start + length)])
        start, length = start + length, capacity


class BestFit:
    """Places pieces one by one; ``place`` returns the number of the sequence and the offset in it."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.most = capacity, open_bins
        self.bits = 0  # bit f is set when an open sequence has f free
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open, self.next = 0, 0

    def _take(self, free: int) -> int:
        found = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits ^= 1 << free
        return found

    def place(self, length: int) -> tuple[int, int]:
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
            self.open -= 1
        else:
            free, number = self.capacity, self.next
            self.next += 1
            if length < free and self.open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.open -= 1
        left = free - length
        if left:
            self.bits |= 1 << left
            self.by_free[left].append(number)
            self.open += 1
        return number, self.capacity - free


def _cut_batches(ranks: str, pattern: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(ranks, pattern)
        for batch in batches:
            rows = []
            numbers, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for number, doc_id, text in zip(numbers, ids, as_bytes(batch.column(2))):
                tokens = token_ids(encoding, text.decode("utf-8", "replace"))
                tokens.append(END_ID)
                rows += [(number, doc_id, i, *piece) for i, piece in enumerate(cut(tokens, capacity))]
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                names = ["row_no", "doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def _arriving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in groups of ``ARRIVING``, the last one smaller."""
    held, rows = [], 0
    for batch in batches:
        while len(batch):
            part = batch.slice(0, ARRIVING - rows)
            held.append(part)
            rows += len(part)
            batch = batch.slice(len(part))
            if rows == ARRIVING:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _pack_batches(capacity: int, open_bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # Sequences of different tasks have different numbers.
        base = TaskContext.get().partitionId() << 33
        packer = BestFit(capacity, open_bins)
        for batch in _arriving(batches):
            batch = batch.sort_by([("length", "descending"), ("row_no", "ascending"), ("piece", "ascending")])
            placed = [packer.place(length) for length in batch.column("length").to_pylist()]
            sequence = pa.array([base + number for number, _ in placed], pa.int64())
            offset = pa.array([at for _, at in placed], pa.int64())
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.record_batch([*kept, sequence, offset], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(
    docs: DataFrame, ranks: str, pattern: str, text: str = "text", capacity: int = CAPACITY, open_bins: int = OPEN_BINS
) -> DataFrame:
    """A row per piece of ``docs(doc_id, text)`` with its place in a sequence; other columns are not read.

    Null and empty texts are one piece, the end id alone. Rows with the same or no id are documents of their own. No
    documents give no rows. ``ranks`` and ``pattern`` are the vocabulary file and the pre-token pattern.

    Documents are tokenised where they are read. Only the narrow rows of their pieces are shuffled, by a hash of the row
    number, to tasks of the size that Spark advises, and packed there in hash order. A rerun of a task repeats it, and
    at most ``open_bins`` sequences of a task stay partly empty.
    """
    from outpulse.llm.common import numbered

    numbered_docs = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")))
    pieces = numbered_docs.select("row_no", "doc_id", "text").mapInArrow(_cut_batches(ranks, pattern, capacity), PIECES_DDL)
    dealt = pieces.repartition(F.xxhash64("row_no", "piece")).sortWithinPartitions(F.xxhash64("row_no", "piece"))
    return dealt.mapInArrow(_pack_batches(capacity, open_bins), PACKED_DDL)

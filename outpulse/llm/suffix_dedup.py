"""Removal of byte strings that occur more than once anywhere in a corpus.

Every window of ``size`` bytes is filed under an anchor, that of the ``ANCHOR``-byte strings inside it that has the
smallest hash, the last one of equals. Equal windows have equal anchors at the same place, so a window can repeat only
under an anchor that occurs elsewhere. Successive windows of a text with their anchor at one place form a piece. Pieces of
repeated anchors are brought together and equal ones folded into one with a count. Where each piece of an anchor has a copy,
all are repeated; the texts of the others are indexed by a Burrows-Wheeler transform. Breadth-first backward extension of its intervals then
derives the common prefixes of neighbouring suffixes by increasing value and stops at ``size``: what has got no value by
then agrees in ``size`` bytes or more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outpulse.llm.common import ROW, as_bytes, light, numbered, written
from outpulse.llm.rolling import all_stretches, prefix_hashes, stretches

SIZE = 200
#: Bytes hashed for an anchor, at most ``SIZE``. Longer anchors are more, but fewer of them are shared by chance.
ANCHOR = 40
#: Distinct pieces of an anchor beyond which each of their windows is filed under its own hash instead.
HOT_PIECES = 4096
#: Piece bytes that a task indexes on average.
SHARD_BYTES = 2 << 20
#: Bytes hashed at a time, few enough for a processor's cache.
BLOCK = 1 << 17
_PLACE = np.uint64((1 << 18) - 1)

_PIECES_DDL = f"{ROW} bigint, anchor bigint, content bigint, start bigint, windows int"
_FOUND_DDL = "anchor bigint, content bigint, found array<int>"


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` successive values."""
    n = len(values) - width + 1
    rows = -(-len(values) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _block_pieces(data: np.ndarray, ends: np.ndarray, size: int, anchor: int):
    """``(start, windows, anchor, content)`` of the pieces of some joined texts that end at ``ends``."""
    sums = prefix_hashes(data)
    hashes = all_stretches(sums, anchor)
    # The low bits give the place, counted from behind.
    least = _window_minima(hashes & ~_PLACE | _PLACE - np.arange(len(hashes), dtype=np.uint64), size - anchor + 1)
    # A window must not reach over the end of its text.
    starts = np.arange(len(least))
    lengths = np.diff(ends, prepend=0)
    inside = starts <= np.repeat(ends - size, lengths)[: len(least)]
    new = np.ones(len(least), bool)
    np.not_equal(least[1:], least[:-1], out=new[1:])
    new[ends[ends < len(least)]] = True
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(least)))
    # Windows that reach over an end are the last ones of their text.
    valid = np.add.reduceat(inside, first) if len(first) else count
    keep = valid > 0
    first, count = first[keep], valid[keep]
    content = stretches(sums, first, first + count + size - 1)
    return first, count, hashes[(_PLACE - (least[first] & _PLACE)).astype(np.int64)], content


def pieces_of(texts: list[bytes], size: int = SIZE, anchor: int = ANCHOR) -> Iterator[tuple]:
    """``(text, start, windows, anchor, content)`` as arrays, a block of texts at a time."""
    most = BLOCK

    def block(members: list[tuple[int, int, bytes]]):
        lengths = np.array([len(m[2]) for m in members])
        ends = np.cumsum(lengths)
        data = np.frombuffer(b"".join(m[2] for m in members), np.uint8)
        first, count, least, content = _block_pieces(data, ends, size, anchor)
        member = np.searchsorted(ends, first, "right")
        which = np.array([m[0] for m in members])[member]
        start = first - (ends - lengths)[member] + np.array([m[1] for m in members])[member]
        return which, start, count, least.view(np.int64), content.view(np.int64)

    members, held = [], 0
    for i, text in enumerate(texts):
        # A long text is cut into blocks that overlap by less than a window, so no window is lost or taken twice.
        for at in range(0, max(0, len(text) - size + 1), most - size + 1):
            part = text[at : at + most]
            if held + len(part) > most and members:
                yield block(members)
                members, held = [], 0
            members.append((i, at, part))
            held += len(part)
    if members:
        yield block(members)


def _piece_batches(size: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy(zero_copy_only=False)
            for which, start, count, least, content in pieces_of(as_bytes(batch.column(1)), size, anchor):
                yield pa.record_batch(
                    [pa.array(rows[which]), pa.array(least), pa.array(content), pa.array(start), pa.array(count.astype(np.int32))],
                    [ROW, "anchor", "content", "start", "windows"],
                )

    return run


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols, by prefix doubling; ties in any order."""
    n = len(codes)
    key = np.zeros(n, np.int64)
    padded = np.concatenate([codes.astype(np.int64), np.zeros(7, np.int64)])
    for j in range(7):
        key = key * 257 + padded[j : j + n]
    order = np.argsort(key)
    done = 7
    sorted_key = key[order]
    while True:
        new = np.ones(n, bool)
        new[1:] = sorted_key[1:] != sorted_key[:-1]
        # A suffix's rank is the place of the first one that it ties with.
        place = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        if done >= depth or new.all():
            return order
        rank = np.empty(n, np.int64)
        rank[order] = place
        tied = ~new
        tied[:-1] |= ~new[1:]
        where = np.flatnonzero(tied)
        suffix = order[where]
        after = suffix + done
        behind = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        # Ties stay together: their rank is the higher part of the key.
        sub = np.argsort(place[where] * np.int64(n + 1) + behind)
        order[where] = suffix[sub]
        sorted_key = place.copy() * np.int64(n + 1)
        sorted_key[where] = (place[where] * np.int64(n + 1) + behind)[sub]
        done *= 2


def open_boundaries(codes: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each place in ``order``, whether it shares at least ``depth`` symbols with the place before it.

    Intervals of the Burrows-Wheeler transform are extended backwards, breadth first: the intervals of all strings of
    length L give the boundaries where L symbols are common before any longer ones are looked at. Symbol 0 parts the
    texts and is never extended over.
    """
    n = len(codes)
    transform = codes[order - 1]
    by_symbol = np.argsort(transform, kind="stable")
    step = np.empty(n, np.int64)  # the place of the suffix that is one symbol longer
    step[by_symbol] = np.arange(n)
    follower = np.full(n, n, np.int64)  # the next place with the same symbol
    same = transform[by_symbol[1:]] == transform[by_symbol[:-1]]
    follower[by_symbol[:-1][same]] = by_symbol[1:][same]
    leader = np.full(n, -1, np.int64)
    leader[by_symbol[1:][same]] = by_symbol[:-1][same]
    unset = np.ones(n + 1, bool)
    unset[0] = unset[n] = False
    low, high = np.array([0]), np.array([n - 1])
    for _ in range(depth):
        width = high - low + 1
        total = int(width.sum())
        if not total:
            break
        begin = np.cumsum(width) - width
        place = np.arange(total) + np.repeat(low - begin, width)
        keep = transform[place] != 0
        last = keep & (follower[place] > np.repeat(high, width))
        first = keep & (leader[place] < np.repeat(low, width))
        # The extended intervals do not overlap, so their sorted ends and starts belong together.
        ends, starts = np.sort(step[place[last]]), np.sort(step[place[first]])
        fresh = unset[ends + 1]
        unset[ends + 1] = False
        if low[0] == 0 and high[0] == n - 1:
            unset[np.count_nonzero(codes == 0)] = False
            # The end of the text belongs to no boundary, but its interval goes on.
            fresh |= ends + 1 == n
        low, high = starts[fresh], ends[fresh]
    return unset[:n]


def repeated_windows(texts: list[bytes], size: int = SIZE) -> list[np.ndarray]:
    """For each text, which of its windows of ``size`` bytes start at another place of any of the texts as well."""
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = np.zeros(int(lengths.sum()) + len(texts), np.uint16)
    begin = np.cumsum(lengths + 1) - lengths - 1
    for at, text in zip(begin, texts):
        codes[at : at + len(text)] = np.frombuffer(text, np.uint8)
        codes[at : at + len(text)] += 1
    order = suffix_order(codes, size)
    joined = open_boundaries(codes, order, size)
    whole = np.zeros(len(codes), bool)
    for at, length in zip(begin, lengths):
        whole[at : at + max(0, length - size + 1)] = True
    fits = whole[order]
    pair = joined & fits
    pair[1:] &= fits[:-1]
    pair[0] = False
    either = pair.copy()
    either[:-1] |= pair[1:]
    found = np.zeros(len(codes), bool)
    found[order] = either
    return [found[at : at + max(0, length - size + 1)] for at, length in zip(begin, lengths)]


def runs_of(flags: np.ndarray) -> np.ndarray:
    """Starts and stops of the runs of set flags, by turns."""
    return np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]])))


def _shard_batches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, contents, copies, texts = [], [], [], []
        for batch in batches:
            anchors += batch.column("anchor").to_pylist()
            contents += batch.column("content").to_pylist()
            copies += batch.column("copies").to_pylist()
            texts += batch.column("bytes").to_pylist()
        if not texts:
            return
        found = []
        for flags, n in zip(repeated_windows(texts, size), copies):
            found.append([0, len(flags)] if n > 1 else runs_of(flags).tolist())
        yield pa.record_batch(
            [pa.array(anchors, pa.int64()), pa.array(contents, pa.int64()), pa.array(found, pa.list_(pa.int32()))],
            ["anchor", "content", "found"],
        )

    return run


def _texts_of_pieces(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "content", "copies", "bytes"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for text, pieces in zip(as_bytes(batch.column("text")), batch.column("pieces").to_pylist()):
                rows = [(p["anchor"], p["content"], p["copies"], text[p["start"] : p["start"] + p["windows"] + size - 1]) for p in pieces]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def repeated_spans(docs: DataFrame, size: int = SIZE, anchor: int = ANCHOR, hot: int = HOT_PIECES) -> DataFrame:
    """``(row_no, spans)`` of the rows of ``docs(row_no, text)`` with a repeated window; ``spans`` are unmerged
    ``(start, windows)``, several to a row."""
    texts = docs.select(ROW, F.col("text"))
    pieces = texts.mapInArrow(_piece_batches(size, anchor), _PIECES_DDL)
    # Only counts leave the first pass; a frequent anchor is summed up on the map side.
    anchors = pieces.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    shared = written(pieces.join(anchors, "anchor"), "pieces")
    distinct = shared.groupBy("anchor", "content").agg(
        F.count("*").alias("copies"), F.min_by(F.struct(ROW, "start", "windows"), F.struct(ROW, "start")).alias("at")
    )
    distinct = written(distinct, "distinct-pieces")
    # Where every piece of an anchor has a copy, all its windows repeat. Only the other anchors are searched.
    counts = distinct.groupBy("anchor").agg(F.count("*").alias("n"), F.min("copies").alias("fewest"))
    searched = light(written(counts.filter("fewest = 1").select("anchor", "n"), "searched-anchors"))
    whole = distinct.join(searched, "anchor", "left_anti").select("anchor", "content", F.array(F.lit(0), F.col("at.windows")).alias("found"))
    distinct = written(distinct.join(searched, "anchor"), "searched-pieces")
    singly = _window_by_window(texts, distinct.filter(F.col("n") > hot), size)
    distinct = distinct.filter(F.col("n") <= hot)
    total = distinct.agg(F.sum(F.col("at.windows") + size - 1)).first()[0] or 0
    shards = int(max(1, -(-total // SHARD_BYTES)))
    wanted = distinct.groupBy(F.col(f"at.{ROW}").alias(ROW)).agg(
        F.collect_list(F.struct("anchor", "content", "copies", "at.start", "at.windows")).alias("pieces")
    )
    indexed = (
        texts.join(wanted, ROW)
        .mapInArrow(_texts_of_pieces(size), "anchor bigint, content bigint, copies bigint, bytes binary")
        .repartition(shards, "anchor")
        .mapInArrow(_shard_batches(size), _FOUND_DDL)
        .filter(F.size("found") > 0)
    )
    indexed = written(indexed.unionByName(singly).unionByName(whole), "repeated-pieces")
    spans = F.transform(
        F.sequence(F.lit(0), F.size("found") - 2, F.lit(2)),
        lambda i: F.struct(
            (F.col("start") + F.element_at("found", i + 1)).alias("start"),
            (F.element_at("found", i + 2) - F.element_at("found", i + 1)).alias("windows"),
        ),
    )
    return shared.join(indexed, ["anchor", "content"]).select(ROW, spans.alias("spans"))


def _window_by_window(texts: DataFrame, pieces: DataFrame, size: int) -> DataFrame:
    """``(anchor, content, found)`` of pieces whose anchor has too many different ones for a shard.

    Equal windows have equal hashes. A window counts as often as there are copies of its piece, so that only different
    pieces are taken apart, and no copy is looked at again.
    """
    wanted = pieces.groupBy(F.col(f"at.{ROW}").alias(ROW)).agg(
        F.collect_list(F.struct("anchor", "content", "copies", "at.start", "at.windows")).alias("pieces")
    )
    ddl = "anchor bigint, content bigint, copies bigint, hash bigint, place int"
    windows = written(texts.join(wanted, ROW).mapInArrow(_single_windows(size), ddl), "single-windows")
    again = windows.groupBy("hash").agg(F.sum("copies").alias("n")).filter("n > 1").select("hash")
    again = light(written(again, "repeated-windows"))
    places = windows.join(again, "hash").groupBy("anchor", "content").agg(F.array_sort(F.collect_list("place")).alias("places"))
    found = F.flatten(F.transform("places", lambda at: F.array(at, at + 1)))
    return places.select("anchor", "content", found.alias("found"))


def _single_windows(size: int):
    names = ["anchor", "content", "copies", "hash", "place"]

    def told(pieces: list[dict], hashes: list[np.ndarray]) -> pa.RecordBatch:
        counts = [len(h) for h in hashes]
        same = [np.repeat(np.array([p[name] for p in pieces], np.int64), counts) for name in names[:3]]
        places = np.concatenate([np.arange(n, dtype=np.int32) for n in counts])
        return pa.record_batch([pa.array(c) for c in (*same, np.concatenate(hashes), places)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, hashes, held = [], [], 0
        for batch in batches:
            for text, found in zip(as_bytes(batch.column("text")), batch.column("pieces").to_pylist()):
                for p in found:
                    data = np.frombuffer(text[p["start"] : p["start"] + p["windows"] + size - 1], np.uint8)
                    pieces.append(p)
                    hashes.append(all_stretches(prefix_hashes(data), size).view(np.int64))
                    held += p["windows"]
                    if held > BLOCK:
                        yield told(pieces, hashes)
                        pieces, hashes, held = [], [], 0
        if pieces:
            yield told(pieces, hashes)

    return run


def merged(spans: list[dict], size: int) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that ``(start, windows)`` cover."""
    runs: list[list[int]] = []
    for start, stop in sorted((s["start"], s["start"] + s["windows"] + size - 1) for s in spans):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], stop)
        else:
            runs.append([start, stop])
    return [tuple(r) for r in runs]


def whole_characters(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs without the bytes of characters that they cut in two."""
    inner = []
    for start, stop in runs:
        while start < stop and start < len(text) and text[start] & 0xC0 == 0x80:
            start += 1
        while stop > start and stop < len(text) and text[stop] & 0xC0 == 0x80:
            stop -= 1
        if start < stop:
            inner.append((start, stop))
    return inner


def kept_bytes(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """What is left without the runs."""
    parts, at = [], 0
    for start, stop in runs:
        parts.append(text[at:start])
        at = stop
    return b"".join([*parts, text[at:]])


_REMOVED = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")]
    + [T.StructField("kept_sha256", T.StringType()), T.StructField("kept_text", T.StringType())]
)


def _removal(size: int, with_text: bool):
    def remove(text: pa.Array, spans: pa.Array) -> pa.Array:
        rows = []
        for value, found in zip(as_bytes(text), spans.to_pylist()):
            runs = merged([s for one in found or [] for s in one], size)
            kept = kept_bytes(value, runs)
            shown = kept_bytes(value, whole_characters(value, runs)).decode("utf-8", "replace") if with_text else None
            rows.append((len(value), len(value) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), shown))
        columns = zip(*rows) if rows else [()] * 5
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], _REMOVED.names)

    remove.__annotations__ = {"text": pa.Array, "spans": pa.Array, "return": pa.Array}
    return F.arrow_udf(remove, _REMOVED).asNondeterministic()


def dedup(docs: DataFrame, text: str = "text", size: int = SIZE, with_text: bool = True, anchor: int = ANCHOR, hot: int = HOT_PIECES) -> DataFrame:
    """``docs`` as struct column ``doc`` with ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``kept_text``.

    Every byte inside a string of ``size`` bytes that also starts elsewhere, in the same text or another, is removed;
    texts are judged as given. A null or empty text has no bytes. Rows that repeat others lose what they share like any
    other. ``kept_text`` keeps characters whole, so a character that a run cuts in two stays (``null`` without
    ``with_text``). Columns of any names may stand beside.

    Anchors are a hundredth of the text, and only counts, and pieces of anchors that occur twice, are shuffled. Tasks
    index the distinct pieces of an anchor, unless each has a copy; an anchor with more than ``hot`` of them is dissolved into windows.
    """
    rows = numbered(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(text).cast("string").alias("text")))
    spans = repeated_spans(rows, size, anchor, hot)
    per_row = spans.groupBy(ROW).agg(F.collect_list("spans").alias("spans"))
    remove = _removal(size, with_text)
    return rows.join(per_row, ROW, "left").select("doc", remove("text", "spans").alias("r")).select("doc", "r.*")

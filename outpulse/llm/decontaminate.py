"""Benchmark decontamination with an Aho-Corasick automaton.

Benchmark texts are normalised to words and every window of consecutive words is a pattern. Each document is normalised
the same way and scanned once; hits are mapped back to words and to byte offsets of the original text.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outpulse.llm.common import ROW, as_bytes, numbered

WINDOW = 10
#: Benchmark bytes of one automaton. Each byte is in up to ten windows, so this is some 200 MB in a Python worker.
AUTOMATON_BYTES = 1 << 19

#: Fixed by the word rule: digits, letters and everything beyond ASCII stay, A-Z in lower case, the rest parts words.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)

_RUN = T.StructType([T.StructField(name, T.LongType()) for name in ("first", "last", "start", "stop")])
_HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(_RUN)),
        T.StructField("items", T.ArrayType(T.LongType())),
    ]
)
_ARROW_RUN = pa.struct([(name, pa.int64()) for name in ("first", "last", "start", "stop")])


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def windows_of(words: list[bytes], size: int) -> Iterator[str]:
    """Every window as a pattern with a blank on either side; a shorter text is one window, an empty one none."""
    for i in range(max(1, len(words) - size + 1) if words else 0):
        yield f" {b' '.join(words[i : i + size]).decode('latin-1')} "


class Scanner:
    """One automaton over the windows of ``items(item_id, text)``. A null item id hits, but is not listed."""

    def __init__(self, items: list[tuple[int | None, bytes]], size: int):
        owners: dict[str, set] = {}
        for item_id, text in items:
            for window in windows_of(words_of(text), size):
                owners.setdefault(window, set()).add(item_id)
        self.automaton = ahocorasick.Automaton()
        for window, ids in owners.items():
            self.automaton.add_word(window, (window.count(" ") - 1, tuple(i for i in ids if i is not None)))
        self.empty = not owners
        if not self.empty:
            self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int, int, int]], list[int]]:
        """Number of words, runs of hit words (first word, word after the last, first byte, byte after the last), items."""
        folded = text.translate(_FOLD)
        words = folded.split()
        if self.empty or not words:
            return len(words), [], []
        plain = f" {b' '.join(words).decode('latin-1')} "
        found = list(self.automaton.iter(plain))
        if not found:
            return len(words), [], []
        blanks = np.cumsum(np.frombuffer(plain.encode("latin-1"), np.uint8) == 0x20)
        edge = np.zeros(len(words) + 1, np.int64)
        items: set[int] = set()
        for end, (length, ids) in found:
            after = blanks[end] - 1
            edge[after - length] += 1
            edge[after] -= 1
            items.update(ids)
        # Word starts and stops in the original: folding keeps every byte in its place.
        inside = np.concatenate([[False], np.frombuffer(folded, np.uint8) != 0x20, [False]])
        bounds = np.flatnonzero(inside[1:] != inside[:-1])
        turns = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])))
        runs = [(int(a), int(b), int(bounds[2 * a]), int(bounds[2 * b - 1])) for a, b in zip(turns[::2], turns[1::2])]
        return len(words), runs, sorted(items)


def merge_runs(runs: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Runs of several scans of a text as maximal runs."""
    merged: list[list[int]] = []
    for first, last, start, stop in sorted(runs):
        if merged and first <= merged[-1][1]:
            if last > merged[-1][1]:
                merged[-1][1], merged[-1][3] = last, stop
        else:
            merged.append([first, last, start, stop])
    return [tuple(run) for run in merged]


def _as_struct(rows: list[tuple]) -> pa.Array:
    n_words, runs, items = zip(*rows) if rows else ((), (), ())
    named = [[dict(zip(("first", "last", "start", "stop"), run)) for run in one] for one in runs]
    return pa.StructArray.from_arrays(
        [pa.array(n_words, pa.int64()), pa.array(named, pa.list_(_ARROW_RUN)), pa.array(items, pa.list_(pa.int64()))],
        ["n_words", "runs", "items"],
    )


def _scan_udf(spark: SparkSession, items: list[tuple[int | None, bytes]], size: int):
    """The scan of a text column. Each Python worker builds the automaton once."""
    sent, held = spark.sparkContext.broadcast(items), {}

    def scan(text: pa.Array) -> pa.Array:
        if not held:
            held["scanner"] = Scanner(sent.value, size)
        return _as_struct([held["scanner"].scan(value) for value in as_bytes(text)])

    scan.__annotations__ = {"text": pa.Array, "return": pa.Array}
    return F.arrow_udf(scan, _HITS).asNondeterministic()


@F.arrow_udf(_HITS)
def _merge(scans: pa.Array) -> pa.Array:
    rows = []
    for of_one in scans.to_pylist():
        runs = merge_runs([tuple(run.values()) for scan in of_one for run in scan["runs"]])
        rows.append((of_one[0]["n_words"], runs, sorted({i for scan in of_one for i in scan["items"]})))
    return _as_struct(rows)


def scanned(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", size: int = WINDOW, automaton_bytes: int = AUTOMATON_BYTES
) -> DataFrame:
    """``docs`` as struct column ``doc`` with ``n_words``, ``runs`` and ``items``.

    ``benchmark`` has ``item_id`` and ``text``. Any other columns on either side. Null and empty texts have no words.
    Items of fewer than ``size`` words are one window, items without words none. Repeated items count once; an item
    without id hits, but is not listed. Texts are scanned whole.

    The benchmark goes to every executor in one automaton while it is small. A larger one is dealt to several, of
    ``automaton_bytes`` on average, each with a scan of its own; their hits are joined by row.
    """
    spark = docs.sparkSession
    items = benchmark.select("item_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = max(1, -(-total // automaton_bytes))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(text).cast("binary").alias("t"))
    if passes == 1:
        scan = _scan_udf(spark, [tuple(r) for r in items.collect()], size)
        return rows.select("doc", scan("t").alias("h")).select("doc", "h.*")
    rows, every = numbered(rows), None
    for i in range(passes):
        share = items.filter(F.pmod(F.xxhash64("text"), F.lit(passes)) == i)
        scan = _scan_udf(spark, [tuple(r) for r in share.collect()], size)
        hits = rows.select(ROW, scan("t").alias("h"))
        every = hits if every is None else every.unionByName(hits)
    merged = every.groupBy(ROW).agg(F.collect_list("h").alias("scans")).select(ROW, _merge("scans").alias("h"))
    return rows.select(ROW, "doc").join(merged, ROW).select("doc", "h.*")


def n_hit(runs: Column) -> Column:
    return F.aggregate(runs, F.lit(0).cast("long"), lambda total, run: total + run.last - run.first)


def items_digest(items: Column) -> Column:
    """SHA-256 of the ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(F.transform(items, lambda i: i.cast("string"))), ",").cast("binary"), 256)

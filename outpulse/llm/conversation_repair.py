"""The cheapest edits that turn conversations into ``system? (user assistant)+``, or into nothing.

A row becomes a symbol: what it may stay (by its role's initial, and whether it is truncated) or that it has to go. Rows
of a conversation are strings of symbols, in segments of bounded length. Equal segments are looked at once, whichever
conversations they come from: a Re-Pair grammar is made of many segments, every rule has one min-plus matrix of the
costs between states of the target pattern, with the edits as a rope, and matrices are multiplied bottom-up. A
conversation is the product of its segments' matrices in order. Its texts are then streamed once, in order, beside the
edits, and hashed as they pass.

Rows are told by turn (nulls first); rows of one turn keep their order in the files. Only the digest of a conversation
needs all its texts in one task; they pass through it row by row, sorted on disk.

Defined results: a null role, text, id or turn reads as one space where it is text; conversations of a null id are one
conversation. An empty role is like one of an unknown initial. Repeated rows are duplicates like any other. A
conversation without rows after the damage has zeros, no edits and the digest of nothing. An empty table gives no rows.
Columns other than those named are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outpulse.llm.common import ROW, numbered, written

SPACE = " \t\n\v\f\r"
#: Rows of a segment.
SEGMENT = 1024
#: Symbols that share a grammar, about, and the uses that make a rule worth its matrix.
GRAMMAR_SYMBOLS, MIN_USES = 1 << 16, 4
#: Matrices of this many symbols in all may be broadcast; a matrix holds up to 16 ropes as long as its segment.
BROADCAST_SYMBOLS = 1 << 20

#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States of the pattern: nothing yet, after the system, after a user, after an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: Where a further user or assistant leads.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
#: Symbols: a row to be deleted; rows by initial, upper-case if truncated; ``o`` for any other initial.
SYMBOLS = "xsuaoSUAO"


# Ropes: edits of a rule are those of its halves, never copied.


class Rope:
    __slots__ = ("left", "right", "text", "size", "key")

    def __init__(self, left: Rope | None, right: Rope | None, text: str = "") -> None:
        self.left, self.right, self.text = left, right, text
        self.size = left.size + right.size if left is not None else len(text)
        # Equal keys of ropes of one size stand for equal edits.
        self.key = (left.key * pow(_BASE, right.size, _PRIME) + right.key) % _PRIME if left is not None else _key(text)

    def __str__(self) -> str:
        parts, open_ropes = [], [self]
        while open_ropes:
            rope = open_ropes.pop()
            if rope.left is None:
                parts.append(rope.text)
            else:
                open_ropes += (rope.right, rope.left)
        return "".join(parts)


_PRIME, _BASE = (1 << 61) - 1, 0x1D2B3A4958677685


def _key(text: str) -> int:
    key = 0
    for character in text:
        key = (key * _BASE + ord(character)) % _PRIME
    return key


def joined(one: Rope, two: Rope) -> Rope:
    if not one.size:
        return two
    return Rope(one, two) if two.size else one


def less(one: Rope, two: Rope) -> bool:
    """Whether ``one`` comes first in ASCII. Equal parts are passed over by their keys."""
    left, right = [one], [two]
    while left and right:
        a, b = left.pop(), right.pop()
        if a is b or (a.size == b.size and a.key == b.key):
            continue
        if a.left is None and b.left is None:
            size = min(a.size, b.size)
            if a.text[:size] != b.text[:size]:
                return a.text < b.text
            if a.size > size:
                left.append(Rope(None, None, a.text[size:]))
            if b.size > size:
                right.append(Rope(None, None, b.text[size:]))
        elif b.left is None or (a.left is not None and a.size >= b.size):
            left += (a.right, a.left)
            right.append(b)
        else:
            left.append(a)
            right += (b.right, b.left)
    return bool(right) and not left


# Min-plus matrices: entry [p][q] is the cheapest way from state p to state q, ASCII-least among ties. Two ways from one
# state to another one over the same rows are never a prefix of each other at the same cost, so that ties are settled
# alike whatever is joined to them later.

Matrix = list[list[tuple[int, Rope] | None]]


def product(one: Matrix, two: Matrix) -> Matrix:
    out: Matrix = []
    for ways in one:
        line = []
        for q in STATES:
            best = None
            for r in STATES:
                first, second = ways[r], two[r][q]
                if first is None or second is None:
                    continue
                cost = first[0] + second[0]
                if best is None or cost < best[0]:
                    best = (cost, first[1], second[1], None)
                elif cost == best[0]:
                    held, rival = best[3] or joined(best[1], best[2]), joined(first[1], second[1])
                    best = (cost, None, None, rival if less(rival, held) else held)
            line.append(best and (best[0], best[3] or joined(best[1], best[2])))
        out.append(line)
    return out


def _insertions() -> Matrix:
    """The cheapest inserted rows between two states."""
    out: Matrix = [[None] * 4 for _ in STATES]
    for p in STATES:
        q, rows = p, 0
        while out[p][q] is None:
            out[p][q] = (INSERT * rows, Rope(None, None, "I" * rows))
            q, rows = NEXT[q], rows + 1
    return out


INSERTIONS = _insertions()


def symbol_matrix(symbol: str) -> Matrix:
    """Insertions, then the one row."""
    row: Matrix = [[None] * 4 for _ in STATES]
    worse = TRUNCATED if symbol.isupper() else 0
    keeps = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}.get(symbol.lower(), {})
    for p in STATES:
        row[p][p] = (DELETE, Rope(None, None, "D"))
        if symbol != "x":
            row[p][NEXT[p]] = (REROLE + worse, Rope(None, None, "R"))
            if p in keeps:
                row[p][keeps[p]] = (worse, Rope(None, None, "K"))
    return product(INSERTIONS, row)


def re_pair(strings: list[str]) -> tuple[list[tuple[int, int]], list[np.ndarray]]:
    """Rules, numbered after the symbols, and what is left of each string when pairs have become rules, the most frequent
    first."""
    lengths = np.array([len(s) for s in strings])
    text = np.frombuffer("".join(s + "-" for s in strings).encode(), np.uint8)
    number = np.full(256, -1, np.int64)
    number[np.frombuffer(SYMBOLS.encode(), np.uint8)] = np.arange(len(SYMBOLS))
    x = number[text]
    rules: list[tuple[int, int]] = []
    while len(lengths):
        size = len(SYMBOLS) + len(rules)
        pairs = np.where((x[:-1] >= 0) & (x[1:] >= 0), x[:-1] * size + x[1:], -1)
        codes, uses = np.unique(pairs[pairs >= 0], return_counts=True)
        if not len(codes) or uses.max() < MIN_USES:
            break
        code = codes[uses.argmax()]
        at = np.flatnonzero(pairs == code)
        if code // size == code % size:
            # In a run of one symbol every second place begins a pair.
            begins = np.flatnonzero(np.diff(at, prepend=-2) > 1)
            in_run = np.arange(len(at)) - np.repeat(begins, np.diff(begins, append=len(at)))
            at = at[in_run % 2 == 0]
        rules.append((int(code // size), int(code % size)))
        x = x.copy()
        x[at] = size
        x = np.delete(x, at + 1)
    ends = np.flatnonzero(x < 0)
    return rules, [x[a:b] for a, b in zip(np.concatenate([[0], ends[:-1] + 1]), ends)]


def matrices(strings: list[str]) -> Iterator[Matrix]:
    """The matrix of each string, rules evaluated once, bottom-up."""
    rules, left = re_pair(strings)
    known = [symbol_matrix(s) for s in SYMBOLS]
    for a, b in rules:
        known.append(product(known[a], known[b]))
    for rest in left:
        matrix = known[rest[0]]
        for symbol in rest[1:]:
            matrix = product(matrix, known[symbol])
        yield matrix


_MATRIX_DDL = "symbols string, costs array<bigint>, audits array<string>"


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def told(strings: list[str]) -> pa.RecordBatch:
        entries = [[e for line in m for e in line] for m in matrices(strings)]
        return pa.record_batch(
            {
                "symbols": pa.array(strings, pa.string()),
                "costs": pa.array([[e and e[0] for e in m] for m in entries], pa.list_(pa.int64())),
                "audits": pa.array([[e and str(e[1]) for e in m] for m in entries], pa.list_(pa.string())),
            }
        )

    held: list[str] = []
    symbols = 0
    for batch in batches:
        for string in batch["symbols"].to_pylist():
            held.append(string)
            symbols += len(string)
            if symbols > GRAMMAR_SYMBOLS:
                yield told(held)
                held, symbols = [], 0
    if held:
        yield told(held)


_COUNTS = ["blank", "duplicate", "truncated", "illegal"]


class _Conversation:
    """The cheapest ways to each state over the segments so far, and the counts.

    A way is a rope of whole segments. Two ways differ early or one is the other with insertions at its end, so that a tie
    is settled near the end of the ropes, or by the keys of their beginnings.
    """

    def __init__(self) -> None:
        self.ways: Matrix = [[(0, Rope(None, None))] + [None] * 3]
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.low = self.high = None
        self.turns = 0

    def add(self, row: dict) -> None:
        entries = [None if c is None else (c, Rope(None, None, a)) for c, a in zip(row["costs"], row["audits"])]
        self.ways = product(self.ways, [entries[4 * p : 4 * p + 4] for p in STATES])
        for name in _COUNTS:
            self.counts[name] += row[name]
        self.turns += row["turns"]
        if row["low"] is not None:
            self.low = row["low"] if self.low is None else min(self.low, row["low"])
            self.high = row["high"] if self.high is None else max(self.high, row["high"])

    def result(self) -> dict:
        (ways,) = product(self.ways, INSERTIONS)
        ends = [w for w in (ways[START], ways[ASSISTANT]) if w is not None]
        least = min(w[0] for w in ends)
        ends = [w for w in ends if w[0] == least]
        best = ends[1] if len(ends) == 2 and less(ends[1][1], ends[0][1]) else ends[0]
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"gaps": gaps, **self.counts, "cost": best[0], "audit": str(best[1])}


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order of conversation and number to one row a conversation."""
    conv, state, found = None, None, []
    for batch in batches:
        for row in batch.to_pylist():
            if state is None or row["conv"] != conv:
                if state is not None:
                    found.append({"conv": conv, **state.result()})
                conv, state = row["conv"], _Conversation()
            state.add(row)
        if found:
            yield _rows(found, batch.schema.field("conv").type)
            found = []
    if state is not None:
        yield _rows([{"conv": conv, **state.result()}], batch.schema.field("conv").type)


def _rows(rows: list[dict], conv_type: pa.DataType) -> pa.RecordBatch:
    """Rows of results, whose columns are the conversation, numbers and texts."""
    text = {"audit", "repaired_sha256"}
    columns = {c: pa.string() if c in text else pa.int64() for c in rows[0]} | {"conv": conv_type}
    return pa.record_batch({c: pa.array([r[c] for r in rows], t) for c, t in columns.items()})


_RESULT = [(c, "bigint") for c in ("gaps", *_COUNTS, "cost")] + [("audit", "string")]
_NOTHING = {c: "" if t == "string" else 0 for c, t in _RESULT}


class _Repaired:
    """Applies the edits of one conversation to its rows as they pass."""

    def __init__(self, result: dict) -> None:
        self.result, self.audit = result, result["audit"]
        self.at, self.state, self.empty = 0, START, True
        self.digest = hashlib.sha256()

    def _put(self, role: str, text: str) -> None:
        self.digest.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode())
        self.empty = False

    def _inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self.state = NEXT[self.state]
            self._put(ROLE_OF[self.state], "")

    def row(self, role: str, text: str) -> None:
        self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "D":
            return
        self.state = SYSTEM if edit == "K" and role[:1] == "s" else NEXT[self.state]
        self._put(role if edit == "K" else ROLE_OF[self.state], text)

    def end(self) -> dict:
        self._inserted()
        return {**self.result, "repaired_sha256": self.digest.hexdigest()}


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation its edits come first, then its rows in order, then marks of rows that the damage dropped."""
    conv, state, found = None, None, []
    for batch in batches:
        names = ["conv", "kind", "role", "text", "copies", *_NOTHING]
        for values in zip(*(batch[name].to_pylist() for name in names)):
            row = dict(zip(names, values))
            if state is None or row["conv"] != conv:
                if state is not None:
                    found.append({"conv": conv, **state.end()})
                conv = row["conv"]
                state = _Repaired({c: row[c] for c in _NOTHING} if row["kind"] == 0 else _NOTHING)
            for _ in range(row["copies"]):
                state.row(row["role"], row["text"])
        if found:
            yield _rows(found, batch.schema.field("conv").type)
            found = []
    if state is not None:
        yield _rows([{"conv": conv, **state.end()}], batch.schema.field("conv").type)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text) after the damage that a hash of conversation and turn chooses. ``copies`` is how often
    a row is there, next to each other; 0 for those dropped."""
    space = F.lit(" ")
    named = F.concat(F.coalesce(F.col("conv").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.withColumn("damage", F.crc32(named.cast("binary")) % 20)
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    return rows.select(
        "conv",
        "turn",
        F.when(F.col("damage") == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(F.col("damage") == 1, F.lit("")).when(F.col("damage") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(F.col("damage") == 0, 0).when(F.col("damage") == 3, 2).otherwise(1).alias("copies"),
        ROW,
    )


def _segments(rows: DataFrame) -> DataFrame:
    """Per conversation and segment: its symbols, and what its rows count. Narrow rows; one shuffle, by conversation."""
    end = F.right(F.rtrim(F.col("text"), F.lit(SPACE)), F.lit(1))
    narrow = rows.filter("copies > 0").select(
        "conv", "turn", ROW, "copies", "role", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"),
        (end == "").alias("is_blank"), (~end.isin(".", "!", "?")).alias("is_open"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col(ROW)]
    narrow = narrow.repartition("conv")
    seen = F.row_number().over(Window.partitionBy("conv", "role", "digest").orderBy(*order)) > 1
    narrow = narrow.withColumn("seen", seen).withColumn("initial", F.substring("role", 1, 1))
    whole = Window.partitionBy("conv").orderBy(*order)
    placed = narrow.select(
        "*",
        (F.row_number().over(whole) - 1).alias("at"),
        F.lag("initial").over(whole).alias("before"),
        F.lag("turn").over(whole).alias("turn_before"),
    )
    again = F.col("copies") - 1
    blank, seen = F.col("is_blank"), ~F.col("is_blank") & F.col("seen")
    cut = ~F.col("is_blank") & ~F.col("seen") & F.col("is_open")
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    symbol = F.when(blank | seen, F.lit("x")).when(cut, F.upper(letter)).otherwise(letter)
    legal = F.concat("before", "initial").isin("su", "ua", "au")
    told = placed.select(
        "conv",
        F.floor(F.col("at") / SEGMENT).cast("bigint").alias("segment"),
        "at",
        F.concat(symbol, F.when(again > 0, F.lit("x")).otherwise("")).alias("symbol"),
        "turn",
        F.when(blank, F.col("copies")).otherwise(0).alias("blank"),
        F.when(seen, F.col("copies")).when(~blank, again).otherwise(0).alias("duplicate"),
        cut.cast("int").alias("truncated"),
        # A copy follows its original with the same initial.
        (F.when(F.col("before").isNotNull() & ~legal, 1).otherwise(0) + again).alias("illegal"),
        F.when(F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("turn_before")), 1).otherwise(0).alias("new_turn"),
    )
    parts = F.array_sort(F.collect_list(F.struct("at", "symbol")))
    return told.groupBy("conv", "segment").agg(
        F.array_join(F.transform(parts, lambda p: p["symbol"]), "").alias("symbols"),
        *[F.sum(c).cast("bigint").alias(c) for c in _COUNTS],
        F.sum("new_turn").cast("bigint").alias("turns"),
        F.min("turn").alias("low"),
        F.max("turn").alias("high"),
    )


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Damages ``rows`` and returns per conversation its faults, the cheapest edits and the digest of what they leave."""
    named: list[Column] = [F.col(f"`{c}`").alias(n) for c, n in ((conv_id, "conv"), (turn, "turn"), (role, "role"), (text, "text"))]
    rows = damaged(numbered(rows.select(*named)))
    segments = written(_segments(rows), "segments")
    patterns = segments.select("symbols").distinct().mapInArrow(_matrices, _MATRIX_DDL)
    patterns = written(patterns, "segment-matrices")
    symbols = patterns.agg(F.sum(F.length("symbols"))).first()[0] or 0
    paired = segments.join(F.broadcast(patterns) if symbols <= BROADCAST_SYMBOLS else patterns, "symbols").drop("symbols")

    conv_type = rows.schema["conv"].dataType.simpleString()
    result = ", ".join(f"{c} {t}" for c, t in _RESULT)
    in_order = paired.repartition("conv").sortWithinPartitions("conv", "segment")
    edits = in_order.mapInArrow(_folded, f"conv {conv_type}, {result}")

    texts = rows.withColumn("kind", F.when(F.col("copies") > 0, 1).otherwise(2)).withColumn("text", F.when(F.col("copies") > 0, F.col("text")))
    heads = edits.withColumn("kind", F.lit(0)).withColumn("copies", F.lit(0))
    stream = heads.unionByName(texts, allowMissingColumns=True).repartition("conv")
    stream = stream.sortWithinPartitions("conv", "kind", F.col("turn").asc_nulls_first(), ROW)
    done = stream.mapInArrow(_hashed, f"conv {conv_type}, {result}, repaired_sha256 string")
    return done.withColumnRenamed("conv", "conv_id")

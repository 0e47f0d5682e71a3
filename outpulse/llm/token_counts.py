"""Token counts that follow edits.

A document's pre-tokens are grouped to leaves, and a segment tree over the leaves holds the sums of their characters and
tokens. An edit is found by descending the tree; only the leaves that it touches, and as much beside them as can change
the pre-tokens there, are encoded anew. All other leaves, and the sums of untouched subtrees, stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outpulse.llm.packing import SPECIAL, load_encoding

#: Pre-tokens of a leaf when it is built.
LEAF = 64
#: Characters after a pre-token that can change where it ends.
LOOKAHEAD = 2

TREE_DDL = "struct<chars:array<int>,tokens:array<int>>"
EDITS_DDL = "array<struct<start:int,stop:int,text:string>>"


class Tree:
    """Sums over leaves. Node 1 is the root, node ``i`` has the children ``2 i`` and ``2 i + 1``; leaves fill the last level."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.leaves = len(chars)
        self.width = 1 << max(0, self.leaves - 1).bit_length()
        self.chars, self.tokens = np.zeros(2 * self.width, np.int64), np.zeros(2 * self.width, np.int64)
        for sums, values in ((self.chars, chars), (self.tokens, tokens)):
            sums[self.width : self.width + self.leaves] = values
            level = self.width
            while level > 1:
                sums[level // 2 : level] = sums[level : 2 * level].reshape(-1, 2).sum(axis=1)
                level //= 2

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at``, and where it begins; beyond the end, the last leaf."""
        node, begin = 1, 0
        while node < self.width:
            node *= 2
            if at - begin >= self.chars[node] and self.chars[node + 1]:
                begin += int(self.chars[node])
                node += 1
        return node - self.width, begin

    def values(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of the leaves."""
        span = slice(self.width, self.width + self.leaves)
        return self.chars[span].tolist(), self.tokens[span].tolist()


class Counter:
    """Counts with one vocabulary."""

    def __init__(self, ranks: str, pattern: str):
        self.encoding = load_encoding(ranks, pattern)
        self.pattern = regex.compile(f"{regex.escape(SPECIAL)}|{pattern}")

    def count(self, text: str) -> int:
        if SPECIAL in text:
            return len(self.encoding.encode(text, allowed_special="all"))
        return len(self.encoding.encode_ordinary(text))

    def build(self, text: str) -> tuple[list[int], list[int]]:
        """Characters and tokens of the leaves of a text."""
        cuts = self._cuts(text, self._ends(text))
        return np.diff(cuts).tolist(), [self.count(text[a:b]) for a, b in zip(cuts, cuts[1:])]

    def _ends(self, text: str) -> list[int]:
        """Where pre-tokens end, but for those that end with a blank: what follows can reach back over blanks."""
        return [m.end() for m in self.pattern.finditer(text) if not text[m.end() - 1].isspace()]

    @staticmethod
    def _cuts(text: str, ends: list[int]) -> list[int]:
        """Bounds of the leaves. A leaf ends where no pre-token can reach over, so its own text has the same ones."""
        cuts = [0, *ends[LEAF - 1 :: LEAF]]
        return cuts if cuts[-1] == len(text) else [*cuts, len(text)]

    def edit(self, text: str, chars: list[int], tokens: list[int], edits: list[tuple[int, int, str]]):
        """``(new text, chars, tokens, characters encoded)`` after replacing ``text[start:stop]`` for every edit.

        The edits are in order and do not overlap. Leaves that no edit touches are taken over.
        """
        tree = Tree(chars, tokens)
        begins = np.concatenate([[0], np.cumsum(np.asarray(chars, np.int64))])
        new_chars, new_tokens, parts = [], [], []
        leaf, done, i, encoded = 0, 0, 0, 0  # leaves and characters of the old text that are accounted for
        while i < len(edits):
            # The first leaf with a pre-token that the edit, or what it brings, can change.
            first = tree.find(max(0, edits[i][0] - LOOKAHEAD))[0] if chars else 0
            if first > 0 and edits[i][0] - LOOKAHEAD <= begins[first]:
                first -= 1
            first = max(first, leaf)
            new_chars += chars[leaf:first]
            new_tokens += tokens[leaf:first]
            parts.append(text[done : begins[first]])
            # Scan from there until a pre-token ends where a leaf of the old text begins, behind the last edit nearby.
            done = int(begins[first])
            changed, old = [], done
            last = first
            while True:
                while i < len(edits) and (edits[i][0] <= old or last == first or edits[i][0] - LOOKAHEAD <= begins[last]):
                    start, stop, put = edits[i]
                    changed += [text[old:start], put]
                    old = stop
                    i += 1
                    last = tree.find(stop)[0] + 1 if chars else 0
                    last = min(max(last, first), len(chars))
                rest = text[old : begins[last]] if last < len(begins) else ""
                region = "".join([*changed, rest])
                context = text[begins[last] : begins[last] + LOOKAHEAD]
                ends = self._ends(region + context)
                if last >= len(chars) or len(region) in ends or not region:
                    break
                last += 1
            cuts = self._cuts(region, [e for e in ends if e <= len(region)])
            new_chars += np.diff(cuts).tolist()
            new_tokens += [self.count(region[a:b]) for a, b in zip(cuts, cuts[1:])]
            encoded += len(region)
            parts.append(region)
            leaf, done = last, int(begins[last])
        new_chars += chars[leaf:]
        new_tokens += tokens[leaf:]
        parts.append(text[done:])
        return "".join(parts), new_chars, new_tokens, encoded


def _build_batches(ranks: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks, pattern)
        kind = pa.struct([("chars", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))])
        for batch in batches:
            trees = [dict(zip(("chars", "tokens"), counter.build(text or ""))) for text in batch.column("text").to_pylist()]
            names = batch.schema.names
            yield pa.record_batch([*(batch.column(n) for n in names), pa.array(trees, kind)], [*names, "tree"])

    return run


def _edit_batches(ranks: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks, pattern)
        for batch in batches:
            rows = []
            columns = [batch.column(n).to_pylist() for n in ("text", "tree", "edits")]
            for text, tree, edits in zip(*columns):
                tree = tree or {"chars": [], "tokens": []}
                wanted = [(e["start"], e["stop"], e["text"] or "") for e in edits or []]
                after, chars, tokens, encoded = counter.edit(text or "", tree["chars"], tree["tokens"], wanted)
                rows.append((after, {"chars": chars, "tokens": tokens}, sum(tree["tokens"]), sum(tokens), len(wanted), encoded))
            kind = pa.struct([("chars", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))])
            kinds = [pa.string(), kind, *[pa.int64()] * 4]
            names = ["text", "tree", "tokens_before", "tokens_after", "n_edits", "chars_encoded"]
            fields = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)]
            yield pa.record_batch([batch.column("doc_id"), *fields], ["doc_id", *names])

    return run


def build_trees(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``docs(doc_id, text)`` with the tree of each row. Null and empty texts have a tree without leaves.

    Nothing is shuffled; a row is built by itself, so repeated rows and missing ids do not matter. Other columns are not
    read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_build_batches(ranks, pattern), f"doc_id bigint, text string, tree {TREE_DDL}")


def apply_edits(trees: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``trees(doc_id, text, tree, edits)`` with new text and tree, and ``tokens_before``, ``tokens_after``, ``n_edits``
    and ``chars_encoded``.

    The edits of a row are in order and do not overlap; ``start`` and ``stop`` are characters of the old text. No edits,
    or null, change nothing.
    """
    ddl = f"doc_id bigint, text string, tree {TREE_DDL}, tokens_before bigint, tokens_after bigint, n_edits bigint, chars_encoded bigint"
    return trees.select("doc_id", "text", "tree", "edits").mapInArrow(_edit_batches(ranks, pattern), ddl)


#: What the redaction edits replace, and by what: mail addresses, then network addresses and phone numbers.
REDACTED = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "<mail>"),
    (r"\+?\d[\d(). -]{6,}\d", "<number>"),
]


def redactions(text: pa.Array) -> pa.Array:
    """The edits that redact personal data, as an Arrow array."""
    found = regex.compile("|".join(f"({p})" for p, _ in REDACTED))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("text", pa.string())]))
    rows = [
        [{"start": m.start(), "stop": m.end(), "text": REDACTED[m.lastindex - 1][1]} for m in found.finditer(t or "")]
        for t in text.to_pylist()
    ]
    return pa.array(rows, kind)

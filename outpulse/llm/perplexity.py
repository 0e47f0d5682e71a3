"""Quality by the perplexity of an interpolated modified Kneser-Ney trigram model of trusted text.

All that the probability of a word ``w`` after ``u v`` needs, but for the word's own, lies with the middle word ``v``: the
triple, its context ``uv``, the pair ``vw`` and that pair's context ``v``. Tokens are therefore dealt into shards by their middle
word. A shard counts its trusted tokens and scores all of its tokens as

    p(w|uv) = a + b * p1(w)

where ``a`` and ``b`` come from the shard alone and ``p1`` from a table of words, whose most frequent ones are sent to every
task; the others meet the table by a join. Middle words that are frequent are dealt out by ``u`` too, and the counts of their
pairs are added up over the shards before anything is scored.

Counts need 64-bit words, so tokens outgrow the text that they come from. They are dealt in rounds, each of which takes its
share of the shards from all texts and removes its shuffled files when it is done.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outpulse.llm.common import ROW, as_bytes, light, numbered, written
from outpulse.llm.rolling import mixed, powers

#: Trusted documents are in two folds. Model 0 and 1 lack the fold of their number, model 2 has both.
FOLDS = 2
MODELS = range(FOLDS + 1)
#: Trusted documents of a language that stay below the threshold.
QUANTILE = 0.99
#: A middle word that occurs more often is dealt out by the word before it, to a shard for so many tokens.
FREQUENT = 200_000
#: Tokens of a shard, as far as no middle word has more of them, and the least number of shards.
SHARD_TOKENS, LEAST_SHARDS = 1_000_000, 96
#: Rounds in which the tokens of trusted texts are counted, and those of all texts scored.
COUNT_ROUNDS, SCORE_ROUNDS = 2, 5
#: Words whose counts are sent to every task. All others meet the table of words by a join.
SENT_WORDS = 300_000
#: 64-bit words of the filter that leaves out words which the model lacks. The join removes what passes by chance.
FILTER_WORDS = 1 << 19
#: Tokens that a task deals out together, and bytes of text that it parts into words together.
BLOCK_TOKENS, BLOCK_BYTES = 2_000_000, 1 << 18
#: Tokens whose shards are found together.
CACHED_TOKENS = 1 << 15
#: The least discount, so that an unknown word has a probability.
LEAST_DISCOUNT = 0.05

_BEGIN, _END = np.array([0x51ED270B0A1FD3C7, 0x2545F4914F6CDD1D], np.uint64)
_PIECE = np.uint64(0x9E3779B97F4A7C15)
_UPPER, _TAB, _ALONE = np.array([0x41, 0x09, 0xE3], np.uint8)
_DEALT = "shard bigint, first bigint, block bigint, words binary, grams binary, docs binary"
_REPLIED = "block bigint, docs binary, logs binary, left_words binary, left_values binary"
_COUNTED = "kind int, first bigint, word bigint, " + ", ".join(f"n{m} int" for m in MODELS)
_SCORED = f"{ROW} bigint, n bigint, log double, word bigint, model bigint, a double, b double"
#: Kinds of counted rows: numbers of triples and of pairs by their count, words, and pairs with a frequent middle word.
_TRIPLES, _PAIRS, _WORDS, _BUSY = range(4)
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Dealing(NamedTuple):
    """How tokens are dealt out: the number of shards, and the frequent middle words, in order, with their pieces."""

    shards: int
    busy: np.ndarray
    pieces: np.ndarray


class Model(NamedTuple):
    """Discounts by order (words, pairs, triples), model and count; the number of pairs in each model; ``words(word, n0, n1,
    n2)`` and ``pairs(first, word, n0, n1, n2)``, those with a frequent first word, with their counts in each model."""

    dealing: Dealing
    discounts: list[list[list[float]]]
    totals: list[int]
    words: DataFrame
    pairs: DataFrame


def tokens(text: bytes, places: bool = False) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, on demand with the places where they begin. A-Z count as a-z; a character of scripts without blanks (U+3000 to U+9FFF) is a word."""
    if not text:
        return (np.empty(0, np.uint64), np.empty(0, np.int64)) if places else np.empty(0, np.uint64)
    data = np.frombuffer(text, np.uint8)
    data = data | ((data - _UPPER < 26).view(np.uint8) << np.uint8(5))
    space = (data == 0x20) | (data - _TAB < 5)
    alone = data - _ALONE < 7
    edge = np.ones(len(data) + 1, bool)
    if alone.any():
        edge[1:-1] = space[1:] | space[:-1] | alone[1:]
        edge[3:-1] |= alone[: len(data) - 3] if len(data) > 3 else False
        at = np.flatnonzero(edge)
        word = ~space[at[:-1]]
        starts, stops = at[:-1][word], at[1:][word]
    else:
        edge[0], edge[-1] = not space[0], not space[-1]
        np.not_equal(space[1:], space[:-1], out=edge[1:-1])
        at = np.flatnonzero(edge)
        starts, stops = at[::2], at[1::2]
    # Those of ``prefix_hashes`` and ``stretches``, the ones that each byte is raised by added up by length.
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.multiply(data, up[:-1], out=sums[1:])
    np.cumsum(sums[1:], out=sums[1:])
    size = stops - starts
    ones = np.cumsum(np.append(np.uint64(0), up[: size.max(initial=0)]), dtype=np.uint64)
    found = mixed((sums[stops] - sums[starts]) * down[starts] + ones[size])
    return (found, starts) if places else found


@contextlib.contextmanager
def _cleared(spark: SparkSession) -> Iterator[None]:
    """Shuffled files of what is executed inside go when it is done, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers, models and numbers of words of texts ``(row, model, text)`` with a word, and the words of all of them."""
    rows, models, sizes, words, held, texts, n_bytes = [], [], [], [], 0, [], 0

    def parted() -> None:
        # Nothing reaches over two blanks between texts, not even a character that is cut off at the end of one.
        lengths = np.array([len(t) + 2 for t in texts])
        found, at = tokens(b"  ".join(texts), places=True)
        words.append(found)
        sizes.append(np.diff(np.searchsorted(at, np.concatenate([[0], np.cumsum(lengths)]))))

    def block():
        size = np.concatenate(sizes)
        some = size > 0
        return np.array(rows, np.int64)[some], np.array(models, np.int64)[some], size[some], np.concatenate(words)

    for batch in batches:
        for row, model, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))):
            rows.append(row)
            models.append(model)
            texts.append(text)
            n_bytes += len(text) + 2
            if n_bytes >= BLOCK_BYTES:
                parted()
                held += len(words[-1]) + len(texts)
                texts, n_bytes = [], 0
                if held >= BLOCK_TOKENS:
                    yield block()
                    rows, models, sizes, words, held = [], [], [], [], 0
    if texts:
        parted()
    if rows:
        yield block()


def _count_middles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, _, sizes, words in _blocks(batches):
        word, n = np.unique(words, return_counts=True)
        word, n, total = np.append(word, _BEGIN), np.append(n, len(rows)), len(words) + len(rows)
        often = n >= total >> 16  # no word that is rarer in every block is frequent
        yield pa.record_batch([pa.array([*word[often].view(np.int64), None], pa.int64()), pa.array([*n[often], total], pa.int64())], ["word", "n"])


def dealing(texts: DataFrame) -> Dealing:
    """How the tokens of ``texts(text)`` are dealt out."""
    read = texts.select(F.lit(0).alias(ROW), F.lit(0).alias("model"), F.col("text").cast("string").alias("text"))
    found = read.mapInArrow(_count_middles, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    rows = found.filter((F.col("n") > FREQUENT) | F.col("word").isNull()).collect()  # a row per FREQUENT tokens at most
    total = sum(r.n for r in rows if r.word is None)
    busy = np.array([r.word for r in rows if r.word is not None], np.int64).view(np.uint64)
    pieces = np.array([1 + r.n // max(1, FREQUENT) for r in rows if r.word is not None], np.uint64)
    order = np.argsort(busy)
    return Dealing(max(LEAST_SHARDS, total // SHARD_TOKENS), busy[order], pieces[order])


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ``wanted`` among the sorted ``keys``, -1 for what is not there."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _shard(middle: np.ndarray, dealt: Dealing) -> np.ndarray:
    """The shards of middle words, to which their piece is added."""
    found, n = mixed(middle), np.uint64(dealt.shards)
    return (found - found // n * n).view(np.int64)  # a division by one number is faster than its remainder


def _packed(values: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones, compressed: bytes that are alike are together."""
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T)
    return planes.size.to_bytes(8, "little") + pa.Codec("zstd", 1).compress(pa.py_buffer(planes), asbytes=True)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    planes = pa.Codec("zstd", 1).decompress(data[8:], size, asbytes=True) if size else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _coded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in order, and the place of each among them."""
    coded = pa.array(values).dictionary_encode()
    known = coded.dictionary.to_numpy()
    order = np.argsort(known)
    place = np.empty(len(known), np.int32)
    place[order] = np.arange(len(known), dtype=np.int32)
    return known[order], place[coded.indices.to_numpy()]


def _dealt_to(words: np.ndarray, dealt: Dealing, turn: int, turns: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the middle words, and their shards, that belong to this turn. Few are taken at a time, which stay in the cache."""
    marked = np.zeros(1 << 16, bool)
    marked[dealt.busy.astype(np.uint16)] = True
    mine = np.arange(dealt.shards) % turns == turn
    places, shards = [], []
    for start in range(0, len(words), CACHED_TOKENS):
        middle = words[start : start + CACHED_TOKENS]
        split = np.flatnonzero(marked[middle.astype(np.uint16)])
        if len(split):
            busy = _find(dealt.busy, middle[split])
            split, busy = split[busy >= 0] + start, busy[busy >= 0]
            piece = mixed(words[split - 1]) % dealt.pieces[busy]
            middle = middle.copy()
            middle[split - start] += piece * _PIECE
        shard = _shard(middle, dealt)
        at = np.flatnonzero(mine[shard])
        places.append(at + start)
        shards.append(shard[at])
    return np.concatenate(places), np.concatenate(shards)


def _deal_batches(dealt: Dealing, turn: int, turns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, models, sizes, words in _blocks(batches):
            # Each text is BEGIN BEGIN words END; a token is a word or an END and the two before it.
            n_texts = len(sizes)
            begins = np.cumsum(sizes + 3) - sizes - 3
            ends = begins + sizes + 2
            padded = np.full(len(words) + 3 * n_texts, _BEGIN, np.uint64)
            inner = np.ones(len(padded), bool)
            inner[begins] = inner[begins + 1] = inner[ends] = False
            padded[inner] = words
            padded[ends] = _END
            middle, shard = _dealt_to(padded, dealt, turn, turns)
            # All but the first and the last of a text stand in the middle of a token.
            inner[begins + 1] = True
            some = inner[middle]
            at, shard = middle[some] + 1, shard[some]
            narrow = shard.astype(np.uint16) if dealt.shards <= 1 << 16 else shard
            order = np.argsort(narrow, kind="stable")
            of = np.repeat(np.arange(n_texts, dtype=np.int32), sizes + 3)[at][order]
            shard, at = shard[order], at[order]
            starts = np.flatnonzero(np.diff(shard, prepend=-1))
            out = []
            for start, stop in zip(starts, [*starts[1:], len(shard)]):
                place = at[start:stop]
                known, grams = _coded(padded[np.concatenate([place - 2, place - 1, place])])
                first = np.flatnonzero(np.diff(of[start:stop], prepend=-1))
                texts, n = of[start:stop][first], np.diff(first, append=stop - start)
                docs = np.concatenate([np.diff(rows[texts], prepend=0), n, models[texts]])
                known = np.diff(known, prepend=np.uint64(0))
                out.append((int(shard[start]), None, int(rows[0]), _packed(known), _packed(grams), _packed(docs)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], names=_NAMES)

    return run


_NAMES = ["shard", "first", "block", "words", "grams", "docs"]
_TYPES = [pa.int64()] * 3 + [pa.binary()] * 3


def _deal_pairs(dealt: Dealing, turn: int, turns: int):
    """Sends counted pairs of frequent first words to all shards that have tokens with this middle word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(held: list[np.ndarray]):
            first, word, *n = np.concatenate(held, axis=1)
            order = np.argsort(first, kind="stable")
            first, word, n = first[order], word[order], np.stack(n)[:, order].astype(np.int32)
            starts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
            for start, stop in zip(starts, [*starts[1:], len(first)]):
                middle = first[start : start + 1].view(np.uint64)
                pieces = np.arange(dealt.pieces[_find(dealt.busy, middle)[0]], dtype=np.uint64)
                shards = np.unique(_shard(middle + pieces * _PIECE, dealt))
                row = (int(first[start]), None, _packed(word[start:stop]), _packed(n[:, start:stop].ravel()), None)
                out = [(int(shard), *row) for shard in shards if shard % turns == turn]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], names=_NAMES)

        held, size = [], 0
        for batch in batches:
            held.append(np.stack([c.to_numpy().astype(np.int64) for c in batch.columns]))
            size += len(batch)
            if size >= BLOCK_TOKENS // 4:
                yield from block(held)
                held, size = [], 0
        if size:
            yield from block(held)

    return run


class _Shard:
    """The tokens of a shard, and the counts of those that are trusted, in each model."""

    def __init__(self, table: pa.Table, busy: np.ndarray):
        parts = [p for p in zip(*(table.column(c).to_pylist() for c in _NAMES[1:])) if p[0] is None]
        dicts = [np.cumsum(_unpacked(p[2], np.uint64), dtype=np.uint64) for p in parts]
        self.words, of = np.unique(np.concatenate(dicts), return_inverse=True)
        ends = np.cumsum([len(d) for d in dicts])
        grams = [of[end - len(d) + _unpacked(p[3], np.int32)].reshape(3, -1) for p, d, end in zip(parts, dicts, ends)]
        u, v, w = np.concatenate(grams, axis=1)
        docs = [_unpacked(p[4], np.int64).reshape(3, -1) for p in parts]
        self.blocks, self.block_ends = [p[1] for p in parts], np.cumsum([d.shape[1] for d in docs])
        self.rows = np.concatenate([np.cumsum(d[0]) for d in docs])
        _, sizes, models = np.concatenate(docs, axis=1)
        self.sizes, self.doc = sizes, np.repeat(np.arange(len(sizes)), sizes)
        self.model = models[self.doc]
        n = self.n = len(self.words)
        self.v, self.w, self.context = v, w, v * n + u
        trusted = self.model < FOLDS
        self.contexts, context = np.unique(self.context[trusted], return_inverse=True)
        self.triples, triple = np.unique(context * n + w[trusted], return_inverse=True)
        fold = self.model[trusted]
        self.of_triples = np.stack([np.bincount(triple[fold != m], minlength=len(self.triples)) for m in MODELS])
        self.context_of, last = self.triples // max(n, 1), self.triples % max(n, 1)
        # Lower orders count the different words that an n-gram follows.
        self.pairs, pair = np.unique((self.contexts // max(n, 1))[self.context_of] * n + last, return_inverse=True)
        self.of_pairs = np.stack([np.bincount(pair[k > 0], minlength=len(self.pairs)) for k in self.of_triples])
        self.busy = _find(busy, self.words)
        self.pair_busy = self.busy[self.pairs // max(n, 1)] >= 0


def _numbers(kind: int, counts: np.ndarray) -> list[tuple]:
    return [(kind, None, i, *(int((k == i).sum()) for k in counts)) for i in range(1, 5)]


def _counted(columns: list, n: int) -> pa.Table:
    names = ["kind", "first", "word", *(f"n{m}" for m in MODELS)]
    types = [pa.int32(), pa.int64(), pa.int64(), *(pa.int32() for _ in MODELS)]
    return pa.table([pa.nulls(n, t) if c is None else pa.array(c, t) for c, t in zip(columns, types)], names)


def _count_shard(busy: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        s = _Shard(table, busy)
        free = ~s.pair_busy
        rows = _numbers(_TRIPLES, s.of_triples) + _numbers(_PAIRS, s.of_pairs[:, free])
        words, word = np.unique((s.pairs % max(s.n, 1))[free], return_inverse=True)
        follows = [np.bincount(word[k[free] > 0], minlength=len(words)) for k in s.of_pairs]
        held, m = s.pairs[s.pair_busy], len(words)
        key = s.words.view(np.int64)
        return pa.concat_tables(
            [
                _counted(list(zip(*rows)), len(rows)),
                _counted([np.full(m, _WORDS), None, key[words], *follows], m),
                _counted([np.full(len(held), _BUSY), key[held // max(s.n, 1)], key[held % max(s.n, 1)], *s.of_pairs[:, s.pair_busy]], len(held)),
            ]
        )

    return run


def discounts(numbers: list[list[int]]) -> list[list[float]]:
    """For each model, the discounts of counts 1, 2 and of 3 or more, from the numbers of n-grams with counts 1 to 4."""
    found = []
    for n in ([0, *of_model] for of_model in numbers):
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else None
        # Without n-grams of some low count, the discount is its usual size.
        usual = [i - (i + 1) * y * n[i + 1] / n[i] if y is not None and n[i] else 0.75 for i in (1, 2, 3)]
        found.append([min(float(i), max(LEAST_DISCOUNT, d)) for i, d in enumerate(usual, 1)])
    return found


def _discount(m: int, d: list[list[float]]):
    n = F.col(f"n{m}")
    return F.when(n == 0, 0.0).when(n == 1, d[m][0]).when(n == 2, d[m][1]).otherwise(d[m][2])


def _counts_of_counts(table: DataFrame) -> np.ndarray:
    """How many n-grams of ``table`` have the counts 1 to 4 in each model."""
    row = table.agg(*[F.count_if(F.col(f"n{m}") == i) for m in MODELS for i in range(1, 5)]).first()
    return np.array(row).reshape(len(MODELS), 4)


def fit(texts: DataFrame, dealt: Dealing | None = None) -> tuple[Model, list[float]]:
    """The model of ``texts(fold, text)`` and the log2 probability of an unknown word in each of its models. Tokens are dealt
    as ``dealt`` says, which is found from the texts where it is not given. The counts of triples and of pairs are not kept."""
    with _cleared(texts.sparkSession):
        dealt = dealt or dealing(texts)
        read = texts.select(F.lit(0).cast("long").alias(ROW), F.col("fold").cast("int").alias("model"), F.col("text").cast("string").alias("text"))
        turns = min(COUNT_ROUNDS, dealt.shards)
        parts = []
        for turn in range(turns):
            shards = read.mapInArrow(_deal_batches(dealt, turn, turns), _DEALT).groupBy("shard")
            parts.append(written(shards.applyInArrow(_count_shard(dealt.busy), _COUNTED), "counts"))
        counted = parts[0]
        for part in parts[1:]:
            counted = counted.union(part)
        n = [f"n{m}" for m in MODELS]
        numbers = {_TRIPLES: np.zeros((len(MODELS), 4), np.int64), _PAIRS: np.zeros((len(MODELS), 4), np.int64)}
        for row in counted.filter(F.col("kind") <= _PAIRS).groupBy("kind", "word").agg(*[F.sum(k).alias(k) for k in n]).collect():
            numbers[row.kind][:, row.word - 1] = [row[k] for k in n]
        pairs = counted.filter(F.col("kind") == _BUSY).groupBy("first", "word").agg(*[F.sum(k).cast("int").alias(k) for k in n])
        pairs = written(pairs, "frequent-pairs")
        follows = pairs.select("word", *[(F.col(k) > 0).cast("int").alias(k) for k in n])
        words = counted.filter(F.col("kind") == _WORDS).select("word", *n).union(follows)
        words = written(words.groupBy("word").agg(*[F.sum(k).alias(k) for k in n]), "words")
        d = [discounts(k.tolist()) for k in (_counts_of_counts(words), numbers[_PAIRS] + _counts_of_counts(pairs), numbers[_TRIPLES])]
        sums = [s for m in MODELS for s in (F.sum(f"n{m}").alias(f"t{m}"), F.sum(_discount(m, d[0])).alias(f"taken{m}"), F.count_if(F.col(f"n{m}") > 0).alias(f"v{m}"))]
        whole = words.agg(*sums).first()
    unknown = [(whole[f"taken{m}"] / whole[f"t{m}"] if whole[f"t{m}"] else 1.0) / (whole[f"v{m}"] + 1) for m in MODELS]
    return Model(dealt, d, [whole[f"t{m}"] or 0 for m in MODELS], words, pairs), [float(np.log2(p)) for p in unknown]


def _frequent(words: DataFrame) -> DataFrame:
    """The words that follow most others, ``SENT_WORDS`` at most, by a histogram of the sizes of their counts."""
    size = F.floor(F.log2(F.greatest(f"n{FOLDS}", F.lit(1))) * 16).cast("int")
    numbers = sorted(words.groupBy(size.alias("size")).count().collect(), reverse=True)  # a row per sixteenth of a doubling
    least, held = numbers[0][0] + 1 if numbers else 0, 0
    for of_size, n in numbers:
        held += n
        if held > SENT_WORDS:
            break
        least = of_size
    return words.filter(size >= least)


def _score_shard(sent, model_discounts: list, totals: list[int], unknown: list[float], busy: np.ndarray):
    """Scores a shard's tokens: a row for each block of texts, with each text's tokens and sum of logarithms, and with the
    words, ``a`` and ``b`` of the tokens whose word is neither sent nor known to be unknown."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("first").null_count == 0:
            return _replied([])
        keys, counts, bits, sums = sent.value
        off = np.array([[[0.0, *of_model] for of_model in order] for order in model_discounts])
        s = _Shard(table, busy)
        n = s.n
        pairs, of_pairs = s.pairs[~s.pair_busy], s.of_pairs[:, ~s.pair_busy]
        added = [(pairs, of_pairs)]
        for first, _, words, held, _ in zip(*(table.column(c).to_pylist() for c in _NAMES[1:])):
            if first is not None:
                at, of = _find(s.words, _unpacked(words, np.uint64)), _find(s.words, np.array([first]).view(np.uint64))[0]
                if of >= 0:
                    added.append((of * n + at[at >= 0], _unpacked(held, np.int32).reshape(len(MODELS), -1)[:, at >= 0]))
        pairs, of_pairs = np.concatenate([a[0] for a in added]), np.concatenate([a[1] for a in added], axis=1)
        order = np.argsort(pairs)
        pairs, of_pairs = pairs[order], of_pairs[:, order]
        context, pair = _find(s.contexts, s.context), _find(pairs, s.v * n + s.w)
        triple = np.where(context >= 0, _find(s.triples, context * n + s.w), -1)
        word = _find(keys, s.words)
        bit = (bits[(s.words >> np.uint64(6)) % np.uint64(FILTER_WORDS)] >> (s.words & np.uint64(63))) & np.uint64(1)
        open_ = ((word < 0) & (bit == 1))[s.w]
        a, b, log = np.zeros(len(s.w)), np.zeros(len(s.w)), np.zeros(len(s.w))

        def parts(k: np.ndarray, taken: np.ndarray, total: np.ndarray, at: np.ndarray, of: np.ndarray, d: np.ndarray):
            """The own share of n-grams with the places ``at`` and the weight of their contexts with the places ``of``."""
            total, taken = np.append(total, 0.0)[of], np.append(taken, 0.0)[of]
            count = np.append(k, 0)[at]
            some = np.maximum(total, 1.0)
            return np.where(count > 0, (count - d[np.minimum(count, 3)]) / some, 0.0), np.where(total > 0, taken / some, 1.0)

        for m in MODELS:
            mine = np.flatnonzero(s.model == m)
            k3, k2 = s.of_triples[m], of_pairs[m]
            total = np.bincount(s.context_of, k3, len(s.contexts))
            taken = np.bincount(s.context_of, off[2, m][np.minimum(k3, 3)], len(s.contexts))
            own3, rest3 = parts(k3, taken, total, triple[mine], context[mine], off[2, m])
            of = pairs // max(n, 1)
            total, taken = np.bincount(of, k2, n), np.bincount(of, off[1, m][np.minimum(k2, 3)], n)
            split = s.busy >= 0
            total[split], taken[split] = sums[:, m, s.busy[split]]
            own2, rest2 = parts(k2, taken, total, pair[mine], s.v[mine], off[1, m])
            a[mine], b[mine] = own3 + rest3 * own2, rest3 * rest2
            c = np.append(counts[m], 0)[word]
            p1 = np.where(c > 0, (c - off[0, m][np.minimum(c, 3)]) / max(totals[m], 1), 0.0) + 2.0 ** unknown[m]
            log[mine] = np.log2(a[mine] + b[mine] * p1[s.w[mine]])
        logs = np.bincount(s.doc[~open_], log[~open_], len(s.rows))
        left = np.flatnonzero(open_)
        out, begin = [], 0
        for block, end in zip(s.blocks, s.block_ends):
            mine = left[slice(*np.searchsorted(s.doc[left], [begin, end]))]
            docs = np.concatenate([np.diff(s.rows[begin:end], prepend=0), s.sizes[begin:end]])
            of = [s.doc[mine] - begin, s.model[mine], s.words.view(np.int64)[s.w[mine]]]
            out.append((block, _packed(docs), _packed(logs[begin:end]), _packed(np.concatenate(of)), _packed(np.concatenate([a[mine], b[mine]]))))
            begin = end
        return _replied(out)

    return run


def _replied(rows: list[tuple]) -> pa.Table:
    columns = zip(*rows) if rows else [[]] * 5
    types = [pa.int64()] + [pa.binary()] * 4
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], ["block", "docs", "logs", "left_words", "left_values"])


def _add_up(table: pa.Table) -> pa.Table:
    """A row for each text of a block with its tokens and sum of logarithms in all shards of a round, and one for each token
    that is left, with its word, ``a`` and ``b``."""
    rows, sizes, logs, left = [], [], [], []
    for _, docs, log, left_words, left_values in zip(*(c.to_pylist() for c in table.columns)):
        step, size = _unpacked(docs, np.int64).reshape(2, -1)
        rows.append(np.cumsum(step))
        sizes.append(size)
        logs.append(_unpacked(log, np.float64))
        doc, model, word = _unpacked(left_words, np.int64).reshape(3, -1)
        left.append((rows[-1][doc], word, model, *_unpacked(left_values, np.float64).reshape(2, -1)))
    texts, text = np.unique(np.concatenate(rows), return_inverse=True)
    size = np.bincount(text, np.concatenate(sizes), len(texts)).astype(np.int64)
    log = np.bincount(text, np.concatenate(logs), len(texts))
    left_rows, *rest = (np.concatenate(c) for c in zip(*left))
    n, of = len(texts), len(left_rows)
    columns = [pa.chunked_array([pa.array(texts), pa.array(left_rows)])]
    columns += [pa.chunked_array([pa.array(c), pa.nulls(of, pa.array(c).type)]) for c in (size, log)]
    columns += [pa.chunked_array([pa.nulls(n, pa.array(c).type), pa.array(c)]) for c in rest]
    return pa.table(columns, names=[ROW, "n", "log", "word", "model", "a", "b"])


def perplexities(docs: DataFrame, model: Model, unknown: list[float]) -> DataFrame:
    """``row_no, perplexity`` per word of the whole text of ``docs(row_no, fold, text)``, null without a word.

    The rows with a fold must be the texts that the model is fitted to: their n-grams are counted again where the others
    meet them. A fold is scored by the model that has not seen it, all other rows by the model of both.
    """
    spark = docs.sparkSession
    dealt, d = model.dealing, model.discounts
    with _cleared(spark):
        top = _frequent(model.words).toArrow()  # SENT_WORDS rows at most
        keys = top.column("word").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        counts = np.stack([top.column(f"n{m}").to_numpy()[order].astype(np.int32) for m in MODELS])
        place = F.pmod(F.shiftrightunsigned("word", 6), F.lit(FILTER_WORDS)).cast("int").alias("place")
        bit = F.expr("shiftleft(1L, cast(word & 63 as int))")
        marks = model.words.groupBy(place).agg(F.bit_or(bit).alias("bits")).toArrow()  # FILTER_WORDS rows at most
        bits = np.zeros(FILTER_WORDS, np.uint64)
        bits[marks.column("place").to_numpy()] = marks.column("bits").to_numpy().view(np.uint64)
        both = [s for m in MODELS for s in (F.sum(f"n{m}"), F.sum(_discount(m, d[1])))]
        sums = np.zeros((2, len(MODELS), len(dealt.busy)))
        for first, *of in model.pairs.groupBy("first").agg(*both).collect():  # a row per frequent word
            sums[:, :, _find(dealt.busy, np.array([first]).view(np.uint64))[0]] = np.array(of).reshape(len(MODELS), 2).T
        sent = spark.sparkContext.broadcast((keys[order], counts, bits, sums))
        read = docs.select(ROW, F.coalesce("fold", F.lit(FOLDS)).cast("int").alias("model"), F.col("text").cast("string").alias("text"))
        turns = min(SCORE_ROUNDS, dealt.shards)
        # A row for each text, as one without a word has no tokens.
        sizes, left = docs.select(ROW, F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("log")), None
        for turn in range(turns):
            shards = read.mapInArrow(_deal_batches(dealt, turn, turns), _DEALT)
            shards = shards.union(model.pairs.mapInArrow(_deal_pairs(dealt, turn, turns), _DEALT)).groupBy("shard")
            found = shards.applyInArrow(_score_shard(sent, d, model.totals, unknown, dealt.busy), _REPLIED)
            part = written(found.groupBy("block").applyInArrow(_add_up, _SCORED), "scores")
            sizes = sizes.union(part.filter("word is null").select(ROW, "n", "log"))
            rest = part.filter("word is not null").select(ROW, "word", "model", "a", "b")
            left = rest if left is None else left.union(rest)
    chosen = lambda of: F.when(F.col("model") == 0, of(0)).when(F.col("model") == 1, of(1)).otherwise(of(2))
    known = lambda m: F.when(F.col(f"n{m}") > 0, (F.col(f"n{m}") - _discount(m, d[0])) / max(model.totals[m], 1)).otherwise(0.0) + 2.0 ** unknown[m]
    p = F.col("a") + F.col("b") * chosen(known)
    joined = left.join(model.words, "word", "left").select(ROW, F.lit(0).cast("long").alias("n"), F.log2(p).alias("log"))
    sums = sizes.union(joined).groupBy(ROW).agg(F.sum("log").alias("log"), F.sum("n").alias("size"))
    return sums.select(ROW, F.when(F.col("size") > 0, F.pow(F.lit(2.0), -F.col("log") / F.col("size"))).alias("perplexity"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """``doc_id, lang, perplexity, threshold, kept`` of every row of ``docs(doc_id, text, lang)``, a scan of files.

    Trusted documents are in two folds, and their own perplexities, from which the thresholds come, are those under the
    other fold's model. All other documents are scored by the model of both.

    Trusted are the documents that ``labels(doc_id, quality, toxic)`` calls good and not toxic in every row about them;
    all of them are counted. A language without trusted documents, and a missing one, has the threshold of all
    languages; without any, nothing is rejected for its perplexity. A text without a word, a null one too, has none and is
    not kept. Rows that repeat are judged alike; other columns are not read.
    """
    good = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("trusted"))
    good = written(good.filter("trusted"), "trusted")
    rows = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text"))
    fold = F.when(F.col("trusted"), F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")).alias("fold")
    marked = rows.join(light(good), "doc_id", "left").select(ROW, "doc_id", "lang", "text", fold)
    with _cleared(docs.sparkSession):
        model, unknown = fit(marked.filter("fold is not null").select("fold", "text"), dealing(marked))
        scored = marked.drop("text").join(perplexities(marked, model, unknown), ROW)
        scored = written(scored, "perplexities")
    trusted = scored.filter("fold is not null and perplexity is not null")
    per_language = trusted.groupBy("lang").agg(F.percentile_approx("perplexity", quantile, 10_000).alias("own"))
    overall = trusted.agg(F.percentile_approx("perplexity", quantile, 10_000).alias("all"))
    judged = scored.join(light(written(per_language.filter("lang is not null"), "thresholds")), "lang", "left").join(F.broadcast(overall))
    threshold = F.coalesce("own", "all")
    kept = F.col("perplexity").isNotNull() & (threshold.isNull() | (F.col("perplexity") <= threshold))
    return judged.select("doc_id", "lang", "perplexity", threshold.alias("threshold"), kept.alias("kept"))

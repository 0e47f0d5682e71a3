"""How the sources of a language differ in the words they use.

Terms are counted where documents are read, by Arrow's own kernels on whole batches; Spark adds the partial counts. Each
source of a language has a smoothed probability per kept term, as an integer of billionths. Two sources are compared in
units of a block of sources against another one over a shard of terms, so that no task sees a whole language.

Defined results: a null text, language or source is the empty string. A document without terms still makes its source a
source of its language. Rows are never merged: repeated rows count as often as they are there. An empty table gives no
rows. Columns other than those named are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outpulse.llm.common import light, written

#: What stands between terms: everything in ASCII but its letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: A term is kept in a language that has it in this many documents.
MIN_DOCS = 30
#: Added to every count.
SMOOTHING = 5
#: Probabilities are integers of this unit.
UNIT = 1_000_000_000
#: Terms reported per source.
TOP_TERMS = 50
#: Bytes of documents that are counted at a time. Few documents have nearly as many counts as words.
COUNTED_BYTES = 16 << 20
#: Partial counts that a task holds before it hands them on.
HELD_COUNTS = 500_000
#: Sources in a block and counts in a shard, both about.
BLOCK_SOURCES, SHARD_COUNTS = 128, 32_768
#: Terms compared at a time.
TERMS_AT_ONCE = 256

COUNTS_DDL = "lang string, source string, term string, n bigint, docs bigint"
_KEYS = ["lang", "source", "term"]


def _summed(counts: pa.Table) -> pa.Table:
    found = counts.group_by(_KEYS).aggregate([("n", "sum"), ("docs", "sum")])
    return found.select([*_KEYS, "n_sum", "docs_sum"]).rename_columns([*_KEYS, "n", "docs"])


def _coded(names: list[pa.Array]) -> tuple[pa.Array, pa.Table]:
    """Rows numbered by the distinct combinations of ``names``, and these combinations."""
    coded = [name.dictionary_encode() for name in names]
    number = pc.cast(coded[0].indices, pa.int64())
    for part in coded[1:]:
        number = pc.add(pc.multiply(number, max(len(part.dictionary), 1)), pc.cast(part.indices, pa.int64()))
    whole = number.dictionary_encode()
    kept, columns = whole.dictionary, []
    for part in reversed(coded):
        size = max(len(part.dictionary), 1)
        rest = pc.divide(kept, size)
        columns.append(part.dictionary.take(pc.subtract(kept, pc.multiply(rest, size))))
        kept = rest
    return whole.indices, pa.table(columns[::-1], names=[str(i) for i in range(len(names))])


def batch_counts(batch: pa.RecordBatch) -> pa.Table:
    """Occurrences and documents per language, source and term of one batch. The empty term counts all documents."""
    lang, source, text = (pc.fill_null(batch[name].cast(pa.large_string()), "") for name in ("lang", "source", "text"))
    group, groups = _coded([lang, source])
    words = pc.split_pattern_regex(pc.ascii_lower(text), BETWEEN)
    row, term = pc.list_parent_indices(words), pc.list_flatten(words)
    there = pc.not_equal(term, "")
    row, term = pc.filter(row, there), pc.filter(term, there).dictionary_encode()
    each = pa.table({"row": row, "term": term.indices}).group_by(["row", "term"]).aggregate([([], "count_all")])
    each = each.append_column("group", pa.chunked_array([group]).take(each["row"]))
    found = each.group_by(["group", "term"]).aggregate([("count_all", "sum"), ([], "count_all")])
    terms = pa.chunked_array([term.dictionary])
    documents = pa.table({"group": group}).group_by(["group"]).aggregate([([], "count_all")])
    rows = pa.table(
        {
            "group": pa.chunked_array([*found["group"].chunks, *documents["group"].chunks], group.type),
            "term": pa.chunked_array([*terms.take(found["term"]).chunks, pa.repeat(pa.scalar("", pa.large_string()), len(documents))]),
            "n": pa.chunked_array([*found["count_all_sum"].chunks, pa.array(np.zeros(len(documents), np.int64))], pa.int64()),
            "docs": pa.chunked_array([*found["count_all"].chunks, *documents["count_all"].chunks], pa.int64()),
        }
    )
    named = groups.take(rows["group"])
    return pa.table([named["0"], named["1"], rows["term"], rows["n"], rows["docs"]], names=[*_KEYS, "n", "docs"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of ``COUNTED_BYTES`` or little more, however small they come."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= COUNTED_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of many batches added up, and handed on whenever they are many."""
    schema = pa.schema([(name, pa.string()) for name in _KEYS] + [("n", pa.int64()), ("docs", pa.int64())])
    held: list[pa.Table] = []
    rows = 0

    def flushed() -> Iterator[pa.RecordBatch]:
        yield from _summed(pa.concat_tables(held)).cast(schema).combine_chunks().to_batches(max_chunksize=10_000)

    for batch in _joined(batches):
        held.append(batch_counts(batch))
        rows += held[-1].num_rows
        if rows > HELD_COUNTS:
            held = [_summed(pa.concat_tables(held))]
            rows = held[0].num_rows
            if 2 * rows > HELD_COUNTS:
                yield from flushed()
                held, rows = [], 0
    if held:
        yield from flushed()


def term_counts(docs: DataFrame) -> DataFrame:
    """Occurrences and documents per language, source and term, and of the empty term per source."""
    partial = docs.select("lang", "source", "text").mapInArrow(_partial_counts, COUNTS_DDL)
    return partial.groupBy(*_KEYS).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(n: str, total: str, kept: str) -> Column:
    """``1 + floor(UNIT * (n + 5) / (total + 5 * kept))``, in decimals that no corpus overflows."""
    above = f"cast({UNIT} as decimal(10, 0)) * (cast({n} as decimal(20, 0)) + {SMOOTHING})"
    below = f"(cast({total} as decimal(20, 0)) + {SMOOTHING} * cast({kept} as decimal(17, 0)))"
    return F.expr(f"case when {kept} > 0 then 1 + ({above}) div {below} else 0L end")


def _unit_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per unit, for each pair of its sources, what the unit adds to the sum of differences.

    Rows come ordered by unit and term; those without a term name the unit's sources and come first. A term that neither
    source has differs as their zeros do. That is counted for all kept terms at once, in the first shard, and the units
    add only by how much the terms that they hold differ from it.
    """
    unit: tuple | None = None
    sides: dict[bool, dict[str, int]] = {}
    zeros: dict[bool, np.ndarray] = {}
    sums = np.zeros((0, 0), np.int64)
    kept, pending = 0, []

    def dense(rows: list, second: bool) -> np.ndarray:
        place = sides[second]
        terms: dict[str, int] = {}
        values = np.empty((len({r[0] for r in rows}), len(place)), np.int64)
        values[:] = zeros[second]
        for term, side, source, p in rows:
            line = terms.setdefault(term, len(terms))
            if side == second or unit[1] == unit[2]:
                values[line, place[source]] = p
        return values

    def add() -> None:
        nonlocal pending
        if pending:
            one, two = dense(pending, False), dense(pending, True)
            for a in range(one.shape[1]):
                sums[a] += np.abs(one[:, a : a + 1] - two).sum(0) - len(one) * np.abs(zeros[False][a] - zeros[True])
        pending = []

    def result() -> pa.RecordBatch:
        add()
        if unit[3] == 0:
            sums[:] += kept * np.abs(zeros[False][:, None] - zeros[True][None, :])
        first, second = list(sides[False]), list(sides[True])
        a, b = np.divmod(np.arange(sums.size), max(len(second), 1))
        once = np.array([unit[1] != unit[2] or first[i] < second[j] for i, j in zip(a, b)], bool)
        return pa.record_batch(
            {
                "lang": pa.array([unit[0]] * int(once.sum()), pa.string()),
                "source": pa.array([first[i] for i in a[once]], pa.string()),
                "item": pa.array([second[j] for j in b[once]], pa.string()),
                "part_value": pa.array(sums.ravel()[once], pa.int64()),
            }
        )

    def begin() -> None:
        """All sources of the unit are known."""
        nonlocal sums
        for second in (False, True):
            side = sources[second] if unit[1] != unit[2] else {**sources[False], **sources[True]}
            sides[second] = {name: i for i, name in enumerate(side)}
            zeros[second] = np.array(list(side.values()), np.int64)
        sums = np.zeros((len(sides[False]), len(sides[True])), np.int64)

    sources: dict[bool, dict[str, int]] = {False: {}, True: {}}
    begun = False
    last_term = None
    terms_pending = 0
    for batch in batches:
        columns = [batch[name].to_pylist() for name in ("lang", "block", "other", "shard", "term", "second", "source", "p", "kept")]
        for lang, block, other, shard, term, second, source, p, v in zip(*columns):
            if (lang, block, other, shard) != unit:
                if unit is not None:
                    if not begun:
                        begin()
                    yield result()
                unit, kept, begun, last_term, terms_pending = (lang, block, other, shard), v, False, None, 0
                sources = {False: {}, True: {}}
            if term is None:
                sources[second][source] = p
                continue
            if not begun:
                begin()
                begun = True
            if term != last_term:
                last_term, terms_pending = term, terms_pending + 1
                if terms_pending > TERMS_AT_ONCE:
                    add()
                    terms_pending = 1
            pending.append((term, second, source, p))
    if unit is not None:
        if not begun:
            begin()
        yield result()


def _pairs(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """Summed differences of every two sources of a language, in both directions."""
    # Every row goes to the units of its block with each block, as their first or second side.
    block = F.pmod(F.xxhash64("source"), F.col("blocks"))
    paired = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))

    def placed(df: DataFrame, shard: Column, term: Column, p: str) -> DataFrame:
        spread = df.withColumn("own", block).withColumn("with", paired).withColumn("shard", shard)
        return spread.select(
            "lang",
            F.least("own", "with").alias("block"),
            F.greatest("own", "with").alias("other"),
            "shard",
            term.alias("term"),
            (F.col("own") > F.col("with")).alias("second"),
            "source",
            F.col(p).alias("p"),
            "kept",
        )

    terms = placed(counts, F.pmod(F.xxhash64("term"), F.col("shards")), F.col("term"), "p")
    names = placed(groups, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shards") - 1)), F.lit(None).cast("string"), "zero")
    unit = ["lang", "block", "other", "shard"]
    units = names.unionByName(terms).repartition(*unit).sortWithinPartitions(*unit, F.col("term").asc_nulls_first())
    parts = units.mapInArrow(_unit_pairs, "lang string, source string, item string, part_value bigint")
    once = parts.groupBy("lang", "source", "item").agg(F.sum("part_value").alias("value"))
    swap = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    return once.select("lang", swap.alias("two"), "value").select("lang", "two.source", "two.item", "value")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """Per source of a language, every other source by how much it differs, and the terms it has more than its language.

    Returns lang, source, part (``pair`` or ``term``), item, value and rank: by value downwards, then by item.
    """
    counts = written(term_counts(docs), "term-counts")
    words = counts.filter("term <> ''")
    kept = words.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("lang_docs"))
    kept = light(written(kept.filter(F.col("lang_docs") >= min_docs).select("lang", "term", "lang_n"), "kept-terms"))
    counted = written(words.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "kept-counts")

    # One row per source of a language, and one per language.
    totals = counted.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("rows"))
    groups = counts.filter("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").na.fill(0, ["total", "rows"])
    vocabulary = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    sizes = groups.groupBy("lang").agg(F.count("*").alias("sources"), F.sum("rows").alias("rows_all"))
    blocks = F.ceil(F.col("sources") / BLOCK_SOURCES).cast("bigint").alias("blocks")
    shards = (F.floor(F.col("rows_all") / SHARD_COUNTS).cast("bigint") + 1).alias("shards")
    langs = sizes.join(vocabulary, "lang", "left").na.fill(0, ["kept", "lang_total"])
    groups = groups.join(langs.select("lang", "kept", "lang_total", blocks, shards), "lang")
    groups = light(written(groups.withColumn("zero", probability("0L", "total", "kept")).drop("rows"), "sources"))

    measured = counted.join(groups, ["lang", "source"]).withColumn("p", probability("n", "total", "kept"))
    pairs = _pairs(measured, groups).withColumn("part", F.lit("pair"))
    above = measured.withColumn("value", F.col("p") - probability("lang_n", "lang_total", "kept")).filter("value > 0")
    terms = above.select("lang", "source", F.col("term").alias("item"), "value", F.lit("term").alias("part"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    ranked = pairs.withColumn("rank", place).unionByName(terms.withColumn("rank", place).filter(F.col("rank") <= top_terms))
    return ranked.select("lang", "source", "part", "item", "value", "rank")

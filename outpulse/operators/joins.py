"""Joins from a large fact side to a keyed lookup side, safe for hot keys at any lookup size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# A lookup is broadcast only when counting proves it holds at most this many (narrow) rows.
MAX_BROADCAST_ROWS = 200_000
# Places of the frequency sketch for every piece that a partition's share is made of.
CELLS_PER_PIECE = 16
# Pieces that make up one partition's share of the rows. More of them even out where the hash puts them.
PIECES = 16
# Rows without a key meet nothing, so they may be spread over any number of places.
KEYLESS_SALTS = 1 << 20


def is_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> bool:
    """True when ``df`` is proven to have at most ``max_rows`` rows. Reads no more than the bound per partition."""
    return df.limit(max_rows + 1).count() <= max_rows


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: str | Sequence[str],
    *,
    spread_by: str | Sequence[str],
    how: str = "left",
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """``facts`` joined (left or inner) to ``lookup`` on equal column names.

    A proven small lookup is broadcast, so the facts do not move. Otherwise see ``salted_join``.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"unsupported join type: {how}")
    keys = [on] if isinstance(on, str) else list(on)
    if is_small(lookup.select(*keys), max_broadcast_rows):
        return facts.join(F.broadcast(lookup), keys, how)
    return salted_join(facts, lookup, keys, spread_by=spread_by, how=how)


def frequent_cells(facts: DataFrame, cell: Column, pieces: int) -> DataFrame:
    """``(_cell, _salts)`` of the cells that hold more than one of ``pieces`` equal parts of the rows: at most ``pieces``.

    The cells are a frequency sketch: keys are counted by a hash in every task, and the counts are added up, so there are
    never more of them than cells. Sums come out the same in whatever order tasks end, so both sides of a join that
    evaluate this agree. A key that shares the cell of a frequent one is spread with it, which changes no result.
    """
    counted = facts.groupBy(cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_n")).filter("_cell is not null")
    share = F.sum("_n").over(W.partitionBy()) / pieces
    return counted.withColumn("_salts", F.ceil(F.col("_n") / share).cast("int")).filter("_salts > 1").drop("_n")


def salted_join(facts: DataFrame, lookup: DataFrame, keys: Sequence[str], *, spread_by: str | Sequence[str], how: str) -> DataFrame:
    """Both sides shuffled, with the rows of a frequent key dealt into as many pieces as its share of the rows asks for.

    Only the lookup rows of such keys are repeated, once a piece. Rows without a key are spread as well. Nothing runs
    before the query does.
    """
    spread = [spread_by] if isinstance(spread_by, str) else list(spread_by)
    keyless: Column = F.lit(False)
    for key in keys:
        keyless = keyless | F.col(key).isNull()
    pieces = PIECES * int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cell = F.when(~keyless, F.pmod(F.xxhash64(*keys), F.lit(pieces * CELLS_PER_PIECE)))
    # At most ``pieces`` rows.
    frequent = F.broadcast(frequent_cells(facts, cell, pieces))
    drawn = F.xxhash64(F.lit(17), *spread)
    salts = F.when(F.col("_cell").isNull(), F.lit(KEYLESS_SALTS)).otherwise(F.coalesce("_salts", F.lit(1)))
    salted_facts = facts.withColumn("_cell", cell).join(frequent, "_cell", "left").withColumn("_salt", F.pmod(drawn, salts).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    salted_lookup = lookup.withColumn("_cell", cell).join(frequent, "_cell", "left").withColumn("_salt", every)
    helpers = ["_cell", "_salts"]
    return salted_facts.drop(*helpers).join(salted_lookup.drop(*helpers), [*keys, "_salt"], how).drop("_salt")

"""Fingerprints that follow the edit distance of texts: Order MinHash, in DataFrame functions only.

A text is cut into units (runs of at most 32 characters without space; wide scripts by single characters) and into
k-mers of two units, the last unit standing alone. The n-th occurrence of a k-mer is told from its first, as one hash
per k-mer and number. Every signature has an offset of its own on the ring of hash values and selects the two k-mers
whose hashes follow it first; these are put into the order that they have in the text, and the pair of k-mers is hashed.
The offsets are equal steps of one ring, so a text is hashed and sorted once for all signatures. Texts with the same
k-mers in another order differ, unlike under plain MinHash.

The next document is the one before it in its order of ids. Documents are placed by a range partition of narrow rows;
texts are shuffled once by place, and each meets the next one inside its bucket. The first of each bucket is sent to the
bucket before, too.

Defined results: a null text is empty. An empty text, or one of spaces only, has all signatures zero; two of them are
alike (1), and one is unlike any other (0). Rows with equal or null ids are ordered by the place of the row in its file,
nulls last. The only document of a table is its own next one. An empty table gives no rows. Further columns, whatever
their names, stay inside ``doc``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outpulse.llm.common import ROW, light, numbered, written

#: Units of a text: wide scripts from U+2E80 on by character.
UNITS = r"[^\x20\x09-\x0D\x{2E80}-\x{10FFFF}]{1,32}|[\x{2E80}-\x{10FFFF}]"
#: Signatures of a fingerprint, a power of two, by its number of bits.
SIGNATURE_BITS = 6
SIGNATURES = 1 << SIGNATURE_BITS
#: Bits of a packed number that hold a place in the text; the others hold a hash.
PLACE_BITS = 28
#: Documents in a bucket.
BUCKET = 4096

_PLACE = (1 << PLACE_BITS) - 1


def _packed(value: Column, place: Column) -> Column:
    return value.bitwiseAND(F.lit(~_PLACE)).bitwiseOR(place.cast("bigint"))


def _upto(last: Column) -> Column:
    """0, 1, ... last."""
    return F.sequence(F.lit(0), last)


def fingerprinted(df: DataFrame, text: str, result: str) -> DataFrame:
    """``df`` with array ``result`` of one number per signature. Each step is a column of its own, as later ones use it
    several times per element."""
    kept = df.columns
    df = df.withColumn("units", F.regexp_extract_all(F.col(text), F.lit(UNITS), F.lit(0)))
    kmer = F.zip_with("units", F.slice("units", F.lit(2), F.greatest(F.size("units"), F.lit(1))), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn("kmers", kmer).drop("units")
    df = df.withColumn("found", F.sort_array(F.transform("kmers", lambda h, i: _packed(h, i))))
    # Equal hashes stand side by side now. A run of them is numbered from 0, so each has a hash of its own.
    df = df.withColumn("n", F.size("found"))
    hashed = lambda i: F.shiftright(F.get("found", i), PLACE_BITS)
    starts = F.filter(_upto(F.col("n") - 1), lambda i: (i == 0) | (hashed(i) != hashed(i - 1)))
    df = df.withColumn("starts", F.when(F.col("n") > 0, starts).otherwise(F.array().cast("array<int>")))
    ends = F.concat(F.slice("starts", F.lit(2), F.greatest(F.size("starts"), F.lit(1))), F.array("n"))
    df = df.withColumn("runs", F.arrays_zip("starts", ends.alias("ends")))
    numbered_run = lambda run: F.transform(
        F.sequence(run["starts"], run["ends"] - 1),
        lambda i: _packed(F.xxhash64(hashed(i), i - run["starts"]), F.get("found", i).bitwiseAND(F.lit(_PLACE))),
    )
    several = F.flatten(F.transform("runs", numbered_run))
    df = df.withColumn("ring", F.when(F.col("n") > 0, F.sort_array(several)).otherwise(F.array().cast("array<bigint>"))).drop("found", "starts", "runs")

    # The signatures whose offset lies between the number before and this one select this one and its successor.
    step = lambda v: F.shiftright(v, 64 - SIGNATURE_BITS).cast("int")
    first_step = -(SIGNATURES // 2)
    before = lambda i: F.when(i == 0, F.lit(first_step - 1)).otherwise(step(F.get("ring", i - 1)))
    df = df.withColumn("chosen", F.filter(_upto(F.greatest(F.col("n") - 1, F.lit(0))), lambda i: (F.col("n") > 0) & (step(F.get("ring", i)) > before(i))))

    def place(i: Column) -> Column:
        return F.get("ring", i).bitwiseAND(F.lit(_PLACE)).cast("int")

    def pair(i: Column) -> Column:
        one, two = place(i), place((i + 1) % F.col("n"))
        hashes = F.xxhash64(F.get("kmers", F.least(one, two)), F.get("kmers", F.greatest(one, two)))
        # Zero is kept for texts without units.
        return hashes.bitwiseAND(F.lit(0xFFFFFFFE)).bitwiseOR(F.lit(1))

    each = F.transform("chosen", lambda i: F.array_repeat(pair(i), step(F.get("ring", i)) - before(i)))
    after = F.array_repeat(pair(F.lit(0)), F.lit(SIGNATURES // 2 - 1) - step(F.get("ring", F.col("n") - 1)))
    none = F.array_repeat(F.lit(0).cast("bigint"), SIGNATURES)
    df = df.withColumn(result, F.when(F.col("n") > 0, F.concat(F.flatten(each), after)).otherwise(none))
    return df.select(*kept, result)


def spelled(fingerprint: Column) -> Column:
    """Eight hexadecimal digits a signature."""
    return F.array_join(F.transform(fingerprint, lambda v: F.lower(F.lpad(F.hex(v), 8, "0"))), "")


def likeness(one: Column, two: Column) -> Column:
    """The share of equal signatures, 0 between a text without units and another one."""
    same = F.size(F.filter(F.zip_with(one, two, lambda a, b: a == b), lambda v: v))
    return same / F.lit(float(SIGNATURES))


def placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """The place (from 0) of every row number in ``order``, without a global sort in one task.

    Narrow rows are dealt out by ranges, which are written, as their bounds are sampled. Ranges are numbered by their
    size, then rows within each.
    """
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "ranges")
    # One row a range; their number is bounded by the partitions.
    sizes = ranged.groupBy("part").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", before.alias("start"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return ranged.withColumn("within", within).join(F.broadcast(starts), "part").select(ROW, (F.col("start") + F.col("within")).alias("place"))


def with_next(docs: DataFrame, doc_id: str, columns: Callable[[DataFrame], DataFrame], carried: list[str]) -> DataFrame:
    """``columns(rows)`` of every document as struct ``doc``, with ``next_`` copies of ``carried`` from the next document."""
    rows = numbered(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")))
    key = F.col(f"doc.`{doc_id}`").alias("id")
    places = written(placed(rows.select(ROW, key), [F.col("id").desc_nulls_last(), F.col(ROW)]), "places")
    count = places.count()
    # The first of each bucket is also the guest of the bucket before it; the very first is that of the last bucket.
    last = (count - 1) // BUCKET
    bucket = F.floor(F.col("place") / BUCKET).cast("bigint")
    guest = F.when(F.col("place") == 0, F.lit(last)).when(F.col("place") % BUCKET == 0, bucket - 1)
    own = F.struct(bucket.alias("bucket"), F.col("place").alias("at"))
    guests = F.when(guest.isNotNull(), F.array(F.struct(guest.alias("bucket"), ((guest + 1) * BUCKET).alias("at"))))
    ready = columns(rows.join(light(places), ROW))
    sent = ready.withColumn("to", F.explode(F.concat(F.array(own), F.coalesce(guests, F.array().cast("array<struct<bucket:bigint,at:bigint>>")))))
    order = Window.partitionBy("to.bucket").orderBy("to.at")
    follow = [F.lead(c).over(order).alias(f"next_{c}") for c in carried]
    met = sent.select("doc", *carried, "to", *follow)
    return met.filter(F.floor(F.col("to.at") / BUCKET) == F.col("to.bucket")).drop("to")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document and its edited text (its second half replaced by the head of the next document) with fingerprints.

    Returns ``doc``, n_chars, edited (text), fingerprint, edited_fingerprint, near_edited, near_next.
    """

    def measured(rows: DataFrame) -> DataFrame:
        whole = rows.withColumn("whole", F.coalesce(F.col(f"doc.`{text}`"), F.lit("")))
        return fingerprinted(whole.withColumn("n_chars", F.length("whole").cast("bigint")), "whole", "signatures")

    met = with_next(docs, doc_id, measured, ["whole", "n_chars", "signatures"])
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("whole", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_whole", F.lit(1), half))
    met = fingerprinted(met.withColumn("edited", edited), "edited", "edited_signatures")
    return met.select(
        "doc",
        "n_chars",
        "edited",
        spelled(F.col("signatures")).alias("fingerprint"),
        spelled(F.col("edited_signatures")).alias("edited_fingerprint"),
        likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"),
        likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next"),
    )

"""Quality rules with host verdicts.

A document fails by its own rules when it is short, repeats itself or is full of symbols. Failures are counted per host,
each host's rate is shrunk towards a beta prior fitted to all hosts, and a host whose shrunken rate stands out from that
prior, with most of its documents failing, loses all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outpulse.llm.common import as_bytes, light, written

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: Symbols in percent of word characters beyond which a text is junk.
MAX_SYMBOL_PERCENT = 10
#: A host goes when its shrunken failure rate is this many deviations of the prior above its mean, but never below the
#: first of these rates and always above the second.
HOST_DEVIATIONS, HOST_RATES = 3, (0.5, 0.8)

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_FEATURES = T.StructType([T.StructField(name, T.LongType()) for name in MEASURES])
_NOT_SYMBOL = bytes(b for b in range(256) if b not in SYMBOLS)
_CONTINUATION = bytes(range(0x80, 0xC0))


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice, the first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    numbers: dict[bytes, int] = {}
    codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    if len(numbers) == n:
        return 0
    pairs = np.unique(codes[:-1] * len(numbers) + codes[1:], return_inverse=True)[1]
    _, window, counts = np.unique(pairs[:-1] * len(numbers) + codes[2:], return_inverse=True, return_counts=True)
    again = counts[window] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= again
    return int(covered.sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in text:
        return 0
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def measure(text: bytes) -> tuple[int, int, int, int, int]:
    # bytes.split() parts words at 0x20 and 0x09-0x0D only.
    words = text.split()
    chars = sum(map(len, words))
    if not text.isascii():
        chars -= len(text) - len(text.translate(None, _CONTINUATION))
    symbols = len(text.translate(None, _NOT_SYMBOL))
    return len(words), chars, symbols, duplicate_lines(text), repeated_words(words)


@F.arrow_udf(_FEATURES)
def features(text: pa.Array) -> pa.Array:
    rows = [measure(value) for value in as_bytes(text)]
    columns = zip(*rows) if rows else [()] * len(MEASURES)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], MEASURES)


# Spark would otherwise run it again for a filter on what it returns.
features = features.asNondeterministic()


def fails(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEATED_PERCENT * n_words)


def junk(n_symbols: Column, word_chars: Column, max_percent: int) -> Column:
    return 100 * n_symbols > max_percent * word_chars


def host_verdicts(flags: DataFrame) -> DataFrame:
    """One row per host of ``flags(host, failed)``: documents, failures, shrunken rate, verdict.

    The prior is a beta distribution with the mean and variance of the hosts' own rates (method of moments, one vote a
    host). With fewer than two hosts, or rates that do not vary, it is the uniform prior. Documents without a host get
    no host verdict.
    """
    hosts = (
        flags.filter("host is not null")
        .groupBy("host")
        .agg(F.count("*").alias("host_docs"), F.count_if("failed").alias("host_failed"))
    )
    rate = F.col("host_failed") / F.col("host_docs")
    moments = hosts.agg(F.avg(rate).alias("m"), F.var_samp(rate).alias("v"))
    strength = F.try_divide(F.col("m") * (1 - F.col("m")), F.col("v")) - 1
    usable = strength > 0
    outstanding = F.col("m") + HOST_DEVIATIONS * F.sqrt(F.coalesce("v", F.lit(0.0)))
    prior = moments.select(
        F.least(F.greatest(outstanding, F.lit(HOST_RATES[0])), F.lit(HOST_RATES[1])).alias("max_rate"),
        F.when(usable, F.col("m") * strength).otherwise(1.0).alias("alpha"),
        F.when(usable, (1 - F.col("m")) * strength).otherwise(1.0).alias("beta"),
    )
    shrunk = (F.col("host_failed") + F.col("alpha")) / (F.col("host_docs") + F.col("alpha") + F.col("beta"))
    # The prior is one row, an aggregate without keys.
    rated = hosts.join(F.broadcast(prior)).withColumn("host_rate", shrunk)
    return rated.select("host", "host_docs", "host_failed", "host_rate", (F.col("host_rate") > F.col("max_rate")).alias("host_rejected"))


def judge(docs: DataFrame, text: str = "text", host: str = "source", max_symbol_percent: int = MAX_SYMBOL_PERCENT) -> DataFrame:
    """``docs`` as struct column ``doc``, with the rule measures, ``base_failed``, ``junk``, ``host_rejected`` and ``kept``.

    Any number of rows and columns, whatever their names. A null or empty text has no words and fails. Repeated rows are
    judged alike and each counts for its host. A null host is never rejected. Texts are measured whole. A document that
    fails by length, repetition or symbols counts for its host.

    Only counts per host are shuffled. Rejected hosts alone are written and joined back, broadcast while they are few.
    """
    measured = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), features(F.col(text)).alias("f"))
    base_failed = fails(F.col("f.n_words"), F.col("f.n_repeat_words")).alias("base_failed")
    too_many = junk(F.col("f.n_symbols"), F.col("f.word_chars"), max_symbol_percent).alias("junk")
    measured = measured.select("doc", "f.*", base_failed, too_many)
    failed = F.col("base_failed") | F.col("junk")
    flags = measured.select(F.col(f"doc.`{host}`").alias("host"), failed.alias("failed"))
    rejected = light(written(host_verdicts(flags).filter("host_rejected").select("host", "host_rejected"), "rejected-hosts"))
    judged = measured.withColumn("host", F.col(f"doc.`{host}`")).join(rejected, "host", "left")
    judged = judged.withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
    return judged.withColumn("kept", ~failed & ~F.col("host_rejected"))

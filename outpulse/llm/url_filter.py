"""URL filter: rules by host and path, then a blocked Bloom filter and an exact join with a list of URLs.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a block: eight of 64 bits, one bit set in each.
WORDS = 8
#: The filter never has more blocks, so at 64 bytes a block its broadcast stays under 8 MB. A longer list only makes the
#: filter pass more URLs to the exact join.
MAX_BLOCKS = 1 << 17


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without one."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without ``www.`` or ``m.``, path without ``.html`` and closing slashes; scheme, query and fragment do not count."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(\.html|/+)$", ""))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest of ``rules(verdict, host, path)`` that fits, else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # The last one wrapped is asked first.
    for what, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def _bit(hashed: Column, word: int) -> Column:
    """The bit that a hash sets in a word of its block: six bits of the hash for each of the eight words."""
    place = F.shiftrightunsigned(hashed, 6 * word).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def bloom_blocks(listed: DataFrame, url: str, blocks: int) -> DataFrame:
    """``(block, w0 .. w7)`` of the listed URLs, combined on the map side; at most ``blocks`` rows."""
    hashed = listed.select(F.xxhash64(url).alias("h"), F.xxhash64(url, F.lit("block")).alias("b"))
    return hashed.groupBy(F.pmod("b", F.lit(blocks)).cast("int").alias("block")).agg(
        *[F.bit_or(_bit(F.col("h"), i)).alias(f"w{i}") for i in range(WORDS)]
    )


def judge_urls(
    pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", blocks: int = MAX_BLOCKS
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``; columns of these names are replaced.

    A rule decides where one fits. Other pages are blocked when ``listed.canonical_url`` holds their canonical URL and
    allowed otherwise. A null URL, or one without ``://``, has empty host and path and is allowed. The list may hold
    nulls, repeats, or nothing. Repeated pages are judged alike.

    The filter is broadcast, bounded by ``blocks``. Only the pages that it passes meet the list, in a hash join by URL;
    the others are a second narrow branch over the same scan. Should the list be long, Spark splits frequent URLs.
    """
    if not 1 <= blocks <= MAX_BLOCKS:
        raise ValueError(f"blocks must be from 1 to {MAX_BLOCKS}")
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("page")
    parsed = pages.select(row, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rule, ruled = matching_rule(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumns({"rule": rule, "ruled": ruled, "canonical_url": canonical(F.col("host"), F.col("path"))})
    parsed = parsed.withColumns(
        {"h": F.xxhash64("canonical_url"), "block": F.pmod(F.xxhash64("canonical_url", F.lit("block")), F.lit(blocks)).cast("int")}
    )
    wanted = listed.filter("canonical_url is not null").select("canonical_url").distinct()
    probed = parsed.join(F.broadcast(bloom_blocks(wanted, "canonical_url", blocks)), "block", "left")
    hit = F.lit(True)
    for i in range(WORDS):
        bit = _bit(F.col("h"), i)
        hit = hit & (F.col(f"w{i}").bitwiseAND(bit) == bit)
    possible = F.coalesce(F.col("ruled").isNull() & (F.col("host") != "") & hit, F.lit(False))
    probed = probed.select("page", "host", "path", "rule", "ruled", "canonical_url", possible.alias("possible"))
    passed = probed.filter("possible").join(wanted.withColumn("is_listed", F.lit(True)), "canonical_url", "left")
    others = probed.filter("not possible").withColumn("is_listed", F.lit(False))
    both = passed.unionByName(others)
    verdict = F.coalesce("ruled", F.when(F.col("is_listed"), "block").otherwise("allow"))
    return both.select("page.*", "host", "path", "rule", verdict.alias("verdict"))

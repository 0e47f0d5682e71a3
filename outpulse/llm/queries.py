"""The registered queries of this subpackage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outpulse.llm import (
    conversation_repair,
    decontaminate,
    language_id,
    near_dedup,
    order_minhash,
    packing,
    perplexity,
    quality_rules,
    source_divergence,
    suffix_dedup,
    token_counts,
    url_filter,
    warc,
)
from outpulse.llm.common import table

#: Rules of the URL query: verdict, host, path prefix.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Host words whose pages make up the list of the URL query.
LISTED_HOSTS = r"(^|[.-])(casino|bets|pills|adult|spam|ads)([.-]|$)"


def vocabulary() -> tuple[str, str]:
    """Rank file and pre-token pattern of the byte-level vocabulary."""
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    return found.select("doc.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens before and after its personal data is redacted."""
    trees = token_counts.build_trees(table(spark, sf_dir, "documents"), *vocabulary())
    edits = F.arrow_udf(token_counts.redactions, token_counts.EDITS_DDL).asNondeterministic()
    edited = token_counts.apply_edits(trees.withColumn("edits", edits("text")), *vocabulary())
    return edited.select("doc_id", "tokens_before", "tokens_after", "n_edits", "chars_encoded", F.size("tree.chars").alias("n_leaves"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.near_duplicates(docs, words=3, percent=85)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.scanned(docs, table(spark, sf_dir, "benchmark")).withColumn("n_hit", decontaminate.n_hit(F.col("runs")))
    return found.select(
        "doc.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        decontaminate.items_digest(F.col("items")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def listed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical URLs of all pages whose host has a listed word."""
    host, path = url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))
    pages = table(spark, sf_dir, "pages").select(host.alias("host"), path.alias("path"))
    return pages.filter(F.col("host").rlike(LISTED_HOSTS)).select(
        url_filter.canonical(F.col("host"), F.col("path")).alias("canonical_url")
    )


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return perplexity.classify(docs, table(spark, sf_dir, "labels"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.judge_urls(pages, listed_urls(spark, sf_dir), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    # An unknown id has no remainder and is not learned from.
    network = language_id.train(language_id.sample(docs, ~held_out))
    judged = language_id.identify(docs.select("doc_id", "text"), network)
    held = F.crc32(F.col("doc.doc_id").cast("string").cast("binary")) % 4 == 2
    return judged.select("doc.doc_id", held.alias("held_out"), "lang_pred", "score")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality_rules.judge(docs).select("doc.doc_id", *quality_rules.MEASURES, "base_failed", "kept")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), *vocabulary())


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = order_minhash.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256")
    return found.select("doc.doc_id", "n_chars", digest, "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


QUERIES = {
    query.__name__: query
    for query in (
        op1_suffix_dedup,
        op2_warc,
        op3_token_counts,
        op4_near_dedup,
        op5_decontaminate,
        op6_quality_classifier,
        op7_url_filter,
        op8_language_id,
        op9_quality_rules,
        op10_packing,
        op11_source_divergence,
        op12_document_fingerprints,
        op13_conversation_repair,
    )
}

_URL_SQL = r"""
WITH parsed AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
named AS (
  SELECT *, regexp_replace(host, '^(www|m)[.]', '') || regexp_replace(path, '([.]html|/+)$', '') AS canonical,
         host = 'example.org' OR ends_with(host, '.example.org') AS in_example,
         host = 'com' OR ends_with(host, '.com') AS in_com, host = 'org' OR ends_with(host, '.org') AS in_org
  FROM parsed),
ruled AS (
  SELECT *, CASE WHEN in_example AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                 WHEN in_example AND starts_with(path, '/es/') THEN 'example.org/es/'
                 WHEN in_com AND starts_with(path, '/fr/') THEN 'com/fr/'
                 WHEN in_com AND starts_with(path, '/de/') THEN 'com/de/'
                 WHEN in_org AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM named),
listed AS (SELECT DISTINCT canonical FROM named WHERE regexp_matches(host, '(^|[.-])(casino|bets|pills|adult|spam|ads)([.-]|$)'))
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN host <> '' AND canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

_RULES_SQL = r"""
WITH split AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) AS win
  FROM split WHERE len(w) >= 3),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM split),
base AS (
  SELECT s.doc_id, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM split s JOIN lines USING (doc_id) LEFT JOIN covered c USING (doc_id)),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 100 * n_symbols > 10 * word_chars AS junk FROM base),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed OR junk) AS f FROM judged WHERE source IS NOT NULL GROUP BY source),
moments AS (SELECT avg(f / n) AS m, var_samp(f / n) AS v FROM hosts),
prior AS (SELECT m, least(greatest(m + 3 * sqrt(coalesce(v, 0)), 0.5), 0.8) AS max_rate, CASE WHEN v > 0 AND m * (1 - m) / v - 1 > 0 THEN m * (1 - m) / v - 1 END AS strength FROM moments),
rejected AS (
  SELECT source FROM hosts, prior
  WHERE (f + coalesce(m * strength, 1)) / (n + coalesce(m * strength, 1) + coalesce((1 - m) * strength, 1)) > max_rate)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT junk AND (source IS NULL OR source NOT IN (SELECT source FROM rejected)) AS kept
FROM judged
"""

_DIVERGENCE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
words AS (
  SELECT d, lang, source,
         unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM docs),
kept AS (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY ALL HAVING count(DISTINCT d) >= 30),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(lang_n)::HUGEINT AS total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
full_counts AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.lang_n::HUGEINT AS lang_n
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sized AS (SELECT *, sum(n) OVER (PARTITION BY lang, source)::HUGEINT AS total FROM full_counts),
measured AS (
  SELECT s.lang, s.source, s.term, s.n, 1 + (1000000000 * (s.n + 5)) // (s.total + 5 * l.v) AS p,
         1 + (1000000000 * (s.lang_n + 5)) // (l.total + 5 * l.v) AS lang_p
  FROM sized s JOIN langs l USING (lang)),
differing AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM measured a JOIN measured b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN differing f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - lang_p FROM measured WHERE n > 0 AND p > lang_p)
SELECT lang, source, part, item, value::BIGINT AS value,
       (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::INTEGER AS rank
FROM found QUALIFY part = 'pair' OR rank <= 50
"""

#: DuckDB SQL for the queries that it can express on whole tables. Tests compare the others with brute force.
SQL: dict[str, str] = {
    "op7_url_filter": _URL_SQL,
    "op9_quality_rules": _RULES_SQL,
    "op11_source_divergence": _DIVERGENCE_SQL,
}

"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.llm.collocations import collocations
from tidewell.llm.decontaminate import contaminated_passages
from tidewell.llm.language import identify_language
from tidewell.llm.neighbours import nearest_neighbours
from tidewell.llm.ngram_join import ngram_components
from tidewell.llm.packing import pack_documents
from tidewell.llm.periodic_runs import periodic_runs, run_digest, with_planted_period
from tidewell.llm.quality import score_quality
from tidewell.llm.quality_rules import rule_verdicts
from tidewell.llm.revisit import captures_of_pages, resolve_revisits
from tidewell.llm.secrets import scan_secrets, span_digest
from tidewell.llm.suffix_dedup import remove_repeats, repeat_digest
from tidewell.llm.toxicity import score_toxicity


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_revisits(spark: SparkSession, folder: str) -> DataFrame:
    """Every revisit of the crawl derived from ``pages``; headers spelled out, payload hashed."""
    resolved = resolve_revisits(captures_of_pages(_table(spark, folder, "pages")))
    lines = F.transform("headers", lambda e: F.concat_ws(": ", e["key"], e["value"]))
    return resolved.select(
        "record_id",
        "canonical_url",
        "status",
        "response_id",
        F.array_join(lines, "\n").alias("headers"),
        F.md5("payload").alias("payload_md5"),
        F.length("payload").cast("long").alias("payload_chars"),
    )


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    return score_quality(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeat_digest(remove_repeats(_table(spark, folder, "documents")))


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    return identify_language(_table(spark, folder, "documents"))


def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return span_digest(scan_secrets(_table(spark, folder, "documents")))


def op6_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest_neighbours(_table(spark, folder, "embeddings"))


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(_table(spark, folder, "documents"))


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated_passages(
        _table(spark, folder, "documents"), _table(spark, folder, "benchmark")
    )


def op9_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_components(_table(spark, folder, "documents"))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return score_toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(_table(spark, folder, "documents"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of every document, one in ten with its rear made periodic first."""
    docs = _table(spark, folder, "documents")
    planted = with_planted_period(F.col("doc_id"), F.col("text"))
    found = docs.select("doc_id", periodic_runs(planted).alias("found"))
    return found.select("doc_id", *run_digest(F.col("found")))


def op13_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rule_verdicts(_table(spark, folder, "documents"), _table(spark, folder, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "step", "certified", "rule",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_revisits": op1_revisits,
    "op2_quality": op2_quality,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_language": op4_language,
    "op5_secrets": op5_secrets,
    "op6_neighbours": op6_neighbours,
    "op7_packing": op7_packing,
    "op8_decontamination": op8_decontamination,
    "op9_ngram_join": op9_ngram_join,
    "op10_toxicity": op10_toxicity,
    "op11_collocations": op11_collocations,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_quality_rules": op13_quality_rules,
}

_OP1_SQL = r"""
WITH spelled AS (
  SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest
  FROM pages
), parts AS (
  SELECT page_id, html,
    regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), '^www\.', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda p: p <> ''
      AND NOT regexp_matches(lower(p), '^(utm_[a-z]+|gclid|fbclid|ref|sessionid)(=|$)'))) AS kept
  FROM spelled
), page AS (
  SELECT page_id, html,
    host || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical_url,
    '"' || md5(html) || '"' AS tag
  FROM parts
), revisit AS (
  SELECT page_id * 3 + 1 AS record_id, page_id, canonical_url, page_id * 10 + 5 AS at,
    CASE page_id % 4 WHEN 0 THEN tag WHEN 1 THEN tag WHEN 3 THEN '"other"' END AS tag
  FROM page
  UNION ALL
  SELECT page_id * 3 + 2, page_id, canonical_url, page_id * 10 - 5, tag FROM page
), found AS (
  SELECT v.*, p.page_id AS full_id, p.tag AS full_tag, p.html
  FROM revisit v ASOF LEFT JOIN (SELECT *, page_id * 10 AS at FROM page) p
    ON v.canonical_url = p.canonical_url AND v.at > p.at
), judged AS (
  SELECT *, CASE WHEN full_id IS NULL THEN 'no_earlier_response'
    WHEN coalesce(tag = full_tag, page_id = full_id) THEN 'resolved'
    ELSE 'validator_mismatch' END AS status
  FROM found
)
SELECT record_id, canonical_url, status,
  CASE WHEN status = 'resolved' THEN full_id * 3 END AS response_id,
  CASE WHEN status = 'resolved' THEN 'cache-control: max-age=60' || chr(10) || 'content-type: text/html'
    || chr(10) || 'date: day ' || page_id || ' later' || chr(10) || 'etag: ' || full_tag
    || chr(10) || 'server: first' END AS headers,
  CASE WHEN status = 'resolved' THEN md5(html) END AS payload_md5,
  CASE WHEN status = 'resolved' THEN length(html) END AS payload_chars
FROM judged
"""

_OP11_SQL = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS words FROM piece
), total AS (
  SELECT lang, sum(len(words))::BIGINT AS n FROM worded GROUP BY lang
), placed AS (
  SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM worded
), gram AS (
  SELECT lang, unnest(list_transform(range(1, least(5, len(words) - i + 1) + 1),
    lambda k: array_to_string(words[i : i + k - 1], ' '))) AS phrase
  FROM placed
), f AS (
  SELECT lang, phrase, count(*) AS f FROM gram GROUP BY lang, phrase HAVING count(*) >= 100
), candidate AS (
  SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS words, len(string_split(phrase, ' ')) AS k
  FROM f WHERE contains(phrase, ' ')
), inner_part AS (
  SELECT lang, a, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2),
    lambda i: array_to_string(words[i : i + m - 1], ' '))))) AS phrase
  FROM candidate
), covering AS (
  SELECT lang, phrase, max(a) AS longest FROM inner_part GROUP BY lang, phrase
), cut AS (
  SELECT lang, phrase, a, c, array_to_string(words[1 : c], ' ') AS head, array_to_string(words[c + 1 : k], ' ') AS rest
  FROM (SELECT lang, phrase, a, words, k, unnest(range(1, k)) AS c
    FROM candidate LEFT JOIN covering USING (lang, phrase) WHERE longest IS NULL OR 100 * longest < 100 * a)
), scored AS (
  SELECT cut.lang, cut.phrase, a, c, h.f AS l, t.f AS r, n,
    (1000::HUGEINT * a * n) // (h.f::HUGEINT * t.f) AS score
  FROM cut JOIN f h ON h.lang = cut.lang AND h.phrase = head
    JOIN f t ON t.lang = cut.lang AND t.phrase = rest JOIN total ON total.lang = cut.lang
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""

_OP12_SQL = r"""
WITH coded AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    xor(list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
      lambda acc, x: xor(xor(acc, x) >> 1, 3988292384 * (xor(acc, x) & 1)), 4294967295::BIGINT), 4294967295) AS h
  FROM documents
), placed AS (
  SELECT doc_id, words, len(words) AS n, h, h // 10 AS g,
    CASE WHEN len(words) > 0 THEN (h // 10) % len(words) ELSE 0 END AS a
  FROM coded
), period AS (
  SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM placed
), token AS (
  SELECT doc_id, n, i, words[CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END + 1] AS word
  FROM (SELECT *, unnest(range(0, n)) AS i FROM period)
), pair AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM token x JOIN token y
    ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 2 * (y.i - x.i) <= x.n
), stretch AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pair)
  GROUP BY doc_id, q, island HAVING count(*) >= q AND count(*) + q >= 12
), run AS (
  SELECT * FROM stretch s WHERE NOT EXISTS (SELECT 1 FROM stretch t WHERE t.doc_id = s.doc_id AND t.q < s.q
    AND s.q % t.q = 0 AND t.start <= s.start AND t.start + t.length >= s.start + s.length)
), kept AS (
  SELECT * FROM token t WHERE NOT EXISTS (SELECT 1 FROM run r WHERE r.doc_id = t.doc_id
    AND t.i >= r.start + r.q AND t.i < r.start + r.length)
), listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines
  FROM run GROUP BY doc_id
), longest AS (
  SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, q) = 1
), collapsed AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM kept GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, q AS period, 1000 * length // q AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(c.text, '')) AS collapsed_sha256
FROM documents d LEFT JOIN listed USING (doc_id) LEFT JOIN longest USING (doc_id) LEFT JOIN collapsed c USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op1_revisits": _OP1_SQL,
    "op11_collocations": _OP11_SQL,
    "op12_periodic_runs": _OP12_SQL,
}

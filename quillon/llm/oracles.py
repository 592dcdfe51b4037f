"""DuckDB SQL of the queries that SQL can express."""

from .quality import STOP_WORDS

STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)

ORACLES = {
    "op1_warc": r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS h FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keep FROM d),
x AS (SELECT *, list_transform(range(0, 32), lambda k: ((('0x' || substr(h || '0', CAST(k * 5 // 4 + 1 AS INT), 3))::BIGINT >> (7 - (k * 5) % 4)) & 31)) AS v FROM m)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(v, lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(i + 1 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keep THEN keep END AS refers_to, true AS verified
FROM x""",
    "op2_url_filter": r"""
WITH parsed AS (
  SELECT page_id,
    CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN url LIKE '%://%' THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
rules(v, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/'))
SELECT page_id, host, path,
  (SELECT arg_max(h || p, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule,
  coalesce((SELECT arg_max(v, length(h || p)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)), 'allow') AS verdict
FROM parsed""",
    "op7_quality": rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
win AS (SELECT doc_id, unnest(list_transform(range(1, len(words) - 6), lambda i: {{'p': i, 's': array_to_string(words[i:i+7], ' ')}})) AS w
  FROM t WHERE len(words) >= 8),
rep AS (SELECT doc_id, w.p AS p FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, w.s) >= 2),
cov AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM rep, range(0, 8) r(k) GROUP BY doc_id),
m AS (SELECT t.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
    len(list_intersect(words, [{STOPS}])) AS stops
  FROM t LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 2.0 AND 15.0 AND n_symbols / n_words <= 0.1
    AND coalesce(n_dup_lines / nullif(n_lines, 0), 0) <= 0.3 AND n_repeat_words / n_words <= 0.3
    AND NOT (n_words >= 100 AND stops < 1) AS kept
FROM b""",
}

"""DuckDB SQL with the rows of the queries that SQL can express."""

from __future__ import annotations

#: Words of a text: DuckDB regular expressions see the same characters as the kernel.
WORDS = r"list_filter(string_split_regex(coalesce({text}, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {}

SQL["op1_minhash"] = f"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, {WORDS.format(text=LOWER)} AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s
  FROM tokens
), flat AS (
  SELECT doc_id, unnest(s) AS shingle FROM sets
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM flat a JOIN flat b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE 100 * n >= 85 * (len(x.s) + len(y.s) - n)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, seen) AS (
  SELECT doc_id, doc_id FROM sets
  UNION
  SELECT e.b, r.seen FROM reach r JOIN edges e ON e.a = r.doc_id
), lowest AS (
  SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY 1
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN lowest USING (doc_id)
"""

SQL["op2_quality"] = f"""
WITH tokens AS (
  SELECT doc_id, coalesce(text, '') AS t, {WORDS.format(text='text')} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents
), starts AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM tokens
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS often FROM starts
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE often > 1) GROUP BY 1
), base AS (
  SELECT doc_id, t, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    length(regexp_replace(t, '[^!]', '', 'g')) AS n_marks, length(regexp_replace(t, '[^0-9]', '', 'g')) AS n_digits,
    length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) AS n_capitals
  FROM tokens LEFT JOIN covered USING (doc_id)
), failed AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR 10 * n_dup_lines > 3 * n_lines
    OR 10 * n_marks > n_words OR 10 * n_capitals > 3 * greatest(word_chars, 1) OR 10 * n_digits > 3 * greatest(word_chars, 1)) AS kept
FROM failed
"""

SQL["op8_warc"] = """
WITH hashed AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), chosen AS (
  SELECT payload_digest, max(page_id) AS largest FROM hashed WHERE payload_bytes >= 1000 GROUP BY 1
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN largest IS NULL OR largest = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN largest <> page_id THEN largest END AS refers_to
FROM hashed LEFT JOIN chosen USING (payload_digest)
"""

SQL["op10_substring"] = f"""
WITH tokens AS (
  SELECT doc_id, {WORDS.format(text='text')} AS w FROM documents
), starts AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM tokens
), windows AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY md5(array_to_string(w[i:i + 12], ' '))) AS first_doc FROM starts
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM windows WHERE first_doc < doc_id
), kept AS (
  SELECT t.doc_id, t.p, t.word, g.p IS NOT NULL AS gone
  FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM tokens) t LEFT JOIN gone g ON g.doc_id = t.doc_id AND g.p = t.p
), joined AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS rest FROM kept GROUP BY 1
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM tokens LEFT JOIN joined USING (doc_id)
"""

"""DuckDB counterparts of the queries that SQL can express."""

from __future__ import annotations

QUALITY = r"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS body,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines,
         row_number() OVER () AS row_id
  FROM documents
), windows AS (
  SELECT row_id, unnest(range(1, len(words) - 1)) AS i, words FROM split WHERE len(words) >= 3
), keyed AS (
  SELECT row_id, i, count(*) OVER (PARTITION BY row_id, words[i], words[i + 1], words[i + 2]) AS times FROM windows
), covered AS (
  SELECT row_id, count(DISTINCT place) AS n_repeat_words
  FROM (SELECT row_id, unnest([i, i + 1, i + 2]) AS place FROM keyed WHERE times > 1) GROUP BY row_id
), measured AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(len(lines) AS BIGINT) AS n_text_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM split LEFT JOIN covered USING (row_id)
), judged AS (
  SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
    + 8 * (2 * n_dup_lines > n_text_lines)::INT + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 15 * n_words)::INT AS INT) AS failed
  FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed
FROM judged
"""

LINE_DEDUP = r"""
WITH lines AS (
  SELECT row_id, doc_id, unnest(all_lines) AS line, generate_subscripts(all_lines, 1) AS i
  FROM (SELECT row_number() OVER () AS row_id, doc_id, string_split(coalesce(text, ''), chr(10)) AS all_lines FROM documents)
), keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), common AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT row_id) >= 10
), marked AS (
  SELECT k.row_id, k.doc_id, k.line, k.i, c.key IS NULL AS stays FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays), '')) AS kept_sha256
FROM marked GROUP BY row_id
"""

# the tokens, the compressor, the patterns' code point spans and the page grammar have no SQL form; those
# queries are held against brute force in the tests
DECONTAMINATION = r"""
WITH normal AS (
  SELECT row_number() OVER () AS row_id, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), item_windows AS (
  SELECT DISTINCT item_id, size, array_to_string(words[i : i + size - 1], ' ') AS run
  FROM (SELECT item_id, words, least(10, len(words)) AS size, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM items WHERE len(words) > 0)
), sizes AS (
  SELECT DISTINCT size FROM item_windows
), document_windows AS (
  SELECT row_id, size, i, array_to_string(words[i : i + size - 1], ' ') AS run
  FROM (SELECT row_id, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM normal, sizes WHERE len(words) >= size)
), hits AS (
  SELECT d.row_id, d.i, d.size, w.item_id FROM document_windows d JOIN item_windows w USING (size, run)
), places AS (
  SELECT row_id, count(DISTINCT place) AS n_hit FROM (SELECT row_id, unnest(range(i, i + size)) AS place FROM hits) GROUP BY row_id
), owners AS (
  SELECT row_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS list FROM (SELECT DISTINCT row_id, item_id FROM hits) GROUP BY row_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM normal LEFT JOIN places USING (row_id) LEFT JOIN owners USING (row_id)
"""

WARC = r"""
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS payload, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages
), digests AS (
  SELECT page_id, payload_bytes, sha1(payload) AS payload_digest FROM payloads
), largest AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS first FROM digests
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM largest
"""

URL_FILTER = r"""
WITH parsed AS (
  SELECT page_id, coalesce(url, '') AS url,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*[^?#]*\?([^#]*)', 1) AS query
  FROM pages
), canonical AS (
  SELECT page_id, host, path, CASE WHEN contains(url, '://') THEN
      regexp_replace(regexp_replace(regexp_replace(regexp_replace(host, '^[^@]*@', ''), ':(80|443)?$', ''), '\.$', ''), '^www\.', '')
      || regexp_replace(regexp_replace(path, '/{2,}', '/', 'g'), '/(index\.(html?|php))?$', '')
      || CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(kept, '&') END END AS form
  FROM (SELECT *, list_sort(list_filter(string_split(query, '&'), lambda p: p <> ''
    AND NOT regexp_matches(p, '^(utm_[^=]*|ref|referrer|fbclid|gclid|msclkid|sessionid|sid)(=|$)'))) AS kept FROM parsed)
), listed AS (
  SELECT DISTINCT form FROM canonical
  WHERE list_has_any(regexp_split_to_array(host, '[.-]'), ['ads', 'adult', 'bet', 'bets', 'casino', 'pills', 'poker', 'porn', 'spam'])
), rules(rule_host, rule_path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, CASE WHEN form IN (SELECT form FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM (
  SELECT c.*, (SELECT max({'n': length(rule_host || rule_path), 'rule': rule_host || rule_path, 'verdict': verdict}) FROM rules
               WHERE (c.host = rule_host OR ends_with(c.host, '.' || rule_host)) AND starts_with(c.path, rule_path)) AS best
  FROM canonical c)
"""

# the polynomial of crc32, over the bits of each character
CONVERSATION_TRIE = r"""
WITH turns AS (
  SELECT conv_id, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS item,
         CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS words,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), families AS (
  SELECT conv_id, conv_id - conv_id % 20 AS source, xor(4294967295, list_reduce(
      list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384::BIGINT * (a & 1)) END)) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
), mixed AS (
  SELECT f.conv_id, 0 AS own, t.pos, t.item, t.words FROM families f JOIN turns t ON t.conv_id = f.source AND t.pos <= f.h
  UNION ALL
  SELECT f.conv_id, 1, t.pos, t.item, t.words FROM families f JOIN turns t ON t.conv_id = f.conv_id AND t.pos > f.h
), rebuilt AS (
  SELECT conv_id, item, words, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth FROM mixed
), prefixes AS (
  SELECT conv_id, depth, words, sha256(string_agg(md5(item), '') OVER (PARTITION BY conv_id ORDER BY depth)) AS name FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM families
), nodes AS (
  SELECT name, any_value(depth) AS depth, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs FROM prefixes GROUP BY name
), linked AS (
  SELECT n.*, p.name AS parent FROM nodes n LEFT JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1
), counted AS (
  SELECT l.*, coalesce(c.n, 0) AS n_children FROM linked l LEFT JOIN (SELECT parent, count(*) AS n FROM linked WHERE parent IS NOT NULL GROUP BY parent) c ON c.parent = l.name
), sums AS (
  SELECT p.name, count(*) FILTER (x.n_children = 0) AS n_leaves, sum((x.n_convs - 1) * x.words) AS saved_tokens
  FROM counted x JOIN prefixes p ON p.conv_id = x.conv_id AND p.depth <= x.depth GROUP BY p.name
), ends AS (
  SELECT name, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS list
  FROM (SELECT conv_id, arg_max(name, depth) AS name FROM prefixes GROUP BY conv_id) GROUP BY name
)
SELECT c.conv_id, CAST(c.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(list, '')) AS ends_sha256
FROM counted c JOIN sums USING (name) LEFT JOIN ends USING (name) LEFT JOIN nodes p ON p.name = c.parent
"""

ORACLES: dict[str, str] = {
    "op4_decontamination": DECONTAMINATION,
    "op5_warc": WARC,
    "op8_quality_rules": QUALITY,
    "op9_line_dedup": LINE_DEDUP,
    "op11_url_filter": URL_FILTER,
    "op12_conversation_trie": CONVERSATION_TRIE,
}

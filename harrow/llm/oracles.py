"""DuckDB SQL of the queries that SQL can express."""

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), '" + _UP + "', '" + _LOW + r"'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4 = r"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS s FROM w, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i) WHERE len(w) > 0),
  n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  pairs AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
  links AS MATERIALIZED (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
  edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
  reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
  class AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY 1), deg AS (SELECT a AS doc_id, count(*) AS k FROM edges GROUP BY 1)
  SELECT doc_id, class_id, coalesce(k, 0) AS n_links FROM class LEFT JOIN deg USING (doc_id)"""

OP5 = """WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
  s AS MATERIALIZED (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 100)) AS s FROM d, LATERAL (SELECT unnest(range(len(h) // 2 - 49)) AS i)),
  f AS (SELECT s, min(doc_id) AS m FROM s GROUP BY 1 HAVING count(*) > 1), g AS (SELECT doc_id, i FROM s JOIN f USING (s) WHERE m < doc_id),
  e AS (SELECT *, CASE WHEN i - lag(i) OVER o <= 50 THEN 0 ELSE 1 END AS new FROM g WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
  r AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS z FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM e) GROUP BY 1, 2),
  k AS (SELECT doc_id, run, a, z, substr(h, 2 * coalesce(lag(z) OVER o, 0) + 1, 2 * (a - coalesce(lag(z) OVER o, 0))) AS before FROM r JOIN d USING (doc_id) WINDOW o AS (PARTITION BY doc_id ORDER BY a)),
  t AS (SELECT doc_id, string_agg(before, '' ORDER BY a) AS kept, max(z) AS z, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM k GROUP BY 1)
  SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(z, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)"""

OP8 = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages), h AS (SELECT page_id, octet_length(b) AS payload_bytes, upper(sha1(b)) AS h, max(page_id) OVER (PARTITION BY b) AS m FROM p),
  v AS (SELECT *, [CAST('0x' || substr(h, 5 * i + 1, 5) AS BIGINT) FOR i IN range(8)] AS v FROM h)
  SELECT page_id, payload_bytes, array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((x >> (15 - 5 * j)) & 31 AS INT) + 1, 1) FOR j IN range(4)], '') FOR x IN v], '') AS payload_digest,
    CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to FROM v"""

OP10 = f"""WITH dw AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents), bw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
  win AS MATERIALIZED (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s FROM bw, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i) WHERE len(w) > 0),
  pos AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM dw, (SELECT DISTINCT n FROM win), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
  hit AS MATERIALIZED (SELECT doc_id, i, pos.n, item FROM pos JOIN win ON pos.n = win.n AND pos.s = win.s),
  cov AS (SELECT doc_id, count(DISTINCT p) AS k FROM hit, LATERAL (SELECT unnest(range(i, i + n)) AS p) GROUP BY 1),
  its AS (SELECT doc_id, count(DISTINCT item) AS m, array_to_string(list_sort(list(DISTINCT item)), ',') AS s FROM hit GROUP BY 1)
  SELECT doc_id, len(w) AS n_words, coalesce(k, 0) AS n_hit, coalesce(m, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(k, 0) > 0 AS contaminated FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)"""

OP12 = f"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
  s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 2], ' ')) AS s FROM w, LATERAL (SELECT unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i) WHERE len(w) > 0),
  n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  pairs AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
  links AS MATERIALIZED (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
  edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
  reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
  class AS (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY 1)
  SELECT doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, doc_id = c AS kept FROM class LEFT JOIN n USING (doc_id)"""

OP13 = r"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '""" + _UP + "', '" + _LOW + r"""'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
  g AS (SELECT DISTINCT lang, source FROM d), t AS MATERIALIZED (SELECT k, lang, source, unnest(w) AS item FROM d),
  kept AS MATERIALIZED (SELECT lang, item FROM t GROUP BY 1, 2 HAVING count(DISTINCT k) >= 30), v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
  c AS (SELECT lang, source, item, count(*) AS n FROM t SEMI JOIN kept USING (lang, item) GROUP BY 1, 2, 3),
  f AS MATERIALIZED (SELECT g.lang, g.source, kept.item, coalesce(n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, item)),
  p AS MATERIALIZED (SELECT *, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p,
    1 + (1000000000::HUGEINT * (sum(n) OVER (PARTITION BY lang, item) + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM f JOIN v USING (lang)),
  s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS x FROM p a JOIN p b ON a.lang = b.lang AND a.item = b.item AND a.source <> b.source GROUP BY 1, 2, 3),
  r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL SELECT lang, source, 'term', item, p - q FROM p WHERE n > 0 AND p > q)
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM r QUALIFY part = 'pair' OR rank <= 50"""

SQL = {"op4_jaccard_join": OP4, "op5_suffix_dedup": OP5, "op8_warc": OP8, "op10_decontamination": OP10, "op12_near_dedup": OP12, "op13_divergence": OP13}

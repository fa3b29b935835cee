"""SQL that says the same as the queries which SQL can express. The others rest on models or xxHash."""

A_TO_Z = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: Five hex digits of the SHA-1 at a time are four digits of base 32.
OP4 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('{DIGITS}', CAST(1 + ((CAST('0x' || substr(x, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""

OP8 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({A_TO_Z}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS item FROM s),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.item = b.item AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT doc_id, doc_id AS other FROM s UNION SELECT r.doc_id, links.y FROM r JOIN links ON links.x = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY 1)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""

#: What is rebuilt comes from the output alone: its parts lie between the marks, which the texts of these forms don't hold.
OP11 = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
h AS (SELECT *, len(u) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(d, i, 8) AS BIGINT)) AS h FROM t),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM p),
r AS (SELECT *, strpos(output, '<P>') AS at_p, strpos(output, '<S>') AS at_s, strpos(output, '<M>') AS at_m FROM o)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(output) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN substr(output, 4, at_s - 4) || substr(output, at_m + 3) || substr(output, at_s + 3, at_m - at_s - 3)
    ELSE substr(output, at_p + 3, at_m - at_p - 3) || substr(output, at_m + 3) || substr(output, 4, at_p - 4) END) AS restored_sha256
FROM r
"""

#: Site rules by host and path, the patterns written as regular expressions.
OP12 = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, contains(coalesce(url, ''), '://') AS there, strpos(coalesce(url, ''), '://') + 3 AS after FROM pages),
r AS (SELECT page_id, CASE WHEN there THEN substr(url, after) ELSE '' END AS rest FROM u),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM r),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path, substr(rest, length(raw) + 1) AS tail FROM h),
s AS (SELECT * FROM (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')) AS t(rule, site, start, action)),
f AS (SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(action, length(rule)) AS action FROM p JOIN s ON (host = site OR ends_with(host, '.' || site)) AND starts_with(path, start) GROUP BY page_id),
m AS (SELECT page_id, host, path, host || tail AS address FROM p)
SELECT m.page_id, host, path, rule, CASE WHEN action IS NOT NULL THEN action
  WHEN regexp_matches(address, '(?s)^([^/?#]*\.)?ads\..*/about([^A-Za-z0-9_.%-]|$)') THEN 'allow'
  WHEN regexp_matches(address, '^([^/?#]*\.)?(ads\.|ads-track\.|tracker\.|adult-|casino-|cheap-pills\.|free-bets\.|spam-farm\.)') OR contains(address, '/wp-login.') OR regexp_matches(address, '(?s)/ads/.*/banner([^A-Za-z0-9_.%-]|$)')
    OR contains(address, '?sessionid=') OR contains(address, '&sessionid=') OR ends_with(address, '.exe') OR regexp_matches(address, '^[0-9]+([.][0-9]+){3}(:[0-9]+)?[/?#]') THEN 'block'
  ELSE 'allow' END AS verdict
FROM m LEFT JOIN f USING (page_id)
"""

OP13 = """
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') AS pieces FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(pieces), '[^\\x20\\x09]+') AS w FROM d),
s AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
g AS (SELECT lang, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase, k FROM p, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
f AS (SELECT lang, phrase, k, count(*) AS a FROM g GROUP BY lang, phrase, k HAVING count(*) >= 100),
c AS (SELECT lang, phrase, k, a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
x AS (SELECT lang, phrase, k, a, w, unnest(range(1, k)) AS cut FROM c),
j AS (SELECT x.lang, x.phrase, x.k, x.a, cut, l.a AS l, r.a AS r, n, CAST((1000::HUGEINT * x.a * n) // (l.a::HUGEINT * r.a) AS BIGINT) AS score FROM x
  JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(w[1:cut], ' ') JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(w[cut + 1:x.k], ' ') JOIN s ON s.lang = x.lang),
b AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.k > b.k AND c.a >= b.a AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' '))),
t AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM o)
SELECT * FROM t WHERE rank <= 2000
"""

ORACLES = {"op4_warc": OP4, "op8_minhash": OP8, "op11_fill_in_middle": OP11, "op12_url_filter": OP12, "op13_collocations": OP13}

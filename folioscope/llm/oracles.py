"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP2 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS k FROM again) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    coalesce(dup.n_lines, 0) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_ascii_letters,
    len(list_filter(ws, lambda x: regexp_matches(x, '[#*$%&|<>!]$'))) AS n_marked_words
  FROM d JOIN w USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id)
),
b AS (
  SELECT *,
    ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (100 * n_symbols > 20 * n_words)::BIGINT
      + 8 * (n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines)::BIGINT + 16 * (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words))::BIGINT
      + 32 * (n_ascii_letters >= 50 AND 100 * n_upper > 60 * n_ascii_letters)::BIGINT + 64 * (100 * n_marked_words > 50 * n_words)::BIGINT)::BIGINT AS fail_bits
  FROM m
)"""
ABLATIONS = OP2 + """,
p(policy, version, mask) AS (VALUES ('base', 1, 3), ('production', 1, 127), ('production', 2, 63), ('no_markup', 1, 71), ('no_markup', 2, 7)),
r(rule, bit) AS (VALUES ('few_words', 1), ('repeated_words', 2), ('symbol_heavy', 4), ('repeated_lines', 8), ('odd_word_length', 16), ('shouting', 32), ('marked_words', 64)),
x AS (SELECT policy, version, mask, fail_bits & mask AS bits FROM b, p)
SELECT policy, version, rule, count(*) AS n, count(*) FILTER (bits = 0) AS kept, bit_or(bits) AS any_bits, bit_and(bits) AS all_bits,
  count(*) FILTER (bits & bit <> 0) AS n_failed, count(*) FILTER (bits = bit) AS n_only, count(*) FILTER (bits = 0 OR bits = bit) AS kept_without
FROM x JOIN r ON mask & bit <> 0 GROUP BY ALL
"""
OP2 += """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 63) = 0 AS kept, fail_bits FROM b
"""

OP10 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
),
t AS (
  SELECT *, row_number() OVER w AS pos,
    sum(23 + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) OVER w AS so_far
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)
),
e AS (
  SELECT conv_id, so_far FROM t WHERE role = 'assistant'
  UNION ALL
  SELECT conv_id, so_far FROM t QUALIFY pos = max(pos) OVER (PARTITION BY conv_id) AND role <> 'assistant'
),
f AS (SELECT conv_id, sum(so_far)::BIGINT AS formatted_chars FROM e GROUP BY conv_id),
g AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '') AS loss
  FROM t GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g JOIN f USING (conv_id)
"""

OP9 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS k, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS g
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)
),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, ks WHERE len(ws) >= k)
),
hits AS (SELECT doc_id, item_id, i, k FROM dw JOIN bw USING (k, g)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP6 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + least(4, len(ws)) - 1], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - least(4, len(ws)) + 2)) AS i FROM d WHERE len(ws) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * o >= 85 * (p.n + q.n - o)),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) m USING (doc_id)
"""

_OP11_ROUND = """
a{k} AS (
  SELECT p.vec_id, any_value(p.label) AS label, p.part, any_value(p.v) AS v, arg_min(c.entry, d * 64 + c.entry) AS entry, min(d) AS d
  FROM (SELECT p.*, c.entry, list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN c{k} c USING (part)) p
  JOIN c{k} c USING (part, entry) GROUP BY p.vec_id, p.part
)"""

_OP11_UPDATE = """,
s{k} AS (SELECT part, entry, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM (SELECT part, entry, v, unnest(range(1, len(v) + 1)) AS i FROM a{k}) GROUP BY ALL),
c{next} AS (
  SELECT part, entry, coalesce(m.v, c.v) AS v FROM c{k} c
  LEFT JOIN (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{k} GROUP BY ALL) m USING (part, entry)
),"""

OP11 = (
    """
WITH kept AS (
  SELECT vec_id, label, embedding, len(embedding) // 16 AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
p AS (SELECT vec_id, label, part, list_transform(embedding[part * w + 1:part * w + w], lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM kept, range(16) r(part)),
c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM p QUALIFY entry < 64),"""
    + "".join(_OP11_ROUND.format(k=k) + _OP11_UPDATE.format(k=k, next=k + 1) for k in range(2))
    + _OP11_ROUND.format(k=2)
    + """,
f AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM f, h
"""
)

#: crc32 of the id's decimal digits: each byte is folded in, then shifted out by eight steps (-1).
_CRC = """xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ord(x), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"""

OP12 = f"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
),
o AS (SELECT c, list({{'role': role, 'text': text}} ORDER BY k) AS xs FROM t GROUP BY c),
g AS (SELECT c, xs, ({_CRC} % 6)::BIGINT AS h FROM o),
b AS (SELECT g.c, list_concat(coalesce(p.xs, g.xs[1:0])[1:g.h], g.xs[g.h + 1:]) AS xs FROM g LEFT JOIN o p ON p.c = g.c - g.c % 100),
m AS (SELECT c, xs, d, xs[1:d] AS path FROM (SELECT c, xs, unnest(range(0, len(xs) + 1)) AS d FROM b)),
n AS (
  SELECT path, d AS depth, min(c) AS conv_id, count(*) AS n_convs, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(xs) = d) AS ends,
    coalesce(length(any_value(path)[-1].text), 0) AS chars
  FROM m GROUP BY path, d
),
kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (path)),
sub AS (
  SELECT path[1:e] AS path, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum((n_convs - 1) * chars)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS e FROM f) GROUP BY 1
)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM f JOIN sub USING (path) LEFT JOIN n p ON f.depth > 0 AND p.path = f.path[1:f.depth - 1]
"""

#: These pages mark their articles; what SQL can't do, telling containers apart, is tested against plain versions.
OP13 = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article[^>]*>(.*?)(</article>|$)', 1, 's') AS body FROM pages),
b AS (SELECT page_id, url, regexp_split_to_array(regexp_replace(regexp_replace(body, '</?b>', '', 'g'), '<br[^>]*>', ' ', 'g'), '<[^>]*>') AS xs FROM a),
c AS (
  SELECT page_id, url, list_transform(xs, lambda x: trim(regexp_replace(regexp_replace(replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS xs FROM b
)
SELECT page_id, url, array_to_string(list_filter(xs, lambda x: x <> ''), chr(10) || chr(10)) AS text,
  length(array_to_string(list_filter(xs, lambda x: x <> ''), chr(10) || chr(10)))::BIGINT AS n_chars FROM c
"""

SQL = {"op13_main_text": OP13, "op12_prefix_trie": OP12, "op11_vector_codes": OP11, "op6_jaccard_join": OP6, "op9_decontamination": OP9, "op2_quality_rules": OP2, "quality_ablations": ABLATIONS, "op10_chat_format": OP10}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

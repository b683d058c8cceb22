"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

from tableprep.llm.licenses import PHRASES, TEMPLATES, THRESHOLD, template_sets, words_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

# CRC-32 of ASCII digits: eight shift steps a byte (the polynomial is the standard's)
CRC_STEP = "CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END"
CRC = f"""xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(c AS VARCHAR), ''), lambda d: ascii(d)::BIGINT),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: {CRC_STEP})), 4294967295)"""


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


PHRASE_ROWS = ", ".join(f"({_list(words_of(p))}, '{label}')" for p, label in PHRASES)
TEMPLATE_ROWS = ", ".join(f"({t['template']}, '{t['label']}', {_list(t['words'])}, {t['n']}, {t['needed']}, {t['span']})"
                          for t in template_sets(TEMPLATES, THRESHOLD))

ORACLE: dict[str, str] = {
    # a line's key goes in all documents but the smallest that holds it; 10 code points at least
    "op2_line_dedup": f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, {SPACES}), '{UPPER}', '{LOWER}') AS key FROM l),
held AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.*, coalesce(h.first <> k.doc_id, false) AS gone FROM k LEFT JOIN held h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
    # exact shingle sets, all linked pairs, and what can be reached over links
    "op3_hyperminhash": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
         '[ \\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
        ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS sh
      FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles FROM s),
x AS (SELECT doc_id, unnest(sh) AS g FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id
          GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
          WHERE 100 * common >= 85 * (na.n_shingles + nb.n_shingles - common)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT n.doc_id, n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
""",
    # conversations as lists of (role, text); a conversation is kept when no longer one begins with it
    "op10_snapshot_chats": """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
p AS (
  SELECT conv_id, row_number() OVER w AS position,
         string_agg(coalesce(role, chr(1)) || chr(2) || coalesce(text, chr(1)) || chr(3), '') OVER w AS prefix,
         string_agg('<|' || coalesce(role, 'user') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '')
           OVER w AS rendered
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn ASC NULLS LAST, role ASC NULLS FIRST, text ASC NULLS FIRST
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
e AS (SELECT conv_id, max(position) AS n_turns, arg_max(prefix, position) AS whole,
             arg_max(rendered, position) AS rendered FROM p GROUP BY conv_id),
inner_prefix AS (SELECT DISTINCT prefix FROM p JOIN e USING (conv_id) WHERE position < n_turns),
classes AS (SELECT whole, min(conv_id) AS conv_id, count(*) AS copies FROM e GROUP BY whole)
SELECT c.conv_id, CAST(0 AS BIGINT) AS part, CAST(1 AS BIGINT) AS n_parts, e.n_turns, c.copies, e.rendered
FROM classes c JOIN e USING (conv_id) WHERE c.whole NOT IN (SELECT prefix FROM inner_prefix)
""",
    # every kept term of a language in every group, differences of the exact shares
    "op11_source_divergence": f"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
                  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                     '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
x AS MATERIALIZED (SELECT lang, source, r, unnest(terms) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term FROM x GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM x JOIN kept USING (lang, term) GROUP BY ALL),
full_c AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n
           FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS MATERIALIZED (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v)
        AS p FROM full_c JOIN v USING (lang)),
l AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM full_c GROUP BY ALL),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM l JOIN v USING (lang)),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(t.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y
             ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) t
    ON t.lang = a.lang AND t.source = a.source AND t.other = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (
             PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
""",
    # consecutive words of the phrases, and all blocks with enough distinct words of a template
    "op12_license_scan": f"""
WITH w AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
         '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words FROM documents),
x AS MATERIALIZED (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM w),
phrases(phrase, label) AS (VALUES {PHRASE_ROWS}),
places AS (SELECT r, pos, label FROM x JOIN phrases ON word = phrase[1] JOIN w USING (r)
           WHERE words[pos + 1:pos + len(phrase)] = phrase),
base AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word,
                string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY r),
templates(template, label, own, n, needed, span) AS (VALUES {TEMPLATE_ROWS}),
tokens AS (SELECT template, label, n, needed, span, unnest(own) AS word FROM templates),
hits AS (SELECT r, label, n, count(DISTINCT word) AS common, pos // span - k AS block
         FROM x JOIN tokens USING (word) JOIN (VALUES (0), (1)) o(k) ON pos // span >= k
         GROUP BY r, template, label, n, needed, pos // span - k HAVING count(DISTINCT word) >= needed),
best AS (SELECT r, max(common / n) AS best FROM hits GROUP BY r),
named AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
          FROM (SELECT r, label FROM places UNION SELECT r, label FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN best USING (r) LEFT JOIN named USING (r)
""",
    # prefixes as strings; a node's subtree are the nodes whose first member passes it
    "op13_prefix_trie": f"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS position
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, c - c % 5 AS base, {CRC} % 9 AS h FROM (SELECT DISTINCT c FROM t)),
turns AS (
  SELECT convs.c, 1 AS part, position, role, text FROM convs JOIN t ON t.c = base WHERE base <> convs.c AND position <= h
  UNION ALL
  SELECT convs.c, 2, position, role, text FROM convs JOIN t USING (c) WHERE base = c OR position > h),
members AS MATERIALIZED (
  SELECT c, 0 AS depth, '' AS prefix, 0 AS n_bytes FROM convs
  UNION ALL
  SELECT c, row_number() OVER w, string_agg(role || chr(2) || text || chr(3), '') OVER w, octet_length(encode(text))
  FROM turns WINDOW w AS (PARTITION BY c ORDER BY part, position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
last AS (SELECT c, max(depth) AS depth FROM members GROUP BY c),
nodes AS MATERIALIZED (
  SELECT members.depth AS depth, prefix, min(c) AS conv, count(*) AS n_convs, any_value(n_bytes) AS n_bytes,
         coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE last.depth = members.depth), '') AS ends
  FROM members JOIN last USING (c) GROUP BY members.depth, prefix),
up AS MATERIALIZED (
  SELECT n.conv, n.depth, a.conv AS a_conv, a.depth AS a_depth
  FROM nodes n JOIN members m ON m.c = n.conv AND m.depth <= n.depth JOIN nodes a ON a.depth = m.depth AND a.prefix = m.prefix),
parents AS (SELECT conv, depth, a_conv AS parent FROM up WHERE a_depth = depth - 1),
children AS (SELECT parent AS conv, depth - 1 AS depth, count(*) AS n_children FROM parents GROUP BY ALL),
own AS (SELECT nodes.*, parent, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN parents USING (conv, depth)
        LEFT JOIN children USING (conv, depth)),
sums AS (SELECT a_conv AS conv, a_depth AS depth, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * n_bytes) AS saved
         FROM up JOIN own USING (conv, depth) GROUP BY ALL)
SELECT conv AS conv_id, CAST(depth AS BIGINT) AS depth, parent AS parent_conv_id, n_convs, n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256
FROM own JOIN sums USING (conv, depth)
""",
}

"""The results of operators 11 to 13 in DuckDB SQL, by no method but their definition."""

from __future__ import annotations

import string


def _crc(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text."""
    step = (
        "list_reduce(list_prepend(xor(c, b), range(8)), "
        "lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    )
    letters = f"[ascii(z)::BIGINT FOR z IN string_split({text}, '')]"
    return f"xor(list_reduce(list_prepend(4294967295, {letters}), lambda c, b: {step}), 4294967295)"


def _lower(text: str) -> str:
    return f"translate({text}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def _leaf(text: str) -> str:
    fields = ("doc_id", "source", "lang", "n_chars", text)
    told = (f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in fields)
    return f"sha256({' || '.join(told)})"


OP11 = f"""WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {_leaf('text')} AS leaf, {_leaf('changed')} AS other
  FROM (SELECT *, CASE WHEN {_crc('doc_id::VARCHAR')} % 3 = 0 THEN {_lower('text')} ELSE text END AS changed FROM documents)),
placed AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves
  WINDOW w AS (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, other)),
inner_nodes AS (
  SELECT lang, 0 AS level, pos, leaf AS digest, n FROM placed
  UNION ALL
  SELECT lang, level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (n + 7) // 8 FROM inner_nodes WHERE n > 1 GROUP BY lang, level, pos // 8, n),
subs AS (SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM inner_nodes WHERE n = 1),
upper_nodes AS (
  SELECT 0 AS level, pos, digest, n FROM subs
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (n + 7) // 8 FROM upper_nodes WHERE n > 1 GROUP BY level, pos // 8, n),
inner_runs AS (SELECT lang, level, pos // 8 AS run, list(digest ORDER BY pos) AS run_digests FROM inner_nodes WHERE n > 1 GROUP BY ALL),
upper_runs AS (SELECT level, pos // 8 AS run, list(digest ORDER BY pos) AS run_digests FROM upper_nodes WHERE n > 1 GROUP BY ALL),
walk AS (
  SELECT doc_id, lang, leaf, other, 0 AS level, pos, pos AS start, '' AS proof, other AS folded FROM placed
  UNION ALL
  SELECT doc_id, w.lang, leaf, other, w.level + 1, pos // 8, start,
    proof || array_to_string(list_concat(run_digests[1:pos % 8], run_digests[pos % 8 + 2:]), ''),
    sha256(array_to_string(run_digests[1:pos % 8], '') || folded || array_to_string(run_digests[pos % 8 + 2:], ''))
  FROM walk w JOIN inner_runs r ON w.lang IS NOT DISTINCT FROM r.lang AND w.level = r.level AND w.pos // 8 = r.run),
below AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY lang, start ORDER BY level DESC) = 1),
climb AS (
  SELECT doc_id, b.lang, leaf, start, s.digest AS subroot, 0 AS level, s.pos, proof, folded FROM below b JOIN subs s ON b.lang IS NOT DISTINCT FROM s.lang
  UNION ALL
  SELECT doc_id, lang, leaf, start, subroot, c.level + 1, pos // 8,
    proof || array_to_string(list_concat(run_digests[1:pos % 8], run_digests[pos % 8 + 2:]), ''),
    sha256(array_to_string(run_digests[1:pos % 8], '') || folded || array_to_string(run_digests[pos % 8 + 2:], ''))
  FROM climb c JOIN upper_runs r ON c.level = r.level AND c.pos // 8 = r.run),
done AS (SELECT * FROM climb QUALIFY row_number() OVER (PARTITION BY lang, start ORDER BY level DESC) = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM done, (SELECT digest AS root FROM upper_nodes WHERE n = 1)"""

OP12 = f"""WITH RECURSIVE turns AS (
  SELECT conv_id, list(struct_pack(turn := turn, role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
own AS (SELECT conv_id, [struct_pack(r := x.role, t := x.text) FOR x IN t] AS t, {_crc('conv_id::VARCHAR')} % 9 AS h FROM turns),
built AS (SELECT o.conv_id, list_concat(coalesce(s.t[1:o.h], []), o.t[o.h + 1:]) AS t
  FROM own o LEFT JOIN own s ON s.conv_id = o.conv_id - o.conv_id % 5),
prefixes AS (SELECT conv_id, d AS depth, t[1:d] AS p, len(t) = d AS ends, octet_length(encode(t[d].t)) AS size
  FROM (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM built)),
nodes AS (SELECT p, depth, min(conv_id) AS conv_id, count(*) AS n, any_value(size) AS size,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ends
  FROM prefixes GROUP BY p, depth),
kids AS (SELECT p[1:depth - 1] AS p, depth - 1 AS depth, count(*) AS k FROM nodes WHERE depth > 0 GROUP BY ALL),
told AS (SELECT n.*, coalesce(k, 0) AS n_children FROM nodes n LEFT JOIN kids USING (p, depth)),
sums AS (SELECT p[1:d] AS p, d AS depth, sum((n_children = 0)::BIGINT) AS leaves,
    sum(CASE WHEN depth > 0 THEN (n - 1) * size ELSE 0 END) AS saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM told) GROUP BY ALL)
SELECT t.conv_id, t.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, t.n::BIGINT AS n_convs, t.n_children::BIGINT AS n_children,
  s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(t.ends) AS ends_sha256
FROM told t JOIN sums s ON s.p = t.p AND s.depth = t.depth LEFT JOIN told u ON u.p = t.p[1:t.depth - 1] AND u.depth = t.depth - 1"""

OP13 = f"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s FROM words),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS token FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b ON a.token = b.token AND a.doc_id <> b.doc_id
  AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) ON a = doc_id"""

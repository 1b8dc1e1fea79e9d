"""DuckDB SQL of the operators' queries that SQL can express over whole tables; op6's is in decontaminate.py."""

from __future__ import annotations

from .tokencount import END, VOCABULARY, byte_letters

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The pages of the tables have one article each, of headings, paragraphs, line breaks and bold text, with these references.
OP3_SQL = r"""
WITH inner_html AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?b>', '', 'g') AS h FROM pages),
plain AS (SELECT page_id, url, regexp_replace(replace(regexp_replace(h, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&amp;?', '&', 'g') AS t FROM inner_html)
SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text, length(trim(regexp_replace(t, '\s+', ' ', 'g'))) AS n_chars FROM plain
"""


def linked_sql(size: int, similar: int) -> str:
    """Shingles, all pairs that share one, and what each document reaches over the links."""
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(CASE WHEN len(w) < {size} THEN w ELSE w[i:i + {size - 1}] END, ' ')) AS g
  FROM d, unnest(range(1, greatest(len(w) - {size - 1}, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= {similar} * (x.n + y.n - k)),
ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT ways.v, reach.c FROM reach JOIN ways ON ways.u = reach.doc_id),
least AS (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d JOIN least USING (doc_id) LEFT JOIN n USING (doc_id)
"""


OP7_SQL = linked_sql(3, 85)
OP12_SQL = f"SELECT doc_id, n_shingles, component_id FROM ({linked_sql(5, 80)})"


def doubled(steps: tuple[int, ...]) -> str:
    """Expressions that carry each byte's hash of the 1, 2, 4, ... bytes from it on, one level of query for each."""
    query = "SELECT doc_id, p, x, hash(x) AS h1 FROM b"
    for size in steps:
        kept = ", ".join(f"h{k}" for k in (1, *steps) if k <= size and k in (16, 128, 256) or k == size)
        query = f"SELECT doc_id, p, x, {kept}, hash(h{size}, lead(h{size}, {size}) OVER (PARTITION BY doc_id ORDER BY p)) AS h{2 * size} FROM ({query})"
    return query


#: A hash of every 400 bytes by doubling (256 + 128 + 16), counted; and of every 51 words, by document.
OP4_SQL = rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS x FROM documents),
b AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS p, unnest(x) AS x FROM t),
h AS ({doubled((1, 2, 4, 8, 16, 32, 64, 128))}),
g AS (
  SELECT doc_id, p, x, p <= max(p) OVER (PARTITION BY doc_id) - 399 AS whole,
         hash(h256, lead(h128, 256) OVER w, lead(h16, 384) OVER w) AS g FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
again AS (SELECT g FROM g WHERE whole GROUP BY g HAVING count(*) > 1),
c AS (
  SELECT doc_id, p, x, coalesce(max(whole AND g IN (FROM again)) OVER (PARTITION BY doc_id ORDER BY p ROWS 399 PRECEDING), false) AS gone,
         x NOT IN ('20', '09', '0A', '0B', '0C', '0D') AS ink FROM g),
marked AS (SELECT *, ink AND NOT lag(ink, 1, false) OVER w AS word_starts, gone AND NOT lag(gone, 1, false) OVER w AS run_starts FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
numbered AS (SELECT *, sum(word_starts::INT) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS n FROM marked),
kept AS (
  SELECT doc_id, sum(gone::INT)::BIGINT AS n_removed, sum(run_starts::INT)::BIGINT AS n_spans,
         sha256(unhex(coalesce(string_agg(x, '' ORDER BY p) FILTER (WHERE NOT gone), ''))) AS kept_sha256 FROM marked GROUP BY doc_id),
words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
runs AS (SELECT doc_id, i, hash(array_to_string(w[i:i + 50], ' ')) AS k FROM words, unnest(range(1, len(w) - 49)) AS t(i)),
shared AS (SELECT k FROM runs GROUP BY k HAVING count(DISTINCT doc_id) > 1),
said AS (SELECT DISTINCT doc_id, i + j AS n FROM runs JOIN shared USING (k), unnest(range(0, 51)) AS t(j)),
told AS (
  SELECT doc_id, count(*) AS n_shared FROM numbered JOIN said USING (doc_id, n) LEFT JOIN said AS after ON after.doc_id = numbered.doc_id AND after.n = numbered.n + 1
  WHERE ink OR after.n IS NOT NULL GROUP BY doc_id)
SELECT d.doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       coalesce(kept_sha256, sha256('')) AS kept_sha256, coalesce(n_shared, 0) AS n_shared
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN told USING (doc_id)
"""

_LETTERS = ", ".join(f"'{b:02X}': '{c if c != chr(39) else chr(39) * 2}'" for c, b in byte_letters().items())

#: Each distinct word loses its longest entry again and again; the vocabulary is read where the query reads it.
OP2_SQL = rf"""
WITH RECURSIVE v AS (SELECT DISTINCT unnest(json_keys(content::JSON, '$.model.vocab')) AS e FROM read_text('{VOCABULARY}')),
sizes AS (SELECT DISTINCT len(e) AS k FROM v WHERE e <> '{END}'),
w AS (SELECT doc_id, unnest(regexp_extract_all({LOWER}, '[a-z\x80-\x{{10FFFF}}]+|[0-9]|[^a-z0-9\x00-\x20\x7F\x80-\x{{10FFFF}}]+')) AS w FROM documents),
spelt AS (
  SELECT w, array_to_string(list_transform(regexp_extract_all(hex(encode(w)), '..'), lambda x: letters[x]), '') || '{END}' AS s
  FROM (SELECT DISTINCT w FROM w), (SELECT MAP {{{_LETTERS}}} AS letters)),
cut AS (
  SELECT w, s, 0 AS n FROM spelt
  UNION ALL
  SELECT w, s[max(k) + 1:], any_value(n) + 1 FROM cut, sizes, v WHERE s <> '' AND k <= len(s) AND s[:k] = e AND s[k + 1:] <> '{END}' GROUP BY w, s),
n AS (SELECT w, max(n) AS n FROM cut GROUP BY w)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_tokens, 0) AS n_tokens
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n_words, sum(n)::BIGINT AS n_tokens FROM w JOIN n USING (w) GROUP BY doc_id) USING (doc_id)
"""

#: Every phrase counted, cuts by joins, hidden phrases by the phrases one word longer; numbers of up to 128 bits.
OP13_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWER}, '[.,;:!?\x0A-\x0D]')) AS t FROM documents),
w AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM p),
said AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS s FROM w, unnest([1, 2, 3, 4, 5]) AS x(m), unnest(range(1, len(w) - m + 2)) AS y(i)),
f AS (SELECT lang, m, s, count(*) AS f FROM said GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, count(*) AS n FROM said WHERE m = 1 GROUP BY lang),
c AS (SELECT *, string_split(s, ' ') AS w FROM f WHERE m > 1),
hidden AS (SELECT DISTINCT lang, f, unnest([array_to_string(w[:m - 1], ' '), array_to_string(w[2:], ' ')]) AS s FROM c WHERE m > 2),
cuts AS (SELECT lang, s, f AS a, k, array_to_string(w[:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM c ANTI JOIN hidden USING (lang, f, s), unnest(range(1, m)) AS t(k)),
scored AS (
  SELECT cuts.lang, cuts.s AS phrase, a, l.f AS l, r.f AS r, n, k, (1000::HUGEINT * a * n // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.s = x JOIN f r ON r.lang = cuts.lang AND r.s = y JOIN n ON n.lang = cuts.lang),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM least QUALIFY rank <= 2000
"""

"""Oracle SQL of the operators that SQL can express."""

_WORD = r"[^\x20\x09-\x0D]+"

OP1 = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{_WORD}') AS words, string_split(text, chr(10)) AS lines FROM d),
c AS (SELECT doc_id, host, text, words, len(words) AS n_words, array_to_string(words, '') AS joined, list_filter(lines, lambda x: regexp_matches(x, '{_WORD}')) AS kept_lines FROM w),
tri AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT doc_id, words, unnest(range(1, n_words - 1)) AS i FROM c)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
l AS (SELECT doc_id, host, text, lower(trim(regexp_replace(x, '[\x09\x0B-\x0D]', ' ', 'g'))) AS line, len(regexp_extract_all(x, '{_WORD}')) AS n FROM (SELECT doc_id, host, text, unnest(kept_lines) AS x FROM c)),
hosts AS (SELECT host, count(DISTINCT text) AS n FROM d GROUP BY host),
hot AS (SELECT l.host, line FROM l JOIN hosts USING (host) GROUP BY l.host, line, hosts.n HAVING count(DISTINCT text) > greatest(20, hosts.n * CAST(0.1 AS DOUBLE))),
gone AS (SELECT doc_id, sum(n) AS words, count(*) AS lines FROM l JOIN hot USING (host, line) GROUP BY doc_id)
SELECT doc_id, n_words, length(joined) AS word_chars, length(regexp_replace(joined, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(kept_lines) - len(list_distinct(kept_lines)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
  n_words < 50 OR 100 * coalesce(cov.n, 0) > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * coalesce(cov.n, 0) > 50 * n_words) AND NOT (100 * (n_words - coalesce(gone.words, 0)) < 30 * n_words) AS kept,
  CAST(coalesce(gone.words, 0) AS BIGINT) AS removed_words, coalesce(gone.lines, 0) AS removed_lines, 100 * (n_words - coalesce(gone.words, 0)) < 30 * n_words AS depleted
FROM c LEFT JOIN cov USING (doc_id) LEFT JOIN gone USING (doc_id)
"""

OP3 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) >= 3 THEN list_sort(list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])))
  WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS sh, len(words) AS nw FROM w),
class AS (SELECT sh, min(doc_id) AS rep, count(*) AS n_same, len(sh) AS n FROM s WHERE nw > 0 GROUP BY sh),
e AS (SELECT rep, n, unnest(sh) AS g FROM class),
link AS (SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.g = b.g AND a.rep <> b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT rep AS a, rep AS b FROM class UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
comp AS (SELECT a AS rep, min(b) AS component FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id, doc_id = coalesce(component, doc_id) AS kept, coalesce(n_same, 1) AS n_same
FROM s LEFT JOIN class ON s.sh = class.sh AND s.nw > 0 LEFT JOIN comp USING (rep)
"""

OP7 = r"""
WITH p AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?])([ \t]+)', '\1' || chr(1) || '\2' || chr(1), 'g'), '(\n+)', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS parts FROM documents),
u AS (SELECT doc_id, i, parts[i] AS unit, coalesce(list_sum(list_transform(parts[1:i - 1], lambda x: length(x))), 0) AS "begin" FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1, 2)) AS i FROM p)),
n AS (SELECT doc_id, i, "begin", "begin" + length(unit) AS "end", list_filter(regexp_split_to_array(lower(unit), '\s+'), lambda x: x <> '') AS words FROM u),
k AS (SELECT doc_id, "begin", "end", len(words) AS n_words, array_to_string(words, ' ') AS normal, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM n WHERE len(words) >= 3),
f AS (SELECT *, min({'doc': doc_id, 'pos': pos}) OVER (PARTITION BY normal) AS first FROM k),
r AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM f WHERE (doc_id, pos) <> (first.doc, first.pos))
SELECT doc_id, CAST(min("begin") AS INTEGER) AS "begin", CAST(max("end") AS INTEGER) AS "end", count(*) AS n_units, CAST(sum(n_words) AS BIGINT) AS n_words, arg_min(first.doc, pos) AS first_doc_id
FROM r GROUP BY doc_id, run HAVING sum(n_words) >= 20
"""

# crc32 by its definition: a table of the bytes' remainders, folded over the UTF-8 bytes of a string of ASCII and U+00C0 to U+00FF.
OP12 = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b::BIGINT, list_transform(range(8), lambda i: 0::BIGINT)), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
d AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM r WHERE length(run) >= 7 GROUP BY ALL),
b AS (SELECT run, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, (unicode(x) - 64)::BIGINT] END)) AS bytes FROM d),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(t[1 + (xor(c, x) & 255)], c >> 8)), 4294967295::BIGINT) AS h FROM b, tab),
s AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM s WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
g AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (SELECT a.word AS word, b.word AS near, b.n AS near_n FROM g a JOIN g b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT g.word, w.word, w.n FROM g JOIN w ON g.rest = w.word UNION SELECT w.word, g.word, g.n FROM g JOIN w ON g.rest = w.word),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS near_n, arg_min(near, {'n': -near_n, 'w': near}) AS near FROM near GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form, CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n FROM w LEFT JOIN best USING (word)),
walk AS (SELECT word, form AS last, 1 AS step FROM f WHERE form IS NOT NULL UNION ALL SELECT walk.word, f.form, step + 1 FROM walk JOIN f ON f.word = walk.last WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(last, step) AS root FROM walk GROUP BY word)
SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN ends USING (word)
"""

OP13 = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
n AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY lang),
k AS (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(words) >= k),
f AS (SELECT lang, array_to_string(words[i:i + k - 1], ' ') AS phrase, k, count(*)::HUGEINT AS f FROM k GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS words FROM f WHERE k > 1),
cuts AS (SELECT c.lang, c.phrase, c.a, j, x.f AS l, y.f AS r, 2000000 * c.a // (x.f + y.f) AS score FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.words[1:j], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.words[j + 1:], ' ')),
best AS (SELECT lang, phrase, a, arg_min({'l': l, 'r': r, 'score': score}, {'score': score, 'j': j}) AS b FROM cuts GROUP BY ALL),
inner_ AS (SELECT lang, a, m, words, unnest(range(1, k - m + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS m) WHERE m < k),
longer AS (SELECT lang, array_to_string(words[i:i + m - 1], ' ') AS phrase, max(a) AS more FROM inner_ GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN longer USING (lang, phrase) WHERE NOT coalesce(100 * more >= 80 * a, false)),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY b.score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(b.l AS BIGINT) AS l, CAST(b.r AS BIGINT) AS r, n, CAST(b.score AS BIGINT) AS score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""

"""SQL (for DuckDB, on the whole tables) of the training-data operators that it can express."""

SOURCE_DIVERGENCE = r"""
WITH d AS (
    SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'
        ) AS terms, row_number() OVER () AS row
    FROM documents
), t AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
kept AS (
    SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT row) >= 30
), size AS (
    SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY lang
), g AS (SELECT DISTINCT lang, source FROM d),
c AS (
    SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL
), total AS (
    SELECT lang, source, coalesce(sum(c.n), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL
), p AS (
    SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
        1 + 1000000000 * (coalesce(c.n, 0)::HUGEINT + 5) // (total.n + 5 * size.v) AS p,
        1 + 1000000000 * (kept.n::HUGEINT + 5) // (size.n + 5 * size.v) AS q
    FROM g JOIN kept USING (lang) JOIN size USING (lang) JOIN total USING (lang, source)
    LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
), pair AS (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), part AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0)::BIGINT AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value,
    row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM part QUALIFY part = 'pair' OR rank <= 50
"""

PHRASES = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
f1 AS (SELECT lang, w, count(*) AS f FROM (SELECT lang, unnest(ws) AS w FROM w) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
f2 AS (
    SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, count(*) AS f
    FROM (SELECT lang, ws, unnest(range(1, len(ws))) AS i FROM w) GROUP BY ALL
), f3 AS (
    SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, ws[i + 2] AS w3, count(*) AS f
    FROM (SELECT lang, ws, unnest(range(1, len(ws) - 1)) AS i FROM w) GROUP BY ALL HAVING count(*) >= 10
), longer AS (
    SELECT lang, w1, w2, max(f) AS f FROM (
        SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3
    ) GROUP BY ALL
), cuts AS (
    SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.f AS a, 1 AS k, a.f AS l, b.f AS r
    FROM f2 JOIN f1 a ON a.lang = f2.lang AND a.w = f2.w1 JOIN f1 b ON b.lang = f2.lang AND b.w = f2.w2
    LEFT JOIN longer ON longer.lang = f2.lang AND longer.w1 = f2.w1 AND longer.w2 = f2.w2
    WHERE f2.f >= 10 AND 100 * coalesce(longer.f, 0) < 50 * f2.f
    UNION ALL
    SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.f, 1, a.f, b.f
    FROM f3 JOIN f1 a ON a.lang = f3.lang AND a.w = f3.w1
    JOIN f2 b ON b.lang = f3.lang AND b.w1 = f3.w2 AND b.w2 = f3.w3
    UNION ALL
    SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.f, 2, a.f, b.f
    FROM f3 JOIN f2 a ON a.lang = f3.lang AND a.w1 = f3.w1 AND a.w2 = f3.w2
    JOIN f1 b ON b.lang = f3.lang AND b.w = f3.w3
), best AS (
    SELECT lang, phrase, a, l, r,
        (1000000 * a::HUGEINT * a // (l::HUGEINT * r))::BIGINT AS score
    FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
    phrase, a, l, r, n, score
FROM best JOIN n USING (lang) QUALIFY rank <= 2000
"""

JACCARD_COMPONENTS = r"""
WITH RECURSIVE d AS (
    SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w
    FROM documents
), s AS (
    SELECT row, doc_id, list_distinct(CASE
        WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS shingles
    FROM d
), x AS (SELECT row, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
pairs AS (
    SELECT a.row AS a, b.row AS b FROM x a JOIN x b ON a.shingle = b.shingle AND a.row <> b.row
    GROUP BY a.row, b.row, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach(row, other) AS (
    SELECT row, row FROM s UNION SELECT reach.row, pairs.b FROM reach JOIN pairs ON reach.other = pairs.a
)
SELECT s.doc_id, len(s.shingles) AS n_shingles, min(o.doc_id) AS component_id
FROM s JOIN reach ON reach.row = s.row JOIN s o ON o.row = reach.other
GROUP BY s.row, s.doc_id, len(s.shingles)
"""

QUALITY_COUNTS = r"""
WITH d AS (
    SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), dup AS (
    SELECT row, count(*) - count(DISTINCT line) AS n
    FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM d)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row
), windows AS (
    SELECT row, i, count(*) OVER (PARTITION BY row, w[i:i + 4]) AS found
    FROM (SELECT row, w, unnest(range(1, len(w) - 3)) AS i FROM d)
), again AS (
    SELECT row, count(DISTINCT place) AS n
    FROM (SELECT row, unnest(range(i, i + 5)) AS place FROM windows WHERE found > 1) GROUP BY row
), c AS (
    SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        coalesce(dup.n, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words
    FROM d LEFT JOIN dup USING (row) LEFT JOIN again USING (row)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c
"""

"""The queries in DuckDB SQL, where SQL can express them."""

from __future__ import annotations


ORACLE = {
    "op5_exact_dedup": """
        WITH t AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents
        )
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM t WINDOW g AS (PARTITION BY text_sha256)
    """,
}

# Every run of lines is spelled out here, without fingerprints.
ORACLE["op3_line_winnow"] = r"""
    WITH cut AS (
        SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '(\n|[.!?] )', '\1' || chr(30), 'g'), chr(30)) AS segs FROM documents
    ), lines AS (
        SELECT doc_id, unnest(segs) AS seg, unnest(range(len(segs))) AS line FROM cut
    ), filled AS (
        SELECT doc_id, line, trim(seg, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
               len(regexp_extract_all(seg, '[^\x20\x09-\x0D]+')) AS n
        FROM lines
    ), ahead AS (
        SELECT doc_id, line, body, n,
               lead(body, 1) OVER d AS b1, lead(body, 2) OVER d AS b2, lead(body, 3) OVER d AS b3,
               lead(n, 1) OVER d AS n1, lead(n, 2) OVER d AS n2, lead(n, 3) OVER d AS n3,
               lead(line, 1) OVER d AS l1, lead(line, 2) OVER d AS l2, lead(line, 3) OVER d AS l3
        FROM filled WHERE n > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY line)
    ), windows AS (
        SELECT doc_id, line AS first,
               CASE WHEN n >= 20 THEN line WHEN n + n1 >= 20 THEN l1 WHEN n + n1 + n2 >= 20 THEN l2 ELSE l3 END AS last,
               CASE WHEN n >= 20 THEN body WHEN n + n1 >= 20 THEN body || chr(10) || b1
                    WHEN n + n1 + n2 >= 20 THEN body || chr(10) || b1 || chr(10) || b2
                    ELSE body || chr(10) || b1 || chr(10) || b2 || chr(10) || b3 END AS content
        FROM ahead
    ), ranked AS (
        SELECT doc_id, first, last, row_number() OVER (PARTITION BY content ORDER BY doc_id, first) AS nth
        FROM windows WHERE content IS NOT NULL
    ), gone AS (
        SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS line FROM ranked WHERE nth > 1
    )
    SELECT l.doc_id, count(*) AS n_lines, count(g.line) AS n_removed,
           coalesce(string_agg(g.line::VARCHAR, ',' ORDER BY g.line), '') AS removed,
           coalesce(string_agg(CASE WHEN g.line IS NULL THEN l.seg END, '' ORDER BY l.line), '') AS text
    FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.line = l.line
    GROUP BY l.doc_id
"""

# Every kept term of every group of a language, with its count of 0 where it does not occur.
ORACLE["op13_divergence"] = r"""
    WITH d AS (
        SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
        FROM documents
    ), w AS (
        SELECT id, lang, source, translate(unnest(words), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d
    ), kept AS (
        SELECT lang, term, count(*) AS lang_n FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 3
    ), groups AS (
        SELECT DISTINCT lang, source FROM d
    ), counts AS (
        SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL
    ), dense AS (
        SELECT g.lang, g.source, k.term, k.lang_n, coalesce(c.n, 0) AS n
        FROM groups g JOIN kept k ON k.lang = g.lang
        LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
    ), totals AS (
        SELECT lang, source, sum(n) AS total, sum(lang_n) AS lang_total, count(*) AS v FROM dense GROUP BY ALL
    ), shares AS (
        SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (total + v)::HUGEINT AS p,
               1 + (1000000000::HUGEINT * (lang_n + 1)) // (lang_total + v)::HUGEINT AS q
        FROM dense JOIN totals USING (lang, source)
    ), pairs AS (
        SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
        FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
    ), found AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
        FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
        UNION ALL
        SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE n > 0 AND p > q
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found
    )
    SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

# All runs of one to five words are counted as lists.
ORACLE["op11_phrases"] = r"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents
    ), w AS (
        SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces
    ), sizes AS (
        SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang
    ), starts AS (
        SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w
    ), counts AS (
        SELECT lang, words[i : i + m - 1] AS words, count(*) AS f FROM starts, range(1, 6) t(m)
        WHERE i + m - 1 <= len(words) GROUP BY ALL HAVING count(*) >= 100
    ), candidates AS (
        SELECT lang, words, f AS a FROM counts WHERE len(words) > 1
    ), parts AS (
        SELECT lang, words, a, unnest(range(1, len(words))) AS k FROM candidates
    ), cuts AS (
        SELECT p.lang, p.words, p.a, k, l.f AS l, r.f AS r, s.n, (1000::HUGEINT * a * s.n) // (l.f::HUGEINT * r.f) AS score
        FROM parts p JOIN sizes s ON s.lang = p.lang
        JOIN counts l ON l.lang = p.lang AND l.words = p.words[1 : k]
        JOIN counts r ON r.lang = p.lang AND r.words = p.words[k + 1 : len(p.words)]
    ), lowest AS (
        SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1
    ), inside AS (
        SELECT DISTINCT c.lang, c.words[i : i + m - 1] AS words, a
        FROM candidates c, range(1, 6) t(i), range(2, 6) u(m) WHERE i + m - 1 <= len(c.words) AND m < len(c.words)
    ), dropped AS (
        SELECT lang, words, max(a) AS longer FROM inside GROUP BY ALL
    ), ranked AS (
        SELECT l.*, array_to_string(l.words, ' ') AS phrase,
               row_number() OVER (PARTITION BY l.lang ORDER BY l.score DESC, l.a DESC, array_to_string(l.words, ' ')) AS rank
        FROM lowest l LEFT JOIN dropped d ON d.lang = l.lang AND d.words = l.words WHERE d.longer IS NULL OR d.longer < l.a
    )
    SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""

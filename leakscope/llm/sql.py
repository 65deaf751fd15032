"""SQL of those queries that look at words, written for whole tables."""

from __future__ import annotations

from leakscope.llm.quality_rules import BASE_WINDOW, GRAM_LIMITS, LINE_LIMIT, MIN_WORDS

WORDS = r"""
    listed AS (
        SELECT doc_id, regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+') AS list
        FROM documents
    ),
    words AS (
        SELECT doc_id, unnest(list) AS word, generate_subscripts(list, 1) AS i, len(list) AS n
        FROM listed
    )
"""


def gram(n: int) -> str:
    """The n words from each one on, joined by one space; null near the end."""
    return f"""
        CASE WHEN i <= n - {n - 1} THEN string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i
            ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) END"""


def covered(start: str, n: int) -> str:
    """Whether one of the n-word windows around a word is marked."""
    return f"""
        max({start}::INT) OVER (PARTITION BY doc_id ORDER BY i
            ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = 1"""


def substring_sql(window: int) -> str:
    return f"""
    WITH {WORDS.format(text="text")},
    windows AS (SELECT *, {gram(window)} AS gram FROM words),
    marked AS (
        SELECT *, gram IS NOT NULL
                  AND row_number() OVER (PARTITION BY gram ORDER BY doc_id, i) > 1 AS again
        FROM windows
    ),
    judged AS (SELECT doc_id, i, word, {covered("again", window)} AS gone FROM marked),
    sums AS (
        SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
               string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept_words
        FROM judged GROUP BY doc_id
    )
    SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
           sha256(coalesce(kept_words, '')) AS kept_sha256
    FROM documents d LEFT JOIN sums s ON s.doc_id = d.doc_id
    """


def near_sql(percent: int, size: int = 5) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = f"translate(text, '{upper}', '{upper.lower()}')"
    return f"""
    WITH RECURSIVE {WORDS.format(text=lowered)},
    shingles AS (
        SELECT DISTINCT doc_id, gram FROM (SELECT doc_id, {gram(size)} AS gram FROM words)
        WHERE gram IS NOT NULL
        UNION ALL
        SELECT doc_id, array_to_string(list, ' ') FROM listed WHERE len(list) BETWEEN 1 AND {size - 1}
    ),
    sets AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    common AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
        FROM shingles a JOIN shingles b ON a.gram = b.gram AND a.doc_id <> b.doc_id
        GROUP BY a.doc_id, b.doc_id
    ),
    links AS (
        SELECT c.a, c.b
        FROM common c JOIN sets s ON s.doc_id = c.a JOIN sets t ON t.doc_id = c.b
        WHERE 100 * c.n >= {percent} * (s.n + t.n - c.n)
    ),
    reach AS (
        SELECT doc_id AS a, doc_id AS b FROM documents
        UNION
        SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
    ),
    lows AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
    SELECT l.doc_id, coalesce(s.n, 0) AS n_shingles, l.component_id,
           l.doc_id = l.component_id AS kept
    FROM lows l LEFT JOIN sets s ON s.doc_id = l.doc_id
    """


def rules_sql() -> str:
    sizes = sorted({BASE_WINDOW, *GRAM_LIMITS})
    each = lambda pattern, between=", ": between.join(pattern(n) for n in sizes)
    shares = ", ".join(f"coalesce(chars{n}, 0) / greatest(coalesce(word_chars, 0), 1) AS gram{n}_share" for n in GRAM_LIMITS)
    limits = " AND ".join(f"gram{n}_share <= {limit}" for n, limit in GRAM_LIMITS.items())
    return rf"""
    WITH {WORDS.format(text="text")},
    windows AS (SELECT *, {each(lambda n: f"{gram(n)} AS gram{n}")} FROM words),
    marked AS (
        SELECT *, {each(lambda n: f"gram{n} IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram{n}) > 1 AS twice{n}")}
        FROM windows
    ),
    judged AS (SELECT doc_id, word, {each(lambda n: f"{covered(f'twice{n}', n)} AS in{n}")} FROM marked),
    sums AS (
        SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars,
               count(*) FILTER (in{BASE_WINDOW}) AS n_repeat_words,
               {each(lambda n: f"sum(length(word)) FILTER (in{n}) AS chars{n}")}
        FROM judged GROUP BY doc_id
    ),
    lines AS (
        SELECT doc_id, line, i FROM (
            SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i
            FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)
        ) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
    ),
    repeats AS (
        SELECT doc_id, count(*) AS n, sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS chars
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS copy FROM lines)
        WHERE copy > 1 GROUP BY doc_id
    ),
    measured AS (
        SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
               coalesce(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')), 0) AS n_symbols,
               coalesce(r.n, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
               coalesce(n_words, 0) < {MIN_WORDS}
                   OR 100 * coalesce(n_repeat_words, 0) > 30 * coalesce(n_words, 0) AS base_failed,
               coalesce(r.chars, 0) / greatest(coalesce(word_chars, 0), 1) AS line_share, {shares}
        FROM documents d LEFT JOIN sums s ON s.doc_id = d.doc_id LEFT JOIN repeats r ON r.doc_id = d.doc_id
    )
    SELECT *, NOT base_failed AND line_share <= {LINE_LIMIT} AND {limits} AS kept FROM measured
    """

"""DuckDB text for the oracle of each query, assembled from shared table expressions."""

from __future__ import annotations

DOCS = r"""docs AS (SELECT doc_id,
  list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS tokens FROM documents)"""

ITEMS = r"""items AS (SELECT ID, tokens, len(tokens) AS L, len(tokens) // 2 AS plen,
  CASE WHEN len(tokens) < 30 THEN 'short' WHEN len(tokens) < 45 THEN 'medium' ELSE 'long' END AS CATEGORY
  FROM (SELECT item_id::VARCHAR AS ID,
    list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS tokens FROM benchmark))"""


def grams(tokens: str, n: int) -> str:
    if n == 1:
        return tokens
    return (
        f"list_transform(range(1, len({tokens}) - {n - 2}), "
        f"lambda i: array_to_string({tokens}[i:i + {n - 1}], ' '))"
    )


SCORES = f"""uni AS (SELECT w, count(*) AS c FROM (SELECT unnest(tokens) AS w FROM docs) GROUP BY w),
tot AS (SELECT sum(c)::DOUBLE + count(*)::DOUBLE AS nv FROM uni),
bi AS (SELECT g, count(*) AS c FROM (SELECT unnest({grams('tokens', 2)}) AS g FROM docs) GROUP BY g),
spread AS (SELECT ID, pos, tokens[pos + 1] AS prev, tokens[pos + 2] AS token
  FROM (SELECT ID, tokens, unnest(range(0, len(tokens) - 1)) AS pos FROM items)),
scores AS (SELECT ID, pos, prev, token, prob, ln(prob) AS log_like FROM (
  SELECT s.ID, s.pos, s.prev, s.token,
    (coalesce(b.c, 0)::DOUBLE + 10 * ((coalesce(t.c, 0)::DOUBLE + 1) / nv)) / (coalesce(h.c, 0)::DOUBLE + 10) AS prob
  FROM spread s CROSS JOIN tot LEFT JOIN bi b ON b.g = s.prev || ' ' || s.token
  LEFT JOIN uni h ON h.w = s.prev LEFT JOIN uni t ON t.w = s.token))"""

TOKEN_DATA = """td AS (SELECT ID, list(token ORDER BY pos) AS toks, list(prob ORDER BY pos) AS probs,
  list(log_like ORDER BY pos) AS lls FROM scores GROUP BY ID)"""

LABELS = f"""iwin AS (SELECT ID, unnest({grams('tokens', 8)}) AS g FROM items),
dwin AS (SELECT DISTINCT g FROM (SELECT unnest({grams('tokens', 8)}) AS g FROM docs)),
hit AS (SELECT DISTINCT ID FROM iwin WHERE g IN (SELECT g FROM dwin)),
lab AS (SELECT ID, CATEGORY, (CASE WHEN ID IN (SELECT ID FROM hit) THEN 1 ELSE 0 END)::INTEGER AS y FROM items)"""

LARGE = r"""large AS (SELECT ID, CATEGORY, SOURCE, y, len(tokens) AS n_words,
  len(list_distinct(tokens))::DOUBLE / len(tokens) AS distinct_share,
  n_chars::DOUBLE / len(tokens) AS chars_per_word,
  1 - len(list_distinct(lines))::DOUBLE / len(lines) AS line_repeat,
  length(regexp_replace(text, '[^0-9]', '', 'g'))::DOUBLE / n_chars AS digit_share, n_chars
  FROM (SELECT doc_id::VARCHAR AS ID, lang AS CATEGORY, source AS SOURCE, quality AS y, text, n_chars,
    list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS tokens,
    string_split(text, chr(10)) AS lines
    FROM documents JOIN labels USING (doc_id)))"""

CORRECT = """cor AS (SELECT doc_id::VARCHAR AS ID, lang AS CATEGORY, source AS MODEL_SHORT,
  CASE WHEN toxic = 1 THEN 'Conta' ELSE 'Clean' END AS LABEL, quality AS CORRECTNESS
  FROM documents JOIN labels USING (doc_id))"""

# Every user turn with the assistant turn right after it, if there is one.
QA = """qa AS (SELECT q.conv_id, q.turn, q.text AS PROBLEM, a.text AS SOLUTION FROM conversations q
  LEFT JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant' WHERE q.role = 'user')"""


def text(value: str) -> str:
    """A string as an SQL literal, line ends spelled out."""
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def with_(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"


def even(length: str, n: int | str, count: int, offset: int) -> str:
    """Evenly spread start points as a list."""
    low = (
        f"(CASE WHEN {length} <= {n} + {offset} THEN greatest(1, least({offset}, {length} // 3)) "
        f"ELSE {offset} END)"
    )
    room = f"({length} - {low} - {n})"
    pts = f"least({count}, {room})"
    return (
        f"CASE WHEN {room} <= 0 THEN NULL WHEN {pts} = 1 THEN [{low} + {room} // 2] ELSE "
        f"list_transform(range(0, {pts}), lambda i: {low} + CASE WHEN i = {pts} - 1 THEN {room} - 1 "
        f"ELSE trunc(i * (({room} - 1)::DOUBLE / ({pts} - 1)))::BIGINT END) END"
    )


def continuations(contexts: str, c: int, n: int, samples: int) -> str:
    """win, kept, greedy and drawn for the contexts of the named expression."""
    return f"""win AS (SELECT doc_id, i AS place, array_to_string(tokens[i:i + {c - 1}], ' ') AS context,
  array_to_string(tokens[i + {c}:i + {c + n - 1}], ' ') AS follow
  FROM (SELECT doc_id, tokens, unnest(range(1, len(tokens) - {c - 1})) AS i FROM docs)),
kept AS (SELECT * FROM win WHERE context IN (SELECT context FROM {contexts})),
greedy AS (SELECT context, string_split(follow, ' ') AS greedy FROM (
  SELECT context, follow, row_number() OVER (PARTITION BY context ORDER BY count(*) DESC, follow) AS r
  FROM kept GROUP BY context, follow) WHERE r = 1),
drawn AS (SELECT context, r, follow, string_split(follow, ' ') AS sample FROM (
  SELECT context, follow, row_number() OVER (PARTITION BY context ORDER BY md5('42|' || doc_id || '|' || place), doc_id, place) AS r
  FROM kept) WHERE r <= {samples})"""


def starts_table(n: int, count: int, offset: int, c: int) -> str:
    return f"""st AS (SELECT ID, tokens, L, plen, slot - 1 AS slot, pts[slot] AS start FROM (
  SELECT ID, tokens, L, plen, pts, unnest(range(1, len(pts) + 1)) AS slot FROM (
    SELECT ID, tokens, L, plen, {even('L', n, count, offset)} AS pts FROM items))),
at_start AS (SELECT ID, slot, start, array_to_string(tokens[start - {c} + 1:start], ' ') AS context,
  tokens[start + 1:start + {n}] AS target FROM st WHERE start >= {c})"""


def distance(a: str, b: str) -> str:
    """Token edit distance: one byte per distinct token of the pair."""
    known = f"list_distinct(list_concat({a}, {b}))"

    def code(tokens: str) -> str:
        return (
            f"array_to_string(list_transform({tokens}, "
            f"lambda t: chr((33 + list_position({known}, t))::INTEGER)), '')"
        )

    return f"levenshtein({code(a)}, {code(b)})"


def cv(k: int = 5) -> str:
    """From feat(grid_pos, ID, y, x): per (grid_pos, f) the best t and accuracies, f = -1 for all."""
    return f"""fold AS (SELECT ID, y, (row_number() OVER (PARTITION BY y ORDER BY md5('42|' || ID), ID) - 1) % {k} AS fold
  FROM (SELECT DISTINCT ID, y FROM feat)),
role AS (SELECT grid_pos, ID, feat.y, x, fold, f FROM feat JOIN fold USING (ID)
  CROSS JOIN (SELECT unnest(range(-1, {k})) AS f)),
tr AS (SELECT * FROM role WHERE fold <> f),
srt AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM tr
  WINDOW w AS (PARTITION BY grid_pos, f ORDER BY x, y, ID)),
cand0 AS (SELECT DISTINCT grid_pos, f, (px + x) / 2 AS t FROM srt WHERE y <> py),
cand AS (SELECT * FROM cand0 UNION ALL
  SELECT grid_pos, f, unnest([min(x) - 0.1::DOUBLE, max(x) + 0.1::DOUBLE]) AS t FROM tr
  WHERE NOT EXISTS (SELECT 1 FROM cand0 c WHERE c.grid_pos = tr.grid_pos AND c.f = tr.f) GROUP BY grid_pos, f),
acc AS (SELECT c.grid_pos, c.f, c.t, sum(CASE WHEN (x >= t) = (y = 1) THEN 1 ELSE 0 END) AS h, count(*) AS n
  FROM cand c JOIN tr ON tr.grid_pos = c.grid_pos AND tr.f = c.f GROUP BY c.grid_pos, c.f, c.t),
best AS (SELECT grid_pos, f, t, h::DOUBLE / n AS train_acc FROM acc
  QUALIFY row_number() OVER (PARTITION BY grid_pos, f ORDER BY h DESC, t) = 1),
cvr AS (SELECT b.grid_pos, b.f, b.t, b.train_acc,
  avg(CASE WHEN (x >= t) = (y = 1) THEN 1::DOUBLE ELSE 0 END) AS test_acc
  FROM best b LEFT JOIN role r ON r.grid_pos = b.grid_pos AND r.f = b.f AND r.fold = b.f
  GROUP BY b.grid_pos, b.f, b.t, b.train_acc)"""


CV_ROWS = """SELECT grid_pos, f::INTEGER AS fold, round(t, 9) AS t, round(train_acc, 9) AS train_acc,
  CASE WHEN f >= 0 THEN round(test_acc, 9) END AS test_acc FROM cvr"""

TUNED = """entry AS (SELECT grid_pos, round(max(t) FILTER (f = -1), 6) AS global_threshold,
  round(median(t) FILTER (f >= 0), 6) AS median_threshold,
  round(avg(train_acc) FILTER (f >= 0), 6) AS mean_cvacc_train,
  round(avg(test_acc) FILTER (f >= 0), 6) AS mean_cvacc_test FROM cvr GROUP BY grid_pos)
SELECT *, row_number() OVER (ORDER BY mean_cvacc_test DESC, grid_pos) = 1 AS is_best FROM entry"""


def cv_pair(k: int = 5) -> str:
    """From feat2(grid_pos, ID, y, a, b): the same over all candidate pairs."""
    return f"""fold AS (SELECT ID, y, (row_number() OVER (PARTITION BY y ORDER BY md5('42|' || ID), ID) - 1) % {k} AS fold
  FROM (SELECT DISTINCT ID, y FROM feat2)),
role AS (SELECT grid_pos, ID, feat2.y, a, b, fold, f FROM feat2 JOIN fold USING (ID)
  CROSS JOIN (SELECT unnest(range(-1, {k})) AS f)),
tr AS (SELECT * FROM role WHERE fold <> f),
{_axis('a')}, {_axis('b')},
acc AS (SELECT p.grid_pos, p.f, p.ta, p.tb,
    sum(CASE WHEN (tr.a < ta OR tr.b > tb) = (tr.y = 1) THEN 1 ELSE 0 END) AS h, count(*) AS n
  FROM (SELECT ca.grid_pos, ca.f, ca.t AS ta, cb.t AS tb FROM cand_a ca JOIN cand_b cb
        ON ca.grid_pos = cb.grid_pos AND ca.f = cb.f) p
  JOIN tr ON tr.grid_pos = p.grid_pos AND tr.f = p.f GROUP BY p.grid_pos, p.f, p.ta, p.tb),
best AS (SELECT grid_pos, f, ta, tb, h::DOUBLE / n AS train_acc FROM acc
  QUALIFY row_number() OVER (PARTITION BY grid_pos, f ORDER BY h DESC, ta, tb) = 1),
cvr AS (SELECT b.grid_pos, b.f, b.ta, b.tb, b.train_acc,
  avg(CASE WHEN (r.a < ta OR r.b > tb) = (y = 1) THEN 1::DOUBLE ELSE 0 END) AS test_acc
  FROM best b LEFT JOIN role r ON r.grid_pos = b.grid_pos AND r.f = b.f AND r.fold = b.f
  GROUP BY b.grid_pos, b.f, b.ta, b.tb, b.train_acc)"""


def _axis(x: str) -> str:
    return f"""srt_{x} AS (SELECT grid_pos, f, {x}, y, lag({x}) OVER w AS px, lag(y) OVER w AS py FROM tr
  WINDOW w AS (PARTITION BY grid_pos, f ORDER BY {x}, y, ID)),
c0_{x} AS (SELECT DISTINCT grid_pos, f, (px + {x}) / 2 AS t FROM srt_{x} WHERE y <> py),
cand_{x} AS (SELECT * FROM c0_{x} UNION ALL
  SELECT grid_pos, f, unnest([min({x}) - 0.1::DOUBLE, max({x}) + 0.1::DOUBLE]) AS t FROM tr
  WHERE NOT EXISTS (SELECT 1 FROM c0_{x} c WHERE c.grid_pos = tr.grid_pos AND c.f = tr.f) GROUP BY grid_pos, f)"""


def two_sided(z: str) -> str:
    """Normal tail with the same published constants as the Spark expression."""
    from leakscope.functions.probability import ERF_A, ERF_P

    x = f"(abs({z}) / sqrt(2::DOUBLE))"
    t = f"(1::DOUBLE / (1 + {ERF_P!r}::DOUBLE * {x}))"
    poly = "0::DOUBLE"
    for a in reversed(ERF_A):
        poly = f"(({poly}) + ({a!r}::DOUBLE)) * {t}"
    return f"least(1::DOUBLE, {poly} * exp(-{x} * {x}))"


def mann_whitney(src: str, model: str, value: str) -> str:
    """mw(model, n1, n2, u1, p_value) from rows with LABEL."""
    p = two_sided("z")
    return f"""ranked AS (SELECT {model}, LABEL, rank() OVER (PARTITION BY {model} ORDER BY {value})
    + (count(*) OVER (PARTITION BY {model}, {value}) - 1) / 2.0::DOUBLE AS r FROM {src}),
tie AS (SELECT {model}, sum(t * t * t - t)::DOUBLE AS ties FROM (
  SELECT {model}, {value}, count(*)::DOUBLE AS t FROM {src} GROUP BY {model}, {value}) GROUP BY {model}),
base AS (SELECT {model}, count(*) FILTER (LABEL = 'Conta')::DOUBLE AS n1,
  count(*) FILTER (LABEL = 'Clean')::DOUBLE AS n2, sum(r) FILTER (LABEL = 'Conta') AS r1 FROM ranked GROUP BY {model}),
stat AS (SELECT {model}, n1, n2, r1 - n1 * (n1 + 1) / 2 AS u1,
  n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1))) AS s2 FROM base JOIN tie USING ({model})),
zed AS (SELECT *, CASE WHEN s2 > 0 THEN (greatest(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5::DOUBLE) / sqrt(s2) END AS z FROM stat),
mw AS (SELECT {model}, n1::BIGINT AS n1, n2::BIGINT AS n2, CASE WHEN n1 > 0 AND n2 > 0 THEN u1 END AS u1,
  CASE WHEN n1 > 0 AND n2 > 0 THEN CASE WHEN z IS NULL OR z < 0 THEN 1::DOUBLE ELSE {p} END END AS p_value FROM zed)"""


def mcnemar(b: str, c: str) -> str:
    n, k = f"({b} + {c})", f"least({b}, {c})"
    return (
        f"CASE WHEN {n} = 0 THEN 1::DOUBLE ELSE least(1::DOUBLE, 2 * list_sum(list_transform(range(0, {k} + 1), "
        f"lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) - {n} * ln(2::DOUBLE))))) END"
    )

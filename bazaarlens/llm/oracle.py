"""DuckDB SQL for the corpus queries that SQL can express.

The others hold a fitted model, a tokenizer library, confirmed similarity links or byte windows;
their tests hold them against brute force.
"""

from __future__ import annotations

from bazaarlens.llm.mixing import PHI, WORD
from bazaarlens.llm.secrets import KINDS, LOOSE, PLACEHOLDER


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spans(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Matches with code-point bounds, from the pieces between matches and the matches."""
    p = _quoted(pattern)
    return f"""
    parts{rank} AS (
        SELECT "row", owner, repo, string_split_regex(t, {p}) AS gaps, regexp_extract_all(t, {p}, 0) AS hits, regexp_extract_all(t, {p}, {group}) AS vals FROM d WHERE regexp_matches(t, {p})),
    found{rank} AS (SELECT "row", owner, repo, gaps, hits, vals[i] AS value, i FROM parts{rank}, unnest(range(1, len(hits) + 1)) AS u(i) WHERE length(vals[i]) >= {least}),
    span{rank} AS (
        SELECT "row", owner, repo, {rank} AS rank, '{kind}' AS kind, value, CAST(list_sum([length(x) FOR x IN gaps[1:i]]) + coalesce(list_sum([length(x) FOR x IN hits[1:i - 1]]), 0) AS BIGINT) AS s,
               CAST(list_sum([length(x) FOR x IN gaps[1:i]]) + list_sum([length(x) FOR x IN hits[1:i]]) AS BIGINT) AS e
        FROM found{rank})"""


SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS "row", doc_id, coalesce(text, '') AS t, source AS owner, concat_ws('/', source, lang) AS repo FROM documents),
    {','.join(_spans(i, *k) for i, k in enumerate([*KINDS, LOOSE]))},
    base AS ({' UNION ALL '.join(f'SELECT * FROM span{i}' for i in range(len(KINDS)))}),
    loose AS (
        SELECT * FROM span{len(KINDS)} l WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]')
          AND NOT EXISTS (SELECT 1 FROM base b WHERE b."row" = l."row" AND b.s < l.e AND l.s < b.e)),
    candidates AS (SELECT * FROM base UNION ALL SELECT * FROM loose),
    ownership AS (
        SELECT value, count(*) AS owners, CAST(sum(repositories) AS BIGINT) AS repositories
        FROM (SELECT value, owner, count(DISTINCT coalesce(repo, '')) AS repositories FROM candidates GROUP BY value, owner) GROUP BY value),
    judged AS (
        SELECT c.*, o.repositories, CASE WHEN o.repositories >= 3 AND o.owners > 1 THEN 'example' WHEN regexp_matches(c.value, '[0-9]') AND regexp_matches(c.value, '[A-Za-z]') AND NOT regexp_matches(c.value, {_quoted(PLACEHOLDER)})
            AND len(list_distinct(string_split(c.value, ''))) >= 8 THEN 'live' ELSE 'plain' END AS verdict
        FROM candidates c JOIN ownership o ON o.value = c.value),
    shown AS (SELECT * FROM judged WHERE rank < {len(KINDS)} OR verdict = 'live'),
    per AS (
        SELECT "row", {', '.join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k, *_ in KINDS)},
               string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY s, rank) FILTER (WHERE rank < {len(KINDS)}) AS base_spans, string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY s, rank) AS spans,
               count(*) FILTER (WHERE verdict = 'live') AS n_live, count(*) FILTER (WHERE verdict = 'example') AS n_example, max(repositories) AS most_repositories
        FROM shown GROUP BY "row")
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k, *_ in KINDS)}, sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(most_repositories, 0) AS most_repositories
FROM d LEFT JOIN per ON per."row" = d."row"
"""

MIXING = f"""
WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, {_quoted(WORD)})), 0) AS BIGINT) AS size, md5(concat('mix:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS digest FROM documents),
    sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
    weighed AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS nr FROM sizes),
    caps AS (SELECT *, nr % 3 + 1 AS weight, 3 * source_size AS cap, CAST(3 * source_size AS DOUBLE) / (nr % 3 + 1) AS ratio FROM weighed),
    levels AS (
        SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0) AS DOUBLE) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS DOUBLE) AS level
        FROM caps WINDOW before AS (ORDER BY ratio, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    goals AS (SELECT *, CASE WHEN ratio <= level THEN CAST(cap AS DOUBLE) ELSE weight * max(level) FILTER (WHERE ratio > level) OVER () END AS target FROM levels),
    placed AS (
        SELECT s.doc_id, s.size, g.source_size, g.target, g.nr, CAST(floor(g.target) AS BIGINT) AS goal,
               CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.digest, s.size, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - s.size AS start
        FROM sized s JOIN goals g ON g.source IS NOT DISTINCT FROM s.source),
    numbered AS (SELECT *, row_number() OVER () AS "row" FROM placed),
    plan AS (SELECT *, CAST(floor(shared * 1.001) AS BIGINT) // block + 64 * sources AS slots FROM (SELECT greatest(64, CAST(sum(source_size) AS BIGINT) // 262144) AS block, sum(target) AS shared, count(*) AS sources FROM goals)),
    upto AS (SELECT nr, CAST(floor(target) AS BIGINT) AS goal, sum(target) OVER (ORDER BY nr) / shared AS upto FROM goals, plan),
    share AS (SELECT *, coalesce(lag(upto) OVER (ORDER BY nr), 0.0) AS since FROM upto),
    points AS (SELECT j AS slot, ((((j // 1048576) * CAST('{PHI * (1 << 20) % 1.0!r}' AS DOUBLE)) % 1.0) + (((j % 1048576) * CAST('{PHI!r}' AS DOUBLE)) % 1.0) + CAST('{PHI / 2!r}' AS DOUBLE)) % 1.0 AS point FROM (SELECT unnest(range(slots)) AS j FROM plan)),
    drawn AS (SELECT s.nr, p.slot, row_number() OVER (PARTITION BY s.nr ORDER BY p.slot) - 1 AS rank FROM points p JOIN share s ON p.point >= s.since AND p.point < s.upto),
    got AS (SELECT s.nr, (s.goal + block - 1) // block AS due, (SELECT count(*) FROM drawn d WHERE d.nr = s.nr) AS got FROM share s, plan),
    ranked AS (SELECT * FROM drawn UNION ALL SELECT nr, slots + r * sources + nr, r FROM (SELECT nr, unnest(range(got, due)) AS r FROM got), plan),
    rounds AS (SELECT "row", nr, goal, size, k * source_size + start AS a FROM (SELECT *, unnest(range((goal + source_size - 1) // greatest(source_size, 1))) AS k FROM numbered WHERE size > 0) WHERE k * source_size + start < goal),
    reads AS (SELECT u."row", min(k.slot) AS first_slot, count(DISTINCT u.a) AS n_takes FROM rounds u, plan JOIN ranked k ON k.nr = u.nr AND k.rank BETWEEN u.a // plan.block AND (least(u.a + u.size, u.goal) - 1) // plan.block GROUP BY u."row")
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE goal // source_size * size + greatest(least(start + size, goal % source_size) - start, 0) END AS taken, first_slot, CAST(coalesce(n_takes, 0) AS INT) AS n_takes
FROM numbered n LEFT JOIN reads r ON r."row" = n."row"
"""

COMPACTION = "SELECT doc_id, lang, source, n_chars, CAST(strlen(text) AS BIGINT) AS n_bytes, sha256(text) AS text_sha256, CAST(CASE WHEN doc_id % 2 = 0 THEN 0 WHEN doc_id % 4 = 1 THEN 1 WHEN doc_id % 8 = 3 THEN 2 ELSE 3 END AS INT) AS arrival, true AS settled FROM documents"

SEARCH = """
WITH v AS (SELECT DISTINCT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings),
    scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([a[1] * a[2] FOR a IN list_zip(q.e, c.e)]) AS BIGINT) AS score
        FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""

NEGATIVES = """
WITH v AS (
        SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
        FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
        SELECT q.vec_id AS anchor_id, q.label = c.label AS same, c.vec_id, CAST(list_sum([a[1] * a[2] FOR a IN list_zip(q.e, c.e)]) AS BIGINT) AS score
        FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
    positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS nth FROM scored WHERE same) WHERE nth <= 5),
    negatives AS (
        SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
        FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 10
"""

ORACLE: dict[str, str] = {"op1_secret_ownership": SECRETS, "op3_source_schedule": MIXING, "op4_tiered_compaction": COMPACTION, "op8_approximation_search": SEARCH, "op12_vantage_hard_negatives": NEGATIVES}

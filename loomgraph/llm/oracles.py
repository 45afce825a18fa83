"""The registered queries that SQL can express, in DuckDB's SQL over whole tables.

Hashes that SQL lacks (op5), trained models (op1, op8), keyed permutations (op3), windows cut by budgets (op7), a
tokenizer's merges with a linear program (op9) and message passing over trees (op10) are held against plain versions
in tests/llm instead.
"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Every run of at least 50 words that starts or ends with its words, and whether an equal one is earlier.
OP2 = """
WITH t AS MATERIALIZED (SELECT doc_id, text, string_split(text, chr(10)) AS own FROM documents),
l AS (SELECT doc_id, unnest(own) AS line, generate_subscripts(own, 1) - 1 AS ln FROM t),
w AS (SELECT doc_id, ln, CASE WHEN trim(line, ' ') = '' THEN 0 ELSE length(trim(line, ' ')) - length(replace(trim(line, ' '), ' ', '')) + 1 END AS w FROM l),
c AS MATERIALIZED (SELECT doc_id, ln, sum(w) OVER (PARTITION BY doc_id ORDER BY ln) AS upto, sum(w) OVER (PARTITION BY doc_id ORDER BY ln) - w AS before FROM w),
runs AS (
    SELECT a.doc_id, a.ln AS a, min(b.ln) AS b FROM c a JOIN c b ON b.doc_id = a.doc_id AND b.ln >= a.ln AND b.upto - a.before >= 50 GROUP BY ALL
    UNION SELECT b.doc_id, max(a.ln) AS a, b.ln AS b FROM c a JOIN c b ON b.doc_id = a.doc_id AND b.ln >= a.ln AND b.upto - a.before >= 50 GROUP BY b.doc_id, b.ln),
later AS (SELECT doc_id, a, b FROM (SELECT r.doc_id, r.a, r.b, row_number() OVER (PARTITION BY t.own[r.a + 1:r.b + 1] ORDER BY r.doc_id, r.a) AS k
    FROM runs r JOIN t USING (doc_id)) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS ln FROM later),
removed AS (SELECT doc_id, count(*) AS n, string_agg(CAST(ln AS VARCHAR), ',' ORDER BY ln) AS names FROM gone GROUP BY doc_id),
rest AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY ln) AS text FROM l ANTI JOIN gone USING (doc_id, ln) GROUP BY doc_id)
SELECT t.doc_id, CASE WHEN t.text IS NULL THEN NULL ELSE coalesce(rest.text, '') END AS text, CAST(coalesce(removed.n, 0) AS INTEGER) AS n_removed,
    coalesce(removed.names, '') AS removed_lines
FROM t LEFT JOIN removed USING (doc_id) LEFT JOIN rest USING (doc_id)
"""

OP4 = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.r <> q.r AND len(c.e) = len(q.e))
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS k FROM s) WHERE k <= 5
"""

_WORDS = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP6 = f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce({_WORDS}, []) AS words FROM documents),
i AS (SELECT item_id, {_WORDS} AS words FROM benchmark WHERE item_id IS NOT NULL),
w AS MATERIALIZED (SELECT DISTINCT item_id, words[k:k + 9] AS own FROM (SELECT item_id, words, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS k FROM i WHERE len(words) > 0)),
n AS (SELECT DISTINCT len(own) AS n FROM w),
p AS (SELECT doc_id, n, words, unnest(range(1, len(words) - n + 2)) AS k FROM d, n),
h AS MATERIALIZED (SELECT p.doc_id, p.k, p.n, w.item_id FROM p JOIN w ON w.own = p.words[p.k:p.k + p.n - 1]),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS at FROM h) GROUP BY doc_id),
of AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN of USING (doc_id)
"""

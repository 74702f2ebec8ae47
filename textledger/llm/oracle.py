"""DuckDB counterparts of the queries that SQL can express; the others are compared with brute force in tests/llm."""

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

TOP_K = """
WITH vectors AS (
    SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS vector
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
    SELECT q.row_id AS query, q.vec_id AS query_id, c.vec_id,
        CAST(coalesce(list_sum(list_transform(range(1, len(c.vector) + 1), lambda i: q.vector[i] * c.vector[i])), 0) AS BIGINT) AS score
    FROM vectors q JOIN vectors c ON q.vec_id % 20 = 0 AND q.row_id <> c.row_id AND len(q.vector) = len(c.vector)
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM scores
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

JACCARD = rf"""
WITH RECURSIVE tokens AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
    FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS shingles
    FROM tokens
), sized AS (SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, shingles FROM sets),
grams AS (SELECT doc_id, n_shingles, unnest(shingles) AS shingle FROM sized),
common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, a.n_shingles + b.n_shingles AS sizes, count(*) AS shared
    FROM grams a JOIN grams b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
    WHERE 4 * a.n_shingles >= 3 * b.n_shingles AND 4 * b.n_shingles >= 3 * a.n_shingles
    GROUP BY ALL
), pairs AS (SELECT a, b FROM common WHERE 100 * shared >= 75 * (sizes - shared)),
links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reached AS (
    SELECT DISTINCT a AS doc_id, a AS other FROM links
    UNION
    SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a
), least AS (SELECT doc_id, min(other) AS other FROM reached GROUP BY doc_id)
SELECT s.doc_id, s.n_shingles, coalesce(l.other, s.doc_id) AS component_id
FROM sized s LEFT JOIN least l ON s.doc_id = l.doc_id
"""

HARD_NEGATIVES = """
WITH vectors AS (
    SELECT row_number() OVER () AS row_id, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vector
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
    SELECT a.row_id AS anchor, a.vec_id AS anchor_id, c.row_id AS other, c.vec_id, a.label = c.label AS same,
        CAST(coalesce(list_sum(list_transform(range(1, len(c.vector) + 1), lambda i: a.vector[i] * c.vector[i])), 0) AS BIGINT) AS score
    FROM vectors a JOIN vectors c ON a.vec_id % 100 = 0 AND a.row_id <> c.row_id AND len(a.vector) = len(c.vector)
), positives AS (
    SELECT anchor, anchor_id, vec_id AS positive_id, score AS positive_score,
        row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS place
    FROM scores WHERE same
), negatives AS (
    SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
        CAST(row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
    FROM positives p JOIN scores s ON p.anchor = s.anchor AND NOT s.same AND p.place <= 5
        AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 5
"""

_TERMS = r"""
list_filter(regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: t <> '')"""

LEXICAL_SEARCH = f"""
WITH texts AS (SELECT row_number() OVER () AS row_id, doc_id, {_TERMS.format(text="text")} AS found FROM documents),
items AS (SELECT row_number() OVER () AS item, item_id, {_TERMS.format(text="text")} AS found FROM benchmark),
asked AS (SELECT item, item_id, unnest(found) AS term FROM items),
wanted AS (SELECT item, term, count(*) AS times FROM asked GROUP BY ALL),
sums AS (SELECT count(*) FILTER (WHERE len(found) > 0) AS docs, CAST(sum(len(found)) AS BIGINT) AS total FROM texts),
tokens AS (SELECT row_id, doc_id, CAST(len(found) AS BIGINT) AS n, unnest(found) AS term FROM texts),
postings AS (
    SELECT row_id, doc_id, n, term, count(*) AS tf FROM tokens WHERE term IN (SELECT term FROM wanted) GROUP BY ALL
), weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, sums GROUP BY term, docs
), gains AS (
    SELECT row_id, doc_id, term,
        w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // total)))) AS gain
    FROM postings JOIN weights USING (term), sums
), scores AS (
    SELECT item, row_id, doc_id, CAST(sum(times * gain) AS BIGINT) AS score FROM gains JOIN wanted USING (term) GROUP BY ALL
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
    FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked JOIN (SELECT item, item_id FROM items) USING (item) WHERE rank <= 10
"""

ORACLE = {
    "op4_jaccard_join": JACCARD,
    "op8_topk_search": TOP_K,
    "op12_hard_negatives": HARD_NEGATIVES,
    "op13_lexical_search": LEXICAL_SEARCH,
}

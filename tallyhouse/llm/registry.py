"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from tallyhouse.llm import byte_bpe, chat, decontaminate, hard_negatives, line_dedup, mips, ngram_join, packing, quality, secrets, sharding, token_counts, whitening


def queries() -> dict:
    return {
        "op1_ngram_jaccard": ngram_join.op1,
        "op2_secret_scans": secrets.op2,
        "op3_quality_classifier": quality.op3,
        "op4_chat_formatting": chat.op4,
        "op5_exact_top_k": mips.op5,
        "op6_decontamination": decontaminate.op6,
        "op7_line_dedup": line_dedup.op7,
        "op8_token_counts": token_counts.op8,
        "op9_sharding": sharding.op9,
        "op10_byte_bpe": byte_bpe.op10,
        "op11_embedding_whitening": whitening.op11,
        "op12_best_fit_packing": packing.op12,
        "op13_hard_negatives": hard_negatives.op13,
    }


#: Documents as sets of distinct three-word shingles; links by counting shared shingles; components by walking links.
NGRAM_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
shingled AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
sizes AS (SELECT doc_id, len(s) AS n FROM shingled),
flat AS (SELECT doc_id, unnest(s) AS g FROM shingled),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, min(r.other) AS component_id FROM sizes s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.n
"""

TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

#: All scores of the anchors; the first rows of each anchor's label; the first rows of other labels in each one's window.
NEGATIVES_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM scored WHERE same) WHERE r <= 5),
windowed AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id) AS INT) AS rank FROM windowed)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard": NGRAM_SQL, "op5_exact_top_k": TOP_K_SQL, "op13_hard_negatives": NEGATIVES_SQL}

"""The subpackage's queries and the SQL that checks them."""

from __future__ import annotations

from . import bpe_tree, decision_list, hard_negatives, html_extract, line_templates, minhash, packing, pii, pu_quality, substring_windows, telephony, toxicity, whitening


def queries() -> dict:
    return {
        "op1_pii_surrogates": pii.op1_pii_surrogates,
        "op2_bpe_tree": bpe_tree.op2_bpe_tree,
        "op3_compact_windows": substring_windows.op3_compact_windows,
        "op4_html_trees": html_extract.op4_html_trees,
        "op5_bbit_minhash": minhash.op5_bbit_minhash,
        "op6_ffd_packing": packing.op6_ffd_packing,
        "op7_decision_list": decision_list.op7_decision_list,
        "op8_telephony": telephony.op8_telephony,
        "op9_subword_toxicity": toxicity.op9_subword_toxicity,
        "op10_log_templates": line_templates.op10_log_templates,
        "op11_whitening": whitening.op11_whitening,
        "op12_pu_quality": pu_quality.op12_pu_quality,
        "op13_hard_negatives": hard_negatives.op13_hard_negatives,
    }


#: Links by all pairs that share a shingle, components by a recursive walk.
OP5_SQL = r"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) < 2 THEN ws ELSE list_distinct([ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
x AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x1 ON x1.doc_id = a JOIN n x2 ON x2.doc_id = b WHERE 100 * k >= 80 * (x1.n + x2.n - k)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, label) AS (SELECT a, a FROM u UNION SELECT u.b, r.label FROM r JOIN u ON u.a = r.node),
c AS (SELECT node, min(label) AS label FROM r GROUP BY node)
SELECT doc_id, n AS n_shingles, coalesce(label, doc_id) AS component_id, doc_id = coalesce(label, doc_id) AS kept FROM n LEFT JOIN c ON node = doc_id"""


#: Scores of each anchor with all rows, then two rankings.
OP13_SQL = """WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, c -> floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, c -> c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) <= 10"""


def oracle_sql() -> dict[str, str]:
    """SQL where SQL can express an operator; the others are tested against brute force in tests/llm."""
    return {"op5_bbit_minhash": OP5_SQL, "op13_hard_negatives": OP13_SQL}

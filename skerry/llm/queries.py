"""Queries of the training-text operators, by name."""

from __future__ import annotations

from . import knn, langid, mojibake, neardup, pack, scans, spam, split, tokens

QUERIES = {
    "p1_found": scans.p1_found,
    "p1_kinds": scans.p1_kinds,
    "p1_repaired": scans.p1_repaired,
    "p2_found": split.p2_found,
    "p2_pieces": split.p2_pieces,
    "p3_found": neardup.p3_found,
    "p3_groups": neardup.p3_groups,
    "p4_found": mojibake.p4_found,
    "p4_repaired": mojibake.p4_repaired,
    "p5_found": knn.p5_found,
    "p5_knn": knn.p5_knn,
    "p6_found": langid.p6_found,
    "p6_languages": langid.p6_languages,
    "p6_segments": langid.p6_segments,
    "p7_ids": tokens.p7_ids,
    "p8_pack": pack.p8_pack,
    "p9_found": spam.p9_found,
    "p9_share": spam.p9_share,
}

#: Exact pairs and neighbours by brute force, for tables small enough; operators without one are tested otherwise.
ORACLES: dict[str, str] = {
    "p2_found": "SELECT DISTINCT passage_id FROM passages WHERE length(text) > (SELECT max_size FROM size_limits WHERE applies_to = 'passages')",
    "p3_found": """WITH p AS (SELECT DISTINCT passage_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM passages WHERE text IS NOT NULL),
        s AS (SELECT DISTINCT passage_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS sh FROM p, range(1, len(w) - 1) t(i) WHERE len(w) >= 40),
        n AS (SELECT passage_id, count(*) AS n FROM s GROUP BY 1), both_ AS (SELECT a.passage_id AS x, b.passage_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.passage_id < b.passage_id GROUP BY 1, 2)
        SELECT x AS passage_id_a, y AS passage_id_b FROM both_ JOIN n n1 ON n1.passage_id = x JOIN n n2 ON n2.passage_id = y WHERE c >= 0.6 * (n1.n + n2.n - c) - 1e-9""",
    "p5_found": """WITH v AS (SELECT DISTINCT key, model, vec::DOUBLE[] AS v FROM emb WHERE key IS NOT NULL AND len(vec) = dim AND len(list_filter(vec, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(vec, lambda x: abs(x))) > 0),
        s AS (SELECT a.key AS a, b.key AS b, list_cosine_similarity(a.v, b.v) AS sim FROM v a JOIN v b ON a.model = b.model AND a.key <> b.key),
        t AS (SELECT a, b, sim FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS r FROM s) WHERE r <= 10 AND sim >= 0.9 - 1e-6)
        SELECT x.a AS key_a, x.b AS key_b FROM t x JOIN t y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b""",
}

"""The same results in DuckDB's SQL, written apart from the Spark plans to check them."""

from __future__ import annotations

from skerry.config import Config
from skerry.functions import porter
from skerry.functions import text as T
from skerry.operators.sparse import STOPWORDS
from skerry.plans import globs
from skerry.sources.extract import TEXT_TYPES

CONF = Config()


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(c: str) -> str:
    return f"regexp_extract_all(lower({c}), {q(T.WORD)})"


def terms(c: str) -> str:
    big = "CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END"
    return f"list_concat(regexp_extract_all(lower(regexp_replace({c}, {q(f'[{T.CJK}]+')}, ' ', 'g')), {q(T.TERM)}), flatten(list_transform(regexp_extract_all({c}, {q(f'[{T.CJK}]+')}), lambda r: {big})))"


def base(c: str) -> str:
    return f"regexp_replace({c}, '^.*/', '')"


def spaced(c: str) -> str:
    return f"trim(regexp_replace({c}, {q(T.SEPARATORS)}, ' ', 'g'))"


def ext(c: str) -> str:
    return f"lower(nullif(regexp_extract({base(c)}, '^.+\\.([^.]+)$', 1), ''))"


def stem_name(c: str) -> str:
    return f"regexp_replace({base(c)}, '^(.+)\\.[^.]*$', '\\1')"


def name_tokens(c: str) -> str:
    return f"list_transform(list_filter(regexp_extract_all(regexp_replace({c}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[A-Za-z0-9]+'), lambda t: length(t) > 1), lambda t: lower(t))"


def parent(c: str) -> str:
    return f"CASE WHEN {c} = '' THEN NULL ELSE regexp_replace({c}, '/?[^/]*$', '') END"


def dfs(c: str) -> str:
    return f"array_to_string(list_transform(string_split({c}, '/'), lambda p, i: CASE WHEN i = len(string_split({c}, '/')) THEN '0' || p ELSE '1' || p END), chr(1))"


def clean(c: str) -> str:
    return f"regexp_replace({c}, {q(T.CONTROL)}, '', 'g')"


def left(c: str, cls: str) -> str:
    return f"length(regexp_replace({c}, {q(cls)}, '', 'g'))"


def textual(c: str) -> str:
    n = f"length({c})"
    return f"({n} > 0 AND ({n} - {left(c, f'[\\p{{L}}\\p{{N}}{T.SPACE}]')}) * 2 >= {n} AND NOT ({n} >= 200 AND ({n} - {left(c, f'[{T.CJK}]')}) * 5 < {n} AND ({n} - {left(c, f'[{T.SPACE}]')}) * 100 < {n} * 3))"


def latest(where: str = "true") -> str:
    return f"""(SELECT path, size, mtime, content_hash, n_passages, indexed_version, indexed_at FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY
        coalesce(indexed_version, -1) DESC, coalesce(indexed_at, -1) DESC, coalesce(mtime, -1) DESC, coalesce(size, -1) DESC, coalesce(content_hash, '') DESC, coalesce(n_passages, -1) DESC) AS rn FROM files WHERE {where}) WHERE rn = 1)"""


PATHS = "(SELECT DISTINCT path FROM files)"
PASS = '(SELECT DISTINCT passage_id, doc_id, path, ordinal, page, "offset", text FROM passages)'


def delta(scan: str = latest(), old: str = latest("indexed_version <= 20")) -> str:
    return f"""(SELECT coalesce(s.path, m.path) AS path, CASE WHEN s.path IS NULL THEN 'deleted' WHEN m.path IS NULL THEN 'added'
        WHEN (s.size IS NOT DISTINCT FROM m.size AND s.mtime IS NOT DISTINCT FROM m.mtime) OR coalesce(s.content_hash = m.content_hash, false) THEN 'unchanged' ELSE 'modified' END AS change
        FROM {scan} s FULL JOIN {old} m ON s.path = m.path)"""


def chunked(pages: str, size: int, overlap: int) -> str:
    step = size - overlap
    gap = f"regexp_replace(e, {q(f'^[{T.SPACE}]+')}, '')"
    el = f"[{T.SPACE}]*[^{T.SPACE}]+"
    return f"""(WITH p0 AS (SELECT doc_id, page, {clean("text")} AS t FROM {pages} WHERE text IS NOT NULL), p1 AS (SELECT doc_id, page, regexp_extract_all(t, {q(el)}) AS el FROM p0 WHERE {textual("t")}),
        p2 AS (SELECT *, CASE WHEN len(el) <= {size} THEN 1 ELSE 1 + CAST(ceil((len(el) - {size}) / {step}.0) AS INT) END AS n FROM p1 WHERE len(el) > 0),
        p3 AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY page NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM p2),
        p4 AS (SELECT *, unnest(range(0, n)) AS o FROM p3)
        SELECT doc_id, page, CAST(b + o AS INT) AS ordinal, array_to_string(list_transform(el[o * {step} + 1 : o * {step} + {size}], lambda e: {gap}), ' ') AS text,
        CAST(length(array_to_string(el[1 : o * {step}], '')) + length(el[o * {step} + 1]) - length(list_transform([el[o * {step} + 1]], lambda e: {gap})[1]) AS INT) AS "offset" FROM p4)"""


def fields() -> str:
    one = lambda f, c: f"SELECT passage_id, '{f}' AS field, {terms(c)} AS terms FROM p"
    return f"p AS (SELECT DISTINCT passage_id, text, path FROM passages), f0 AS ({one('contents', 'coalesce(text, chr(32))')} UNION ALL {one('filename', spaced(base('path')))} UNION ALL {one('pathtext', spaced('path'))}), f AS (SELECT *, len(terms) AS dl FROM f0 WHERE len(terms) > 0)"


def stem_cte(src: str) -> str:
    """``voc(term, stem)`` of the terms of ``src``."""
    out = f"v0 AS (SELECT term, regexp_replace(regexp_replace(term, '^y', 'Y'), '([aeiou])y', '\\1Y', 'g') AS w FROM (SELECT DISTINCT term FROM {src}))"
    steps = porter.steps("regexp_matches({0}, '{1}')")
    for i, e in enumerate(steps):
        out += f", v{i + 1} AS (SELECT term, {e} AS w FROM v{i})"
    return out + f", voc AS (SELECT term, CASE WHEN length(term) > 2 THEN w ELSE term END AS stem FROM v{len(steps)})"


NORM = "CASE WHEN dl < 40 THEN dl::DOUBLE ELSE 24 + floor((dl - 24) / pow(2.0, greatest(0, floor(log2(greatest(dl - 24, 1)::DOUBLE)) - 3))) * pow(2.0, greatest(0, floor(log2(greatest(dl - 24, 1)::DOUBLE)) - 3)) END"


def scoring(qt: str, boosts: dict, k: int, tok: str, out: str = "hits") -> str:
    """CTEs from ``{tok}(passage_id, field, term, dl)`` and ``{qt}(query_id, term, qtf)`` to ``{out}``."""
    b = " ".join(f"WHEN '{f}' THEN {float(v)}::DOUBLE" for f, v in boosts.items())
    o = out
    return f"""{o}_post AS (SELECT passage_id, field, term, dl, count(*) AS tf FROM {tok} WHERE field IN ({", ".join(q(f) for f in boosts)}) AND term IN (SELECT term FROM {qt}) GROUP BY ALL),
        {o}_df AS (SELECT field, term, count(*) AS df FROM {o}_post GROUP BY ALL), {o}_fs AS (SELECT field, count(*) AS nd, sum(dl) / count(*) AS avgdl FROM f GROUP BY field),
        {o}_s AS (SELECT q.query_id, p.passage_id, round(sum((CASE p.field {b} END) * q.qtf * ln(1 + (s.nd - d.df + 0.5::DOUBLE) / (d.df + 0.5::DOUBLE)) * p.tf / (p.tf + 0.9::DOUBLE * (1 - 0.4::DOUBLE + 0.4::DOUBLE * ({NORM}) / s.avgdl))), 6) AS score
        FROM {o}_post p JOIN {o}_df d USING (field, term) JOIN {o}_fs s USING (field) JOIN {qt} q ON q.term = p.term GROUP BY ALL),
        {o} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank FROM {o}_s) WHERE rank <= {k})"""


QT = f"qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({terms('coalesce(query, chr(32))')}) AS term FROM queries) GROUP BY ALL)"
TOK = "tok AS (SELECT passage_id, field, dl, unnest(terms) AS term FROM f)"
BOOSTS = CONF.sparse.field_boosts
SPARSE = f"{fields()}, {TOK}, {QT}, {scoring('qt', BOOSTS, 10, 'tok')}"
POOLED = f"{fields()}, {TOK}, {QT}, {scoring('qt', BOOSTS, 20, 'tok')}"
PRF = f"""{SPARSE}, tot AS (SELECT query_id, sum(score) AS total FROM hits GROUP BY 1), seed AS (SELECT query_id, passage_id, score / CASE WHEN total = 0 THEN 1 ELSE total END AS w FROM hits JOIN tot USING (query_id)),
    tf AS (SELECT s.query_id, s.passage_id, s.w, t.dl, t.term, count(*) AS tf FROM tok t JOIN seed s USING (passage_id) WHERE t.field = 'contents' GROUP BY ALL),
    rm AS (SELECT query_id, term, round(sum(w * tf / dl), 9) AS rm FROM tf GROUP BY ALL),
    own AS (SELECT DISTINCT query_id, unnest({words("coalesce(query, '')")}) AS term FROM queries),
    rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rm DESC, term) AS r FROM rm ANTI JOIN own USING (query_id, term) WHERE length(term) >= 2 AND regexp_matches(term, '[\\p{{L}}\\p{{N}}]') AND term NOT IN ({", ".join(map(q, STOPWORDS))})),
    cdf AS (SELECT term, count(DISTINCT passage_id) AS df FROM tok WHERE field = 'contents' AND term IN (SELECT term FROM rk WHERE r <= 50) GROUP BY 1),
    sc AS (SELECT query_id, term, r, round(rm * ln(((SELECT count(*) FROM f WHERE field = 'contents') + 1) / (df + 0.5::DOUBLE)), 9) AS weight FROM rk JOIN cdf USING (term) WHERE r <= 50),
    ex AS (SELECT query_id, term, weight FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, r) AS k FROM sc) WHERE k <= 10)"""
HASHED = f"""hb AS (SELECT passage_id, CAST('0x' || substr(md5(w), 1, 2) AS INT) AS bucket, count(*) AS n FROM (SELECT passage_id, unnest({words("text")}) AS w FROM (SELECT DISTINCT passage_id, text FROM passages)) GROUP BY ALL),
    hv AS (SELECT passage_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY passage_id)) AS weight FROM hb)"""
DENSE = f"""{HASHED}, qb AS (SELECT query_id, CAST('0x' || substr(md5(w), 1, 2) AS INT) AS bucket, count(*) AS n FROM (SELECT query_id, unnest({words("query")}) AS w FROM queries) GROUP BY ALL),
    qv AS (SELECT query_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY query_id)) AS qw FROM qb), ds AS (SELECT query_id, passage_id, round(sum(weight * qw), 6) AS score FROM hv JOIN qv USING (bucket) GROUP BY ALL),
    near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank FROM ds) WHERE rank <= 10)"""
DENSE20 = DENSE.replace("rank <= 10", "rank <= 20")
ANC = f"anc AS (SELECT path, unnest(list_transform(range(0, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) AS folder FROM {PATHS})"
FOLD = f"""{ANC}, fo AS (SELECT DISTINCT folder FROM anc UNION SELECT ''), own AS (SELECT {parent("path")} AS folder, count(*) AS n FROM {PATHS} GROUP BY 1), sub AS (SELECT {parent("folder")} AS folder, count(*) AS n FROM fo WHERE folder <> '' GROUP BY 1),
    tree AS (SELECT folder, {parent("folder")} AS parent, coalesce(own.n, 0) AS n_files, coalesce(sub.n, 0) AS n_subfolders FROM fo LEFT JOIN own USING (folder) LEFT JOIN sub USING (folder))"""
FTOK = f"""ft AS (SELECT DISTINCT folder, 'name' AS kind, unnest({name_tokens(stem_name("folder"))}) AS token FROM fo WHERE folder <> '' UNION SELECT DISTINCT {parent("path")}, 'file', unnest({name_tokens(stem_name("path"))}) FROM {PATHS}),
    qtk AS (SELECT DISTINCT query_id, unnest({name_tokens("coalesce(query, '')")}) AS token FROM queries), fs AS (SELECT query_id, folder, sum(CASE WHEN kind = 'name' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END) AS score FROM ft JOIN qtk USING (token) GROUP BY ALL),
    seeds AS (SELECT query_id, folder, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, folder) AS r FROM fs) WHERE r <= 5),
    nb AS (SELECT folder AS a, parent AS b FROM tree WHERE parent IS NOT NULL UNION SELECT parent, folder FROM tree WHERE parent IS NOT NULL UNION SELECT x.folder, y.folder FROM tree x JOIN tree y ON x.parent = y.parent AND x.folder <> y.folder)"""


def hop(src: str, out: str, decay: float, edges: str = "nb", node: str = "folder") -> str:
    return f"{out} AS (SELECT query_id, {node}, max(score) AS score FROM (SELECT query_id, {node}, score FROM {src} UNION ALL SELECT query_id, {edges}.b, score * {decay}::DOUBLE FROM {src} JOIN {edges} ON {edges}.a = {src}.{node}) GROUP BY ALL)"


GRAPH = f"""{FOLD}, {FTOK}, {hop("seeds", "h1", 0.5)}, rf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, folder) AS fr FROM h1) WHERE fr <= 5),
    gq AS (SELECT query_id, list(token) AS qt FROM qtk GROUP BY 1), gh AS (SELECT query_id, path, fr, score, len(list_intersect(list_distinct({name_tokens(base("path"))}), qt)) AS ov, {dfs("path")} AS key FROM anc JOIN rf USING (folder) JOIN gq USING (query_id)),
    g1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY fr, ov DESC, key) AS pr FROM gh), g2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fr, ov DESC, key) AS rank FROM g1 WHERE pr = 1), graph AS (SELECT * FROM g2 WHERE rank <= 10)"""
GRAPH20 = GRAPH.replace("rank <= 10", "rank <= 20")
SL = "sl AS (SELECT DISTINCT query_id, rank, doc_id, passage_id, score FROM hits JOIN (SELECT DISTINCT passage_id, doc_id FROM passages) USING (passage_id)), dl_ AS (SELECT query_id, rank, doc_id, passage_id, score FROM near JOIN (SELECT DISTINCT passage_id, doc_id FROM passages) USING (passage_id))"


def rrf(lists: dict[str, str]) -> str:
    rows = " UNION ALL ".join(f"SELECT query_id, doc_id, passage_id, rank, score::DOUBLE AS own, {i} AS list, '{n}' AS source FROM {t}" for i, (n, t) in enumerate(lists.items()))
    return f"""rr AS ({rows}), fu AS (SELECT query_id, doc_id, passage_id, round(sum(1 / (60.0::DOUBLE + rank - 1)), 9) AS score, arg_max(source, (own, -list)) AS source, min((list, rank)) AS first FROM rr GROUP BY ALL)
        SELECT query_id, doc_id, passage_id, score, source, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, passage_id) AS rank FROM fu) WHERE rank <= 10"""


def glob_match(c: str, patterns) -> str:
    return f"regexp_matches({c}, {q('|'.join(globs.regex(g) for g in patterns))})"


_TYPES = ", ".join(q(t) for t in TEXT_TYPES)
KIND = f"CASE WHEN {ext('path')} IN ({_TYPES}) THEN 'text' WHEN {ext('path')} IN ('pdf', 'docx', 'pptx', 'xlsx') THEN {ext('path')} ELSE 'name only' END"
MD = """m0 AS (SELECT path, page, ordinal, coalesce(min(text), '') AS text FROM passages WHERE lower(path) LIKE '%.md' GROUP BY ALL),
    m1 AS (SELECT *, row_number() OVER (PARTITION BY path, page ORDER BY ordinal) AS nth FROM m0),
    m2 AS (SELECT path, ordinal, CASE WHEN nth = 1 THEN text ELSE array_to_string(string_split(text, ' ')[65:], ' ') END AS t FROM m1),
    md AS (SELECT path, string_agg(t, ' ' ORDER BY ordinal, t) AS text FROM m2 GROUP BY 1)"""
UP = f"up AS (SELECT path AS a, CASE WHEN {parent('path')} = '' THEN '_root' ELSE {parent('path')} END || '.md' AS b FROM md), nb AS (SELECT a, b FROM up UNION SELECT b, a FROM up)"
LINKS = f"""{FOLD}, up AS (SELECT CASE WHEN folder = '' THEN '_root' ELSE folder END AS f, CASE WHEN parent = '' THEN '_root' ELSE parent END AS p FROM tree WHERE parent IS NOT NULL),
    li AS (SELECT f || '.md' AS src, translate(p, '[]', '()') || '.md' AS dst FROM up UNION SELECT p || '.md', translate(f, '[]', '()') || '.md' FROM up)"""


def snip(text: str, query: str) -> str:
    at = f"coalesce(list_filter(list_transform({words(query)}, lambda w: strpos(lower({text}), w)), lambda p: p > 0)[1], 1)"
    return f"trim(regexp_replace(substr({text}, greatest(1, {at} - 60), 240), {q(f'[{T.SPACE}]+')}, ' ', 'g'))"


BODY = "regexp_replace(coalesce(text, ''), '(?s)\\A---\\n.*?\\n---\\n', '')"
SEEDS = f"""bo AS (SELECT path, {BODY} AS body FROM md), qw AS (SELECT DISTINCT query_id, unnest({words("coalesce(query, '')")}) AS w FROM queries),
    ws AS (SELECT path, unnest({words(spaced("path") + " || ' ' || body")}) AS w FROM bo), hi AS (SELECT query_id, path, count(DISTINCT w) AS nw, count(*) AS n FROM ws JOIN qw USING (w) GROUP BY ALL),
    s0 AS (SELECT query_id, path AS node, 1.0::DOUBLE / r AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY nw DESC, n DESC, path) AS r FROM hi) WHERE r <= 10)"""


TERM_STATS = f"WITH {fields()}, {TOK}, po AS (SELECT field, term, passage_id, dl, count(*) AS tf FROM tok GROUP BY ALL) SELECT field, term, count(*) AS df, sum(tf)::BIGINT AS ttf FROM po GROUP BY ALL"
PARTS = f"WITH {HASHED} SELECT passage_id, bucket, round(weight, 6) AS weight FROM hv"

ORACLES: dict[str, str] = {
    "walk_extract": """SELECT DISTINCT doc_id || '.txt' AS path, strlen(text) AS size, sha256(text) AS content_hash, NULL::INT AS page,
        CASE WHEN length(regexp_replace(text, '[\\s\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]', '', 'g')) > 0 THEN text END AS text FROM documents WHERE text IS NOT NULL""",
    "vectors_build": PARTS,
    "vectors_update": PARTS,
    "embed_cache_put": "SELECT DISTINCT sha1('hash-256' || chr(0) || text) AS key, 'hash-256' AS model, 256 AS dim, 256 AS n FROM passages WHERE text IS NOT NULL",
    "folder_contents": f"SELECT {parent('path')} AS folder, 'file' AS kind, path AS item FROM {PATHS} UNION ALL SELECT {parent('folder')}, 'subfolder', folder FROM (WITH {FOLD} SELECT folder FROM fo WHERE folder <> '')",
    "manifest_current": f"SELECT * FROM {latest()}",
    "files_scan": f"SELECT path, {base('path')} AS filename, {ext('path')} AS ext, size, mtime FROM {latest()}",
    "include_exclude_filter": f"SELECT path, {glob_match('path', CONF.include)} AND NOT {glob_match('path', CONF.exclude)} AND NOT regexp_matches(path, '(^|/)\\.git(/|$)') AS kept FROM {PATHS}",
    "extract_dispatch": f"SELECT path, {KIND} AS extractor FROM {PATHS}",
    "content_hash": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "clean_text": f"SELECT path, page, {clean('text')} AS text FROM (SELECT DISTINCT * FROM extracted_pages)",
    "textual_ratio": f"SELECT doc_id, coalesce({textual('t')}, false) AS textual FROM (SELECT doc_id, {clean('text')} AS t FROM documents)",
    "chunk_passages": f"SELECT doc_id || '#' || ordinal AS passage_id, ordinal, \"offset\", text FROM {chunked('(SELECT doc_id, NULL::INT AS page, text FROM documents)', 512, 64)}",
    "chunk_pages": f"SELECT doc_id, page, count(*) AS windows, min(\"offset\") AS first, max(\"offset\") AS last FROM {chunked('(SELECT DISTINCT path AS doc_id, page, text FROM extracted_pages)', 64, 16)} GROUP BY ALL",
    "stub_passages": f"SELECT path || '#0' AS passage_id, path, {spaced('path')} AS text FROM {PATHS} WHERE {KIND} = 'name only'",
    "path_fields": f"SELECT path, {spaced(base('path'))} AS filename, {spaced('path')} AS pathtext FROM {PATHS}",
    "tokenize": f"SELECT word, count(*) AS n, count(DISTINCT passage_id) AS passages FROM (SELECT passage_id, unnest({words('text')}) AS word FROM {PASS}) GROUP BY 1",
    "analyze_terms": f"SELECT term, count(*) AS n FROM (SELECT unnest({terms('text')}) AS term FROM {PASS}) GROUP BY 1",
    "analyze_terms_en": f"""WITH a AS (SELECT text FROM {PASS} WHERE text IS NOT NULL), la AS (SELECT unnest(regexp_extract_all(lower(regexp_replace(text, {q(f'[{T.CJK}]+')}, ' ', 'g')), {q(T.TERM)})) AS term FROM a),
        lb AS (SELECT regexp_replace(term, '[''’]s$', '') AS term FROM la),
        t AS (SELECT term, count(*) AS n FROM (SELECT term FROM lb WHERE term <> '' AND term NOT IN ({", ".join(map(q, "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()))}) UNION ALL SELECT unnest(regexp_extract_all(text, {q(f'[{T.CJK}]')})) FROM a) GROUP BY 1),
        {stem_cte('t')} SELECT stem, sum(n)::BIGINT AS n FROM t JOIN voc USING (term) GROUP BY 1""",
    "analyze_stems": f"WITH t AS (SELECT term, count(*) AS n FROM (SELECT unnest({terms('text')}) AS term FROM {PASS}) GROUP BY 1), {stem_cte('t')} SELECT stem, sum(n)::BIGINT AS n, count(*) AS forms FROM t JOIN voc USING (term) GROUP BY 1",
    "cjk_bigrams": f"SELECT bigram, count(*) AS n FROM (SELECT unnest(CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END) AS bigram FROM (SELECT unnest(regexp_extract_all(text, {q(f'[{T.CJK}]+')})) AS r FROM {PASS})) GROUP BY 1",
    "index_build": TERM_STATS,
    "index_update": TERM_STATS,
    "postings": f"WITH {fields()}, {TOK} SELECT field, term, passage_id, dl, count(*)::INT AS tf FROM tok GROUP BY ALL",
    "term_stats": TERM_STATS,
    "field_stats": f"WITH {fields()} SELECT field, count(*) AS n_docs, sum(dl)::BIGINT AS sum_ttf FROM f GROUP BY 1",
    "bm25_contents": f"WITH {fields()}, {TOK}, {QT}, {scoring('qt', {'contents': 1.0}, 10, 'tok')} SELECT query_id, rank, passage_id, score FROM hits",
    "bm25_multifield": f"WITH {SPARSE} SELECT query_id, rank, passage_id, score FROM hits",
    "bm25_stemmed": f"WITH {fields()}, {TOK}, {QT}, al AS (SELECT term FROM tok UNION SELECT term FROM qt), {stem_cte('al')}, tok2 AS (SELECT passage_id, field, dl, stem AS term FROM tok JOIN voc USING (term)), qt2 AS (SELECT query_id, stem AS term, sum(qtf) AS qtf FROM qt JOIN voc USING (term) GROUP BY ALL), {scoring('qt2', BOOSTS, 10, 'tok2')} SELECT query_id, rank, passage_id, score FROM hits",
    "prf_terms": f"WITH {PRF} SELECT query_id, term, round(weight, 6) AS weight FROM ex",
    "bm25_prf": f"WITH {PRF}, qx AS (SELECT query_id, term, sum(qtf) AS qtf FROM (SELECT query_id, term, qtf * 2 AS qtf FROM qt UNION ALL SELECT query_id, unnest({terms('term')}), 1 FROM ex) GROUP BY ALL), {scoring('qx', BOOSTS, 10, 'tok', 'again')} SELECT query_id, rank, passage_id, score FROM again",
    "hash_embed": f"WITH {HASHED} SELECT passage_id, bucket, round(weight, 6) AS weight FROM hv",
    "hash_dense_search": f"WITH {DENSE} SELECT query_id, rank, passage_id, score FROM near",
    "dense_topk": "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a, v b WHERE a.vec_id % 100 = 0) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10",
    "embed_cache_keys": "SELECT DISTINCT passage_id, sha1('hash-64' || chr(0) || text) AS key FROM passages WHERE text IS NOT NULL",
    "embed_cache_hits": "SELECT DISTINCT passage_id, sha1('hash-64' || chr(0) || text) AS key, sha1('hash-64' || chr(0) || text) IN (SELECT key FROM emb WHERE model = 'hash-64' AND key IS NOT NULL) AS hit FROM passages WHERE text IS NOT NULL",
    "folder_tree": f"WITH {FOLD} SELECT * FROM tree",
    "folder_tokens": f"WITH {FOLD}, {FTOK} SELECT * FROM ft",
    "folder_scores": f"WITH {FOLD}, {FTOK} SELECT * FROM fs",
    "folder_neighbors": f"WITH {FOLD}, {FTOK} SELECT folder, coalesce(n, 0) AS n_neighbours FROM tree LEFT JOIN (SELECT a, count(*) AS n FROM nb GROUP BY 1) ON a = folder",
    "folder_subtree_files": f"WITH {ANC} SELECT folder, count(*) AS files, min({dfs('path')}) AS first_key FROM anc GROUP BY 1",
    "graph_hop_expand": f"WITH {FOLD}, {FTOK}, {hop('seeds', 'h1', 0.5)}, {hop('h1', 'h2', 0.5)} SELECT query_id, folder, score FROM h2",
    "graph_search": f"WITH {GRAPH} SELECT query_id, rank, path, path || '#0' AS passage_id, score, 'co-located in folder \"' || CASE WHEN {parent('path')} = '' THEN '/' ELSE {parent('path')} END || '\" (metadata graph match)' AS snippet FROM graph",
    "kb_links": f"WITH {LINKS} SELECT src, dst FROM li UNION SELECT dst, src FROM li",
    "kb_expand": f"WITH {MD}, {UP}, {SEEDS}, {hop('s0', 'k1', 0.4, node='node')}, {hop('k1', 'k2', 0.4, node='node')} SELECT query_id, node, round(score, 6) AS score FROM k2",
    "kb_snippet": f"WITH {MD} SELECT path, {snip('b', q('the committee versiegelten 2023'))} AS snippet FROM (SELECT path, {BODY} AS b FROM md)",
    "kb_search": f"""WITH {MD}, {UP}, {SEEDS}, {hop("s0", "k1", 0.4, node="node")},
        be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, node) AS rank FROM k1) WHERE rank <= 10)
        SELECT query_id, rank, node AS path, round(score, 6) AS score, coalesce(nullif({snip("b", "qr")}, ''), {stem_name("node")}) AS snippet FROM (SELECT be.*, coalesce(body, '') AS b, coalesce(query, '') AS qr FROM be LEFT JOIN bo ON node = path JOIN queries USING (query_id))""",
    "highlight": f"SELECT DISTINCT passage_id, regexp_replace(substr(text, 1, 240), '(?i)(The|committee|\\(GARDEN\\))', '<mark>\\1</mark>', 'g') AS marked FROM {PASS} WHERE text IS NOT NULL",
    "rrf_fusion": f"WITH {POOLED}, {DENSE20}, {SL}, {rrf({'sparse': 'sl', 'dense': 'dl_'})}",
    "hybrid_search": f"WITH {POOLED}, {DENSE20}, {SL}, {GRAPH20.replace(' own AS', ' fown AS').replace('JOIN own ', 'JOIN fown ').replace('own.n,', 'fown.n,').replace(' fs AS', ' gfs AS').replace('FROM fs)', 'FROM gfs)')}, gl AS (SELECT query_id, rank, path AS doc_id, path || '#0' AS passage_id, score FROM graph), {rrf({'sparse': 'sl', 'dense': 'dl_', 'graph': 'gl'})}",
    "result_metadata": f"WITH {SPARSE}, {DENSE}, {SL} SELECT query_id, rank, passage_id, sl.doc_id AS path, {base('sl.doc_id')} AS filename, {ext('sl.doc_id')} AS ext, '/data/' || sl.doc_id AS abs_path, size, mtime FROM sl LEFT JOIN {latest()} m ON m.path = sl.doc_id",
    "change_detection": f"SELECT * FROM {delta()}",
    "deleted_files": f"SELECT path FROM {delta(latest('indexed_version > 20'))} WHERE change = 'deleted'",
    "removed_passages": f"SELECT DISTINCT passage_id FROM passages WHERE path IN (SELECT path FROM {delta()} WHERE change IN ('modified', 'deleted'))",
    "incremental_apply": f"WITH d AS (SELECT * FROM {delta()}) SELECT * FROM {latest('indexed_version <= 20')} WHERE path NOT IN (SELECT path FROM d WHERE change <> 'unchanged') UNION ALL SELECT * FROM {latest()} WHERE path IN (SELECT path FROM d WHERE change IN ('added', 'modified'))",
    "index_report": "SELECT " + ", ".join(f"count(*) FILTER (WHERE change = '{c}') AS {c}" for c in ("added", "modified", "deleted", "unchanged")) + f" FROM {delta()}",
    "staleness": "SELECT count(*) FILTER (WHERE change <> 'unchanged') AS pending, " + ", ".join(f"count(*) FILTER (WHERE change = '{c}') AS pending_{c}" for c in ("added", "modified", "deleted")) + f", count(*) FILTER (WHERE change <> 'unchanged') > 0 AS stale FROM {delta()}",
    "index_stats": f"SELECT count(*) AS n_files, max(indexed_version) AS index_version, max(indexed_at) AS last_indexed_at, (SELECT count(DISTINCT passage_id) FROM passages) AS n_passages FROM {latest()}",
    "manifest_lookup": f"SELECT path, ordinal, passage_id, page, \"offset\" FROM {PASS} WHERE path IN (SELECT path FROM extracted_pages)",
    "vault_notes": f"""WITH {FOLD}, n AS (SELECT *, CASE WHEN folder = '' THEN '_root' ELSE folder END AS me, CASE WHEN parent = '' THEN '_root' ELSE parent END AS pa FROM tree),
        hd AS (SELECT me || '.md' AS note, ['---', 'type: folder', 'path: "' || folder || '"', 'files: ' || n_files, 'subfolders: ' || n_subfolders, '---', '', '# ' || CASE WHEN folder = '' THEN '/ (indexed root)' ELSE folder END, ''] AS ls FROM n)
        SELECT note, 0 AS section, lpad((i - 1)::VARCHAR, 2, '0') AS item, ls[i] AS line FROM hd, range(1, 10) t(i)
        UNION ALL SELECT me || '.md', 1, parent, '- [[' || translate(pa, '[]', '()') || ']]' FROM n WHERE parent IS NOT NULL
        UNION ALL SELECT pa || '.md', 2, folder, '- [[' || translate(me, '[]', '()') || ']]' FROM n WHERE parent IS NOT NULL
        UNION ALL SELECT CASE WHEN {parent("path")} = '' THEN '_root' ELSE {parent("path")} END || '.md', 3, {base("path")}, '- ' || translate({base("path")}, '[]', '()') FROM {PATHS}""",
}

"""SQL of chunking and retrieval, in pieces that the queries put together.

Each piece is a list of common table expressions. The greedy rules walk row by row in recursive
expressions, where the operators work on sorted streams and running sums.
"""

from __future__ import annotations

#: Documents once each.
PARSED = "p AS (SELECT DISTINCT doc_id, markdown FROM parsed_docs WHERE markdown IS NOT NULL)"

#: i(doc_id, item_idx, page, kind, level, text): the items of the documents p.
ITEMS = rf"""{PARSED},
il AS (SELECT doc_id, unnest(string_split(markdown, chr(10))) AS line, generate_subscripts(string_split(markdown, chr(10)), 1) - 1 AS pos FROM p),
ib AS (SELECT *, regexp_matches(line, '^\s*$') AS blank, regexp_matches(line, '^#{{1,6}} ') AS head FROM il),
ig AS (SELECT *, blank OR head OR coalesce(lag(blank OR head) OVER (PARTITION BY doc_id ORDER BY pos), true) AS opens FROM ib),
ir AS (SELECT doc_id, g, min(pos) AS pos, string_agg(line, chr(10) ORDER BY pos) AS raw FROM (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM ig) WHERE NOT blank GROUP BY doc_id, g),
i AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS item_idx, pos // 40 + 1 AS page, length(regexp_extract(raw, '^(#{{1,6}}) ', 1)) AS level,
    CASE WHEN regexp_matches(raw, '^#{{1,6}} ') THEN 'header' WHEN raw LIKE '|%' THEN 'table' WHEN regexp_matches(raw, '^\s*(?:[-*+]|\d{{1,3}}[.)])\s') THEN 'list' ELSE 'text' END AS kind,
    CASE WHEN regexp_matches(raw, '^#{{1,6}} ') THEN regexp_replace(raw, '^#{{1,6}} +', '') ELSE raw END AS text FROM ir)"""

#: n(…): the items i with prose normalised and lines that recur on most pages removed.
CLEAN_ITEMS = r"""nn AS (SELECT doc_id, item_idx, page, level, kind, CASE WHEN kind = 'table' THEN translate(text, '‖―‗', '"-_')
    ELSE regexp_replace(regexp_replace(regexp_replace(translate(text, '‖―‗', '"-_'), '([\pL\pN\pM_])-\n([\pL\pN\pM_])', '\1\2', 'g'), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g') END AS text FROM i),
nk AS (SELECT *, regexp_replace(lower(text), '\d+', '#', 'g') AS match_key FROM nn WHERE kind IN ('text', 'list')),
nd AS (SELECT doc_id, count(DISTINCT page) AS total FROM nk GROUP BY doc_id HAVING count(DISTINCT page) >= 4),
nb AS (SELECT doc_id, match_key FROM nk JOIN nd USING (doc_id) GROUP BY doc_id, match_key, total HAVING count(DISTINCT page) >= greatest(3, floor(total * 0.6)) AND length(match_key) < 120 AND match_key NOT LIKE '#%'),
n AS (SELECT nn.* FROM nn WHERE NOT EXISTS (SELECT 1 FROM nk JOIN nb USING (doc_id, match_key) WHERE nk.doc_id = nn.doc_id AND nk.item_idx = nn.item_idx))"""


def sections(items: str) -> str:
    """s(doc_id, section_idx, item_idx, page, kind, text, path): blocks of ``items`` with their section; headers are folded one by one."""
    rest = r"regexp_replace(text, '^\d{1,3}\.\s+', '')"
    return rf"""so AS (SELECT *, CASE WHEN kind IN ('text', 'list') AND regexp_matches(text, '^\d{{1,3}}\.\s+[A-Z]') THEN 'Rule ' || regexp_extract(text, '^(\d{{1,3}})\.', 1) || ': ' || trim(CASE WHEN instr({rest}, '.') - 1 BETWEEN 1 AND 150 THEN split_part({rest}, '.', 1) ELSE substr({rest}, 1, 100) END) END AS rule
    FROM {items} WHERE text <> '' AND NOT (kind IN ('text', 'list') AND regexp_matches(text, '\.{{4,}}\s*\d+\s*$'))),
sn AS (SELECT *, sum((kind = 'header')::INT) OVER (PARTITION BY doc_id ORDER BY item_idx) AS h, sum((kind = 'header' OR rule IS NOT NULL)::INT) OVER (PARTITION BY doc_id ORDER BY item_idx) AS raw FROM so),
sh AS (SELECT doc_id, 0::HUGEINT AS h, []::VARCHAR[] AS heads FROM (SELECT DISTINCT doc_id FROM sn)
    UNION ALL SELECT sn.doc_id, sn.h, list_append(sh.heads[:sn.level - 1], sn.text) FROM sh JOIN sn ON sn.doc_id = sh.doc_id AND sn.h = sh.h + 1 AND sn.kind = 'header'),
sr AS (SELECT sn.*, heads, first_value(rule) OVER (PARTITION BY sn.doc_id, raw ORDER BY item_idx) AS opener FROM sn JOIN sh ON sh.doc_id = sn.doc_id AND sh.h = sn.h),
s AS (SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY raw) - 1 AS section_idx, item_idx, page, kind, text, CASE WHEN opener IS NULL THEN heads ELSE list_append(heads, opener) END AS path FROM sr WHERE kind <> 'header')"""


#: b(doc_id, section_idx, block_idx, text, is_table, lo, hi): the table of blocks, once each.
BLOCKS = "b AS (SELECT DISTINCT doc_id, section_idx, block_idx, text, coalesce(is_table, false) AS is_table, list_min(pages) AS lo, list_max(pages) AS hi FROM blocks WHERE text IS NOT NULL)"

_TOK = "greatest(1, length({0}) // 4)"
#: c(doc_id, section_idx, group_idx, chunk_id, seq, text, token_count, element_type, page_start, page_end): children packed from b.
PACK = rf"""bt AS (SELECT *, {_TOK.format('text')} AS tok FROM b),
xs AS (SELECT doc_id, section_idx, block_idx, string_split(regexp_replace(text, '([.!?;])\s+([A-Z(\d])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS w FROM bt WHERE tok > 1024 AND NOT is_table),
xc AS (SELECT *, list_transform(w, lambda x: {_TOK.format('x')}) AS c FROM xs),
xf AS (SELECT doc_id, section_idx, block_idx, w, c, 1 AS i, 1 AS first, 0::BIGINT AS size, NULL::INT AS lo, NULL::INT AS hi FROM xc
    UNION ALL SELECT doc_id, section_idx, block_idx, w, c, i + 1,
        CASE WHEN over_ THEN again ELSE first END, c[i] + CASE WHEN over_ THEN coalesce(list_sum(c[greatest(first, again - 1):i - 1]), 0)::BIGINT ELSE size END, CASE WHEN over_ THEN first END, CASE WHEN over_ THEN i - 1 END
    FROM (SELECT *, i > 1 AND size + c[i] > 512 AS over_, coalesce(list_min(list_filter(range(first, i), lambda j: list_sum(c[j:i - 1]) <= 50)), i) AS again FROM xf WHERE i <= len(w))),
xe AS (SELECT doc_id, section_idx, block_idx, w, lo, hi FROM xf WHERE lo IS NOT NULL UNION ALL SELECT doc_id, section_idx, block_idx, w, first, len(w) FROM xf WHERE i = len(w) + 1),
tl AS (SELECT doc_id, section_idx, block_idx, string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10)) AS w, text FROM bt WHERE tok > 1024 AND is_table),
tf AS (SELECT doc_id, section_idx, block_idx, w, {_TOK.format("w[1] || chr(10) || w[2]")} AS base, 3 AS i, 0 AS part, 0::BIGINT AS size FROM tl WHERE len(w) >= 4
    UNION ALL SELECT doc_id, section_idx, block_idx, w, base, i + 1, part + over_::INT, {_TOK.format('w[i]')} + CASE WHEN over_ THEN base ELSE greatest(size, base) END
    FROM (SELECT *, size > 0 AND size + {_TOK.format('w[i]')} > 1024 AS over_ FROM tf WHERE i <= len(w))),
te AS (SELECT doc_id, section_idx, block_idx, part, any_value(w[1] || chr(10) || w[2]) || chr(10) || string_agg(w[i - 1], chr(10) ORDER BY i) AS text FROM tf WHERE i > 3 GROUP BY ALL),
pc AS (SELECT doc_id, section_idx, block_idx, 0 AS part, text, false AS alone FROM bt WHERE tok <= 1024
    UNION ALL SELECT doc_id, section_idx, block_idx, lo, array_to_string(w[lo:hi], ' '), false FROM xe
    UNION ALL SELECT doc_id, section_idx, block_idx, part, text, true FROM te
    UNION ALL SELECT doc_id, section_idx, block_idx, 0, text, true FROM tl WHERE len(w) < 4),
po AS (SELECT pc.*, is_table, lo, hi, {_TOK.format('pc.text')} AS tok, row_number() OVER (PARTITION BY doc_id, section_idx ORDER BY block_idx, part) AS o FROM pc JOIN b USING (doc_id, section_idx, block_idx)),
pg AS (SELECT doc_id, section_idx, o, 0 AS g, tok AS size, NOT alone AS open FROM po WHERE o = 1
    UNION ALL SELECT po.doc_id, po.section_idx, po.o, g + fresh::INT, CASE WHEN fresh THEN po.tok ELSE size + po.tok END, NOT po.alone
    FROM (SELECT pg.*, po.alone OR NOT pg.open OR pg.size + po.tok > 512 AS fresh FROM pg JOIN po ON po.doc_id = pg.doc_id AND po.section_idx = pg.section_idx AND po.o = pg.o + 1) pg JOIN po ON po.doc_id = pg.doc_id AND po.section_idx = pg.section_idx AND po.o = pg.o + 1),
pl AS (SELECT doc_id, section_idx, max(g) AS last FROM pg GROUP BY ALL),
pt AS (SELECT doc_id, section_idx, last FROM pl JOIN pg USING (doc_id, section_idx) JOIN po USING (doc_id, section_idx, o) WHERE g = last AND last >= 1 GROUP BY ALL HAVING sum(tok) < 100),
pm AS (SELECT po.*, CASE WHEN g = pt.last THEN g - 1 ELSE g END AS g FROM po JOIN pg USING (doc_id, section_idx, o) LEFT JOIN pt USING (doc_id, section_idx)),
pa AS (SELECT doc_id, section_idx, g AS group_idx, string_agg(text, chr(10) || chr(10) ORDER BY o) AS text, bool_or(is_table) AS tab, min(lo) AS page_start, max(hi) AS page_end FROM pm GROUP BY ALL),
c AS (SELECT doc_id, section_idx, group_idx, substr(sha1(doc_id || ':' || section_idx || ':' || group_idx), 1, 16) AS chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY section_idx, group_idx) - 1 AS seq,
    text, {_TOK.format('text')} AS token_count, CASE WHEN tab THEN 'table' ELSE 'text' END AS element_type, page_start, page_end FROM pa)"""

#: u(doc_id, section_idx, parent_idx, parent_id, seq): the parent of every child of c.
PARENTS = """co AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section_idx ORDER BY seq) AS o FROM c),
cu AS (SELECT doc_id, section_idx, o, 0 AS parent_idx, token_count AS size FROM co WHERE o = 1
    UNION ALL SELECT co.doc_id, co.section_idx, co.o, parent_idx + (size + token_count > 2048)::INT, CASE WHEN size + token_count > 2048 THEN token_count ELSE size + token_count END FROM cu JOIN co ON co.doc_id = cu.doc_id AND co.section_idx = cu.section_idx AND co.o = cu.o + 1),
u AS (SELECT co.*, parent_idx, substr(sha1(co.doc_id || ':' || co.section_idx || ':p:' || parent_idx), 1, 16) AS parent_id FROM co JOIN cu USING (doc_id, section_idx, o))"""

_WORDS = r"regexp_extract_all(lower({0}), '[\pL\pN]+')"
#: found(query_id, chunk_id, score, rank): the questions among all children by tf-idf of words.
LEXICAL = rf"""q AS (SELECT DISTINCT ON (case_id) case_id AS query_id, question FROM eval_cases ORDER BY case_id, question), k AS (SELECT DISTINCT ON (chunk_id) * FROM chunks WHERE kind = 'child' ORDER BY chunk_id),
kt AS (SELECT chunk_id, token, count(*) AS tf FROM (SELECT chunk_id, unnest({_WORDS.format('text')}) AS token FROM k) GROUP BY ALL),
ki AS (SELECT token, ln((SELECT count(*) FROM k) / count(*)) AS idf FROM kt GROUP BY token),
kw AS (SELECT chunk_id, token, tf * idf AS w FROM kt JOIN ki USING (token)), kn AS (SELECT chunk_id, sqrt(sum(w * w)) AS n FROM kw GROUP BY chunk_id),
qt AS (SELECT query_id, token, count(*) AS tf FROM (SELECT query_id, unnest({_WORDS.format('question')}) AS token FROM q) GROUP BY ALL),
qw AS (SELECT query_id, token, tf * idf AS w FROM qt JOIN ki USING (token)), qn AS (SELECT query_id, sqrt(sum(w * w)) AS n FROM qw GROUP BY query_id),
hits AS (SELECT query_id, chunk_id, round(sum((qw.w / qn.n) * (kw.w / kn.n)), 6) AS score FROM qw JOIN qn USING (query_id) JOIN kw USING (token) JOIN kn USING (chunk_id) WHERE qn.n > 0 AND kn.n > 0 GROUP BY query_id, chunk_id),
found AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM hits WHERE score > 0 QUALIFY rank <= 15)"""

#: rr(query_id, chunk_id, rerank_score, rerank_rank): found by the share of the question's words that a chunk has.
RERANKED = rf"""{LEXICAL},
rs AS (SELECT query_id, chunk_id, rank, list_distinct({_WORDS.format('question')}) AS qw, {_WORDS.format('text')} AS kw FROM found JOIN q USING (query_id) JOIN k USING (chunk_id)),
rc AS (SELECT query_id, chunk_id, rank, round(len(list_filter(qw, lambda x: list_contains(kw, x)))::DOUBLE / greatest(1, len(qw)), 6) AS rerank_score FROM rs),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS rerank_rank FROM rc)"""

#: bb(query_id, block_key, block_no, score, matched_chunks, chunk_id, doc_id, text, page_start, page_end, section_path): context blocks within the budget.
CONTEXT = f"""{RERANKED},
bk AS (SELECT rr.*, k.parent_id, k.doc_id, k.text, k.section_path, k.page_start, k.page_end FROM rr JOIN k USING (chunk_id) WHERE rerank_score >= 0.15 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rerank_rank) <= 8),
bp AS (SELECT DISTINCT ON (chunk_id) chunk_id AS parent_id, text, section_path, page_start, page_end FROM chunks WHERE kind = 'parent' ORDER BY chunk_id),
bj AS (SELECT bk.*, CASE WHEN bp.parent_id IS NULL THEN bk.chunk_id ELSE bk.parent_id END AS block_key, CASE WHEN bp.parent_id IS NULL THEN struct_pack(t := bk.text, s := bk.section_path, a := bk.page_start, b := bk.page_end) ELSE struct_pack(t := bp.text, s := bp.section_path, a := bp.page_start, b := bp.page_end) END AS x FROM bk LEFT JOIN bp ON bp.parent_id = bk.parent_id),
bm AS (SELECT query_id, block_key, max(rerank_score) AS score, count(*) AS matched_chunks, min(rerank_rank) AS f, arg_min(struct_pack(c := chunk_id, d := doc_id, x := x), rerank_rank) AS y FROM bj GROUP BY query_id, block_key),
bo AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, f) AS o, greatest(1, length(y.x.t) // 4) AS tok FROM bm),
bf AS (SELECT query_id, o, block_key, tok AS used, true AS fits FROM bo WHERE o = 1
    UNION ALL SELECT bo.query_id, bo.o, bo.block_key, CASE WHEN used + tok <= 10000 THEN used + tok ELSE used END, used + tok <= 10000 FROM bf JOIN bo ON bo.query_id = bf.query_id AND bo.o = bf.o + 1),
bb AS (SELECT query_id, block_key, row_number() OVER (PARTITION BY query_id ORDER BY o) AS block_no, score, matched_chunks, y.c AS chunk_id, y.d AS doc_id, y.x.t AS text, y.x.a AS page_start, y.x.b AS page_end, y.x.s AS section_path FROM bo JOIN bf USING (query_id, o, block_key) WHERE fits)"""

SECTION_PATHS = f"WITH RECURSIVE {ITEMS}, {sections('i')} SELECT doc_id, section_idx, array_to_string(any_value(path), ' > ') AS path, count(*) AS n_blocks FROM s GROUP BY doc_id, section_idx"
PACKED_CHILDREN = f"WITH RECURSIVE {BLOCKS}, {PACK} SELECT doc_id, section_idx, chunk_id, seq, token_count, element_type, coalesce(page_start, -1) AS page_start, coalesce(page_end, -1) AS page_end, md5(text) AS text_md5 FROM c"
GROUPED_PARENTS = f"""WITH RECURSIVE {BLOCKS}, {PACK}, {PARENTS}
SELECT parent_id, doc_id, section_idx, count(*) AS children, sum(token_count)::BIGINT AS token_count, coalesce(arg_min_null(page_start, seq), -1) AS page_start, coalesce(arg_max_null(page_end, seq), -1) AS page_end, min(seq) AS seq FROM u GROUP BY doc_id, section_idx, parent_id"""
INGESTED_CHUNKS = f"""WITH RECURSIVE {ITEMS}, {CLEAN_ITEMS}, {sections('n')}, b AS (SELECT doc_id, section_idx, item_idx AS block_idx, text, kind = 'table' AS is_table, page AS lo, page AS hi FROM s), {PACK}, {PARENTS},
sp AS (SELECT doc_id, section_idx, any_value(path) AS path FROM s GROUP BY ALL), ti AS (SELECT doc_id, coalesce(max(title), '') AS title FROM parsed_docs GROUP BY doc_id)
SELECT chunk_id, doc_id, parent_id, seq, token_count, array_to_string(path, ' > ') AS path, md5(array_to_string(list_prepend(title, path), ' > ') || chr(10) || chr(10) || text) AS embed_md5 FROM u JOIN sp USING (doc_id, section_idx) JOIN ti USING (doc_id)"""
LEXICAL_SEARCH = f"WITH {LEXICAL} SELECT query_id, chunk_id, score, rank FROM found"
RERANKED_SEARCH = f"WITH {RERANKED} SELECT query_id, chunk_id, rerank_score, rerank_rank FROM rr"
RETRIEVAL_OUTCOME = f"WITH {RERANKED}, m AS (SELECT query_id, max(rerank_score) AS best FROM rr GROUP BY query_id) SELECT query_id, coalesce(best < 0.15, true) AS no_answer, coalesce(best, 0.0) AS top_score FROM q LEFT JOIN m USING (query_id)"
CONTEXT_BLOCKS = f"WITH RECURSIVE {CONTEXT} SELECT query_id, block_key, block_no, score, matched_chunks, coalesce(page_start, -1) AS page_start, coalesce(page_end, -1) AS page_end FROM bb"
_CONTEXT_TEXT = f"""{CONTEXT}, ti AS (SELECT doc_id, max(title) AS title FROM parsed_docs GROUP BY doc_id),
bc AS (SELECT query_id, block_no, '[' || block_no || '] ' || coalesce(title, '') || ' — ' || CASE WHEN len(section_path) > 0 THEN array_to_string(section_path, ' > ') ELSE coalesce(title, '') END || ' (' || CASE WHEN coalesce(page_start, 0) <> 0 THEN 'p.' || page_start ELSE '' END
    || CASE WHEN coalesce(page_end, 0) <> 0 AND page_end IS DISTINCT FROM page_start THEN '-' || page_end ELSE '' END || ')' || chr(10) || coalesce(text, '') AS t FROM bb LEFT JOIN ti USING (doc_id)),
cx AS (SELECT query_id, count(*) AS n_blocks, string_agg(t, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY block_no) AS context FROM bc GROUP BY query_id)"""
CONTEXTS = f"WITH RECURSIVE {_CONTEXT_TEXT} SELECT query_id, n_blocks, md5(context) AS context_md5 FROM cx"
PROMPTS = f"WITH RECURSIVE {_CONTEXT_TEXT} SELECT query_id, md5('Context:' || chr(10) || chr(10) || context || chr(10) || chr(10) || 'Question: ' || question) AS prompt_md5 FROM cx JOIN q USING (query_id)"
SOURCES = f"""WITH RECURSIVE {CONTEXT} SELECT query_id, block_no AS n, coalesce(array_to_string(section_path, ' > '), '') AS section, CASE WHEN coalesce(page_start, 0) <> 0 THEN 'p.' || page_start ELSE '' END
    || CASE WHEN coalesce(page_end, 0) <> 0 AND page_end IS DISTINCT FROM page_start THEN '-' || page_end ELSE '' END AS pages, round_even(score, 3) AS score, md5(substr(text, 1, 600)) AS snippet_md5 FROM bb"""
CASE_OUTCOMES = f"""WITH RECURSIVE {CONTEXT}, m AS (SELECT query_id, max(rerank_score) AS best FROM rr GROUP BY query_id), e AS (SELECT DISTINCT ON (case_id) * FROM eval_cases ORDER BY case_id),
h AS (SELECT case_id, min(block_no) AS rank FROM e JOIN bb ON bb.query_id = e.case_id WHERE len(list_filter(section_path, lambda x: x = expect_rule OR starts_with(x, expect_rule || ':'))) > 0 GROUP BY case_id)
SELECT case_id, CASE WHEN expect_rule IS NOT NULL AND NOT coalesce(expect_refusal, false) THEN h.rank IS NOT NULL END AS hit, CASE WHEN expect_rule IS NOT NULL AND NOT coalesce(expect_refusal, false) THEN coalesce(h.rank, 0) ELSE 0 END AS rank,
CASE WHEN expect_refusal THEN coalesce(best < 0.15, true) END AS refusal_correct, coalesce(best, 0.0) AS top_score FROM e LEFT JOIN m ON m.query_id = e.case_id LEFT JOIN h USING (case_id)"""

"""DuckDB SQL for the corpus queries that SQL can express on whole tables."""

from __future__ import annotations

from weftline.llm import chat, licenses, mixing, urls


def text_literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def license_sql() -> str:
    entries = licenses.template_entries()
    telling = licenses.telling_places(entries)
    rows = ",\n".join(f"({i}, {p}, {text_literal(w[p])}, {text_literal(w[p + 1])}, {len(w)}, {len(places)}, {telling[i].get(p, 0)}, {len(set(telling[i].values()))}, {text_literal(label)}, {base})" for i, (label, w, base, places) in enumerate(entries) for p in places)
    return rf"""
WITH known(template, place, a, b, length, pairs, tells, telling, label, base) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT r, unnest(range(len(w) - 1)) AS pos, w FROM d WHERE len(w) > 1),
hits AS (SELECT r, template, label, base, length, pairs, tells, telling, pos, place FROM (SELECT r, pos, w[pos + 1] AS a, w[pos + 2] AS b FROM g) JOIN known USING (a, b)),
lanes AS (SELECT *, CASE WHEN phase < 0 THEN pos - place ELSE floor((pos - place + phase * 8)::double / 16)::bigint END AS band
  FROM (SELECT *, unnest(CASE WHEN base THEN [-1] ELSE [0, 1] END) AS phase FROM hits)),
marked AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY r, template, phase, band ORDER BY pos, place) > 8 THEN 1 ELSE 0 END AS fresh FROM lanes),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY r, template, phase, band ORDER BY pos, place ROWS UNBOUNDED PRECEDING) AS run FROM marked),
copies AS (SELECT *, row_number() OVER (PARTITION BY r, template, phase, band, run, place ORDER BY pos) AS copy FROM runs),
all_spans AS (SELECT r, template, label, base, length, pairs, telling, count(DISTINCT tells) FILTER (tells > 0) AS told, count(*) AS votes, min(pos) AS s, max(pos) + 2 AS e FROM copies GROUP BY r, template, label, base, length, pairs, telling, phase, band, run, copy),
spans AS (SELECT *, votes::double / pairs AS cover FROM all_spans WHERE CASE WHEN base THEN votes = pairs ELSE votes >= 0.75 * pairs AND told = telling AND length >= 5 AND e - s <= 2 * length END),
found_spans AS (SELECT * FROM spans x WHERE base OR NOT EXISTS (SELECT 1 FROM spans o WHERE o.r = x.r AND NOT o.base AND o.label <> x.label
  AND 2 * (least(x.e, o.e) - greatest(x.s, o.s)) >= least(x.e - x.s, o.e - o.s) AND (o.votes > x.votes OR (o.votes = x.votes AND (o.cover > x.cover OR (o.cover = x.cover AND o.label > x.label)))))),
found AS (SELECT r, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, round(max(cover), 6) AS score FROM found_spans GROUP BY r)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_base, 0)::bigint AS n_base, first_word::bigint AS first_word, last_word::bigint AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::double AS score
FROM d LEFT JOIN found USING (r)"""


def mix_sql() -> str:
    w, b, half, block = mixing.WEIGHTS, mixing.BITS, 1 << (mixing.BITS // 2), 1024
    return rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint AS size, md5(concat_ws('|', coalesce(doc_id::varchar, ''), coalesce(source, ''), coalesce(text, ''))) AS place FROM documents),
s AS (SELECT source, sum(size)::bigint AS source_size, ([{', '.join(map(str, w))}])[((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % {len(w)}) + 1] AS weight FROM d GROUP BY source),
c AS (SELECT *, 2 * source_size AS cap, (2 * source_size)::double / weight AS ratio FROM s),
l AS (SELECT *, (sum(source_size) OVER ()::double * 1.5 - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::double) / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::double AS line
  FROM c WINDOW o AS (ORDER BY ratio, encode(source) NULLS LAST)),
water AS (SELECT arg_min(line, ratio) AS line FROM l WHERE line <= ratio),
t AS (SELECT l.source, source_size, CASE WHEN water.line IS NULL OR water.line * weight > cap THEN cap::double ELSE water.line * weight END AS target FROM l, water),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS start FROM d),
w AS (SELECT source, floor(target)::bigint AS want, (floor(target)::bigint + {block} - 1) // {block} AS slots FROM t WHERE target >= 1),
n AS (SELECT coalesce(sum(slots), 0)::bigint AS n FROM w),
i AS (SELECT w.source, want, slots, floor((sum(slots) OVER o - slots)::double / n * {1 << b}::double)::bigint AS low, floor((sum(slots) OVER o)::double / n * {1 << b}::double)::bigint AS high FROM w, n WINDOW o AS (ORDER BY encode(w.source) NULLS LAST)),
q AS (SELECT slot, ((((slot + 1) & {half - 1}) * {mixing.GOLDEN} + ((((slot + 1) >> {b // 2}) * {mixing.GOLDEN}) % {half}) * {half}) % {1 << b})::bigint AS point FROM (SELECT unnest(range(2 * n + 16)) AS slot FROM n)),
h AS (SELECT source, want, slots, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM q JOIN i ON point >= low AND point < high QUALIFY rank < slots),
x AS (SELECT r, doc_id, p.source, size, source_size, target, start + pass * source_size AS f FROM (SELECT *, row_number() OVER () AS r FROM p) p JOIN t ON p.source IS NOT DISTINCT FROM t.source, (VALUES (0), (1)) v(pass)),
k AS (SELECT r, sum(least(f + size, (rank + 1) * {block}, want) - greatest(f, rank * {block})) AS taken, min(slot) AS first_slot
  FROM x JOIN h ON x.source IS NOT DISTINCT FROM h.source AND rank >= f // {block} AND rank * {block} < f + size AND f < want AND size > 0 WHERE rank * {block} < want GROUP BY r)
SELECT doc_id, source, size, source_size, target, coalesce(taken, 0)::bigint AS taken, first_slot::bigint AS first_slot
FROM (SELECT DISTINCT r, doc_id, source, size, source_size, target FROM x) LEFT JOIN k USING (r)"""


def url_sql(depth: int = urls.DEPTH, max_siblings: int = 12, min_share: float = 0.05, m: float = 5.0, reject_at: float = 0.8, z: float = 2.0) -> str:
    fits = []
    for verdict, rule in sorted(urls.RULES, key=lambda x: -len(x[1])):
        suffix, _, prefix = rule.partition("/")
        fits.append((f"(host = '{suffix}' OR ends_with(host, '.{suffix}')) AND starts_with(path, '/{prefix}')", rule, verdict))
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in fits) + " END"
    seeds = "|".join(urls.SEED_WORDS)
    levels = [f"t0 AS (SELECT *, string_split(shape, '/') AS seg, '' AS template FROM shapes)"]
    for i in range(1, depth + 1):
        levels.append(f"k{i} AS (SELECT host, template, seg[{i + 1}] AS s, sum(n) AS cn, count(*) OVER o AS kids, sum(sum(n)) OVER o AS total FROM t{i - 1} WHERE len(seg) > {i} GROUP BY host, template, seg[{i + 1}] WINDOW o AS (PARTITION BY host, template))")
        levels.append(f"t{i} AS (SELECT a.* EXCLUDE (template), a.template || CASE WHEN len(seg) <= {i} THEN '' WHEN kids > {max_siblings} AND cn < {min_share}::double * total THEN '/*' ELSE '/' || seg[{i + 1}] END AS template FROM t{i - 1} a LEFT JOIN k{i} b ON a.host = b.host AND a.template = b.template AND seg[{i + 1}] = b.s)")
    return rf"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rows_ AS (SELECT *, {rule} AS rule, {verdict} AS by_rule, regexp_replace(path, '[0-9]+', '#', 'g') AS shape FROM h),
labels_ AS (SELECT *, CASE WHEN by_rule IS NOT NULL THEN (by_rule = 'block')::int WHEN regexp_matches(host, '(^|[.-])({seeds})([.-]|$)') THEN 1 END AS y FROM rows_),
shapes AS (SELECT host, shape, count(*) AS n, count(y) AS labelled, coalesce(sum(y), 0) AS blocked FROM labels_ GROUP BY host, shape),
{','.join(levels)},
ts AS (SELECT * EXCLUDE (template), CASE WHEN len(seg) > {depth + 1} THEN template || '/**' ELSE template END AS template FROM t{depth}),
tp AS (SELECT host, template, sum(labelled) AS labelled, sum(blocked) AS blocked, regexp_extract(template, '^[^/]*(/[^/]*)?') AS branch, regexp_replace(template, '^/[^/]*', '') AS below FROM ts GROUP BY host, template),
br AS (SELECT host, branch, sum(labelled) AS bl, sum(blocked) AS bb, string_agg(DISTINCT below, chr(10) ORDER BY below) AS subtree FROM tp GROUP BY host, branch),
bg AS (SELECT *, sum(bl) OVER (PARTITION BY host, subtree) AS gl, sum(bb) OVER (PARTITION BY host, subtree) AS gb FROM br),
bp AS (SELECT host, branch, CASE WHEN power((bb * gl - gb * bl)::double, 2) <= {z * z} * (gb * (gl - gb) * bl)::double THEN subtree ELSE '/' || branch END AS pool FROM bg),
pl AS (SELECT tp.host, template, sum(labelled) OVER (PARTITION BY tp.host, pool, below) AS labelled, sum(blocked) OVER (PARTITION BY tp.host, pool, below) AS blocked, sum(labelled) OVER (PARTITION BY tp.host) AS hl, sum(blocked) OVER (PARTITION BY tp.host) AS hb FROM tp JOIN bp ON tp.host = bp.host AND tp.branch = bp.branch),
pr AS (SELECT (coalesce(sum(blocked), 0) + 1.0::double) / (coalesce(sum(labelled), 0) + 2.0::double) AS prior FROM tp),
jd AS (SELECT host, template, labelled, blocked, CASE WHEN (blocked + {m}::double * ((hb + {m}::double * prior) / (hl + {m}::double))) / (labelled + {m}::double) >= {reject_at} AND hl > 0 THEN 'block' ELSE 'allow' END AS by_tree FROM pl, pr)
SELECT page_id, r.host, path, rule, coalesce(by_rule, by_tree) AS verdict, jd.template, jd.labelled::bigint AS labelled, jd.blocked::bigint AS blocked
FROM rows_ r JOIN ts ON r.host = ts.host AND r.shape = ts.shape JOIN jd ON ts.host = jd.host AND ts.template = jd.template"""


TOPK_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::bigint AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::int AS rank, vec_id, score FROM k WHERE rank <= 10"""

def chat_sql(budget: int = 1024, history: int = 256) -> str:
    said = "'<|im_end|><|im_start|>assistant ok'"
    frame = len(chat.START) + len(chat.END) + 2
    return rf"""
WITH RECURSIVE t0 AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL (VALUES (-1, 0, 'user', {said}), (-1, 1, 'assistant', {said}))),
t1 AS (SELECT *, (strlen(text) + 3) // 4 + (strlen(role) + 3) // 4 + {chat.FRAME} AS tokens, length(role) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + {frame} AS chars FROM t0),
t AS (SELECT *, p // {chat.SECTION * budget} AS section FROM (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS p FROM t1)),
h AS (SELECT conv_id, tokens AS head, chars AS head_chars FROM t WHERE p = 0 AND role = 'system' AND tokens <= {budget // 2}),
r AS (SELECT t.*, {budget} - coalesce(head, 0) AS rest, head, head_chars FROM t LEFT JOIN h USING (conv_id)),
w AS (SELECT conv_id, section, min(p) AS s FROM r GROUP BY conv_id, section
  UNION ALL SELECT r.conv_id, r.section, min(r.p) FROM w JOIN r ON r.conv_id = w.conv_id AND r.section = w.section AND r.p > w.s AND r.p + r.tokens - w.s > CASE WHEN w.s = 0 THEN {budget} ELSE r.rest - {history} END GROUP BY r.conv_id, r.section, w.s),
o AS (SELECT r.conv_id, r.turn, r.chars, r.p, r.tokens, r.rest, r.head_chars, max(w.s) AS s FROM r JOIN w ON w.conv_id = r.conv_id AND w.section = r.section AND w.s <= r.p GROUP BY ALL),
z AS (SELECT conv_id, s, max(p + tokens) - s AS size, sum(chars) + CASE WHEN s > 0 THEN coalesce(any_value(head_chars), 0) ELSE 0 END AS chars, any_value(rest) AS rest FROM o GROUP BY conv_id, s),
again AS (SELECT z.conv_id, z.s, sum(r.chars) AS chars FROM z JOIN r ON r.conv_id = z.conv_id AND r.p < z.s AND z.s - r.p <= least({history}, z.rest - z.size) AND NOT (r.p = 0 AND r.head IS NOT NULL) GROUP BY z.conv_id, z.s),
f AS (SELECT z.conv_id, sum(z.chars + coalesce(again.chars, 0))::bigint AS formatted_chars, count(*) AS n_windows FROM z LEFT JOIN again USING (conv_id, s) GROUP BY z.conv_id),
b AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256, coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS learnt FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(learnt)::bigint AS loss_chars, sha256(learnt) AS loss_sha256, formatted_chars, n_windows FROM b JOIN f USING (conv_id)"""


#: Every phrase of one to four words within a piece, with its count for each language.
COLLOCATION_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
s AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, (VALUES (1), (2), (3), (4)) v(m) WHERE len(w) >= m),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM s GROUP BY ALL),
n AS (SELECT lang, sum(f)::bigint AS n FROM g WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE m > 1 AND f >= 30),
k AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:m], ' ') AS tail FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
x AS (SELECT k.lang, k.phrase, a, k, g1.f AS l, g2.f AS r, (2000000::hugeint * a) // (g1.f::hugeint + g2.f) AS score FROM k JOIN g g1 ON g1.lang = k.lang AND g1.phrase = head JOIN g g2 ON g2.lang = k.lang AND g2.phrase = tail),
y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
u AS (SELECT lang, array_to_string(w[i:i + z - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT *, unnest(range(1, m - z + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS z FROM c WHERE m > 2)) GROUP BY ALL),
q AS (SELECT y.* FROM y LEFT JOIN u USING (lang, phrase) WHERE longer IS NULL OR 100 * longer::hugeint < 80 * a::hugeint)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score::bigint AS score FROM q JOIN n USING (lang) QUALIFY rank <= 2000"""

NEGATIVES_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS anchor_id, c.r AS cr, c.vec_id, q.label = c.label AS same, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::bigint AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
p AS (SELECT r, anchor_id, cr, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.r, p.cr ORDER BY score DESC, vec_id) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON s.r = p.r AND NOT same AND 80 * positive_score::hugeint <= 100 * score::hugeint AND score <= positive_score)
SELECT anchor_id, positive_id, rank::int AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""

SQL = {"op11_chat_windows": chat_sql(), "op12_collocations": COLLOCATION_SQL, "op13_hard_negatives": NEGATIVES_SQL, "op2_license_scan": license_sql(), "op4_source_mix": mix_sql(), "op6_url_filter": url_sql(), "op9_exact_topk": TOPK_SQL}

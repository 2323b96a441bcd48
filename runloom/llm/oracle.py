"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

from runloom.llm.quality_rules import COMMON, Limits

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"

CHAT_FORMAT = r"""WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (SELECT *, length(t) + len(regexp_extract_all(t, '[<\[]\\*(?:/?(?:INST|SYS|ROLE)\]|/?s>|\|(?:image|audio|document)\|>)')) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 WHEN 'system' THEN 13 ELSE 16 + length(role) END AS n FROM c)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn NULLS LAST, role, t)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS LAST, role, t) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id"""

DECONTAMINATE = rf"""WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[k:k + 9], ' ') AS p FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS k FROM i WHERE len(ws) > 0)),
dw AS (SELECT doc_id, n, k, array_to_string(ws[k:k + n - 1], ' ') AS p FROM (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS k FROM w, (SELECT DISTINCT n FROM iw) WHERE len(ws) >= n)),
h AS (SELECT doc_id, k, dw.n AS n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.p = iw.p),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS q FROM h) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY 1),
dp AS (SELECT doc_id, unnest(ws) AS t, unnest(generate_series(1, len(ws))) AS pos FROM w),
cnt AS (SELECT t, count(*) AS c FROM dp GROUP BY 1),
win AS (SELECT item_id, k, ws[k:k + 9] AS p FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS k FROM i WHERE len(ws) > 0)),
anc AS (SELECT item_id, k, p, a.t AS t, o, row_number() OVER (PARTITION BY item_id, k ORDER BY c, o) AS r FROM (SELECT *, unnest(p) AS t, unnest(generate_series(0, len(p) - 1)) AS o FROM win) a JOIN cnt ON cnt.t = a.t),
lead AS (SELECT dp.doc_id AS doc_id, item_id, k, p, pos - o AS s FROM dp JOIN anc ON anc.t = dp.t AND r = 1 JOIN w ON w.doc_id = dp.doc_id
  WHERE 5 * len(list_intersect(list_distinct(p), ws[greatest(pos - 9, 1):pos + 9])) >= 4 * len(list_distinct(p))),
nr AS (SELECT DISTINCT lead.doc_id AS doc_id, lead.item_id AS item_id FROM lead JOIN anc ON anc.item_id = lead.item_id AND anc.k = lead.k AND r = 2 JOIN dp ON dp.doc_id = lead.doc_id AND dp.t = anc.t WHERE abs(pos - o - s) <= 2),
nn AS (SELECT nr.doc_id AS doc_id, count(*) AS n_near FROM nr ANTI JOIN h ON h.doc_id = nr.doc_id AND h.item_id = nr.item_id GROUP BY 1)
SELECT w.doc_id AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM w LEFT JOIN pos ON pos.doc_id = w.doc_id LEFT JOIN it ON it.doc_id = w.doc_id LEFT JOIN nn ON nn.doc_id = w.doc_id"""

NGRAM_JACCARD = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[k:k + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 3, 1))) AS k FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT w.doc_id AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(reach.b) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN reach ON reach.a = w.doc_id GROUP BY 1"""

_CLASSES = ("[a-z]", "[A-Z]", "[0-9]", r"[\x20\x09-\x0D]", "[#*$%&|<>]", r"[\x00-\x08\x0E-\x1F!\"''()+,\-./:;=?@\[\\\]^_`{}~\x7F]", r"[^\x00-\x7F]")
_COUNTS = ", ".join(f"CAST(length(t) - length(regexp_replace(t, '{c}', '', 'g')) AS DOUBLE) AS c{i}" for i, c in enumerate(_CLASSES))


def _js(p: str, q: str) -> str:
    """Both terms of one bucket."""
    m = f"(({p} + {q}) / 2)"
    return f"(CASE WHEN {p} > 0 THEN {p} * log2({p} / {m}) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2({q} / {m}) ELSE 0 END)"


_LIMITS = Limits()
_ALL = " + ".join(f"d.c{i}" for i in range(7))
_REF_ALL = " + ".join(f"r.c{i}" for i in range(7))
_BY_CLASS = " + ".join(_js(f"(d.c{i} / ({_ALL}))", f"(r.c{i} / ({_REF_ALL}))") for i in range(7))

QUALITY_RULES = rf"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
c AS (SELECT doc_id, lang, t, ws, len(ws) AS n, {_COUNTS} FROM d),
r AS (SELECT lang, count(*) FILTER (WHERE n >= {_LIMITS.word_words}) AS n, {", ".join(f"sum(d.c{i} / ({_ALL})) FILTER (WHERE n >= {_LIMITS.class_words}) AS c{i}" for i in range(7))} FROM c d GROUP BY 1),
wd AS (SELECT doc_id, lang, w, max(n) AS n, count(*) AS k FROM (SELECT doc_id, lang, n, unnest(ws) AS w FROM c) GROUP BY 1, 2, 3),
common AS (SELECT wd.lang AS lang, w, sum(k / wd.n) / max(r.n) AS q FROM wd JOIN r ON r.lang = wd.lang WHERE wd.n >= {_LIMITS.word_words} GROUP BY 1, 2 HAVING sum(k / wd.n) >= {COMMON} * max(r.n) * (1 - 1e-9)),
total AS (SELECT lang, sum(q) AS q FROM common GROUP BY 1),
met AS (SELECT wd.doc_id AS doc_id, sum(k / c.n) AS p, sum(common.q) AS q, sum({_js("(k / c.n)", "common.q")}) AS js FROM wd JOIN common ON common.lang = wd.lang AND common.w = wd.w JOIN c ON c.doc_id = wd.doc_id GROUP BY 1),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, n - 2)) AS i FROM c WHERE n >= 3)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM win),
rep AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS q FROM twice WHERE k > 1) GROUP BY 1),
ln AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM c) WHERE regexp_matches(l, '{_WORD}') GROUP BY 1),
j AS (SELECT c.doc_id AS doc_id, c.n AS n, d.c3 AS spaces, d.c4 AS symbols, length(c.t) AS chars, coalesce(ln.n, 0) AS dup, coalesce(rep.n, 0) AS rep,
  CASE WHEN c.n >= {_LIMITS.class_words} AND r.lang IS NOT NULL THEN sqrt(greatest(({_BY_CLASS}) / 2, 0)) ELSE 0 END AS by_class,
  CASE WHEN c.n >= {_LIMITS.word_words} AND r.lang IS NOT NULL THEN sqrt(greatest((coalesce(met.js, 0) + (coalesce(total.q, 0) - coalesce(met.q, 0)) + {_js("(1 - coalesce(met.p, 0))", "(1 - coalesce(total.q, 0))")}) / 2, 0)) ELSE 0 END AS by_word
  FROM c JOIN c d ON d.doc_id = c.doc_id LEFT JOIN r ON r.lang = c.lang LEFT JOIN total ON total.lang = c.lang LEFT JOIN met ON met.doc_id = c.doc_id LEFT JOIN rep ON rep.doc_id = c.doc_id LEFT JOIN ln ON ln.doc_id = c.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(chars - spaces AS BIGINT) AS word_chars, CAST(symbols AS BIGINT) AS n_symbols, CAST(dup AS BIGINT) AS n_dup_lines, CAST(rep AS BIGINT) AS n_repeat_words,
  n < 50 OR 100 * rep > 50 * n AS base_failed, NOT (n < 50 OR 100 * rep > 50 * n) AND by_class <= {_LIMITS.class_distance} AND by_word <= {_LIMITS.word_distance} AS kept FROM j"""

WARC = """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY 1)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM p LEFT JOIN f ON f.d = p.d"""

_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split({k}, ''), lambda c: [CAST(ord(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295)"""

CONVERSATION_REPAIR = rf"""WITH RECURSIVE h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS t, {_CRC.format(k="(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS h FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(t, '.!?', '') ELSE t END AS t, unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE h <> 0),
o AS (SELECT *, rtrim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, t, copy) AS i FROM d),
c AS (SELECT *, substr(role, 1, 1) AS x, lead(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS y,
  CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, t ORDER BY i) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
dp AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, '' AS s, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS rep FROM c
  UNION ALL SELECT conv_id, i, s, cost, audit, rep FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, s ORDER BY cost, audit) AS k FROM (
    SELECT c.conv_id AS conv_id, c.i AS i, CASE l WHEN 'D' THEN s WHEN 'K' THEN x WHEN 'R' THEN CASE s WHEN 'u' THEN 'a' ELSE 'u' END END AS s,
      cost + CASE l WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN l <> 'D' AND fault = 'truncated' THEN 5 ELSE 0 END AS cost, audit || l AS audit,
      rep || CASE WHEN l = 'D' THEN '' ELSE CASE WHEN s = '' THEN '' ELSE chr(10) END || CASE WHEN l = 'K' THEN role WHEN s = 'u' THEN 'assistant' ELSE 'user' END || ':' || t END AS rep
    FROM dp JOIN c ON c.conv_id IS NOT DISTINCT FROM dp.conv_id AND c.i = dp.i + 1, (VALUES ('D'), ('K'), ('R')) e(l)
    WHERE l = 'D' OR (fault IN ('', 'truncated') AND (l = 'R' OR x = CASE s WHEN 'u' THEN 'a' ELSE 'u' END OR (s = '' AND x = 's'))))) WHERE k = 1),
n AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
  count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE x || y NOT IN ('su', 'ua', 'au')) AS illegal FROM c GROUP BY 1),
b AS (SELECT dp.conv_id AS conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, rep, row_number() OVER (PARTITION BY dp.conv_id ORDER BY cost, audit) AS k FROM dp JOIN n ON n.conv_id IS NOT DISTINCT FROM dp.conv_id AND n.n = dp.i WHERE s IN ('', 'a'))
SELECT v.conv_id AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(rep, '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) v LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM v.conv_id AND k = 1"""

_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

LEXICAL_SEARCH = rf"""WITH d AS (SELECT doc_id, len(ws) AS n, ws FROM (SELECT doc_id, regexp_extract_all({_LOWER}, '{_TERMS}') AS ws FROM documents) WHERE len(ws) > 0),
z AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM d),
f AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS t FROM d) GROUP BY 1, 2),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, z GROUP BY 1),
i AS (SELECT item_id, t, count(*) AS c FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERMS}')) AS t FROM benchmark) GROUP BY 1, 2),
s AS (SELECT item_id, f.doc_id AS doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words)))) AS BIGINT) AS score
  FROM i JOIN w ON w.t = i.t JOIN f ON f.t = i.t JOIN d ON d.doc_id = f.doc_id, z GROUP BY 1, 2)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM s WHERE score > 0) WHERE r <= 10"""


ORACLE_SQL = {
    "op1_chat_format": CHAT_FORMAT, "op2_decontaminate": DECONTAMINATE, "op3_ngram_jaccard": NGRAM_JACCARD, "op7_quality_rules": QUALITY_RULES, "op9_warc": WARC,
    "op11_lexical_search": LEXICAL_SEARCH,
    "op13_conversation_repair": CONVERSATION_REPAIR,
}

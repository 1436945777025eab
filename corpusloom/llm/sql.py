"""SQL for what of these operators SQL can express: links of vectors, base rules, base spans and resampling."""

from __future__ import annotations

VECTORS = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
low AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a), n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, component_id, e.vec_id = component_id AS kept FROM embeddings e JOIN low USING (vec_id) LEFT JOIN n USING (vec_id)"""

QUALITY = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), ws AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM t),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM ws),
g AS (SELECT doc_id, i, w || ' ' || lead(w) OVER v || ' ' || lead(w, 2) OVER v AS g FROM w WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g WHERE g IS NOT NULL) WHERE n >= 2),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM t), dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM ln WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id)
SELECT ws.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(hit.n, 0) AS n_repeat_words,
  len(ws) < 50 OR 100 * coalesce(hit.n, 0) > 50 * len(ws) AS base_failed FROM ws LEFT JOIN dup USING (doc_id) LEFT JOIN hit USING (doc_id)"""

_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_D = "regexp_replace(m, '[^0-9]', '', 'g')"
#: the digits from the right: every second one doubled, and the two digits of what comes out added
_LUHN = f"list_sum(list_transform(range(1, length({_D}) + 1), lambda i: CASE WHEN i % 2 = 0 THEN (substr({_D}, length({_D}) + 1 - i::INT, 1)::INT * 2) // 10 + (substr({_D}, length({_D}) + 1 - i::INT, 1)::INT * 2) % 10 ELSE substr({_D}, length({_D}) + 1 - i::INT, 1)::INT END)) % 10 = 0"
_KEEP = {
    "email": "true",
    "ip": "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(ltrim(x, '0') AS INT), 0) > 255)) = 0",
    "card": f"length({_D}) BETWEEN 13 AND 19 AND {_LUHN}",
    "phone": f"length({_D}) BETWEEN 9 AND 15",
}


def _spans(place: int, kind: str) -> str:
    p = _PATTERNS[kind]
    rows = f"SELECT doc_id, unnest(regexp_extract_all(t, '{p}')) AS m, unnest(string_split_regex(t, '{p}')[1:len(regexp_extract_all(t, '{p}'))]) AS gap, unnest(range(len(regexp_extract_all(t, '{p}')))) AS i FROM t WHERE regexp_matches(t, '{p}')"
    at = f"SELECT doc_id, m, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS e FROM ({rows})"
    return f"SELECT doc_id, {place} AS place, '{kind}' AS kind, (e - length(m))::BIGINT AS s, e::BIGINT AS e FROM ({at}) WHERE {_KEEP[kind]}"


PII = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), spans AS ({' UNION ALL '.join(_spans(i, k) for i, k in enumerate(_PATTERNS))}),
g AS (SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in _PATTERNS)}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY place, s) AS said FROM spans GROUP BY doc_id)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in _PATTERNS)}, sha256(coalesce(said, '')) AS base_sha256 FROM t LEFT JOIN g USING (doc_id)"""

#: CRC32 of a word, bit by bit over its UTF-8 bytes
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, 2 * octet_length(encode(w)), 2), lambda i: ('0x' || substr(hex(encode(w)), i::INT, 2))::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))))"""
RESAMPLE = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t, 0 AS target FROM documents UNION ALL SELECT NULL, coalesce(text, ''), 1 FROM benchmark),
w AS (SELECT doc_id, target, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM t),
f AS (SELECT w, count(*) FILTER (target = 0) AS s, count(*) FILTER (target = 1) AS t FROM w GROUP BY w), b AS (SELECT w, s, t, ({_CRC}) % 10000 AS b FROM f),
n AS (SELECT b, sum(s) AS s, sum(t) AS t FROM b GROUP BY b), k AS (SELECT sum(s) AS s, sum(t) AS t FROM n),
g AS (SELECT w, floor(1000 * ln(((n.t + 1)::DOUBLE * (k.s + 10000)::DOUBLE) / ((n.s + 1)::DOUBLE * (k.t + 10000)::DOUBLE)))::BIGINT AS gain FROM b JOIN n USING (b), k),
d AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS gain FROM w JOIN g USING (w) WHERE target = 0 GROUP BY doc_id),
m AS (SELECT x.doc_id, coalesce(n_features, 0) AS n_features, coalesce((gain - ((gain % n_features) + n_features) % n_features) // n_features, 0)::BIGINT AS weight FROM documents x LEFT JOIN d USING (doc_id)),
z AS (SELECT *, weight + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM m),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM z WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM r) THEN rank END AS rank FROM z LEFT JOIN r USING (doc_id)"""


def _runs(n: int, repeat: str) -> str:
    """Words w of every document, numbered i, and whether a repeated run of n words covers them; `repeat` says which runs are."""
    return f"""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
h AS (SELECT doc_id, list_transform(range(1, len(ws) - {n - 2}), lambda i: md5(array_to_string(ws[i:i + {n - 1}], ' '))) AS hs FROM t WHERE len(ws) >= {n}),
g AS (SELECT doc_id, unnest(hs) AS h, generate_subscripts(hs, 1) AS i FROM h), s AS (SELECT doc_id, i, 1 AS hit FROM g QUALIFY {repeat}),
x AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM t), c AS (SELECT doc_id, i, w, coalesce(sum(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 0) > 0 AS gone FROM x LEFT JOIN s USING (doc_id, i))"""


LINES = f"""{_runs(50, 'row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1')} SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed_words FROM t LEFT JOIN (SELECT doc_id, count(*) FILTER (gone) AS n FROM c GROUP BY doc_id) USING (doc_id)"""
SUBSTRINGS = f"""{_runs(35, 'count(*) OVER (PARTITION BY h) > 1')} SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN (SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(w, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id) USING (doc_id)"""

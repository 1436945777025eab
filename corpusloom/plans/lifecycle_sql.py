"""The lifecycle queries in SQL for another engine, written apart from the operators; only comparisons use it."""

from __future__ import annotations

from . import oracle as O
from .ledger_sql import _TEXT, M

_TAIL = "CASE WHEN k <= 0 THEN 1 ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) FROM (SELECT unnest(range(k, n + 1)) AS i)) END"
_X = "x AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"


def _p(win: str) -> str:
    return f"round((SELECT {_TAIL} FROM (SELECT g.n AS n, g.{win} AS k)), 6) AS p_{win}"


SQL: dict[str, str] = {
    "o108_cluster_bootstrap": """WITH s AS (SELECT source AS name, sum(quality)::DOUBLE AS w, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY source),
p AS (SELECT row_number() OVER (ORDER BY name) AS place, w, n FROM s), k AS (SELECT count(*) AS c, sum(w) / sum(n) AS rate, sum(n)::BIGINT AS n FROM s),
draws AS (SELECT b, unnest(range((SELECT c FROM k))) AS j FROM range(1000) t(b)), picked AS (SELECT b, ('0x' || md5('7/' || b || '/' || j)[1:12])::BIGINT % (SELECT c FROM k) + 1 AS place FROM draws),
r AS (SELECT b, sum(w) / sum(n) AS r FROM picked JOIN p USING (place) GROUP BY b), o AS (SELECT list_sort(list(r)) AS r FROM r)
SELECT round(rate, 6) AS rate, round(r[26], 6) AS low, round(r[975], 6) AS high, c AS clusters, n FROM o, k""",
    "o108_pooled_runs": f"""WITH {_X}, a AS (SELECT source AS run, doc_id AS id, lang AS g, toxic = 1 AS recognised, quality = 1 AS good, quality = 1 AND n_chars > 800 AS long, trim(regexp_replace(lower({_TEXT}), '\\s+', ' ', 'g')) AS said FROM x WHERE quality IS NOT NULL),
f AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY said ORDER BY run, id) = 1), runs AS (SELECT g, min(ok) AS ok FROM (SELECT run, g, avg(good::INT) >= 0.5 AS ok FROM a GROUP BY ALL) GROUP BY g),
g AS (SELECT g, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (long) AS long FROM f WHERE NOT recognised GROUP BY g), p AS (SELECT g.g, n, {_p('good')}, {_p('long')} FROM g)
SELECT g AS "group", n, p_good, p_long, coalesce(ok, false) AS all_runs, coalesce(ok, false) AND p_good < 0.05 AND p_long < 0.05 AS passes FROM p LEFT JOIN runs USING (g)""",
    "o155_effective_decisions": f"""WITH {_X}, b AS (SELECT doc_id::VARCHAR AS ref, lang, source, quality, toxic, md5({_TEXT}) AS digest, 's:' || lang || '.' || source AS slot, 'l:' || source || '.' || (n_chars // 300) AS lesson FROM x),
torn AS (SELECT DISTINCT digest FROM b WHERE toxic = 1), t AS (SELECT b.ref, lesson, torn.digest IS NOT NULL AS down, CASE WHEN torn.digest IS NOT NULL THEN 'rejected' WHEN quality = 1 THEN 'approved' ELSE 'pending' END AS decision FROM b LEFT JOIN torn USING (digest)),
s AS (SELECT slot AS id, CASE WHEN sum(toxic) * 8 > count(toxic) THEN 'rejected' ELSE 'approved' END AS decision FROM b GROUP BY slot),
l AS (SELECT lesson AS id, CASE WHEN bool_and(t.down) OR any_value(f.decision) = 'rejected' THEN 'rejected' ELSE 'pending' END AS decision FROM t JOIN (SELECT lesson, s.decision FROM (SELECT lesson, min(slot) AS id FROM b GROUP BY lesson) JOIN s USING (id)) f USING (lesson) GROUP BY lesson),
e AS (SELECT 'e:' || b.ref AS id, CASE WHEN t.down OR l.decision = 'rejected' THEN 'rejected' ELSE 'pending' END AS decision FROM b JOIN t USING (ref) JOIN l ON l.id = b.lesson WHERE quality = 1),
p AS (SELECT DISTINCT 'p:' || source AS id, coalesce(s.decision, 'pending') AS decision FROM b LEFT JOIN s ON s.id = 's:en.' || source),
r AS (SELECT 'r:' || source AS id, CASE WHEN bool_and(s.decision = 'rejected') THEN 'rejected' ELSE 'pending' END AS decision FROM b JOIN s ON s.id = b.slot GROUP BY source)
SELECT 't:' || ref AS id, decision FROM t UNION ALL SELECT * FROM s UNION ALL SELECT * FROM l UNION ALL SELECT * FROM e UNION ALL SELECT * FROM p UNION ALL SELECT * FROM r""",
    "o159_composed_changes": f"WITH {M} SELECT m.key, m.status AS was, CASE WHEN ownership <> 'other' THEN 'forgotten' END AS now FROM m LEFT JOIN (SELECT DISTINCT doc_id AS key, 1 AS hit FROM labels WHERE toxic = 1) t USING (key) WHERE ownership = 'other' OR (hit = 1 AND status <> 'forgotten')",
    "o159_rolled_back": f"WITH {M} SELECT key, status, true AS same FROM m",
    "o153_merged_patches": f"""WITH {_X} SELECT doc_id AS key, CASE WHEN toxic = 1 THEN 'held' ELSE 'active' END AS status,
array_to_string(list_sort(list_filter([CASE WHEN n_chars > 4000 THEN NULL ELSE source || '=own' END, CASE WHEN quality = 1 THEN lang || '=own' WHEN quality IS NOT NULL THEN lang || '=other' END], lambda v: v IS NOT NULL)), ';') AS profiles,
CASE WHEN toxic = 1 AND quality = 0 THEN 'type=' || source WHEN toxic = 1 THEN 'type=flagged' WHEN quality = 0 THEN '' ELSE 'type=' || source END AS facets, CASE WHEN toxic = 1 AND quality = 0 THEN 'facets.type' ELSE '' END AS conflicts FROM x""",
    "o137_language_segments": f"""WITH t AS (SELECT conv_id AS key, turn AS pos, role AS said, {O.n_words(_TEXT)} AS words FROM conversations), u AS (SELECT *, CASE WHEN words >= 40 THEN said END AS told FROM t),
m AS (SELECT key, first(told ORDER BY w DESC, first) AS main FROM (SELECT key, told, sum(words) AS w, min(pos) AS first FROM u WHERE told IS NOT NULL GROUP BY key, told) GROUP BY key), o AS (SELECT key, first(said ORDER BY words DESC, pos) AS other FROM u GROUP BY key),
v AS (SELECT u.*, coalesce(main, other) AS main, CASE WHEN told <> coalesce(main, other) THEN told END AS away FROM u JOIN o USING (key) LEFT JOIN m USING (key)),
w AS (SELECT *, CASE WHEN away IS NOT NULL AND away IS DISTINCT FROM lag(away) OVER (PARTITION BY key ORDER BY pos) THEN 1 ELSE 0 END AS fresh FROM v),
z AS (SELECT *, CASE WHEN away IS NULL THEN 1 ELSE 1 + sum(fresh) OVER (PARTITION BY key ORDER BY pos ROWS UNBOUNDED PRECEDING) END AS part FROM w)
SELECT CASE WHEN part = 1 THEN key::VARCHAR ELSE key || '#' || part END AS key, part, min(coalesce(away, main)) AS lang, count(*) AS blocks, sum(words) AS words FROM z GROUP BY z.key, part""",
}

_LESS = ", ".join(f"sum({s}) OVER w - coalesce({s}, 0) AS {s}" for s in O.SUMS)
_FLAG = "CASE WHEN s.value < floor THEN CASE WHEN l.value - s.value > 2 * floor THEN 'overshoot' ELSE 'ok' END WHEN l.value / s.value > overshoot THEN 'overshoot' WHEN NOT sparse AND shortfall > 0.05 AND l.value / s.value < shortfall THEN 'shortfall' ELSE 'ok' END"
_COUNTS = f"""WITH {O.sums(O.DOCS)}, rest AS (SELECT key, lang, type, {_LESS} FROM sums WINDOW w AS (PARTITION BY lang, type) QUALIFY count(*) OVER w > 1), rv AS (SELECT key, lang, type, {O.value_columns()} FROM rest), slot AS ({O.melted('rv', 'key, lang, type')}),
vals AS (SELECT key, lang, type, {O.value_columns()} FROM sums), long AS ({O.melted('vals', 'key, lang, type')}), {O.metric_table()}, flags AS (SELECT l.key, l.lang, {_FLAG} AS flag FROM long l JOIN slot s USING (key, metric) JOIN metric_table t USING (metric)),
counts AS (SELECT key, lang, count(*) FILTER (flag <> 'ok') AS flagged FROM flags GROUP BY key, lang)"""
SQL["o171_left_out_flags"] = f"{_COUNTS} SELECT key, flagged FROM counts"
SQL["o223_simulated_check"] = f"""{_COUNTS} SELECT lang, k, count(*) AS units, round(count(*) FILTER (flagged > 0) / count(*), 6) AS any_flag, round(count(*) FILTER (flagged >= k) / count(*), 6) AS fails FROM counts, range(2, 9) t(k) GROUP BY lang, k"""
_SUMMED = ", ".join(f"sum({s}) AS {s}" for s in O.SUMS)
SQL["o157_rederived_fingerprints"] = f"""WITH {O.sums(O.DOCS)}, poor AS (SELECT DISTINCT doc_id AS key FROM labels WHERE quality = 0), touched AS (SELECT DISTINCT lang, type FROM sums JOIN poor USING (key)),
stay AS (SELECT sums.* FROM sums JOIN touched USING (lang, type) LEFT JOIN poor USING (key) WHERE poor.key IS NULL), g AS (SELECT lang, type, count(*) AS n_texts, {_SUMMED} FROM stay GROUP BY lang, type), gv AS (SELECT lang, type, n_texts, {O.value_columns()} FROM g), slot AS ({O.melted('gv', 'lang, type, n_texts')}),
vals AS (SELECT key, lang, type, {O.value_columns()} FROM stay), long AS ({O.melted('vals', 'key, lang, type')}), q AS (SELECT lang, type, metric, round(quantile_cont(value, 0.05), 6) AS q05, round(quantile_cont(value, 0.95), 6) AS q95 FROM long GROUP BY ALL)
SELECT lang, type, metric, n_texts, value, q05, q95 FROM slot JOIN q USING (lang, type, metric)"""

SQL["o135_rebuilt_lessons"] = """WITH e AS (SELECT (user_id % 10)::VARCHAR AS slot, user_id AS pair, event_id AS change, event_type AS kind, value FROM events), half AS (SELECT max(change) / 2 AS h FROM e),
f AS (SELECT slot, kind, list_sort(list(DISTINCT pair)) AS pairs FROM e, half WHERE change < h AND value < 20 AND kind <> 'other' GROUP BY slot, kind), old AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY kind) AS id FROM f WHERE NOT (kind = 'error' AND slot < '5')),
n AS (SELECT slot, kind, list_sort(list(DISTINCT pair)) AS now FROM e WHERE value > 5 AND kind <> 'other' GROUP BY slot, kind), b AS (SELECT coalesce(n.slot, old.slot) AS slot, coalesce(n.kind, old.kind) AS kind, id, pairs, now FROM n FULL OUTER JOIN old ON n.slot = old.slot AND n.kind = old.kind),
last AS (SELECT slot, max(id) AS last FROM old GROUP BY slot), fresh AS (SELECT *, kind = 'error' AND slot < '5' AS no FROM b WHERE id IS NULL), r AS (
SELECT slot, id, kind, coalesce(now, []) AS pairs, CASE WHEN now IS NULL THEN 'drop' WHEN now = pairs THEN 'keep' ELSE 'modify' END AS op FROM b WHERE id IS NOT NULL
UNION ALL SELECT slot, coalesce(last, 0) + row_number() OVER (PARTITION BY slot ORDER BY kind), kind, now, 'add' FROM fresh LEFT JOIN last USING (slot) WHERE NOT no UNION ALL SELECT slot, NULL, kind, now, 'refused' FROM fresh WHERE no)
SELECT slot, id, kind, len(pairs) AS pairs, md5(array_to_string(pairs, ',')) AS digest, len(pairs) < 2 AS seen_once, op FROM r"""
_RING = "SELECT {name}, row_number() OVER (ORDER BY md5('{seed}/' || {name}), {name}) - 1 AS place, count(*) OVER () AS total FROM (SELECT DISTINCT {of} AS {name} FROM documents)"
SQL["o217_distractors"] = f"WITH r AS ({_RING.format(name='type', seed='d', of='source')}), a AS (SELECT type, unnest([1, 2, 3]) AS rn, place, total FROM r) SELECT a.type, b.type AS other, rn FROM a JOIN r b ON b.place = (a.place + rn) % a.total WHERE rn < a.total"
SQL["o217_recognition"] = f"""WITH r AS ({_RING.format(name='author', seed='r', of='source')}), p AS (SELECT item_id AS key, CASE WHEN item_id % 3 > 0 THEN 'src' || (item_id % 20) END AS author, md5('r/' || item_id) AS h FROM benchmark),
a AS (SELECT *, row_number() OVER (ORDER BY h, key) AS ask, ('0x' || h[1:12])::BIGINT AS pl FROM p), e AS (SELECT key, author, unnest(range(6)) AS step, pl FROM a), m AS (SELECT e.key, e.step, r.author AS other FROM e JOIN r ON r.place = (pl + step) % r.total WHERE step < r.total AND r.author IS DISTINCT FROM e.author),
k AS (SELECT key, author IN (SELECT author FROM r) AS known FROM p), c AS (SELECT key, list(other ORDER BY step) AS o FROM m GROUP BY key)
SELECT ask, key, CASE WHEN known THEN author ELSE 'none' END AS truth, array_to_string(list_sort(CASE WHEN known THEN list_append(o[1:4], author) ELSE o[1:5] END), ',') AS candidates FROM a JOIN c USING (key) JOIN k USING (key)"""
SQL["o217_judged_twice"] = "SELECT key, unnest(['blind', 'named']) AS kind FROM (SELECT doc_id AS key FROM documents WHERE lang = 'en' ORDER BY md5('s/' || doc_id), doc_id LIMIT 20)"

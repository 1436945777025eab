"""SQL of style windows, bands, checks of fit, small marks and vocabulary richness, for another engine."""

from __future__ import annotations

from . import oracle as O


def windows(src: str) -> str:
    """CTEs up to `win` (key, lang, type, i, b, w, done): paragraphs in windows of 350 words; `done` marks a window's last one."""
    return f"""paras AS (SELECT key, lang, type, row_number() OVER (PARTITION BY key ORDER BY n) AS i, b, {O.n_words('b')} AS c FROM (WITH {O.prose(src)} SELECT * FROM prose WHERE NOT heading)),
fold AS (SELECT key, i, c AS acc, 1 AS n, 0 AS w FROM paras WHERE i = 1
  UNION ALL SELECT p.key, p.i, CASE WHEN f.acc >= 350 THEN p.c ELSE f.acc + p.c END, CASE WHEN f.acc >= 350 THEN 1 ELSE f.n + 1 END, f.w + CASE WHEN f.acc >= 350 THEN 1 ELSE 0 END FROM fold f JOIN paras p ON p.key = f.key AND p.i = f.i + 1),
win AS (SELECT paras.*, w, acc, n AS n_paras, acc >= 350 AS done FROM paras JOIN fold USING (key, i))"""


WINDOWS = f"WITH RECURSIVE {windows(O.TALKS)} SELECT key, w, acc AS window_words, n_paras FROM win WHERE done"

_SUMS = ", ".join(f"sum({s}) AS {s}" for s in O.SUMS)
BANDS = f"""WITH RECURSIVE {windows(O.DOCS)}, whole AS (SELECT key || '/' || w AS key, string_agg(b, chr(10) || chr(10) ORDER BY i) AS text, lang, type FROM win GROUP BY key, w, lang, type HAVING bool_or(done)),
wv AS (WITH {O.sums("SELECT * FROM whole")} SELECT key, lang, {O.value_columns()} FROM sums), wl AS ({O.melted('wv', 'key, lang')}),
slot AS (WITH {O.sums(O.DOCS)} SELECT lang, {_SUMS} FROM sums GROUP BY lang), sv AS (SELECT lang, {O.value_columns()} FROM slot), sl AS ({O.melted('sv', 'lang')}), {O.metric_table()},
q AS (SELECT s.lang, s.metric, any_value(s.value) AS value, count(w.value) AS n_windows, round(quantile_cont(CASE WHEN s.value > 0 THEN w.value / s.value END, 0.95), 3) AS q95, round(quantile_cont(CASE WHEN s.value > 0 THEN w.value / s.value END, 0.05), 3) AS q05
  FROM sl s LEFT JOIN wl w USING (lang, metric) GROUP BY s.lang, s.metric)
SELECT lang, metric, value, n_windows, CASE WHEN n_windows >= 20 AND value >= floor THEN greatest(overshoot, q95) ELSE overshoot END AS overshoot,
  CASE WHEN n_windows >= 20 AND value >= floor AND shortfall > 0.05 THEN greatest(0.05, least(shortfall, q05)) ELSE shortfall END AS shortfall FROM q JOIN metric_table USING (metric)"""


def verified(long: str, drafts: str) -> str:
    """`long` are the CTEs of leave-one-out distances; `drafts` is a source of texts."""
    return f"""WITH {long}, dv AS (WITH {O.sums(drafts)} SELECT key, lang, type, {O.value_columns()} FROM sums), dl AS ({O.melted('dv', 'key, lang, type')}),
ref AS (SELECT lang, type, metric, median(value) AS ref FROM long GROUP BY ALL),
dd AS (SELECT d.key, d.lang, d.type, avg(abs(ln(greatest(d.value, floor) / greatest(ref, floor)))) AS d FROM dl d JOIN ref USING (lang, type, metric) JOIN metric_table USING (metric) GROUP BY ALL),
sh AS (SELECT dd.*, (SELECT avg((x.distance >= dd.d)::INT) FROM dist x WHERE x.lang = dd.lang AND x.type = dd.type) AS share FROM dd)
SELECT key, lang, type, round(d, 3) AS distance, round(share, 3) AS share_further, CASE WHEN d <= median THEN 'closer than most' WHEN d <= threshold THEN 'within the range' ELSE 'unlike the others' END AS verdict FROM sh JOIN lim USING (lang, type) WHERE n >= 5"""


_DOTS = "len(regexp_extract_all(regexp_replace(body, '\\.{4,}', '', 'g'), '\\.\\.\\.|…'))"
_MARKS = {
    "ellipses": _DOTS,
    "exclamations": "len(regexp_extract_all(body, '!')) - len(regexp_extract_all(body, '!='))",
    "questions": "len(regexp_extract_all(body, '\\?'))",
    "asides": "len(regexp_extract_all(body, '\\(')) - len(regexp_extract_all(body, '\\]\\('))",
    "emoji": "len(regexp_extract_all(body, '[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}]'))",
}
QUIRKS = f"""WITH {O.prose(O.DOCS)}, p AS (SELECT key, lang, string_agg(regexp_replace(b, '`[^`\\n]*`', ' ', 'g'), chr(10) ORDER BY n) AS body FROM prose WHERE NOT heading GROUP BY key, lang), c AS (SELECT key, lang, {O.n_words('body')} AS n, * FROM (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _MARKS.items())} FROM p)),
l AS ({' UNION ALL '.join(f"SELECT key, lang, n, '{k}' AS quirk, {k} AS uses FROM c WHERE n >= 300" for k in _MARKS)}),
r AS (SELECT lang, quirk, round(sum(uses) * 1000 / sum(n), 3) AS rate, round(quantile_cont(uses * 1000 / n, 0.9), 3) AS high, round(avg((uses > 0)::INT), 3) AS share FROM l GROUP BY lang, quirk HAVING count(*) >= 5),
x AS (SELECT key, quirk, uses, share, CASE WHEN share > 0 THEN round_even(rate * n / 1000, 0) ELSE 0 END AS expected, CASE WHEN share > 0 THEN greatest(1, ceil(high * n / 1000)) ELSE 0 END::BIGINT AS allowed FROM l JOIN r USING (lang, quirk))
SELECT key, quirk, uses, allowed, CASE WHEN uses > allowed THEN 'high' WHEN uses = 0 AND expected >= 2 AND share >= 0.5 THEN 'low' ELSE 'ok' END AS flag FROM x"""

TTR = f"""WITH w AS (SELECT doc_id AS key, list_transform({O.words('text')}, lambda x: lower(x)) AS ws FROM documents)
SELECT key, CASE WHEN len(ws) > 0 THEN round(list_avg(list_transform(range(1, greatest(len(ws) - 99, 1) + 1, 10), lambda i: len(list_distinct(ws[i:i + 99])) / least(100, len(ws)))), 6) END AS ttr FROM w"""

_LONG_QUOTES = f"list_filter(regexp_extract_all(b, '{O.QUOTED}'), lambda q: {O.n_words('q')} >= 4)"
_ALL_START = "len(list_filter(string_split(b, chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(ltrim(x), '{}'))) = 0"
_QUOTE = _ALL_START.format(">")
_ADDRESS = f"len(regexp_extract_all(regexp_replace(lower(string_agg(b, chr(10) ORDER BY n)), '({O.NOT_WORD})', '\\1\\1', 'g'), '(?:^|{O.NOT_WORD})(?:yourselves|yourself|yours|your|you)(?:$|{O.NOT_WORD})'))"
_CV = "CASE WHEN avg({0}) > 0 THEN stddev_pop({0}) / avg({0}) ELSE 0 END"
#: CTEs up to `shape`: the features of every conversation with 300 words of prose
_SHAPE = f"""pr AS (WITH {O.prose(O.TALKS)} SELECT * FROM prose), every AS (WITH {O.prose(O.TALKS)} SELECT key, n, b, heading, ref FROM ref_blk),
pa AS (SELECT *, {O.n_words('b')} AS w, greatest(1, len({O.split_sentences('b')})) AS ns FROM pr WHERE NOT heading),
pf AS (SELECT key, lang, type, count(*) AS k, sum(w) AS words, {_CV.format('w')} AS cv, avg(ns) AS ns, avg((ns = 1)::INT) AS one, {_ADDRESS} AS you FROM pa GROUP BY key, lang, type HAVING sum(w) >= 300),
se AS (SELECT key, sec, sum({O.n_words('b')}) AS w FROM (SELECT *, count(*) FILTER (heading) OVER (PARTITION BY key ORDER BY n) AS sec FROM pr) WHERE NOT heading GROUP BY key, sec),
sf AS (SELECT key, count(*) AS k, {_CV.format('w')} AS cv FROM se WHERE w > 0 GROUP BY key),
qf AS (SELECT key, sum({O.n_words('b')}) AS words, sum(CASE WHEN {_QUOTE} THEN 1 ELSE len({_LONG_QUOTES}) END) AS quotes,
  sum(CASE WHEN {_QUOTE} THEN {O.n_words('b')} ELSE coalesce(list_sum(list_transform({_LONG_QUOTES}, lambda q: {O.n_words('q')})), 0) END) AS quoted FROM every WHERE (ref IS NULL OR n < ref) AND NOT {_ALL_START.format('|')} GROUP BY key),
shape AS (SELECT p.key, lang, type, CASE WHEN p.k >= 5 THEN round(p.cv, 4) END AS paragraph_length_cv, CASE WHEN p.k >= 5 THEN round(p.ns, 4) END AS paragraph_sentences, CASE WHEN p.k >= 5 THEN round(p.one, 4) END AS one_sentence_paragraphs,
  CASE WHEN s.k >= 3 THEN round(s.cv, 4) END AS section_length_cv, CASE WHEN lang = 'en' THEN round(you * 1000 / p.words, 4) END AS reader_address_per_1k,
  CASE WHEN q.words > 0 THEN round(quotes * 1000 / q.words, 4) END AS long_quotes_per_1k, CASE WHEN q.words > 0 THEN round(quoted / q.words, 4) END AS quoted_share FROM pf p LEFT JOIN sf s USING (key) LEFT JOIN qf q USING (key))"""
_FEATURES = "paragraph_length_cv paragraph_sentences one_sentence_paragraphs section_length_cv reader_address_per_1k long_quotes_per_1k quoted_share".split()
_RANGES = f"""{_SHAPE}, sl AS ({' UNION ALL '.join(f"SELECT key, lang, '{f}' AS feature, {f} AS value FROM shape WHERE {f} IS NOT NULL" for f in _FEATURES)}),
span AS (SELECT lang, feature, round(quantile_cont(value, 0.1), 4) AS low, round(quantile_cont(value, 0.5), 4) AS mid, round(quantile_cont(value, 0.9), 4) AS high, count(*) AS texts FROM sl GROUP BY lang, feature HAVING count(*) >= 5)"""
SHAPE = f"WITH {_SHAPE} SELECT * FROM shape"
SHAPE_RANGES = f"WITH {_RANGES} SELECT * FROM span"
SHAPE_FLAGS = f"WITH {_RANGES} SELECT key, feature, CASE WHEN value > high THEN 'high' WHEN value < low AND feature NOT IN ('long_quotes_per_1k', 'quoted_share') THEN 'low' ELSE 'ok' END AS flag FROM sl JOIN span USING (lang, feature)"

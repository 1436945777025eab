"""The same results in plain SQL for another engine; written independently of the Column expressions."""

from __future__ import annotations

from ..functions import packs, text

W = r"[\p{L}\p{No}\p{Nl}][\p{L}\p{No}\p{Nl}''-]*"
NOT_WORD = r"[^\p{L}\p{N}_]"
QUOTED = '“[^”\\n]*”|"[^"\\n]*"'
DOCS = "SELECT doc_id AS key, text, lang, source AS type FROM documents"
TALKS = "SELECT conv_id AS key, string_agg(text, chr(10) || chr(10) ORDER BY turn, role, text) AS text, 'en' AS lang, 'talk' || (conv_id % 3) AS type FROM conversations GROUP BY conv_id"


def straight(x: str) -> str:
    return f"translate({x}, '’‘', '''''')"


def words(x: str) -> str:
    return f"regexp_extract_all({straight(x)}, '{W}')"


def n_words(x: str) -> str:
    return f"len({words(x)})"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def heading(b: str) -> str:
    return f"(NOT contains({b}, chr(10)) AND {n_words(b)} < 12 AND NOT regexp_matches({b}, '[.!?:;][\"''”’)\\]]*$'))"


def not_prose(b: str) -> str:
    lines = f"list_filter(string_split({b}, chr(10)), lambda x: trim(x) <> '')"
    return "(" + " OR ".join(f"len(list_filter({lines}, lambda x: NOT starts_with(ltrim(x), '{s}'))) = 0" for s in "|>") + ")"


def unquoted(b: str) -> str:
    pair = f"list_zip(string_split_regex({b}, '{QUOTED}'), regexp_extract_all({b}, '{QUOTED}'))"
    kept = f"list_transform({pair}, lambda z: coalesce(z[1], '') || CASE WHEN z[2] IS NULL OR {n_words('z[2]')} >= 4 THEN '' ELSE z[2] END)"
    return f"regexp_replace(array_to_string({kept}, ''), '[ \\t]{{2,}}', ' ', 'g')"


def blocks(src: str) -> str:
    """CTEs up to `blk` (key, lang, type, n, b, heading): every block of a text."""
    return f"""src AS ({src}),
cut_src AS (SELECT key, lang, type, string_split_regex({straight("regexp_replace(regexp_replace(coalesce(text, ''), '<!--.*?-->', '', 'gs'), '^---.*?---', '', 's')")}, '\\n\\s*\\n') AS parts FROM src),
raw_blk AS (SELECT key, lang, type, unnest(parts) AS raw, generate_subscripts(parts, 1) AS i FROM cut_src),
some_blk AS (SELECT key, lang, type, i, {strip('raw')} AS b FROM raw_blk),
blk AS (SELECT key, lang, type, row_number() OVER (PARTITION BY key ORDER BY i) AS n, b, {heading('b')} AS heading FROM some_blk WHERE b <> '')"""


def prose(src: str) -> str:
    """`blocks`, then `prose` (key, lang, type, n, b, heading): what is the writer's own."""
    refs = "|".join(text.REFERENCES)
    return f"""{blocks(src)},
ref_blk AS (SELECT *, min(CASE WHEN heading AND regexp_matches(b, '^[#*\\s]*(?:{refs})[*\\s]*:?$', 'i') THEN n END) OVER (PARTITION BY key) AS ref FROM blk),
own_blk AS (SELECT key, lang, type, n, {strip(unquoted('b'))} AS b, heading FROM ref_blk WHERE (ref IS NULL OR n < ref) AND NOT {not_prose('b')}),
prose AS (SELECT * FROM own_blk WHERE {n_words('b')} > 0)"""


def split_sentences(x: str) -> str:
    marked = f"regexp_replace(regexp_replace({x}, '\\s+', ' ', 'g'), '([.!?])[\"'')\\]]*\\s+([\"''(\\[]?[0-9\\p{{Lu}}])', '\\1' || chr(31) || '\\2', 'g')"
    return f"list_filter(string_split({marked}, chr(31)), lambda s: trim(s) <> '')"


def _doubled(phrase: str) -> str:
    return "".join(c if c.isalnum() else c * 2 for c in phrase).replace("'", "''")


def _hedges() -> str:
    low = f"regexp_replace(lower(body), '({NOT_WORD})', '\\1\\1', 'g')"
    cases = []
    for lang, p in packs.HEDGES.items():
        alts = "|".join(_doubled(x) for x in p)
        cases.append(f"WHEN '{lang}' THEN len(regexp_extract_all({low}, '(?:^|{NOT_WORD})(?:{alts})(?:$|{NOT_WORD})'))")
    return f"CASE lang {' '.join(cases)} END"


def counted(bodies: str) -> str:
    """CTEs from `bodies` (key.., lang, body, n_para) to `sums`; `bodies` must be the name of one with a column `id`."""
    openers = " ".join(f"WHEN '{k}' THEN first IN ({', '.join(repr(x) for x in v)})" for k, v in packs.OPENERS.items())
    langs = ", ".join(f"'{k}'" for k in packs.CONTRACTIONS if k != "en")
    count = lambda c: f"(length(body) - length(replace(body, '{c}', '')))"
    return f"""sent AS (SELECT id, lang, unnest({split_sentences('body')}) AS s FROM {bodies}),
sent_len AS (SELECT id, lang, {n_words('s')} AS n, lower(regexp_extract({straight('s')}, '{W}')) AS first FROM sent),
sent_sum AS (SELECT id, count(*) AS n_sent, sum(n) AS sum_len, sum(n * n) AS sumsq_len, count(*) FILTER (n < 8) AS n_short, count(*) FILTER (n > 28) AS n_long,
  sum(CASE WHEN CASE lang {openers} END THEN 1 WHEN lang IN ({', '.join(repr(k) for k in packs.OPENERS)}) THEN 0 END) AS openers FROM sent_len GROUP BY id),
sums AS (SELECT d.*, coalesce(n_sent, 0) AS n_sent, coalesce(sum_len, 0) AS sum_len, coalesce(sumsq_len, 0) AS sumsq_len, coalesce(n_short, 0) AS n_short, coalesce(n_long, 0) AS n_long,
  {count(',')} AS commas, {count(';')} AS semicolons, {count(':')} - {count('://')} // 3 AS colons,
  len(regexp_extract_all(body, '—|--| – ')) AS dashes, len(regexp_extract_all(body, '\\b\\d+\\b')) AS digits,
  {n_words('body')} AS n_words, len(list_filter({words('body')}, lambda w: length(w) >= 7)) AS long_words,
  {_hedges()} AS hedges, coalesce(openers, CASE WHEN lang IN ({', '.join(repr(k) for k in packs.OPENERS)}) THEN 0 END) AS openers,
  CASE WHEN lang = 'en' THEN len(regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}_]+''(?:s|re|ve|ll|d|t|m)(?:$|{NOT_WORD})')) WHEN lang IN ({langs}) THEN 0 END AS contractions
  FROM {bodies} d LEFT JOIN sent_sum USING (id))"""


def sums(src: str) -> str:
    """CTEs up to `sums`: one row of sums for each text."""
    return f"""{prose(src)},
bodies AS (SELECT src.key AS id, src.key, src.lang, src.type, coalesce(string_agg(b, chr(10) || chr(10) ORDER BY n) FILTER (NOT heading), '') AS body, count(b) FILTER (NOT heading) AS n_para
  FROM src LEFT JOIN prose USING (key) GROUP BY src.key, src.lang, src.type),
{counted('bodies')}"""


SUMS = "n_para n_sent sum_len sumsq_len n_short n_long commas semicolons colons dashes digits n_words long_words hedges openers contractions".split()


def values() -> dict[str, str]:
    s, w, p = "greatest(n_sent, 1)", "greatest(n_words, 1)", "greatest(n_para, 1)"
    return {
        "sentence_length_sd": f"sqrt(greatest(sumsq_len / {s} - (sum_len / {s}) * (sum_len / {s}), 0.0))",
        "sentences_per_paragraph": f"n_sent / {p}",
        "long_sentence_share": f"n_long / {s}",
        "sentence_length_mean": f"sum_len / {s}",
        "commas_per_sentence": f"commas / {s}",
        "semicolons_per_1k": f"semicolons * 1000 / {w}",
        "conjunction_opener_share": f"openers / {s}",
        "contractions_per_1k": f"contractions * 1000 / {w}",
        "dashes_per_1k": f"dashes * 1000 / {w}",
        "colons_per_1k": f"colons * 1000 / {w}",
        "short_sentence_share": f"(n_short + CASE WHEN n_sent = 0 THEN 1 ELSE 0 END) / {s}",
        "long_word_share": f"long_words / {w}",
        "hedges_per_1k": f"hedges * 1000 / {w}",
        "digits_per_1k": f"digits * 1000 / {w}",
    }


def value_columns(digits: int = 6) -> str:
    return ", ".join(f"round({v}, {digits}) AS {k}" for k, v in values().items())


def melted(rel: str, keep: str) -> str:
    return " UNION ALL ".join(f"SELECT {keep}, '{m}' AS metric, {m} AS value FROM {rel} WHERE {m} IS NOT NULL" for m in values())


def metric_table() -> str:
    rows = ", ".join(f"('{m}', {v[0]}, {v[1]}, {v[2]}, {v[3]}, {str(v[4]).lower()}, {i})" for i, (m, v) in enumerate(packs.METRICS.items()))
    return f"metric_table(metric, overshoot, shortfall, tolerance, floor, sparse, place) AS (SELECT metric, overshoot::DOUBLE, shortfall::DOUBLE, tolerance::DOUBLE, floor::DOUBLE, sparse, place FROM (VALUES {rows}) t(metric, overshoot, shortfall, tolerance, floor, sparse, place))"

"""The trial's measures in SQL for another engine, written apart from the operator; only comparisons use it."""

from __future__ import annotations

from . import oracle as O

_NW = O.NOT_WORD
_W = "[A-Za-z][A-Za-z''-]*"
_DOUBLED = {"{t}": f"regexp_replace(t, '({_NW})', '\\1\\1', 'g')", "{low}": f"regexp_replace(lower(t), '({_NW})', '\\1\\1', 'g')"}


def _count(pattern: str, of: str = "t") -> str:
    return f"len(regexp_extract_all({of}, '{pattern}'))"


def _words(phrases: str) -> str:
    alts = "|".join(p.replace(" ", "  ") for p in phrases.split("/"))
    return _count(f"(?:^|{_NW})(?:{alts})(?:$|{_NW})", _DOUBLED["{low}"])


_PER = {
    "semicolons": _count(";"), "colons": "(" + _count(":") + " - " + _count("://") + ")", "dashes": _count("—|--| – "), "parentheses": _count("\\("), "questions": _count("\\?"), "exclamations": _count("!"),
    "ellipses": _count("\\.\\.\\.|…"), "quotes": _count('["“]') + " / 2", "digits": _count(f"(?:^|{_NW})[0-9]+(?:$|{_NW})", _DOUBLED["{t}"]),
    "first_singular": _words("i/me/my/mine/myself"), "first_plural": _words("we/us/our/ours/ourselves"), "second_person": _words("you/your/yours/yourself"),
    "hedges": _words("perhaps/maybe/might/arguably/somewhat/possibly/probably/seems/seem/seemingly/i suspect/in some sense/it may be/likely/rather/fairly/quite"),
    "formal_connectives": _words("moreover/furthermore/additionally/consequently/nevertheless/nonetheless/therefore/thus/hence/however/in addition/it is worth noting"),
    "contractions": _count(f"[\\p{{L}}\\p{{N}}_]+''(?:s|re|ve|ll|d|t|m)(?:$|{_NW})", "lower(t)"), "ly_adverbs": _count(f"[\\p{{L}}\\p{{N}}_]{{3,}}ly(?:$|{_NW})", "lower(t)"),
    "passive": _count(f"(?:^|{_NW})(?:is|are|was|were|be|been|being)\\s+[\\p{{L}}\\p{{N}}_]+ed(?:$|{_NW})", _DOUBLED["{low}"]),
}
_MARKED = "regexp_replace(regexp_replace(t, '\\s+', ' ', 'g'), '([.!?])[\"'')\\]]*\\s+([\"''(\\[]?[A-Z0-9])', '\\1' || chr(31) || '\\2', 'g')"
_EMPTY = "coalesce(list_sum({0}), 0)"
METRICS = f"""WITH c AS (SELECT doc_id AS key, trim(translate(regexp_replace(regexp_replace(coalesce(text, ''), '<!--(?s:.*?)-->', '', 'g'), '^---(?s:.*?)---', ''), '’‘', ''''''), chr(32) || chr(10) || chr(9) || chr(13)) AS t FROM documents),
w AS (SELECT key, t, regexp_extract_all(t, '{_W}') AS ws, list_filter(string_split({_MARKED}, chr(31)), lambda s: trim(s) <> '') AS ss, greatest(len(list_filter(string_split(t, chr(10) || chr(10)), lambda p: regexp_matches(p, '\\S'))), 1) AS np FROM c),
v AS (SELECT *, greatest(len(ws), 1) AS nw, CASE WHEN len(ss) > 0 THEN list_transform(ss, lambda s: len(regexp_extract_all(s, '{_W}'))) ELSE [0] END AS sl, list_transform(ws, lambda x: lower(x)) AS lw, greatest(len(ss), 1) AS ns FROM w)
SELECT key, round(list_avg(sl), 6) AS sentence_length_mean, round(sqrt(greatest(list_avg(list_transform(sl, lambda x: x * x)) - list_avg(sl) ** 2, 0)), 6) AS sentence_length_sd,
  round(len(list_filter(sl, lambda x: x < 8)) / len(sl), 6) AS short_sentence_share, round(len(list_filter(sl, lambda x: x > 28)) / len(sl), 6) AS long_sentence_share, round(len(ss) / np, 6) AS sentences_per_paragraph,
  round(nw / np, 6) AS words_per_paragraph, round(len(regexp_extract_all(t, ',')) / ns, 6) AS commas_per_sentence, {', '.join(f'round({v} * 1000 / nw, 6) AS {k}_per_1k' for k, v in _PER.items())},
  round(len(list_filter(ss, lambda s: lower(regexp_extract(s, '{_W}')) IN ('and', 'but', 'so', 'or', 'yet', 'then'))) / ns, 6) AS conjunction_opener_share,
  round(CASE WHEN len(lw) < 100 THEN len(list_distinct(lw)) / nw ELSE list_avg(list_transform(range(0, len(lw) - 99, 10), lambda i: len(list_distinct(lw[i + 1:i + 100])) / 100)) END, 6) AS type_token_mattr,
  round(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) / nw, 6) AS word_length_mean, round(len(list_filter(ws, lambda x: length(x) >= 7)) / nw, 6) AS long_word_share FROM v"""

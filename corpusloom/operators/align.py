"""Alignment of a draft with its edited version, and a small language scorer: Arrow-batched pandas UDFs."""

from __future__ import annotations

import difflib
import re

import pandas as pd
import regex
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import packs

WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|['-])*")
TOKEN = re.compile(r"\w+")
SENTENCE = regex.compile(r"""(?V1)(?<=[.!?])["')\]]* +(?=["'(\[]?(?:[A-Z0-9À-ÖØ-Þ]|[Ā-ԯ&&\p{Lu}]))""")
PAIR = T.ArrayType(T.StructType([T.StructField("before", T.StringType()), T.StructField("after", T.StringType())]))
#: How many sentences of the one side a unit takes for how many of the other; on ties the first.
UNITS = ((1, 1), (1, 2), (2, 1), (1, 3), (3, 1), (1, 0), (0, 1))


def sentences(text: str) -> list[str]:
    return [s for s in SENTENCE.split(re.sub(r"\s+", " ", text or "").strip()) if s.strip()]


def _matcher(a, b) -> difflib.SequenceMatcher:
    return difflib.SequenceMatcher(None, a, b, autojunk=False)


def share(before: str | None, after: str | None) -> float:
    """Words and numbers of `before` that `after` keeps in order, as a share."""
    a, b = [TOKEN.findall((x or "").lower()) for x in (before, after)]
    return round(sum(m.size for m in _matcher(a, b).get_matching_blocks()) / len(a), 6) if a else 0.0


def _runs(before: str | None, after: str | None) -> list[tuple[list[str], list[str]]]:
    """Runs of sentences that differ; white space alone makes no difference, the case of a letter does."""
    a, b = sentences(before), sentences(after)
    return [(a[i:j], b[k:m]) for tag, i, j, k, m in _matcher(a, b).get_opcodes() if tag != "equal"]


def changes(before: str | None, after: str | None) -> list[tuple[str, str]]:
    """Runs of sentences that differ, with what took their place."""
    return [(" ".join(x), " ".join(y)) for x, y in _runs(before, after)]


def paired(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """The sentences of one changed run in units, so that the units are as alike as can be in total.

    The table is filled from the ends: row i holds, for each j, the best total of a[i:] and b[j:] and the unit
    it begins with. A unit counts its likeness once for every sentence of its longer side; on a tie the unit that
    stands first in UNITS begins.
    """
    rows: list[list[tuple[float, tuple[int, int]]]] = []  # rows[k] is row len(a) - k
    for i in range(len(a), -1, -1):
        row = [(0.0, (0, 0))] * (len(b) + 1)
        for j in range(len(b), -1, -1):
            options = []
            for place, (x, y) in enumerate(UNITS):
                if i + x <= len(a) and j + y <= len(b):
                    further = row[j + y][0] if not x else rows[len(a) - i - x][j + y][0]
                    alike = max(x, y) * _matcher(" ".join(a[i : i + x]), " ".join(b[j : j + y])).ratio() if x and y else 0.0
                    options.append((further + alike, -place))
            if options:
                total, place = max(options)
                row[j] = (total, UNITS[-place])
        rows.append(row)
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        x, y = rows[len(a) - i][j][1]
        out.append((" ".join(a[i : i + x]), " ".join(b[j : j + y])))
        i, j = i + x, j + y
    return out


def units(before: str | None, after: str | None) -> list[tuple[str, str]]:
    """Every edit between two versions: changed runs as one-to-one edits, splits, merges, cuts and insertions."""
    return [(x, y) for run in _runs(before, after) for x, y in paired(*run) if x != y]


#: what became of a unit
KINDS = ("insert", "cut", "split", "merge", "case", "marks", "trim", "expand", "reword")


def kind(before: str, after: str) -> str:
    """The kind of an edit, from its two sides alone."""
    if not before or not after:
        return "insert" if after else "cut"
    n, m = len(sentences(before)), len(sentences(after))
    if n != m:
        return "split" if m > n else "merge"
    if before.lower() == after.lower():
        return "case"
    a, b = TOKEN.findall(before.lower()), TOKEN.findall(after.lower())
    if a == b:
        return "marks"
    kept = sum(x.size for x in _matcher(a, b).get_matching_blocks())
    return "trim" if kept == len(b) else "expand" if kept == len(a) else "reword"


@F.pandas_udf(T.DoubleType())
def token_share(before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([share(x, y) for x, y in zip(before, after, strict=True)])


@F.pandas_udf(PAIR)
def sentence_changes(before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([[{"before": p, "after": q} for p, q in changes(x, y)] for x, y in zip(before, after, strict=True)])


@F.pandas_udf(PAIR)
def aligned_units(before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([[{"before": p, "after": q} for p, q in units(x, y)] for x, y in zip(before, after, strict=True)])


@F.pandas_udf(T.StringType())
def edit_kind(before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([kind(x or "", y or "") for x, y in zip(before, after, strict=True)])


LETTERS = {"de": "äöüß", "fr": "èêçàâîôûœ", "es": "ñóíáú"}


def identify(text: str | None) -> tuple[str, float]:
    """A language and the share of its evidence: openers, hedges and letters that are its own."""
    low = (text or "").lower()
    words = WORD.findall(low)
    if not words:
        return "und", 0.0
    score = {k: sum(w in set(packs.OPENERS[k]) for w in words) + sum(low.count(c) for c in LETTERS.get(k, "")) for k in packs.OPENERS}
    score["en"] += sum(w in set(packs.STOPWORDS["en"]) for w in words)
    best = max(sorted(score), key=lambda k: score[k])
    total = sum(score.values())
    return (best, round(score[best] / total, 6)) if total else ("und", 0.0)


@F.pandas_udf(T.StructType([T.StructField("code", T.StringType()), T.StructField("confidence", T.DoubleType())]))
def identified(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([identify(t) for t in text], columns=["code", "confidence"])

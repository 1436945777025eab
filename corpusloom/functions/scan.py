"""The style scan: one pass over a text gives its sixteen sums, and those of its windows.

The same counts as the Column expressions of operators/style.py (tests hold both against each other), in Arrow batches:
higher-order functions are interpreted element by element, and the pass of compiled patterns takes about half the time.
A batch stays in Arrow's buffers: one text at a time is a Python string, so a worker's memory does not grow with a batch's rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import functions as F

from . import packs
from . import text as T

WORD = regex.compile(T.WORD)
SENTENCE_END = regex.compile("(?V1)" + T.SENTENCE_END)
HEADING_END, REFERENCE, QUOTED = regex.compile(T.HEADING_END), regex.compile(T.REFERENCE_HEADING), regex.compile(T.QUOTED)
COMMENT, FRONT, BLANK_LINE, GAP, SPACE = (regex.compile(p) for p in (r"(?s)<!--.*?-->", r"(?s)^---.*?---", r"\n\s*\n", "[ \t]{2,}", r"\s+"))
COLON, DASH, NUMBER = (regex.compile(p) for p in (":(?!//)", "—|--| – ", r"\b\d+\b"))


def _unquoted(block: str) -> str:
    if '"' in block or "“" in block:
        block = QUOTED.sub(lambda m: "" if len(WORD.findall(m[0])) >= T.QUOTE_MIN_WORDS else m[0], block)
    return GAP.sub(" ", block)


@functools.cache
def _lists(lang: str | None) -> tuple:
    """Hedges, openers and contractions of a language, compiled; null where its pack has none."""
    hedges = regex.compile(rf"\b(?:{packs.alternatives(packs.HEDGES[lang])})\b") if lang in packs.HEDGES else None
    openers = frozenset(packs.OPENERS[lang]) if lang in packs.OPENERS else None
    return hedges, openers, [regex.compile(p) for p in packs.CONTRACTIONS[lang]] if lang in packs.CONTRACTIONS else None


def paragraphs(text: str | None) -> list[str]:
    """The same as text.paragraphs."""
    t = FRONT.sub("", COMMENT.sub("", text or "")).replace("’", "'").replace("‘", "'")
    paras = []
    for block in filter(None, (b.strip() for b in BLANK_LINE.split(t))):
        heading = "\n" not in block and not HEADING_END.search(block) and len(WORD.findall(block)) < T.HEADING_WORDS
        if heading and REFERENCE.search(block):
            break
        lines = [x.strip() for x in block.split("\n") if x.strip()] if block[0] in "|>" else ()
        if lines and any(all(x.startswith(s) for x in lines) for s in "|>"):
            continue
        block = _unquoted(block).strip()
        if WORD.search(block) and not heading:
            paras.append(block)
    return paras


def counted(paras: list[str], lang: str | None) -> tuple:
    """The sixteen sums of paragraphs, in the order of style.SUMS."""
    hedges, openers, contractions = _lists(lang)
    body = "\n\n".join(paras)
    low = body.lower()
    sents = [s for s in SENTENCE_END.split(SPACE.sub(" ", body)) if s.strip()]
    found = [WORD.findall(s) for s in sents]  # no word reaches over the end of a sentence
    lengths = [len(ws) for ws in found]
    return (
        len(paras), len(sents), sum(lengths), sum(n * n for n in lengths), sum(n < 8 for n in lengths), sum(n > 28 for n in lengths),
        body.count(","), body.count(";"), len(COLON.findall(body)), len(DASH.findall(body)), len(NUMBER.findall(body)),
        sum(lengths), sum([len(w) >= 7 for ws in found for w in ws]),
        None if hedges is None else len(hedges.findall(low)),
        None if openers is None else sum((ws[0].lower() if ws else "") in openers for ws in found),
        None if contractions is None else sum(len(p.findall(low)) for p in contractions),
    )


def sums_of(text: str | None, lang: str | None) -> tuple:
    """The sixteen sums of a text, in the order of style.SUMS."""
    return counted(paragraphs(text), lang)


def windows_of(paras: list[str], size: int) -> Iterator[tuple[int, list[str]]]:
    """Paragraphs gathered until they hold `size` words, with these words; a short rest is dropped."""
    now, n = [], 0
    for p in paras:
        now.append(p)
        n += len(WORD.findall(p))
        if n >= size:
            yield n, now
            now, n = [], 0


def _refresh(lists: dict) -> None:
    """The language packs of the driver, which may have read some from a folder."""
    if any(packs.LISTS[k] != v for k, v in lists.items()):
        for k, v in lists.items():
            packs.LISTS[k].clear()
            packs.LISTS[k].update(v)
        _lists.cache_clear()


def scan(names: tuple[str, ...], window: int | None = None):
    """An Arrow UDF of (text, language) to a struct of the sums; the language packs are those of the time it is made.

    With `window` the struct has also `windows`, an array of w, window_words and the sums of each window of that many words.
    """
    lists = {k: dict(v) for k, v in packs.LISTS.items()}
    sums = ", ".join(f"{n} long" for n in names)
    inner = pa.struct([(n, pa.int64()) for n in ("w", "window_words", *names)])

    @F.arrow_udf(sums if window is None else f"{sums}, windows array<struct<w long, window_words long, {sums}>>")
    def run(texts: pa.Array, langs: pa.Array) -> pa.Array:
        _refresh(lists)
        rows, wins, ends = [], [], [0]
        for t, c in zip(texts, langs, strict=True):
            paras, lang = paragraphs(t.as_py()), c.as_py()
            rows.append(counted(paras, lang))
            if window is not None:
                wins += [(w, n, *counted(ps, lang)) for w, (n, ps) in enumerate(windows_of(paras, window))]
                ends.append(len(wins))
        columns = [pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * len(names))]
        if window is None:
            return pa.StructArray.from_arrays(columns, list(names))
        parts = [pa.array(x, pa.int64()) for x in (zip(*wins, strict=True) if wins else [[]] * inner.num_fields)]
        listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, [f.name for f in inner]))
        return pa.StructArray.from_arrays([*columns, listed], [*names, "windows"])

    return run

"""Operator 5: language identification by language-bitmask n-gram filters.

Training counts character n-grams of the labelled texts by language. An n-gram belongs to a language if
its relative frequency there is at least `MIN_SHARE` and within `RATIO` of its highest in any language; so
a language has at most 1 / MIN_SHARE of them, however large the corpus. The sets go into bit-sliced Bloom filters: one table of cells, each a
bit mask over languages, so that the AND of an n-gram's cells is the mask of all languages that hold it.
Prediction counts the bits of each language over the text's n-grams, takes off the false positives that
the filter's fill leads one to expect, and takes the language with most; ties go to the first by name.

Defined cases: `und` with score 0 if the text is null or has no letter, or if nothing was learned; labelled
rows with null text or lang teach nothing; repeated rows count as often as they occur; other columns are
ignored, and lang, source and doc_id are no inputs of a prediction; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: n-gram length in letters, with a blank at either end of a word
SIZE = 3
MIN_SHARE = 1e-5
RATIO = 0.2
CELLS = 1 << 20
PROBES = 4
#: code points hashed at once
CHUNK = 1 << 18
RESULT = "doc_id {}, held_out boolean, lang_pred string, score double"

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For each code point of the basic plane the lower-case code point of a letter, else a blank."""
    global _LETTER
    if _LETTER is None:
        own = [ord(c.lower()[0]) if (c := chr(i)).isalpha() else 32 for i in range(0x10000)]
        _LETTER = np.array(own, dtype=np.uint32)
    return _LETTER


def codes(text: str | None) -> Iterator[np.ndarray]:
    """64-bit codes of the text's n-grams: letters of a word with a blank before and after, chunk by chunk."""
    raw = np.frombuffer((text or "").encode("utf-32-le"), dtype="<u4")
    for at in range(0, len(raw), CHUNK):
        part = raw[max(at - SIZE + 1, 0) : at + CHUNK]
        low = _letters()[np.minimum(part, 0xFFFF)]
        if len(part) and part.max() > 0xFFFF:
            high = part > 0xFFFF
            low[high] = [c if chr(c).isalpha() else 32 for c in part[high].tolist()]
        if at == 0:
            low = np.concatenate([[32], low])
        if at + CHUNK >= len(raw):
            low = np.concatenate([low, [32]])
        low = low.astype(np.uint64)
        gram = low[: len(low) - SIZE + 1].copy()
        letter = gram != 32
        for k in range(1, SIZE):
            nxt = low[k : len(low) - SIZE + 1 + k]
            gram = (gram << np.uint64(21)) | nxt
            letter |= nxt != 32
        inner = low[1 : len(low) - SIZE + 2] if SIZE == 3 else None
        yield gram[letter & (inner != 32)] if inner is not None else gram[letter]



def held_out() -> F.Column:
    """Whether crc32 of the doc_id as text leaves 1 when divided by 3; such rows teach nothing."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, gram, n over all labelled rows of `docs`."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
        return grams, np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(grams)).astype(np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                parts, size = [known[lang]] if lang in known else [], 0
                for grams in (g for t in texts for g in codes(t)):
                    parts.append((grams, np.ones(len(grams), dtype=np.int64)))
                    size += len(grams)
                    if size > 1 << 20:
                        parts, size = [merged(parts)], 0
                known[lang] = merged(parts)
        for lang, (grams, n) in known.items():
            yield pd.DataFrame({"lang": lang, "gram": grams.view(np.int64), "n": n})

    labelled = docs.where("lang is not null and text is not null").select("lang", "text")
    return labelled.mapInPandas(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Filter:
    """Bit-sliced Bloom filters: cells[c] has one bit for each language, 64 to a word."""

    def __init__(self, grams: dict[str, np.ndarray], n_cells: int = CELLS):
        self.langs = sorted(grams)
        self.cells = np.zeros((-(-max(len(self.langs), 1) // 64), n_cells), dtype=np.uint64)
        for i, lang in enumerate(self.langs):
            for cell in self.probes(grams[lang]):
                self.cells[i // 64][cell] |= np.uint64(1 << i % 64)
        #: share of n-grams that a language's filter passes by chance
        self.false = np.array([((self.cells[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() ** PROBES for i in range(len(self.langs))])

    def probes(self, grams: np.ndarray) -> Iterator[np.ndarray]:
        h = grams.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        a, b = h >> np.uint64(32), (h & np.uint64(0xFFFFFFFF)) | np.uint64(1)
        for k in range(PROBES):
            yield ((a + np.uint64(k) * b) % np.uint64(self.cells.shape[1])).astype(np.int64)

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """The mask of languages of every n-gram, words of 64 languages as rows."""
        out = None
        for cell in self.probes(grams):
            got = self.cells[:, cell]
            out = got if out is None else out & got
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        counts, n = np.zeros(len(self.langs)), 0
        for grams in codes(text):
            n += len(grams)
            if len(grams) and self.langs:
                masks = self.masks(grams)
                for i in range(len(self.langs)):
                    counts[i] += np.count_nonzero(masks[i // 64] & np.uint64(1 << i % 64))
        if not n or not self.langs:
            return "und", 0.0
        true = np.clip((counts - n * self.false) / (1 - np.minimum(self.false, 0.999)), 0, n)
        best = int(true.argmax())
        return self.langs[best], float(true[best] / true.sum()) if true.sum() > 0 else 1.0 / len(self.langs)


def learn(docs: DataFrame) -> Filter:
    """The filter of the labelled rows of `docs` that are not held out.

    The driver gets the n-grams that belong to a language: 1 / MIN_SHARE for each language at most.
    """
    counts = checkpointed(count_grams(docs.where(~held_out())))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.join(totals, "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("share")).where(F.col("share") >= MIN_SHARE)
    top = shares.groupBy("gram").agg(F.max("share").alias("top"))
    got = shares.join(top, "gram").where(F.col("share") >= RATIO * F.col("top")).select("lang", "gram").toPandas()
    return Filter({lang: g.to_numpy(dtype=np.int64) for lang, g in got.groupby("lang")["gram"]})


def identify(docs: DataFrame, model: Filter) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the share of the language's n-grams among all languages') of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for b in batches:
            found = [model.predict(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "lang_pred": [x[0] for x in found], "score": [x[1] for x in found]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInPandas(run, RESULT.format(kind))


def language_id(docs: DataFrame) -> DataFrame:
    """`learn` and `identify` over the same rows."""
    return identify(docs, learn(docs))

"""Operator 8: line dedup by winnowing over line hashes.

Lines are wrapped at every word: a line is `WIDTH` words from any word on, whatever the line breaks are, so
a passage is found wherever it begins and ends. Winnowing selects in each window of `min_words - WIDTH + 1`
such lines the one with the least hash (the first of equals) as fingerprint: a run of `min_words` words is one
window, so places that share it share a fingerprint, at the same distance from the run, which is guaranteed.

Positions of equal fingerprints are joined. Windows around one position are a piece; equal pieces, the common case,
are counted as one, and the first of their places is kept. A match is extended both ways by comparing, window by
window, the words before and behind the fingerprint: of every window the earliest place among all pieces of that
fingerprint is found. A window whose earliest place is not its own is a later repeat, and every word in one is
deleted; what is first stays. There is no bound on how far a match reaches nor on how many sources a run has: the
result is exactly the words in runs of `min_words` that occur at an earlier place, in junk of one repeated word too.

An earlier place is one with a smaller doc_id, then a smaller hash of the text, then a smaller position. Pairs of
positions are never made: sources are minima, pre-aggregated, and all joins are equi-joins that Spark can split.
Texts are shuffled in part: those that are the source of a piece with relatives, and those that lose words.

Defined cases: a null text stays null and an empty one empty; a row with a null doc_id comes before all
others; rows that agree in doc_id and text are one position, so neither is later than the other; a deleted
run takes the white space behind it, but a line that keeps words before the run keeps its end; a document
may become empty, and its row stays; an empty table gives no rows; further columns pass through untouched. Repeated
lines of fewer than `min_words` words stay, unless their neighbours repeat with them.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .common import checkpointed
from .words import parts

MIN_WORDS = 50
#: words of a line
WIDTH = 12
DONE = "n_words long, n_lines long, n_removed long, n_removed_words long, text string"
KINDS = pa.struct([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in DONE.split(", ")])
#: texts that are worked on at a time
TOGETHER = 500


def repeated_places(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, tag (hash of the text), at and mask: the pieces that hold a later repeat, and which of their windows are one."""
    if min_words < 2 * WIDTH:
        raise ValueError(f"min_words must be {2 * WIDTH} or more, so that windows have enough lines of {WIDTH} words to choose from")
    rows = repeats.met_pieces(docs, min_words, WIDTH)
    place = F.struct("doc_id", "tag", "at")
    kinds = rows.groupBy("anchor", "words").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("size", "line", "before", "behind")], F.min(place).alias("first"))
    kinds = checkpointed(kinds)
    asked = kinds.select("anchor", "words", "n", "size", "line", "first.*").join(repeats.related(kinds), ["anchor", "words"])
    windows = repeats.edges(docs, asked, min_words, WIDTH, placed=True)
    earliest = windows.groupBy("anchor", "edge").agg(F.min("mark").alias("low"), F.max("mark").alias("high")).where("low < high").select("anchor", "edge", "low")
    later = windows.join(earliest, ["anchor", "edge"]).where("low < mark").groupBy("anchor", "words").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("part"))
    known = kinds.join(later, ["anchor", "words"], "left").where("n > 1 or part is not null").select("anchor", "words", "first", F.coalesce("part", F.lit(0).cast("long")).alias("part"))
    known = checkpointed(known)  # a join of two plain shuffles can be split at a hot piece
    mask = F.when(place.eqNullSafe(F.col("first")), F.col("part")).otherwise(repeats.full())
    return rows.join(known, ["anchor", "words"]).select("doc_id", "tag", "at", mask.alias("mask")).where("mask <> 0")


def _lines(text: str) -> int:
    return sum(1 for x in text.split("\n") if x.strip(" \t\r\x0b\x0c"))


def _without(min_words: int):
    def one(text: str | None, places: pa.ListScalar, masks: pa.ListScalar) -> tuple:
        n = sum(map(len, parts(text))) if text else 0
        before = _lines(text or "")
        if not places.is_valid or not len(places.values) or not n:
            return n, before, 0, 0, text
        gone = repeats.covered(n, places.values.to_numpy(), masks.values.to_numpy(), min_words)
        left = repeats.without(text, gone)
        return n, before, before - _lines(left), int(gone.sum()), left

    def run(texts: pa.Array, at: pa.Array, mask: pa.Array) -> pa.Array:
        """A batch stays in Arrow's buffers; `TOGETHER` texts at a time are Python strings."""
        out = [pa.array([], KINDS)]
        for lo in range(0, len(texts), TOGETHER):
            some = [x.slice(lo, TOGETHER) for x in (texts, at, mask)]
            columns = zip(*[one(t.as_py(), a, m) for t, a, m in zip(*some, strict=True)], strict=True)
            out.append(pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, KINDS, strict=True)], fields=list(KINDS)))
        return pa.concat_arrays(out)

    return F.arrow_udf(run, DONE)


def _deduped(docs: DataFrame, min_words: int) -> DataFrame:
    rows = repeats.with_places(docs, repeated_places(docs, min_words))
    return rows.select("row", _without(min_words)("row.text", "at", "mask").alias("done"))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_words, n_lines, n_removed (lines), n_removed_words and the text that is left, for every document."""
    return _deduped(docs.select("doc_id", "text"), min_words).select("row.doc_id", "done.*")


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows and columns of `docs`, with repeated runs taken out of the text."""
    return _deduped(docs, min_words).select(*[F.col("done.text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])

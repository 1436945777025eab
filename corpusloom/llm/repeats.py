"""Runs of words that occur twice: what line dedup and substring dedup share.

All runs of `window` words of a text (edges) are dealt to pieces: neighbours whose least line of `width` words, the
leftmost of equals, stands at one place (the anchor). Winnowing guarantees that equal edges have equal anchors at
one distance, whatever stands around them, so edges are compared within the pieces of one anchor only. A piece has
at most `LONGEST` edges, as they are the bits of one number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, packed, ranked
from .words import BLANKS, Runs, mixed, parts

#: rows of a list of texts that is still broadcast; beyond it all texts are shuffled
MAX_BROADCAST = 500_000
#: edges of a piece
LONGEST = 62
#: words of a text that places tell apart
MOST_WORDS = 1 << 28
#: signs of texts that are worked on as one array
TOGETHER = 1_000_000
#: bits of the filter of anchors: it is the one thing that goes through the driver, so 16 MB is its most
MOST_BITS = 1 << 27


def hashed(text: str) -> np.ndarray:
    """A 64-bit hash of each word."""
    found = [pd.util.hash_array(np.array(words, dtype=object), categorize=False) for words in parts(text) if words]
    return found[0] if len(found) == 1 else np.concatenate([np.zeros(0, dtype=np.uint64), *found])


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` values the place of the least one, by the upper half of its bits."""
    n = len(values) - width + 1
    low = (values & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(values), dtype=np.uint64)
    size = 1
    while 2 * size <= width:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    return (np.minimum(low[:n], low[width - size : width - size + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def pieces(texts: list[str], window: int, width: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The number of pieces of each text, and the columns of all pieces in order: at, size (edges), line (where the anchor
    stands, from at on), anchor, words (hashes), before and behind (hashes of the anchor with half an edge to that side, 0 where the text ends first), u and v (hashes of
    the runs of one word less at the piece's ends). The texts are worked on as one array."""
    found = [hashed(t) for t in texts]
    sizes = np.array([len(x) for x in found], dtype=np.int64)
    words = np.concatenate(found)
    begin, n = np.cumsum(sizes) - sizes, np.maximum(sizes - window + 1, 0)
    if not n.any():
        return np.zeros(len(texts), dtype=np.int64), [np.zeros(0, dtype=np.int64)] * len(COLUMNS)
    runs = Runs(words)
    starts = np.arange(len(words) - width + 1)
    lines = mixed(runs(starts, starts + width))
    owner = np.repeat(np.arange(len(texts)), n)  # of every edge
    edge = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + begin[owner]
    anchor = leftmost_least(lines, window - width + 1)[edge]
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])]))
    size = np.diff(np.append(first, len(edge)))
    if window - width + 1 > LONGEST:  # long pieces are cut; where does not matter
        cuts = -(-size // LONGEST)
        first = np.repeat(first, cuts) + LONGEST * (np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts))
        size = np.diff(np.append(first, len(edge)))
    at, line, own = edge[first], anchor[first], owner[first]
    half = (window - width + 1) // 2
    lo, hi, end = line - half, line + width + half, begin[own] + sizes[own]
    before, behind = mixed(runs(np.maximum(lo, 0), line + width)), mixed(runs(line, np.minimum(hi, len(words))))
    before[lo < begin[own]], behind[hi > end] = 0, 0
    whole = mixed(runs(at, at + size + window - 1))
    nodes = [mixed(runs(x, x + window - 1)) for x in (at, at + size)]
    return np.bincount(own, minlength=len(texts)), [(at - begin[own]).astype(np.int32), size.astype(np.int32), (line - at).astype(np.int32), lines[line], whole, before, behind, *nodes]


COLUMNS = ("at", "size", "line", "anchor", "words", "before", "behind", "u", "v")


def _array(x: np.ndarray, c: str) -> pa.Array:
    return pa.array(x.astype(np.int32)) if c in COLUMNS[:3] else pa.array(x.view(np.int64))


def _groups(texts: list[str | None], least: int) -> Iterator[list[int]]:
    """Indices of the texts that are long enough, about a million signs together."""
    group, total = [], 0
    for k, t in enumerate(texts):
        if t and len(t) >= least:
            group.append(k)
            total += len(t)
            if total > TOGETHER:
                yield group
                group, total = [], 0
    if group:
        yield group


def _pieces(window: int, width: int, columns: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                texts = b["text"].to_pylist()
                for group in _groups(texts, 2 * window - 1):
                    counts, found = pieces([texts[k] for k in group], window, width)
                    some = counts > 0
                    rows, ends = pa.array(np.array(group)[some]), pa.array(np.concatenate([[0], np.cumsum(counts[some])]).astype(np.int32))
                    lists = [pa.ListArray.from_arrays(ends, _array(x, c)) for c, x in zip(columns, found, strict=False)]
                    yield pa.RecordBatch.from_arrays([b["doc_id"].take(rows), b["tag"].take(rows), *lists], names=["doc_id", "tag", *columns])

    return run


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, tag (hash of the text) and text."""
    return docs.select("doc_id", F.xxhash64("text").alias("tag"), "text")


def _bitmap(anchors: DataFrame) -> np.ndarray:
    """A filter of the anchors: bit a mod its length is set for each anchor a. It has 32 bits an anchor, and `MOST_BITS` at most."""
    bits = min(MOST_BITS, 1 << max(20, (32 * anchors.count()).bit_length()))
    slot = F.col("anchor").bitwiseAND(F.lit(bits - 1))
    words = anchors.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(anchor & 63 as int))")).alias("bits"))
    rows = words.toArrow()  # two numbers for each word of the filter, never a Python object for each
    out = np.zeros(bits // 64, dtype=np.int64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out


def _passed(shared, columns: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = shared.value
        for b in batches:
            anchor = b["anchor"].flatten().to_numpy()
            slot = anchor & np.int64(64 * len(filled) - 1)
            keep = np.flatnonzero(filled[slot >> 6] >> (slot & 63) & 1)
            owner = pa.array(np.repeat(np.arange(b.num_rows), np.diff(b["anchor"].offsets.to_numpy()))[keep])
            flat = [b[c].flatten().take(pa.array(keep)) for c in columns]
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(owner), b["tag"].take(owner), *flat], names=["doc_id", "tag", *columns])

    return run


def met_pieces(docs: DataFrame, window: int, width: int, nodes: bool = False) -> DataFrame:
    """doc_id, tag, at, size, line, anchor, words, before, behind (and u, v) of the pieces whose anchor occurs twice.

    Most anchors occur once. A filter of bits drops nearly all of these before the join that decides; it has a
    bound of its own, and where it is full the join alone does the work.
    """
    columns = COLUMNS if nodes else COLUMNS[:-2]
    kind = docs.schema["doc_id"].dataType.simpleString()
    types = {c: "int" if c in COLUMNS[:3] else "long" for c in columns}
    found = checkpointed(keyed(docs).mapInArrow(_pieces(window, width, columns), f"doc_id {kind}, tag long, {', '.join(f'{c} array<{t}>' for c, t in types.items())}"))
    often = found.select(F.explode("anchor").alias("anchor")).groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1")
    often = checkpointed(often.select("anchor"))  # a join of two plain shuffles can be split at a hot anchor
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(often))
    rows = found.mapInArrow(_passed(shared, columns), f"doc_id {kind}, tag long, {', '.join(f'{c} {t}' for c, t in types.items())}")
    return checkpointed(rows.join(often, "anchor", "left_semi"))


def same(a: str, b: str, tag_a: str, tag_b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b)) & (F.col(tag_a) == F.col(tag_b))


ASKED = ("anchor", "words", "at", "size", "line", "sides", "n")


def _edges(window: int, width: int, placed: bool):
    half = (window - width + 1) // 2

    def edges_of(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, places = b["text"].to_pylist(), b["place"].to_numpy().astype(np.int64)
        for group in _groups(texts, 0):
            found = [hashed(texts[k]) for k in group]
            sizes = np.array([len(x) for x in found], dtype=np.int64)
            lists = {c: b[c].take(pa.array(group)) for c in ASKED}
            counts = np.diff(lists["at"].offsets.to_numpy())
            x = {c: a.flatten().to_numpy().astype(np.int64) for c, a in lists.items()}
            size = x["size"]
            of = np.repeat(np.arange(len(size)), size)
            i = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
            left = x["line"][of] - i  # what an edge has before its anchor
            met = (x["sides"][of] & 1 > 0) & (left >= half) | (x["sides"][of] & 2 > 0) & (window - width - left >= half)
            of, i = of[met], i[met]
            at = x["at"][of] + i
            begin = np.repeat(np.cumsum(sizes) - sizes, counts)[of]
            edge = mixed(Runs(np.concatenate(found))(at + begin, at + begin + window)).view(np.int64)
            mark = np.repeat(places[group], counts)[of] * MOST_WORDS + at if placed else x["n"][of]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (x["anchor"][of], x["words"][of], i.astype(np.int32), edge, mark)], names=["anchor", "words", "i", "edge", "mark"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                yield from edges_of(whole.slice(lo, 1000))

    return run


def edges(docs: DataFrame, kinds: DataFrame, window: int, width: int, placed: bool = False) -> DataFrame:
    """anchor, words, i, edge (hash), mark of those edges of `kinds` that another kind may share, from the words that stand there.

    kinds: anchor, words, n, size, line, sides (see `related`), and the place doc_id, tag, at of one source of each. mark is n, or with
    `placed` the edge's place as a number: documents in the order of doc_id (null first) and tag, then words.
    Rows that agree in doc_id and text give their edges each.
    """
    asked = kinds.groupBy(F.col("doc_id").alias("s_id"), F.col("tag").alias("s_tag")).agg(*[F.collect_list(c).alias(c) for c in ASKED])
    if placed:
        numbered = ranked(asked.select("s_id", "s_tag", F.struct(*ASKED).alias("x")), "s_id", "s_tag")
        asked = checkpointed(numbered.select("s_id", "s_tag", F.col("rank").alias("place"), "x.*"))
    else:
        asked = checkpointed(asked).withColumn("place", F.lit(0))
    tags = checkpointed(asked.select(F.col("s_tag").alias("tag")).distinct())
    texts = keyed(docs)
    some = texts.join(F.broadcast(tags), "tag", "left_semi") if tags.count() <= MAX_BROADCAST else texts
    sources = some.join(asked, same("doc_id", "s_id", "tag", "s_tag")).select("text", "place", *ASKED)
    return checkpointed(sources.mapInArrow(_edges(window, width, placed), "anchor long, words long, i int, edge long, mark long"))


def related(kinds: DataFrame) -> DataFrame:
    """(anchor, words, sides) of the kinds that can share an edge with another kind: an edge has at least half of what stands beside
    its anchor on one side, so both have the same words before it (sides 1), or behind it (2), or both (3)."""
    sides = kinds.select("anchor", "words", F.posexplode(F.array("before", "behind")).alias("k", "side")).where("side <> 0")
    shared = checkpointed(sides.groupBy("side").agg(F.min("words").alias("least"), F.max("words").alias("most")).where("least <> most").select("side"))
    return sides.join(shared, "side", "left_semi").groupBy("anchor", "words").agg(F.bit_or(F.col("k") + 1).alias("sides"))


def full() -> Column:
    """The mask of all edges of a piece."""
    return F.expr("if(size >= 63, -1L, shiftleft(1L, size) - 1)")


def covered(n: int, at: np.ndarray, mask: np.ndarray, window: int) -> np.ndarray:
    """Which of n words the edges of places cover; bit i of a place's mask stands for the edge i words behind it."""
    begins = np.zeros(n + 64, dtype=bool)
    for lo in range(0, len(at), 10_000):
        bits = np.unpackbits(mask[lo : lo + 10_000].astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(bool)
        begins[(at[lo : lo + 10_000].astype(np.int64)[:, None] + np.arange(64))[bits]] = True
    upto = np.cumsum(begins[:n], dtype=np.int32)
    upto[window:] -= upto[:-window].copy()  # edges that begin among the last `window` words
    return upto > 0


def with_places(docs: DataFrame, places: DataFrame) -> DataFrame:
    """row (the columns of `docs`) and the columns of `places` besides doc_id and tag, as arrays: null without a place.

    Texts without a place are not shuffled while the list of the others is small enough to be broadcast.
    """
    more = [c for c in places.columns if c not in ("doc_id", "tag")]
    listed = places.groupBy(F.col("doc_id").alias("at_id"), F.col("tag").alias("at_tag")).agg(*[F.collect_list(c).alias(c) for c in more])
    listed = checkpointed(listed)
    rows = packed(docs).withColumns({"own_id": F.col("row.doc_id"), "own_tag": F.xxhash64("row.text")})
    tags = checkpointed(listed.select(F.col("at_tag").alias("own_tag")).distinct())
    met = same("own_id", "at_id", "own_tag", "at_tag")
    if tags.count() > MAX_BROADCAST:
        return rows.join(listed, met, "left").select("row", *more)
    some = rows.join(F.broadcast(tags), "own_tag", "left_semi").join(listed, met, "left").select("row", *more)
    none = rows.join(F.broadcast(tags), "own_tag", "left_anti").select("row", *[F.lit(None).cast(listed.schema[c].dataType).alias(c) for c in more])
    return some.union(none)


def without(text: str, gone: np.ndarray) -> str:
    """The text without the words marked in `gone`."""
    signs = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    word = ~np.isin(signs, BLANKS)
    starts = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))  # where words begin
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    out, at = [], 0
    for i, j in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        lo, hi = int(starts[i]), int(starts[j]) if j < len(starts) else len(text)
        begins = not text[text.rfind("\n", 0, lo) + 1 : lo].strip()
        out.append(text[at:lo] if j < len(starts) else text[at:lo].rstrip(" \t\n\r\x0b\x0c"))
        if not begins and j < len(starts) and "\n" in text[lo:hi]:
            out[-1] = out[-1].rstrip(" ") + "\n"
        at = hi
    return "".join(out) + text[at:]

"""Operator 12: alignment of two tokenizers, with DuckDB inside each Arrow batch.

Space and text are cut into tokens by a byte-level BPE (A) and a SentencePiece model (B). In every batch the
tokens become two interval tables on one axis of bytes. An ASOF join gives each A token the last B token that
ends with or before it: where both end together is a cut. A window sum over the cuts numbers the groups, and a
second ASOF join, to the first cut at or behind its end, places each B token (a range join gives the same, but
took 3.5 times as long). Tokens of a group are linked, all with all, by a join of the group's distinct ids with
their numbers, so a group of very many tokens costs no more than its vocabulary.

The first pass counts for each id pair the documents that link it: once a document within a batch, then partial
counts are merged in Spark. The second pass looks the counts up. The table of counts is broadcast while it has
at most `MAX_PAIRS` rows; beyond that, documents' pairs are joined to it by shuffle.

Most of a corpus is words met before, so the tables hold every distinct segment once. A segment begins at a
space or line feed behind a visible sign; neither tokenizer reaches over such a place: A's pattern takes
white space only at the beginning of a match, and B has no piece with a space behind another sign, nor one with
a line feed. Both ends of a segment are therefore cuts. The vocabulary is searched for such pieces when it is loaded; if there is
one, or the pattern is another, whole texts are the segments. A worker remembers a bounded number of segments, by
their signs.

Defined cases: null and empty texts, and texts whose joined token bytes differ from space and text, have no tokens:
zeros and an empty `groups_sha256`; repeated rows count as documents, each for itself; an empty table gives
no rows; further columns are ignored. Memory grows with the longest text, never with the number of texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: rows of the table of counts that is still broadcast
MAX_PAIRS = 6_000_000
#: segments that a worker remembers, and those that are aligned together
REMEMBERED, TOGETHER = 400_000, 60_000
#: signs of text of one round
ROUND = 4 << 20
#: a segment: up to the next space or line feed behind a sign that is not white space
SEGMENT = re.compile(r"(?s).[^ \n]*(?:(?<=\s)[ \n][^ \n]*)*")

ALIGN = """CREATE OR REPLACE TEMP TABLE ends AS SELECT a.i, a.seg, a.id, a.e, b.e IS NOT DISTINCT FROM a.e AS cut FROM a ASOF LEFT JOIN b ON a.e >= b.e;
CREATE OR REPLACE TEMP TABLE ga AS SELECT seg, id, i, e, cut, coalesce(sum(cut::INT) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS g FROM ends;
CREATE OR REPLACE TEMP TABLE cuts AS SELECT g, e FROM ga WHERE cut;
CREATE OR REPLACE TEMP TABLE gb AS SELECT b.id, b.i, c.g FROM b ASOF JOIN cuts c ON b.e <= c.e"""
LINKS = """WITH x AS (SELECT seg, g, id, count(*) AS n FROM ga GROUP BY ALL), y AS (SELECT g, id, count(*) AS n FROM gb GROUP BY ALL)
SELECT seg, (x.id::BIGINT << 32) | y.id AS pair, sum(x.n * y.n)::BIGINT AS n FROM x JOIN y USING (g) GROUP BY ALL"""
#: documents of a round that hold each pair
COUNTS = "SELECT pair, count(*) AS docs FROM (SELECT DISTINCT doc, pair FROM held JOIN links USING (seg)) GROUP BY pair"
ROWS = "SELECT doc, pair, sum(held.n * links.n)::BIGINT AS n FROM held JOIN links USING (seg) GROUP BY ALL ORDER BY doc, pair"
#: how tokens of a text are parted: within a side, between the sides, between groups, between segments
MARKS = np.array([",", "|", ";", "\n"], dtype=object)
#: the columns of sums: whether a segment fits, and its numbers
FITS, TOTALS = 0, ("n_a", "n_b", "n_groups", "n_links")


class Index(dict):
    """Numbers of segments; those asked for the first time are listed in `new`."""

    def __init__(self, segments=()):
        super().__init__(zip(segments, range(len(segments)), strict=True))
        self.new: list[str] = []

    def __missing__(self, segment: str) -> int:
        self[segment] = n = len(self)
        self.new.append(segment)
        return n


def _row(*columns) -> np.ndarray:
    return np.stack(columns, axis=1).astype(np.int64)


class Pair:
    """Both tokenizers, and the alignment of the segments met so far."""

    def __init__(self, a_file: str, b_file: str, pattern: str):
        import duckdb
        import public_tokenizers
        import sentencepiece
        import tiktoken

        from .packing import json_vocabulary

        ranks, _ = json_vocabulary(a_file)
        self.a = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.a_size = np.zeros(max(ranks.values()) + 1, dtype=np.int32)
        self.a_size[list(ranks.values())] = [len(x) for x in ranks]
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        pieces = [self.b.id_to_piece(i) for i in range(len(self.b))]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.b_size = np.array([len(x) for x in self.b_bytes], dtype=np.int32)
        self.splits = pattern == public_tokenizers.PATTERN and not any(re.search("[^▁]▁|\n", p) for p in pieces) and self.b_ids([" x"])[0] == self.b.encode("x")
        self.names = np.array([str(i) for i in range(max(len(self.a_size), len(pieces)))], dtype=object)
        self.con = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        self.index, self.said, self.uses = Index(), [], np.zeros(0, dtype=np.int64)
        self.sums = np.zeros((0, 5), dtype=np.int64)
        self.links = [(np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]  # segment, pair, number
        self.table, self.scores = None, np.zeros((0, 2), dtype=np.int64)

    def merged(self) -> tuple[np.ndarray, ...]:
        """All links in one part."""
        if len(self.links) > 1:
            self.links = [tuple(map(np.concatenate, zip(*self.links, strict=True)))]
        return self.links[0]

    def forget(self) -> None:
        """Half of what may be remembered stays: what was used most."""
        keep = np.sort(np.argsort(-self.uses, kind="stable")[: REMEMBERED // 2])
        place = np.full(len(self.index), -1, dtype=np.int32)
        place[keep] = np.arange(len(keep), dtype=np.int32)
        segments = list(self.index)
        self.index, self.said = Index([segments[k] for k in keep]), [self.said[k] for k in keep]
        self.uses, self.sums = self.uses[keep] // 2, self.sums[keep]
        self.scores = self.scores[keep] if len(self.scores) else self.scores
        seg, pair, n = self.merged()
        stays = place[seg] >= 0
        self.links = [(place[seg[stays]], pair[stays], n[stays])]

    def segments(self, text: str) -> list[str]:
        return SEGMENT.findall(" " + text) if self.splits else [" " + text]

    def b_ids(self, segments: list[str]) -> list[list[int]]:
        """B's ids of segments wherever they stand: behind a line feed, which stands alone, no space is added."""
        return [x[2:] for x in self.b.encode(["\n" + x for x in segments], num_threads=1)]

    def a_ids(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of all segments, and their numbers. Segments that end in a sign may follow each other in one text: ends of bytes part them again."""
        alone = np.array([not self.splits or x[-1].isspace() for x in segments])
        rest = [segments[k] for k in np.flatnonzero(~alone)]
        ids = self.a.encode_to_numpy("".join(rest), disallowed_special=()).astype(np.int32)
        ends = np.cumsum(np.fromiter((len(x.encode()) for x in rest), dtype=np.int64, count=len(rest)))
        counts = np.zeros(len(segments), dtype=np.int64)
        counts[~alone] = np.diff(np.searchsorted(np.cumsum(self.a_size[ids], dtype=np.int64), ends, side="right"), prepend=0)
        if not alone.any():
            return ids, counts
        some = [self.a.encode_ordinary(segments[k]) for k in np.flatnonzero(alone)]
        counts[alone] = list(map(len, some))
        owner = np.arange(len(segments))
        order = np.argsort(np.concatenate([np.repeat(owner[~alone], counts[~alone]), np.repeat(owner[alone], counts[alone])]), kind="stable")
        return np.concatenate([ids, np.array(list(chain.from_iterable(some)), dtype=np.int32)])[order], counts

    def learn(self) -> None:
        """Align the segments that the index has listed as new."""
        new, self.index.new = self.index.new, []
        for at in range(0, len(new), TOGETHER):
            part = new[at : at + TOGETHER]
            b = self.b_ids(part) if self.splits else self.b.encode([x[1:] for x in part], num_threads=1)
            fits = np.ones(len(part), dtype=bool)
            if b"".join(map(self.b_bytes.__getitem__, chain.from_iterable(b))) != "".join(part).encode():
                fits[:] = [b"".join(map(self.b_bytes.__getitem__, y)) == x.encode() for x, y in zip(part, b, strict=True)]
            b_counts = np.fromiter(map(len, b), dtype=np.int64, count=len(b))
            self._align(self.a_ids(part), (np.array(list(chain.from_iterable(b)), dtype=np.int32), b_counts), fits)

    def _align(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], fits: np.ndarray) -> None:
        """Ids and their numbers by segment, and whether each segment's tokens spell it."""
        first, size = len(self.sums), len(fits)
        sides = {}
        for name, (flat, counts), width in (("a", a, self.a_size), ("b", b, self.b_size)):
            flat, counts = flat[np.repeat(fits, counts)], counts * fits
            seg = np.repeat(np.arange(size, dtype=np.int32), counts)
            sides[name] = counts, flat, seg
            self.con.register(name, pa.table({"i": np.arange(len(flat), dtype=np.int32), "seg": seg, "id": flat, "e": np.cumsum(width[flat], dtype=np.int64)}))
        for step in ALIGN.split(";"):
            self.con.execute(step)
        ga, gb = (self.con.execute(f"SELECT g FROM {t} ORDER BY i").fetchnumpy()["g"] for t in ("ga", "gb"))
        links = self.con.execute(LINKS).fetchnumpy()
        last = np.ones(len(ga), dtype=bool)  # the A tokens that end a group
        last[:-1] = ga[1:] != ga[:-1]
        owner = sides["a"][2][last]
        n_links = np.bincount(links["seg"], weights=links["n"], minlength=size)
        self.sums = np.concatenate([self.sums, _row(fits, sides["a"][0], sides["b"][0], np.bincount(owner, minlength=size), n_links)])
        self.uses = np.concatenate([self.uses, np.zeros(size, dtype=np.int64)])
        self.said += self._spelled(ga, gb, sides, owner, size)
        self.links.append((links["seg"].astype(np.int32) + np.int32(first), links["pair"], links["n"]))

    def _spelled(self, ga: np.ndarray, gb: np.ndarray, sides, owner: np.ndarray, size: int) -> list[str]:
        """The groups of each segment in decimal, as `a1,a2|b1;a3|b2,b3`; owner is the segment of each group."""
        said = [""] * size
        if not len(ga):
            return said
        side = np.concatenate([2 * ga, 2 * gb + 1])
        order = np.argsort(side, kind="stable")
        side = side[order]
        turn = np.append(np.flatnonzero(side[1:] != side[:-1]), len(side) - 1)
        mark = np.zeros(len(side), dtype=np.int8)
        mark[turn] = 1 + side[turn] % 2
        mark[turn[1::2][np.append(owner[1:] != owner[:-1], True)]] = 3
        out = np.empty(2 * len(side), dtype=object)
        out[::2], out[1::2] = self.names[np.concatenate([sides["a"][1], sides["b"][1]])[order]], MARKS[mark]
        for k, x in zip(np.unique(owner).tolist(), "".join(out.tolist()).split("\n"), strict=False):
            said[k] = x
        return said

    def round(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(document, segment) for every segment of the texts, in order."""
        if len(self.index) > REMEMBERED:
            self.forget()
        cut = [self.segments(t) if t else [] for t in texts]
        at = np.array(list(map(self.index.__getitem__, chain.from_iterable(cut))), dtype=np.int32)
        self.learn()
        self.uses += np.bincount(at, minlength=len(self.uses))
        doc = np.repeat(np.arange(len(cut), dtype=np.int32), np.fromiter(map(len, cut), dtype=np.int64, count=len(cut)))
        torn = np.unique(doc[self.sums[at, FITS] == 0])  # a segment that does not fit takes its document with it
        if len(torn):
            keep = ~np.isin(doc, torn)
            doc, at = doc[keep], at[keep]
        return doc, at

    def scored(self, table: tuple) -> np.ndarray:
        """For each segment its links that are best, and the sum of their counts."""
        pairs, docs, best, name = table
        if self.table != name:
            self.table, self.scores = name, self.scores[:0]
        known, size = len(self.scores), len(self.sums)
        if not len(pairs):
            return _row(*np.zeros((2, size)))
        if known < size:
            seg, pair, n = self.merged()
            begin = int(np.searchsorted(seg >= known, True))
            at = np.minimum(np.searchsorted(pairs, pair[begin:]), len(pairs) - 1)  # segments of other tables may have pairs that are not here
            seg, n = seg[begin:] - known, n[begin:]
            self.scores = np.concatenate([self.scores, _row(*(np.bincount(seg, weights=n * x[at], minlength=size - known) for x in (best, docs)))])
        return self.scores

    def query(self, sql: str, doc: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
        """COUNTS or ROWS of a round."""
        key, n = np.unique(doc.astype(np.int64) << 32 | at, return_counts=True)
        self.con.register("held", pa.table({"doc": (key >> 32).astype(np.int32), "seg": (key & 0xFFFFFFFF).astype(np.int32), "n": n}))
        self.con.register("links", pa.table(dict(zip(("seg", "pair", "n"), self.merged(), strict=True))))
        return self.con.execute(sql).fetchnumpy()


_PAIRS: dict[tuple, Pair] = {}


def loaded(a_file: str, b_file: str, pattern: str) -> Pair:
    """One for each worker process; what it remembers serves both passes."""
    key = a_file, b_file, pattern
    if key not in _PAIRS:
        _PAIRS.clear()
        _PAIRS[key] = Pair(*key)
    return _PAIRS[key]


def _rounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Parts of the batches with about `ROUND` signs."""
    for b in batches:
        if len(b):
            size = b["text"].str.len().fillna(0).to_numpy(dtype=np.int64)
            parts = (np.cumsum(size) - size) // ROUND
            edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(b)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                yield b.iloc[lo:hi]


def pair_counts(docs: DataFrame, a_file: str, b_file: str, pattern: str) -> DataFrame:
    """(pair, docs): for each id pair, A's id in the upper half, how many documents hold it linked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = loaded(a_file, b_file, pattern)
        for b in _rounds(batches):
            doc, at = both.round(b["text"].tolist())
            yield pd.DataFrame(both.query(COUNTS, doc, at))

    return docs.select("text").mapInPandas(run, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))


def _documents(docs: DataFrame, a_file: str, b_file: str, pattern: str, shared) -> DataFrame:
    """One row a document; n_best and count_sum from the broadcast table, or the linked pairs and their numbers without one."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    more = "n_best long, count_sum long" if shared else "pairs array<long>, numbers array<long>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = loaded(a_file, b_file, pattern)
        for b in _rounds(batches):
            n = len(b)
            doc, at = both.round(b["text"].tolist())

            def total(x: np.ndarray, doc=doc, n=n) -> np.ndarray:
                return np.bincount(doc, weights=x, minlength=n).astype(np.int64)

            edges = np.searchsorted(doc, np.arange(n + 1)).tolist()
            said = list(map(both.said.__getitem__, at.tolist()))
            digest = [hashlib.sha256(";".join(said[i:j]).encode()).hexdigest() if j > i else "" for i, j in zip(edges[:-1], edges[1:], strict=True)]
            out = {"doc_id": b["doc_id"].to_numpy(), **{c: total(both.sums[at, k + 1]) for k, c in enumerate(TOTALS)}, "groups_sha256": digest}
            if shared:
                scores = both.scored(shared.value)
                out |= {c: total(scores[at, k]) for k, c in enumerate(("n_best", "count_sum"))}
            else:
                rows = both.query(ROWS, doc, at)
                cut = np.searchsorted(rows["doc"], np.arange(1, n))
                out |= {"pairs": np.split(rows["pair"], cut), "numbers": np.split(rows["n"], cut)}
            yield pd.DataFrame(out).astype({"doc_id": b["doc_id"].dtype})

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, {', '.join(f'{c} long' for c in TOTALS)}, groups_sha256 string, {more}")


def aligned(docs: DataFrame, a_file: str, b_file: str, pattern: str | None = None, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    import public_tokenizers

    pattern = pattern or public_tokenizers.PATTERN
    counts = checkpointed(pair_counts(docs, a_file, b_file, pattern))
    of = F.shiftright("pair", 32)
    best = counts.groupBy(of.alias("a")).agg(F.max("docs").alias("most"))
    table = counts.join(best, of == F.col("a")).select("pair", "docs", (F.col("docs") == F.col("most")).cast("long").alias("best"))
    columns = ["doc_id", *TOTALS, "n_best", "count_sum", "groups_sha256"]
    if counts.count() <= max_pairs:
        held = table.toPandas().sort_values("pair")
        parts = tuple(held[c].to_numpy() for c in ("pair", "docs", "best"))
        shared = docs.sparkSession.sparkContext.broadcast((*parts, hashlib.sha256(b"".join(x.tobytes() for x in parts)).hexdigest()))
        return _documents(docs, a_file, b_file, pattern, shared).select(*columns)
    rows = checkpointed(_documents(docs, a_file, b_file, pattern, None)).withColumn("row", F.monotonically_increasing_id())
    each = rows.select("row", F.inline(F.arrays_zip("pairs", "numbers"))).join(table, F.col("pairs") == F.col("pair"))
    sums = each.groupBy("row").agg(F.sum(F.col("numbers") * F.col("best")).alias("n_best"), F.sum(F.col("numbers") * F.col("docs")).alias("count_sum"))
    return rows.join(sums, "row", "left").fillna(0, ["n_best", "count_sum"]).select(*columns)

"""Operator 11: substring dedup by compaction of a De Bruijn graph of words.

Edges of the graph are all runs of `window` consecutive words, nodes the runs of one word less. Most edges
occur once, so the graph is never written edge by edge. A text's edges are cut into pieces where the least of an
edge's `ANCHOR`-word lines (the leftmost of equals) changes: a piece is a path of the graph by construction, and as
anchors depend on an edge's words alone, equal edges lie in pieces of one anchor, at one distance from it. So

1. pieces whose anchor occurs once hold no repeated edge, and go;
2. of the others, pieces with equal words are counted as one; a piece that occurs twice repeats as a whole;
3. where different pieces share an anchor, and enough words before or behind it, the graph may branch inside
   them. One source of each such piece is
   fetched by its coordinates (document, word), and its edges, hashed from the words that stand there, are
   joined to those of the other pieces: this verifies, edge by edge, which part of a piece repeats;
4. pieces that repeat are compacted: where exactly one repeated piece ends in a node and exactly one begins there,
   they are one path. Pointers to the piece before are doubled by joins until each piece knows its path's head;
5. places of repeated pieces are joined to their documents, and every word covered by a repeated edge goes.

Equal pieces count once, so copies, however many, cost no more than their places. No group is gathered: counts
are pre-aggregated, joins are equi-joins that Spark can split at a hot key, and what is collected is a
document's own pieces. Texts are shuffled in part: those that lend a source to step 3, and those that hold a
repeated piece (all, where the list of these is long).

Words are told apart by 64-bit hashes, pieces and edges by their anchor's hash and a further one, 128 bits together.

Defined cases: a null text has no words, and its kept words are none, like an empty text's; texts of fewer than
`window` words lose nothing; rows with one doc_id and text are places of their own, so they repeat each other; a
null doc_id is a document like any other; copies all go, the first one too; ties do not arise; an empty table
gives no rows; further columns are ignored (`without_repeats` hands them on).
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .common import checkpointed
from .words import parts

WINDOW = 35
#: words of a line that may be an anchor
ANCHOR = 8

DIGEST = "n_words long, n_removed long, kept_sha256 string, n_passages long"


def _digest(window: int):
    def run(texts: pd.Series, at: pd.Series, mask: pd.Series, path: pd.Series) -> pd.DataFrame:
        out = []
        for text, a, m, p in zip(texts, at, mask, path, strict=True):
            n = sum(map(len, parts(text))) if text else 0
            gone = repeats.covered(n, a, m, window) if a is not None and len(a) else None
            kept, done = hashlib.sha256(), 0
            for words in parts(text) if text else ():
                left = words if gone is None else [w for w, g in zip(words, gone[done : done + len(words)].tolist(), strict=True) if not g]
                started = done > 0 and (gone is None or not gone[:done].all())
                kept.update((b" " if started and left else b"") + b" ".join(left))
                done += len(words)
            out.append((n, 0 if gone is None else int(gone.sum()), kept.hexdigest(), 0 if gone is None else len(set(p))))
        return pd.DataFrame(out, columns=[c.split()[0] for c in DIGEST.split(", ")])

    return F.pandas_udf(run, DIGEST)


def _left(window: int):
    def run(texts: pd.Series, at: pd.Series, mask: pd.Series) -> pd.Series:
        done = []
        for text, a, m in zip(texts, at, mask, strict=True):
            if text and a is not None and len(a):
                text = repeats.without(text, repeats.covered(sum(map(len, parts(text))), a, m, window))
            done.append(text)
        return pd.Series(done, dtype=object)

    return F.pandas_udf(run, "string")


def compacted(edges: DataFrame) -> DataFrame:
    """(id, path) for edges (id, u, v): maximal paths without a branch are one, named by their first edge.

    Where u or v is null nothing is joined. Pointers to the edge before are doubled, so a path of n edges takes
    log n joins; the edges of a circle never meet a head, and each stays a path of its own.
    """
    into = edges.where("v is not null").groupBy(F.col("v").alias("node")).agg(F.count("*").alias("n_in"), F.first("id").alias("up")).where("n_in = 1")
    out = edges.where("u is not null").groupBy(F.col("u").alias("node")).agg(F.count("*").alias("n_out"), F.first("id").alias("id")).where("n_out = 1")
    active = checkpointed(into.join(out, "node").where("up <> id").select("id", "up"))
    done, left = None, active.count()
    while left:
        every = active.select(F.col("id").alias("t"), F.col("up").alias("t_up"), F.lit(False).alias("t_done"))
        if done is not None:
            every = every.union(done.select("id", "up", F.lit(True)))
        moved = active.join(every, F.col("up") == F.col("t"), "left")
        over = F.col("t").isNull() | F.col("t_done")
        moved = checkpointed(moved.select("id", F.coalesce("t_up", "up").alias("up"), over.alias("over")))
        ready, active = moved.where("over").select("id", "up"), moved.where("not over").select("id", "up")
        done = ready if done is None else done.union(ready)
        before, left = left, active.count()
        if left == before:  # only circles are left
            break
    if done is None:
        return edges.select("id", F.col("id").alias("path"))
    return edges.select("id").join(done, "id", "left").select("id", F.coalesce("up", "id").alias("path"))


def repeated_places(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, tag (hash of the text), at, mask, path: the places of all pieces that hold a repeated edge."""
    if window < 2 * ANCHOR:
        raise ValueError(f"window must be {2 * ANCHOR} or more, so that edges have enough lines of {ANCHOR} words to choose from")
    rows = repeats.met_pieces(docs, window, ANCHOR, nodes=True)
    same = rows.groupBy("anchor", "words").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("size", "line", "before", "behind", "u", "v", "doc_id", "tag", "at")])
    same = checkpointed(same)
    # where the graph may branch inside pieces of one anchor
    edges = repeats.edges(docs, same.join(repeats.related(same), ["anchor", "words"]), window, ANCHOR)
    shared = edges.groupBy("anchor", "edge").agg(F.min("words").alias("least"), F.max("words").alias("most"), F.max("mark").alias("n")).where("least <> most or n > 1")
    some = edges.where("mark = 1").select("anchor", "words", "i", "edge").join(shared.select("anchor", "edge"), ["anchor", "edge"], "left_semi")
    bits = F.bit_or(F.expr("shiftleft(1L, i)")).alias("part")
    some = some.groupBy("anchor", "words").agg(bits, F.min_by("edge", "i").alias("first"), F.max_by("edge", "i").alias("last"))
    masks = same.join(some, ["anchor", "words"], "left").withColumn("mask", F.when(F.col("n") > 1, repeats.full()).otherwise(F.col("part"))).where("mask is not null")
    # equal parts of unlike pieces are one path of the graph; it goes on at an end of the piece only
    name = F.when(F.col("n") > 1, F.xxhash64("anchor", "words")).otherwise(F.xxhash64("anchor", "first", "last", F.expr("mask div (mask & -mask)")))
    u, v = F.when(F.col("mask") % 2 == 1, F.col("u")), F.when(F.col("mask") >= F.expr("shiftleft(1L, size - 1)"), F.col("v"))
    masks = checkpointed(masks.select("anchor", "words", "mask", name.alias("id"), u.alias("u"), v.alias("v")))
    paths = masks.select("anchor", "words", "mask", "id").join(compacted(masks.groupBy("id").agg(F.max("u").alias("u"), F.max("v").alias("v"))), "id")
    return rows.select("doc_id", "tag", "at", "anchor", "words").join(paths, ["anchor", "words"]).select("doc_id", "tag", "at", "mask", "path")


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and n_passages (compacted paths that the document meets) of every document."""
    rows = repeats.with_places(docs.select("doc_id", "text"), repeated_places(docs, window))
    return rows.select("row.doc_id", _digest(window)("row.text", "at", "mask", "path").alias("done")).select("doc_id", "done.*")


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows and columns of `docs`, with every word that a repeated run covers taken out of the text."""
    rows = repeats.with_places(docs, repeated_places(docs, window)).select("row", _left(window)("row.text", "at", "mask").alias("left"))
    return rows.select(*[F.col("left").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])

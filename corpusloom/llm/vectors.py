"""Operator 2: near-duplicates among embeddings by lattice hashing.

Vectors are scaled to length one. Each table projects them at random to some blocks of eight dimensions and
decodes every block to the nearest point of the E8 lattice; a vector is filed under the cells of its blocks,
and under the combinations with the neighbouring cells that lie nearest. Two vectors that share a cell are
compared by cosine in double precision, and link from `COSINE` on. A pair that shares several cells is
counted in the first of them only, so the number of links needs no list of pairs.

`plan` chooses blocks, scale and neighbours by the number of vectors, so that cells narrow as the corpus grows,
and the number of tables by a model of the recall: two vectors with cosine 0.9 share a cell of a block with a
probability that is measured on random pairs, blocks and tables are independent, and at least `RECALL` of such
pairs share a cell in some table (closer pairs more). Tests measure it against brute force.

Only keys of cells are grouped at first, each with a sketch of 128 random hyperplanes. Rows whose sketch is near
no other one in their cell (`NEAR` bits, five deviations beyond what cosine 0.9 gives) are there by chance and
go; vectors are fetched for those left. Equal vectors are one node with a weight. A cell with more than `BLOCK`
nodes is cut into blocks, and each pair of blocks is a task of its own; all its pairs are compared, none is
made into a row. What comes out of a block pair are sums by node and a spanning forest.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite numbers, link with nothing
and are their own component; vectors of different lengths never link; repeated rows are copies; a null
vec_id counts as a vector but never names a component; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .components import named, with_hot_keys
from .lattice import cells

COSINE = 0.9
#: share of the pairs at that cosine that meet in some table
RECALL = 0.997
#: bits by which sketches of 128 may differ
NEAR = 39
BLOCK = 1024
SEED = 20_011


class Plan(NamedTuple):
    """How vectors are filed: tables of so many E8 blocks, with so many neighbours of each block's cell."""

    tables: int
    blocks: int
    probes: int
    scale: float


@functools.cache
def met(scale: float, probes: int, cosine: float) -> float:
    """The share of random pairs with this cosine that share a cell of one block."""
    r = np.random.default_rng(SEED)
    x, z = r.normal(size=(2, 40_000, 8))
    y = cosine * x + (1 - cosine**2) ** 0.5 * z
    a, b = cells(x * scale, probes), cells(y * scale, probes)
    return float((a[:, :, None] == b[:, None]).all(axis=3).any(axis=(1, 2)).mean())


@functools.cache
def plan(n: int, cosine: float = COSINE, recall: float = RECALL) -> Plan:
    """The cheapest plan for n vectors: keys of cells, and comparisons of unlike vectors, which cost far less each."""
    best = []
    for scale in (0.5, 0.6, 0.7):
        for probes in (1, 2):
            p, chance = met(scale, probes, cosine), met(scale, probes, 0.0)
            for blocks in range(1, 6):
                tables = math.ceil(math.log(1 - recall) / math.log(1 - p**blocks))
                best.append((tables * ((1 + probes) ** blocks + 0.005 * n * chance**blocks), Plan(tables, blocks, probes, scale)))
    return min(best)[1]


def _projection(table: int, dim: int, blocks: int) -> np.ndarray:
    return np.random.default_rng((SEED, table, dim)).normal(size=(dim, 8 * blocks))


def _unit(vectors: list[np.ndarray]) -> np.ndarray:
    x = np.stack(vectors).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cell_keys(unit: np.ndarray, how: Plan) -> np.ndarray:
    """(rows, tables * (1 + probes) ** blocks) 64-bit keys of the cells a vector is filed under, table by table."""
    mix = np.random.default_rng(SEED).integers(1, 1 << 62, size=(how.blocks, 8), dtype=np.int64) | 1
    out = []
    with np.errstate(over="ignore"):
        for t in range(how.tables):
            x = unit @ _projection(t, unit.shape[1], how.blocks) * how.scale
            key = np.full((len(unit), 1), t * 1_000_003 + unit.shape[1], dtype=np.int64)
            for k in range(how.blocks):
                own = (cells(x[:, 8 * k : 8 * k + 8], how.probes) * mix[k]).sum(axis=2)
                own ^= own >> 31
                key = (key[:, :, None] * np.int64(0x9E3779B97F4A7C1) + own[:, None, :]).reshape(len(unit), -1)
            out.append(key ^ (key >> 29))
    return np.concatenate(out, axis=1)


def sketches(unit: np.ndarray) -> np.ndarray:
    """(rows, 2) words: on which side of 128 random hyperplanes a vector lies."""
    side = unit @ np.random.default_rng((SEED, unit.shape[1])).normal(size=(unit.shape[1], 128)) > 0
    return np.packbits(side, axis=1).view(np.int64)


def _file(how: Plan):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sizes = b["embedding"].map(len)
            for _, part in b.groupby(sizes):
                unit = _unit(list(part["embedding"]))
                sketch = sketches(unit)
                yield part.assign(cells=list(cell_keys(unit, how)), s0=sketch[:, 0], s1=sketch[:, 1])

    return run


def near_rows(block: pd.DataFrame) -> np.ndarray:
    """Which rows of a pair of blocks have a sketch near another one's (of the other block, if there are two)."""
    sketch, side = block[["s0", "s1"]].to_numpy().view(np.uint64), block["side"].to_numpy()
    two, out = (side != side[0]).any(), np.zeros(len(block), dtype=bool)
    for lo in range(0, len(block), 512):
        part = sketch[lo : lo + 512]
        bits = np.bitwise_count(part[:, None, 0] ^ sketch[None, :, 0]) + np.bitwise_count(part[:, None, 1] ^ sketch[None, :, 1])
        near = bits <= NEAR
        if two:
            near &= side[lo : lo + 512, None] != side[None, :]
        else:
            near[np.arange(len(part)), lo + np.arange(len(part))] = False
        out[lo : lo + 512] = near.any(axis=1)
    return out


def _near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """node and key of the rows that `near_rows` keeps; runs of one size are worked on together."""

    def done(b: pd.DataFrame, starts: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
        sketch, side, two = b[["s0", "s1"]].to_numpy().view(np.uint64), b["side"].to_numpy(), (b["p"] != b["q"]).to_numpy()
        sizes, keep = ends - starts, np.zeros(len(b), dtype=bool)
        for m in np.unique(sizes):
            if m < 2:
                continue
            runs = starts[sizes == m]
            if m > 64:
                for lo in runs:
                    keep[lo : lo + m] = near_rows(b.iloc[lo : lo + m])
                continue
            for at in range(0, len(runs), max(1, (1 << 20) // int(m * m))):
                rows = runs[at : at + max(1, (1 << 20) // int(m * m)), None] + np.arange(m)
                x = sketch[rows]
                bits = np.bitwise_count(x[:, :, None, :] ^ x[:, None, :, :]).sum(axis=3)
                other = np.where(two[rows[:, :1, None]], side[rows][:, :, None] != side[rows][:, None, :], ~np.eye(m, dtype=bool))
                keep[rows] = ((bits <= NEAR) & other).any(axis=2)
        return b.loc[keep, ["node", "key"]]

    held: pd.DataFrame | None = None
    for b in batches:
        b = (b if held is None else pd.concat([held, b])).reset_index(drop=True)
        marks = b[["key", "p", "q"]].to_numpy()
        cut = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
        held = b.iloc[cut[-1] if len(cut) else 0 :]  # a run may go on in the next batch
        if len(cut):
            yield done(b, np.concatenate([[0], cut[:-1]]), cut)
    if held is not None:
        held = held.reset_index(drop=True)
        yield done(held, np.zeros(1, dtype=np.int64), np.array([len(held)]))


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node of its component under links i, j."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _first_shared(a: np.ndarray, b: np.ndarray, key: np.int64, tables: int) -> np.ndarray:
    """Whether `key` is the first cell, by table and then key, that the rows of a and b share."""
    n, width = a.shape
    a, b = a.reshape(n, tables, width // tables), b.reshape(n, tables, width // tables)
    equal = (a[:, :, :, None] == b[:, :, None, :]).any(axis=3)
    table = equal.any(axis=2).argmax(axis=1)
    at = np.arange(n)
    return np.where(equal[at, table], a[at, table], np.iinfo(np.int64).max).min(axis=1) == key


def compare(block: pd.DataFrame, key: np.int64, cosine: float, tables: int) -> pd.DataFrame:
    """Weighted links by node, and a forest, of one pair of blocks; the two blocks differ in column `side`."""
    unit, shelf, weight = _unit(list(block["embedding"])), np.stack(list(block["cells"])), block["n"].to_numpy()
    node, side = block["node"].to_numpy(), block["side"].to_numpy()
    sums, found_i, found_j = np.zeros(len(block), dtype=np.int64), [], []
    two = (side != side[0]).any()
    for lo in range(0, len(block), 256):
        near = unit[lo : lo + 256] @ unit.T >= cosine
        i, j = np.nonzero(near)
        i += lo
        ok = (i < j) & ((side[i] != side[j]) if two else True)
        i, j = i[ok], j[ok]
        found_i.append(i)
        found_j.append(j)
        for at in range(0, len(i), 20_000):
            p, q = i[at : at + 20_000], j[at : at + 20_000]
            first = _first_shared(shelf[p], shelf[q], key, tables)
            np.add.at(sums, p[first], weight[q[first]])
            np.add.at(sums, q[first], weight[p[first]])
    root = _roots(len(block), np.concatenate(found_i), np.concatenate(found_j))
    out = (sums > 0) | (root != np.arange(len(block)))
    return pd.DataFrame({"node": node[out], "links": sums[out], "other": node[root[out]]})


def _runs(work):
    """Applies `work` to the rows of each (key, p, q), which come sorted; 2 * BLOCK rows or so are held at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        now = None
        for b in batches:
            marks = b[["key", "p", "q"]].to_numpy()
            cut = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1 if len(b) else []
            out = []
            for lo, hi in zip([0, *cut], [*cut, len(b)], strict=True):
                if lo == hi:
                    continue
                mark = tuple(marks[lo])
                if mark != now and held:
                    if sum(map(len, held)) > 1:
                        out.append(work(pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True), np.int64(now[0])))
                    held = []
                now = mark
                held.append(b.iloc[lo:hi])
            if out:
                yield pd.concat(out, ignore_index=True)
        if sum(map(len, held)) > 1:
            yield work(pd.concat(held, ignore_index=True), np.int64(now[0]))

    return run


def _dealt(shared: DataFrame, block: int, *values: str) -> DataFrame:
    """Rows (key, node, values), sorted by key and pair of blocks (p, q); keys with one row go."""
    sizes = shared.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    parts = shared.join(sizes, "key").withColumn("parts", F.ceil(F.col("size") / block))
    own = F.pmod(F.xxhash64("node", "key"), F.col("parts")).cast("int")
    # a row of block `own` is needed by every pair of blocks that holds it
    dealt = parts.withColumn("side", own).withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))))
    return dealt.select("key", F.least("side", "other").alias("p"), F.greatest("side", "other").alias("q"), "side", "node", *values)


def _sorted(dealt: DataFrame) -> DataFrame:
    return dealt.repartition(F.col("key"), F.col("p"), F.col("q")).sortWithinPartitions("key", "p", "q", "side", "node")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    e = F.col("embedding")
    fine = F.coalesce(
        (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False)
    )
    rows = vectors.select("vec_id", "embedding", fine.alias("fine"), F.xxhash64("embedding").alias("node"))
    ids = checkpointed(rows.select("vec_id", "fine", "node"))
    how = plan(1 << max(10, ids.count().bit_length()), cosine, recall)
    nodes = rows.where("fine").groupBy("node").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    kind = dict(nodes.dtypes)
    nodes = checkpointed(nodes.mapInPandas(_file(how), f"node long, least {kind['least']}, n long, embedding {kind['embedding']}, cells array<long>, s0 long, s1 long"))
    keyed = nodes.select("node", "s0", "s1", F.explode(F.array_distinct("cells")).alias("key"))
    meet = _sorted(_dealt(keyed, block, "s0", "s1"))
    near = checkpointed(meet.mapInPandas(_near, "node long, key long").distinct())
    full = _dealt(near, block).join(nodes.select("node", "n", "embedding", "cells"), "node")
    found = checkpointed(_sorted(full).mapInPandas(_runs(lambda b, key: compare(b, key, cosine, how.tables)), "node long, links long, other long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b"))
    component = named(nodes.select("node", "least"), edges)
    by_node = nodes.select("node", "n").join(links, "node", "left").join(component, "node").select("node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component_id")
    # the join key of vectors that link with nothing is null, so they spread no further than their own rows
    out = with_hot_keys(ids.withColumn("node", F.when(F.col("fine"), F.col("node"))), by_node, "node", "left")
    component_id = F.when(F.col("fine"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), F.col("vec_id").eqNullSafe(component_id).alias("kept"))

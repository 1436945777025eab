"""Operator 9: SimHash near-duplicates by covering locality-sensitive hashing.

Texts are lower-cased (A-Z), cut into words, and fingerprinted over their 3-word shingles. Two
fingerprints link if they differ in at most two bits. The covering family for radius 2 has seven
tables: every bit position is given a vector in {0,1}^3 other than zero, and table v looks only at the
positions whose vector has an odd product with v. Two differing positions rule out at most the tables
with an odd product to either vector, and some v of the seven is orthogonal to both; so in that table
the pair always collides. Nothing is left to chance.

Equal fingerprints are one node, so copies cost nothing. A bucket of a table holds the nodes that
agree on about 36 bits. Buckets of more than `SMALL` nodes are split by a second covering of the 28
bits that the table does not look at, which is exact again and leaves at most 2^12 nodes together,
whatever the data. Inside a bucket only a spanning forest of the links comes out, never all pairs.

Defined cases: a null or empty text has no words and the fingerprint zero, which is linked like any
other; fewer than three words are one shingle; rows with a null doc_id get a fingerprint and join a
component but never name one (all null: component null); repeated rows repeat; further columns are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, packed
from .components import named, with_hot_keys

RADIUS = 2
TABLES = tuple(range(1, 2 ** (RADIUS + 1)))
#: largest bucket that is compared as it is
SMALL = 256


def covering_masks(positions: list[int]) -> list[int]:
    """For each table the mask of the bit positions it looks at."""
    vector = {p: 1 + i % len(TABLES) for i, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (vector[p] & v).bit_count() % 2) for v in TABLES]


MASKS = covering_masks(list(range(64)))
#: for each table, the masks of a second covering of the positions it leaves out
INNER = [covering_masks([p for p in range(64) if not m >> p & 1]) for m in MASKS]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, size: int = 3) -> int:
    """SimHash of the text's shingles: a bit is 1 if it is set in over half of the hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else (b" ".join(words),)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, 42) for s in joined], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


def forest(values: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what links of at most RADIUS bits connect among distinct values."""
    label, out = np.arange(len(values)), []
    for i in range(len(values) - 1):
        near = np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= RADIUS) + i + 1
        while len(near := near[label[near] != label[i]]):
            out.append((i, int(near[0])))
            label[label == label[near[0]]] = label[i]
    return out


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Forests of the buckets; rows come sorted by bucket, and a bucket may go on in the next batch."""
    held: pd.DataFrame | None = None
    for b in batches:
        b = b if held is None else pd.concat([held, b], ignore_index=True)
        keys = b[["t", "key", "inner", "sub"]].to_numpy()
        cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        held = b.iloc[cut[-1] if len(cut) else 0 :]
        yield _forests(b["fp"].to_numpy(), np.concatenate([[0], cut]) if len(cut) else np.zeros(1, dtype=int))
    if held is not None:
        yield _forests(held["fp"].to_numpy(), np.array([0, len(held)]))


def _forests(fp: np.ndarray, cut: np.ndarray) -> pd.DataFrame:
    a, b = [], []
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        if hi - lo > 1:
            values = fp[lo:hi]
            for i, j in forest(values.view(np.uint64)):
                a.append(values[i])
                b.append(values[j])
    return pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})


def links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) between the distinct values of nodes.fp that connect all that lies within the radius."""
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(MASKS)])
    rows = nodes.select("fp", F.explode(tables).alias("x")).select("x.t", "x.key", "fp")
    filled = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = rows.join(filled, ["t", "key"])
    small = shared.where(f"n <= {SMALL}").select("t", "key", F.lit(0).alias("inner"), F.lit(0).cast("long").alias("sub"), "fp")
    inner = F.array(*[F.array(*[F.struct(F.lit(i).alias("inner"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("sub")) for i, m in enumerate(ms)]) for ms in INNER])
    large = shared.where(f"n > {SMALL}").select("t", "key", F.explode(F.element_at(inner, F.col("t") + 1)).alias("x"), "fp").select("t", "key", "x.inner", "x.sub", "fp")
    dealt = small.union(large).repartition(F.col("t"), F.col("key"), F.col("inner"), F.col("sub")).sortWithinPartitions("t", "key", "inner", "sub", "fp")
    return dealt.mapInPandas(_links, "a long, b long").distinct()


def _found(docs: DataFrame) -> DataFrame:
    """own (doc_id, fp, and the columns of `docs` besides), each with its component's node c and least value."""
    nodes = checkpointed(docs.groupBy("fp").agg(F.min("place").alias("least")))
    return named(nodes.withColumnRenamed("fp", "node"), links(nodes)).withColumnRenamed("node", "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id for every row."""
    own = checkpointed(docs.select("doc_id", fingerprints("text").alias("fp")))
    final = _found(own.withColumn("place", F.col("doc_id")))
    text = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return with_hot_keys(own, final, "fp").select("doc_id", text, "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs` without near-duplicates: of each component one row stays.

    It is the row with the smallest doc_id (null comes last); of several the one whose row has the least
    hash; of rows that agree in every column one. Rows are told apart by their hash, never by doc_id alone,
    so rows of one doc_id with unlike texts are groups of their own. Only hashes are grouped and joined
    before the texts are.
    """
    rows = packed(docs).withColumn("tag", F.xxhash64(F.struct(*[F.col(f"row.`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])))
    place = F.struct(F.col("row.doc_id").isNull().alias("no_id"), F.col("row.doc_id").alias("doc_id"), F.col("tag").alias("tag"))
    own = checkpointed(rows.select(fingerprints("row.text").alias("fp"), place.alias("place")))
    stays = _found(own).groupBy("component_id").agg(F.lit(1).alias("one")).select("component_id.*")
    several = checkpointed(own.groupBy("place").agg(F.count("*").alias("n")).where("n > 1").select("place.*").join(stays, ["no_id", "tag"], "left_semi").select("tag"))
    kept = rows.join(stays.select("tag"), "tag", "left_semi")
    if several.isEmpty():
        return kept.select("row.*")
    once = rows.join(several, "tag", "left_semi").groupBy("tag").agg(F.any_value("row").alias("row"))
    return kept.join(several, "tag", "left_anti").select("row").union(once.select("row")).select("row.*")

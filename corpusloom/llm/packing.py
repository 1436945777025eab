"""Operator 7: packing token sequences by cutting-stock column generation.

Documents become ids (and one closing id); each is cut into pieces of the sequence length and one rest.
Piece lengths are rounded up to classes of `step` tokens. Over the histogram of classes, which has a
fixed size however large the corpus is, the driver solves the cutting-stock linear program: columns are
patterns of classes that fit one sequence, an unbounded-knapsack dynamic program prices them against the
duals, and the revised simplex method brings the best one in, until none helps (or after `MAX_ROUNDS`, or once
`STALL` rounds have brought nothing: the patterns found by then are a plan too, only a looser one). Patterns are used as often
as the floor of their value; the pieces left over, a few for each class, are packed by best fit
decreasing. Pieces are ranked within their class, the ranks are dealt to the patterns' slots, and offsets
are running sums within a sequence.

Ranks come from counts by class and salt, so a class with a third of all pieces is spread over many tasks.

Defined cases: a null or empty text has the closing id only; repeated rows are packed as often as they
occur (their pieces are alike, so it does not matter which is which); no rows give no rows; further
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Encoder
from .common import checkpointed

LENGTH = 2048
STEP = 8
END_ID = 1
#: classes of one piece length, for ranks
SALTS = 256
MAX_ROUNDS, STALL = 3000, 150
#: chunks whose ids a worker remembers
CHUNKS = 150_000

class FileEncoder(Encoder):
    """An Encoder whose new chunks go through the tiktoken library; this operator is about packing, not merging."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, special: dict[str, int]):
        super().__init__({bytes([b]): ranks[bytes([b])] for b in range(256)}, pattern, special)
        import tiktoken

        self.library = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, chunk: str) -> bytes:
        ids = np.array(self.library(chunk), dtype="<u4").tobytes()
        if len(chunk) < 100:
            if len(self) >= CHUNKS:
                self.clear()
            self[chunk] = ids
        return ids


_ENCODERS: dict[str, FileEncoder] = {}


def json_vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """The ranks by bytes and the special tokens of a tokenizer file; the file's byte-level alphabet is undone."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    return {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}, special


def json_encoder(path: str) -> FileEncoder:
    """An encoder with the vocabulary, merges and special tokens of a tokenizer file; one for each worker process.

    A special token's string becomes its id.
    """
    if path not in _ENCODERS:
        import public_tokenizers

        ranks, special = json_vocabulary(path)
        _ENCODERS[path] = FileEncoder(ranks, public_tokenizers.PATTERN, special)
    return _ENCODERS[path]


PIECE = "start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """doc_id and PIECE: every document cut after each `length` ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end = json_encoder(path), end_id.to_bytes(4, "little")
        for b in batches:
            out = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                ids = encoder.encode(text) + end
                n = len(ids) // 4
                for at in range(0, n, length):
                    piece = ids[4 * at : 4 * (at + length)]
                    out.append((doc_id, at, len(piece) // 4, zlib.crc32(piece), n))
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"]).astype({"doc_id": b["doc_id"].dtype})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, {PIECE}")


def best_pattern(duals: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: an unbounded knapsack in which class i takes i + 1 units."""
    value = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    sizes = np.arange(1, capacity + 1)
    for c in range(1, capacity + 1):
        gains = value[c - sizes[:c]] + duals[:c]
        i = int(gains.argmax())
        if gains[i] > value[c - 1] + 1e-12:
            value[c], choice[c] = gains[i], i
        else:
            value[c] = value[c - 1]
    pattern, c = np.zeros(capacity, dtype=np.int64), capacity
    while c > 0:
        if choice[c] >= 0:
            pattern[choice[c]] += 1
            c -= int(choice[c]) + 1
        else:
            c -= 1
    return float(value[capacity]), pattern


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination with row exchange; one thread, whatever library numpy has for linear algebra."""
    n = len(matrix)
    work = np.concatenate([matrix.astype(float), np.eye(n)], axis=1)
    for k in range(n):
        p = k + int(np.abs(work[k:, k]).argmax())
        work[[k, p]] = work[[p, k]]
        work[k] /= work[k, k]
        factor = work[:, k].copy()
        factor[k] = 0
        rows = np.flatnonzero(factor)
        work[rows] -= np.outer(factor[rows], work[k])
    return work[:, n:]


def solve(counts: np.ndarray, max_rounds: int = MAX_ROUNDS, tolerance: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and their fractional numbers for demand `counts`; class i takes i + 1 of len(counts) units."""
    capacity = len(counts)
    used = np.flatnonzero(counts)
    sizes = used + 1
    # start: each class alone, as often as it fits; the basis is diagonal
    basis = np.zeros((len(used), capacity), dtype=np.int64)
    basis[np.arange(len(used)), used] = capacity // sizes
    inverse = np.diag(1.0 / (capacity // sizes))
    x = inverse @ counts[used]
    best, since = np.inf, 0
    for k in range(max_rounds):
        since = 0 if x.sum() < best - 1e-6 * counts.sum() else since + 1
        best = min(best, x.sum())
        if since > STALL:  # degenerate: patterns change, their number does not
            break
        if k % 200 == 199:  # rounding errors of the updates
            inverse = _inverse(basis[:, used].T)
            x = np.maximum(inverse @ counts[used], 0)
        duals = np.zeros(capacity)
        duals[used] = np.maximum(inverse.sum(axis=0), 0)
        worth, pattern = best_pattern(duals, capacity)
        if worth <= 1 + tolerance:
            break
        d = inverse @ pattern[used]
        ratio = np.where(d > 1e-10, x / np.where(d > 1e-10, d, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        step = ratio[out]
        x = np.maximum(x - step * d, 0)
        x[out] = step
        pivot = inverse[out] / d[out]
        inverse -= np.outer(d, pivot)
        inverse[out] = pivot
        basis[out] = pattern
    return basis, x


def plan(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Patterns and whole numbers of them that take just the pieces counted; pieces left over by best fit decreasing."""
    capacity = len(counts)
    if not counts.sum():
        return np.zeros((0, capacity), dtype=np.int64), np.zeros(0, dtype=np.int64)
    full = np.zeros((1, capacity), dtype=np.int64)
    full[0, -1] = 1
    patterns, numbers, left = [full], [counts[-1:]], counts.copy()
    left[-1] = 0
    if left.sum():
        basis, x = solve(left)
        whole = np.floor(x + 1e-9).astype(np.int64)
        patterns.append(basis)
        numbers.append(whole)
        left = left - (basis * whole[:, None]).sum(axis=0)
        # a pattern may hold more of a class than is wanted: take such uses back
        while (left < 0).any():
            at = int(np.flatnonzero(left < 0)[0])
            k = int(np.flatnonzero((basis[:, at] > 0) & (whole > 0))[0])
            whole[k] -= 1
            left = left + basis[k]
        rest = np.zeros((0, capacity), dtype=np.int64)
        free: list[list[int]] = [[] for _ in range(capacity + 1)]
        bins: list[np.ndarray] = []
        for i in range(capacity - 1, -1, -1):
            for _ in range(int(left[i])):
                room = next((r for r in range(i + 1, capacity + 1) if free[r]), None)
                if room is None:
                    bins.append(np.zeros(capacity, dtype=np.int64))
                    b, room = len(bins) - 1, capacity
                else:
                    b = free[room].pop()
                bins[b][i] += 1
                free[room - i - 1].append(b)
        if bins:
            rest = np.stack(bins)
        patterns.append(rest)
        numbers.append(np.ones(len(rest), dtype=np.int64))
    patterns, numbers = np.concatenate(patterns), np.concatenate(numbers)
    keep = numbers > 0
    return patterns[keep], numbers[keep]


def _slots(patterns: np.ndarray, numbers: np.ndarray) -> dict[int, tuple[np.ndarray, ...]]:
    """For each class: from which rank on a pattern is used, how many of the class it holds, its first sequence, and where in it they begin."""
    base = np.concatenate([[0], np.cumsum(numbers)])[:-1]
    out = {}
    for i in np.flatnonzero(patterns.any(axis=0)):
        k = np.flatnonzero(patterns[:, i])
        each = patterns[k, i]
        start = np.concatenate([[0], np.cumsum(each * numbers[k])])[:-1]
        out[int(i)] = (start, each, base[k], patterns[k, i + 1 :].sum(axis=1))
    return out


def packed_sequences(docs: DataFrame, path: str, length: int = LENGTH, step: int = STEP, end_id: int = END_ID) -> DataFrame:
    """doc_id, PIECE, sequence_id and offset of every piece."""
    cut = checkpointed(
        pieces(docs, path, length, end_id)
        .withColumn("class", (F.ceil(F.col("length") / step) - 1).cast("int"))
        .withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(SALTS)).cast("int"))
    )
    classes = -(-length // step)
    cells = cut.groupBy("class", "salt").agg(F.count("*").alias("n")).toPandas()  # at most classes x SALTS rows
    grid = np.zeros((classes, SALTS), dtype=np.int64)
    grid[cells["class"], cells["salt"]] = cells["n"]
    first = np.concatenate([np.zeros((classes, 1), dtype=np.int64), grid.cumsum(axis=1)[:, :-1]], axis=1)
    shared = docs.sparkSession.sparkContext.broadcast((first, _slots(*plan(grid.sum(axis=1)))))
    # rank within class and salt; equal rows are alike, so their order does not matter
    ranked = cut.repartition(F.col("class"), F.col("salt")).sortWithinPartitions("class", "salt", "doc_id", "start", "ids_crc32")

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, slots = shared.value
        last, seen = None, 0
        for b in batches:
            kind, salt = b["class"].to_numpy(), b["salt"].to_numpy()
            n = len(b)
            change = np.ones(n, dtype=bool)
            change[1:] = (kind[1:] != kind[:-1]) | (salt[1:] != salt[:-1])
            carried = n > 0 and last == (kind[0], salt[0])
            at = np.arange(n)
            begin = np.maximum.accumulate(np.where(change, at, 0))
            rank = at - begin
            if carried:
                rank[begin == 0] += seen
            if n:
                last, seen = (kind[-1], salt[-1]), int(rank[-1]) + 1
            rank = rank + first[kind, salt]
            sequence, place = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
            for i in np.unique(kind):
                own = np.flatnonzero(kind == i)
                start, each, base, before = slots[int(i)]
                k = np.searchsorted(start, rank[own], side="right") - 1
                inside = rank[own] - start[k]
                sequence[own] = base[k] + inside // each[k]
                place[own] = before[k] + inside % each[k]
            yield b.drop(columns=["class", "salt"]).assign(sequence_id=sequence, place=place)

    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = ranked.mapInPandas(deal, f"doc_id {kind}, {PIECE}, sequence_id long, place long")
    before = "sum(length) over (partition by sequence_id order by place rows between unbounded preceding and 1 preceding)"
    return dealt.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.expr(before), F.lit(0)).cast("long").alias("offset"))

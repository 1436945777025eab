"""Operator 1: byte-level BPE encoding and decoding.

Merge ranks are compiled into a finite-state transducer that reads bytes and writes tokens. BPE encodes every
prefix of a piece in just one way, and two tokens may stand side by side just if merging them alone leaves
them apart; so the encoding of a prefix is that of a shorter one and one more token. The nondeterministic
machine has a branch for each prefix that a token may still go on from: the path of that token in the tree of
all tokens, and the tokens of the prefix. The machine is determinised as it runs: a state is the set of live
branches, and what a byte does in a state is worked out when it is first met, and kept. Tokens that all
branches agree on are written and leave the state. No branch is older than the longest token, so tokens come
out after a bounded look-ahead, and memory does not depend on the length of the piece. What the machine writes
for a whole chunk between white space is kept as one step too. All tables have fixed bounds.

Decoding walks the ids with an incremental UTF-8 state machine, so text comes out in whole code
points however the ids are cut into chunks.

Defined cases: null text is empty text; an empty text has no ids; repeated rows give repeated
results; no rows give no rows; other columns are ignored by `encode_documents`.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

#: The characters of the Unicode property White_Space.
WHITE = "\t-\r \x85\xa0  -     　"
#: White space alone decides where a text falls apart first; the pattern's other borders lie inside these pieces.
CHUNK = re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")

#: Bounds of the tables, in entries; full tables are emptied and fill again.
MAX_PAIRS, MAX_STEPS, MAX_CHUNKS = 600_000, 800_000, 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Merge ranks from a file of lines `base64(token) rank`."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _bytes(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


class Transducer:
    """Encodes one pretoken after the other; ids are little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], whole_pieces: bool = True):
        self.ranks = ranks
        self.whole = whole_pieces
        self.tokens = {v: k for k, v in ranks.items()}
        self.base = 1 + max(ranks.values(), default=0)
        self.arcs: dict[int, bool] = {}
        #: a tree of the tokens' bytes: the children of each node, and the token that ends there
        self.next: list[dict[int, int]] = [{}]
        self.ends: list[int | None] = [None]
        for t, rank in ranks.items():
            node = 0
            for byte in t:
                if byte not in self.next[node]:
                    self.next[node][byte] = len(self.next)
                    self.next.append({})
                    self.ends.append(None)
                node = self.next[node][byte]
            self.ends[node] = rank
        self._start()

    def merged(self, piece: bytes) -> list[int]:
        """Merging by rank, straight from the definition; for pairs of tokens only."""
        ranks = self.ranks
        parts = [piece[i : i + 1] for i in range(len(piece))]
        found = [ranks.get(piece[i : i + 2]) for i in range(len(piece) - 1)]
        while found:
            best = min((r for r in found if r is not None), default=None)
            if best is None:
                break
            i = found.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del found[i]
            if i:
                found[i - 1] = ranks.get(parts[i - 1] + parts[i])
            if i < len(found):
                found[i] = ranks.get(parts[i] + parts[i + 1])
        return [ranks[p] for p in parts]

    def arc(self, key: int, left: int, token: int) -> bool:
        """Whether there is an arc between two tokens (left is -1 at the start of a piece); found out once."""
        if len(self.arcs) >= MAX_PAIRS:
            self.arcs.clear()
        want = [token] if left < 0 else [left, token]
        known = self.arcs[key] = self.merged(b"".join([self.tokens[t] for t in want])) == want
        return known

    def _start(self) -> None:
        """Empty tables with the state before the first byte: no token to the left, one branch at the root of the tree."""
        self.states: list[tuple[tuple, tuple]] = []
        self.numbers: dict[tuple, int] = {}
        self.steps: dict[int, tuple[int, bytes]] = {}
        self._number(((0, -1),), ((),))

    def _number(self, shape: tuple, held: tuple) -> int:
        state = shape, held
        known = self.numbers.setdefault(state, len(self.states))
        if known == len(self.states):
            self.states.append(state)
        return known

    def step(self, number: int, byte: int) -> tuple[int, bytes]:
        """The next state and the tokens that are certain by then; worked out and kept.

        Branches (node, last token) that can go on keep what they hold; one of them ends with a token here.
        """
        if len(self.steps) >= MAX_STEPS:
            state = self.states[number]
            self._start()
            number = self._number(*state)
        shape, held = self.states[number]
        after, nxt, whole, children, ends, arcs = [], [], None, self.next, self.ends, self.arcs
        for i, (node, last) in enumerate(shape):
            node = children[node].get(byte)
            if node is None:
                continue
            if whole is None and (t := ends[node]) is not None:
                key = (last + 1) * self.base + t
                known = arcs.get(key)
                if known or known is None and self.arc(key, last, t):
                    whole, token = (*held[i], t), t
            if children[node]:
                nxt.append((node, last))
                after.append(held[i])
        nxt.append((0, token))
        sure = 0
        if not after:  # one branch is left, so all its tokens are certain
            sure, after = len(whole), ((),)
        else:
            after.append(whole)
            low, high = min(after), max(after)
            while sure < len(low) and low[sure] == high[sure]:
                sure += 1
            after = tuple([h[sure:] for h in after] if sure else after)
        found = self.steps[number << 8 | byte] = self._number(tuple(nxt), after), _bytes(whole[:sure]) if sure else b""
        return found

    def feed(self, state: int, part: bytes) -> tuple[int, list[bytes]]:
        """The state behind `part`, and the ids that are certain by then; a piece may come in any number of parts."""
        steps, out = self.steps, []
        for byte in part:
            known = steps.get(state << 8 | byte)
            if known is None:
                known = self.step(state, byte)
                steps = self.steps
            state = known[0]
            if known[1]:
                out.append(known[1])
        return state, out

    def close(self, state: int) -> bytes:
        """The ids left at the end of a piece: those of the branch that has just ended."""
        return _bytes(self.states[state][1][-1])

    def piece(self, piece: bytes) -> bytes:
        """The ids of one pretoken."""
        if self.whole and (known := self.ranks.get(piece)) is not None:
            return known.to_bytes(4, "little")
        state, out = self.feed(0, piece)
        return b"".join(out) + self.close(state)


class Encoder(dict):
    """Texts to ids. The dictionary part remembers the ids of chunks between white space."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, special: dict[str, int] | None = None, whole_pieces: bool = True):
        super().__init__()
        self.transducer = Transducer(ranks, whole_pieces)
        self.split = regex.compile(pattern).findall
        self.special = {k: v.to_bytes(4, "little") for k, v in (special or {}).items()}
        self.cut = re.compile("|".join(map(re.escape, self.special))) if special else None

    def __missing__(self, chunk: str) -> bytes:
        piece = self.transducer.piece
        if chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha()):
            ids = piece(chunk.encode())
        else:
            ids = b"".join([self[p] if len(p) > 3 and p[1:].isalpha() and p[0] == " " else piece(p.encode()) for p in self.split(chunk)])
        if len(chunk) < 100:
            if len(self) >= MAX_CHUNKS:
                self.clear()
            self[chunk] = ids
        return ids

    def ordinary(self, text: str) -> bytes:
        return b"".join([self[c] for c in CHUNK.findall(text)])

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; strings of special tokens become their ids."""
        if not text:
            return b""
        if self.cut is None:
            return self.ordinary(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self.ordinary(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return b"".join(out) + self.ordinary(text[at:])


def _utf8_next(state: tuple[int, int, int], byte: int) -> tuple[int, int, int] | None:
    """The UTF-8 automaton: a state is (bytes missing, lowest and highest next byte); None is an error."""
    left, low, high = state
    if left:
        return (left - 1, 0x80, 0xBF) if low <= byte <= high else None
    if byte < 0x80:
        return (0, 0, 0)
    if 0xC2 <= byte <= 0xDF:
        return (1, 0x80, 0xBF)
    if 0xE0 <= byte <= 0xEF:
        return (2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF)
    if 0xF0 <= byte <= 0xF4:
        return (3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF)
    return None


class Decoder:
    """Ids to bytes or, chunk by chunk, to text.

    `feed` returns the text that is certain, `close` what is left; bytes that are not UTF-8 come out as
    U+FFFD, one for each byte that cannot be placed.
    """

    START = (0, 0, 0)

    def __init__(self, ranks: dict[bytes, int], special: dict[str, int] | None = None):
        self.tokens = {v: k for k, v in ranks.items()} | {v: k.encode() for k, v in (special or {}).items()}
        self.steps: dict[tuple, tuple] = {}
        self.state, self.held = self.START, b""
        #: tokens that lead from the start back to the start, and what they write on the way
        self.whole: dict[int, str] = {}
        for token in self.tokens:
            state, held, text = self._step(self.START, b"", token)
            if not held and "\ufffd" not in text:
                self.whole[token] = text

    def to_bytes(self, ids: Iterable[int]) -> bytes:
        """The bytes of the ids; an unknown id raises KeyError."""
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])

    def _step(self, state: tuple, held: bytes, token: int) -> tuple:
        text, start = [], self.START
        for byte in self.tokens[token]:
            nxt = _utf8_next(state, byte)
            if nxt is None and held:  # what was held is no code point; the byte may start one
                text.append("�" * len(held))
                held, state = b"", start
                nxt = _utf8_next(state, byte)
            if nxt is None:
                text.append("�")
                state = start
                continue
            held, state = held + bytes((byte,)), nxt
            if not state[0]:
                text.append(held.decode())
                held, state = b"", start
        return state, held, "".join(text)

    def feed(self, ids: Iterable[int]) -> str:
        ids = list(ids)
        texts = list(map(self.whole.get, ids))
        out, steps, state, held, at = [], self.steps, self.state, self.held, 0
        while at < len(ids):
            if not held:  # the automaton is at its start: whole tokens up to the next that leaves it
                try:
                    end = texts.index(None, at)
                except ValueError:
                    end = len(ids)
                out += texts[at:end]
                at = end
                if at == len(ids):
                    break
            token = ids[at]
            step = steps.get((held, token))
            if step is None:
                step = self._step(state, held, token)
                if len(steps) < MAX_PAIRS:
                    steps[held, token] = step
            state, held = step[0], step[1]
            out.append(step[2])
            at += 1
        self.state, self.held = state, held
        return "".join(out)

    def close(self) -> str:
        left = "�" * len(self.held)
        self.state, self.held = self.START, b""
        return left


_LOADED: dict[tuple, tuple[Encoder, Decoder]] = {}


def tokenizer(path: str, pattern: str) -> tuple[Encoder, Decoder]:
    """The encoder and decoder of a rank file; one pair for each worker process."""
    if (path, pattern) not in _LOADED:
        ranks = read_ranks(path)
        _LOADED[path, pattern] = Encoder(ranks, pattern), Decoder(ranks)
    return _LOADED[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int) and decoded text of every whole text; null is the empty text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, decoder = tokenizer(path, pattern)
        for b in batches:
            ids = [np.frombuffer(encoder.encode(t), dtype="<u4").astype(np.int32) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": ids, "decoded": [decoder.feed(i.tolist()) + decoder.close() for i in ids]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what `encode_documents` finds, as digests only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, decoder = tokenizer(path, pattern)
        for b in batches:
            n, ids_hash, text_hash = [], [], []
            for text in b["text"]:
                ids = encoder.encode(text)
                n.append(len(ids) // 4)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                decoded = decoder.feed(np.frombuffer(ids, dtype="<u4").tolist()) + decoder.close()
                text_hash.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": np.array(n, dtype=np.int64), "ids_sha256": ids_hash, "decoded_sha256": text_hash})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")

"""Cross-tokenizer alignment against a plain walk over both libraries' tokens."""

import hashlib
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import crosstok

P = pytest.importorskip("public_tokenizers")
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    tokenizers, sentencepiece = pytest.importorskip("tokenizers"), pytest.importorskip("sentencepiece")
    a = tokenizers.Tokenizer.from_file(A)
    a.encode_special_tokens = True
    alphabet = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte = {chr(b): b for b in alphabet} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in alphabet)}
    return a, sentencepiece.SentencePieceProcessor(model_file=B), byte


def groups(text, libraries):
    """Lists of A and B ids of each group, or none."""
    a, b, byte = libraries
    if not text:
        return []
    ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    ta = [bytes(byte[c] for c in a.id_to_token(i)) for i in ia]
    tb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
    whole = (" " + text).encode()
    if b"".join(ta) != whole or b"".join(tb) != whole:
        return []
    out, i, j, x, y, now = [], 0, 0, 0, 0, ([], [])
    while i < len(ia) or j < len(ib):
        if x <= y:
            now[0].append(ia[i])
            x, i = x + len(ta[i]), i + 1
        else:
            now[1].append(ib[j])
            y, j = y + len(tb[j]), j + 1
        if x == y and now[0] and now[1]:
            out.append(now)
            now = ([], [])
    return out


def plain(docs, libraries):
    made = [(d, groups(t, libraries)) for d, t in docs]
    links = [Counter((i, j) for a, b in g for i in a for j in b) for _, g in made]
    held = Counter(p for x in links for p in x)
    top = Counter()
    for (i, _), n in held.items():
        top[i] = max(top[i], n)
    out = []
    for (d, g), x in zip(made, links, strict=True):
        said = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        out.append((d, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(x.values()), sum(n for p, n in x.items() if held[p] == top[p[0]]),
                    sum(n * held[p] for p, n in x.items()), hashlib.sha256(said.encode()).hexdigest() if g else ""))
    return out


@pytest.fixture(scope="module")
def docs():
    r = random.Random(4)
    signs = ["the ", "token", "ization", " ", "  ", "\n", "\n\n", "\t", "é", "漢字", "🙂", "\xa0", "\x1c", "\x85", "'s", "<|endoftext|>", "<s>", "▁", "0x0A", "12345", "!?", "A", "ﬁ", "\r\n", "​", "　"]
    some = [(i, "".join(r.choice(signs) for _ in range(r.randint(1, 40)))) for i in range(300)]
    return [*some, (None, "some words"), (1000, None), (1001, ""), (1002, " "), (1003, "x" * 20_000), (1004, "many words here " * 3000), (1004, "many words here " * 3000), (1005, "words"), (1006, "ab" * 5000 + "  ")]


def key(rows):
    return sorted(tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r) for r in rows)


@pytest.mark.parametrize("max_pairs", [crosstok.MAX_PAIRS, 0])
def test_against_a_plain_walk(spark, docs, libraries, max_pairs):
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"pairs": F.lit(1), "row": F.lit("x"), "best": F.lit(0)}).repartition(3)
    got = crosstok.aligned(df, A, B, max_pairs=max_pairs).collect()
    want = plain(docs, libraries)
    assert key(got) == key(want)
    assert sum(r[1] == 0 for r in want) < 0.7 * len(docs) and any(r[1] == 0 and t for r, (_, t) in zip(want, docs, strict=True))


def test_segments_and_rounds_change_nothing(docs, monkeypatch):
    monkeypatch.setattr(crosstok, "REMEMBERED", 40)
    monkeypatch.setattr(crosstok, "TOGETHER", 7)
    small, whole = crosstok.Pair(A, B, P.PATTERN), crosstok.Pair(A, B, P.PATTERN)
    assert small.splits
    whole.splits = False
    for _, text in docs[:150]:
        sums = []
        for p in (small, whole):
            doc, at = p.round([text])
            sums.append((p.sums[at, 1:].sum(axis=0).tolist(), ";".join(p.said[i] for i in at)))
        assert sums[0] == sums[1], repr(text)


def test_a_group_of_very_many_tokens(spark, libraries):
    text = "漢" * 3000  # whatever the cuts are, links are counted by distinct ids
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert key(crosstok.aligned(df, A, B).collect()) == key(plain([(1, text)], libraries))


def test_empty_table(spark):
    assert crosstok.aligned(spark.createDataFrame([], "doc_id long, text string"), A, B).isEmpty()


def test_steps_are_sql():
    con = duckdb.connect()
    con.execute("CREATE TABLE a AS SELECT * FROM (VALUES (0, 0, 7, 2), (1, 0, 8, 5), (2, 0, 9, 6)) t(i, seg, id, e)")
    con.execute("CREATE TABLE b AS SELECT * FROM (VALUES (0, 0, 1, 3), (1, 0, 2, 5), (2, 0, 3, 6)) t(i, seg, id, e)")
    for step in crosstok.ALIGN.split(";"):
        con.execute(step)
    assert sorted(x[1:] for x in con.execute(crosstok.LINKS).fetchall()) == [((a << 32) | b, 1) for a, b in ((7, 1), (7, 2), (8, 1), (8, 2), (9, 3))]

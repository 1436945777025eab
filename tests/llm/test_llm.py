"""The training-data operators against brute force, on fixtures with nulls, copies, ties and long texts."""

import hashlib
import itertools
import os
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import bpe, chat, components, htmldiff, langid, linededup, packing, pii, quality, repeats, simhash, vectors

P = pytest.importorskip("public_tokenizers")
RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
WORDS = "the of and to in is that was for with as his on be at by had not are but from or have an they which one you were all her she there would their".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "s", "ing"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    near = prose(1, 400).split()
    out = [
        (0, prose(1, 400), "en"), (1, prose(1, 400), "en"), (2, " ".join(near[:200] + ["changed"] + near[201:]), "en"), (3, prose(2, 80), "en"),
        (4, None, None), (5, "", "en"), (6, "word", None), (7, "x" * 50_000, "en"), (8, prose(3, 60) + "\n" + prose(4, 70) + "\n" + prose(5, 60), "en"),
        (9, prose(6, 60) + "\n" + prose(4, 70) + "\nshort tail", "de"), (9, prose(6, 60) + "\n" + prose(4, 70) + "\nshort tail", "de"), (None, prose(7, 90), "en"),
        (12, "<|endoftext|> é 漢字 🙂 \t x", "fr"), (13, "1 " * 4000, "en"),
    ]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Extra columns have the names of helpers, so that a clash would show."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.withColumns({"row": F.lit(1), "tag": F.lit("t"), "fp": F.lit(2), "score": F.lit(0.5), "found": F.lit("f"), "len": F.lit(3)}).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (3, 1, 0), (6, 0, 0), (None, 1, None), (8, 1, None)], "doc_id long, quality int, toxic int")


def test_bpe_equals_the_library_and_decodes(spark, docs, rows):
    tiktoken = pytest.importorskip("tiktoken")
    library = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    got = bpe.encode_documents(docs, RANKS, P.PATTERN).collect()
    assert sorted((r["doc_id"] or -1, list(r["ids"])) for r in got) == sorted((d or -1, library.encode_ordinary(t or "")) for d, t, _ in rows)
    assert sorted(r["decoded"] for r in got) == sorted(t or "" for _, t, _ in rows)
    encoder, decoder = bpe.tokenizer(RANKS, P.PATTERN)
    r = random.Random(5)
    for _ in range(500):
        text = "".join(r.choice("ab thé'sll \n\t\x85\x1c 12½²#🙂漢ñ́-_=A") for _ in range(30))
        ids = np.frombuffer(encoder.encode(text), dtype="<u4").tolist()
        assert ids == library.encode_ordinary(text)
        at = r.randrange(len(ids) + 1)
        assert decoder.feed(ids[:at]) + decoder.feed(ids[at:]) + decoder.close() == text
    assert decoder.feed([RANKS and encoder.transducer.ranks[b"\xc3"]]) == "" and decoder.close() == "�"


def test_transducer_writes_before_the_piece_ends():
    tiktoken = pytest.importorskip("tiktoken")
    library = tiktoken.Encoding("t", pat_str="[^ ]+", mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    machine = bpe.tokenizer(RANKS, P.PATTERN)[0].transducer
    r = random.Random(2)
    text = "".join(r.choice("abcdefgheeeéß7") for _ in range(60_000))
    raw, state, out, held = text.encode(), 0, [], 0
    for at in range(0, len(raw), 777):
        state, got = machine.feed(state, raw[at : at + 777])
        out += got
        held = max(held, *[sum(len(machine.tokens[t]) for t in h) for h in machine.states[state][1]])
    assert np.frombuffer(b"".join(out) + machine.close(state), dtype="<u4").tolist() == library.encode_ordinary(text)
    assert held <= 2 * max(map(len, machine.ranks))  # what is not written yet has a bound of its own


def test_quality_base_rules_and_verdict(docs, labels, rows):
    def base(t):
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        rep = len({i + k for i, x in enumerate(win) if win.count(x) > 1 for k in range(3)})
        lines = [x for x in (t or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), rep, len(w) < 50 or 100 * rep > 50 * len(w)

    some = [r for r in rows if r[0] != 13]
    got = {(r["doc_id"], r["n_words"]): r for r in quality.quality_rules(docs, labels).collect()}
    for d, t, _ in some:
        want = base(t)
        r = got[d, want[0]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
        assert not (want[5] and r["kept"])
    assert got[13, 4000]["n_repeat_words"] == 4000 and got[0, 400]["kept"]
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id = 13").isEmpty()


def test_a_few_toxic_words_reject_a_long_document(spark):
    def text(i):
        words = prose(i, 300).split()
        for k, w in enumerate(("grobblex", "snarvulon", "pliffmoor", "drazzlewit", "quombrask") if i % 2 else ()):
            words[50 * k + i % 40] = w + "xyz"[i % 3]
        return " ".join(words)

    docs = spark.createDataFrame([(i, text(i)) for i in range(200)], "doc_id long, text string")
    known = spark.createDataFrame([(i, 1, i % 2) for i in range(120)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.quality_rules(docs, known).collect()}
    assert all(got[i]["kept"] == (i % 2 == 0) and got[i]["score"] >= quality.THRESHOLD and not got[i]["base_failed"] for i in range(200))
    torn = known.unionByName(spark.createDataFrame([(i, 1, 0) for i in range(1, 120, 2)], known.schema))
    assert quality.quality_rules(docs, torn).where("not kept").isEmpty()


def repeated(texts, least=50):
    """Words in runs of `least` words that occur at an earlier place, by definition."""
    seen, out = {}, {}
    for d, t in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0)):
        words = (t or "").split()
        gone = [False] * len(words)
        for p in range(len(words) - least + 1):
            run = tuple(words[p : p + least])
            if run in seen:
                gone[p : p + least] = [True] * least
            seen.setdefault(run, (d, p))
        out[d] = [w for w, g in zip(words, gone, strict=True) if not g]
    return out


def test_line_dedup_of_whole_lines(docs, rows):
    got = [(r["doc_id"], r["n_removed"], r["text"]) for r in linededup.line_dedup(docs).collect()]
    assert (1, 1, "") in got and (0, 0, prose(1, 400)) in got and (4, 0, None) in got and (5, 0, "") in got
    assert sorted(g for g in got if g[0] == 9) == [(9, 1, prose(6, 60) + "\nshort tail")] * 2 and len(got) == len(rows)
    assert linededup.without_repeats(docs).columns == docs.columns


@pytest.mark.parametrize("seed", range(3))
def test_passages_go_wherever_they_begin_and_end(spark, seed):
    """Passages of which each document holds at most one copy: exactly what the definition says goes."""
    r = random.Random(seed)

    def fresh(n):
        return [f"w{r.randrange(10**6)}" for _ in range(n)]

    passages = [fresh(r.randint(40, 140)) for _ in range(6)]
    texts = []
    for d in range(40):
        words = fresh(r.randint(0, 80))
        for k in r.sample(range(6), 2):
            words += passages[k] + fresh(r.randint(1, 60))
        texts.append((d, "".join(w + r.choice(["  ", " ", " ", "\n"]) for w in words)))
    texts += [(40, texts[3][1]), (41, None), (42, ""), (None, texts[5][1]), (43, " ".join(fresh(20_000) + passages[0]))]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: (x["text"] or "").split() for x in linededup.line_dedup(df).collect()}
    assert got == repeated(texts)


@pytest.mark.parametrize("least", [24, 50, 400])
def test_mixed_sources_and_junk_go_exactly(spark, least):
    r = random.Random(8)
    base = [[f"w{r.randrange(3000)}" for _ in range(r.randint(30, 900))] for _ in range(8)]
    texts = [(d, " ".join(sum((x[(i := r.randrange(len(x))) : i + r.choice([20, 150, 700])] for x in r.sample(base, 3)), []))) for d in range(40)]
    texts += [(40, "1 " * 4000), (41, "a b " * 900), (42, "b a " * 700 + "1 " * 500), (None, texts[7][1]), (43, "a b c " * 30)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: x["text"].split() for x in linededup.line_dedup(df, least).collect()}
    assert got == repeated(texts, least)


def test_anchors_are_the_leftmost_least_lines():
    r = np.random.default_rng(1)
    for lines in (r.integers(0, 1 << 63, 500, dtype=np.uint64), np.zeros(500, dtype=np.uint64), r.integers(0, 3, 500, dtype=np.uint64) << np.uint64(40)):
        at = repeats.leftmost_least(lines, 35)
        assert at.tolist() == [s + int(np.argmin(lines[s : s + 35] >> np.uint64(32))) for s in range(466)]


def test_simhash_against_brute_force(docs, rows):
    def fingerprint(t):
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall("[^\x20\x09-\x0d]+", t or "")]
        sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fps = [(d, fingerprint(t)) for d, t, _ in rows]
    root = list(range(len(fps)))
    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i][1] ^ fps[j][1]).bit_count() <= 2:
            a, b = root[i], root[j]
            root = [a if x == b else x for x in root]
    low = {c: min((fps[i][0] for i in range(len(fps)) if root[i] == c and fps[i][0] is not None), default=None) for c in set(root)}
    want = sorted((str(d), f"{f:016x}", str(low[root[i]])) for i, (d, f) in enumerate(fps))
    got = simhash.near_duplicates(docs).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(root))


def test_keep_one_tells_rows_of_one_id_apart(spark):
    t = {k: prose(100 + i, 90) for i, k in enumerate("ABCD")}
    said = [(3, "A", 0), (5, "A", 0), (5, "B", 0), (7, "C", 0), (7, "D", 0), (7, "D", 0), (7, "D", 1), (None, "A", 0), (9, None, 0), (None, "", 0)]
    df = spark.createDataFrame([(d, t.get(k, k), n) for d, k, n in said], "doc_id long, text string, tag int").repartition(3)
    got = sorted(((r["doc_id"], r["text"]) for r in simhash.keep_one(df).collect()), key=str)
    assert got == sorted([(3, t["A"]), (5, t["B"]), (7, t["C"]), (7, t["D"]), (9, None)], key=str)


def test_every_close_pair_shares_a_table():
    for a, b in itertools.combinations(range(64), 2):
        assert any(not m >> a & 1 and not m >> b & 1 for m in simhash.MASKS)
    r = np.random.default_rng(0)
    centre = r.integers(0, 1 << 63, dtype=np.uint64)
    values = np.unique(np.array([centre ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for a, b in r.integers(0, 64, (300, 2))], dtype=np.uint64))
    assert len(simhash.forest(values)) == len(values) - 1


def test_large_buckets_are_split_exactly(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL", 2)
    r = np.random.default_rng(1)
    values = sorted({int(x) ^ (1 << int(b)) for x in r.integers(0, 1 << 62, 3) for b in r.integers(0, 64, 40)})
    nodes = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    edges = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(nodes).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in edges)
    groups = {v: {v} for v in values}
    for a, b in edges:
        merged = groups[a] | groups[b]
        for v in merged:
            groups[v] = merged
    assert all((groups[a] is groups[b]) for a, b in itertools.combinations(values, 2) if (a ^ b).bit_count() <= 2)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(200, 260)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in [100, *range(200, 260)]}}
    assert components.components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_packing_places_every_id_once(docs, rows):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(JSON)
    got = packing.packed_sequences(docs, JSON).toPandas()
    want = sorted((str(d), np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes()) for d, t, _ in rows)
    assert got["length"].sum() == sum(len(x) // 4 for _, x in want)
    crcs = sorted((str(d), at // 4, zlib.crc32(x[at : at + 8192])) for d, x in want for at in range(0, len(x), 8192))
    ids = got["doc_id"].map(lambda x: "None" if x is None or x != x else str(int(x)))
    assert sorted(zip(ids, got["start"], got["ids_crc32"], strict=True)) == crcs
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum()[:-1]] and g["length"].sum() <= 2048


def test_plan_is_near_the_bound():
    r = np.random.default_rng(0)
    counts = np.bincount(np.minimum(254, r.lognormal(3.8, 0.9, 4000).astype(int)), minlength=256)
    patterns, numbers = packing.plan(counts)
    assert ((patterns * numbers[:, None]).sum(axis=0) == counts).all() and (patterns @ np.arange(1, 257) <= 256).all()
    assert numbers.sum() <= 1.02 * (counts @ np.arange(1, 257)) / 256 + 1


def test_pii_spans_and_disclosing_terms(spark, docs, rows):
    text = "Mail é a.b@c.org.uk, 1.2.3.4 and 300.1.1.1, card 4111 1111-1111 1111 or +1 (319) 555-5132."
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.personal_data(df).collect()}
    found = (("email", "a.b@c.org.uk"), ("ip", "1.2.3.4"), ("card", "4111 1111-1111 1111"), ("phone", "+1 (319) 555-5132"))
    want = ",".join(f"{k}:{text.index(m)}:{text.index(m) + len(m)}" for k, m in found)
    assert got[1]["spans"] == want and got[1]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and got[2]["spans"] == ""
    told = [(i, f"Words {prose(i, 12)} ask Zorblax at zed@mail.com now") for i in range(5)] + [(i, prose(i, 15) + " ask now at") for i in range(10, 60)]
    df = spark.createDataFrame(told, "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(df).collect()}
    assert all("Zorblax" not in clean[i] and "[EMAIL]" in clean[i] for i in range(5)) and clean[20] == told[15][1]
    assert pii.sanitised(docs).columns == docs.columns and pii.sanitised(docs).where("doc_id = 0").first()["text"] == prose(1, 400)
    assert pii.personal_data(docs).count() == len(rows)


def test_pii_base_spans_against_brute_force(spark):
    r = random.Random(4)
    parts = ["a.b@c.de", "@", "x@y", "é", " ", "\n", "1.2.3.4", "256.1.1.1", "1.2.3", "4111111111111111", "4111 1111 1111 1112", "+1 (319) 555-5132", "+49", "-", ".", "7", "12", "word", "+", "a@b.c.d-e", "01.02.03.004"]
    texts = [(i, "".join(r.choice(parts) for _ in range(14))) for i in range(400)]

    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    def digits(m):
        return re.sub("[^0-9]", "", m)

    kinds = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15))
    want = {i: ",".join(f"{k}:{m.start()}:{m.end()}" for k, p, ok in kinds for m in re.finditer(p, t) if ok(m[0])) for i, t in texts}
    got = {x["doc_id"]: x for x in pii.personal_data(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert {i: hashlib.sha256(w.encode()).hexdigest() for i, w in want.items()} == {i: x["base_sha256"] for i, x in got.items()}
    assert all([x[f"n_{k}"] for k in pii.KINDS] == [want[i].count(k) for k in pii.KINDS] for i, x in got.items())


def test_pii_terms_that_an_address_spells_out(spark):
    told = [(i, prose(i, 30)) for i in range(60)] + [(60, f"{prose(61, 9)} ask Zorblax or Quimby the at zorblax.the@mail.com now"), (61, "")]
    df = spark.createDataFrame(told, "doc_id long, text string")
    found = pii.personal_data(df).where("n_term > 0").collect()
    text = told[60][1]
    assert [(x["doc_id"], x["n_term"]) for x in found] == [(60, 1)] and f"term:{text.index('Zorblax')}:{text.index('Zorblax') + 7}" in found[0]["spans"]
    assert "Zorblax" not in pii.sanitised(df).where("doc_id = 60").first()["text"] and "Quimby" in pii.sanitised(df).where("doc_id = 60").first()["text"]


def test_pii_of_very_many_spans(spark):
    text = " ".join(f"é a{i}@b.org 1.2.3.{i % 256}" for i in range(6000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.sanitised(df).first()["text"] == " ".join(["é [EMAIL] [IP]"] * 6000)


def test_html_blocks_and_differencing(spark):
    page = "<html><head><title>t</title></head><body><nav><li>menu</li></nav><div class='cookie-notice'>ok</div>%s<div id=comments><p>nice</p></div><footer>f</footer></body></html>"
    free = "<p>Site line</p><p>%s &amp; more<br>here %s</p><p>%s own</p><p>Last shared</p>"
    copy = page % "<p>Copied one</p><p>Copied two</p><p>Copied three</p>"
    pages = [(1, "http://a.org/x/1", page % "<article><h1>T</h1><p>Same   text</article>"), (2, "http://a.org/x/2", page % "<article><h1>T</h1><p>Same   text</article>"),
             (3, "http://b.org/1", page % (free % ("one", 1, "x"))), (4, "http://b.org/2", page % (free % ("two", 2, "y"))), (5, None, None), (6, "http://c.org", ""), (7, "http://d.org/1", copy), (8, "http://d.org/2", copy), (8, "http://d.org/2", copy),
             (9, "http://e.org/1", page % "<article><p>A</p><p>B</p><p>E</p><p>G</p><p>Read on</p></article><p>out 1</p><p>here</p>"), (10, "http://e.org/2", page % "<article><p>C</p><p>A</p><p>D</p><p>F</p></article><p>Read on</p><p>here</p>"),
             (11, "x", "<![x[ y ]]><p>kept</p><![CDATA[ z ]]>")]
    rows = htmldiff.extract(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("rank", F.lit("x"))).collect()
    got = {r["page_id"]: r["text"] for r in rows}
    assert got[1] == got[2] == "T\n\nSame text" and got[3] == "one & more\n\nhere 1\n\nx own" and got[4] == "two & more\n\nhere 2\n\ny own"
    assert got[5] == got[6] == "" and len(rows) == len(pages) and got[7] == got[8] == "Copied one\n\nCopied two\n\nCopied three" and got[11] == "kept"
    # a line of the site goes in and out of articles; a passage that both articles hold stays
    assert got[9] == "A\n\nB\n\nE\n\nG\n\nout 1" and got[10] == "C\n\nA\n\nD\n\nF"
    assert htmldiff.extract(spark.createDataFrame([], "page_id long, url string, html string")).isEmpty()


@pytest.mark.parametrize("n", [40, 300])
def test_partners_are_the_nearest_pages_of_any_host(spark, monkeypatch, n):
    monkeypatch.setattr(htmldiff, "RUN", 16)
    r = random.Random(n)
    pages = [(i, f"http://h.org/{r.choice('abc')}/{r.randrange(900)}", "".join(f"<p>{r.choice('qrstuv')}{k}</p>" for k in range(9)) + f"<p>only {i}</p>" * 8) for i in range(n)]
    order = sorted((u.split("h.org")[1], i, h) for i, u, h in pages)
    want = {}
    for at, (path, i, h) in enumerate(order):
        own = [(t, m, a) for t, m, a in htmldiff.blocks_of(h)]
        near = sorted((k for k in range(max(0, at - 2), min(n, at + 3)) if k != at), key=lambda k: (-len(os.path.commonprefix([path, order[k][0]])), abs(k - at), k))
        other = htmldiff.blocks_of(order[near[0]][2])
        want[i] = htmldiff.main_text(own, set(htmldiff.deleted(own, other)))
    if len({p for p, _, _ in order}) == n:  # equal paths are ordered by hash
        assert {x["page_id"]: x["text"] for x in htmldiff.extract(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)).collect()} == want


@pytest.mark.parametrize("bits", [1 << 28, 8])
def test_common_subsequence_is_longest(monkeypatch, bits):
    monkeypatch.setattr(htmldiff, "TABLE_BITS", bits)
    for seed in range(60):
        r = random.Random(seed)
        a, b = [r.choice("abc") for _ in range(r.randrange(14))], [r.choice("abc") for _ in range(r.randrange(14))]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        pairs = htmldiff.common_subsequence(a, b)
        assert len(pairs) == best[-1][-1] and all(a[i] == b[j] for i, j in pairs) and all(x < y for p, q in zip(pairs, pairs[1:]) for x, y in zip(p, q))


def test_html_that_is_malformed_or_very_deep(spark):
    r = random.Random(3)
    for _ in range(3000):
        htmldiff.blocks_of("".join(r.choice(["<", ">", "!", "[", "]", "-", "/", "p", "article", "x", " ", '"', "=", "&#", "class", "?", ";", "script"]) for _ in range(25)))
    assert htmldiff.blocks_of("<div><b>" * 30_000 + "end") == [("end", False, False)]
    blocks = htmldiff.blocks_of('<article><p class="related-work">Body</p><div class="post-menu-review">X</div><div class="share-buttons">S</div><header>T</header></article>')
    assert [(t, m) for t, m, _ in blocks] == [("Body", False), ("X", False), ("S", True), ("T", False)]


@pytest.mark.parametrize(("html", "want"), [
    ("<p>one <script>x</script>two</p>", ["one two"]), ("<p>a <button>b</button> c</p>", ["a c"]), ("<p>a<style>p {}</style>b <svg><text>x</text></svg>c</p>", ["ab c"]),
    ("<p>a <select><option>x<option>y</select> b</p><p>c</p>", ["a b", "c"]), ("<p>a <button>b</p><p>c</p>", ["a", "c"]), ("<div>a <noscript>b</noscript></div>c", ["a", "c"]), ("<p>a<nav>b</nav>c</p>", ["a", "c"]),
])
def test_what_is_skipped_within_a_line_does_not_end_it(html, want):
    assert [t for t, marked, _ in htmldiff.blocks_of(html) if not marked] == want


def test_language_accuracy_and_empty_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = langid.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() >= 0.97 and got["score"].between(0, 1).all()
    assert all(h == (zlib.crc32(str(d).encode()) % 3 == 1) for d, h in zip(got["doc_id"], got["held_out"], strict=True))
    few = spark.createDataFrame([(1, None, "en"), (2, "12 !", "en"), (3, "hello hello", "en"), (4, "hello", None), (None, "hé 🙂 𝒳", "en")], "doc_id long, text string, lang string")
    pred = {r["doc_id"]: r["lang_pred"] for r in langid.language_id(few).collect()}
    assert pred[1] == pred[2] == "und" and pred[4] == "en"


def test_vectors_against_brute_force(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(60, 16))
    x = np.concatenate([base, base[:20] + 0.05 * r.normal(size=(20, 16)), base[:5], np.zeros((1, 16)), 3 * base[:2]])
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(900, None), (901, [1.0, float("nan")]), (902, [1.0, None]), (903, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cells", F.lit(1))
    got = {v["vec_id"]: v for v in vectors.near_duplicates(df).collect()}
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    cos = (x / np.where(norm, norm, 1)) @ (x / np.where(norm, norm, 1)).T
    links = (cos >= 0.9).sum(axis=1) - (norm[:, 0] > 0)
    found = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (found <= links).all() and found.sum() >= 0.95 * links.sum()
    assert got[60]["component_id"] == 0 and not got[60]["kept"] and all(got[i]["kept"] and got[i]["n_links"] == 0 for i in (85, 900, 901, 902, 903))


@pytest.mark.parametrize("how", [None, vectors.Plan(15, 2, 1, 0.5)])
def test_recall_of_pairs_at_the_limit(spark, monkeypatch, how):
    if how:
        monkeypatch.setattr(vectors, "plan", lambda *a: how)
    r = np.random.default_rng(5)
    base = r.normal(size=(600, 48))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    off = r.normal(size=base.shape)
    off -= (off * base).sum(axis=1, keepdims=True) * base
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    x = np.concatenate([base, 0.902 * base + (1 - 0.902**2) ** 0.5 * off])
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    want = ((x @ x.T) >= 0.9).sum() - len(x)
    found = vectors.near_duplicates(df).agg(F.sum("n_links")).first()[0]
    assert want >= 1200 and 0.985 * want <= found <= want


def test_plans_grow_with_the_corpus():
    plans = [vectors.plan(1 << k) for k in (10, 16, 22, 28, 34)]
    costs = [p.tables * (1 << k) * vectors.met(p.scale, p.probes, 0.0) ** p.blocks for k, p in zip((10, 16, 22, 28, 34), plans, strict=True)]
    assert [p.blocks for p in plans] == sorted(p.blocks for p in plans) and plans[0].blocks == 1 and plans[-1].blocks >= 3
    assert all(b < a * 60 for a, b in zip(costs, costs[1:]))  # candidates a vector, for 64 times as many vectors


def test_blocks_of_a_cell_count_each_pair_once(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=16) + 0.01 * r.normal(size=(150, 16))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    assert {(v["n_links"], v["component_id"]) for v in vectors.near_duplicates(df, block=16).collect()} == {(149, 0)}


def test_chat_quotes(spark):
    said = [(1, 0, "user", "Hello there everybody\nHow are things going?"), (1, 1, "assistant", "Fine thank you very much"),
            (1, 2, "user", "On Monday, X wrote:\n> Hello  there everybody\n> How are things going?\nNice to see"), (1, 3, "user", ">> hello there everybody\n> Nice to see\nok then"),
            (None, 1, "user", None), (2, None, None, "> x"), (1, 1, "assistant", "Fine thank you very much")]
    got = chat.formatted(spark.createDataFrame(said, "conv_id long, turn long, role string, text string").withColumn("thread_", F.lit(0))).collect()
    by = {(r["conv_id"], r["turn"]): r for r in got}
    assert by[1, 2]["reply_to"] == 0 and by[1, 3]["reply_to"] == 2 and by[1, 3]["thread"] == 0 and by[1, 3]["max_level"] == 2
    assert by[1, 2]["text"] == "Nice to see" and by[1, 1]["thread"] == 1 and len(got) == len(said)


def test_chat_links_deeper_and_short_quotes(spark):
    said = [(0, "Where shall we meet tomorrow?"), (1, "Yes"), (2, "A quite different remark"), (3, ">> Where shall we meet tomorrow?\n> never said by anyone here\nAt noon"), (4, ">> Where shall we meet tomorrow?\nforwarded"),
            (5, "> yes\nfine"), (6, ">> Where shall we meet tomorrow?\n> A quite different remark\nboth"), (7, "> Yes\n> and something unknown\na short line links"), (8, "> Yes\n\n> Where shall we meet tomorrow?\nlonger first")]
    df = spark.createDataFrame([(1, t, "user", x) for t, x in said], "conv_id long, turn long, role string, text string")
    got = {r["turn"]: (r["reply_to"], r["thread"]) for r in chat.formatted(df).collect()}
    assert got == {0: (None, 0), 1: (None, 1), 2: (None, 2), 3: (0, 0), 4: (0, 0), 5: (1, 1), 6: (2, 2), 7: (1, 1), 8: (0, 0)}


def test_chat_short_lines_link_within_longer_passages(spark):
    said = [(0, "Yes."), (1, "No."), (2, "> Yes.\n> (was it?) never said before"), (3, "> No.\n> Yes.\n\nboth were said"), (4, "> No.\n> (was it?) never said before\nlonger"), (5, ">> (was it?) never said before\n> Yes.\nlevel first")]
    df = spark.createDataFrame([(1, t, "user", x) for t, x in said], "conv_id long, turn long, role string, text string").repartition(2)
    got = {r["turn"]: r["reply_to"] for r in chat.formatted(df).collect()}
    assert got == {t: v for t, v in plain_links(said).items()} and got[2] == 0 and got[3] == 1 and got[5] == 0


def plain_links(said):
    """reply_to of each turn of one conversation, by comparing every quoted passage with every earlier message."""
    def norm(x):
        return " ".join(x.lower().split())

    own = {t: chat.own_text(chat.levels(x)) for t, x in said}
    out = {}
    for t, x in said:
        found = {}
        runs = [(level, [line for _, line in g]) for level, g in itertools.groupby(chat.levels(x), key=lambda p: p[0])]
        for level, part in runs:
            whole = "\n".join(part)
            parts = [whole, *re.split(r"\n\s*\n", whole), *part]
            for p in parts if level else ():
                if norm(p):
                    short = len(norm(p)) < chat.SHORT
                    firsts = [u for u, _ in said if norm(p) in {norm(q) for q in (own[u], *re.split(r"\n\s*\n", own[u]), *own[u].split("\n"))}]
                    if firsts and min(firsts) < t:
                        rank = 2 * level + short
                        found[rank] = max(found.get(rank, -1), min(firsts))
        out[t] = found[min(found)] if found else None
    return out


def test_chat_links_against_brute_force(spark):
    r = random.Random(6)
    said, want = [], {}
    for c in range(12):
        turns = []
        for t in range(10):
            lines = [f"{prose(100 * c + t, r.randint(1, 9))}" for _ in range(r.randint(1, 3))]
            for _ in range(r.randint(0, 2)):
                if turns:
                    quoted = r.choice(turns)[1].split("\n")
                    lines = [r.choice(["> ", ">> ", ">"]) + q for q in r.sample(quoted, min(len(quoted), 2))] + lines
            turns.append((t, "\n".join(lines)))
        said += [(c, t, "user", x) for t, x in turns]
        want |= {(c, t): u for t, u in plain_links(turns).items()}
    got = chat.formatted(spark.createDataFrame(said, "conv_id long, turn long, role string, text string").repartition(3)).collect()
    assert {(x["conv_id"], x["turn"]): x["reply_to"] for x in got} == want and sum(v is not None for v in want.values()) > 30
    for c in range(12):
        rows = sorted((x for x in got if x["conv_id"] == c), key=lambda x: x["position"])
        assert [x["position"] for x in rows] == list(range(10)) and [(x["thread"], x["turn"]) for x in rows] == sorted((x["thread"], x["turn"]) for x in rows)
        assert all(x["reply_to"] is None or [y["turn"] for y in rows].index(x["reply_to"]) < x["position"] for x in rows)


def test_language_filter_against_sets():
    r = np.random.default_rng(7)
    grams = {f"l{k:02}": np.unique(r.integers(0, 1 << 40, 3000)) for k in range(70)}  # more languages than a word has bits
    model = langid.Filter(grams)
    some = np.concatenate([grams["l03"][:500], grams["l68"][:500], r.integers(0, 1 << 40, 500)])
    masks = model.masks(some)
    for i, lang in enumerate(model.langs):
        hit = (masks[i // 64] >> np.uint64(i % 64) & np.uint64(1)).astype(bool)
        member = np.isin(some, grams[lang])
        assert hit[member].all() and (hit & ~member).mean() <= 4 * model.false[i] + 0.01


EMPTY = "doc_id long, text string, lang string, page_id long, url string, html string, vec_id long, embedding array<float>, conv_id long, turn long, role string, quality int, toxic int"
RUNS = [
    linededup.line_dedup, linededup.without_repeats, simhash.near_duplicates, simhash.keep_one, pii.personal_data, pii.sanitised, langid.language_id, htmldiff.extract, vectors.near_duplicates, chat.formatted, chat.without_quotes,
    lambda d: packing.packed_sequences(d, JSON), lambda d: bpe.digest_documents(d, RANKS, P.PATTERN), lambda d: quality.quality_rules(d, d), lambda d: quality.keep_good(d, d),
]


@pytest.mark.parametrize("run", RUNS)
def test_no_rows_give_no_rows(spark, run):
    assert run(spark.createDataFrame([], EMPTY)).isEmpty()


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert [n for n, _ in c.STAGES] == ["quality rules", "line dedup", "SimHash near-dedup", "PII", "packing"]
    now = docs
    for name, stage in c.STAGES[:-1]:
        now = stage(spark, now, "/root/testdata/sf0.001")
        assert now.columns == docs.columns, name
        now = now.persist()
    packed = c.run(spark, "/root/testdata/sf0.001")
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in now.select("doc_id").collect()}

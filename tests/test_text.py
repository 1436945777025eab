"""Text functions and metrics against hand-made cases and plain Python."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import align, check, outliers, patterns, shape, similarity, style
from corpusloom.sources import formats


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("It’s well-known, isn't it?", ["It's", "well-known", "isn't", "it"]), ("a1 b_c é", ["a", "b", "c", "é"]), ("12 ½ x²", ["½", "x²"]), ("", [])],
)
def test_words(spark, text, want):
    assert one(spark, T.words(F.col("t")), t=text) == want


def test_sentences_split_before_capitals_and_keep_closers_out(spark):
    got = one(spark, T.sentences(F.col("t")), t='He left. "Why?" Nobody knew.  Łukasz did! and more. 3 of them')
    assert got == ["He left.", '"Why?', "Nobody knew.", "Łukasz did! and more.", "3 of them"]


def test_blocks_headings_and_prose(spark):
    text = "---\nlang: en\n---\nA title\n\nFirst words here. “four words are quoted” and \"two words\" stay.\n\n| a | b |\n\n> quoted\n\nSources\n\nAfter the list."
    got = one(spark, T.prose_blocks(F.col("t")), t=text)
    assert [(b["n"], b["block"], b["heading"]) for b in got] == [(1, "A title", True), (2, 'First words here. and "two words" stay.', False)]
    assert [b["heading"] for b in one(spark, T.blocks(F.col("t")), t="one two\n\nends with stop.\n\na b c d e f g h i j k l")] == [True, False, False]


def test_subject_and_url(spark):
    assert one(spark, T.thread_subject(F.col("t")), t=" RE: fwd: Re[2]:  The   Plan") == "the plan"
    assert one(spark, T.url_key(F.col("t")), t="https://WWW.Example.com/A/b/#x") == "example.com/A/b"


def test_redaction(spark):
    text = "Mail a.b@c.org, call +31 20 123 4567, live at Kerkstraat 12, 1012 AB Amsterdam, Jan Jansen and Jan."
    assert one(spark, patterns.redacted(F.col("t"), [("Jan", "[p]"), ("Jan Jansen", "[q]")]), t=text) == "Mail [email], call [phone], live at Kerkstraat 12, [postcode] Amsterdam, [q] and [p]."


def test_overlapping_phrases_count_once_and_lines_bound_hits(spark):
    p = patterns.compiled("phrases", ["I think", "I think that"])
    assert one(spark, patterns.hits(F.col("t"), p), t="I think that. I  think so; i think\nI\nthink") == 3


def test_windows_drop_the_rest(spark):
    blocks = [" ".join(["word"] * n) + "." for n in (200, 160, 340, 20, 349)]
    texts = spark.createDataFrame([(1, "\n\n".join(blocks), "en", "t")], "key long, text string, lang string, type string")
    assert [r["window_words"] for r in style.windows(texts).orderBy("w").collect()] == [360, 360]


def test_metrics_of_empty_text(spark):
    texts = spark.createDataFrame([(1, None, "en", "t"), (2, "", "xx", None)], "key long, text string, lang string, type string")
    rows = {r["key"]: r for r in style.text_metrics(texts).collect()}
    assert rows[1]["short_sentence_share"] == 1.0 and rows[2]["hedges_per_1k"] is None


def test_leave_one_out_median_is_exact(spark):
    values = {"a": [3.0, 1.0, 2.0, 2.0, 9.0], "b": [1.0, 4.0, 4.0, 7.0], "c": [5.0]}
    rows = [(f"{s}{i}", s, "m", v, 0.02) for s, vs in values.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "key string, slot string, metric string, value double, floor double")
    got = {r["key"]: r["ref"] for r in outliers.without_self(df, ["slot"]).collect()}
    want = {f"{s}{i}": statistics.median(vs[:i] + vs[i + 1 :]) for s, vs in values.items() if len(vs) > 1 for i in range(len(vs))}
    assert got == want


def test_poisson_tail(spark):
    rows = spark.createDataFrame([(k, m) for k in range(8) for m in (0.0, 0.7, 3.0, 900.0)], "k int, m double")
    for r in rows.select("k", "m", check.poisson_tail(F.col("k"), F.col("m")).alias("p")).collect():
        below = sum(math.exp(-r["m"] + i * math.log(r["m"]) - math.lgamma(i + 1)) for i in range(r["k"])) if r["m"] else 1.0
        assert r["p"] == pytest.approx(1.0 if r["k"] == 0 else max(0.0, 1 - below), abs=1e-9)


def test_near_duplicates_against_brute_force(spark):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    texts = {0: words, 1: words, 2: words[:-1], 3: words[:-8], 4: words[:60], 5: words[60:], 6: ["a"], 7: words[1:] + ["zz"]}
    df = spark.createDataFrame([(k, " ".join(w), "en", "t") for k, w in texts.items()] + [(9, None, "en", "t")], "key long, text string, lang string, type string")
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, w in texts.items()} | {9: set()}
    link = {k: [j for j in sets if j != k and sets[j] | sets[k] and len(sets[j] & sets[k]) / len(sets[j] | sets[k]) >= 0.9] for k in sets}
    got = {r["key"]: (r["n_links"], r["component"]) for r in similarity.near_duplicates(df).collect()}
    for k in sets:
        seen, todo = {k}, [k]
        while todo:
            for j in link[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert got[k] == (len(link[k]), min(seen))


def test_shape_sections_and_quotes(spark):
    para = "You see this one. Plain " + " ".join(["plain"] * 59) + "."
    text = "\n\n".join(["Head one", para, para, "Head two", para, "Head three", para, para, "> quoted words of others"])
    r = shape.measures(spark.createDataFrame([(1, text, "en", "t")], "key long, text string, lang string, type string")).first()
    assert r["paragraph_sentences"] == 2.0 and r["paragraph_length_cv"] == 0.0 and r["section_length_cv"] == pytest.approx(0.2828, abs=1e-4)
    assert r["reader_address_per_1k"] == pytest.approx(5 * 1000 / 320, abs=1e-3)


def test_alignment():
    assert align.share("a b c d", "a x c d") == 0.75
    assert align.changes("One is here. Two is cut. Three stays.", "One is here. Three stays.") == [("Two is cut.", "")]
    assert align.units("One thing and another thing.", "One thing. Another thing.") == [("One thing and another thing.", "One thing. Another thing.")]


def test_formats():
    assert formats.markdown(b"> [!note] T\n> body")["blocks"] == ["body"]
    assert formats.markdown(b"a\n\n> [!tip]- T\n> one\n> two\n\n> quote\n\nb\n> [!x]\n\n> quote")["blocks"] == ["a", "one two", "b"]
    md = formats.markdown(b"---\ndate: 2024-01-02\ntags: [a, b]\n---\n# Title\n\nSome [link](x) and **bold**.\n\n> quote\n\n```\ncode\n```\n\n| 1 | 2 |\n| 3 | 4 |\n")
    assert md == {"blocks": ["Title", "Some link and bold."], "doc_date": "2024-01-02", "tags": ["a", "b"]}
    vtt = b"WEBVTT\n\n00:00.000 --> 00:01.000\nAnn: Hello\n\n00:02.990 --> 00:04.000\nAnn: there\n\n00:06.000 --> 00:07.000\nAnn: later\n\n00:07.100 --> 00:08.000\nBob: hi\n"
    assert formats.transcript(vtt) == {"blocks": ["Hello there", "later", "hi"], "flags": ["several speakers"]}
    eml = formats.mail(b"Subject: Re: x\nDate: Mon, 1 Jan 2024 10:00:00 +0000\n\nHello there\n\n> quoted\n-- \nsig\n")
    assert eml["blocks"] == ["Hello there"] and eml["doc_date"] == "2024-01-01"
    assert formats.feed(b"<urlset><url><loc>http://a/b</loc><lastmod>2024-01-01</lastmod></url></urlset>") == [("http://a/b", "2024-01-01")]


def test_files_and_globs(spark, tmp_path):
    (tmp_path / "a.md").write_text("Hello world")
    (tmp_path / "b.msg").write_bytes(b"%PDF")
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "c.md").write_text("no")
    rows = {r["path"].rsplit("/", 1)[-1]: r for r in formats.read_files(spark, str(tmp_path)).collect()}
    assert rows["a.md"]["blocks"] == ["Hello world"] and rows["b.msg"]["flags"] == ["skipped: not prose"] and "c.md" not in rows
    assert formats.glob_pattern("a/**/b?.md") == r"^a/(?:[^/]*/)*b[^/]\.md$"


def test_shingles_of_one_set_are_not_sent_on(spark):
    """Of sets that share one shingle in a thousand only that one is sorted and joined."""
    sets = [(i, sorted([-1, *range(1000 * i, 1000 * i + 999)])) for i in range(1, 4)] + [(9, sorted([-1, *range(1000, 1999)][:-3]))]
    got = similarity.similar_sets(spark.createDataFrame(sets, "id long, sh array<long>"))
    assert [(r["a"], r["b"]) for r in got.collect()] == [(1, 9)]
    assert "> 1)" in got._jdf.queryExecution().optimizedPlan().toString()

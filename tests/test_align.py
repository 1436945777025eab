"""Edits between two versions, the matching of drafts over several micro-batches, pages and Word files."""

import datetime as dt
import io
import itertools
import random
import zipfile

from corpusloom.operators import align
from corpusloom.sources import formats
from corpusloom.streaming import published

from test_streaming import NOW, SCHEMA


def test_share_counts_numbers_and_ignores_case():
    assert align.share("One 2 three", "one 2 four three") == 1.0 and align.share("a b c d", "d c b a") == 0.25 and align.share("", "x") == 0.0


def test_edits_of_case_alone_are_edits():
    assert align.changes("One thing. Two things.", "One thing. two things.") == [("One thing. Two things.", "One thing. two things.")]
    assert align.units("Same  here. Gone now. Last.", "Same here. Last.") == [("Gone now.", "")]
    assert align.units("A long sentence, and then more of it.", "A long sentence. And then more of it.") == [("A long sentence, and then more of it.", "A long sentence. And then more of it.")]


def test_units_are_the_best_of_all_alignments():
    r = random.Random(1)

    def every(n, m):
        if not n and not m:
            yield []
        for x, y in align.UNITS:
            if x <= n and y <= m:
                for rest in every(n - x, m - y):
                    yield [(x, y), *rest]

    for _ in range(40):
        a, b = ([" ".join(r.choice(["red", "blue", "green", "dog"]) for _ in range(3)) for _ in range(r.randrange(4))] for _ in range(2))

        def score(steps):
            i = j = 0
            total = 0.0
            for x, y in steps:
                total += max(x, y) * align._matcher(" ".join(a[i : i + x]), " ".join(b[j : j + y])).ratio() if x and y else 0
                i, j = i + x, j + y
            return total

        pairs = align.paired(a, b)
        assert " ".join(x for x, _ in pairs if x) == " ".join(a) and " ".join(y for _, y in pairs if y) == " ".join(b)
        steps = [(len(x.split()) // 3, len(y.split()) // 3) for x, y in pairs]
        assert abs(score(steps) - max(map(score, every(len(a), len(b))))) < 1e-9


def test_kinds_of_edits():
    said = {("", "New."): "insert", ("Old.", ""): "cut", ("One, two.", "One. Two."): "split", ("One. Two.", "One, two."): "merge", ("one two", "One two"): "case", ("one, two", "one two"): "marks",
            ("very big dog", "big dog"): "trim", ("big dog", "very big dog"): "expand", ("big dog", "big cat"): "reword"}
    assert {k: align.kind(*k) for k in said} == said and set(said.values()) == set(align.KINDS)


def test_a_draft_is_used_once_over_all_batches(spark, tmp_path):
    known = [("sam", "draft", "d1", NOW, "one two three four five"), ("sam", "draft", "d2", NOW, "one two three four six")]
    for k, (i, text) in enumerate([("t1", "one two three four five"), ("t2", "one two three four five"), ("t3", "one two three four five")]):
        spark.createDataFrame([("sam", "text", i, NOW - dt.timedelta(days=1 - k), text)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second start finds nothing new
        query = published.run_matching(spark, stream, spark.createDataFrame(known, SCHEMA), str(tmp_path / "out"), str(tmp_path / "state"))
        query.awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r["draft"] for r in rows) == ["d1", "d2"] and len({r["text_id"] for r in rows}) == 2 and len({r["batch"] for r in rows}) == 2


def test_page_text_and_date(spark):
    page = "<html><head><title>T</title></head><body><nav>menu</nav><main><p>In &amp; out<pre>code</pre><figure><figcaption>Seen</figcaption></figure><button>Go</button></p>tail</main><p>after</p></body></html>"
    assert formats.paragraphs_of(page) == ["In & out", "Seen", "Go", "tail"] and formats.paragraphs_of(None) == [] and formats.paragraphs_of("plain<br>text") == ["plain", "text"]
    rows = ["<META content='2024-02-03T01:00' property='article:published_time'>", '<time class="x" datetime="2023-01-02">', "<p>none"]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, html string").select("i", formats.page_date("html").alias("d")).collect()
    assert [r["d"] for r in sorted(got)] == ["2024-02-03", "2023-01-02", None]


def test_docx_without_deletions():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f"<w:document {w}><w:body><w:p><w:r><w:t>Kept</w:t></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del><w:ins><w:r><w:tab/><w:t>new</w:t></w:r></w:ins></w:p><w:p/></w:body></w:document>"
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", body)
        z.writestr("docProps/core.xml", "<x><dcterms:created>2024-05-06T00:00:00Z</dcterms:created></x>")
    assert formats.docx(raw.getvalue()) == {"blocks": ["Kept new"], "doc_date": "2024-05-06"}


def test_steps_cover_every_size():
    assert all(any((x, y) == u for u in align.UNITS) for x, y in itertools.product((0, 1), repeat=2) if x or y)

"""Registered queries on patterns, redaction, shape, bunched habits, alignment and web text, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import packs
from .functions import text as T
from .operators import align, check, patterns, shape
from .operators.similarity import checkpointed
from .plans import oracle as O
from .plans import style_sql
from .sources import formats
from .sources.tables import conversations, documents, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


#: tests of the four forms over words of the sample texts
TESTS = {
    "chars": patterns.compiled("chars", ["!", "|"]),
    "words": patterns.compiled("words", ["stupid", "idiot", "the"]),
    "phrases": patterns.compiled("phrases", ["of the", "of the and", "de la"]),
    "pattern": patterns.compiled("pattern", r"\bth\w+ing\b"),
}
_NW = r"[^\p{L}\p{N}_]"


def _whole(words: str) -> str:
    """Hits of whole words or phrases, without look-around: neighbours are doubled first."""
    doubled = f"regexp_replace(x, '({_NW})', '\\1\\1', 'g')"
    return f"len(regexp_extract_all({doubled}, '(?i)(?:^|{_NW})(?:{words})(?:$|{_NW})'))"


_HITS = {
    "chars": "len(regexp_extract_all(x, '[!|]'))",
    "words": _whole("stupid|idiot|the"),
    "phrases": _whole("of  the  and|of  the|de  la"),
    "pattern": f"len(regexp_extract_all(regexp_replace(x, '({_NW})', '\\1\\1', 'g'), '(?i)(?:^|{_NW})th[\\p{{L}}\\p{{N}}_]+ing(?:$|{_NW})'))",
}
_LINES = "ln AS (SELECT doc_id AS key, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)"
_COUNTED = f"""{_LINES}, per AS (SELECT key, {', '.join(f'sum({v}) AS {k}' for k, v in _HITS.items())} FROM ln GROUP BY key),
base AS (SELECT doc_id AS key, lang, source AS type, {O.n_words('text')} AS n_words FROM documents),
counted AS ({' UNION ALL '.join(f"SELECT key, lang, type, n_words, '{k}' AS id, {k}::BIGINT AS hits FROM base JOIN per USING (key)" for k in _HITS)})"""


@add("o037_hits_per_line", f"WITH {_LINES}, h AS (SELECT key, line, {_HITS['words']} AS hits FROM ln) SELECT key, line, hits FROM h WHERE hits > 0")
def o037(spark, d):
    return patterns.hits_per_line(documents(spark, d), TESTS["words"])


@add("o038_test_counts", f"WITH {_COUNTED} SELECT key, id, hits FROM counted")
def o038(spark, d):
    """The four test forms, counted in one scan (O-035, O-036, O-038, O-076)."""
    return patterns.counted(documents(spark, d), TESTS).select("key", "id", F.col("hits").cast("long").alias("hits"))


_RATES = "rates AS (SELECT lang, id, round(sum(hits) * 1000 / sum(n_words), 2) AS per_1k, count(*) FILTER (hits > 0) AS texts, count(*) AS of FROM counted GROUP BY lang, id)"


@add("o092_phrase_rates", f"WITH {_COUNTED}, {_RATES} SELECT lang, id, per_1k, texts, of FROM rates")
def o092(spark, d):
    return patterns.rates(documents(spark, d), TESTS, ["lang"])


@add("o142_ruling_flags", f"WITH {_COUNTED}, {_RATES} SELECT key, id, hits, coalesce(per_1k, 0) <= 0 OR (hits >= 2 AND hits * 1000 / greatest(n_words, 1) > 2 * per_1k) AS flagged FROM counted LEFT JOIN rates USING (lang, id) WHERE hits > 0")
def o142(spark, d):
    docs = documents(spark, d)
    return patterns.ruling_flags(docs, TESTS, patterns.rates(docs, TESTS, ["lang"]).select("lang", "id", "per_1k"), ["lang"])


_ALLOW = """r AS (SELECT lang, id, hits, n_words, hits * 1000 / n_words AS r, row_number() OVER (PARTITION BY lang, id ORDER BY hits * 1000 / n_words) AS rn, count(*) OVER (PARTITION BY lang, id) AS n FROM counted WHERE n_words > 0),
pr AS (SELECT lang, id, max(CASE WHEN rn = greatest(1, ceil(0.95 * n)) THEN r END) AS p, sum(hits) AS h, sum(n_words) AS w FROM r GROUP BY lang, id),
allow AS (SELECT lang, id, round(CASE WHEN h = 0 THEN 0 WHEN p = 0 THEN greatest(0.01, h * 1000 / w) ELSE p END, 2) AS rate FROM pr)"""


@add("o094_sign_allowance", f"WITH {_COUNTED}, {_ALLOW} SELECT lang, id, rate FROM allow")
def o094(spark, d):
    return patterns.allowances(documents(spark, d), TESTS, ["lang"])


@add("o143_sign_flags", f"WITH {_COUNTED}, {_ALLOW}, x AS (SELECT key, id, hits, CASE WHEN coalesce(rate, 0) > 0 THEN greatest(1, ceil(rate * n_words / 1000))::BIGINT ELSE 0 END AS allowed FROM counted LEFT JOIN allow USING (lang, id) WHERE hits >= 1) SELECT key, id, hits, allowed, hits > allowed AS flagged FROM x")
def o143(spark, d):
    docs = documents(spark, d)
    return patterns.sign_flags(docs, TESTS, patterns.allowances(docs, TESTS, ["lang"]), ["lang"])


@add("o144_scan_without_writer", f"WITH {_COUNTED} SELECT key, id, hits FROM counted WHERE hits >= 3")
def o144(spark, d):
    return patterns.counted(documents(spark, d), TESTS).where("hits >= 3").select("key", "id", F.col("hits").cast("long").alias("hits"))


@add(
    "o095_marker_totals",
    f"WITH {_COUNTED}, t AS (SELECT lang, key, sum(hits) AS h, any_value(n_words) AS w FROM counted GROUP BY lang, key), g AS (SELECT lang, sum(h) AS hits, sum(w) AS words, count(*) FILTER (h > 0) AS texts, count(*) AS of, max(CASE WHEN w >= 300 THEN h * 1000 / w END) AS mx FROM t GROUP BY lang)"
    " SELECT lang, hits::BIGINT AS hits, texts, of, round(hits * 1000 / words, 2) AS per_1k, round(mx, 2) AS max_per_1k, CASE WHEN round(hits * 1000 / words, 2) < 1 THEN 'light' WHEN round(hits * 1000 / words, 2) < 4 THEN 'moderate' ELSE 'strong' END AS strength FROM g",
)
def o095(spark, d):
    t = patterns.counted(documents(spark, d), TESTS).groupBy("lang", "key").agg(F.sum("hits").alias("h"), F.max("n_words").alias("w"))
    g = t.groupBy("lang").agg(F.sum("h").alias("hits"), F.sum("w").alias("words"), F.sum((F.col("h") > 0).cast("long")).alias("texts"), F.count("*").alias("of"), F.max(F.when(F.col("w") >= 300, F.col("h") * 1000 / F.col("w"))).alias("mx"))
    rate = F.round(F.col("hits") * 1000 / F.col("words"), 2)
    return g.select("lang", "hits", "texts", "of", rate.alias("per_1k"), F.round("mx", 2).alias("max_per_1k"), F.when(rate < 1, "light").when(rate < 4, "moderate").otherwise("strong").alias("strength"))




@add("o039_redacted")
def o039(spark, d):
    """E-mail, bank, profile, phone and postcode redaction; look-behind keeps it from SQL, a test holds it against hand-made texts."""
    done = patterns.redaction(F.col("text"), [("Anblewh", "[person]")])
    said = T.once(done, lambda x: F.struct(F.md5(x["text"]).alias("digest"), (x["text"] != F.col("text")).alias("changed"), F.size(x["found"]).cast("long").alias("replaced")))
    return table(spark, d, "documents").select("doc_id", said.alias("x")).select("doc_id", "x.*")


@add("o033_normal_quotes", "SELECT doc_id, md5(translate(text, '’‘“” ', '''''\"\" ')) AS digest FROM documents")
def o033(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.normal_quotes(F.col("text"))).alias("digest"))


@add("o040_placeholders", "SELECT doc_id, len(regexp_extract_all(t, '(?i)\\[[^\\[\\]\\n]{0,120}?\\bneeded\\b[^\\[\\]\\n]{0,120}?\\]')) AS n FROM (SELECT doc_id, replace(text, '. ', ' [example needed: x]. ') AS t FROM documents)")
def o040(spark, d):
    t = F.replace("text", F.lit(". "), F.lit(" [example needed: x]. "))
    return table(spark, d, "documents").select("doc_id", F.regexp_count(t, F.lit(T.PLACEHOLDER)).cast("long").alias("n"))


_STOP = ", ".join(f"'{w}'" for w in packs.STOPWORDS["en"])


@add("o043_lesson_key", f"SELECT item_id, array_to_string(list_filter(string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')), ' '), lambda w: w NOT IN ({_STOP}, '')), ' ') AS key FROM benchmark")
def o043(spark, d):
    from .operators.ledger import lesson_key

    return table(spark, d, "benchmark").select("item_id", lesson_key(F.col("text")).alias("key"))


@add("o050_piece_length", "SELECT doc_id, nullif(replace(regexp_extract('write ' || (doc_id * 37)::VARCHAR || ',000 words now', '(\\d{1,3}(?:[.,]\\d{3})+|\\d+)\\s+words', 1), ',', ''), '')::BIGINT AS n FROM documents")
def o050(spark, d):
    brief = F.concat(F.lit("write "), (F.col("doc_id") * 37).cast("string"), F.lit(",000 words now"))
    n = F.regexp_extract(brief, r"(\d{1,3}(?:[.,]\d{3})+|\d+)\s+words", 1)
    return table(spark, d, "documents").select("doc_id", F.nullif(F.replace(n, F.lit(","), F.lit("")), F.lit("")).cast("long").alias("n"))


@add("o051_brief_specifics", f"SELECT item_id, len(list_distinct(regexp_extract_all(text, '\\d+'))) AS numbers, len(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+ [A-Z][a-z]+'))) AS names FROM benchmark")
def o051(spark, d):
    n = lambda p: F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(p), F.lit(0)))).cast("long")
    return table(spark, d, "benchmark").select("item_id", n(r"\d+").alias("numbers"), n("[A-Z][a-z]+ [A-Z][a-z]+").alias("names"))


@add("o056_globs", "SELECT doc_id, regexp_full_match('dir' || doc_id % 7 || '/sub/f' || doc_id || '.md', '(?:[^/]*/)*f[^/]1[^/]*\\.md') AS hit FROM documents")
def o056(spark, d):
    path = F.concat(F.lit("dir"), (F.col("doc_id") % 7).cast("string"), F.lit("/sub/f"), F.col("doc_id").cast("string"), F.lit(".md"))
    return table(spark, d, "documents").select("doc_id", path.rlike(formats.glob_pattern("**/f?1*.md")).alias("hit"))




@add("o096_shape", style_sql.SHAPE)
def o096(spark, d):
    """Shape of the conversations; sections are folds, a test has a case made by hand."""
    return shape.measures(conversations(spark, d))


@add("o097_shape_ranges", style_sql.SHAPE_RANGES)
def o097(spark, d):
    return shape.ranges(shape.measures(conversations(spark, d)), ["lang"])


@add("o147_shape_flags", style_sql.SHAPE_FLAGS)
def o147(spark, d):
    own = shape.measures(conversations(spark, d))
    return shape.compared(own, shape.ranges(own, ["lang"]), ["lang"])


@add("o147_shape_warnings", f"SELECT key, count(*) FILTER (flag <> 'ok') AS off, count(*) FILTER (flag <> 'ok') >= 4 AS warned FROM ({style_sql.SHAPE_FLAGS}) GROUP BY key")
def o147_warnings(spark, d):
    own = shape.measures(conversations(spark, d))
    return shape.warned(shape.compared(own, shape.ranges(own, ["lang"]), ["lang"]))


@add("o098_quirk_counts", f"WITH {O.prose(O.DOCS)}, p AS (SELECT key, string_agg(regexp_replace(b, '`[^`\\n]*`', ' ', 'g'), chr(10) ORDER BY n) AS body FROM prose WHERE NOT heading GROUP BY key) SELECT key, {O.n_words('body')} AS n_words, {', '.join(f'{v} AS {k}' for k, v in style_sql._MARKS.items())} FROM p")
def o098(spark, d):
    return shape.quirks(documents(spark, d)).where("n_words > 0").select("key", "n_words", *shape.QUIRKS)


@add("o148_quirk_flags", style_sql.QUIRKS)
def o148(spark, d):
    counts = checkpointed(shape.quirks(documents(spark, d)))  # a filter on counts would else find them before texts are spread, and again after
    return shape.quirk_flags(counts, shape.quirk_ranges(counts, ["lang"]), ["lang"])


@add("o141_poisson_tail", "WITH g AS (SELECT k, m FROM (SELECT unnest(range(0, 9)) AS k), (SELECT unnest([0.0, 0.5, 2.0, 7.5]) AS m)) SELECT k, m, round(CASE WHEN k <= 0 THEN 1.0 WHEN m <= 0 THEN 0.0 ELSE 1 - list_sum(list_transform(range(0, k), lambda i: exp(-m) * pow(m, i) / factorial(i::INT))) END, 9) AS p FROM g")
def o141(spark, d):
    k = spark.range(9).select(F.col("id").alias("k"))
    g = k.crossJoin(F.broadcast(spark.createDataFrame([(0.0,), (0.5,), (2.0,), (7.5,)], "m double")))  # thirty-six rows
    return g.select("k", "m", F.round(check.poisson_tail(F.col("k").cast("int"), F.col("m")), 9).alias("p"))


@add("o008_page_text")
def o008(spark, d):
    """Main text of pages by its elements; a test holds it against hand-made pages."""
    return table(spark, d, "pages").select("page_id", formats.page_text(F.col("html")).alias("text"))


@add("o009_page_date", "SELECT page_id, coalesce(nullif(regexp_extract(html, '(?i)<meta[^>]+published_time[^>]+content=.(\\d{4}-\\d{2}-\\d{2})', 1), ''), nullif(regexp_extract(html, '(?i)<time[^>]+datetime=.(\\d{4}-\\d{2}-\\d{2})', 1), '')) AS day FROM pages")
def o009(spark, d):
    return table(spark, d, "pages").select("page_id", formats.page_date(F.col("html")).alias("day"))


@add("o132_token_share")
def o132(spark, d):
    """How much of each passage the document of the same number keeps, in order."""
    return _pairs(spark, d).select("key", align.token_share("before", "after").alias("share"))


@add("o133_sentence_diff")
def o133(spark, d):
    return _pairs(spark, d).select("key", F.inline(align.sentence_changes("before", "after")))


@add("o134_unit_alignment")
def o134(spark, d):
    return _pairs(spark, d).select("key", F.inline(align.aligned_units("before", "after")))


def _pairs(spark, d):
    a = table(spark, d, "benchmark").select(F.col("item_id").alias("key"), F.col("text").alias("before"))
    return a.withColumn("after", F.concat(F.regexp_replace("before", r"\b(the|of) ", ""), F.lit(" One more sentence.")))


@add("o135_edit_kinds")
def o135(spark, d):
    """Edits between passages and their changed versions, by kind, with the pairs they occur in."""
    from .operators.ledger import edit_lessons

    edits = _pairs(spark, d).select(F.col("key").alias("pair"), F.inline(align.aligned_units("before", "after")))
    return edit_lessons(edits.withColumn("kind", align.edit_kind("before", "after")))


@add("o136_identified")
def o136(spark, d):
    """A language code and confidence from letters and short words; the column lang is not read."""
    return table(spark, d, "documents").select("doc_id", F.inline(F.array(align.identified("text"))))


@add("o169_moving_ttr", style_sql.TTR)
def o169(spark, d):
    """Mean share of distinct words over windows of 100 words, every ten words."""
    return documents(spark, d).select("key", style_ttr().alias("ttr"))


def style_ttr(size: int = 100, step: int = 10):
    def of(w):
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1)), F.lit(step))
        shares = F.transform(starts, lambda i: F.size(F.array_distinct(F.slice(w, i, size))) / F.least(F.lit(size), F.size(w)))
        return F.when(F.size(w) > 0, F.aggregate(shares, F.lit(0.0), lambda a, x: a + x) / F.size(shares))

    return F.round(F.get(F.transform(F.array(F.transform(T.words(F.col("text")), lambda x: F.lower(x))), of), 0), 6)


@add("o213_excerpt", f"SELECT doc_id, array_to_string(({O.words('text')})[1:300], ' ') AS excerpt FROM documents")
def o213(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(F.slice(T.words(F.col("text")), 1, 300), " ").alias("excerpt"))


@add("o209_guide_lines", "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents")
def o209(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return rows.select("doc_id", "line", (F.col("i") + 1).cast("long").alias("n"))


@add("o093_ruling_rates", f"WITH {_COUNTED}, m AS (SELECT lang, type, id, round(sum(hits) * 1000 / sum(n_words), 2) AS per_1k FROM counted GROUP BY ALL) SELECT lang, type, id, per_1k FROM m")
def o093(spark, d):
    return patterns.rates(documents(spark, d), TESTS, ["lang", "type"]).select("lang", "type", "id", "per_1k")


@add("o101_never_list", "WITH w AS (SELECT item_id, lower(unnest(ws)) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT item_id, " + O.words("text") + " AS ws FROM benchmark)), g AS (SELECT DISTINCT item_id, w || ' ' || lead(w) OVER (PARTITION BY item_id ORDER BY i) AS g FROM w) SELECT g, count(*) AS texts FROM g WHERE g IS NOT NULL GROUP BY g HAVING count(*) >= 3 ORDER BY texts DESC, g LIMIT 15")
def o101(spark, d):
    """The fifteen word pairs that most passages share."""
    from .operators.similarity import grams

    low = F.transform(T.words(F.col("text")), lambda w: F.lower(w))
    g = table(spark, d, "benchmark").select(F.explode(grams(low, 2)).alias("g")).groupBy("g").agg(F.count("*").alias("texts"))
    return g.where("texts >= 3").orderBy(F.desc("texts"), "g").limit(15)



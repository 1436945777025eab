"""Registered queries on text functions and style metrics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as T
from .operators import style
from .plans import oracle as O
from .plans import style_sql
from .sources.tables import conversations, documents, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, sql: str | None = None):
    """Register a query and its SQL."""

    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


@add("o023_words", f"SELECT doc_id, len(w) AS n, coalesce(w[1], '') AS first_word, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, {O.words('text')} AS w FROM documents)")
def o023(spark, d):
    w = F.col("w")
    return table(spark, d, "documents").select("doc_id", T.words(F.col("text")).alias("w")).select("doc_id", F.size(w).cast("long").alias("n"), F.coalesce(F.get(w, 0), F.lit("")).alias("first_word"), F.md5(F.array_join(w, " ")).alias("digest"))


@add("o024_word_count", f"SELECT conv_id, turn, {O.n_words('text')} AS n FROM conversations")
def o024(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.n_words(F.col("text")).cast("long").alias("n"))


@add("o025_sentences", f"SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, {O.split_sentences('text')} AS s FROM documents)")
def o025(spark, d):
    s = F.col("s")
    return table(spark, d, "documents").select("doc_id", T.sentences(F.col("text")).alias("s")).select("doc_id", F.size(s).cast("long").alias("n"), F.md5(F.array_join(s, "|")).alias("digest"))


@add("o026_blocks", f"WITH {O.blocks(O.TALKS)} SELECT key, n, b AS block, heading FROM blk")
def o026(spark, d):
    """Blocks of the conversations, with their number and the heading test."""
    rows = conversations(spark, d).select("key", F.inline(T.blocks(F.col("text"))))
    return rows.select("key", F.col("n").cast("long").alias("n"), "block", "heading")


@add("o027_headings", f"SELECT conv_id, turn, {O.heading('text')} AS heading FROM conversations")
def o027(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.is_heading(F.col("text")).alias("heading"))


@add("o028_not_prose", f"SELECT doc_id, {O.not_prose('marked')} AS not_prose FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '> ' || replace(text, chr(10), chr(10) || '> ') WHEN 1 THEN '|' || text ELSE text END AS marked FROM documents)")
def o028(spark, d):
    m = F.col("doc_id") % 3
    marked = F.when(m == 0, F.concat(F.lit("> "), F.replace("text", F.lit("\n"), F.lit("\n> ")))).when(m == 1, F.concat(F.lit("|"), "text")).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", T.not_prose(marked).alias("not_prose"))


@add("o029_unquoted", "WITH q AS (SELECT conv_id, turn, regexp_replace(text, '(\\w+) (\\w+) (\\w+) (\\w+)[.]', '\"\\1 \\2 \\3 \\4\" “\\1 \\2”.', 'g') AS t FROM conversations)" + f" SELECT conv_id, turn, {O.unquoted('t')} AS text FROM q")
def o029(spark, d):
    """Turns with quotations put in, and the long ones taken out again."""
    t = F.regexp_replace("text", r"(\w+) (\w+) (\w+) (\w+)[.]", '"$1 $2 $3 $4" “$1 $2”.')
    return table(spark, d, "conversations").select("conv_id", "turn", T.unquoted(t).alias("text"))


@add("o030_prose_blocks", f"WITH {O.prose(O.TALKS)} SELECT key, n, b AS block, heading FROM prose")
def o030(spark, d):
    rows = conversations(spark, d).select("key", F.inline(T.prose_blocks(F.col("text"))))
    return rows.select("key", F.col("n").cast("long").alias("n"), "block", "heading")


@add("o032_prepared", f"WITH {O.prose(O.DOCS)} SELECT key, count(*) AS n_blocks, sum({O.n_words('b')})::BIGINT AS n_words FROM prose WHERE NOT heading GROUP BY key")
def o032(spark, d):
    p = F.col("p")
    rows = documents(spark, d).select("key", T.paragraphs(F.col("text")).alias("p")).where(F.size("p") > 0)
    return rows.select("key", F.size(p).cast("long").alias("n_blocks"), F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + T.n_words(x)).alias("n_words"))


@add("o082_text_metrics", f"WITH {O.sums(O.DOCS)} SELECT key, lang, type, {O.value_columns()} FROM sums")
def o082(spark, d):
    return style.text_metrics(documents(spark, d))


@add("o082_talk_metrics", f"WITH {O.sums(O.TALKS)} SELECT key, lang, type, {O.value_columns()} FROM sums")
def o082_talk(spark, d):
    return style.text_metrics(conversations(spark, d))


_SUM = ", ".join(f"sum({s}) AS {s}" for s in O.SUMS)


@add("o083_slot_fingerprint", f"WITH {O.sums(O.DOCS)}, g AS (SELECT lang, type, count(*) AS n_texts, {_SUM} FROM sums GROUP BY lang, type) SELECT lang, type, n_texts, n_words::BIGINT AS n_words, {O.value_columns()} FROM g")
def o083(spark, d):
    """The flagship: one scan, one row of sums for each text, one aggregate."""
    return style.slot_metrics(documents(spark, d))


@add(
    "o084_pooled_slots",
    f"WITH {O.sums(O.DOCS)}, g AS (SELECT lang || '.' || type AS slot, false AS pooled, count(*) AS n_texts, {_SUM} FROM sums GROUP BY lang, type"
    f" UNION ALL SELECT lang || '._', true, count(*), {', '.join(f'sum({s})' for s in O.SUMS)} FROM sums GROUP BY lang) SELECT slot, pooled, n_texts, n_words::BIGINT AS n_words, {O.value_columns()} FROM g",
)
def o084(spark, d):
    return style.pooled_metrics(documents(spark, d))


_WSUM = ", ".join(f"sum({s} * (1 + (key % 5 = 0)::INT)) AS {s}" for s in O.SUMS)


@add("o085_recent_twice", f"WITH {O.sums(O.DOCS)}, g AS (SELECT lang, type, count(*) AS n_texts, {_WSUM} FROM sums GROUP BY lang, type) SELECT lang, type, n_texts, n_words::BIGINT AS n_words, {O.value_columns()} FROM g")
def o085(spark, d):
    """Every fifth text counts as recent, and so counts twice."""
    return style.slot_metrics(documents(spark, d), weight=1 + (F.col("key") % 5 == 0).cast("int"))


_DIRECT = "CASE WHEN n_texts < 3 OR n_words < 3000 THEN 'low' WHEN n_texts >= 8 AND n_words >= 15000 THEN 'high' ELSE 'medium' END"


@add("o089_count_level", f"SELECT lang, type, n_texts, n_words, {_DIRECT} AS level FROM (SELECT lang, source AS type, count(*) AS n_texts, sum({O.n_words('text')})::BIGINT AS n_words FROM documents GROUP BY ALL)")
def o089(spark, d):
    g = documents(spark, d).groupBy("lang", "type").agg(F.count("*").alias("n_texts"), F.sum(T.n_words(F.col("text"))).cast("long").alias("n_words"))
    return g.withColumn("level", style.count_level(F.col("n_texts"), F.col("n_words")))


_HALVES = f"""{O.sums(O.DOCS)}, drawn AS (SELECT sums.*, k, (('0x' || substr(md5(k || '/' || key), 1, 1))::INT % 2) AS half FROM sums, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
sides AS (SELECT lang, type, k, half, {_SUM} FROM drawn GROUP BY lang, type, k, half),
side_values AS (SELECT lang, type, k, half, {O.value_columns()} FROM sides), long AS ({O.melted('side_values', 'lang, type, k, half')}),
pairs AS (SELECT lang, type, k, metric, max(value) FILTER (half = 0) AS a, max(value) FILTER (half = 1) AS b FROM long GROUP BY ALL), {O.metric_table()},
over AS (SELECT lang, type, metric, sum((abs(a - b) / greatest(floor, (a + b) / 2) > tolerance)::INT)::BIGINT AS over FROM pairs JOIN metric_table USING (metric) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL)"""


@add("o090_split_half", f"WITH {_HALVES} SELECT lang, type, metric, over FROM over")
def o090(spark, d):
    return style.stability(documents(spark, d))


@add(
    "o091_confidence",
    f"WITH {_HALVES}, raw AS (SELECT lang, source AS type, count(*) AS n_texts, sum({O.n_words('text')})::BIGINT AS n_words FROM documents GROUP BY ALL),"
    f" lv AS (SELECT *, {_DIRECT} AS count_level FROM raw), sh AS (SELECT lang, type, sum((over >= 2)::INT)::BIGINT AS n_unstable, count(*) AS m FROM over GROUP BY ALL)"
    " SELECT lang, type, n_texts, n_words, count_level, coalesce(n_unstable, 0) AS n_unstable, CASE WHEN n_texts >= 2 AND coalesce(m, 0) > 0 AND n_unstable >= least(m, greatest(2, ceil(28 * m / 100)))"
    " THEN CASE count_level WHEN 'high' THEN 'medium' ELSE 'low' END ELSE count_level END AS level FROM lv LEFT JOIN sh USING (lang, type)",
)
def o091(spark, d):
    return style.confidence(documents(spark, d))


@add("o086_windows", style_sql.WINDOWS)
def o086(spark, d):
    """Windows of 350 words or more over the conversations' turns."""
    return style.windows(conversations(spark, d)).select("key", "w", "window_words", F.size("paras").alias("n_paras"))


@add("o088_bands", style_sql.BANDS)
def o088(spark, d):
    """Bands by language over documents."""
    return style.bands(documents(spark, d))


@add("o047_slot_key", "SELECT doc_id, coalesce(nullif(lang, 'es'), '_') || '.' || coalesce(nullif(source, 'src0'), '_') AS slot FROM documents")
def o047(spark, d):
    return table(spark, d, "documents").select("doc_id", T.slot(F.nullif("lang", F.lit("es")), F.nullif("source", F.lit("src0"))).alias("slot"))


@add("o034_content_key", "SELECT doc_id, sha256(trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g'))) AS key FROM documents")
def o034(spark, d):
    from .functions.udfs import nfc

    return table(spark, d, "documents").select("doc_id", F.sha2(T.content_text(nfc("text")), 256).alias("key"))


_SUBJECT = "['Re: ', 'FW: re : ', 'Aw: Antw: ', 'Re[2]: ', '', 'Report: '][1 + doc_id % 6] || split_part(text, chr(10), 1)"


@add("o042_thread_subject", f"SELECT doc_id, lower(trim(regexp_replace(regexp_replace({_SUBJECT}, '(?i)^\\s*(?:(?:re|fw|fwd|aw|antw|wg|sv|vs|tr)\\s*(?:\\[\\d+\\])?\\s*:\\s*)+', ''), '\\s+', ' ', 'g'))) AS subject FROM documents")
def o042(spark, d):
    prefixes = F.array(*[F.lit(x) for x in ("Re: ", "FW: re : ", "Aw: Antw: ", "Re[2]: ", "", "Report: ")])
    subject = F.concat(F.get(prefixes, (F.col("doc_id") % 6).cast("int")), F.split_part("text", F.lit("\n"), F.lit(1)))
    return table(spark, d, "documents").select("doc_id", T.thread_subject(subject).alias("subject"))


@add(
    "o044_url_key",
    "WITH b AS (SELECT page_id, regexp_replace(regexp_replace(trim(url), '^[A-Za-z]+://', ''), '#.*$', '') AS u FROM pages)"
    " SELECT page_id, regexp_replace(regexp_replace(lower(split_part(u, '/', 1)), '^www\\.', '') || substr(u, length(split_part(u, '/', 1)) + 1), '/+$', '') AS key FROM b",
)
def o044(spark, d):
    return table(spark, d, "pages").select("page_id", T.url_key(F.col("url")).alias("key"))

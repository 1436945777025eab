"""Registered queries on near-duplicates, overlap, retrieval, outliers and fit, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import packs
from .functions import text as T
from .operators import outliers, ranks, similarity, style
from .plans import oracle as O
from .plans import style_sql
from .sources.tables import documents, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


def _runs(idc: str, rel: str, size: int) -> str:
    """Distinct runs of `size` lower-cased words, by a window over word positions."""
    parts = " || ' ' || ".join(["w"] + [f"lead(w, {k}) OVER v" for k in range(1, size)])
    words = f"SELECT {idc}, lower(unnest(ws)) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT {idc}, {O.words('text')} AS ws FROM {rel})"
    return f"SELECT DISTINCT {idc}, g FROM (SELECT {idc}, {parts} AS g FROM ({words}) WINDOW v AS (PARTITION BY {idc} ORDER BY i)) WHERE g IS NOT NULL"


_SH = f"""sh AS (SELECT doc_id, g AS s FROM ({_runs('doc_id', 'documents', 5)})),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE c / (x.n + y.n - c) >= 0.9),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)"""


@add("o071_near_duplicates", f"WITH RECURSIVE {_SH}, deg AS (SELECT a, count(*) AS n FROM links GROUP BY a) SELECT d.doc_id AS key, coalesce(n, 0) AS n_links, (SELECT min(b) FROM reach WHERE reach.a = d.doc_id) AS component FROM documents d LEFT JOIN deg ON deg.a = d.doc_id")
def o071(spark, d):
    return similarity.near_duplicates(documents(spark, d))


@add("o112_components", f"WITH RECURSIVE {_SH}, c AS (SELECT a, min(b) AS component FROM reach GROUP BY a) SELECT component, count(*) AS n, max(a) AS last FROM c GROUP BY component")
def o112(spark, d):
    return similarity.near_duplicates(documents(spark, d)).groupBy("component").agg(F.count("*").alias("n"), F.max("key").alias("last"))


@add("o072_against_corpus", f"WITH RECURSIVE {_SH} SELECT DISTINCT d.doc_id AS key FROM documents d WHERE d.doc_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM links WHERE a = d.doc_id AND b % 2 = 0)")
def o072(spark, d):
    """Candidates (odd keys) that are near no text of the corpus (even keys)."""
    own = similarity.shingles(documents(spark, d)).withColumn("id", F.xxhash64("sh"))
    own = similarity.checkpointed(own)
    classes = similarity.checkpointed(own.where(F.size("sh") > 0).select("id", "sh").dropDuplicates(["id"]))  # read four times
    pairs = similarity.checkpointed(similarity.similar_sets(classes))
    own = own.select("key", "id", (F.size("sh") > 0).alias("some"))
    near = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).union(own.where("some").select(F.col("id").alias("a"), F.col("id").alias("b")).distinct())
    corpus = own.where("key % 2 = 0").select(F.col("id").alias("b")).distinct()
    taken = near.join(corpus, "b", "left_semi").select(F.col("a").alias("id")).distinct()
    return own.where("key % 2 = 1").join(taken, "id", "left_anti").select("key")


_GRAMS = f"SELECT doc_id AS key, g FROM ({_runs('doc_id', 'documents', 4)})"
_PASSAGES = f"SELECT item_id AS item, g FROM ({_runs('item_id', 'benchmark', 4)})"


@add("o081_brief_overlap", f"WITH a AS ({_GRAMS}), b AS ({_PASSAGES}) SELECT key, item, count(*) AS shared FROM a JOIN b USING (g) GROUP BY key, item")
def o081(spark, d):
    """4-grams that documents share with benchmark passages."""
    return similarity.overlaps(documents(spark, d), table(spark, d, "benchmark").select(F.col("item_id").alias("key"), "text"))


@add("o080_ngrams_not_in_corpus", f"WITH a AS ({_PASSAGES}), b AS ({_GRAMS}) SELECT DISTINCT g FROM a WHERE g NOT IN (SELECT g FROM b)")
def o080(spark, d):
    def exploded(df):
        low = F.transform(T.words(F.col("text")), lambda w: F.lower(w))
        return df.select(F.explode(similarity.grams(low, 4)).alias("g"))

    return exploded(table(spark, d, "benchmark")).distinct().join(exploded(table(spark, d, "documents")), "g", "left_anti")


@add("o126_shingle_sets", f"WITH {_SH.split(',\nsize AS')[0]} SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id")
def o126(spark, d):
    return similarity.shingles(documents(spark, d)).where(F.size("sh") > 0).select(F.col("key").alias("doc_id"), F.size("sh").cast("long").alias("n"))


_STOP = packs.STOPWORDS["en"]
_TOK = "SELECT {id} AS {name}, unnest(list_distinct(list_filter(list_transform({words}, lambda x: lower(x)), lambda x: length(x) > 2 AND NOT list_contains([{stop}], x)))) AS w FROM {rel}"


def _tok(idc: str, name: str, rel: str) -> str:
    return _TOK.format(id=idc, name=name, rel=rel, words=O.words("text"), stop=", ".join(f"'{x}'" for x in _STOP))


@add(
    "o117_top_passages",
    f"WITH docs AS ({_tok('doc_id', 'key', 'documents')}), q AS ({_tok('item_id', 'brief', 'benchmark')}), idf AS (SELECT w, ln(1 + (SELECT count(*) FROM documents) / count(*)) AS idf FROM docs GROUP BY w),"
    " s AS (SELECT brief, key, round(sum(idf), 6) AS score FROM q JOIN idf USING (w) JOIN docs USING (w) GROUP BY brief, key), r AS (SELECT *, row_number() OVER (PARTITION BY brief ORDER BY score DESC, key) AS rank FROM s) SELECT brief, key, rank, score FROM r WHERE rank <= 3",
)
def o117(spark, d):
    return similarity.top_passages(documents(spark, d), table(spark, d, "benchmark").select(F.col("item_id").alias("key"), "text"), _STOP)


_LONG = f"""{O.sums(O.DOCS)}, vals AS (SELECT key, lang, type, {O.value_columns()} FROM sums), long AS ({O.melted('vals', 'key, lang, type')}), {O.metric_table()},
loo AS (SELECT a.key, a.lang, a.type, a.metric, a.value, t.floor, (SELECT median(b.value) FROM long b WHERE b.lang = a.lang AND b.type = a.type AND b.metric = a.metric AND b.key <> a.key) AS ref FROM long a JOIN metric_table t USING (metric)),
gaps AS (SELECT *, abs(ln(greatest(value, floor) / greatest(ref, floor))) AS gap FROM loo WHERE ref IS NOT NULL),
dist AS (SELECT key, lang, type, avg(gap) AS distance FROM gaps GROUP BY ALL),
mid AS (SELECT lang, type, median(distance) AS median, count(*) AS n FROM dist GROUP BY ALL),
lim AS (SELECT m.lang, m.type, m.n, m.median, greatest(m.median + 4 * 1.4826 * (SELECT median(abs(distance - m.median)) FROM dist d WHERE d.lang = m.lang AND d.type = m.type), 1.5 * m.median) AS threshold FROM mid m)"""
_BY = ["lang", "type"]


@add("o113_leave_one_out", f"WITH {_LONG} SELECT key, lang, type, round(distance, 6) AS distance FROM dist")
def o113(spark, d):
    return outliers.distances(documents(spark, d), _BY).select("key", *_BY, F.round("distance", 6).alias("distance"))


@add("o114_thresholds", f"WITH {_LONG} SELECT lang, type, n, round(median, 6) AS median, round(threshold, 6) AS threshold FROM lim")
def o114(spark, d):
    t = outliers.thresholds(outliers.distances(documents(spark, d), _BY), _BY)
    return t.select(*_BY, "n", F.round("median", 6).alias("median"), F.round("threshold", 6).alias("threshold"))


@add("o115_outliers", f"WITH {_LONG} SELECT key, lang, type, round(distance, 3) AS distance, round(threshold, 3) AS threshold, round(median, 3) AS median FROM dist JOIN lim USING (lang, type) WHERE n >= 5 AND distance > threshold")
def o115(spark, d):
    return outliers.outliers(documents(spark, d), _BY)


@add("o115_off_metrics", f"WITH {_LONG}, r AS (SELECT key, lang, type, metric, row_number() OVER (PARTITION BY key ORDER BY round(gap, 9) DESC, metric) AS rank FROM gaps WHERE round(gap, 9) >= ln(1.25)) SELECT * FROM r WHERE rank <= 3")
def o115_off(spark, d):
    return outliers.off_metrics(documents(spark, d), _BY)


_DRAFTS = "SELECT item_id AS key, text, 'en' AS lang, 'src' || (item_id % 20) AS type FROM benchmark"


@add("o116_verify", style_sql.verified(_LONG, _DRAFTS))
def o116(spark, d):
    """Benchmark passages against the slots of English documents."""
    drafts = table(spark, d, "benchmark").select(F.col("item_id").alias("key"), "text", F.lit("en").alias("lang"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("type"))
    return outliers.verify(drafts, documents(spark, d), _BY)


@add("o087_quantiles", f"WITH {O.sums(O.DOCS)}, vals AS (SELECT key, lang, type, {O.value_columns()} FROM sums), long AS ({O.melted('vals', 'lang')}) SELECT lang, metric, round(quantile_cont(value, 0.05), 5) AS q05, round(quantile_cont(value, 0.5), 5) AS q50, round(quantile_cont(value, 0.95), 5) AS q95 FROM long GROUP BY lang, metric")
def o087(spark, d):
    rows = style.melted(style.text_metrics(documents(spark, d)), ["lang"])
    names = {"q05": 0.05, "q50": 0.5, "q95": 0.95}
    return ranks.quantiles(rows, ["lang", "metric"], "value", names).select("lang", "metric", *[F.round(n, 5).alias(n) for n in names])


@add(
    "o107_drift",
    f"WITH {O.sums(O.DOCS)}, g AS (SELECT lang, {', '.join(f'sum({s}) AS {s}' for s in O.SUMS)} FROM sums GROUP BY lang), gv AS (SELECT lang, {O.value_columns()} FROM g), slot AS ({O.melted('gv', 'lang')}), vals AS (SELECT key, lang, {O.value_columns()} FROM sums), long AS ({O.melted('vals', 'key, lang')}), {O.metric_table()}"
    " SELECT l.key, round(avg(abs(ln(greatest(l.value, floor) / greatest(s.value, floor)))), 6) AS drift, count(*) FILTER (greatest(l.value, floor) / greatest(s.value, floor) > overshoot OR greatest(l.value, floor) / greatest(s.value, floor) < shortfall) AS outside FROM long l JOIN slot s USING (lang, metric) JOIN metric_table t USING (metric) GROUP BY l.key",
)
def o107(spark, d):
    """Mean absolute log ratio of every text to its language's slot, and how many metrics lie outside the band."""
    docs = style.summed_once(documents(spark, d))
    slot = style.melted(style.slot_metrics(docs, ("lang",)), ["lang"]).withColumnRenamed("value", "slot")
    rows = style.melted(style.text_metrics(docs), ["key", "lang"]).join(slot, ["lang", "metric"]).join(style.metric_table(spark), "metric")
    r = F.greatest("value", "floor") / F.greatest("slot", "floor")
    return rows.groupBy("key").agg(F.round(F.avg(F.abs(F.log(r))), 6).alias("drift"), F.sum(((r > F.col("overshoot")) | (r < F.col("shortfall"))).cast("long")).alias("outside"))


@add(
    "o106_eta_squared",
    f"WITH {O.sums(O.DOCS)}, vals AS (SELECT lang, {O.value_columns()} FROM sums), long AS ({O.melted('vals', 'lang')}), g AS (SELECT metric, lang, count(*) AS n, avg(value) AS m FROM long GROUP BY ALL), t AS (SELECT metric, avg(value) AS gm, var_pop(value) * count(*) AS ss FROM long GROUP BY metric)"
    " SELECT metric, round(sum(n * (m - gm) * (m - gm)) / any_value(ss), 5) AS eta2 FROM g JOIN t USING (metric) WHERE ss > 0 GROUP BY metric",
)
def o106(spark, d):
    """Share of a metric's variance that lies between languages."""
    rows = style.melted(style.text_metrics(documents(spark, d)), ["lang"])
    g = rows.groupBy("metric", "lang").agg(F.count("*").alias("n"), F.avg("value").alias("m"))
    t = rows.groupBy("metric").agg(F.avg("value").alias("gm"), (F.var_pop("value") * F.count("*")).alias("ss")).where("ss > 0")
    return g.join(t, "metric").groupBy("metric").agg(F.round(F.sum(F.col("n") * (F.col("m") - F.col("gm")) * (F.col("m") - F.col("gm"))) / F.first("ss"), 5).alias("eta2"))


@add(
    "o118_blended_targets",
    f"WITH {O.sums(O.DOCS)}, g AS (SELECT lang, {', '.join(f'sum({s}) AS {s}' for s in O.SUMS)} FROM sums GROUP BY lang), gv AS (SELECT lang, {O.value_columns()} FROM g), slot AS ({O.melted('gv', 'lang')}), vals AS (SELECT key, lang, n_words AS words, {O.value_columns()} FROM sums), long AS ({O.melted('vals', 'key, lang, words')})"
    " SELECT l.key, l.metric, round(l.words / (l.words + 300.0) * l.value + (1 - l.words / (l.words + 300.0)) * s.value, 3) AS target FROM long l JOIN slot s USING (lang, metric)",
)
def o118(spark, d):
    """Every text as the example passage of its slot: targets lean to it by words / (words + 300)."""
    docs = style.summed_once(documents(spark, d))
    slot = style.melted(style.slot_metrics(docs, ("lang",)), ["lang"]).withColumnRenamed("value", "slot")
    own = style.sums(docs).select("key", "lang", F.col("n_words").alias("words"), *style.values().values())
    rows = style.melted(own, ["key", "lang", "words"]).join(slot, ["lang", "metric"])
    w = F.col("words") / (F.col("words") + 300.0)
    return rows.select("key", "metric", F.round(w * F.col("value") + (1 - w) * F.col("slot"), 3).alias("target"))


_TONES = ", ".join(f"('{t}', '{m}', {v}, {i})" for i, (t, p) in enumerate(packs.TONES.items()) for m, v in p.items())


@add(
    "o119_tone_targets",
    f"WITH {O.sums(O.DOCS)}, g AS (SELECT lang, {', '.join(f'sum({s}) AS {s}' for s in O.SUMS)} FROM sums GROUP BY lang), gv AS (SELECT lang, {O.value_columns()} FROM g), slot AS ({O.melted('gv', 'lang')}), vals AS (SELECT key, lang, {O.value_columns()} FROM sums), long AS ({O.melted('vals', 'lang')}),"
    " q AS (SELECT lang, metric, quantile_cont(value, 0.25) AS lo, quantile_cont(value, 0.75) AS hi FROM long GROUP BY ALL),"
    f" tones AS (SELECT * FROM (VALUES {_TONES}) t(tone, metric, up, place)) SELECT tone, lang, metric, round(CASE WHEN up > 0 THEN greatest(value, hi) ELSE least(value, lo) END, 5) AS target FROM tones JOIN slot USING (metric) JOIN q USING (lang, metric)",
)
def o119(spark, d):
    """For each tone and language the targets it moves: to the writer's own quartile where that lies further."""
    docs = style.summed_once(documents(spark, d))
    slot = style.melted(style.slot_metrics(docs, ("lang",)), ["lang"])
    q = ranks.quantiles(style.melted(style.text_metrics(docs), ["lang"]), ["lang", "metric"], "value", {"lo": 0.25, "hi": 0.75})
    tones = F.broadcast(spark.createDataFrame([(t, m, v) for t, p in packs.TONES.items() for m, v in p.items()], "tone string, metric string, up int"))
    target = F.when(F.col("up") > 0, F.greatest("value", "hi")).otherwise(F.least("value", "lo"))
    return slot.join(q, ["lang", "metric"]).join(tones, "metric").select("tone", "lang", "metric", F.round(target, 5).alias("target"))


@add(
    "o138_metric_flags",
    f"WITH {O.sums(O.DOCS)}, g AS (SELECT lang, {', '.join(f'sum({s}) AS {s}' for s in O.SUMS)} FROM sums GROUP BY lang), gv AS (SELECT lang, {O.value_columns()} FROM g), slot AS ({O.melted('gv', 'lang')}), vals AS (SELECT key, lang, {O.value_columns()} FROM sums), long AS ({O.melted('vals', 'key, lang')}), {O.metric_table()}"
    " SELECT l.key, l.metric, CASE WHEN s.value < floor THEN CASE WHEN l.value - s.value > 2 * floor THEN 'overshoot' ELSE 'ok' END WHEN l.value / s.value > overshoot THEN 'overshoot' WHEN NOT sparse AND shortfall > 0.05 AND l.value / s.value < shortfall THEN 'shortfall' ELSE 'ok' END AS flag FROM long l JOIN slot s USING (lang, metric) JOIN metric_table t USING (metric)",
)
def o138(spark, d):
    from .operators.check import metric_flags

    docs = style.summed_once(documents(spark, d))
    return metric_flags(docs, style.slot_metrics(docs, ("lang",)), ["lang"]).select("key", "metric", "flag")


@add(
    "o149_check_status",
    f"WITH f AS ({ORACLE_SQL['o138_metric_flags']}), n AS (SELECT key, count(*) AS m, count(*) FILTER (flag <> 'ok') AS flagged FROM f GROUP BY key) SELECT key, flagged, CASE WHEN flagged >= least(m, greatest(2, ceil(28 * m / 100))) THEN 'fail' ELSE 'pass' END AS status FROM n",
)
def o149(spark, d):
    from .operators.check import metric_flags, status

    docs = style.summed_once(documents(spark, d))
    return status(metric_flags(docs, style.slot_metrics(docs, ("lang",)), ["lang"]))

"""Registered queries of decisions, changes, matching and resampling over the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import decisions as D
from .operators import evaluation as E
from .operators import ledger as L
from .operators import leaveout, matching, style, trial
from .plans.lifecycle_sql import SQL
from .plans.trial_sql import METRICS
from .sources import ledger as S
from .sources.tables import documents, table

QUERIES: dict = {}
ORACLE_SQL = SQL | {"o169_trial_metrics": METRICS}


def add(name: str):
    def keep(f):
        QUERIES[name] = f
        return f

    return keep


def labelled(s, d) -> DataFrame:
    """Documents with what is known of them (quality and toxic are null where nothing is)."""
    return table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left")


@add("o108_cluster_bootstrap")
def o108_bootstrap(s, d):
    """Good labels as wins; a source's documents are drawn together."""
    rows = labelled(s, d).where("quality is not null").select("source", F.col("quality").cast("double").alias("win"))
    return E.cluster_interval(rows, "source", "win", 1000)


@add("o108_pooled_runs")
def o108_pooled(s, d):
    """Each source is a run; copies of a text count in the first run that has it, toxic texts stand for recognised ones."""
    rows = labelled(s, d).where("quality is not null").select(
        F.col("source").alias("run"), F.col("doc_id").alias("id"), "text", F.col("lang").alias("group"), (F.col("toxic") == 1).alias("recognised"),
        (F.col("quality") == 1).alias("good"), ((F.col("quality") == 1) & (F.col("n_chars") > 800)).alias("long"),
    )
    runs = rows.groupBy("run", "group").agg((F.avg(F.col("good").cast("double")) >= 0.5).alias("passed"))
    return E.pooled(rows, runs, ["good", "long"])


def proposal(s, d) -> tuple[DataFrame, ...]:
    """A proposal over all documents: texts, slots, pooled slots, lessons, examples and profile records, with what ties them.

    Toxic texts are rejected, good ones approved; copies of a text stand and fall together; a slot is rejected where more
    than an eighth of its labelled texts are toxic; a pooled slot follows the English one of its source.
    """
    docs = labelled(s, d).select(
        F.col("doc_id").cast("string").alias("ref"), "lang", "source", "quality", "toxic", F.md5(F.coalesce("text", F.lit(""))).alias("digest"),
        F.concat(F.lit("s:"), "lang", F.lit("."), "source").alias("slot"), F.concat(F.lit("l:"), "source", F.lit("."), F.floor(F.col("n_chars") / 300).cast("string")).alias("lesson"),
    )
    none = F.lit(None).cast("string")
    decided = F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "approved").otherwise("pending")
    texts = docs.select(F.concat(F.lit("t:"), "ref").alias("id"), decided.alias("decision"), "ref", F.col("digest").alias("proposal"))
    share = F.sum("toxic") * 8 > F.count("toxic")
    slots = docs.groupBy("slot").agg(F.when(share, "rejected").otherwise("approved").alias("decision")).select(F.col("slot").alias("id"), "decision", none.alias("ref"), none.alias("proposal"))

    def pending(ids: DataFrame, column: str) -> DataFrame:
        return ids.select(F.col(column).alias("id")).distinct().select("id", F.lit("pending").alias("decision"), none.alias("ref"), none.alias("proposal"))

    good = docs.where("quality = 1").select(F.concat(F.lit("e:"), "ref").alias("id"), "ref", "lesson")
    pools = docs.select(F.concat(F.lit("p:"), "source").alias("id"), F.concat(F.lit("s:en."), "source").alias("up")).distinct()
    records = docs.select(F.concat(F.lit("r:"), "source").alias("id"), F.col("lang").alias("record"), F.col("slot").alias("on")).distinct()
    items = texts.union(slots).union(pending(docs, "lesson")).union(pending(good, "id")).union(pending(pools, "id")).union(pending(records, "id"))
    first = docs.groupBy("lesson").agg(F.min("slot").alias("on")).select(F.col("lesson").alias("id"), "on")
    requires = first.union(good.select("id", F.col("lesson").alias("on")))
    return items, requires, pools, good.select("id", "ref"), docs.select(F.col("lesson").alias("id"), "ref"), records


@add("o155_effective_decisions")
def o155_effective(s, d):
    return D.effective(*proposal(s, d))


@add("o159_composed_changes")
def o159_composed(s, d):
    """Texts with toxic labels are forgotten, then those of other writers removed: one change from the first state to the last."""
    m = S.manifest(s, d).select("key", "path", "status", "ownership")
    toxic = table(s, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("key"))
    forget = D.marked(m, toxic, {"status": F.lit("forgotten")})
    after = D.applied(m, forget)
    remove = D.removed(after, after.where("ownership = 'other'"))
    return D.composed(forget, remove).select("key", F.col("before.status").alias("was"), F.col("after.status").alias("now"))


@add("o159_rolled_back")
def o159_rolled_back(s, d):
    """The same change and its inverse: what stands in the end, and whether it is what stood in the beginning."""
    m = S.manifest(s, d).select("key", "path", "status", "ownership")
    change = D.changes(m, D.applied(m, D.marked(m, m.where("ownership = 'undecided'"), {"status": F.lit("held"), "ownership": F.lit("own")})))
    back = D.applied(D.applied(m, change), D.inverse(change))
    other = back.join(m.select("key", F.struct("path", "status", "ownership").alias("old")), "key", "full_outer")
    return other.select("key", "status", F.struct("path", "status", "ownership").eqNullSafe(F.col("old")).alias("same"))


@add("o153_merged_patches")
def o153_merged(s, d):
    """Records of all documents, patched from their labels; a toxic text of poor quality gets patches that contradict each other."""
    x = labelled(s, d).select(F.col("doc_id").alias("key"), "lang", "source", "quality", "toxic", "n_chars")
    records = x.select("key", F.lit("active").alias("status"), F.create_map("source", F.lit("own")).alias("profiles"), F.create_map(F.lit("type"), F.col("source")).alias("facets"))

    def patch(rows: DataFrame, op: str, field=None, name=None, value=None) -> DataFrame:
        return rows.select("key", F.lit(op).alias("op"), F.lit(field).cast("string").alias("field"), (name if name is not None else F.lit(None).cast("string")).alias("name"), (value if value is not None else F.lit(None).cast("string")).alias("value"))

    mine = F.when(F.col("quality") == 1, "own").otherwise("other")
    parts = [
        patch(x.where("quality is not null"), "set", "profiles", F.col("lang"), mine), patch(x.where("toxic = 1"), "force", "facets", F.lit("type"), F.lit("flagged")),
        patch(x.where("quality = 0"), "remove", "facets", F.lit("type")), patch(x.where("n_chars > 4000"), "replace", "profiles"), patch(x.where("toxic = 1"), "status", value=F.lit("held")),
    ]
    patches = parts[0]
    for p in parts[1:]:
        patches = patches.union(p)
    said = lambda c: F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return D.merged(records, patches).select("key", "status", said("profiles").alias("profiles"), said("facets").alias("facets"), F.array_join("conflicts", ";").alias("conflicts"))


@add("o137_language_segments")
def o137(s, d):
    """Turns of conversations as blocks; the role stands for the language."""
    return L.segments(S.turns(s, d).select(F.col("conv_id").alias("key"), F.col("turn").alias("pos"), F.col("role").alias("lang"), "words"))


@add("o179_matched_drafts")
def o179(s, d):
    """The benchmark's passages as kept drafts of one writer, and all documents as texts published a day after each other."""
    start = F.lit("2024-01-01").cast("timestamp")
    drafts = table(s, d, "benchmark").select(F.lit("w").alias("profile"), F.col("item_id").alias("id"), start.alias("ts"), "text")
    texts = table(s, d, "documents").select(F.lit("w").alias("profile"), F.col("doc_id").alias("id"), (start + F.make_dt_interval(hours=F.pmod(F.col("doc_id"), F.lit(2400)).cast("int"))).alias("ts"), "text")
    return matching.matched(drafts, texts)


@add("o169_trial_metrics")
def o169(s, d):
    return trial.metrics(documents(s, d))


@add("o171_left_out_flags")
def o171(s, d):
    """Each document against the other documents of its language and source: how many metrics are off."""
    docs = style.summed_once(documents(s, d))
    return leaveout.counted(leaveout.flags(docs.withColumn("unit", F.lit(0)), docs, ["lang", "type"]), ["lang", "type"]).select("key", "flagged")


@add("o223_simulated_check")
def o223(s, d):
    """What a check that fails from 2 to 8 flags would find among texts that are each left out of their slot."""
    docs = style.summed_once(documents(s, d))
    counts = leaveout.counted(leaveout.flags(docs.withColumn("unit", F.lit(0)), docs, ["lang", "type"]), ["lang", "type"])
    return leaveout.simulated(counts, ["lang"])


@add("o157_rederived_fingerprints")
def o157(s, d):
    """Fingerprints of all slots, and those that change when texts of poor quality leave, from the sums of these texts alone."""
    by = ["lang", "type"]
    docs = documents(s, d)
    poor = docs.join(table(s, d, "labels").where("quality = 0").select(F.col("doc_id").alias("key")).distinct(), "key", "left_semi")
    every = style.summed_once(docs)
    return leaveout.rederived(leaveout.state(every, by), leaveout.histogram(every, by), poor, docs.limit(0), by)


@add("o135_rebuilt_lessons")
def o135(s, d):
    """Event types as kinds of edits and users as pairs, by a slot of ten: lessons of the first half of the table, rebuilt from all
    but the lowest values; what says error has been rejected."""
    e = table(s, d, "events").select((F.col("user_id") % 10).cast("string").alias("slot"), F.col("user_id").alias("pair"), F.col("event_id").alias("change"), F.col("event_type").alias("kind"), "value")
    half = e.agg(F.max("change")).first()[0] / 2
    none = lambda schema: s.createDataFrame([], schema)
    described = e.select("slot", "kind", F.concat(F.lit("Less of "), "kind", F.lit(".")).alias("text")).distinct()
    rejected = described.where("kind = 'error' and slot < '5'").select("slot", F.upper("text").alias("text"))
    first = D.rebuilt_lessons(e.where((F.col("change") < half) & (F.col("value") < 20)), none("slot string, id long, kind string, text string, pairs array<long>"), described, rejected).where("op = 'add'")
    got = D.rebuilt_lessons(e.where("value > 5"), first.drop("seen_once", "op"), described, rejected)
    return got.select("slot", "id", "kind", F.size("pairs").cast("long").alias("pairs"), F.md5(F.array_join(F.col("pairs").cast("array<string>"), ",")).alias("digest"), "seen_once", "op")


@add("o217_recognition")
def o217(s, d):
    """A forced choice for each passage of the benchmark between its author, by turns a source or nobody, and four other sources."""
    b = table(s, d, "benchmark").select(F.col("item_id").alias("key"), F.when(F.col("item_id") % 3 > 0, F.concat(F.lit("src"), F.col("item_id") % 20)).alias("author"))
    pool = table(s, d, "documents").select(F.col("source").alias("author")).distinct()
    return E.recognition(b, pool, 5).select("ask", "key", "truth", F.array_join("candidates", ",").alias("candidates"))


@add("o217_judged_twice")
def o217_twice(s, d):
    """Twenty English documents drawn to be judged blind and once more with the author told."""
    return E.judged_twice(documents(s, d).select("key", F.col("lang").alias("group")), "en", 20)

"""The ledger of texts: DataFrame operators over tables that a caller brings.

manifest   key, path, folder, lang, type, words, status, ownership, holdout, cached, year: one row for each known text
found      key, path, words, lang, type, year: what a scan of the sources has met
rules      rule_path, profile, ownership: who wrote what lies at or under a path; "." is everything
profiles   profile, parent, consent: writers and whom they inherit from

Rules and paths meet by the ancestors of a path, an equi-join, so no table is compared row by row. Groups that may
hold any part of a table are aggregated or numbered by `ranks`; plain windows only cut the first few rows of a
group, which Spark does before it shuffles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import packs
from ..functions import text as T
from ..sources.formats import glob_pattern
from . import ranks
from .similarity import checkpointed, near_duplicates, plain_ids

MIN_WORDS, BATCH, LIVE = 150, 50, ("active", "unreachable")


def live() -> Column:
    return F.col("status").isin(*LIVE)


def own_texts(manifest: DataFrame) -> DataFrame:
    """Texts that a profile learns from: its own, live, not held out, and in the cache."""
    return manifest.where((F.col("ownership") == "own") & live() & ~F.col("holdout") & F.col("cached"))


def top(rows: DataFrame, by: list[str], order: list, n: int, name: str = "rn") -> DataFrame:
    """The first n rows of each group, with their place."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn(name, F.row_number().over(w).cast("long")).where(F.col(name) <= n)


# --- sources and sinks


def corpus_texts(manifest: DataFrame, texts: DataFrame) -> DataFrame:
    """Cached texts of the ledger that are not forgotten, with their text's columns."""
    return manifest.where(F.col("cached") & (F.col("status") != "forgotten")).select("key", "status").join(texts, "key")


def pushed(found: DataFrame, manifest: DataFrame, origin: str, least: int = MIN_WORDS) -> DataFrame:
    """What a connector or an interview brings: key, path, words, origin, result (added, or why it is refused)."""
    known = manifest.select("key", F.lit(True).alias("known")).distinct()
    result = F.when(F.col("known"), "refused: known").when(F.col("words") < least, "refused: too short").otherwise("added")
    return found.join(known, "key", "left").select("key", "path", "words", F.lit(origin).alias("origin"), result.alias("result"))


def bridge_plan(files: DataFrame, seen: DataFrame, size: int = BATCH) -> DataFrame:
    """path and batch (from 0) of the files that have not been seen with the same size and time of change."""
    todo = files.join(seen, ["path", "size", "mtime"], "left_anti").select("path")
    return ranks.numbered(todo, [], ["path"]).select("path", F.floor((F.col("n") - 1) / size).alias("batch"))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """path and action (write, delete, keep) between two snapshots (path, digest)."""
    a, b = before.select("path", F.col("digest").alias("was")), after.select("path", F.col("digest").alias("now"))
    action = F.when(F.col("now").isNull(), "delete").when(F.col("was").eqNullSafe(F.col("now")), "keep").otherwise("write")
    return a.join(b, "path", "full").select("path", action.alias("action"))


def compared(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """path and outcome (equal, differs, missing, extra) of two inventories (path, key); an expected null key is any key."""
    a, b = expected.select("path", F.col("key").alias("want"), F.lit(1).alias("a")), actual.select("path", F.col("key").alias("got"), F.lit(1).alias("b"))
    same = F.col("want").isNull() | F.col("want").eqNullSafe(F.col("got"))
    outcome = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(same, "equal").otherwise("differs")
    return a.join(b, "path", "full").select("path", outcome.alias("outcome"))


# --- facets, dates, predicates


def first_set(*values: Column) -> Column:
    """The first value that is neither null nor empty: command, entry, rule, front matter, detected, default."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def document_date(stated: Column, changed: Column) -> Column:
    """The day that a text states (an ISO date comes first in it), else that of its last change."""
    return F.coalesce(F.try_to_date(F.substring(stated, 1, 10), "yyyy-MM-dd"), changed.cast("date")).cast("string")


def ancestors(path: Column) -> Column:
    """".", then every folder above a path, and the path itself."""
    parts = F.split(path, "/")
    return F.concat(F.array(F.lit(".")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))


def rule_hits(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Files with the rules that lie over them, and the rule's depth."""
    return files.select("*", F.posexplode(ancestors(F.col("path"))).alias("depth", "rule_path")).join(rules, "rule_path")


def matches_any(path: Column, globs: list[str]) -> Column:
    """A glob without a slash matches the name alone."""
    return reduce(lambda a, b: a | b, [path.rlike(glob_pattern(g if "/" in g else f"**/{g}")) for g in globs], F.lit(False))


def in_scope(path: Column, lang: Column, folders: list[str] = (), flat: list[str] = (), langs: list[str] = ()) -> Column:
    """Under a registered folder, right in one that is not recursive, or of a language."""
    under = reduce(lambda a, b: a | b, [path.startswith(f + "/") for f in folders], F.lit(False))
    return under | F.regexp_extract(path, "^(.*)/[^/]*$", 1).isin(*flat) | lang.isin(*langs)


def rulings_in_slot(slots: DataFrame, rulings: DataFrame) -> DataFrame:
    """slot and id: rulings of any slot or this one, in any language or this one."""
    r = rulings.select("id", F.col("slot").alias("r_slot"), F.col("lang").alias("r_lang"))
    for_all = r.where("r_slot is null and r_lang is null")
    by_slot = slots.join(r.where("r_slot is not null"), (F.col("slot") == F.col("r_slot")) & F.coalesce(F.col("r_lang") == F.col("lang"), F.lit(True)))
    by_lang = slots.join(r.where("r_slot is null and r_lang is not null"), F.col("lang") == F.col("r_lang"))
    every = slots.withColumn("one", F.lit(1)).join(for_all.withColumn("one", F.lit(1)), "one")
    return every.select("slot", "id").union(by_slot.select("slot", "id")).union(by_lang.select("slot", "id"))


def applicable(langs: DataFrame, needs: dict[str, tuple]) -> DataFrame:
    """metric, lang, applies: a metric that counts a list applies where the language's pack has that list."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col("lang").isin(*have).alias("applies")) for m, have in needs.items()])
    return langs.select("lang", F.explode(rows).alias("x")).select("x.metric", "lang", "x.applies")


def sign_states(signs: DataFrame, held: DataFrame, allowed: DataFrame, declined: DataFrame) -> DataFrame:
    """id and state of signs: deferred to a starter rule that is held, allowed to the writer, or applied."""
    rows = signs.join(held.select("starter", F.lit(True).alias("held")), "starter", "left").join(allowed.select("id", F.lit(True).alias("ok")), "id", "left").join(declined.select("starter", F.lit(True).alias("no")), "starter", "left")
    may = (F.col("tier") == "unless_writer") & (F.col("ok").isNotNull() | F.col("no").isNotNull())
    return rows.select("id", F.when(F.col("held"), "deferred").when(may, "allowed").otherwise("applies").alias("state"))


def mirrors(texts: DataFrame, pool: list[str], exact: list[str]) -> DataFrame:
    """pool columns and mirrors: how many of its exact slots hold just the texts of the pooled slot, by count and sums of hashes."""
    h = F.xxhash64("key").cast("decimal(38,0)")
    sums = [F.count("*").alias("n"), F.sum(h).alias("h"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("x")]
    same = [*pool, "n", "h", "x"]
    hit = texts.groupBy(*exact).agg(*sums).groupBy(*same).agg(F.count("*").alias("m"))
    return texts.groupBy(*pool).agg(*sums).join(hit, same, "left").select(*pool, F.coalesce("m", F.lit(0)).alias("mirrors"))


# --- joins with the manifest


def classified(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """key, path and result of what a scan has met: unknown, forgotten, holdout, reverted, unchanged or renamed."""
    m = manifest.select("key", F.col("path").alias("was"), "status", "holdout")
    result = (
        F.when(F.col("was").isNull(), "unknown").when(F.col("status") == "forgotten", "forgotten").when(F.col("holdout"), "holdout")
        .when(F.col("status") == "superseded", "reverted").when(F.col("was") == F.col("path"), "unchanged").otherwise("renamed")
    )
    return found.join(m, "key", "left").select(*found.columns, result.alias("result"))


def changed_paths(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """key, path, supersedes: other live texts that the ledger has at the same path, in any case."""
    m = manifest.where(live()).select(F.col("key").alias("supersedes"), F.lower("path").alias("p"))
    return found.withColumn("p", F.lower("path")).join(m, "p").where("key <> supersedes").select("key", "path", "supersedes")


def decided(files: DataFrame, rules: DataFrame) -> DataFrame:
    """key, profile, ownership, asks: the deepest rule of each profile; rules of one depth that disagree ask."""
    at = rule_hits(files, rules).groupBy("key", "profile", "depth").agg(F.min("ownership").alias("ownership"), F.count_distinct("ownership").alias("n"))
    best = at.groupBy("key", "profile").agg(F.max(F.struct("depth", "ownership", "n")).alias("b"))
    return best.select("key", "profile", F.col("b.ownership").alias("ownership"), (F.col("b.n") > 1).alias("asks"))


def ownership_decisions(manifest: DataFrame, rules: DataFrame) -> DataFrame:
    """key, profile, decision: what was decided stays, else what the rules say, else a question."""
    rows = manifest.select("key", F.col("ownership").alias("was")).join(decided(manifest.select("key", "path"), rules), "key")
    return rows.select("key", "profile", F.when(F.col("was") != "undecided", F.col("was")).when(~F.col("asks"), F.col("ownership")).otherwise("question").alias("decision"))


def unreachable(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Active texts of which neither the key nor the path was met."""
    gone = manifest.where("status = 'active'").join(found.select("key"), "key", "left_anti")
    return gone.join(found.select("path"), "path", "left_anti").select("key", "path")


def inventory(found: DataFrame, manifest: DataFrame, texts: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """key, path, words, lang, type, result: every file with what becomes of it; of new near-duplicates the newest stays."""
    old = changed_paths(found, manifest).select("key", F.lit(True).alias("old")).distinct()
    rows = classified(found, manifest).join(old, "key", "left")
    fresh = F.when(F.col("words") < least, "skipped: too short").when(F.col("old"), "changed").otherwise("new")
    known = F.when(F.col("result") == "unknown", fresh).otherwise(F.col("result"))
    rated = checkpointed(rows.withColumn("result", F.when(F.col("lang").isin(*packs.UNSUPPORTED), "skipped: language not supported").otherwise(known)).drop("old"))
    new = rated.where("result = 'new'").select("key", "path", "year")
    kept = newest_in_group(new, texts.join(new.select("key"), "key", "left_semi")).where("result = 'kept'").select("key", F.lit(True).alias("kept"))
    result = F.when((F.col("result") == "new") & F.col("kept").isNull(), "skipped: near-duplicate").otherwise(F.col("result"))
    return rated.join(kept, "key", "left").select("key", "path", "words", "lang", "type", result.alias("result"))


def newest_in_group(files: DataFrame, texts: DataFrame) -> DataFrame:
    """key and result: of each component of near-duplicate texts the newest is kept; on a tie the first path."""
    rows = files.join(near_duplicates(texts).select("key", "component"), "key")
    best = rows.groupBy("component").agg(F.min(F.struct((-F.col("year")).alias("y"), "path", "key")).alias("b")).select("b.key", F.lit(True).alias("best"))
    return rows.join(best, "key", "left").select("key", F.when(F.col("best"), "kept").otherwise("skipped: near-duplicate").alias("result"))


# --- inheritance


def chain(profiles: DataFrame) -> DataFrame:
    """start, profile, consent, depth: every profile with those it inherits from; a cycle ends where it closes."""
    p = checkpointed(profiles.select("profile", "parent", "consent"))
    now = p.select(F.col("profile").alias("start"), "profile", "parent", "consent", F.lit(0).alias("depth"), F.array("profile").alias("seen"))
    out = now
    while True:
        up = p.select(F.col("profile").alias("p"), F.col("parent").alias("pp"), F.col("consent").alias("pc"))
        nxt = now.join(up, F.col("parent") == F.col("p")).where(~F.array_contains("seen", F.col("p")))
        now = checkpointed(nxt.select("start", F.col("p").alias("profile"), F.col("pp").alias("parent"), F.col("pc").alias("consent"), (F.col("depth") + 1).alias("depth"), F.concat("seen", F.array("p")).alias("seen")))
        if now.isEmpty():
            return out.select("start", "profile", "consent", "depth")
        out = out.union(now)


def nearest(links: DataFrame, have: DataFrame, value: str) -> DataFrame:
    """start and value: what the nearest profile of the chain has (ties by value)."""
    rows = links.join(have, "profile").groupBy("start").agg(F.min(F.struct("depth", value)).alias("b"))
    return rows.select("start", F.col(f"b.{value}").alias(value))


def resolved_slot(links: DataFrame, slots: DataFrame, asked: DataFrame) -> DataFrame:
    """start, profile, slot: the first slot that exists, by depth in the chain, then by generality of what is asked."""
    rows = links.join(asked, "start").join(slots, ["profile", "slot"])
    best = rows.groupBy("start").agg(F.min(F.struct("depth", "general", "profile", "slot")).alias("b"))
    return best.select("start", "b.profile", "b.slot")


def merged(links: DataFrame, entries: DataFrame) -> DataFrame:
    """start, id, text: entries of the chain without those that a nearer one overrides by id or repeats by text."""
    rows = links.join(entries, "profile")
    gone = rows.where("overrides is not null").select("start", F.col("overrides").alias("id")).distinct()
    kept = rows.join(gone, ["start", "id"], "left_anti").groupBy("start", F.lower("text").alias("t")).agg(F.min(F.struct("depth", "id", "text")).alias("b"))
    return kept.select("start", "b.id", "b.text")


def inherited(links: DataFrame) -> DataFrame:
    """start, inherited_from: ancestors that did not consent for themselves."""
    return links.where("depth > 0 and consent <> 'self'").select("start", F.col("profile").alias("inherited_from"))


# --- rejections, evidence, quotes


def lesson_key(lesson: Column, stop: tuple = packs.STOPWORDS["en"]) -> Column:
    """A lesson without signs and stop words."""
    words = F.split(F.trim(F.regexp_replace(F.lower(lesson), r"[^\p{L}\p{N}_]+", " ")), " ")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*stop)), " ")


def not_rejected(lessons: DataFrame, rejected: DataFrame) -> DataFrame:
    """Lessons (id, lesson) whose words, but for stop words, were not rejected before."""
    no = rejected.select(lesson_key(F.col("lesson")).alias("k")).distinct()
    return lessons.withColumn("k", lesson_key(F.col("lesson"))).join(no, "k", "left_anti").drop("k")


def _loose(text: Column) -> Column:
    return F.lower(F.trim(T.squeeze(text)))


def quotes_found(texts: DataFrame, quotes: DataFrame) -> DataFrame:
    """key, item: texts that hold a quote (item, quote) as it stands, but for case and white space.

    Candidates share the quote's longest word (ties by order), which must be free of signs at its ends; a quote
    without a word of letters is compared by its first word.
    """
    words = lambda c: F.filter(F.split(F.regexp_replace(_loose(c), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    asked = quotes.select("item", _loose(F.col("quote")).alias("q"), words(F.col("quote")).alias("ws"))
    # the first and last word of a quote may be cut in the middle of a word of the text, so inner words count where there are any
    inner = F.when(F.size("ws") > 2, F.slice("ws", F.lit(2), F.size("ws") - 2)).otherwise(F.array().cast("array<string>"))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    asked = asked.select("item", "q", longest.alias("w")).where("q <> ''")
    said = texts.select("key", "text", F.explode(F.array_distinct(words(F.col("text")))).alias("w"))
    some = said.join(asked.where("w is not null"), "w").where(F.contains(_loose(F.col("text")), F.col("q"))).select("key", "item")
    short = asked.where("w is null").agg(F.collect_list(F.struct("item", "q")).alias("qs"))  # quotes of one or two words
    rest = texts.join(F.broadcast(short.where(F.size("qs") > 0))).select("key", F.explode(F.filter("qs", lambda x: F.contains(_loose(F.col("text")), x["q"]))).alias("x"))
    return some.union(rest.select("key", "x.item"))


def guide_rules(guides: DataFrame, rules: DataFrame) -> DataFrame:
    """item, found_in: in how many guides a rule's quote stands; 0 refuses the import."""
    n = quotes_found(guides, rules.select("item", "quote")).groupBy("item").agg(F.count("*").alias("n"))
    return rules.select("item").join(n, "item", "left").select("item", F.coalesce("n", F.lit(0)).alias("found_in"))


def evidence(hits: DataFrame, texts: DataFrame, by: list[str]) -> DataFrame:
    """by, seen, of_texts, is_default: texts with a hit among those of the group; half of them and two make a default."""
    of = texts.groupBy(*by).agg(F.count_distinct("key").alias("of_texts"))
    seen = hits.groupBy(*by).agg(F.count_distinct("key").alias("seen"))
    rows = of.join(seen, by, "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    return rows.select(*by, "seen", "of_texts", ((F.col("seen") >= 2) & (2 * F.col("seen") >= F.col("of_texts"))).alias("is_default"))


def pruned(lessons: DataFrame, rejected: DataFrame) -> DataFrame:
    """lesson, seen_in, quote_from: lessons without the texts that were rejected; those with none left go."""
    return lessons.join(rejected.select("key"), "key", "left_anti").groupBy("lesson").agg(F.count_distinct("key").alias("seen_in"), F.min("key").alias("quote_from"))


def cascaded(examples: DataFrame, lost: DataFrame) -> DataFrame:
    """Examples (id, source, quote): those of a lost text lose source and quote, the others stay."""
    rows = examples.join(lost.select(F.col("key").alias("source"), F.lit(True).alias("lost")), "source", "left")
    return rows.select("id", *[F.when(F.col("lost").isNull(), F.col(c)).alias(c) for c in ("source", "quote")])


def edit_lessons(changes: DataFrame) -> DataFrame:
    """kind, pairs, seen_once: edit kinds with the pairs they occur in."""
    return changes.groupBy("kind").agg(F.count_distinct("pair").alias("pairs")).select("kind", "pairs", (F.col("pairs") < 2).alias("seen_once"))


def language_majority(texts: DataFrame, by: str) -> DataFrame:
    """by, lang, words: the language with the most words; the one seen first on a tie."""
    g = texts.groupBy(by, "lang").agg(F.sum("words").alias("words"), F.min("key").alias("seen"))
    return g.groupBy(by).agg(F.max(F.struct("words", (-F.col("seen")).alias("s"), "lang")).alias("b")).select(by, "b.lang", "b.words")


# --- samples


def even_spread(texts: DataFrame, by: list[str], order: list[str], n: int = 10) -> DataFrame:
    """n texts of each group at even steps of its order (all, if there are no more)."""
    rows = ranks.numbered(texts, by, order).withColumn("i", F.col("n") - 1)
    total = texts.groupBy(*by).agg(F.count("*").alias("total"))
    rows = rows.join(total, by)
    return rows.where((F.col("total") <= n) | (F.floor(F.col("i") * n / F.col("total")) > F.floor((F.col("i") - 1) * n / F.col("total")))).select(*texts.columns)


def capped(texts: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """Texts of each group, in order, until their words exceed `most`; with the running total `upto`."""
    return ranks.running(texts, by, order, "words").where(F.col("upto") <= most)


def seeded(texts: DataFrame, by: list[str], seed: str, n: int) -> DataFrame:
    """n texts of each group in the order of a hash of seed and key, with their place rn."""
    return top(texts.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}/"), F.col("key").cast("string")))), by, ["_h", "key"], n).drop("_h")


def round_robin(rows: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """At most n rows: the first of every group, then the second ones, and so on."""
    return top(rows, [by], order, n).orderBy("rn", by).limit(n)


def spot_check(texts: DataFrame, by: str, percent: int = 10) -> DataFrame:
    """A seeded share of each group, one at least."""
    rows = texts.withColumn("_h", F.md5(F.col("key").cast("string")))
    n = texts.groupBy(by).agg(F.count("*").alias("_n"))
    return ranks.numbered(rows, [by], ["_h", "key"]).join(n, by).where(F.col("n") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * percent / 100))).select(*texts.columns)


def next_ids(items: DataFrame, used: DataFrame, order: list[str]) -> DataFrame:
    """Items with id: the numbers after the highest that was ever used."""
    most = used.agg(F.coalesce(F.max("id"), F.lit(0)).alias("most")).first()["most"]
    return ranks.numbered(items, [], order).withColumn("id", F.col("n") + F.lit(most)).drop("n")


def to_prune(snapshots: DataFrame, by: str, order: list, keep: int = 5) -> DataFrame:
    """Snapshots beyond the newest `keep` of each profile."""
    return snapshots.join(top(snapshots, [by], order, keep).select("key"), "key", "left_anti")


def balanced_labels(items: DataFrame, labels: int = 4) -> DataFrame:
    """key and label (from 0): labels rotate over the items in order, so each is used equally often."""
    return ranks.numbered(items, [], ["key"]).select("key", F.pmod(F.col("n") - 1, F.lit(labels)).alias("label"))


# --- lifecycle


def patched(manifest: DataFrame, patch: DataFrame) -> DataFrame:
    """key and status once a patch (key, status, removed) is applied: entries are set, made or removed."""
    p = patch.select("key", F.col("status").alias("new"), F.col("removed"))
    return manifest.select("key", "status").join(p, "key", "full").where(~F.coalesce("removed", F.lit(False))).select("key", F.coalesce("new", "status").alias("status"))


def affected_slots(touched: DataFrame) -> DataFrame:
    """slot: the exact and the pooled slots of the texts that a change touches."""
    return touched.select(F.explode(F.array(T.slot(F.col("lang"), F.col("type")), T.slot(F.col("lang"), F.lit(None).cast("string")))).alias("slot")).distinct()


def rederived(slots: DataFrame, fresh: DataFrame, affected: DataFrame) -> DataFrame:
    """Slots with the affected ones measured anew; affected slots without texts go."""
    return slots.join(affected, "slot", "left_anti").unionByName(fresh.join(affected, "slot", "left_semi"))


def starter_actions(starters: DataFrame, mine: DataFrame) -> DataFrame:
    """id and action: starter rules to add, rules that are the same, and edited ones, which are kept."""
    a, b = starters.select("id", F.sha2("body", 256).alias("s")), mine.select("id", F.sha2("body", 256).alias("m"))
    return a.join(b, "id", "left").select("id", F.when(F.col("m").isNull(), "add").when(F.col("m") == F.col("s"), "same").otherwise("edited, kept").alias("action"))


def facet_added(slots: DataFrame) -> DataFrame:
    """Slot keys with one facet more, which nothing has yet."""
    return slots.withColumn("slot", F.concat("slot", F.lit("._")))


def cascade(items: DataFrame, rejected: DataFrame) -> DataFrame:
    """id of items that fall with the rejected ones: what requires a fallen item falls too, until nothing changes.

    `items` has id and requires (an id or null), one row for each requirement.
    """
    items = checkpointed(items.where("requires is not null").select("id", "requires"))  # read once, not every round
    fallen = checkpointed(plain_ids(rejected))
    now = fallen
    while True:
        nxt = plain_ids(items.join(now.select(F.col("id").alias("requires")), "requires", "left_semi"))
        now = checkpointed(nxt.join(fallen, "id", "left_anti"))
        if now.isEmpty():
            return fallen
        fallen = checkpointed(fallen.union(now))


def staged(inventory_rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """key, change: what an inventory and its decisions would write: create, repath, supersede, ask or nothing."""
    rows = inventory_rows.select("key", "result").join(decisions.groupBy("key").agg(F.max(F.col("decision") == "question").alias("asks")), "key", "left")
    change = (
        F.when(F.col("result").startswith("skipped") | F.col("result").isin("unchanged", "forgotten", "holdout"), "nothing").when(F.coalesce("asks", F.lit(False)), "ask")
        .when(F.col("result") == "renamed", "repath").when(F.col("result") == "changed", "supersede").otherwise("create")
    )
    return rows.select("key", change.alias("change"))


def restored(now: DataFrame, snapshot: DataFrame, rejections: DataFrame) -> DataFrame:
    """id, body, next_id: a snapshot's items without those rejected for good; new ids start behind the highest of both."""
    most = max(x.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"] for x in (now, snapshot))
    return snapshot.join(rejections.where("permanent").select("id"), "id", "left_anti").select("id", "body", F.lit(most + 1).cast("long").alias("next_id"))


def rejections(items: DataFrame, decision: str = "rejected") -> DataFrame:
    """id, kind, body, digest: what was rejected; of example passages only the hash is kept."""
    keep = F.when(F.col("kind") != "example", F.col("body"))
    return items.where(F.col("decision") == decision).select("id", "kind", keep.alias("body"), F.sha2("body", 256).alias("digest"))


def forgotten(manifest: DataFrame, examples: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The manifest with the keys marked as forgotten, and the examples without those of their texts."""
    gone = keys.select("key", F.lit(True).alias("gone"))
    m = manifest.join(gone, "key", "left").withColumn("status", F.when(F.col("gone"), "forgotten").otherwise(F.col("status"))).drop("gone")
    return m, cascaded(examples, keys)


def looked_up(manifest: DataFrame, asked: DataFrame) -> DataFrame:
    """name, key: entries whose key, path or address is the name asked for; forgotten ones only where none is live."""
    names = F.array_distinct(F.array(F.col("key").cast("string"), F.col("path"), T.url_key(F.col("path"))))
    rows = manifest.select("key", "status", F.explode(names).alias("name")).join(asked, "name")
    best = rows.groupBy("name").agg(F.max((F.col("status") != "forgotten").cast("int")).alias("some"))
    return rows.join(best, "name").where((F.col("some") == 0) | (F.col("status") != "forgotten")).select("name", "key")


def rule_facets(files: DataFrame, rules: DataFrame) -> DataFrame:
    """key, facet, value: facets that rules (rule_path, facet, value) set; the deepest rule wins."""
    return rule_hits(files, rules).groupBy("key", "facet").agg(F.max(F.struct("depth", "value")).alias("b")).select("key", "facet", F.col("b.value").alias("value"))


def coverage(files: DataFrame, rules: DataFrame, excluded: list[str] = ()) -> DataFrame:
    """rule_path, profile, texts: files under each rule that no glob takes out."""
    n = rule_hits(files.where(~matches_any(F.col("path"), list(excluded))), rules.select("rule_path", "profile").distinct()).groupBy("rule_path", "profile").agg(F.count("*").alias("texts"))
    return rules.select("rule_path", "profile").distinct().join(n, ["rule_path", "profile"], "left").select("rule_path", "profile", F.coalesce("texts", F.lit(0)).alias("texts"))


def stripped(entries: DataFrame, rejected: list[str]) -> DataFrame:
    """Entries (key, profiles: map of profile and record) without the records that stand on rejected items."""
    return entries.withColumn("profiles", F.map_filter("profiles", lambda p, r: ~r.isin(*rejected)))


def emptied_slots(slots: DataFrame, texts: DataFrame) -> DataFrame:
    return slots.join(texts.select("lang", "type"), ["lang", "type"], "left_anti")


def upserted(ledger: DataFrame, copied: DataFrame, by: str, value: str) -> DataFrame:
    """The ledger with rows of the same name replaced and new ones put in."""
    c = copied.select(by, F.col(value).alias("_new"))
    return ledger.select(by, value).join(c, by, "full").select(by, F.coalesce("_new", value).alias(value))


def changed_since(rows: DataFrame, last, name: str = "ts") -> DataFrame:
    """Rows changed a second after the last scan or later."""
    return rows.where(F.col(name) >= F.lit(last) + F.expr("interval 1 second"))


def expired(drafts: DataFrame, now, days: int = 90) -> DataFrame:
    """id and status of drafts (id, created): open, or expired after `days`."""
    return drafts.select("id", F.when(F.col("created") < F.lit(now) - F.make_dt_interval(F.lit(days)), "expired").otherwise("open").alias("status"))


def latest(states: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """The last state of each item of an append-only queue."""
    return states.groupBy(by).agg(F.max_by(value, F.struct(*order)).alias(value))


def joined_shorts(mails: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """folder, gid, members, words, last: short texts of a folder joined by thread (two at least), the rest by ISO week.

    `mails` has folder, thread, day and words; groups that stay shorter than `least` words go.
    """
    short = mails.where(F.col("words") < least)
    groups = short.groupBy("folder", "thread").agg(F.count("*").alias("members"), F.sum("words").alias("words"), F.max("day").alias("last"))
    threads = groups.where((F.col("members") >= 2) & (F.col("words") >= least))
    rest = short.join(threads.select("folder", "thread"), ["folder", "thread"], "left_anti")
    week = rest.groupBy("folder", F.date_trunc("week", "day").cast("date").alias("w")).agg(F.count("*").alias("members"), F.sum("words").alias("words"), F.max("day").alias("last")).where(F.col("words") >= least)
    name = F.concat(F.lit("thread-"), F.substring(F.sha1(F.col("thread").cast("string")), 1, 8))
    return threads.select("folder", name.alias("gid"), "members", "words", "last").union(week.select("folder", F.concat(F.lit("week-"), F.col("w").cast("string")), "members", "words", "last"))


def segments(blocks: DataFrame, least: int = 40) -> DataFrame:
    """key, part, lang, blocks, words: each text's main part (part 1, key as it is) and its runs in other languages (parts 2, 3,
    ..., key#part). `blocks` has key, pos, lang, words, and tells languages apart from `least` words on.

    The main language is the one with the most words in blocks that are long enough, on a tie the one that comes
    first; without such a block it is the language of the text's longest block. A run ends where a block of the main
    language stands, or one too short to tell: all these are the main part. So the blocks and words of the parts add up to the text's.
    """
    told = blocks.select("key", "pos", F.when(F.col("words") >= least, F.col("lang")).alias("told"), F.col("lang").alias("said"), "words")
    of = told.where("told is not null").groupBy("key", "told").agg(F.sum("words").alias("w"), F.min("pos").alias("first"))
    most = of.groupBy("key").agg(F.min(F.struct((-F.col("w")).alias("w"), "first", "told")).alias("b")).select("key", F.col("b.told").alias("main"))
    longest = told.groupBy("key").agg(F.min(F.struct((-F.col("words")).alias("w"), "pos", "said")).alias("b")).select("key", F.col("b.said").alias("other"))
    rows = told.join(longest.join(most, "key", "left"), "key").withColumn("main", F.coalesce("main", "other"))
    # rows of one text in order; a text's own blocks bound the window
    w = Window.partitionBy("key").orderBy("pos")
    away = F.when(F.col("told") != F.col("main"), F.col("told"))
    rows = rows.withColumn("away", away).withColumn("fresh", F.when(F.col("away").isNotNull() & ~F.col("away").eqNullSafe(F.lag("away").over(w)), 1).otherwise(0))
    part = F.when(F.col("away").isNull(), 1).otherwise(1 + F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = rows.withColumn("part", part.cast("long")).groupBy("key", "part").agg(F.min(F.coalesce("away", "main")).alias("lang"), F.count("*").alias("blocks"), F.sum("words").alias("words"))
    name = F.when(F.col("part") == 1, F.col("key").cast("string")).otherwise(F.concat(F.col("key").cast("string"), F.lit("#"), "part"))
    return g.select(name.alias("key"), "part", "lang", "blocks", "words")


def paragraphs(cues: DataFrame, pause: str = "2 seconds") -> DataFrame:
    """session, para, speaker, cues, first: a new paragraph where the speaker changes or after a longer pause."""
    w = Window.partitionBy("session").orderBy("ts", "cue")
    goes_on = (F.lag("speaker").over(w) == F.col("speaker")) & (F.lag("ts").over(w) >= F.col("ts") - F.expr(f"interval {pause}"))
    rows = cues.withColumn("fresh", F.when(goes_on, 0).otherwise(1)).withColumn("para", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("session", "para").agg(F.min("speaker").alias("speaker"), F.count("*").alias("cues"), F.min("cue").alias("first"))

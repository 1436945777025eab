"""Registered queries of the text ledger: the operators over ledger tables derived from the input tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as T
from .operators import evaluation as E
from .operators import ledger as L
from .operators import outliers, style
from .plans.ledger_sql import SQL
from .sources import ledger as S
from .sources.tables import documents, table

QUERIES: dict = {}
ORACLE_SQL = SQL


def add(name: str):
    def keep(f):
        QUERIES[name] = f
        return f

    return keep


def rows(spark, schema: str, *values):
    return spark.createDataFrame(list(values), schema)


@add("o014_corpus_texts")
def o014(s, d):
    return L.corpus_texts(S.manifest(s, d), table(s, d, "documents").select(F.col("doc_id").alias("key"), "n_chars")).select("key", "n_chars", "status")


@add("o016_connector_add")
def o016(s, d):
    return L.pushed(S.found(s, d), S.manifest(s, d), "web")


@add("o017_interview_add")
def o017(s, d):
    """Answers of the users of conversations, under the texts' keys."""
    said = S.turns(s, d).where("role = 'user'").select((F.col("conv_id") * 2).alias("key"), F.concat(F.lit("interview/"), "conv_id", F.lit("-"), "turn").alias("path"), "words")
    return L.pushed(said, S.manifest(s, d), "interview", 60)


@add("o018_bridge_plan")
def o018(s, d):
    files = S.found(s, d).select("path", F.col("words").alias("size"), F.col("key").alias("mtime"))
    return L.bridge_plan(files, S.manifest(s, d).select("path", F.col("words").alias("size"), F.col("key").alias("mtime")))


@add("o019_bridge_diff")
def o019(s, d):
    return L.snapshot_diff(S.manifest(s, d).select("path", F.col("key").alias("digest")), S.found(s, d).select("path", F.col("key").alias("digest")))


@add("o048_facet_precedence")
def o048(s, d):
    key = F.col("key")
    return S.manifest(s, d).select("key", L.first_set(F.when(key % 9 == 0, "note"), F.when(F.col("type") != "src3", F.col("type")), F.when(key % 2 == 0, "essay").otherwise(""), F.lit("unknown")).alias("type"))


@add("o049_document_date")
def o049(s, d):
    stated = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("2023-0"), (1 + F.col("event_id") % 9).cast("string"), F.lit("-17T08:00:00Z"))).when(F.col("event_id") % 3 == 1, "last spring")
    return table(s, d, "events").select("event_id", L.document_date(stated, F.col("ts")).alias("day"))


@add("o057_under_path")
def o057(s, d):
    return L.rule_hits(S.manifest(s, d), S.rules(s)).select("key", "rule_path", "profile")


@add("o058_scope")
def o058(s, d):
    return S.manifest(s, d).where(L.in_scope(F.col("path"), F.col("lang"), ["dir1"], ["dir2/sub0"], ["es"])).select("key")


@add("o059_excludes")
def o059(s, d):
    return S.manifest(s, d).where(~L.matches_any(F.col("path"), ["**/sub2/**", "dir4/**/*7.md", "f?1.md"])).select("key")


@add("o060_own_texts")
def o060(s, d):
    return L.own_texts(S.manifest(s, d)).select("key", "lang", "type", "words")


@add("o061_supported_languages")
def o061(s, d):
    return table(s, d, "documents").where(~F.col("lang").isin(*L.packs.UNSUPPORTED)).select("doc_id", "lang")


@add("o062_long_enough")
def o062(s, d):
    return S.manifest(s, d).where(F.col("words") >= L.MIN_WORDS).select("key", "words")


@add("o063_rulings_in_slot")
def o063(s, d):
    slots = S.manifest(s, d).select(T.slot(F.col("lang"), F.col("type")).alias("slot"), "lang").distinct()
    return L.rulings_in_slot(slots, rows(s, "id string, slot string, lang string", ("r1", None, None), ("r2", "en.src1", None), ("r3", None, "de"), ("r4", "fr.src2", "fr"), ("r5", "fr.src2", "de")))


@add("o064_applicable_metrics")
def o064(s, d):
    return L.applicable(table(s, d, "documents").select("lang").distinct(), {"hedges_per_1k": ("en", "de"), "conjunction_opener_share": ("en",), "contractions_per_1k": ("en",)})


@add("o065_applicable_signs")
def o065(s, d):
    signs = rows(s, "id string, tier string, starter string", ("s1", "always", "k1"), ("s2", "unless_writer", "k2"), ("s3", "unless_writer", None), ("s4", "unless_writer", "k4"), ("s5", "always", "k4"))
    return L.sign_states(signs, rows(s, "starter string", ("k1",)), rows(s, "id string", ("s3",)), rows(s, "starter string", ("k4",)))


@add("o066_mirror_slots")
def o066(s, d):
    return L.mirrors(L.own_texts(S.manifest(s, d)), ["lang"], ["lang", "type"])


@add("o067_classify_known")
def o067(s, d):
    return L.classified(S.found(s, d).select("key", "path"), S.manifest(s, d))


@add("o068_changed_paths")
def o068(s, d):
    return L.changed_paths(S.found(s, d), S.manifest(s, d))


@add("o069_most_specific_rule")
def o069(s, d):
    return L.decided(S.manifest(s, d).select("key", "path"), S.rules(s))


@add("o070_unreachable")
def o070(s, d):
    return L.unreachable(S.manifest(s, d), S.found(s, d))


@add("o073_inheritance")
def o073(s, d):
    return L.chain(S.profiles(s)).select("start", "profile", "depth")


@add("o074_slot_resolution")
def o074(s, d):
    slots = rows(s, "profile string, slot string", ("base", "en._"), ("sam", "en.src1"), ("base", "de.src2"))
    asked = rows(s, "start string, slot string, general int", ("acme", "en.src1", 0), ("acme", "en._", 1), ("kim", "en.src1", 0), ("kim", "en._", 1))
    return L.resolved_slot(L.chain(S.profiles(s)), slots, asked)


@add("o075_override_merge")
def o075(s, d):
    entries = rows(s, "profile string, id string, overrides string, text string", ("base", "b1", None, "use tea"), ("sam", "s1", "b1", "use coffee"), ("acme", "a1", None, "Use Tea"), ("base", "b2", None, "no jargon"))
    return L.merged(L.chain(S.profiles(s)), entries)


def _quotes(s, d):
    letters = "abcdefghijklmnopqrstuvwxyz"
    return table(s, d, "benchmark").select(F.col("item_id").alias("item"), F.translate("text", letters, letters.upper()).alias("quote"))


@add("o078_quote_found")
def o078(s, d):
    """Every passage, in capitals, against every document."""
    return L.quotes_found(documents(s, d), _quotes(s, d))


@add("o079_rejected_lessons")
def o079(s, d):
    lessons = table(s, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("lesson"))
    said = lessons.where("id % 3 = 0").select(F.concat(F.lit("The "), F.col("lesson"), F.lit(" and!")).alias("lesson"))
    return L.not_rejected(lessons, said).select("id")


@add("o099_status")
def o099(s, d):
    own = (F.col("ownership") == "own") & (F.col("status") == "active")
    return S.manifest(s, d).groupBy("status").agg(F.count("*").alias("texts"), F.count_if("holdout").alias("holdouts"), F.count_if(own).alias("own_active"), F.sum("words").alias("words"))


@add("o100_inventory_summary")
def o100(s, d):
    return L.classified(S.found(s, d), S.manifest(s, d)).groupBy("result").agg(F.count("*").alias("n"))


@add("o103_edit_rollup")
def o103(s, d):
    """Edits that users make stand for changes, by kind and pair."""
    return L.edit_lessons(table(s, d, "events").where("value > 100 or event_type = 'click'").select(F.col("event_type").alias("kind"), F.col("user_id").alias("pair")))


@add("o104_evidence_share")
def o104(s, d):
    docs = documents(s, d)
    return L.evidence(docs.where(F.col("text").contains("!")), docs, ["type"])


@add("o105_language_majority")
def o105(s, d):
    return L.language_majority(S.manifest(s, d), "folder")


@add("o109_rank_agreement")
def o109(s, d):
    """Sources ranked by the length of their texts and by their labelled quality."""
    docs = documents(s, d).join(table(s, d, "labels").select(F.col("doc_id").alias("key"), "quality"), "key")
    return E.rank_agreement(docs.groupBy("type").agg(F.avg(F.length("text")).alias("a"), F.avg("quality").alias("b")))


@add("o110_familiarity_bins")
def o110(s, d):
    """Texts by how likely a reader knows them (here their share of e), and how often they win (here good labels)."""
    docs = documents(s, d).join(table(s, d, "labels").select(F.col("doc_id").alias("key"), "quality"), "key")
    share = (F.length("text") - F.length(F.regexp_replace("text", "e", ""))) * 400 / F.length("text")
    return E.win_rate_bins(docs.where("length(text) > 0").select(share.alias("p"), (F.col("quality") == 1).alias("won")))


@add("o111_newest_in_group")
def o111(s, d):
    return L.newest_in_group(S.manifest(s, d).select("key", "path", "year"), documents(s, d))


@add("o120_even_spread")
def o120(s, d):
    return L.even_spread(L.own_texts(S.manifest(s, d)).select("key", "lang", "year"), ["lang"], ["year", "key"]).select("key", "lang")


@add("o121_capped_sample")
def o121(s, d):
    return L.capped(L.own_texts(S.manifest(s, d)).select("key", "lang", "year", "words"), ["lang"], ["year", "key"], 20_000).select("key", "lang", "upto")


@add("o122_seeded_sample")
def o122(s, d):
    return L.seeded(S.manifest(s, d).select("key", "type"), ["type"], "seed", 8)


@add("o123_one_per_text")
def o123(s, d):
    return L.round_robin(S.manifest(s, d).select("key", "type"), "type", ["key"], 25)


@add("o124_next_ids")
def o124(s, d):
    m = S.manifest(s, d)
    return L.next_ids(m.where("ownership = 'other'").select("key"), m.where("ownership = 'own'").select(F.col("key").alias("id")), ["key"])


@add("o125_snapshots_to_prune")
def o125(s, d):
    return L.to_prune(S.manifest(s, d).select("key", "folder", "year"), "folder", [F.desc("year"), F.desc("key")]).select("key", "folder")


@add("o128_superseded")
def o128(s, d):
    return S.manifest(s, d).where("status = 'active'").select("key").join(S.found(s, d).select("key"), "key", "left_anti")


@add("o129_write_diff")
def o129(s, d):
    return S.found(s, d).select("path", "key").exceptAll(S.manifest(s, d).select("path", "key"))


@add("o130_common_facets")
def o130(s, d):
    """Metrics that every text of a slot has: sources that occur in all languages stand for them."""
    m = S.manifest(s, d)
    return m.groupBy("type").agg(F.count_distinct("lang").alias("n")).where(F.col("n") == m.select("lang").distinct().count()).select("type")


@add("o131_sign_union")
def o131(s, d):
    own, universal = rows(s, "id string, lang string", ("a", "en"), ("b", "en")), rows(s, "id string, lang string", ("b", "any"), ("c", "any"))
    return own.unionByName(universal.join(own, "id", "left_anti"))


@add("o010_transcript_paragraphs")
def o010(s, d):
    return L.paragraphs(S.cues(s, d), "2 hours")


@add("o181_iso_weeks")
def o181(s, d):
    return table(s, d, "events").groupBy(F.date_trunc("week", "ts").alias("week"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


@add("o046_short_joined")
def o046(s, d):
    return L.joined_shorts(S.turns(s, d).select(F.col("role").alias("folder"), F.col("conv_id").alias("thread"), "day", "words")).withColumn("last", F.col("last").cast("string"))


@add("o151_inventory")
def o151(s, d):
    return L.inventory(S.found(s, d), S.manifest(s, d), S.texts_by_new_key(s, d))


@add("o152_ownership_decisions")
def o152(s, d):
    return L.ownership_decisions(S.manifest(s, d), S.rules(s))


def _patch(s, d):
    m, key = S.manifest(s, d), F.col("key")
    made = m.where("key % 10 = 3").select((key + 5_000_000).alias("key"), F.lit("active").alias("status"), F.lit(False).alias("removed"))
    set_ = m.where("key % 10 = 1").select("key", F.lit("superseded").alias("status"), F.lit(False).alias("removed"))
    gone = m.where("key % 10 = 2").select("key", F.lit(None).cast("string").alias("status"), F.lit(True).alias("removed"))
    return set_.union(gone).union(made)


@add("o153_manifest_patch")
def o153(s, d):
    return L.patched(S.manifest(s, d), _patch(s, d))


@add("o200_approved_view")
def o200(s, d):
    """Of the patches only those whose items were approved (not a multiple of four) are in the view."""
    return L.patched(S.manifest(s, d), _patch(s, d).where("key % 4 <> 0"))


@add("o154_staged_texts")
def o154(s, d):
    m = S.manifest(s, d)
    return L.staged(L.inventory(S.found(s, d), m, S.texts_by_new_key(s, d)), L.ownership_decisions(m, S.rules(s)))


@add("o155_decision_cascade")
def o155(s, d):
    """Each document requires the one of half its number; every thirteenth is rejected."""
    items = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") > 1, F.floor(F.col("doc_id") / 2)).alias("requires"))
    return L.cascade(items, items.where("id % 13 = 5").select("id"))


@add("o156_affected_slots")
def o156(s, d):
    return L.affected_slots(S.manifest(s, d).where("key % 40 = 0"))


@add("o157_rederived_slots")
def o157(s, d):
    """Slots with their words; the third of the texts that were touched are measured anew without those rejected."""
    m = S.manifest(s, d).withColumn("slot", T.slot(F.col("lang"), F.col("type")))
    words = lambda x: x.groupBy("slot").agg(F.sum("words").alias("words"), F.count("*").alias("texts"))
    return L.rederived(words(m), words(m.where("ownership <> 'other'")), L.affected_slots(m.where("key % 3 = 0 and ownership = 'other'")))


@add("o159_forgotten")
def o159(s, d):
    m = S.manifest(s, d)
    examples = m.select(F.col("key").alias("id"), F.col("key").alias("source"), F.col("path").alias("quote"))
    return L.forgotten(m, examples, m.where("folder = 'dir3'").select("key"))[0].select("key", "status")


@add("o191_cascade_delete")
def o191(s, d):
    m = S.manifest(s, d)
    examples = m.select(F.col("key").alias("id"), (F.col("key") + 1).alias("source"), F.col("path").alias("quote"))
    return L.cascaded(examples, m.where("status = 'forgotten'").select("key"))


@add("o160_holdouts")
def o160(s, d):
    own = L.own_texts(S.manifest(s, d)).select("key", "type")
    picked = L.seeded(own, ["type"], "holdout", 2).select("key", F.lit(True).alias("p"))
    return own.join(picked, "key", "left").select("key", F.coalesce("p", F.lit(False)).alias("holdout"))


@add("o227_author_holdouts")
def o227(s, d):
    return L.seeded(S.manifest(s, d).select("key", "folder"), ["folder"], "x", 3).select("key", "folder")


@add("o161_starter_rules")
def o161(s, d):
    """All documents as starter rules; a writer has the labelled ones, and has edited those of poor quality."""
    starters = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    had = table(s, d, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("quality"))
    return L.starter_actions(starters, starters.join(had, "id").select("id", F.when(F.col("quality") == 0, F.concat("body", F.lit(" edited"))).otherwise(F.col("body")).alias("body")))


@add("o162_guide_rules_found")
def o162(s, d):
    return L.guide_rules(documents(s, d), _quotes(s, d))


@add("o165_facet_added")
def o165(s, d):
    return L.facet_added(S.manifest(s, d).select("key", T.slot(F.col("lang"), F.col("type")).alias("slot")))


@add("o175_balanced_labels")
def o175(s, d):
    return L.balanced_labels(S.manifest(s, d))


@add("o176_inventory_compare")
def o176(s, d):
    expected = S.manifest(s, d).where("key % 5 <> 4").select("path", F.when(F.col("key") % 8 != 0, F.col("key")).alias("key"))
    return L.compared(expected, S.found(s, d))


@add("o177_changed_since")
def o177(s, d):
    ev = table(s, d, "events")
    last = ev.agg((F.min("ts") + F.expr("interval 3 days")).alias("t")).first()["t"]
    return L.changed_since(ev, last).select("event_id", "ts")


@add("o178_expired_drafts")
def o178(s, d):
    ev = table(s, d, "events")
    return L.expired(ev.select(F.col("event_id").alias("id"), F.col("ts").alias("created")), ev.agg(F.max("ts").alias("t")).first()["t"], 20)


@add("o180_edit_queue")
def o180(s, d):
    return L.latest(table(s, d, "events").select(F.col("user_id").alias("item"), F.col("event_type").alias("state"), "ts", "event_id"), "item", ["ts", "event_id"], "state")


@add("o182_evidence_pruned")
def o182(s, d):
    m = S.manifest(s, d)
    return L.pruned(m.select(F.col("type").alias("lesson"), "key"), m.where("status = 'forgotten' or ownership = 'other'"))


@add("o183_nearest_ancestor")
def o183(s, d):
    return L.nearest(L.chain(S.profiles(s)), rows(s, "profile string, file string", ("base", "en.flavour"), ("sam", "de.flavour")), "file")


@add("o186_inherited_rulings")
def o186(s, d):
    return L.inherited(L.chain(S.profiles(s)))


@add("o187_rule_facets")
def o187(s, d):
    return L.rule_facets(S.manifest(s, d).select("key", "path"), rows(s, "rule_path string, facet string, value string", *S.FACETS))


@add("o188_rule_coverage")
def o188(s, d):
    return L.coverage(S.manifest(s, d).select("key", "path"), S.rules(s), ["*9.md"])


@add("o189_type_resolution")
def o189(s, d):
    m, key = S.manifest(s, d), F.col("key")
    ruled = L.rule_facets(m.select("key", "path"), rows(s, "rule_path string, facet string, value string", *S.FACETS)).where("facet = 'type'").select("key", "value")
    return m.join(ruled, "key", "left").select("key", L.first_set(F.when(key % 4 == 0, "set"), F.when(F.col("type") != "src1", F.col("type")), F.col("value")).alias("type"))


@add("o190_entry_lookup")
def o190(s, d):
    m = S.manifest(s, d)
    asked = m.where("key % 9 = 0").select(F.col("key").cast("string").alias("name")).union(m.where("key % 9 = 2").select("path")).distinct()
    return L.looked_up(m, asked)


@add("o192_restored")
def o192(s, d):
    """All documents are there now; the snapshot had the labelled ones, and toxic ones are rejected for good."""
    items = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("body"))
    no = table(s, d, "labels").select(F.col("doc_id").alias("id"), (F.col("toxic") == 1).alias("permanent"))
    return L.restored(items, items.join(no.select("id").distinct(), "id", "left_semi"), no)


@add("o193_item_lookup")
def o193(s, d):
    m = S.manifest(s, d)
    kinds = (("lesson", "ownership = 'own'"), ("example", "holdout"), ("ruling", "status = 'superseded'"))
    parts = [m.where(c).select(F.lit(k).alias("artefact"), "key") for k, c in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).join(m.where("cached").select("key"), "key", "left_semi")


@add("o194_stripped_records")
def o194(s, d):
    m = S.manifest(s, d).select("key", F.create_map(F.lit("sam"), F.col("ownership"), F.lit("kim"), F.col("status")).alias("profiles"))
    return L.stripped(m, ["other", "forgotten"]).select("key", F.array_join(F.array_sort(F.map_keys("profiles")), ",").alias("profiles"))


@add("o195_requirements")
def o195(s, d):
    g = S.manifest(s, d).groupBy("folder").agg(F.array_sort(F.collect_set("type")).alias("t"))
    return g.select("folder", F.array_join("t", ",").alias("types"))


@add("o196_emptied_slots")
def o196(s, d):
    m = S.manifest(s, d)
    return L.emptied_slots(m.select("lang", "type").distinct(), L.own_texts(m))


@add("o197_rejections")
def o197(s, d):
    items = documents(s, d).select(F.col("key").alias("id"), F.when(F.col("key") % 2 == 0, "example").otherwise("lesson").alias("kind"), F.col("text").alias("body"), F.when(F.col("key") % 3 == 0, "rejected").otherwise("approved").alias("decision"))
    return L.rejections(items).select("id", "kind", F.length("body").cast("long").alias("kept_chars"), "digest")


@add("o198_profile_snapshot")
def o198(s, d):
    """All texts that the rules give to a profile, with their entries."""
    m = S.manifest(s, d)
    mine = L.decided(m.select("key", "path"), S.rules(s)).where("profile = 'sam' and ownership = 'own'").select("key")
    return m.join(mine, "key", "left_semi").select("key", "path", "status")


@add("o201_kept_drafts")
def o201(s, d):
    """Drafts with equal texts are kept once, the first of them."""
    docs = documents(s, d).withColumn("digest", F.sha2(T.content_text(F.coalesce("text", F.lit(""))), 256))
    return docs.groupBy("digest").agg(F.min("key").alias("id"), F.count("*").alias("copies"), F.min(T.n_words(F.coalesce("text", F.lit("")))).cast("long").alias("words")).select("id", "copies", "words")


@add("o202_published_summary")
def o202(s, d):
    return S.manifest(s, d).groupBy("type").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "active").alias("active"))


@add("o203_learnable_names")
def o203(s, d):
    path = F.when(F.col("key") % 10 == 0, F.concat(F.lit(".git/"), "path")).when(F.col("key") % 10 == 1, F.concat("path", F.lit(".png"))).otherwise(F.col("path"))
    return S.manifest(s, d).select("key", path.alias("path")).where(E.learnable(F.col("path")))


@add("o204_copied_files")
def o204(s, d):
    m = S.manifest(s, d)
    return L.upserted(m.where("key % 2 = 0"), m.where("key % 3 = 0").select("path", (F.col("words") + 1).alias("words")), "path", "words")


@add("o205_pack_caveats")
def o205(s, d):
    return E.pack_caveats(table(s, d, "documents").select("lang").union(rows(s, "lang string", ("nl",), ("xx",))).distinct())


@add("o206_pack_listing")
def o206(s, d):
    return E.pack_listing(s)


@add("o207_kit_caps")
def o207(s, d):
    return L.top(S.manifest(s, d).select("key", "type", (F.col("ownership") != "own").alias("late")), ["type"], ["late", "key"], 30).select("key", "type", "rn")


@add("o210_one_ruling")
def o210(s, d):
    used = S.manifest(s, d).where("holdout").select(F.col("key").alias("id"))
    return used.union(L.next_ids(rows(s, "key long", (-1,)), used, ["key"]).select("id"))


@add("o211_sign_override")
def o211(s, d):
    signs = rows(s, "id string, tier string, starter string", ("s1", "always", None), ("s2", "unless_writer", None))
    none = rows(s, "starter string")
    return L.sign_states(signs, none, signs.select("id"), none).select("id", (F.col("state") == "allowed").alias("may_switch_off"))


@add("o212_next_steps")
def o212(s, d):
    """Steps of a run that have not been done, from what the ledger holds."""
    m = S.manifest(s, d).agg(F.count("*").alias("scan"), F.count_if(F.col("ownership") == "own").alias("own"), F.count_if(F.col("status") == "measured").alias("measure"), F.count_if(F.col("status") == "committed").alias("commit"))
    steps = F.array(*[F.struct(F.lit(i + 1).alias("place"), F.lit(k).alias("step"), F.col(k).alias("n")) for i, k in enumerate(("scan", "own", "measure", "commit"))])
    return m.select(F.inline(steps)).where("n = 0").select("step", "place")


@add("o214_pending_status")
def o214(s, d):
    open_ = F.col("ownership") == "undecided"
    return S.manifest(s, d).agg(F.count_if(open_).alias("pending"), F.count_if(~open_).alias("decided"), F.count("*").alias("items"))


@add("o215_fresh_round_robin")
def o215(s, d):
    own = L.own_texts(S.manifest(s, d)).select("key", "type")
    return L.round_robin(own.join(own.where("key % 3 = 0").select("key"), "key", "left_anti"), "type", ["key"], 40)


@add("o216_draft_length")
def o216(s, d):
    """Documents as drafts, against the mean length of their source."""
    m = S.manifest(s, d).select("key", "type", "words")
    return E.length_check(m.join(m.groupBy("type").agg(F.avg("words").alias("target")), "type"))


@add("o217_distractors")
def o217(s, d):
    return E.distractors(S.manifest(s, d).select("type").distinct(), "type", 3)


@add("o218_scaled_answers")
def o218(s, d):
    """The users' shares of each event type's value."""
    return E.scaled(table(s, d, "events").groupBy(F.col("event_type").alias("answer"), F.col("user_id").alias("choice")).agg(F.sum("value").alias("p")))


@add("o219_spot_check")
def o219(s, d):
    return L.spot_check(S.manifest(s, d).select("key", "type"), "type")


@add("o220_detector_shift")
def o220(s, d):
    """A detector's score (here the share of e) of good and of poor texts by source."""
    docs = documents(s, d).join(table(s, d, "labels").select(F.col("doc_id").alias("key"), "quality"), "key")
    score = F.length(F.regexp_replace("text", "[^e]", ""))
    return E.detector_shift(docs.select("type", score.alias("score"), (F.col("quality") == 1).alias("own")), "type")


@add("o221_screened_authors")
def o221(s, d):
    """Sources whose texts are toxic with a mean probability under 30 %."""
    labels = table(s, d, "labels").select(F.col("doc_id").alias("key"), (F.col("toxic") * 100).alias("p"))
    return E.screened(documents(s, d).join(labels, "key").select(F.col("type").alias("author"), "p"))


@add("o222_report_cut")
def o222(s, d):
    """Every second document has a passage and a report behind it."""
    t = F.when(F.col("key") % 2 == 0, F.concat("text", F.lit("\n## Report\nflags: 3\n## Report\n"))).otherwise(F.col("text"))
    return documents(s, d).select("key", F.md5(E.without_report(t)).alias("digest"))


@add("o223_flags_by_group")
def o223(s, d):
    m = S.manifest(s, d).withColumn("flag", (F.col("words") < 150).cast("long"))
    return E.scored(m, [["type"], ["lang"]], "flag")


@add("o225_essay_slices")
def o225(s, d):
    """Lines of all documents of a folder; a title may stand in a table of contents first, so its last line counts."""
    m = S.manifest(s, d).select("folder", "key", F.col("type").alias("title"))
    return E.slices(m, "folder", "title", "key")


@add("o139_two_references")
def o139(s, d):
    """Words a text, flagged if outside the band of its language and that of its source."""
    m = S.manifest(s, d).select("key", "lang", "type", "words")
    a, b = (m.groupBy(c).agg(F.avg("words").alias(f"{c}_mean")) for c in ("lang", "type"))
    return m.join(a, "lang").join(b, "type").select("key", E.outside_both(F.col("words"), F.col("lang_mean"), F.col("type_mean")).alias("flagged"))


@add("o140_fail_counts")
def o140(s, d):
    return s.range(1, 29).select(F.col("id").alias("n"), E.fail_count(F.col("id")).alias("fails_from"))


@add("o150_language_guard")
def o150(s, d):
    """The language of a draft's slot against that of its text, which is given."""
    m = S.manifest(s, d)
    asked = F.when(F.col("key") % 8 == 0, "en").otherwise(F.col("lang"))
    return m.select("key", E.mismatch(asked, F.col("lang"), F.col("words")).alias("mismatch"))


@add("o170_pair_separation")
def o170(s, d):
    """Words of a document against those of the next one, by source."""
    m = S.manifest(s, d).select("key", "type", "words")
    pairs = m.where("key % 2 = 0").join(m.select((F.col("key") - 1).alias("key"), F.col("words").alias("after")), "key").where("words > 0")
    return E.separation(pairs.select(F.col("type").alias("author"), F.col("words").alias("before"), "after"))


@add("o171_leave_own_out")
def o171(s, d):
    m = S.manifest(s, d).select("key", "type", "words")
    return E.without_own(m, "type", "words")


@add("o172_threshold_sweep")
def o172(s, d):
    return E.sweep(outliers.distances(documents(s, d), ["lang", "type"]), ["lang", "type"], [1.5, 2.0, 3.0, 4.0, 5.0])


@add("o108_win_rates")
def o108(s, d):
    """Good labels as wins by source, with a tie for toxic texts, and the exact two-sided binomial test."""
    labels = table(s, d, "labels").select(F.col("doc_id").alias("key"), F.when(F.col("toxic") == 1, 0.5).otherwise(F.col("quality").cast("double")).alias("win"))
    return E.win_rates(documents(s, d).join(labels, "key"), "type", "win")


@add("o102_primary_metrics")
def o102(s, d):
    """Metrics by which texts of one language differ from the slot most often, worst first."""
    from .operators.check import metric_flags

    docs = style.summed_once(documents(s, d))
    return E.primary(metric_flags(docs, style.slot_metrics(docs, ("lang",)), ["lang"]), 5)


@add("o184_drift_per_metric")
def o184(s, d):
    docs = style.summed_once(documents(s, d))
    slot = style.melted(style.slot_metrics(docs, ("lang",)), ["lang"]).withColumnRenamed("value", "slot")
    got = style.melted(style.slot_metrics(docs, ("lang", "type")), ["lang", "type"])
    return E.drift(got, slot, ["lang"], ["lang", "type"])

"""Decisions that bear on each other, and changes of a table that can be applied, taken back and composed.

A proposal's items hang together: by what they require, whom they follow, the texts they quote or rest on. What a
writer's own decisions mean for all of them is the least fixpoint of a few rules, found round by round over the
items that fell last. Changes are rows (key, before, after), structs or null: a table is moved forward or back by
joins on the key, and nothing but the touched keys is rewritten.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .similarity import checkpointed, plain_ids

DECIDED = ("approved", "rejected")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, frames)


def followed(items: DataFrame, follows: DataFrame) -> DataFrame:
    """(id, decision): an item takes the decision of the one it follows, once that is decided, and so on up the chain.

    `follows` (id, up) has at most one row an item. Chains are doubled, so their length costs its logarithm; items
    that follow each other in a circle keep their own decisions, and so do those that lead into one.
    """
    own = items.select("id", "decision")
    # dec: the furthest decision met so far, from the item up to, but without, `up`
    chain = checkpointed(own.join(follows.select("id", "up"), "id", "left").join(own.select(F.col("id").alias("up"), F.lit(True).alias("known")), "up", "left").select("id", F.when(F.col("known"), F.col("up")).alias("up"), F.col("decision").alias("dec")))
    left = chain.where("up is not null").count()
    steps = max(1, left).bit_length() + 1
    while left and steps:
        above = chain.select(F.col("id").alias("up"), F.col("up").alias("further"), F.col("dec").alias("above"))
        moved = chain.where("up is not null").join(above, "up").select("id", F.col("further").alias("up"), F.when(F.col("above").isin(*DECIDED), F.col("above")).otherwise(F.col("dec")).alias("dec"))
        chain = checkpointed(moved.union(chain.where("up is null").select("id", "up", "dec")))
        left, steps = chain.where("up is not null").count(), steps - 1
    return chain.join(own, "id").select("id", F.when(F.col("up").isNull(), F.col("dec")).otherwise(F.col("decision")).alias("decision"))


def effective(items: DataFrame, requires: DataFrame, follows: DataFrame, quotes: DataFrame, evidence: DataFrame, records: DataFrame) -> DataFrame:
    """(id, decision) of every item, from the writer's own decisions alone, whatever was in effect before.

    items: id, decision (approved, rejected or pending), ref (the text it stands for, or null), proposal (an atomic one, or
    null). requires: id, on. follows: id, up. quotes: id, ref. evidence: id, ref. records: id, record, on.

    An item is rejected if an item it requires is, or the one it follows, or the text it quotes; if every text it rests
    on is; if each of its records needs something that is; or if the writer rejects an item of its atomic proposal. Other
    items have the decision they follow, or their own. The rules only ever add rejections, so their order is of no
    account, and approving a cause again undoes what came of it.
    """
    items = checkpointed(items.select("id", "decision", "ref", "proposal"))
    base = checkpointed(followed(items, follows))
    torn = items.where("decision = 'rejected' and proposal is not null").select("proposal").distinct()
    seeds = base.where("decision = 'rejected'").select("id").union(items.join(torn, "proposal", "left_semi").select("id"))
    refs = items.where("ref is not null").select(F.col("id").alias("on"), "ref")
    requires, follows = checkpointed(requires.select("id", "on")), checkpointed(follows.select("id", F.col("up").alias("on")))
    cited = checkpointed(quotes.select("id", "ref").join(refs, "ref").select("id", "on"))
    # each text of a lesson with the items that stand for it; a text that no item stands for cannot fall
    rests = checkpointed(evidence.select("id", "ref").distinct().join(refs, "ref", "left").select("id", "ref", "on"))
    needs = checkpointed(records.select("id", "record", "on").distinct())
    now = checkpointed(plain_ids(seeds))
    fallen = now
    while not now.isEmpty():
        last = now.select(F.col("id").alias("on"))
        direct = [e.join(last, "on", "left_semi").select("id") for e in (requires, follows, cited)]
        down = fallen.select(F.col("id").alias("on"), F.lit(1).alias("down"))
        # only lessons and records that the last round touched are counted again
        touched = rests.join(rests.join(last, "on", "left_semi").select("id").distinct(), "id", "left_semi").join(down, "on", "left")
        lessons = touched.groupBy("id", "ref").agg(F.max("down").alias("down")).groupBy("id").agg(F.count("*").alias("n"), F.count("down").alias("down")).where("n = down").select("id")
        met = needs.join(needs.join(last, "on", "left_semi").select("id").distinct(), "id", "left_semi").join(down, "on", "left")
        bare = met.groupBy("id", "record").agg(F.max("down").alias("down")).groupBy("id").agg(F.count("*").alias("n"), F.count("down").alias("down")).where("n = down").select("id")
        found = plain_ids(_union([*direct, lessons, bare])).join(items.select("id"), "id", "left_semi")
        now = checkpointed(found.join(fallen, "id", "left_anti"))
        fallen = checkpointed(fallen.union(now))
    mark = fallen.select("id", F.lit("rejected").alias("fell"))
    return base.join(mark, "id", "left").select("id", F.coalesce("fell", "decision").alias("decision"))


# --- changes


def _image(columns: list[str], side: str) -> Column:
    """The row as a struct; null where the table has no row of that key."""
    return F.when(F.col(f"{side}_here"), F.struct(*[F.col(f"{side}_{c}").alias(c) for c in columns]))


def changes(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """(key, before, after) for the rows that were added, removed or altered; both tables have each key once."""
    columns = old.columns
    a = old.select(F.col(key), *[F.col(c).alias(f"before_{c}") for c in columns], F.lit(True).alias("before_here"))
    b = new.select(F.col(key), *[F.col(c).alias(f"after_{c}") for c in columns], F.lit(True).alias("after_here"))
    both = a.join(b, key, "full_outer").select(key, _image(columns, "before").alias("before"), _image(columns, "after").alias("after"))
    return both.where(~F.col("before").eqNullSafe(F.col("after")))


def inverse(change: DataFrame, key: str = "key") -> DataFrame:
    return change.select(key, F.col("after").alias("before"), F.col("before").alias("after"))


def conflicts(table: DataFrame, change: DataFrame, key: str = "key") -> DataFrame:
    """(key, expected, found) where the table does not have the row that the change starts from."""
    have = table.select(F.col(key), F.struct(*table.columns).alias("found"))
    met = change.select(key, F.col("before").alias("expected")).join(have, key, "left")
    return met.where(~F.col("expected").eqNullSafe(F.col("found")))


def applied(table: DataFrame, change: DataFrame, key: str = "key") -> DataFrame:
    """The table after the change; rows of other keys stay as they are. Ask for `conflicts` first."""
    stay = table.join(change.select(key), key, "left_anti").select(table.columns)
    return stay.unionByName(change.where("after is not null").select("after.*"))


def composed(first: DataFrame, second: DataFrame, key: str = "key") -> DataFrame:
    """One change that does what `first` and then `second` do; what they undo between them is left out."""
    a = first.select(key, "before", F.col("after").alias("mid"), F.lit(True).alias("one"))
    b = second.select(key, F.col("before").alias("mid2"), "after", F.lit(True).alias("two"))
    both = a.join(b, key, "full_outer")
    got = both.select(key, F.when(F.col("one"), F.col("before")).otherwise(F.col("mid2")).alias("before"), F.when(F.col("two"), F.col("after")).otherwise(F.col("mid")).alias("after"))
    return got.where(~F.col("before").eqNullSafe(F.col("after")))


def marked(table: DataFrame, keys: DataFrame, values: dict[str, Column], key: str = "key") -> DataFrame:
    """The change that gives the rows of `keys` other values in some columns."""
    hit = table.join(keys.select(key).distinct(), key, "left_semi")
    new = hit.select(*[values[c].alias(c) if c in values else F.col(c) for c in table.columns])
    return changes(hit, new, key)


def removed(table: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """The change that takes rows out. Their ids stay used: `next_id` looks at the changes, too."""
    hit = table.join(keys.select(key).distinct(), key, "left_semi")
    return hit.select(F.col(key), F.struct(*table.columns).alias("before"), F.lit(None).cast(hit.select(F.struct(*table.columns)).schema[0].dataType).alias("after"))


def next_id(table: DataFrame, history: list[DataFrame], key: str = "key") -> int:
    """One more than any id that the table has or a change ever mentioned."""
    every = _union([table.select(F.col(key).alias("k")), *[h.select(F.col(key).alias("k")) for h in history]])
    return (every.agg(F.max("k").alias("k")).first()["k"] or 0) + 1


# --- patches of nested maps


def merged(records: DataFrame, patches: DataFrame) -> DataFrame:
    """Records (key, status, profiles: map of string to string, facets: map) with patches merged in.

    A patch has key, op, field, name and value. `set` gives a map's entry a value unless the record has one, `force` in any case;
    `remove` takes the entry out; `replace` empties the map first; `status` sets the status; `create` makes the record. Of
    several patches of one entry force goes before set, and a removal before both; two forced values that differ, or a value
    forced on an entry that is removed, conflict: the entry stays as it is and `conflicts` names it.
    """
    maps = ("profiles", "facets")
    kinds = {k: F.col("op") == k for k in ("set", "force", "remove")}
    one = patches.where(F.col("op").isin("set", "force", "remove")).groupBy("key", "field", "name").agg(
        F.count_if(kinds["remove"]).alias("gone"), F.min(F.when(kinds["force"], F.col("value"))).alias("low"), F.max(F.when(kinds["force"], F.col("value"))).alias("high"),
        F.min(F.when(kinds["set"], F.col("value"))).alias("given"),
    )
    clash = (F.col("low") != F.col("high")) | ((F.col("gone") > 0) & F.col("low").isNotNull())
    act = F.when(clash, "keep").when(F.col("gone") > 0, "remove").when(F.col("low").isNotNull(), "force").otherwise("set")
    acts = one.select("key", "field", "name", act.alias("act"), F.coalesce("low", "given").alias("value"))
    listed = acts.groupBy("key").agg(F.collect_list(F.struct("field", "name", "act", "value")).alias("acts"))
    empties = patches.where("op = 'replace'").groupBy("key").agg(F.collect_set("field").alias("emptied"))
    status = patches.where("op = 'status'").groupBy("key").agg(F.max("value").alias("to"))
    made = patches.where("op = 'create'").select("key").distinct().join(records.select("key"), "key", "left_anti")
    none = F.create_map().cast("map<string,string>")
    rows = records.select("key", "status", *maps).unionByName(made.select("key", F.lit("active").alias("status"), *[none.alias(m) for m in maps]))
    rows = rows.join(listed, "key", "left").join(empties, "key", "left").join(status, "key", "left")

    def entries(field: str) -> Column:
        old = F.when(F.array_contains("emptied", field), none).otherwise(F.coalesce(F.col(field), none))
        own = F.filter(F.coalesce("acts", F.array().cast(listed.schema["acts"].dataType)), lambda a: (a["field"] == field))
        moved = F.filter(own, lambda a: a["act"].isin("force", "remove"))
        kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.transform(moved, lambda a: a["name"]), k))
        fresh = F.filter(own, lambda a: (a["act"] == "force") | ((a["act"] == "set") & ~F.map_contains_key(old, a["name"])))
        return F.map_concat(kept, F.map_from_entries(F.transform(fresh, lambda a: F.struct(a["name"], a["value"]))))

    stuck = F.transform(F.filter(F.coalesce("acts", F.array().cast(listed.schema["acts"].dataType)), lambda a: a["act"] == "keep"), lambda a: F.concat(a["field"], F.lit("."), a["name"]))
    return rows.select("key", F.coalesce("to", "status").alias("status"), *[entries(m).alias(m) for m in maps], F.array_sort(stuck).alias("conflicts"))


# --- lessons from stored pairs of edits

SLUG = "^[a-z0-9]+(-[a-z0-9]+)*$"
OTHER = "other"


def kind_faults(changes: DataFrame, lessons: DataFrame, described: DataFrame) -> DataFrame:
    """slot, kind, fault: kinds that are missing, no slugs, or new and not described; changes have slot, pair, change, kind."""
    kinds = changes.groupBy("slot", "kind").agg(F.count("*").alias("n"))
    missing = kinds.where("kind is null").select("slot", "kind", F.lit("a change has no kind").alias("fault"))
    spelled = kinds.where(~F.col("kind").rlike(SLUG)).select("slot", "kind", F.lit("not a slug").alias("fault"))
    known = lessons.select("slot", "kind").union(described.select("slot", "kind")).distinct()
    new = kinds.where((F.col("kind") != OTHER) & F.col("kind").rlike(SLUG)).join(known, ["slot", "kind"], "left_anti").select("slot", "kind", F.lit("not described").alias("fault"))
    return _union([missing, spelled, new])


def rebuilt_lessons(changes: DataFrame, lessons: DataFrame, described: DataFrame, rejected: DataFrame) -> DataFrame:
    """slot, id, kind, text, pairs, seen_once, op: the lessons that all stored pairs bear out, beside those there are.

    lessons: slot, id, kind, text, pairs. op is keep, modify (its pairs have changed), drop (no pair is left: taking a pair out
    undoes what it brought), add (a kind that is described; ids go on behind the slot's highest, in the order of kinds) or
    refused (a new kind whose text the writer has rejected: slot, text in normal form; no id). Kind `other` teaches nothing.
    """
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, r"(?U)[^\w]+", " ")))
    now = changes.where(F.col("kind").isNotNull() & (F.col("kind") != OTHER)).groupBy("slot", "kind").agg(F.array_sort(F.collect_set("pair")).alias("now"))
    old = lessons.select("slot", "id", "kind", "text", F.array_sort("pairs").alias("pairs"))
    both = now.join(old, ["slot", "kind"], "full_outer")
    kept = both.where("id is not null").select(
        "slot", "id", "kind", "text", F.coalesce("now", F.array().cast(now.schema["now"].dataType)).alias("pairs"),
        F.when(F.col("now").isNull(), "drop").when(F.col("now") == F.col("pairs"), "keep").otherwise("modify").alias("op"),
    )
    new = both.where("id is null").select("slot", "kind", F.col("now").alias("pairs")).join(described.select("slot", "kind", F.trim("text").alias("text")), ["slot", "kind"])
    said = rejected.select(F.col("slot").alias("r_slot"), norm(F.col("text")).alias("r_text")).distinct()
    new = checkpointed(new.join(said, (F.col("slot") == F.col("r_slot")) & (norm(F.col("text")) == F.col("r_text")), "left").withColumn("no", F.col("r_slot").isNotNull()).drop("r_slot", "r_text"))
    last = lessons.groupBy("slot").agg(F.max("id").alias("last"))
    # a slot's kinds are few, as people name them
    rank = F.expr("row_number() over (partition by slot order by kind)")
    added = new.where("not no").withColumn("rn", rank).join(last, "slot", "left").select("slot", (F.coalesce("last", F.lit(0)) + F.col("rn")).cast("long").alias("id"), "kind", "text", "pairs", F.lit("add").alias("op"))
    refused = new.where("no").select("slot", F.lit(None).cast("long").alias("id"), "kind", "text", "pairs", F.lit("refused").alias("op"))
    out = kept.withColumn("id", F.col("id").cast("long")).unionByName(added).unionByName(refused)
    return out.select("slot", "id", "kind", "text", "pairs", (F.size("pairs") < 2).alias("seen_once"), "op")

"""Decisions, changes and patches against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import decisions as D


def loop(items, requires, follows, quotes, evidence, records):
    """What the rules say, tried on every item again and again until nothing changes."""
    own, ref = {i: d for i, d, _, _ in items}, {}
    for i, _, r, _ in items:
        ref.setdefault(r, []).append(i)
    up = dict(follows)

    def base(i):
        seen, at, got = set(), i, own[i]
        while at in up and up[at] in own:
            if at in seen:
                return own[i]  # a circle, or what leads into one
            seen.add(at)
            at = up[at]
            if own[at] != "pending":
                got = own[at]
        return got

    now = {i: base(i) for i in own}
    torn = {p for i, d, _, p in items if d == "rejected" and p is not None}
    down = {i for i in own if now[i] == "rejected"} | {i for i, _, _, p in items if p in torn}
    while True:
        fell = {i for i, on in requires if on in down} | {i for i, on in follows if on in down}
        text_down = lambda r: any(t in down for t in ref.get(r, []))
        fell |= {i for i, r in quotes if text_down(r)}
        rests = {}
        for i, r in evidence:
            rests.setdefault(i, set()).add(r)
        fell |= {i for i, rs in rests.items() if all(map(text_down, rs))}
        made = {}
        for i, record, on in records:
            made.setdefault(i, {}).setdefault(record, set()).add(on)
        fell |= {i for i, rs in made.items() if all(any(on in down for on in ons) for ons in rs.values())}
        fell &= set(own)
        if fell <= down:
            return {i: "rejected" if i in down else now[i] for i in own}
        down |= fell


@pytest.mark.parametrize("seed", range(3))
def test_effective_decisions(spark, seed):
    r = random.Random(seed)
    ids = [f"i{k}" for k in range(60)]
    items = [(i, r.choice(["approved", "pending", "pending", "rejected"] if k % 9 == 0 else ["approved", "pending"]), f"r{k % 17}" if k % 3 == 0 else None, f"p{k % 11}" if k % 7 == 0 else None) for k, i in enumerate(ids)]
    pick = lambda: r.choice([*ids, "absent"])
    requires = [(pick(), pick()) for _ in range(12)]
    follows = [(i, pick()) for i in r.sample(ids, 18)]
    quotes = [(pick(), f"r{r.randrange(20)}") for _ in range(6)]
    evidence = [(pick(), f"r{r.randrange(20)}") for _ in range(20)]
    records = [(pick(), f"x{r.randrange(2)}", pick()) for _ in range(16)]
    frames = [spark.createDataFrame(rows, schema) for rows, schema in (
        (items, "id string, decision string, ref string, proposal string"), (requires, "id string, on string"), (follows, "id string, up string"),
        (quotes, "id string, ref string"), (evidence, "id string, ref string"), (records, "id string, record string, on string"),
    )]
    got = {x["id"]: x["decision"] for x in D.effective(*frames).collect()}
    assert got == loop(items, requires, follows, quotes, evidence, records)


def test_approving_a_cause_undoes_what_came_of_it(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    for first, last in (("rejected", "rejected"), ("approved", "pending")):
        items = spark.createDataFrame([("a", first, None, None)] + [(f"b{k}", "pending", None, None) for k in range(30)], "id string, decision string, ref string, proposal string")
        chain = spark.createDataFrame([("b0", "a")] + [(f"b{k}", f"b{k - 1}") for k in range(1, 30)], "id string, on string")
        got = {x["id"]: x["decision"] for x in D.effective(items, chain, none("id string, up string"), none("id string, ref string"), none("id string, ref string"), none("id string, record string, on string")).collect()}
        assert got["b29"] == last


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_changes_go_forward_and_back(spark):
    schema = "key int, status string, words int"
    a = spark.createDataFrame([(1, "active", 10), (2, "active", None), (3, None, 5)], schema)
    b = spark.createDataFrame([(1, "active", 10), (2, "forgotten", None), (4, "new", 7)], schema)
    c = spark.createDataFrame([(1, "active", 11), (2, "active", None), (4, "new", 7)], schema)
    one, two = D.changes(a, b), D.changes(b, c)
    key = lambda r: tuple((x is not None, x) for x in r)
    same = lambda x, y: sorted(map(key, x.collect())) == sorted(map(key, y.collect()))
    assert sorted(x["key"] for x in one.collect()) == [2, 3, 4]
    assert same(D.applied(a, one), b) and same(D.applied(b, D.inverse(one)), a)
    both = D.composed(one, two)
    assert same(D.applied(a, both), c) and same(D.applied(c, D.inverse(both)), a)
    assert sorted(x["key"] for x in both.collect()) == [1, 3, 4]  # what the second undid is left out
    assert D.composed(one, D.inverse(one)).isEmpty()
    assert D.conflicts(a, one).isEmpty() and sorted(x["key"] for x in D.conflicts(b, one).collect()) == [2, 3, 4]
    assert D.changes(a, a).isEmpty() and D.changes(a.limit(0), a.limit(0)).isEmpty()


def test_each_mutation_and_its_inverse(spark):
    table = spark.createDataFrame([(1, "active", 10), (2, "held", 20), (7, "active", 5)], "key int, status string, words int")
    some = spark.createDataFrame([(2,), (7,), (9,)], "key int")
    for change in (D.marked(table, some, {"status": F.lit("forgotten")}), D.removed(table, some), D.marked(table, some, {"words": F.col("words") * 2})):
        moved = D.applied(table, change)
        assert rows(moved) != rows(table) and rows(D.applied(moved, D.inverse(change))) == rows(table)
    gone = D.removed(table, some)
    assert rows(D.applied(table, gone)) == [(1, "active", 10)]
    assert D.next_id(D.applied(table, gone), [gone]) == 8  # ids of removed rows stay used
    assert D.next_id(table.limit(0), [gone.limit(0)]) == 1


def test_every_pair_of_patches(spark):
    """Two patches of one entry, in both orders, on a record that has the entry and on one that lacks it."""
    ops = [("set", "a"), ("set", "b"), ("force", "a"), ("force", "b"), ("remove", None), ("replace", None)]
    records, patches, want = [], [], {}
    for i, x in enumerate(ops):
        for j, y in enumerate(ops):
            for has in (0, 1):
                key = 100 * i + 10 * j + has
                records.append((key, "active", {"n": "old", "m": "kept"} if has else {"m": "kept"}, {}))
                patches += [(key, op, "profiles", None if op == "replace" else "n", v) for op, v in (x, y)]
                said = {x, y}
                forced = {v for op, v in said if op == "force"}
                old = "old" if has and ("replace", None) not in said else None
                clash = len(forced) > 1 or (forced and ("remove", None) in said)
                if clash:
                    value = old
                elif ("remove", None) in said:
                    value = None
                elif forced:
                    value = forced.pop()
                else:
                    sets = sorted(v for op, v in said if op == "set")
                    value = old or (sets[0] if sets else None)
                rest = {} if ("replace", None) in said else {"m": "kept"}
                want[key] = (rest | ({"n": value} if value else {}), ["profiles.n"] if clash else [])
    made = [(5000, "create", None, None, None), (5000, "set", "facets", "type", "note"), (0, "status", None, None, "held")]
    df = spark.createDataFrame(records, "key int, status string, profiles map<string,string>, facets map<string,string>")
    got = {x["key"]: x for x in D.merged(df, spark.createDataFrame(patches + made, "key int, op string, field string, name string, value string")).collect()}
    assert got[5000]["facets"] == {"type": "note"} and got[5000]["status"] == "active" and got[0]["status"] == "held" and len(got) == len(want) + 1
    for key, (profiles, stuck) in want.items():
        assert (got[key]["profiles"], got[key]["conflicts"]) == (profiles, stuck), key

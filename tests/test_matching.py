"""Drafts and published texts against a loop in which each text in turn takes the best draft that is left."""

import datetime as dt
import random

import pytest

from corpusloom.operators import align, matching

START = dt.datetime(2024, 1, 1)
WORDS = [f"word{k}" for k in range(60)]
SCHEMA = "profile string, id long, ts timestamp, text string"


def loop(drafts, texts):
    kinds = {}
    for p, i, ts, t in drafts:
        if t is not None:
            kinds.setdefault((p, t, ts), []).append(i)
    kinds = {k: sorted(v) for k, v in kinds.items()}
    first = {k: v[0] for k, v in kinds.items()}
    runs = lambda t: {tuple(w[i : i + 4]) for w in [align.TOKEN.findall(t.lower())] for i in range(len(w) - 3)}
    out = []
    for p, i, ts, t in sorted((x for x in texts if x[3] is not None), key=lambda x: (x[0], x[2], x[1])):
        best = []
        for k, left in kinds.items():
            if left and k[0] == p and ts <= k[2] + dt.timedelta(days=90) and runs(k[1]) & runs(t):
                s = align.share(k[1], t)
                if s >= 0.4:
                    best.append((-s, first[k], k))
        if best:
            s, _, k = min(best)
            out.append((p, kinds[k].pop(0), i, -s))
    return sorted(out)


def made(seed, n):
    r = random.Random(seed)
    drafts, texts = [], []
    for i in range(n):
        words = [r.choice(WORDS) for _ in range(r.randint(3, 60))]
        for _ in range(r.choice([1, 1, 1, 3])):
            drafts.append((r.choice("pq"), len(drafts), START + dt.timedelta(days=r.randint(0, 1)), " ".join(words)))
        for _ in range(r.randint(0, 3)):
            kept = [w for w in words if r.random() < r.choice([1.0, 0.8, 0.5])]
            at = r.randrange(len(kept) + 1)
            texts.append((r.choice("pq"), len(texts), START + dt.timedelta(days=r.choice([-3, 5, 30, 89, 90, 95])), " ".join(kept[:at] + [r.choice(WORDS) for _ in range(9)] + kept[at:])))
    return [*drafts, ("p", 900, START, None), ("p", 901, START, "")], [*texts, ("p", 900, START, None), ("p", 901, START, "")]


@pytest.mark.parametrize("seed", range(2))
def test_each_text_takes_the_best_draft_left(spark, seed):
    drafts, texts = made(seed, 25)
    got = matching.matched(spark.createDataFrame(drafts, SCHEMA).repartition(3), spark.createDataFrame(texts, SCHEMA).repartition(3)).collect()
    want = loop(drafts, texts)
    assert sorted((x["profile"], x["draft"], x["text_id"], round(x["share"], 6)) for x in got) == want and len(want) > 10
    assert len({(x["profile"], x["draft"]) for x in got}) == len({(x["profile"], x["text_id"]) for x in got}) == len(got)


def test_ten_thousand_drafts_of_one_writer_are_dealt_to_tasks(spark):
    """Copies settle by their number in one round, and unlike drafts meet their texts by the index alone."""
    drafts = [("w", i, START, f"draft number {i} says {i * 7} and then {i * 13} as nobody else {i * 17} does") for i in range(9000)] + [("w", 9000 + i, START, "one and the same draft text") for i in range(1000)]
    texts = [("w", i, START + dt.timedelta(days=1), drafts[i][3] + " and more") for i in range(0, 9000, 3)] + [("w", 9000 + i, START + dt.timedelta(days=2), "one and the same draft text") for i in range(1200)]
    got = {x["text_id"]: x["draft"] for x in matching.matched(spark.createDataFrame(drafts, SCHEMA).repartition(4), spark.createDataFrame(texts, SCHEMA).repartition(4)).collect()}
    assert got == {i: i for i in range(0, 9000, 3)} | {9000 + i: 9000 + i for i in range(1000)}

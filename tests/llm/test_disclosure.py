"""Terms that reveal protected values, recounted entity by entity and term by term."""

import math
import random
from collections import defaultdict

import regex

from corpusloom.llm import pii

WORDS = "the of and river stone Anna Bertram Castor delta Eleonora forest garden harbour island".split()


def recounted(rows, entities, support, threshold):
    """text -> {term: share}, by the docstring of the operator. entities: of each distinct text."""
    copies = defaultdict(int)
    for _, t in rows:
        copies[t] += 1
    total = len(rows)
    terms = {t: set(regex.findall(r"\p{L}[\p{L}\p{N}]{2,}+", t)) for t in copies}
    n_t, n_e, texts = defaultdict(int), defaultdict(int), defaultdict(set)
    for t, n in copies.items():
        for x in terms[t]:
            n_t[x] += n
        for e in entities[t]:
            n_e[e] += n
            texts[e].add(t)
    out = {}
    for e, where in texts.items():
        counts, held = defaultdict(int), defaultdict(int)
        for t in where:
            for x in terms[t]:
                counts[x] += copies[t]
                held[x] += 1
        parts = set(regex.split(r"[^\p{L}]+", e.removeprefix("email:").split("@")[0])) if e.startswith("email:") else set()
        for x in counts:
            spelled = len(x) >= 3 and x.lower() in parts
            if (len(where) >= support and held[x] >= support) or spelled:
                content = -math.log2(n_e[e] / total)
                share = math.log2(counts[x] * total / (n_e[e] * n_t[x])) / content if content > 0 else 0.0
                if share >= threshold:
                    for t in where:
                        if x in terms[t]:
                            out.setdefault(t, {})
                            out[t][x] = max(out[t].get(x, 0.0), share)
    return out


def pools(spans):
    out = set()
    for s in spans:
        plain = regex.sub("[^0-9]", "", s["value"]) if s["kind"] in ("card", "phone") else s["value"].lower()
        out.add(f"{s['kind']}:{plain}")
        if s["kind"] == "email":
            out.add("domain:" + plain.split("@")[1])
        elif s["kind"] == "ip":
            out.add("network:" + ".".join(plain.split(".")[:2]))
        else:
            out.add(f"issuer:{plain[:6]}" if s["kind"] == "card" else f"area:{plain[:4]}")
    return out


def test_recount(spark):
    r = random.Random(5)
    rows = []
    for k in range(120):
        own = r.choice(["acme.org", "corp.net", "mail.com", None, None])
        words = [r.choice(WORDS) for _ in range(25)]
        if own:
            words += [f"{r.choice(['anna.x', 'bertram', 'of.z', 'q'])}@{own}"] * r.randint(1, 2) + {"acme.org": ["Acmeworks"], "corp.net": ["Corporate", "stone"], "mail.com": []}[own]
        if r.random() < 0.2:
            words += [f"10.{r.randint(1, 2)}.0.{r.randint(1, 9)}", "Subnetz"]
        if r.random() < 0.2:
            words += ["+31 20 123 45" + str(r.randint(10, 12)), "Amsterdam"]
        rows.append((k, " ".join(r.sample(words, len(words)))))
    rows += [(200 + i, rows[3][1]) for i in range(4)]
    # many domains in the same few texts: they are alike, so they cost no more than one
    many = " ".join(f"x@d{i}.org" for i in range(150))
    rows += [(300 + i, f"{many} Zwillinge term{'abc'[i]} " + " ".join(f"w{j}" for j in range(150))) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    base = pii.with_base(df)
    by_id = {x["doc_id"]: pools(x["base"]) for x in base.collect()}
    entities = {t: by_id[k] for k, t in rows}
    found = pii.disclosures(df, base)
    text_of = {(x["tag"], x["len"]): x["text"] for x in df.select(*pii._key(df.text), "text").distinct().collect()}
    got = {text_of[x["tag"], x["len"]]: x["terms"] for x in found.collect()}
    want = recounted(rows, entities, pii.SUPPORT, pii.THRESHOLD)
    assert set(got) == set(want) and len(want) > 20
    for t, terms in want.items():
        assert set(got[t]) == set(terms) and all(abs(got[t][x] - s) < 1e-9 for x, s in terms.items())
    assert "Zwillinge" in got[rows[-1][1]] and any("Acmeworks" in x for x in got.values())

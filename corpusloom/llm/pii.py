"""Operator 10: personal data, by patterns and by information-theoretic sanitisation. DataFrame functions only.

Base: e-mail addresses, IP addresses, card numbers and phone numbers, by fixed patterns, leftmost and
without overlap for each kind; matches that fail their check are dropped and not tried again.

Method: every value found is a protected entity, and so is what several values have in common: the domain of
e-mail addresses, the network of IP addresses, the issuer of cards, the area of phone numbers. The corpus tells how much a term t reveals of an
entity e: the pointwise mutual information of t and e as a share of e's information content,
log2(p(e,t) / (p(e) p(t))) / -log2 p(e), with the probabilities estimated by rows that hold them. A term
whose share reaches `threshold`, in at least `support` different texts that hold the entity, is a
disclosure: wherever it stands in a text with that entity it is a span of kind `term`. Terms that reveal
nearly all (`remove` or more) are removed by `sanitised`, others are generalised to their class; the
base kinds are replaced by their names.

Of an entity in fewer than `support` different texts co-occurrence says nothing for itself: every rare word of
its text would reveal it. Its domain, network, issuer or area is counted instead, and of an e-mail address
also the terms of the text that its name part spells out, which need no support; common words among these
fall short of the threshold. All counts cover the whole corpus. Only texts that hold a disclosed entity are looked at again; they are joined by the text's
hash, so copies share one answer.

Defined cases: a null text is empty (and stays null in `sanitised`); repeated rows count as rows; ties do
not arise, as thresholds decide each term for itself; an empty table gives no rows; further columns pass
through `sanitised` untouched. Folds over spans work block by block, so long texts with many spans take
little more than linear time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, packed

SUPPORT = 3
THRESHOLD = 0.9
REMOVE = 0.99
#: rows of candidate terms that are still broadcast; beyond it the terms' counts are joined by shuffle
MAX_BROADCAST = 200_000

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns. \G or a look-behind keeps a search from starting again inside a run that has
#: failed, and possessive quantifiers from giving back; neither changes what matches.
LOCAL = "[A-Za-z0-9._%+-]"
LABEL = "[A-Za-z0-9-]++"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}(?:\.{LABEL})++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
TERM = r"\p{L}[\p{L}\p{N}]{2,}+"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    digits = _digits(m)
    n = F.length(digits)
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(digits)).otherwise(False)
    return n.between(9, 15)


def _may_hold(kind: str, text: Column) -> Column:
    """A cheap test that every text with a match of this kind passes."""
    if kind == "email":
        return text.contains("@")
    if kind == "phone":
        return text.contains("+")
    return text.rlike(r"[0-9]\.[0-9]" if kind == "ip" else r"(?:[0-9][\x20-]?){13}")


SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def _let(value: Column, body) -> Column:
    """`body` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _blocks(items: Column) -> Column:
    """An array in blocks of about the root of its length, so that a fold over each copies little."""
    size = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(items)))).cast("int")
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), size)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(items, i, size))


def _found(kind: str, pattern: str, text: Column, keep) -> Column:
    """Spans of the matches that `keep` accepts, in order; start and end count code points.

    What lies between the matches comes from a split at the same pattern, so lengths add up to positions.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)).alias("gap"), matches.alias("m"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["m"].alias("value"))
        return F.struct(end.alias("at"), F.when(keep(x["m"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def block(acc: Column, items: Column) -> Column:
        got = F.aggregate(items, F.struct(acc["at"].alias("at"), F.array().cast(SPAN).alias("out")), step)
        return _let(got, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
    return F.flatten(_let(pairs, lambda p: F.aggregate(_blocks(p), empty, block))["out"])


def _spliced(text: Column, spans: Column, value) -> Column:
    """The text with value(span, at) in the place of each span; spans are in order, `at` is where the last one ended.

    What a span shares with those before it is not written again. Each block of spans works on its own part of the text.
    """

    def block(acc: Column, items: Column) -> Column:
        upto = F.aggregate(items, acc["at"], lambda at, x: F.greatest(at, x["end"]))

        def within(end: Column) -> Column:
            part = F.substring(text, acc["at"] + 1, end - acc["at"])

            start = F.struct(acc["at"].alias("at"), F.lit("").alias("out"))
            done = _let(part, lambda part: F.aggregate(items, start, lambda a, x: step_on(part, a, x)))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(done["out"])).alias("out"))

        def step_on(part: Column, a: Column, x: Column) -> Column:
            gap = F.substring(part, a["at"] - acc["at"] + 1, F.greatest(F.lit(0), x["start"] - a["at"]))
            return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.concat(a["out"], gap, value(x, a["at"])).alias("out"))

        return _let(upto, within)

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = _let(spans, lambda x: F.aggregate(_blocks(x), empty, block))
    return _let(done, lambda d: F.concat(F.array_join(d["out"], ""), F.substring(text, d["at"] + 1, F.length(text))))


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end, value), by kind as in KINDS, then start."""
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast(SPAN)
    return F.concat(*[F.when(_may_hold(k, text), _found(k, PATTERNS[k], text, lambda m, k=k: _passes(k, m))).otherwise(none) for k in KINDS])


def _entity(span: Column) -> Column:
    """A value in one spelling."""
    plain = F.when(span["kind"].isin("card", "phone"), _digits(span["value"])).otherwise(F.lower(span["value"]))
    return F.concat_ws(":", span["kind"], plain)


def _key(text: Column) -> list[Column]:
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("tag"), F.length(text).alias("len")]


def with_base(docs: DataFrame) -> DataFrame:
    """doc_id, tag and len of the text, base (spans)."""
    return docs.select("doc_id", *_key(F.col("text")), base_spans(F.col("text")).alias("base"))


def _share(n_et: str, n_e: str, n_t: Column, total: float) -> Column:
    """Mutual information of a term and an entity as a share of the entity's information content."""
    content = -F.log2(F.col(n_e) / total)
    return F.when(content <= 0, 0.0).otherwise(F.log2(F.col(n_et) * total / (F.col(n_e) * n_t)) / content)


def _pools(e: Column) -> Column:
    """What an entity has in common with others: a domain, a network, an issuer or an area, and itself."""
    pools = [
        F.concat(F.lit("domain:"), F.regexp_extract(e, "^email:[^@]*@(.*)$", 1)),
        F.concat(F.lit("network:"), F.regexp_extract(e, r"^ip:([0-9]+\.[0-9]+)\.", 1)),
        F.concat(F.lit("issuer:"), F.regexp_extract(e, "^card:([0-9]{6})", 1)),
        F.concat(F.lit("area:"), F.regexp_extract(e, "^phone:([0-9]{4})", 1)),
    ]
    return F.filter(F.array(e, *pools), lambda p: ~p.rlike(":$"))


def _name_parts(e: Column) -> Column:
    """The words that an e-mail address spells out before its @ sign."""
    return F.array_distinct(F.filter(F.split(F.regexp_extract(e, "^email:([^@]*)@", 1), r"[^\p{L}]+"), lambda p: F.length(p) >= 3))


def disclosures(docs: DataFrame, base: DataFrame, support: int = SUPPORT, threshold: float = THRESHOLD) -> DataFrame | None:
    """tag, len and terms (term, share) of the texts that hold a disclosed entity; None if there are none.

    `base` comes from `with_base(docs)`. The share given is the largest over the text's entities.
    """
    entities = F.array_distinct(F.transform("base", _entity))
    held = base.where(F.size("base") > 0).select("tag", "len", F.explode(F.array_distinct(F.flatten(F.transform(entities, _pools)))).alias("e"))
    by_text = held.groupBy("e", "tag", "len").agg(F.count("*").alias("rows"))
    known = by_text.groupBy("e").agg(F.sum("rows").alias("n_e"), F.count("*").alias("texts"))
    where = checkpointed(by_text.join(known, "e").where((F.col("texts") >= support) | F.col("e").startswith("email:")))
    if where.isEmpty():
        return None
    tags = where.select("tag", "len").distinct()
    texts = docs.select(*_key(F.col("text")), F.coalesce("text", F.lit("")).alias("text"))
    # only texts with base data can be among them; one row of each
    near = texts.where(reduce(lambda a, b: a | b, [_may_hold(k, F.col("text")) for k in KINDS])).join(tags, ["tag", "len"], "left_semi")
    terms = checkpointed(near.select("tag", "len", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)))).alias("t")).distinct())
    sums = [F.sum("rows").alias("n_et"), F.count("*").alias("texts"), F.first("n_e").alias("n_e")]
    # entities that stand in the same texts, as often, reveal each other's terms alike: one of them is enough, so a text with very
    # many of them does not meet all its terms with each; and a term in fewer texts than `support` reveals nothing
    held = where.where(F.col("texts") >= support)
    marks = [F.bit_xor(F.xxhash64(F.lit(k), "tag", "len", "rows")).alias(f"mark{k}") for k in (0, 1)]
    alike = held.groupBy("e").agg(*marks, F.count("*").alias("texts")).groupBy("mark0", "mark1", "texts").agg(F.min("e").alias("e"))
    least = checkpointed(terms.groupBy("t").agg(F.count("*").alias("least_t")))
    often = held.drop("texts").join(alike.select("e"), "e", "left_semi").join(terms.join(least.where(F.col("least_t") >= support).select("t"), "t", "left_semi"), ["tag", "len"])
    often = often.groupBy("e", "t").agg(*sums).where(F.col("texts") >= support)
    # a term that the address itself spells out needs no further support
    spelled = where.select("e", "tag", "len", "rows", "n_e", F.explode(_name_parts(F.col("e"))).alias("part"))
    spelled = spelled.join(terms.withColumn("part", F.lower("t")), ["tag", "len", "part"]).groupBy("e", "t").agg(*sums)
    pairs = often.unionByName(spelled).groupBy("e", "t").agg(F.max("n_et").alias("n_et"), F.max("n_e").alias("n_e"))
    total = float(base.count())
    # n_t is at least the number of these texts that hold t; with that bound in its place the share is at least
    # the true one, so what falls short of the threshold (frequent words do) needs no count over the corpus
    pairs = pairs.join(least, "t").where(_share("n_et", "n_e", F.greatest("least_t", "n_et"), total) >= threshold)
    pairs = checkpointed(pairs.select("e", "t", "n_et", "n_e"))
    wanted = checkpointed(pairs.select("t").distinct())
    n_wanted = wanted.count()
    if not n_wanted:
        return None
    every = texts.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)))).alias("t"))
    if n_wanted <= MAX_BROADCAST:
        every = every.join(F.broadcast(wanted), "t", "left_semi")
    n_t = every.groupBy("t").agg(F.count("*").alias("n_t"))
    share = _share("n_et", "n_e", F.col("n_t"), total)
    revealing = pairs.join(n_t, "t").select("e", "t", share.alias("share")).where(F.col("share") >= threshold)
    found = where.select("e", "tag", "len").join(revealing, "e").join(terms, ["tag", "len", "t"])
    return found.groupBy("tag", "len", "t").agg(F.max("share").alias("share")).groupBy("tag", "len").agg(F.map_from_entries(F.collect_list(F.struct("t", "share"))).alias("terms"))


def _term_spans(text: Column, terms: Column, base: Column, remove: float) -> Column:
    """Spans of the terms outside the base spans, which are blanked before terms are looked for."""
    order = F.array_sort(F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    free = _spliced(text, order, lambda s, at: F.repeat(F.lit(" "), F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], at))))
    found = _found("term", TERM, free, lambda m: F.map_contains_key(terms, m))
    return F.transform(found, lambda s: s.withField("value", F.when(terms[s["value"]] >= remove, "").otherwise(F.when(s["value"].rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]"))))


def added_spans(docs: DataFrame, base: DataFrame, support: int = SUPPORT, threshold: float = THRESHOLD, remove: float = REMOVE) -> DataFrame | None:
    """tag, len, added: for each text with disclosing terms their spans; value is what replaces them."""
    terms = disclosures(docs, base, support, threshold)
    if terms is None:
        return None
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*_key(F.col("text")), text.alias("text")).where(reduce(lambda a, b: a | b, [_may_hold(k, F.col("text")) for k in KINDS]))
    # few megabytes, but heavy ones: dealt to a set number of tasks (not that of the join, or the planner leaves the rows
    # where they are and puts small partitions together)
    n = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = rows.join(terms, ["tag", "len"]).repartition(n, "tag", "len").groupBy("tag", "len").agg(F.first("text").alias("text"), F.first("terms").alias("terms"))
    return checkpointed(once.select("tag", "len", _term_spans(F.col("text"), F.col("terms"), base_spans(F.col("text")), remove).alias("added")))


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def personal_data(docs: DataFrame, support: int = SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256, spans, and n_term, for every document."""
    base = checkpointed(with_base(docs))
    added = added_spans(docs, base, support, threshold)
    none = F.array().cast(SPAN)
    rows = base.withColumn("added", none) if added is None else base.join(added, ["tag", "len"], "left").withColumn("added", F.coalesce("added", none))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select(
        "doc_id",
        *map(count, KINDS),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_term"),
    )


def sanitised(docs: DataFrame, support: int = SUPPORT, threshold: float = THRESHOLD, remove: float = REMOVE) -> DataFrame:
    """The rows and columns of `docs`, with every span replaced by its kind, its class or nothing."""
    base = checkpointed(with_base(docs))
    added = added_spans(docs, base, support, threshold, remove)
    rows = packed(docs).select("row", *_key(F.col("row.text")))
    none = F.array().cast(SPAN)
    rows = rows.withColumn("added", none) if added is None else rows.join(added, ["tag", "len"], "left").withColumn("added", F.coalesce("added", none))
    text = F.col("row.text")
    named = F.transform(base_spans(text), lambda s: s.withField("value", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
    order = F.array_sort(F.transform(F.concat(named, "added"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))))
    clean = F.when(F.size(order) == 0, text).otherwise(_spliced(text, order, lambda s, at: F.when(s["start"] >= at, s["value"]).otherwise("")))
    return rows.select(*[clean.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])

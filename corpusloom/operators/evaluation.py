"""Evaluation dataflows and small checks: agreement, win rates, bins, separation, sweeps, drift and drafts' lengths."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import packs
from ..functions import text as T
from . import ledger, ranks, style
from .check import stirling_rest
from .similarity import checkpointed

REPORT = "\n## Report"
#: Files that texts are read from.
LEARNABLE = ("md", "markdown", "txt", "docx", "pdf", "eml", "msg", "vtt", "srt")


def rank_agreement(arms: DataFrame) -> DataFrame:
    """agreement and pairs: the share of pairs of arms (type, a, b) that both scores put in one order.

    A pair is counted from the side of the arm that comes first by name; arms are few (a score for each).
    """
    x, y = arms.alias("x"), arms.alias("y")
    same = (F.col("x.a") < F.col("y.a")) == (F.col("x.b") < F.col("y.b"))
    pairs = x.join(y, F.col("x.type") < F.col("y.type")).select(same.cast("double").alias("same"))
    return pairs.agg(F.round(F.avg("same"), 6).alias("agreement"), F.count("*").alias("pairs"))


def win_rate_bins(answers: DataFrame, width: int = 20) -> DataFrame:
    """bin, n, win_rate: wins by how probable it was (p from 0 to 100) that the reader knew the text."""
    b = F.least(F.floor(F.col("p") / width), F.lit(100 // width - 1)).alias("bin")
    return answers.groupBy(b).agg(F.count("*").alias("n"), F.round(F.avg(F.col("won").cast("double")), 6).alias("win_rate"))


def binomial_tail(k: Column, n: Column) -> Column:
    """P(X >= k) for n fair tosses, summed from logarithms.

    What lies further than 20 square roots of n from the middle has a probability below 1e-300, so it does not change a double:
    the terms grow with the square root of n, and each is had at once.
    """
    k, n = k.cast("long"), n.cast("long")
    reach = F.ceil(F.sqrt(n) * 20)
    low, high = F.greatest(k, F.floor(n / 2) - reach), F.least(n, F.ceil(n / 2) + reach)
    half = n / 2

    def term(i: Column) -> Column:
        j = n - i
        apart = i * F.log(i / half) + j * F.log(j / half)
        inner = F.log(n / (i * j.cast("double") * (2 * math.pi))) / 2 + stirling_rest(n) - stirling_rest(i) - stirling_rest(j) - apart
        return F.exp(F.when((i == 0) | (j == 0), n * F.lit(-math.log(2))).otherwise(inner))

    terms = F.transform(F.sequence(low, F.greatest(low, high)), term)
    return F.when(k <= 0, 1.0).when(low > high, 0.0).otherwise(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x))


def win_rates(answers: DataFrame, by: str, win: str) -> DataFrame:
    """by, n, ties, rate, p: wins count 1, ties one half; p is the exact two-sided sign test without ties."""
    g = answers.groupBy(by).agg(
        F.count("*").alias("n"), F.count_if(F.col(win) == 0.5).alias("ties"), F.count_if(F.col(win) == 1).alias("w"), F.round(F.avg(win), 6).alias("rate")
    )
    m = (F.col("n") - F.col("ties")).cast("int")
    p = F.least(F.lit(1.0), 2 * binomial_tail(F.greatest(F.col("w").cast("int"), m - F.col("w").cast("int")), m))
    return g.select(by, "n", "ties", "rate", F.round(p, 6).alias("p"))


def cluster_interval(rows: DataFrame, cluster: str, win: str, n_boot: int = 4000, seed: int = 7, share: float = 0.95) -> DataFrame:
    """rate, low, high, clusters, n: the share of wins and an interval of it from drawing whole clusters again and again.

    Wins are summed by cluster first, so a draw is a row of two numbers: the replicate's k-th draw is the cluster whose
    number, in the order of names, is the hash of seed, replicate and k modulo their count. low and high are order
    statistics of the `n_boot` replicates. No rows give one row without values.
    """
    sums = checkpointed(rows.groupBy(F.col(cluster).cast("string").alias("name")).agg(F.sum(win).alias("w"), F.count("*").alias("n")))
    count = sums.count()
    if not count:
        return sums.agg(*[F.lit(None).cast("double").alias(c) for c in ("rate", "low", "high")], F.count("*").alias("clusters"), F.count("*").alias("n"))
    placed = ranks.numbered(sums, [], ["name"], "place").select(F.col("place").cast("long").alias("place"), "w", "n")
    draws = rows.sparkSession.range(n_boot * count).select(F.floor(F.col("id") / count).alias("b"), (F.col("id") % count).alias("k"))
    digest = F.md5(F.concat(F.lit(f"{seed}/"), F.col("b").cast("string"), F.lit("/"), F.col("k").cast("string")))
    drawn = draws.select("b", (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % count + 1).alias("place"))
    rates = drawn.join(placed, "place").groupBy("b").agg((F.sum("w") / F.sum("n")).alias("r"))
    # as many values as replicates were asked for, however many clusters there are
    of = rates.agg(F.sort_array(F.collect_list("r")).alias("r"))
    low = int((1 - share) / 2 * n_boot)
    at = [F.element_at("r", i + 1) for i in (low, max(low, int((1 + share) / 2 * n_boot) - 1))]
    total = sums.agg((F.sum("w") / F.sum("n")).alias("rate"), F.count("*").alias("clusters"), F.sum("n").alias("n")).first()
    whole = [F.lit(float(total["rate"])), F.lit(total["clusters"]).cast("long"), F.lit(total["n"]).cast("long")]
    return of.select(F.round(whole[0], 6).alias("rate"), F.round(at[0], 6).alias("low"), F.round(at[1], 6).alias("high"), whole[1].alias("clusters"), whole[2].alias("n"))


def pooled(rows: DataFrame, passed: DataFrame, wins: list[str], level: float = 0.05) -> DataFrame:
    """group, n, p_<win> of each win, all_runs and passes, over the runs of an evaluation.

    rows: run, id, text, group, recognised and a boolean for each win. A passage that comes again, in any run, counts in the first
    one only, as repeats are not independent; recognised ones are not counted but do use up their text. p is the
    one-sided binomial tail. passed: run, group, passed. A group passes if all its runs did and every p is below `level`.
    """
    said = F.sha2(T.squeeze(F.lower(T.strip(F.coalesce("text", F.lit(""))))), 256)
    keyed = rows.select(said.alias("said"), F.struct("run", "id", "group", "recognised", *wins).alias("x"))
    first = keyed.groupBy("said").agg(F.min("x").alias("x")).select("x.*").where("not recognised")
    g = first.groupBy("group").agg(F.count("*").alias("n"), *[F.count_if(F.col(w)).alias(w) for w in wins])
    runs = passed.groupBy("group").agg(F.min(F.col("passed")).alias("all_runs"))
    p = [F.round(binomial_tail(F.col(w).cast("int"), F.col("n").cast("int")), 6).alias(f"p_{w}") for w in wins]
    out = g.join(runs, "group", "left").select("group", "n", *p, F.coalesce("all_runs", F.lit(False)).alias("all_runs"))
    good = [F.col(f"p_{w}") < level for w in wins]
    return out.withColumn("passes", reduce(lambda a, b: a & b, good, F.col("all_runs")))


def separation(pairs: DataFrame, least: float = 1.25, agree: float = 0.8) -> DataFrame:
    """author, ratio, up, n, separates: pairs (author, before, after) whose mean ratio leaves 1 either way and that mostly agree."""
    r = F.col("after") / F.col("before")
    g = pairs.groupBy("author").agg(F.avg(r).alias("r"), F.count_if(r > 1).alias("up"), F.count("*").alias("n"))
    far = (F.col("r") >= least) & (F.col("up") >= agree * F.col("n")) | (F.col("r") <= 1 / least) & (F.col("n") - F.col("up") >= agree * F.col("n"))
    return g.select("author", F.round("r", 6).alias("ratio"), "up", "n", far.alias("separates"))


def without_own(rows: DataFrame, by: str, value: str) -> DataFrame:
    """key, others: the mean of the group's other rows, from sums."""
    g = rows.groupBy(by).agg(F.sum(value).alias("s"), F.count("*").alias("c")).where("c > 1")
    return rows.join(g, by).select("key", F.round((F.col("s") - F.col(value)) / (F.col("c") - 1), 6).alias("others"))


def sweep(distances: DataFrame, by: list[str], factors: list[float]) -> DataFrame:
    """k, flagged, n: outliers at thresholds of k deviations above the median of their group of five texts or more."""
    n = distances.groupBy(*by).agg(F.count("*").alias("c")).where("c >= 5")
    rows = checkpointed(distances.join(ranks.quantiles(distances, by, "distance", {"m": 0.5}).join(n, by), by).withColumn("off", F.abs(F.col("distance") - F.col("m"))))
    mad = ranks.quantiles(rows, by, "off", {"mad": 0.5})
    over = [F.count_if(F.col("distance") > F.greatest(F.col("m") + k * 1.4826 * F.col("mad"), 1.5 * F.col("m"))).alias(f"k{i}") for i, k in enumerate(factors)]
    wide = rows.join(mad, by).agg(F.count("*").alias("n"), *over)
    return wide.select(F.inline(F.array(*[F.struct(F.lit(float(k)).alias("k"), F.col(f"k{i}").alias("flagged"), F.col("n")) for i, k in enumerate(factors)])))


def detector_shift(scores: DataFrame, by: str) -> DataFrame:
    """by, own_mean, other_max, shift: a detector's scores of a writer's own texts and of the others."""
    own = F.when(F.col("own"), F.col("score"))
    g = scores.groupBy(by).agg(F.avg(own).alias("own_mean"), F.avg(F.when(~F.col("own"), F.col("score"))).alias("o"), F.max(F.when(~F.col("own"), F.col("score"))).alias("other_max"))
    return g.select(by, F.round("own_mean", 6).alias("own_mean"), "other_max", F.round(F.col("own_mean") - F.col("o"), 6).alias("shift"))


def screened(answers: DataFrame, most: float = 30) -> DataFrame:
    """author, probability: authors whose texts are hardly known, by the mean of the answers."""
    g = answers.groupBy("author").agg(F.avg("p").alias("p")).where(F.col("p") < most)
    return g.select("author", F.round("p", 6).alias("probability"))


def scaled(answers: DataFrame) -> DataFrame:
    """answer, choice, percent: positive probabilities of an answer scaled to 100."""
    total = answers.groupBy("answer").agg(F.sum("p").alias("total"))
    return answers.where("p > 0").join(total, "answer").select("answer", "choice", F.round(F.col("p") * 100 / F.col("total"), 5).alias("percent"))


def _ring(names: DataFrame, name: str, seed: str) -> DataFrame:
    """name, place (from 0) and total: the names on a ring in the order of a hash of seed and name."""
    drawn = names.select(name).distinct().withColumn("_h", F.md5(F.concat(F.lit(f"{seed}/"), F.col(name))))
    total = drawn.count()  # one number
    return ranks.numbered(drawn, [], ["_h", name], "place").select(name, (F.col("place") - 1).cast("long").alias("place"), F.lit(total).cast("long").alias("total"))


def distractors(names: DataFrame, name: str, n: int, seed: str = "d") -> DataFrame:
    """name, other, rn: each name with the n names that follow it on the seed's ring (all others, where there are fewer).

    Neighbours are met by their places, so n rows a name are made, whatever the number of names.
    """
    ring = checkpointed(_ring(names, name, seed))
    asked = ring.select(name, "total", "place", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("rn")).where("rn < total")
    other = ring.select(F.col(name).alias("other"), F.col("place").alias("at"))
    return asked.withColumn("at", (F.col("place") + F.col("rn")) % F.col("total")).join(other, "at").select(name, "other", "rn")


def recognition(passages: DataFrame, pool: DataFrame, n: int, seed: str = "r") -> DataFrame:
    """ask, key, truth, candidates: one forced choice for each passage (key, author), under numbers that tell nothing.

    A passage's candidates are its author and n - 1 others of the pool (n others, where the author is null or not in it),
    in the order of names; which others, the hash of seed and key decides: they stand behind its place on the ring.
    """
    ring = checkpointed(_ring(pool, "author", seed))
    digest = F.md5(F.concat(F.lit(f"{seed}/"), F.col("key").cast("string")))
    place = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")
    total = ring.count()
    asked = ranks.numbered(passages.select("key", "author", digest.alias("_h"), place.alias("_p")), [], ["_h", "key"], "ask")
    # one place more than is needed, as one of them may be the author's own
    each = asked.select("ask", "key", "author", "_p", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("step")).where(F.col("step") < total)
    met = each.withColumn("place", (F.col("_p") + F.col("step")) % max(total, 1)).join(ring.select(F.col("author").alias("other"), "place"), "place").where(~F.col("other").eqNullSafe(F.col("author")))
    known = passages.select("author").distinct().join(pool.select("author").distinct(), "author").withColumn("known", F.lit(True))
    listed = met.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("step", "other"))).alias("o"))
    rows = asked.join(listed, "key", "left").join(known, "author", "left")
    more = F.transform(F.slice(F.coalesce("o", F.array().cast(listed.schema["o"].dataType)), F.lit(1), n - F.when(F.col("known"), 1).otherwise(0)), lambda x: x["other"])
    both = F.when(F.col("known"), F.concat(more, F.array("author"))).otherwise(more)
    return rows.select(F.col("ask").cast("long").alias("ask"), "key", F.when(F.col("known"), F.col("author")).otherwise("none").alias("truth"), F.array_sort(both).alias("candidates"))


def judged_twice(packets: DataFrame, group: str, n: int, seed: str = "s") -> DataFrame:
    """key, kind: a seeded sample of n packets of the group, each to be judged blind and once with the name told."""
    drawn = ledger.top(packets.where(F.col("group") == group).withColumn("_h", F.md5(F.concat(F.lit(f"{seed}/"), F.col("key").cast("string")))).withColumn("_one", F.lit(1)), ["_one"], ["_h", "key"], n)
    return drawn.select("key", F.explode(F.array(F.lit("blind"), F.lit("named"))).alias("kind"))


def length_check(drafts: DataFrame, off: float = 0.15) -> DataFrame:
    """key, fits: drafts within 15 % of the words they should have."""
    return drafts.select("key", F.col("words").between((1 - off) * F.col("target"), (1 + off) * F.col("target")).alias("fits"))


def without_report(text: Column) -> Column:
    """The text up to the first report behind it."""
    return F.substring_index(text, REPORT, 1)


def scored(rows: DataFrame, sets: list[list[str]], flag: str) -> DataFrame:
    """The sets' columns, n and flagged, once for each set of columns; columns of other sets are null."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    parts = [
        rows.groupBy(*s).agg(F.count("*").alias("n"), F.sum(flag).alias("flagged")).select(*[F.col(c) if c in s else F.lit(None).cast("string").alias(c) for c in names], "n", "flagged") for s in sets
    ]
    return reduce(DataFrame.unionByName, parts)


def slices(lines: DataFrame, book: str, title: str, line: str) -> DataFrame:
    """book, title, line, until_line: each piece of a book from the last line that names it to the next piece."""
    from pyspark.sql import Window

    last = lines.groupBy(book, title).agg(F.max(line).alias("line"))
    return last.select(book, title, "line", F.lead("line").over(Window.partitionBy(book).orderBy("line")).alias("until_line"))


def outside_both(value: Column, a: Column, b: Column) -> Column:
    """Outside the band of the target and, more widely, that of the slot."""
    return ((value > 1.5 * a) | (value < 0.5 * a)) & ((value > 1.8 * b) | (value < 0.4 * b))


def fail_count(n: Column, percent: int = 28) -> Column:
    """Flags from which a check fails: a share of the metrics, at least two, at most all."""
    return F.least(n, F.greatest(F.lit(2), F.ceil(percent * n / 100))).cast("long")


def mismatch(slot: Column, found: Column, words: Column, least: int = 20) -> Column:
    """A text of enough words in another language than its slot's."""
    return (words >= least) & (found != slot)


def learnable(path: Column) -> Column:
    return path.rlike(rf"(?i)\.(?:{'|'.join(LEARNABLE)})$") & ~path.rlike(r"(?:^|/)(?:\.|node_modules/)")


def pack_caveats(langs: DataFrame) -> DataFrame:
    """lang, caveat: what a writer of the language should know about its pack."""
    known = list(packs.OPENERS)
    caveat = F.when(F.col("lang") == "en", F.lit(None).cast("string")).when(F.col("lang").isin(*known), "the thresholds were calibrated on English").otherwise("no language pack")
    return langs.select("lang", caveat.alias("caveat"))


def pack_listing(spark: SparkSession) -> DataFrame:
    """lang, metrics, hedges, openers: what each pack has; metrics that count a missing list do not apply."""
    lists = {"hedges_per_1k": packs.HEDGES, "conjunction_opener_share": packs.OPENERS, "contractions_per_1k": packs.CONTRACTIONS}
    langs = sorted(set().union(*lists.values()))
    size = lambda x: len(x or ())
    rows = [(c, len(packs.METRICS) - sum(c not in v for v in lists.values()), size(packs.HEDGES.get(c)), size(packs.OPENERS.get(c))) for c in langs]
    return spark.createDataFrame(rows, "lang string, metrics long, hedges long, openers long")


def primary(flags: DataFrame, n: int) -> DataFrame:
    """metric, flagged, rank: the metrics flagged most often; ties by name."""
    g = flags.groupBy("metric").agg(F.count_if(F.col("flag") != "ok").alias("flagged")).where("flagged > 0")
    order = [F.desc("flagged"), "metric"]
    return ledger.top(g.withColumn("one", F.lit(1)), ["one"], order, n, "rank").select("metric", "flagged", "rank")


def drift(got: DataFrame, slot: DataFrame, on: list[str], by: list[str]) -> DataFrame:
    """by, metric, drift: log ratio of each metric to the slot's, values under the floor raised to it."""
    rows = got.join(slot, [*on, "metric"]).join(style.metric_table(got.sparkSession).select("metric", "floor"), "metric")
    return rows.select(*by, "metric", F.round(F.log(F.greatest("value", "floor") / F.greatest("slot", "floor")), 5).alias("drift"))


def drift_trend(texts: DataFrame, held: DataFrame, by: str, orders: int = 10) -> DataFrame:
    """by, stage, mean_drift: how far held-out texts lie from 1/4, 1/2 and all of an author's texts, over seeded orders.

    Both have key, text, lang and `by`. Sums by text are drawn once; an order is a hash of its number and the key.
    """
    from pyspark.sql import Window

    sums = style.sums(texts).select("key", by, *style.SUMS)
    drawn = sums.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(orders)))).withColumn("h", F.md5(F.concat_ws("/", "k", "key")))
    n = texts.groupBy(by).agg(F.count("*").alias("n"))
    ranked = drawn.withColumn("rn", F.row_number().over(Window.partitionBy(by, "k").orderBy("h", "key"))).join(n, by)
    stages = F.array(*[F.struct(F.lit(i).alias("stage"), size.alias("size")) for i, size in enumerate((F.greatest(F.lit(2), F.floor(F.col("n") / 4)), F.floor(F.col("n") / 2), F.col("n")))])
    rows = ranked.withColumn("s", F.explode(stages)).where(F.col("rn") <= F.col("s.size")).withColumn("stage", F.col("s.stage"))
    got = style.melted(style.summed(rows, [by, "k", "stage"]).select(by, "k", "stage", *style.values().values()), [by, "k", "stage"])
    ref = style.melted(style.summed(style.sums(held), [by]).select(by, *style.values().values()), [by]).withColumnRenamed("value", "slot")
    per = drift(got, ref, [by], [by, "k", "stage"]).groupBy(by, "k", "stage").agg(F.avg(F.abs("drift")).alias("d"))
    return per.groupBy(by, "stage").agg(F.round(F.avg("d"), 4).alias("mean_drift"))


def rebanded(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """`new` bands in the place of `old` ones; an error if a slot's value is not what it was."""
    was = old.select(*by, "metric", F.col("value").alias("was"))
    same = F.assert_true(F.col("was").isNull() | (F.abs(F.col("value") - F.col("was")) < 1e-6), "a slot's value has changed")
    return new.join(was, [*by, "metric"], "left").where(same.isNull()).drop("was")


def correlated(rows: DataFrame, columns: list[str], most: float = 0.9) -> DataFrame:
    """a, b, r: pairs of columns whose correlation is stronger than `most`; of each such pair one may be left out. A column
    that does not vary correlates with none."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    both = [F.when(F.col(b).isNotNull(), F.col(a)) for a, b in pairs], [F.when(F.col(a).isNotNull(), F.col(b)) for a, b in pairs]
    wide = rows.agg(*[F.try_divide(F.covar_pop(a, b), F.stddev_pop(x) * F.stddev_pop(y)).alias(f"r{i}") for i, ((a, b), x, y) in enumerate(zip(pairs, *both, strict=True))])
    long = wide.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(f"r{i}", 5).alias("r")) for i, (a, b) in enumerate(pairs)])))
    return long.where(F.abs("r") > most)


def tone_pulls(names: list[str]) -> tuple[dict[str, tuple[int, str]], list[tuple[str, str, str]]]:
    """What a list of tones moves (metric to direction and tone), and the conflicts (metric, tone that decides, tone overruled).

    The tone named first decides.
    """
    pulls: dict[str, tuple[int, str]] = {}
    conflicts = []
    for tone in names:
        for metric, up in packs.TONES[tone].items():
            first = pulls.setdefault(metric, (up, tone))
            if first[0] != up:
                conflicts.append((metric, first[1], tone))
    return pulls, conflicts


def _low_words(text: str, stop: tuple = ()) -> Column:
    low = F.transform(T.words(F.coalesce(text, F.lit(""))), lambda w: F.lower(w))
    return F.filter(low, lambda w: ~w.isin(*stop)) if stop else low


def brief_check(pairs: DataFrame, stop: tuple, most: int = 60) -> DataFrame:
    """key, words, shared, ok: briefs (key, brief, text) that share no run of four words with their text, but for stop words,
    and keep within sixty words."""
    from .similarity import grams

    shared = F.size(F.array_intersect(grams(_low_words("brief", stop), 4), grams(_low_words("text", stop), 4)))
    rows = pairs.select("key", T.n_words(F.coalesce("brief", F.lit(""))).cast("long").alias("words"), shared.cast("long").alias("shared"))
    return rows.withColumn("ok", (F.col("shared") == 0) & (F.col("words") <= most))


def never_list(rewrites: DataFrame, corpus: DataFrame, stop: tuple, n: int = 15) -> DataFrame:
    """marker, texts: pairs and triples of words that rewrites share and the writer never uses, at most n.

    A marker stands in three rewrites and 30 % of them, is not made of stop words alone, and neither holds nor is held
    by one before it (most texts first, then by name). As each stands in a third of the rewrites, candidates are about as
    many as the words of a few texts, so they fit one row.
    """
    def runs(texts: DataFrame, size: int) -> DataFrame:
        from .similarity import grams

        return texts.select("key", F.explode(grams(_low_words("text"), size)).alias("g"))

    words = F.split("g", " ")
    seen = runs(rewrites, 2).union(runs(rewrites, 3)).where(F.exists(words, lambda w: ~w.isin(*stop))).groupBy("g").agg(F.count_distinct("key").alias("texts"))
    least = max(3, -(-3 * rewrites.count() // 10))
    used = runs(corpus, 2).union(runs(corpus, 3)).select("g")
    often = checkpointed(seen.where(F.col("texts") >= least))
    own = used.join(F.broadcast(often.select("g")), "g", "left_semi").distinct()
    left = often.join(own, "g", "left_anti").agg(F.array_sort(F.collect_list(F.struct((-F.col("texts")).alias("t"), "g"))).alias("c"))

    def step(out: Column, x: Column) -> Column:
        held = F.exists(out, lambda o: F.contains(o["g"], x["g"]) | F.contains(x["g"], o["g"]))
        return F.when(held | (F.size(out) >= n), out).otherwise(F.concat(out, F.array(x)))

    kept = F.aggregate("c", F.array().cast("array<struct<t:bigint,g:string>>"), step)
    return left.select(F.inline(kept)).select(F.col("g").alias("marker"), (-F.col("t")).alias("texts"))

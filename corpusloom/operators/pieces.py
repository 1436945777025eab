"""Pieces of texts: masks, normal forms, passages and chunks, what a brief rules out, and rates in words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

FRONT_LINES, SENTENCE_WORDS, EXCLUSIONS = 80, 25, 40
#: What a brief's label or heading says when it rules something out.
RULED_OUT = (
    r"(?iU)\b(?:do not use|don'?t use|claims? we (?:won'?t|will not|do not) make|"
    r"never (?:say|claim|use)|avoid|out of scope|not to use)\b"
)
#: Fixed value: the label or heading at the beginning of a line.
LABEL = r"^[-*\d.\s]*\**([^:*]{1,40})[:*]"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def prose_mask(text: Column) -> Column:
    """The text with all that is not the writer's prose blanked, line for line: a reference list to its end, lines of tables
    and block quotes, and long quotations (by as many blanks)."""

    def blanked(line: Column) -> Column:
        found = F.regexp_extract_all(line, F.lit(T.QUOTED), F.lit(0))
        kept = F.transform(found, lambda m: F.when(T.n_words(m) >= T.QUOTE_MIN_WORDS, F.repeat(F.lit(" "), F.length(m))).otherwise(m))
        return F.array_join(F.zip_with(F.split(line, T.QUOTED, -1), kept, lambda gap, m: F.concat(gap, F.coalesce(m, F.lit("")))), "")

    def masked(lines: Column) -> Column:
        ref = F.array_position(F.transform(lines, lambda x: T.strip(x).rlike("^#") & T.strip(x).rlike(T.REFERENCE_HEADING)), True)
        return F.array_join(F.transform(lines, lambda x, i: F.when((ref > 0) & (i + 1 >= ref) | T.strip(x).rlike(r"^[|>]"), "").otherwise(F.when(x.rlike('["“]'), blanked(x)).otherwise(x))), "\n")

    return T.once(_lines(text), masked)


def without_front_matter(text: Column) -> Column:
    """The text with the lines of a leading front matter block left blank, so that line numbers stay."""

    def cut(lines: Column) -> Column:
        end = F.array_position(F.transform(F.slice(lines, 2, FRONT_LINES - 1), lambda x: F.trim(x).isin("---", "...")), True).cast("int")
        blank = F.concat(F.array_repeat(F.lit(""), end + 1), F.slice(lines, end + 2, F.size(lines)))
        return F.when((F.trim(F.get(lines, F.lit(0))) == "---") & (end > 0), F.array_join(blank, "\n")).otherwise(F.array_join(lines, "\n"))

    return T.once(_lines(text), cut)


def folded(text: Column) -> Column:
    """Lower case, white space in one form."""
    return F.lower(F.trim(T.squeeze(text)))


def plain(text: Column) -> Column:
    """Without marks of Markdown and with straight quotes, folded: as quotes of a guide are compared."""
    return folded(F.regexp_replace(T.normal_quotes(text), r"[*_`#>\"']", ""))


def one_glyph(text: Column) -> Column:
    """Typographic signs in one form: dashes, quotes, ellipses and no-break spaces."""
    return F.regexp_replace(F.translate(T.normal_quotes(text), "–—‑ ", "--- "), "…", "...")


def exclusions(brief: Column, cap: int = EXCLUSIONS) -> Column:
    """Lines of a brief that rule something out: by their label, or because they stand under a heading that does."""
    start = F.struct(F.lit(False).alias("under"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        t = T.strip(line)
        out = acc["under"] | F.regexp_extract(t, LABEL, 1).rlike(RULED_OUT)
        text = F.struct(acc["under"].alias("under"), F.when(out & (t != ""), F.concat(acc["out"], F.array(t))).otherwise(acc["out"]).alias("out"))
        return F.when(t.startswith("#"), F.struct(t.rlike(RULED_OUT).alias("under"), acc["out"].alias("out"))).otherwise(text)

    return F.slice(F.aggregate(_lines(brief), start, step)["out"], 1, cap)


def sentence_at(text: Column, pattern: str) -> Column:
    """The first sentence with a match, cut to 25 words around it."""

    def cut(s: Column) -> Column:
        words = F.split(F.trim(s), " ")
        before = F.size(F.filter(F.split(F.regexp_extract(F.trim(s), rf"^(.*?)(?:{pattern})", 1), " "), lambda w: w != ""))
        lo = F.greatest(F.lit(0), F.least(before - SENTENCE_WORDS // 2, F.size(words) - SENTENCE_WORDS))
        return F.array_join(F.slice(words, lo + 1, F.lit(SENTENCE_WORDS)), " ")

    return T.once(F.get(F.filter(T.sentences(text), lambda s: s.rlike(pattern)), F.lit(0)), cut)


def _paragraphs(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n\n")


def paragraphs_in_range(text: Column, lo: int, hi: int) -> Column:
    return F.filter(_paragraphs(text), lambda p: T.n_words(p).between(lo, hi) & ~T.is_heading(p))


def passages(text: Column, lo: int, hi: int) -> Column:
    """Short paragraphs in a row joined to passages of lo to hi words; a heading or a longer paragraph ends one."""
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("cur"), F.lit(0).alias("n"), none.alias("out"))

    def state(cur: Column, n: Column, out: Column) -> Column:
        return F.struct(cur.alias("cur"), n.cast("int").alias("n"), out.alias("out"))

    def step(acc: Column, p: Column) -> Column:
        n = T.n_words(p)
        over = acc["n"] + n > hi
        cur = F.when(over, F.array(p)).otherwise(F.concat(acc["cur"], F.array(p)))
        total = F.when(over, n).otherwise(acc["n"] + n)
        full = state(none, F.lit(0), F.concat(acc["out"], F.array(F.array_join(cur, "\n\n"))))
        return F.when((T.strip(p) == "") | T.is_heading(p) | (n > hi), state(none, F.lit(0), acc["out"])).when(total >= lo, full).otherwise(state(cur, total, acc["out"]))

    return F.aggregate(_paragraphs(text), start, step)["out"]


def chunks(text: Column, size: int) -> Column:
    """Paragraphs joined until they have `size` words; the rest counts if it has 60 % of them."""
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("cur"), F.lit(0).alias("n"), none.alias("out"))

    def words(p: Column) -> Column:
        return F.size(F.filter(F.split(p, r"(?U)\s+"), lambda w: w != ""))

    def step(acc: Column, p: Column) -> Column:
        cur, n = F.concat(acc["cur"], F.array(p)), acc["n"] + words(p)
        full = F.struct(none.alias("cur"), F.lit(0).alias("n"), F.concat(acc["out"], F.array(F.array_join(cur, "\n\n"))).alias("out"))
        return F.when(n >= size, full).otherwise(F.struct(cur.alias("cur"), n.alias("n"), acc["out"].alias("out")))

    done = F.aggregate(_paragraphs(text), start, step)
    return T.once(done, lambda d: F.when((F.size(d["cur"]) > 0) & (d["n"] >= 0.6 * size), F.concat(d["out"], F.array(F.array_join(d["cur"], "\n\n")))).otherwise(d["out"]))


def described_rate(per_1k: Column) -> Column:
    """A rate in words."""
    every = 1000 / per_1k
    rounded = F.when(every >= 1000, F.bround(every, -2)).otherwise(F.bround(every, -1))
    return F.when(per_1k <= 0, "never").otherwise(F.concat(F.lit("about once every "), F.format_number(rounded, 0), F.lit(" words")))


def ebook_text(text: Column) -> Column:
    """The body of a public-domain e-book: without its header and footer, note marks and italics signs, lines joined to paragraphs."""
    body = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\r", ""), r"(?s)^.*?\*\*\* ?START OF[^\n]*\n|\*\*\* ?END OF.*$", "")
    bare = F.regexp_replace(F.regexp_replace(body, r"\[(?:\d+|[*†]|Footnote[^\]]*)\]", ""), r"(?<!\w)_([^_\n]+)_(?!\w)", "$1")
    parts = F.transform(F.split(bare, r"\n[ \t]*\n\s*"), lambda p: F.trim(T.squeeze(p)))
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")

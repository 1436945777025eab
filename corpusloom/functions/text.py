"""Scalar text functions as Column expressions; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A letter or a number sign that is no digit, then letters, apostrophes and hyphens; where sentences
#: end (before a capital or digit; closers may follow the stop and one opener may precede the capital); headings; quotations.
LETTER = r"\p{L}\p{No}\p{Nl}"
WORD = rf"[{LETTER}][{LETTER}'-]*"
SENTENCE_END = r"""(?<=[.!?])["')\]]* +(?=["'(\[]?(?:[A-Z0-9À-ÖØ-Þ]|[Ā-ԯ&&[\p{Lu}]]))"""
HEADING_END = r"""[.!?:;]["'”’)\]]*$"""
QUOTED = '“[^”\n]*”|"[^"\n]*"'
QUOTE_MIN_WORDS = 4
HEADING_WORDS = 12
#: Headings of a reference list.
REFERENCES = (
    "sources", "references", "bibliography", "further reading", "reading list", "works cited", "notes and sources", "footnotes",
    "bronnen", "literatuur", "bronvermelding", "quellen", "literatur",
)
REFERENCE_HEADING = rf"(?i)^[#*\s]*(?:{'|'.join(REFERENCES)})[*\s]*:?$"
PLACEHOLDER = r"(?i)\[[^\[\]\n]{0,120}?\bneeded\b[^\[\]\n]{0,120}?\]"
REPLY = r"(?i)^\s*(?:(?:re|fw|fwd|aw|antw|wg|sv|vs|tr)\s*(?:\[\d+\])?\s*:\s*)+"


def straight(c: Column) -> Column:
    """Curly apostrophes as straight ones, as words and blocks are read."""
    return F.translate(c, "’‘", "''")


def normal_quotes(c: Column) -> Column:
    """Curly quotes as straight ones and no-break spaces as spaces, as phrases and rules are counted."""
    return F.translate(c, "’‘“” ", "''\"\" ")


def words(c: Column) -> Column:
    return F.regexp_extract_all(straight(c), F.lit(WORD), F.lit(0))


def n_words(c: Column) -> Column:
    return F.regexp_count(straight(c), F.lit(WORD))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def sentences(c: Column) -> Column:
    return F.filter(F.split(squeeze(c), SENTENCE_END), lambda s: F.trim(s) != "")


def is_heading(block: Column) -> Column:
    b = strip(block)
    return ~b.contains("\n") & (n_words(b) < HEADING_WORDS) & ~b.rlike(HEADING_END)


def not_prose(block: Column) -> Column:
    """A table (every line starts with |) or a block quote (every line with >)."""
    lines = F.filter(F.split(block, "\n"), lambda x: strip(x) != "")

    def all_start(sign: str) -> Column:
        return F.forall(lines, lambda x: strip(x).startswith(sign))

    return (F.size(lines) > 0) & (all_start("|") | all_start(">"))


def blocks(text: Column) -> Column:
    """Array of (n, block, heading), without comments and front matter; n counts from 1."""
    t = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    t = straight(F.regexp_replace(t, r"(?s)^---.*?---", ""))
    found = F.filter(F.transform(F.split(t, r"\n\s*\n"), strip), lambda b: b != "")
    return F.transform(found, lambda b, i: F.struct((i + 1).alias("n"), b.alias("block"), is_heading(b).alias("heading")))


def once(value: Column, body) -> Column:
    """`body` of a value that is worked out once; an expression that is named twice is else worked out twice."""
    return F.get(F.transform(F.array(value), body), 0)


def unquoted(text: Column) -> Column:
    """The text without quotations of four words or more."""
    return F.when(text.rlike('["“]'), _unquoted(text)).otherwise(F.regexp_replace(text, "[ \t]{2,}", " "))


def _unquoted(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(QUOTED), F.lit(0))
    kept = F.transform(found, lambda m: F.when(n_words(m) >= QUOTE_MIN_WORDS, "").otherwise(m))
    joined = F.array_join(F.zip_with(F.split(text, QUOTED, -1), kept, lambda gap, m: F.concat(gap, F.coalesce(m, F.lit("")))), "")
    return F.regexp_replace(joined, "[ \t]{2,}", " ")


def prose_blocks(text: Column) -> Column:
    """`blocks` up to a reference list, without tables, block quotes and long quotations."""

    def mine(every: Column) -> Column:
        cut = F.array_position(F.transform(every, lambda b: b["heading"] & b["block"].rlike(REFERENCE_HEADING)), True)
        return F.when(cut > 0, F.slice(every, F.lit(1), F.greatest(cut.cast("int") - 1, F.lit(0)))).otherwise(every)

    prose = F.filter(once(blocks(text), mine), lambda b: ~(b["block"].rlike("^[|>]") & not_prose(b["block"])))
    clean = F.transform(prose, lambda b: b.withField("block", strip(unquoted(b["block"]))))
    return F.filter(clean, lambda b: b["block"].rlike(f"[{LETTER}]"))


def paragraphs(text: Column) -> Column:
    """Prose blocks that are no headings."""
    return F.transform(F.filter(prose_blocks(text), lambda b: ~b["heading"]), lambda b: b["block"])


def content_text(c: Column) -> Column:
    """White space in one form; Unicode form is up to the caller (see udfs.nfc)."""
    return F.trim(squeeze(c))


def thread_subject(c: Column) -> Column:
    return F.lower(F.trim(squeeze(F.regexp_replace(F.coalesce(c, F.lit("")), REPLY, ""))))


def url_key(c: Column) -> Column:
    """An address without scheme, www., fragment and closing slashes; the host in lower case."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), r"^[A-Za-z]+://", ""), r"#.*$", "")
    host, rest = F.lower(F.regexp_extract(bare, "^[^/]*", 0)), F.regexp_extract(bare, "^[^/]*(.*)$", 1)
    return F.regexp_replace(F.concat(F.regexp_replace(host, r"^www\.", ""), rest), "/+$", "")


def slot(*facets: Column) -> Column:
    return F.concat_ws(".", *[F.coalesce(f, F.lit("_")) for f in facets])

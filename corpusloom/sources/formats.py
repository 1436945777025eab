"""File formats as texts: Markdown, mail, Word, subtitles, feeds and web pages.

`read_files` lists a folder with Spark's binaryFile source and sends each row to its parser by extension;
parsers are plain functions over bytes, run in Arrow batches. .msg needs a library that is not here; such
rows come out with the flag that says so.
"""

from __future__ import annotations

import email
import email.policy
import html
import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pdf

EXTRACT = "path string, blocks array<string>, doc_date string, subject string, tags array<string>, flags array<string>"
GAP = 2.0


def glob_pattern(glob: str) -> str:
    """A glob as an anchored pattern: ** crosses folders, * and ? stay within a name."""
    out, rest = "", glob
    while rest:
        for sign, means in (("**/", "(?:[^/]*/)*"), ("**", ".*"), ("*", "[^/]*"), ("?", "[^/]")):
            if rest == "/**":
                out, rest = out + "(?:/.*)?", ""
                break
            if rest.startswith(sign):
                out, rest = out + means, rest[len(sign) :]
                break
        else:
            out, rest = out + re.sub(r"([\\.^$|+()\[\]{}])", r"\\\1", rest[0]), rest[1:]
    return f"^{out}$"


def markdown(raw: bytes) -> dict:
    """Blocks without code, quotes, embeds, footnotes, comments and number tables; date and tags from the front matter."""
    text = raw.decode("utf-8", "replace").replace("\r\n", "\n")
    front = re.match(r"---\n(.*?)\n---\n", text, re.DOTALL)
    meta = dict(re.findall(r"^(\w+):\s*(.*)$", front[1], re.MULTILINE)) if front else {}
    body = text[front.end() :] if front else text
    for pattern in (r"(?s)```.*?(?:```|\Z)", r"(?s)<!--.*?-->", r"(?m)^\[\^[^\]]+\]:.*$", r"!\[\[[^\]]*\]\]", r"!\[[^\]]*\]\([^)]*\)", r"\[\^[^\]]+\]"):
        body = re.sub(pattern, "", body)
    # a callout is marked like a quote, but what stands under its title line is the writer's own
    body = re.sub(r"(?m)^>\s*\[!\w+\][-+]?.*(?:\n|\Z)((?:>.*(?:\n|\Z))*)", lambda m: "\n" + re.sub(r"(?m)^>[ \t]?", "", m[1]) + "\n", body)
    body = re.sub(r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", r"\1", re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", body))
    blocks = []
    for part in re.split(r"\n\s*\n", body):
        lines = [x.strip() for x in part.split("\n") if x.strip()]
        if not lines or all(x.startswith(">") for x in lines):
            continue
        if all(x.startswith("|") for x in lines):
            cells = [c.strip() for x in lines for c in x.strip("|").split("|") if c.strip(" -:")]
            if sum(bool(re.fullmatch(r"[\d.,%€$ -]+", c)) for c in cells) * 2 > len(cells):
                continue
        blocks += [re.sub(r"^(?:[-*+]|\d+\.|#+)\s+", "", x) for x in lines] if all(re.match(r"(?:[-*+]|\d+\.)\s", x) for x in lines) else [re.sub(r"^#+\s+", "", " ".join(lines))]
    tags = re.findall(r"[\w/-]+", meta.get("tags", ""))
    return {"blocks": [re.sub(r"[*_`]{1,2}([^*_`]+)[*_`]{1,2}", r"\1", b) for b in blocks], "doc_date": meta.get("date"), "tags": tags}


def mail(raw: bytes) -> dict:
    """Blocks of a message without quotes, forwarded headers and signature; subject and date from the header."""
    msg = email.message_from_bytes(raw, policy=email.policy.default)
    part = msg.get_body(preferencelist=("plain", "html"))
    text = part.get_content() if part else ""
    if part is not None and part.get_content_type() == "text/html":
        text = html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"(?i)<(?:br|/p|/div)[^>]*>", "\n\n", text)))
    kept = []
    for line in text.replace("\r\n", "\n").split("\n"):
        if re.match(r"^-- ?$", line) or re.match(r"^(?:-----Original Message-----|_{10,}|From:\s.+@)", line):
            break
        if not line.lstrip().startswith(">") and not re.match(r"^On .+ wrote:\s*$", line):
            kept.append(line)
    blocks = [" ".join(b.split()) for b in re.split(r"\n\s*\n", "\n".join(kept)) if b.strip()]
    date = msg["date"].datetime.date().isoformat() if msg["date"] is not None and msg["date"].datetime else None
    return {"blocks": blocks, "doc_date": date, "subject": msg["subject"]}


def docx(raw: bytes) -> dict:
    """Paragraphs with insertions and without deletions or moves; the date of creation."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
        core = z.read("docProps/core.xml").decode("utf-8", "replace") if "docProps/core.xml" in z.namelist() else ""

    for parent in list(body.iter()):  # what was deleted or moved away is no text
        for child in [c for c in parent if c.tag in (w + "del", w + "moveFrom")]:
            parent.remove(child)
    signs = {w + "t": None, w + "tab": " ", w + "br": " "}
    texts = ("".join((n.text or "") if signs[n.tag] is None else signs[n.tag] for n in p.iter() if n.tag in signs) for p in body.iter(w + "p"))
    date = re.search(r"<dcterms:created[^>]*>(\d{4}-\d{2}-\d{2})", core)
    return {"blocks": [b for t in texts if (b := " ".join(t.split()))], "doc_date": date[1] if date else None}


def _seconds(stamp: str) -> float:
    total = 0.0
    for part in stamp.replace(",", ".").split(":"):
        total = total * 60 + float(part)
    return total


def transcript(raw: bytes) -> dict:
    """Paragraphs of subtitles: a new one when the speaker changes or after a pause of two seconds."""
    cues = []
    for block in re.split(r"\n\s*\n", raw.decode("utf-8", "replace").replace("\r\n", "\n")):
        m = re.search(r"([\d:.,]+)\s+-->\s+([\d:.,]+)[^\n]*\n(.*)", block, re.DOTALL)
        if m:
            said = re.match(r"\s*(?:<v ([^>]+)>|([A-Z][\w .'-]{0,40}):\s)?(.*)", m[3], re.DOTALL)
            cues.append((_seconds(m[1]), _seconds(m[2]), said[1] or said[2], " ".join(re.sub(r"<[^>]+>", "", said[3]).split())))
    blocks, last = [], None
    for start, end, speaker, text in cues:
        if last is None or (speaker or last[1]) != last[1] or start - last[0] >= GAP:
            blocks.append(text)
        else:
            blocks[-1] += " " + text
        last = (end, speaker or (last[1] if last else None))
    speakers = {c[2] for c in cues if c[2]}
    return {"blocks": blocks, "flags": ["several speakers"] if len(speakers) > 1 else []}


def feed(raw: bytes) -> list[tuple[str, str | None]]:
    """(address, date) of a sitemap, sitemap index, RSS or Atom file."""
    root = ElementTree.fromstring(raw)
    local = lambda x: x.tag.rsplit("}", 1)[-1]
    out = []
    for node in root.iter():
        if local(node) in ("url", "sitemap", "item", "entry"):
            found = {local(c): (c.get("href") or c.text or "").strip() for c in node}
            out.append((found.get("loc") or found.get("link") or "", found.get("lastmod") or found.get("pubDate") or found.get("updated") or found.get("published")))
    return [x for x in out if x[0]]


PARSERS = {"md": markdown, "markdown": markdown, "eml": mail, "docx": docx, "pdf": pdf.read, "vtt": transcript, "srt": transcript}


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for path, content in zip(b["path"], b["content"], strict=True):
            row = {"path": path, "blocks": [], "doc_date": None, "subject": None, "tags": [], "flags": []}
            parser = PARSERS.get(path.rsplit(".", 1)[-1].lower())
            try:
                row |= parser(bytes(content)) if parser else {"flags": ["skipped: not prose"]}
            except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                row["flags"] = [f"unreadable: {type(e).__name__}"]
            out.append(row)
        yield pd.DataFrame(out)


def read_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """EXTRACT for every file under a folder; hidden folders are left out before any content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return files.where(~F.col("path").rlike(r"/(?:\.[^/]+|node_modules|_to_delete)/|\.tmp$")).select("path", "content").mapInPandas(_parse, EXTRACT)


#: Elements that are no prose, and those that begin and end a paragraph.
DROPPED = ("script", "style", "noscript", "nav", "header", "footer", "aside", "form", "svg", "template", "title", "pre")
BREAKS = (
    "p", "div", "section", "article", "main", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "tr", "table", "br", "hr", "figure", "figcaption", "dd", "dt",
)
SCOPES = ("article", "main", "body")


class _Paragraphs(HTMLParser):
    """The paragraphs of a page, and for each scope from where to where it goes (first start to last end)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.done: list[str] = []
        self.now: list[str] = []
        self.dropped: list[str] = []
        self.starts: dict[str, int] = {}
        self.ends: dict[str, int] = {}

    def flush(self) -> None:
        text = " ".join("".join(self.now).split())
        self.now.clear()
        if text:
            self.done.append(text)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i)

    def handle_starttag(self, tag: str, attrs) -> None:
        if self.dropped:
            self.dropped += [tag] if tag == self.dropped[0] else []
        elif tag in DROPPED:
            self.dropped.append(tag)
            self.now.append(" ")
        else:
            if tag in BREAKS or tag == "body":
                self.flush()
            if tag in SCOPES:
                self.starts.setdefault(tag, len(self.done))

    def handle_endtag(self, tag: str) -> None:
        if self.dropped:
            if tag == self.dropped[0]:
                self.dropped.pop()
        else:
            if tag in BREAKS or tag == "body":
                self.flush()
            if tag in SCOPES:
                self.ends[tag] = len(self.done)

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.now.append(data)


def paragraphs_of(page: str | None) -> list[str]:
    """Paragraphs of the first article, main or body that is closed, else of the whole page."""
    parser = _Paragraphs()
    parser.feed(page or "")
    parser.close()
    parser.flush()
    scope = next((x for x in SCOPES if x in parser.starts and parser.ends.get(x, -1) >= parser.starts[x]), None)
    return parser.done[parser.starts[scope] : parser.ends[scope]] if scope else parser.done


@F.pandas_udf(T.StringType())
def page_text(pages: pd.Series) -> pd.Series:
    """The main text of pages, with blank lines between its paragraphs."""
    return pages.map(lambda x: "\n\n".join(paragraphs_of(x if isinstance(x, str) else None)))


def page_date(page: Column) -> Column:
    """The day of article:published_time (its attributes in any order), else of the first time element; ISO dates only."""
    stamp = r"""["'](\d{4}-\d{2}-\d{2})"""
    name = r"""property\s*=\s*["']article:published_time["']"""
    found = [rf"<meta[^>]+{name}[^>]+content\s*=\s*{stamp}", rf"<meta[^>]+content\s*=\s*{stamp}[^>]+{name}", rf"<time[^>]+datetime\s*=\s*{stamp}"]
    return F.coalesce(*[F.nullif(F.regexp_extract(page, "(?i)" + p, 1), F.lit("")) for p in found])


def joined_paragraphs(paragraphs: list[str]) -> list[str]:
    """Paragraphs that a page break has cut are put together: no stop at the end, a small letter at the beginning."""
    out: list[str] = []
    for p in paragraphs:
        if out and p[:1].islower() and not re.search(r"""[.!?:;]["'”’)\]]*$""", out[-1]):
            out[-1] = out[-1][:-1] + p if re.search(r"\w-$", out[-1]) else out[-1] + " " + p
        else:
            out.append(p)
    return out


def wiki_text(pages: Column) -> Column:
    """Main text of wiki pages: paragraphs from the first of ten words to the last that ends a sentence, cuts of page breaks mended."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        def one(page: str | None) -> str:
            paras = joined_paragraphs(paragraphs_of(page))
            first = next((i for i, p in enumerate(paras) if len(p.split()) >= 10), len(paras))
            last = next((i for i in range(len(paras) - 1, -1, -1) if re.search(r"""[.!?]["'”’)\]]*$""", paras[i])), -1)
            return "\n\n".join(paras[first : last + 1])

        return texts.map(lambda x: one(x if isinstance(x, str) else None))

    return run(pages)

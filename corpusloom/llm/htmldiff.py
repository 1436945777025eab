"""Operator 4: main text of web pages by nearest-URL page differencing.

A page is read into blocks: the text between block-level tags, with entities decoded and white space
collapsed. Blocks in regions that never hold the article (head, script, style, nav, header, footer, aside,
form, dialog, and elements whose class or id names advertising, menus, notices, sidebars or readers'
comments) are marked and never part of the text.

Pages of a host are put in order of their path. A page's partner is the nearest one by URL: of the two
pages before it and the two behind it that with the longest common prefix of paths (then the nearer one,
then the one before). A page that shares over half of the unmarked blocks of the shorter of the two is a
copy and no partner, as it would take the article away. The unmarked blocks of both pages are aligned by
their longest common subsequence, and the lines that they share are deleted, in article elements and outside
them; only a line that stands in an article element of both pages is a passage of two articles, and stays.

Only addresses and the hashes of the blocks are put in order. Every row gets its rank over all pages, and
runs of `RUN` ranks, with the rows next to them, are compared in one task; so neither the size of a host
nor the number of partitions changes a partner. Pages of a host with the same html are compared once.

Defined cases: a null or empty html gives an empty text; pages without an address in their URL (null,
empty or equal URLs included) are ordered by hash within one host; pages without a partner are only freed
from marked blocks; repeated rows and ties get the same result each; markup that is no HTML is text or
comment; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, ranked

#: ranks that are compared in one task, and how far a partner may be away on either side
RUN, REACH = 2048, 2
#: pages with deleted lines that are still broadcast; beyond it that join shuffles
MAX_BROADCAST = 50_000
#: bits of the tables of one alignment that are kept at a time
TABLE_BITS = 1 << 28

#: HTML elements by what they mean for the text.
SKIPPED = frozenset("head script style template noscript iframe object svg canvas select textarea button nav header footer aside form dialog menu".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: skipped elements that stand within a line; what they hold goes, and the block around them goes on
SILENT = SKIPPED - BLOCKS
#: elements that end the one of their kind before them
ENDING = frozenset("p li td th tr dt dd option".split())
NAMES = (
    r"ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|header|masthead|menu|nav\w*|newsletter|notices?"
    r"|popup|promo\w*|related|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget"
)
MARKED = re.compile(rf"(?:^|[\s_-])(?:{NAMES})(?:$|[\s_-])", re.IGNORECASE)
#: within an article a name counts as a whole, or with what makes it a container; names of the text's own topics do not
MARKED_INSIDE = re.compile(
    rf"(?:^|\s)(?:{NAMES})(?:[_-](?:area|banner|bar|block|box|buttons?|container|form|items?|links?|list|notice|section|slot|unit|widget|wrap(?:per)?))*(?:$|\s)", re.IGNORECASE
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu".split())
SPACE = re.compile(r"\s+")

Block = tuple[str, bool, bool]


class _Blocks(HTMLParser):
    """Collects (text, marked, in article) of every block; elements that are left open end with their parent."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.open: list[tuple[str, bool, bool]] = []
        self.names: Counter[str] = Counter()
        self.nested: list[str] = []  # the open block-level elements
        self.marked = self.inside = self.silent = 0
        self.text: list[str] = []

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i)

    def _end_block(self) -> None:
        text = SPACE.sub(" ", "".join(self.text)).strip()
        self.text.clear()
        if text:
            self.blocks.append((text, self.marked > self.silent, self.inside > 0))

    def _close(self, name: str) -> None:
        """Close the innermost open element of this name and all within it."""
        if not self.names[name]:
            return
        while True:
            tag, marked, article = self.open.pop()
            self.names[tag] -= 1
            self.marked -= marked
            self.inside -= article
            self.silent -= tag in SILENT
            if tag in BLOCKS:
                self.nested.pop()
            if tag == name:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS and not (self.silent and tag == "option"):
            self._end_block()
        if tag in VOID:
            return
        if tag in ENDING and self.nested:
            last = self.nested[-1]
            if last == tag or tag == "p" and last in ("h1", "h2", "h3", "h4", "h5", "h6"):
                self._close(last)
        values = dict(attrs)
        named = f"{values.get('class') or ''} {values.get('id') or ''}"
        by_name = tag not in ("html", "body", "article", "main") and bool((MARKED_INSIDE if self.inside else MARKED).search(named))
        by_tag = tag in SKIPPED and not (tag == "header" and self.inside)  # the header of an article holds its title
        marked = by_tag or by_name or "hidden" in values or values.get("role") in ROLES
        article = (tag in ("article", "main") or values.get("role") in ("main", "article")) and not self.marked
        self.open.append((tag, marked, article))
        self.names[tag] += 1
        self.marked += marked
        self.inside += article
        self.silent += tag in SILENT
        if tag in BLOCKS:
            self.nested.append(tag)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._end_block()

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS and not (self.silent and tag == "option"):
            self._end_block()
        self._close(tag)

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.text.append(data)


def blocks_of(html: str | None) -> list[Block]:
    """(text, marked, in article) of every block, in page order."""
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser._end_block()
    return parser.blocks


def _rows(a: list, masks: dict, width: int) -> Iterator[int]:
    """For each prefix of `a` the bit vector whose zeros are the places of b where the common length grows."""
    full = (1 << width) - 1
    v = full
    for x in a:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _masks(b: list) -> dict:
    out: dict = {}
    for j, x in enumerate(b):
        out[x] = out.get(x, 0) | 1 << j
    return out


def _lengths(a: list, b: list) -> np.ndarray:
    """Common lengths of all of `a` with every prefix of `b`."""
    v = (1 << len(b)) - 1
    for v in _rows(a, _masks(b), len(b)):
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common_subsequence(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of positions of a longest common subsequence, by bit vectors; memory stays within TABLE_BITS."""
    lo, ha, hb = 0, len(a), len(b)
    while lo < ha and lo < hb and a[lo] == b[lo]:
        lo += 1
    while ha > lo and hb > lo and a[ha - 1] == b[hb - 1]:
        ha, hb = ha - 1, hb - 1
    ends = [(i, i) for i in range(lo)], [(ha + k, hb + k) for k in range(len(a) - ha)]
    return ends[0] + [(lo + i, lo + j) for i, j in _middle(a[lo:ha], b[lo:hb])] + ends[1]


def _middle(a: list, b: list) -> list[tuple[int, int]]:
    if not a or not b:
        return []
    if len(a) * len(b) > TABLE_BITS and len(a) > 1:  # halve `a` where both halves do best
        half = len(a) // 2
        at = int((_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
        return _middle(a[:half], b[:at]) + [(half + i, at + j) for i, j in _middle(a[half:], b[at:])]
    rows = [(1 << len(b)) - 1, *_rows(a, _masks(b), len(b))]
    i, j, out = len(a), len(b), []
    while i and j:
        bit = 1 << j - 1
        if rows[i] & bit:
            j -= 1
        elif not rows[i - 1] & bit:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def deleted(own: list[tuple], other: list[tuple]) -> list[int]:
    """Positions of own blocks (key, marked, in article) that the partner shares; marked blocks of either are gone already."""
    a, b = ([i for i, (_, marked, _) in enumerate(x) if not marked] for x in (own, other))
    pairs = common_subsequence([own[i][0] for i in a], [other[j][0] for j in b])
    return [a[i] for i, j in pairs if not (own[a[i]][2] and other[b[j]][2])]


def is_copy(own: list[tuple], other: list[tuple]) -> bool:
    """Whether over half of the unmarked blocks of the shorter page are the other's too."""
    a, b = Counter(k for k, m, _ in own if not m), Counter(k for k, m, _ in other if not m)
    return 2 * (a & b).total() > min(a.total(), b.total())


def main_text(blocks: list[Block], gone: set[int] | frozenset[int] = frozenset()) -> str:
    """The blocks that are left once marked and deleted ones are gone."""
    return "\n\n".join([t for i, (t, marked, _) in enumerate(blocks) if not marked and i not in gone])


def prefix(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def partner(pages: list[tuple], at: int) -> int | None:
    """Index of the partner of pages[at] among its neighbours; pages are (host, path, blocks) in order."""
    host, path, own = pages[at]
    near = [k for k in range(max(0, at - REACH), min(len(pages), at + REACH + 1)) if k != at and pages[k][0] == host]
    near.sort(key=lambda k: (-prefix(pages[k][1], path), abs(k - at), k))
    return next((k for k in near if not is_copy(own, pages[k][2])), None)


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        keys, kinds = [], []
        for html in b["html"]:
            blocks = blocks_of(html)
            keys.append(np.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t, _, _ in blocks], dtype=np.uint64).view(np.int64))
            kinds.append(bytes(m + 2 * a for _, m, a in blocks))
        yield b[["host", "path", "tag", "size"]].assign(keys=keys, kinds=kinds)


def _deletions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by run and rank; a run and its border rows are held at a time."""

    def done(run: int, rows: list[tuple]) -> pd.DataFrame:
        pages = [(r[2], r[3], [(k, bool(f & 1), bool(f & 2)) for k, f in zip(r[6].tolist(), r[7], strict=True)]) for r in rows]
        out = []
        for at, r in enumerate(rows):
            if r[1] // RUN == run and (k := partner(pages, at)) is not None and (gone := deleted(pages[at][2], pages[k][2])):
                out.append((r[2], r[4], r[5], gone))
        return pd.DataFrame(out, columns=["host", "tag", "size", "gone"])

    now, held = None, []
    for b in batches:
        for row in zip(*(b[c] for c in ("run", "rank", "host", "path", "tag", "size", "keys", "kinds")), strict=True):
            if row[0] != now:
                if held:
                    yield done(now, held)
                now, held = row[0], []
            held.append(row)
    if held:
        yield done(now, held)


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        texts = [main_text(blocks_of(h), set() if gone is None else set(gone.tolist())) for h, gone in zip(b["html"], b["gone"], strict=True)]
        yield b[["page_id", "url"]].assign(text=texts, n_chars=np.array([len(t) for t in texts], dtype=np.int64))


def _address() -> list[Column]:
    """host and path of the URL; tag and size tell html apart."""
    found = F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)", 0)
    host = F.lower(F.regexp_replace(F.regexp_extract(found, r"//([^/?#]*)", 1), r"^www\.", ""))
    return [host.alias("host"), F.regexp_extract(found, r"//[^/?#]*([^?#]*)", 1).alias("path"), F.xxhash64("html").alias("tag"), F.length("html").alias("size")]


def shared_lines(pages: DataFrame) -> DataFrame:
    """host, tag, size and gone: which unmarked blocks of a page its partner shares; only pages with any."""
    seen = pages.select(*_address(), "html").where("html <> ''")
    hashed = seen.mapInPandas(_hashed, "host string, path string, tag long, size int, keys array<long>, kinds binary")
    once = hashed.groupBy("host", "tag", "size").agg(F.min("path").alias("path"), F.any_value("keys").alias("keys"), F.any_value("kinds").alias("kinds"))
    rows = ranked(once, "host", "path", "tag", "size")
    runs = F.array_distinct(F.transform(F.array(F.lit(0), F.lit(-REACH), F.lit(REACH)), lambda d: F.floor((F.col("rank") + d) / RUN)))
    dealt = rows.withColumn("run", F.explode(runs)).repartition("run").sortWithinPartitions("run", "rank")
    found = dealt.select("run", "rank", "host", "path", "tag", "size", "keys", "kinds").mapInPandas(_deletions, "host string, tag long, size int, gone array<int>")
    return checkpointed(found)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    gone = shared_lines(pages)
    if gone.count() <= MAX_BROADCAST:
        gone = F.broadcast(gone)
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", "url", "html", *_address()).join(gone, ["host", "tag", "size"], "left").select("page_id", "url", "html", "gone")
    return rows.mapInPandas(_extract, f"page_id {kind}, url string, text string, n_chars long")

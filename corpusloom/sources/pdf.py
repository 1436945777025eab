"""Text of PDF files by the standard library: content streams (plain or deflated) of fonts with one-byte codes.

Files that need more (encryption, other filters, fonts that only a character map can read) come out with pages
without text, which the flags name.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.DOTALL)
STREAM = re.compile(rb"(.*?)\bstream\r?\n(.*?)\r?\n?endstream", re.DOTALL)
REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R")
TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+[0-9]?", re.DOTALL)
ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r?\n|.)", re.DOTALL)
NAMED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
PAGE_NUMBER = re.compile(r"^(?:page\s+)?[-–(]?\s*\d{1,4}\s*[-–)]?(?:\s*(?:/|of)\s*\d{1,4})?$", re.IGNORECASE)


def _stream(body: bytes) -> bytes:
    m = STREAM.search(body)
    if not m:
        return b""
    if b"/FlateDecode" in m[1]:
        try:
            return zlib.decompressobj().decompress(m[2])
        except zlib.error:
            return b""
    return b"" if b"/Filter" in m[1] else m[2]


def _objects(raw: bytes) -> dict[int, bytes]:
    out = {int(n): body for n, body in OBJECT.findall(raw)}
    for body in list(out.values()):
        if b"/ObjStm" in body and (first := re.search(rb"/First\s+(\d+)", body)):
            data, at = _stream(body), int(first[1])
            heads = list(map(int, data[:at].split()))
            places = [*heads[1::2], len(data)]
            out |= {n: data[at + places[k] : at + places[k + 1]] for k, n in enumerate(heads[::2])}
    return out


def _pages(objects: dict[int, bytes]) -> list[bytes]:
    """The content of each page, in the order of the page tree."""
    out: list[bytes] = []
    seen: set[int] = set()

    def walk(n: int) -> None:
        body = objects.get(n, b"")
        if n in seen:
            return
        seen.add(n)
        if kids := re.search(rb"/Kids\s*\[(.*?)\]", body, re.DOTALL):
            for kid in REFERENCE.findall(kids[1]):
                walk(int(kid))
        elif re.search(rb"/Type\s*/Page\b", body):
            m = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", body, re.DOTALL)
            out.append(b"\n".join(_stream(objects.get(int(r), b"")) for r in REFERENCE.findall(m[1])) if m else b"")

    for n, body in objects.items():
        if re.search(rb"/Type\s*/Pages\b", body) and b"/Parent" not in body:
            walk(n)
    return out


def _string(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        data = ESCAPE.sub(lambda m: NAMED.get(m[1], b"" if m[1][-1:] == b"\n" else bytes([int(m[1], 8) & 255]) if m[1].isdigit() else m[1]), token[1:-1])
    return data.decode("utf-16") if data[:2] in (b"\xfe\xff", b"\xff\xfe") else data.decode("cp1252", "replace")


def lines(content: bytes) -> list[tuple[float, str]]:
    """(height on the page, text) of every line."""
    out: list[tuple[float, str]] = []
    stack: list = []
    y = leading = 0.0
    inside = False

    def show(text: str) -> None:
        if out and abs(out[-1][0] - y) < 1:
            out[-1] = (out[-1][0], out[-1][1] + text)
        else:
            out.append((y, text))

    for token in TOKEN.findall(content):
        if token[:1] in b"(<[]/" or token[-1:].isdigit() and not token[:1].isalpha():
            stack.append(token)
            continue
        op = token.decode("latin-1")
        numbers = [float(x) for x in stack if x[:1] not in b"(<[]/"]
        if op == "BT":
            inside, y = True, 0.0
        elif op == "ET":
            inside = False
        elif op in ("Td", "TD") and len(numbers) >= 2:
            y += numbers[-1]
            leading = -numbers[-1] if op == "TD" else leading
        elif op == "Tm" and len(numbers) >= 6:
            y = numbers[-1]
        elif op == "TL" and numbers:
            leading = numbers[-1]
        elif op in ("T*", "'", '"'):
            y -= leading
        if inside and op in ("Tj", "TJ", "'", '"'):
            parts = []
            for x in stack:
                if x[:1] in b"(<":
                    parts.append(_string(x))
                elif op == "TJ" and x[:1] not in b"[]/" and float(x) < -200:  # a wide gap is a blank
                    parts.append(" ")
            show("".join(parts))
        stack.clear()
    return [(h, " ".join(t.split())) for h, t in out if t.strip()]


def read(raw: bytes) -> dict:
    """Blocks without page numbers and lines repeated on half of three pages or more; words cut at line ends joined; the
    day of creation; flags for pages without text."""
    if raw[:5] != b"%PDF-":
        raise ValueError("no PDF header")
    pages = [lines(p) for p in _pages(_objects(raw))]
    often = Counter(t for p in pages for t in {t for _, t in p})
    drop = {t for t, n in often.items() if len(pages) >= 3 and 2 * n >= len(pages)}
    blocks: list[str] = []
    for page in pages:
        kept = [(h, t) for h, t in page if t not in drop and not PAGE_NUMBER.match(t)]
        gaps = sorted(a[0] - b[0] for a, b in zip(kept, kept[1:]) if a[0] > b[0])
        usual = gaps[len(gaps) // 2] if gaps else 0.0
        last = None
        for h, t in kept:
            if last is None or not 0 <= last - h <= 1.4 * usual:
                blocks.append(t)
            elif re.search(r"\w-$", blocks[-1]) and t[:1].islower():
                blocks[-1] = blocks[-1][:-1] + t
            else:
                blocks[-1] += " " + t
            last = h
    date = re.search(rb"/CreationDate\s*\(D:(\d{4})(\d{2})(\d{2})", raw)
    flags = [f"page {i} has no text" for i, p in enumerate(pages, 1) if not p]
    return {"blocks": blocks, "doc_date": b"-".join(date.groups()).decode() if date else None, "flags": flags or ([] if pages else ["no pages"])}

"""Text of PDF documents by their page tree and content streams, plain or deflated; no fonts are decoded."""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj\b", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_PAGE = re.compile(rb"/Type\s*/Page(?![A-Za-z])")
_SHOWN = re.compile(rb"\((?P<t>(?:\\.|[^\\()])*)\)\s*(?:Tj|'|\")|\[(?P<a>(?:\((?:\\.|[^\\()])*\)|[^\]])*)\]\s*TJ")
_INNER = re.compile(rb"\(((?:\\.|[^\\()])*)\)")


def _pages(content: bytes) -> list[tuple[bytes, dict[int, bytes]]]:
    objects = {int(m[1]): m[2] for m in _OBJECT.finditer(content)}
    return [(body, objects) for body in objects.values() if _PAGE.search(body.split(b"stream")[0])]


def _shown(page: bytes, objects: dict[int, bytes]) -> str:
    """The strings that a page's content streams show, a line each."""
    at = page.find(b"/Contents")
    refs = re.match(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", page[at:]) if at >= 0 else None
    parts = []
    for number in re.findall(rb"(\d+)\s+\d+\s+R", refs[1]) if refs else ():
        body = objects.get(int(number), b"")
        stream = _STREAM.search(body)
        raw = stream[1] if stream else b""
        if b"/FlateDecode" in body.split(b"stream")[0]:
            try:
                raw = zlib.decompress(raw)
            except zlib.error:
                continue
        for m in _SHOWN.finditer(raw):
            text = m["t"] if m["t"] is not None else b"".join(_INNER.findall(m["a"]))
            parts.append(re.sub(rb"\\([()\\])", rb"\1", text).decode("latin-1"))
    return "\n".join(parts)


def inspect(content: bytes) -> tuple[int, bool]:
    """The number of pages, and whether any of them shows a letter or digit; 0 pages if it can't be read."""
    pages = _pages(content)
    return len(pages), any(any(c.isalnum() for c in _shown(*p)) for p in pages)


def page_text(content: bytes, page: int) -> str:
    """Text of a page, from 0; a page of which no text can be read is an error and never empty."""
    pages = _pages(content)
    if not 0 <= page < len(pages):
        raise ValueError(f"page {page} is out of range: the document has {len(pages)}")
    text = _shown(*pages[page])
    if not any(c.isalnum() for c in text):
        raise ValueError(f"no text could be read of page {page}")
    return text


def make_pdf(pages: list[str], deflate: bool = True) -> bytes:
    """A small PDF of one line of text a page, for examples and tests."""
    bodies = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(pages), b" ".join(b"%d 0 R" % (3 + 2 * i) for i in range(len(pages))))]
    for i, text in enumerate(pages):
        shown = b"BT /F1 12 Tf (" + re.sub(r"([()\\])", r"\\\1", text).encode("latin-1", "replace") + b") Tj ET" if text else b""
        packed = zlib.compress(shown) if deflate else shown
        bodies.append(b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (4 + 2 * i))
        bodies.append(b"<< /Length %d%s >>\nstream\n" % (len(packed), b" /Filter /FlateDecode" if deflate else b"") + packed + b"\nendstream")
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, b) for i, b in enumerate(bodies, 1)) + b"%%EOF\n"

"""Text and metadata of HTML pages with the standard library's parser."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

# Elements whose text is not shown, and elements that begin a line.
HIDDEN = {"script", "style", "noscript", "svg", "head", "template", "iframe"}
LINES = {"p", "div", "section", "article", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "td", "figure", "header", "footer"}

_TITLE = re.compile(r"(?is)<title[^>]*>(.*?)</title>")
_META = re.compile(r"(?is)<meta\b([^>]*)>")
_ATTR = re.compile(r"""(?is)([a-z:_-]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
_ASSET = re.compile(r"""(?is)\b(?:src|poster)\s*=\s*["']([^"']+)["']|\bsrcset\s*=\s*["']([^"']+)["']|url\(\s*["']?([^"')]+)["']?\s*\)|@import\s+["']([^"']+)["']""")


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in HIDDEN:
            self.hidden += 1
        elif tag in LINES:
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in LINES:
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.out.append(data)


def text_of(page: str) -> str:
    """Visible text, one line per block, without empty lines; broken markup gives what could be read."""
    p = _Text()
    try:
        p.feed(page)
        p.close()
    except Exception:  # a page never stops a batch
        pass
    lines = (re.sub(r"[ \t\xa0]+", " ", x).strip() for x in "".join(p.out).split("\n"))
    return "\n".join(x for x in lines if x)


def metadata_of(page: str) -> dict[str, str]:
    """Title (that for sharing first), author and date, at most 120 characters each but the title."""
    metas = [{k.lower(): a or b for k, a, b in _ATTR.findall(m)} for m in _META.findall(page)]
    named = {(m.get("property") or m.get("name") or "").lower(): m.get("content", "") for m in reversed(metas)}
    found = {"title": named.get("og:title") or (t[1] if (t := _TITLE.search(page)) else ""), "author": (named.get("author") or named.get("article:author") or "")[:120], "date": (named.get("article:published_time") or named.get("date") or named.get("pubdate") or "")[:120]}
    return {k: html.unescape(v).strip() for k, v in found.items() if v and v.strip()}


def assets_of(page: str) -> list[str]:
    """Addresses of what a page loads, each once, in order."""
    out: list[str] = []
    for one, several, css, imported in _ASSET.findall(page):
        parts = [s.strip().split()[0] for s in several.split(",") if s.strip()] if several else [one or css or imported]
        out += [u for u in parts if u and not u.startswith("data:")]
    return list(dict.fromkeys(out))


def encoding_of(data: bytes, header: str | None = None) -> str:
    """Encoding of a page: its header, a byte order mark, its meta element, else the first that decodes it."""

    def decodes(name: str | None) -> bool:
        try:
            data.decode(name or "?")
        except (LookupError, UnicodeDecodeError):
            return False
        return True

    if header and decodes(header):
        return header.lower()
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return name
    m = re.search(rb"""(?i)charset\s*=\s*["']?([a-z0-9_-]+)""", data[:4096])
    if m and decodes(m[1].decode()):
        return m[1].decode().lower()
    return next((e for e in ("utf-8", "gb18030", "big5") if decodes(e)), "latin-1")

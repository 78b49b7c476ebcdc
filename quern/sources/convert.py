"""Files to Markdown: a registry of handlers by extension, run over ``binaryFile`` rows.

A handler gets bytes and the file's name and gives title and Markdown, or raises.
``convert`` turns whatever happens into a row, so one file never stops a batch.
"""

from __future__ import annotations

import csv
import email
import io
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from email import policy
from pathlib import PurePosixPath
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame

from quern.sources import html
from quern.sources.archive import Container, UnsafeArchive

MAX_CHARS, MAX_FILE = 4_000_000, 50 << 20
SHEET_ROWS, SHEET_COLUMNS, CSV_ROWS, XML_LINES = 800, 40, 3000, 4000

# Extensions by family.
PLAIN = ".txt .log .ini .cfg .conf .env .properties .gitignore"
MARKUP = ".md .markdown .mdown .rst .org .textile .adoc"
CODE = (
    ".py .pyw .js .mjs .cjs .ts .tsx .jsx .vue .svelte .java .kt .scala .groovy .c .h .cc .cpp .hpp .cxx .cs .go .rs .rb .php .swift .m .mm .dart .lua .pl "
    ".sh .bash .zsh .fish .ps1 .psm1 .bat .cmd .sql .r .jl .hs .erl .ex .exs .clj .cljs .el .nim .zig .asm .s .v .sv .vhd .tex .proto .graphql .dockerfile"
)
LANGUAGES = {"py": "python", "js": "javascript", "ts": "typescript", "sh": "bash", "bat": "batch", "cmd": "batch", "ps1": "powershell", "yml": "yaml", "rb": "ruby", "cs": "csharp", "cpp": "cpp", "h": "c"}
UNREADABLE = {"legacy office": ".doc .ppt .xls .wps .et .dps", "image": ".png .jpg .jpeg .gif .bmp .webp .tif .tiff .svg .heic", "audio or video": ".mp3 .wav .m4a .flac .ogg .mp4 .mkv .mov .avi .webm"}
# XML namespaces.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_OPF = "{http://www.idpf.org/2007/opf}"
_DC = "{http://purl.org/dc/elements/1.1/}"


class Unreadable(ValueError):
    """A file without text that could be had from it."""


@dataclass
class Converted:
    ok: bool
    markdown: str = ""
    title: str = ""
    kind: str = ""
    warnings: list[str] = field(default_factory=list)
    error: str = ""


@dataclass
class _File:
    data: bytes
    name: str
    warnings: list[str]

    @property
    def extension(self) -> str:
        return PurePosixPath(self.name).suffix.lower()

    @property
    def stem(self) -> str:
        stem = PurePosixPath(self.name).stem
        return re.sub(r"[_\-\s]+", " ", stem).strip() or stem

    def text(self) -> str:
        text, used = decode(self.data)
        if not used.startswith("utf-8"):
            self.warnings.append(f"decoded as {used}")
        return text


Handler = Callable[[_File], tuple[str, str]]
HANDLERS: dict[str, tuple[str, Handler]] = {}


def handles(kind: str, extensions: str) -> Callable[[Handler], Handler]:
    """Register a handler; users may add their own the same way."""

    def add(f: Handler) -> Handler:
        HANDLERS.update({e: (kind, f) for e in extensions.split()})
        return f

    return add


def decode(data: bytes) -> tuple[str, str]:
    """Text and the encoding used: a byte order mark, then the first of four that fits."""
    if data[:3] == b"\xef\xbb\xbf":
        return data[3:].decode("utf-8", "replace"), "utf-8-bom"
    for name in ("utf-8", "gb18030", "big5"):
        try:
            return data.decode(name), name
        except UnicodeDecodeError:
            pass
    return data.decode("latin-1"), "latin-1"


def fence(text: str, language: str = "") -> str:
    """A code block whose marks are longer than any in it."""
    longest = max((len(m) for m in re.findall("`{3,}", text)), default=2)
    bar = "`" * (longest + 1)
    body = text.rstrip("\n")
    return f"{bar}{language}\n{body}\n{bar}"


def grid(rows: list[list[str]]) -> str:
    """Rows as a Markdown table; the first is its head."""
    cell = lambda c: re.sub(r"\n", " ", (c or "").replace("|", "\\|")).strip()
    lines = ["| " + " | ".join(map(cell, r)) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join("---" for _ in rows[0]) + " |", *lines[1:]])


@handles("text", PLAIN)
def plain(f: _File) -> tuple[str, str]:
    return f.stem, f.text()


@handles("markdown", MARKUP)
def markup(f: _File) -> tuple[str, str]:
    return f.stem, f.text()


@handles("code", CODE)
def code(f: _File) -> tuple[str, str]:
    short = f.extension[1:]
    return f.stem, f"# {f.stem}\n\n{fence(f.text(), LANGUAGES.get(short, short))}"


@handles("json", ".json .jsonl .ndjson")
def json_file(f: _File) -> tuple[str, str]:
    text = f.text()
    nice = lambda o: json.dumps(o, ensure_ascii=False, indent=2)
    try:
        text = nice(json.loads(text)) if f.extension == ".json" else "\n".join(nice(json.loads(x)) for x in text.splitlines() if x.strip())
    except ValueError as e:
        f.warnings.append(f"not valid JSON, kept as it is ({e})")
    return f.stem, f"# {f.stem}\n\n{fence(text, 'json')}"


@handles("yaml", ".yaml .yml")
@handles("toml", ".toml")
def settings(f: _File) -> tuple[str, str]:
    return f.stem, f"# {f.stem}\n\n{fence(f.text(), 'toml' if f.extension == '.toml' else 'yaml')}"


@handles("xml", ".xml")
def xml(f: _File) -> tuple[str, str]:
    text = f.text()
    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        f.warnings.append(f"not well-formed, kept as it is ({e})")
        return f.stem, text
    short = lambda name: name.rsplit("}", 1)[-1]

    def outline() -> Iterator[str]:
        todo = [(root, 0)]
        while todo:
            e, depth = todo.pop()
            value = (e.text or "").strip()
            about = [f'{short(k)}="{v}"' for k, v in e.attrib.items()] + ([f"={value}"] if value else [])
            if about:
                yield "  " * depth + f"- `{short(e.tag)}` " + " ".join(about)
            todo += [(c, depth + 1) for c in reversed(e)]

    lines = [x for _, x in zip(range(XML_LINES), outline())]
    return f.stem, f"# {f.stem}\n\n" + "\n".join(lines)


@handles("csv", ".csv .tsv")
def separated(f: _File) -> tuple[str, str]:
    text = f.text()
    sep = "\t"
    if f.extension == ".csv":
        try:
            sep = csv.Sniffer().sniff("\n".join(text.splitlines()[:5]), delimiters=",;\t|").delimiter
        except csv.Error:
            sep = ","
    rows = [r for r in csv.reader(io.StringIO(text), delimiter=sep) if "".join(r).strip()]
    if not rows:
        raise Unreadable("no rows")
    width = max(map(len, rows))
    if len(rows) > CSV_ROWS:
        f.warnings.append(f"only the first {CSV_ROWS} rows")
    rows = [r + [""] * (width - len(r)) for r in rows[:CSV_ROWS]]
    return f.stem, f"# {f.stem}\n\n共 {len(rows) - 1} 行 × {width} 列\n\n{grid(rows)}"


@handles("subtitle", ".srt .vtt .ass .ssa .lrc")
def subtitle(f: _File) -> tuple[str, str]:
    drop = re.compile(r"(?i)^(?:\d+|WEBVTT.*|NOTE.*|STYLE.*|REGION.*|.*-->.*|(?:Dialogue|Comment):.*)$")
    lines = [x.strip() for x in f.text().splitlines()]
    kept = [re.sub(r"^\[\d+:\d+[^\]]*\]", "", x).strip() for x in lines if x and not drop.match(x)]
    return f.stem, f"# {f.stem}\n\n" + "\n".join(kept)


@handles("rtf", ".rtf")
def rtf(f: _File) -> tuple[str, str]:
    t = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: chr(int(m[1], 16)), f.text())
    t = re.sub(r"\\u(-?\d+)\s?\??", lambda m: chr(int(m[1]) % 65536), t)
    for word, by in ((r"\par", "\n"), (r"\line", "\n"), (r"\tab", "\t")):
        t = t.replace(word, by)
    t = re.sub(r"\\[a-zA-Z]+-?\d*\s?|[{}]", "", t)
    f.warnings.append("styles are lost")
    return f.stem, re.sub(r"\n{3,}", "\n\n", t).strip()


def _page(page: str, f: _File) -> tuple[str, str]:
    body, meta = html.text_of(page), html.metadata_of(page)
    if not body.strip():
        raise Unreadable("no body text")
    title = meta.get("title") or f.stem
    head = f"# {title}\n" + (f"\n作者：{meta['author']}" if "author" in meta else "") + (f"　发布于：{meta['date']}" if "date" in meta else "")
    return title, f"{head}\n\n{body.strip()}"


@handles("html", ".html .htm .xhtml")
def web_page(f: _File) -> tuple[str, str]:
    return _page(f.data.decode(html.encoding_of(f.data), "replace"), f)


def _parts(data: bytes) -> tuple[email.message.EmailMessage, list[tuple[str, str]]]:
    m = email.message_from_bytes(data, policy=policy.default)
    parts = []
    for p in m.walk():
        if p.get_content_type() in ("text/plain", "text/html"):
            try:
                parts.append((p.get_content_type(), p.get_content()))
            except (LookupError, ValueError):
                continue
    return m, [(k, t) for k, t in parts if isinstance(t, str)]


@handles("mhtml", ".mhtml .mht")
def web_archive(f: _File) -> tuple[str, str]:
    _, parts = _parts(f.data)
    pages = [t for k, t in parts if k == "text/html"]
    if pages:
        return _page("\n".join(pages), f)
    if not parts:
        raise Unreadable("no readable part")
    return f.stem, "\n".join(t for _, t in parts)


@handles("eml", ".eml")
def mail(f: _File) -> tuple[str, str]:
    m, parts = _parts(f.data)
    if not any(t.strip() for _, t in parts):
        raise Unreadable("the mail has no text")
    kind, body = max(parts, key=lambda p: len(p[1]))
    subject = str(m["Subject"] or f.stem)
    if kind == "text/html":
        body = _page(body, f)[1]
    about = [f"- **{label}**：{m[key]}" for label, key in (("发件人", "From"), ("收件人", "To"), ("抄送", "Cc"), ("时间", "Date")) if m[key]]
    return subject, "\n".join([f"# {subject}", "", *about, ""]) + body.strip()


def _xml_in(c: Container, name: str) -> ET.Element | None:
    raw = c.read(name)
    try:
        return ET.fromstring(raw) if raw else None
    except ET.ParseError:
        return None


def _property(c: Container) -> str:
    root = _xml_in(c, "docProps/core.xml")
    values = [(root.findtext(f"{_DC}{k}") or "").strip() for k in ("title", "subject")] if root is not None else []
    return next((v for v in values if v), "")


def _heading_levels(c: Container) -> dict[str, int]:
    """Level of each style that is a heading by its name or by one it is based on, within 8 steps."""
    root = _xml_in(c, "word/styles.xml")
    named: dict[str, int] = {}
    based: dict[str, str] = {}
    for s in root.iter(f"{_W}style") if root is not None else ():
        key = s.get(f"{_W}styleId") or ""
        name = s.find(f"{_W}name")
        label = (name.get(f"{_W}val") if name is not None else "") or ""
        m = re.search(r"(?i)(?:heading|标题)\s*(\d)", label) or re.search(r"(?i)^heading(\d)$", key)
        if m:
            named[key] = min(6, int(m[1]))
        up = s.find(f"{_W}basedOn")
        if up is not None:
            based[key] = up.get(f"{_W}val") or ""
    out = {}
    for key in set(named) | set(based):
        at, steps = key, 0
        while at not in named and at in based and steps < 8:
            at, steps = based[at], steps + 1
        if at in named:
            out[key] = named[at]
    return out


@handles("docx", ".docx .docm .dotx .dotm")
def word(f: _File) -> tuple[str, str]:
    c = Container(f.data)
    root = _xml_in(c, "word/document.xml")
    body = root.find(f"{_W}body") if root is not None else None
    if body is None:
        raise Unreadable("no document part")
    levels = _heading_levels(c)
    words = lambda e: "".join((t.text or "") if t.tag == f"{_W}t" else "\n" if t.tag == f"{_W}br" else "\t" if t.tag == f"{_W}tab" else "" for t in e.iter()).strip()
    parts: list[tuple[str, bool]] = []
    for e in body:
        if e.tag == f"{_W}tbl":
            rows = [[words(cell) for cell in r.iter(f"{_W}tc")] for r in e.iter(f"{_W}tr")]
            width = max(map(len, rows), default=0)
            if width:
                parts.append((grid([r + [""] * (width - len(r)) for r in rows]), False))
        elif e.tag == f"{_W}p" and (text := words(e)):
            props = e.find(f"{_W}pPr")
            style = props.find(f"{_W}pStyle") if props is not None else None
            level = levels.get(style.get(f"{_W}val") or "", 0) if style is not None else 0
            listed = props is not None and props.find(f"{_W}numPr") is not None
            parts.append((f"{'#' * level} {text}" if level else f"- {text}" if listed else text, bool(level)))
    if not parts:
        raise Unreadable("no text")
    title = _property(c) or f.stem
    out = f"# {title}\n"
    for i, (text, _) in enumerate(parts):
        # A heading stays with the table right behind it.
        glued = i > 0 and parts[i - 1][1] and text.startswith("| ")
        out += ("\n" if glued else "\n\n") + text
    return title, out


@handles("pptx", ".pptx .pptm .potx")
def slides(f: _File) -> tuple[str, str]:
    c = Container(f.data)
    number = lambda n: int(re.search(r"(\d+)\.xml$", n)[1])  # type: ignore[index]

    def texts(folder: str) -> Iterator[tuple[int, list[str]]]:
        for i, n in enumerate(sorted((n for n in c.names if re.fullmatch(rf"ppt/{folder}\d+\.xml", n)), key=number), 1):
            root = _xml_in(c, n)
            if root is not None and (found := [s for t in root.iter(f"{_A}t") if (s := (t.text or "").strip())]):
                yield i, found

    out = []
    for i, found in texts("slides/slide"):
        head = found[0] if len(found[0]) <= 40 else f"第 {i} 页"
        out.append(f"## 第 {i} 页 · {head}" + ("\n\n" + "\n\n".join(found[1:]) if found[1:] else ""))
    out += [f"### 备注 {i}\n\n" + "\n".join(t) for i, found in texts("notesSlides/notesSlide") if (t := [x for x in found if not x.isdigit()])]
    if not out:
        raise Unreadable("no text on any slide")
    title = _property(c) or f.stem
    pages = sum(bool(re.fullmatch(r"ppt/slides/slide\d+\.xml", n)) for n in c.names)
    return title, f"# {title}\n\n共 {pages} 页\n\n" + "\n\n".join(out)


def column_of(ref: str) -> int:
    """Index from 0 of a cell reference's letters."""
    n = 0
    for ch in re.match("[A-Z]*", (ref or "").upper())[0]:  # type: ignore[index]
        n = n * 26 + ord(ch) - 64
    return max(0, n - 1)


@handles("xlsx", ".xlsx .xlsm .xltx")
def sheets(f: _File) -> tuple[str, str]:
    c = Container(f.data)
    strings = _xml_in(c, "xl/sharedStrings.xml")
    shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in strings.iter(f"{_S}si")] if strings is not None else []
    rels, book = _xml_in(c, "xl/_rels/workbook.xml.rels"), _xml_in(c, "xl/workbook.xml")
    if book is None:
        raise Unreadable("no workbook part")
    target = {r.get("Id"): (r.get("Target") or "").lstrip("/") for r in rels} if rels is not None else {}
    out = []
    for sheet in book.iter(f"{_S}sheet"):
        path = target.get(sheet.get(f"{_R}id"), "")
        root = _xml_in(c, path if path.startswith("xl/") else f"xl/{path}")
        rows: list[list[str]] = []
        for r in root.iter(f"{_S}row") if root is not None else ():
            cells: dict[int, str] = {}
            for k, cell in enumerate(r.iter(f"{_S}c")):
                v = cell.findtext(f"{_S}v") or ""
                if cell.get("t") == "s" and v.isdigit() and int(v) < len(shared):
                    v = shared[int(v)]
                elif cell.get("t") == "inlineStr":
                    v = "".join(t.text or "" for t in cell.iter(f"{_S}t"))
                cells[column_of(cell.get("r") or "") if cell.get("r") else k] = v
            row = [cells.get(i, "") for i in range(min(SHEET_COLUMNS, max(cells, default=-1) + 1))]
            if any(x.strip() for x in row):
                rows.append(row)
        if not rows:
            continue
        if len(rows) > SHEET_ROWS:
            f.warnings.append(f"only the first {SHEET_ROWS} rows of a sheet")
        width = max(map(len, rows))
        rows = [x + [""] * (width - len(x)) for x in rows[:SHEET_ROWS]]
        rows[0] = [x or f"列{i + 1}" for i, x in enumerate(rows[0])]
        out.append(f"## {sheet.get('name')}\n\n{grid(rows)}")
    if not out:
        raise Unreadable("no cells")
    title = _property(c) or f.stem
    return title, f"# {title}\n\n" + "\n\n".join(out)


@handles("epub", ".epub")
def book(f: _File) -> tuple[str, str]:
    c = Container(f.data)
    container = _xml_in(c, "META-INF/container.xml")
    root = next((e for e in container.iter() if e.tag.endswith("rootfile")), None) if container is not None else None
    path = (root.get("full-path") if root is not None else "") or ""
    package = _xml_in(c, path)
    if package is None:
        raise Unreadable("no package part")
    base = path.rsplit("/", 1)[0] + "/" if "/" in path else ""
    items = {i.get("id"): i.get("href") or "" for i in package.iter(f"{_OPF}item")}
    title = (next((e.text for e in package.iter(f"{_DC}title")), None) or f.stem).strip()
    chapters = [html.text_of(raw.decode("utf-8", "replace")) for r in package.iter(f"{_OPF}itemref") if (raw := c.read(base + items.get(r.get("idref"), "")))]
    chapters = [t for t in chapters if t.strip()]
    if not chapters:
        raise Unreadable("no chapters")
    return title, f"# {title}\n\n" + "\n\n".join(chapters)


@handles("pdf", ".pdf")
def pdf(f: _File) -> tuple[str, str]:
    try:
        from pdfminer.high_level import extract_text

        text = extract_text(io.BytesIO(f.data))
    except ImportError:
        try:
            from pypdf import PdfReader
        except ImportError:
            raise Unreadable("no PDF library is installed") from None
        text = "\n\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(f.data)).pages)
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text)).strip()
    if len(text) < 20:
        raise Unreadable("hardly any text, it may need OCR")
    return f.stem, text


def convert(data: bytes | None, name: str) -> Converted:
    """One file; never raises."""
    f = _File(data or b"", name, [])
    if not data:
        return Converted(False, error=f"{name}: empty file")
    if len(data) > MAX_FILE:
        return Converted(False, error=f"{name}: larger than {MAX_FILE >> 20} MB")
    if f.extension not in HANDLERS:
        family = next((k for k, e in UNREADABLE.items() if f.extension in e.split()), None)
        return Converted(False, error=f"{name}: {family} can't be read" if family else f"{name}: no handler for {f.extension or 'files without extension'}")
    kind, handler = HANDLERS[f.extension]
    try:
        title, text = handler(f)
    except (Unreadable, UnsafeArchive) as e:
        return Converted(False, kind=kind, error=f"{name}: {e}")
    except Exception as e:  # one file must not stop a batch
        return Converted(False, kind=kind, error=f"{name}: {type(e).__name__}: {e}")
    if len(text) > MAX_CHARS:
        f.warnings.append("the text was cut")
        text = text[:MAX_CHARS] + "\n\n> ⚠️ 内容过长已截断"
    return Converted(True, text, title or f.stem, kind, f.warnings)


def convert_files(files: DataFrame) -> DataFrame:
    """Rows of the ``binaryFile`` source (``path, content``) to ``path, ok, kind, title, markdown, warnings, error``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "ok", "kind", "title", "markdown", "warnings", "error"]
        types = [pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                r = convert(data, path.rsplit("/", 1)[-1])
                row = (path, r.ok, r.kind, r.title, r.markdown, r.warnings, r.error)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

    return files.select("path", "content").mapInArrow(run, "path string, ok boolean, kind string, title string, markdown string, warnings array<string>, error string")


def capabilities() -> list[tuple[str, str]]:
    """Extensions that can be read, with their kind."""
    return sorted((e, k) for e, (k, _) in HANDLERS.items())

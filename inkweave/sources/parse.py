"""Parsers of file contents: plain text, Markdown, HTML, CSV and Office packages. A parser never fails on a file: what it can't read has the status ``unreadable``."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.functions.text import FILE_TYPES
from inkweave.runtime import spread

PARSED = "title string, text string, word_count int, headings array<string>, md_link_targets array<string>, doc_links array<struct<text: string, url: string>>, status string, warning string"
MAX_ENTRY_BYTES, MAX_SLIDES, MAX_SHEETS = 40 << 20, 300, 200


@dataclass
class Parsed:
    title: str
    text: str = ""
    headings: list[str] = field(default_factory=list)
    targets: list[str] = field(default_factory=list)
    links: list[tuple[str, str]] = field(default_factory=list)
    status: str = "ok"
    warning: str | None = None


def file_title(name: str) -> str:
    """A title from a file name: dashes and underscores as spaces, words capitalised."""
    base = name.replace("\\", "/").rsplit("/", 1)[-1]
    words = re.sub(r"[-_]+", " ", re.sub(r"\.[A-Za-z0-9]{1,8}$", "", base)).split()
    return " ".join(w[0].upper() + w[1:] for w in words) or base


def file_kind(name: str) -> str | None:
    """The file type by extension; None without a known one."""
    stem, dot, ext = name.rpartition(".")
    return FILE_TYPES.get(ext.lower()) if dot and stem else None


def _decoded(content: bytes) -> str:
    return content.decode("utf-8-sig", "replace")


def _squeeze(s: str) -> str:
    return " ".join(s.split())


def parse_text(content: bytes, name: str) -> Parsed:
    return Parsed(file_title(name), _decoded(content))


_MARKS = re.compile(r"[*_~`]+")
_DEFINES = re.compile(r" {0,3}\[([^\]]+)\]:\s*(<[^>]+>|\S+)")
_LINKED = re.compile(r"(?P<image>!?)\[(?P<label>[^\]]*)\](?:\(\s*(?P<url><[^>]+>|[^)\s]+)(?:\s+(?:'[^']*'|\"[^\"]*\"))?\s*\)|\[(?P<ref>[^\]]*)\])")


class _Markdown:
    """One pass over the lines of a Markdown file."""

    def __init__(self, raw: str):
        self.raw = raw
        self.lines = raw.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self.defined = {m[1].strip().lower(): m[2].strip("<>") for m in map(_DEFINES.match, self.lines) if m}

    def links(self) -> Iterator[tuple[bool, bool, str, str]]:
        """(is by reference, is an image, label, url) of every link."""
        for m in _LINKED.finditer(self.raw):
            if m["url"] is not None:
                yield False, bool(m["image"]), m["label"], m["url"].strip("<>")
            elif m["label"] and (url := self.defined.get((m["ref"].strip() or m["label"].strip()).lower())):
                yield True, bool(m["image"]), m["label"], url

    @staticmethod
    def plain(line: str) -> str:
        if _DEFINES.match(line) or re.match(r" {0,3}(?:```|~~~)", line):
            return ""
        line = re.sub(r"^ {0,3}>\s?|^\s*(?:[-+*]|\d+[.)])\s+", "", line).replace("|", " ")
        line = _LINKED.sub(lambda m: m["label"], line)
        return _squeeze(_MARKS.sub("", re.sub(r"\[([^\]]+)\]", r"\1", line)))

    def parse(self, name: str) -> Parsed:
        out, blocks, skip = Parsed(file_title(name)), [], False
        for line, below in zip(self.lines, [*self.lines[1:], ""]):
            if skip:
                skip = False
                continue
            head = re.match(r"\s{0,3}#{1,6}\s+(.+)$", line)
            under = bool(line.strip()) and re.fullmatch(r"\s{0,3}(?:=+|-+)\s*", below) is not None
            if head or under:
                title = _MARKS.sub("", re.sub(r"\s*#+\s*$", "", (head[1] if head else line).strip())).strip()
                skip = under and not head
                if title:
                    out.headings.append(title)
                blocks.append(title)
            elif text := self.plain(line):
                blocks.append(text)
        out.text = "\n".join(blocks)
        every = list(self.links())
        out.targets = [*self.defined.values(), *(u for by_ref, _, _, u in every if not by_ref), *(u for by_ref, _, _, u in every if by_ref)]
        out.links = [(_squeeze(_MARKS.sub("", label)), u) for _, image, label, u in sorted(every, key=lambda x: x[0]) if not image]
        return out


def parse_markdown(content: bytes, name: str) -> Parsed:
    return _Markdown(_decoded(content)).parse(name)


class _Page(HTMLParser):
    """Collects the visible text, headings and links of a page."""

    BLOCKS = set("p div br li ul ol h1 h2 h3 h4 h5 h6 tr table thead tbody section article aside nav header footer blockquote pre hr dt dd figcaption".split())
    HIDDEN = {"script", "style", "noscript", "head"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.parts: list[str] = []
        self.title: list[str] = []
        self.hidden: list[str] = []
        self.in_title = False
        self.open: list[tuple[str, list[str]]] = []
        self.headings: list[str] = []
        self.targets: list[str] = []
        self.links: list[tuple[str, str]] = []
        self.anchor: tuple[str, list[str]] | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "title" and not self.title:
            self.in_title = True
        if tag in self.HIDDEN:
            self.hidden.append(tag)
        if self.hidden:
            return
        self.parts.append("\n" if tag in self.BLOCKS else " ")
        if tag == "a":
            href = (dict(attrs).get("href") or "").strip()
            self.anchor = None
            if href and not href.startswith("#"):
                self.targets.append(href)
                self.anchor = (href, [])
        elif re.fullmatch("h[1-6]", tag):
            self.open.append((tag, []))

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        if tag in self.hidden:
            del self.hidden[self.hidden.index(tag) :]
            return
        if self.hidden:
            return
        self.parts.append("\n" if tag in self.BLOCKS else " ")
        if tag == "a" and self.anchor:
            self.links.append((_squeeze("".join(self.anchor[1])), self.anchor[0]))
            self.anchor = None
        elif self.open and self.open[-1][0] == tag and (text := _squeeze("".join(self.open.pop()[1]))):
            self.headings.append(text)

    def handle_entityref(self, name: str) -> None:
        self.handle_data(decode_entities(f"&{name};"))

    def handle_charref(self, name: str) -> None:
        self.handle_data(decode_entities(f"&#{name};"))

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title.append(data)
        if not self.hidden:
            self.parts.append(data)
            if self.anchor:
                self.anchor[1].append(data)
            for _, held in self.open:
                held.append(data)


def parse_html(content: bytes, name: str) -> Parsed:
    page = _Page()
    page.feed(_decoded(content))
    page.close()
    lines = [re.sub(r"[ \t\r\f\v]+", " ", x).strip() for x in "".join(page.parts).split("\n")]
    text = re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()
    return Parsed(_squeeze("".join(page.title)) or file_title(name), text, page.headings, page.targets, page.links)


#: The named character references that are decoded.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}


def _referred(m: re.Match) -> str:
    if m["name"]:
        return ENTITIES.get(m["name"].lower(), m[0])
    code = int(m["hex"], 16) if m["hex"] else int(m["n"])
    return chr(code) if code <= 0x10FFFF else ""


def decode_entities(text: str) -> str:
    """Six named and all numeric character references; other names stay as they are, numbers beyond Unicode vanish."""
    return re.sub(r"&(?:#[xX](?P<hex>[0-9a-fA-F]+)|#(?P<n>\d+)|(?P<name>[a-zA-Z]+));", _referred, text)


def csv_rows(files: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """The rows of CSV texts: key, row_no (from 0), cells ARRAY<STRING>. Ragged rows stay ragged; a null text has none."""
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in enumerate(b.column(text).to_pylist()):
                rows = parse_csv(t) if t else []
                take = pa.array([i] * len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(key).take(take), pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.list_(pa.string()))], names=[key, "row_no", "cells"])

    return files.select(key, text).mapInArrow(run, f"`{key}` {kind}, row_no bigint, cells array<string>")


def parse_csv(text: str) -> list[list[str]]:
    """Rows of cells: quoted fields, doubled quotes, line breaks in quotes, ragged rows; blank lines at the end don't count."""
    rows = [row or [""] for row in csv.reader(io.StringIO(text, newline=""))]
    if rows and rows[-1] == [""]:
        rows.pop()
    return rows


class _Package:
    """An Office file: a zip of XML parts. Parts beyond ``MAX_ENTRY_BYTES`` count as missing."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))

    def xml(self, path: str) -> ElementTree.Element | None:
        try:
            info = self.zip.getinfo(path)
            if info.file_size > MAX_ENTRY_BYTES:
                return None
            with self.zip.open(info) as f:
                data = f.read(MAX_ENTRY_BYTES + 1)
            return ElementTree.fromstring(data) if len(data) <= MAX_ENTRY_BYTES and b"<!ENTITY" not in data[:4096] else None
        except (KeyError, ElementTree.ParseError, zipfile.BadZipFile, RuntimeError, OSError):
            return None

    def rels(self, part: str) -> dict[str, str]:
        folder, _, file = part.rpartition("/")
        root = self.xml(f"{folder}/_rels/{file}.rels")
        return {} if root is None else {r.get("Id", ""): r.get("Target", "") for r in root}

    def title(self) -> str:
        root = self.xml("docProps/core.xml")
        found = next((e.text for e in root.iter() if _name(e) == "title"), None) if root is not None else None
        return _squeeze(found or "")


def _name(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _all(e: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    return (x for x in e.iter() if _name(x) == name)


def _shown(e: ElementTree.Element) -> str:
    """The text of an element, tabs and breaks as spaces."""
    return _squeeze("".join((x.text or "") if _name(x) == "t" else " " if _name(x) in ("tab", "br") else "" for x in e.iter()))


def _attr(e: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def _docx(p: _Package, out: Parsed, lines: list[str]) -> str | None:
    root = p.xml("word/document.xml")
    if root is None:
        return "No Word document body found"
    rels = p.rels("word/document.xml")
    for para in _all(root, "p"):
        if text := _shown(para):
            lines.append(text)
            style = next((_attr(s, "val") or "" for s in _all(para, "pStyle")), "").lower()
            if re.fullmatch("heading[1-6]|title", style):
                out.headings.append(text)
            out.links += [(_shown(h), rels[_attr(h, "id")]) for h in _all(para, "hyperlink") if _attr(h, "id") in rels and _shown(h)]
    return None if lines else "No readable Word text found"


def _pptx(p: _Package, out: Parsed, lines: list[str]) -> str | None:
    slides = sorted((n for n in p.zip.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n, re.I)), key=lambda n: int(re.search(r"(\d+)\.xml", n, re.I)[1]))
    if not slides:
        return "No PowerPoint slides found"
    for i, path in enumerate(slides[:MAX_SLIDES], 1):
        root = p.xml(path)
        if root is None:
            continue
        shown = [t for t in map(_shown, _all(root, "p")) if t]
        if shown:
            out.headings.append(shown[0])
            lines += [f"Slide {i}: {shown[0]}", *shown[1:]]
            rels = p.rels(path)
            for run in _all(root, "r"):
                out.links += [(_shown(run), rels[_attr(h, "id")]) for x in ("hlinkClick", "hlinkMouseOver") for h in _all(run, x) if _shown(run) and _attr(h, "id") in rels]
    if len(slides) > MAX_SLIDES:
        out.status, out.warning = "partial", f"Only the first {MAX_SLIDES} slides were indexed"
    return None if lines else "No readable PowerPoint text found"


def _xlsx(p: _Package, out: Parsed, lines: list[str]) -> str | None:
    book, rels = p.xml("xl/workbook.xml"), p.rels("xl/workbook.xml")
    sheets = [(s.get("name", "Sheet"), "xl/" + rels[_attr(s, "id")].removeprefix("/xl/")) for s in _all(book, "sheet") if _attr(s, "id") in rels] if book is not None else []
    if not sheets:
        return "No Excel worksheets found"
    strings_root = p.xml("xl/sharedStrings.xml")
    strings = [_shown(si) for si in _all(strings_root, "si")] if strings_root is not None else []

    def value(c: ElementTree.Element) -> str:
        kind = c.get("t")
        if kind == "inlineStr":
            return _shown(c)
        v = "".join(x.text or "" for x in _all(c, "v"))
        if kind == "s":
            return strings[int(v)] if v.isdigit() and int(v) < len(strings) else ""
        return {"1": "TRUE"}.get(v, "FALSE") if kind == "b" and v else _squeeze(v)

    any_row = False
    for name, path in sheets[:MAX_SHEETS]:
        out.headings.append(name)
        root = p.xml(path)
        if root is not None:
            lines.append(f"Sheet: {name}")
            for row in _all(root, "row"):
                if cells := [v for v in map(value, _all(row, "c")) if v]:
                    lines.append(" | ".join(cells))
                    any_row = True
    if len(sheets) > MAX_SHEETS:
        out.status, out.warning = "partial", f"Only the first {MAX_SHEETS} worksheets were indexed"
    return None if any_row or lines else "No readable Excel cell text found"


def parse_office(content: bytes, name: str, kind: str) -> Parsed:
    out, lines = Parsed(file_title(name)), []
    try:
        p = _Package(content)
        problem = {"docx": _docx, "pptx": _pptx, "xlsx": _xlsx}[kind](p, out, lines)
    except (zipfile.BadZipFile, ElementTree.ParseError, ValueError):
        return Parsed(out.title, status="unreadable", warning="Not a readable Office file")
    if problem:
        return Parsed(out.title, status="unreadable", warning=problem)
    out.title = p.title() or out.title
    out.text = "\n".join(lines)
    out.targets = [u for _, u in out.links]
    return out


def parse_file(content: bytes | None, name: str) -> Parsed:
    """A file by its extension. PDF needs a reader that isn't part of this package: its pages come as text (see ``strip_page_furniture``)."""
    kind = file_kind(name)
    if content is None:
        return Parsed(file_title(name), status="unreadable", warning="No content")
    if kind == "md":
        return parse_markdown(content, name)
    if kind == "html":
        return parse_html(content, name)
    if kind in ("docx", "pptx", "xlsx"):
        return parse_office(content, name, kind)
    if kind == "pdf":
        return Parsed(file_title(name), status="unreadable", warning="PDF reader not installed")
    return parse_text(content, name)


def parse_files(files: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """``files`` with the columns of ``PARSED`` in place of ``content``; columns of those names give way."""
    names = [x.strip().split(" ")[0] for x in re.sub(r"<[^>]*(?:<[^>]*>)?[^>]*>", "", PARSED).split(",")]
    keep = [c for c in files.columns if c != content and c not in names]
    kinds = {f.name: f.dataType.simpleString() for f in files.schema.fields}
    links = pa.list_(pa.struct([("text", pa.string()), ("url", pa.string())]))
    types = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), links, pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [parse_file(c, n or "") for c, n in zip(b.column(content).to_pylist(), b.column(name).to_pylist())]
            cols = zip(*((p.title, p.text, len(p.text.split()), p.headings, p.targets, [{"text": t, "url": u} for t, u in p.links], p.status, p.warning) for p in got)) if got else [[]] * 8
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(list(c), t) for c, t in zip(cols, types))], names=[*keep, *names])

    return spread(files.select(*keep, content)).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), PARSED]))


def strip_page_furniture(lines: DataFrame, share: float = 0.6) -> DataFrame:
    """Page lines (doc_id, page, line_no, line) without those that recur, digits alike, on a share of the document's pages; documents of fewer than three pages stay whole."""
    form = F.regexp_replace(F.lower(F.trim("line")), r"\d", "#")
    marked = lines.withColumn("_form", form)
    pages = marked.groupBy("doc_id").agg(F.countDistinct("page").alias("_pages"))
    seen = marked.where("_form <> ''").groupBy("doc_id", "_form").agg(F.countDistinct("page").alias("_on")).join(pages, "doc_id")
    often = seen.where((F.col("_pages") >= 3) & (F.col("_on") >= F.greatest(F.lit(2), F.ceil(share * F.col("_pages"))))).select("doc_id", "_form")
    return marked.join(often, ["doc_id", "_form"], "left_anti").select(*lines.columns)


def link_labels(spans: DataFrame, rects: DataFrame, slack: float = 2.0, most: int = 140) -> DataFrame:
    """The text inside link rectangles of a page: doc_id, page, rect_no, label.

    ``spans``: doc_id, page, span_no, str, tx, ty, width; ``rects``: doc_id, page, rect_no, x1, y1, x2, y2. A span belongs to a rectangle that holds its
    baseline and half of its width, or 90 % of the rectangle's.
    """
    both = spans.join(rects, ["doc_id", "page"]).where((F.col("ty") >= F.col("y1") - slack) & (F.col("ty") <= F.col("y2") + slack))
    shared = F.least(F.col("tx") + F.col("width"), F.col("x2")) - F.greatest("tx", "x1")
    inside = both.where((F.col("width") > 0) & ((shared >= 0.5 * F.col("width")) | (shared >= 0.9 * (F.col("x2") - F.col("x1")))))
    joined = inside.groupBy("doc_id", "page", "rect_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_no", "str"))), lambda s: s["str"]), " ").alias("label"))
    return joined.withColumn("label", F.substring(F.trim(F.regexp_replace("label", r"\s+", " ")), 1, most))

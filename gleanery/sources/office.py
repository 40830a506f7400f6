"""DOCX and Excel packages, read with the standard library."""

from __future__ import annotations

import io
import json
import posixpath
import re
import zipfile
from xml.etree import ElementTree as ET

from .formats import Extracted, Section, Unreadable

MAX_PARTS, MAX_PART_BYTES, MAX_RATIO = 2000, 64 << 20, 200
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


class Package:
    """A zip whose parts are bounded in number, size and ratio; XML without a document type."""

    def __init__(self, data: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile as e:
            raise Unreadable("not a package") from e
        items = self.zip.infolist()
        if len(items) > MAX_PARTS or any(i.file_size > MAX_PART_BYTES or i.file_size > MAX_RATIO * max(i.compress_size, 1024) for i in items):
            raise Unreadable("the package passes its budget", "quarantined")
        if any(i.flag_bits & 1 for i in items):
            raise Unreadable("an encrypted package")
        self.names = {i.filename for i in items}

    def xml(self, name: str) -> ET.Element | None:
        if name not in self.names:
            return None
        data = self.zip.read(name)
        if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
            raise Unreadable("a document type is declared", "quarantined")
        try:
            return ET.fromstring(data)
        except ET.ParseError as e:
            raise Unreadable("broken XML") from e

    def related(self, name: str) -> dict[str, tuple[str, str]]:
        """Relationship id to (kind, part)."""
        folder, base = posixpath.split(name)
        root = self.xml(f"{folder}/_rels/{base}.rels")
        out = {}
        for r in root if root is not None else []:
            if r.get("TargetMode") != "External":
                target = r.get("Target", "")
                out[r.get("Id")] = (r.get("Type", "").rsplit("/", 1)[-1], target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target)))
        return out


# DOCX


def _on(e: ET.Element | None) -> bool:
    return e is not None and e.get(f"{W}val", "true") not in ("false", "0", "off")


def _styles(root: ET.Element | None) -> dict[str, tuple[int | None, bool]]:
    """Style to its heading level and whether it hides its text."""
    out = {}
    for s in root.iter(f"{W}style") if root is not None else []:
        level = s.find(f"{W}pPr/{W}outlineLvl")
        name = s.find(f"{W}name")
        m = re.fullmatch(r"heading ([1-9])", (name.get(f"{W}val", "") if name is not None else "").lower())
        number = int(level.get(f"{W}val")) + 1 if level is not None else int(m[1]) if m else None
        out[s.get(f"{W}styleId")] = (number if number and number <= 9 else None, _on(s.find(f"{W}rPr/{W}vanish")))
    return out


def _runs(e: ET.Element, styles: dict, latent: bool) -> list[tuple[bool, str]]:
    out = []
    for child in e:
        tag = child.tag
        if tag in (f"{W}del", f"{W}moveFrom"):
            out += _runs(child, styles, True)
        elif tag == f"{W}r":
            look = child.find(f"{W}rPr")
            style = look.find(f"{W}rStyle") if look is not None else None
            hidden = latent or (look is not None and _on(look.find(f"{W}vanish"))) or (style is not None and styles.get(style.get(f"{W}val"), (None, False))[1])
            for x in child:
                if x.tag in (f"{W}t", f"{W}delText", f"{W}instrText"):
                    out.append((hidden or x.tag != f"{W}t", x.text or ""))
                elif x.tag == f"{W}tab":
                    out.append((hidden, "\t"))
                elif x.tag in (f"{W}br", f"{W}cr"):
                    out.append((hidden, "\n"))
        elif tag not in (f"{W}p", f"{W}tbl", f"{W}pPr"):
            out += _runs(child, styles, latent)
    return out


def _cell(c: ET.Element, styles: dict, latent: bool) -> str:
    """The paragraphs of a cell, its shown or its hidden text; tables inside it are read where they stand."""
    lines = ("".join(t for hidden, t in _runs(p, styles, False) if hidden == latent).strip() for p in c.iter(f"{W}p"))
    return "\n".join(t for t in lines if t)


def _story(root: ET.Element | None, styles: dict, role: str, stack: list, notices: list[str]) -> list[Section]:
    out = []

    def paragraph(p: ET.Element) -> None:
        style = p.find(f"{W}pPr/{W}pStyle")
        direct = p.find(f"{W}pPr/{W}outlineLvl")
        level, hidden = styles.get(style.get(f"{W}val"), (None, False)) if style is not None else (None, False)
        if direct is not None:
            n = int(direct.get(f"{W}val", "9"))
            level = n + 1 if n < 9 else None
        runs = _runs(p, styles, hidden)
        shown = "".join(t for latent, t in runs if not latent).strip()
        if level and shown and role == "primary":
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, " ".join(shown.split())))
        for latent in (False, True):
            text = "".join(t for x, t in runs if x == latent)
            if text.strip():
                out.append(Section(text.strip(), [n for _, n in stack], "latent" if latent else role))

    def body(e: ET.Element) -> None:
        for child in e:
            if child.tag == f"{W}p":
                paragraph(child)
            elif child.tag == f"{W}tbl":
                if any(True for c in child.iter(f"{W}tc") for _ in c.iter(f"{W}tbl")):
                    notices.append("a table stands inside a table")
                for row in child.findall(f"{W}tr"):
                    for latent in (False, True):
                        cells = [_cell(c, styles, latent) for c in row.findall(f"{W}tc")]
                        if any(cells):
                            out.append(Section("\t".join(cells), [n for _, n in stack], "latent" if latent else role))
            elif child.tag != f"{W}sectPr":
                body(child)

    if root is not None:
        body(root)
    return out


def read_docx(data: bytes) -> Extracted:
    """Body, then notes, headers, footers and comments; primary before supporting before latent."""
    package = Package(data)
    name = "word/document.xml"
    root = package.xml(name)
    if root is None:
        raise Unreadable("no document part")
    parts = package.related(name)
    styles = _styles(package.xml(next((p for k, p in parts.values() if k == "styles"), "")))
    notices: list[str] = []
    out = _story(root.find(f"{W}body"), styles, "primary", [], notices)
    for kinds in (("footnotes", "endnotes"), ("header", "footer"), ("comments",)):
        for kind, part in sorted(parts.values()):
            if kind in kinds:
                out += _story(package.xml(part), styles, "supporting", [], notices)
    order = {"primary": 0, "supporting": 1, "latent": 2}
    out.sort(key=lambda s: order[s.role])
    coverage = "partial" if notices else "complete"
    return Extracted(coverage if out else "skipped_no_extractable_text", out, notices=notices).checked()


# Excel


def a1(reference: str) -> tuple[int, int]:
    """Row and column, from 1, of a cell name."""
    m = re.fullmatch(r"\$?([A-Z]{1,3})\$?([1-9][0-9]{0,6})", reference)
    if not m:
        raise ValueError(f"{reference} is not a cell")
    column = 0
    for c in m[1]:
        column = column * 26 + ord(c) - 64
    return int(m[2]), column


def a1_name(row: int, column: int) -> str:
    letters = ""
    while column:
        column, rest = divmod(column - 1, 26)
        letters = chr(65 + rest) + letters
    return f"{letters}{row}"


def _shared(root: ET.Element | None) -> list[str]:
    skip = f"{S}rPh"
    text = lambda e: "".join(x.text or "" for c in e if c.tag != skip for x in c.iter(f"{S}t"))
    return [text(si) for si in root.findall(f"{S}si")] if root is not None else []


def _value(c: ET.Element, shared: list[str]) -> str:
    v, kind = c.findtext(f"{S}v"), c.get("t", "n")
    if kind == "inlineStr":
        return "".join(x.text or "" for x in c.iter(f"{S}t"))
    if v is None:
        return ""
    if kind == "s":
        return shared[int(v)] if v.isdigit() and int(v) < len(shared) else ""
    return {"1": "TRUE", "0": "FALSE"}.get(v, v) if kind == "b" else v


def read_excel(data: bytes) -> Extracted:
    """Sheets in order, cells row by row: cached values primary, formulas, comments and hidden cells latent; macros are never opened."""
    package = Package(data)
    book = package.xml("xl/workbook.xml")
    if book is None:
        raise Unreadable("no workbook part")
    parts = package.related("xl/workbook.xml")
    shared = _shared(package.xml(next((p for k, p in parts.values() if k == "sharedStrings"), "")))
    out, notices = [], []
    for d in book.iter(f"{S}definedName"):
        if d.text and d.get("hidden") not in ("1", "true"):
            out.append(Section(f"{d.get('name')}: {d.text}", [], "latent"))
    for sheet in book.iter(f"{S}sheet"):
        name, (_, part) = sheet.get("name", ""), parts.get(sheet.get(f"{R}id"), ("", ""))
        root = package.xml(part)
        if root is None:
            notices.append("a sheet is missing")
            continue
        away = sheet.get("state", "visible") != "visible"
        out.append(Section(name, [name], "latent" if away else "primary"))
        columns = [(int(c.get("min")), int(c.get("max"))) for c in root.iter(f"{S}col") if c.get("hidden") in ("1", "true")]
        comments = {}
        for kind, other in package.related(part).values():
            if kind == "comments" and (told := package.xml(other)) is not None:
                comments |= {c.get("ref"): "".join(x.text or "" for x in c.iter(f"{S}t")) for c in told.iter(f"{S}comment")}
        for row in root.iter(f"{S}row"):
            for c in row.findall(f"{S}c"):
                ref = c.get("r", "")
                try:
                    _, column = a1(ref)
                except ValueError:
                    notices.append("a cell has no place")
                    continue
                hidden = away or row.get("hidden") in ("1", "true") or any(a <= column <= b for a, b in columns)
                where = json.dumps({"kind": "excel_cell", "sheet": name, "cell": ref})
                for text, role in ((_value(c, shared), "latent" if hidden else "primary"), (c.findtext(f"{S}f") or "", "latent"), (comments.get(ref, ""), "latent")):
                    if text.strip():
                        out.append(Section(text, [name], role, where))
    return Extracted("partial" if notices else "complete", out, notices=notices).checked()

"""Text of PDF pages, with the standard library: objects, streams, fonts, content operators, and a reading order.

A page is a section. Glyph runs get places on the page; runs of a line are
joined, and the page is cut along its widest gaps, across before down, so that
columns are read one after the other. Encrypted files are unreadable, files
without text are skipped.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from .formats import Extracted, Section, Unreadable

MOST_PAGES, MOST_BYTES, MOST_DEPTH, MOST_FORMS = 5000, 64 << 20, 6, 8
#: A gap of this share of the letters' height is a space; of so many heights, another column; lines so far apart are other paragraphs.
SPACE, COLUMN, PARAGRAPH = 0.2, 1.5, 1.6


class Name(str):
    """A name such as /Type, without its slash."""


class Op(str):
    """An operator of a content stream."""


@dataclass(frozen=True)
class Ref:
    number: int


@dataclass
class Stream:
    info: dict
    raw: bytes


# Syntax

_TOKEN = re.compile(rb"""\s*(?:%[^\r\n]*[\r\n]+\s*)*(?:(<<|>>|\[|\]|\{|\})|/([^\s()<>\[\]{}/%]*)|(\()|<([0-9A-Fa-f\s]*)>|([+-]?(?:\d+\.?\d*|\.\d+))(?=[\s()<>\[\]{}/%]|$)|([^\s()<>\[\]{}/%]+))""")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    """A string in brackets, from behind its first one."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        at += 1
        if c == b"\\":
            m = re.compile(rb"[0-7]{1,3}|\r\n|.", re.DOTALL).match(data, at)
            if not m:
                break
            at, e = m.end(), m[0]
            out += bytes([int(e, 8) & 255]) if e[:1].isdigit() and e[:1] < b"8" else b"" if e in (b"\r\n", b"\n", b"\r") else _ESCAPES.get(e, e)
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            break
        out += c
    return bytes(out), at


def _name(raw: bytes) -> Name:
    return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), raw).decode("latin-1"))


def tokens(data: bytes, at: int = 0) -> Iterator[tuple[object, int]]:
    """Values and operators with the place behind each; arrays and dictionaries whole, references joined."""
    stack: list[list] = [[]]
    kinds: list[bytes] = []
    while m := _TOKEN.match(data, at):
        at = m.end()
        mark, name, opened, hexed, number, word = m.groups()
        if mark in (b"<<", b"[", b"{"):
            stack.append([])
            kinds.append(mark)
            continue
        if mark:
            if not kinds:
                continue
            items, kind = stack.pop(), kinds.pop()
            value: object = dict(zip(items[::2], items[1::2], strict=False)) if kind == b"<<" else items
        elif name is not None:
            value = _name(name)
        elif opened:
            value, at = _literal(data, at)
        elif hexed is not None:
            digits = re.sub(rb"\s", b"", hexed)
            value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif number:
            value = float(number) if b"." in number else int(number)
        elif word == b"R" and len(stack) > 1 and len(stack[-1]) > 1:
            _, first = stack[-1].pop(), stack[-1].pop()
            value = Ref(first) if isinstance(first, int) else None
        else:
            value = {b"true": True, b"false": False, b"null": None}.get(word, Op(word.decode("latin-1")))
        if kinds:
            stack[-1].append(value)
        else:
            yield value, at


# Files


class File:
    """Objects by number, those in object streams too; found by looking for them, so a broken table of places does no harm."""

    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise Unreadable("not a PDF")
        self.objects: dict[int, object] = {}
        self.spent = 0
        for m in re.finditer(rb"(?<![0-9])(\d{1,9})\s+\d{1,5}\s+obj\b", data):
            try:
                value, at = next(tokens(data, m.end()))
            except (StopIteration, ValueError):
                continue
            if isinstance(value, dict) and (s := re.compile(rb"\s*stream(\r\n|\n|\r)").match(data, at)):
                size = value.get("Length")
                end = s.end() + size if isinstance(size, int) and data[s.end() + size :].lstrip()[:9] == b"endstream" else data.find(b"endstream", s.end())
                value = Stream(value, data[s.end() : end if end >= 0 else len(data)])
            self.objects[int(m[1])] = value
        trailers = [v for m in re.finditer(rb"\btrailer\b", data) for v, _ in [next(tokens(data, m.end()), (None, 0))] if isinstance(v, dict)]
        trailers += [o.info for o in self.objects.values() if isinstance(o, Stream) and o.info.get("Type") == "XRef"]
        if any("Encrypt" in t for t in trailers):
            raise Unreadable("an encrypted file")
        for s in [o for o in self.objects.values() if isinstance(o, Stream) and o.info.get("Type") == "ObjStm"]:
            inner, first = self.bytes_of(s), self.get(s.info.get("First"))
            heads = [v for v, _ in tokens(inner[:first])] if isinstance(first, int) else []
            for number, place in zip(heads[::2], heads[1::2], strict=False):
                got = next(tokens(inner, first + place), None)
                if got and number not in self.objects:
                    self.objects[number] = got[0]
        self.root = next((self.get(t["Root"]) for t in trailers if "Root" in t), None) or next((o for o in self.objects.values() if isinstance(o, dict) and o.get("Type") == "Catalog"), None)

    def get(self, value):
        for _ in range(32):
            if not isinstance(value, Ref):
                return value
            value = self.objects.get(value.number)
        return None

    def bytes_of(self, s: Stream) -> bytes:
        """A stream's data; empty where its filters aren't known."""
        data, filters, told = s.raw, self.get(s.info.get("Filter")) or [], self.get(s.info.get("DecodeParms")) or {}
        for i, f in enumerate(filters if isinstance(filters, list) else [filters]):
            if f in ("FlateDecode", "Fl"):
                d = zlib.decompressobj()
                try:
                    data = d.decompress(data, MOST_BYTES - self.spent + 1)
                except zlib.error:
                    return b""
                how = self.get(told[i] if isinstance(told, list) and i < len(told) else told) or {}
                if isinstance(how, dict) and how.get("Predictor", 1) >= 10:
                    data = _unpredicted(data, how.get("Columns", 1) * how.get("Colors", 1) * how.get("BitsPerComponent", 8) // 8)
            elif f in ("ASCIIHexDecode", "AHx"):
                digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">")[0])
                data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            else:
                return b""
            self.spent += len(data)
            if self.spent > MOST_BYTES:
                raise Unreadable("the streams pass their budget", "quarantined")
        return data

    def pages(self) -> Iterator[dict]:
        """Page dictionaries in order, with what they inherit."""
        todo, seen = [(self.root.get("Pages") if isinstance(self.root, dict) else None, {})], 0
        visited: set[int] = set()
        while todo and seen < MOST_PAGES:
            ref, above = todo.pop()
            if isinstance(ref, Ref):
                if ref.number in visited:
                    continue
                visited.add(ref.number)
            node = self.get(ref)
            if not isinstance(node, dict):
                continue
            node = above | node
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                handed = {k: node[k] for k in ("Resources",) if k in node}
                todo += [(k, handed) for k in reversed(kids)]
            else:
                seen += 1
                yield node


def _unpredicted(data: bytes, width: int) -> bytes:
    """Rows that were stored as differences to the row above or the byte before."""
    out, above = bytearray(), bytearray(width)
    for a in range(0, len(data), width + 1):
        kind, row = data[a], bytearray(data[a + 1 : a + 1 + width].ljust(width, b"\0"))
        for i in range(width):
            left, up = (row[i - 1] if i else 0), above[i]
            row[i] = (row[i] + (0, left, up, (left + up) // 2, up)[min(kind, 4)]) & 255
        out += row
        above = row
    return bytes(out)


# Fonts


class Font:
    """Codes of a font to text and advances (in thousandths of its size)."""

    def __init__(self, file: File, info: dict):
        self.wide = info.get("Subtype") == "Type0"
        self.told = self._cmap(file, file.get(info.get("ToUnicode")))
        encoding = file.get(info.get("Encoding"))
        base = encoding.get("BaseEncoding") if isinstance(encoding, dict) else encoding
        self.codec = "mac_roman" if base == "MacRomanEncoding" else "cp1252"
        self.named: dict[int, str] = {}
        if isinstance(encoding, dict):
            code = 0
            for x in file.get(encoding.get("Differences")) or []:
                if isinstance(x, int):
                    code = x
                else:
                    self.named[code] = _glyph(str(x))
                    code += 1
        self.widths: dict[int, float] = {}
        if self.wide:
            below = file.get((file.get(info.get("DescendantFonts")) or [None])[0]) or {}
            self.usual = below.get("DW", 1000)
            w, i = file.get(below.get("W")) or [], 0
            while i + 1 < len(w):
                second = file.get(w[i + 1])
                if isinstance(second, list):
                    self.widths |= {w[i] + k: x for k, x in enumerate(second)}
                    i += 2
                elif i + 2 < len(w):
                    self.widths |= dict.fromkeys(range(w[i], min(second, w[i] + 65536) + 1), w[i + 2])
                    i += 3
                else:
                    break
        else:
            self.usual = 500
            first = info.get("FirstChar", 0)
            self.widths = {first + i: x for i, w in enumerate(file.get(info.get("Widths")) or []) if isinstance(x := file.get(w), (int, float))}

    @staticmethod
    def _cmap(file: File, stream) -> dict[int, str]:
        out: dict[int, str] = {}
        if not isinstance(stream, Stream):
            return out
        text = lambda b: b.decode("utf-16-be", "ignore")
        number = lambda b: int.from_bytes(b, "big")
        held: list = []
        for v, _ in tokens(file.bytes_of(stream)):
            if not isinstance(v, Op):
                held.append(v)
                continue
            if v == "endbfchar":
                pairs = [x for x in held if isinstance(x, bytes)]
                out |= {number(a): text(b) for a, b in zip(pairs[::2], pairs[1::2], strict=False)}
            elif v == "endbfrange":
                rows = [x for x in held if isinstance(x, (bytes, list))]
                for a, b, to in zip(rows[::3], rows[1::3], rows[2::3], strict=False):
                    for k in range(min(number(b) - number(a) + 1, 65536)):
                        if isinstance(to, list):
                            out[number(a) + k] = text(to[k]) if k < len(to) else ""
                        elif to:
                            out[number(a) + k] = text(to[:-2]) + chr(min(number(to[-2:]) + k, 0x10FFFF)) if len(to) > 1 else chr(number(to) + k)
            held = []
        return out

    def decode(self, data: bytes) -> Iterator[tuple[str, float, bool]]:
        """Text, advance, and whether it is the single-byte space that word spacing widens."""
        step = 2 if self.wide else 1
        for i in range(0, len(data) - step + 1, step):
            code = int.from_bytes(data[i : i + step], "big")
            shown = self.told.get(code)
            if shown is None:
                shown = "" if self.wide else self.named.get(code) or bytes([code]).decode(self.codec, "ignore")
            yield shown, self.widths.get(code, self.usual), step == 1 and code == 32


#: Names of glyphs that are no single letter.
GLYPHS = {"space": " ", "period": ".", "comma": ",", "hyphen": "-", "colon": ":", "semicolon": ";", "parenleft": "(", "parenright": ")", "quotesingle": "'", "quoteright": "’", "quotedblleft": "“", "quotedblright": "”", "endash": "–", "emdash": "—", "fi": "fi", "fl": "fl", "ff": "ff", "slash": "/", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}


def _glyph(name: str) -> str:
    if m := re.fullmatch(r"uni([0-9A-Fa-f]{4})|u([0-9A-Fa-f]{4,6})", name):
        return chr(int(m[1] or m[2], 16))
    return GLYPHS.get(name, name if len(name) == 1 else "")


# Pages


@dataclass
class Run:
    """Text that stands at one place: left and right end, base line, height."""

    left: float
    right: float
    base: float
    size: float
    text: str


def _times(a: tuple, b: tuple) -> tuple:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
CLIP_ONLY = 7  # a way of drawing that shows nothing; invisible text (3) is kept, as scanned pages have it


def _runs(file: File, content: bytes, resources: dict, place: tuple = IDENTITY, depth: int = 0) -> Iterator[Run]:
    """Upright runs as the operators draw them; rotated ones follow behind."""
    fonts = file.get(resources.get("Font")) or {}
    ready: dict[str, Font] = {}
    state = {"place": place, "font": None, "size": 1.0, "char": 0.0, "word": 0.0, "scale": 1.0, "lead": 0.0, "rise": 0.0, "mode": 0}
    saved: list[dict] = []
    text = line = IDENTITY
    args: list = []
    turned: list[Run] = []

    def show(data: bytes) -> Run | None:
        nonlocal text
        font = state["font"]
        if font is None or not isinstance(data, bytes):
            return None
        shown, width = "", 0.0
        for s, advance, wide in font.decode(data):
            shown += s
            width += (advance / 1000 * state["size"] + state["char"] + (state["word"] if wide else 0)) * state["scale"]
        at = _times((1, 0, 0, 1, 0, state["rise"]), _times(text, state["place"]))
        text = _times((1, 0, 0, 1, width, 0), text)
        if not shown.strip() and not shown or state["mode"] == CLIP_ONLY:
            return None
        size = state["size"] * (at[2] ** 2 + at[3] ** 2) ** 0.5
        run = Run(at[4], at[4] + width * at[0], at[5], abs(size) or 1.0, shown)
        if abs(at[1]) > abs(at[0]):
            turned.append(run)
            return None
        return run

    def move(x: float, y: float) -> None:
        nonlocal text, line
        text = line = _times((1, 0, 0, 1, x, y), line)

    for v, _ in tokens(content):
        if not isinstance(v, Op):
            args.append(v)
            if len(args) > 64:
                del args[:32]
            continue
        numbers = [float(a) for a in args if isinstance(a, (int, float))]
        if v == "q":
            saved.append(dict(state))
        elif v == "Q" and saved:
            state = saved.pop()
        elif v == "cm" and len(numbers) >= 6:
            state["place"] = _times(tuple(numbers[-6:]), state["place"])
        elif v == "BT":
            text = line = IDENTITY
        elif v == "Tf" and len(args) > 1:
            key = str(args[-2])
            if key not in ready and isinstance(info := file.get(fonts.get(key)), dict):
                ready[key] = Font(file, info)
            state["font"], state["size"] = ready.get(key), numbers[-1] if numbers else 1.0
        elif v in ("Tc", "Tw", "TL", "Ts", "Tz", "Tr") and numbers:
            field = {"Tc": "char", "Tw": "word", "TL": "lead", "Ts": "rise", "Tz": "scale", "Tr": "mode"}[v]
            state[field] = numbers[-1] / 100 if v == "Tz" else numbers[-1]
        elif v in ("Td", "TD") and len(numbers) > 1:
            if v == "TD":
                state["lead"] = -numbers[-1]
            move(numbers[-2], numbers[-1])
        elif v == "Tm" and len(numbers) >= 6:
            text = line = tuple(numbers[-6:])
        elif v == "T*":
            move(0, -state["lead"])
        elif v in ("Tj", "'", '"') and args:
            if v != "Tj":
                if v == '"' and len(numbers) > 1:
                    state["word"], state["char"] = numbers[-2], numbers[-1]
                move(0, -state["lead"])
            if run := show(args[-1]):
                yield run
        elif v == "TJ" and args and isinstance(args[-1], list):
            for part in args[-1]:
                if isinstance(part, (int, float)):
                    text = _times((1, 0, 0, 1, -part / 1000 * state["size"] * state["scale"], 0), text)
                elif run := show(part):
                    yield run
        elif v == "Do" and args and depth < MOST_FORMS:
            form = file.get((file.get(resources.get("XObject")) or {}).get(args[-1]))
            if isinstance(form, Stream) and form.info.get("Subtype") == "Form":
                matrix = file.get(form.info.get("Matrix")) or IDENTITY
                inner = file.get(form.info.get("Resources")) or resources
                yield from _runs(file, file.bytes_of(form), inner, _times(tuple(map(float, matrix)), state["place"]), depth + 1)
        args = []
    yield from turned


def _lines(runs: list[Run]) -> list[tuple[float, float, str]]:
    """(base line, height, text) of runs of one column, from the top."""
    out: list[list[Run]] = []
    for r in sorted(runs, key=lambda r: (-r.base, r.left)):
        if out and abs(out[-1][0].base - r.base) <= 0.5 * max(out[-1][0].size, r.size):
            out[-1].append(r)
        else:
            out.append([r])
    lines = []
    for row in out:
        row.sort(key=lambda r: r.left)
        text = row[0].text
        for a, b in zip(row, row[1:], strict=False):
            gap = b.left - a.right > SPACE * max(a.size, b.size)
            text += (" " if gap and not text.endswith(" ") and not b.text.startswith(" ") else "") + b.text
        if text.strip():
            lines.append((row[0].base, max(r.size for r in row), " ".join(text.split())))
    return lines


def _gap(spans: list[tuple[float, float]], least: float) -> float | None:
    """The middle of the widest stretch that no span covers, if it is ``least`` wide."""
    best, end = (least, None), None
    for a, b in sorted(spans):
        if end is not None and a - end >= best[0]:
            best = (a - end, (a + end) / 2)
        end = b if end is None else max(end, b)
    return best[1]


def compose(runs: list[Run], depth: int = 0) -> str:
    """The text of runs in reading order: cut across where a wide band is empty, else down, else line by line."""
    if not runs:
        return ""
    size = sorted(r.size for r in runs)[len(runs) // 2]
    if depth < MOST_DEPTH and len(runs) > 1:
        across = _gap([(r.base - 0.2 * r.size, r.base + 0.8 * r.size) for r in runs], PARAGRAPH * size)
        if across is not None:
            parts = [r for r in runs if r.base > across], [r for r in runs if r.base <= across]
            return "\n\n".join(filter(None, (compose(p, depth + 1) for p in parts)))
        down = _gap([(r.left, r.right) for r in runs], COLUMN * size)
        if down is not None:
            parts = [r for r in runs if r.left < down], [r for r in runs if r.left >= down]
            rows = [_lines(p) for p in parts]
            if min(map(len, rows)) >= 4:  # fewer lines side by side are one row with a gap, as in a table
                return "\n\n".join(filter(None, (compose(p, depth + 1) for p in parts)))
    lines = _lines(runs)
    out = lines[0][2] if lines else ""
    for (above, height, _), (base, _, text) in zip(lines, lines[1:], strict=False):
        out += ("\n\n" if above - base > PARAGRAPH * 1.2 * height else "\n") + text
    return out


def read(data: bytes) -> Extracted:
    try:
        file = File(data)
        out = []
        for number, page in enumerate(file.pages(), 1):
            contents = file.get(page.get("Contents"))
            streams = [file.get(c) for c in contents] if isinstance(contents, list) else [contents]
            content = b"\n".join(file.bytes_of(s) for s in streams if isinstance(s, Stream))
            text = compose(list(_runs(file, content, file.get(page.get("Resources")) or {})))
            if text.strip():
                out.append(Section(text, [], locator=json.dumps({"kind": "pdf_page", "page": number})))
    except (ValueError, TypeError, KeyError, IndexError, AttributeError, RecursionError, OverflowError) as e:
        raise Unreadable("a broken PDF") from e
    return Extracted("complete" if out else "skipped_no_extractable_text", out).checked()

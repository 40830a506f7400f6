"""HTML sections: text by block, headings, roles; scripts, forms and embedded things left out."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from .formats import Extracted, Section, decode

#: Fixed lists of element names.
OMITTED = frozenset("script style template input button select option textarea svg iframe object embed canvas audio video math datalist progress meter".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table caption tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME = frozenset("nav aside footer noscript".split())
LANDMARKS = frozenset("banner navigation complementary contentinfo search".split())
#: An opening tag closes these open ones, up to the barriers.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"})}
CELLS, TABLE_PARTS = frozenset(("td", "th", "caption")), frozenset(("table", "tbody", "thead", "tfoot", "tr"))
HEADINGS = {f"h{i}": i for i in range(1, 7)}


def display_none(style: str) -> bool:
    """Whether the last valid ``display`` declaration hides."""
    last = ""
    for part in re.sub(r"/\*.*?\*/", "", style, flags=re.S).split(";"):
        name, _, value = part.partition(":")
        value = value.replace("!important", "").strip().lower()
        if name.strip().lower() == "display" and re.fullmatch(r"[a-z-]+(?: [a-z-]+)*", value):
            last = value
    return last == "none"


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str, int]] = []  # tag, role, heading stack's number
        self.out: list[Section] = []
        self.text: list[str] = []
        self.title, self.in_title, self.description, self.in_body = None, False, None, False
        self.skip: list[str] = []
        self.stacks: list[list[tuple[int, str]]] = [[]]  # the first is the primary one
        self.heading: int | None = None
        self.tables: list[int] = []  # for each open table, the place before it
        self.loose = ""
        self.fostered: int | None = None  # where text that stands outside cells goes on

    def role(self) -> str:
        return self.open[-1][1] if self.open else "primary"

    def flush(self) -> None:
        content = " ".join("".join(self.text).split())
        self.text = []
        if not content:
            return
        stack = self.stacks[self.open[-1][2] if self.open else 0]
        if self.heading is not None:
            while stack and stack[-1][0] >= self.heading:
                stack.pop()
            stack.append((self.heading, content))
        self.out.append(Section(content, [n for _, n in stack], self.role()))

    def close(self, tag: str) -> None:
        while self.open:
            name = self.open[-1][0]
            if name in BLOCKS:
                self.flush()
            if name in HEADINGS:
                self.heading = None
            was = self.role()
            if was == "latent" and self.role_below() != "latent":
                self.flush()
            self.open.pop()
            if name == "table" and self.tables:
                self.tables.pop()
                self.fostered = None
            if name == tag:
                return

    def role_below(self) -> str:
        return self.open[-2][1] if len(self.open) > 1 else "primary"

    def close_open(self, tags: set[str], barriers: set[str]) -> None:
        for name, _, _ in reversed(self.open):
            if name in barriers:
                return
            if name in tags:
                self.close(name)
                return self.close_open(tags, barriers)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if self.skip:
            if tag == self.skip[-1] and tag not in VOID:
                self.skip.append(tag)
            return
        if tag == "title":
            if self.in_body:
                self.skip.append(tag)  # a later title is no text of the body
            else:
                self.in_title = True
            return
        if tag == "meta":
            if not self.in_body and self.description is None and a.get("name", "").lower() == "description" and a.get("content", "").strip():
                self.description = " ".join(a["content"].split())
            return
        if tag in ("html", "head", "link", "base"):
            return
        self.in_body = True
        if tag in OMITTED:
            if tag not in VOID:
                self.skip.append(tag)
            return
        if tag in BLOCKS:
            self.close_open({"p"}, {"button", "table", "td", "th", "body"})
        if tag in HEADINGS:
            self.close_open(set(HEADINGS), {"table", "td", "th", "body"})
        if tag in CLOSES:
            self.close_open(*CLOSES[tag])
        role, stack = self.role(), self.open[-1][2] if self.open else 0
        landmark = next((r for r in a.get("role", "").lower().split() if r in LANDMARKS or r in ("main", "article", "region", "none", "presentation")), "")
        header = tag == "header" and not {"main", "article", "section"} & {t for t, _, _ in self.open}
        if role == "primary" and ("hidden" in a or a.get("aria-hidden", "").lower() == "true" or display_none(a.get("style", "")) or landmark in LANDMARKS or header or tag in CHROME):
            self.flush()
            role, stack = "latent", len(self.stacks)
            self.stacks.append([])
        if tag in BLOCKS:
            self.flush()
        if tag == "br":
            self.text.append(" ")
        if tag in CELLS or tag in TABLE_PARTS:
            self.fostered = None
        if tag == "table":
            self.tables.append(len(self.out))
        if tag not in VOID:
            self.open.append((tag, role, stack))
            if tag in HEADINGS:
                self.heading = HEADINGS[tag]
        label = a.get("aria-label", "").strip()
        if label:
            self.flush()
            self.out.append(Section(" ".join(label.split()), [n for _, n in self.stacks[stack]], "latent"))
        if tag in ("img", "area") and a.get("alt", "").strip():
            self.text.append(f" {a['alt']} ")

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.pop()
            return
        if tag == "title" and self.in_title:
            self.in_title = False
        elif any(t == tag for t, _, _ in self.open):
            self.close(tag)
        elif tag in BLOCKS:
            self.flush()

    def handle_data(self, data: str) -> None:
        if self.in_title:
            if self.title is None and data.strip():
                self.title = " ".join(data.split())
            return
        if self.skip:
            return
        if data.strip():
            self.in_body = True
        if self.outside_cells():
            self.foster(data)
        else:
            self.text.append(data)

    def outside_cells(self) -> bool:
        """Whether the nearest part of a table that is open is no cell."""
        return next((name in TABLE_PARTS for name, _, _ in reversed(self.open) if name in CELLS or name in TABLE_PARTS), False)

    def foster(self, data: str) -> None:
        """Text that a table holds outside its cells stands before the table."""
        if self.fostered is not None:
            self.loose += data
            self.out[self.fostered].content = " ".join(self.loose.split())
            return
        content, self.loose = " ".join(data.split()), data
        if not content or not self.tables:
            return
        above = next(i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == "table")
        _, role, stack = self.open[above - 1] if above else ("", "primary", 0)
        self.fostered, place = self.tables[-1], self.tables[-1]
        self.out.insert(place, Section(content, [n for _, n in self.stacks[stack]], role))
        self.tables[-1] += 1


def read(data: bytes) -> Extracted:
    text = decode(data)
    r = _Reader()
    r.feed(text)
    HTMLParser.close(r)
    r.flush()
    latent = [Section(r.description, [], "latent")] if r.description else []
    return Extracted("complete" if r.out or latent or r.title else "skipped_no_extractable_text", [*latent, *r.out], {"title": r.title} if r.title else {}, r.title).checked()

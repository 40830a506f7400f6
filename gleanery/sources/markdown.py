"""Markdown sections and YAML frontmatter."""

from __future__ import annotations

import re

import yaml

from .formats import Extracted, Section, decode

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_HTML_BLOCK = re.compile(r"^ {0,3}<(?:!--|/?(?:address|article|aside|blockquote|body|center|dd|details|dialog|dir|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|nav|ol|p|pre|script|section|style|table|tbody|td|textarea|th|thead|title|tr|ul)\b)", re.I)


class _Loader(yaml.SafeLoader):
    """YAML that keeps dates as text and refuses repeated keys."""


_Loader.yaml_implicit_resolvers = {k: [(tag, rx) for tag, rx in v if tag not in ("tag:yaml.org,2002:timestamp", "tag:yaml.org,2002:bool")] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
_Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))


def _mapping(loader: _Loader, node: yaml.MappingNode) -> dict:
    loader.flatten_mapping(node)
    out = {}
    for k, v in node.value:
        key = str(loader.construct_object(k, deep=True))
        if key in out:
            raise yaml.YAMLError(f"the key {key} is repeated")
        out[key] = loader.construct_object(v, deep=True)
    return out


_Loader.add_constructor("tag:yaml.org,2002:map", _mapping)
MAX_ALIASES = 100


class _Quick(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
    """The same rules over libyaml, where it is built in: some eight times faster."""


_Quick.yaml_implicit_resolvers = _Loader.yaml_implicit_resolvers
_Quick.add_constructor("tag:yaml.org,2002:map", _mapping)
#: Where both parsers read the same: libyaml differs on tabs, byte order marks and explicit keys, and its recursion has no net.
QUICK_CHARS, QUICK_DEPTH = 4096, 50
_ALIKE = re.compile(r"[^\t?\ufeff]*")
_DEEP = re.compile(r"(?m)^(?:.*?- ){50}")


def _quick(text: str) -> bool:
    return len(text) <= QUICK_CHARS and bool(_ALIKE.fullmatch(text)) and text.count("[") + text.count("{") <= QUICK_DEPTH and not _DEEP.search(text)


def parse_yaml(text: str):
    if len(re.findall(r"(?m)(?:^|[\s\[,:-])\*\w", text)) > MAX_ALIASES:
        raise yaml.YAMLError("too many aliases")
    return yaml.load(text, _Quick if _quick(text) else _Loader)  # noqa: S506  a safe loader's subclass


def split_frontmatter(text: str) -> tuple[str | None, str]:
    """The YAML between ``---`` at the very start and the next ``---`` line, and the rest."""
    m = re.match(r"---[ \t]*\r?\n(.*?)(?:^)---[ \t]*(?:\r?\n|\Z)", text, re.S | re.M)
    return (m[1], text[m.end() :]) if m else (None, text)


def frontmatter(text: str) -> tuple[dict, str, list[str]]:
    """Properties, body and notices; broken YAML is a notice and the body survives."""
    block, body = split_frontmatter(text)
    if block is None:
        return {}, body, []
    try:
        value = parse_yaml(block)
    except (yaml.YAMLError, RecursionError, ValueError):
        return {}, body, ["malformed frontmatter"]
    return (value if isinstance(value, dict) else {}), body, [] if isinstance(value, (dict, type(None))) else ["frontmatter is not a mapping"]


def compact(properties: dict) -> dict:
    """title, description, status and date as text, tags as a list; other shapes are left out."""
    scalar = lambda v: ("true" if v else "false") if isinstance(v, bool) else str(v)
    out = {k: scalar(v) for k in ("title", "description", "status", "date") if not isinstance(v := properties.get(k), (dict, list, type(None)))}
    tags = properties.get("tags")
    tags = tags if isinstance(tags, list) else [] if tags is None else [tags]
    return out | {"tags": [scalar(t) for t in tags if not isinstance(t, (dict, list, type(None)))]}


def aliases(properties: dict) -> list[str]:
    value = properties.get("aliases", [])
    names = value if isinstance(value, list) else [value]
    return list(dict.fromkeys(n.strip() for n in names if isinstance(n, str) and n.strip()))


def _heading_text(raw: str) -> str:
    text = re.sub(r"`+([^`]*)`+", r"\1", raw)
    text = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", text)
    return " ".join(re.sub(r"(?<!\w)[*_]{1,3}(\S(?:.*?\S)?)[*_]{1,3}(?!\w)", r"\1", text).split())


#: Marks of the containers that a line may stand in: quotes and list items.
_CONTAINER = re.compile(r" {0,3}(?:> ?|(?:[-*+]|\d{1,9}[.)])(?:[ \t]{1,4}(?=\S)))")
_RULE = re.compile(r"^ {0,3}(?:[-*_][ \t]*){3,}$")


def _inside(line: str) -> tuple[str, int]:
    """A line without the marks of quotes and list items before it, and how many there were."""
    marks = 0
    while not _RULE.match(line) and (m := _CONTAINER.match(line)):
        line, marks = line[m.end() :], marks + 1
    return line, marks


def headings(text: str) -> list[tuple[int, int, str]]:
    """(line, level, text) of ATX and setext headings, those in quotes and list items too; fences, indented code and HTML blocks hold none."""
    out, fence, html, paragraph = [], None, False, []
    for i, line in enumerate(text.split("\n")):
        line = line.rstrip("\r")
        if fence:
            if re.match(rf"^ {{0,3}}{re.escape(fence[0])}{{{len(fence)},}}[ \t]*$", line):
                fence = None
            continue
        blank = not line.strip()
        if html:
            html = not blank
            continue
        line, marks = _inside(line)
        if marks:
            paragraph = paragraph if line.strip() and _SETEXT.match(line) else []
        m = _FENCE.match(line)
        if m and not (m[1][0] == "`" and "`" in m[2]):
            fence, paragraph = m[1], []
        elif not paragraph and (line.startswith("    ") or line.startswith("\t")) and not blank:
            continue
        elif not paragraph and _HTML_BLOCK.match(line):
            html = True
        elif m := _ATX.match(line):
            out.append((i, len(m[1]), _heading_text(m[2] or "")))
            paragraph = []
        elif paragraph and (m := _SETEXT.match(line)):
            out.append((paragraph[0][0], 1 if m[1][0] == "=" else 2, _heading_text(" ".join(x for _, x in paragraph))))
            paragraph = []
        elif blank or re.match(r"^ {0,3}(?:[-*_][ \t]*){3,}$", line) or re.match(r"^ {0,3}(?:[-*+>]|\d{1,9}[.)])(?:\s|$)", line):
            paragraph = []
        else:
            paragraph.append((i, line.strip()))
    return out


def sections(text: str) -> list[Section]:
    """A section per heading, from its line to the next; the preamble has no path."""
    lines = text.split("\n")
    marks = headings(text)
    out, stack = [], []
    before = "\n".join(lines[: marks[0][0] if marks else len(lines)])
    if before.strip():
        out.append(Section(before))
    for (start, level, name), end in zip(marks, [m[0] for m in marks[1:]] + [len(lines)] * bool(marks), strict=True):
        while stack and stack[-1][0] >= level:
            stack.pop()
        stack.append((level, name))
        out.append(Section("\n".join(lines[start:end]), [n for _, n in stack if n]))
    return out


def read(data: bytes) -> Extracted:
    properties, body, notices = frontmatter(decode(data))
    return Extracted("complete", sections(body), properties, None, notices).checked()

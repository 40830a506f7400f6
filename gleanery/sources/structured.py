"""Text, YAML base files, JSON canvases and drawings."""

from __future__ import annotations

import json

import yaml

from .formats import Extracted, Section, Unreadable, decode
from .markdown import parse_yaml, sections


def read_text(data: bytes) -> Extracted:
    text = decode(data)
    return Extracted("complete", [Section(text)] if text.strip() else [])


def render(path: str, value) -> list[str]:
    """``path: value`` lines of a YAML value; steps into maps are dots, into lists brackets."""
    if isinstance(value, dict):
        return [x for k in sorted(value) for x in render(f"{path}.{k}" if path else k, value[k])] or [f"{path}: {{}}"]
    if isinstance(value, list):
        return [x for i, v in enumerate(value) for x in render(f"{path}[{i}]", v)] or [f"{path}: []"]
    return [f"{path}: " + ("null" if value is None else str(value).lower() if isinstance(value, bool) else str(value))]


def read_base(data: bytes) -> Extracted:
    try:
        root = parse_yaml(decode(data))
    except (yaml.YAMLError, RecursionError, ValueError) as e:
        raise Unreadable("invalid YAML", "quarantined") from e
    if not isinstance(root, dict) or not root:
        raise Unreadable("no configuration", "skipped_no_extractable_text")
    views = root.get("views")
    named = [v for v in views if isinstance(v, dict) and isinstance(v.get("name"), str) and v["name"].strip()] if isinstance(views, list) else []
    rest = {k: v for k, v in root.items() if k != "views" or not named}
    out = [Section("\n".join(render("", rest)))] if rest else []
    used: set[str] = set()
    for v in named:
        name, n = v["name"].strip(), 1
        heading = name
        while heading in used:
            n += 1
            heading = f"{name} ({n})"
        used.add(heading)
        out.append(Section("\n".join(render("", v)), [heading], locator=json.dumps({"kind": "base_view", "view": name})))
    return Extracted("complete", out, {k: v for k, v in root.items() if k != "views"}).checked()


def _json(data: bytes) -> dict:
    text = decode(data)
    if not text.strip():
        raise Unreadable("an empty file", "skipped_no_extractable_text")
    try:
        root = json.loads(text)
    except (ValueError, RecursionError) as e:
        raise Unreadable("invalid JSON", "quarantined") from e
    if not isinstance(root, dict):
        raise Unreadable("the root is not an object", "quarantined")
    return root


def _name(value) -> str | None:
    return value if isinstance(value, str) and value.strip() else None


def _node(node, seen: set[str]) -> tuple[str, list[Section]] | str:
    """A canvas node's id and sections, or what is wrong with it."""
    if not isinstance(node, dict) or not (key := _name(node.get("id"))):
        return "a node has no id"
    if key in seen:
        return "an id is repeated"
    seen.add(key)
    if not (kind := _name(node.get("type"))):
        return "a node has no type"
    if any(type(node.get(f)) is not int for f in ("x", "y", "width", "height")):
        return "a node's geometry is not whole"
    if kind == "text":
        text = node.get("text")
        return (key, sections(text) if text.strip() else []) if isinstance(text, str) else "a text node has no text"
    if kind == "file":
        path, sub = _name(node.get("file")), node.get("subpath", "")
        return (key, [Section(path + (f"\n{sub}" if sub.strip() else ""))]) if path and isinstance(sub, str) else "a file node has no path"
    if kind == "link":
        return (key, [Section(url)]) if (url := _name(node.get("url"))) else "a link node has no address"
    if kind == "group":
        label = node.get("label", "")
        return (key, [Section(label)] if label.strip() else []) if isinstance(label, str) else "a group's label is not text"
    return "a node's type is unknown"


def read_canvas(data: bytes) -> Extracted:
    """Nodes before edges, in file order; a bad element is left out and makes the reading partial."""
    root = _json(data)
    nodes, edges = root.get("nodes", []), root.get("edges", [])
    if not isinstance(nodes, list) or not isinstance(edges, list):
        raise Unreadable("nodes or edges are not lists", "quarantined")
    seen: set[str] = set()
    known: set[str] = set()
    out, notices = [], []
    for node in nodes:
        got = _node(node, seen)
        if isinstance(got, str):
            notices.append(got)
        else:
            known.add(got[0])
            out += got[1]
    for edge in edges:
        if not isinstance(edge, dict) or not (key := _name(edge.get("id"))) or key in seen:
            notices.append("an edge has no id of its own")
            continue
        seen.add(key)
        label = edge.get("label", "")
        if edge.get("fromNode") not in known or edge.get("toNode") not in known or not isinstance(label, str):
            notices.append("an edge leads nowhere")
        elif label.strip():
            out.append(Section(label))
    return Extracted("partial" if notices else "complete", out, notices=notices).checked()


def read_excalidraw(data: bytes) -> Extracted:
    """Text, frame names and links of elements that are not deleted, in order; of equal ids the first."""
    root = _json(data)
    elements = root.get("elements")
    if root.get("type") != "excalidraw" or not isinstance(elements, list):
        raise Unreadable("not a drawing", "quarantined")
    out, notices, seen = [], [], set()
    for e in elements:
        key = _name(e.get("id")) if isinstance(e, dict) else None
        if key is None or key in seen:
            notices.append("an element has no id of its own")
            continue
        seen.add(key)
        if e.get("isDeleted") is True:
            continue
        shown = []
        if e.get("type") == "text":
            shown.append(_name(e.get("originalText")) or _name(e.get("text")))
        elif e.get("type") in ("frame", "magicframe"):
            shown.append(_name(e.get("name")))
        shown.append(_name(e.get("link")))
        out += [Section(s) for s in shown if s]
    return Extracted("partial" if notices else "complete", out, notices=notices).checked()

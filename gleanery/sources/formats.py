"""Source formats and what a reader returns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed registry: extension to format.
EXTENSIONS = {
    "md": "markdown", "markdown": "markdown", "txt": "text", "text": "text", "base": "base", "canvas": "canvas", "excalidraw": "excalidraw",
    "html": "html", "htm": "html", "docx": "docx", "xlsx": "excel", "xlsm": "excel", "pdf": "pdf",
}
#: Fixed list of folders that enumeration does not enter.
PRUNED = (".git", ".hg", ".svn", ".obsidian", ".trash", "node_modules", "target")
COVERAGE = ("complete", "partial", "skipped_no_extractable_text", "quarantined", "unreadable")
ROLES = ("primary", "supporting", "latent")
#: Versions of the readers; part of a row's format identity.
VERSIONS = {"markdown": 1, "text": 1, "base": 1, "canvas": 1, "excalidraw": 1, "html": 3, "docx": 1, "excel": 1, "pdf": 1}
CHUNKING_VERSION = 2
MAX_BYTES = 10 << 20
MAX_SECTIONS, MAX_HEADING_BYTES = 100_000, 10 << 20


@dataclass
class Section:
    content: str
    headings: list[str] = field(default_factory=list)
    role: str = "primary"
    locator: str | None = None


@dataclass
class Extracted:
    coverage: str = "complete"
    sections: list[Section] = field(default_factory=list)
    properties: dict = field(default_factory=dict)
    title: str | None = None
    notices: list[str] = field(default_factory=list)

    def checked(self) -> Extracted:
        """Quarantined whole where sections or their headings pass the budget."""
        if len(self.sections) > MAX_SECTIONS or sum(len(h.encode()) for s in self.sections for h in s.headings) > MAX_HEADING_BYTES:
            return Extracted("quarantined", notices=["the extraction budget is spent"])
        return self


class Unreadable(Exception):
    """A source that can't be read; carries coverage and notice."""

    def __init__(self, notice: str, coverage: str = "unreadable"):
        super().__init__(notice)
        self.coverage = coverage


def decode(data: bytes) -> str:
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError as e:
        raise Unreadable("invalid UTF-8") from e
    if "\0" in text:
        raise Unreadable("binary content")
    return text


def format_of(path: Column) -> Column:
    """The format by the last extension, in any case; null if none is known."""
    known = F.create_map(*[x for k, v in EXTENSIONS.items() for x in (F.lit(k), F.lit(v))])
    return F.element_at(known, F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)))


def format_identity(fmt: str) -> str:
    return f"{fmt}/{VERSIONS[fmt]}/{CHUNKING_VERSION}"


def format_identity_of(fmt: Column) -> Column:
    """The same for a column of formats; null for none."""
    known = F.create_map(*[x for f in sorted(set(EXTENSIONS.values())) for x in (F.lit(f), F.lit(format_identity(f)))])
    return F.element_at(known, fmt)


def valid_path(path: Column) -> Column:
    """Relative and normalised: no leading slash, no empty, ``.`` or ``..`` step."""
    return (path != "") & ~path.rlike(r"(^|/)(\.{0,2})(/|$)")

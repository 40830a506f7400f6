"""Enumeration of a folder and bounded reading of its files.

Folders are listed level by level, the folders of a level side by side, so no
process holds the whole tree. Hidden names, pruned folders, links and what git
would ignore are left out. Anything that can't be listed or named makes the
enumeration defective: nothing may then be taken for deleted.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from .formats import MAX_BYTES, PRUNED

LISTED = "kind string, path string, byte_length long, mtime long, mtime_nanos decimal(38,0), rules string, message string"
MOST_RULE_BYTES = 1 << 20


# What git ignores


def _glob(pattern: str) -> str:
    """A regular expression for one pattern of an ignore file, without its anchors."""
    out, i = "", 0
    while i < len(pattern):
        rest = pattern[i:]
        if rest.startswith("**/") and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif rest == "**" and pattern[i - 1 : i] == "/":
            out, i = out + ".+", i + 2
        elif rest[0] == "*":
            out, i = out + "[^/]*", i + len(rest) - len(rest.lstrip("*"))
        elif rest[0] == "?":
            out, i = out + "[^/]", i + 1
        elif rest[0] == "[" and (end := rest.find("]", 2)) > 0:
            inner = rest[1:end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", i + end + 1
        elif rest[0] == "\\" and len(rest) > 1:
            out, i = out + re.escape(rest[1]), i + 2
        else:
            out, i = out + re.escape(rest[0]), i + 1
    return out


def ignore_rules(text: str, folder: str) -> list[list]:
    """Of an ignore file in ``folder``: [regular expression over paths, whether it takes back, whether it is for folders alone]."""
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        back = line.startswith("!")
        line = line[1:] if back else line
        only_folders = line.endswith("/")
        line = line.rstrip("/")
        if not line:
            continue
        anywhere = "/" not in line
        base = re.escape(folder + "/") if folder else ""
        out.append([f"{base}{'(?:.*/)?' if anywhere else ''}{_glob(line.lstrip('/'))}", back, only_folders])
    return out


def ignored(path: str, is_folder: bool, rules: list[list]) -> bool:
    """The last rule that fits decides."""
    verdict = False
    for pattern, back, only_folders in rules:
        if (is_folder or not only_folders) and re.fullmatch(pattern, path):
            verdict = not back
    return verdict


# Listing


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if re.match(r"[a-z0-9]+:/", uri) else f"file://{uri}")


def _is_link(fs, path: str) -> bool:
    import os

    return fs.type_name == "local" and os.path.islink(path)


def _list_one(fs, root: str, folder: str, rules: list[list]) -> Iterator[dict]:
    from pyarrow import fs as pfs

    where = f"{root}/{folder}" if folder else root
    try:
        entries = sorted(fs.get_file_info(pfs.FileSelector(where)), key=lambda e: e.base_name)
        mine = next((e for e in entries if e.base_name == ".gitignore" and e.is_file and e.size <= MOST_RULE_BYTES), None)
        if mine:
            with fs.open_input_stream(mine.path) as f:
                rules = [*rules, *ignore_rules(f.read().decode("utf-8", "replace"), folder)]
    except OSError as e:
        yield {"kind": "warning", "path": folder, "message": str(e)}
        return
    for e in entries:
        name = e.base_name
        path = f"{folder}/{name}" if folder else name
        is_folder = e.type == pfs.FileType.Directory
        if name.startswith(".") or (is_folder and name in PRUNED) or _is_link(fs, e.path) or ignored(path, is_folder, rules):
            continue
        try:
            path.encode()
        except UnicodeEncodeError:
            yield {"kind": "warning", "path": folder, "message": "a name is not valid UTF-8"}
            continue
        if is_folder:
            yield {"kind": "folder", "path": path, "rules": json.dumps(rules)}
        elif e.is_file:
            yield {"kind": "file", "path": path, "byte_length": e.size, "mtime": (e.mtime_ns or 0) // 1_000_000_000, "mtime_nanos": e.mtime_ns or 0}


def enumerate_tree(spark: SparkSession, root: str) -> DataFrame:
    """Rows (kind, path, byte_length, mtime, mtime_nanos, message): files, and warnings. Paths are relative to the root."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(LISTED)
    shape = to_arrow_schema(schema)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _fs(root)
        for b in batches:
            for folder, rules in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = [dict.fromkeys(schema.names) | r for r in _list_one(fs, base, folder, json.loads(rules))]
                yield pa.RecordBatch.from_pylist(rows, schema=shape)

    level = spark.createDataFrame([("", "[]")], "path string, rules string")
    found, folders = None, 1
    while folders:
        here = cut(level.repartition(min(folders, 4096)).mapInArrow(look, schema))
        rows = here.where("kind <> 'folder'")
        found = rows if found is None else found.unionByName(rows)
        level = here.where("kind = 'folder'").select("path", "rules")
        folders = level.count()
    return found.drop("rules")


def is_complete(listed: DataFrame) -> bool:
    """Whether what isn't listed may be taken for gone."""
    return listed.where("kind = 'warning'").isEmpty()


# Reading


def read_files(listed: DataFrame, root: str, most: int = MAX_BYTES) -> DataFrame:
    """(path, byte_length, mtime, content, transient): each file read once, whole, and only if it did not change meanwhile.

    Files above ``most`` bytes are not read (content null). ``transient`` says
    that a file changed or went while it was read; what is known of it stands.
    """
    schema = "path string, byte_length long, mtime long, content binary, transient boolean"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _fs(root)
        names = ["path", "byte_length", "mtime", "content", "transient"]
        for b in batches:
            for path, length, mtime in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                data, stale = None, False
                if length <= most:
                    try:
                        before = fs.get_file_info(f"{base}/{path}")
                        with fs.open_input_stream(f"{base}/{path}") as f:
                            data = f.read(most + 1)
                        after = fs.get_file_info(f"{base}/{path}")
                        stale = not before.is_file or (before.size, before.mtime_ns) != (after.size, after.mtime_ns) or len(data) != length
                    except OSError:
                        stale = True
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([length], pa.int64()), pa.array([mtime], pa.int64()), pa.array([None if stale else data], pa.binary()), pa.array([stale])], names=names)

    return listed.where("kind = 'file'").select("path", "byte_length", "mtime").mapInArrow(read, schema)


def retained_rows(old: DataFrame, read: DataFrame, key: str = "path") -> DataFrame:
    """Rows of an old manifest whose sources could not be read this time: they stay as they are."""
    return old.join(read.where("transient").select(F.col(key)), key, "left_semi")

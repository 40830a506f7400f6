"""Text functions, ignore rules, stored tables, streams' helpers: the driver's and the columns' forms agree, odd input included."""

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleanery.functions import chunking, text
from gleanery.operators import index as I
from gleanery.operators import manifest as M
from gleanery.operators import properties as R
from gleanery.operators import search as S
from gleanery.sources import prepare, tree
from gleanery.streaming import reconcile as ST

from .test_engine import NOTES, files

ODD_TEXTS = ["", " ", "\tTitle here", "a b c", "Ünïcode É", "é combining", "한국어 글", "ΟΔΟΣ ὈΔΥΣΣΕΎΣ", "İstanbul ıI", "𝔘𝔫𝔦 𐐀𐐁", "हिन्दी में", "straße ẞ", "ﬁ ligature", "a_b-c", "x" * 45 + " y", None]


def test_folding_in_columns_is_folding_on_the_driver(spark):
    rows = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "i int, t string")
    got = rows.select("t", text.fold(F.col("t")).alias("f"), text.normalized(F.col("t")).alias("n"), F.filter(text.tokens(F.col("t")), text.short_token).alias("w")).collect()
    for r in got:
        if r.t is None:
            assert r.f is None and r.n is None
            continue
        assert r.f == text.fold_text(r.t) and r.n == text.normalize_text(r.t)
        assert r.w == text.tokenize(r.t)


def test_every_character_folds_by_the_table():
    before, after, other = text._fold_table()
    table = dict(zip(before, after, strict=False)) | dict.fromkeys(before[len(after) :], "")
    for code in (*range(128, 0xD800, 7), *range(0xE000, 0x10000, 3)):
        c = chr(code)
        folded = text.fold_text(c)
        assert table.get(c, c) == folded or len(folded) > 1
    assert "가" not in table and unicodedata.normalize("NFD", "가") == text.fold_text("가")


@given(st.text(max_size=300), st.text(min_size=1, max_size=4))
@settings(max_examples=150, deadline=None)
def test_excerpts_are_parts_of_the_text(content, term):
    out = text.hydrate_excerpt(content, [text.fold_text(term)])
    flat = text.re.sub(f"[{text.WHITE}]+", " ", content).strip(" ")
    assert out.removeprefix("…").removesuffix("…") in flat or out.strip("…") in flat


def test_excerpt_stands_at_its_hit_where_folding_changes_lengths():
    assert "바늘" in text.hydrate_excerpt("한국어 " * 100 + "바늘 끝", [text.fold_text("바늘")])


@given(st.text(alphabet=st.sampled_from("ab \n\t"), max_size=400))
@settings(max_examples=200, deadline=None)
def test_parts_hold_every_word(body):
    parts = chunking.split_long(body, most=40, overlap=8)
    assert all(0 < len(p) <= 40 for p in parts)
    assert "".join(body.split()) == "" or parts
    if parts:
        assert body.strip().startswith(parts[0]) and body.strip().endswith(parts[-1])


def test_ignore_rules():
    rules = tree.ignore_rules("# no\n*.log\n!keep.log\nbuild/\n/top.md\nsub/*.txt\n**/deep/x?.md\n[ab].c\n", "")
    skipped = lambda p, folder=False: tree.ignored(p, folder, rules)
    assert skipped("a/b.log") and not skipped("a/keep.log") and skipped("x/build", True) and not skipped("x/build")
    assert skipped("top.md") and not skipped("a/top.md") and skipped("sub/a.txt") and not skipped("sub/s/a.txt")
    assert skipped("q/deep/x1.md") and skipped("deep/x1.md") and skipped("z/a.c") and not skipped("z/c.c")
    assert tree.ignored("r/a/b.md", False, tree.ignore_rules("a/b.md\n", "r")) and not tree.ignored("a/b.md", False, tree.ignore_rules("a/b.md\n", "r"))


def test_a_folder_that_cannot_be_listed_makes_enumeration_defective(spark, tmp_path):
    (tmp_path / "a.md").write_text("x")
    (tmp_path / "link.md").symlink_to(tmp_path / "a.md")
    listed = tree.enumerate_tree(spark, f"file://{tmp_path}")
    assert tree.is_complete(listed) and [r.path for r in listed.collect()] == ["a.md"]
    assert not tree.is_complete(tree.enumerate_tree(spark, f"file://{tmp_path}/gone"))


def test_changed_files_are_transient(spark, tmp_path):
    (tmp_path / "a.md").write_text("words")
    listed = tree.enumerate_tree(spark, f"file://{tmp_path}").cache()
    assert listed.count() == 1
    (tmp_path / "a.md").write_text("other words")
    read = tree.read_files(listed, f"file://{tmp_path}")
    assert [(r.transient, r.content) for r in read.collect()] == [(True, None)]
    old = spark.createDataFrame([("a.md", 1), ("b.md", 2)], "path string, n int")
    assert [r.path for r in tree.retained_rows(old, read).collect()] == ["a.md"]


def test_stored_index_answers_like_one_that_is_made(spark, tmp_path):
    rows = files(spark, NOTES).unionByName(files(spark, {f"x{i}.md": "river river stone" for i in range(4)}, "v", None))
    sources = prepare.prepare(rows).cache()
    chunks = prepare.chunks(sources).cache()
    kept = M.Generations(spark, f"file://{tmp_path}/g")
    kept.publish_index(sources, chunks)
    for resources in (None, [("v", "r")], [("v", None)], [("w", "r")]):
        made, opened = S.Index(chunks, resources=resources), S.Index.opened(kept.reader(), resources)
        for q in ("river stone", "ston", "RFC 7230", "tags:water OR wall", "résumé café"):
            found = lambda ix: [(r.chunk_id, r.tier, r.score, r["rank"]) for r in ix.search(q).orderBy("rank").collect()]  # noqa: B023, E731
            assert found(made) == found(opened)
    plan = S.Index.opened(kept.reader())._of(["river"], ("content",))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "In(term" in plan.replace("EqualTo(term", "In(term") and "Exchange" not in plan


def test_postings_apply_what_changed(spark):
    chunks = prepare.chunks(prepare.prepare(files(spark, NOTES))).cache()
    new = prepare.chunks(prepare.prepare(files(spark, {"stone.md": "# New\nwords", "fresh.md": "a river"})))
    gone = spark.createDataFrame([("v", "plain.txt")], "vault_id string, path string")
    after = I.apply_postings(I.postings(I.fields(chunks)), new, gone)
    whole = chunks.where("path NOT IN ('stone.md', 'plain.txt')").unionByName(new.select(*chunks.columns))
    rows = lambda p: sorted(map(str, p.collect()))
    assert rows(after) == rows(I.postings(I.fields(whole)).select(*after.columns))


def test_publishers_that_race(spark, tmp_path):
    g = M.Generations(spark, f"file://{tmp_path}/g")
    g.publish({"t": spark.range(1)})
    taken = g.list
    g.list = lambda: taken()[:0] if not hasattr(g, "asked") and not setattr(g, "asked", True) else taken()  # the first look is out of date
    assert g.publish({"t": spark.range(2)}) == "gen-00000002" and g.read("t").count() == 2


def test_manifest_is_checked(spark):
    columns = "source_key string, vault_id string, path string, format string, format_identity string, outcome string, content_hash string, byte_length long, chunk_count long"
    row = ("s", "v", "p", "text", "text/1/2", "indexed", "h", 1, 1)
    make = lambda *rows: spark.createDataFrame(list(rows), columns)
    stale = ("t", "v", "q", "text", "text/0/2", "indexed", "h", 1, 1)
    current = spark.createDataFrame([("text", "text/1/2")], "format string, format_identity string")
    assert [r.source_key for r in M.load_manifest(make(row, stale), current).collect()] == ["s"]
    for bad in (make(row, row), make((*row[:5], "other", *row[6:])), make((*row[:5], "skipped", *row[6:])), make(row).drop("path")):
        with pytest.raises(ValueError):
            M.load_manifest(bad)


def test_whole_numbers_are_not_doubles(spark):
    rows = spark.createDataFrame([(i, f'{{"n": {2**53 + i}}}') for i in range(3)], "source_key long, j string")
    points = R.property_points(R.property_scalars(rows, "source_key", "j"), [R.PropertyRule("r", "n", 1, "i64", low=2**53 + 1, high=2**53 + 1)])
    assert {r.source_key: r.points for r in points.collect()} == {0: 0, 1: 1, 2: 0}


def test_safety_stream_and_merge(spark):
    ticks = ST.safety_stream(spark, ["a", "b"], every=1)
    assert ticks.isStreaming and set(ticks.columns) == {"vault_id", "first_ms", "last_ms", "n_events", "n_paths", "full_rescan", "paths"}
    batch = lambda *rows: spark.createDataFrame(list(rows), "vault_id string, paths array<string>, full_rescan boolean")
    got = {r.vault_id: (r.paths, r.full_rescan) for r in ST.merge_back(batch(("a", ["x"], False), ("b", [], True)), batch(("a", ["y", "x"], False), ("c", ["z"], False))).collect()}
    assert got == {"a": (["x", "y"], False), "b": ([], True), "c": (["z"], False)}


def test_html_tables_and_late_titles():
    from gleanery.sources import html

    page = b"<title>T</title><h1>H</h1><p>a<table>loose <b>text</b><tr><td>one</td>more<td>two</td></tr><title>late</title><tr><td>x<table>in<tr><td>y</table></td></tr></table><p>b"
    got = html.read(page)
    assert got.title == "T"
    assert [(s.content, s.headings) for s in got.sections] == [(c, ["H"]) for c in ("H", "a", "loose text", "more", "one", "two", "x", "in", "y", "b")]


def test_headings_in_containers():
    from gleanery.sources import markdown

    doc = "> # Quoted\n> words\n\n- ## Item\n- plain\n\n1. ### Third\n\n* * *\n\n> > Deep\n> > ====\n\nText\n- - -\n"
    assert [(level, name) for _, level, name in markdown.headings(doc)] == [(1, "Quoted"), (2, "Item"), (3, "Third"), (1, "Deep")]


def test_tables_in_word_processing():
    from gleanery.sources import office

    from .test_engine import packed

    w = f'xmlns:w="{office.W[1:-1]}"'
    run = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r><w:r><w:rPr><w:vanish/></w:rPr><w:t>({t})</w:t></w:r></w:p>"
    inner = f"<w:tbl><w:tr><w:tc>{run('in')}</w:tc></w:tr></w:tbl>"
    body = f"<w:document {w}><w:body><w:tbl><w:tr><w:tc>{run('a')}</w:tc><w:tc>{run('b')}{inner}</w:tc></w:tr></w:tbl></w:body></w:document>"
    got = office.read_docx(packed({"word/document.xml": body}))
    assert got.coverage == "partial" and got.notices == ["a table stands inside a table"]
    assert [(s.content, s.role) for s in got.sections] == [("a\tb\nin", "primary"), ("(a)\t(b)\n(in)", "latent")]


def made_pdf(*pages, encrypted=False, packed=False):
    """A PDF whose pages are lists of (x, y, size, text)."""
    import zlib

    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding /FirstChar 32 /Widths [" + b"500 " * 224 + b"] >>"}
    kids = []
    for i, page in enumerate(pages):
        body = b"".join(b"BT /F1 %d Tf 1 0 0 1 %d %d Tm (%s) Tj ET\n" % (size, x, y, t.encode("cp1252").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")) for x, y, size, t in page)
        objects[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * i)
        body = zlib.compress(body) if packed else body
        objects[11 + 2 * i] = b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(body), b"/Filter /FlateDecode" if packed else b"", body)
        kids.append(b"%d 0 R" % (10 + 2 * i))
    objects[2] = b"<< /Type /Pages /Count %d /Kids [%s] /Resources << /Font << /F1 3 0 R >> >> >>" % (len(pages), b" ".join(kids))
    data = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in objects.items())
    return data + b"trailer << /Root 1 0 R " + (b"/Encrypt 9 0 R " if encrypted else b"") + b">>\n%%EOF"


@pytest.mark.parametrize("packed", [False, True])
def test_pdf_pages(packed):
    from gleanery.sources import pdf

    left = [(50, 700 - 12 * i, 10, f"left {i}") for i in range(5)]
    right = [(300, 700 - 12 * i, 10, f"right {i}") for i in range(5)]
    head = [(50, 760, 10, "The (whole) title"), (150, 760, 10, "é")]
    row = [(50, 500, 10, "a"), (200, 500, 10, "b"), (50, 488, 10, "c"), (200, 488, 10, "d")]
    got = pdf.read(made_pdf([*right, *left, *head], [], row, packed=packed))
    assert [json_page(s) for s in got.sections] == [1, 3] and got.coverage == "complete"
    assert got.sections[0].content == "The (whole) title é\n\n" + "\n".join(f"left {i}" for i in range(5)) + "\n\n" + "\n".join(f"right {i}" for i in range(5))
    assert got.sections[1].content == "a b\nc d"
    assert pdf.read(made_pdf([], packed=packed)).coverage == "skipped_no_extractable_text"
    for bad in (b"", b"words", made_pdf([], encrypted=True)):
        with pytest.raises(pdf.Unreadable):
            pdf.read(bad)


def json_page(section) -> int:
    import json

    return json.loads(section.locator)["page"]


def test_pdf_fonts_with_maps():
    from gleanery.sources import pdf

    cmap = b"1 beginbfchar <0001> <00480069> endbfchar 1 beginbfrange <0002> <0004> <0061> endbfrange"
    body = b"BT /F 12 Tf 1 0 0 1 10 10 Tm [<0001> -800 <00020003>] TJ <0004> Tj ET"
    data = b"%PDF-1.5\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Kids [3 0 R] >> endobj 3 0 obj << /Type /Page /Contents 4 0 R /Resources << /Font << /F 5 0 R >> >> >> endobj "
    data += b"4 0 obj << /Length %d >> stream\n%s\nendstream endobj 5 0 obj << /Subtype /Type0 /ToUnicode 6 0 R /DescendantFonts [<< /DW 1000 >>] >> endobj 6 0 obj << /Length %d >> stream\n%s\nendstream endobj" % (len(body), body, len(cmap), cmap)
    assert [s.content for s in pdf.read(data).sections] == ["Hi abc"]


@given(st.binary(max_size=300))
@settings(max_examples=200, deadline=None)
def test_any_bytes_are_read_or_refused(data):
    from gleanery.sources import pdf

    for some in (data, b"%PDF-1.4\n" + data, made_pdf([(1, 1, 9, "x")])[: -len(data) or None] + data):
        try:
            pdf.read(some)
        except pdf.Unreadable:
            pass


@given(st.text(alphabet="ab", max_size=6), st.text(alphabet="ab", max_size=6))
def test_one_edit(a, b):
    from gleanery import abi

    near = {a[:i] + c + a[i + cut :] for i in range(len(a) + 1) for cut in (0, 1) for c in ("", "a", "b")} - {a}
    assert abi.one_edit(a, b) == (b in near)


def test_calls_without_a_session():
    from gleanery import abi
    from gleanery.plans.planner import QueryError

    got = abi.prepare_source({"vault_id": "v", "path": "a/b.md"}, b"# T\nwords")
    assert got["coverage"] == "complete" and got["chunks"][0]["heading_path"] == ["T"]
    assert abi.prepare_oversized({"vault_id": "v", "path": "b.html", "byte_length": 20 << 20})["coverage"] == "quarantined"
    for bad in ({"vault_id": "v", "path": "../b.md"}, {"path": "b.md"}, {"vault_id": "v", "path": "b.zip"}, {"vault_id": "v", "path": "b.md", "format": "text"}):
        with pytest.raises(ValueError):
            abi.prepare_source(bad, b"")
    with pytest.raises(ValueError):
        abi.prepare_oversized({"vault_id": "v", "path": "b.md", "byte_length": 5})
    plan = abi.prepare_query("river ston")
    assert [t["text"] for t in plan["terms"]] == ["river", "ston"]
    done = abi.finalize_query("river ston", {0: 3, 1: 0}, {1: ["stone"]})
    assert [s["kind"] for s in done["stages"]][:3] == ["exact_metadata", "exact_phrase", "prefix_metadata"]
    for evidence in (({5: 1}, None), ({0: 1}, {1: ["x"] * 17})):
        with pytest.raises(QueryError):
            abi.finalize_query("river ston", *evidence)
    assert abi.prepare_typo("Nichz")["prefix"] == "nich" and abi.prepare_typo("two words")["term"] is None
    assert abi.finalize_typo("nichz", [("nicht", 3), ("niche", 9), ("nichts", 99)]) == "niche"

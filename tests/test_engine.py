"""Search, readers, maintenance and streams on small hand-made corpora."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from gleanery.functions import chunking, text
from gleanery.operators import index as I
from gleanery.operators import manifest as M
from gleanery.operators import properties as R
from gleanery.operators import search as S
from gleanery.operators import semantic as V
from gleanery.sources import html, markdown, office, prepare, structured
from gleanery.sources.formats import Unreadable, valid_path
from gleanery.streaming import reconcile as ST

NOTES = {
    "river-notes.md": "---\ntitle: River Stone\ntags: [water, rock]\naliases: [Old Bed]\n---\nIntro text.\n\n# Flow\nThe river moves a stone. See [[banks|edge]].\n\n## Depth\nDeep water.\n",
    "stone.md": "# Stonework\nA stone wall by the river, stone on stone.\n",
    "plain.txt": "river and more river; RFC 7230 says so",
    "cafe.md": "---\ntitle: Résumé Café\n---\nnaïve words",
    "deep/a/other.md": "nothing of note here",
}


def files(spark, notes, vault="v", room="r"):
    rows = [(vault, room, p, bytearray(t.encode()), len(t.encode()), 100) for p, t in notes.items()]
    return spark.createDataFrame(rows, "vault_id string, room string, path string, content binary, byte_length long, mtime long")


@pytest.fixture(scope="module")
def ix(spark):
    return S.Index(prepare.chunks(prepare.prepare(files(spark, NOTES))).cache()).cached()


def found(frame):
    return [(r.path, r.tier) for r in frame.orderBy("rank").collect()]


def test_name_beats_body(ix):
    got = found(ix.search("river stone"))
    assert got[0] == ("river-notes.md", "exact_metadata")
    assert ("stone.md", "exact_phrase") in got


def test_phrase_stands_before_all_terms(ix):
    assert found(ix.search("stone wall"))[0] == ("stone.md", "exact_phrase")


def test_prefix_of_a_name(ix):
    assert {("stone.md", "prefix_metadata"), ("river-notes.md", "prefix_metadata")} <= set(found(ix.search("ston")))
    assert found(ix.search("stonew")) == [("stone.md", "prefix")]


def test_relaxed(ix):
    got = found(ix.search("river moves zzqq"))
    assert got and got[0][1] == "partial_coverage"


def test_accents(ix):
    for q in ("Résumé Café", "resume cafe", "Résumé Café"):
        assert found(ix.search(q))[0] == ("cafe.md", "exact_metadata")


def test_identifier(ix):
    assert {p for p, _ in found(ix.search("RFC 7230"))} == {"plain.txt"}
    assert found(ix.search("RFC 9999 river")) == []


def test_explicit(ix):
    assert {p for p, _ in found(ix.search("river NOT stone"))} == {"plain.txt"}
    assert {p for p, _ in found(ix.search("tags:water OR wall"))} == {"river-notes.md", "stone.md"}
    assert {p for p, _ in found(ix.search('"stone wall"'))} == {"stone.md"}


def test_filters_change_no_score(ix):
    everything = {r.chunk_id: r.score for r in ix.search("river").collect()}
    some = ix.search("river", S.Filters(path_prefix="plain")).collect()
    assert [everything[r.chunk_id] for r in some] == [r.score for r in some] and len(some) == 1
    assert {p for p, _ in found(ix.search("river", S.Filters(tags=("water", "rock"))))} == {"river-notes.md"}
    with pytest.raises(S.P.QueryError):
        S.Filters(path_prefix="../x")
    with pytest.raises(S.P.QueryError):
        S.Filters(frontmatter={"other": "x"})


def test_other_rooms_change_nothing(spark, ix):
    more = files(spark, {f"x{i}.md": "river river stone" for i in range(5)}, "v", "hidden")
    chunks = prepare.chunks(prepare.prepare(files(spark, NOTES).unionByName(more)))
    scoped = S.Index(chunks, resources=[("v", "r")])
    rows = lambda i: [(r.chunk_id, r.tier, r.score) for r in i.search("river stone").orderBy("rank").collect()]
    assert rows(scoped) == rows(ix)


def test_incremental_equals_rebuild(spark):
    before = prepare.chunks(prepare.prepare(files(spark, NOTES)))
    changed = dict(NOTES, **{"stone.md": "# New\nother words", "new.md": "fresh river"})
    gone = changed.pop("plain.txt") and prepare.prepare(files(spark, {"plain.txt": NOTES["plain.txt"]})).select("source_key")
    whole = prepare.chunks(prepare.prepare(files(spark, changed)))
    part = prepare.chunks(prepare.prepare(files(spark, {k: changed[k] for k in ("stone.md", "new.md")})))
    after = I.apply_sources(before, part, gone)
    rows = lambda c: sorted(map(str, I.postings(I.fields(c)).collect()))
    assert rows(after) == rows(whole)


def test_hits_and_groups(ix):
    hits = ix.hits("river").collect()
    assert all(h.excerpt and h.vault_id == "v" for h in hits)
    grouped = S.group_sources(ix.hits("river")).orderBy("group").collect()
    assert [g.group for g in grouped] == list(range(1, len(grouped) + 1))


def test_text_functions():
    assert text.fold_text("Résumé ß İ Ø") == "resume ß i ø"
    assert text.normalize_text("  A \n b ") == "a b" and text.normalize_text(" ") is None
    assert [n for _, _, n in text.identifier_spans("see CVE-2026-1 or v2.4.1, plain, 2026-01")] == ["cve-2026-1", "v2.4.1", "2026-01"]
    assert text.hydrate_excerpt("word " * 200 + "needle tail", ["needle"]).count("needle") == 1
    assert text.highlight_terms("title:River AND stone") == ["river", "stone"]


def test_snippet(spark):
    row = spark.createDataFrame([("a <b> river & stone",), (None,)], "t string").select(text.snippet(["River"])("t").alias("s")).collect()
    assert row[0].s == "a &lt;b&gt; <b>river</b> &amp; stone" and row[1].s is None


def test_split_long():
    body = ("x" * 99 + " ") * 100
    parts = chunking.split_long(body)
    assert all(len(p) <= 4000 for p in parts) and parts[0][-380:] in parts[1] + " " * 0 or len(parts) == 3
    assert chunking.split_long("short") == ["short"] and chunking.split_long(" \n ") == []
    assert chunking.split_long("a" * 3500 + "\n\n" + "b" * 3000)[0] == "a" * 3500


def test_markdown():
    doc = "pre\n\nTitle\n=====\ntext\n```\n# no heading\n```\n## Sub `code`\nmore\n# Next #\n"
    got = markdown.read(doc.encode()).sections
    assert [s.headings for s in got] == [[], ["Title"], ["Title", "Sub code"], ["Next"]]
    bad = markdown.read(b"---\na: [\n---\nbody survives")
    assert bad.notices and bad.sections[0].content == "body survives"
    assert markdown.frontmatter("---\na: 1\na: 2\n---\nx")[2]
    assert markdown.frontmatter("---\nday: 2024-02-03\nyes: no\n---\n")[0] == {"day": "2024-02-03", "yes": "no"}


def test_html():
    page = "<html><head><title>T &amp; t</title><meta name=description content='about it'></head><body><nav>menu</nav><h1>One</h1><p>first <b>bold<p>second<div hidden>away</div><h2>Two</h2><ul><li>a<li>b</ul><script>no()</script><div style='display:block;display:none'>gone</div><img alt=pic></body>"
    got = html.read(page.encode())
    assert got.title == "T & t"
    assert [(s.content, s.headings, s.role) for s in got.sections] == [
        ("about it", [], "latent"), ("menu", [], "latent"), ("One", ["One"], "primary"), ("first bold", ["One"], "primary"), ("second", ["One"], "primary"), ("away", [], "latent"),
        ("Two", ["One", "Two"], "primary"), ("a", ["One", "Two"], "primary"), ("b", ["One", "Two"], "primary"), ("gone", [], "latent"), ("pic", ["One", "Two"], "primary"),
    ]


def test_structured():
    base = structured.read_base(b"name: x\nlimit: 2.5\nviews:\n - name: A\n   order: [p, q]\n - name: A\n")
    assert [s.headings for s in base.sections] == [[], ["A"], ["A (2)"]]
    assert "order[1]: q" in base.sections[1].content
    g = {"x": 0, "y": 0, "width": 1, "height": 1}
    canvas = {"nodes": [{"id": "a", "type": "text", "text": "# H\nbody", **g}, {"id": "b", "type": "link", "url": "u", **g}, {"id": "c", "type": "text", "text": "t", "x": 0.5}], "edges": [{"id": "e", "fromNode": "a", "toNode": "b", "label": "goes"}, {"id": "f", "fromNode": "a", "toNode": "zz", "label": "lost"}]}
    got = structured.read_canvas(json.dumps(canvas).encode())
    assert got.coverage == "partial" and [s.content for s in got.sections] == ["# H\nbody", "u", "goes"]
    drawing = {"type": "excalidraw", "elements": [{"id": "1", "type": "text", "text": "wrap\nped", "originalText": "wrapped"}, {"id": "2", "type": "text", "text": "x", "isDeleted": True}, {"id": "3", "type": "frame", "name": "F", "link": "l"}]}
    assert [s.content for s in structured.read_excalidraw(json.dumps(drawing).encode()).sections] == ["wrapped", "F", "l"]
    for bad in (b"{", b"\xff", b"[]"):
        with pytest.raises(Unreadable):
            structured.read_canvas(bad)


def packed(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return out.getvalue()


def test_docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>text</w:t></w:r><w:del><w:r><w:delText>old</w:delText></w:r></w:del></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    rels = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="x/styles" Target="styles.xml"/></Relationships>'
    styles = f'<w:styles {w}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>'
    got = office.read_docx(packed({"word/document.xml": body, "word/_rels/document.xml.rels": rels, "word/styles.xml": styles}))
    assert [(s.content, s.headings, s.role) for s in got.sections] == [("Head", ["Head"], "primary"), ("text", ["Head"], "primary"), ("a\tb", ["Head"], "primary"), ("old", ["Head"], "latent")]


def test_excel():
    m, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    book = f'<workbook xmlns="{m}" xmlns:r="{r}"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>'
    rels = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="x/worksheet" Target="worksheets/s.xml"/><Relationship Id="r2" Type="x/sharedStrings" Target="sst.xml"/></Relationships>'
    sheet = f'<worksheet xmlns="{m}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><f>1+1</f><v>2</v></c></row><row r="2" hidden="1"><c r="A2"><v>9</v></c></row></sheetData></worksheet>'
    got = office.read_excel(packed({"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels, "xl/worksheets/s.xml": sheet, "xl/sst.xml": f'<sst xmlns="{m}"><si><t>hi</t></si></sst>'}))
    assert [(s.content, s.role) for s in got.sections] == [("S", "primary"), ("hi", "primary"), ("2", "primary"), ("1+1", "latent"), ("9", "latent")]
    assert office.a1("AB12") == (12, 28) and office.a1_name(12, 28) == "AB12"


def test_prepare_odd_sources(spark):
    rows = [("v", None, "big.html", None, 20 << 20, 1), ("v", None, "bad.txt", bytearray(b"\xff"), 1, 1), ("v", None, "x.zip", bytearray(b"z"), 1, 1), ("v", None, "../up.md", bytearray(b"z"), 1, 1), ("v", None, "only.md", bytearray(b"---\ntitle: T\n---\n"), 17, 1)]
    got = {r.path: r for r in prepare.prepare(spark.createDataFrame(rows, "vault_id string, room string, path string, content binary, byte_length long, mtime long")).collect()}
    assert {p: r.coverage for p, r in got.items()} == {"big.html": "quarantined", "bad.txt": "unreadable", "x.zip": "unreadable", "only.md": "complete"}
    assert got["only.md"].chunk_count == 1 and got["only.md"].title == "T"


def test_tree(spark, tmp_path):
    for name in ("a.md", "sub/b.txt", ".git/c.md", "node_modules/d.md", "e.bin"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("words")
    got = prepare.read_tree(spark, f"file://{tmp_path}", "v").select("path").collect()
    assert sorted(r.path for r in got) == ["a.md", "sub/b.txt"]
    rows = spark.createDataFrame([("a/b",), ("/a",), ("a//b",), ("a/../b",), ("",)], "p string").select(valid_path(F.col("p")).alias("k")).collect()
    assert [r.k for r in rows] == [True, False, False, False, False]


def test_roles_lead_chunk_ids(spark):
    rows = spark.createDataFrame([("primary",), ("supporting",), ("latent",)], "role string")
    got = rows.select("role", I.chunk_id(F.lit("v"), F.lit("p"), F.array(F.lit("h")), F.lit(0), F.col("role")).alias("i")).collect()
    assert [int(r.i[0], 16) // 4 for r in got] == [0, 1, 2] and all(len(r.i) == 64 for r in got)


def test_generations(spark, tmp_path):
    g = M.Generations(spark, f"file://{tmp_path}/gens")
    assert g.current() is None
    for n in range(5):
        g.publish({"chunks": spark.range(n), "sources": spark.createDataFrame([(n,)], "chunk_count long")})
    assert g.current() == "gen-00000005" and len(g.list()) == 3 and g.read("chunks").count() == 4
    with pytest.raises(ValueError):
        g.publish({"chunks": spark.range(3), "sources": spark.createDataFrame([(1,)], "chunk_count long")})
    assert g.current() == "gen-00000005" and g.read("chunks").count() == 4


def test_rolling_audit(spark):
    rows = spark.createDataFrame([(f"k{i}", 40 if i == 3 else 10) for i in range(6)], "source_key string, byte_length long")
    assert M.rolling_audit(rows, "k1", sources=3, budget=35) == ["k2", "k4", "k5"]
    assert M.rolling_audit(rows, "k4", sources=3, budget=99) == ["k5", "k0", "k1"]


def test_rerank_stays_in_tiers(spark):
    hits = spark.createDataFrame([("a", "s1", "x/a.md", 0, 1), ("b", "s2", "keep/b.md", 1, 2), ("c", "s3", "y/c.md", 1, 3), ("d", "s4", "keep/d.md", 1, 4)], "chunk_id string, source_key string, path string, tier_no int, rank int")
    sources = spark.createDataFrame([(f"s{i}", 1000) for i in range(1, 5)], "source_key string, mtime long")
    got = R.rerank(hits, sources, R.Profile(folders=(("keep", 4), ("y", -2))), 2000).orderBy("new_rank").collect()
    assert [r.chunk_id for r in got] == ["a", "b", "d", "c"]
    with pytest.raises(ValueError):
        R.Profile(folders=(("a", 3),))


def test_properties_keep_types(spark):
    rows = spark.createDataFrame([("s1", '{"ok": true, "n": 3, "deep": {"a/b": [1.5, "2024-01-31"]}}'), ("s2", '{"ok": "true", "n": 18446744073709551615}'), ("s3", "broken"), ("s4", None)], "source_key string, j string")
    scalars = R.property_scalars(rows, "source_key", "j")
    got = {(r.source_key, r.property, r.pointer): (r.scalar_type, r.exact_value, r.date_value) for r in scalars.collect()}
    assert got[("s1", "deep", "/a~1b/1")] == ("string", "2024-01-31", "2024-01-31") and got[("s2", "n", "")][0] == "u64"
    points = R.property_points(scalars, [R.PropertyRule("r", "ok", 2, "bool", "true"), R.PropertyRule("d", "deep", 1, "date", low="2024-01-01", high="2024-12-31")])
    assert {r.source_key: r.points for r in points.collect()} == {"s1": 3, "s2": 0}


def test_vectors(spark):
    v = spark.createDataFrame([("s1", "i1", [1.0]), ("s2", "i2", [2.0])], "source_key string, source_identity string, embedding array<float>")
    new = spark.createDataFrame([("s1", "i1", [9.0]), ("s2", "i3", [8.0])], v.schema)
    assert sorted((r.source_key, r.embedding[0]) for r in V.replace_vectors(v, new).collect()) == [("s1", 1.0), ("s2", 8.0)]
    one = spark.createDataFrame([("a b",)], "t string").select(V.hash_embedding("t").alias("v")).first().v
    assert abs(sum(x * x for x in one) - 1) < 1e-6


def test_stream_matches_batches(spark, tmp_path):
    rows = [(i, "edit", f"/w/n{i % 3}.md", f"2024-01-01 00:00:{i * 0.1:09.6f}" if i < 5 else f"2024-01-01 00:00:{5 + i * 0.1:09.6f}") for i in range(9)]
    spark.createDataFrame(rows, "event_id long, kind string, path string, at string").withColumn("ts", F.to_timestamp("at")).drop("at").write.parquet(f"{tmp_path}/in")
    roots = spark.createDataFrame([("v", "/w")], "vault_id string, root string")
    events = spark.readStream.schema("event_id long, kind string, path string, ts timestamp").parquet(f"{tmp_path}/in")
    seen, fails = [], []

    def act(frame, epoch):
        seen.extend(frame.collect())

    def follow(frame, epoch):
        raise RuntimeError("no model")

    q = ST.run_reconcile(ST.pending_batches(ST.classify(events, roots)), act, f"{tmp_path}/check", follow, available_now=False)
    ST.drain(q, 60)
    assert q.failures and seen[0].n_events == 5 and seen[0].paths == ["n0.md", "n1.md", "n2.md"] and not seen[0].full_rescan
    assert not fails


def test_metrics_and_status(spark):
    assert ST.freshness(None, False) == "unavailable" and ST.freshness(1, False) == "current" and ST.freshness(999, False) == "stale"
    chunks = spark.createDataFrame([("c1", "s1"), ("c2", "s2")], "chunk_id string, source_key string")
    assert M.check_integrity(chunks, chunks, spark.createDataFrame([("s1",)], "source_key string")) == {"postings_without_chunk": 0, "chunks_without_source": 1, "sources_without_chunk": 0, "repeated_chunks": 0}

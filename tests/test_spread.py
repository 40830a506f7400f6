"""Work that costs time by the row is dealt out, and its shortcuts change no result."""

import pytest
import yaml

from gleanery.operators import index as I
from gleanery.sources import markdown, prepare


def test_a_small_file_is_not_one_tasks_work(spark):
    rows = [("v", "r", f"{i}.md", bytearray(b"---\ntitle: t\n---\nwords"), 22, 100) for i in range(200)]
    files = spark.createDataFrame(rows, "vault_id string, room string, path string, content binary, byte_length long, mtime long").coalesce(1)
    sizes = [n for n in prepare.prepare(files).rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect() if n]
    assert sum(sizes) == 200 and max(sizes) < 50


@pytest.mark.parametrize("text", ["title: A\ntags: [a, t1, 7]\naliases: ['A1 ', B]\nother: {a: [1]}", "date: 2024-01-02\nn: 0x1f\nb: yes\nc: true\nd: ~", "a: 1\na: 2", "a: [", "- - a", "a: &x b\nc: *x", "a: |\n  b\n   c\n", "'\\ufeff': 1", "a:\tb", "? a\n: b", "a: " + "[" * 400 + "]" * 400, "", "- " * 300])
def test_both_yaml_parsers_agree(text):
    def read(loader):
        try:
            return repr(yaml.load(text, loader))
        except (yaml.YAMLError, RecursionError):
            return "malformed"

    if markdown._quick(text):
        assert read(markdown._Quick) == read(markdown._Loader)
    assert markdown._quick("title: A\ntags: [a, b]\n") and not any(map(markdown._quick, ("a:\tb", "? a", "\ufeff", "[" * 51, "- " * 50)))


def test_page_titles_have_the_references_that_their_sql_knows(spark, tmp_path):
    from gleanery import catalog

    from .conftest import duck, same_rows

    titles = ["a &amp; b", "token = &quot;x&quot;", "cut off &amp", "&lt;b&gt; &#62; &nbsp;&copy", "&amp;lt; &amp;quot;", ""]
    rows = [(i, f"http://x/{i}", f"<html><head><title>{t}</title></head><body>{t}</body></html>") for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    same_rows(catalog.QUERIES["page_titles"](spark, str(tmp_path)), duck(str(tmp_path)).sql(catalog.ORACLES["page_titles"]))


def test_vocabularies_shuffle_terms_alone(spark, small):
    """No row per posting leaves the JVM or is shuffled; a chunk's terms are counted where it stands."""
    from gleanery import catalog

    for name in ("vocabulary", "typo_vocabulary"):
        plan = catalog.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan and plan.count("Exchange hashpartitioning") == 1


QUERIES = ("river stonew", "rfc 7230 river", "stone wall", "content:[ri TO st} OR tags:>a", "ston* AND river", "+river^2 wall -word", "한국")


def test_one_pass_answers_like_whole_postings(spark):
    from gleanery.operators import search as S

    from .test_engine import NOTES, files

    chunks = prepare.chunks(prepare.prepare(files(spark, NOTES | {"k.md": "# 한국 river\n한국 말 stone river"}))).cache()
    made, whole = S.Index(chunks), S.Index(chunks).cached()
    for q in QUERIES:
        found = lambda ix: [(r.chunk_id, r.tier, r.score) for r in ix.search(q).orderBy("rank").collect()]  # noqa: B023, E731
        assert found(made) == found(whole), q


def test_a_query_makes_no_whole_postings(spark, small):
    """What is asked for is found in one pass in the JVM; stages and statistics read that."""
    from gleanery import catalog

    for name in ("dismax_multi_field", "explicit_boolean", "phrase_match", "ladder_phrase_first"):
        plan = catalog.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan and "/hits-" in plan and "text" not in plan


def test_an_update_sorts_no_postings(spark, small):
    from gleanery import catalog

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.QUERIES["incremental_equals_rebuild"](spark, small)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_publishing_reads_chunks_once_a_table(spark, tmp_path):
    """Finding the bounds of ranges made every table twice."""
    from gleanery.operators import manifest as M

    from .test_engine import NOTES, files

    sources = prepare.prepare(files(spark, NOTES)).cache()
    chunks = prepare.chunks(sources).cache()
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    kept = M.Generations(spark, f"file://{tmp_path}/g")
    kept.publish_index(sources, chunks.mapInArrow(counted, chunks.schema))
    assert seen.value <= 7 * chunks.count()  # names read them twice
    terms = [r.term for r in kept.read("postings").coalesce(1).select("term").collect()]
    assert sorted(terms) == sorted(r.term for r in I.postings(I.fields(chunks)).select("term").collect())


def test_pages_are_read_once_a_search(spark, small):
    from gleanery import catalog

    plan = catalog.QUERIES["page_search"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "/chunks-" in plan and "MapInArrow" not in plan and "pages.parquet" not in plan

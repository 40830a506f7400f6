"""The registered queries and the pipeline's stages themselves, on the smallest tables and on odd ones."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from gleanery.llm import packing as P
from gleanery.llm import queries

from .conftest import ODD
from .test_corpus_operators import judge_brute, stats_brute
from .test_text_operators import component_brute, spans_brute, suffix_brute, unigram  # noqa: F401  a fixture


@pytest.fixture(scope="module")
def texts(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang").collect()
    return {r.doc_id: (r.text, r.lang) for r in rows}


def test_op2(spark, small, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries()["op2_suffix_dedup"](spark, small).collect()}
    ids = sorted(texts)
    assert [got[i] for i in ids] == suffix_brute([texts[i][0] for i in ids], 200)


def test_op3(spark, small, texts):
    got = queries()["op3_jaccard"](spark, small).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == component_brute([(i, t) for i, (t, _) in texts.items()], 4, 85, 100)


def test_op4(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    found = defaultdict(list)
    for r in sorted(queries()["op4_nearest"](spark, small).collect(), key=lambda r: r.rank):
        found[r.query_id].append((r.vec_id, r.score))
    s, hit, want = x @ x.T, 0, 0
    for q in np.flatnonzero(ids % 20 == 0):
        best = sorted(((-s[q, j], int(ids[j])) for j in range(len(ids)) if j != q))[:20]
        mine = found[int(ids[q])]
        assert len(mine) == 20 and all(abs(score - s[q, list(ids).index(i)]) < 1e-12 for i, score in mine)
        assert mine == sorted(mine, key=lambda m: (-m[1], m[0]))
        hit += len({i for _, i in best} & {i for i, _ in mine})
        want += 20
    assert hit >= 0.9 * want


def test_op5(spark, small, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.default_tokenizer())
    t.encode_special_tokens = True
    by, bins = defaultdict(list), defaultdict(list)
    for r in queries()["op5_packing"](spark, small).collect():
        by[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    for i, (text, _) in texts.items():
        ids, at = [*t.encode(text or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for b in bins.values():
        size = sum(r.length for r in b)
        assert size <= 2048 and size & (size - 1) == 0 and len(b) <= P.SEGMENTS
        assert sorted(r.offset for r in b) == np.cumsum([0, *(r.length for r in sorted(b, key=lambda r: r.offset))])[:-1].tolist()


def test_op8(spark, small, texts):
    ids = sorted(texts)
    want = dict(zip(ids, judge_brute([texts[i] for i in ids]), strict=True))
    for r in queries()["op8_quality"](spark, small).collect():
        n, failed, kept, loss, _ = want[r.doc_id]
        assert (r.n_words, r.base_failed, r.kept) == (n, failed, kept) and (loss is None or abs(r.loss - loss) < 1e-5)
        assert {k: getattr(r, k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")} == stats_brute(texts[r.doc_id][0] or "")


def test_op9(spark, small, texts, unigram):  # noqa: F811
    got = {r.doc_id: r.n_tokens for r in queries()["op9_token_counts"](spark, small).collect()}
    assert got == {i: len(unigram.encode(t or "", add_special_tokens=False).ids) for i, (t, _) in texts.items()}


def test_op10(spark, small, texts):
    for r in queries()["op10_secret_scan"](spark, small).collect():
        base = spans_brute(texts[r.doc_id][0] or "")
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(filter(None, r.spans.split(",")))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(base.count(f"{k}:") for k in ("assign", "access", "hex"))


def test_stages_of_odd_and_empty_tables(spark, odd, nothing):
    """Every stage on nulls, repeats, ties, empty and long texts, and columns with clashing names."""
    import corpus_pipeline as C

    for i, (_, stage) in enumerate(C.STAGES):
        assert stage(spark, nothing, None).count() == 0
        out = stage(spark, odd, None)
        if i < len(C.STAGES) - 1:
            assert out.columns == odd.columns
        rows = out.collect()
        if i == 0:
            assert rows == []  # short, repeating or empty: all fail the base rules
        elif i == 1:
            assert len(rows) == len(ODD) and {r.n_chars for r in rows} == {len(r.text) for r in rows}
        elif i == 2:
            assert len(rows) == len(ODD) - 1
        elif i == 3:
            assert {r.text for r in rows} <= {r[1] for r in ODD if (r[1] or "").strip()}
        else:
            assert len({(r.doc_id, r.start, r.sequence_id) for r in rows}) == len(rows) and sum(r.start == 0 for r in rows) == len(ODD)


def test_largest_id_is_no_null(spark):
    """The largest number there is is an id like any other, in every operator that orders by id."""
    from gleanery.llm import jaccard, line_dedup, suffix_dedup

    top = 2**63 - 1
    rows = [(top, "one line that is shared here\nand more words of its own"), (None, "one line that is shared here\nother words"), (3, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.n_dropped) for r in line_dedup.line_dedup(docs).collect()} == {(top, 0), (None, 1), (3, 0)}
    assert {r.doc_id for r in suffix_dedup.suffix_dedup(docs).collect()} == {top, None, 3}
    assert {(r.doc_id, r.component_id) for r in jaccard.near_components(docs).collect()} == {(top, top), (None, None), (3, 3)}
